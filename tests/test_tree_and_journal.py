"""Tree operators and journal replay against plain Python."""

import random

import pytest

from pathlens.operators import hierarchy, stats
from pathlens.sources.catalog import IncompleteSource, gate, listing_nodes
from pathlens.sources.storage import load, publish, versions
from pathlens.streaming.changes import CHANGE_SCHEMA, CREATE, DELETE, RENAME_NEW, RENAME_OLD, Journal, StaleCheckpoint, check_checkpoint, compact, due, replay
from test_language import NODES, TREE, tree


def plain(base, changes):
    """One change after the other, over a dictionary."""
    nodes = {r[1]: list(r) for r in base}

    def kill(frn):
        if frn in nodes:
            nodes[frn][8] = True
        for other in [x for x, r in nodes.items() if x != frn and not r[8] and r[2] == frn]:
            kill(other)

    for volume, usn, frn, parent, reason, attrs, name in sorted(changes, key=lambda c: c[1]):
        if reason & DELETE:
            kill(frn)
        elif reason & (CREATE | RENAME_NEW):
            nodes[frn] = [volume, frn, parent, name, attrs, bool(attrs & 16), 1024, 1767225600 * 10**9, False]
    return {f: (r[2], r[3], r[8]) for f, r in nodes.items()}


def replayed(spark, base, changes):
    out = replay(spark.createDataFrame(base, NODES), spark.createDataFrame(changes, CHANGE_SCHEMA)).collect()
    return {r["frn"]: (r["parent_frn"], r["name"], r["deleted"]) for r in out}


def folder(frn, parent, name, deleted=False):
    return ("F:", frn, parent, name, 16, True, 0, 0, deleted)


def test_state_machine(spark):
    base = [folder(100, 100, ".")]
    c = lambda usn, frn, parent, reason, name, attrs=0: ("F:", usn, frn, parent, reason, attrs, name)
    changes = [c(10, 101, 100, CREATE, "alpha-needle.txt"), c(11, 102, 100, CREATE, "beta-needle.go"), c(13, 102, 100, RENAME_OLD, "beta-needle.go"), c(14, 102, 100, RENAME_NEW, "gamma-needle.go"),
               c(15, 103, 100, CREATE, "subdir", 16), c(16, 104, 103, CREATE, "delta-needle.txt"), c(17, 103, 100, DELETE, "subdir"), c(18, 101, 100, DELETE, ""), c(19, 101, 100, CREATE, "aaa-needle.md"),
               c(20, 105, 100, CREATE, "parent-a", 16), c(21, 106, 100, CREATE, "parent-b", 16), c(22, 107, 105, CREATE, "movable", 16), c(23, 108, 107, CREATE, "epsilon-needle.txt"), c(25, 107, 106, RENAME_NEW, "movable", 16),
               c(26, 102, 100, DELETE, ""), c(27, 109, 100, CREATE, "gamma-needle.go")]
    for n in (4, 7, 9, 14, 16):
        assert replayed(spark, base, changes[:n]) == plain(base, changes[:n])
    assert replayed(spark, base, []) == plain(base, [])
    assert replayed(spark, base, changes + changes) == plain(base, changes)


@pytest.mark.parametrize("seed", range(4))
def test_random_journal(spark, seed):
    rng = random.Random(seed)
    base = [folder(1, 1, ".")] + [folder(f, rng.randrange(1, f), f"n{f}", rng.random() < 0.1) for f in range(2, 40)]
    changes = []
    for usn in range(150):
        frn = rng.randrange(2, 50)
        # Parents have lower ids, so no move makes a cycle.
        changes.append(("F:", usn, frn, rng.randrange(1, frn), rng.choice([CREATE, RENAME_NEW, DELETE, DELETE, RENAME_OLD, 0]), 16, f"c{usn}"))
    assert replayed(spark, base, changes) == plain(base, changes)


def test_journal_stream(spark, tmp_path):
    base = [folder(1, 1, "."), folder(2, 1, "a"), folder(3, 2, "b")]
    root = str(tmp_path)
    publish(spark.createDataFrame(base, NODES), f"{root}/base")
    journal = Journal(spark, root)
    first, second = [("F:", 1, 4, 2, CREATE, 0, "x"), ("F:", 2, 5, 1, CREATE, 0, "y")], [("F:", 3, 2, 1, DELETE, 16, "a"), ("F:", 4, 4, 2, CREATE, 0, "z")]
    feed = lambda rows: spark.createDataFrame(rows, CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    feed(first)
    journal.start(spark.readStream.schema(CHANGE_SCHEMA).parquet(f"{root}/in")).awaitTermination()
    early = journal.view()
    shown = lambda df: {r["frn"]: (r["parent_frn"], r["name"], r["deleted"]) for r in df.collect()}
    assert shown(early) == plain(base, first)
    feed(second)
    journal.start(spark.readStream.schema(CHANGE_SCHEMA).parquet(f"{root}/in")).awaitTermination()
    assert shown(journal.view()) == plain(base, first + second)
    assert shown(early) == plain(base, first)  # a snapshot stays
    live = {f: v for f, v in plain(base, first + second).items() if not v[2]}
    assert journal.fold() == 2 and shown(journal.view()) == live and versions(spark, f"{root}/base") == [1, 2]
    assert load(spark, f"{root}/base", 1).count() == 3


def test_checkpoint_and_compaction(spark):
    check_checkpoint(10, 50, 10, 30, 100)
    for journal, at in ((10, 29), (10, 101), (11, 50)):
        with pytest.raises(StaleCheckpoint):
            check_checkpoint(journal, at, 10, 30, 100)
    nodes = spark.createDataFrame([folder(1, 1, "."), folder(2, 1, "a", True)], NODES)
    assert compact(nodes).count() == 1 and due(nodes, 0) and not due(nodes, 0, most_deleted=0.6) and due(nodes, 10, most_changes=10)


def test_tree(spark):
    whole = tree(spark, TREE).cache()
    spans = {r["frn"]: (r["sub_start"], r["sub_end"]) for r in hierarchy.subtree_intervals(whole).collect()}
    for r in whole.collect():
        inside = {f for f, (a, _) in spans.items() if spans[r["frn"]][0] <= a < spans[r["frn"]][1]}
        assert inside == {x["frn"] for x in whole.collect() if r["frn"] in [*x["ancestors"], x["frn"]]}
    with pytest.raises(hierarchy.TreeError):
        hierarchy.directory_paths(spark.createDataFrame([folder(1, 2, "a"), folder(2, 1, "b"), folder(3, 1, "c")], NODES))
    with pytest.raises(hierarchy.TreeError):
        hierarchy.check_unique(spark.createDataFrame([folder(1, 1, "."), folder(1, 1, "a")], NODES))


def test_sources(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_text("12345")
    (tmp_path / "a" / "y.md").write_text("1")
    from pathlens.sources.catalog import file_listing

    whole = hierarchy.entries(listing_nodes(file_listing(spark, str(tmp_path)), "C:")).collect()
    shown = {r["path"]: (r["is_dir"], r["size"]) for r in whole}
    at = "C:" + str(tmp_path).replace("/", "\\")
    assert shown[at + r"\a\b\x.txt"] == (False, 5) and shown[at + r"\a\b"] == (True, 0) and shown[at + r"\a\y.md"] == (False, 1)
    assert gate({}, 0) == "complete" and gate({"inaccessible": 1}, 2) == "degraded"
    with pytest.raises(IncompleteSource):
        gate({"inaccessible": 3}, 2)


def test_percentiles(spark):
    got = stats.percentile_floor(spark.createDataFrame([(x,) for x in range(10)], "x int"), "x", [0.5, 0.99]).first()
    assert (got["n"], got["min"], got["max"], got["p50"], got["p99"]) == (10, 0, 9, 4, 8)


def test_filters_and_columns_reach_the_published_catalog(spark):
    from conftest import SF
    from pathlens.operators.search import count, matches
    from pathlens.sources.catalog import star_catalog

    whole = star_catalog(spark, SF)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    said = plan(matches(whole, "ext:urgent size:>100k dm:1998-01-01").select("frn"))
    assert "EqualTo(ext,urgent)" in said and "GreaterThan(size,102400)" in said and "GreaterThanOrEqual(mtime_ns," in said
    assert "Join" not in said and "path" not in said.split("ReadSchema:")[1].split("\n")[0]
    assert "PartitionFilters: [" in plan(matches(whole, "F: .md")) and "Exchange" not in plan(matches(whole, "path:asia"))
    assert "name_lc" not in plan(count(whole, "size:>300000")).split("ReadSchema:")[1].split("\n")[0]


def test_many_roots_are_joined(spark, monkeypatch):
    whole = tree(spark, TREE).cache()
    roots = whole.filter("name in ('src', 'Assets', 'workspace')").select("volume", "frn")
    few = {r["frn"] for r in hierarchy.descendants(whole, roots).collect()}
    monkeypatch.setattr(hierarchy, "FEW_ROOTS", 1)
    assert {r["frn"] for r in hierarchy.descendants(whole, roots).collect()} == few and len(few) > 5


def test_query_file_and_places(spark, tmp_path):
    from pathlens.sources.catalog import query_file

    (tmp_path / "q.txt").write_text("# a comment\n\nmain\n  ext:md \nregex:.*test.*\n")
    assert query_file(spark, str(tmp_path / "q.txt")) == ["main", "ext:md", "regex:.*test.*"]
    values = spark.createDataFrame([(x,) for x in (5, 1, 4, 2, 3, 6)], "x int")
    assert stats.percentile_nearest(values, "x", [0.5, 0.95]).first().asDict() == {"n": 6, "min": 1, "max": 6, "p50": 3, "p95": 6}
    assert stats.upper_median(values, "x").first()["median"] == 4


def test_grams(spark):
    whole = tree(spark, TREE)
    table = stats.gram_table(whole)
    for needles in (("main",), ("te", "me"), ("volume", ".bin"), ("zzz",)):
        expected = sorted(r["name"] for r in whole.collect() if all(n in r["name"].lower() for n in needles))
        assert sorted(r["name"] for r in stats.by_grams(whole, table, *needles).collect()) == expected
