"""The query language: parser, aliases, and searches over a small tree against expected names."""

from datetime import datetime, timezone

import pytest

from pathlens.operators import hierarchy
from pathlens.operators.search import condition, count, explain, search, Options, understood
from pathlens.plans.parser import QueryError, parse, parse_size, render, unfinished

# The trees and the names expected below.
NODES = "volume string, frn long, parent_frn long, name string, attrs int, is_dir boolean, size long, mtime_ns long, deleted boolean"
DAY = 86400 * 10**9
TREE = """1:1:D:. 2:1:D:fixture 3:2:D:workspace 4:3:D:Assets 5:4:F:sample.dat 6:4:F:notes.txt 7:3:D:src 8:7:F:main.go
9:7:F:search_test.go 10:3:F:README.md 11:3:F:readme.md 12:3:D:project-data-worktree 13:12:F:volume.bin 14:3:F:archive.tar.gz
15:3:D:Downstream 16:15:F:sibling.dat"""
SECOND = """1:1:D:. 2:1:D:fixture 3:2:D:Downloads 4:3:F:camera.raw 5:3:F:scan.nrrd 6:3:F:draft.raw 7:2:D:Assets 8:7:F:asset.raw
9:2:D:Lab 10:9:F:lab.raw 11:2:D:ai.opencode.desktop 12:11:F:settings.json 13:2:D:Reports 14:13:F:manual.pdf 15:13:F:manual.pdf.bak"""


def tree(spark, text, volume="C:"):
    made = []
    for k, row in enumerate(text.split()):
        frn, parent, kind, name = row.split(":", 3)
        made.append((volume, int(frn), int(parent), name, 0x10 if kind == "D" else 0, kind == "D", 0 if kind == "D" else (k + 1) * 1024, 20574 * DAY, False))
    return hierarchy.entries(spark.createDataFrame(made, NODES))


@pytest.fixture(scope="module")
def first(spark):
    return tree(spark, TREE).cache()


@pytest.fixture(scope="module")
def second(spark):
    return tree(spark, SECOND).cache()


FIRST = [
    ("main", 0, "", "main.go"), ("assets dat", 1, "", "sample.dat"), ("project .bin", 1, "", "volume.bin"), ("c: .bin", 1, "", "volume.bin"),
    (".tar.gz", 1, "", "archive.tar.gz"), ("ext:go", 1, "", "main.go search_test.go"), ("dir:src ext:go", 1, "", "main.go search_test.go"),
    ("workspace ext:go", 1, "", "main.go search_test.go"), ("src main.go", 1, "", "main.go"), ("downstream ext:dat", 1, "", "sibling.dat"),
    ("glob:*_test.go", 1, "", "search_test.go"), (r"regex:Assets.*\.dat$", 1, "", "sample.dat"), ("type:file assets", 1, "", "sample.dat notes.txt"),
    ("type:dir assets", 1, "", "Assets"), ("ext:dat", 1, r"C:\fixture\workspace\Assets", "sample.dat"), ("ext:dat", 1, r"C:\fixture\workspace\Down", ""), ("case: README", 0, "", "README.md"),
]
RAW = "camera.raw draft.raw"
SECOND_CASES = [
    ("path:Downloads ext:raw", RAW), ("path:Downloads .raw", RAW), (r"path:C:\fixture\Downloads .raw", RAW), ("dir:Downloads ext:.raw", RAW), ("path:Downloads glob:*.raw", RAW),
    (r"path:Downloads regex:Downloads.*\.raw$", RAW), ("path:Downloads ext:raw type:file !draft", "camera.raw"), ("path:Downloads ext:raw|nrrd", RAW + " scan.nrrd"),
    ("path:Downloads|path:Assets ext:raw", RAW + " asset.raw"), ("ext:raw !path:Assets", RAW + " lab.raw"), (".opencode", "ai.opencode.desktop"), (".pdf", "manual.pdf manual.pdf.bak"),
    ("path:.pdf", "manual.pdf"), ("path:Reports .pdf", "manual.pdf"), ("dir:Reports .pdf", "manual.pdf"), ("path:C: .opencode", "ai.opencode.desktop settings.json"), ("ext:opencode", ""),
    ("path:C:.nrrd", ""), ("path:Downloads.raw", ""), ("ext:pdf|path:Lab", "manual.pdf Lab lab.raw"),
]


@pytest.mark.parametrize("query,path,root,names", FIRST)
def test_first_tree(first, query, path, root, names):
    assert sorted(r["name"] for r in search(first, query, match_path=bool(path), under=root).collect()) == sorted(names.split())
    assert count(first, query, match_path=bool(path), under=root).first()["n"] == len(names.split())


@pytest.mark.parametrize("query,names", SECOND_CASES)
def test_second_tree(second, query, names):
    assert sorted(r["name"] for r in search(second, query).collect()) == sorted(names.split())


def test_token_order_and_limits(second):
    whole = [r["path"] for r in search(second, "raw path:fixture").collect()]
    assert whole == [r["path"] for r in search(second, "path:fixture raw").collect()]
    assert [r["path"] for r in search(second, "path:fixture raw", limit=2).collect()] == whole[:2]


@pytest.mark.parametrize("text,want", [(">100mb", (">", 100 << 20)), (">=1gb", (">=", 1 << 30)), ("<4k", ("<", 4096)), ("<=512", ("<=", 512)), ("1024", ("=", 1024)), ("=2048b", ("=", 2048))])
def test_sizes(text, want):
    assert parse_size(text) == want


@pytest.mark.parametrize("query", ["size2:>1mb", "color:red", "attrib:Z", "sort:size", "ext:txt sort:owner", r"parent:C:\repo", "parent:foo/bar", "parent:foo*", "size:", "size:>notanumber", "regex:a(?=b)", "regex:("])
def test_rejected(query):
    with pytest.raises(QueryError):
        parse(query)


@pytest.mark.parametrize("query", [r"c:\windows main", "ext:go", "parent:src", "size:>1mb", "attrib:H", "type:file", "ext:a|b !path:x -y", "a b|c glob:*x?", r"regex:README\.(md|txt)$"])
def test_render_round_trip(query):
    parsed = parse(query, True)
    assert parse(render(parsed), True) == parsed


def test_dates():
    now = datetime(2026, 7, 8, 12, tzinfo=timezone.utc)
    at = lambda d: int(datetime(2026, 7, d, tzinfo=timezone.utc).timestamp()) * 10**9
    assert parse("dm:today", now=now).dates == ((at(8), at(9)),)
    assert parse("dm:thisweek", now=now).dates == ((at(6), at(13)),)
    assert parse("dm:2026-07-03", now=now).dates == ((at(3), None),)
    assert parse("dm:2d", now=now).dates[0][0] == at(6) + DAY // 2


@pytest.mark.parametrize("query,same,path", [
    ("file:extension:.go", "type:file ext:go", False), ("folder:regex:^src$", "type:dir regex:^src$", False), ("fullpath:src main", "src main", True), ("files:main", "type:file main", False),
    ("directory:", "type:dir", False), ("dir:", "type:dir", False), ("location:src ext:go", "dir:src ext:go", True), ("filename:a sz:>1k", "a size:>1k", False), ("!folder:old x", "!type:dir !old x", False),
    ("datemodified:2026-01-01", "dm:2026-01-01", False), ("!ext:.go a", "!ext:go a", False), ("file:size:>1mb", "type:file size:>1mb", False), ("full-path:.go", "path:.go", True), ("case-sensitive:Ab", "case:Ab", False),
])
def test_aliases(query, same, path):
    assert parse(query, aliases=True) == parse(same, path)


def test_unfinished():
    assert unfinished("abc ext:") and unfinished("abc .") and not unfinished("abc") and not unfinished("") and not unfinished("ext:go a")


def test_missing_metadata(spark, first):
    volumes = spark.createDataFrame([("C:", False, False, False)], "volume string, has_size boolean, has_mtime boolean, has_attrs boolean")
    for query in ("size:>1", "a sort:modified", "dm:today", "!attrib:H"):
        with pytest.raises(QueryError):
            search(first, query, volumes=volumes)
    assert search(first, "main", volumes=volumes).count() == 1


def test_explain(first):
    said = explain(first, "path:src ext:go !main")
    assert said["needs_path"] and said["negations"] == 1 and "TakeOrderedAndProject" in said["plan"]
    assert understood("a", Options()).terms == ("a",) and condition(parse("a"), Options()) is not None
