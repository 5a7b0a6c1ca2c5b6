"""A query for each operator over the catalog that the star-schema tables give, and its SQL.

The SQL states each predicate on its own; it shares no text with what the parser and compiler make.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.functions import paths
from pathlens.operators import hierarchy, stats
from pathlens.operators.search import as_json, count, matches, search, union_page
from pathlens.sources.catalog import CUSTOMERS, excluded, info, merged, micros, star_catalog, star_nodes, star_volumes, table
from pathlens.streaming.changes import CREATE, DELETE, RENAME_NEW, RENAME_OLD, compact, replay

NOW = datetime(1998, 8, 5, 12, tzinfo=timezone.utc)  # a Wednesday
DAY = "86400000000000"

ENTRIES = """
WITH regions AS (SELECT r_regionkey + 100 AS frn, r_name AS name FROM region),
nations AS (SELECT n_nationkey + 1000 AS frn, n_regionkey + 100 AS parent_frn, n_name AS name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
customers AS (SELECT c_custkey + 1000000000000 AS frn, c_nationkey + 1000 AS parent_frn, c_name AS name, r_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
docs AS (SELECT doc_id, n_chars, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang FROM documents),
placed AS (
SELECT 'C:' AS volume, 1 AS frn, 1 AS parent_frn, '.' AS name, 16 AS attrs, 0 AS size, 0 AS mtime_ns, 'C:\\' AS path, NULL AS parent_name_lc, 0 AS depth
UNION ALL SELECT 'C:', frn, 1, name, 16, 0, 0, 'C:\\' || name, '.', 1 FROM regions
UNION ALL SELECT 'C:', frn, parent_frn, name, 16, 0, 0, 'C:\\' || r_name || '\\' || name, lower(r_name), 2 FROM nations
UNION ALL SELECT 'C:', frn, parent_frn, name, 16, 0, 0, 'C:\\' || r_name || '\\' || n_name || '\\' || name, lower(n_name), 3 FROM customers
UNION ALL SELECT 'C:', o_orderkey + 2000000000000, o_custkey + 1000000000000, fname, CASE o_orderstatus WHEN 'O' THEN 34 WHEN 'P' THEN 37 ELSE 32 END, floor(o_totalprice)::BIGINT, epoch_us(o_orderdate) * 1000, 'C:\\' || r_name || '\\' || n_name || '\\' || c_name || '\\' || fname, lower(c_name), 4
 FROM (SELECT *, 'order-' || lpad(o_orderkey::VARCHAR, 8, '0') || '.' || lower(regexp_extract(o_orderpriority, '([A-Za-z]+)', 1)) AS fname FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'F:', 1, 1, '.', 16, 0, 0, 'F:\\', NULL, 0
UNION ALL SELECT DISTINCT 'F:', ('0x' || substr(md5(source), 1, 15))::BIGINT, 1, source, 16, 0, 0, 'F:\\' || source, '.', 1 FROM docs
UNION ALL SELECT DISTINCT 'F:', ('0x' || substr(md5(source || '/' || lang), 1, 15))::BIGINT, ('0x' || substr(md5(source), 1, 15))::BIGINT, lang, 16, 0, 0, 'F:\\' || source || '\\' || lang, lower(source), 2 FROM docs
UNION ALL SELECT 'F:', doc_id + 1000000000000, ('0x' || substr(md5(source || '/' || lang), 1, 15))::BIGINT, fname, 32, n_chars, 0, 'F:\\' || source || '\\' || lang || '\\' || fname, lower(lang), 3
 FROM (SELECT *, 'doc-' || doc_id || '.' || ['txt', 'md', 'html'][doc_id % 3 + 1] AS fname FROM docs)),
entries AS (SELECT *, (attrs & 16) = 16 AS is_dir, lower(name) AS name_lc, lower(path) AS path_lc, CASE WHEN contains(name, '.') THEN regexp_extract(lower(name), '\\.([^.]*)$', 1) ELSE '' END AS ext FROM placed)
""".replace("\\\\", "\\")

JOURNAL = """,
puts AS (SELECT user_id + 1000000000000 AS frn, arg_max('user-' || user_id || '-' || event_id, event_id) AS new_name, arg_max(1000 + event_id % 25, event_id) AS new_parent, max(event_id) AS put FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id),
dels AS (SELECT user_id + 1000000000000 AS frn, max(event_id) AS del FROM events WHERE event_type = 'error' GROUP BY user_id),
after AS (SELECT e.volume, e.frn, coalesce(p.new_name, e.name) AS name, coalesce(p.new_parent, e.parent_frn) AS parent_frn, CASE WHEN p.frn IS NULL THEN e.size ELSE 1024 END AS size,
 CASE WHEN d.frn IS NOT NULL AND d.del > coalesce(p.put, -1) THEN true ELSE x.frn IS NOT NULL END AS deleted
 FROM (SELECT * FROM entries WHERE volume = 'C:') e LEFT JOIN puts p ON e.frn = p.frn LEFT JOIN dels d ON e.frn = d.frn LEFT JOIN dels x ON e.parent_frn = x.frn AND e.depth = 4
 UNION ALL SELECT 'C:', p.frn, p.new_name, p.new_parent, 1024, coalesce(d.del > p.put, false) FROM puts p LEFT JOIN dels d USING (frn) WHERE p.frn NOT IN (SELECT frn FROM entries WHERE volume = 'C:'))
"""

MOVED = r""",
live AS (SELECT frn, parent_frn, name FROM after WHERE NOT deleted),
walk AS (SELECT frn, name, CASE WHEN name = '.' THEN '' ELSE '\' || name END AS tail FROM live WHERE parent_frn = frn OR parent_frn NOT IN (SELECT frn FROM live)
 UNION ALL SELECT l.frn, l.name, w.tail || '\' || l.name FROM live l JOIN walk w ON l.parent_frn = w.frn WHERE l.parent_frn <> l.frn),
moved AS (SELECT frn, name, 'C:' || CASE WHEN tail = '' THEN '\' ELSE tail END AS path FROM walk)
"""

#: key: (query, options, SQL condition). All matches, unordered.
FILTERS: dict[str, tuple[str, dict, str]] = {
    "C1_term_name": ("customer#0000001", {}, "contains(name_lc, 'customer#0000001')"),
    "C2_term_path": ("europe order-000001", {"match_path": True}, "contains(path_lc, 'europe') AND contains(path_lc, 'order-000001')"),
    "C3_and": ("urgent order 001", {}, "contains(name_lc, 'urgent') AND contains(name_lc, 'order') AND contains(name_lc, '001')"),
    "C4_or_groups": ("path:asia|path:africa ext:low", {}, "(contains(path_lc, 'asia') OR contains(path_lc, 'africa')) AND ext = 'low'"),
    "C5_not": ("ext:urgent !11 -7.", {}, "ext = 'urgent' AND NOT contains(name_lc, '11') AND NOT contains(name_lc, '7.')"),
    "C6_ext_list": ("ext:.urgent|md", {}, "ext IN ('urgent', 'md')"),
    "C7_dotted_path_mode": ("path:EUROPE .high", {}, "contains(path_lc, 'europe') AND ext = 'high'"),
    "C8_dotted_name_mode": (".md", {}, "contains(name_lc, '.md')"),
    "C9_fused_path": ("path:urope.high", {}, "contains(path_lc, 'urope.high')"),
    "C10_path_scoped": (r"path:C:\EUROPE\NATION_3", {}, "volume = 'C:' AND contains(path_lc, 'europe') AND contains(path_lc, 'nation_3')"),
    "C11_separator": (r"asia\nation_1/order", {}, "contains(path_lc, 'asia') AND contains(path_lc, 'nation_1') AND contains(path_lc, 'order')"),
    "C12_not_path": ("ext:urgent !path:europe", {}, "ext = 'urgent' AND NOT contains(path_lc, 'europe')"),
    "C13_dir": ("dir:nation_1 ext:medium", {}, "contains(path_lc, 'nation_1') AND ext = 'medium'"),
    "C14_parent": ("parent:nation_3", {}, "parent_name_lc = 'nation_3'"),
    "C15_glob": ("glob:doc-?[0-4]*.md", {}, "regexp_matches(name_lc, '^doc-.[0-4].*[.]md$')"),
    "C15_glob_bare": ("*7.low", {}, "name_lc LIKE '%7.low'"),
    "C16_regex": (r"regex:NATION_[12]\\Customer#\d+7\\.*\.(urgent|low)$", {}, r"regexp_matches(path_lc, 'nation_[12]\\customer#[0-9]+7\\.*\.(urgent|low)$')"),
    "C17_type_dir": ("type:dir", {}, "is_dir"),
    "C17_type_file": ("type:file customer", {"match_path": True}, "NOT is_dir AND contains(path_lc, 'customer')"),
    "C18_size_range": ("size:>=100k size:<200kb", {}, "size >= 102400 AND size < 204800"),
    "C19_date_iso_open": ("dm:1998-08-04", {}, f"mtime_ns >= epoch_us(TIMESTAMP '1998-08-04') * 1000 AND mtime_ns <> 0"),
    "C19_date_lastweek": ("dm:lastweek", {"now": NOW}, "mtime_ns >= epoch_us(TIMESTAMP '1998-07-27') * 1000 AND mtime_ns < epoch_us(TIMESTAMP '1998-08-03') * 1000"),
    "C20_modified_after": ("type:file", {"modified_after": datetime(2000, 5, 5, tzinfo=timezone.utc)}, "NOT is_dir AND mtime_ns > epoch_us(TIMESTAMP '2000-05-05') * 1000"),
    "C20_recent": ("ext:low", {"recent": timedelta(days=30), "now": datetime(2001, 8, 1, tzinfo=timezone.utc)}, "ext = 'low' AND mtime_ns > epoch_us(TIMESTAMP '2001-07-02') * 1000"),
    "C21_attributes": ("attrib:HA|attrib:RS ext:high", {}, "((attrs & 34) = 34 OR (attrs & 5) = 5) AND ext = 'high'"),
    "C22_case": ("case:EUROPE", {"match_path": True}, "contains(path, 'EUROPE')"),
    "C23_volume": ("F: .md", {}, "volume = 'F:' AND contains(name_lc, '.md')"),
    "C24_under": ("order", {"under": r"c:\europe\NATION_3"}, r"contains(name_lc, 'order') AND starts_with(path_lc, 'c:\europe\nation_3\')"),
    "C31_aliases": ("location:nation_1 date:1998-01-01 extension:urgent sz:>1k", {"aliases": True}, "contains(path_lc, 'nation_1') AND ext = 'urgent' AND size > 1024 AND mtime_ns >= epoch_us(TIMESTAMP '1998-01-01') * 1000"),
    "C31_folder_alias": ("folder:nation_1", {"aliases": True}, "is_dir AND contains(name_lc, 'nation_1')"),
    "C31_nested_alias": ("file:extension:.urgent name:0001", {"aliases": True}, "NOT is_dir AND ext = 'urgent' AND contains(name_lc, '0001')"),
}

#: key: (query, options, SQL condition, SQL order, limit). Ordered pages.
PAGES: dict[str, tuple[str, dict, str, str, int]] = {
    "F1_sort_name": ("order 1", {}, "contains(name_lc, 'order') AND contains(name_lc, '1')", "name_lc", 100),
    "F2_sort_size": ("path:EUROPE ext:urgent sort:size", {"limit": 20}, "contains(path_lc, 'europe') AND ext = 'urgent'", "size, name_lc", 20),
    "F3_sort_modified": ("ext:md|low sort:modified", {"limit": 50}, "ext IN ('md', 'low')", "mtime_ns = 0, mtime_ns DESC, name_lc", 50),
    "F4_sort_extension": ("path:nation_2 sort:extension", {"limit": 200}, "contains(path_lc, 'nation_2')", "ext, name_lc", 200),
    "F5_sort_type": ("path:asia sort:type", {"limit": 400}, "contains(path_lc, 'asia')", "is_dir DESC, name_lc", 400),
    "F6_sort_path": ("type:file sort:path", {"limit": 100}, "NOT is_dir", "path_lc", 100),
    "F8_cross_volume": ("1 sort:size", {"limit": 150}, "contains(name_lc, '1')", "size, name_lc", 150),
    "F9_default_limit": ("type:file", {}, "NOT is_dir", "name_lc", 100),
    "F12_bias": ("ext:urgent", {"limit": 300, "cwd_bias": r"C:\ASIA"}, "ext = 'urgent'", r"starts_with(path_lc, 'c:\asia\') DESC, name_lc", 300),
}

#: key: (query, options, SQL condition). One row n.
COUNTS: dict[str, tuple[str, dict, str]] = {
    "E1_count": ("path:europe !ext:low size:>10k", {}, "contains(path_lc, 'europe') AND ext <> 'low' AND size > 10240"),
    "E3_count_scalar": ("size:>300000 dm:1997-01-01", {}, "size > 300000 AND mtime_ns >= epoch_us(TIMESTAMP '1997-01-01') * 1000"),
    "E4_count_subtree": ("path:nation_1", {}, "contains(path_lc, 'nation_1')"),
    "E5_count_union": ("ext:md|path:src1|ext:txt", {}, "ext IN ('md', 'txt') OR contains(path_lc, 'src1')"),
    "E6_count_term": ("0", {}, "contains(name_lc, '0')"),
    "E7_count_type": ("type:dir customer", {}, "is_dir AND contains(name_lc, 'customer')"),
}

SHOWN = ("volume", "frn", "path", "is_dir", "size", "mtime_ns")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("event_type") == "signup", CREATE).when(F.col("event_type") == "purchase", RENAME_NEW).when(F.col("event_type") == "error", DELETE).otherwise(RENAME_OLD)
    name = F.concat_ws("-", F.lit("user"), F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(F.lit("C:").alias("volume"), F.col("event_id").alias("usn"), (F.col("user_id") + CUSTOMERS).alias("frn"), (F.col("event_id") % 25 + 1000).alias("parent_frn"), reason.alias("reason"), F.lit(0x10).alias("attrs"), name.alias("name"))


def _filter(query: str, options: dict) -> Callable:
    return lambda spark, sf_dir: matches(star_catalog(spark, sf_dir), query, volumes=star_volumes(spark) if "F:" in query else None, **options).select(*SHOWN)


def _page(query: str, options: dict) -> Callable:
    return lambda spark, sf_dir: search(star_catalog(spark, sf_dir), query, **options).select("rank", *SHOWN)


def _count(query: str, options: dict) -> Callable:
    return lambda spark, sf_dir: count(star_catalog(spark, sf_dir), query, **options)


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(star_nodes(spark, sf_dir).filter("volume = 'C:'"), _changes(spark, sf_dir))


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "A6_merge_missing": (
        lambda s, d: merged(star_nodes(s, d).filter("frn % 3 <> 0"), star_nodes(s, d).withColumns({"size": F.lit(0).cast("long"), "mtime_ns": F.lit(0).cast("long")})).select("volume", "frn", "name", "size", "mtime_ns"),
        "SELECT volume, frn, name, CASE WHEN frn % 3 <> 0 THEN size ELSE 0 END AS size, CASE WHEN frn % 3 <> 0 THEN mtime_ns ELSE 0 END AS mtime_ns FROM entries"),
    "A7_exclude_subtree": (
        lambda s, d: excluded(star_catalog(s, d), [r"c:\Asia", r"F:\src1"]).select("volume", "frn", "path"),
        r"SELECT volume, frn, path FROM entries WHERE path_lc NOT IN ('c:\asia', 'f:\src1') AND NOT starts_with(path_lc, 'c:\asia\') AND NOT starts_with(path_lc, 'f:\src1\')"),
    "A14_info": (
        lambda s, d: info(star_catalog(s, d)),
        "SELECT volume, count(*) AS n, count(*) FILTER (NOT is_dir) AS n_files, count(*) FILTER (is_dir) AS n_dirs, sum(size)::BIGINT AS bytes, max(mtime_ns) AS newest_ns FROM entries GROUP BY volume"),
    "B1_paths": (lambda s, d: hierarchy.entries(star_nodes(s, d)).select("volume", "frn", "path", "depth", "parent_name_lc"), "SELECT volume, frn, path, depth, parent_name_lc FROM entries"),
    "B3_extension": (lambda s, d: star_catalog(s, d).select("volume", "frn", "ext"), "SELECT volume, frn, ext FROM entries"),
    "B4_json": (
        lambda s, d: as_json(search(star_catalog(s, d), "ext:urgent sort:size", limit=30)),
        """SELECT rank, '{"path":"' || replace(path, '\\', '\\\\') || '","name":"' || name || '","is_dir":false,"size":' || size || ',"modified":"' || strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') || '","index_source":"' || volume || '"}' AS json
FROM (SELECT row_number() OVER (ORDER BY size, name_lc, path_lc, volume, frn) AS rank, * FROM entries WHERE ext = 'urgent') WHERE rank <= 30"""),
    "B5_dir_and_base": (lambda s, d: star_catalog(s, d).select("volume", "frn", paths.dir_name(F.col("path")).alias("dir"), paths.base_name(F.col("path")).alias("base")), r"SELECT volume, frn, regexp_replace(path, '\\[^\\]*$', '') AS dir, regexp_extract(path, '([^\\]*)$', 1) AS base FROM entries"),
    "B9_filetime": (lambda s, d: table(s, d, "orders").select("o_orderkey", paths.filetime_to_ns(micros("o_orderdate") * 10 + paths.FILETIME_EPOCH - F.lit(9 * 10**15)).alias("ns")), "SELECT o_orderkey, greatest(epoch_us(o_orderdate) * 1000 - 900000000000000000, 0) AS ns FROM orders"),
    "B10_grams": (lambda s, d: table(s, d, "part").select("p_partkey", F.explode(paths.grams(F.lower("p_name"))).alias("gram")), "SELECT DISTINCT p_partkey, substr(lower(p_name), i, 3) AS gram FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part)"),
    "C27_deleted": (lambda s, d: matches(star_catalog(s, d).withColumn("deleted", F.col("frn") % 3 == 0), "order").select(*SHOWN), "SELECT volume, frn, path, is_dir, size, mtime_ns FROM entries WHERE contains(name_lc, 'order') AND frn % 3 <> 0"),
    "D2_children": (lambda s, d: hierarchy.children(star_nodes(s, d)), "SELECT volume, parent_frn AS frn, count(*) AS n_children FROM entries WHERE parent_frn <> frn GROUP BY ALL"),
    "D6_descendants_of_hits": (
        lambda s, d: hierarchy.descendants(e := star_catalog(s, d), matches(e, "type:dir nation_1").select("volume", "frn")).select("volume", "frn", "path"),
        "SELECT volume, frn, path FROM entries WHERE contains(path_lc, 'nation_1')"),
    "E2_count_by_ext": (lambda s, d: stats.counts_by(star_catalog(s, d), "ext"), "SELECT ext, count(*) AS n FROM entries GROUP BY ext"),
    "E8_overlay_count": (lambda s, d: count(_replayed(s, d).withColumn("name_lc", F.lower("name")), "user"), "SELECT count(*) AS n FROM after WHERE NOT deleted AND contains(lower(name), 'user')"),
    "E9_gram_frequency": (lambda s, d: stats.gram_frequencies(star_catalog(s, d)), "SELECT gram, count(*) AS df FROM (SELECT DISTINCT volume, frn, substr(name_lc, i, 3) AS gram FROM (SELECT volume, frn, name_lc, unnest(range(1, length(name_lc) - 1)) AS i FROM entries)) GROUP BY gram"),
    "E10_postings": (
        lambda s, d: stats.postings(star_catalog(s, d), F.col("ext")).select("key", "volume", "block", F.size("ids").alias("n"), F.element_at("ids", 1).alias("least")),
        "SELECT ext AS key, volume, frn // 1048576 AS block, count(*)::INT AS n, min(frn) AS least FROM entries GROUP BY ALL"),
    "E11_gram_limit": (lambda s, d: stats.gram_frequencies(star_catalog(s, d), 250), "SELECT gram, count(*) AS df FROM (SELECT DISTINCT volume, frn, substr(name_lc, i, 3) AS gram FROM (SELECT volume, frn, name_lc, unnest(range(1, length(name_lc) - 1)) AS i FROM entries)) GROUP BY gram HAVING count(*) <= 250"),
    "E14_latency_stats": (
        lambda s, d: stats.percentile_floor(table(s, d, "events").select("value"), "value", [0.5, 0.9, 0.95, 0.99]),
        "SELECT count(*) AS n, min(value) AS min, max(value) AS max, " + ", ".join(f"list_sort(list(value))[floor({p} * (count(*) - 1))::BIGINT + 1] AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM events"),
    "E17_result_hash": (
        lambda s, d: stats.result_hash(search(star_catalog(s, d), "ext:urgent sort:size", limit=500)),
        "SELECT sha256(string_agg(path, chr(10) ORDER BY path)) AS hash FROM (SELECT path FROM entries WHERE ext = 'urgent' ORDER BY size, name_lc, path_lc, volume, frn LIMIT 500)"),
    "G3_except": (
        lambda s, d: matches(e := star_catalog(s, d), "ext:low").select("volume", "frn").join(matches(e, "path:asia").select("volume", "frn"), ["volume", "frn"], "left_anti"),
        "SELECT volume, frn FROM entries WHERE ext = 'low' AND NOT contains(path_lc, 'asia')"),
    "G6_interval_merge": (
        lambda s, d: hierarchy.merged_intervals(table(s, d, "part").select(F.col("p_brand").alias("volume"), (F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + F.col("p_size") * 5).alias("end"))),
        """SELECT volume, min(s) AS start, max(e) AS "end" FROM (SELECT volume, s, e, sum(gap) OVER (PARTITION BY volume ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT volume, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY volume ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS gap
FROM (SELECT p_brand AS volume, p_partkey * 7 AS s, p_partkey * 7 + p_size * 5 AS e FROM part))) GROUP BY volume, island"""),
    "G4_limited_union": (
        lambda s, d: union_page(star_catalog(s, d), ["ext:low sort:size", "path:asia"], limit=60).select("rank", "volume", "frn", "path"),
        "SELECT (row_number() OVER (ORDER BY size, name_lc, path_lc, volume, frn))::INT AS rank, volume, frn, path FROM entries WHERE ext = 'low' OR contains(path_lc, 'asia') QUALIFY rank <= 60"),
    "E12_block_min_rank": (
        lambda s, d: stats.block_least(hierarchy.numbered(hierarchy.dense_ids(star_catalog(s, d).select("volume", "frn", "name_lc")), ["name_lc", "frn"], "rank")),
        "SELECT volume, record_id // 1024 AS block, min(rank) AS least FROM (SELECT volume, row_number() OVER (PARTITION BY volume ORDER BY frn) - 1 AS record_id, row_number() OVER (PARTITION BY volume ORDER BY name_lc, frn) - 1 AS rank FROM entries) GROUP BY ALL"),
    "E13_build_statistics": (
        lambda s, d: stats.build_statistics(star_catalog(s, d)),
        "SELECT volume, count(*) AS n, count(*) FILTER (is_dir) AS n_dirs, 0::BIGINT AS n_deleted, sum(strlen(name))::BIGINT AS name_bytes, sum(strlen(path))::BIGINT AS path_bytes, max(depth) AS deepest, sum(len(list_distinct([name_lc[i : i + 2] for i in range(1, length(name_lc) - 1)])))::BIGINT AS n_grams FROM entries GROUP BY volume"),
    "E15_nearest_rank": (
        lambda s, d: stats.percentile_nearest(table(s, d, "events").select("value"), "value", [0.5, 0.95, 0.99]),
        "SELECT count(*) AS n, min(value) AS min, max(value) AS max, " + ", ".join(f"list_sort(list(value))[ceil(count(*) * {p}::DOUBLE)::BIGINT] AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM events"),
    "E16_upper_median": (lambda s, d: stats.upper_median(table(s, d, "events").select("value"), "value"), "SELECT count(*) AS n, min(value) AS min, max(value) AS max, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events"),
    "H10_gram_search": (
        lambda s, d: stats.by_grams(e := star_catalog(s, d), stats.gram_table(e), "customer#0000001").select("volume", "frn", "path"),
        "SELECT volume, frn, path FROM entries WHERE contains(name_lc, 'customer#0000001')"),
    "H12_gram_intersection": (
        lambda s, d: stats.by_grams(e := star_catalog(s, d), stats.gram_table(e), "order-0", "urgent", "11").select("volume", "frn", "path"),
        "SELECT volume, frn, path FROM entries WHERE contains(name_lc, 'order-0') AND contains(name_lc, 'urgent') AND contains(name_lc, '11')"),
    "H14_gram_count": (
        lambda s, d: stats.gram_candidates(stats.gram_table(star_catalog(s, d)), stats.needle_grams("urgent", "r-00")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT count(*) AS n FROM entries WHERE " + " AND ".join(f"contains(name_lc, '{g}')" for g in ("-00", "ent", "gen", "r-0", "rge", "urg"))),
    "J8_paths_after_moves": (
        lambda s, d: hierarchy.entries(compact(_replayed(s, d))).select("volume", "frn", "path"),
        "SELECT 'C:' AS volume, frn, path FROM moved"),
    "F14_backfill": (
        lambda s, d: search(hierarchy.entries(compact(_replayed(s, d))), "user", limit=25).select("rank", "frn", "path"),
        "SELECT (row_number() OVER (ORDER BY lower(name), lower(path), frn))::INT AS rank, frn, path FROM moved WHERE contains(lower(name), 'user') QUALIFY rank <= 25"),
    "J5_journal_replay": (lambda s, d: _replayed(s, d).select("volume", "frn", "parent_frn", "name", "size", "deleted"), "SELECT volume, frn, parent_frn, name, size, deleted FROM after"),
    "J12_compaction": (lambda s, d: compact(_replayed(s, d)).select("volume", "frn", "name"), "SELECT volume, frn, name FROM after WHERE NOT deleted"),
    "B7_dense_ids": (lambda s, d: hierarchy.dense_ids(star_nodes(s, d)).select("volume", "frn", "record_id"), "SELECT volume, frn, (row_number() OVER (PARTITION BY volume ORDER BY frn) - 1)::INT AS record_id FROM entries"),
    "K3_subtree_intervals": (
        lambda s, d: hierarchy.subtree_intervals(star_catalog(s, d)).select("volume", "frn", (F.col("sub_end") - F.col("sub_start")).alias("width")),
        r"SELECT a.volume, a.frn, count(*) AS width FROM entries a JOIN (SELECT array_to_string(parts[:i], '\') AS prefix FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT string_split(rtrim(path_lc, '\'), '\') AS parts FROM entries))) b ON rtrim(a.path_lc, '\') = b.prefix GROUP BY a.volume, a.frn"),
    "K4_under_roots": (
        lambda s, d: hierarchy.descendants(e := star_catalog(s, d), hierarchy.root_of(e, "C:/europe").unionByName(hierarchy.root_of(e, r"c:\EUROPE\nation_3"))).select("volume", "frn", "path"),
        r"SELECT volume, frn, path FROM entries WHERE path_lc = 'c:\europe' OR starts_with(path_lc, 'c:\europe\')"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _filter(q, o) for k, (q, o, _) in FILTERS.items()} | {k: _page(q, o) for k, (q, o, *_) in PAGES.items()} | {k: _count(q, o) for k, (q, o, _) in COUNTS.items()} | {k: f for k, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    shown = ", ".join(SHOWN)
    out = {k: f"{ENTRIES} SELECT {shown} FROM entries WHERE {w}" for k, (_, _, w) in FILTERS.items()}
    for k, (_, _, where, order, limit) in PAGES.items():
        out[k] = f"{ENTRIES} SELECT * FROM (SELECT (row_number() OVER (ORDER BY {order}, path_lc, volume, frn))::INT AS rank, {shown} FROM entries WHERE {where}) WHERE rank <= {limit}"
    out |= {k: f"{ENTRIES} SELECT count(*) AS n FROM entries WHERE {w}" for k, (_, _, w) in COUNTS.items()}
    for k, (_, sql) in OTHERS.items():
        if " moved" in sql:
            out[k] = f"{ENTRIES}{JOURNAL}{MOVED} {sql}".replace("WITH regions", "WITH RECURSIVE regions", 1)
        else:
            out[k] = f"{ENTRIES}{JOURNAL if ' after' in sql else ''} {sql}" if " entries" in sql or " after" in sql else sql
    return out
