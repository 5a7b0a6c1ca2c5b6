"""Catalog sources: file listings, merges, exclusions, quality gates, and a catalog derived from star-schema tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.functions.paths import DIRECTORY, extension, stable_id
from pathlens.operators.hierarchy import descendants, entries as tree_entries
from pathlens.sources.storage import load, publish, shared_folder

CUSTOMERS, ORDERS = 10**12, 2 * 10**12
NODE_COLUMNS = ("volume", "frn", "parent_frn", "name", "attrs", "is_dir", "size", "mtime_ns", "deleted")


class IncompleteSource(RuntimeError):
    """A source lost more entries than the caller allows."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, volume: str, frn, parent, name, attrs=DIRECTORY, size=0, mtime=0) -> DataFrame:
    col = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return df.select(F.lit(volume).alias("volume"), col(frn, "long").alias("frn"), col(parent, "long").alias("parent_frn"), col(name, "string").alias("name"), col(attrs, "int").alias("attrs"), (col(attrs, "int").bitwiseAND(DIRECTORY) != 0).alias("is_dir"), col(size, "long").alias("size"), col(mtime, "long").alias("mtime_ns"), F.lit(False).alias("deleted"))


def micros(time: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({time} as timestamp_ntz))")


def text_id(text: Column) -> Column:
    """A positive id from 60 bits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume C: region / nation / customer / order file. Volume F: source / lang / document file, without times."""
    t = lambda name: table(spark, sf_dir, name)
    root = spark.range(1)
    status = F.col("o_orderstatus")
    bits = F.lit(0x20).bitwiseOR(F.when(status == "O", 0x2).when(status == "P", 0x5).otherwise(0))
    order_name = F.concat(F.lit("order-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("."), F.lower(F.regexp_extract("o_orderpriority", "([A-Za-z]+)", 1)))
    docs = t("documents").select("doc_id", "n_chars", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"))
    doc_ext = F.element_at(F.array(F.lit("txt"), F.lit("md"), F.lit("html")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    in_lang = F.concat_ws("/", "source", "lang")
    return (
        _nodes(root, "C:", 1, 1, ".")
        .unionAll(_nodes(t("region"), "C:", F.col("r_regionkey") + 100, 1, F.col("r_name")))
        .unionAll(_nodes(t("nation"), "C:", F.col("n_nationkey") + 1000, F.col("n_regionkey") + 100, F.col("n_name")))
        .unionAll(_nodes(t("customer"), "C:", F.col("c_custkey") + CUSTOMERS, F.col("c_nationkey") + 1000, F.col("c_name")))
        .unionAll(_nodes(t("orders"), "C:", F.col("o_orderkey") + ORDERS, F.col("o_custkey") + CUSTOMERS, order_name, bits, F.floor("o_totalprice"), micros("o_orderdate") * 1000))
        .unionAll(_nodes(root, "F:", 1, 1, "."))
        .unionAll(_nodes(docs.select("source").distinct(), "F:", text_id(F.col("source")), 1, F.col("source")))
        .unionAll(_nodes(docs.select("source", "lang").distinct(), "F:", text_id(in_lang), text_id(F.col("source")), F.col("lang")))
        .unionAll(_nodes(docs, "F:", F.col("doc_id") + CUSTOMERS, text_id(in_lang), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), doc_ext), 0x20, F.col("n_chars")))
    )


def star_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of star_nodes. The tree has four known levels, so three joins on keys give the paths."""
    nodes = star_nodes(spark, sf_dir)
    shown = lambda name: F.concat(F.lit("\\"), name)
    t = lambda name: table(spark, sf_dir, name)
    region = t("region").select((F.col("r_regionkey") + 100).cast("long").alias("up"), F.lit("C:").alias("volume"), shown(F.col("r_name")).alias("dir"), F.lower("r_name").alias("parent_name_lc"), F.lit(1).alias("dir_depth"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").withColumn("n_path", F.concat(F.coalesce(shown(F.col("r_name")), F.lit("")), shown(F.col("n_name"))))
    nation = nations.select((F.col("n_nationkey") + 1000).cast("long").alias("up"), F.lit("C:").alias("volume"), F.col("n_path").alias("dir"), F.lower("n_name").alias("parent_name_lc"), F.lit(2).alias("dir_depth"))
    customer = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select((F.col("c_custkey") + CUSTOMERS).alias("up"), F.lit("C:").alias("volume"), F.concat(F.coalesce("n_path", F.lit("")), shown(F.col("c_name"))).alias("dir"), F.lower("c_name").alias("parent_name_lc"), F.lit(3).alias("dir_depth"))
    pairs = t("documents").select(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang")).distinct()
    lang = pairs.select(text_id(F.concat_ws("/", "source", "lang")).alias("up"), F.lit("F:").alias("volume"), F.concat(shown(F.col("source")), shown(F.col("lang"))).alias("dir"), F.lower("lang").alias("parent_name_lc"), F.lit(2).alias("dir_depth"))
    source = pairs.select("source").distinct().select(text_id(F.col("source")).alias("up"), F.lit("F:").alias("volume"), shown(F.col("source")).alias("dir"), F.lower("source").alias("parent_name_lc"), F.lit(1).alias("dir_depth"))
    roots = spark.createDataFrame([(1, "C:", "", ".", 0), (1, "F:", "", ".", 0)], "up long, volume string, dir string, parent_name_lc string, dir_depth int")
    dirs = roots.unionAll(region).unionAll(nation).unionAll(customer).unionAll(lang).unionAll(source)
    up = F.when(F.col("parent_frn") != F.col("frn"), F.col("parent_frn")).alias("up")
    whole = nodes.select("*", up).join(dirs, ["volume", "up"], "left")
    tail = F.concat(F.coalesce("dir", F.lit("")), F.when(F.col("name") == ".", "").otherwise(shown(F.col("name"))))
    path = F.concat("volume", F.when(tail == "", "\\").otherwise(tail))
    return whole.select(*nodes.columns, F.lower("name").alias("name_lc"), extension(F.lower("name")).alias("ext"), "parent_name_lc", path.alias("path"), F.lower(path).alias("path_lc"), (F.coalesce("dir_depth", F.lit(-1)) + 1).alias("depth"))


_PUBLISHED: dict[tuple[str, str], str] = {}


def star_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of star_nodes as a published catalog: built once by an application, then read from its columns.

    Filters and the columns of a query reach the scan; nothing is joined again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PUBLISHED:
        root = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
        publish(tree_entries(star_nodes(spark, sf_dir)), root)
        _PUBLISHED[key] = root
    return load(spark, _PUBLISHED[key])


def query_file(spark: SparkSession, path: str) -> list[str]:
    """The queries of a text file: one a line, blank lines and those that begin with # left out."""
    line = F.trim("value")
    return [r[0] for r in spark.read.text(path).select(line.alias("q")).filter((F.col("q") != "") & ~F.col("q").startswith("#")).collect()]


def star_volumes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("C:", True, True, True), ("F:", True, False, True)], "volume string, has_size boolean, has_mtime boolean, has_attrs boolean")


def listing_nodes(files: DataFrame, volume: str) -> DataFrame:
    """Nodes of a file listing (path with /, length, modificationTime as Spark's binaryFile source names them) and of all directories above.

    Ids are hashes of the lower-case path. Directories have no time.
    """
    clean = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "/+$", "")
    parts = F.filter(F.split(clean, "/"), lambda p: p != "")
    rows = files.select(parts.alias("parts"), F.col("length").cast("long").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    key = lambda p: stable_id(F.lower(F.array_join(p, "\\")))
    at = lambda n: F.slice("parts", 1, n)
    depth = F.size("parts")
    found = rows.filter(depth > 0).select(key(F.col("parts")).alias("frn"), F.when(depth > 1, key(at(depth - 1))).otherwise(F.lit(0)).alias("parent_frn"), F.element_at("parts", -1).alias("name"), F.lit(0x20).alias("attrs"), "size", "mtime_ns")
    above = rows.filter(depth > 1).select(F.explode(F.sequence(F.lit(1), depth - 1)).alias("n"), "parts").select(at(F.col("n")).alias("parts")).distinct()
    dirs = above.select(key(F.col("parts")).alias("frn"), F.when(depth > 1, key(at(depth - 1))).otherwise(F.lit(0)).alias("parent_frn"), F.element_at("parts", -1).alias("name"), F.lit(DIRECTORY).alias("attrs"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"))
    both = dirs.unionByName(found)
    return both.select(F.lit(volume).alias("volume"), "frn", "parent_frn", "name", "attrs", (F.col("attrs") == DIRECTORY).alias("is_dir"), "size", "mtime_ns", F.lit(False).alias("deleted"))


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of all files below root, listed by Spark; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """first, and of second the ids that first lacks."""
    return first.unionByName(second.join(first.select("volume", "frn"), ["volume", "frn"], "left_anti"), allowMissingColumns=True)


def excluded(entries: DataFrame, paths: list[str]) -> DataFrame:
    """entries without the subtrees at `paths`, whatever their case. entries need ancestors."""
    clean = [p.replace("/", "\\").rstrip("\\").lower() for p in paths]
    roots = entries.filter(F.col("path_lc").isin(clean)).select("volume", "frn")
    return entries.join(descendants(entries, roots).select("volume", "frn"), ["volume", "frn"], "left_anti")


def gate(counts: dict[str, int], most: int) -> str:
    """'complete', or 'degraded' if at most `most` entries were inaccessible; raises IncompleteSource beyond."""
    lost = counts.get("inaccessible", 0)
    if lost > most:
        raise IncompleteSource(f"{lost} inaccessible entries, {most} allowed")
    return "degraded" if lost else "complete"


def info(entries: DataFrame) -> DataFrame:
    """A row per volume: entries, files, directories, bytes and newest time."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return entries.filter(~F.col("deleted")).groupBy("volume").agg(F.count(F.lit(1)).alias("n"), one(~F.col("is_dir"))("n_files"), one(F.col("is_dir"))("n_dirs"), F.sum("size").alias("bytes"), F.max("mtime_ns").alias("newest_ns"))
