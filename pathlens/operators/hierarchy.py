"""The file tree: paths, ancestors, cycle check, children, subtree intervals, descendants.

Only directories take part in the iteration; files join their directory once. Pointer doubling
needs about log2(depth) joins, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlens.functions.paths import extension
from pathlens.sources.storage import settle

MAX_ROUNDS = 40


class TreeError(ValueError):
    """Duplicate ids, or a parent chain that never ends."""


def _shown(name: Column) -> Column:
    return F.when(name.isin("", "."), F.lit("")).otherwise(F.concat(F.lit("\\"), name))


def check_unique(nodes: DataFrame) -> None:
    """An id that occurs twice in a volume is an error."""
    twice = nodes.groupBy("volume", "frn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise TreeError(f"duplicate id {twice[0]['frn']} in volume {twice[0]['volume']}")


def linked(nodes: DataFrame) -> DataFrame:
    """nodes with `up`: the parent's id, null for roots (parent 0, itself, or not found). Ids are unique in a volume."""
    parents = nodes.select("volume", F.col("frn").alias("up"), F.lit(True).alias("found"))
    wanted = F.when((F.col("parent_frn") != 0) & (F.col("parent_frn") != F.col("frn")), F.col("parent_frn"))
    return nodes.withColumn("up", wanted).join(parents, ["volume", "up"], "left").select(*nodes.columns, F.when(F.col("found"), F.col("up")).alias("up"))


def directory_paths(nodes: DataFrame) -> DataFrame:
    """(volume, frn, tail, ancestors, depth) of every node that is some node's parent, by pointer doubling.

    tail is the path behind the volume; ancestors run from the root to the node itself. Raises
    TreeError if chains still grow after MAX_ROUNDS doublings (a cycle).
    """
    up = nodes if "up" in nodes.columns else linked(nodes)
    parents = up.select("volume", F.col("up").alias("frn")).filter("frn is not null").distinct()
    inner = up.join(parents, ["volume", "frn"], "left_semi")
    state = settle(inner.select("volume", "frn", "up", _shown(F.col("name")).alias("tail"), F.array("frn").alias("ancestors"), "name"))
    for _ in range(MAX_ROUNDS):
        if state.filter("up is not null").isEmpty():
            return state.select("volume", "frn", "tail", "ancestors", (F.size("ancestors") - 1).alias("depth"), "name")
        above = state.select("volume", F.col("frn").alias("up"), F.col("up").alias("up2"), F.col("tail").alias("tail2"), F.col("ancestors").alias("a2"))
        grown = state.join(above, ["volume", "up"], "left")
        state = settle(grown.select("volume", "frn", F.col("up2").alias("up"), F.concat(F.coalesce("tail2", F.lit("")), "tail").alias("tail"), F.concat(F.coalesce("a2", F.expr("cast(array() as array<bigint>)")), "ancestors").alias("ancestors"), "name"))
        if state.filter(F.size(F.array_distinct("ancestors")) < F.size("ancestors")).limit(1).count():
            break
    raise TreeError("the parent chain has a cycle")


def entries(nodes: DataFrame) -> DataFrame:
    """nodes with name_lc, ext, parent_name_lc, path, path_lc, depth and ancestors (ids above, root first)."""
    up = settle(linked(nodes))  # read for the directories, their names and all entries
    dirs = directory_paths(up).select("volume", F.col("frn").alias("up"), F.col("tail").alias("dir_tail"), F.col("ancestors").alias("above"), F.lower("name").alias("parent_name_lc"))
    whole = up.join(dirs, ["volume", "up"], "left")
    tail = F.concat(F.coalesce("dir_tail", F.lit("")), _shown(F.col("name")))
    path = F.concat("volume", F.when(tail == "", "\\").otherwise(tail))
    above = F.coalesce("above", F.expr("cast(array() as array<bigint>)"))
    return whole.select(*nodes.columns, F.lower("name").alias("name_lc"), extension(F.lower("name")).alias("ext"), "parent_name_lc", path.alias("path"), F.lower(path).alias("path_lc"), F.size(above).alias("depth"), above.alias("ancestors"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`: 0, 1, ... per volume by `order`, which is total.

    The order is a range partitioning; only the number of rows of each partition is gathered, so no
    task sees a whole volume.
    """
    ordered = settle(df.drop(name).repartitionByRange("volume", *order).sortWithinPartitions("volume", *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy("volume", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("volume").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("volume", "part", "first", before.alias("before"))
    return ordered.withColumn("part", part).join(F.broadcast(offsets), ["volume", "part"]).select(*[c for c in df.columns if c != name], (F.col("at") - F.col("first") + F.col("before")).alias(name))  # a row per partition and volume


def dense_ids(nodes: DataFrame) -> DataFrame:
    """nodes with record_id: 0, 1, ... per volume by ascending id."""
    return numbered(nodes, ["frn"], "record_id").withColumn("record_id", F.col("record_id").cast("int"))


def children(nodes: DataFrame) -> DataFrame:
    """(volume, frn, n_children): counted, not collected, so a directory may have any number."""
    return linked(nodes).filter("up is not null").groupBy("volume", F.col("up").alias("frn")).agg(F.count(F.lit(1)).alias("n_children"))


#: Roots up to this number are compared within a row; more are joined.
FEW_ROOTS = 256


def descendants(whole: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries below or among roots (volume, frn), each once however roots are nested.

    A few roots become a predicate, so that nothing is shuffled. More are joined to every entry's
    chain of ancestors; the roots' side is small next to it, and rows of one hot root are split by AQE.
    """
    chain = F.concat("ancestors", F.array("frn"))
    wanted = roots.select("volume", "frn").distinct()
    few = wanted.limit(FEW_ROOTS + 1).collect()  # bounded
    if len(few) <= FEW_ROOTS:
        test = F.lit(False)
        for volume in sorted({r["volume"] for r in few}):
            ids = F.array(*(F.lit(r["frn"]).cast("long") for r in few if r["volume"] == volume))
            test = test | ((F.col("volume") == volume) & F.arrays_overlap(chain, ids))
        return whole.filter(test)
    marked = whole.select("volume", "frn", F.explode(chain).alias("a"))
    hit = marked.join(wanted.select("volume", F.col("frn").alias("a")), ["volume", "a"], "left_semi").select("volume", "frn").distinct()
    return whole.join(hit, ["volume", "frn"], "left_semi")


def subtree_sizes(whole: DataFrame) -> DataFrame:
    """(volume, frn, n_subtree): entries at and below every directory; the width of its preorder interval."""
    return whole.select("volume", F.explode(F.concat("ancestors", F.array("frn"))).alias("frn"), "is_dir").groupBy("volume", "frn").agg(F.count(F.lit(1)).alias("n_subtree"))


def subtree_intervals(whole: DataFrame) -> DataFrame:
    """(volume, frn, sub_start, sub_end): preorder positions, children by id; sub_end is exclusive.

    The preorder of a tree whose siblings are ordered by id is the order of the id chains, so a
    range partitioning by chain and counts per partition give the positions.
    """
    chain = F.concat("ancestors", F.array("frn"))
    ordered = settle(whole.select("volume", "frn", chain.alias("chain")).repartitionByRange("volume", "chain").sortWithinPartitions("volume", "chain").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy("volume", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("volume").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("volume", "part", "first", before.alias("before"))
    start = ordered.withColumn("part", part).join(F.broadcast(offsets), ["volume", "part"]).select("volume", "frn", (F.col("at") - F.col("first") + F.col("before")).alias("sub_start"))
    return start.join(subtree_sizes(whole), ["volume", "frn"]).select("volume", "frn", "sub_start", (F.col("sub_start") + F.col("n_subtree")).alias("sub_end"))


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching [start, end) of each volume as one (gaps and islands)."""
    order = Window.partitionBy("volume").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.coalesce(F.col("reach"), F.lit(-1)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return intervals.withColumn("reach", reach).withColumn("island", island).groupBy("volume", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def root_of(whole: DataFrame, path: str) -> DataFrame:
    """The entry whose path is `path`, whatever its case."""
    clean = path.replace("/", "\\").rstrip("\\").lower()
    return whole.filter(F.col("path_lc").isin(clean, clean + "\\"))
