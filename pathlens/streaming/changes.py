"""The change journal: replay over a base catalog, in batch and with Structured Streaming.

A change has volume, usn (its order), frn, parent_frn, reason, attrs and name. Create and rename-new
put the node in place as given; delete marks the node, and what lies below it at that moment through
nodes that are not deleted. Other reasons do nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathlens.functions.paths import is_directory
from pathlens.sources.catalog import NODE_COLUMNS
from pathlens.sources.storage import load, publish, settle, versions

# Reason bits of the Windows change journal.
CREATE, DELETE, RENAME_OLD, RENAME_NEW = 0x100, 0x200, 0x1000, 0x2000
# Size and time of a node that a change put in place (2026-01-01).
NEW_SIZE, NEW_MTIME_NS = 1024, 1767225600 * 10**9
BEFORE, NEVER = -1, (1 << 63) - 1
MAX_ROUNDS = 200
CHANGE_SCHEMA = "volume string, usn long, frn long, parent_frn long, reason int, attrs int, name string"


class StaleCheckpoint(RuntimeError):
    """The journal no longer holds what follows the checkpoint: rebuild."""


class Unsettled(RuntimeError):
    """Deletes still spread after MAX_ROUNDS levels."""


def check_checkpoint(journal_id: int, checkpoint: int, current_id: int, lowest: int, following: int) -> None:
    """Raises StaleCheckpoint unless it is the same journal and lowest <= checkpoint <= following."""
    if journal_id != current_id or not lowest <= checkpoint <= following:
        raise StaleCheckpoint(f"journal {journal_id} at {checkpoint}; now {current_id} with {lowest} to {following}")


def _deletes() -> Column:
    return F.col("reason").bitwiseAND(DELETE) != 0


def _puts() -> Column:
    return ~_deletes() & (F.col("reason").bitwiseAND(CREATE | RENAME_NEW) != 0)


def spans(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(volume, frn, since, until, parent_frn, alive, own): each stay of a node below one parent.

    since is the usn that put it there (BEFORE for the base), until the next such usn; own is the
    first delete of the node itself within; alive is false for base rows that were deleted.
    """
    first = base.select("volume", "frn", F.lit(BEFORE).cast("long").alias("usn"), "parent_frn", (~F.col("deleted")).alias("alive"), F.lit(True).alias("put"))
    later = changes.filter(_puts() | _deletes()).select("volume", "frn", "usn", "parent_frn", F.lit(True).alias("alive"), _puts().alias("put"))
    touched = later.select("volume", "frn").distinct()
    still = first.join(touched, ["volume", "frn"], "left_anti").select("volume", "frn", F.col("usn").alias("since"), F.lit(NEVER).cast("long").alias("until"), "parent_frn", "alive", F.lit(None).cast("long").alias("own"))
    by_node = Window.partitionBy("volume", "frn").orderBy("usn")
    moved = first.join(touched, ["volume", "frn"], "left_semi").unionByName(later)
    # A delete belongs to the stay that the last put before it began.
    stay = moved.withColumn("since", F.max(F.when(F.col("put"), F.col("usn"))).over(by_node.rowsBetween(Window.unboundedPreceding, 0)))
    own = stay.filter("since is not null").groupBy("volume", "frn", "since").agg(F.max(F.when(F.col("put"), F.col("parent_frn"))).alias("parent_frn"), F.bool_and("alive").alias("alive"), F.min(F.when(~F.col("put"), F.col("usn"))).alias("own"))
    until = F.coalesce(F.lead("since").over(Window.partitionBy("volume", "frn").orderBy("since")), F.lit(NEVER))
    return own.withColumn("until", until).select(*still.columns).unionByName(still)


def received(stays: DataFrame, kills: DataFrame) -> DataFrame:
    """(volume, frn, since, usn): the first delete of the parent that a live node sees during a stay.

    kills are joined by parent; only the first counts, so pre-aggregation is safe where a directory is hot.
    """
    above = kills.select("volume", F.col("frn").alias("parent_frn"), "usn")
    hit = stays.filter("alive and parent_frn <> frn").join(above, ["volume", "parent_frn"])
    hit = hit.filter((F.col("usn") > F.col("since")) & (F.col("usn") < F.col("until")) & (F.col("own").isNull() | (F.col("usn") < F.col("own"))))
    return hit.groupBy("volume", "frn", "since").agg(F.min("usn").alias("usn"))


def directory_kills(stays: DataFrame, changes: DataFrame) -> DataFrame:
    """(volume, frn, usn): when each directory was deleted, itself or with one above it.

    One join per level of the tree, over stays of directories only, until nothing changes.
    """
    own = settle(changes.filter(_deletes()).select("volume", "frn", "usn").distinct())
    parents = stays.select("volume", F.col("parent_frn").alias("frn")).distinct()
    dirs = settle(stays.join(parents, ["volume", "frn"], "left_semi"))
    kills, seen = own, None
    for _ in range(MAX_ROUNDS):
        state = kills.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("volume", "frn", "usn").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return kills
        seen = state
        kills = settle(own.unionByName(received(dirs, kills).select("volume", "frn", "usn")).distinct())
    raise Unsettled(f"deletes still spread after {MAX_ROUNDS} levels")


def replay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes after all changes in usn order. Deleted nodes stay, marked; neither input is altered.

    Changes are grouped by node; deletes spread level by level through directories; files see them in
    one join. Deletes of unknown nodes still reach nodes below their id. The same change twice counts once.
    """
    changes = settle(changes.select("volume", "usn", "frn", "parent_frn", "reason", "attrs", "name").dropDuplicates(["volume", "usn", "frn", "reason"]))
    stays = settle(spans(base, changes))
    kills = directory_kills(stays, changes)
    last = stays.filter(F.col("until") == NEVER)
    dead = received(last, kills).select("volume", "frn", F.lit(True).alias("fell"))
    newest = changes.filter(_puts()).groupBy("volume", "frn").agg(F.max_by(F.struct("parent_frn", "name", "attrs"), "usn").alias("new"))
    ends = last.join(dead, ["volume", "frn"], "left").select("volume", "frn", (~F.col("alive") | F.col("own").isNotNull() | F.coalesce("fell", F.lit(False))).alias("gone"))
    old = base.select(*NODE_COLUMNS)
    whole = ends.join(newest, ["volume", "frn"], "left").join(old, ["volume", "frn"], "left")
    put = F.col("new").isNotNull()
    pick = lambda new, col: F.when(put, new).otherwise(F.col(col)).alias(col)
    return whole.select("volume", "frn", pick(F.col("new.parent_frn"), "parent_frn"), pick(F.col("new.name"), "name"), pick(F.col("new.attrs"), "attrs"), pick(is_directory(F.col("new.attrs")), "is_dir"), pick(F.lit(NEW_SIZE).cast("long"), "size"), pick(F.lit(NEW_MTIME_NS).cast("long"), "mtime_ns"), F.col("gone").alias("deleted"))


def compact(nodes: DataFrame) -> DataFrame:
    """Nodes without deleted rows, for the next base."""
    return nodes.filter(~F.col("deleted"))


def due(nodes: DataFrame, n_changes: int, most_changes: int = 1_000_000, most_deleted: float = 0.25) -> bool:
    """Whether to compact: too many changes wait, or too large a share of rows is deleted."""
    if n_changes >= most_changes:
        return True
    row = nodes.agg(F.avg(F.col("deleted").cast("double")).alias("share")).first()
    return (row["share"] or 0.0) >= most_deleted


class Journal:
    """A base and a change log in one shared folder. A stream appends; readers see base and log; compaction folds the log in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def start(self, stream: DataFrame, **trigger):
        """The running query that appends a stream of changes. A batch that is written again replaces itself."""

        def append(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.root}/log/batch={number}")

        return stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{self.root}/stream").trigger(**(trigger or {"availableNow": True})).start()

    def log(self, upto: int | None = None) -> DataFrame:
        """Changes of finished batches, up to a batch number if one is given."""
        done = [n for n in versions(self.spark, f"{self.root}/log", "batch") if upto is None or n <= upto]
        if not done:
            return self.spark.createDataFrame([], CHANGE_SCHEMA)
        return self.spark.read.schema(CHANGE_SCHEMA).parquet(*[f"{self.root}/log/batch={n}" for n in done])

    def base(self, version: int | None = None) -> DataFrame:
        return load(self.spark, f"{self.root}/base", version)

    def view(self, upto: int | None = None) -> DataFrame:
        """Nodes of the latest base with the log replayed on them. What it returned doesn't change with later batches."""
        version = versions(self.spark, f"{self.root}/base")[-1]
        return replay(self.base(version), self.pending(version, upto))

    def pending(self, version: int, upto: int | None = None) -> DataFrame:
        """Logged changes that base `version` doesn't hold."""
        if version not in versions(self.spark, f"{self.root}/folded"):
            return self.log(upto)
        folded = self.spark.read.parquet(f"{self.root}/folded/version={version}")
        return self.log(upto).join(folded, "volume", "left").filter(F.col("usn") > F.coalesce("folded", F.lit(BEFORE))).drop("folded")

    def fold(self) -> int:
        """Write the next base from base and log; returns its version.

        What it holds is written first, under the version it will have, so a crash between the two
        writes leaves the old base with its own mark.
        """
        last = max(versions(self.spark, f"{self.root}/log", "batch"), default=-1)
        now = settle(self.view(last))
        new = versions(self.spark, f"{self.root}/base")[-1] + 1
        self.log(last).groupBy("volume").agg(F.max("usn").alias("folded")).write.mode("overwrite").parquet(f"{self.root}/folded/version={new}")
        return publish(compact(now), f"{self.root}/base")
