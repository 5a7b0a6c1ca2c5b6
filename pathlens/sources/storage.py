"""Tables in shared storage: cut lineage, and publish catalogs version by version."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only a local master may go without and gets a temporary folder; elsewhere that would be a folder
    that the other machines don't see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="pathlens-"))
    return _LOCAL[0]


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept reliably, so that lost executors don't bring back the whole plan."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str, prefix: str = "version") -> list[int]:
    """Published versions, ascending. A folder counts once its _SUCCESS file is there."""
    where, store = _folder(spark, root)
    if not store.exists(where):
        return []
    jvm = spark.sparkContext._jvm
    found = [re.fullmatch(rf"{prefix}=(\d+)", s.getPath().getName()) for s in store.listStatus(where)]
    done = [int(m[1]) for m in found if m and store.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{m[0]}/_SUCCESS"))]
    return sorted(done)


def publish(entries: DataFrame, root: str) -> int:
    """Write the next version, a folder per volume, sorted by name within files for tight row-group statistics.

    Readers of older versions are not disturbed; a failed write leaves no _SUCCESS and is not seen.
    """
    new = max(versions(entries.sparkSession, root), default=0) + 1
    parts = entries.repartitionByRange("volume", "name_lc", "frn") if "name_lc" in entries.columns else entries
    order = ["volume", "name_lc"] if "name_lc" in entries.columns else ["volume", "frn"]
    parts.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("volume").parquet(f"{root}/version={new}")
    return new


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A published version, the latest by default."""
    known = versions(spark, root)
    if not known or (version or known[-1]) not in known:
        raise FileNotFoundError(f"no published version {version or ''} in {root}")
    return spark.read.parquet(f"{root}/version={version or known[-1]}")
