"""What the operators of this subpackage share: tables, checkpoints and Arrow text buffers."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SHIPPED: set[str] = set()
_LOCAL: str | None = None


def ship(spark: SparkSession) -> None:
    """Give this package's modules to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(suffix=".zip", prefix="pathlens-")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as packed:
        for module in sorted(root.rglob("*.py")):
            packed.write(module, module.relative_to(root.parent))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(kind: T.DataType, rest: str) -> T.StructType:
    """A schema of `id`, of any type, and the columns of a DDL string."""
    return T.StructType([T.StructField("id", kind), *T.StructType.fromDDL(rest).fields])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local master, as in tests, may go without: it gets a temporary folder. Anywhere else a
    folder of one machine would be lost on the others, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    global _LOCAL
    _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="shared-")
    return _LOCAL


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one that is no longer read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint.

    The folder is the one the session names in spark.checkpoint.dir. Only where none is named, as
    in local tests, a temporary one is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished passes deleted, once nothing refers to them.

    Spark's cleaner follows the driver's garbage collection: the first round frees Python's handles, the next ones their data.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def trim() -> None:
    """Give memory that is no longer in use back to the system; Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not glibc


def lean(made: Callable) -> Callable:
    """A function for mapInArrow that trims its worker's memory after each batch and at its end: workers outlive their task."""

    @functools.wraps(made)
    def run(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                trim()

        yield from made(each(), *args, **kwargs)
        trim()

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a string or binary column; a null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width, empty = np.int64, b"" if pa.types.is_large_binary(column.type) else ""
    else:
        width, empty = np.int32, b"" if pa.types.is_binary(column.type) else ""
    if column.null_count:
        column = column.fill_null(empty)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return at, memoryview(data or b"")


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay near `most`; a longer row gets a range of its own."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(rows, max(high, low + 1))
        yield low, high
        low = high


def split_residue(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus
