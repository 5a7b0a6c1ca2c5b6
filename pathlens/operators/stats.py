"""Counts and statistics that catalogs and benchmarks need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlens.functions.paths import grams


def counts_by(entries: DataFrame, key: str) -> DataFrame:
    """(key, n) over live entries."""
    return entries.filter(~F.col("deleted")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def gram_frequencies(entries: DataFrame, most: int | None = None, width: int = 3) -> DataFrame:
    """(gram, df): how many live names hold a gram; with `most`, only grams that up to so many hold."""
    out = entries.filter(~F.col("deleted")).select(F.explode(grams(F.col("name_lc"), width)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return out if most is None else out.filter(F.col("df") <= most)


def postings(entries: DataFrame, key: Column, block: int = 1 << 20) -> DataFrame:
    """(key, block, ids): sorted ids per key, cut by id range so that no row grows with the table."""
    return entries.filter(~F.col("deleted")).groupBy(key.alias("key"), "volume", F.floor(F.col("frn") / block).alias("block")).agg(F.array_sort(F.collect_set("frn")).alias("ids"))


def gram_table(entries: DataFrame, width: int = 3) -> DataFrame:
    """(volume, frn, gram): the distinct grams of live names, to be written once and read by gram."""
    return entries.filter(~F.col("deleted")).select("volume", "frn", F.explode(grams(F.col("name_lc"), width)).alias("gram"))


def needle_grams(*needles: str, width: int = 3) -> list[str]:
    """The distinct grams that a name must hold to hold all needles; shorter needles give none."""
    return sorted({n.lower()[k : k + width] for n in needles for k in range(len(n) - width + 1)})


def gram_candidates(table: DataFrame, wanted: list[str]) -> DataFrame:
    """(volume, frn) of names that hold all wanted grams: the intersection of their lists."""
    held = table.filter(F.col("gram").isin(wanted)).groupBy("volume", "frn").agg(F.count(F.lit(1)).alias("n"))
    return held.filter(F.col("n") == len(wanted)).select("volume", "frn")


def by_grams(entries: DataFrame, table: DataFrame, *needles: str, width: int = 3) -> DataFrame:
    """Live entries whose names hold all needles: candidates by grams, then the test itself. Needles without grams are only tested."""
    test = ~F.col("deleted")
    for n in needles:
        test = test & F.contains(F.col("name_lc"), F.lit(n.lower()))
    wanted = needle_grams(*needles, width=width)
    near = entries.join(gram_candidates(table, wanted), ["volume", "frn"], "left_semi") if wanted else entries
    return near.filter(test)


def block_least(ranked: DataFrame, block: int = 1024) -> DataFrame:
    """(volume, block, least): the least rank of each block of record ids."""
    return ranked.groupBy("volume", F.floor(F.col("record_id") / block).cast("long").alias("block")).agg(F.min("rank").alias("least"))


def build_statistics(entries: DataFrame) -> DataFrame:
    """A row for each volume: what a build of the catalog reports."""
    return entries.groupBy("volume").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_dir").cast("long")).alias("n_dirs"), F.sum(F.col("deleted").cast("long")).alias("n_deleted"), F.sum(F.octet_length("name").cast("long")).alias("name_bytes"),
        F.sum(F.octet_length("path").cast("long")).alias("path_bytes"), F.max("depth").alias("deepest"), F.sum(F.greatest(F.size(grams(F.col("name_lc"))), F.lit(0)).cast("long")).alias("n_grams"))


def _places(values: DataFrame, column: str, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: n, min, max and, for each name, the sorted value at the place that its function gives for n.

    Distinct values are counted first and a range partitioning ranks them, so no task holds all of them.
    """
    from pathlens.operators.ranks import running

    totals = running(values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")), "v", "n")
    size = totals.agg(F.sum("n").alias("total"))
    hit = lambda place, name: F.max(F.when((place >= F.col("before")) & (place < F.col("before") + F.col("n")), F.col("v"))).alias(name)
    return totals.crossJoin(F.broadcast(size)).agg(F.max("total").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), *[hit(f(F.col("total")), name) for name, f in at.items()])  # one row is broadcast


def percentile_floor(values: DataFrame, column: str, at: list[float]) -> DataFrame:
    """n, min, max and p<k>, the sorted value at floor(p * (n - 1))."""
    return _places(values, column, {f"p{round(p * 100)}": lambda n, p=p: F.floor(F.lit(p) * (n - 1)) for p in at})


def percentile_nearest(values: DataFrame, column: str, at: list[float]) -> DataFrame:
    """n, min, max and p<k>, the sorted value at ceil(n * p) - 1, the nearest rank."""
    return _places(values, column, {f"p{round(p * 100)}": lambda n, p=p: F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0)) for p in at})


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """n, min, max and median, the sorted value at floor(n / 2)."""
    return _places(values, column, {"median": lambda n: F.floor(n / 2)})


def result_hash(page: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted paths of a page (bounded by its limit)."""
    return page.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("path"))), 256).alias("hash"))
