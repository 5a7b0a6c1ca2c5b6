"""Search, count and explain over catalog entries."""

from __future__ import annotations

import functools
import json
import operator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlens.plans.compiler import predicate, under
from pathlens.plans.parser import ParsedQuery, QueryError, parse, to_ns

DEFAULT_LIMIT = 100


@dataclass(frozen=True)
class Options:
    match_path: bool = False
    case_sensitive: bool = False
    limit: int = 0
    under: str = ""
    modified_after: datetime | None = None
    recent: timedelta | None = None
    cwd_bias: str = ""
    root_bias: str = ""
    now: datetime | None = None
    week_start: int = 0
    aliases: bool = False


def understood(query: str, o: Options) -> ParsedQuery:
    return parse(query, o.match_path, o.case_sensitive, o.now, o.week_start, o.aliases)


def condition(q: ParsedQuery, o: Options) -> Column:
    """The whole predicate. Deleted rows never match; an unknown time (0) is never recent."""
    out = ~F.col("deleted") & predicate(q)
    after = o.modified_after or (((o.now or datetime.now(timezone.utc)) - o.recent) if o.recent else None)
    if after:
        out &= (F.col("mtime_ns") != 0) & (F.col("mtime_ns") > F.lit(to_ns(after)))
    return out & under(o.under) if o.under else out


def order_of(sort: str) -> list[Column]:
    """A total order; ties end with path, volume and id."""
    name = F.col("name_lc")
    keys = {
        "size": [F.col("size"), name],
        "modified": [F.col("mtime_ns") == 0, F.col("mtime_ns").desc(), name],
        "extension": [F.col("ext"), name],
        "type": [F.col("is_dir").desc(), name],
        "path": [],
    }
    keys["recent"] = keys["modified"]
    return [*keys.get(sort, [name]), F.col("path_lc"), F.col("volume"), F.col("frn")]


def check_capabilities(q: ParsedQuery, o: Options, volumes: DataFrame | None) -> None:
    """Raises QueryError where a volume that the query reaches lacks sizes, times or attributes. volumes: a row each."""
    if volumes is None:
        return
    needs = {
        "has_size": q.sort == "size" or any(p.sizes for p in q.parts()),
        "has_mtime": q.sort in ("modified", "recent") or bool(o.recent or o.modified_after) or any(p.dates for p in q.parts()),
        "has_attrs": any(p.attributes for p in q.parts()),
    }
    for row in volumes.collect():
        if q.drives and row["volume"].upper() not in q.drives:
            continue
        for flag, needed in needs.items():
            if needed and not row[flag]:
                raise QueryError(f"volume {row['volume']} has no {flag.removeprefix('has_')} metadata; build its catalog with it")


def matches(entries: DataFrame, query: str, options: Options = Options(), volumes: DataFrame | None = None, **more) -> DataFrame:
    """All entries that the query matches, unordered and unlimited."""
    o = Options(**(options.__dict__ | more))
    q = understood(query, o)
    check_capabilities(q, o, volumes)
    return entries.filter(condition(q, o))


def search(entries: DataFrame, query: str, options: Options = Options(), volumes: DataFrame | None = None, **more) -> DataFrame:
    """The best `limit` entries (100 if not positive) with their rank from 1, over all volumes.

    The limit follows the order, so Spark keeps a bounded heap per task and no full sort.
    """
    o = Options(**(options.__dict__ | more))
    q = understood(query, o)
    check_capabilities(q, o, volumes)
    order = order_of(q.sort)
    bias = o.cwd_bias or o.root_bias
    if bias:
        order = [under(bias).desc(), *order]
    page = entries.filter(condition(q, o)).orderBy(*order).limit(o.limit if o.limit > 0 else DEFAULT_LIMIT)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a page, not the table


def union_page(entries: DataFrame, queries: list[str], limit: int = 0, **more) -> DataFrame:
    """The best `limit` entries that any of the queries matches, each once, in the order of the first: one scan for all."""
    o = Options(**more)
    parsed = [understood(q, o) for q in queries]
    order = order_of(parsed[0].sort)
    either = functools.reduce(operator.or_, [condition(q, o) for q in parsed])
    page = entries.filter(either).orderBy(*order).limit(limit if limit > 0 else DEFAULT_LIMIT)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a page, not the table


def count(entries: DataFrame, query: str, options: Options = Options(), volumes: DataFrame | None = None, **more) -> DataFrame:
    """One row with n, the exact number of matches whatever the limit. Path columns are read only if the query needs them."""
    o = Options(**(options.__dict__ | more))
    q = understood(query, o)
    check_capabilities(q, o, volumes)
    return entries.filter(condition(q, o)).agg(F.count(F.lit(1)).alias("n"))


def as_json(page: DataFrame) -> DataFrame:
    """Result rows as JSON text; the time is RFC 3339, absent where unknown."""
    time = F.when(F.col("mtime_ns") != 0, F.date_format(F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return page.select("rank", F.to_json(F.struct("path", "name", "is_dir", "size", time.alias("modified"), F.col("volume").alias("index_source"))).alias("json"))


def explain(entries: DataFrame, query: str, options: Options = Options(), **more) -> dict:
    """How a query is understood and run: its parts, whether paths are read, and Spark's plan."""
    o = Options(**(options.__dict__ | more))
    q = understood(query, o)
    page = search(entries, query, o)
    plan = page._jdf.queryExecution().executedPlan().toString()
    return {
        "match_path": q.match_path, "case_sensitive": q.case_sensitive, "needs_path": q.needs_path or bool(o.under), "volumes": list(q.drives),
        "terms": list(q.terms), "filters": json.loads(json.dumps({k: getattr(q, k) for k in ("exts", "dirs", "parents", "globs", "regexes", "sizes", "dates", "attributes") if getattr(q, k)})),
        "alternatives": len(q.or_groups), "negations": len(q.not_groups), "sort": q.sort or "name", "pushed": "PushedFilters" in plan, "plan": plan,
    }
