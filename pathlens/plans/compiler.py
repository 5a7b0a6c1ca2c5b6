"""ParsedQuery to one boolean Column over catalog entries. No UDFs: Catalyst pushes what it can to the scan."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlens.functions.paths import SEPARATOR, glob, regex_literal
from pathlens.plans.parser import ParsedQuery

_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}


def _all(parts: list[Column]) -> Column:
    return reduce(operator.and_, parts) if parts else F.lit(True)


def under(root: str) -> Column:
    """The root itself or what lies below it at a separator; case doesn't count."""
    clean = root.replace("/", SEPARATOR).rstrip(SEPARATOR).lower()
    return (F.col("path_lc") == clean) | (F.col("path_lc") == clean + SEPARATOR) | F.col("path_lc").startswith(clean + SEPARATOR)


def predicate(q: ParsedQuery, match_path: bool = False) -> Column:
    """What parse() understood, over the columns of entries. Only the columns that it reads are named."""
    path_mode = match_path or q.match_path
    name, path = (F.col("name"), F.col("path")) if q.case_sensitive else (F.col("name_lc"), F.col("path_lc"))
    hay = path if path_mode else name
    parts = [F.upper(F.col("volume")) == d for d in q.drives]
    if q.kind:
        parts.append(F.col("is_dir") if q.kind == "dir" else ~F.col("is_dir"))
    for op, size in q.sizes:
        parts.append(_COMPARE[op](F.col("size"), F.lit(size)))
    for after, before in q.dates:
        known = (F.col("mtime_ns") != 0) & (F.col("mtime_ns") >= F.lit(after))
        parts.append(known if before is None else known & (F.col("mtime_ns") < F.lit(before)))
    parts += [F.col("attrs").bitwiseAND(mask) == mask for mask in q.attributes]
    ext = F.regexp_extract("name", r"\.([^.]*)$", 1) if q.case_sensitive else F.col("ext")
    parts += [ext == e for e in q.exts]
    parts += [F.col("parent_name_lc") == p for p in q.parents]
    parts += [F.contains(hay, F.lit(t)) for t in q.terms]
    parts += [F.contains(path, F.lit(d)) for d in q.dirs]
    parts += [glob(name, g) for g in q.globs]
    for r in q.regexes:
        if literal := regex_literal(r):  # cheap test first
            parts.append(F.contains(F.col("path_lc"), F.lit(literal.lower())))
        parts.append(F.rlike(F.col("path"), F.lit(r if q.case_sensitive else f"(?i){r}")))
    for group in q.or_groups:
        exts = [a.exts[0] for a in group if a == ParsedQuery(a.match_path, a.case_sensitive, exts=a.exts) and len(a.exts) == 1]
        parts.append(F.col("ext").isin(exts) if len(exts) == len(group) and not q.case_sensitive else reduce(operator.or_, [predicate(a, path_mode) for a in group]))
    parts += [~predicate(n, path_mode) for n in q.not_groups]
    return _all(parts)
