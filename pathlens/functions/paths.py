"""Column functions over names, paths and record fields. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\\"
DIRECTORY = 0x10
FILETIME_EPOCH = 116444736000000000  # 100 ns ticks from 1601 to 1970


def extension(name_lc: Column) -> Column:
    """Text after the last dot, without it; empty if there is none or nothing follows."""
    return F.regexp_extract(name_lc, r"\.([^.]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"\\[^\\]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\]*)$", 1)


def filetime_to_ns(ticks: Column) -> Column:
    """Unix ns of 100 ns ticks since 1601; 0 for zero and for times before 1970."""
    return F.when(ticks > FILETIME_EPOCH, (ticks - FILETIME_EPOCH) * 100).otherwise(F.lit(0).cast("long"))


def is_directory(attrs: Column) -> Column:
    return attrs.bitwiseAND(DIRECTORY) == DIRECTORY


def grams(text: Column, width: int = 3) -> Column:
    """Distinct windows of `width` characters; none for shorter texts."""
    return F.when(F.length(text) >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (width - 1)), lambda i: F.substring(text, i, width)))).otherwise(F.expr("cast(array() as array<string>)"))


def stable_id(path_lc: Column) -> Column:
    """A 64-bit id of a path, never 0."""
    hashed = F.xxhash64(path_lc)
    return F.when(hashed == 0, F.lit(1).cast("long")).otherwise(hashed)


def fnv1a64(data: bytes) -> int:
    """FNV-1a as a signed 64-bit number, 0 becoming 1; for ids that must equal those of other tools."""
    value = 0xCBF29CE484222325
    for byte in data:
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    value = value or 1
    return value - (1 << 64) if value >> 63 else value


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: * and ? don't cross separators, [set] may be negated by ^."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += r"[^\\]*"
        elif c == "?":
            out += r"[^\\]"
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            body = pattern[k + 1 : end]
            out += "[" + ("^" if body[0] == "^" else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body.removeprefix("^")) + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


def glob(name: Column, pattern: str) -> Column:
    """Whole-name match; the common shapes need no regular expression."""
    plain = not re.search(r"[?\[]", pattern)
    body = pattern.strip("*")
    if plain and "*" not in body and body:
        starts, ends = not pattern.startswith("*"), not pattern.endswith("*")
        if starts and ends:
            return name == body
        return name.startswith(body) if starts else name.endswith(body) if ends else F.contains(name, F.lit(body))
    return F.rlike(name, F.lit(glob_regex(pattern)))


def regex_literal(pattern: str) -> str:
    """The longest run of 3 or more characters that every match of the pattern holds, or ''."""
    if re.search(r"[|()\[\]{}]|\\[A-Za-z0-9]", pattern):
        return ""
    runs, run = [], ""
    tokens = re.findall(r"\\.|.", pattern, re.S)
    for k, t in enumerate(tokens):
        after = tokens[k + 1] if k + 1 < len(tokens) else ""
        if t in ".^$*+?" or after in ("*", "?"):
            runs, run = [*runs, run], ""
        else:
            run += t[-1]
    best = max([*runs, run], key=len)
    return best if len(best) >= 3 else ""
