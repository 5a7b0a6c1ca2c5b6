"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Every text becomes its set of word n-grams (64-bit hashes, computed with arrays). Texts with the
   same set are one class from here on, however many copies there are.
2. Each set gets `bands * rows` MinHash values; the number of bands and rows is chosen for a recall
   at the threshold. Band hashes are dealt by a shuffle; a bucket's members are tied to its least
   member (a star), never to each other, so the rows stay linear in the classes.
3. Stars are contracted to candidate groups by hooking every node to its least neighbour in an
   order that is dealt anew each round.
4. Groups are verified exactly: all pairs of sets of a group are compared by counting shared
   n-grams. A large group is cut into blocks, and each pair of blocks is one task, so no task holds
   more than two blocks. A task returns, per class, the number of its links there and a spanning
   forest of the links, never the pairs.
5. The forests are contracted to the final groups.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.llm.common import blocks, checkpointed, lean, utf8

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 220
#: Classes in one block of a candidate group, and bytes of text that are hashed at a time.
BLOCK_CLASSES, BLOCK_BYTES = 512, 1 << 20
#: Rows in one file of a table of edges or labels, unless there are fewer files than cores.
FILE_ROWS = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest false candidates, whose bands reach `recall` at `threshold` with at most `hashes` values."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _word_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    return out


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE)
    up[0] = 1
    down = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per text) of the words, in order: runs of ASCII letters and digits, case folded, and of any other characters beyond ASCII."""
    texts = len(bounds) - 1
    raw = np.frombuffer(data.lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    inside = _word_bytes()[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    begins = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | cut[1:])) + 1
    up, down = _powers(1 << max(10, len(raw).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    word = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    return word, np.bincount(np.searchsorted(bounds, begins, side="right") - 1, minlength=texts)


def shingles(data: bytes, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets of the texts in them): the distinct word n-grams of each text, sorted.

    A text of fewer than `words` words but one at least has one n-gram, all its words; one without
    words has none.
    """
    texts = len(bounds) - 1
    word, counts = word_hashes(data, bounds)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    many = np.maximum(counts - words + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(texts), many)
    at = first[doc] + np.arange(offsets[-1]) - offsets[doc]
    stop = first[doc + 1]
    gram = np.zeros(len(at), np.uint64)
    for k in range(words):
        there = at + k < stop
        gram = mix(gram * _BASE + np.where(there, word[np.minimum(at + k, len(word) - 1)], np.uint64(k)))
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[fresh], doc[fresh]
    return gram, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts))])


@functools.cache
def _permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    dealt = np.random.default_rng(20240607)
    return dealt.integers(0, 1 << 32, hashes, np.uint64).astype(np.uint32) | np.uint32(1), dealt.integers(0, 1 << 32, hashes, np.uint64).astype(np.uint32)


def signatures(gram: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values, a row for each text; texts without n-grams have the highest values."""
    out = np.full((len(offsets) - 1, hashes), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        low, (a, b) = (gram >> np.uint64(32)).astype(np.uint32) ^ gram.astype(np.uint32), _permutations(hashes)
        step = 1 << 16  # rows of values that stay in cache
        starts = offsets[full]
        groups = np.searchsorted(starts, np.arange(0, len(gram) + step, step))
        for g0, g1 in zip(groups, groups[1:]):
            if g0 == g1:
                continue
            lo, hi = starts[g0], starts[g1] if g1 < len(starts) else len(gram)
            part, at = low[lo:hi], starts[g0:g1] - lo
            for k in range(hashes):
                out[full[g0:g1], k] = np.minimum.reduceat(part * a[k] + b[k], at)
    return out


def set_keys(gram: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit keys of the sets, as two columns: sums of two scramblings of the members, and their number."""
    pair = np.zeros((len(offsets) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
            pair[full, k] = mix(np.add.reduceat(mix(gram ^ np.uint64(salt)), offsets[full]) + np.diff(offsets)[full].astype(np.uint64))
    return pair


@lean
def _hashed(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        for low, high in blocks(offsets, BLOCK_BYTES):
            gram, at = shingles(bytes(data[offsets[low] : offsets[high]]), offsets[low : high + 1] - offsets[low], words)
            values = signatures(gram, at, bands * rows).astype(np.uint64).reshape(-1, bands, rows)
            band = np.zeros(values.shape[:2], np.uint64)
            for k in range(rows):
                band = mix(band * _BASE + values[:, :, k])
            n = high - low
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, n), pa.array(_packed(set_keys(gram, at)), pa.binary()), pa.array(np.diff(at), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(band.ravel().view(np.int64))),
                ],
                ["id", "node", "grams", "bands"],
            )


def _packed(keys: np.ndarray) -> list[bytes]:
    raw = keys.tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


@lean
def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        for low, high in blocks(offsets, BLOCK_BYTES):
            gram, at = shingles(bytes(data[offsets[low] : offsets[high]]), offsets[low : high + 1] - offsets[low], words)
            raw, at8 = gram.tobytes(), (at * 8).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(_packed(set_keys(gram, at)), pa.binary()), pa.array([raw[a:b] for a, b in zip(at8, at8[1:])], pa.binary())], ["node", "set"])


def _few(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of `rows` rows at most, in no more partitions than these need: each file of a checkpoint starts a process beside the executor."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def contract(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the same root for connected nodes.

    Each round moves every node to the least node within two steps, which folds a star at once, and
    keeps the edges between different targets. The order of nodes is hashed anew from the second
    round on, so long paths shrink by a factor too. Rows stay linear in the edges; the minimum over
    a hub's neighbours is summed up map-side.
    """
    edges = checkpointed(pairs.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    labels, rounds = edges.select(F.col("a").alias("node"), F.col("b").alias("root")), 0
    first = rows = edges.count()
    while rows:
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(rounds)) if rounds else F.lit(0).cast("long")).alias("h"), c.alias("n"))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        least = both.groupBy("node").agg(F.min(rank(F.col("near"))).alias("m")).select("node", F.least("m", rank(F.col("node"))).alias("m"))
        second = both.join(least.select(F.col("node").alias("near"), "m"), "near").groupBy("node").agg(F.min("m").alias("m"))
        hook = checkpointed(_few(second.select("node", F.least("m", rank(F.col("node")))["n"].alias("to")), 2 * rows))
        moved = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = checkpointed(_few(moved.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), rows))
        if rounds:
            later = hook.select(F.col("node").alias("root"), "to")
            labels = checkpointed(_few(labels.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root")), 2 * first))
        else:
            labels = hook.select("node", F.col("to").alias("root"))
        rows = edges.count()
        rounds += 1
    return labels


def _block_links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean links between sets: left x right, or left x left."""
    every = left + (right or [])
    sizes = np.array([len(s) for s in every])
    owner = np.repeat(np.arange(len(every)), sizes)
    values, inverse, counts = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    kept = counts[inverse] > 1
    number = np.cumsum(counts > 1) - 1
    rows, cols = owner[kept], number[inverse[kept]]
    n, m = len(left), len(right) if right is not None else len(left)
    shared = np.zeros((n, m), np.int64)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    width = 4096
    for start in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        a, b = np.searchsorted(cols, (start, start + width))
        dense = np.zeros((len(every), width), np.float32)
        dense[rows[a:b], cols[a:b] - start] = 1
        shared += (dense[:n] @ (dense[n:] if right is not None else dense).T).astype(np.int64)
    x, y = sizes[:n, None], (sizes[n:] if right is not None else sizes)[None, :]
    # shared / (x + y - shared) >= threshold in whole numbers: the threshold is the fraction it is written as, 0.8 is 4/5
    part, whole = Fraction(str(threshold)).as_integer_ratio()
    links = shared * (part + whole) >= part * (x + y)
    links &= (x > 0) & (y > 0)
    if right is None:
        np.fill_diagonal(links, False)
    return links


def _verify(key: tuple, group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    low, high = int(key[1]), int(key[2])
    group = group.sort_values("node", ignore_index=True)
    sides = [group[group["block"] == k] for k in ((low,) if low == high else (low, high))]
    nodes = [list(s["node"]) for s in sides]
    sets = [[np.frombuffer(x, np.uint64) for x in s["set"]] for s in sides]
    links = _block_links(sets[0], sets[1] if len(sets) > 1 else None, threshold)
    names = [n for part in nodes for n in part]
    shift = 0 if low == high else len(nodes[0])
    count = np.zeros(len(names), np.int64)
    count[: links.shape[0]] += links.sum(axis=1)
    if shift:
        count[shift:] += links.sum(axis=0)
    parent = list(range(len(names)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(links)):
        x, y = root(int(a)), root(int(b) + shift)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return pd.DataFrame({"node": names, "root": [names[root(k)] for k in range(len(names))], "links": count})


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(id, class_id, rep_id, n_copies, n_links) for each row.

    rep_id: the least id of the rows with the same n-gram set, n_copies their number. n_links: how
    many other sets have a Jaccard similarity of `threshold` or more with this one. class_id: the
    least id of the rows connected by such links or equal sets. A null text counts as empty; texts
    without words have the same, empty set and no links. Rows with a null id take part and keep it;
    repeated rows are copies; other columns are not read.
    """
    bands, rows = choose_bands(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    hashed = checkpointed(plain.mapInArrow(functools.partial(_hashed, words=words, bands=bands, rows=rows), f"id {kind}, node binary, grams long, bands array<long>"))
    classes = checkpointed(hashed.groupBy("node").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"), F.first("grams").alias("grams")))

    # Buckets: members are tied to the least of them. Partial sums keep a hot bucket small.
    member = classes.filter("grams > 0").select("node", F.posexplode("bands").alias("band", "value"))
    least = member.groupBy("band", "value").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = member.join(least.drop("n"), ["band", "value"]).select("a", F.col("node").alias("b"))
    candidates = checkpointed(contract(stars))

    # Blocks of a candidate group: a size known by counting, members dealt by hash.
    sizes = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    cut = F.ceil(F.col("size") / F.lit(float(BLOCK_CLASSES))).cast("int")
    dealt = candidates.join(sizes, "root").select("node", "root", cut.alias("blocks"), F.pmod(F.xxhash64("node"), cut).cast("int").alias("block"))
    chosen = dealt.join(classes.select("node", "rep_id"), "node")
    sets = _first_sets(plain, hashed, chosen, words)
    low_high = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")))
    tasks = dealt.join(sets, "node").select("node", "root", "block", "set", F.explode(low_high).alias("pair")).select("node", "root", "block", "set", "pair.low", "pair.high")
    found = checkpointed(tasks.groupBy("root", "low", "high").applyInPandas(functools.partial(_verify, threshold=threshold), "node binary, root binary, links long"))

    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = contract(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "rep_id", "n_copies").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = named.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    facts = named.join(least_id, "root").select("node", "class_id", "rep_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return hashed.select("id", "node").join(facts, "node").select("id", "class_id", "rep_id", "n_copies", "n_links")


def _first_sets(plain: DataFrame, hashed: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(node, set) of the chosen nodes: texts of their representatives are read again, one of each node kept."""
    wanted = chosen.select(F.col("rep_id").alias("id")).filter("id is not null").distinct()
    texts = plain.join(wanted, "id", "left_semi")
    lone = chosen.filter("rep_id is null")
    if not lone.isEmpty():
        texts = texts.unionByName(plain.filter("id is null"))
    raw = texts.select("id", "text").select(F.lit(None).cast("binary").alias("node"), "text").mapInArrow(functools.partial(_sets, words=words), "node binary, set binary")
    return raw.join(chosen.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))
