"""Language-model scoring by Katz backoff over word bigrams.

Counts of all training texts live in tables partitioned by hash. Texts stay in blocks of bounded
size; what crosses the network is packed and already summed up within a block:

0. A pass of its own sends a block's distinct training bigrams, as 64-bit hashes with their counts,
   to partitions by hash, which total them; their counts of counts, a few numbers each, are summed
   up to those of all training texts.
1. A block sends its distinct words with their counts to the word partitions, which total them and
   send back each word's total and number.
2. With these a block knows every unigram probability and sends its distinct bigrams, with counts
   and the texts they occur in, to the partition of the history.
3. A history partition totals its bigrams, discounts counts up to DISCOUNTED by Good-Turing, with
   the same discounts in every partition, and normalises each history exactly: p(w|h) = d(c) c(h,w) / c(h) where training has the bigram, if only once, else
   a(h) p(w) with a(h) = (1 - sum of the former) / (1 - sum of p(w) over the same words). It returns
   sums per text.
4. Blocks add up.

Unigrams are discounted likewise; what that leaves is the probability of an unknown word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.llm.common import blocks, checkpointed, release, split_residue, utf8
from pathlens.llm.ngram_join import _BASE, _powers, mix

DISCOUNTED = 5
#: Texts a word or history partition is made for, tokens and rows of a block, bytes hashed at a time.
PART_ROWS, BLOCK_TOKENS, BLOCK_ROWS, SLICE_BYTES = 6_000, 2_000_000, 20_000, 1 << 20
END_HASH = np.uint64(0x1)
_BITS, UNKNOWN = 22, -1


def _pack(a: np.ndarray) -> bytes:
    """Compressed, bytes of equal weight together: high bytes of small numbers then cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences, which pack better than sorted numbers."""
    return np.diff(a, prepend=np.zeros(1, a.dtype))


def tokens(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per text): words between ASCII white space, A-Z in lower case, then one end."""
    texts = len(bounds) - 1
    raw = np.frombuffer(data.lower(), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    inside = ~blank
    before, after = np.concatenate([[True], blank])[: len(raw)], np.concatenate([blank[1:], [True]])[: len(raw)]
    begins = np.flatnonzero(inside & (before | cut[:-1]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    owner = np.searchsorted(bounds, begins, side="right") - 1
    words = np.bincount(owner, minlength=texts)
    offsets = np.concatenate([[0], np.cumsum(words + 1)])
    out = np.full(offsets[-1], END_HASH)
    if len(begins):
        up, down = _powers(1 << max(10, len(raw).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        hashed = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(words)])
        out[offsets[owner] + np.arange(len(begins)) - first[owner]] = np.maximum(hashed, np.uint64(2))
    return out, words + 1


def discounts(counted: np.ndarray) -> np.ndarray:
    """d(0..DISCOUNTED + 1) by Katz's rule from n(0..DISCOUNTED + 1), the numbers of things seen r times.

    Where the counts of counts give none in (0, 1], a count isn't discounted. d(0) is 0.
    """
    d = np.ones(DISCOUNTED + 2)
    k, n = DISCOUNTED, counted.astype(float)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        if n[r] and common < 1:
            value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            d[r] = value if 0 < value <= 1 else 1.0
    d[0] = 0
    return d


def unigram(total: int, distinct: int, counted: np.ndarray):
    """p(c) for arrays of counts, normalised over the known words and one unknown word."""
    d = discounts(counted)
    spare = float(sum((1 - d[r]) * r * counted[r] for r in range(1, DISCOUNTED + 1))) / total if total else 1.0
    if not total or spare <= 0:
        return lambda c: (c + 1.0) / (total + distinct + 1.0)
    return lambda c: np.where(c > 0, d[np.minimum(c, DISCOUNTED + 1)] * c / total, spare)


ROW = "kind int, block long, part int, a binary, b binary, c binary, d binary, e binary, f binary"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), *((x, pa.binary()) for x in "abcdef")])
TEXTS, WORDS, TOTALS, FACTS, PAIRS, SUMS, STATS, BIGRAMS = range(8)


def _row(kind: int, block: int, part: int, *blobs: bytes) -> dict:
    return dict(zip(_NAMES, (kind, block, part, *blobs, *[None] * (6 - len(blobs)))))


def _ids(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([column], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocked(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows TEXTS (one a block: word numbers, lengths, training flags, ids) and WORDS (hashes and counts for a word partition)."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    hashes, lengths, trains, ids = [], [], [], []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        if not lengths:
            return
        every, length, train = np.concatenate(hashes), np.concatenate(lengths), np.concatenate(trains)
        words, local = np.unique(every, return_inverse=True)
        counts = np.bincount(local[np.repeat(train, length)], minlength=len(words))
        rows = [_row(TEXTS, number, -1, _pack(local.astype(np.int32)), _pack(length.astype(np.int64)), _pack(train), _ids(pa.concat_arrays(ids)))]
        where = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(where, np.arange(parts + 1))
        for part, (low, high) in enumerate(zip(edges, edges[1:])):
            if low < high:
                rows.append(_row(WORDS, number, part, _pack(_steps(words[low:high])), _pack(counts[low:high].astype(np.int64))))
        number += 1
        for x in (hashes, lengths, trains, ids):
            x.clear()
        for r in rows:
            yield pa.RecordBatch.from_pylist([r], _ARROW)

    held = texts = 0
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        flags = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        for low, high in blocks(offsets, SLICE_BYTES):
            hashed, length = tokens(bytes(data[offsets[low] : offsets[high]]), offsets[low : high + 1] - offsets[low])
            hashes.append(hashed)
            lengths.append(length)
            trains.append(flags[low:high])
            ids.append(batch.column(0).slice(low, high - low))
            held, texts = held + len(hashed), texts + high - low
            if held >= BLOCK_TOKENS or texts >= BLOCK_ROWS:
                yield from flush()
                held = texts = 0
    yield from flush()


def _bigrams(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows BIGRAMS: hashes and counts of a block's distinct bigrams, training texts only, for a partition by hash."""
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        pairs, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        where = ((pairs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(where, np.arange(parts + 1))
        for part, (low, high) in enumerate(zip(edges, edges[1:])):
            if low < high:
                yield pa.RecordBatch.from_pylist([_row(BIGRAMS, -1, part, _pack(_steps(pairs[low:high])), _pack(counts[low:high].astype(np.int64)))], _ARROW)

    for batch in batches:
        offsets, data = utf8(batch.column(0))
        for low, high in blocks(offsets, SLICE_BYTES):
            hashed, length = tokens(bytes(data[offsets[low] : offsets[high]]), offsets[low : high + 1] - offsets[low])
            history = np.empty_like(hashed)
            history[1:] = hashed[:-1]
            history[np.cumsum(length) - length] = END_HASH
            held.append(mix(mix(history) * _BASE + hashed))
            if sum(map(len, held)) >= BLOCK_TOKENS:
                yield from flush()
    yield from flush()


def _counts_of_counts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """n(0..DISCOUNTED + 1) of the bigrams of a partition."""
    hashes = np.concatenate([np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in group["a"]])
    counts = np.concatenate([_unpack(x, np.int64) for x in group["b"]])
    order = np.argsort(hashes, kind="stable")
    total = np.add.reduceat(counts[order], np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0])))
    stats = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]
    return pd.DataFrame([_row(STATS, -1, int(key[0]), stats.astype("<i8").tobytes())], columns=_NAMES)


def _totals(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Totals of a word partition: for each block the totals and numbers of its words; and the counts of counts."""
    group = group.sort_values("block")
    part = int(group["part"].iloc[0])
    hashes = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in group["a"]]
    words, number = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(number, weights=np.concatenate([_unpack(x, np.int64) for x in group["b"]]), minlength=len(words)).astype(np.int64)
    rows, at = [], 0
    for block, mine in zip(group["block"], hashes):
        own = number[at : at + len(mine)]
        rows.append(_row(TOTALS, block, part, _pack(total[own]), _pack(_steps(own.astype(np.int64)))))
        at += len(mine)
    stats = np.concatenate([[total.sum(), (total > 0).sum()], np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]])
    rows.append(_row(STATS, -1, part, stats.astype("<i8").tobytes()))
    return pd.DataFrame(rows, columns=_NAMES)


def _facts(key: tuple, group: pd.DataFrame, parts: int, total: int, distinct: int, counted: tuple) -> pd.DataFrame:
    """A block with its words' totals: facts of its texts, and its bigrams for the history partitions."""
    text = group[group["kind"] == TEXTS].iloc[0]
    replies = group[group["kind"] == TOTALS].sort_values("part")
    count = np.concatenate([_unpack(x, np.int64) for x in replies["a"]])
    ident = np.concatenate([np.cumsum(_unpack(x, np.int64)) | (int(p) << 40) for p, x in zip(replies["part"], replies["b"])])
    local, length, train = _unpack(text["a"], np.int32), _unpack(text["b"], np.int64), _unpack(text["c"], bool)
    block, texts = int(text["block"]), len(length)
    p = unigram(total, distinct, np.array(counted))
    owner = np.repeat(np.arange(texts), length)
    c = count[local]
    known = np.bincount(owner, weights=c > 0, minlength=texts).astype(np.int64)
    base = np.bincount(owner, weights=np.log10((count + 1.0) / (total + distinct + 1.0))[local], minlength=texts)
    alone = np.bincount(owner, weights=np.log10(p(count))[local], minlength=texts)
    rows = [_row(FACTS, block, -1 - block % parts, _pack(length), _pack(known), _pack(base), _pack(alone), _pack(~train), text["d"])]
    # Before the first word stands an end. A history that training lacks has no bigrams; words that it lacks are one.
    end = int(local[-1])
    history = np.empty_like(local)
    history[1:] = local[:-1]
    history[np.cumsum(length) - length] = end
    there = count[history] > 0
    history, word, owner = history[there].astype(np.int64), local[there].astype(np.int64), owner[there]
    known_word = count > 0
    part_of = (mix(ident.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    code = np.where(known_word[word], word + 1, 0)
    if len(count) < 1 << _BITS and parts < 1 << (62 - 2 * _BITS):
        order = np.argsort((part_of[history] << (2 * _BITS)) | (history << _BITS) | code, kind="stable")
    else:  # too many words in a block, or partitions, for one sort key
        order = np.lexsort((code, history, part_of[history]))
    history, code, owner, weight = history[order], code[order], owner[order], train[owner[order]]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (history[1:] != history[:-1]) | (code[1:] != code[:-1])
    starts = np.flatnonzero(fresh)
    spans = np.diff(np.append(starts, len(order)))
    trained = np.add.reduceat(weight.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    h, w = history[starts], code[starts] - 1
    edges = np.searchsorted(part_of[h], np.arange(parts + 1))
    for part, (low, high) in enumerate(zip(edges, edges[1:])):
        if low < high:
            a, b = starts[low], starts[high] if high < len(starts) else len(order)
            these = w[low:high]
            rows.append(_row(PAIRS, block, part, _pack(_steps(ident[h[low:high]])), _pack(np.where(these < 0, UNKNOWN, ident[these])), _pack(np.where(these < 0, 0, count[these])), _pack(trained[low:high].astype(np.int32)), _pack(spans[low:high].astype(np.int32)), _pack(owner[a:b].astype(np.int32))))
    return pd.DataFrame(rows, columns=_NAMES)


def backoff(h: np.ndarray, pw: np.ndarray, count: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of p(w|h) / p(w), whether training has the bigram) for sorted distinct bigrams of whole histories."""
    seen = count > 0
    first = np.flatnonzero(np.diff(h, prepend=-2))
    number = np.cumsum(np.diff(h, prepend=-2) != 0) - 1
    held = np.where(seen, d[np.minimum(count, DISCOUNTED + 1)] * count, 0.0)
    per = np.add.reduceat(count, first).astype(float)
    mass = np.add.reduceat(held, first)
    any_seen = np.add.reduceat(seen.astype(np.int64), first) > 0
    # A history all of whose mass would go to its bigrams is given one more count, for the others.
    per = np.where(any_seen & (per - mass < 1e-9), per + 1, np.maximum(per, 1))
    rest = 1 - np.add.reduceat(np.where(seen, pw, 0.0), first)
    alpha = np.where(any_seen, (1 - mass / per) / np.maximum(rest, 1e-12), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(seen, np.log10(held / per[number]) - np.log10(pw), np.log10(alpha)[number])
    return ratio, seen


def _history(key: tuple, group: pd.DataFrame, total: int, distinct: int, counted: tuple, paired: tuple) -> pd.DataFrame:
    """A history partition: sums of log10(p(w|h) / p(w)) per text. Facts of blocks pass through."""
    facts = group[group["kind"] == FACTS]
    pairs = group[group["kind"] == PAIRS].sort_values("block")
    rows = facts.to_dict("records")
    if len(pairs):
        p, d = unigram(total, distinct, np.array(counted)), discounts(np.array(paired))
        hs = [np.cumsum(_unpack(x, np.int64)) for x in pairs["a"]]
        h, w = np.concatenate(hs), np.concatenate([_unpack(x, np.int64) for x in pairs["b"]])
        cw, ct = np.concatenate([_unpack(x, np.int64) for x in pairs["c"]]), np.concatenate([_unpack(x, np.int32) for x in pairs["d"]])
        order = np.lexsort((w, h))
        hh, ww = h[order], w[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hh[1:] != hh[:-1]) | (ww[1:] != ww[:-1])
        starts = np.flatnonzero(fresh)
        ratio, _ = backoff(hh[starts], p(cw[order][starts]), np.add.reduceat(ct[order].astype(np.int64), starts), d)
        value = np.empty(len(order))
        value[order] = ratio[np.cumsum(fresh) - 1]
        at = 0
        for block, mine, spans, owners in zip(pairs["block"], hs, pairs["e"], pairs["f"]):
            owner = _unpack(owners, np.int32)
            added = np.bincount(owner, weights=np.repeat(value[at : at + len(mine)], _unpack(spans, np.int32)))
            texts = np.unique(owner)
            rows.append(_row(SUMS, block, int(key[0]), _pack(_steps(texts.astype(np.int32))), _pack(added[texts])))
            at += len(mine)
    return pd.DataFrame(rows, columns=_NAMES)


def _added(key: tuple, group: pa.Table) -> pa.Table:
    kinds = group.column("kind").to_pylist()
    rows = group.to_pylist()
    facts = rows[kinds.index(FACTS)]
    score = _unpack(facts["d"], np.float64).copy()
    for r in sorted((r for r in rows if r["kind"] == SUMS), key=lambda r: r["part"]):
        score[np.cumsum(_unpack(r["a"], np.int32))] += _unpack(r["b"], np.float64)
    ids = pa.ipc.open_stream(facts["f"]).read_all().column("id").combine_chunks()
    columns = [ids, pa.array(_unpack(facts["e"], bool)), pa.array(_unpack(facts["a"], np.int64)), pa.array(_unpack(facts["b"], np.int64)), pa.array(_unpack(facts["c"], np.float64)), pa.array(score)]
    return pa.table(columns, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Rows whose crc32(id as text) mod `modulus` is `held_out` teach the model nothing. A null text
    counts as empty: its one token is the end. Without training rows every probability is that of
    one unknown word, 1. Repeated rows count as often as they occur; a null id counts as an empty
    one for the split.
    """
    rows = docs.count()
    parts = max(1, -(-rows // PART_ROWS))
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), (split_residue(id_col, modulus) != held_out).alias("train"))
    # Counted from the texts once more: the bigrams with their texts would have to be kept on disk for a second look.
    pairs = plain.filter("train").select("text").mapInArrow(functools.partial(_bigrams, parts=parts), ROW)
    paired = np.zeros(DISCOUNTED + 2, np.int64)
    for r in pairs.groupBy("part").applyInPandas(_counts_of_counts, ROW).select("a").collect():  # a few numbers of each partition
        paired += np.frombuffer(r["a"], "<i8")
    del pairs
    release(docs.sparkSession)  # what this pass shuffled is not read again
    made = checkpointed(plain.mapInArrow(functools.partial(_blocked, parts=parts), ROW))
    replies = checkpointed(made.filter(F.col("kind") == WORDS).groupBy("part").applyInPandas(_totals, ROW))
    stats = np.zeros(DISCOUNTED + 4, np.int64)
    for r in replies.filter(F.col("kind") == STATS).select("a").collect():  # a few numbers of each partition
        stats += np.frombuffer(r["a"], "<i8")
    release(docs.sparkSession)
    total, distinct, counted = int(stats[0]), int(stats[1]), (0, *map(int, stats[3:]))
    known = made.filter(F.col("kind") == TEXTS).unionByName(replies.filter(F.col("kind") == TOTALS))
    facts = known.groupBy("block").applyInPandas(functools.partial(_facts, parts=parts, total=total, distinct=distinct, counted=counted), ROW)
    sums = facts.groupBy("part").applyInPandas(functools.partial(_history, total=total, distinct=distinct, counted=counted, paired=tuple(map(int, paired))), ROW)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return sums.groupBy("block").applyInArrow(_added, schema).select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
