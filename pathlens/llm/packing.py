"""Best-fit packing of token pieces into fixed-length sequences, improved by swaps.

Full pieces are sequences of their own and are never shuffled. The others (one per document at
most) are dealt by a hash of their serial number into groups of bounded size, so neither the hot
source nor repeated documents can gather in one task. In a group, best fit in the order of arrival
makes the first packing, as a stream of documents would be packed. Local search then empties one
bin after another, the least filled first: it moves a document, exchanges one for one, two for one or
one for two between underfull bins, taking only changes that increase the sum of squared fills. It
ends when the number of bins has reached its lower bound, or when no underfull bin is left from which
a change is possible; there is no other limit.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.llm.common import blocks, checkpointed, lean, trim, utf8

CAPACITY, END_ID, GROUP_ROWS = 4096, 1, 20_000
CACHE_ENTRIES, BLOCK_BYTES = 400_000, 8 << 20
#: Pieces that are encoded together.
TOGETHER = 256
#: Chunks of printable characters up to U+024F, of which each keeps its class in lower case and none is composed.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
#: Among these, words of letters, and words with a digit or mark after them.
_WORD = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"


def _blobs(offsets: np.ndarray, data) -> pa.Array:
    """A binary array of the ranges between offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


class WordEncoder:
    """Ids by the tokenizers library, of texts cut at ASCII white space, with a bounded cache.

    The vocabulary's normaliser and splitter never join text across white space and map case
    first, so the ids of a text are those of its lower-cased chunks, one after another. A chunk of
    plain characters is cut further as the splitter's own pattern does, so "word" and "word," share
    the ids of "word"; each such piece ends with the one token that has the end mark. Arrow cuts a block of
    texts, numbers its distinct chunks and pieces and puts their ids in the texts' order; only pieces
    that the cache lacks are encoded. When the cache is full, the pieces of the last block stay. The
    vocabulary's added tokens are found in a whole text before it is cut, so a text with one of them
    is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        # The same model, for lower-cased pieces with a space between them: nothing to normalise or to split is left.
        self.quick = Tokenizer(self.tokenizer.model)
        self.quick.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        made = json.loads(self.tokenizer.to_str())
        self.mark = made["model"]["end_of_word_suffix"]
        self.split = regex.compile(next(x["pattern"]["Regex"] for x in made["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")).findall
        self.added = [x["content"] for x in made["added_tokens"]]
        ends = [k for token, k in self.tokenizer.get_vocab().items() if token.endswith(self.mark)]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.known, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())

    @classmethod
    @functools.cache
    def load(cls, path: str) -> WordEncoder:
        return cls(path)

    def coded(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.batch(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> pa.Array:
        """Ids of plain pieces, many in one call; where a piece has other than one end, each alone."""
        groups = [pieces[k : k + TOGETHER] for k in range(0, len(pieces), TOGETHER)]
        sizes, data = [np.zeros(1, np.int64)], []
        batch = getattr(self.quick, "encode_batch_fast", self.quick.encode_batch)
        for group, found in zip(groups, batch([" ".join(g).lower() for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(group) and last[-1] == len(ids):
                sizes.append(np.diff(last, prepend=0) * 4)
                data.append(ids.tobytes())
            else:
                each = self.coded(group)
                sizes.append(np.array([len(x) for x in each]))
                data += each
        return _blobs(np.cumsum(np.concatenate(sizes)), b"".join(data))

    def looked_up(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, by the cache."""
        at = pc.index_in(pieces, value_set=self.known)
        fresh = pieces.filter(at.is_null())
        values = pa.concat_arrays([self.values, self.learn(fresh.to_pylist())])
        place = at.to_numpy(zero_copy_only=False).copy() if not at.null_count else at.fill_null(-1).to_numpy().copy()
        place[place < 0] = np.arange(len(self.known), len(values))
        found = values.take(pa.array(place))
        self.known, self.values = (pieces, found) if len(values) > CACHE_ENTRIES else (pa.concat_arrays([self.known, fresh]), values)
        return found

    def chunks(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct chunks."""
        word = pc.match_substring_regex(distinct, _WORD + "$").to_numpy(zero_copy_only=False)
        marked = pc.match_substring_regex(distinct, _WORD + "[!-@\\[-`{-~]$").to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~word & ~marked)
        odd, cut, other, whole = [], [], [], []
        for k, chunk in zip(rest.tolist(), distinct.take(pa.array(rest)).to_pylist()):
            if _PLAIN.fullmatch(chunk):
                odd.append(k)
                cut.append(self.split(chunk))
            else:
                other.append(k)
                whole.append(chunk)
        words, both = distinct.filter(pa.array(word)), distinct.filter(pa.array(marked))
        n, m = len(words), len(both)
        # Pieces of all chunks: words, then words and marks in turn, then those of other plain chunks.
        stems = pc.utf8_slice_codeunits(both, 0, -1)
        turns = pa.concat_arrays([stems, pc.utf8_slice_codeunits(both, -1, None)]).take(pa.array(np.arange(2 * m).reshape(2, m).T.ravel()))
        flat = pa.concat_arrays([words, turns, pa.array([x for parts in cut for x in parts], pa.string())]).dictionary_encode()
        ends, data = utf8(self.looked_up(flat.dictionary).take(flat.indices))
        edges = np.concatenate([np.arange(n), n + 2 * np.arange(m), n + 2 * m + np.cumsum([0, *map(len, cut)])])
        found = pa.concat_arrays([_blobs(ends[edges], data), pa.array(self.coded(whole), pa.large_binary())])
        back = np.empty(len(distinct), np.int64)
        back[np.concatenate([np.flatnonzero(word), np.flatnonzero(marked), np.array(odd + other, np.int64)])] = np.arange(len(distinct))
        return found.take(pa.array(back))

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, memoryview]:
        """(where each text's ids begin and the last ones end, in bytes; little-endian unsigned 32-bit ids) of a string array; a null counts as empty."""
        if not len(texts):
            return np.zeros(1, np.int64), memoryview(b"")
        texts = texts.cast(pa.string())
        texts = texts.fill_null("") if texts.null_count else texts
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = split.flatten().dictionary_encode()
        ends, data = utf8(self.chunks(found.dictionary).take(found.indices))
        edges = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if special.any():
            parts = [bytes(data[a:b]) for a, b in zip(edges, edges[1:])]
            rows = np.flatnonzero(special).tolist()
            for k, raw in zip(rows, self.coded([texts[k].as_py() for k in rows])):
                parts[k] = raw
            edges, data = np.cumsum([0, *map(len, parts)]), memoryview(b"".join(parts))
        return edges, data

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        edges, data = self.encoded(pa.array(texts, pa.binary()).cast(pa.string()))
        return [bytes(data[a:b]) for a, b in zip(edges, edges[1:])]


@lean
def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, end, size = WordEncoder.load(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
    serial = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
    for batch in batches:
        offsets, _ = utf8(batch.column(1))
        for low, high in blocks(offsets, BLOCK_BYTES):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            edges, ids = encoder.encoded(batch.column(1).slice(low, high - low))
            for k, (first, last) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
                coded = bytes(ids[first:last]) + end
                for n, at in enumerate(range(0, len(coded), size)):
                    part = coded[at : at + size] if len(coded) > size else coded
                    rows.append(low + k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(range(serial, serial + len(rows)), pa.int64())]
            serial += len(rows)
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, ["doc_id", "piece", "start", "length", "ids_crc32", "serial"] + ["ids"] * keep_ids)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, serial[, ids]): each text's ids and an end id, cut at `capacity`.

    A null text counts as empty: one piece with the end id alone. serial numbers the rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, serial long" + ", ids binary" * keep_ids
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(functools.partial(_pieces, path=path, capacity=capacity, end_id=end_id, keep_ids=keep_ids), schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in the given order: bins of indexes. Open bins are found by a bit mask over their free space."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    mask = 0
    for k, size in enumerate(lengths):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            found = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, found = capacity, len(bins)
            bins.append([])
        bins[found].append(k)
        if free > size:
            by_free.setdefault(free - size, []).append(found)
            mask |= 1 << (free - size)
    return bins


class Search:
    """Local search: which bin holds each document, and the changes that bring a bin's documents into fuller ones."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.size, self.capacity = [list(b) for b in bins], np.array(lengths, np.int32), capacity
        self.bin_of = np.zeros(len(lengths), np.int64)
        for t, members in enumerate(self.bins):
            self.bin_of[members] = t
        self.fill = np.bincount(self.bin_of, weights=self.size, minlength=len(self.bins)).astype(np.int64)
        #: Of each document: the most that may take its place in its bin, and the bin's fill.
        self.near = self.fill[self.bin_of].astype(np.int32)
        self.most = (self.size + self.capacity - self.near).astype(np.int32)

    def change(self, s: int) -> bool:
        """Makes the change that shifts most tokens out of bin s into another underfull one; whether there was one.

        A shift d from s to t changes the sum of squared fills by 2d(t - s + d), so d must be above
        s - t and not above the gap of t. For each document b that may come back, the largest
        documents or pairs x of s with x - b within the gap are read from a table.
        """
        own, mine = self.bins[s], int(self.fill[s])
        gap = np.where(self.fill > 0, self.capacity - self.fill, 0)
        gap[s] = 0
        ones = {int(self.size[k]): (k,) for k in own}
        pairs = {int(self.size[i] + self.size[j]): (i, j) for n, i in enumerate(own) for j in own[:n]}
        best, found = 0, ((), (), -1)

        def offer(outs: dict, back: np.ndarray | int, most: np.ndarray, fill: np.ndarray) -> int:
            """Where the largest shift x - back is, or -1: x up to most, the other bin then over the fill of s."""
            nonlocal best
            if not outs or not len(most):
                return -1
            x = np.zeros(self.capacity + 1, np.int32)  # the largest of outs up to each number
            keys = [n for n in outs if n <= self.capacity]
            x[keys] = keys
            np.maximum.accumulate(x, out=x)
            shift = x[most] - back
            shift[shift + fill <= mine] = 0
            k = int(shift.argmax())
            if shift[k] <= best:
                return -1
            best = int(shift[k])
            return k

        if (t := offer(ones, 0, gap, self.fill)) >= 0:
            found = (ones[best], (), t)
        self.most[own] = 0
        if (k := offer(pairs | ones, self.size, self.most, self.near)) >= 0:
            x = best + int(self.size[k])
            found = (ones.get(x) or pairs[x], (k,), int(self.bin_of[k]))
        if not best:
            first, second = self._pairs(gap)
            both = self.size[first] + self.size[second]
            if (p := offer(ones, both, both + gap[self.bin_of[first]], self.near[first])) >= 0:
                k, j = int(first[p]), int(second[p])
                found = (ones[best + int(both[p])], (k, j), int(self.bin_of[k]))
        if best:
            out, back, t = found
            self.bins[s] = [k for k in own if k not in out] + list(back)
            self.bins[t] = [k for k in self.bins[t] if k not in back] + list(out)
            self.bin_of[list(out)] = t
            self.bin_of[list(back)] = s
            self.fill[s] -= best
            self.fill[t] += best
            self._note(t)
        self._note(s)
        return best > 0

    def _note(self, t: int) -> None:
        """What `most` and `near` have for the documents of bin t."""
        members = self.bins[t]
        self.near[members] = self.fill[t]
        self.most[members] = self.size[members] + (self.capacity - self.fill[t])

    def _pairs(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of all pairs that stand together in an underfull bin."""
        item = np.flatnonzero(gap[self.bin_of] > 0)
        item = item[np.argsort(self.bin_of[item], kind="stable")]
        where, first, second = self.bin_of[item], [item[:0]], [item[:0]]
        for apart in range(1, len(item)):
            same = np.flatnonzero(where[apart:] == where[:-apart])
            if not len(same):
                break
            first.append(item[same])
            second.append(item[same + apart])
        return np.concatenate(first), np.concatenate(second)

    def run(self) -> list[list[int]]:
        """Changes until the bins are at their lower bound, or a pass over all underfull bins has found none."""
        floor = -(-int(self.fill.sum()) // self.capacity)
        alive, stuck, changed = int((self.fill > 0).sum()), np.zeros(len(self.fill), bool), False
        while alive > floor:
            open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity) & ~stuck)
            if not len(open_):
                if not changed:
                    break
                stuck[:], changed = False, False
                continue
            s = int(open_[self.fill[open_].argmin()])
            if self.change(s):
                changed = True
                alive -= not self.fill[s]
            else:
                stuck[s] = True
        return [b for b in self.bins if b]


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins while they increase the sum of squared fills and bins are above their lower bound."""
    return Search(bins, lengths, capacity).run()


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes into `lengths`, each of `capacity` at most.

    Where the search from the order of arrival ends above the lower bound, it is run from the
    decreasing order too, and the fewer bins are taken.
    """
    if not lengths:
        return []
    found = local_search(best_fit(lengths, capacity), lengths, capacity)
    if len(found) * capacity - sum(lengths) >= capacity:
        order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
        other = best_fit([lengths[k] for k in order], capacity)
        again = local_search([[order[k] for k in b] for b in other], lengths, capacity)
        found = min(found, again, key=len)
    return found


def _pack_group(key: tuple, group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values("serial", ignore_index=True)
    lengths = group["length"].tolist()
    sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for n, members in enumerate(pack_lengths(lengths, capacity)):
        at = 0
        for k in members:
            sequence[k], offset[k] = (int(key[0]) << 32) + n, at
            at += lengths[k]
    trim()
    return group.assign(sequence_id=sequence, offset=offset)


def pack(cut: DataFrame, rows: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to the output of `pieces`; `serial` goes.

    rows: an upper bound of the pieces below capacity, such as the number of documents; it sets the
    number of groups. Sequence ids of full pieces are negative. An empty table gives no rows; equal
    rows get places of their own.
    """
    full, groups = F.col("length") >= capacity, max(1, -(-rows // GROUP_ROWS))
    plain = [c for c in cut.columns if c != "serial"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", group_of int, sequence_id long, offset long"
    # Both branches below read the pieces; texts are encoded once and the small rows are kept.
    dealt = checkpointed(cut).withColumn("group_of", F.when(full, F.lit(None)).otherwise(F.pmod(F.xxhash64("serial"), F.lit(groups))).cast("int"))
    alone = dealt.filter(full).select(*plain, (-F.col("serial") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shared = dealt.filter(~full).groupBy("group_of").applyInPandas(functools.partial(_pack_group, capacity=capacity), schema)
    return alone.unionByName(shared.select(*plain, "sequence_id", "offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences, from pieces that kept their ids. A group has `capacity` tokens at most."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id", F.aggregate("rows", F.lit(b"").cast("binary"), lambda acc, r: F.concat(acc, r["ids"])).alias("ids"), F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids")
    )
