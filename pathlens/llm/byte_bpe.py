"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Text is cut into pieces without a regex. Every code point gets a class; each class is a transition
function of a small automaton that knows what kind of piece is open. Composition of such functions
is associative, so the state before each code point comes from a prefix scan over composed
functions (the finite monoid they generate is tabulated once, which makes a composition one table
lookup). A piece starts where (state, class, next class) says so. Pieces feed a cache of merged
pairs; offsets of the tokens are kept for decoding.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathlens.llm.common import blocks, utf8

# Classes of code points. The single letters are those that contractions are made of.
CLASSES = ("letter", "number", "other", "space", "blank", "'", "s", "t", "m", "d", "r", "v", "e", "l")
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE = range(6)
END = len(CLASSES)
#: States: fresh (whatever comes starts a piece), a run of letters, numbers or others, a space or
#: another blank just read, a quote that started a piece, and a quote with r, v or l after it.
STATES = ("fresh", "letters", "numbers", "others", "space", "blank", "quote", "quote r", "quote v", "quote l")
FRESH, LETTERS, NUMBERS, OTHERS, AFTER_SPACE, AFTER_BLANK, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(10)
#: White space as regular expressions over Unicode define it (the White_Space property).
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LONG_PIECE, CACHE_ENTRIES, BLOCK_BYTES, COLUMNS = 48, 1_000_000, 1 << 20, 64


def _step(state: int, kind: str) -> int:
    if state == AT_QUOTE and kind in "stmd" and len(kind) == 1:
        return FRESH
    if (state, kind) in {(QUOTE_R, "e"), (QUOTE_V, "e"), (QUOTE_L, "l")}:
        return FRESH
    if kind == "space":
        return AFTER_SPACE
    if kind == "blank":
        return AFTER_BLANK
    if kind == "number":
        return NUMBERS
    if kind == "other":
        return OTHERS
    if kind == "'":
        return OTHERS if state in (OTHERS, AFTER_SPACE, AT_QUOTE) else AT_QUOTE
    if state == AT_QUOTE and kind in "rvl":
        return {"r": QUOTE_R, "v": QUOTE_V, "l": QUOTE_L}[kind]
    return LETTERS


def _starts(state: int, kind: str, following: str) -> bool:
    white = ("space", "blank")
    if state == FRESH:
        return True
    if kind in white:
        return state not in (AFTER_SPACE, AFTER_BLANK) or following not in (*white, "end")
    if state == AFTER_SPACE:
        return False
    if state == AFTER_BLANK:
        return True
    if kind == "number":
        return state != NUMBERS
    if kind in ("other", "'"):
        return state not in (OTHERS, AT_QUOTE)
    if state == AT_QUOTE:
        return not (kind in "stmd" and len(kind) == 1 or (kind, following) in {("r", "e"), ("v", "e"), ("l", "l")})
    return state in (NUMBERS, OTHERS)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            out[code] = LETTER
        elif kind == "N":
            out[code] = NUMBER
    out[list(WHITE_SPACE)] = BLANK
    out[0x20] = SPACE
    for k, name in enumerate(CLASSES):
        if len(name) == 1:
            out[ord(name)] = k
    return out


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(composition table of the monoid, generator of each class, state reached from a fresh start, piece starts).

    Generators come twice: plain, and with a reset before them for the first code point of a text.
    """
    plain = [tuple(_step(s, kind) for s in range(len(STATES))) for kind in CLASSES]
    reset = [(f[FRESH],) * len(STATES) for f in plain]
    known: dict[tuple, int] = {}
    for f in (*plain, *reset):
        known.setdefault(f, len(known))
    grown = 0
    while grown < len(known):
        every = list(known)
        grown = len(every)
        for f in every:
            for g in (*plain, *reset):
                known.setdefault(tuple(g[s] for s in f), len(known))
    every = list(known)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint16)
    starts = np.array([[[_starts(s, kind, following) for following in (*CLASSES, "end")] for kind in CLASSES] for s in range(len(STATES))])
    return compose, np.array([known[f] for f in (*plain, *reset)], np.uint16), np.array([f[FRESH] for f in every], np.uint8), starts


def _scan(compose: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of monoid elements: within columns, then over column totals."""
    n = len(items)
    if n <= COLUMNS:
        out = items.copy()
        for k in range(1, n):
            out[k] = compose[out[k - 1], items[k]]
        return out
    rows = -(-n // COLUMNS)
    grid = np.empty((COLUMNS, rows), items.dtype)
    padded = np.concatenate([items, np.full(rows * COLUMNS - n, items[-1])])
    grid[:] = padded.reshape(rows, COLUMNS).T
    width = len(compose)
    flat = compose.ravel()
    for k in range(1, COLUMNS):
        grid[k] = flat.take(grid[k - 1].astype(np.int32) * width + grid[k])
    totals = _scan(compose, grid[-1].copy())
    grid[:, 1:] = flat.take(totals[:-1].astype(np.int32)[None, :] * width + grid[:, 1:])
    return grid.T.reshape(-1)[:n]


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point. first: indexes at which a text begins."""
    compose, generators, reached, starts = _automaton()
    kinds = _classes()[codes]
    chosen = kinds.copy()
    chosen[first] += END
    state = reached[_scan(compose, generators[chosen])]
    before = np.empty_like(state)
    before[1:] = state[:-1]
    before[first] = FRESH
    following = np.empty_like(kinds)
    following[:-1] = kinds[1:]
    following[-1] = END
    following[first[first > 0] - 1] = END
    index = (before.astype(np.int32) * END + kinds) * (END + 1) + following
    return starts.ravel().take(index)


def piece_offsets(data: bytes, bounds: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces start, and len(data). bounds: byte offsets of the texts in it."""
    if not data:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    lead = (raw & 0xC0) != 0x80
    if lead.all():
        codes, at = raw, None
    else:
        codes, at = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32), np.flatnonzero(lead)
    begins = np.unique(bounds[:-1][bounds[:-1] < bounds[1:]])
    first = begins if at is None else np.searchsorted(at, begins)
    found = np.flatnonzero(piece_starts(codes, first))
    return np.append(found if at is None else at[found], len(data))


class Vocabulary:
    """Ranks of a byte-level BPE and a bounded cache of merged pieces."""

    def __init__(self, ranks: dict[bytes, int], entries: int = CACHE_ENTRIES):
        self.ranks, self.entries = ranks, entries
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    @functools.cache
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [ranks.get(piece[k : k + 2], 1 << 60) for k in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 60:
                break
            k = pairs.index(least)
            parts[k : k + 2] = [joined := parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(joined + parts[k + 1], 1 << 60)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + joined, 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges by a heap over a linked list, for runs of any length."""
        ranks, n = self.ranks, len(piece)
        ends, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            if gone[k] or ends[k] >= n or ends[k] == stop or ends[ends[k]] != stop:
                continue
            gone[ends[k]] = 1
            ends[k] = stop
            if stop < n:
                before[stop] = k
                if (r := ranks.get(piece[k : ends[stop]])) is not None:
                    heapq.heappush(heap, (r, k, ends[stop]))
            if (p := before[k]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : ends[k]]])
            k = ends[k]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece."""
        cache = self.cache
        try:
            return [cache[p] for p in pieces]
        except KeyError:
            pass
        if len(cache) > self.entries:
            cache.clear()
        for p in set(pieces).difference(cache):
            cache[p] = np.array(self.merge(p), "<u4").tobytes()
        return [cache[p] for p in pieces]

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        at = piece_offsets(data, np.array([0, len(data)])).tolist()
        return np.frombuffer(b"".join(self.encode_pieces([data[a:b] for a, b in zip(at, at[1:])])), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, decoded: bool = False) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary.load(path)
    lengths = np.array([len(t) for t in vocabulary.tokens], np.uint32)
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        for low, high in blocks(offsets, BLOCK_BYTES):
            part = bytes(data[offsets[low] : offsets[high]])
            bounds = offsets[low : high + 1] - offsets[low]
            cuts = piece_offsets(part, bounds)
            where = cuts.tolist()
            coded = vocabulary.encode_pieces([part[a:b] for a, b in zip(where, where[1:])])
            sizes = np.zeros(len(coded) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)), out=sizes[1:])
            joined = b"".join(coded)
            at = sizes[np.searchsorted(cuts, bounds)]
            spans = np.cumsum(lengths[np.frombuffer(joined, "<u4")], dtype=np.int64)
            edges = at // 4
            if len(spans):
                base = np.concatenate([[0], spans])[edges[:-1]]
                spans -= np.repeat(base, np.diff(edges))
            columns = [batch.column(0).slice(low, high - low), _binary(joined, at), _binary(spans.astype("<u4").tobytes(), at)]
            if decoded:
                back = vocabulary.decode(np.frombuffer(joined, "<u4").tolist())
                last = np.concatenate([spans, [0]])[np.maximum(edges[1:] - 1, 0)] * (edges[1:] > edges[:-1])
                columns.append(_binary(back, np.concatenate([[0], np.cumsum(last)])))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "ends"] + ["decoded"] * decoded)


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    if len(data) < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.array([data[a:b] for a, b in zip(offsets, offsets[1:])], pa.binary())


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = Vocabulary.load(path).tokens
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        ids = [np.frombuffer(data[a:b], "<u4").tolist() for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b"".join(map(tokens.__getitem__, x)) for x in ids], pa.binary())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids, ends[, decoded]) for each row: ids and the byte offset at which each token ends,
    both as little-endian unsigned 32-bit integers. decoded: the ids are turned back into bytes,
    and the retained offsets cut those into rows, in the same pass.

    A null text counts as empty and has no tokens. Rows are kept as they are, repeated ones too;
    other columns are not read. Nothing is shuffled; memory is bounded by one block of texts, or
    by the longest text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(functools.partial(_encoded, path=path, decoded=decoded), f"id {kind}, ids binary, ends binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded`, the bytes that the ids of `encode` stand for."""
    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(functools.partial(_decoded, path=path), f"id {kind}, ids binary, decoded binary")
