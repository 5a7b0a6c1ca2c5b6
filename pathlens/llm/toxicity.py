"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learnt from labelled rows: word beginnings and whole words that are far more frequent
in toxic than in clean texts, once near copies have been folded together. Its trie is intersected
with Levenshtein automata (the error bound grows with the term) and made deterministic; all words of
a block of texts then walk the resulting table in step, as arrays. Matches are weighed in a window
of words around them: quotation marks and verbs of saying speak for quotation, second-person words
and other matches near by for abuse. A logistic model turns the sums into a score.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlens.llm.byte_bpe import LETTER, NUMBER, _classes
from pathlens.llm.common import blocks, checkpointed, lean, split_residue, typed, utf8
from pathlens.llm.ngram_join import shingles, signatures

#: The bound of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS = 20_000
#: A term's least share of the toxic texts of the sample and least log-odds; lengths of beginnings. Shorter and longer words are terms as wholes.
LEAST_SHARE, LEAST_ODDS, SHORTEST, LONGEST = 0.004, 4.0, 4, 14
WINDOW, BLOCK_BYTES = 5, 1 << 20
# Fixed word lists: words of saying before a quoted term, and words that address somebody.
SAYING = ("called", "says", "said", "saying", "wrote", "word", "words", "term", "quote", "quoted", "quoting", "named")
ADDRESS = ("you", "your", "youre", "u", "ur", "yourself", "du", "dich", "tu", "toi", "te", "vous", "usted")
QUOTES = "\"“”„«»‹›"
FEATURES = ("weight", "terms", "quoted", "addressed", "near", "rate", "fuzzy", "fuzzy_quoted")
END = "\0"


@dataclass
class Automaton:
    """A deterministic automaton over symbols; state 0 is dead, 1 the start."""

    symbols: dict[str, int]
    table: np.ndarray
    #: Per state: errors * number of terms + term of the best match reached there, or a large number.
    accepts: np.ndarray
    terms: list[str]

    @property
    def steps(self) -> int:
        return max(map(len, self.terms), default=0) + 3


NONE = np.int32(1 << 30)


def errors_allowed(term: str) -> int:
    """0 below 5 letters, 1 below 9, then 2; word beginnings are looser already and get one less from 6 on."""
    size = len(term.rstrip(END))
    if term.endswith(END):
        return 0 if size < 5 else 1 if size < 9 else 2
    return 0 if size < 6 else 1


def build(terms: list[str]) -> Automaton:
    """The Levenshtein automata of all terms on their trie, made deterministic.

    A term that ends with END matches whole words, any other one the beginning of a word.
    """
    children: list[dict[str, int]] = [{}]
    final: dict[int, int] = {}
    slack = [0]
    for number, term in enumerate(terms):
        node = 0
        slack[0] = max(slack[0], errors_allowed(term))
        for letter in term:
            if letter not in children[node]:
                children[node][letter] = len(children)
                children.append({})
                slack.append(0)
            node = children[node][letter]
            slack[node] = max(slack[node], errors_allowed(term))
        final[node] = number
    letters = sorted({c for t in terms for c in t} - {END})
    symbols = {END: 1} | {c: k for k, c in enumerate(letters, 2)}  # 0: any other character
    names = {k: c for c, k in symbols.items()}

    def closed(pairs: dict[int, int]) -> frozenset:
        todo = list(pairs.items())
        while todo:
            node, errors = todo.pop()
            if pairs[node] < errors:
                continue
            for letter, child in children[node].items():  # the text lacks a letter
                if letter != END and errors + 1 <= slack[child] and errors + 1 < pairs.get(child, 9):
                    pairs[child] = errors + 1
                    todo.append((child, errors + 1))
        return frozenset(pairs.items())

    def step(state: frozenset, symbol: int) -> frozenset:
        out: dict[int, int] = {}
        letter = names.get(symbol)
        for node, errors in state:
            if letter in children[node]:
                child = children[node][letter]
                out[child] = min(errors, out.get(child, 9))
            if symbol == 1:
                continue
            if errors + 1 <= slack[node] and node:  # an extra letter, not before the first one
                out[node] = min(errors + 1, out.get(node, 9))
            for other, child in children[node].items():
                if other not in (END, letter) and errors + 1 <= slack[child]:
                    out[child] = min(errors + 1, out.get(child, 9))
        return closed(out)

    start = closed({0: 0})
    known, rows, accepts, todo = {frozenset(): 0, start: 1}, {0: [0] * (len(symbols) + 1)}, {0: NONE, 1: NONE}, [start]
    while todo:
        state = todo.pop()
        row = []
        for symbol in range(len(symbols) + 1):
            reached = step(state, symbol)
            if reached not in known:
                known[reached] = len(known)
                accepts[known[reached]] = min((e * len(terms) + final[n] for n, e in reached if n in final and e <= errors_allowed(terms[final[n]])), default=NONE)
                todo.append(reached)
            row.append(known[reached])
        rows[known[state]] = row
    return Automaton(symbols, np.array([rows[k] for k in range(len(known))], np.int32), np.array([accepts[k] for k in range(len(known))], np.int32), terms)


@functools.cache
def _word_table() -> np.ndarray:
    inside = np.isin(_classes(), (LETTER, NUMBER)) | (_classes() > 5)
    inside[[ord(c) for c in "@$*"]] = True
    return inside


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends) of the words of a lower-cased text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inside = _word_table()[codes]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return codes, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def matches(machine: Automaton, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The best accept value of each word, or NONE: all words walk the table together, the dead ones drop out."""
    best = np.full(len(starts), NONE)
    if not machine.terms:
        return best
    highest = max((ord(c) for c in machine.symbols), default=0)
    number = np.zeros(highest + 2, np.int32)
    for letter, k in machine.symbols.items():
        if letter != END:
            number[ord(letter)] = k
    symbols = number[np.minimum(codes, highest + 1)]
    active, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
    for j in range(machine.steps + 1):
        at = starts[active] + j
        over = at >= ends[active]
        symbol = np.where(over, 1, symbols[np.minimum(at, len(symbols) - 1)])
        state = machine.table[state, symbol]
        best[active] = np.minimum(best[active], machine.accepts[state])
        kept = (state != 0) & ~over
        active, state = active[kept], state[kept]
        if not len(active):
            break
    return best


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    odds: list[float] = field(default_factory=list)
    benign: frozenset = frozenset()
    center: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float = 0.0
    machine: Automaton | None = None

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.center)) / np.array(self.scale) @ np.array(self.weights) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def features(model: Model, texts: list[str], surfaces: list[set] | None = None) -> np.ndarray:
    """A row of FEATURES for each text. surfaces: gets the misspelt words that matched, per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    machine = model.machine or build(model.terms)
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered) + "\n"
    codes, starts, ends = words_of(joined)
    if not len(starts):
        return out
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    first = np.searchsorted(starts, bounds)
    found = matches(machine, codes, starts, ends)
    hits = np.flatnonzero(found < NONE)
    if not len(hits):
        return out
    owner = np.searchsorted(bounds, starts[hits], side="right") - 1
    marks = np.cumsum(np.isin(codes, [ord(c) for c in QUOTES]))
    by_text = defaultdict(list)
    for k, doc in zip(hits.tolist(), owner.tolist()):
        by_text[doc].append(k)
    for doc, at in by_text.items():
        low, high = int(first[doc]), int(first[doc + 1])
        opened = int(marks[bounds[doc] - 1]) if bounds[doc] else 0
        weight = near = 0.0
        count = Counter()
        seen: set[int] = set()
        exact_at = [k for k in at if found[k] < len(machine.terms)]
        for k in at:
            errors, term = divmod(int(found[k]), len(machine.terms))
            word = joined[starts[k] : ends[k]]
            if errors and word in model.benign:
                continue
            if errors and surfaces is not None:
                surfaces[doc].add(word)
            around = [joined[starts[i] : ends[i]] for i in range(max(low, k - WINDOW), min(high, k + WINDOW + 1))]
            inside = (int(marks[starts[k]]) - opened) % 2 == 1 and int(marks[bounds[doc + 1] - 1]) > int(marks[ends[k] - 1])
            quoted = inside or any(w in SAYING for w in around[: min(k - low, WINDOW)][-3:])
            kind = "fuzzy" if errors else "terms"
            count[kind] += not quoted  # what is quoted is no abuse of its own
            count["fuzzy_quoted" if errors else "quoted"] += quoted
            count["addressed"] += (not quoted) and any(w in ADDRESS for w in around)
            if not errors and not quoted:
                near = max(near, sum(1 for x in exact_at if abs(x - k) <= 4 * WINDOW))
                if term not in seen:
                    seen.add(term)
                    weight += model.odds[term]
        out[doc] = (math.log1p(weight), math.log1p(count["terms"]), math.log1p(count["quoted"]), math.log1p(count["addressed"]), math.log1p(near), math.log1p(100.0 * count["terms"] / max(20, high - low)), math.log1p(count["fuzzy"]), math.log1p(count["fuzzy_quoted"]))
    return out


def _beginnings(text: str) -> set[str]:
    codes, starts, ends = words_of(text.lower())
    lowered = text.lower()
    out = set()
    for word in {lowered[a:b] for a, b in zip(starts.tolist(), ends.tolist())}:
        whole = word + END
        if len(word) >= 2:
            out.add(whole)
        out.update(whole[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return out


@lean
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        rows = [[], [], [], []]
        for low, high in blocks(offsets, BLOCK_BYTES):
            gram, at = shingles(bytes(data[offsets[low] : offsets[high]]), offsets[low : high + 1] - offsets[low])
            for k, values in enumerate(signatures(gram, at, 4).T):
                rows[k].append(values.astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(r) if r else np.zeros(0, np.int64)) for r in rows)], ["row", "m0", "m1", "m2", "m3"])


@lean
def _counted(batches: Iterator[pa.RecordBatch], kept: frozenset) -> Iterator[pa.RecordBatch]:
    """Partial counts of beginnings by label, over the kept rows of this task."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for row, text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if row in kept:
                (toxic if label else clean).update(_beginnings(text))
    names = list(toxic.keys() | clean.keys())
    for low in range(0, len(names), 50_000):
        part = names[low : low + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], ["term", "toxic", "clean"])


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[list[str], list[float]]:
    """Terms and their log-odds, of (beginning, toxic texts, clean texts).

    The shortest beginnings with log-odds enough are lengthened as long as one longer beginning
    holds nearly all their texts; a beginning that ends in END is a whole word.
    """
    odds = {t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for t, a, b in rows}
    count = {t: a for t, a, _ in rows}
    longer = defaultdict(list)
    for t in count:
        longer[t[:-1]].append(t)
    chosen: dict[str, float] = {}
    for t in sorted(count, key=lambda t: (len(t), t)):
        if odds[t] < LEAST_ODDS or any(t[:k] in odds and odds[t[:k]] >= LEAST_ODDS for k in range(SHORTEST, min(len(t) - 1, LONGEST) + 1)):
            continue
        while (n := max(longer[t], key=count.__getitem__, default=None)) and count[n] >= 0.95 * count[t]:
            t = n
        chosen[t] = odds[t]
    best = sorted(chosen, key=lambda t: (-count[t], t))
    return best, [chosen[t] for t in best]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with an L2 penalty on the weights."""
    design = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(design.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + penalty @ beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        move = np.linalg.solve(hessian, gradient)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


@lean
def _sample_features(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        surfaces = [set() for _ in texts]
        x = features(model, texts, surfaces)
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array([sorted(s) for s in surfaces], pa.list_(pa.string())), batch.column(2)], ["x", "surfaces", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most `rows` labelled rows, chosen by a hash of the id, whose crc32(id) mod `modulus` is not 0.

    Without toxic or without clean rows the score is the toxic share of the sample (0 if that is empty).
    """
    usable = labels.filter((split_residue(id_col, modulus) != 0) & F.col(label_col).isNotNull())
    chosen = usable.groupBy(F.col(id_col).alias("row")).agg(F.max(label_col).cast("int").alias("toxic")).orderBy(F.xxhash64("row"), "row").limit(rows)
    texts = docs.select(docs[id_col].alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    sample = checkpointed(texts.join(F.broadcast(chosen), "row").select("row", "text", "toxic"))  # `rows` bounds the broadcast
    kind = sample.schema["row"].dataType.simpleString()
    sketch = sample.select("row", "text").mapInArrow(_sketched, f"row {kind}, m0 long, m1 long, m2 long, m3 long").collect()
    label = dict(map(tuple, sample.select("row", "toxic").collect()))
    kept, seen = [], [set() for _ in range(4)]
    for r in sorted(sketch, key=lambda r: r["row"]):
        if not any((label[r["row"]], r[f"m{k}"]) in seen[k] for k in range(4)):
            kept.append(r["row"])
        for k in range(4):
            seen[k].add((label[r["row"]], r[f"m{k}"]))
    toxic = sum(1 for k in kept if label[k])
    clean = len(kept) - toxic
    model = Model()
    if not toxic or not clean:
        share = sum(map(bool, label.values())) / max(1, len(label))
        model.bias = math.log(share / (1 - share)) if 0 < share < 1 else 40.0 if share else -40.0
        model.machine = build([])
        return model
    counts = sample.mapInArrow(functools.partial(_counted, kept=frozenset(kept)), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows_ = counts.filter(F.col("toxic") >= max(3, math.ceil(LEAST_SHARE * toxic))).collect()  # bounded by the sample
    model.terms, model.odds = choose_terms([tuple(r) for r in rows_], toxic, clean)
    model.machine = build(model.terms)
    schema = "x array<double>, surfaces array<string>, toxic int"
    first = sample.mapInArrow(functools.partial(_sample_features, model=model), schema).select("surfaces", "toxic").filter(F.size("surfaces") > 0).collect()
    good, bad = Counter(), Counter()
    for r in first:
        (bad if r["toxic"] else good).update(r["surfaces"])
    total = sum(map(bool, label.values()))
    model.benign = frozenset(w for w, n in good.items() if (bad[w] + 0.5) / (total + 1) < 8 * (n + 0.5) / (len(label) - total + 1))
    again = sample.mapInArrow(functools.partial(_sample_features, model=model), schema).select("x", "toxic").collect()
    x, y = np.array([r["x"] for r in again]), np.array([float(r["toxic"]) for r in again])
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    model.center, model.scale = x.mean(axis=0).tolist(), np.maximum(x.std(axis=0), 1e-3).tolist()
    weights, model.bias = fit_logistic((x - model.center) / model.scale, y)
    model.weights = weights.tolist()
    return model


@lean
def _scored(batches: Iterator[pa.RecordBatch], model: Model, field: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(pc.struct_field(batch.column(0), field) if field else batch.column(1))
        for low, high in blocks(offsets, BLOCK_BYTES):
            x = features(model, [bytes(data[a:b]).decode() for a, b in zip(offsets[low:high], offsets[low + 1 : high + 1])])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(model.score(x)), *(pa.array(x[:, k]) for k in (1, 2, 6))], ["id", "score", "terms", "quoted", "fuzzy"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, terms, quoted, fuzzy) for each row: score in 0..1; the others are log(1 + count).

    A null text counts as empty and gets the score of a text without matches. Only the text enters
    a score, so equal texts have equal scores. Rows are not moved; repeated ones stay. The id may
    be a struct of a whole row; a text that is a field of it, as in "row.text", is sent once.
    """
    field = text_col.removeprefix(f"{id_col}.") if text_col.startswith(f"{id_col}.") else None
    schema = typed(docs.schema[id_col].dataType, "score double, terms double, quoted double, fuzzy double")
    sent = [docs[id_col].alias("id")] + ([] if field else [docs[text_col].cast("string").alias("text")])
    return docs.select(*sent).mapInArrow(functools.partial(_scored, model=model, field=field), schema)
