"""Toxicity by Levenshtein automata intersected with a trie of learned terms.

Terms are learned from labelled rows: whole words of up to four letters, stems of 4 to 9 letters, and stems that need a further
letter. A term enters the lexicon if its documents are toxic far more often than chance allows over all terms tested; of terms
that begin alike the most telling one does. Its weight is the log of its odds. The lexicon becomes a trie. A
word's automaton of up to one edit (two for long terms; a swap of neighbours is one) runs through the trie's nodes; the
intersection is determinised as words arrive, so a word costs one look-up a letter. A word matches exactly or misspelled.

Every match is read in a window of words around it. Inside quotation marks, or beside a word that reports speech, it is a
quotation; the others are abuse. The weights of the four kinds of matches, and their share of the text, are the inputs of a
logistic regression. Labels, language, source and doc_id are no inputs.

Terms and weights are fitted on at most ``FIT_ROWS`` labelled rows (those with the smallest hashes of doc_id); near copies
count once there, by four min-hashes of word 5-grams. All texts are scored whole. Null and empty texts have no matches and get
the score of such a text. Without labels of both kinds every score is the share of toxic labels (0.5 if there are none).
Repeated rows and extra columns change nothing.
"""
from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as wd
from .scratch import keep

FIT_ROWS = 24_000
#: Rows with this remainder of crc32(doc_id) mod 4 are held out.
HELD_OUT = 2
THRESHOLD = 0.3
#: Words on each side of a match that decide whether it is quoted.
CONTEXT = 8
PREFIXES = range(4, 10)
MOST_TERMS = 2000
#: Log-likelihood ratio by which a term must beat chance, beyond the log of the number of terms tested.
MARGIN = 3.0
#: Toxic documents a term must have to be tested at all.
LEAST = 5
PURITY = 0.6
#: Kinds of terms.
WHOLE, STEM, OPEN = 0, 1, 2
#: Letters from which a term may be one or two edits away.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words that report speech.
REPORTING = frozenset("said says wrote quoted called quote dijo dice escribió dit écrit cité sagte sagt schrieb zitiert".split())
_MEMO = 400_000


_NONE = (9, 0.0)


class Matcher:
    """Trie of terms, and the words within their edit distance (as prefixes for stems)."""

    def __init__(self, terms: list[tuple[str, int, float]]):
        """terms: (letters, kind, weight); a stem matches every word that begins like it, an open one needs a further letter."""
        self.child: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]  # kind of the term that ends here
        self.weight: list[float] = [0.0]
        self.most: list[int] = [0]  # edits allowed to any term below
        self.allowed: list[int] = [0]  # edits allowed to the term that ends here
        for letters, kind, weight in terms:
            edits = 2 if len(letters) >= TWO_EDITS else 1 if len(letters) >= ONE_EDIT else 0
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in letters:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.end.append(-1)
                    self.weight.append(0.0)
                    self.most.append(0)
                    self.allowed.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], edits)
            self.end[node], self.weight[node], self.allowed[node] = kind, weight, edits
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.verdicts: list[tuple] = []  # by kind: (edits, -weight) of the best term that ends here
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, points: set) -> frozenset:
        """With letters left out of the word."""
        todo, out = list(points), set(points)
        while todo:
            node, e, swap = todo.pop()
            if swap:
                continue
            for c, below in self.child[node].items():
                point = (below, e + 1, "")
                if e < self.most[below] and point not in out:
                    out.add(point)
                    todo.append(point)
        best: dict = {}
        for node, e, swap in out:
            best[node, swap] = min(e, best.get((node, swap), 9))
        return frozenset((n, e, s) for (n, s), e in best.items())

    def _state(self, points: frozenset) -> int:
        if points not in self.states:
            self.states[points] = len(self.sets)
            self.sets.append(points)
            self.moves.append({})
            done = [(self.end[n], (e, -self.weight[n])) for n, e, s in points if not s and self.end[n] >= 0 and e <= self.allowed[n]]
            self.verdicts.append(tuple(min((v for k, v in done if k == kind), default=_NONE) for kind in (WHOLE, STEM, OPEN)))
        return self.states[points]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e, swap in self.sets[state]:
            if swap:  # the first letter of a swapped pair is still to come
                if c == swap:
                    out.add((node, e, ""))
                continue
            if c in self.child[node]:
                out.add((self.child[node][c], e, ""))
            if e < self.most[node]:
                out.add((node, e + 1, ""))
                for a, below in self.child[node].items():
                    if e < self.most[below]:
                        out.add((below, e + 1, ""))
                        if c in self.child[below] and e < self.most[self.child[below][c]]:
                            out.add((self.child[below][c], e + 1, a))
        self.moves[state][c] = new = self._state(self._closed(out))
        return new

    def match(self, word: str) -> tuple[int, float]:
        """(0, 0) no match, (1, weight) exact, (2, weight) misspelled."""
        if len(self.sets) > _MEMO:
            self.states, self.sets, self.moves, self.verdicts = {}, [], [], []
            self.start = self._state(self._closed({(0, 0, "")}))
        state, stem, pending = self.start, _NONE, _NONE
        for c in word:
            stem = min(stem, pending)  # a further letter is there
            state = self.moves[state].get(c, -1) if c in self.moves[state] else self._move(state, c)
            if not self.sets[state]:
                break
            stem, pending = min(stem, self.verdicts[state][STEM]), min(pending, self.verdicts[state][OPEN])
            if not stem[0]:
                break
        best = stem if not stem[0] or not self.sets[state] else min(stem, self.verdicts[state][WHOLE])
        return (0, 0.0) if best == _NONE else (1 if best[0] == 0 else 2, -best[1])


_OPEN = re.compile("(?:^|[\\s(])[\"']|[“„«‘]")
_CLOSE = re.compile("[\"'](?:$|[\\s).,;!?])|[”“»’]")


def _quoted(before: str, after: str) -> bool:
    """Whether a quotation opened before is still open and closes after."""
    opened = [m.end() for m in _OPEN.finditer(before)]
    closed = [m.end() for m in _CLOSE.finditer(before)]
    return bool(opened) and (not closed or closed[-1] <= opened[-1]) and bool(_CLOSE.search(after))


class Scorer:
    """Inputs of the regression for Arrow columns of texts, in a worker."""

    def __init__(self, terms: list[tuple[str, int, float]]):
        self.matcher, self.known = Matcher(terms), {}

    def matches(self, names: list[bytes]) -> tuple[np.ndarray, dict[int, float]]:
        """Kind of match of each word, and the weights of those that match."""
        if len(self.known) > _MEMO:
            self.known = {}
        known, match = self.known, self.matcher.match
        kinds, weights = np.zeros(len(names), np.int8), {}
        for i, w in enumerate(names):
            found = known.get(w)
            if found is None:
                found = known[w] = match(w.decode())
            if found[0]:
                kinds[i], weights[i] = found
        return kinds, weights

    def inputs(self, texts: pa.Array) -> np.ndarray:
        """Rows: a constant, logs of the weights of exact and misspelled abuse and quotation, and the share of abuse."""
        cut = wd.cut(texts, wd.SYMBOLS, lower=True)
        counts = np.zeros((len(texts), 4))
        if len(cut):
            codes, names = cut.coded()
            names = names.to_pylist()
            by_name, weights = self.matches(names)
            kinds = by_name[codes]
            body, _ = wd.text_bytes(texts)
            hits = np.flatnonzero(kinds)
            docs = np.searchsorted(cut.docs, hits, "right") - 1
            for i, d in zip(hits.tolist(), docs.tolist()):
                a, b = max(int(cut.docs[d]), i - CONTEXT), min(int(cut.docs[d + 1]), i + CONTEXT + 1)
                first, last = int(cut.starts[i]), int(cut.starts[i] + cut.lengths[i])
                quoted = any(names[c].decode() in REPORTING for c in codes[max(a, i - 3):min(b, i + 4)].tolist())
                if not quoted:
                    left = int(cut.starts[a - 1] + cut.lengths[a - 1]) if a > cut.docs[d] else int(cut.starts[a])
                    right = int(cut.starts[b]) if b < cut.docs[d + 1] else int(cut.starts[b - 1] + cut.lengths[b - 1]) + 2
                    quoted = _quoted(body[max(0, left - 1):first].tobytes().decode("utf-8", "replace"), body[last:right].tobytes().decode("utf-8", "replace"))
                counts[d, 2 * quoted + kinds[i] - 1] += weights[int(codes[i])]
        share = (counts[:, 0] + counts[:, 1]) / np.sqrt(np.maximum(cut.counts, 1))
        return np.column_stack([np.ones(len(texts)), np.log1p(counts), np.minimum(share, 10.0)])


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows that aren't held out, near copies once."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` rows of two numbers go to every task, so texts stay where they are.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(_minhashed, "doc_id long, text string, toxic int, m0 long, m1 long, m2 long, m3 long")
    rows = keep(rows, "labelled")
    first = lambda rows, c: rows.groupBy(c, "toxic").agg(F.min_by(F.struct(*rows.columns), F.struct("doc_id", "m0", "m1")).alias("r")).select("r.*")
    slim = rows.drop("text")
    for c in ("m0", "m1", "m2", "m3"):
        slim = first(slim, c)
    return rows.join(slim.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic")


def _minhashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in wd.slices(batch):
                cut = wd.cut(part.column("text"), wd.SYMBOLS, lower=True)
                h = np.append(cut.hashes(), np.zeros(4, np.uint64))
                grams = wd.mix(sum((h[k:k + len(cut)] * np.uint64(2 * k + 3) for k in range(5)), np.zeros(len(cut), np.uint64)))
                least = np.tile(wd.mix(part.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64))[:, None], 4)
                full = np.flatnonzero(cut.counts)
                for k in range(4):
                    if len(full):
                        least[full, k] = np.minimum.reduceat(wd.mix(grams + np.uint64(k)), cut.docs[:-1][full])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "text", "toxic")), *(pa.array(least[:, k].view(np.int64).copy()) for k in range(4))],
                                                 ["doc_id", "text", "toxic", "m0", "m1", "m2", "m3"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for part in wd.slices(batch):
            cut = wd.cut(part.column("text"), wd.SYMBOLS, lower=True)
            if not len(cut):
                continue
            codes, names = cut.coded()
            names = [n.decode() for n in names.to_pylist()]
            toxic = part.column("toxic").to_numpy()
            doc = np.repeat(np.arange(part.num_rows), cut.counts)
            for size, kind in [(0, WHOLE), *((size, kind) for size in PREFIXES for kind in (STEM, OPEN))]:
                fits = (lambda n: len(n) <= PREFIXES[0]) if kind == WHOLE else (lambda n: len(n) >= size) if kind == STEM else (lambda n: len(n) > size)  # noqa: B023
                terms: dict[str, int] = {}
                of = np.array([terms.setdefault(n[:size] if size else n, len(terms)) if fits(n) else -1 for n in names], np.int64)
                here = of[codes]
                pairs = np.unique(here[here >= 0] * part.num_rows + doc[here >= 0])
                term, own = pairs // part.num_rows, toxic[pairs % part.num_rows]
                pos, n = np.bincount(term[own > 0], minlength=len(terms)), np.bincount(term, minlength=len(terms))
                for (t, k), a in zip(terms.items(), pos.tolist()):
                    x = total.setdefault((t, kind), [0, 0])
                    x[0] += a
                    x[1] += int(n[k]) - a
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in total], pa.string()), pa.array([k for _, k in total], pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1] for x in total.values()], pa.int64())],
            ["term", "kind", "pos", "neg"])


def lexicon(rows: DataFrame, most: int = MOST_TERMS) -> list[tuple[str, int, float]]:
    """Terms of toxic rows with kind and weight, at most ``most`` are looked at; no term begins like another."""
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    if not n.pos or n.pos == n.n:
        return []
    base = n.pos / n.n
    found = keep(rows.mapInArrow(_term_counts, "term string, kind int, pos long, neg long").groupBy("term", "kind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "terms")
    found = found.where(F.col("pos") >= LEAST)
    tested = found.count()
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = F.col("pos") * F.log(share / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    good = found.where((share >= PURITY) & (gain >= MARGIN + math.log(max(1, tested)))).withColumn("gain", gain)
    chosen: dict[str, tuple[int, float]] = {}
    for r in good.orderBy(F.desc("gain"), F.length("term"), "term", "kind").limit(most).collect():
        if not any(t.startswith(r.term) or r.term.startswith(t) for t in chosen):
            chosen[r.term] = (r.kind, math.log((r.pos + 0.5) / (r.neg + 0.5)))
    return sorted((t, *v) for t, v in chosen.items())


def _inputs(terms):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for batch in batches:
            for part in wd.slices(batch):
                x = scorer.inputs(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("toxic")], ["x", "toxic"])

    return of


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic regression (Newton's method, ridge on all but the constant)."""
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[list[tuple[str, int, float]], list[float]]:
    """Terms and weights from at most ``most`` labelled rows."""
    rows = keep(training_rows(docs, labels, most), "training")
    terms = lexicon(rows)
    got = rows.mapInArrow(_inputs(terms), "x array<double>, toxic int").collect()  # bounded by ``most``
    if not got:
        return [], [0.0] * 6
    x, y = np.array([r.x for r in got]), np.array([r.toxic > 0 for r in got], float)
    order = np.lexsort((y, *x.T))
    return terms, logistic(x[order], y[order]).tolist()


def _scored(terms, weights, name="score"):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = Scorer(terms), np.array(weights)
        for batch in batches:
            for part in wd.slices(batch):
                score = 1 / (1 + np.exp(-np.clip(scorer.inputs(part.column("text")) @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names), pa.array(score)], [*part.schema.names, name])

    return of


def scores(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    terms, weights = fit(docs, labels, most)
    found = docs.select("doc_id", "text").mapInArrow(_scored(terms, weights), "doc_id long, text string, score double").drop("text")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """``docs`` without those that are predicted toxic."""
    terms, weights = fit(docs, labels, most)
    name = "score"
    while name in docs.columns:
        name += "_"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {name} double"
    return docs.mapInArrow(_scored(terms, weights, name), schema).where(F.col(name) < THRESHOLD).drop(name)


def crc_remainder(doc_id: int) -> int:
    """The remainder of ``held_out`` outside of Spark."""
    return zlib.crc32(str(doc_id).encode()) % 4
