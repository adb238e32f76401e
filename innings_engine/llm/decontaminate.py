"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) are compiled into one suffix automaton per
block of items. Its states that hold a *window* (``window`` consecutive words of an item, or a whole shorter item) list the
items. Document words stream through it; the longest matching length tells which windows end at a word. A stretch of a
document can only match while its neighbouring words are neighbours in some item, so numpy cuts each slice of documents to
such stretches first and the automaton walks only those.

A block has a bounded number of bytes (``BLOCK_BYTES``), whatever the benchmark's size: further items are further
blocks, each a pass over all documents, and the hits of a document are united by its id and the digest of its text.

Null or empty texts and items have no words and never match. Items that repeat, or several items with one id, count once
per id; a null item_id is not counted as an item but its words hit. Other columns, also of the same names, are ignored.
Each row is judged by its own text, at any number of blocks: rows that repeat a doc_id, with equal or different texts, and rows
without one give one result each.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import words as wd
from .scratch import keep

WINDOW = 13
#: Bytes of item texts in one automaton.
BLOCK_BYTES = 2 << 20
#: A document is contaminated if hit words are at least 1 / COVERAGE of its words.
COVERAGE = 20

_HITS = "doc_id long, digest string, n_words long, spans array<struct<a:int,b:int>>, items array<long>"


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.goals: dict[int, dict[int, set[int]]] = {}  # state -> length of a window -> items
        for item, sequence in coded:
            length = min(window, len(sequence))
            state = matched = 0
            for i, word in enumerate(sequence):
                state, matched = self.step(state, matched, word)
                if i + 1 >= length:
                    at = state
                    while self.size[self.link[at]] >= length:
                        at = self.link[at]
                    self.goals.setdefault(at, {}).setdefault(length, set()).update(() if item is None else (item,))
        self.shortest = min((n for g in self.goals.values() for n in g), default=window)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.up = [-1] * len(self.size)  # nearest state with goals on the suffix path
        for state in order:
            self.up[state] = state if state in self.goals else self.up[self.link[state]]
        width = len(self.ids) + 1
        self.pairs = np.unique(np.array([a * width + b for _, s in coded for a, b in zip(s, s[1:])], np.int64))

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            if self.size[there] == self.size[last] + 1:
                return there
            return self._clone(last, word, there)
        new = len(self.size)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][word]
            self.link[new] = there if self.size[there] == self.size[last] + 1 else self._clone(last, word, there)
        return new

    def _clone(self, last: int, word: int, there: int) -> int:
        new = len(self.size)
        self.next.append(dict(self.next[there]))
        self.size.append(self.size[last] + 1)
        self.link.append(self.link[there])
        self.link[there] = new
        while last >= 0 and self.next[last].get(word) == there:
            self.next[last][word] = new
            last = self.link[last]
        return new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.size[state]
        there = self.next[state].get(word)
        return (0, 0) if there is None else (there, matched + 1)

    def stream(self, sequence: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(end, length, items) of every window that occurs."""
        state = matched = 0
        for i, word in enumerate(sequence):
            state, matched = self.step(state, matched, word)
            at = self.up[state]
            while at > 0:
                for length, items in self.goals[at].items():
                    if length <= matched:
                        yield i + 1, length, items
                at = self.up[self.link[at]]

    def numbers(self, cut: wd.Words) -> np.ndarray:
        if not len(cut):
            return np.empty(0, np.int64)
        codes, names = cut.coded()
        return np.array([self.ids.get(w, -1) for w in names.to_pylist()], np.int64)[codes]

    def stretches(self, cut: wd.Words) -> Iterator[tuple[int, list[int]]]:
        """First word and word numbers of each stretch that can hold a window."""
        numbers = self.numbers(cut)
        if not len(numbers):
            return
        tied = np.zeros(len(numbers), bool)  # to the word before
        both = (numbers[1:] >= 0) & (numbers[:-1] >= 0)
        pair = numbers[:-1] * (len(self.ids) + 1) + numbers[1:]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            tied[1:] = both & (self.pairs[at] == pair)
        tied[cut.docs[:-1][cut.counts > 0]] = False
        start = np.flatnonzero(~tied)
        size = np.diff(np.append(start, len(numbers)))
        long = (size >= self.shortest) & (numbers[start] >= 0)
        for a, n in zip(start[long].tolist(), size[long].tolist()):
            yield a, numbers[a:a + n].tolist()


def _hits(automaton):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: SuffixAutomaton = automaton.value
        for batch in batches:
            for part in wd.slices(batch):
                cut = wd.cut(part.column("text"), wd.SYMBOLS, lower=True)
                spans: dict[int, list[list[int]]] = {}
                items: dict[int, set[int]] = {}
                for first, sequence in machine.stretches(cut):
                    doc = int(np.searchsorted(cut.docs, first, "right")) - 1
                    base = first - int(cut.docs[doc])
                    for end, length, found in machine.stream(sequence):
                        items.setdefault(doc, set()).update(found)
                        own = spans.setdefault(doc, [])
                        a, b = base + end - length, base + end
                        while own and own[-1][1] >= a:
                            a = min(a, own.pop()[0])
                        own.append([a, b])
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array(cut.counts),
                     pa.array([[{"a": a, "b": b} for a, b in spans.get(d, ())] for d in range(n)], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                     pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.int64()))],
                    ["doc_id", "digest", "n_words", "spans", "items"])

    return of


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items as words, in blocks of about ``block_bytes``; one block at a time is on the driver."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().collect()
        yield [(r.item_id, _item_words(r.text)) for r in rows]


def _item_words(text: str) -> list[bytes]:
    cut = wd.cut(pa.array([text]), wd.SYMBOLS, lower=True)
    stops = np.cumsum(cut.lengths)
    body = cut.body.tobytes()
    return [body[b - n:b] for n, b in zip(cut.lengths.tolist(), stops.tolist())]


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, digest, n_words, spans, items) of each row: merged word ranges inside windows, and the items that have those windows."""
    rows = docs.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    passes = []
    for block in item_blocks(items, block_bytes):
        automaton = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))
        passes.append(rows.mapInArrow(_hits(automaton), _HITS))
    if len(passes) == 1:
        return passes[0]
    every = passes[0]
    for more in passes[1:]:
        every = every.union(more)
    # Rows with one id and one text have one result; they are counted in each pass and given back as often as they came.
    joined = every.groupBy("doc_id", "digest").agg(
        (F.count("*") / len(passes)).cast("int").alias("times"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    # Ranges in order: a range that reaches into the last one extends it.
    merge = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b"))))
    ).otherwise(F.concat(done, F.array(s)))
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    whole = joined.withColumn("spans", F.aggregate("spans", none, merge))
    return whole.select("*", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col", "times")


def _judged(found: DataFrame, coverage: int) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]).cast("long"))
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document with hit words, items and verdict."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return _judged(hits(docs, items, window, block_bytes), coverage).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")


@F.arrow_udf(StringType())
def _without_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans; null where there are no spans, so that other texts needn't be sent here."""
    out: list[str | None] = []
    for part in wd.slices(pa.RecordBatch.from_arrays([text, spans], ["text", "spans"])):
        cut = wd.cut(part.column("text"), wd.SYMBOLS, lower=True)
        body, offsets = wd.text_bytes(part.column("text"))
        for d, own in enumerate(part.column("spans").to_pylist()):
            if own is None:
                out.append(None)
                continue
            at, kept = int(offsets[d]), []
            for s in own:
                a, b = int(cut.docs[d]) + s["a"], int(cut.docs[d]) + s["b"] - 1
                kept.append(body[at:cut.starts[a]].tobytes())
                at = int(cut.starts[b] + cut.lengths[b])
            kept.append(body[at:offsets[d + 1]].tobytes())
            out.append(b"".join(kept).decode())
    return pa.array(out, pa.string())


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated rows; the others lose the spans that were hit (from the first to the last hit word)."""
    found = keep(_judged(hits(docs, items, window, block_bytes), coverage).where("n_hit > 0").select("doc_id", "digest", "spans", "contaminated").dropDuplicates(["doc_id", "digest"]), "hits")
    same = lambda left, right: F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.sha2(F.col(f"{left}.text").cast("binary"), 256) == F.col(f"{right}.digest"))
    # One join by row, merged as verdicts grow with the documents; only texts that lose spans go through Python.
    d, v = docs.alias("d"), found.alias("verdict").hint("merge")
    kept = d.join(v, same("d", "verdict"), "left").where("verdict.contaminated is null or not verdict.contaminated")
    spans = F.col("verdict.spans")
    clean = F.coalesce(_without_spans(F.when(spans.isNotNull(), F.col("d.text")), spans), F.col("d.text"))
    return kept.select(*[clean.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
