"""Removal of word windows that repeat across documents, by recompression.

Every document is parsed in rounds. A round names maximal runs of one symbol, then pairs of a left and a right symbol, the
side being a bit of the symbol's name under the round's seed. A name is a hash of what it stands for, so all tasks give
equal content one name without exchanging a dictionary, and equal substrings get equal symbols except near their ends.
For each symbol the parse carries its *context*, the words that alone decide its existence; a symbol whose context lies
inside a window is found in every copy of that window.

Every window takes as its anchor the symbol with the smallest name among those it decides by itself. Neighbouring windows
mostly share an anchor, so one record (the symbol in its context, hash of the whole span of such windows) stands for about twenty windows. Spark
then finds

1. symbols whose context occurs in two documents or more (grouped with partial sums, so a symbol of a third of all documents is no
   hot task); all other records are dropped,
2. equal spans: every window of a span repeats where the span's first document is smaller,
3. for symbols with several spans (the ends of repeats), the single windows of one representative per distinct span,
   compared by their own hashes.

Windows that decide no symbol (inside long runs) are their own anchor, so the result is exact. Words are those of
``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and lose nothing; texts shorter than a window lose nothing;
a document never loses words to itself. Rows that repeat a doc_id must be equal; each gives its own row. Extra columns stay.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as wd
from .scratch import keep

WINDOW = 50
ROUNDS = 3
#: Low bits of a rank that hold the symbol's place in its slice, so that ties go to the leftmost.
_INDEX_BITS = np.uint64(28)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def parse(names: np.ndarray, docs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after ``rounds``: name, first word, and context (first word, last word + 1).

    ``docs`` has the index of the first word of each document and the number of all words. A context that would need the
    end of a document lies outside every window.
    """
    n = len(names)
    at = np.arange(n)
    low, high = at.copy(), at + 1
    doc_of = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    first, last = docs[:-1][doc_of] - 1, docs[1:][doc_of] + 1  # outside of the document
    for turn in range(rounds):
        if not len(names):
            break
        doc = doc_of[at]
        joins = np.zeros(len(names), bool)  # to the symbol before
        joins[1:] = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
        start = np.flatnonzero(~joins)
        stop = np.append(start[1:], len(names))
        size = (stop - start).astype(np.uint64)
        heads = names[start]
        names, doc, at = np.where(size > 1, wd.mix(heads + wd.mix(size + np.uint64(977 + turn))), heads), doc[start], at[start]
        fresh = np.ones(len(start), bool)
        fresh[1:] = doc[1:] != doc[:-1]
        closing = np.append(fresh[1:], True)
        # A run is maximal because of one neighbour on each side, not because of the neighbours' whole runs.
        low, high = np.where(fresh, first[at], low[start - 1]), np.where(closing, last[at], np.append(high, 0)[stop])

        right = (wd.mix(names + np.uint64(7919 * (turn + 1))) & np.uint64(1)).astype(bool)
        merged = np.zeros(len(names), bool)  # the left half of a pair
        merged[:-1] = ~right[:-1] & right[1:] & ~closing[:-1]
        taken = np.append(False, merged[:-1])
        follow = np.append(names[1:], np.uint64(0))
        paired = wd.mix(wd.mix(names + np.uint64(31 + turn)) + follow)
        next_high = np.where(closing, last[at], np.append(high[1:], 0))
        prev_low = np.where(fresh, first[at], np.append(0, low[:-1]))
        new_low = np.where(right, prev_low, low)
        new_high = np.where(right, high, next_high)
        names = np.where(merged, paired, names)[~taken]
        low, high, at = new_low[~taken], new_high[~taken], at[~taken]
    return names, at, low, high


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class SpanHashes:
    """Hashes of any range of words."""

    def __init__(self, names: np.ndarray):
        self.prefix = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * _powers(len(names), _BASE), out=self.prefix[1:])
        self.undo = _powers(len(names) + 1, _UNBASE)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return wd.mix((self.prefix[b] - self.prefix[a]) * self.undo[a])


def anchors(names: np.ndarray, docs: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: symbol, hash of the span, first window, number of windows."""
    n, spans = len(names), SpanHashes(names)
    sizes = np.maximum(np.diff(docs) - window + 1, 0)
    at = wd.ragged(docs[:-1], sizes)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), at, at
    symbol, place, low, high = parse(names, docs, rounds)
    begin = np.cumsum(np.bincount(low + 1, minlength=n + 3))[at]
    end = np.cumsum(np.bincount(high, minlength=n + 3))[at + window]
    bits = _INDEX_BITS
    rank = ((wd.mix(symbol + np.uint64(5)) >> bits) << bits) | np.arange(len(symbol), dtype=np.uint64)
    least = [rank]
    for k in range(window.bit_length()):
        step = 1 << k
        least.append(np.minimum(least[-1], np.append(least[-1][step:], least[-1][-step:])[:len(rank)]) if step < len(rank) else least[-1])
    width = end - begin
    found = width > 0
    anchor = np.empty(len(at), np.int64)
    anchor[~found] = -1 - at[~found]  # the window itself
    level = np.log2(np.maximum(width, 1)).astype(np.int64)
    table = np.stack(least[:level.max() + 1])
    b, w, k = begin[found], width[found], level[found]
    anchor[found] = (np.minimum(table[k, b], table[k, b + w - (1 << k)]) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, len(at)))
    first, chosen = at[start], anchor[start]
    span = spans.of(first, first + count + window - 1)
    own = chosen < 0
    inside = first - place[np.maximum(chosen, 0)]  # the same in all copies of the span
    chosen = np.maximum(chosen, 0)
    context = spans.of(np.where(own, first, low[chosen]), np.where(own, first + window, high[chosen]))
    key = wd.mix(context + np.where(own, np.uint64(0), symbol[chosen]))
    span = wd.mix(span + wd.mix(np.where(own, 0, inside).astype(np.uint64) + np.uint64(3)) + count.astype(np.uint64))
    return key, span, first, count


_PARSED = "doc_id long, n_words long, kept_sha256 string, records array<struct<symbol:long,span:long,at:int,n:int>>"


def _parsed(window: int, rounds: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                cut = wd.cut(part.column("text"))
                body, begins = cut.joined()
                edges = np.append(begins, len(body))[cut.docs]
                digest = [hashlib.sha256(body[a:max(a, b - 1)]).hexdigest() for a, b in zip(edges.tolist(), edges[1:].tolist())]
                symbol, span, at, n = anchors(cut.hashes(), cut.docs, window, rounds)
                owner = np.searchsorted(at, cut.docs)
                base = np.repeat(cut.docs[:-1], np.diff(owner))
                fields = pa.StructArray.from_arrays(
                    [pa.array(symbol.view(np.int64)), pa.array(span.view(np.int64)), pa.array((at - base).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["symbol", "span", "at", "n"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(cut.counts), pa.array(digest, pa.string()), pa.ListArray.from_arrays(pa.array(owner.astype(np.int32)), fields)],
                    ["doc_id", "n_words", "kept_sha256", "records"])

    return of


def _windows(window: int):
    """Hashes of the single windows of the listed records."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                cut = wd.cut(part.column("text"))
                spans = SpanHashes(cut.hashes())
                lists = part.column("records")
                flat, per = lists.flatten(), np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(per)), per)
                n = flat.field("n").to_numpy().astype(np.int64)
                first = flat.field("at").to_numpy() + cut.docs[doc]
                start = wd.ragged(first, n)
                take = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.field("symbol").to_numpy()[take]), pa.array(flat.field("span").to_numpy()[take]),
                     pa.array((start - first[take]).astype(np.int32)), pa.array(spans.of(start, start + window).view(np.int64)),
                     part.column("doc_id").take(pa.array(doc[take]))],
                    ["symbol", "span", "step", "win", "doc_id"])

    return of


def _cut_out(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                cut = wd.cut(part.column("text"))
                body, begins = cut.joined()
                begins = np.append(begins, len(body))
                lists = part.column("gone")
                ranges, per = lists.flatten(), np.diff(lists.offsets.to_numpy())
                base = np.repeat(cut.docs[:-1], per)
                change = np.zeros(len(cut) + 1, np.int64)
                first = ranges.field("at").to_numpy() + base
                np.add.at(change, first, 1)
                np.add.at(change, first + ranges.field("n").to_numpy() + window - 1, -1)
                kept = np.cumsum(change)[:-1] == 0
                texts, removed = [], []
                for a, b in zip(cut.docs.tolist(), cut.docs[1:].tolist()):
                    own = kept[a:b]
                    texts.append(b"".join(body[begins[i]:begins[i + 1]] for i in (np.flatnonzero(own) + a).tolist())[:-1].decode())
                    removed.append(int(b - a - own.sum()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_removed", "kept_text"])

    return of


def removals(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, n_words, kept_sha256 of all words) of every document, and (doc_id, n_removed, kept_text) of those
    that lose words; kept words are joined by one space."""
    docs = docs.select("doc_id", "text")
    parsed = keep(docs.mapInArrow(_parsed(window, rounds), _PARSED), "parsed")
    records = parsed.select("doc_id", F.inline("records"))
    shared = records.groupBy("symbol").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("symbol")
    # Kept first: a join of two plain exchanges is split where a symbol is hot, one of an aggregate is not.
    # Symbols, spans and windows grow with the documents, and their files are far smaller than their rows: they are merged at any size.
    seen = keep(records.join(keep(shared, "symbols").hint("merge"), "symbol"), "shared")
    spans = keep(seen.groupBy("symbol", "span").agg(F.min("doc_id").alias("first_doc")), "spans")
    several = spans.groupBy("symbol").agg(F.count("*").alias("kinds")).where("kinds > 1").select("symbol", F.lit(True).alias("mixed"))
    spans = keep(spans.join(keep(several, "symbols"), "symbol", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))), "spans")
    seen = keep(seen.join(spans.hint("merge"), ["symbol", "span"]), "known")

    # Texts of every document that shares a symbol; records of which single windows are compared ride along.
    record = F.struct("symbol", "span", "at", "n")
    wanted = seen.groupBy("doc_id").agg(F.collect_list(F.when(F.col("mixed") & (F.col("doc_id") == F.col("first_doc")), record)).alias("records"))
    texts = keep(docs.join(wanted, "doc_id"), "texts")
    single = texts.where(F.size("records") > 0).mapInArrow(_windows(window), "symbol long, span long, step int, win long, doc_id long")
    single = keep(single, "windows")
    met = single.groupBy("symbol", "win").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("top")).where("source < top").drop("top")
    verdict = single.join(keep(met, "met").hint("merge"), ["symbol", "win"]).groupBy("symbol", "span").agg(F.collect_set(F.struct("step", "source")).alias("steps"))

    whole = seen.where(~F.col("mixed") & (F.col("doc_id") > F.col("first_doc"))).select("doc_id", F.array(F.struct("at", "n")).alias("gone"))
    whole = whole.union(seen.where(F.col("mixed") & (F.col("doc_id") > F.col("first_doc"))).select("doc_id", F.array(F.struct("at", "n"))))
    partly = seen.where(F.col("mixed") & (F.col("doc_id") == F.col("first_doc"))).join(verdict.hint("merge"), ["symbol", "span"]).select(
        "doc_id", F.transform(F.filter("steps", lambda s: s["source"] < F.col("doc_id")),
                              lambda s: F.struct((F.col("at") + s["step"]).alias("at"), F.lit(1).alias("n"))).alias("gone"))
    gone = whole.union(partly.where(F.size("gone") > 0)).groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    lost = texts.select("doc_id", "text").join(gone, "doc_id").mapInArrow(_cut_out(window), "doc_id long, n_removed long, kept_text string")
    return parsed.select("doc_id", "n_words", "kept_sha256"), lost


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the kept words as text where words were removed, and the text unchanged elsewhere."""
    _, lost = removals(docs, window)
    lost = lost.select("doc_id", "kept_text").dropDuplicates(["doc_id"]).alias("lost")
    columns = [F.coalesce("lost.kept_text", "d.text").alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    return docs.alias("d").join(lost, F.col("d.doc_id") == F.col("lost.doc_id"), "left").select(*columns)


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    every, lost = removals(docs, window)
    lost = lost.select("doc_id", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("sha")).dropDuplicates(["doc_id"])
    return every.join(lost, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))
