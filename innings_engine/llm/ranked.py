"""Ranked lexical search that scores documents with equal bags once.

One pass over the texts keeps of each document its length and its *bag*: the terms of the items' vocabulary with their
numbers of occurrences. Nothing else of a document has a say in its scores but the length factor m, so documents with the same
bag and the same m are one class: rows are brought together by a hash of both and told apart by the whole bag, and of a class only the
``k`` smallest doc_ids are kept, as no other can be among the best. Each class is scored once against all items, as a product of
its term weights with the items' incidence matrix; every task hands over its ``k`` best classes of an item, and the best of those are
expanded into their documents by ascending doc_id.

All items are scored against all rows, in groups of at most ``GROUP_ITEMS`` items and ``GROUP_BYTES`` of their terms (a longer item is a group of its
own): a group is what the driver holds and broadcasts, whatever the benchmark's size. Scores are whole numbers; products stay exact in
float64 below 2**53 and are taken in int64 beyond.

Terms are the matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased. Null or empty texts have none: such a document is never found, such an item
finds nothing. Rows that repeat an item_id are one item with the terms of all; a null item_id is an item too. Rows that repeat a doc_id are documents of their own, with
equal scores in any order; a null doc_id comes last among equal scores. Fewer than ``k`` documents with a score above 0 give fewer rows. Other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import words as wd
from .scratch import keep

BEST = 50
GROUP_ITEMS = 4096
GROUP_BYTES = 16 << 20
#: Items scored at a time, and classes.
_ITEMS, _CLASSES = 256, 2048
#: Parts of an item's best classes that are compared on their own first.
_PARTS = 64
_FOUND = "item int, score long, cls long, first struct<none:boolean,doc_id:long>"
_PAIR = np.dtype([("term", "<u4"), ("tf", "<u4")])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                cut = wd.cut(part.column("text"), wd.SYMBOLS, lower=True)
                codes, names = cut.coded()
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(np.repeat(np.arange(part.num_rows), cut.counts))), names.take(pa.array(codes)).cast(pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(of, "item_id long, term binary").distinct()


@dataclass
class ItemGroup:
    """Items as numbers of terms; ``weights`` are filled in when the documents are counted."""

    items: list[int | None]
    firsts: np.ndarray  # where each item's terms begin in ``terms``
    terms: np.ndarray
    vocabulary: pa.Array
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first item, term numbers used, incidence of those terms and the block's items) in blocks of items."""
        for at in range(0, len(self.items), _ITEMS):
            bounds = self.firsts[at:at + _ITEMS + 1]
            used, rows = np.unique(self.terms[bounds[0]:bounds[-1]], return_inverse=True)
            incidence = np.zeros((len(used), len(bounds) - 1))
            incidence[rows, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = 1
            yield at, used, incidence


def groups_of(terms: DataFrame, most_items: int = GROUP_ITEMS, most_bytes: int = GROUP_BYTES) -> Iterator[ItemGroup]:
    """Items in groups within both bounds, one at a time on the driver; sizes are added up in Spark first."""
    sizes = terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 16).alias("bytes")).withColumn("h", F.xxhash64("item_id"))
    total = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if not total.n:
        return
    groups = max(1, -(-total.n // most_items), -(-total.bytes // most_bytes))
    for _ in range(64):
        full = sizes.groupBy(F.pmod("h", F.lit(groups))).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        if groups == 1 or not full.where((F.col("n") > 1) & ((F.col("n") > most_items) | (F.col("bytes") > most_bytes))).limit(1).count():
            break
        groups *= 2
    for group in range(groups):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).toArrow()
        if rows.num_rows:
            yield _numbered(rows)


def _numbered(rows: pa.Table) -> ItemGroup:
    items = rows.column("item_id").combine_chunks().dictionary_encode("encode")
    terms = rows.column("term").combine_chunks().dictionary_encode()
    owner, term = items.indices.to_numpy(), terms.indices.to_numpy()
    order = np.lexsort((term, owner))
    firsts = np.searchsorted(owner[order], np.arange(len(items.dictionary) + 1))
    return ItemGroup(items.dictionary.to_pylist(), firsts, term[order].astype(np.uint32), terms.dictionary)


def _bags(sent):
    """Task: number of terms of each document with any, and its bag."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value.vocabulary.cast(pa.large_binary())
        for batch in batches:
            for part in wd.slices(batch):
                cut = wd.cut(part.column("text"), wd.SYMBOLS, lower=True)
                codes, names = cut.coded()
                number = pc.index_in(names, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                number = number[codes] if len(codes) else np.empty(0, np.int64)
                doc = np.repeat(np.arange(part.num_rows), cut.counts)[number >= 0]
                keys, counts = np.unique(doc * len(vocabulary) + number[number >= 0], return_counts=True)
                pairs = np.empty(len(keys), _PAIR)
                pairs["term"], pairs["tf"] = keys % len(vocabulary), counts
                ends = np.searchsorted(keys // len(vocabulary), np.arange(part.num_rows + 1)) * _PAIR.itemsize
                bags = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(pairs.tobytes())])
                some = pa.array(cut.counts > 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cut.counts), bags], ["doc_id", "n", "bag"]).filter(some)

    return of


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and (term, tf) of everything in a column of bags."""
    ends = np.frombuffer(bags.buffers()[1], np.int32)[bags.offset:bags.offset + len(bags) + 1] if len(bags) else np.zeros(1, np.int32)
    body = np.frombuffer(bags.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return np.repeat(np.arange(len(bags)), np.diff(ends) // _PAIR.itemsize), body.view(_PAIR)


def document_counts(bags: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each term of the vocabulary."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(_pairs(batch.column("bag"))[1]["term"], minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in bags.select("bag").mapInArrow(of, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def classes_of(bags: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(cls, bag, m, docs): one row per bag and m, with its ``k`` smallest doc_ids, none last."""
    m = 50 + F.expr(f"(50L * n * {n_docs}L) div {max(n_terms, 1)}L")
    docs = bags.where(F.octet_length("bag") > 0).select("bag", m.alias("m"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("doc"))
    same = ["h", "bag", "m"]
    docs = docs.withColumn("h", F.xxhash64("bag", "m"))
    first = docs.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy("doc"))).where(F.col("place") <= k)
    return first.groupBy(*same).agg(F.array_sort(F.collect_list("doc")).alias("docs")).select(F.monotonically_increasing_id().alias("cls"), "bag", "m", "docs")


def _best(sent, k: int):
    """Task: the k best of its classes for each item, by score and smallest document."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: ItemGroup = sent.value
        heavy = float(group.weights.max(initial=0)) * 1e6 * max(np.diff(group.firsts).max(initial=0), 1) >= 2.0 ** 53
        kept = [(np.empty(0, np.int64),) * 4 for _ in group.items]  # score, cls, none, doc_id
        for batch in batches:
            for at in range(0, batch.num_rows, _CLASSES):
                part = batch.slice(at, _CLASSES)
                row, pair = _pairs(part.column("bag"))
                m = part.column("m").to_numpy()[row]
                tf = pair["tf"].astype(np.int64)
                weight = group.weights[pair["term"]] * (1000000000 * tf // (1000 * tf + 20 * m))
                cls = part.column("cls").to_numpy()
                none = part.column("first").field("none").to_numpy(zero_copy_only=False).astype(np.int64)
                doc = part.column("first").field("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                place = np.full(len(group.vocabulary), -1)
                for first, used, incidence in group.blocks():
                    place[used] = np.arange(len(used))
                    spot = place[pair["term"]]
                    inside = spot >= 0
                    dense = np.zeros((part.num_rows, len(used)), np.int64 if heavy else np.float64)
                    dense[row[inside], spot[inside]] = weight[inside]
                    scores = (dense @ (incidence.astype(np.int64) if heavy else incidence)).astype(np.int64)
                    place[used] = -1
                    for i in range(scores.shape[1]):
                        old = kept[first + i]
                        least = max(1, int(old[0][-1])) if len(old[0]) == k else 1
                        new = np.flatnonzero(scores[:, i] >= least)
                        if len(new):
                            both = [np.concatenate(x) for x in zip(old, (scores[new, i], cls[new], none[new], doc[new]))]
                            order = np.lexsort((both[3], both[2], -both[0]))[:k]
                            kept[first + i] = tuple(x[order] for x in both)
        item = np.repeat(np.arange(len(kept), dtype=np.int32), [len(x[0]) for x in kept])
        score, cls, none, doc = (np.concatenate([x[c] for x in kept]) if kept else np.empty(0, np.int64) for c in range(4))
        doc = pa.array(doc, mask=none.astype(bool))
        first = pa.StructArray.from_arrays([pa.array(none.astype(bool)), doc], ["none", "doc_id"])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(cls), first], ["item", "score", "cls", "first"])

    return of


def _top(found: DataFrame, by: list[str], then: str, k: int, name: str = "rank") -> DataFrame:
    return found.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), then))).where(F.col(name) <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, most_items: int = GROUP_ITEMS, most_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in groups_of(keep(item_terms(items), "terms"), most_items, most_bytes):
        bags = keep(texts.mapInArrow(_bags(spark.sparkContext.broadcast(group)), "doc_id long, n long, bag binary"), "bags")
        whole = bags.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = document_counts(bags, len(group.vocabulary))
        group.weights = np.array([math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        classes = keep(classes_of(bags, whole.docs, whole.terms, k), "classes")
        found = classes.select("cls", "bag", "m", F.col("docs")[0].alias("first")).mapInArrow(_best(spark.sparkContext.broadcast(group), k), _FOUND)
        found = _top(found.withColumn("part", F.pmod("cls", F.lit(_PARTS))), ["item", "part"], "first", k).drop("rank", "part")
        best = keep(_top(found, ["item"], "first", k).select("item", "score", "cls"), "best")
        members = best.join(classes.select("cls", F.explode("docs").alias("doc")), "cls")
        ids = spark.createDataFrame(list(enumerate(group.items)), "item int, item_id long")
        out = out.union(_top(members, ["item"], "doc", k).join(ids, "item").select("item_id", "rank", "doc.doc_id", "score"))
    return out


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""
WITH word AS (SELECT doc_id, {_TERMS} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
doc AS (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM doc),
item AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
factor AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM doc, whole),
score AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN factor USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 50
"""
