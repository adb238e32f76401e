"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most two bits differ in at most one bit
of some segment. So each segment has a table from its values to fingerprints, every fingerprint enumerates the 33 values of the
Hamming ball of radius 1 around its own, fetches what the table holds for them, and the complete distance is verified.

Most values of a ball aren't in the table; they go in the first join, with the distinct values alone. A value that more than
``HOT`` fingerprints share is split by the other segment: its table is keyed by the value and every value within one bit of
the entry's other segment. A probe with the same value asks there for the ball of its other segment (the rest may differ in two
bits), a probe with one flipped bit for its other segment as it is (the rest may differ in one). That is complete as well, and an
entry holds at most 33 fingerprints, so no value, however many share it, makes pairs that grow with the square of its
fingerprints; one fingerprint has at most 2,080 others within two bits.

Exact copies share one fingerprint and take part once. Documents without words have fingerprint zero and are linked like
any other. Null text counts as empty; repeated doc_ids keep one row each, by their own texts; other columns are ignored. A row
without doc_id keeps its row and links others, but names a component only by their doc_ids (null, if there are none).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as wd
from .components import components
from .scratch import keep

SHINGLE = 3
SEED = 42
SEGMENTS = 2
RADIUS = 2
WIDTH = 64 // SEGMENTS
#: Fingerprints that share a segment value, from which its table is split by the other segment. Both ways are complete.
HOT = 64
#: Byte value to eight one-byte counters, lowest bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]
_FULL = 255  # additions a one-byte counter holds


def _shingle_hashes(words: wd.Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the number of them per document."""
    body, begins = words.joined()
    counts = words.counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = wd.ragged(words.docs[:-1], n)
    last = first + np.repeat(np.minimum(counts, size), n) - 1
    of = xxhash.xxh64_intdigest
    stops = begins[last] + words.lengths[last] if len(last) else last
    starts = begins[first] if len(first) else first
    return np.fromiter((of(body[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(first)), n


def fingerprints(texts: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    hashes, n = _shingle_hashes(wd.cut(texts, lower=True), size, seed)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    groups = -(-n[full] // _FULL)
    firsts = np.cumsum(n[full]) - n[full]
    heads = np.repeat(firsts, groups) + _FULL * wd.ragged(np.zeros(len(full), np.int64), groups)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.add.reduceat(_SPREAD[by_byte[:, k]], heads).view(np.uint8).reshape(-1, 8) for k in range(8)], axis=1)
    ones = np.add.reduceat(ones.astype(np.int64), np.cumsum(groups) - groups, axis=0)
    out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text")).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fp long")


def _segment(fp: Column, which: int) -> Column:
    """One segment's bits as a long; 0 is the lower one."""
    return F.shiftrightunsigned(fp, WIDTH * which).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _ball(value: Column) -> list[Column]:
    """A segment value and its changes of one bit."""
    return [value, *[value.bitwiseXOR(F.lit(1 << i)) for i in range(WIDTH)]]


def _both(fps: DataFrame, keys) -> DataFrame:
    """(segment, key, fp) with the keys of either segment."""
    rows = [F.struct(F.lit(s).alias("segment"), k.alias("key")) for s in range(SEGMENTS) for k in keys(_segment(F.col("fp"), s))]
    return fps.select("fp", F.explode(F.array(*rows)).alias("at")).select("at.segment", "at.key", "fp")


def _other(fp: str) -> Column:
    """The bits outside the row's ``segment``."""
    return F.when(F.col("segment") == 0, _segment(F.col(fp), 1)).otherwise(_segment(F.col(fp), 0))


def candidates(distinct_fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, that meet in the table of some segment; every pair within two bits is among them."""
    fps = distinct_fps.select("fp")
    entries = keep(_both(fps, lambda v: [v]), "segments")
    shared = entries.groupBy("segment", "key").agg(F.count("*").alias("held"))
    same = F.col("key") == F.when(F.col("segment") == 0, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1))
    # Spark sizes an exploded table by its input, 66 times too low: whatever meets one is merged, never broadcast.
    found = keep(_both(fps, _ball).join(shared.hint("merge"), ["segment", "key"]).where((F.col("held") > 1) | ~same)
                 .select("segment", "key", "fp", "held", same.alias("same")), "probes")
    few, many = F.col("held") <= hot, F.col("held") > hot
    table = entries.withColumnRenamed("fp", "other")
    cold = found.where(few).join(table.hint("merge"), ["segment", "key"]).where("fp < other").select("fp", "other")

    split = keep(shared.where(many).select("segment", "key"), "hot")
    listed = keep(table.join(split, ["segment", "key"], "left_semi")
                  .select("segment", "key", "other", F.explode(F.array(*_ball(_other("other")))).alias("beside")), "split")
    asked = found.where(many).select("segment", "key", "fp", F.explode(
        F.when(F.col("same"), F.array(*_ball(_other("fp")))).otherwise(F.array(_other("fp")))).alias("beside"))
    warm = asked.join(listed.hint("merge"), ["segment", "key", "beside"]).where("fp < other").select("fp", "other")
    return cold.union(warm).toDF("a", "b")


def links(distinct_fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Verified links (a, b) between all distinct fingerprints within ``radius`` bits; a link may come more than once."""
    if not 0 <= radius <= 2:
        raise ValueError("two segments with balls of one bit find all links up to two differing bits only")
    return candidates(distinct_fps, hot).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): hex fingerprint and the smallest doc_id reachable over links."""
    fps = keep(with_fingerprints(docs), "fingerprints")
    classes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "classes")
    roots = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = classes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = keep(rooted.join(heads, "root").select("fp", "component_id"), "components")
    return fps.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
