"""Token ids in blocks coded with a static range asymmetric numeral system.

Format. ``frequencies`` is one table for all blocks: (token, freq) with frequencies that sum to 2**20. ``blocks`` has one row per
block: shard and block number, ids of the shard before it, the documents in it (doc_id and number of ids, ascending), number of ids, the payload, and the
places from which decoding may begin. A block codes whole consecutive documents. Id i belongs to lane i mod LANES; each lane
has a 64-bit state, and all lanes write their 32-bit words into one stream, step by step. Every ``CHECKPOINT`` steps the lane
states and the position in the stream are stored with a CRC-32 of the words and states up to the next checkpoint, so parts of a block decode
independently and damage is found where it is. Rows are parquet, so commits are atomic and a lost task is simply run again.

Blocks follow each other in ascending doc_id order: shards are ranges of doc_id, sorted inside.
Null texts count as empty (only the end id). Repeated doc_ids keep one entry each, in a stable place among each other only
if their ids are equal. An empty table gives no blocks.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark import TaskContext

from . import units as un
from . import words as wd
from .scratch import keep

SCALE = 20
LANES = 512
BLOCK_IDS = 1 << 18
CHECKPOINT = 128
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)

BLOCK_SCHEMA = ("shard int, block int, before long, n_ids long, doc_ids array<long>, doc_sizes array<int>, lanes int, words binary, "
                "marks array<struct<step:int,word:long,states:binary,crc:long>>")


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for every id that occurs."""
    total, room = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    exact = counts[used] / total * (room - len(used))
    freq = 1 + np.floor(exact).astype(np.int64)
    short = room - int(freq.sum())
    order = np.lexsort((used, np.floor(exact) - exact))  # largest remainder first, then id
    freq[order[:short]] += 1
    out = np.zeros(len(counts), np.int64)
    out[used] = freq
    return out


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE, lanes: int = LANES, checkpoint: int = CHECKPOINT):
        self.freq, self.scale, self.lanes, self.checkpoint = freq.astype(np.uint64), np.uint64(scale), lanes, checkpoint
        self.base = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - scale)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, list[dict]]:
        lanes, steps = self.lanes, -(-len(ids) // self.lanes)
        filler = int(np.argmax(self.freq))
        grid = np.append(ids, np.full(steps * lanes - len(ids), filler, ids.dtype)).reshape(steps, lanes)
        state = np.full(lanes, _LOW, np.uint64)
        out, marks = [], []
        for step in range(steps - 1, -1, -1):
            f, c = self.freq[grid[step]], self.base[grid[step]]
            full = state >= self.limit[grid[step]]
            out.append((state[full] & _MASK).astype(np.uint32))
            state[full] >>= _WORD
            quotient, rest = np.divmod(state, f)
            state = (quotient << self.scale) + rest + c
            if step % self.checkpoint == 0:
                marks.append((step, len(out), state.copy()))
        sizes = np.cumsum([0] + [len(x) for x in reversed(out)])
        stream = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
        marks = [(step, int(sizes[len(out) - n]), s) for step, n, s in reversed(marks)]
        ends = [m[1] for m in marks[1:]] + [len(stream)]
        return stream.astype("<u4").tobytes(), [
            {"step": step, "word": word, "states": s.astype("<u8").tobytes(), "crc": zlib.crc32(stream[word:end].tobytes(), zlib.crc32(s.tobytes()))}
            for (step, word, s), end in zip(marks, ends)]

    def decode_from(self, words: bytes, marks: list[dict], k: int, n_ids: int) -> np.ndarray:
        """The ids from checkpoint k up to the next one (or the end)."""
        lanes, mark = self.lanes, marks[k]
        stream = np.frombuffer(words, "<u4")
        end = marks[k + 1]["word"] if k + 1 < len(marks) else len(stream)
        part = stream[mark["word"]:end]
        if zlib.crc32(part.tobytes(), zlib.crc32(mark["states"])) != mark["crc"]:
            raise ValueError("damaged block: a checksum differs")
        steps = -(-n_ids // lanes)
        last = marks[k + 1]["step"] if k + 1 < len(marks) else steps
        state, at = np.frombuffer(mark["states"], "<u8").astype(np.uint64), 0
        out = np.empty((last - mark["step"], lanes), np.uint16)
        low_bits = np.uint64((1 << int(self.scale)) - 1)
        for row in range(len(out)):
            slot = state & low_bits
            symbol = self.slots[slot]
            out[row] = symbol
            state = self.freq[symbol] * (state >> self.scale) + slot - self.base[symbol]
            need = state < _LOW
            n = int(np.count_nonzero(need))
            if n:
                state[need] = (state[need] << _WORD) | part[at:at + n]
                at += n
        return out.reshape(-1)[:n_ids - mark["step"] * lanes]

    def decode(self, words: bytes, marks: list[dict], n_ids: int) -> np.ndarray:
        parts = [self.decode_from(words, marks, k, n_ids) for k in range(len(marks))]
        return np.concatenate(parts) if parts else np.empty(0, np.uint16)


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_ids, ids): ids of the whole text and the end id, two bytes each (little-endian)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ("words", path) not in un._LOADED:
            un._LOADED["words", path] = un.Remembered(un.WordEncoder(un.load(path)))
        known = un._LOADED["words", path]
        for batch in batches:
            for part in wd.slices(batch, size=2 * wd.SLICE_BYTES):
                cut = un.word_pieces(part.column("text"))
                ids, edges = np.empty(0, np.uint16), np.zeros(part.num_rows + 1, np.int64)
                if len(cut):
                    codes, names = cut.coded()
                    ids, edges = un.gather(*known.of(names.to_pylist()), codes, cut.docs)
                whole = np.insert(ids, edges[1:], end_id).astype("<u2")
                edges = edges + np.arange(part.num_rows + 1)
                blob = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((2 * edges).astype(np.int64)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(edges)), blob.cast(pa.binary())], ["doc_id", "n_ids", "ids"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_ids long, ids binary")


def _rows(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Two-byte numbers of a binary column and the edges of its rows."""
    blob = batch.column(column).cast(pa.large_binary())
    ends = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset:blob.offset + len(blob) + 1]
    body = blob.buffers()[2]
    return np.frombuffer(body, "<u2")[ends[0] // 2:ends[-1] // 2], (ends - ends[0]) // 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(_rows(batch, "ids")[0], minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["token", "n"])


def frequencies(ids: DataFrame) -> DataFrame:
    """(token, freq) over all documents; a vocabulary has at most 65,536 ids, and so has this table."""
    return ids.select("ids").mapInArrow(_counted, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _coder(freq) -> Coder:
    key = ("coder", freq.id)
    if key not in un._LOADED:
        un._LOADED[key] = Coder(freq.value)
    return un._LOADED[key]


class _Shared:
    """A frequency table of fixed size on its way to the tasks."""

    def __init__(self, spark, table: np.ndarray):
        self.sent = spark.sparkContext.broadcast(table)
        self.id = f"{spark.sparkContext.applicationId}-{self.sent._jbroadcast.id()}"

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self) -> np.ndarray:
        return self.sent.value


def _blocks(freq: _Shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, block, before = _coder(freq), TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        sizes: list[int] = []
        waiting: list[np.ndarray] = []
        n = 0

        def done() -> pa.RecordBatch:
            words, marks = coder.encode(np.concatenate(waiting))
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "before": before, "n_ids": n, "doc_ids": docs, "doc_sizes": sizes, "lanes": coder.lanes, "words": words, "marks": marks}], _ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, edges = _rows(batch, "ids")
            for d, a, b in zip(batch.column("doc_id").to_pylist(), edges.tolist(), edges[1:].tolist()):
                docs.append(d)
                sizes.append(b - a)
                waiting.append(ids[a:b])
                n += b - a
                if n >= BLOCK_IDS:
                    yield done()
                    docs, sizes, waiting, n, block, before = [], [], [], 0, block + 1, before + n
        if docs:
            yield done()

    return of


_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int32())), ("lanes", pa.int32()), ("words", pa.binary()),
    ("marks", pa.list_(pa.struct([("step", pa.int32()), ("word", pa.int64()), ("states", pa.binary()), ("crc", pa.int64())])))])


def _decoded(freq: _Shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["words"], row["marks"], row["n_ids"])
                edges = np.append(0, np.cumsum(row["doc_sizes"]))
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(edges.tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(crc), pa.int32()),
                     pa.array(row["before"] + edges[:-1], pa.int64()), pa.array(row["doc_sizes"], pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "inside", "n_tokens", "ids_crc32"])

    return of


def write(docs: DataFrame, path: str, end_id: int = 1, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode ``docs`` with the tokenizer at ``path`` and write both tables of the format: (frequencies, blocks)."""
    spark = docs.sparkSession
    ids = keep(tokenized(docs, path, end_id), "ids")
    counts = np.zeros(1 << 16, np.int64)
    for r in frequencies(ids).collect():  # one row per id of the vocabulary
        counts[r.token] = r.n
    freq = scaled(counts)
    used = np.flatnonzero(freq)
    table = keep(spark.createDataFrame([(int(t), int(freq[t])) for t in used], "token int, freq int").coalesce(1), "frequencies")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.select("doc_id", "ids").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    return table, keep(ordered.mapInArrow(_blocks(_Shared(spark, freq)), BLOCK_SCHEMA), "blocks")


def read(table: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written tables."""
    freq = np.zeros(1 << 16, np.int64)
    for r in table.collect():  # one row per id of the vocabulary
        freq[r.token] = r.freq
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    starts = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    found = blocks.mapInArrow(_decoded(_Shared(blocks.sparkSession, freq)), "doc_id long, shard int, inside long, n_tokens long, ids_crc32 long")
    return found.join(starts, "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
