"""Words of whole Arrow text columns, cut with numpy inside a task."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that end a word of the pattern [^\x20\x09-\x0D]+ .
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z became a-z).
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Text bytes that a task cuts at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i]+counts[i]-1, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    used = counts > 0
    first, size = starts[used].astype(np.int64), counts[used].astype(np.int64)
    heads = np.cumsum(size) - size
    out[heads] = first
    out[heads[1:]] -= first[:-1] + size[:-1] - 1
    return np.cumsum(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return body[ends[0]:ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in slices of about ``size`` bytes of text; no row is left out."""
    if not batch.num_rows:
        return
    lengths = np.diff(text_bytes(batch.column(column))[1])
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of several documents: ``body`` has them without what separates them."""

    body: np.ndarray  # uint8
    lengths: np.ndarray  # bytes of each word
    docs: np.ndarray  # index of the first word of each document, and the number of all words
    starts: np.ndarray  # place of each word in the bytes of the column

    def __len__(self) -> int:
        return len(self.lengths)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """Code of each word and the words by code."""
        ends = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.lengths, out=ends[1:])
        flat = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.body))])
        coded = flat.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.empty(0, np.uint64)
        codes, names = self.coded()
        of = xxhash.xxh3_64_intdigest
        return np.fromiter((of(w, seed) for w in names.to_pylist()), np.uint64, len(names))[codes]

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each begins."""
        out = np.full(int(self.lengths.sum()) + len(self), 0x20, np.uint8)
        begins = np.cumsum(self.lengths + 1) - (self.lengths + 1) if len(self) else np.empty(0, np.int64)
        out[np.arange(len(self.body)) + np.repeat(np.arange(len(self)), self.lengths)] = self.body
        return out.tobytes(), begins


def cut(texts: pa.Array, ends: np.ndarray = SPACES, lower: bool = False, parting: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words of each text; ``ends`` marks the bytes that are in no word.

    ``parting`` cuts words further, between a byte of its first table and one of its second.
    """
    body, offsets = text_bytes(texts)
    if lower:
        body = _LOWER[body]
    inside = ~ends[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(body) + 1, bool)
    before[0], before[1:] = False, inside
    if parting is not None and len(body):
        edge[1:-1] |= parting[0][body[:-1]] & parting[1][body[1:]]
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(body), bool)
    after[:-1], after[-1:] = inside[1:], False
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(body[inside], stops - starts, np.searchsorted(starts, offsets), starts)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
