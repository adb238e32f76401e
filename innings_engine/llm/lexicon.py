"""Byte-level BPE by a minimal acyclic transducer of frequent words.

Texts are cut into *units*: a run of ASCII white space and what follows it. The tokenizer's own splitting never joins
two units, so a unit always has the same ids. All units of the corpus are counted; the most frequent become a minimal
acyclic automaton (equal suffixes share states) whose edges carry integer outputs. Their sum along a word is the word's
number, which finds its ids. The automaton is one flat file of fixed size that each worker maps into memory; a batch of
distinct units walks it together, one byte a step. Units it doesn't hold are merged exactly, once per worker while they are
remembered. Whole texts with white space beyond ASCII (which reaches across units) or a special token are encoded whole.

The lexicon only decides how ids are found, never which: its size is bounded in units (``LEXICON_WORDS``) and in bytes
(``LEXICON_BYTES`` of units of at most ``UNIT_BYTES``) at any size of the corpus. Longer units, such as whole lines of a script without
spaces, are merged exactly in each slice that has them and not remembered. Null texts count as empty (no ids). Rows that repeat give repeated rows. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import units as un
from . import words as wd
from .scratch import keep

LEXICON_WORDS = 65_536
#: Longest unit that is counted, held in the lexicon or remembered, and bytes of all units of the lexicon together.
UNIT_BYTES, LEXICON_BYTES = 64, 1 << 20
#: States whose number and an edge's byte fit the 32-bit key.
MOST_STATES = 1 << 24
#: Units a worker counts or remembers at a time, beside what earlier stages left in its memory.
HELD_UNITS = 200_000
#: White space of Unicode that is not ASCII.
_WIDE = "\u0085   -     　"


class Lexicon:
    """Minimal acyclic transducer over byte strings; ``outputs`` has a list of ids per string."""

    _PARTS = (("key", "<u4"), ("target", "<u4"), ("weight", "<u4"), ("final", "u1"), ("start", "<u4"), ("size", "<u4"), ("ids", "<u2"))

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def compile(cls, words: list[bytes], outputs: list[list[int]]) -> Lexicon:
        """Incremental construction from sorted words: the tail of the last word is frozen when the next one leaves it."""
        order = sorted(range(len(words)), key=words.__getitem__)
        frozen: dict[tuple, int] = {}
        edges: list[tuple] = []  # state -> ((byte, target), ...)
        accepts: list[bool] = []
        open_: list[list] = [[False, []]]  # path of the last word: [final, [(byte, target)]]

        def freeze(down_to: int) -> None:
            while len(open_) > down_to:
                final, out = open_.pop()
                mark = (final, tuple(out))
                state = frozen.get(mark)
                if state is None:
                    if len(edges) >= MOST_STATES:
                        raise ValueError(f"the lexicon has more than {MOST_STATES} states; its edge keys hold no more")
                    state = frozen[mark] = len(edges)
                    edges.append(mark[1])
                    accepts.append(final)
                if open_:
                    parent = open_[-1][1]
                    parent[-1] = (parent[-1][0], state)
                else:
                    self_root.append(state)

        self_root: list[int] = []
        last = b""
        for k in order:
            word = words[k]
            same = len(os.path.commonprefix([last, word]))
            freeze(same + 1)
            for byte in word[same:]:
                open_[-1][1].append((byte, -1))
                open_.append([False, []])
            open_[-1][0] = True
            last = word
        freeze(0)
        below = [0] * len(edges)  # words accepted from a state on; targets are frozen before their sources
        keys, targets, weights = [], [], []
        root = self_root[0]
        rename = lambda s: 0 if s == root else s + 1 if s < root else s  # noqa: E731  the root is state 0
        for state, out in enumerate(edges):
            count = int(accepts[state])
            for byte, target in out:
                keys.append(rename(state) << 8 | byte)
                targets.append(rename(target))
                weights.append(count)
                count += below[target]
            below[state] = count
        order_e = np.argsort(np.array(keys, np.int64), kind="stable")
        final = np.zeros(len(edges), np.uint8)
        final[[rename(s) for s in range(len(edges))]] = accepts
        rows = [outputs[k] for k in order]
        size = np.array([len(r) for r in rows], np.int64)
        pick = lambda x: np.array(x, np.int64)[order_e].astype(np.uint32)
        return cls(key=pick(keys), target=pick(targets), weight=pick(weights), final=final, start=(np.cumsum(size) - size).astype(np.uint32), size=size.astype(np.uint32),
                   ids=np.array([i for r in rows for i in r], np.uint16))

    def to_bytes(self) -> bytes:
        arrays = [np.asarray(getattr(self, n), kind) for n, kind in self._PARTS]
        head = np.array([len(a) for a in arrays], "<u8").tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Over a read-only memory map that workers of one machine share; the file is a cache named by its content."""
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}")
        if not os.path.exists(path):
            with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as f:
                f.write(data)
            os.replace(f.name, path)
        flat = np.memmap(path, np.uint8, "r")
        lengths, at, parts = flat[:8 * len(cls._PARTS)].view("<u8").tolist(), 8 * len(cls._PARTS), {}
        for (name, kind), n in zip(cls._PARTS, lengths):
            nbytes = n * np.dtype(kind).itemsize
            parts[name] = flat[at:at + nbytes].view(kind)
            at += nbytes + -nbytes % 8
        return cls(**parts)

    def numbers(self, body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each byte string, -1 where the automaton doesn't accept it."""
        out = np.full(len(starts), -1, np.int64)
        live, state, total = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        step = 0
        while len(live):
            ended = lengths[live] == step
            accepted = ended & (self.final[state] == 1)
            out[live[accepted]] = total[accepted]
            live, state, total = live[~ended], state[~ended], total[~ended]
            if not len(self.key) or not len(live):
                break
            want = (state << 8) | body[starts[live] + step]
            at = np.minimum(np.searchsorted(self.key, want.astype(np.uint32)), len(self.key) - 1)
            found = self.key[at] == want
            live, at = live[found], at[found]
            state, total = self.target[at].astype(np.int64), total[found] + self.weight[at]
            step += 1
        return out


def _odd(tokenizer) -> re.Pattern:
    special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join([f"[{_WIDE}]", *special]))


def _units_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["unit", "n"])

    for batch in batches:
        for part in wd.slices(batch):
            cut = un.spaced_units(part.column("text"))
            if not len(cut):
                continue
            codes, names = cut.coded()
            for u, n in zip(names.to_pylist(), np.bincount(codes, minlength=len(names)).tolist()):
                if len(u) > UNIT_BYTES:
                    continue
                total[u] = total.get(u, 0) + n
            if len(total) > HELD_UNITS:
                yield out()
                total = {}
    if total:
        yield out()


def frequent_units(docs: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """At most ``most`` of the most frequent short units of all texts, with ``LEXICON_BYTES`` together: those above a count that so many reach."""
    counted = docs.select("text").mapInArrow(_units_counted, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")
    counted = keep(counted.withColumn("step", F.floor(16 * F.log2("n")).cast("int")), "units")
    room, space, least = most, LEXICON_BYTES, 1 << 30
    steps = counted.groupBy("step").agg(F.count("*").alias("units"), F.sum(F.octet_length("unit")).alias("size"))
    for r in steps.orderBy(F.desc("step")).collect():  # 16 rows per doubling of the count
        room, space = room - r.units, space - r.size
        if room < 0 or space < 0:
            break
        least = r.step
    return [bytes(r.unit) for r in counted.where(F.col("step") >= least).select("unit").collect()]


def build(units: list[bytes], path: str) -> Lexicon:
    tokenizer = un.load(path)
    odd = _odd(tokenizer)
    units = [u for u in units if u and not odd.search(u.decode("utf-8", "replace"))]
    return Lexicon.compile(units, [e.ids for e in tokenizer.encode_batch([u.decode() for u in units], add_special_tokens=False)]) if units else Lexicon.compile([b" "], [[220]])


def _byte_of() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of whole Arrow columns in a worker."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.tokenizer, self.lexicon = un.load(path), lexicon
        self.encode_all = lambda texts: [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        self.odd = _odd(self.tokenizer)
        table = _byte_of()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        pieces = [bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t in tokens]
        self.piece = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.rest = un.Remembered(un.SpacedEncoder(self.tokenizer, self.length), HELD_UNITS)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = un.spaced_units(texts)
        if not len(cut):
            return np.empty(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        codes, names = cut.coded()
        ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1]
        number = self.lexicon.numbers(np.frombuffer(names.buffers()[2], np.uint8), ends[:-1], np.diff(ends))
        held = number >= 0
        long = ~held & (np.diff(ends) > UNIT_BYTES)
        rest = ~held & ~long
        start, size = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        start[held], size[held] = self.lexicon.start[number[held]], self.lexicon.size[number[held]]
        flat, start_rest, size_rest = self.rest.of(names.filter(pa.array(rest)).to_pylist())
        start[rest], size[rest] = start_rest + len(self.lexicon.ids), size_rest
        own = np.empty(0, np.uint16)
        if long.any():
            own, size[long] = self.rest.encode(names.filter(pa.array(long)).to_pylist())
            start[long] = len(self.lexicon.ids) + self.rest.used + np.cumsum(size[long]) - size[long]
        return un.gather(np.concatenate([self.lexicon.ids, flat[:self.rest.used], own]), start, size, codes, cut.docs)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin."""
        whole = [(i, t) for i, t in enumerate(texts.to_pylist()) if t and self.odd.search(t)]
        if not whole:
            return self._plain(texts)
        mask = np.ones(len(texts), bool)
        mask[[i for i, _ in whole]] = False
        ids, edges = self._plain(pa.array([t if m else "" for t, m in zip(texts.to_pylist(), mask.tolist())], pa.string()))
        own = {i: np.array(x, np.uint16) for (i, _), x in zip(whole, self.encode_all([t for _, t in whole]))}
        parts = [own.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist()))]
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts and where each text's begin."""
        n = self.length[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        return self.piece[wd.ragged(self.begin[ids], n)].tobytes(), ends[edges]


def _codec(path: str, sent) -> Codec:
    data = sent.value
    key = ("codec", path, hash(data))
    if key not in un._LOADED:
        un._LOADED[key] = Codec(path, Lexicon.mapped(data))
    return un._LOADED[key]


def _round_trip(path: str, sent, with_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, sent)
        for batch in batches:
            for part in wd.slices(batch, size=wd.SLICE_BYTES // 2):
                ids, edges = codec.encode(part.column("text"))
                body, marks = codec.decode(ids, edges)
                wide = memoryview(ids.astype("<u4")).cast("B")
                e, m = edges.tolist(), marks.tolist()
                texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(m, m[1:])]
                arrays = [part.column("doc_id"), pa.array(np.diff(edges)), pa.array([hashlib.sha256(wide[4 * a:4 * b]).hexdigest() for a, b in zip(e, e[1:])], pa.string()),
                          pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_text:
                    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    arrays, names = [*arrays, lists, pa.array(texts, pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return of


def encoded(docs: DataFrame, path: str, most: int = LEXICON_WORDS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text; ``with_text`` adds ids and the decoded text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(build(frequent_units(docs, most), path).to_bytes())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_text else "")
    return docs.select("doc_id", "text").mapInArrow(_round_trip(path, sent, with_text), schema)
