"""Token ids of text units (pieces of a text that a tokenizer encodes on their own), remembered per Python worker."""
from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from . import words as wd

#: Units a worker remembers before it starts anew.
REMEMBERED = 600_000
_LOADED: dict = {}


def load(path: str):
    """The tokenizer of a file without truncation and padding, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in two bytes; the vocabulary is larger")
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


#: Units of one text that is encoded for many of them together.
_TOGETHER = 400


def one_by_one(tokenizer, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number per unit) of units encoded on their own."""
    rows = [e.ids for e in tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.uint16, int(size.sum())), size


def _merged(units: list[bytes], easy: np.ndarray, together, apart) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the easy units by ``together`` and of the others by ``apart``, in order."""
    flat, size = [], np.empty(len(units), np.int64)
    start = np.empty(len(units), np.int64)
    used = 0
    for mask, encode in ((easy, together), (~easy, apart)):
        at = np.flatnonzero(mask)
        if len(at):
            ids, n = encode([units[i] for i in at.tolist()])
            start[at], size[at] = used + np.cumsum(n) - n, n
            flat.append(ids)
            used += len(ids)
    ids = np.concatenate(flat) if flat else np.empty(0, np.uint16)
    return ids[wd.ragged(start, size)], size


class WordEncoder:
    """Words for a vocabulary with word ends; letters with at most one closing sign go many to a text.

    Such a word has one piece, or two with the sign, never fewer; if a text has as many pieces as its words should have, each word
    has its own number of them. Otherwise its words are encoded on their own.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.ends = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(tokenizer.get_vocab_size())])

    def _pieces(self, word: bytes) -> int:
        text = word.decode()
        return 1 if text.isalpha() else 2 if text[-1] in ".,;:!?" and text[:-1].isalpha() else 0

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces = np.fromiter(map(self._pieces, units), np.int64, len(units))
        apart = lambda rest: one_by_one(self.tokenizer, rest)

        def together(easy: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            want = pieces[pieces > 0]
            cuts = range(0, len(easy), _TOGETHER)
            texts = [b" ".join(easy[i:i + _TOGETHER]).decode() for i in cuts]
            flat, size = [], []
            for i, e in zip(cuts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids, n = np.array(e.ids, np.uint16), want[i:i + _TOGETHER]
                last = np.flatnonzero(self.ends[ids]) + 1
                if len(last) == n.sum() and (last[-1:] == len(ids)).all():
                    stops = last[np.cumsum(n) - 1]
                    flat.append(ids)
                    size.append(np.diff(stops, prepend=0))
                else:
                    ids, n = apart(easy[i:i + _TOGETHER])
                    flat.append(ids)
                    size.append(n)
            return np.concatenate(flat), np.concatenate(size)

        return _merged(units, pieces > 0, together, apart)


class SpacedEncoder:
    """Units of white space and what follows, for a byte-level vocabulary; those whole in this sense go many to a text.

    Ids stand for bytes, so the bytes of each id tell which unit it is of.
    """

    def __init__(self, tokenizer, length: np.ndarray):
        self.tokenizer, self.length = tokenizer, length

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        easy = np.fromiter((wd.SPACES[u[0]] and not wd.SPACES[u[-1]] if u else False for u in units), bool, len(units))
        apart = lambda rest: one_by_one(self.tokenizer, rest)

        def together(whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            cuts = range(0, len(whole), _TOGETHER)
            texts = [b"".join(whole[i:i + _TOGETHER]).decode() for i in cuts]
            flat, size = [], []
            for i, e in zip(cuts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                part = whole[i:i + _TOGETHER]
                ids = np.array(e.ids, np.uint16)
                ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
                at = np.cumsum(self.length[ids])
                stops = np.searchsorted(at, ends) + 1
                if (at[stops - 1] != ends).any():  # an id over a border of units
                    ids, n = apart(part)
                else:
                    n = np.diff(stops, prepend=0)
                flat.append(ids)
                size.append(n)
            return np.concatenate(flat), np.concatenate(size)

        return _merged(units, easy, together, apart)


class Remembered:
    """Ids of units; unknown units are encoded together by ``encode`` (units to ids and their number per unit).

    When full, the half that was asked for most often stays.
    """

    def __init__(self, encode, most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint16), 0
        self.start, self.size, self.asked = (np.empty(0, np.int64) for _ in range(3))

    def _add(self, fresh: list[bytes]) -> None:
        ids, size = self.encode(fresh)
        need, n = self.used + len(ids), len(self.known)
        if need > len(self.flat):
            self.flat = np.append(self.flat[:self.used], np.empty(2 * need - self.used, np.uint16))
        if n + len(fresh) > len(self.start):
            grow = np.zeros(n + 2 * len(fresh), np.int64)
            self.start, self.size, self.asked = (np.append(x[:n], grow) for x in (self.start, self.size, self.asked))
        self.flat[self.used:need] = ids
        self.start[n:n + len(fresh)] = self.used + np.cumsum(size) - size
        self.size[n:n + len(fresh)] = size
        self.asked[n:n + len(fresh)] = 0
        self.used = need
        self.known.update(zip(fresh, range(n, n + len(fresh))))

    def _shrink(self) -> None:
        n = len(self.known)
        stay = np.zeros(n, bool)
        stay[np.argsort(self.asked[:n], kind="stable")[n - self.most // 2:]] = True
        names = [u for u, k in zip(self.known, stay.tolist()) if k]  # in order of their places
        start, size = self.start[:n][stay], self.size[:n][stay]
        self.flat = self.flat[wd.ragged(start, size)]
        self.used = len(self.flat)
        self.start, self.size, self.asked = np.cumsum(size) - size, size, self.asked[:n][stay] // 2
        self.known = dict(zip(names, range(len(names))))

    def of(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all remembered ids, start, number) of distinct units."""
        if len(self.known) > self.most:
            self._shrink()
        known = self.known
        fresh = [u for u in units if u not in known]
        if fresh:
            self._add(fresh)
        at = np.fromiter((known[u] for u in units), np.int64, len(units))
        self.asked[at] += 1
        return self.flat, self.start[at], self.size[at]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units in order, and where each document's ids begin (and the end)."""
    n = size[codes]
    edges = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(n, out=edges[1:])
    return flat[wd.ragged(start[codes], n)], edges[docs]


_LETTERS, _SIGNS = np.zeros(256, bool), np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_SIGNS[list(b".,;:!?")] = True


def word_pieces(texts: pa.Array) -> wd.Words:
    """Pieces that a lower-casing vocabulary with word ends encodes on their own.

    It drops white space, and splits between a letter and a sign; A-Z are lower-cased here so that fewer pieces differ,
    unless the texts have what might be a special token, which is told by its case.
    """
    body, _ = wd.text_bytes(texts)
    special = bool(((body[:-1] == 0x3C) & (body[1:] == 0x7C)).any())
    return wd.cut(texts, lower=not special, parting=(_LETTERS, _SIGNS))


def spaced_units(texts: pa.Array) -> wd.Words:
    """A text as units of an ASCII white space run and what follows up to the next one; nothing is left out."""
    body, offsets = wd.text_bytes(texts)
    space = wd.SPACES[body]
    head = np.zeros(len(body) + 1, bool)
    head[1:-1] = space[1:] & ~space[:-1]
    head[offsets] = True
    starts = np.flatnonzero(head[:-1])
    return wd.Words(body, np.diff(np.append(starts, len(body))), np.searchsorted(starts, offsets), starts)
