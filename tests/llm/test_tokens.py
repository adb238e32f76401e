import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from innings_engine.llm import lexicon, rans, units

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "  a  b ", "It's we'll DON'T", "é È naïve ß", "a b   c \t d", "x 　 y", "1234 5,678.90 !!", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>c", "tab\tnew\n line\r\n", "\x1c\x1d a",
       "end  ", "́ combining á ́", "ΣΑΣ ΣΑΣ.", "日本語 テキスト 🙂🙂 ‍", "q" * 3000, "the cat " * 900]


def texts():
    rng = random.Random(3)
    bits = [w for t in ODD if t for w in t.split(" ")] + ["the", "of", "and", "\n", "\t", " ", "The,", "ing."]
    return ODD + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["same text"] * 3


def test_lexicon_ids_and_round_trip(spark, make_docs):
    own = texts()
    t = units.load(BYTES)
    for most in (5, 10_000):
        got = {r.doc_id: r for r in lexicon.encoded(make_docs(own), BYTES, most, with_text=True).collect()}
        for i, text in enumerate(own):
            ids = t.encode(text or "", add_special_tokens=False).ids
            decoded = t.decode(ids, skip_special_tokens=False)
            assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == decoded == (text or "")
            assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_automaton_is_minimal_and_finds_all():
    rng = random.Random(4)
    words = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(900)})
    made = lexicon.Lexicon.mapped(lexicon.Lexicon.compile(words, [[k % 50000, k % 7] for k in range(len(words))]).to_bytes())
    probes = words + [b"", b"abcabcabc", b"zz"] + [w + b"a" for w in words]
    body = np.frombuffer(b"".join(probes), np.uint8)
    size = np.array([len(p) for p in probes])
    numbers = made.numbers(body, np.cumsum(size) - size, size)
    place = {w: k for k, w in enumerate(words)}
    order = sorted(words)
    for p, n in zip(probes, numbers.tolist()):
        assert (n >= 0) == (p in place) and (n < 0 or order[n] == p)
        if n >= 0:
            assert made.ids[made.start[n]:][:made.size[n]].tolist() == [place[p] % 50000, place[p] % 7]
    suffixes = {}  # states of the minimal automaton: distinct sets of continuations
    for p in {w[:i] for w in words for i in range(len(w) + 1)}:
        suffixes[p] = frozenset(w[len(p):] for w in words if w.startswith(p))
    assert len(made.final) == len(set(suffixes.values()))


def test_lexicon_is_bounded_in_bytes(spark, make_docs, monkeypatch):
    line = "".join(chr(0x4E00 + i) for i in range(400))
    texts = [line, line + " a b", "a b " + line, "x" * 5000, "x" * 5000, "\n" + line + "\n" + line, "a b a b", *[" ".join(f"w{i}" for i in range(60))] * 2]
    docs = make_docs(texts)
    assert sorted(map(len, lexicon.frequent_units(docs)))[-1] < 64
    tokenizer = units.load(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.ids, r.decoded) for r in lexicon.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), with_text=True).collect()}
    assert got == {d: (tokenizer.encode(t, add_special_tokens=False).ids, t) for d, t in enumerate(texts)}
    monkeypatch.setattr(lexicon, "LEXICON_BYTES", 20)
    assert 0 < sum(map(len, lexicon.frequent_units(docs))) <= 20
    monkeypatch.setattr(lexicon, "MOST_STATES", 10)
    with pytest.raises(ValueError, match="states"):
        lexicon.Lexicon.compile([b"abcdefghijkl"], [[1]])


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for counts, n in ((np.array([5]), 1), (np.array([1, 0, 10**9, 3]), 7000), (rng.integers(0, 50, 49408), 200_001)):
        freq = rans.scaled(counts)
        assert freq.sum() == 1 << rans.SCALE and ((freq > 0) == (counts > 0)).all()
        used = np.flatnonzero(counts)
        ids = rng.choice(used, n).astype(np.uint16)
        coder = rans.Coder(freq, lanes=64, checkpoint=20)
        words, marks = coder.encode(ids)
        assert (coder.decode(words, marks, n) == ids).all()
        for k in range(len(marks)):
            a = marks[k]["step"] * 64
            assert (coder.decode_from(words, marks, k, n) == ids[a:a + (20 * 64)]).all()
        if len(words) > 8:
            with pytest.raises(ValueError):
                coder.decode(words[:4] + bytes([words[4] ^ 1]) + words[5:], marks, n)
    ids = np.repeat(np.arange(4, dtype=np.uint16), [9000, 500, 400, 100])
    words, _ = rans.Coder(rans.scaled(np.bincount(ids))).encode(rng.permutation(ids))
    assert 8 * len(words) < 1.05 * 10000 * 0.64 + 64 * 512


def test_files_hold_all_documents_in_order(spark, make_docs, monkeypatch):
    own = texts()
    ids = random.Random(5).sample(range(-50, 4000), len(own))
    t = units.load(WORDS)
    monkeypatch.setattr(rans, "BLOCK_IDS", 900)
    table, blocks = rans.write(make_docs(own, ids), WORDS, shards=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.read(table, blocks).collect()}
    start, want = 0, {}
    for i, text in sorted(zip(ids, own)):
        own_ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(own_ids), zlib.crc32(np.array(own_ids, "<u4").tobytes()))
        start += len(own_ids)
    assert got == want
    rows = blocks.orderBy("shard", "block").collect()
    assert len(rows) > 3 and [d for r in rows for d in r.doc_ids] == sorted(ids)


def test_empty_tables(spark, make_docs):
    none = make_docs(["a"]).where("false")
    assert rans.read(*rans.write(none, WORDS)).collect() == []
    assert lexicon.encoded(none, BYTES).collect() == []


def test_units_cover_the_text():
    own = pa.array(texts())
    cut = units.spaced_units(own)
    assert cut.lengths.sum() == sum(len((t or "").encode()) for t in texts())


def test_encoders_and_memory():
    rng = random.Random(6)
    pool = [w for t in texts() if t for w in t.split()] + ["İstanbul", "DŽ", "ﬁn.", "don't", "a1b2", "e\u0301t\u0301e", "naïve,", "..", "x!?", "日本", "ß", "'s", "ABC", "ŉa"]
    words = sorted({w.encode() for w in pool if "\u3000" not in w} | {("".join(rng.choice("abcdeé") for _ in range(5)) + rng.choice(["", ".", ","])).encode() for _ in range(2000)})
    spaced = sorted({rng.choice([b" ", b"", b"\n\n ", b"  "]) + w + rng.choice([b"", b"", b" "]) for w in words})
    for path, units_, make in ((WORDS, words, units.WordEncoder), (BYTES, spaced, None)):
        t = units.load(path)
        encode = make(t) if make else lexicon.Codec(path, lexicon.build([], path)).rest.encode
        rng.shuffle(units_)
        want = {u: t.encode(u.decode(), add_special_tokens=False).ids for u in units_}
        memory = units.Remembered(encode, most=700)
        for _ in range(12):
            ask = list(dict.fromkeys(rng.choices(units_, k=400)))
            flat, start, size = memory.of(ask)
            assert [flat[a:a + n].tolist() for a, n in zip(start, size)] == [want[u] for u in ask]
        assert len(memory.known) < 1500
