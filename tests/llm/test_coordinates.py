import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from innings_engine.llm import coordinates as co


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows, from all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    head = [*range(len(rows))]

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, s in enumerate(sets):
        for b in {b for x in s for b in by[x] if b > a}:
            both = len(s & sets[b])
            if 100 * both >= 80 * (len(s) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i))
        out.append((d, len(sets[i]), c, c is None or d == c))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(rng, words, n):
    words = [*words]
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def texts(rng):
    base = [f"b{i}" for i in range(120)]
    near = [edited(rng, base, rng.randrange(0, 12)) for _ in range(90)]
    short = ["a b c d e", "a b c d e f", "a b c d", "A b C d e", "a b", "b a", "one", "ONE", "one one", "", None, " \t\n", "x " * 50, "x " * 51]
    common = [" ".join([*["the", "very", "common"] * 3, *[f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9))]]) for _ in range(60)]
    other = [" ".join(f"o{rng.randrange(400)}" for _ in range(rng.randrange(2, 60))) for _ in range(60)]
    return [*near, *short, *common, *other, *near[:5], near[0] + " tail of it"]


@pytest.mark.parametrize("blocks", [(256, 2_000_000), (7, 2_000_000), (256, 900)])
def test_equals_brute_force(spark, make_docs, blocks):
    rng = random.Random(4)
    all_texts = texts(rng)
    ids = rng.sample(range(1000), len(all_texts))
    ids[3], ids[5], ids[100] = None, ids[4], None
    docs = make_docs(all_texts, ids=ids)
    assert got(co.near_duplicates(docs, block_classes=blocks[0], block_shingles=blocks[1])) == brute([*zip(ids, all_texts)])


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(co.near_duplicates(table)) == brute([(r.doc_id, r.text) for r in table.collect()])


def test_extra_columns_and_empty_table(spark, make_docs):
    docs = make_docs(["a b c d e f", "a b c d e f g"])
    for c in ("cls", "h1", "sig", "kept", "root", "leader", "key", "n_shingles"):
        docs = docs.withColumn(c, F.lit("x"))
    assert got(co.near_duplicates(docs)) == [(0, 5, 0, True), (1, 6, 0, False)]
    assert co.near_duplicates(docs.limit(0)).count() == 0


def test_a_text_over_one_slice(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(700_000))
    assert got(co.near_duplicates(make_docs([long, long + " more", "w1 w2", long[:4_000_000]]))) == [
        (0, 699_999, 0, True), (1, 700_000, 0, False), (2, 1, 2, True), (3, len(shingles(long[:4_000_000])), 3 if len(shingles(long[:4_000_000])) < 559_999 else 0, len(shingles(long[:4_000_000])) < 559_999)]


def test_shingle_sets_and_signatures():
    rng = random.Random(9)
    some = texts(rng)
    h, begins = co.shingle_sets(pa.array(some))
    assert np.diff(begins).tolist() == [len(shingles(t)) for t in some]
    pairs = []
    for k in range(150):
        base = [f"p{k}_{i}" for i in range(60)]
        pairs += [" ".join(base), edited(rng, base, 3)]
    h, begins = co.shingle_sets(pa.array(pairs))
    sig = co.signatures(h, begins)
    real = np.mean([(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))) ** 2 for a, b in zip(pairs[::2], pairs[1::2])])
    assert abs((sig[::2] == sig[1::2]).mean() - real) < 0.015


def test_a_forest_keeps_what_is_connected():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 40, 200), rng.integers(0, 40, 200)
    kept = co._forest(a, b, np.arange(40))
    assert len(kept) < 40
    full, some = ({frozenset(g) for g in groups(zip(a[i].tolist(), b[i].tolist()))} for i in (np.arange(200), kept))
    assert full == some


def groups(edges):
    out = []
    for x, y in edges:
        met = [g for g in out if x in g or y in g]
        out = [g for g in out if g not in met] + [set().union({x, y}, *met)]
    return out
