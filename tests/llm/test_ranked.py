import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from innings_engine.llm import ranked as rk

PATTERN = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    return re.findall(PATTERN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """item -> [(doc_id, score)], from (id, text) rows."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    merged = {}
    for i, t in items:
        merged.setdefault(i, set()).update(terms(t))
    out = {}
    for item, wanted in merged.items():
        found = []
        for (d, b), size in zip(bags, sizes):
            m = 50 + (50 * size * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 20 * m)) for t in wanted if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        if found:
            out[item] = [(x[3], -x[0]) for x in sorted(found)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


TEXTS = [None, "", " ,;", "a", "A b", "b a!", "a a b", *["the same text twice over"] * 70, "the same text, twice OVER", "élan vital élan", "x" * 3000, "word " * 5000,
         *[f"own {i} the text {i % 7} a" for i in range(60)]]
ITEMS = [(1, "the text a 3"), (2, "élan? ÉLAN"), (3, None), (4, ""), (5, "nothing here"), (6, "same over"), (1, "b word"), (None, "twice own"), (7, "a"), (7, "a")]


@pytest.mark.parametrize("bounds", [(4096, 1 << 24), (1, 1 << 24), (4096, 40)])
def test_equals_brute_force(spark, make_docs, bounds):
    ids = [*range(100, 100 + len(TEXTS))]
    ids[40], ids[41], ids[30] = None, 105, 105
    docs = make_docs(TEXTS, ids=ids)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(rk.ranked(docs, items, 50, *bounds)) == brute([*zip(ids, TEXTS)], ITEMS)


def test_equal_bags_are_one_class_and_ties_go_by_id(spark, make_docs):
    docs = make_docs(["same words here"] * 200, ids=[*range(500, 300, -1)])
    items = spark.createDataFrame([(1, "words"), (2, "same here other")], "item_id long, text string")
    found = got(rk.ranked(docs.unionByName(make_docs(["else"] * 300, ids=[*range(1000, 1300)])), items, 50))
    assert [d for d, _ in found[1]] == [d for d, _ in found[2]] == [*range(301, 351)]


def test_extra_columns_and_empty_tables(spark, make_docs):
    docs = make_docs(["one two", "two three"]).withColumn("bag", F.lit("x")).withColumn("m", F.lit("x")).withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(9, "three", "x", 4)], "item_id long, text string, doc_id string, score int")
    assert got(rk.ranked(docs, items)) == brute([(0, "one two"), (1, "two three")], [(9, "three")])
    assert rk.ranked(docs, items.limit(0)).count() == 0 and rk.ranked(docs.limit(0), items).count() == 0
    assert rk.ranked(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_a_text_over_one_slice(spark, make_docs):
    texts = ["far " * 1_200_000 + "needle", "needle", "far"]
    items = [(1, "needle far")]
    found = got(rk.ranked(make_docs(texts), spark.createDataFrame(items, "item_id long, text string")))
    assert found == brute([*enumerate(texts)], items)


@pytest.mark.parametrize("weight", [7, 1 << 40])
def test_scores_are_exact_beyond_float64(weight):
    group = rk.ItemGroup([1, 2], np.array([0, 2, 3]), np.array([0, 2, 1], np.uint32), pa.array([b"a", b"b", b"c"]), np.array([weight + 1, weight, weight + 3]))
    bags = [[(0, 1), (2, 3)], [(1, 2)], [(2, 1)]]
    first = pa.array([{"none": False, "doc_id": i} for i in range(3)], pa.struct([("none", pa.bool_()), ("doc_id", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array([np.array(b, rk._PAIR).tobytes() for b in bags], pa.binary()), pa.array([60, 61, 62]), first], ["cls", "bag", "m", "first"])
    found = [r for out in rk._best(SimpleNamespace(value=group), 2)(iter([batch])) for r in out.to_pylist()]
    part = lambda d, t, tf: int(group.weights[t]) * (1000000000 * tf // (1000 * tf + 20 * (60 + d)))
    assert [(r["item"], r["cls"], r["score"]) for r in found] == [(0, 5, part(0, 0, 1) + part(0, 2, 3)), (0, 7, part(2, 2, 1)), (1, 6, part(1, 1, 2))]
