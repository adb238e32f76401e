import random
import re

import pyarrow as pa
import pytest
import xxhash

from innings_engine.llm import simhash
from innings_engine.llm.components import components


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """doc -> smallest doc reachable, all pairs."""
    head = {d: d for d in fps}

    def find(d):
        while head[d] != d:
            d = head[d]
        return d

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {d: find(d) for d in fps}


TEXTS = [None, "", " \t", "one", "Two words", "x y z", "é È  z a", "a " * 700, "ab\x1ccd ef gh", *["lorem ipsum dolor sit amet " * 3] * 3]


def test_fingerprint_bits():
    assert simhash.fingerprints(pa.array(TEXTS)).tolist() == [slow_fingerprint(t) for t in TEXTS]


def test_components_match_all_pairs(spark, make_docs):
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(300)]
    texts = list(TEXTS)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(300)] = "zz"
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(texts)).collect()}
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    want = slow_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len({c for _, c in got.values()}) < len(got) - 10


def test_links_within_two_bits_over_the_sign(spark):
    rng = random.Random(2)
    seen = {rng.getrandbits(64) for _ in range(20)}
    for x in list(seen):
        for bits in ((0,), (63,), (15, 16), (0, 63), (4, 5), (1, 2, 3)):
            seen.add(x ^ sum(1 << b for b in bits))
    fps = dict(enumerate(sorted(seen)))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps.values()}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"))
    roots = {r.node: r.root for r in components(edges).collect()}
    want = slow_components(fps)
    groups = {}
    for i, f in fps.items():
        groups.setdefault(want[i], set()).add(roots.get(signed[f], signed[f]))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_empty_table_and_extra_columns(spark, make_docs):
    from pyspark.sql import functions as F
    assert simhash.near_duplicates(make_docs(["a"]).where("false")).collect() == []
    extra = make_docs(["a b c", "a b c"]).withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    assert [r.component_id for r in simhash.near_duplicates(extra).collect()] == [0, 0]


def test_chain_and_no_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert components(chain).select("root").distinct().count() == 1
    assert components(chain.where("false")).collect() == []


def test_tables_hot_values_and_the_distance(spark):
    rng = random.Random(3)
    seen = {rng.getrandbits(64) for _ in range(30)}
    for half in (0, 32):
        shared = rng.getrandbits(32) << half
        for _ in range(40):
            x = shared | rng.getrandbits(32) << (32 - half)
            seen |= {x, *(x ^ 1 << a ^ 1 << b for a, b in ((0, 0), (1, 40), (33, 35), (2, 3), (63, 63)))}
            seen.add(x ^ 0b111 << 30)
    fps = sorted(seen)
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    plain = lambda df: {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in df.collect()}
    for hot in (1, 8, 1000):
        assert plain(simhash.links(table, hot=hot)) == want
        assert plain(simhash.candidates(table, hot)) > want
    assert plain(simhash.links(table, radius=1)) == {(a, b) for a, b in want if (a ^ b).bit_count() == 1}
    with pytest.raises(ValueError):
        simhash.links(table, radius=3)


def test_rows_without_doc_id_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, "q r s t u v"), (4, "a b c"), (4, "z y x w"), (7, "a b c")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in got) == [
        (-1, -1), (-1, 4), (4, 4), (4, 4), (7, 4)]


def test_exploded_tables_are_never_broadcast(spark, monkeypatch):
    """An exploded table is far larger than the size Spark plans with, so nothing that meets one may be sent through the driver."""
    plans = []
    written = simhash.keep
    monkeypatch.setattr(simhash, "keep", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or written(df, name))
    found = simhash.candidates(spark.createDataFrame([(i * 7919,) for i in range(50)], "fp long"), hot=8)
    plans.append(("pairs", found._jdf.queryExecution().sparkPlan().toString()))
    seen = dict(plans)
    for name, joins in (("probes", 1), ("pairs", 2)):
        assert "Broadcast" not in seen[name] and seen[name].count("SortMergeJoin") == joins, seen[name]
