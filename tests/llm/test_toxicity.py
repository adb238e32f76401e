import random

import pyarrow as pa
import pytest

from innings_engine.llm import toxicity as tx


def slow_edits(a, b):
    """Edits between two words; a swap of neighbours is one."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        rows.append([i])
        for j in range(1, len(b) + 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def slow_kind(terms, word):
    best = 9
    for t, kind in terms:
        allowed = 2 if len(t) >= tx.TWO_EDITS else 1 if len(t) >= tx.ONE_EDIT else 0
        e = min(slow_edits(t, word[:k]) for k in ([len(word)] if kind == 0 else range(len(word) + 2 - kind))) if kind < 2 or word else 9
        if e <= allowed:
            best = min(best, e)
    return 0 if best == 9 else 1 if best == 0 else 2


@pytest.mark.parametrize("terms", [
    [("idiot", 1), ("scum", 0), ("worthless", 1), ("lowei", 2), ("vile", 0)],
    [("abcab", 0), ("abbab", 1), ("ab", 0), ("aabbaabba", 0), ("cab", 2), ("bbacab", 2)]])
def test_kinds_against_edit_distance(terms):
    rng = random.Random(11)
    letters = "".join(sorted({c for t, _ in terms for c in t})) + "x"
    words = [t for t, _ in terms] + ["", "idoit", "idiots", "diot", "worhtles", "wrthles", "scums", "lowiechen"]
    for _ in range(1500):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        words.append("".join(w) + rng.choice(["", "", "xx", "b"]))
    m = tx.Matcher([(*t, 1.5) for t in terms])
    assert [(w, m.match(w)[0]) for w in words] == [(w, slow_kind(terms, w)) for w in words]


def test_quotation_and_abuse():
    s = tx.Scorer([("idiot", 1, 2.0)])
    texts = pa.array(["you idiot", 'he told me "you idiot, go" and left', "« quel idiot »", 'an "old" idiot "here"', "she said idiot", "idoit", None, ""])
    x = s.inputs(texts)
    assert [r[1] > 0 for r in x.tolist()] == [True, False, False, True, False, False, False, False]
    assert [r[3] > 0 for r in x.tolist()] == [False, True, True, False, True, False, False, False]
    assert x[5][2] > 0


def corpus(n=900):
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(pool) for _ in range(rng.randint(20, 90))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["zworthless", "zscum", "zlowe" + rng.choice(pool)]))
            if rng.random() < 0.1:
                words = [w.replace("zworthless", "zwortless") for w in words]
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    return texts + [texts[0]] * 30 + [None, ""], labels + [(n + k, labels[0][1]) for k in range(30)] + [(n + 30, None), (n + 31, 0), (10**6, 1)]


def test_held_out_labels(spark, make_docs):
    texts, labels = corpus()
    docs, table = make_docs(texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    terms, _ = tx.fit(docs, table)
    assert {"zwor", "zscu", "zlow"} <= {t[:4] for t, *_ in terms} and len(terms) < 8
    got = {r.doc_id: r for r in tx.scores(docs, table).collect()}
    truth = dict(labels)
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (tx.crc_remainder(d) == 2) for d, r in got.items())
    out = [d for d, r in got.items() if r.held_out and truth.get(d) is not None]
    assert sum(got[d].predicted == truth[d] for d in out) >= 0.97 * len(out)
    left = tx.without_toxic(docs.withColumn("score", docs.n_chars), table)
    assert left.count() == sum(1 - r.predicted for r in got.values())


def test_held_out_labels_are_not_read(spark, make_docs):
    texts, labels = corpus(300)
    flipped = [(d, 1 - t if t is not None and tx.crc_remainder(d) == 2 else t) for d, t in labels]
    docs = make_docs(texts)
    a, b = (sorted(tx.scores(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


def test_no_labels_and_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tx.scores(make_docs(["a", None]), none).collect()} == {0.5}
    assert tx.scores(make_docs(["a"]).where("false"), none).collect() == []
    ones = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.3 for r in tx.scores(make_docs(["a", "b"]), ones).collect())
