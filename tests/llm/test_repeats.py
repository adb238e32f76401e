import hashlib
import random
import re

import numpy as np
import pytest

from innings_engine.llm import repeats


def slow_removal(texts, window):
    """doc -> (n_words, n_removed, kept text), by a dictionary of all windows."""
    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i:i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def planted(seed, window, letters):
    rng = random.Random(seed)
    word = lambda: rng.choice(letters)
    passages = [[word() for _ in range(rng.randint(window - 2, 4 * window))] for _ in range(6)]
    texts = [None, "", " ", "short", "a " * (window - 1), "a " * window, "a " * (window + 1), "a " * (5 * window), "b " + "a " * (3 * window) + "c"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [word() for _ in range(rng.randint(0, window))]
            part = list(rng.choice(passages))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = word()
            if rng.random() < 0.3:
                part = part[rng.randrange(5):]
            parts += part
        texts.append("\n".join(parts))
    texts += texts[-3:]
    return texts


@pytest.mark.parametrize("seed,window,letters", [(1, 12, "ab"), (2, 12, "abcdefghij"), (3, 50, [f"w{i}" for i in range(300)]), (4, 50, "abc"), (5, 5, "ab")])
def test_against_a_dictionary_of_windows(spark, make_docs, seed, window, letters):
    texts = planted(seed, window, letters)
    random.Random(seed).shuffle(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.removal_report(make_docs(texts), window).collect()}
    want = slow_removal(dict(enumerate(texts)), window)
    assert got == {d: (n, g, hashlib.sha256(t.encode()).hexdigest()) for d, (n, g, t) in want.items()}
    assert sum(g for _, g, _ in got.values()) > 100


def test_equal_windows_have_one_anchor():
    rng = np.random.default_rng(5)
    names = repeats.wd.mix(rng.integers(0, 4, 4000).astype(np.uint64))
    names[3000:3400] = names[100:500]
    docs = np.array([0, 700, 1500, 1500, 4000])
    symbol, _, at, n = repeats.anchors(names, docs, 20)
    seen = {}
    for s, a, k in zip(symbol.tolist(), at.tolist(), n.tolist()):
        for i in range(a, a + k):
            assert seen.setdefault(names[i:i + 20].tobytes(), s) == s
    assert n.sum() == sum(max(0, b - a - 19) for a, b in zip(docs, docs[1:])) and len(seen) < n.sum()


def test_text_is_kept_where_nothing_repeats(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    docs = make_docs(["A  spaced\ttext", long, None, f"x {long} y"])
    got = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert got == {0: "A  spaced\ttext", 1: long, 2: None, 3: "x y"}
    assert repeats.without_repeats(docs).columns == docs.columns


def test_empty_table(spark, make_docs):
    assert repeats.removal_report(make_docs(["a"]).where("false")).collect() == []


def test_tables_of_symbols_are_never_broadcast(spark, make_docs, monkeypatch):
    """Files of symbols, spans and windows are far smaller than their rows, so none goes through the driver."""
    plans = []
    written = repeats.keep
    monkeypatch.setattr(repeats, "keep", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or written(df, name))
    passage = " ".join(f"w{i}" for i in range(80))
    repeats.removals(make_docs([passage, f"a {passage}", f"b c {passage} d"]))
    seen = dict(plans)
    for name in ("shared", "known"):
        assert "Broadcast" not in seen[name] and "SortMergeJoin" in seen[name], seen[name]
