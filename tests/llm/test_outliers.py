import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from innings_engine.llm import outliers


def slow_statistics(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def odd_texts():
    rng = random.Random(7)
    pool = ["a", "é#", "b\n", "\n", "x | y", "日本", " \r\n", "a a a a a a a a a", "same line\n", "\t"]
    return [None, "", " ", "\n\n", "a\n", "a\na", "a\r\na\n", "\na\n a\na", "w " * 9, *[" ".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(120)]]


def test_statistics():
    texts = odd_texts()
    got = outliers.statistics(pa.array(texts))
    assert list(zip(*[got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])) == [slow_statistics(t) for t in texts]


def slow_estimate(x, share, steps):
    """The same estimate for one group, from all rows at once."""
    x = np.asarray(x)
    n = len(x)
    at = lambda q: np.sort(x, axis=0)[int(np.ceil(q * n)) - 1] / outliers.UNIT
    mean, scatter = at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2 + np.square(outliers.FLOORS))
    far = lambda: np.einsum("ij,jk,ik->i", x / outliers.UNIT - mean, np.linalg.inv(scatter), x / outliers.UNIT - mean)

    def of(rows, factor):
        return rows.mean(0) / outliers.UNIT, np.cov(rows.T, bias=True) / outliers.UNIT**2 * factor + np.diag(np.square(outliers.FLOORS))

    for _ in range(steps):
        bins = np.floor(outliers.BIN * np.log2(far() + 1e-6))
        edge = np.sort(bins)[int(np.ceil(share * n)) - 1]
        mean, scatter = of(x[bins <= edge], outliers._consistency(share))
    mean, scatter = of(x[far() <= outliers.chi2_quantile(5, 0.975)], outliers._consistency(0.975))
    return mean, np.linalg.inv(scatter)


def test_estimates_of_a_hot_and_a_small_group(spark):
    rng = np.random.default_rng(8)
    rows, groups = [], {"hot": 700, "small": 150}
    for g, n in groups.items():
        base = rng.normal(0, 1, (n, 5)) @ rng.normal(0, 0.5, (5, 5)) + 3
        base[: n // 6] += 8
        rows += [(g, *map(int, np.round(r * outliers.UNIT))) for r in base]
    frame = spark.createDataFrame(rows, "grp string, x0 long, x1 long, x2 long, x3 long, x4 long")
    got = {r.grp: r for r in outliers.estimates(frame.repartition(5)).collect()}
    for g, n in groups.items():
        mean, inverse = slow_estimate([r[1:] for r in rows if r[0] == g], outliers.KEEP, outliers.STEPS)
        assert got[g].n_all == n
        assert np.allclose(got[g].mean, mean) and np.allclose(np.reshape(got[g].inverse, (5, 5)), inverse)
    assert abs(np.array(got["hot"].mean) - 3).max() < 0.4  # the planted sixth is ignored


def test_chi_square():
    assert abs(outliers.chi2_quantile(5, 0.975) - 12.8325) < 1e-3 and abs(outliers.chi2_cdf(2, 2.0) - (1 - np.exp(-1))) < 1e-9


def test_junk_is_rejected_and_prose_kept(spark, make_docs):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [prose(rng.randint(40, 600)) for _ in range(300)]
    junk = [" ".join(w + "$$$" for w in prose(200).split()), " ".join("x" * 15 + w for w in prose(150).split()), "no " * 300, "short", None]
    got = {r.doc_id: r for r in outliers.outlier_report(make_docs(texts + junk)).collect()}
    assert len(got) == 305 and sum(got[i].kept for i in range(300)) >= 298
    assert not any(got[300 + i].kept for i in range(5))
    assert [got[300 + i].base_failed for i in range(5)] == [False, False, True, True, True]


def test_repetition_near_the_limits_of_the_base_rules_is_rejected(spark, make_docs):
    rng = random.Random(10)
    prose = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    plain = [" ".join(prose(rng.randint(40, 600))) for _ in range(300)]
    windows = []
    for share in (0.15, 0.2, 0.25, 0.29):
        words, own = prose(200), int(200 * share) // 2
        words[100:100 + own] = words[:own]
        windows.append(" ".join(words))
    lines = ["\n".join([" ".join(prose(20)) for _ in range(10)] + ["one line"] * n) for n in (6, 11, 20)]
    got = {r.doc_id: r for r in outliers.outlier_report(make_docs(plain + windows + lines)).collect()}
    odd = [got[i] for i in range(300, 307)]
    assert not any(r.base_failed for r in odd) and all(r.n_repeat_words or r.n_dup_lines for r in odd)
    assert not any(r.kept for r in odd) and sum(got[i].kept for i in range(300)) >= 295


@pytest.mark.parametrize("texts", [["a"], ["a " * 25 + "b", None], ["w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21"]])
def test_few_rows_have_no_outliers(spark, make_docs, texts):
    for r in outliers.outlier_report(make_docs(texts, lang=None, source=None)).collect():
        assert r.kept == (not r.base_failed)


def test_empty_table(spark, make_docs):
    assert outliers.outlier_report(make_docs(["a"]).where("false")).collect() == []


def slow_sparse_estimate(x):
    """One group's estimate with the variances of sparse statistics, from all rows at once."""
    x, n, unit = np.asarray(x), len(x), outliers.UNIT
    at = lambda v, q: np.sort(v, axis=0)[int(np.ceil(q * len(v))) - 1] / unit
    n_long = np.exp(at(x, 0.75)[0])
    sizes = {2: n_long * np.exp(at(x, 0.5)[1]), 3: n_long, 4: n_long}
    added = np.square(outliers.FLOORS)
    for i in outliers.SPARSE:
        some = x[x[:, i] != 0][:, i]
        added[i] = (at(some, 0.5) ** 2 * len(some) / n if len(some) else 0) + 0.25 / (sizes[i] + outliers.DAMP[i - 2])
    mean, scatter = at(x, 0.5), np.diag(((at(x, 0.75) - at(x, 0.25)) / 1.349) ** 2 + added)
    far = lambda: np.einsum("ij,jk,ik->i", x / unit - mean, np.linalg.inv(scatter), x / unit - mean)
    of = lambda rows, share: (rows.mean(0) / unit, np.cov(rows.T, bias=True).reshape(5, 5) / unit**2 * outliers._consistency(share) + np.diag(added))
    for _ in range(outliers.STEPS):
        bins = np.floor(outliers.BIN * np.log2(far() + 1e-6))
        mean, scatter = of(x[bins <= np.sort(bins)[int(np.ceil(outliers.KEEP * n)) - 1]], outliers.KEEP)
    return (n, *of(x[far() <= outliers.chi2_quantile(5, outliers.REWEIGHT)], outliers.REWEIGHT))


def slow_verdicts(docs):
    """{doc_id: (kept, distance)} of (doc_id, lang, source, text)."""
    vectors, out = {}, {}
    for d, lang, source, text in docs:
        n, chars, symbols, lines, repeats = slow_statistics(text)
        if n < 20 or 100 * repeats > 30 * n:
            out[d] = (False, None)
            continue
        shares = [c / (size + more) for c, size, more in zip((symbols, lines, repeats), (chars, n, n), outliers.DAMP)]
        x = [np.log(n), np.log((chars + 5 * outliers.SHORT) / (n + outliers.SHORT)), *np.sqrt(shares)]
        vectors[d] = (lang, source, [int(np.floor(v * outliers.UNIT + 0.5)) for v in x])
    pick = lambda fits: slow_sparse_estimate([v[2] for v in vectors.values() if fits(v)])
    for d, (lang, source, x) in vectors.items():
        _, mean, scatter = pick(lambda v: True)
        for n, own, wide in (pick(lambda v: v[0] == lang), pick(lambda v: v[:2] == (lang, source))):
            w = n / (n + outliers.PRIOR)
            scatter = w * wide + (1 - w) * scatter + w * (1 - w) * np.outer(own - mean, own - mean)
            mean = w * own + (1 - w) * mean
        apart = np.array(x) / outliers.UNIT - mean
        far = apart @ np.linalg.inv(scatter) @ apart
        out[d] = (bool(far <= outliers.chi2_quantile(5, outliers.TAIL)), far)
    return out


def mixed_docs():
    """Two languages, a hot source, small sources, nulls and documents with some repetition or symbols."""
    rng = random.Random(11)
    docs = []
    for i in range(240):
        words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(15, 400))]
        if i % 5 == 0:
            words += [f"c{i}", "#", "|"] * rng.randint(1, 4)
        if i % 7 == 0:
            words += ["\none line", "\none line"] + words[:8 + i % 3]
        if i % 40 == 3:
            words = [w + "$%" for w in words]
        lang = ["en", "en", "de", None][i % 4]
        docs.append((i, lang, "hot" if i % 3 else [None, "s1", "s2"][i % 9 // 3], " ".join(words)))
    return [*docs, (900, "xx", "alone", "word " + docs[1][3]), (901, None, None, None), docs[5]]


def test_verdicts_over_all_levels_against_brute_force(spark):
    docs = mixed_docs()
    frame = spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").selectExpr("*", "1 AS distance", "'x' AS kept", "2 AS mean")
    rows = outliers.outlier_report(frame.repartition(7)).collect()
    want = slow_verdicts([(k, *d[1:]) for k, d in enumerate(docs)])
    assert len(rows) == len(docs)
    by_id = {r.doc_id: r for r in rows}
    for k, d in enumerate(docs):
        kept, far = want[k]
        got = by_id[d[0]]
        assert got.kept == kept and (far is None or abs(got.distance - far) < 1e-6 * max(1, far)), d[:3]
    good = [r for r in rows if not r.base_failed]
    assert any(r.kept for r in good) and any(not r.kept for r in good)


def test_one_event_in_a_long_text_is_kept_and_many_are_not(spark, make_docs):
    rng = random.Random(12)
    prose = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    plain = [" ".join(prose(rng.randint(40, 600))) for _ in range(300)]
    few = [" ".join(prose(300)) + " #", " ".join(prose(500)) + "\nnote\nnote", " ".join(prose(400)) + " 5%"]
    many = [" ".join(w + "#" for w in prose(300)), " ".join(prose(200)) + "\nnote" * 60]
    got = {r.doc_id: r for r in outliers.outlier_report(make_docs(plain + few + many)).collect()}
    assert all(got[300 + i].kept for i in range(3)) and not any(got[303 + i].kept or got[303 + i].base_failed for i in range(2))
    assert sum(got[i].kept for i in range(300)) >= 295


def test_covariances_change_verdicts(spark):
    docs = spark.createDataFrame(mixed_docs(), "doc_id long, lang string, source string, text string")
    with_, without = ({r.doc_id: r.kept for r in outliers.outlier_report(docs, covariances=c).collect()} for c in (True, False))
    assert with_ != without
