"""Robust multivariate outliers of text statistics, per language and source.

Statistics of each text are counted exactly over the whole text. Documents that pass the base rules (at least 20 words, at
most 30 % of them in repeated 8-word windows) give a vector of five transformed statistics: logs of the words and of the word
length, and the square roots of the shares of symbols, repeated lines and repeated words. For each (language, source), each
language and all rows together, the minimum-covariance-determinant location and scatter is found by concentration steps from a
deterministic start (medians and quartile ranges): each step keeps the ``KEEP`` share of rows nearest by Mahalanobis
distance and takes their mean and covariance. A reweighting step follows. A document is rejected beyond ``TAIL`` of the
chi-square distribution.

The last three statistics are zero in most texts, so that the core of a group may have no scatter in them. Each gets a variance
from the group itself, in every step: that of a text which is non-zero as often as the group's and then at the median of its
non-zero values (a few extreme texts can't raise it), plus the sampling variance of a rare count, a quarter of one event over the
length of a text at the group's third quartile. One symbol or one repeated line is so within bounds where it is rare, and many
are not. The other two have a floor of one unit (``FLOORS``), only so that the scatter can be inverted.

Every (language, source) is judged by an estimate of its own, however small: its rows are mixed with ``PRIOR`` rows' worth of its
language, which is mixed with ``PRIOR`` rows' worth of all. The covariance is that of the mixture. An estimate of five
statistics is determined from six rows in the core, eight in the group; fewer rows weigh little beside the prior.

A step is one aggregation by (group, distance bin): map-side sums of counts and moments in whole numbers, so that results are the
same however rows are dealt, and a hot source costs no more than another. The nearest rows are whole bins up to the
share.

Null texts are empty; documents failing the base rules are not kept and not part of any estimate; null languages and sources are
values of their own; repeated rows count as often as they appear; other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import words as wd
from .repeats import SpanHashes
from .scratch import keep

#: Share of a group's rows that the scatter is minimal for.
KEEP = 0.75
STEPS = 4
#: Rows' worth of the next wider group that are mixed into each group: six for each statistic.
PRIOR = 30
#: Probability up to which the reweighting step and the verdict accept a distance.
REWEIGHT, TAIL = 0.975, 0.999
UNIT = 1024  # statistics are whole numbers of 1 / UNIT
#: Added standard deviation of each transformed statistic: one unit, enough to invert any scatter.
FLOORS = (1 / UNIT,) * 5
BIN = 32  # distance bins per doubling
DIM = len(FLOORS)
#: Words of five letters added to each text before its word length is taken, which in few words is mostly chance.
SHORT = 20
#: Added to the characters or words that a share is taken of, so that one event in a short text stays a small share.
DAMP = (250, 50, 50)
#: Statistics that are zero in most texts.
SPARSE = (2, 3, 4)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_REPEAT = 8

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_doc(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[edges])


def _doubled(keys: np.ndarray) -> np.ndarray:
    """Marks every key that occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts per text."""
    body, offsets = wd.text_bytes(texts)
    cut = wd.cut(texts)
    heads = np.zeros(len(body), bool)  # first bytes of code points in words
    heads[:] = ((body & 0xC0) != 0x80) & ~wd.SPACES[body]
    # Lines: pieces between line feeds and text borders.
    border = np.zeros(len(body) + 1, bool)
    border[offsets] = True
    feed = body == 0x0A
    first = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(feed) + 1]))
    first = first[first < len(body)]
    stop = np.append(first[1:], len(body))
    doc = np.searchsorted(offsets, first, "right") - 1
    filled = _per_doc(heads, np.append(first, len(body))) > 0 if len(first) else np.empty(0, bool)
    stop = stop - (feed[stop - 1] if len(first) else 0)
    first, stop, doc = first[filled], stop[filled], doc[filled]
    lines = wd.Words(body[wd.ragged(first, stop - first)], stop - first, np.array([0, len(first)]), first)
    dup_lines = np.zeros(len(texts), np.int64)
    if len(first):
        code, _ = lines.coded()
        pairs = np.unique(np.stack([doc, code]), axis=1)[0]
        dup_lines = np.bincount(doc, minlength=len(texts)) - np.bincount(pairs, minlength=len(texts))
    n = np.maximum(cut.counts - _REPEAT + 1, 0)
    at = wd.ragged(cut.docs[:-1], n)
    repeated = np.zeros(len(cut), np.int64)
    if len(at):
        owner = np.repeat(np.arange(len(n)), n).astype(np.uint64)
        twice = at[_doubled(SpanHashes(cut.hashes()).of(at, at + _REPEAT) ^ wd.mix(owner + np.uint64(1)))]
        change = np.bincount(twice, minlength=len(cut) + 1)[:len(cut) + 1] - np.bincount(twice + _REPEAT, minlength=len(cut) + 1)[:len(cut) + 1]
        repeated = (np.cumsum(change)[:-1] > 0).astype(np.int64)
    return {"n_words": cut.counts, "word_chars": _per_doc(heads, offsets), "n_symbols": _per_doc(_SYMBOL[body], offsets),
            "n_dup_lines": dup_lines, "n_repeat_words": _per_doc(repeated, cut.docs)}


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                own = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), *(pa.array(v.astype(np.int64)) for v in own.values())], ["doc_id", "lang", "source", *own])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(of, f"doc_id long, lang string, source string, {_STATS}")


def vectors() -> list[Column]:
    """Transformed statistics in whole units."""
    n, chars = F.col("n_words"), F.col("word_chars")
    shares = zip(("n_symbols", "n_dup_lines", "n_repeat_words"), (chars, n, n), DAMP)
    raw = [F.log(n), F.log((chars + SHORT * 5) / (n + SHORT)), *(F.sqrt(F.col(c) / (size + more)) for c, size, more in shares)]
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def chi2_cdf(k: int, x: float) -> float:
    """Distribution of the sum of k squared normals, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / math.gamma(k / 2 + 1)
    for i in range(1, 500):
        term *= x / 2 / (k / 2 + i)
        total += term
    return min(1.0, total * math.exp(-x / 2 + k / 2 * math.log(x / 2)))


def chi2_quantile(k: int, p: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(k, mid) < p else (low, mid)
    return low


def _consistency(share: float) -> float:
    """Factor that makes the scatter of the nearest share right for normal data."""
    return share / chi2_cdf(DIM + 2, chi2_quantile(DIM, share))


_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_MOMENTS = [f"s{i}" for i in range(DIM)] + [f"p{i}{j}" for i, j in _PAIRS]
_PARAMS = "grp string, n_all long, floors array<double>, mean array<double>, scatter array<double>, inverse array<double>"


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(DIM)]
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))  # noqa: E731  no overflow at any number of rows
    return [F.count("*").alias("n"), *(wide(x[i]).alias(f"s{i}") for i in range(DIM)), *(wide(x[i] * x[j]).alias(f"p{i}{j}") for i, j in _PAIRS)]


def _estimated(factor: float):
    """Mean and inverse scatter of each group's moments (one row a group)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = {c: [] for c in ("grp", "n_all", "floors", "mean", "scatter", "inverse")}
            for r in rows:
                n = int(r["n"])
                mean = np.array([float(r[f"s{i}"]) / n for i in range(DIM)])
                scatter = np.zeros((DIM, DIM))
                for i, j in _PAIRS:  # exact numerators: sums are whole numbers
                    scatter[i, j] = scatter[j, i] = float(int(r[f"p{i}{j}"]) * n - int(r[f"s{i}"]) * int(r[f"s{j}"])) / n / n
                scatter = scatter / UNIT**2 * factor + np.diag(r["floors"])
                for c, v in zip(out, (r["grp"], r["n_all"], r["floors"], (mean / UNIT).tolist(), scatter.ravel().tolist(), np.linalg.inv(scatter).ravel().tolist())):
                    out[c].append(v)
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int64(), lists, lists, lists, lists))], list(out))

    return of


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. from the columns mean and inverse."""
    d = [F.col(f"x{i}") / UNIT - F.col(f"{prefix}mean")[i] for i in range(DIM)]
    terms = [F.col(f"{prefix}inverse")[DIM * i + j] * d[i] * d[j] * (1 if i == j else 2) for i, j in _PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _first_estimate(grouped: DataFrame, sparse: tuple[int, ...]) -> DataFrame:
    """Medians, quartile ranges and added variances; values are whole, so a group's distinct values are few however many rows it has."""
    long = grouped.select("grp", F.posexplode(F.array(*[f"x{i}" for i in range(DIM)])).alias("i", "x")).groupBy("grp", "i", "x").agg(F.count("*").alias("n"))
    order, all_of = Window.partitionBy("grp", "i").orderBy("x"), Window.partitionBy("grp", "i")
    zero = F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("n"))).over(all_of), F.lit(0))
    ranked = long.withColumn("upto", F.sum("n").over(order)).withColumn("n_all", F.sum("n").over(all_of)).withColumn("zero", zero)
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("n_all")), F.col("x"))) / UNIT
    filled = F.col("n_all") - F.col("zero")
    usual = F.coalesce(F.min(F.when((F.col("x") != 0) & (F.col("upto") - F.col("zero") >= F.ceil(0.5 * filled)), F.col("x"))) / UNIT, F.lit(0.0))
    wide = ranked.groupBy("grp", "i").agg(
        F.max("n_all").alias("n_all"), at(0.5).alias("mid"), at(0.75).alias("high"), ((at(0.75) - at(0.25)) / 1.349).alias("scale"), (usual * usual * F.max(filled / F.col("n_all"))).alias("rare"))
    parts = wide.groupBy("grp").agg(F.max("n_all").alias("n_all"), F.array_sort(F.collect_list(F.struct("i", "mid", "high", "scale", "rare"))).alias("v"))
    n_long = F.exp(F.col("v")[0]["high"])
    sizes = (n_long * F.exp(F.col("v")[1]["mid"]), n_long, n_long)
    added = [F.col("v")[i]["rare"] + 0.25 / (sizes[i - 2] + DAMP[i - 2]) if i in sparse else F.lit(FLOORS[i] ** 2) for i in range(DIM)]
    parts = parts.withColumn("floors", F.array(*added))
    diagonal = F.transform("v", lambda r: 1 / (r["scale"] * r["scale"] + F.element_at("floors", r["i"] + 1)))
    flat = F.transform(F.sequence(F.lit(0), F.lit(DIM * DIM - 1)), lambda k: F.when(
        k % (DIM + 1) == 0, F.element_at(diagonal, (k / (DIM + 1)).cast("int") + 1)).otherwise(F.lit(0.0)))
    return parts.select("grp", "n_all", "floors", F.transform("v", lambda r: r["mid"]).alias("mean"), flat.alias("inverse"))


def estimates(grouped: DataFrame, share: float = KEEP, steps: int = STEPS, sparse: tuple[int, ...] = ()) -> DataFrame:
    """(grp, n_all, floors, mean, scatter, inverse) of every group of (grp, x0..); ``sparse`` statistics get their variance as in the module's text."""
    params = keep(_first_estimate(grouped, sparse), "params")
    added = params.select("grp", "floors")
    for _ in range(steps):
        near = F.floor(BIN * F.log2(distance() + 1e-6))
        bins = grouped.join(params, "grp").groupBy("grp", "n_all", near.alias("bin")).agg(*_moments())
        before = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        kept = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < F.ceil(share * F.col("n_all")))
        total = kept.groupBy("grp", "n_all").agg(*[F.sum(c).alias(c) for c in ("n", *_MOMENTS)])
        params = keep(total.join(added, "grp").mapInArrow(_estimated(_consistency(share)), _PARAMS), "params")
    inner = grouped.join(params, "grp").where(distance() <= chi2_quantile(DIM, REWEIGHT)).groupBy("grp", "n_all").agg(*_moments())
    return keep(inner.join(added, "grp").mapInArrow(_estimated(_consistency(REWEIGHT)), _PARAMS), "params")


def _mixed(covariances: bool):
    """Mean and inverse scatter of each (language, source), mixed with its language and all rows."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.float64())
        for batch in batches:
            means, inverses = [], []
            rows = batch.to_pylist()
            for r in rows:
                mean, scatter = np.array(r["mean2"]), np.reshape(r["scatter2"], (DIM, DIM))
                for level in (1, 0):
                    own, n = np.array(r[f"mean{level}"]), r[f"n{level}"]
                    w, apart = n / (n + PRIOR), own - mean
                    scatter = w * np.reshape(r[f"scatter{level}"], (DIM, DIM)) + (1 - w) * scatter + w * (1 - w) * np.outer(apart, apart)
                    mean = mean + w * apart
                means.append(mean.tolist())
                inverses.append(np.linalg.inv(scatter if covariances else np.diag(np.diag(scatter))).ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array([r["g0"] for r in rows], pa.string()), pa.array(means, lists), pa.array(inverses, lists)], ["g0", "mean", "inverse"])

    return of


def outlier_report(docs: DataFrame, tail: float = TAIL, covariances: bool = True) -> DataFrame:
    """doc_id, counts, base_failed, kept and the squared distance (null if base_failed) of every document."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = keep(with_statistics(docs).withColumn("base_failed", failed), "statistics")
    name = lambda *c: F.concat_ws("\u0001", *[F.coalesce(F.col(x), F.lit("\u0002")) for x in c]) if c else F.lit("")
    levels = [name("lang", "source"), F.concat(name("lang"), F.lit("\u0003")), name()]
    keyed = rows.select("*", *[k.alias(f"g{i}") for i, k in enumerate(levels)])
    # Vectors only for rows that passed: others may have no words to divide by.
    good = keyed.where("not base_failed").select("doc_id", "g0", "g1", "g2", *vectors())
    grouped = good.select(F.explode(F.array("g0", "g1", "g2")).alias("grp"), *[f"x{i}" for i in range(DIM)])
    params = estimates(grouped, sparse=SPARSE)
    places = good.select("g0", "g1", "g2").distinct()
    for i in range(3):
        places = places.join(params.select(F.col("grp").alias(f"g{i}"), F.col("n_all").alias(f"n{i}"), F.col("mean").alias(f"mean{i}"), F.col("scatter").alias(f"scatter{i}")), f"g{i}")
    own = keep(places.mapInArrow(_mixed(covariances), "g0 string, mean array<double>, inverse array<double>"), "places")
    scored = keyed.select("*", *[F.when(~F.col("base_failed"), v).alias(f"x{i}") for i, v in enumerate(vectors())])
    scored = scored.join(own, "g0", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(DIM, tail))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
