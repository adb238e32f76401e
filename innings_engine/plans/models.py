"""Forecast models on Spark ML: chronological selection, refit, calibration, components."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators import metrics as m
from ..operators.blend import COMPONENTS, reconcile
from ..operators.encode import CLIP_SIGMAS, HALF_LIVES, SIGMA_FLOOR, category_codes, drop_by_importance, half_up, ordinal_encode, recency_weight
from ..operators.split import FITTED, chrono_labels
from ..session import all_written, written
from ..sources.delivery_log import OVER_KEY
from .forecast import MODEL, TARGET, row_key, staged_log
from .over_table import CATEGORICAL, feature_columns, over_samples, require_columns
from .staging import staged_once

SEED = 20260907
TARGETS = [TARGET, "target_wicket", "target_boundary", "target_six", "target_ten_plus", "target_run_bucket",
           "target_batter_runs", "target_non_striker_runs", "target_extras", "target_other_batters", "target_bowler_conceded"]
KEYS = ["match_id", "innings", "over_number", "date", "partition"]
#: What a chosen model needs to be there; the table has every feature.
NEEDED = ["innings", "over_number", "current_score", "current_wickets", "batter_career_strike_rate", "bowler_career_economy"]


def model_rows(log: DataFrame) -> DataFrame:
    """Keys, targets and categories of every over, its numbers as one vector.

    A vector is one column to write and to read, where hundreds of columns cost more than the joins that made them.
    """
    df = over_samples(log, MODEL, all_written)
    require_columns(df, NEEDED)
    features = feature_columns(df)
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    numbers = [x for x in features if x not in text and x not in KEYS]
    held = df.select("season", *OVER_KEY, "date", *TARGETS, *[x for x in CATEGORICAL if x in features],
                     *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in numbers])
    data = VectorAssembler(inputCols=["innings", "over_number", *numbers], outputCol="numbers").transform(held)
    return data.drop(*numbers)


def vector_table(spark, sf_dir: str) -> DataFrame:
    """Keys with the partition, targets and ``features``: the numbers and the codes of the categories. Written once per session.

    Dates and categories of the usable overs are written first, a few bytes an over, so that partitions and codes are known when the joins
    make the vectors: these are by far the largest table, and it is written in this one form only.
    """
    def build():
        log = staged_log(spark, sf_dir)
        seen = written(over_samples(log, (), all_written).select("season", "date", *CATEGORICAL), "categories")
        labels = chrono_labels(seen)
        df = model_rows(log).join(F.broadcast(labels), "date")          # a row per day
        categories = [x for x in CATEGORICAL if x in df.columns]
        # One code per distinct category: a dimension-sized table, written so that its size decides the joins and no row is shuffled for them.
        codes = written(category_codes(of(seen.join(F.broadcast(labels), "date"), "train"), categories), "codes")
        for x in categories:
            df = ordinal_encode(df, codes.filter(F.col("column") == x), x, f"{x}_code")
        return VectorAssembler(inputCols=["numbers", *[f"{x}_code" for x in categories]], outputCol="features").transform(df).select(*KEYS, *TARGETS, "features")
    return staged_once(spark, ("model_vectors", sf_dir), build, compression="zstd")


def as_columns(data: DataFrame) -> DataFrame:
    """Vectors as columns again, for whatever asks for features by name."""
    held = data.select(*KEYS, *TARGETS, vector_to_array("features").alias("_v"))
    return held.select(*KEYS, *TARGETS, *[F.col("_v")[i].alias(x) for i, x in enumerate(features_of(data)) if x not in KEYS])


def model_table(spark, sf_dir: str) -> DataFrame:
    """Keys, targets and every feature of the over table: numbers as doubles, categories as codes."""
    return as_columns(vector_table(spark, sf_dir))


def features_of(table: DataFrame) -> list[str]:
    """Feature columns of a model table, the two position keys included, or the names in its vectors."""
    if "features" in table.columns:
        parts = table.schema["features"].metadata["ml_attr"]["attrs"].values()
        return [a["name"].removeprefix("numbers_") for a in sorted((a for part in parts for a in part), key=lambda a: a["idx"])]
    return ["innings", "over_number", *[c for c in table.columns if c not in {*KEYS, *TARGETS, "held_out"}]]


def numbers_of(table: DataFrame) -> list[str]:
    return [c for c in features_of(table) if not c.endswith("_code")]


def assembled(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``features``, the vector of ``columns`` (all features by default); vectors that are there already are cut to them."""
    names = features_of(df)
    wanted = list(columns or names)
    if "features" not in df.columns:
        return VectorAssembler(inputCols=wanted, outputCol="features").transform(df)
    if wanted == names:
        return df
    cut = VectorSlicer(inputCol="features", outputCol="_cut", indices=[names.index(x) for x in wanted]).transform(df)
    return cut.drop("features").withColumnRenamed("_cut", "features")


def of(df: DataFrame, *partitions: str) -> DataFrame:
    return df.filter(F.col("partition").isin(*partitions))


def regressors(label: str = TARGET) -> dict:
    """Candidate regressors with fixed, regularised settings."""
    common = {"labelCol": label, "featuresCol": "features"}
    return {
        "gbt": GBTRegressor(maxIter=10, maxDepth=4, stepSize=.2, seed=SEED, validationIndicatorCol="held_out", **common),
        "forest": RandomForestRegressor(numTrees=12, maxDepth=7, minInstancesPerNode=25, seed=SEED, **common),
        "linear": LinearRegression(regParam=.1, **common),
    }


def with_validation(df: DataFrame) -> DataFrame:
    """Train and validation rows, the latter marked for early stopping (never a random split)."""
    return of(df, "train", "validation").withColumn("held_out", F.col("partition") == "validation")


def fit_and_score(df: DataFrame) -> tuple[DataFrame, dict]:
    """Select on validation, refit on everything before the calibration blocks, score both."""
    data = assembled(df)
    refit = of(data, *FITTED).withColumn("held_out", F.lit(False))
    scored, fitted = None, {}
    for name, estimator in regressors().items():
        chosen = estimator.fit(with_validation(data) if name == "gbt" else of(data, "train"))
        final = estimator
        if name == "gbt":
            # The number of trees was settled on validation; the refit uses all rows for fitting.
            final = GBTRegressor(labelCol=TARGET, featuresCol="features", maxIter=max(1, chosen.getNumTrees), maxDepth=4,
                                 stepSize=.2, seed=SEED)
        fitted[name] = final.fit(refit)
        for stage, model, partition in (("selection", chosen, "validation"), ("refit", fitted[name], "test")):
            rows = model.transform(of(data, partition)).select(
                F.lit(name).alias("model"), F.lit(stage).alias("stage"), "match_id", "innings", "over_number",
                F.col(TARGET).alias("y"), F.greatest(F.lit(0.0), F.col("prediction")).alias("p"))
            scored = rows if scored is None else scored.unionByName(rows)
    return scored, fitted


def native_importance(df: DataFrame) -> DataFrame:
    """Importance table of the forest fitted before the calibration blocks."""
    data = assembled(df)
    return importances(df.sparkSession, regressors()["forest"].fit(of(data, *FITTED)), features_of(df))


def importances(spark, model, columns: Sequence[str]) -> DataFrame:
    """Native importance per feature, largest first."""
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def grid_search(df: DataFrame) -> DataFrame:
    """Parameter grid judged by error on the chronological validation block."""
    data = assembled(df)
    train, validation = of(data, "train"), of(data, "validation")
    estimator = GBTRegressor(labelCol=TARGET, featuresCol="features", maxIter=5, seed=SEED)
    grid = ParamGridBuilder().addGrid(estimator.maxDepth, [3, 5]).addGrid(estimator.stepSize, [.1, .3]).build()
    out = None
    for params in grid:
        model = estimator.copy(params).fit(train)
        values = {p.name: v for p, v in params.items()}
        rows = model.transform(validation).agg(F.avg(F.abs(F.col(TARGET) - F.col("prediction"))).alias("mae")).select(
            F.lit(values["maxDepth"]).alias("max_depth"), F.lit(values["stepSize"]).alias("step_size"), "mae")
        out = rows if out is None else out.unionByName(rows)
    order = ["mae", "max_depth", "step_size"]
    return out.withColumn("chosen", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) == 1).orderBy(*order)     # a row per setting


def _linear_rows(data: DataFrame, fit_on: DataFrame, partitions: Sequence[str], **settings) -> DataFrame:
    """Rows of the partitions with the forecast ``p`` of a linear model."""
    model = LinearRegression(labelCol=TARGET, featuresCol="features", regParam=.1, **settings).fit(fit_on)
    return model.transform(of(data, *partitions)).select("match_id", "innings", "over_number", "partition", F.col(TARGET).alias("y"),
                                                         F.greatest(F.lit(0.0), F.col("prediction")).alias("p"))


def recency_arms(df: DataFrame, half_lives: Sequence[int] = tuple(HALF_LIVES)) -> DataFrame:
    """(arm, rows...): linear models fitted on everything before the calibration blocks, plain and weighted by recency."""
    data = assembled(df)
    fitted = of(data, *FITTED)
    newest = fitted.agg(F.max("date")).scalar()
    out = None
    for half_life in (None, *half_lives):
        weight = F.lit(1.0) if half_life is None else recency_weight(F.col("date"), newest, half_life)
        rows = _linear_rows(data, fitted.withColumn("weight", weight), ["test"], weightCol="weight").select(
            F.lit("plain" if half_life is None else f"half_life_{half_life}").alias("arm"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def feature_importance(df: DataFrame) -> DataFrame:
    """(feature, mae_increase, std) of every number of a model table: permutation on validation of a model fitted on the training rows."""
    names = numbers_of(df)
    model = LinearRegression(labelCol=TARGET, featuresCol="features", regParam=.1).fit(of(assembled(df, names), "train"))
    judged = of(df, "validation")
    if "features" in df.columns:
        judged = as_columns(judged)
    return permutation_importance(judged, names, TARGET, linear_scorer(model, names), ["match_id", "innings", "over_number"])


def feature_selection(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(feature, mae_increase, dropped, adopt): every number's importance, and whether the refit without the dropped ones is adopted."""
    rows = [(r["feature"], r["mae_increase"]) for r in feature_importance(df).collect()]     # one row per feature
    importance = df.sparkSession.createDataFrame(rows, "feature string, mae_increase double")
    verdict = feature_removal(df, threshold, importance).select("adopt")
    return importance.withColumn("dropped", F.col("mae_increase") <= threshold).crossJoin(verdict)


def feature_removal(df: DataFrame, threshold: float = 0.0, importance: DataFrame | None = None) -> DataFrame:
    """Importance (of ``feature_importance`` unless given), drop, refit, paired test: one row.

    A model fitted on the training rows is judged on validation by permutation; features that don't raise its error go. Both sets are
    fitted again before the calibration blocks and compared on the same test rows; the smaller set is adopted unless it is
    worse by two standard errors.
    """
    names = numbers_of(df)
    data = assembled(df, names)
    kept, _ = drop_by_importance(feature_importance(df) if importance is None else importance, threshold)
    chosen = sorted(r["feature"] for r in kept.select("feature").collect()) or names[:1]      # one row per feature
    key = ["match_id", "innings", "over_number", "y"]
    smaller = assembled(df, chosen)
    full = _linear_rows(data, of(data, *FITTED), ["test"]).select(*key, F.col("p").alias("full"))
    small = _linear_rows(smaller, of(smaller, *FITTED), ["test"]).select(*key[:3], F.col("p").alias("small"))
    both = full.join(small, key[:3])
    tested = m.paired_test(both, [], "small", "full")
    errors = both.agg(F.avg(F.abs(F.col("y") - F.col("full"))).alias("mae_full"), F.avg(F.abs(F.col("y") - F.col("small"))).alias("mae_small"))
    return m.same_group(errors, tested, []).withColumns({
        "features": F.lit(len(names)), "kept": F.lit(len(chosen)), "adopt": F.lit(len(chosen) < len(names)) & ~F.col("significant").cast("boolean")})


def log_probabilities(column: str = "probability") -> Column:
    """log(p) as a vector, p kept away from zero."""
    return array_to_vector(F.transform(vector_to_array(column), lambda p: F.log(F.greatest(p, F.lit(1e-9)))))


def boosted(data: DataFrame, label: str, classes: int) -> Callable[[DataFrame], DataFrame]:
    """Boosted trees fitted before the calibration season, stopped early on validation; adds ``probability`` to a table.

    Spark's boosting knows two classes: more are fitted one against the others, and the probabilities of a row are made to add up to one.
    """
    fit_on = of(data, *FITTED).withColumn("held_out", F.lit(False)).unionByName(of(data, "validation").withColumn("held_out", F.lit(True)))

    def estimator(target: str):
        return GBTClassifier(labelCol=target, maxIter=6, maxDepth=3, seed=SEED, validationIndicatorCol="held_out")

    if classes == 2:
        return estimator(label).fit(fit_on).transform
    models = [estimator("_own").setProbabilityCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setPredictionCol(f"_y{k}")
              .fit(fit_on.withColumn("_own", (F.col(label) == k).cast("double"))) for k in range(classes)]

    def transform(rows: DataFrame) -> DataFrame:
        out = rows
        for model in models:
            out = model.transform(out)
        own = [vector_to_array(f"_p{k}")[1] for k in range(classes)]
        return out.withColumn("probability", array_to_vector(F.array(*[p / sum(own[1:], own[0]) for p in own]))).select(*rows.columns, "probability")

    return transform


def calibrated_classifier(data: DataFrame, task: str, classes: int):
    """Classifier fitted before the calibration season, logistic calibration on its own block.

    Returns the test rows with raw and calibrated probabilities.
    """
    label = f"target_{task}"
    transform = boosted(data, label, classes)
    block = transform(of(data, "probability_calibration")).select(
        label, log_probabilities().alias("log_p"))
    calibrator = LogisticRegression(labelCol=label, featuresCol="log_p", maxIter=100, regParam=.01,
                                    family="binomial" if classes == 2 else "multinomial",
                                    probabilityCol="calibrated", rawPredictionCol="calibrated_raw",
                                    predictionCol="calibrated_prediction").fit(block)
    if block.select(label).distinct().count() != classes:
        raise ValueError("a class is missing from the calibration block")
    test = transform(of(data, "test")).select(
        "match_id", "innings", "over_number", F.col(label).cast("bigint").alias("y"), "probability", log_probabilities().alias("log_p"))
    return calibrator.transform(test).select(
        "match_id", "innings", "over_number", F.lit(task).alias("task"), "y",
        vector_to_array("probability").alias("raw"), vector_to_array("calibrated").alias("calibrated"))


def probability_scores(rows: DataFrame) -> DataFrame:
    """Log loss and Brier score before and after calibration, long over the two versions."""
    long = rows.select("task", "y", F.explode(F.array(
        F.struct(F.lit("raw").alias("version"), F.col("raw").alias("probs")),
        F.struct(F.lit("calibrated").alias("version"), F.col("calibrated").alias("probs")))).alias("v")).select("task", "y", "v.*")
    return m.probabilistic_scores(long, ["task", "version"])


def component_scores(df: DataFrame) -> DataFrame:
    """One regressor per component, reconciled to the total forecast, error per component."""
    data = assembled(df)
    test = of(data, "test")
    fitted = of(data, *FITTED)
    names = [*COMPONENTS, "bowler_conceded"]
    for name, label in [("total", TARGET), *[(n, f"target_{n}") for n in names]]:
        model = LinearRegression(labelCol=label, featuresCol="features", regParam=.1, predictionCol=f"_{name}").fit(fitted)
        test = model.transform(test)
    total = F.greatest(F.lit(0.0), F.col("_total"))
    parts = reconcile(total, {n: F.col(f"_{n}") for n in COMPONENTS}, F.col("_bowler_conceded"))
    cells = F.array(*[F.struct(F.lit(n).alias("component"), F.col(f"target_{n}").alias("y"), parts[n].alias("p")) for n in names])
    long = test.select(F.explode(cells).alias("c")).select("c.*")
    return m.regression_metrics(long, ["component"], median=False)


# --- scores of every feature ------------------------------------------------------------------

def standard_scores(data: DataFrame, schema: str, batch: Callable) -> DataFrame:
    """z-scores of every number with the moments of the training rows, as ``operators.encode.standardize`` has them.

    ``batch(row keys, partitions, names, scores)`` makes the arrays of one Arrow batch of ``schema``. A row is one vector, so its
    cost does not depend on how Spark compiles hundreds of column expressions.
    """
    every, names = features_of(data), numbers_of(data)
    held = [every.index(x) for x in names]
    got = of(data, "train").agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).first()["s"]     # one row
    mean = got["mean"].toArray()[held]
    sigma = np.sqrt(got["variance"].toArray()[held] * ((got["count"] - 1) / got["count"]))
    sigma[sigma < SIGMA_FLOOR] = 1.0
    limit, width = float(CLIP_SIGMAS), len(every)

    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[:, held]
            yield pa.RecordBatch.from_arrays(*batch(b.column(0), b.column(1), names, np.clip((x - mean) / sigma, -limit, limit)))

    return data.select(row_key().alias("row_key"), "partition", vector_to_array("features").alias("_v")).mapInArrow(run, schema)


def score_columns(data: DataFrame) -> DataFrame:
    """(row_key, partition, rounded z-score of every number)."""
    names, rounded = numbers_of(data), half_up()

    def batch(keys, partitions, columns, z):
        return [keys, partitions, *[pa.array(v) for v in np.ascontiguousarray(rounded(z).T)]], ["row_key", "partition", *columns]

    return standard_scores(data, ", ".join(["row_key string", "partition string", *[f"`{x}` double" for x in names]]), batch)


def largest_scores(data: DataFrame, k: int = 3) -> DataFrame:
    """(row_key, partition, feature, rank, contribution): the k largest |z| of each row, ties by name."""
    rounded = half_up()

    def batch(keys, partitions, columns, z):
        order = np.argsort(columns)
        z, rows, found = z[:, order], np.arange(len(z)), []
        size = np.abs(z)
        for _ in range(min(k, len(columns))):
            best = size.argmax(axis=1)                  # the first of equal ones
            found.append(best)
            size[rows, best] = -1
        best = np.stack(found, axis=1)
        each = np.repeat(rows, best.shape[1])
        feature = pa.array(np.asarray(columns, dtype=object)[order][best.ravel()], pa.string())
        rank = pa.array(np.tile(np.arange(1, best.shape[1] + 1), len(rows)))
        return [keys.take(pa.array(each)), partitions.take(pa.array(each)), feature, rank, pa.array(rounded(z[each, best.ravel()]))], \
            ["row_key", "partition", "feature", "rank", "contribution"]

    return standard_scores(data, "row_key string, partition string, feature string, rank bigint, contribution double", batch)


# --- user models ----------------------------------------------------------------------------

def score_with(df: DataFrame, columns: Sequence[str], scorer: Callable, keep: Sequence[str], out: str = "p") -> DataFrame:
    """Apply a user's ``scorer(pandas frame) -> array`` to Arrow batches."""
    schema = df.select(*keep).schema.add(out, "double")
    names = list(columns)

    def run(batches):
        for pdf in batches:
            result = pdf[list(keep)].copy()
            result[out] = scorer(pdf[names])
            yield result

    return df.select(*dict.fromkeys([*keep, *names])).mapInPandas(run, schema)


def linear_scorer(model, columns: Sequence[str]) -> Callable:
    """Scorer of a fitted linear model (coefficients only travel to the tasks); ``weights`` tells what one column adds to a score."""
    weights, intercept = model.coefficients.toArray(), float(model.intercept)
    names = list(columns)

    def score(pdf):
        return pdf[names].to_numpy(dtype=float) @ weights + intercept

    score.weights = dict(zip(names, weights.tolist()))
    return score


#: Rows that exchange values with each other.
PERMUTED_TOGETHER = 2000


def permutation_importance(df: DataFrame, features: Sequence[str], y: str, scorer: Callable, key: Sequence[str],
                           repeats: int = 3, seed: int = SEED) -> DataFrame:
    """Mean and deviation of the error increase when one feature's values change hands.

    Hashes of the row key deal the rows into groups of bounded size and order each group anew for every feature and
    repeat, so the exchange is the same however the table is partitioned. A group returns only error sums. With a scorer that
    names its ``weights`` only the exchanged column is scored again, not all columns for each of them.
    """
    names, keys = list(features), list(key)
    groups = max(1, df.count() // PERMUTED_TOGETHER)
    weights = getattr(scorer, "weights", None)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h", kind="stable")
        truth, x = pdf[y].to_numpy(dtype=float), pdf[names].copy()
        scored, out = scorer(x), []
        base = np.abs(truth - scored).sum()
        marks = pdf["_h"].to_numpy()
        for i, name in enumerate(names):
            original = x[name].to_numpy(copy=True)
            for r in range(repeats):
                order = pd.util.hash_array(marks ^ np.int64(1 + i * repeats + r)).argsort(kind="stable")
                if weights:
                    changed = scored + weights[name] * (original[order].astype(float) - original)
                else:
                    x[name] = original[order]
                    changed = scorer(x)
                out.append((name, r, np.abs(truth - changed).sum(), base, len(truth)))
            if not weights:
                x[name] = original
        return pd.DataFrame(out, columns=["feature", "repeat", "shuffled", "base", "n"])

    marked = df.select(y, *names, F.xxhash64(*keys, F.lit(seed)).alias("_h"))
    sums = marked.groupBy(F.pmod(F.xxhash64("_h"), F.lit(groups)).alias("_g")).applyInPandas(
        lambda pdf: partial(pdf), "feature string, repeat int, shuffled double, base double, n bigint")
    per = sums.groupBy("feature", "repeat").agg(((F.sum("shuffled") - F.sum("base")) / F.sum("n")).alias("d"))
    return per.groupBy("feature").agg(F.avg("d").alias("mae_increase"), F.stddev_pop("d").alias("std"))
