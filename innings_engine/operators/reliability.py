"""Reliability labels from model agreement and player history, and the promotion decision."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import exact_quantiles

# Fixed quantiles of the calibration block that become the cut points.
SUPPORT_LOW, SUPPORT_HIGH, SPREAD_LOW, SPREAD_HIGH = .25, .60, .40, .80
CUTS = ["support_low", "support_high", "spread_low", "spread_high"]
MAX_SUBGROUP_SHARE, MAX_ECE, MAX_COVERAGE_GAP, MAX_SEGMENT_LOSS = 0.9, 0.05, 0.05, 0.5


def spread(predictions: list[Column]) -> Column:
    """Population standard deviation across models."""
    k = len(predictions)
    mean = sum(predictions[1:], predictions[0]) / k
    square = sum((p * p for p in predictions[1:]), predictions[0] * predictions[0]) / k
    return F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))


def label(high: Column) -> Column:
    c = F.col
    return (F.when((c("support") < c("support_low")) | (c("spread") > c("spread_high")), "LOW")
            .when(high & (c("support") >= c("support_high")) & (c("spread") <= c("spread_low"))
                  & (c("batter_matchup_balls") > 0), "HIGH")
            .otherwise("MEDIUM"))


def _with_cuts(df: DataFrame, cuts: DataFrame) -> DataFrame:
    row = cuts.select(F.struct(*CUTS).alias("c")).scalar()
    return df.withColumn("_cuts", row).select("*", *[F.col("_cuts")[c].alias(c) for c in CUTS]).drop("_cuts")


def monotone() -> Column:
    """Aggregate: all three labels present and error rising from HIGH to LOW."""
    mae = lambda name: F.max(F.when(F.col("label") == name, F.col("mae")))
    return F.coalesce((mae("HIGH") < mae("MEDIUM")) & (mae("MEDIUM") < mae("LOW")), F.lit(False))


def fit(reference: DataFrame, error: Column) -> dict[str, DataFrame]:
    """Cut points of the reference block, and whether HIGH may be issued at all."""
    by_support = exact_quantiles(reference, [], "support", {"support_low": SUPPORT_LOW, "support_high": SUPPORT_HIGH})
    by_spread = exact_quantiles(reference, [], "spread", {"spread_low": SPREAD_LOW, "spread_high": SPREAD_HIGH})
    other = by_spread.select(F.struct("spread_low", "spread_high").alias("c")).scalar()
    cuts = by_support.withColumn("_o", other).select(
        "support_low", "support_high", F.col("_o.spread_low").alias("spread_low"), F.col("_o.spread_high").alias("spread_high"))
    trial = _with_cuts(reference, cuts).select(label(F.lit(True)).alias("label"), error.alias("_e"))
    ordered = trial.groupBy("label").agg(F.avg("_e").alias("mae")).agg(monotone().alias("ok"))
    return {"cuts": cuts, "high": ordered}


def apply(df: DataFrame, rule: dict[str, DataFrame]) -> DataFrame:
    return _with_cuts(df, rule["cuts"]).withColumn("high_enabled", rule["high"].scalar()) \
        .withColumn("label", label(F.col("high_enabled")))


def reason() -> Column:
    """Plain-language reason of a label, with the figures behind it."""
    c = F.col
    differ = F.concat(F.lit("models differ by "), F.round("spread", 2).cast("decimal(20,2)").cast("string"), F.lit(" runs"))
    thin, apart = c("support") < c("support_low"), c("spread") > c("spread_high")
    low = F.concat_ws(" and ", F.when(thin, F.concat(F.lit("least-seen player has "), c("support").cast("string"),
                                                     F.lit(" balls of history"))),
                      F.when(apart, differ))
    causes = F.concat_ws("; ", F.when(c("spread") > c("spread_low"), differ),
                         F.when(c("batter_matchup_balls") == 0, F.lit("the batter has not faced this bowler")),
                         F.when(c("support") < c("support_high"), F.concat(F.lit("least-seen player has "), c("support").cast("string"), F.lit(" balls of history"))))
    causes = F.when(causes == "", "ordering not verified").otherwise(causes)
    return (F.when(c("label") == "LOW", F.concat(F.lit("Wider than usual uncertainty: "), low))
            .when(c("label") == "HIGH", F.concat(F.lit("Every player has history, "), differ, F.lit(" and the batter has faced this bowler for "),
                                                 c("batter_matchup_balls").cast("bigint").cast("string"), F.lit(" balls")))
            .otherwise(F.concat(F.lit("Ordinary support: "), causes)))


def audit(rows: DataFrame) -> DataFrame:
    """Per label: size, error, interval width and coverage, and whether the order holds."""
    error = F.abs(F.col("y") - F.col("p"))
    inside = ((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("double")
    per = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"),
        F.avg(inside).alias("coverage"))
    return per.withColumn("ordering_holds", per.agg(monotone()).scalar())


def promotion_checks(mae: DataFrame, champion: str, candidate: str, gain: DataFrame, ece: DataFrame,
                     coverage: DataFrame) -> DataFrame:
    """(check, passed) rows and the final decision; every input is a small metric table but coverage."""
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("mae")))
    inside = ((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("double")
    share = lambda kind: F.avg(F.when(F.col("kind") == kind, inside))
    facts = mae.agg((of(candidate) < of(champion)).alias("candidate_beats_champion"))
    facts = facts.select(
        "candidate_beats_champion",
        gain.agg(F.coalesce(F.max("share"), F.lit(0.0)) <= MAX_SUBGROUP_SHARE).scalar().alias("improvement_not_from_one_subgroup"),
        ece.agg(F.max("ece") <= MAX_ECE).scalar().alias("calibration_not_degraded"),
        coverage.agg(F.abs(share("over_80") - .8) <= MAX_COVERAGE_GAP).scalar().alias("coverage_80_within_5_points"),
        coverage.agg(F.abs(share("over_95") - .95) <= MAX_COVERAGE_GAP).scalar().alias("coverage_95_within_5_points"),
        gain.agg(F.min(F.col("gain") / F.col("n")) >= -MAX_SEGMENT_LOSS).scalar().alias("no_catastrophic_segment_regression"))
    names = facts.columns
    every = F.lit(True)
    for n in names:
        every = every & F.col(n)
    cells = [F.struct(F.lit(n).alias("check"), F.col(n).cast("bigint").alias("passed")) for n in names]
    cells.append(F.struct(F.lit("promote").alias("check"), every.cast("bigint").alias("passed")))
    return facts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
