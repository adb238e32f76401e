"""Within-innings state: every window is partitioned by match (and innings) and bounded by it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cricket as k
from ..sources.delivery_log import OVER_KEY

INNINGS = ["match_id", "innings"]
BALL_SPAN = 1_000_000          # (over, ball) as one integer keeps the aggregation hash-based


def _by(*columns: str):
    return W.partitionBy(*columns)


def _so_far(window, value: Column | str) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def state_columns(runs: str, wickets: str, legal: str, order: list[str]) -> list[Column]:
    """State of an innings before each row of it in ``order`` (balls, or whole overs), and the chase target."""
    w = _by(*INNINGS).orderBy(*order)
    first_total = F.sum(F.when(F.col("innings") == 1, F.col(runs))).over(_by("match_id"))
    return [
        _so_far(w, runs).alias("current_score"), _so_far(w, wickets).alias("current_wickets"), _so_far(w, legal).alias("legal_balls_before"),
        F.when(F.col("innings") == 2, 1 + F.coalesce(first_total, F.lit(0))).otherwise(0).cast("bigint").alias("target")]


def running_state(log: DataFrame) -> DataFrame:
    """Score, wickets and legal balls before each ball, and the chase target."""
    return log.select("*", *state_columns("runs_total", "wicket", "legal", ["over_number", "ball_number"]))


def over_totals(log: DataFrame) -> DataFrame:
    return log.groupBy(*OVER_KEY).agg(
        F.sum("runs_total").alias("runs"), F.sum("wicket").alias("wickets"),
        F.sum("boundary").alias("boundaries"), F.sum("six").alias("sixes"),
        F.sum("legal").alias("legal"))


def momentum_over_columns(spans=(1, 2, 3, 5)) -> list[Column]:
    """Sums over the previous n over numbers of the innings, on a table with over totals."""
    w = _by(*INNINGS).orderBy("over_number")
    names = ["runs", "wickets", "boundaries", "sixes"]
    return [F.coalesce(F.sum(m).over(w.rangeBetween(-n, -1)), F.lit(0)).alias(f"{m}_last_{n}_overs")
            for n in spans for m in names]


def momentum_overs(log: DataFrame) -> DataFrame:
    return over_totals(log).select(*OVER_KEY, *momentum_over_columns())


def with_momentum_balls(df: DataFrame, spans=(6, 12, 18, 24)) -> DataFrame:
    """Runs and dot rate over the previous n deliveries, wides and no-balls included.

    A sliding sum is the difference of two running sums, so each row costs the same
    whatever the span.
    """
    w = _by(*INNINGS).orderBy("over_number", "ball_number")
    summed = df.select(
        "*", _so_far(w, "runs_total").alias("_runs"), (F.row_number().over(w) - 1).alias("_seen"),
        _so_far(w, k.flag(F.col("runs_total") == 0)).alias("_dots"))
    out = []
    for n in spans:
        last = lambda col: F.col(col) - F.coalesce(F.lag(col, n).over(w), F.lit(0))
        out += [last("_runs").alias(f"runs_last_{n}_deliveries"),
                (last("_dots") / k.at_least(F.least("_seen", F.lit(n)))).alias(f"dot_rate_last_{n}_deliveries")]
    return summed.select(*df.columns, *out)


def ball_lag_columns(lags: int = 12) -> list[Column]:
    """The last deliveries one by one; -1 where the innings has not had that many."""
    w = _by(*INNINGS).orderBy("over_number", "ball_number")
    named = [("runs", "runs_total"), ("wicket", "wicket"), ("boundary", "boundary")]
    return [F.lag(column, lag, -1).over(w).alias(f"ball_minus_{lag}_{name}")
            for lag in range(1, lags + 1) for name, column in named]


def over_starts(log: DataFrame) -> DataFrame:
    """Opening state of each over: the row of its first ball."""
    return log.filter(F.col("ball_number") == 1)


def innings_so_far(log: DataFrame) -> DataFrame:
    """Both batters' and the bowler's figures in this innings before the over starts.

    Each ball yields a narrow fact for its batter and its bowler; the first ball of an over
    also yields a zero-valued row for the non-striker, who may not face in it. Facts are
    combined per over before the only sort.
    """
    c = F.col
    first = c("ball_number") == 1
    zero = F.lit(0).cast("int")

    def entry(player: Column, side: str, mark: Column, *values: Column) -> Column:
        return F.struct(player.alias("player"), F.lit(side).alias("side"), mark.alias("mark"),
                        *[v.cast("int").alias(n) for n, v in zip(("a", "b", "c"), values)])

    # mark: 1 = opens the over in this role, 2 = non-striker at its start
    batting = entry(c("batter"), "bat", k.flag(first), c("runs_batter"), c("batter_ball"), zero)
    bowling = entry(c("bowler"), "bowl", k.flag(first), c("legal"), c("bowler_conceded"), c("bowler_wicket"))
    partner = entry(c("non_striker"), "bat", F.lit(2), zero, zero, zero)
    events = log.select(*OVER_KEY, F.explode(
        F.when(first, F.array(batting, bowling, partner)).otherwise(F.array(batting, bowling))).alias("e")).select(*OVER_KEY, "e.*")
    per_over = events.groupBy(*OVER_KEY, "side", "player").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"),
        F.max((c("mark") == 1).cast("int")).alias("opens"), F.max((c("mark") == 2).cast("int")).alias("partners"))
    w = _by(*INNINGS, "side", "player").orderBy("over_number")
    seen = per_over.select(*OVER_KEY, "side", "opens", "partners", *[_so_far(w, x).alias(x) for x in ("a", "b", "c")])
    columns = []
    for role, mark in (("batter", "opens"), ("non_striker", "partners")):
        own = lambda m: F.max(F.when((c("side") == "bat") & (c(mark) == 1), c(m)))
        columns += [own("a").alias(f"{role}_innings_runs"), own("b").alias(f"{role}_innings_balls"),
                    (100 * own("a") / k.at_least(own("b"))).alias(f"{role}_innings_sr")]
    spell = lambda m: F.max(F.when((c("side") == "bowl") & (c("opens") == 1), c(m)))
    legal = spell("a")
    columns += [legal.alias("bowler_match_legal_balls"), spell("b").alias("bowler_match_conceded"),
                spell("c").alias("bowler_match_wickets"), (6 * spell("b") / k.at_least(legal)).alias("bowler_match_economy"),
                (legal / 6).alias("bowler_overs_bowled_this_match"),
                F.greatest(F.lit(0.0), k.OVERS_PER_BOWLER - legal / 6).alias("bowler_overs_remaining_quota")]
    return seen.groupBy(*OVER_KEY).agg(*columns)


def batting_order(log: DataFrame) -> DataFrame:
    """Order in which players first face a ball: one row per (innings, batter)."""
    first = log.groupBy(*INNINGS, "batter").agg(
        F.min("date").alias("date"),
        F.min(F.col("over_number").cast("bigint") * BALL_SPAN + F.col("ball_number")).alias("first_ball"))
    w = _by(*INNINGS).orderBy("first_ball")
    return first.select(*INNINGS, "date", "batter", F.floor(F.col("first_ball") / BALL_SPAN).cast("int").alias("first_over"),
                        F.row_number().over(w).alias("position"))


def position_now(log: DataFrame) -> DataFrame:
    """Known batting position at over start, else the next free one (at least 1 or 2).

    Tables per innings or over grow with the log, whose files are far smaller than its rows: no side is broadcast.
    """
    order = batting_order(log)
    starts = over_starts(log).select(*OVER_KEY, "batter", "non_striker")
    new_by_over = order.groupBy(*INNINGS, F.col("first_over").alias("over_number")).agg(
        F.count(F.lit(1)).alias("new_players"))
    seen = starts.join(new_by_over.hint("merge"), OVER_KEY, "left").select(
        *OVER_KEY, "batter", "non_striker",
        _so_far(_by(*INNINGS).orderBy("over_number"), "new_players").alias("seen"))
    out = seen
    for role, fallback in (("batter", 1), ("non_striker", 2)):
        known = order.select(*INNINGS, F.col("batter").alias(role), F.col("first_over").alias("_first"),
                             F.col("position").alias("_pos"))
        out = out.join(known.hint("merge"), [*INNINGS, role], "left").withColumn(
            f"{role}_position_now",
            F.when(F.col("_first") < F.col("over_number"), F.col("_pos"))
            .otherwise(F.greatest(F.col("seen") + 1, F.lit(fallback))).cast("bigint")).drop("_first", "_pos")
    return out.select(*OVER_KEY, "batter_position_now", "non_striker_position_now")


def target_columns(opener: str = "opener", partner: str = "partner") -> list[Column]:
    """Outcome of an over, runs split by the opening pair's roles (aggregates of ball rows)."""
    c = F.col
    striker, other = c("batter") == c(opener), c("batter") == c(partner)
    total = F.sum("runs_total")
    when_sum = lambda cond, col: F.coalesce(F.sum(F.when(cond, c(col))), F.lit(0))
    return [
        total.alias("target_next_over_runs"),
        k.run_bucket(total).cast("bigint").alias("target_run_bucket"),
        k.flag(F.max("wicket") > 0).cast("bigint").alias("target_wicket"),
        k.flag(F.max("boundary") > 0).cast("bigint").alias("target_boundary"),
        k.flag(F.max("six") > 0).cast("bigint").alias("target_six"),
        k.flag(total >= 10).cast("bigint").alias("target_ten_plus"),
        F.sum("runs_extras").alias("target_extras"),
        F.sum("bowler_conceded").alias("target_bowler_conceded"),
        when_sum(~striker & ~other, "runs_batter").alias("target_other_batters"),
        when_sum(striker, "runs_batter").alias("target_batter_runs"),
        when_sum(striker, "batter_ball").alias("target_batter_balls"),
        when_sum(other, "runs_batter").alias("target_non_striker_runs"),
        when_sum(other, "batter_ball").alias("target_non_striker_balls"),
    ]


def with_opening_pair(df: DataFrame) -> DataFrame:
    w = _by(*OVER_KEY).orderBy("ball_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.select("*", F.first("batter").over(w).alias("opener"), F.first("non_striker").over(w).alias("partner"))


def over_targets(log: DataFrame) -> DataFrame:
    return with_opening_pair(log).groupBy(*OVER_KEY).agg(*target_columns())


CHANNELS = ["runs_total", "runs_batter", "wicket", "boundary", "six", "legal", "runs_extras",
            "batter_ball", "same_bowler", "same_striker", "ball_share", "over_gap"]


def sequence_windows(log: DataFrame, size: int = 24) -> DataFrame:
    """Per over: the last ``size`` earlier deliveries x 12 channels, oldest first, zeros in front."""
    w = _by(*INNINGS).orderBy("over_number", "ball_number").rowsBetween(-size, -1)
    ball = F.struct("runs_total", "runs_batter", "wicket", "boundary", "six", "legal", "runs_extras",
                    "batter_ball", "bowler", "batter", "ball_number", "over_number")
    held = log.select(*OVER_KEY, "ball_number", "bowler", "batter", F.collect_list(ball).over(w).alias("past")) \
        .filter(F.col("ball_number") == 1)
    plain = CHANNELS[:8]

    def channels(b: Column) -> Column:
        return F.array(
            *[b[name].cast("double") for name in plain],
            k.flag(b["bowler"] == F.col("bowler")).cast("double"),
            k.flag(b["batter"] == F.col("batter")).cast("double"),
            b["ball_number"] / 6.0,
            (F.col("over_number") - b["over_number"]) / 20.0)

    rows = F.transform("past", channels)
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), len(CHANNELS)), F.lit(size) - F.size("past"))
    return held.select(*OVER_KEY, F.concat(blank, rows).alias("sequence"))
