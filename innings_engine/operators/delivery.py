"""Delivery-level rows: in-over state, striker slots and outcome structure."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cricket as k
from ..sources.delivery_log import OVER_KEY
from .metrics import same_group
from .ordered import exact_quantiles
from .windows import running_state, with_opening_pair

# Fixed quantiles reported of an outcome distribution.
OUTCOME_QUANTILES = {"p2_5": .025, "p10": .10, "p20": .20, "p25": .25, "p50": .50, "p75": .75, "p80": .80,
                     "p90": .90, "p95": .95, "p97_5": .975}


def in_over_columns() -> dict[str, Column]:
    """What has happened in the over before each ball."""
    w = W.partitionBy(*OVER_KEY).orderBy("ball_number").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    return {
        "legal_in_over": so_far("legal"), "balls_in_over": F.col("ball_number") - 1,
        "runs_in_over": so_far("runs_total"), "wickets_in_over": so_far(k.flag(F.col("wicket") > 0)),
        "boundaries_in_over": so_far("boundary"), "sixes_in_over": so_far("six"),
    }


def rule_slots(log: DataFrame) -> DataFrame:
    """Striker slot by comparison with the opening pair.

    Equal to the ordered rule except when an opening batter returns after a replacement has
    taken that batter's place; :func:`tracked_slots` follows the order exactly.
    """
    c = F.col
    slot = F.when(c("batter") == c("opener"), "batter").when(c("batter") == c("partner"), "non_striker") \
        .otherwise("replacement")
    w = W.partitionBy(*OVER_KEY, "batter").orderBy("ball_number").rowsBetween(W.unboundedPreceding, -1)
    return with_opening_pair(log).select(
        *OVER_KEY, "ball_number", "batter", slot.alias("striker_slot"),
        F.coalesce(F.sum("runs_batter").over(w), F.lit(0)).alias("striker_live_runs"),
        F.coalesce(F.sum("batter_ball").over(w), F.lit(0)).alias("striker_live_balls"))


def tracked_slots(log: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Striker slot and live tallies by the ordered rule, ends tracked by name; ``carry`` names further columns of a ball.

    A fold over the balls of each over, which are a handful: the end on strike, the other end, and the rows so far.
    """
    types = {f.name: f.dataType.simpleString() for f in log.schema}
    end = "struct<name:string,slot:string,runs:bigint,balls:bigint>"
    row = ("struct<ball_number:int,batter:string,striker_slot:string,striker_live_runs:bigint,striker_live_balls:bigint,"
           "other_live_runs:bigint,other_live_balls:bigint" + "".join(f",{x}:{types[x]}" for x in carry) + ">")
    balls = log.groupBy(*OVER_KEY).agg(F.array_sort(F.collect_list(
        F.struct(*dict.fromkeys(["ball_number", "batter", "non_striker", "runs_batter", "batter_ball", *carry])))).alias("balls"))
    first = F.element_at("balls", 1)
    fresh = lambda name, slot: F.struct(name.alias("name"), F.lit(slot).alias("slot"), F.lit(0).cast("bigint").alias("runs"),
                                        F.lit(0).cast("bigint").alias("balls")).cast(end)

    def step(acc: Column, ball: Column) -> Column:
        stays, turns = ball["batter"].eqNullSafe(acc["on"]["name"]), ball["batter"].eqNullSafe(acc["off"]["name"])
        on = F.when(stays, acc["on"]).when(turns, acc["off"]).otherwise(fresh(ball["batter"], "replacement"))
        off = F.when(~stays & turns, acc["on"]).otherwise(acc["off"])
        seen = F.struct(ball["ball_number"], ball["batter"], on["slot"], on["runs"], on["balls"], off["runs"], off["balls"],
                        *[ball[x] for x in carry]).cast(row)
        after = F.struct(on["name"], on["slot"], on["runs"] + ball["runs_batter"], on["balls"] + ball["batter_ball"]).cast(end)
        return F.struct(after.alias("on"), off.alias("off"), F.concat(acc["rows"], F.array(seen)).alias("rows"))

    start = F.struct(fresh(first["batter"], "batter").alias("on"), fresh(first["non_striker"], "non_striker").alias("off"),
                     F.array().cast(f"array<{row}>").alias("rows"))
    return balls.select(*OVER_KEY, F.inline(F.aggregate("balls", start, step, lambda acc: acc["rows"])))


def delivery_dataset(log: DataFrame, overs: DataFrame) -> DataFrame:
    """One row per ball: over context, in-over state and the four outcome classes.

    Balls of overs without a context row (not usable, or before the bootstrap) are left out.
    """
    c = F.col
    context = overs.drop(*[x for x in overs.columns if x.startswith("target_")])
    balls = running_state(log).select(
        *OVER_KEY, "ball_number", "batter", "runs_batter", "runs_extras", "wides", "noballs", "wicket",
        c("current_score").alias("live_score"), c("current_wickets").alias("live_wickets"),
        c("legal_balls_before").alias("live_legal"), c("target").alias("live_target"),
        *[v.alias(n) for n, v in in_over_columns().items()])
    chase = k.chase_columns(c("live_target"), c("live_score"), c("live_legal"), c("live_wickets"))
    taken = set(context.columns)
    rows = balls.select(
        *OVER_KEY, "ball_number", c("batter").alias("striker"),
        "legal_in_over", "balls_in_over", (c("balls_in_over") - c("legal_in_over")).alias("illegal_in_over"),
        "runs_in_over", "wickets_in_over", "boundaries_in_over", "sixes_in_over", "live_score", "live_wickets", "live_legal",
        *[v.alias(f"live_{n}") for n, v in chase.items()],
        k.run_class(c("runs_batter")).alias("target_runs"), k.extra_class(c("runs_extras")).alias("target_extras"),
        k.legality_class(c("wides"), c("noballs")).alias("target_legality"), k.flag(c("wicket") > 0).alias("target_wicket"))
    clash = [x for x in rows.columns if x in taken and x not in OVER_KEY]
    return rows.join(context.drop(*clash).hint("merge"), OVER_KEY)     # a written log is far larger than its files: never broadcast


# Statistics of whoever is on strike, and the context of the over that every ball keeps.
STRIKER_STATS = (
    "career_strike_rate", "career_boundary_rate", "career_six_rate", "career_dot_rate", "career_balls", "career_average",
    "season_strike_rate", "season_boundary_rate", "innings_runs", "innings_balls", "innings_sr",
    "ewma0_15_runs_per_ball", "ewma0_15_boundary_rate", "ewma0_15_dot_rate", "ewma0_4_runs_per_ball", "ewma0_4_boundary_rate",
    "powerplay_sr", "middle_sr", "death_sr", "matchup_strike_rate", "matchup_balls", "matchup_boundary_rate", "matchup_dot_rate",
    "sr_vs_era", "mean_position", "position_now")
BALL_CONTEXT = (
    "chase_target", "venue_run_rate", "venue_phase_run_rate", "venue_boundary_rate", "venue_wicket_rate", "venue_over_run_rate",
    "era_strike_rate", "era_economy", "team_run_rate", "opposition_run_rate", "bowler_career_economy", "bowler_career_dot_rate",
    "bowler_career_boundary_rate", "bowler_career_six_rate", "bowler_career_balls", "bowler_season_economy",
    "bowler_powerplay_economy", "bowler_middle_economy", "bowler_death_economy", "bowler_ewma0_15_economy",
    "bowler_ewma0_4_economy", "bowler_economy_vs_era", "bowler_match_economy", "bowler_overs_bowled_this_match")
BALL_NAMES = ("phase", "bowler", "venue", "team_batting", "team_bowling")
#: A replacement has no record in the row of the over: the league's strike rate, position seven and zeros stand for it.
UNKNOWN_POSITION, UNKNOWN_STRIKE_RATE = 7.0, 125.0


def striker_samples(log: DataFrame, overs: DataFrame) -> DataFrame:
    """One row per ball of every usable over: 81 inputs of an outcome model and four outcome classes.

    The statistics of the batter on strike are gathered by the tracked slot from the row of the over; within the over only
    earlier balls count. The log is shuffled once, by over: fold, tallies and the join with the overs share it.
    """
    c = F.col
    outcome = ("runs_batter", "runs_extras", "runs_total", "wides", "noballs", "wicket", "legal", "boundary", "six")
    balls = tracked_slots(log, outcome)
    balls = balls.select(
        *OVER_KEY, "ball_number", c("batter").alias("striker"), "striker_slot",
        "striker_live_runs", "striker_live_balls", "other_live_runs", "other_live_balls", *[v.alias(n) for n, v in in_over_columns().items()],
        k.run_class(c("runs_batter")).alias("target_runs"), k.extra_class(c("runs_extras")).alias("target_extras"),
        k.legality_class(c("wides"), c("noballs")).alias("target_legality"), k.flag(c("wicket") > 0).alias("target_wicket"))
    roles = [f"{r}_{s}" for r in ("batter", "non_striker") for s in STRIKER_STATS]
    state = ["current_score", "current_wickets", "legal_balls_before"]
    context = overs.select(*OVER_KEY, "date", "season", *BALL_CONTEXT, *BALL_NAMES,
                           *[c(x).alias(f"_{x}") for x in (*roles, *state)])
    rows = balls.join(context.hint("merge"), OVER_KEY)     # a written log is far larger than its files: never broadcast

    era = F.when(c("era_strike_rate") != 0, c("era_strike_rate")).otherwise(UNKNOWN_STRIKE_RATE)
    unknown = {"career_strike_rate": era, "sr_vs_era": F.lit(1.0), "mean_position": F.lit(UNKNOWN_POSITION), "position_now": F.lit(UNKNOWN_POSITION)}

    def on_strike(stat: str) -> Column:
        own = lambda role: F.coalesce(c(f"_{role}_{stat}").cast("double"), F.lit(0.0))
        return F.when(c("striker_slot") == "batter", own("batter")).when(c("striker_slot") == "non_striker", own("non_striker")) \
            .otherwise(unknown.get(stat, F.lit(0.0)))

    rows = rows.withColumns({
        "current_score": c("_current_score") + c("runs_in_over"), "current_wickets": c("_current_wickets") + c("wickets_in_over"),
        "legal_balls_innings": c("_legal_balls_before") + c("legal_in_over")})
    chase = k.chase_columns(F.coalesce(c("chase_target"), F.lit(0)), c("current_score"), c("legal_balls_innings"), c("current_wickets"))
    chase["balls_remaining"] = F.greatest(F.lit(0), chase["balls_remaining"])
    kept = ("wickets_remaining", "balls_remaining", "current_run_rate", "runs_required", "required_run_rate",
            "required_minus_current_rate", "required_runs_per_wicket")
    tallies = ("legal_in_over", "balls_in_over", "runs_in_over", "wickets_in_over", "boundaries_in_over", "sixes_in_over")
    return rows.select(
        *OVER_KEY, "ball_number", "striker", "date", "season", *BALL_CONTEXT, *BALL_NAMES,
        *[on_strike(x).alias(f"striker_{x}") for x in STRIKER_STATS],
        "striker_slot", k.flag(c("striker_slot") == "replacement").alias("striker_is_replacement"),
        *tallies, (c("balls_in_over") - c("legal_in_over")).alias("illegal_in_over"),
        "current_score", "current_wickets", "legal_balls_innings", *[chase[x].alias(x) for x in kept],
        "striker_live_runs", "striker_live_balls", (100 * c("striker_live_runs") / k.at_least(c("striker_live_balls"))).alias("striker_live_sr"),
        "other_live_runs", "other_live_balls", "target_runs", "target_extras", "target_legality", "target_wicket")


def joint_structure(log: DataFrame) -> DataFrame:
    """How wickets and extras depend on runs and legality, as (measure, key, value) rows."""
    c = F.col
    out = k.flag(c("wicket") > 0)
    extra = k.flag(c("runs_extras") > 0)
    kind = F.when(c("wides") > 0, "wide").when(c("noballs") > 0, "noball").otherwise("legal")
    runs = F.when((c("wides") == 0) & (c("noballs") == 0), F.greatest(F.least(c("runs_batter"), F.lit(6)), F.lit(0))).otherwise(-1)
    cells = log.groupBy(kind.alias("kind"), runs.alias("key"), (c("noballs") > 0).alias("has_noball")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(out).alias("w"), F.sum(extra).alias("x"))
    # At most a dozen cells from here on.
    base = cells.agg(F.sum("w") / F.sum("n")).scalar()
    ratio = lambda a, b: F.when(b > 0, a / b)
    lift = lambda v: F.when(c("base") > 0, v / c("base")).otherwise(0.0)
    legal = cells.filter("kind = 'legal'").groupBy("key").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("x").alias("x"))
    rows = legal.withColumn("base", base).select(F.explode(F.array(
        F.struct(F.lit("wicket_lift_by_runs").alias("measure"), c("key").cast("bigint").alias("key"), lift(ratio(c("w"), c("n"))).alias("value")),
        F.struct(F.lit("extras_probability_by_runs").alias("measure"), c("key").cast("bigint").alias("key"), ratio(c("x"), c("n")).alias("value")),
    )).alias("r")).select("r.*")
    total = lambda m, cond: F.sum(F.when(cond, c(m)).otherwise(0))
    wide, noball = c("kind") == "wide", c("has_noball")
    whole = cells.agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), total("n", wide).alias("wn"), total("w", wide).alias("ww"),
        total("x", wide).alias("wx"), total("n", noball).alias("nn"), total("w", noball).alias("nw"), total("x", noball).alias("nx")) \
        .withColumn("base", c("w") / c("n"))
    single = {"base_wicket_rate": c("base"), "wicket_lift_wide": lift(ratio(c("ww"), c("wn"))),
              "wicket_lift_noball": lift(ratio(c("nw"), c("nn"))), "extras_given_wide": ratio(c("wx"), c("wn")),
              "extras_given_noball": ratio(c("nx"), c("nn")), "n_deliveries": c("n").cast("double")}
    flat = whole.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.lit(0).cast("bigint").alias("key"), v.alias("value")) for n, v in single.items()])).alias("r")).select("r.*")
    return rows.unionByName(flat)


def distribution_summary(df: DataFrame, group: list[str], value: str, events: Mapping[str, Column] | None = None,
                         means: Mapping[str, Column] | None = None) -> DataFrame:
    """Mean, mode, quantiles, bucket and tail probabilities of a table of outcomes per group."""
    v = F.col(value)
    share = lambda cond: F.avg(cond.cast("double"))
    bucket = k.run_bucket(v)
    main = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("draws"), F.avg(v).alias("expected_runs"),
        *[share(bucket == i).alias(f"bucket_{i}") for i in range(len(k.RUN_BUCKET_NAMES))],
        *[share(v >= t).alias(f"probability_{t}_plus") for t in (10, 15, 20)],
        *[share(c).alias(f"{n}_probability") for n, c in (events or {}).items()],
        *[F.avg(c).alias(f"expected_{n}") for n, c in (means or {}).items()])
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy(*group).agg(F.max_by(v, F.struct("_n", -v)).alias("mode_runs"))
    return same_group(same_group(main, mode, group), exact_quantiles(df, group, value, OUTCOME_QUANTILES), group)


def spread_convergence(records: DataFrame, watched: list[str], tolerance: float) -> DataFrame:
    """Mean over states of the seed-to-seed deviation per setting, and the setting chosen.

    ``records`` has one row per (draws, state, seed). The choice is the smallest setting whose
    watched spreads are all within tolerance, else the largest.
    """
    per_state = records.groupBy("draws", "state").agg(*[F.stddev_samp(c).alias(c) for c in watched])
    spread = per_state.groupBy("draws").agg(*[F.avg(c).alias(f"{c}_spread") for c in watched])
    good = F.lit(True)
    for c in watched:
        good = good & (F.col(f"{c}_spread") <= tolerance)
    chosen = spread.agg(F.coalesce(F.min(F.when(good, F.col("draws"))), F.max("draws"))).scalar()
    return spread.withColumn("chosen", (F.col("draws") == chosen).cast("bigint"))
