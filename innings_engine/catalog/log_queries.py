"""Delivery-log queries: scalar columns and within-innings windows."""
from pyspark.sql import functions as F

from ..functions import cricket as k
from ..operators import windows as w
from ..sources.delivery_log import OVER_KEY, delivery_log
from ..plans.forecast import staged_log
from .registry import cte, query


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def rounded(digits, *names):
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


def sql_big(*names):
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def sql_round(digits, *names):
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) AS {n}" for n in names)


LOG_INTS = ["season", "innings", "over_number", "ball_number", "wides", "noballs", "legbyes", "byes",
            "wicket", "bowler_wicket", "runs_batter", "legal", "batter_ball", "runs_extras",
            "runs_total", "bowler_conceded", "boundary", "six"]
LOG_STRINGS = ["match_id", "venue", "team_batting", "team_bowling", "batter", "non_striker", "bowler",
               "dismissed_player", "dismissal_type"]


@query("delivery_log", f"SELECT CAST(date AS VARCHAR) AS date, {', '.join(LOG_STRINGS)}, {sql_big(*LOG_INTS)} FROM fx")
def _delivery_log(spark, sf):
    log = delivery_log(spark, sf)
    return log.select(F.col("date").cast("string").alias("date"), *LOG_STRINGS, *big(*LOG_INTS))


@query("running_state", "SELECT match_id, " + sql_big(
    "innings", "over_number", "ball_number", "current_score", "current_wickets", "legal_balls_before",
    "target") + " FROM st")
def _running_state(spark, sf):
    return w.running_state(delivery_log(spark, sf)).select("match_id", *big(
        "innings", "over_number", "ball_number", "current_score", "current_wickets",
        "legal_balls_before", "target"))


@query("phase_bucket", """
SELECT phase, CASE WHEN t >= 20 THEN 5 WHEN t >= 15 THEN 4 WHEN t >= 11 THEN 3 WHEN t >= 8 THEN 2
  WHEN t >= 5 THEN 1 ELSE 0 END AS bucket, count(*) AS overs, CAST(sum(t) AS BIGINT) AS runs
FROM (SELECT match_id, innings, over_number, any_value(phase) AS phase, sum(runs_total) AS t
      FROM fx GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _phase_bucket(spark, sf):
    overs = w.over_totals(staged_log(spark, sf))
    return overs.groupBy(k.phase(F.col("over_number")).alias("phase"), k.run_bucket(F.col("runs")).alias("bucket")) \
        .agg(F.count(F.lit(1)).alias("overs"), F.sum("runs").alias("runs"))


# Opening batters of each over and the outcome of the over.
cte("opening", """
SELECT match_id, innings, over_number, date, season, venue, team_batting, team_bowling, batter, non_striker,
  bowler, phase, current_score, current_wickets, legal_balls_before, target
FROM st WHERE ball_number = 1""")
cte("tgt", """
SELECT f.match_id, f.innings, f.over_number,
  CAST(sum(runs_total) AS BIGINT) AS target_next_over_runs,
  CAST(CASE WHEN sum(runs_total) >= 20 THEN 5 WHEN sum(runs_total) >= 15 THEN 4 WHEN sum(runs_total) >= 11 THEN 3
       WHEN sum(runs_total) >= 8 THEN 2 WHEN sum(runs_total) >= 5 THEN 1 ELSE 0 END AS BIGINT) AS target_run_bucket,
  CAST(max(CASE WHEN wicket > 0 THEN 1 ELSE 0 END) AS BIGINT) AS target_wicket,
  CAST(max(boundary) AS BIGINT) AS target_boundary, CAST(max(six) AS BIGINT) AS target_six,
  CAST(CASE WHEN sum(runs_total) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS target_ten_plus,
  CAST(sum(runs_extras) AS BIGINT) AS target_extras,
  CAST(sum(bowler_conceded) AS BIGINT) AS target_bowler_conceded,
  CAST(sum(CASE WHEN f.batter NOT IN (o.batter, o.non_striker) THEN runs_batter ELSE 0 END) AS BIGINT) AS target_other_batters,
  CAST(sum(CASE WHEN f.batter = o.batter THEN runs_batter ELSE 0 END) AS BIGINT) AS target_batter_runs,
  CAST(sum(CASE WHEN f.batter = o.batter THEN batter_ball ELSE 0 END) AS BIGINT) AS target_batter_balls,
  CAST(sum(CASE WHEN f.batter = o.non_striker THEN runs_batter ELSE 0 END) AS BIGINT) AS target_non_striker_runs,
  CAST(sum(CASE WHEN f.batter = o.non_striker THEN batter_ball ELSE 0 END) AS BIGINT) AS target_non_striker_balls
FROM fx f JOIN opening o USING (match_id, innings, over_number) GROUP BY 1, 2, 3""")


@query("over_targets", "SELECT * REPLACE (CAST(innings AS BIGINT) AS innings, CAST(over_number AS BIGINT) AS over_number) FROM tgt")
def _over_targets(spark, sf):
    out = w.over_targets(delivery_log(spark, sf))
    return out.select("match_id", *big(*[c for c in out.columns if c != "match_id"]))


_MOMENTUM = [f"{m}_last_{n}_overs" for n in (1, 2, 3, 5) for m in ("runs", "wickets", "boundaries", "sixes")]


@query("momentum_overs", "WITH o AS (SELECT match_id, innings, over_number, sum(runs_total) AS runs, sum(wicket) AS wickets, "
       "sum(boundary) AS boundaries, sum(six) AS sixes FROM fx GROUP BY 1, 2, 3) "
       "SELECT a.match_id, CAST(a.innings AS BIGINT) AS innings, CAST(a.over_number AS BIGINT) AS over_number, " + ", ".join(
           f"CAST(coalesce(sum(CASE WHEN b.over_number >= a.over_number - {n} THEN b.{m} END), 0) AS BIGINT) AS {m}_last_{n}_overs"
           for n in (1, 2, 3, 5) for m in ("runs", "wickets", "boundaries", "sixes"))
       + " FROM o a LEFT JOIN o b ON a.match_id = b.match_id AND a.innings = b.innings AND b.over_number < a.over_number "
         "GROUP BY 1, 2, 3")
def _momentum_overs(spark, sf):
    return w.momentum_overs(staged_log(spark, sf)).select("match_id", *big("innings", "over_number", *_MOMENTUM))


cte("numbered", """
SELECT *, row_number() OVER (PARTITION BY match_id, innings ORDER BY over_number, ball_number) AS seq FROM fx""")


@query("momentum_balls", "SELECT a.match_id, CAST(a.innings AS BIGINT) AS innings, CAST(a.over_number AS BIGINT) AS over_number, "
       + ", ".join(
           f"CAST(coalesce(sum(CASE WHEN b.seq >= a.seq - {n} THEN b.runs_total END), 0) AS BIGINT) AS runs_last_{n}_deliveries, "
           f"round(CAST(count(CASE WHEN b.seq >= a.seq - {n} AND b.runs_total = 0 THEN 1 END) AS DOUBLE) / "
           f"greatest(count(CASE WHEN b.seq >= a.seq - {n} THEN 1 END), 1), 9) AS dot_rate_last_{n}_deliveries"
           for n in (6, 12, 18, 24))
       + " FROM numbered a LEFT JOIN numbered b ON a.match_id = b.match_id AND a.innings = b.innings AND b.seq < a.seq "
         "AND b.seq >= a.seq - 24 WHERE a.ball_number = 1 GROUP BY 1, 2, 3")
def _momentum_balls(spark, sf):
    out = w.over_starts(w.with_momentum_balls(staged_log(spark, sf)))
    return out.select("match_id", *big("innings", "over_number", *[f"runs_last_{n}_deliveries" for n in (6, 12, 18, 24)]),
                      *rounded(9, *[f"dot_rate_last_{n}_deliveries" for n in (6, 12, 18, 24)]))


_LAGS = [(lag, name, col) for lag in range(1, 13)
         for name, col in (("runs", "runs_total"), ("wicket", "wicket"), ("boundary", "boundary"))]


@query("ball_lags", "SELECT a.match_id, CAST(a.innings AS BIGINT) AS innings, CAST(a.over_number AS BIGINT) AS over_number, " + ", ".join(
    f"CAST(coalesce(max(CASE WHEN b.seq = a.seq - {lag} THEN b.{col} END), -1) AS BIGINT) AS ball_minus_{lag}_{name}"
    for lag, name, col in _LAGS)
    + " FROM numbered a LEFT JOIN numbered b ON a.match_id = b.match_id AND a.innings = b.innings AND b.seq < a.seq "
      "AND b.seq >= a.seq - 12 WHERE a.ball_number = 1 GROUP BY 1, 2, 3")
def _ball_lags(spark, sf):
    out = w.over_starts(staged_log(spark, sf).select(*OVER_KEY, "ball_number", *w.ball_lag_columns()))
    return out.select("match_id", *big("innings", "over_number", *[f"ball_minus_{lag}_{n}" for lag, n, _ in _LAGS]))


cte("insofar", """
SELECT o.match_id, o.innings, o.over_number, o.batter, o.non_striker,
  CAST(coalesce(sum(CASE WHEN f.batter = o.batter THEN f.runs_batter END), 0) AS BIGINT) AS batter_innings_runs,
  CAST(coalesce(sum(CASE WHEN f.batter = o.batter THEN f.batter_ball END), 0) AS BIGINT) AS batter_innings_balls,
  CAST(coalesce(sum(CASE WHEN f.batter = o.non_striker THEN f.runs_batter END), 0) AS BIGINT) AS non_striker_innings_runs,
  CAST(coalesce(sum(CASE WHEN f.batter = o.non_striker THEN f.batter_ball END), 0) AS BIGINT) AS non_striker_innings_balls,
  CAST(coalesce(sum(CASE WHEN f.bowler = o.bowler THEN f.legal END), 0) AS BIGINT) AS bowler_match_legal_balls,
  CAST(coalesce(sum(CASE WHEN f.bowler = o.bowler THEN f.bowler_conceded END), 0) AS BIGINT) AS bowler_match_conceded,
  CAST(coalesce(sum(CASE WHEN f.bowler = o.bowler THEN f.bowler_wicket END), 0) AS BIGINT) AS bowler_match_wickets
FROM opening o LEFT JOIN fx f ON f.match_id = o.match_id AND f.innings = o.innings AND f.over_number < o.over_number
GROUP BY 1, 2, 3, 4, 5""")


@query("innings_so_far", f"""
SELECT match_id, {sql_big('innings', 'over_number', 'batter_innings_runs', 'batter_innings_balls',
                          'non_striker_innings_runs', 'non_striker_innings_balls')},
  round(100.0 * batter_innings_runs / CAST(greatest(batter_innings_balls, 1) AS DOUBLE), 9) AS batter_innings_sr,
  round(100.0 * non_striker_innings_runs / CAST(greatest(non_striker_innings_balls, 1) AS DOUBLE), 9) AS non_striker_innings_sr
FROM insofar""")
def _innings_so_far(spark, sf):
    out = w.innings_so_far(staged_log(spark, sf))
    return out.select("match_id", *big("innings", "over_number", "batter_innings_runs", "batter_innings_balls",
                                       "non_striker_innings_runs", "non_striker_innings_balls"),
                      *rounded(9, "batter_innings_sr", "non_striker_innings_sr"))


@query("bowler_so_far", f"""
SELECT match_id, {sql_big('innings', 'over_number', 'bowler_match_legal_balls', 'bowler_match_conceded', 'bowler_match_wickets')},
  round(6.0 * bowler_match_conceded / CAST(greatest(bowler_match_legal_balls, 1) AS DOUBLE), 9) AS bowler_match_economy,
  round(bowler_match_legal_balls / CAST(6 AS DOUBLE), 9) AS bowler_overs_bowled_this_match,
  round(greatest(CAST(0 AS DOUBLE), 4 - bowler_match_legal_balls / CAST(6 AS DOUBLE)), 9) AS bowler_overs_remaining_quota
FROM insofar""")
def _bowler_so_far(spark, sf):
    out = w.innings_so_far(staged_log(spark, sf))
    return out.select("match_id", *big("innings", "over_number", "bowler_match_legal_balls", "bowler_match_conceded",
                                       "bowler_match_wickets"),
                      *rounded(9, "bowler_match_economy", "bowler_overs_bowled_this_match", "bowler_overs_remaining_quota"))


cte("faced", """
SELECT match_id, innings, batter, min(date) AS date, min(over_number * 1000 + ball_number) AS first_ball,
  min(over_number) AS first_over,
  row_number() OVER (PARTITION BY match_id, innings ORDER BY min(over_number * 1000 + ball_number)) AS position
FROM fx GROUP BY 1, 2, 3""")


@query("batting_order", "SELECT match_id, CAST(innings AS BIGINT) AS innings, batter, CAST(position AS BIGINT) AS position FROM faced")
def _batting_order(spark, sf):
    return w.batting_order(staged_log(spark, sf)).select("match_id", "batter", *big("innings", "position"))


cte("posnow", """
SELECT o.match_id, o.innings, o.over_number,
  CAST(coalesce(max(CASE WHEN f.batter = o.batter THEN f.position END), greatest(count(f.batter) + 1, 1)) AS BIGINT) AS batter_position_now,
  CAST(coalesce(max(CASE WHEN f.batter = o.non_striker THEN f.position END), greatest(count(f.batter) + 1, 2)) AS BIGINT) AS non_striker_position_now
FROM opening o LEFT JOIN faced f ON f.match_id = o.match_id AND f.innings = o.innings AND f.first_over < o.over_number
GROUP BY 1, 2, 3""")


@query("position_now", f"SELECT match_id, {sql_big('innings', 'over_number', 'batter_position_now', 'non_striker_position_now')} FROM posnow")
def _position_now(spark, sf):
    return w.position_now(staged_log(spark, sf)).select(
        "match_id", *big("innings", "over_number", "batter_position_now", "non_striker_position_now"))


@query("sequence_window", """
WITH held AS (
  SELECT match_id, innings, over_number, ball_number, bowler AS now_bowler, batter AS now_batter,
    list({'runs_total': runs_total, 'runs_batter': runs_batter, 'wicket': wicket, 'boundary': boundary, 'six': six, 'legal': legal, 'runs_extras': runs_extras,
          'batter_ball': batter_ball, 'bowler': bowler, 'batter': batter, 'ball_number': ball_number, 'over_number': over_number})
      OVER (PARTITION BY match_id, innings ORDER BY over_number, ball_number ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS past
  FROM fx),
slots AS (SELECT *, unnest(range(24)) AS slot, coalesce(len(past), 0) AS n FROM held WHERE ball_number = 1),
p AS (SELECT match_id, innings, over_number, slot, now_bowler, now_batter, CASE WHEN slot >= 24 - n THEN past[slot - (24 - n) + 1] END AS b FROM slots)
SELECT match_id, CAST(innings AS BIGINT) AS innings, CAST(over_number AS BIGINT) AS over_number, slot,
  CAST(coalesce(b.runs_total, 0) AS DOUBLE) AS runs_total, CAST(coalesce(b.runs_batter, 0) AS DOUBLE) AS runs_batter,
  CAST(coalesce(b.wicket, 0) AS DOUBLE) AS wicket, CAST(coalesce(b.boundary, 0) AS DOUBLE) AS boundary,
  CAST(coalesce(b.six, 0) AS DOUBLE) AS six, CAST(coalesce(b.legal, 0) AS DOUBLE) AS legal,
  CAST(coalesce(b.runs_extras, 0) AS DOUBLE) AS runs_extras, CAST(coalesce(b.batter_ball, 0) AS DOUBLE) AS batter_ball,
  CAST(CASE WHEN b.bowler = now_bowler THEN 1 ELSE 0 END AS DOUBLE) AS same_bowler,
  CAST(CASE WHEN b.batter = now_batter THEN 1 ELSE 0 END AS DOUBLE) AS same_striker,
  round(coalesce(b.ball_number, 0) / CAST(6 AS DOUBLE), 9) AS ball_share,
  round(coalesce(over_number - b.over_number, 0) / CAST(20 AS DOUBLE), 9) AS over_gap
FROM p""")
def _sequence_window(spark, sf):
    seq = w.sequence_windows(staged_log(spark, sf))
    flat = seq.select("match_id", *big("innings", "over_number"), F.posexplode("sequence").alias("slot", "v"))
    return flat.select("match_id", "innings", "over_number", F.col("slot").cast("bigint").alias("slot"),
                       *[F.round(F.col("v")[i], 9).alias(n) for i, n in enumerate(w.CHANNELS)])


@query("run_histogram", """
SELECT 'total' AS kind, CAST(t AS BIGINT) AS key, count(*) AS overs, CAST(sum(t) AS BIGINT) AS runs FROM
  (SELECT sum(runs_total) AS t FROM fx GROUP BY match_id, innings, over_number) GROUP BY 2
UNION ALL
SELECT 'over', CAST(over_number AS BIGINT), count(*), CAST(sum(t) AS BIGINT) FROM
  (SELECT over_number, sum(runs_total) AS t FROM fx GROUP BY match_id, innings, over_number) GROUP BY 2""")
def _run_histogram(spark, sf):
    overs = w.over_totals(staged_log(spark, sf))
    # Both groupings in one pass: key 'total' is the over's runs, key 'over' its number.
    keyed = overs.select("runs", F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), F.col("runs").cast("bigint").alias("key")),
        F.struct(F.lit("over").alias("kind"), F.col("over_number").cast("bigint").alias("key")))).alias("k"))
    return keyed.groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("overs"), F.sum("runs").alias("runs"))
