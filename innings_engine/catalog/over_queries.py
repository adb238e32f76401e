"""Over samples, splits and baselines."""
from pyspark.sql import functions as F

from ..operators import split as s
from ..plans import forecast as fc, over_table as ot
from .history_queries import _ERA_SQL, day, sql_shrunk
from .log_queries import big, rounded, sql_big, sql_round
from ..plans.forecast import staged_log
from .registry import cte, query

# Fixed inputs of the chase arithmetic, in SQL.
_CHASE = {
    "balls_remaining": "120 - legal_balls_before", "wickets_remaining": "10 - current_wickets",
    "current_run_rate": "6 * current_score / CAST(greatest(legal_balls_before, 1) AS DOUBLE)",
    "runs_required": "CASE WHEN target > 0 THEN greatest(0, target - current_score) ELSE 0 END",
    "required_run_rate": "CASE WHEN target > 0 THEN 6 * greatest(0, target - current_score) / CAST(greatest(120 - legal_balls_before, 1) AS DOUBLE) ELSE 0 END",
}
cte("chase0", "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _CHASE.items()) + " FROM opening")
cte("chase", """
SELECT *, CASE WHEN target > 0 THEN required_run_rate - current_run_rate ELSE 0 END AS required_minus_current_rate,
  CASE WHEN target > 0 THEN runs_required / CAST(greatest(wickets_remaining, 1) AS DOUBLE) ELSE 0 END AS required_runs_per_wicket,
  balls_remaining / CAST(greatest(wickets_remaining, 1) AS DOUBLE) AS balls_per_wicket_remaining,
  CASE WHEN target = 0 THEN 0 WHEN required_run_rate >= 12 THEN 5 WHEN required_run_rate >= 10 THEN 4
       WHEN required_run_rate >= 8 THEN 3 WHEN required_run_rate >= 6 THEN 2 ELSE 1 END AS pressure_bucket
FROM chase0""")
_CHASE_INT = ["balls_remaining", "wickets_remaining", "runs_required", "pressure_bucket"]
_CHASE_FLOAT = ["current_run_rate", "required_run_rate", "required_minus_current_rate", "required_runs_per_wicket",
                "balls_per_wicket_remaining"]


@query("chase_features", f"SELECT match_id, {sql_big('innings', 'over_number', *_CHASE_INT)}, {sql_round(9, *_CHASE_FLOAT)} FROM chase")
def _chase(spark, sf):
    return ot.opening_states(staged_log(spark, sf)).select(
        "match_id", *big("innings", "over_number", *_CHASE_INT), *rounded(9, *_CHASE_FLOAT))


# Usable overs with what the forecasts need.
cte("matchup_day", "SELECT batter, bowler, date, CAST(sum(batter_ball) AS BIGINT) AS balls FROM fx GROUP BY 1, 2, 3")
cte("usable", """
SELECT c.* FROM chase c JOIN league_asof l ON l.date = c.date JOIN prior_date p ON p.date = c.date
WHERE l.league_balls >= 1000 AND NOT (coalesce(p.history_through >= c.date, FALSE)) AND legal_balls_before = (over_number - 1) * 6
  AND current_wickets < 10 AND NOT (target > 0 AND current_score >= target)""")
_CAREER = {"batter": "bat_career", "non_striker": "bat_career", "bowler": "bowl_career"}
cte("dates", """
SELECT season, date, row_number() OVER (PARTITION BY season ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY season) AS n,
  dense_rank() OVER (ORDER BY season DESC) AS back FROM (SELECT DISTINCT season, date FROM usable)""")
cte("labels_by_date", """
SELECT date, CASE WHEN back = 1 THEN 'test' WHEN back = 2 AND i < floor(n * 0.5) THEN 'refit_extra'
  WHEN back = 2 AND i < floor(n * 0.75) THEN 'probability_calibration' WHEN back = 2 THEN 'interval_calibration'
  WHEN back = 3 THEN 'validation' ELSE 'train' END AS "partition" FROM dates""")
cte("smp", f"""
SELECT u.*, t.* EXCLUDE (match_id, innings, over_number), lb."partition",
  i.batter_innings_balls, b.balls AS batter_career_balls, nsc.balls AS non_striker_career_balls, w.balls AS bowler_career_balls,
  {sql_shrunk('b.', 'l.league_')['strike_rate']} AS batter_career_strike_rate,
  {sql_shrunk('w.', 'l.league_')['economy']} AS bowler_career_economy,
  coalesce((SELECT sum(m.balls) FROM matchup_day m WHERE m.batter = u.batter AND m.bowler = u.bowler AND m.date < u.date), 0) AS batter_matchup_balls,
  coalesce((SELECT sum(v.legal) FROM ctx_day v WHERE v.venue = u.venue AND v.date < u.date), 0) AS venue_balls
FROM usable u JOIN tgt t USING (match_id, innings, over_number) JOIN labels_by_date lb ON lb.date = u.date
JOIN league_asof l ON l.date = u.date JOIN insofar i ON i.match_id = u.match_id AND i.innings = u.innings AND i.over_number = u.over_number
JOIN bat_career b ON b.player = u.batter AND b.date = u.date JOIN bat_career nsc ON nsc.player = u.non_striker AND nsc.date = u.date
JOIN bowl_career w ON w.player = u.bowler AND w.date = u.date""")
cte("train_over", "SELECT over_number, avg(target_next_over_runs) AS over_mean FROM smp WHERE \"partition\" = 'train' GROUP BY 1")
cte("train_mean", "SELECT avg(target_next_over_runs) AS m FROM smp WHERE \"partition\" = 'train'")
cte("pw", """
SELECT s.*, s.target_next_over_runs AS y, concat_ws('/', match_id, innings, over_number) AS row_key,
  m.m AS league_mean, coalesce(o.over_mean, m.m) AS over_number_mean,
  CASE WHEN s.over_number > 1 THEN s.current_run_rate ELSE m.m END AS recent_run_rate,
  3 * batter_career_strike_rate / 100 + CAST(0.5 AS DOUBLE) * bowler_career_economy AS batter_bowler_history,
  least(batter_career_balls, non_striker_career_balls, bowler_career_balls) AS support
FROM smp s LEFT JOIN train_over o USING (over_number), train_mean m""")
cte("pl", " UNION ALL ".join(
    f"SELECT row_key, match_id, innings, over_number, season, phase, \"partition\", y, '{m}' AS model, CAST({m} AS DOUBLE) AS p FROM pw" for m in fc.MODELS))

_SMP_INT = ["innings", "over_number", "current_score", "current_wickets", "target", "batter_innings_balls", "batter_career_balls",
            "non_striker_career_balls", "bowler_career_balls", "batter_matchup_balls", "venue_balls", "target_next_over_runs"]
_SMP_FLOAT = ["batter_career_strike_rate", "bowler_career_economy", "current_run_rate", "required_run_rate"]


@query("over_samples", f"SELECT match_id, \"partition\" AS part, {sql_big(*_SMP_INT)}, {sql_round(9, *_SMP_FLOAT)} FROM smp")
def _over_samples(spark, sf):
    df = fc.samples(spark, sf, fc.REPORT)
    return df.select("match_id", F.col("partition").alias("part"), *big(*_SMP_INT), *rounded(9, *_SMP_FLOAT))


_VS_ERA = {
    "scoring_vs_era": "current_run_rate / greatest(era_strike_rate * 6 / 100, CAST(1e-9 AS DOUBLE))",
    "batter_sr_vs_era": "batter_career_strike_rate / greatest(era_strike_rate, CAST(1e-9 AS DOUBLE))",
    "bowler_economy_vs_era": "bowler_career_economy / greatest(era_economy, CAST(1e-9 AS DOUBLE))",
}


@query("against_era", f"""
WITH era AS (SELECT date, {', '.join(f'{e} AS {n}' for n, e in _ERA_SQL.items())} FROM league_asof)
SELECT match_id, {sql_big('innings', 'over_number')}, {', '.join(f'round({e}, 9) AS {n}' for n, e in _VS_ERA.items())} FROM smp JOIN era USING (date)""")
def _against_era(spark, sf):
    """Scoring and players against the league of their own time."""
    return fc.samples(spark, sf, fc.REPORT).select("match_id", *big("innings", "over_number"), *rounded(9, *_VS_ERA))


@query("chrono_split", "SELECT \"partition\" AS part, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(*) AS dates FROM labels_by_date GROUP BY 1")
def _chrono_split(spark, sf):
    labels = s.chrono_labels(fc.samples(spark, sf, fc.STATE).select("season", "date"))
    return labels.groupBy(F.col("partition").alias("part")).agg(
        F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"),
        F.count(F.lit(1)).alias("dates"))


@query("partition_summary", "SELECT \"partition\" AS part, CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date, count(DISTINCT match_id) AS matches, count(*) AS overs FROM smp GROUP BY 1")
def _partition_summary(spark, sf):
    out = s.partition_summary(fc.samples(spark, sf, fc.STATE))
    return out.select(F.col("partition").alias("part"), F.col("start").cast("string").alias("start_date"),
                      F.col("end").cast("string").alias("end_date"), "matches", "overs")


@query("recorded_windows", """
WITH w AS (SELECT "partition" AS part, min(date) AS a, max(date) AS b FROM smp GROUP BY 1)
SELECT part, count(DISTINCT match_id) AS matches, count(*) AS deliveries FROM fx JOIN w ON date BETWEEN a AND b GROUP BY 1""")
def _recorded_windows(spark, sf):
    # The windows of the over samples, on every delivery of the raw log.
    log = s.by_windows(staged_log(spark, sf), s.recorded_windows(fc.samples(spark, sf, fc.STATE)))
    per_match = log.groupBy(F.col("partition").alias("part"), "match_id").agg(F.count(F.lit(1)).alias("n"))
    return per_match.groupBy("part").agg(F.count(F.lit(1)).alias("matches"), F.sum("n").alias("deliveries"))


@query("partition_overlap", "SELECT match_id, min(\"partition\") AS first_partition, max(\"partition\") AS last_partition FROM smp GROUP BY 1 HAVING min(\"partition\") <> max(\"partition\")")
def _partition_overlap(spark, sf):
    return s.partition_overlap(fc.samples(spark, sf, fc.STATE))


def _fold_case(strategy):
    if strategy == "recent":
        return ("CASE WHEN gap = 0 THEN 'test' WHEN gap > 1 THEN 'train' WHEN gap = 1 AND i < floor(n * 0.45) THEN 'train' "
                "WHEN gap = 1 AND i < floor(n * 0.75) THEN 'validation' WHEN gap = 1 AND i < floor(n * 0.90) THEN 'probability_calibration' "
                "WHEN gap = 1 THEN 'interval_calibration' END")
    mid = ("WHEN gap = 1 AND i < floor(n * 0.5) THEN 'refit_extra' WHEN gap = 1 AND i < floor(n * 0.75) THEN 'probability_calibration' "
           if strategy == "refit_plus" else "WHEN gap = 1 AND i < floor(n / 2) THEN 'probability_calibration' ")
    return ("CASE WHEN gap = 0 THEN 'test' WHEN gap = 2 THEN 'validation' WHEN gap > 2 THEN 'train' " + mid
            + "WHEN gap = 1 THEN 'interval_calibration' END")


cte("folds", " UNION ALL ".join(
    f"SELECT '{st}' AS strategy, test_season, date, season, {_fold_case(st)} AS part FROM "
    "(SELECT d.*, t.season AS test_season, t.season - d.season AS gap FROM dates d, (SELECT DISTINCT season FROM dates WHERE back <= 3) t)"
    for st in s.STRATEGIES))


@query("walk_forward_splits", """
SELECT f.strategy, CAST(f.test_season AS BIGINT) AS test_season, f.part, CAST(min(u.date) AS VARCHAR) AS start_date, CAST(max(u.date) AS VARCHAR) AS end_date,
  count(DISTINCT u.match_id) AS matches, count(*) AS overs
FROM folds f JOIN usable u ON u.date = f.date WHERE f.part IS NOT NULL GROUP BY 1, 2, 3""")
def _walk_forward_splits(spark, sf):
    df = fc.samples(spark, sf, fc.STATE).select("season", "date", "match_id")
    labels = s.walk_forward_labels(df)
    # Rows are combined per match before they meet the folds, one row per day and arm.
    per_match = df.groupBy("date", "match_id").agg(F.count(F.lit(1)).alias("n"))
    folded = per_match.join(F.broadcast(labels), "date")
    out = folded.groupBy("strategy", "test_season", F.col("partition").alias("part"), "match_id").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"), F.sum("n").alias("n"))
    return out.groupBy("strategy", F.col("test_season").cast("bigint").alias("test_season"), "part").agg(
        F.min("lo").cast("string").alias("start_date"), F.max("hi").cast("string").alias("end_date"),
        F.count(F.lit(1)).alias("matches"), F.sum("n").alias("overs"))


@query("baselines", "SELECT row_key, \"partition\" AS part, " + sql_round(9, *fc.MODELS) + " FROM pw")
def _baselines(spark, sf):
    return fc.predictions(spark, sf, fc.HISTORY).select(fc.row_key().alias("row_key"), F.col("partition").alias("part"), *rounded(9, *fc.MODELS))


@query("over_mean_baseline", """
WITH fit AS (SELECT * FROM smp WHERE "partition" IN ('train', 'validation', 'refit_extra')),
m AS (SELECT avg(target_next_over_runs) AS v FROM fit), o AS (SELECT over_number, avg(target_next_over_runs) AS v FROM fit GROUP BY 1)
SELECT concat_ws('/', match_id, innings, over_number) AS row_key, round(coalesce(o.v, m.v), 9) AS p
FROM smp LEFT JOIN o USING (over_number), m WHERE "partition" = 'test'""")
def _over_mean(spark, sf):
    df = fc.samples(spark, sf, fc.HISTORY)
    out = fc.baselines(df.filter(F.col("partition") == "test"), df.filter(F.col("partition").isin(s.FITTED)))
    return out.select(fc.row_key().alias("row_key"), F.round("over_number_mean", 9).alias("p"))


@query("phase_forecast_error", """
SELECT phase, count(*) AS overs, round(avg(abs(y - batter_bowler_history)), 6) AS mae,
  round(avg(y), 6) AS mean_runs, round(avg(batter_bowler_history), 6) AS mean_forecast FROM pw GROUP BY 1""")
def _flagship(spark, sf):
    """From the raw table to the error of the history forecast per phase."""
    df = ot.over_samples(staged_log(spark, sf), ("career",))
    p = 3 * F.col("batter_career_strike_rate") / 100 + 0.5 * F.col("bowler_career_economy")
    y = F.col(fc.TARGET)
    return df.groupBy("phase").agg(
        F.count(F.lit(1)).alias("overs"), F.round(F.avg(F.abs(y - p)), 6).alias("mae"),
        F.round(F.avg(y), 6).alias("mean_runs"), F.round(F.avg(p), 6).alias("mean_forecast"))
