"""Live requests against the published histories."""
from pyspark.sql import functions as F

from ..operators import validate as v, windows as w
from ..plans import forecast as fc, over_table as ot, serving as sv
from ..plans.staging import staged_once
from ..session import all_written
from .log_queries import big, rounded, sql_big, sql_round
from .over_queries import _SMP_FLOAT, _SMP_INT
from .registry import query

_INT = [x for x in _SMP_INT if x != fc.TARGET]


def serving(spark, sf):
    """The published histories, written once per session."""
    return staged_once(spark, ("serving", sf), lambda: sv.serving_table(fc.staged_log(spark, sf)))


def requests_of(log):
    """A live request for every over of the log."""
    return v.live_states(w.running_state(log)).withColumn("request_id", F.concat_ws("/", "match_id", "innings", F.col("over").cast("string")))


def differing(live, batch, features):
    """Per request, the number of features whose value isn't that of the over table's row; numbers to a relative 1e-9."""
    def same(x):
        a, b = F.col(f"l.{x}"), F.col(f"b.{x}")
        if dict(batch.dtypes)[x] == "string":
            return a.eqNullSafe(b)
        a, b = a.cast("double"), b.cast("double")
        return F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b)), a.isNull() & b.isNull())
    count = sum((F.when(same(x), 0).otherwise(1) for x in features), F.lit(0))
    keys = ot.OVER_KEY
    return live.alias("l").join(batch.alias("b"), [F.col(f"l.{x}").eqNullSafe(F.col(f"b.{x}")) for x in keys]).select(F.col("l.request_id"), count.cast("bigint").alias("differing"))


@query("live_features", f"""
SELECT concat_ws('/', match_id, innings, over_number) AS request_id, {sql_big(*_INT)}, {sql_round(9, *_SMP_FLOAT)}, CAST(0 AS BIGINT) AS differing FROM smp""")
def _live_features(spark, sf):
    """Every over of the log asked for as a live request; ``differing`` counts the features, of all there are, that aren't the batch row's."""
    batch = fc.samples(spark, sf)
    live = staged_once(spark, ("live_features", sf), lambda: sv.live_features(requests_of(fc.staged_log(spark, sf)), serving(spark, sf), all_written))
    return live.join(differing(live, batch, ot.feature_columns(batch)), "request_id").select("request_id", *big(*_INT), *rounded(9, *_SMP_FLOAT), "differing")


_NEW_INT = ["batter_career_balls", "batter_season_balls", "non_striker_matchup_balls", "bowler_career_outs", "venue_phase_balls", "era_balls_observed", "batter_innings_seen"]


@query("live_new_match", f"""
WITH last AS (SELECT max(date) AS d FROM fx), asked AS (
  SELECT *, year(last.d + INTERVAL 75 DAY) AS season_then FROM opening JOIN last ON opening.date = last.d
  WHERE current_wickets < 10 AND (target = 0 OR target > current_score))
SELECT concat_ws('/', 'live', match_id, innings, over_number) AS request_id,
  CAST((SELECT coalesce(sum(batter_ball), 0) FROM fx WHERE fx.batter = a.batter) AS BIGINT) AS batter_career_balls,
  CAST((SELECT coalesce(sum(batter_ball), 0) FROM fx WHERE fx.batter = a.batter AND fx.season = a.season_then) AS BIGINT) AS batter_season_balls,
  CAST((SELECT coalesce(sum(batter_ball), 0) FROM fx WHERE fx.batter = a.non_striker AND fx.bowler = a.bowler) AS BIGINT) AS non_striker_matchup_balls,
  CAST((SELECT coalesce(sum(bowler_wicket), 0) FROM fx WHERE fx.bowler = a.bowler) AS BIGINT) AS bowler_career_outs,
  CAST((SELECT coalesce(sum(legal), 0) FROM fx WHERE fx.venue = a.venue AND fx.phase = (CASE WHEN a.over_number <= 6 THEN 'powerplay' WHEN a.over_number <= 15 THEN 'middle' ELSE 'death' END)) AS BIGINT) AS venue_phase_balls,
  CAST((SELECT coalesce(sum(batter_ball), 0) FROM fx WHERE fx.season = a.season_then) AS BIGINT) AS era_balls_observed,
  CAST((SELECT count(DISTINCT match_id || '/' || innings) FROM fx WHERE fx.batter = a.batter) AS BIGINT) AS batter_innings_seen,
  CAST((SELECT count(DISTINCT match_id) FROM (SELECT DISTINCT date, match_id FROM fx WHERE fx.batter = a.batter ORDER BY date DESC, match_id DESC LIMIT 25) m
    WHERE date_diff('day', m.date, CAST(a.date + INTERVAL 75 DAY AS DATE)) <= 90) AS DOUBLE) AS batter_last_90d_innings,
  round(6 * current_score / CAST(greatest(legal_balls_before, 1) AS DOUBLE), 9) AS current_run_rate
FROM asked a""")
def _live_new_match(spark, sf):
    """The overs of the log's last day as requests of matches that aren't in the log, 75 days later."""
    log = fc.staged_log(spark, sf)
    last = log.agg(F.max("date").alias("d"))
    # A match of the last day has a ball on it; its requests need the balls of that match only.
    played = log.join(F.broadcast(last), F.col("date") == F.col("d")).select("match_id").distinct()
    asked = requests_of(log.join(played, "match_id", "left_semi")).join(F.broadcast(last), F.to_date("date") == F.col("d")).withColumns({
        "request_id": F.concat_ws("/", F.lit("live"), "request_id"), "match_id": F.concat(F.lit("live-"), "match_id"),
        "date": F.date_add("d", 75).cast("string")}).drop("d")
    return sv.live_features(asked, serving(spark, sf), all_written).select(
        "request_id", *big(*_NEW_INT), "batter_last_90d_innings", *rounded(9, "current_run_rate"))
