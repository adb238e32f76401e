"""Spark ML and Structured Streaming queries."""
from pyspark.sql import functions as F

from ..operators import encode as e, logs as lg, metrics as m
from ..plans import forecast as fc, models as md, over_table as ot
from ..sources.delivery_log import read_table
from ..streaming import live
from .log_queries import big, sql_big
from .metric_queries import r6
from .model_queries import prediction_requests
from .registry import query


@query("fit_regressors")
def _fit(spark, sf):
    scored, _ = md.fit_and_score(md.vector_table(spark, sf))
    return m.regression_metrics(scored, ["model", "stage"], median=False)


@query("grid_search")
def _grid(spark, sf):
    return md.grid_search(md.vector_table(spark, sf))


@query("fit_classifiers")
def _classifiers(spark, sf):
    data = md.assembled(md.vector_table(spark, sf))
    out = None
    for task, classes in (("wicket", 2), ("boundary", 2), ("six", 2), ("ten_plus", 2), ("run_bucket", 6)):
        rows = md.calibrated_classifier(data, task, classes)
        out = rows if out is None else out.unionByName(rows)
    return md.probability_scores(out)


@query("calibrate")
def _calibrate(spark, sf):
    data = md.assembled(md.vector_table(spark, sf))
    rows = md.calibrated_classifier(data, "six", 2)
    long = rows.select(F.col("y"), F.explode(F.array(
        F.struct(F.lit("raw").alias("version"), F.col("raw")[1].alias("p")),
        F.struct(F.lit("calibrated").alias("version"), F.col("calibrated")[1].alias("p")))).alias("v")).select("y", "v.*")
    return m.calibration_error(long, ["version"]).join(m.roc_auc(long, ["version"]), "version")


@query("fit_components")
def _components(spark, sf):
    return md.component_scores(md.vector_table(spark, sf))


@query("permutation_importance")
def _permutation(spark, sf):
    return md.feature_importance(md.vector_table(spark, sf)).orderBy(F.desc("mae_increase"))


@query("recency_arms")
def _recency_arms(spark, sf):
    return m.regression_metrics(md.recency_arms(md.vector_table(spark, sf)), ["arm"], median=False)


@query("feature_removal")
def _removal(spark, sf):
    return md.feature_removal(md.vector_table(spark, sf))


# --- every feature: the queries of these names without _all compare seven or fifteen columns with SQL -------------
@query("standardize_clip_all")
def _standardize_all(spark, sf):
    return md.score_columns(md.vector_table(spark, sf))


@query("top_contributions_all")
def _top_all(spark, sf):
    return md.largest_scores(md.vector_table(spark, sf))


@query("feature_selection_all")
def _selection_all(spark, sf):
    return r6(md.feature_selection(md.vector_table(spark, sf)))


@query("feature_families_all")
def _families_all(spark, sf):
    df = fc.samples(spark, sf)
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    mean = lambda x: F.lit(None).cast("double") if x in text else F.avg(F.col(x).cast("double"))  # noqa: E731  categories have no mean
    row = df.agg(F.array(*[F.struct(F.lit(x).alias("feature"), F.count(x).alias("n"), mean(x).alias("mean")) for x in ot.feature_columns(df)]).alias("all"))
    families = ot.feature_families(fc.staged_log(spark, sf))
    return r6(row.select(F.explode("all").alias("c")).select("c.*").withColumn("family", e.family(F.col("feature"), families)))


@query("native_importance")
def _native(spark, sf):
    return md.native_importance(md.vector_table(spark, sf))


@query("scorer_hook", f"""
SELECT CAST(innings AS BIGINT) AS innings, count(*) AS n, round(avg(abs({fc.TARGET} - (CAST(10.5 AS DOUBLE) - over_number * CAST(0.25 AS DOUBLE) - current_wickets * CAST(0.5 AS DOUBLE)))), 6) AS mae
FROM smp WHERE "partition" = 'test' GROUP BY 1""")
def _hook(spark, sf):
    # A user's model: any function of a pandas frame.
    scorer = lambda pdf: 10.5 - pdf["over_number"] * .25 - pdf["current_wickets"] * .5
    scored = md.score_with(md.of(fc.samples(spark, sf, fc.STATE), "test"), ["over_number", "current_wickets"], scorer, ["match_id", "innings", "over_number", fc.TARGET])
    return scored.groupBy(F.col("innings").cast("bigint").alias("innings")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col(fc.TARGET) - F.col("p"))), 6).alias("mae"))


# --- streams --------------------------------------------------------------------------------
# Every stream arrives in four deliveries that are not in order of time.
_PARTS = 4


def _events(spark, sf):
    return read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedup", """
SELECT id, count(*) AS arrivals, (min({'part': (event_id * 7) % 4, 'ts': ts, 'event_id': event_id})).event_id AS event_id FROM requests GROUP BY 1""")
def _dedup(spark, sf):
    requests = prediction_requests(_events(spark, sf)).select("id", "ts", "event_id")
    arrivals = live.deliveries(requests, F.col("event_id") * 7 % _PARTS, _PARTS, "dedup")
    stored = live.append_new(arrivals, requests, "id", "ts", "dedup")
    return stored.select("id", "event_id").join(requests.groupBy("id").agg(F.count("*").alias("arrivals")), "id")


@query("stream_gate", """
SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM (
  SELECT CASE WHEN event_id * 13 % 80 - 20 > 30 THEN 'stale' WHEN event_id * 13 % 80 - 20 < -5 THEN 'future' WHEN user_id % 7 <> event_id % 7 THEN 'different_match' END AS reason
  FROM events) GROUP BY 1""")
def _gate(spark, sf):
    # Age of an observation in seconds, and the match it claims, from the numbers of the event.
    states = _events(spark, sf).select("event_id", "user_id")
    reason = lg.freshness_reason(F.col("event_id") * 13 % 80 - 20, F.col("user_id") % 7, F.col("event_id") % 7)
    accepted, rejected = live.gated(live.deliveries(states, F.col("event_id") * 7 % _PARTS, _PARTS, "gate"), states, reason, "gate")
    rows = accepted.select(F.lit("accepted").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome")))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("stream_join", """
SELECT p.event_id AS prediction_event, o.outcome_event, CASE WHEN o.id IS NULL THEN 'awaiting' ELSE 'recorded' END AS status
FROM events p LEFT JOIN (
  SELECT event_id - 1 - event_id % 2 * 3 AS id, (min({'part': (event_id * 7) % 4, 'ts': ts, 'event_id': event_id})).event_id AS outcome_event
  FROM events WHERE event_id % 3 = 1 AND event_id % 5 <> 0 GROUP BY 1) o ON o.id = p.event_id
WHERE p.event_id % 3 = 0""")
def _join(spark, sf):
    e, events = F.col("event_id"), _events(spark, sf)
    # An outcome names the prediction it belongs to: that of its own triple of events or the one before.
    predictions = events.where(e % 3 == 0).select(e.alias("id"), F.col("ts").alias("predicted_at"))
    outcomes = events.where((e % 3 == 1) & (e % 5 != 0)).select((e - 1 - e % 2 * 3).alias("id"), "ts", e.alias("outcome_event"))
    made = live.append_new(live.deliveries(predictions, F.col("id") * 7 % _PARTS, _PARTS, "predictions"), predictions, "id", "predicted_at", "predictions")
    seen = live.append_new(live.deliveries(outcomes, F.col("outcome_event") * 7 % _PARTS, _PARTS, "outcomes"), outcomes, "id", "ts", "outcomes")
    return live.with_outcomes(made.select("id"), seen.select("id", "outcome_event"), "id").select(F.col("id").alias("prediction_event"), "outcome_event", "status")


@query("stream_running_state", f"""
SELECT match_id, {sql_big('innings')}, CAST(sum(runs_total) AS BIGINT) AS score, CAST(sum(wicket) AS BIGINT) AS wickets,
  CAST(sum(legal) AS BIGINT) AS legal_balls, count(*) AS deliveries FROM fx GROUP BY match_id, innings""")
def _running(spark, sf):
    log = fc.staged_log(spark, sf)
    balls = live.read_stream(spark, fc.staged_log_path(spark, sf), log)
    final = live.run_update(live.running_innings(balls), "innings", ["match_id", "innings"])
    return final.select("match_id", *big("innings", "score", "wickets", "legal_balls", "deliveries"))


# Days of the middle, the end and the start of the month arrive one after the other; a tenth of all rows comes last.
_PART_OF_DAY = "CASE WHEN event_id % 10 = 0 THEN 3 WHEN extract(day FROM ts) BETWEEN 11 AND 20 THEN 0 WHEN extract(day FROM ts) > 20 THEN 1 ELSE 2 END"
_LATENESS = 3


@query("stream_history_commit", f"""
WITH arrived AS (SELECT *, CAST(ts AS DATE) AS day, {_PART_OF_DAY} AS part FROM events),
marks AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM arrived GROUP BY part),
judged AS (SELECT a.*, coalesce(a.day + {1 + _LATENESS} <= m.mark, FALSE) AS late FROM arrived a JOIN marks m USING (part))
SELECT CAST(day AS VARCHAR) AS date, event_type, late, count(*) AS n, round(sum(value), 6) AS total FROM judged
WHERE late OR day + {1 + _LATENESS} <= (SELECT max(ts) FROM events) GROUP BY 1, 2, 3""")
def _commit(spark, sf):
    events = _events(spark, sf).select("event_id", "ts", "event_type", "value")
    arrivals = live.deliveries(events, F.expr(_PART_OF_DAY), _PARTS, "commit")
    facts, late = live.closed_day_facts(arrivals, events, "ts", ["event_type"], "value", _LATENESS, "commit")
    apart = late.groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = facts.withColumn("late", F.lit(False)).unionByName(apart.withColumn("late", F.lit(True)))
    return out.select(F.col("date").cast("string").alias("date"), "event_type", "late", "n", F.round("total", 6).alias("total"))
