"""Evaluation metrics on the baseline forecasts."""
from pyspark.sql import Column, functions as F

from ..operators import metrics as m, ordered as o
from ..plans import forecast as fc, probabilities as pb, segments as sg
from ..plans.staging import staged_once
from .log_queries import big, rounded
from .registry import cte, query

C, D = fc.CANDIDATE, fc.CHAMPION


def part(spark, sf, name="test", groups=fc.REPORT):
    return fc.predictions(spark, sf, groups).filter(F.col("partition") == name)


def r6(df, *keep):
    """Keep keys; integers to bigint; doubles to six digits."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("integer", "long", "short", "boolean"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif t in ("double", "float", "decimal"):
            out.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def long_test(spark, sf, name="test"):
    return fc.long_form(part(spark, sf, name, fc.HISTORY).withColumn("row_key", fc.row_key()), ["row_key", "match_id", "phase", "y"])


cte("test_long", "SELECT * FROM pl WHERE \"partition\" = 'test'")
cte("test_wide", "SELECT * FROM pw WHERE \"partition\" = 'test'")

_ERR = """count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(quantile_cont(abs(y - p), 0.5), 6) AS median_ae, """ + ", ".join(
    f"round(avg(CASE WHEN abs(y - p) <= {t} THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS within_{t}" for t in (1, 2, 3, 4))


@query("regression_metrics", f"SELECT \"partition\" AS part, model, {_ERR} FROM pl GROUP BY 1, 2")
def _regression(spark, sf):
    df = fc.predictions(spark, sf, fc.HISTORY)
    long = fc.long_form(df.withColumnRenamed("partition", "part"), ["part", "y"])
    return r6(m.regression_metrics(long, ["part", "model"]))


@query("tolerance_table", "SELECT model, round(avg(CASE WHEN round_even(p, 0) = y THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS exact, " + ", ".join(
    f"round(avg(CASE WHEN abs(y - p) <= {t} THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS within_{t}" for t in m.TOLERANCES)
    + " FROM test_long GROUP BY 1")
def _tolerance(spark, sf):
    return r6(m.tolerance_table(long_test(spark, sf), ["model"]))


@query("baseline_improvement", f"""
WITH e AS (SELECT model, avg(abs(y - p)) AS mae FROM test_long GROUP BY 1), c AS (SELECT mae AS v FROM e WHERE model = '{C}')
SELECT model, round(mae, 6) AS mae, round(mae - v, 6) AS absolute_improvement, round(100 * (mae - v) / mae, 6) AS relative_improvement_percent
FROM e, c WHERE model <> '{C}'""")
def _improvement(spark, sf):
    errors = m.regression_metrics(long_test(spark, sf), ["model"], median=False)
    return r6(m.baseline_improvement(errors.select("model", "mae"), C))


# --- probabilities in SQL: one row per (row, task, class) ------------------------------
_E = pb.EVENTS
cte("ev_day", "SELECT bowler, date, count(*) AS n, " + ", ".join(f"sum(target_{e}) AS {e}" for e in _E) + " FROM smp GROUP BY 1, 2")
cte("ev_own", "SELECT p.bowler, p.date, coalesce(sum(f.n), 0) AS n, " + ", ".join(f"coalesce(sum(f.{e}), 0) AS {e}" for e in _E)
    + " FROM ev_day p LEFT JOIN ev_day f ON f.bowler = p.bowler AND f.date < p.date GROUP BY 1, 2")
cte("ev_all", "SELECT p.date, coalesce(sum(f.n), 0) AS n, " + ", ".join(f"coalesce(sum(f.{e}), 0) AS {e}" for e in _E)
    + " FROM (SELECT DISTINCT date FROM ev_day) p LEFT JOIN ev_day f ON f.date < p.date GROUP BY 1")
cte("ev_p", " UNION ALL ".join(
    f"SELECT concat_ws('/', s.match_id, s.innings, s.over_number) AS row_key, s.match_id, s.phase, s.\"partition\", '{e}' AS task, s.target_{e} AS y, "
    f"(o.{e} + 24 * a.{e} / CAST(greatest(a.n, 1) AS DOUBLE)) / (o.n + 24) AS p "
    "FROM smp s JOIN ev_own o ON o.bowler = s.bowler AND o.date = s.date JOIN ev_all a ON a.date = s.date" for e in _E))
cte("bk_day", "SELECT phase, date, target_run_bucket AS k, count(*) AS n FROM smp GROUP BY 1, 2, 3")
cte("bk_p", """
SELECT d.phase, d.date, k.k, coalesce(sum(CASE WHEN f.k = k.k THEN f.n END), 0) AS nk, coalesce(sum(f.n), 0) AS n
FROM (SELECT DISTINCT phase, date FROM bk_day) d, (SELECT unnest(range(6)) AS k) k
LEFT JOIN bk_day f ON f.phase = d.phase AND f.date < d.date GROUP BY 1, 2, 3""".replace(
    "FROM (SELECT DISTINCT phase, date FROM bk_day) d, (SELECT unnest(range(6)) AS k) k",
    "FROM (SELECT DISTINCT phase, date, u.k FROM bk_day, (SELECT unnest(range(6)) AS k) u) k").replace("d.phase", "k.phase").replace("d.date", "k.date"))
cte("prk", """
SELECT row_key, match_id, phase, task, y, k, CASE WHEN k = 1 THEN p ELSE 1 - p END AS p FROM ev_p, (SELECT unnest(range(2)) AS k) u WHERE "partition" = 'test'
UNION ALL
SELECT concat_ws('/', s.match_id, s.innings, s.over_number), s.match_id, s.phase, 'run_bucket', s.target_run_bucket, b.k, (b.nk + 1) / CAST(b.n + 6 AS DOUBLE)
FROM smp s JOIN bk_p b ON b.phase = s.phase AND b.date = s.date WHERE s."partition" = 'test'""")
cte("prc", """
SELECT row_key, match_id, phase, task, y, k, p, c / sum(c) OVER (PARTITION BY row_key, task) AS pc FROM (
  SELECT *, least(greatest(p, 1e-9), 1 - 1e-9) AS c FROM prk)""")
cte("predicted", """
SELECT row_key, match_id, phase, task, any_value(y) AS y, arg_max(k, p * 1000 - k * 1e-12) AS pred, max(p) AS pmax, max(CASE WHEN k = 1 THEN p END) AS p1
FROM prk GROUP BY 1, 2, 3, 4""")
cte("confident", "SELECT *, CASE WHEN task = 'run_bucket' THEN pmax ELSE p1 END AS conf, CASE WHEN task = 'run_bucket' THEN CASE WHEN pred = y THEN 1 ELSE 0 END ELSE y END AS obs FROM predicted")


def probs(spark, sf, partition="test"):
    return pb.probability_table(spark, sf, partition)


def predicted(spark, sf):
    """Adds the predicted class, the confidence and whether the event was observed."""
    df = probs(spark, sf).withColumn("pred", m.argmax("probs"))
    multi = F.col("task") == "run_bucket"
    return df.select(
        "*", F.when(multi, F.array_max("probs")).otherwise(F.col("probs")[1]).alias("conf"),
        F.when(multi, (F.col("pred") == F.col("y")).cast("int")).otherwise(F.col("y")).alias("obs"))


_EDGES = [i * 0.1 for i in range(11)]
_BIN = "least(9, " + " + ".join(f"CASE WHEN conf >= CAST({e!r} AS DOUBLE) THEN 1 ELSE 0 END" for e in _EDGES[1:10]) + ")"


@query("calibration_error", f"""
SELECT task, round(sum(n * abs(o - c)) / sum(n), 6) AS ece FROM (
  SELECT task, {_BIN} AS b, count(*) AS n, avg(obs) AS o, avg(conf) AS c FROM confident GROUP BY 1, 2) GROUP BY 1""")
def _ece(spark, sf):
    return r6(m.calibration_error(predicted(spark, sf), ["task"], "obs", "conf"))


@query("reliability_table", "SELECT task, CAST(bin AS BIGINT) AS bin, round(avg(conf), 6) AS predicted, round(avg(obs), 6) AS observed, count(*) AS n FROM (SELECT * REPLACE (least(greatest(conf, 1e-9), 1 - 1e-9) AS conf), CASE "
       + " ".join(f"WHEN least(conf, 1 - 1e-9) >= CAST({e!r} AS DOUBLE) AND least(conf, 1 - 1e-9) < CAST({(e + 0.1)!r} AS DOUBLE) THEN {i}" for i, e in enumerate(_EDGES[:10]))
       + " END AS bin FROM confident) WHERE bin IS NOT NULL GROUP BY 1, 2")
def _reliability(spark, sf):
    return r6(m.reliability_table(predicted(spark, sf), ["task"], "obs", "conf"))


def n_classes() -> Column:
    return F.when(F.col("task") == "run_bucket", pb.CLASSES).otherwise(2)


@query("confusion_matrix", """
SELECT t.task, CAST(t.a AS BIGINT) AS y, CAST(t.b AS BIGINT) AS pred, count(p.row_key) AS n FROM (
  SELECT DISTINCT x.task, x.k AS a, z.k AS b FROM prk x JOIN prk z ON x.row_key = z.row_key AND x.task = z.task) t
LEFT JOIN predicted p ON p.task = t.task AND p.y = t.a AND p.pred = t.b GROUP BY 1, 2, 3""")
def _confusion(spark, sf):
    return r6(m.confusion_matrix(predicted(spark, sf), ["task"], n_classes()))


@query("classification_metrics", """
WITH l AS (SELECT task, label, count(CASE WHEN s = 't' THEN 1 END) AS support, count(CASE WHEN s = 'm' THEN 1 END) AS predicted,
             count(CASE WHEN s = 't' AND hit THEN 1 END) AS tp FROM (
    SELECT task, y AS label, 't' AS s, y = pred AS hit FROM predicted UNION ALL SELECT task, pred, 'm', FALSE FROM predicted) GROUP BY 1, 2),
sc AS (SELECT *, CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS rc,
  2 * tp / CAST(support + predicted AS DOUBLE) AS f FROM l),
av AS (SELECT task, CASE WHEN task = 'run_bucket' THEN avg(pr) ELSE coalesce(max(CASE WHEN label = 1 THEN pr END), 0) END AS precision,
  CASE WHEN task = 'run_bucket' THEN avg(rc) ELSE coalesce(max(CASE WHEN label = 1 THEN rc END), 0) END AS recall,
  CASE WHEN task = 'run_bucket' THEN avg(f) ELSE coalesce(max(CASE WHEN label = 1 THEN f END), 0) END AS f1,
  sum(f * support) / sum(support) AS weighted_f1 FROM sc GROUP BY 1)
SELECT task, count(*) AS n, round(avg(CASE WHEN y = pred THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy, round(any_value(precision), 6) AS precision,
  round(any_value(recall), 6) AS recall, round(any_value(f1), 6) AS f1, round(any_value(weighted_f1), 6) AS weighted_f1
FROM predicted JOIN av USING (task) GROUP BY 1""")
def _classification(spark, sf):
    counts = m.confusion_counts(predicted(spark, sf), ["task"])
    return r6(m.classification_metrics(counts, ["task"], F.col("task") != "run_bucket"))


@query("probabilistic_scores", """
SELECT task, count(DISTINCT row_key) AS n, round(-sum(CASE WHEN k = y THEN ln(pc) END) / count(DISTINCT row_key), 6) AS log_loss,
  round(sum((pc - CASE WHEN k = y THEN 1 ELSE 0 END) ** 2) / count(DISTINCT row_key) / CASE WHEN task = 'run_bucket' THEN 1 ELSE 2 END, 6) AS brier
FROM prc GROUP BY 1""")
def _probabilistic(spark, sf):
    return r6(m.probabilistic_scores(probs(spark, sf), ["task"]))


@query("ranked_probability_score", """
SELECT task, round(sum(d * d) / count(DISTINCT row_key) / (count(DISTINCT k) - 1), 6) AS rps FROM (
  SELECT task, row_key, k, sum(p - CASE WHEN k = y THEN 1 ELSE 0 END) OVER (PARTITION BY row_key, task ORDER BY k) AS d FROM prk) GROUP BY 1""")
def _rps(spark, sf):
    return r6(m.ranked_probability_score(probs(spark, sf), ["task"]))


def binary(spark, sf):
    return pb.event_table(spark, sf).filter(F.col("partition") == "test")


cte("bin_test", "SELECT * FROM ev_p WHERE \"partition\" = 'test'")
_AUC = """
SELECT {g}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) END AS roc_auc
FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {g}, p) - 1) / CAST(2 AS DOUBLE) AS r FROM {t} WINDOW w AS (PARTITION BY {g} ORDER BY p)) GROUP BY {g}"""
_PR = """
SELECT {g}, CASE WHEN max(tp_all) > 0 THEN round(sum(pos * hits / CAST(flagged AS DOUBLE)) / max(tp_all), 6) END AS pr_auc FROM (
  SELECT {g}, p, pos, sum(pos) OVER w AS hits, sum(n) OVER w AS flagged, sum(pos) OVER (PARTITION BY {g}) AS tp_all FROM (
    SELECT {g}, p, count(*) AS n, sum(y) AS pos FROM {t} GROUP BY {g}, p) WINDOW w AS (PARTITION BY {g} ORDER BY p DESC)) GROUP BY {g}"""


@query("roc_auc", _AUC.format(g="task", t="bin_test"))
def _roc(spark, sf):
    return r6(m.roc_auc(binary(spark, sf), ["task"]))


@query("pr_auc", _PR.format(g="task", t="bin_test"))
def _prauc(spark, sf):
    return r6(m.pr_auc(binary(spark, sf), ["task"]))


cte("bin_cal", "SELECT * FROM ev_p WHERE \"partition\" = 'probability_calibration'")


@query("best_f1_threshold", """
WITH t AS (SELECT task, arg_max(p, f * 1e6 - p) AS threshold, max(f) AS calibration_f1 FROM (
  SELECT *, 2 * hits / CAST(flagged + tp_all AS DOUBLE) AS f FROM (
  SELECT task, p, sum(pos) OVER w AS hits, sum(n) OVER w AS flagged, sum(pos) OVER (PARTITION BY task) AS tp_all FROM (
    SELECT task, p, count(*) AS n, sum(y) AS pos FROM bin_cal GROUP BY task, p) WINDOW w AS (PARTITION BY task ORDER BY p DESC))) GROUP BY 1),
m AS (SELECT b.task, threshold, calibration_f1, count(CASE WHEN p >= threshold THEN 1 END) AS flagged, count(CASE WHEN p >= threshold AND y = 1 THEN 1 END) AS hits,
  sum(y) AS pos FROM bin_test b JOIN t USING (task) GROUP BY 1, 2, 3)
SELECT task, round(threshold, 6) AS threshold, round(calibration_f1, 6) AS calibration_f1, flagged,
  round(CASE WHEN flagged > 0 THEN hits / CAST(flagged AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN pos > 0 THEN hits / CAST(pos AS DOUBLE) ELSE 0 END, 6) AS recall,
  round(CASE WHEN flagged + pos > 0 THEN 2 * hits / CAST(flagged + pos AS DOUBLE) ELSE 0 END, 6) AS f1 FROM m""")
def _f1(spark, sf):
    chosen = m.best_f1_threshold(pb.event_table(spark, sf).filter("partition = 'probability_calibration'"), ["task"])
    scored = m.at_threshold(binary(spark, sf), chosen, ["task"])
    return r6(scored.join(chosen.select("task", F.col("f1").alias("calibration_f1")), "task"))


@query("class_support", """
SELECT task, y AS label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY task) AS DOUBLE), 6) AS rate
FROM (SELECT DISTINCT row_key, task, y FROM prk) GROUP BY 1, 2""")
def _support(spark, sf):
    return r6(m.class_support(probs(spark, sf), ["task"]))


# Events read from the run-bucket probabilities: dot-like (first bucket), mid and top bucket.
_BUCKET_EVENTS = {"low_over": 0, "busy_over": 3, "huge_over": 5}
cte("bucket_ev", " UNION ALL ".join(
    f"SELECT row_key, '{n}' AS event, CASE WHEN y = {i} THEN 1 ELSE 0 END AS y, p FROM prk WHERE task = 'run_bucket' AND k = {i}" for n, i in _BUCKET_EVENTS.items()))


@query("event_scores", f"""
SELECT a.event, a.roc_auc, b.pr_auc, c.brier, c.base_rate FROM ({_AUC.format(g='event', t='bucket_ev')}) a
JOIN ({_PR.format(g='event', t='bucket_ev')}) b ON a.event = b.event
JOIN (SELECT event, round(avg((p - y) ** 2), 6) AS brier, round(avg(y), 6) AS base_rate FROM bucket_ev GROUP BY 1) c ON a.event = c.event""")
def _event_scores(spark, sf):
    df = probs(spark, sf).filter(F.col("task") == "run_bucket")
    events = F.array(*[F.struct(F.lit(n).alias("event"), (F.col("y") == i).cast("int").alias("y"), F.col("probs")[i].alias("p"))
                       for n, i in _BUCKET_EVENTS.items()])
    long = df.select(F.explode(events).alias("e")).select("e.*")
    base = long.groupBy("event").agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg("y").alias("base_rate"))
    return r6(m.roc_auc(long, ["event"]).join(m.pr_auc(long, ["event"]), "event").join(base, "event"))


# --- intervals ---------------------------------------------------------------------------
def radii(spark, sf):
    """Radius rows (kind, n, rank, radius) per over of the candidate on the interval block, written once."""
    return staged_once(spark, ("radii", sf), lambda: _radii(spark, sf)[0])


def block_radius(spark, sf):
    """The same for whole matches."""
    return staged_once(spark, ("block_radius", sf), lambda: _radii(spark, sf)[1])


def _radii(spark, sf):
    cal = part(spark, sf, "interval_calibration", fc.HISTORY).select("match_id", "y", F.col(C).alias("p"))
    r80 = m.conformal_radius(cal, [], .2).select(F.lit("over_80").alias("kind"), "n", "rank", "radius")
    r95 = m.conformal_radius(cal, [], .05).select(F.lit("over_95").alias("kind"), "n", "rank", "radius")
    block = m.conformal_block_radius(cal, [], "match_id", .2).select(F.lit("match_80").alias("kind"), "n", "rank", "radius")
    return r80.unionByName(r95).coalesce(1), block


_KINDS = [("over_80", 0.2, 0.8), ("over_95", 0.05, 0.95)]
cte("cal", f"SELECT match_id, abs(y - {C}) AS e FROM pw WHERE \"partition\" = 'interval_calibration'")
cte("cal_block", "SELECT match_id, max(e) AS e FROM cal GROUP BY 1")
cte("radius", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, n, rank, e AS radius FROM (SELECT e, row_number() OVER (ORDER BY e) AS i, count(*) OVER () AS n, "
    f"CAST(ceil((count(*) OVER () + 1) * CAST({1 - a!r} AS DOUBLE)) AS BIGINT) AS rank FROM {t}) WHERE i = rank"
    for k, a, t in (("over_80", .2, "cal"), ("over_95", .05, "cal"), ("match_80", .2, "cal_block"))))


@query("conformal_radius", "SELECT kind, n, rank, round(radius, 9) AS radius FROM radius WHERE kind <> 'match_80'")
def _conformal(spark, sf):
    return radii(spark, sf).select("kind", *big("n", "rank"), F.round("radius", 9).alias("radius"))


@query("conformal_block", "SELECT n, rank, round(radius, 9) AS radius FROM radius WHERE kind = 'match_80'")
def _conformal_block(spark, sf):
    return block_radius(spark, sf).select(*big("n", "rank"), F.round("radius", 9).alias("radius"))


cte("intervals", f"""
SELECT kind, match_id, y, greatest(0, floor({C} - radius)) AS lo, ceil({C} + radius) AS hi,
  CASE kind WHEN 'over_95' THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS target, {C} AS p, support
FROM test_wide, radius
UNION ALL SELECT 'quantiles', t.match_id, y, floor(q.lo), ceil(q.hi), CAST(0.8 AS DOUBLE), {C}, support FROM test_wide t JOIN (
  SELECT over_number, quantile_cont(target_next_over_runs, 0.1) AS lo, quantile_cont(target_next_over_runs, 0.9) AS hi FROM smp
  WHERE "partition" = 'train' GROUP BY 1) q USING (over_number)""")


def with_intervals(spark, sf):
    """Test rows x interval kind, bounds included."""
    test = part(spark, sf, groups=fc.HISTORY)
    bounds = []
    found = radii(spark, sf).unionByName(block_radius(spark, sf))
    for kind, target in (("over_80", .8), ("over_95", .95), ("match_80", .8)):
        lo, hi = m.interval_columns(F.col(C), found.filter(F.col("kind") == kind).agg(F.max("radius")).scalar())
        bounds.append(F.struct(F.lit(kind).alias("kind"), F.lit(target).alias("target"),
                               lo.cast("double").alias("lower"), hi.cast("double").alias("upper")))
    return test.select("match_id", "y", F.col(C).alias("p"), sg.support().alias("support"),
                       F.explode(F.array(*bounds)).alias("b")).select("match_id", "y", "p", "support", "b.*")


@query("interval_coverage", """
WITH b AS (SELECT kind, match_id, CASE WHEN bool_and(y >= lo AND y <= hi) THEN 1 ELSE 0 END AS ok FROM intervals GROUP BY 1, 2),
s AS (SELECT kind, avg(ok) AS simultaneous FROM b GROUP BY 1)
SELECT i.kind, count(*) AS n, round(avg(CASE WHEN y >= lo AND y <= hi THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS coverage,
  round(avg(CASE WHEN y >= lo AND y <= hi THEN CAST(1 AS DOUBLE) ELSE 0 END) - max(target), 6) AS coverage_error, round(avg(hi - lo), 6) AS mean_width,
  round(quantile_cont(hi - lo, 0.5), 6) AS median_width, round(max(simultaneous), 6) AS simultaneous_coverage
FROM intervals i JOIN s ON s.kind = i.kind GROUP BY 1""")
def _coverage(spark, sf):
    rows = with_intervals(spark, sf).select("match_id", "y", "kind", "target", "lower", "upper")
    # Bounds from per-over-number outcome quantiles, rounded outward but not cut at zero.
    train = part(spark, sf, "train", fc.HISTORY)
    q = o.exact_quantiles(train, ["over_number"], fc.TARGET, {"q10": .1, "q90": .9})
    extra = part(spark, sf, groups=fc.HISTORY).join(F.broadcast(q), "over_number").select(     # at most twenty over numbers
        "match_id", "y", F.lit("quantiles").alias("kind"), F.lit(.8).alias("target"),
        F.floor("q10").cast("double").alias("lower"), F.ceil("q90").cast("double").alias("upper"))
    both = rows.unionByName(extra)
    covered = m.interval_coverage(both, ["kind", "target"], "lower", "upper", 0.0)
    out = covered.withColumn("coverage_error", F.col("coverage") - F.col("target"))
    return r6(out.select("kind", "n", "coverage", "coverage_error", "mean_width", "median_width", "simultaneous_coverage"))


# --- comparisons -------------------------------------------------------------------------
_GAIN = f"(abs(y - {D}) - abs(y - {C}))"


@query("paired_test", f"""
SELECT phase, count(*) AS n, round(avg(d), 6) AS mae_improvement, round(stddev_samp(d) / sqrt(count(*)), 6) AS standard_error,
  round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS z, CAST(CASE WHEN avg(d) > 2 * stddev_samp(d) / sqrt(count(*)) THEN 1 ELSE 0 END AS BIGINT) AS significant
FROM (SELECT phase, {_GAIN} AS d FROM test_wide) GROUP BY 1""")
def _paired(spark, sf):
    return r6(m.paired_test(part(spark, sf, groups=fc.HISTORY), ["phase"], D, C))


@query("bootstrap_ci")
def _bootstrap(spark, sf):
    test = part(spark, sf, groups=fc.HISTORY)
    return m.bootstrap_ci(test, F.abs(F.col("y") - F.col(D)) - F.abs(F.col("y") - F.col(C)))


_SEGMENT_SQL = {
    "powerplay": "over_number <= 6", "middle_overs": "over_number > 6 AND over_number <= 15", "death_overs": "over_number >= 16",
    "first_innings": "innings = 1", "second_innings": "innings = 2", "chase_low_rrr": "innings = 2 AND required_run_rate < 8",
    "chase_medium_rrr": "innings = 2 AND required_run_rate >= 8 AND required_run_rate < 12", "chase_high_rrr": "innings = 2 AND required_run_rate >= 12",
    "wickets_0_2": "current_wickets <= 2", "wickets_3_5": "current_wickets BETWEEN 3 AND 5", "wickets_6_plus": "current_wickets >= 6",
    "set_batter": "batter_innings_balls >= 20", "new_batter": "batter_innings_balls < 6", "known_player": "support >= 300",
    "low_history_player": "support > 0 AND support < 120", "cold_start_player": "support = 0", "known_matchup": "batter_matchup_balls >= 12",
    "sparse_matchup": "batter_matchup_balls = 0", "known_venue": "venue_balls >= 5000", "sparse_venue": "venue_balls < 1500",
    "unseen_matchup": "batter_matchup_balls = 0", "seen_matchup": "batter_matchup_balls > 0", "high_required_rate": "required_run_rate >= 12",
    "low_required_rate_chase": "required_run_rate < 8 AND innings = 2", "actual_15_plus": "y >= 15", "actual_20_plus": "y >= 20", "actual_under_5": "y < 5"}


_SEGMENT_ERR = f"count(*) AS n, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in {
    "mae": f"avg(abs(y - {C}))", "rmse": f"sqrt(avg((y - {C}) * (y - {C})))",
    "r2": f"CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - {C}) * (y - {C})) / (var_pop(y) * count(*)) WHEN sum((y - {C}) * (y - {C})) = 0 THEN 1 ELSE 0 END",
    **{f"within_{t}": f"avg(CASE WHEN abs(y - {C}) <= {t} THEN CAST(1 AS DOUBLE) ELSE 0 END)" for t in (1, 2, 3, 4)},
    "mean_actual": "avg(y)", "mean_predicted": f"avg({C})"}.items())
_VALUE_SEGMENTS = {"venue": "venue", "phase": "phase", "innings": "CAST(innings AS VARCHAR)"}


@query("segment_metrics", " UNION ALL ".join(
    [f"SELECT '{n}' AS segment, {_SEGMENT_ERR} FROM test_wide WHERE {cond} HAVING count(*) >= 2" for n, cond in _SEGMENT_SQL.items()]
    + [f"SELECT '{n}=' || {x} AS segment, {_SEGMENT_ERR} FROM test_wide GROUP BY 1 HAVING count(*) >= 2" for n, x in _VALUE_SEGMENTS.items()]))
def _segments(spark, sf):
    test = part(spark, sf).withColumn("p", F.col(C))
    named = m.segment_metrics(test, {**sg.audit_segments(), **sg.report_segments()})
    # Segments by value: one row per (row, column) in the same pass.
    values = test.select("y", "p", F.explode(F.array(*[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in _VALUE_SEGMENTS])).alias("segment"))
    by_value = values.groupBy("segment").agg(
        *[c.alias(n) for n, c in m.error_columns().items()], F.avg("y").alias("mean_actual"), F.avg("p").alias("mean_predicted")).filter("n >= 2")
    return r6(named.unionByName(by_value))


cte("worst", f"SELECT *, abs(y - {C}) AS e FROM test_wide ORDER BY e DESC, row_key LIMIT 100")


def worst(spark, sf, n=100):
    test = part(spark, sf, groups=fc.HISTORY).withColumns({"p": F.col(C), "row_key": fc.row_key()})
    return m.worst_n(test, n, ["row_key"])


@query("worst_n", f"SELECT row_key, phase, batter, bowler, CAST(y AS BIGINT) AS y, round({C}, 6) AS p, round(e, 6) AS absolute_error FROM worst")
def _worst(spark, sf):
    return worst(spark, sf).select("row_key", "phase", "batter", "bowler", *big("y"), *rounded(6, "p", "absolute_error"))


_COND_SQL = {
    "wicket_fell": "target_wicket = 1", "six_hit": "target_six + target_boundary >= 2", "extreme_over": "y >= 20", "extras_of_two_or_more": "target_extras >= 2",
    "death_overs": "over_number >= 16", "powerplay": "over_number <= 6", "new_batter_under_6_balls": "batter_innings_balls < 6",
    "sparse_batter_history": "batter_career_balls < 120", "sparse_bowler_history": "bowler_career_balls < 120", "unseen_matchup": "batter_matchup_balls = 0",
    "required_rate_at_least_12": "required_run_rate >= 12", "high_pressure_chase": "innings = 2 AND required_run_rate >= 12",
    "second_innings_chase": "innings = 2", "cold_start_player": "support = 0", "sparse_venue": "venue_balls < 1500"}


@query("worst_error_summary", f"""
SELECT count(*) AS n, round(avg(e), 6) AS worst_mae, round(sum(e) / (SELECT sum(abs(y - {C})) FROM test_wide), 6) AS share_of_total_error,
  round(avg(CASE WHEN {C} < y THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS under_prediction_share FROM worst""")
def _worst_summary(spark, sf):
    test = part(spark, sf, groups=fc.HISTORY).withColumns({"p": F.col(C), "row_key": fc.row_key()}).withColumn("absolute_error", F.abs(F.col("y") - F.col(C)))
    return r6(m.worst_summary(test, m.worst_n(test, 100, ["row_key"])))


@query("error_lift", " UNION ALL ".join(f"""
SELECT '{n}' AS condition, count(CASE WHEN {c} THEN 1 END) AS n, round(avg(CASE WHEN {c} THEN 1 ELSE 0 END), 6) AS share,
  round(avg(CASE WHEN {c} THEN abs(y - {C}) END), 6) AS mae_when_true, round(avg(CASE WHEN NOT ({c}) THEN abs(y - {C}) END), 6) AS mae_when_false,
  round(sum(CASE WHEN {c} THEN abs(y - {C}) ELSE 0 END) / sum(abs(y - {C})), 6) AS share_of_total_error,
  round((SELECT avg(CASE WHEN {c} THEN 1 ELSE 0 END) FROM worst), 6) AS share_of_worst,
  round(CASE WHEN count(CASE WHEN {c} THEN 1 END) > 0 THEN (SELECT avg(CASE WHEN {c} THEN 1 ELSE 0 END) FROM worst) / avg(CASE WHEN {c} THEN 1 ELSE 0 END) END, 6) AS lift
FROM test_wide""" for n, c in _COND_SQL.items()))
def _lift(spark, sf):
    test = part(spark, sf).withColumns({"p": F.col(C), "row_key": fc.row_key()})
    test = test.withColumn("absolute_error", F.abs(F.col("y") - F.col("p")))
    return r6(m.error_lift(test, m.worst_n(test, 100, ["row_key"]), sg.error_conditions()))


@query("gain_attribution", f"""
SELECT phase, count(*) AS n, round(sum({_GAIN}), 6) AS gain, round(sum({_GAIN}) / sum(sum({_GAIN})) OVER (), 6) AS share FROM test_wide GROUP BY 1""")
def _gain(spark, sf):
    return r6(m.gain_attribution(part(spark, sf, groups=fc.HISTORY), "phase", D, C))


@query("representative_rows", "SELECT segment, row_key, n FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS segment, row_key, row_number() OVER (ORDER BY date, match_id, innings, over_number) - 1 AS i, count(*) OVER () AS n FROM test_wide WHERE {c}"
    for n, c in {"powerplay": "over_number <= 6", "middle": "over_number BETWEEN 7 AND 15", "death": "over_number >= 16",
                 "low_pressure_chase": "innings = 2 AND required_run_rate < 8", "high_pressure_chase": "innings = 2 AND required_run_rate >= 12",
                 "high_scoring_state": "current_run_rate >= 11", "low_scoring_state": "current_run_rate <= 6"}.items()) + ") WHERE i = floor(n / 2)")
def _representative(spark, sf):
    order = ["date", "match_id", "innings", "over_number"]
    rows = m.segment_rows(part(spark, sf), sg.situations(), order).withColumn("one", F.lit(1))
    # Slices follow the order: by date, then by the leading part of the match id.
    rows = rows.withColumn(o.SLICE, F.concat(F.col("date").cast("string"), F.substring("match_id", 1, 13)))
    ranked = o.sliced_prefix_sums(rows, ["segment"], order, {"one": "ahead"}, totals_too=True)
    return ranked.filter(F.col("ahead") == F.floor(F.col("one_total") / 2)).select(
        "segment", fc.row_key().alias("row_key"), F.col("one_total").cast("bigint").alias("n"))


# --- labels and promotion ------------------------------------------------------------------
cte("spreads", f"""
SELECT *, sqrt(greatest(0, ({' + '.join(f'{x} * {x}' for x in fc.MODELS)}) / 4 - (({' + '.join(fc.MODELS)}) / 4) ** 2)) AS spread FROM pw""")
cte("cuts", """
SELECT quantile_cont(support, 0.25) AS support_low, quantile_cont(support, 0.60) AS support_high,
  quantile_cont(spread, 0.40) AS spread_low, quantile_cont(spread, 0.80) AS spread_high FROM spreads WHERE "partition" = 'probability_calibration'""")
_LABEL = """CASE WHEN support < support_low OR spread > spread_high THEN 'LOW'
  WHEN {high} AND support >= support_high AND spread <= spread_low AND batter_matchup_balls > 0 THEN 'HIGH' ELSE 'MEDIUM' END"""
cte("trial_mae", f"""
SELECT label, avg(abs(y - {C})) AS mae FROM (SELECT *, {_LABEL.format(high='TRUE')} AS label FROM spreads, cuts WHERE "partition" = 'probability_calibration') GROUP BY 1""")
cte("high_ok", """
SELECT coalesce((SELECT mae FROM trial_mae WHERE label = 'HIGH') < (SELECT mae FROM trial_mae WHERE label = 'MEDIUM')
  AND (SELECT mae FROM trial_mae WHERE label = 'MEDIUM') < (SELECT mae FROM trial_mae WHERE label = 'LOW'), FALSE) AS ok""")
cte("labelled", f"SELECT *, {_LABEL.format(high='ok')} AS label FROM spreads, cuts, high_ok WHERE \"partition\" = 'test'")


def labelled_test(spark, sf):
    from ..operators import reliability as rl
    df = fc.predictions(spark, sf).withColumns({
        "spread": rl.spread([F.col(x) for x in fc.MODELS]), "support": sg.support()})
    reference = df.filter(F.col("partition") == "probability_calibration")
    rule = rl.fit(reference, error=F.abs(F.col("y") - F.col(C)))
    return rl.apply(df.filter(F.col("partition") == "test"), rule)


_DIFFER = "'models differ by ' || CAST(CAST(round(spread, 2) AS DECIMAL(20, 2)) AS VARCHAR) || ' runs'"
_SEEN = "'least-seen player has ' || CAST(CAST(support AS BIGINT) AS VARCHAR) || ' balls of history'"
REASON_SQL = f"""CASE label WHEN 'LOW' THEN 'Wider than usual uncertainty: ' || concat_ws(' and ',
      CASE WHEN support < support_low THEN {_SEEN} END, CASE WHEN spread > spread_high THEN {_DIFFER} END)
    WHEN 'HIGH' THEN 'Every player has history, ' || {_DIFFER} || ' and the batter has faced this bowler for ' || CAST(CAST(batter_matchup_balls AS BIGINT) AS VARCHAR) || ' balls'
    ELSE 'Ordinary support: ' || coalesce(nullif(concat_ws('; ', CASE WHEN spread > spread_low THEN {_DIFFER} END,
      CASE WHEN batter_matchup_balls = 0 THEN 'the batter has not faced this bowler' END, CASE WHEN support < support_high THEN {_SEEN} END), ''), 'ordering not verified') END"""


@query("reliability_labels", f"""
SELECT row_key, label, CAST(support AS BIGINT) AS support, round(spread, 6) AS spread, {REASON_SQL} AS reason FROM labelled""")
def _labels(spark, sf):
    from ..operators import reliability as rl
    out = labelled_test(spark, sf)
    return out.select(fc.row_key().alias("row_key"), "label", F.col("support").cast("bigint").alias("support"),
                      F.round("spread", 6).alias("spread"), rl.reason().alias("reason"))


@query("label_audit", f"""
SELECT label, count(*) AS n, round(avg(abs(y - {C})), 6) AS mae, round(avg(ceil({C} + radius) - greatest(0, floor({C} - radius))), 6) AS mean_width,
  round(avg(CASE WHEN y >= greatest(0, floor({C} - radius)) AND y <= ceil({C} + radius) THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS coverage,
  CAST((SELECT coalesce(max(CASE WHEN label = 'HIGH' THEN mae END) < max(CASE WHEN label = 'MEDIUM' THEN mae END)
    AND max(CASE WHEN label = 'MEDIUM' THEN mae END) < max(CASE WHEN label = 'LOW' THEN mae END), FALSE) FROM (SELECT label, avg(abs(y - {C})) AS mae FROM labelled GROUP BY 1)) AS BIGINT) AS ordering_holds
FROM labelled, (SELECT radius FROM radius WHERE kind = 'over_80') r GROUP BY 1""")
def _label_audit(spark, sf):
    from ..operators import reliability as rl
    radius = radii(spark, sf).filter("kind = 'over_80'").agg(F.max("radius")).scalar()
    lo, hi = m.interval_columns(F.col(C), radius)
    rows = labelled_test(spark, sf).select("label", "y", F.col(C).alias("p"), lo.cast("double").alias("lower"), hi.cast("double").alias("upper"))
    return r6(rl.audit(rows))


@query("promotion_checks", f"""
WITH e AS (SELECT model, avg(abs(y - p)) AS mae FROM test_long GROUP BY 1),
g AS (SELECT phase, sum({_GAIN}) / nullif(sum(sum({_GAIN})) OVER (), 0) AS share FROM test_wide GROUP BY 1),
c AS (SELECT kind, avg(CASE WHEN y >= lo AND y <= hi THEN CAST(1 AS DOUBLE) ELSE 0 END) AS coverage FROM intervals GROUP BY 1),
ec AS (SELECT task, sum(n * abs(o - q)) / sum(n) AS ece FROM (SELECT task, {_BIN} AS b, count(*) AS n, avg(obs) AS o, avg(conf) AS q FROM confident GROUP BY 1, 2) GROUP BY 1),
sr AS (SELECT min(share) AS worst FROM (SELECT phase, sum({_GAIN}) / count(*) AS share FROM test_wide GROUP BY 1)),
ck AS (
  SELECT 'candidate_beats_champion' AS "check", (SELECT mae FROM e WHERE model = '{C}') < (SELECT mae FROM e WHERE model = '{D}') AS passed
  UNION ALL SELECT 'improvement_not_from_one_subgroup', (SELECT coalesce(max(share), 0) <= 0.9 FROM g)
  UNION ALL SELECT 'calibration_not_degraded', (SELECT max(ece) <= 0.05 FROM ec)
  UNION ALL SELECT 'coverage_80_within_5_points', (SELECT abs(coverage - 0.8) <= 0.05 FROM c WHERE kind = 'over_80')
  UNION ALL SELECT 'coverage_95_within_5_points', (SELECT abs(coverage - 0.95) <= 0.05 FROM c WHERE kind = 'over_95')
  UNION ALL SELECT 'no_catastrophic_segment_regression', (SELECT worst >= -0.5 FROM sr))
SELECT "check", CAST(passed AS BIGINT) AS passed FROM ck UNION ALL SELECT 'promote', CAST(bool_and(passed) AS BIGINT) FROM ck""")
def _promotion(spark, sf):
    from ..operators import reliability as rl
    test = part(spark, sf, groups=fc.HISTORY)
    return rl.promotion_checks(
        mae=m.regression_metrics(long_test(spark, sf), ["model"], median=False), champion=D, candidate=C,
        gain=m.gain_attribution(test, "phase", D, C), ece=m.calibration_error(predicted(spark, sf), ["task"], "obs", "conf"),
        coverage=with_intervals(spark, sf))
