"""Model inputs, blends, walk-forward comparison and log queries."""
from pyspark.sql import functions as F

from ..operators import blend as b, encode as e, logs as lg, metrics as m, split as s
from ..plans import forecast as fc, over_table as ot, probabilities as pb
from ..sources.delivery_log import OVER_KEY, read_table
from ..streaming.live import with_outcomes
from .log_queries import big, rounded, sql_round
from .metric_queries import REASON_SQL, C, D, block_radius, labelled_test, part, r6, radii
from ..plans.forecast import staged_log
from .registry import cte, query

FEATURES = ["batter_innings_balls", "batter_career_balls", "batter_matchup_balls", "venue_balls", "current_run_rate",
            "required_minus_current_rate", "balls_per_wicket_remaining"]


_FAMILY_OF = {"batter_innings_balls": "player", "batter_career_balls": "player", "batter_career_strike_rate": "player", "non_striker_career_balls": "player",
              "bowler_career_balls": "player", "bowler_career_economy": "player", "batter_matchup_balls": "matchup", "venue_balls": "venue_team",
              "current_run_rate": "base", "current_score": "base", "current_wickets": "base", "over_number": "base", "required_run_rate": "base",
              "required_minus_current_rate": "pressure", "balls_per_wicket_remaining": "pressure"}


@query("feature_families", """
WITH f AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM smp" for f in _FAMILY_OF) + """)
SELECT feature, CASE """ + " ".join(f"WHEN feature = '{f}' THEN '{n}'" for f, n in _FAMILY_OF.items()) + """ ELSE 'base' END AS family,
  count(*) AS n, round(avg(value), 6) AS mean FROM f GROUP BY 1, 2""")
def _families(spark, sf):
    long = e.unpivot(fc.samples(spark, sf, fc.REPORT), [], list(_FAMILY_OF))
    per = long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    families = ot.feature_families(staged_log(spark, sf))
    return r6(per.withColumn("family", e.family(F.col("feature"), families)))


@query("categorical_fill", "SELECT coalesce(nullif(venue, 'V3'), 'unknown') AS venue, count(*) AS n, round(avg(target_next_over_runs), 6) AS mean_runs FROM smp GROUP BY 1")
def _fill(spark, sf):
    df = fc.samples(spark, sf, fc.STATE).withColumn("venue", F.when(F.col("venue") != "V3", F.col("venue")))
    filled = e.fill_categories(df, ["venue", "no_such_column"])
    return r6(filled.groupBy("venue").agg(F.count(F.lit(1)).alias("n"), F.avg(fc.TARGET).alias("mean_runs")))


@query("ordinal_encode", """
WITH c AS (SELECT venue, row_number() OVER (ORDER BY venue) - 1 AS code FROM (SELECT DISTINCT venue FROM smp WHERE "partition" = 'train' AND venue <> 'V3'))
SELECT s.venue, CAST(coalesce(c.code, -1) AS BIGINT) AS code, count(*) AS n FROM smp s LEFT JOIN c ON c.venue = s.venue WHERE "partition" = 'test' GROUP BY 1, 2""")
def _ordinal(spark, sf):
    df = fc.samples(spark, sf, fc.STATE)
    codes = e.ordinal_codes(df.filter((F.col("partition") == "train") & (F.col("venue") != "V3")), "venue")
    out = e.ordinal_encode(df.filter(F.col("partition") == "test"), codes, "venue", "code")
    return out.groupBy("venue", F.col("code").cast("bigint").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("recency_weights", """
SELECT CAST(date AS VARCHAR) AS date, count(*) AS n, """ + ", ".join(
    f"round(exp(-ln(2) * date_diff('day', date, (SELECT max(date) FROM smp WHERE \"partition\" = 'train')) / CAST({h} AS DOUBLE)), 9) AS weight_{h}" for h in e.HALF_LIVES)
    + " FROM smp WHERE \"partition\" = 'train' GROUP BY date")
def _recency(spark, sf):
    train = fc.samples(spark, sf, fc.STATE).filter(F.col("partition") == "train")
    newest = train.agg(F.max("date")).scalar()
    per = train.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("date").cast("string").alias("date"), "n", *[
        F.round(e.recency_weight(F.col("date"), newest, h), 9).alias(f"weight_{h}") for h in e.HALF_LIVES])


_Z = {f: (f"greatest(-8, least(8, ({f} - (SELECT avg({f}) FROM smp WHERE \"partition\" = 'train')) / "
          f"(SELECT CASE WHEN stddev_pop({f}) < 1e-6 THEN 1 ELSE stddev_pop({f}) END FROM smp WHERE \"partition\" = 'train')))") for f in FEATURES}
cte("zs", "SELECT row_key, " + ", ".join(f"{z} AS {f}" for f, z in _Z.items()) + " FROM pw WHERE \"partition\" = 'test'")


def standardized(spark, sf):
    df = fc.samples(spark, sf, fc.REPORT)
    return e.standardize(df.filter(F.col("partition") == "test"), df.filter(F.col("partition") == "train"), FEATURES)


@query("standardize_clip", "SELECT row_key, " + sql_round(6, *FEATURES) + " FROM zs")
def _standardize(spark, sf):
    return standardized(spark, sf).select(fc.row_key().alias("row_key"), *rounded(6, *FEATURES))


@query("top_contributions", "SELECT row_key, feature, CAST(rank AS BIGINT) AS rank, round(value, 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY abs(value) DESC, feature) AS rank FROM ("
       + " UNION ALL ".join(f"SELECT row_key, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM zs" for f in FEATURES) + ")) WHERE rank <= 3")
def _top(spark, sf):
    z = standardized(spark, sf).withColumn("row_key", fc.row_key())
    top = e.top_contributions(e.unpivot(z, ["row_key"], FEATURES), ["row_key"], 3)
    return top.select("row_key", "feature", F.col("rank").cast("bigint").alias("rank"), F.round("value", 6).alias("contribution"))


@query("seeded_sample", f"""
SELECT match_id, CAST(innings AS BIGINT) AS innings, CAST(over_number AS BIGINT) AS over_number, CAST({fc.TARGET} AS BIGINT) AS {fc.TARGET} FROM smp
ORDER BY md5(concat_ws('/', match_id, innings, over_number, '20260907')), match_id, innings, over_number LIMIT 200""")
def _sample(spark, sf):
    out = e.seeded_sample(fc.samples(spark, sf, fc.STATE).select(*OVER_KEY, fc.TARGET), OVER_KEY, 200, 20260907)
    return out.select("match_id", *big("innings", "over_number", fc.TARGET))


@query("feature_selection", """
WITH i AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN var_pop({f}) > 0 THEN corr({f}, y) ** 2 ELSE 0 END AS importance FROM pw WHERE \"partition\" = 'validation'" for f in FEATURES) + f"""),
p AS (SELECT avg(d) > 2 * stddev_samp(d) / sqrt(count(*)) AS significant FROM (SELECT abs(y - {D}) - abs(y - {C}) AS d FROM pw WHERE "partition" = 'validation'))
SELECT feature, round(importance, 6) AS mae_increase, CAST(CASE WHEN importance <= 0.001 THEN 1 ELSE 0 END AS BIGINT) AS dropped,
  CAST(significant AND (SELECT count(*) FROM i WHERE importance <= 0.001) > 0 AS BIGINT) AS adopt FROM i, p""")
def _selection(spark, sf):
    val = part(spark, sf, "validation")
    row = val.agg(*[e.explained_share(F.col(f).cast("double"), F.col("y").cast("double")).alias(f) for f in FEATURES])
    importance = e.unpivot(row, [], FEATURES).select("feature", F.col("value").alias("mae_increase"))
    kept, dropped = e.drop_by_importance(importance, 0.001)
    significant = m.paired_test(val, [], D, C).agg(F.max("significant")).scalar()
    some = dropped.agg(F.count(F.lit(1)) > 0).scalar()
    both = kept.withColumn("dropped", F.lit(0)).unionByName(dropped.withColumn("dropped", F.lit(1)))
    return both.select("feature", F.round("mae_increase", 6).alias("mae_increase"), *big("dropped"),
                       F.when(some, significant).otherwise(0).cast("bigint").alias("adopt"))


_SCORE = "round(12.5 - over_number * 0.25 - current_wickets * CAST(0.5 AS DOUBLE) + CASE WHEN phase = 'death' THEN 3 ELSE 0 END, 6)"


@query("dedup_score_join", f"SELECT concat_ws('/', match_id, innings, over_number) AS row_key, {_SCORE} AS score FROM smp")
def _dedup_score(spark, sf):
    c = F.col
    score = 12.5 - c("over_number") * 0.25 - c("current_wickets") * 0.5 + F.when(c("phase") == "death", 3).otherwise(0)
    out = e.distinct_score_join(fc.samples(spark, sf, fc.STATE), ["phase", "over_number", "current_wickets"], {"score": score})
    # over_number is part of both the state and the row key, so the key is built after the join
    return out.select(fc.row_key().alias("row_key"), F.round("score", 6).alias("score"))


_LOG_COLUMNS = sorted(["match_id", "date", "season", "innings", "over_number", "ball_number", "venue", "team_batting", "team_bowling", "batter", "non_striker", "bowler", "wides",
                       "noballs", "legbyes", "byes", "wicket", "bowler_wicket", "dismissed_player", "dismissal_type", "runs_batter", "legal", "batter_ball", "runs_extras",
                       "runs_total", "bowler_conceded", "boundary", "six"])


@query("table_fingerprint", "SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', " + ", ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _LOG_COLUMNS) + ")), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM fx")
def _fingerprint(spark, sf):
    return e.table_fingerprint(staged_log(spark, sf)).select("rows", F.col("digest").cast("string").alias("digest"))


# --- blends ----------------------------------------------------------------------------
cte("val", "SELECT * FROM pw WHERE \"partition\" = 'validation'")


@query("blend_search", f"""
WITH g AS (SELECT i, avg(abs(y - ((1 - i * CAST(0.05 AS DOUBLE)) * {D} + i * CAST(0.05 AS DOUBLE) * {C}))) AS mae FROM val, (SELECT unnest(range(21)) AS i) u GROUP BY 1)
SELECT round(i * CAST(0.05 AS DOUBLE), 6) AS weight, round(mae, 6) AS mae, CAST(CASE WHEN i = (SELECT i FROM g ORDER BY round(mae, 9), i LIMIT 1) THEN 1 ELSE 0 END AS BIGINT) AS best FROM g""")
def _blend(spark, sf):
    errors = b.grid_errors(part(spark, sf, "validation", fc.HISTORY), "y", [D, C], b.blend_grid())
    best = errors.agg(F.min(F.struct(F.round("mae", 9), "index"))["index"]).scalar()
    return errors.select(F.round(F.col("index") * 0.05, 6).alias("weight"), F.round("mae", 6).alias("mae"),
                         (F.col("index") == best).cast("bigint").alias("best"))


_W4 = " + ".join(f"w{i} * {x}" for i, x in enumerate(fc.MODELS))


@query("simplex_blend", f"""
WITH g AS (SELECT row_number() OVER (ORDER BY a, b, c) AS i, a / CAST(20 AS DOUBLE) AS w0, b / CAST(20 AS DOUBLE) AS w1, c / CAST(20 AS DOUBLE) AS w2, (20 - a - b - c) / CAST(20 AS DOUBLE) AS w3
  FROM (SELECT unnest(range(21)) AS a) x, (SELECT unnest(range(21)) AS b) y, (SELECT unnest(range(21)) AS c) z WHERE a + b + c <= 20),
e AS (SELECT i, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, avg(abs(y - ({_W4}))) AS mae FROM val, g GROUP BY 1),
best AS (SELECT * FROM e ORDER BY round(mae, 9), i LIMIT 1),
moves AS (SELECT 0 AS i, 0 AS a, 0 AS b, CAST(0 AS DOUBLE) AS d UNION ALL
  SELECT row_number() OVER (ORDER BY a, b, d), a, b, d FROM (SELECT unnest(range(4)) AS a) x, (SELECT unnest(range(4)) AS b) y, (SELECT unnest([CAST(0.01 AS DOUBLE), 0.02, 0.03, 0.04]) AS d) z WHERE a <> b),
n AS (SELECT m.i, {', '.join(f'w{k} - CASE WHEN a = {k} THEN d ELSE 0 END + CASE WHEN b = {k} THEN d ELSE 0 END AS w{k}' for k in range(4))} FROM best, moves m),
n2 AS (SELECT * FROM n WHERE w0 > -1e-9 AND w1 > -1e-9 AND w2 > -1e-9 AND w3 > -1e-9),
e2 AS (SELECT i, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, avg(abs(y - ({_W4}))) AS mae FROM val, n2 GROUP BY 1),
fin AS (SELECT * FROM e2 ORDER BY round(mae, 9), i LIMIT 1),
single AS (SELECT model, avg(abs(y - p)) AS mae FROM pl WHERE "partition" = 'validation' GROUP BY 1 ORDER BY 2 LIMIT 1)
SELECT m.model, round(CASE WHEN round(fin.mae, 9) < round(single.mae, 9) THEN m.w ELSE CASE WHEN m.model = single.model THEN 1 ELSE 0 END END, 6) AS weight,
  round(least(fin.mae, single.mae), 6) AS mae
FROM ({' UNION ALL '.join(f"SELECT '{x}' AS model, w{i} AS w FROM fin" for i, x in enumerate(fc.MODELS))}) m, fin, single""")
def _simplex(spark, sf):
    weights, mae = b.simplex_search(part(spark, sf, "validation", fc.HISTORY), "y", fc.MODELS)
    cells = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(round(w, 6)).alias("weight")) for n, w in weights.items()])
    base = part(spark, sf, "validation", fc.HISTORY).agg(F.count(F.lit(1)).alias("_n"))
    return base.select(F.explode(cells).alias("c")).select("c.model", F.abs("c.weight").alias("weight"), F.lit(round(mae, 6)).alias("mae"))


# --- components -------------------------------------------------------------------------
_PARTS = {"batter_runs": "target_batter_runs", "non_striker_runs": "target_non_striker_runs", "extras": "target_extras",
          "other_batters": "target_other_batters", "bowler_conceded": "target_bowler_conceded", "balls": "target_batter_balls"}
cte("comp", "SELECT over_number, " + ", ".join(f"avg({t}) AS c_{n}" for n, t in _PARTS.items())
    + ", avg(target_batter_runs / CAST(greatest(target_batter_balls, 1) AS DOUBLE)) AS c_rate FROM smp WHERE \"partition\" = 'train' GROUP BY 1")
_SUM4 = "(c_batter_runs + c_non_striker_runs + c_extras + c_other_batters)"


def with_components(spark, sf, partition):
    """Component means per over number (at most twenty rows) joined to one partition."""
    df = fc.predictions(spark, sf, fc.HISTORY)
    return df.filter(F.col("partition") == partition).join(F.broadcast(component_means(spark, sf)), "over_number")


def component_means(spark, sf):
    rate = F.avg(F.col("target_batter_runs") / F.greatest(F.col("target_batter_balls"), F.lit(1))).alias("c_rate")
    return fc.predictions(spark, sf, fc.HISTORY).filter(F.col("partition") == "train").groupBy("over_number").agg(
        *[F.avg(t).alias(f"c_{n}") for n, t in _PARTS.items()], rate)


@query("reconcile_components", f"""
SELECT row_key, {', '.join(f"round(CASE WHEN {_SUM4} <= 1e-9 THEN {'recent_run_rate' if n == 'other_batters' else '0'} ELSE c_{n} * recent_run_rate / greatest({_SUM4}, 1e-9) END, 6) AS {n}" for n in b.COMPONENTS)},
  round(least(c_bowler_conceded, recent_run_rate), 6) AS bowler_conceded
FROM test_wide JOIN comp USING (over_number)""")
def _reconcile(spark, sf):
    df = with_components(spark, sf, "test")
    out = b.reconcile(F.col("recent_run_rate"), {n: F.col(f"c_{n}") for n in b.COMPONENTS}, F.col("c_bowler_conceded"))
    return df.select(fc.row_key().alias("row_key"), *[F.round(c, 6).alias(n) for n, c in out.items()])


_R6 = lambda x, n: f"round({x}, 6) AS {n}"
_KIND_SUFFIX = {"over_80": "80", "over_95": "95", "match_80": "match"}


@query("forecast_rows", f"""
WITH ev AS (SELECT row_key, {', '.join(f"max(CASE WHEN task = '{t}' THEN p END) AS {t}_probability" for t in pb.EVENTS)} FROM bin_test GROUP BY 1),
bk AS (SELECT row_key, {', '.join(f"max(CASE WHEN k = {i} THEN p END) AS bucket_{i}_probability" for i in range(pb.CLASSES))} FROM prk WHERE task = 'run_bucket' GROUP BY 1),
rd AS (SELECT {', '.join(f"max(CASE WHEN kind = '{k}' THEN radius END) AS r_{x}" for k, x in _KIND_SUFFIX.items())} FROM radius)
SELECT row_key, {_R6(C, 'expected_runs')},
  {', '.join(f"CAST(greatest(0, floor({C} - r_{x})) AS DOUBLE) AS lower_{x}, CAST(ceil({C} + r_{x}) AS DOUBLE) AS upper_{x}" for x in _KIND_SUFFIX.values())},
  {', '.join(_R6(f"CASE WHEN {_SUM4} <= 1e-9 THEN {C if n == 'other_batters' else '0'} ELSE c_{n} * {C} / greatest({_SUM4}, 1e-9) END", f'expected_{n}') for n in b.COMPONENTS)},
  {_R6(f'least(c_bowler_conceded, {C})', 'expected_bowler_conceded')}, label, {REASON_SQL} AS reason,
  {', '.join(_R6(f'{t}_probability', f'{t}_probability') for t in pb.EVENTS)}, {', '.join(_R6(f'bucket_{i}_probability', f'bucket_{i}_probability') for i in range(pb.CLASSES))}
FROM labelled JOIN comp USING (over_number) JOIN ev USING (row_key) JOIN bk USING (row_key), rd""")
def _forecast_rows(spark, sf):
    from ..plans.forecast_row import forecast_rows, wide_events
    means = component_means(spark, sf)
    rows = labelled_test(spark, sf).join(F.broadcast(means), "over_number").withColumn("row_key", fc.row_key())     # at most twenty rows
    found = radii(spark, sf).unionByName(block_radius(spark, sf))
    by_kind = {x: found.filter(F.col("kind") == k).agg(F.max("radius")).scalar() for k, x in _KIND_SUFFIX.items()}
    events = wide_events(pb.event_table(spark, sf).filter("partition = 'test'"), pb.EVENTS)
    buckets = pb.probability_table(spark, sf).filter("task = 'run_bucket'")
    return r6(forecast_rows(rows, F.col(C), by_kind, events, buckets, pb.CLASSES))


@query("batter_mode", f"""
WITH r AS (SELECT target_batter_runs AS y, c_batter_runs * over_number_mean / {_SUM4} AS direct,
  c_balls * c_rate * over_number_mean / (c_balls * c_rate + c_non_striker_runs + c_extras + c_other_batters) AS staged FROM val JOIN comp USING (over_number))
SELECT round(avg(abs(y - direct)), 6) AS direct_mae, round(avg(abs(y - staged)), 6) AS two_stage_mae,
  CASE WHEN avg(abs(y - staged)) < avg(abs(y - direct)) THEN 'two_stage' ELSE 'direct' END AS mode FROM r""")
def _mode(spark, sf):
    df = with_components(spark, sf, "validation")
    parts = {n: F.col(f"c_{n}") for n in b.COMPONENTS}
    staged = {**parts, "batter_runs": F.col("c_balls") * F.col("c_rate")}
    total, conceded = F.col("over_number_mean"), F.col("c_bowler_conceded")
    error = lambda p: F.avg(F.abs(F.col("target_batter_runs") - b.reconcile(total, p, conceded)["batter_runs"]))
    got = df.agg(error(parts).alias("direct_mae"), error(staged).alias("two_stage_mae"))
    mode = F.when(F.col("two_stage_mae") < F.col("direct_mae"), "two_stage").otherwise("direct")
    return got.select(F.round("direct_mae", 6).alias("direct_mae"), F.round("two_stage_mae", 6).alias("two_stage_mae"), mode.alias("mode"))


# --- walk-forward -------------------------------------------------------------------------
cte("wf_rows", "SELECT f.test_season, f.part, s.* FROM folds f JOIN smp s ON s.date = f.date WHERE f.strategy = 'refit_plus' AND f.part IS NOT NULL")
cte("wf", """
SELECT t.test_season AS season, t.target_next_over_runs AS y, m.v AS league_mean, coalesce(o.v, m.v) AS over_number_mean,
  CASE WHEN t.over_number > 1 THEN t.current_run_rate ELSE m.v END AS recent_run_rate,
  3 * t.batter_career_strike_rate / 100 + CAST(0.5 AS DOUBLE) * t.bowler_career_economy AS batter_bowler_history
FROM wf_rows t JOIN (SELECT test_season, avg(target_next_over_runs) AS v FROM wf_rows WHERE part IN ('train', 'validation', 'refit_extra') GROUP BY 1) m USING (test_season)
LEFT JOIN (SELECT test_season, over_number, avg(target_next_over_runs) AS v FROM wf_rows WHERE part IN ('train', 'validation', 'refit_extra') GROUP BY 1, 2) o
  ON o.test_season = t.test_season AND o.over_number = t.over_number WHERE t.part = 'test'""")


def _arm_sql(a):
    ref = "league_mean"
    d = f"(abs(y - {ref}) - abs(y - {a}))"
    se = f"(stddev_samp({d}) / sqrt(count(*)))"
    tested = a != ref
    return (f"SELECT '{a}' AS arm, count(*) AS n, round(avg(abs(y - {a})), 6) AS pooled_mae, "
            f"(SELECT round(avg(e), 6) FROM (SELECT avg(abs(y - {a})) AS e FROM wf GROUP BY season)) AS mean_season_mae, "
            f"(SELECT round(stddev_pop(e), 6) FROM (SELECT avg(abs(y - {a})) AS e FROM wf GROUP BY season)) AS season_mae_spread, "
            f"(SELECT round(max(e), 6) FROM (SELECT avg(abs(y - {a})) AS e FROM wf GROUP BY season)) AS worst_season_mae, "
            + (f"round(avg({d}), 6) AS mae_improvement, round({se}, 6) AS standard_error, round(avg({d}) / {se}, 6) AS z, CAST(CASE WHEN avg({d}) > 2 * {se} THEN 1 ELSE 0 END AS BIGINT) AS significant"
               if tested else "NULL AS mae_improvement, NULL AS standard_error, NULL AS z, NULL AS significant") + " FROM wf")


@query("walk_forward", "SELECT *, row_number() OVER (ORDER BY pooled_mae, arm) AS rank FROM (" + " UNION ALL ".join(_arm_sql(a) for a in fc.MODELS) + ")")
def _walk_forward(spark, sf):
    df = fc.samples(spark, sf, fc.HISTORY)
    labels = s.walk_forward_labels(df, strategies=["refit_plus"]).drop("strategy")      # one row per day and fold
    rows = df.drop("partition").join(F.broadcast(labels), "date")
    fitted = rows.filter(F.col("partition").isin(s.FITTED)).groupBy("test_season", "over_number").agg(
        F.sum(fc.TARGET).alias("t"), F.count(F.lit(1)).alias("k"))
    league = fitted.groupBy("test_season").agg((F.sum("t") / F.sum("k")).alias("league_mean"))
    test = rows.filter(F.col("partition") == "test").join(F.broadcast(league), "test_season") \
        .join(F.broadcast(fitted), ["test_season", "over_number"], "left")               # folds x twenty over numbers
    c = F.col
    arms = test.select(
        c("test_season").alias("season"), c(fc.TARGET).alias("y"), "league_mean",
        F.coalesce(c("t") / c("k"), c("league_mean")).alias("over_number_mean"),
        F.when(c("over_number") > 1, c("current_run_rate")).otherwise(c("league_mean")).alias("recent_run_rate"),
        (3 * c("batter_career_strike_rate") / 100 + 0.5 * c("bowler_career_economy")).alias("batter_bowler_history"))
    return r6(b.arm_report(arms, "league_mean"))


# --- logs ---------------------------------------------------------------------------------
@query("scalar_json_props", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_max,
  min(substr(sha256(props), 1, 16)) AS first_hash, min(upper(event_type)) AS label FROM events GROUP BY 1""")
def _json(spark, sf):
    ev = read_table(spark, sf, "events").select("event_type", "props", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"),
        F.min(F.substring(F.sha2("props", 256), 1, 16)).alias("first_hash"), F.min(F.upper("event_type")).alias("label"))


@query("freshness_gate", """
SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM (
  SELECT CASE WHEN k - 10 > 30 THEN 'stale' WHEN k - 10 < -5 THEN 'future' WHEN user_id % 7 <> event_id % 7 THEN 'different_match' END AS reason
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) GROUP BY 1""")
def _freshness(spark, sf):
    ev = read_table(spark, sf, "events")
    observed = F.col("ts").cast("timestamp")
    arrived = F.timestamp_seconds(F.unix_micros(observed) / 1e6 + F.get_json_object("props", "$.k").cast("bigint") - 10)
    age = F.round((F.unix_micros(arrived) - F.unix_micros(observed)) / 1e6)
    reason = lg.freshness_reason(age, F.col("user_id") % 7, F.col("event_id") % 7)
    return ev.groupBy(F.coalesce(reason, F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def prediction_requests(events):
    """Prediction requests: every event, its id from the model version and the (user, day) state."""
    ts = F.col("ts").cast("timestamp")
    state = F.concat_ws("|", F.col("user_id").cast("string"), F.date_format(ts, "yyyy-MM-dd"))
    version = F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string"))
    return events.select(lg.prediction_id(version, state).alias("id"), version.alias("version"), ts.alias("ts"), "event_id", "value")


cte("requests", """
SELECT sha256('v' || CAST(user_id % 2 AS VARCHAR) || CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d')) AS id, ts, event_id, value FROM events""")


@query("idempotent_log", "SELECT id, arg_min(event_id, ts) AS event_id, round(arg_min(value, ts), 6) AS value, count(*) AS arrivals FROM requests GROUP BY 1")
def _idempotent(spark, sf):
    log = prediction_requests(read_table(spark, sf, "events"))
    return lg.first_per_id(log, "id", "ts", ["event_id", "value"]).select("id", "event_id", F.round("value", 6).alias("value"), "arrivals")


@query("outcome_reconcile", """
WITH p AS (SELECT DISTINCT id FROM requests WHERE event_id % 3 = 0),
o AS (SELECT id, CAST(floor(value) AS BIGINT) % 2 AS runs FROM requests WHERE event_id % 3 = 1)
SELECT o.id, CAST(count(*) AS BIGINT) AS reports, CASE WHEN max(p.id) IS NULL THEN 'unknown' WHEN min(runs) <> max(runs) THEN 'conflict' ELSE 'recorded' END AS status,
  CASE WHEN max(p.id) IS NOT NULL AND min(runs) = max(runs) THEN min(runs) END AS runs FROM o LEFT JOIN p ON p.id = o.id GROUP BY o.id""")
def _outcome(spark, sf):
    log = prediction_requests(read_table(spark, sf, "events"))
    predictions = log.filter(F.col("event_id") % 3 == 0)
    outcomes = log.filter(F.col("event_id") % 3 == 1).withColumn("runs", F.floor("value") % 2)
    return lg.reconcile_outcomes(predictions, outcomes, "id", "runs").select("id", "status", *big("reports", "runs"))


cte("records", f"""
SELECT t.date, t.row_key, CASE WHEN t.over_number = 20 AND t.innings = 2 THEN 'v2' WHEN t.over_number % 2 = 0 THEN 'v0' ELSE 'v1' END AS version,
  CASE WHEN t.over_number <> 7 THEN t.y END AS y, t.{C} AS p, greatest(0, floor(t.{C} - 6)) AS lo, ceil(t.{C} + 6) AS hi, e.y AS wicket, e.p AS wicket_p
FROM test_wide t JOIN ev_p e ON e.row_key = t.row_key AND e.task = 'wicket'""")


@query("monitoring_by_version", """
SELECT version, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, """ + ", ".join(f"round(CASE WHEN count(*) > 1 THEN {x} END, 6) AS {n}" for n, x in {
    "rmse": "sqrt(avg((y - p) * (y - p)))", "r2": "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))",
    **{f"within_{t}": f"avg(CASE WHEN abs(y - p) <= {t} THEN CAST(1 AS DOUBLE) ELSE 0 END)" for t in (1, 2, 3, 4)}}.items()) + """,
  round(avg(CASE WHEN y >= lo AND y <= hi THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS interval_coverage, round(avg((wicket_p - wicket) ** 2), 6) AS wicket_brier
FROM records WHERE y IS NOT NULL GROUP BY 1""")
def _monitoring(spark, sf):
    c = F.col
    wicket = pb.event_table(spark, sf).filter(c("task") == "wicket").select("row_key", c("y").alias("wicket"), c("p").alias("wicket_p"))
    lo, hi = m.interval_columns(c(C), F.lit(6.0))
    version = F.when((c("over_number") == 20) & (c("innings") == 2), "v2").when(c("over_number") % 2 == 0, "v0").otherwise("v1")
    rows = part(spark, sf, groups=fc.HISTORY).withColumn("row_key", fc.row_key())
    # Two logs: every prediction, and the outcomes reported so far; predictions without one await it.
    predictions = rows.select("row_key", version.alias("version"), c(C).alias("p"), lo.alias("lower"), hi.alias("upper")).join(wicket, "row_key")
    outcomes = rows.filter(c("over_number") != 7).select("row_key", "y")
    records = with_outcomes(predictions, outcomes, "row_key")
    return r6(lg.monitoring(records))


@query("replay_last_matches", f"""
WITH last2 AS (SELECT match_id FROM (SELECT DISTINCT date, match_id FROM test_wide) ORDER BY date DESC, match_id DESC LIMIT 2)
SELECT row_key, CAST(date AS VARCHAR) || ' - ' || team_batting || ' - over ' || CAST(over_number AS VARCHAR) AS label,
  'Player ' || batter AS batter, 'Player ' || bowler AS bowler, CAST(y AS BIGINT) AS actual_runs, round({C}, 6) AS expected_runs
FROM test_wide WHERE match_id IN (SELECT match_id FROM last2)""")
def _replay(spark, sf):
    from ..plans.replay import last_matches, replay_rows
    test = part(spark, sf, groups=fc.HISTORY)
    names = test.select(F.explode(F.array("batter", "non_striker", "bowler")).alias("player_id")).distinct() \
        .withColumn("display_name", F.concat(F.lit("Player "), "player_id"))
    rows = replay_rows(last_matches(test, 2), names, C)
    return rows.select("row_key", "label", "batter", "bowler", *big("actual_runs"), F.round("expected_runs", 6).alias("expected_runs"))
