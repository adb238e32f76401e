"""As-of history, form and feature-store queries."""
from pyspark.sql import functions as F

from ..functions.rates import MEASURES, shrunk_rates
from ..operators import asof, history as h, windows as w
from .log_queries import big, rounded
from ..plans.forecast import staged_log
from .registry import cte, query

# Measures per ball: name -> SQL over fx, outs given per family.
_M = {"runs": "runs_batter", "balls": "batter_ball", "outs": "bowler_wicket", "boundaries": "boundary", "sixes": "six",
      "dots": "CASE WHEN runs_total = 0 THEN 1 ELSE 0 END", "conceded": "bowler_conceded", "legal": "legal"}


def _measures(outs="bowler_wicket", runs="runs_batter"):
    m = {**_M, "outs": outs, "runs": runs}
    return ", ".join(f"{v} AS {n}" for n, v in m.items())


def _sum(alias="", cast=True):
    return ", ".join(f"CAST(coalesce(sum({alias}{m}), 0) AS BIGINT) AS {m}" for m in MEASURES)


cte("bat_ev", f"""
SELECT date, season, phase, batter AS player, {_measures('0')} FROM fx
UNION ALL SELECT date, season, 'none', dismissed_player, 0, 0, 1, 0, 0, 0, 0, 0 FROM fx WHERE dismissed_player <> ''""")
cte("bowl_ev", f"SELECT date, season, phase, batter, bowler AS player, {_measures()} FROM fx")
cte("ctx_ev", f"SELECT date, venue, over_number, phase, team_batting, team_bowling, {_measures('wicket', 'runs_total')} FROM fx")
cte("bat_day", f"SELECT player, season, date, {_sum()} FROM bat_ev GROUP BY 1, 2, 3")
cte("bowl_day", f"SELECT player, season, date, {_sum()} FROM bowl_ev GROUP BY 1, 2, 3")
cte("league_day", f"SELECT season, date, {_sum()} FROM bowl_ev GROUP BY 1, 2")
cte("league_asof", "SELECT p.date, " + ", ".join(
    f"CAST(coalesce(sum(f.{m}), 0) AS BIGINT) AS league_{m}, "
    f"CAST(coalesce(sum(CASE WHEN f.season = p.season THEN f.{m} END), 0) AS BIGINT) AS season_{m}" for m in MEASURES)
    + " FROM league_day p LEFT JOIN league_day f ON f.date < p.date GROUP BY 1")
cte("bat_probe", "SELECT DISTINCT player, date FROM (SELECT batter AS player, date FROM opening UNION ALL SELECT non_striker, date FROM opening)")
cte("bowl_probe", "SELECT DISTINCT bowler AS player, date FROM opening")
cte("bat_career", f"SELECT p.player, p.date, {_sum('f.')} FROM bat_probe p LEFT JOIN bat_day f ON f.player = p.player AND f.date < p.date GROUP BY 1, 2")
cte("bowl_career", f"SELECT p.player, p.date, {_sum('f.')} FROM bowl_probe p LEFT JOIN bowl_day f ON f.player = p.player AND f.date < p.date GROUP BY 1, 2")


def sql_shrunk(own="", league="league_", prefix=""):
    """Shrunk rates in SQL, unrounded."""
    def per_ball(m):
        return (f"(({own}{m} + 24 * {league}{m} / CAST(greatest({league}balls, 1) AS DOUBLE)) "
                f"/ ({own}balls + 24))")
    return {
        f"{prefix}average": f"({own}runs / CAST(greatest({own}outs, 1) AS DOUBLE))",
        f"{prefix}strike_rate": f"(100 * {per_ball('runs')})",
        f"{prefix}boundary_rate": per_ball("boundaries"),
        f"{prefix}six_rate": per_ball("sixes"),
        f"{prefix}dot_rate": per_ball("dots"),
        f"{prefix}economy": f"(6 * ({own}conceded + 24 * {league}conceded / CAST(greatest({league}legal, 1) AS DOUBLE)) / ({own}legal + 24))",
    }


def bat_probes(log):
    return w.over_starts(log).select("date", F.explode(F.array("batter", "non_striker")).alias("player"))


def bowl_probes(log):
    return w.over_starts(log).select("date", F.col("bowler").alias("player"))


def day(df):
    return df.withColumn("date", F.col("date").cast("string"))


@query("asof_career", f"SELECT player, CAST(date AS VARCHAR) AS date, {', '.join(MEASURES)} FROM bat_career")
def _asof_career(spark, sf):
    log = staged_log(spark, sf)
    probes = bat_probes(log)
    facts = h.kind_facts(log, "bat").withColumnRenamed("batter", "player")
    totals = asof.asof_totals(facts, probes, ["player"], MEASURES)
    asked = probes.distinct()
    return day(totals.join(asked, ["player", "date"], "left_semi")).select("player", "date", *big(*MEASURES))


@query("shrunk_rates", "SELECT player, CAST(date AS VARCHAR) AS date, "
       + ", ".join(f"round({e}, 9) AS {n}" for n, e in sql_shrunk().items())
       + " FROM bat_career JOIN league_asof USING (date)")
def _shrunk_rates(spark, sf):
    log = staged_log(spark, sf)
    probes = bat_probes(log)
    facts = h.kind_facts(log, "bat").withColumnRenamed("batter", "player")
    totals = asof.asof_totals(facts, probes, ["player"], MEASURES)
    asked = totals.join(probes.distinct(), ["player", "date"], "left_semi")
    rates = shrunk_rates()
    names = [n for n in rates if n not in MEASURES]
    return day(h.join_league(asked, h.league_asof(log)).select("player", "date", *[F.round(rates[n], 9).alias(n) for n in names]))


_KIND_KEYS = {kind: " || '|' || ".join(f"CAST({'player' if c == 'bowler' else c} AS VARCHAR)" for c in sorted(keys)) or "''"
              for kind, keys in h.KINDS.items()}
_KIND_SRC = {kind: ("ctx_ev" if kind in h.CONTEXT_KINDS else "bat_ev" if kind.startswith("bat") else "bowl_ev") for kind in h.KINDS}


def _kind_sql(kind):
    key = _KIND_KEYS[kind]
    if kind.startswith("bat"):
        key = key.replace("CAST(batter AS", "CAST(player AS")
    where = " WHERE phase <> 'none'" if kind == "bat_phase" else ""
    return f"SELECT '{kind}' AS kind, {key} AS key, {_sum()} FROM {_KIND_SRC[kind]}{where} GROUP BY 2"


@query("history_kinds", " UNION ALL ".join(_kind_sql(kind) for kind in h.KINDS))
def _history_kinds(spark, sf):
    return h.history_kinds(staged_log(spark, sf)).select("kind", "key", *big(*MEASURES))


@query("outs_attribution", """
SELECT player, CAST(sum(bat) AS BIGINT) AS batting_outs, CAST(sum(phase) AS BIGINT) AS phase_outs,
  CAST(sum(faced) AS BIGINT) AS wickets_while_facing, CAST(sum(credited) AS BIGINT) AS bowler_wickets_while_facing FROM (
  SELECT dismissed_player AS player, 1 AS bat, 0 AS phase, 0 AS faced, 0 AS credited FROM fx WHERE dismissed_player <> ''
  UNION ALL SELECT batter, 0, 0, wicket, bowler_wicket FROM fx) GROUP BY 1""")
def _outs_attribution(spark, sf):
    log = staged_log(spark, sf)
    outs = h.kind_totals(log, "bat").select(F.col("batter").alias("player"), F.col("outs").alias("batting_outs"))
    phase = h.kind_totals(log, "bat_phase").groupBy(F.col("batter").alias("player")).agg(F.sum("outs").alias("phase_outs"))
    faced = log.groupBy(F.col("batter").alias("player")).agg(
        F.sum("wicket").alias("wickets_while_facing"), F.sum("bowler_wicket").alias("bowler_wickets_while_facing"))
    out = outs.join(phase, "player", "full").join(faced, "player", "full")
    names = ["batting_outs", "phase_outs", "wickets_while_facing", "bowler_wickets_while_facing"]
    return out.select("player", *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names])


_ERA_SQL = {
    "era_strike_rate": "CASE WHEN season_balls >= 600 THEN 100 * season_runs / CAST(season_balls AS DOUBLE) ELSE 100 * league_runs / greatest(CAST(league_balls AS DOUBLE), 1e-9) END",
    "era_boundary_rate": "CASE WHEN season_balls >= 600 THEN season_boundaries / CAST(season_balls AS DOUBLE) ELSE league_boundaries / greatest(CAST(league_balls AS DOUBLE), 1e-9) END",
    "era_economy": "CASE WHEN season_legal >= 600 THEN 6 * season_conceded / CAST(season_legal AS DOUBLE) ELSE 6 * league_conceded / greatest(CAST(league_legal AS DOUBLE), 1e-9) END",
}


@query("era_baseline", "SELECT CAST(date AS VARCHAR) AS date, season_balls AS era_balls_observed, "
       + ", ".join(f"round({e}, 9) AS {n}" for n, e in _ERA_SQL.items()) + " FROM league_asof")
def _era_baseline(spark, sf):
    return day(h.era_baseline(staged_log(spark, sf))).select(
        "date", *big("era_balls_observed"), *rounded(9, *_ERA_SQL))


cte("ctx_day", f"SELECT date, venue, over_number, phase, team_batting, team_bowling, {_sum()} FROM ctx_ev GROUP BY ALL")
_CTX = ["venue", "venue_over", "venue_phase", "team", "opposition", "head_to_head"]


def _ctx_sql(kind):
    keys = h.CONTEXT_KINDS[kind]
    match = " AND ".join(f"f.{c} = o.{c}" for c in keys)
    names = ", ".join(f"o.{c}" for c in keys)
    return (f"SELECT '{kind}' AS kind, concat_ws('|', {names}) AS key, CAST(o.date AS VARCHAR) AS date, "
            f"round(6 * coalesce(sum(runs), 0) / CAST(greatest(coalesce(sum(legal), 0), 1) AS DOUBLE), 9) AS run_rate, "
            f"CAST(coalesce(sum(legal), 0) AS BIGINT) AS balls, "
            f"round(coalesce(sum(boundaries), 0) / CAST(greatest(coalesce(sum(balls), 0), 1) AS DOUBLE), 9) AS boundary_rate, "
            f"round(coalesce(sum(outs), 0) / CAST(greatest(coalesce(sum(balls), 0), 1) AS DOUBLE), 9) AS wicket_rate "
            f"FROM (SELECT DISTINCT date, {', '.join(keys)} FROM opening) o LEFT JOIN ctx_day f ON {match} AND f.date < o.date "
            f"GROUP BY {', '.join('o.' + c for c in keys)}, o.date")


@query("context_rates", " UNION ALL ".join(_ctx_sql(kind) for kind in _CTX))
def _context_rates(spark, sf):
    log = staged_log(spark, sf)
    out = None
    for kind in _CTX:
        keys = h.CONTEXT_KINDS[kind]
        totals = h.context_totals(log, kind)
        rates = totals.select(*keys, "date", *[c.alias(n) for n, c in h.context_rates(f"{kind}_").items()])
        part = day(rates).select(
            F.lit(kind).alias("kind"), F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("key"), "date",
            F.round(f"{kind}_run_rate", 9).alias("run_rate"), F.col(f"{kind}_balls").cast("bigint").alias("balls"),
            F.round(f"{kind}_boundary_rate", 9).alias("boundary_rate"), F.round(f"{kind}_wicket_rate", 9).alias("wicket_rate"))
        out = part if out is None else out.unionByName(part)
    return out


@query("history_cutoff", """
SELECT CAST(p.date AS VARCHAR) AS date, CAST(max(f.date) AS VARCHAR) AS history_through,
  CAST(CASE WHEN max(f.date) >= p.date THEN 1 ELSE 0 END AS BIGINT) AS leaks
FROM (SELECT DISTINCT date FROM fx) p LEFT JOIN (SELECT DISTINCT date FROM fx) f ON f.date < p.date GROUP BY p.date""")
def _history_cutoff(spark, sf):
    cut = asof.history_cutoff(staged_log(spark, sf))
    return cut.select(F.col("date").cast("string").alias("date"), F.col("history_through").cast("string").alias("history_through"),
                      F.when(F.col("history_through") >= F.col("date"), 1).otherwise(0).cast("bigint").alias("leaks"))


@query("bootstrap_filter", """
SELECT CAST(o.date AS VARCHAR) AS date, count(*) AS overs_kept, max(l.league_balls) AS league_balls
FROM opening o JOIN league_asof l ON l.date = o.date WHERE l.league_balls >= 1000 GROUP BY 1""")
def _bootstrap_filter(spark, sf):
    log = staged_log(spark, sf)
    ready = h.bootstrap_ready(h.league_asof(log))
    kept = h.join_league(w.over_starts(log).select("date"), ready)
    return day(kept.groupBy("date").agg(F.count(F.lit(1)).alias("overs_kept"), F.max("league_balls").alias("league_balls")))


# Form entries per (player, match), with the naive rank among entries before the probe date.
for _role, _player in (("bat", "batter"), ("bowl", "bowler")):
    cte(f"{_role}_entry", f"SELECT player, date, match_id, {_sum()} FROM (SELECT {_player} AS player, date, match_id, {_measures('0')} FROM fx) GROUP BY 1, 2, 3")
    cte(f"{_role}_form", f"""
SELECT * FROM (
  SELECT p.player, p.date, e.date AS entry_date, {', '.join('e.' + m for m in MEASURES)},
    row_number() OVER (PARTITION BY p.player, p.date ORDER BY e.date DESC, e.match_id DESC) - 1 AS age
  FROM {_role}_probe p LEFT JOIN {_role}_entry e ON e.player = p.player AND e.date < p.date) WHERE age < 25""")


def _roles_sql(template):
    """Union of one text for both roles; $R is the role."""
    return " UNION ALL ".join(template.replace("$R", r) for r in ("bat", "bowl"))


def _form_roles(spark, sf, columns):
    log = staged_log(spark, sf)
    out = None
    for role, probes in (("bat", bat_probes(log)), ("bowl", bowl_probes(log))):
        form = h.form_asof(log, probes, role)
        part = day(form.select(F.lit(role).alias("role"), "player", "date", *columns))
        out = part if out is None else out.unionByName(part)
    return out


def _n(n):
    total = lambda m: f"coalesce(sum(CASE WHEN age < {n} THEN {m} END), 0)"
    return (f"round({total('runs')} / CAST(greatest(count(CASE WHEN age < {n} AND entry_date IS NOT NULL THEN 1 END), 1) AS DOUBLE), 9) AS recent_{n}_mean_runs, "
            f"round(100 * {total('runs')} / CAST(greatest({total('balls')}, 1) AS DOUBLE), 9) AS recent_{n}_sr, "
            f"round(6 * {total('conceded')} / CAST(greatest({total('legal')}, 1) AS DOUBLE), 9) AS recent_{n}_economy")


@query("recent_form", _roles_sql(f"SELECT '$R' AS role, player, CAST(date AS VARCHAR) AS date, {_n(5)}, {_n(10)} FROM $R_form GROUP BY player, date"))
def _recent_form(spark, sf):
    cols = {**h.recent_columns("bat", ""), **h.recent_columns("bowl", "")}
    return _form_roles(spark, sf, [F.round(c, 9).alias(n) for n, c in cols.items()])


def _ewma(d):
    total = lambda m: f"coalesce(sum(exp(-{d} * age) * {m}), 0)"
    tag = str(d).replace(".", "_")
    return ", ".join(f"round({num} / greatest({total(den)}, 1e-9), 9) AS ewma{tag}_{name}" for name, num, den in (
        ("runs_per_ball", total("runs"), "balls"), ("boundary_rate", total("boundaries"), "balls"),
        ("dot_rate", total("dots"), "balls"), ("economy", "6 * " + total("conceded"), "legal")))


@query("ewma_form", _roles_sql(f"SELECT '$R' AS role, player, CAST(date AS VARCHAR) AS date, {_ewma(0.15)}, {_ewma(0.4)} FROM $R_form GROUP BY player, date"))
def _ewma_form(spark, sf):
    return _form_roles(spark, sf, [F.round(c, 9).alias(n) for n, c in h.decayed_columns("").items()])


def _cal(days):
    inside = f"date_diff('day', entry_date, date) <= {days}"
    total = lambda m: f"coalesce(sum(CASE WHEN {inside} THEN {m} END), 0)"
    return (f"CAST(count(CASE WHEN {inside} THEN 1 END) AS DOUBLE) AS last_{days}d_innings, "
            f"round({total('runs')} / greatest(CAST({total('balls')} AS DOUBLE), 1e-9), 9) AS last_{days}d_runs_per_ball, "
            f"round(6 * {total('conceded')} / greatest(CAST({total('legal')} AS DOUBLE), 1e-9), 9) AS last_{days}d_economy")


@query("calendar_form", _roles_sql(f"SELECT '$R' AS role, player, CAST(date AS VARCHAR) AS date, {_cal(90)}, {_cal(365)} FROM $R_form GROUP BY player, date"))
def _calendar_form(spark, sf):
    return _form_roles(spark, sf, [F.round(c, 9).alias(n) for n, c in h.calendar_columns("").items()])


_POS = ["mean_position", "share_top3", "share_position_4_6", "share_position_7_plus"]


@query("position_shares", """
SELECT p.player, CAST(p.date AS VARCHAR) AS date, count(f.position) AS innings_seen,
  round(coalesce(sum(f.position), 0) / CAST(greatest(count(f.position), 1) AS DOUBLE), 9) AS mean_position,
  round(count(CASE WHEN f.position <= 3 THEN 1 END) / CAST(greatest(count(f.position), 1) AS DOUBLE), 9) AS share_top3,
  round(count(CASE WHEN f.position BETWEEN 4 AND 6 THEN 1 END) / CAST(greatest(count(f.position), 1) AS DOUBLE), 9) AS share_position_4_6,
  round(count(CASE WHEN f.position >= 7 THEN 1 END) / CAST(greatest(count(f.position), 1) AS DOUBLE), 9) AS share_position_7_plus
FROM bat_probe p LEFT JOIN faced f ON f.batter = p.player AND f.date < p.date GROUP BY p.player, p.date""")
def _position_shares(spark, sf):
    log = staged_log(spark, sf)
    probes = bat_probes(log)
    totals = asof.asof_totals(h.position_facts(log), probes, ["player"], h.POSITION_SUMS)
    asked = totals.join(probes.distinct(), ["player", "date"], "left_semi")
    cols = h.position_columns()
    return day(asked.select("player", "date", cols["innings_seen"].cast("bigint").alias("innings_seen"),
                            *[F.round(cols[n], 9).alias(n) for n in _POS]))
