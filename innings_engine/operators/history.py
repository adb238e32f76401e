"""History aggregates of the sixteen key kinds, form windows and player profiles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cricket as k
from ..functions.rates import MEASURES, context_rates, era_rates
from .asof import asof_latest, asof_totals
from .windows import batting_order

# Form is remembered for 25 matches; decay rates; calendar windows in days.
FORM_MATCHES = 25
DECAYS = [0.15, 0.4]
DAY_WINDOWS = [90, 365]
BOOTSTRAP_BALLS = 1000
PHASES = ["powerplay", "middle", "death"]

# kind -> key columns of the delivery log (phase is derived from the over number)
PLAYER_KINDS = {
    "bat": ["batter"], "bat_season": ["season", "batter"], "bat_phase": ["batter", "phase"],
    "bowl": ["bowler"], "bowl_season": ["season", "bowler"], "bowl_phase": ["bowler", "phase"],
    "matchup": ["batter", "bowler"], "league": [], "league_season": ["season"],
}
CONTEXT_KINDS = {
    "venue": ["venue"], "venue_over": ["venue", "over_number"], "venue_phase": ["venue", "phase"],
    "team": ["team_batting"], "opposition": ["team_bowling"],
    "head_to_head": ["team_batting", "team_bowling"], "team_phase": ["team_batting", "phase"],
}
KINDS = {**PLAYER_KINDS, **CONTEXT_KINDS}
BATTING_OUTS = {"bat", "bat_season"}


def measure_columns(runs: Column, outs: Column) -> list[Column]:
    values = [runs, F.col("batter_ball"), outs, F.col("boundary"), F.col("six"),
              k.flag(F.col("runs_total") == 0), F.col("bowler_conceded"), F.col("legal")]
    return [v.cast("bigint").alias(m) for m, v in zip(MEASURES, values)]


def with_phase(log: DataFrame) -> DataFrame:
    return log.withColumn("phase", k.phase(F.col("over_number")))


def batter_events(log: DataFrame, *carry: str, partners: bool = False) -> DataFrame:
    """Batting facts by player: one row per ball faced and one per player dismissed.

    A run-out can dismiss the non-striker, so outs follow ``dismissed_player``. With
    ``partners`` each ball also yields a zero-valued row for the non-striker, so that the
    pair (non-striker, date) is present for an as-of read without a second scan.
    """
    ball = F.struct(F.col("batter").alias("player"), *measure_columns(F.col("runs_batter"), F.lit(0)))

    def blank(player: Column, outs: int) -> Column:
        values = [F.lit(outs if m == "outs" else 0).cast("bigint").alias(m) for m in MEASURES]
        return F.struct(player.alias("player"), *values)

    always = F.array(ball, blank(F.col("non_striker"), 0)) if partners else F.array(ball)
    gone = F.transform(F.split("dismissed_player", r"\|"), lambda p: blank(p, 1))
    entries = F.when(F.col("dismissed_player") == "", always).otherwise(F.concat(always, gone))
    return log.select(*carry, F.explode(entries).alias("e")).select(*carry, "e.*")


def kind_facts(log: DataFrame, kind: str) -> DataFrame:
    """Key columns, date and the eight measures of one kind (not yet summed)."""
    keys = KINDS[kind]
    if kind in BATTING_OUTS:
        carry = [c for c in keys if c != "batter"]
        return batter_events(log, "date", *carry).withColumnRenamed("player", "batter") \
            .select(*keys, "date", *MEASURES)
    if kind in CONTEXT_KINDS:
        values = measure_columns(F.col("runs_total"), F.col("wicket"))
    elif kind == "bat_phase":
        values = measure_columns(F.col("runs_batter"), F.lit(0))
    else:
        values = measure_columns(F.col("runs_batter"), F.col("bowler_wicket"))
    return with_phase(log).select(*keys, "date", *values)


def kind_totals(log: DataFrame, kind: str) -> DataFrame:
    keys = KINDS[kind]
    return kind_facts(log, kind).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])


def history_kinds(log: DataFrame) -> DataFrame:
    """Totals of all kinds as (kind, key, measures), three passes over the log.

    Kinds that share measures share one GROUPING SETS aggregation; the sets are small after
    the map-side combine.
    """
    def grouped(facts: DataFrame, kinds: list[str]) -> DataFrame:
        names = sorted({c for kind in kinds for c in KINDS[kind]})
        sets = [[F.col(c) for c in KINDS[kind]] for kind in kinds]
        agg = facts.groupingSets(sets, *[F.col(c) for c in names]).agg(
            F.grouping_id().alias("_gid"), *[F.sum(m).alias(m) for m in MEASURES])
        label = F
        for kind in kinds:
            gid = sum(0 if c in KINDS[kind] else 1 << (len(names) - 1 - i) for i, c in enumerate(names))
            label = label.when(F.col("_gid") == gid, kind)
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in names])
        return agg.select(label.alias("kind"), key.alias("key"), *MEASURES)

    phased = with_phase(log)
    bat = grouped(batter_events(log, "season").withColumnRenamed("player", "batter"), ["bat", "bat_season"])
    player = phased.select("season", "batter", "bowler", "phase",
                           *measure_columns(F.col("runs_batter"), F.col("bowler_wicket")))
    bowling = grouped(player, ["bat_phase", "bowl", "bowl_season", "bowl_phase", "matchup", "league",
                               "league_season"])
    # A bat_phase aggregate never records outs.
    bowling = bowling.withColumn("outs", F.when(F.col("kind") == "bat_phase", F.lit(0)).otherwise(F.col("outs")))
    context = phased.select("venue", "over_number", "phase", "team_batting", "team_bowling",
                            *measure_columns(F.col("runs_total"), F.col("wicket")))
    return bat.unionByName(bowling).unionByName(grouped(context, list(CONTEXT_KINDS)))


# --- as-of league and era ---------------------------------------------------------------

def league_asof(log: DataFrame) -> DataFrame:
    """League and league-season totals before each date, and the last earlier date.

    One row per date of the log.
    """
    daily = kind_facts(log, "league").withColumn("season", F.year("date")) \
        .groupBy("season", "date").agg(*[F.sum(m).alias(m) for m in MEASURES])
    whole = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    season = W.partitionBy("season").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    return daily.select(
        "date", F.lag("date").over(W.partitionBy(F.lit(0)).orderBy("date")).alias("history_through"),
        *[F.coalesce(F.sum(m).over(whole), F.lit(0)).alias(f"league_{m}") for m in MEASURES],
        *[F.coalesce(F.sum(m).over(season), F.lit(0)).alias(f"season_{m}") for m in MEASURES])


def join_league(df: DataFrame, league: DataFrame) -> DataFrame:
    """The league table has one row per calendar day, so its broadcast size is bounded by time."""
    return df.join(F.broadcast(league), "date")


def era_baseline(log: DataFrame) -> DataFrame:
    return league_asof(log).select("date", *[c.alias(n) for n, c in era_rates().items()])


def bootstrap_ready(league: DataFrame) -> DataFrame:
    """Dates on which the league already has enough balls behind it."""
    return league.filter(F.col("league_balls") >= BOOTSTRAP_BALLS)


# --- form --------------------------------------------------------------------------------

FORM_SUMS = [m for m in MEASURES if m != "outs"]


def match_entries(log: DataFrame, role: str) -> DataFrame:
    """One entry per (player, match): totals of a match in which the player batted or bowled."""
    player = "batter" if role == "bat" else "bowler"
    return log.select(F.col(player).alias("player"), "date", "match_id",
                      *measure_columns(F.col("runs_batter"), F.lit(0))) \
        .groupBy("player", "date", "match_id").agg(*[F.sum(m).alias(m) for m in MEASURES])


def latest_entries(entries: DataFrame, size: int = FORM_MATCHES) -> DataFrame:
    """Entries that can still be among a player's last ``size`` on any later date.

    Within one date only the last ``size`` matter, which bounds a player's later window by
    dates x size. Spark applies the rank limit before the shuffle as well.
    """
    w = W.partitionBy("player", "date").orderBy(F.col("match_id").desc())
    return entries.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= size)


def form_states(log: DataFrame, role: str, size: int = FORM_MATCHES) -> DataFrame:
    """Per (player, date): the last ``size`` entries up to and including that date, oldest first."""
    kept = latest_entries(match_entries(log, role), size)
    w = W.partitionBy("player").orderBy("date", "match_id").rowsBetween(-(size - 1), 0)
    entry = F.struct("date", "match_id", *MEASURES)
    return kept.select("player", "date", "_back", F.collect_list(entry).over(w).alias("form")) \
        .filter(F.col("_back") == 1).drop("_back")


def form_asof(log: DataFrame, probes: DataFrame, role: str) -> DataFrame:
    """Form array of each distinct probe (player, date); empty when nothing came before."""
    states = form_states(log, role)
    got = asof_latest(states, probes, ["player"], "form")
    empty = F.array().cast(states.schema["form"].dataType)
    return got.withColumn("form", F.coalesce("form", empty))


def _fold(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))


def _last(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def recent_columns(role: str, prefix: str) -> dict[str, Column]:
    """Plain averages over the last five and ten matches."""
    out = {}
    for n in (5, 10):
        rows = _last(F.col("form"), n)
        total = lambda m: _fold(rows, lambda e: e[m].cast("double"))
        if role == "bat":
            out[f"{prefix}recent_{n}_mean_runs"] = total("runs") / k.at_least(F.size(rows))
            out[f"{prefix}recent_{n}_sr"] = 100 * total("runs") / F.greatest(total("balls"), F.lit(1.0))
        else:
            out[f"{prefix}recent_{n}_economy"] = 6 * total("conceded") / F.greatest(total("legal"), F.lit(1.0))
    return out


def decayed_columns(prefix: str) -> dict[str, Column]:
    """Exponentially decayed form; the newest match has weight one."""
    out = {}
    size = F.size("form")
    for decay in DECAYS:
        weighted = F.transform("form", lambda e, i: F.struct(
            *[(F.exp(-F.lit(decay) * (size - 1 - i)) * e[m]).alias(m)
              for m in ("runs", "balls", "boundaries", "dots", "conceded", "legal")]))
        total = lambda m, w=weighted: _fold(w, lambda e: e[m])
        per_ball = lambda m: total(m) / F.greatest(total("balls"), F.lit(1e-9))
        name = f"{prefix}ewma{str(decay).replace(chr(46), chr(95))}_"
        out[f"{name}runs_per_ball"] = per_ball("runs")
        out[f"{name}boundary_rate"] = per_ball("boundaries")
        out[f"{name}dot_rate"] = per_ball("dots")
        out[f"{name}economy"] = 6 * total("conceded") / F.greatest(total("legal"), F.lit(1e-9))
    return out


def calendar_columns(prefix: str) -> dict[str, Column]:
    """Form within 90 and 365 days, seen through the same 25-match memory."""
    out = {}
    for days in DAY_WINDOWS:
        rows = F.filter("form", lambda e: F.datediff(F.col("date"), e["date"]) <= days)
        total = lambda m, r=rows: _fold(r, lambda e: e[m].cast("double"))
        name = f"{prefix}last_{days}d_"
        out[f"{name}innings"] = F.size(rows).cast("double")
        out[f"{name}runs_per_ball"] = total("runs") / F.greatest(total("balls"), F.lit(1e-9))
        out[f"{name}economy"] = 6 * total("conceded") / F.greatest(total("legal"), F.lit(1e-9))
    return out


# --- positions ---------------------------------------------------------------------------

POSITION_SUMS = ["position_sum", "position_n", "top3", "four_six", "seven_plus"]


def position_facts(log: DataFrame) -> DataFrame:
    p = F.col("position")
    return batting_order(log).select(
        F.col("batter").alias("player"), "date", p.alias("position_sum"), F.lit(1).alias("position_n"),
        k.flag(p <= 3).alias("top3"), k.flag(p.between(4, 6)).alias("four_six"), k.flag(p >= 7).alias("seven_plus"))


def position_columns(prefix: str = "", own: str = "") -> dict[str, Column]:
    c = lambda name: F.col(f"{own}{name}")
    n = F.greatest(c("position_n"), F.lit(1))
    return {
        f"{prefix}mean_position": c("position_sum") / n,
        f"{prefix}innings_seen": c("position_n"),
        f"{prefix}share_top3": c("top3") / n,
        f"{prefix}share_position_4_6": c("four_six") / n,
        f"{prefix}share_position_7_plus": c("seven_plus") / n,
    }


# --- profiles: everything known about a player before a date --------------------------------

def player_totals(log: DataFrame, role: str, probes: DataFrame | None = None) -> DataFrame:
    """Career, season and per-phase totals before each (player, date), two small shuffles.

    Prefixes: ``career_``, ``season_``, and ``<phase>_`` for each phase. Every player of an
    over on a date is covered; ``probes`` (player, date) adds dates without any log rows.
    """
    phased = with_phase(log)
    if role == "bat":
        events = batter_events(phased, "date", "phase", partners=True)
    else:
        events = phased.select(F.col("bowler").alias("player"), "date", "phase",
                               *measure_columns(F.col("runs_batter"), F.col("bowler_wicket")))
    if probes is not None:
        events = events.unionByName(probes.select(
            "player", "date", F.lit("none").alias("phase"), *[F.lit(0).cast("bigint").alias(m) for m in MEASURES]))
    daily = events.groupBy("player", "date").agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        *[F.sum(F.when(F.col("phase") == p, F.col(m)).otherwise(0)).alias(f"{p}_{m}")
          for p in PHASES for m in MEASURES])
    daily = daily.withColumn("season", F.year("date"))
    before = lambda *keys: W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    whole, season = before("player"), before("player", "season")
    seen = lambda m, w: F.coalesce(F.sum(m).over(w), F.lit(0))
    return daily.select(
        "player", "date",
        *[seen(m, whole).alias(f"career_{m}") for m in MEASURES],
        *[seen(f"{p}_{m}", whole).alias(f"{p}_{m}") for p in PHASES for m in MEASURES],
        *[seen(m, season).alias(f"season_{m}") for m in MEASURES])


def matchup_totals(log: DataFrame) -> DataFrame:
    """Totals of each (batter or non-striker, bowler) pair before each date they meet on."""
    c = F.col
    zero = F.struct(c("non_striker").alias("player"), *[F.lit(0).cast("bigint").alias(m) for m in MEASURES])
    fact = F.struct(c("batter").alias("player"), *measure_columns(c("runs_batter"), c("bowler_wicket")))
    events = log.select("bowler", "date", F.explode(F.array(fact, zero)).alias("e")).select("bowler", "date", "e.*")
    return asof_totals(events, None, ["player", "bowler"], MEASURES)


def context_totals(log: DataFrame, kind: str) -> DataFrame:
    """Context totals before each date. An over is itself a fact of its keys, so no probes are needed."""
    return asof_totals(kind_facts(log, kind), None, CONTEXT_KINDS[kind], MEASURES)
