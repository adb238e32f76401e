"""The over sample table: opening state, history features and targets of every usable over.

Joins are of three kinds: by match (all sides are already partitioned by match), by date
(one row per day, broadcast) and by (player or venue, date) against as-of tables whose size
AQE checks at run time before choosing how to join.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cricket as k
from ..functions.rates import MEASURES, context_rates, era_rates, shrunk_rates
from ..functions.rules import first_failure
from ..operators import asof, history as h, windows as w
from ..operators.validate import state_rules
from ..sources.delivery_log import OVER_KEY

GROUPS = ["momentum", "lags", "innings", "era", "players", "form", "positions", "matchup", "context", "targets"]
META = ["match_id", "date", "season", "history_through"]
CATEGORICAL = ["competition", "venue", "team_batting", "team_bowling", "batter", "non_striker", "bowler", "phase"]
EXCLUDED_PREFIXES = ("ball_minus_",)
ROLES = {"batter": "bat", "non_striker": "bat", "bowler": "bowl"}
CONTEXTS = ["venue", "venue_over", "venue_phase", "team", "opposition", "head_to_head"]


def named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


BASE = ["match_id", "date", "season", "innings", "over_number", "venue", "team_batting", "team_bowling",
        "batter", "non_striker", "bowler", "current_score", "current_wickets", "legal_balls_before", "target"]


def described(df: DataFrame) -> DataFrame:
    """Add phase and chase arithmetic to opening states."""
    c = F.col
    return df.select(
        "*", F.lit("T20 league").alias("competition"), k.phase(c("over_number")).alias("phase"),
        c("target").alias("chase_target"), *named(k.chase_columns(c("target"), c("current_score"), c("legal_balls_before"), c("current_wickets"))))


def opening_states(log: DataFrame) -> DataFrame:
    """First ball of each over with the state before it, phase and chase arithmetic."""
    return described(w.over_starts(w.running_state(log)).select(*BASE))


#: Values of an over that its first ball decides.
OPENING = ["date", "season", "venue", "team_batting", "team_bowling", "batter", "non_striker", "bowler"]


def overs_in_one_pass(log: DataFrame, groups: Iterable[str]) -> DataFrame:
    """Opening state, ball windows and targets of every over from one shuffle by match.

    The state before an over is a running sum over the totals of the overs, a sixth of the rows. The first ball's values
    are part of the grouping key, so the aggregation per over is a hash aggregation of plain numbers.
    """
    c = F.col
    balls = log.select(*OVER_KEY, "ball_number", *[x for x in OPENING if x not in OVER_KEY], "runs_total", "runs_batter", "runs_extras", "wicket", "legal",
                       "batter_ball", "bowler_conceded", "boundary", "six").repartition("match_id")
    extra: list[str] = []
    if "momentum" in groups:
        known = set(balls.columns)
        balls = w.with_momentum_balls(balls)
        extra += [x for x in balls.columns if x not in known]
    if "lags" in groups:
        lags = w.ball_lag_columns()
        known = set(balls.columns)
        balls = balls.select("*", *lags)
        extra += [x for x in balls.columns if x not in known]
    in_over = W.partitionBy(*OVER_KEY).orderBy("ball_number")
    so_far = in_over.rowsBetween(W.unboundedPreceding, W.currentRow)
    opened = balls.select("*", *[F.first(x).over(so_far).alias(f"_{x}") for x in OPENING], F.row_number().over(in_over).alias("_nth"))
    over = opened.groupBy(*OVER_KEY, *[c(f"_{x}").alias(f"_{x}") for x in OPENING]).agg(
        F.sum("runs_total").alias("runs"), F.sum("wicket").alias("wickets"), F.sum("boundary").alias("boundaries"),
        F.sum("six").alias("sixes"), F.sum("legal").alias("legal"), *w.target_columns("_batter", "_non_striker"),
        *[F.max(F.when(c("_nth") == 1, c(x))).alias(x) for x in extra])
    targets = [x for x in over.columns if x.startswith("target_")]
    momentum = w.momentum_over_columns() if "momentum" in groups else []
    return described(over.select(*OVER_KEY, *[c(f"_{x}").alias(x) for x in OPENING], *w.state_columns("runs", "wickets", "legal", ["over_number"]),
                                 *extra, *targets, *momentum))


def usable(starts: DataFrame, league: DataFrame) -> DataFrame:
    """Overs with an open innings, a complete prefix and enough league history.

    Keeps the ``league_`` and ``season_`` totals the rates are computed from.
    """
    known = h.join_league(starts, h.bootstrap_ready(league))
    claimed = known.withColumns({"claimed_score": F.col("current_score"), "claimed_wickets": F.col("current_wickets")})
    return claimed.filter(first_failure(state_rules()).isNull()).drop("claimed_score", "claimed_wickets")


def packed(df: DataFrame, keys: list[str], columns: dict[str, Column], out: str) -> DataFrame:
    """Key columns and one struct of ``columns``: a join copies it as one value, however many fields it has."""
    return df.select(*keys, F.struct(*named(columns)).alias(out))


def role_rates(role: str, side: str, seasons: bool = True, own: str = "") -> dict[str, Column]:
    """Shrunk rates of a player from raw totals named ``<own><part>_<measure>``."""
    out = shrunk_rates(f"{role}_career_", own=f"{own}career_")
    if seasons:
        out |= shrunk_rates(f"{role}_season_", own=f"{own}season_")
        name, short = ("strike_rate", "sr") if side == "bat" else ("economy", "economy")
        for p in h.PHASES:
            out[f"{role}_{p}_{short}"] = shrunk_rates("", own=f"{own}{p}_")[name]
    return out


def player_rates(seasons: bool = True) -> dict[str, Column]:
    """Shrunk rates of the three players from raw totals named ``_<role>_<part>_<measure>``."""
    return {n: x for role, side in ROLES.items() for n, x in role_rates(role, side, seasons, f"_{role}_").items()}


def matchup_rates() -> dict[str, Column]:
    return {n: c for role in ("batter", "non_striker") for n, c in shrunk_rates(f"{role}_matchup_", own=f"_{role}_matchup_").items()}


def era_ratios(players: bool = True, found: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Scoring and players against the league of their own time, from finished rates (columns, unless ``found`` names them)."""
    c = found.__getitem__ if found else F.col
    tiny = lambda col: F.greatest(c(col), F.lit(1e-9))
    out = {"scoring_vs_era": c("current_run_rate") / F.greatest(c("era_strike_rate") * 6 / 100, F.lit(1e-9))}
    if players:
        for role in ("batter", "non_striker"):
            out[f"{role}_sr_vs_era"] = c(f"{role}_career_strike_rate") / tiny("era_strike_rate")
            out[f"{role}_boundary_rate_vs_era"] = c(f"{role}_career_boundary_rate") / tiny("era_boundary_rate")
        out["bowler_economy_vs_era"] = c("bowler_career_economy") / tiny("era_economy")
    return out


def asof_tables(log: DataFrame, groups: set[str], lifetime: DataFrame) -> dict[str, DataFrame]:
    """The as-of tables of the families ``groups`` by name: keys, date and one struct of finished columns ``_got``."""
    c = F.col
    tables = {}

    def rated(part: DataFrame, own: list[str], found: dict[str, Column]) -> DataFrame:
        return packed(h.join_league(part, lifetime), [*own, "date"], found, "_got")

    if groups & {"players", "career"}:
        for side in ("bat", "bowl"):
            # The rates of a role are those of its side: batter and non-striker share a table.
            found = {n.removeprefix("role_"): x for n, x in role_rates("role", side, "players" in groups).items()}
            tables[f"{side}_totals"] = rated(h.player_totals(log, side), ["player"], found)
    if groups & {"form", "positions"}:
        starts = w.over_starts(log)
        batters = starts.select("date", F.explode(F.array("batter", "non_striker")).alias("player"))
    if "form" in groups:
        for side, probes in (("bat", batters), ("bowl", starts.select("date", c("bowler").alias("player")))):
            found = {**h.recent_columns(side, ""), **h.decayed_columns(""), **h.calendar_columns("")}
            tables[f"{side}_form"] = packed(h.form_asof(log, probes, side), ["player", "date"], found, "_got")
    if "positions" in groups:
        tables["positions"] = packed(asof.asof_totals(h.position_facts(log), batters, ["player"], h.POSITION_SUMS),
                                     ["player", "date"], h.position_columns(), "_got")
    if "matchup" in groups:
        tables["matchups"] = rated(h.matchup_totals(log), ["player", "bowler"], shrunk_rates())
    for kind in context_kinds(groups):
        tables[kind] = packed(h.context_totals(log, kind), [*h.CONTEXT_KINDS[kind], "date"], context_rates(f"{kind}_"), "_got")
    return tables


def context_kinds(groups: set[str]) -> list[str]:
    return CONTEXTS if "context" in groups else ["venue"] if "venue" in groups else []


def over_samples(log: DataFrame, groups: Iterable[str] = tuple(GROUPS), keep: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] = dict) -> DataFrame:
    """One row per usable over. ``groups`` limits which feature families are built.

    An as-of table has one row per key and date, so its rates are computed there, beside the league of that date. Every table comes
    in as one struct, and only the last projection has all columns: a wide row is written once, not by every join. ``keep`` may
    write the as-of tables and read them back, so that their true size decides their joins before any over is shuffled for them.
    """
    groups = set(groups)
    c = F.col
    league = keep({"league": h.league_asof(log)})["league"]
    totals = [f"{p}_{m}" for p in ("league", "season") for m in MEASURES]
    tables = keep(asof_tables(log, groups, league.select("date", *[f"league_{m}" for m in MEASURES])))
    opened = usable(overs_in_one_pass(log, groups), league)
    # Tables made from every ball are kept one after the other, so that only one shuffle of the balls is on disk at a time.
    merged = [(g, t) for g, t in (("innings", w.innings_so_far), ("positions", w.position_now)) if g in groups]
    if merged:
        opened = keep({"overs": opened})["overs"]
    keys = [*OVER_KEY, "date", "venue", "team_batting", "team_bowling", "batter", "non_striker", "bowler", "phase"]
    era = era_rates() if "era" in groups else {}
    base = [x for x in opened.columns if x not in totals]
    held = [x for x in base if x not in keys]
    samples = opened.select(*keys, F.struct(*held, *named(era)).alias("_over"))
    columns = {x: c(x) if x in keys else c("_over")[x] for x in base}
    rates = {x: c("_over")[x] for x in era}

    def add(part: DataFrame, on: list[str], found: dict[str, Column]) -> None:
        """Join ``part`` to the overs. Columns are ordered as the joins leave them: keys first, what is found last."""
        nonlocal samples, columns
        samples = samples.join(part, on, "left")
        columns = {**{x: columns[x] for x in on}, **columns, **found}

    def joined(name: str, at: dict[str, str], out: str, prefix: str = "") -> dict[str, Column]:
        """Add the struct of an as-of table as ``out``; ``at`` names the over's column of each of its keys. Returns its columns."""
        add(tables[name].withColumnsRenamed({**at, "_got": out}), [*at.values(), "date"], {})
        return {f"{prefix}{x}": c(out)[x] for x in tables[name].schema["_got"].dataType.names}

    for group, table in merged:
        part = keep({f"over_{group}": table(log)})[f"over_{group}"]
        names = [x for x in part.columns if x not in OVER_KEY]
        add(packed(part, OVER_KEY, {x: c(x) for x in names}, f"_{group}").hint("merge"), OVER_KEY, {x: c(f"_{group}")[x] for x in names})

    if groups & {"players", "career"}:
        for role, side in ROLES.items():
            rates |= joined(f"{side}_totals", {"player": role}, f"_{role}", f"{role}_")
    if "form" in groups:
        for role, side in ROLES.items():
            found = joined(f"{side}_form", {"player": role}, f"_{role}_form", f"{role}_")
            columns |= found
    if "positions" in groups:
        for role in ("batter", "non_striker"):
            found = joined("positions", {"player": role}, f"_{role}_seen", f"{role}_")
            columns |= found
    if "matchup" in groups:
        for role in ("batter", "non_striker"):
            rates |= joined("matchups", {"player": role, "bowler": "bowler"}, f"_{role}_matchup", f"{role}_matchup_")
    for kind in context_kinds(groups):
        found = joined(kind, {x: x for x in h.CONTEXT_KINDS[kind]}, f"_{kind}")
        columns |= found

    every = {**columns, **rates}
    if "era" in groups:
        every |= era_ratios(bool(groups & {"players", "career"}), every)
    return samples.select(*named(every))


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: everything but identifiers, targets and the excluded families."""
    skip = {*META, "target", "era_boundary_rate", "legal_balls_before", "partition"}
    return [x for x in df.columns if x not in skip and not x.startswith(("target_", *EXCLUDED_PREFIXES))]


#: Family of the columns that each group of the table adds.
GROUP_FAMILY = {"momentum": "momentum", "lags": "lags", "innings": "player", "career": "player", "players": "player", "form": "player",
                "positions": "position", "matchup": "matchup", "venue": "venue_team", "context": "venue_team", "era": "era"}
#: Chase arithmetic of the opening state that measures pressure.
PRESSURE = ("required_minus_current_rate", "required_runs_per_wicket", "balls_per_wicket_remaining", "pressure_bucket")


#: Columns whose family is not that of the group that adds them.
OWN_FAMILY = {"team_batting": "venue_team", "team_bowling": "venue_team", "batter_innings_seen": "player", "non_striker_innings_seen": "player",
              **dict.fromkeys(["bowler_match_legal_balls", "bowler_match_conceded", "bowler_match_wickets", "bowler_match_economy",
                               "bowler_overs_bowled_this_match", "bowler_overs_remaining_quota"], "base")}


def feature_families(log: DataFrame, groups: Iterable[str] = tuple(GROUPS)) -> dict[str, str]:
    """Family of every feature column: that of the group which adds it, ``base`` for the opening state.

    Only schemas are compared; no job runs.
    """
    groups = [g for g in groups if g in GROUP_FAMILY]
    plain = over_samples(log, ())
    out = {x: "pressure" if x in PRESSURE else "base" for x in feature_columns(plain)}
    for g in groups:
        for x in feature_columns(over_samples(log, (g,))):
            out.setdefault(x, GROUP_FAMILY[g])
    # Ratios to the era need two groups; decayed and calendar form are a family of their own.
    smooth = {*h.decayed_columns(""), *h.calendar_columns("")}
    for x in feature_columns(over_samples(log, groups)):
        out.setdefault(x, "era")
        if any(x == f"{role}_{name}" for role in ROLES for name in smooth):
            out[x] = "ewma"
    return {x: OWN_FAMILY.get(x, name) for x, name in out.items()}


def require_columns(df: DataFrame, needed: Iterable[str]) -> None:
    """Fail before any job when a table lacks columns a model needs."""
    missing = [x for x in needed if x not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} required columns are missing: {missing[:10]}")
