"""Normalised as-of feature store: seventeen tables built through one date."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rates import MEASURES, plain_rates
from . import history as h


def players(aliases: DataFrame) -> DataFrame:
    """Display name = first alias in order; count of aliases."""
    return aliases.groupBy("player_id").agg(F.min("alias").alias("display_name"),
                                            F.count("alias").alias("alias_count"))


def matches(log: DataFrame) -> DataFrame:
    first = lambda c: F.min(c).alias(c)      # constant within a match
    return log.groupBy("match_id").agg(
        first("date"), first("season"), first("venue"), F.count(F.lit(1)).alias("deliveries"),
        F.sum("runs_total").alias("runs"), F.sum("wicket").alias("wickets"))


# table -> (kind, output names of the key columns, "bat" / "bowl" / plain)
STATS = {
    "player_batting_stats": ("bat", {"batter": "player_id"}, "bat"),
    "player_batting_stats_by_season": ("bat_season", {"batter": "player_id"}, "bat"),
    "player_batting_stats_by_phase": ("bat_phase", {"batter": "player_id"}, "bat"),
    "player_bowling_stats": ("bowl", {"bowler": "player_id"}, "bowl"),
    "player_bowling_stats_by_season": ("bowl_season", {"bowler": "player_id"}, "bowl"),
    "player_bowling_stats_by_phase": ("bowl_phase", {"bowler": "player_id"}, "bowl"),
    "batter_bowler_matchups": ("matchup", {"batter": "batter_id", "bowler": "bowler_id"}, "bat"),
    "venues": ("venue", {}, None),
    "venue_by_over": ("venue_over", {}, None),
    "venue_by_phase": ("venue_phase", {}, None),
    "teams": ("team", {"team_batting": "team"}, None),
    "team_head_to_head": ("head_to_head", {}, None),
    "league_totals": ("league", {}, None),
}


def stats_table(log: DataFrame, table: str, as_of) -> DataFrame:
    """One statistics table; ``as_of`` is a date column or literal it is valid after."""
    kind, names, side = STATS[table]
    totals = h.kind_totals(log, kind)
    for old, new in names.items():
        totals = totals.withColumnRenamed(old, new)
    rates = plain_rates(side == "bat") if side else {}
    return totals.select("*", *[c.alias(n) for n, c in rates.items()], F.lit(as_of).alias("as_of"))


def form_table(log: DataFrame, as_of) -> DataFrame:
    """The last 25 match entries of every player and role, numbered from the oldest."""
    out = None
    for role in ("bat", "bowl"):
        states = h.form_states(log, role)
        last = states.groupBy("player").agg(F.max_by("form", "date").alias("form"))
        part = last.select(F.lit(role).alias("role"), F.col("player").alias("player_id"),
                           F.posexplode("form").alias("_i", "e"))
        out = part if out is None else out.unionByName(part)
    return out.select("role", "player_id", (F.col("_i") + 1).alias("match_index_from_oldest"),
                      F.col("e.date").alias("match_date"), *[F.col(f"e.{m}").alias(m) for m in MEASURES],
                      F.lit(as_of).alias("as_of"))


def last_date(log: DataFrame):
    """Date the store is built through, as a scalar subquery."""
    return log.agg(F.max("date").alias("d")).scalar()


def build_store(log: DataFrame, aliases: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """All store tables, lazily."""
    as_of = last_date(log) if as_of is None else as_of
    tables = {"players": players(aliases), "player_aliases": aliases}
    tables.update({name: stats_table(log, name, as_of) for name in STATS})
    return {**tables, "matches": matches(log), "player_form": form_table(log, as_of)}
