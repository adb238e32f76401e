"""Replay extract: the last matches of the held-out season with readable names and labels."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .forecast import TARGET, row_key


def last_matches(df: DataFrame, n: int) -> DataFrame:
    """Rows of the n latest matches (a top-n of the distinct matches, then a semi join)."""
    chosen = df.select("date", "match_id").distinct().orderBy(F.desc("date"), F.desc("match_id")).limit(n)
    return df.join(F.broadcast(chosen.select("match_id")), "match_id", "left_semi")


def last_states(df: DataFrame, n: int = 80) -> DataFrame:
    """The n latest over states."""
    return df.orderBy(F.desc("date"), F.desc("match_id"), F.desc("innings"), F.desc("over_number")).limit(n)


def replay_rows(df: DataFrame, names: DataFrame, forecast: str) -> DataFrame:
    """Label, named players, forecast and outcome; ids without a name keep the id."""
    out = df
    for role in ("batter", "non_striker", "bowler"):
        side = names.select(F.col("player_id").alias(role), F.col("display_name").alias(f"_{role}"))
        out = out.join(side, role, "left").withColumn(role, F.coalesce(f"_{role}", role)).drop(f"_{role}")
    label = F.format_string("%s - %s - over %d", F.col("date").cast("string"), F.col("team_batting"), F.col("over_number"))
    return out.select(row_key().alias("row_key"), label.alias("label"), "match_id", "innings", "over_number", "current_score",
                      "current_wickets", "batter", "non_striker", "bowler", "venue", "team_batting", "team_bowling",
                      F.col(TARGET).alias("actual_runs"), F.col(forecast).alias("expected_runs"))


def write_replay(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
