"""Nested documents to the flat delivery log: exclusions, identities, flags, duplicates.

Everything here is narrow (row expressions and explodes) except duplicate removal.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cricket as k

COMPETITION = "T20 league"


def played(innings: Column) -> Column:
    return F.filter(innings, lambda i: ~F.coalesce(i["super_over"], F.lit(False)))


def exclusion_reason(doc: Column) -> Column:
    """First matching population rule; null keeps the match."""
    info = doc["info"]
    irregular = F.exists(played(doc["innings"]), lambda i: (
        F.coalesce(i["penalty_runs"] != 0, F.lit(False)) | F.coalesce(i["miscounted_overs"] != "", F.lit(False))
        | (F.coalesce(i["target"]["overs"], F.lit(20)) != 20)))
    return (F.when(info.isNull(), "malformed_document")
            .when((F.coalesce(info["match_type"], F.lit("")) != "T20")
                   | (F.coalesce(info["balls_per_over"], F.lit(6)) != 6), "unsupported_format")
            .when(F.coalesce(info["outcome"]["method"] != "", F.lit(False)), "revised_target_or_rain_method")
            .when(info["outcome"]["result"] == "no result", "no_result")
            .when(F.coalesce(F.size(info["missing"]) > 0, F.lit(False)), "missing_data")
            .when(F.coalesce(info["overs"], F.lit(20)) != 20, "shortened_match")
            .when(irregular, "shortened_or_ambiguous_innings"))


def structural_reason(doc: Column) -> Column:
    """Target discrepancy or a gap in the over numbers, whichever comes first in play."""
    runs_of = lambda over: F.aggregate(over["deliveries"], F.lit(0), lambda a, d: a + d["runs"]["total"])
    total = lambda innings: F.aggregate(innings["overs"], F.lit(0), lambda a, o: a + runs_of(o))
    first = F.element_at(F.filter(doc["innings"], lambda _, i: i == 0), 1)
    first_total = F.when(~F.coalesce(first["super_over"], F.lit(False)), total(first)).otherwise(0)

    def problem(innings: Column, index: Column) -> Column:
        expected = F.when(index == 1, first_total + 1).otherwise(0)
        gap = F.exists(F.transform(innings["overs"], lambda o, i: o["over"] != i), lambda bad: bad)
        return (F.when(F.coalesce(innings["super_over"], F.lit(False)), F.lit(None).cast("string"))
                .when(F.coalesce(innings["target"]["runs"], expected) != expected, "target_discrepancy")
                .when(gap, "non_contiguous_overs"))

    return F.try_element_at(F.array_compact(F.transform(doc["innings"], problem)), F.lit(1))


def judge(docs: DataFrame) -> DataFrame:
    """Documents with ``reason`` (null for those that enter the log)."""
    return docs.withColumn("reason", F.coalesce(exclusion_reason(F.col("doc")), structural_reason(F.col("doc"))))


def exclusions(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).select("match_id", "reason")


def flatten(docs: DataFrame, venue_names: Mapping[str, str] | None = None,
            team_names: Mapping[str, str] | None = None) -> DataFrame:
    """One row per delivery. Super overs keep their place in the innings count but yield no rows."""
    info = F.col("doc.info")
    date = F.element_at(info["dates"], 1)
    innings = docs.select(
        "match_id", date.cast("date").alias("date"), F.year(date.cast("date")).cast("int").alias("season"),
        k.renamed(k.canonical_text(info["venue"]), dict(venue_names or {})).alias("venue"),
        F.coalesce(info["city"], F.lit("unknown")).alias("city"),
        info["teams"].alias("teams"), info["registry"]["people"].alias("people"),
        F.posexplode("doc.innings").alias("_i", "inn"),
    ).filter(~F.coalesce(F.col("inn.super_over"), F.lit(False)))
    overs = innings.select(
        "match_id", "date", "season", "venue", "city", "teams", "people",
        (F.col("_i") + 1).cast("int").alias("innings"), F.col("inn.team").alias("team"),
        F.explode("inn.overs").alias("o"))
    balls = overs.select(
        *[c for c in overs.columns if c != "o"], (F.col("o.over") + 1).alias("over_number"),
        F.posexplode("o.deliveries").alias("_b", "d"))
    d = F.col("d")
    person = lambda name: F.try_element_at("people", name)
    extra = lambda name: F.coalesce(F.try_element_at(d["extras"], F.lit(name)), F.lit(0))
    wickets = F.coalesce(d["wickets"], F.array().cast("array<struct<player_out:string,kind:string>>"))
    counted = F.filter(wickets, lambda w: ~w["kind"].isin(k.NOT_A_WICKET))
    credited = F.filter(wickets, lambda w: ~w["kind"].isin(k.NOT_THE_BOWLERS_WICKET))
    runs = d["runs"]
    real_boundary = ~F.coalesce(runs["non_boundary"], F.lit(False))
    opponent = F.element_at(F.filter("teams", lambda t: t != F.col("team")), 1)
    team_names = dict(team_names or {})
    wides, noballs = extra("wides"), extra("noballs")
    return balls.select(
        "match_id", "date", "season", F.lit(COMPETITION).alias("competition"), "venue", "city",
        k.renamed(F.col("team"), team_names).alias("team_batting"),
        k.renamed(opponent, team_names).alias("team_bowling"),
        "innings", "over_number", (F.col("_b") + 1).cast("int").alias("ball_number"),
        person(d["batter"]).alias("batter"), person(d["non_striker"]).alias("non_striker"),
        person(d["bowler"]).alias("bowler"),
        runs["batter"].alias("runs_batter"), runs["extras"].alias("runs_extras"), runs["total"].alias("runs_total"),
        F.coalesce(F.array_join(F.array_sort(F.map_keys(d["extras"])), "|"), F.lit("")).alias("extra_type"),
        wides.alias("wides"), noballs.alias("noballs"), extra("byes").alias("byes"),
        extra("legbyes").alias("legbyes"), extra("penalty").alias("penalty"),
        k.flag((wides == 0) & (noballs == 0)).alias("legal"), k.flag(wides == 0).alias("batter_ball"),
        F.size(counted).alias("wicket"), F.size(credited).alias("bowler_wicket"),
        F.array_join(F.transform(counted, lambda w: F.try_element_at("people", w["player_out"])), "|").alias("dismissed_player"),
        F.array_join(F.transform(wickets, lambda w: w["kind"]), "|").alias("dismissal_type"),
        k.flag(runs["batter"].isin(4, 6) & real_boundary).alias("boundary"),
        k.flag((runs["batter"] == 6) & real_boundary).alias("six"),
        (runs["batter"] + wides + noballs).alias("bowler_conceded"),
        F.filter(F.array(d["batter"], d["non_striker"], d["bowler"]),
                 lambda n: F.try_element_at("people", n).isNull()).alias("unknown_names"),
        F.coalesce(F.aggregate(F.map_values(d["extras"]), F.lit(0), lambda a, x: a + x), F.lit(0)).alias("extras_sum"),
    )


def accounting_rules() -> dict[str, Column]:
    c = F.col
    return {
        "inconsistent_total": c("runs_total") != c("runs_batter") + c("runs_extras"),
        "inconsistent_extras": c("runs_extras") != c("extras_sum"),
    }


def identity_rules() -> dict[str, Column]:
    return {"unregistered_player": F.size("unknown_names") > 0}


def fingerprinted(texts: DataFrame, text: str = "text") -> DataFrame:
    """sha256 of the whole (info, innings) of each raw text, all keys sorted; malformed text stands for itself."""
    value = F.try_parse_json(text)
    part = lambda name: F.variant_get(value, f"$.{name}", "variant").alias(name)
    return texts.withColumn("fingerprint", F.sha2(F.coalesce(F.to_json(F.when(value.isNotNull(), F.struct(part("info"), part("innings")))), text), 256))


def first_of_duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, first name, copies): combined on the map side, so a key with many copies is harmless."""
    return df.groupBy(key).agg(F.min(name).alias(name), F.count(F.lit(1)).alias("copies"))


def drop_duplicates_first(df: DataFrame, key: str, name: str):
    """(kept, dropped) by smallest ``name`` per ``key``; joins on the unique name, never on the key."""
    first = first_of_duplicates(df, key, name).select(name)
    return df.join(first, name, "left_semi"), df.join(first, name, "left_anti")


def player_aliases(docs: DataFrame) -> DataFrame:
    """Distinct (alias, player id) pairs; an alias alone never identifies a player."""
    return docs.select(F.explode("doc.info.registry.people").alias("alias", "player_id")).distinct()
