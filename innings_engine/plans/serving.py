"""Features of live requests: as-of tables in a form that is looked up, and the over's state from the request itself.

``serving_table`` publishes every history of the log once: one row per (kind, key) and day on which the key occurs, with totals up
to and including that day and the days for which they are the newest ones before (``valid_from`` < date <= ``valid_to``). A
row is posted under each month its days touch, the newest row of a key, which has no end, under ``OPEN``. A request looks up its
month and ``OPEN`` by equality, so it meets at most the days of one month of a key and exactly one row holds.

``live_features`` turns a request's delivery prefix (an array bounded by its innings) into the state, ball windows, tallies and
positions of its over in Arrow batches. Histories are looked up, and their rates computed with the same column functions as in the over table, once
per distinct player, pair or place and date; requests join the answers. A
request needs no row in the log: a match that isn't there, or a player never seen, has zero history. Requests are (request_id, match_id, date, innings, over,
score, wickets, striker, non_striker, bowler, venue, team_batting, team_bowling, target, bowler_confirmed,
previous_deliveries); ``request_id`` is unique. Other columns are dropped.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import cricket as k
from ..functions.rates import MEASURES, context_rates, era_rates, shrunk_rates
from ..functions.rules import first_failure
from ..operators import history as h
from ..operators.validate import live_state_rules, state_rules
from . import over_table as ot

#: Bucket of rows without an end.
OPEN = -1
_OVER_SPANS, _BALL_SPANS, _LAGS = (1, 2, 3, 5), (6, 12, 18, 24), 12


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def _month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def _entries(facts: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Totals per (kind, key, date) of facts that count under several kinds.

    Facts that agree in all their keys are summed first, so that balls are not multiplied by the kinds they count under.
    """
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in kinds.items()])
    finest = facts.groupBy(*[x for x in facts.columns if x not in MEASURES]).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return finest.select("date", F.explode(pairs).alias("e"), *MEASURES).groupBy("e.kind", "e.key", "date").agg(*[F.sum(m).alias(m) for m in MEASURES])


def _running(daily: DataFrame, measures: list[str]) -> DataFrame:
    """(kind, key, date, totals): sums up to and including each day."""
    w = W.partitionBy("kind", "key").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.select("kind", "key", "date", F.array(*[F.sum(m).over(w).cast("bigint") for m in measures]).alias("totals"))


def serving_table(log: DataFrame) -> DataFrame:
    """(kind, key, bucket, valid_from, valid_to, totals, form) of every history a request may ask for."""
    c = F.col
    phased = h.with_phase(log)
    bat = _entries(h.batter_events(log, "season", "date"), {"bat": _key("player"), "bat_season": _key("season", "player")})
    ball = phased.select("date", "season", "batter", "bowler", "phase", *h.measure_columns(c("runs_batter"), c("bowler_wicket")))
    own = _entries(ball, {
        "bat_phase": _key("batter", "phase"), "bowl": _key("bowler"), "bowl_season": _key("season", "bowler"), "bowl_phase": _key("bowler", "phase"),
        "matchup": _key("batter", "bowler"), "league": F.lit(""), "league_season": _key("season")})
    team = phased.select("date", *sorted({x for kind in ot.CONTEXTS for x in h.CONTEXT_KINDS[kind]}), *h.measure_columns(c("runs_total"), c("wicket")))
    context = _entries(team, {kind: _key(*h.CONTEXT_KINDS[kind]) for kind in ot.CONTEXTS})
    position = h.position_facts(log).groupBy(F.lit("position").alias("kind"), c("player").alias("key"), "date").agg(*[F.sum(m).alias(m) for m in h.POSITION_SUMS])
    totals = _running(bat.unionByName(own).unionByName(context), MEASURES).unionByName(_running(position, h.POSITION_SUMS))
    rows = totals.withColumn("form", F.lit(None))
    for role in ("bat", "bowl"):
        rows = rows.unionByName(h.form_states(log, role).select(
            F.lit(f"{role}_form").alias("kind"), c("player").alias("key"), "date", F.lit(None).alias("totals"), "form"))
    dated = rows.withColumn("valid_to", F.lead("date").over(W.partitionBy("kind", "key").orderBy("date")))
    months = F.when(c("valid_to").isNull(), F.array(F.lit(OPEN))).otherwise(F.sequence(_month(F.date_add("date", 1)), _month(c("valid_to"))))
    return dated.select("kind", "key", F.explode(months).alias("bucket"), c("date").alias("valid_from"), "valid_to", "totals", "form")


def _looked_up(asked: DataFrame, serving: DataFrame, *payload: str) -> DataFrame:
    """``asked`` (kind, key, date, ...) with the newest row before its date; rows that have none are left out."""
    c = F.col
    both = asked.withColumn("bucket", F.explode(F.array(_month(c("date")), F.lit(OPEN))))
    met = both.join(serving.select("kind", "key", "bucket", "valid_from", "valid_to", *payload), ["kind", "key", "bucket"])
    return met.where((c("valid_from") < c("date")) & (c("valid_to").isNull() | (c("date") <= c("valid_to"))))


def league_lookup(dates: DataFrame, serving: DataFrame) -> DataFrame:
    """``dates`` (distinct) with league and season totals before each; zero without any. One row per day."""
    c = F.col
    asked = dates.select("date", F.explode(F.array(
        F.struct(F.lit("league").alias("kind"), F.lit("").alias("key")), F.struct(F.lit("league_season").alias("kind"), _key(F.year("date")).alias("key")))).alias("e"))
    got = _looked_up(asked.select("date", "e.*"), serving.where(c("kind").isin("league", "league_season")), "totals")
    wide = got.groupBy("date").agg(
        F.max(F.when(c("kind") == "league", c("valid_from"))).alias("history_through"),
        *[F.coalesce(F.max(F.when(c("kind") == kind, c("totals")[i])), F.lit(0)).alias(f"{prefix}_{m}")
          for kind, prefix in (("league", "league"), ("league_season", "season")) for i, m in enumerate(MEASURES)])
    return dates.join(wide, "date", "left").select(
        "date", "history_through", *[F.coalesce(f"{p}_{m}", F.lit(0)).alias(f"{p}_{m}") for p in ("league", "season") for m in MEASURES])


def _answers(who: DataFrame, keys: list[str], questions: dict[str, tuple[str, Column, list[str]]], serving: DataFrame) -> DataFrame:
    """``keys``, date and the raw totals before it for each distinct (keys, date) of ``who``, however many requests share it.

    ``questions`` maps a column prefix to (kind, key, names of its totals); a kind without totals is a form, whose column the prefix names.
    """
    c = F.col
    who = who.select(*keys, "date").distinct()
    pairs = F.array(*[F.struct(F.lit(q).alias("slot"), F.lit(kind).alias("kind"), key.alias("key")) for q, (kind, key, _) in questions.items()])
    rows = who.select(*keys, "date", F.explode(pairs).alias("e")).select(*keys, "date", "e.*")
    held = serving.where(c("kind").isin(*[kind for kind, _, _ in questions.values()]))
    got = _looked_up(rows, held, "totals", "form").select(*keys, "date", "slot", "totals", "form")
    # Each asks for itself too, without an answer, so that whoever has no history is there.
    got = got.unionByName(who.select(*keys, "date", *[F.lit(None).cast(got.schema[x].dataType).alias(x) for x in ("slot", "totals", "form")]))
    wide = got.groupBy(*keys, "date").agg(*[
        F.first(F.when(c("slot") == q, c("totals" if names else "form")), ignorenulls=True).alias(f"_{q}") for q, (_, _, names) in questions.items()])
    empty = F.array().cast(serving.schema["form"].dataType)
    columns = []
    for q, (_, _, names) in questions.items():
        columns += [F.coalesce(c(f"_{q}")[i], F.lit(0)).alias(f"{q}{m}") for i, m in enumerate(names)] or [F.coalesce(f"_{q}", empty).alias(q)]
    return wide.select(*keys, "date", *columns)


def history_tables(states: DataFrame, serving: DataFrame, days: DataFrame) -> dict[str, DataFrame]:
    """What requests ask for, by name: keys, date and one struct of finished columns ``_got``, a row per distinct key and date.

    The rates are those of ``over_table.asof_tables``, computed once for all requests that share a player, a pair or a place on a date.
    """
    c = F.col
    league = days.select("date", *[f"league_{m}" for m in MEASURES])
    batters = states.select("date", "bowler", F.explode(F.array("batter", "non_striker")).alias("player"))
    tables = {}
    for side, who in (("bat", batters), ("bowl", states.select("date", c("bowler").alias("player")))):
        asks = {"career_": (side, _key("player"), MEASURES), "season_": (f"{side}_season", _key(F.year("date"), c("player")), MEASURES),
                **{f"{p}_": (f"{side}_phase", _key(c("player"), F.lit(p)), MEASURES) for p in h.PHASES}, "form": (f"{side}_form", _key("player"), [])}
        found = {n.removeprefix("role_"): x for n, x in ot.role_rates("role", side).items()}
        found |= {**h.recent_columns(side, ""), **h.decayed_columns(""), **h.calendar_columns("")}
        if side == "bat":
            asks["position_"] = ("position", _key("player"), h.POSITION_SUMS)
            found |= h.position_columns("", own="position_")
        tables[side] = ot.packed(h.join_league(_answers(who, ["player"], asks, serving), league), ["player", "date"], found, "_got")
    pairs = _answers(batters, ["player", "bowler"], {"": ("matchup", _key("player", "bowler"), MEASURES)}, serving)
    tables["matchups"] = ot.packed(h.join_league(pairs, league), ["player", "bowler", "date"], shrunk_rates(), "_got")
    for kind in ot.CONTEXTS:
        keys = h.CONTEXT_KINDS[kind]
        got = _answers(states, keys, {"": (kind, _key(*keys), MEASURES)}, serving)
        tables[kind] = ot.packed(got, [*keys, "date"], context_rates(f"{kind}_"), "_got")
    return tables


#: Fields of a delivery that the state before an over is made of.
_NUMBERS = ["over_number", "runs_total", "wicket", "boundary", "six", "legal", "runs_batter", "batter_ball", "bowler_conceded", "bowler_wicket"]
_OVER_SUMS = {"runs": "runs_total", "wickets": "wicket", "boundaries": "boundary", "sixes": "six"}
_LAG_FIELDS = {"runs": "runs_total", "wicket": "wicket", "boundary": "boundary"}


def _fold() -> Callable[[np.ndarray, dict[str, pa.Array], dict[str, pa.Array]], dict[str, pa.Array]]:
    """The fold of one Arrow batch. Made inside a function, it travels to the tasks by value, so they need no copy of this package."""
    def folded(over: np.ndarray, people: dict[str, pa.Array], past: dict[str, pa.Array]) -> dict[str, pa.Array]:
        """What the state columns need from the deliveries of one Arrow batch of requests: sums, counts, single balls, places.

        ``over`` is the over asked for (-1: null), ``people`` the batter, non-striker and bowler, ``past`` one list per field. As in SQL, a sum
        over an unknown value or an unknown list is null, and a comparison with an unknown value doesn't hold.
        """
        some = past["runs_total"]
        there = some.is_valid().to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        stop = np.cumsum(size)
        start, n = stop - size, int(size.sum())
        row = np.repeat(np.arange(len(size)), size)
        flat = {x: a.flatten() for x, a in past.items()}
        value = {x: pc.fill_null(flat[x].cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for x in _NUMBERS}
        known = {x: flat[x].is_valid().to_numpy(zero_copy_only=False) if flat[x].null_count else None for x in _NUMBERS}
        out: dict[str, pa.Array] = {}

        def total(x: np.ndarray, a: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0], np.cumsum(x)])
            return running[stop] - running[a]

        def put(name: str, field: str, a: np.ndarray = start, only: np.ndarray | None = None) -> None:
            """Sum of ``field`` over the deliveries from ``a`` on that ``only`` marks."""
            x, missing = value[field], ~there
            if known[field] is not None:
                lost = ~known[field] if only is None else only & ~known[field]
                missing = missing | (total(lost.astype(np.int64), a) > 0)
            out[name] = pa.array(total(x if only is None else x * only, a), mask=missing)

        for name, field in (("current_score", "runs_total"), ("current_wickets", "wicket"), ("legal_balls_before", "legal")):
            put(name, field)
        dated = (over[row] >= 0) if known["over_number"] is None else (over[row] >= 0) & known["over_number"]
        for span in _OVER_SPANS:
            recent = dated & (value["over_number"] >= over[row] - span)
            for name, field in _OVER_SUMS.items():
                put(f"{name}_last_{span}_overs", field, only=recent)
        dot = value["runs_total"] == 0 if known["runs_total"] is None else (value["runs_total"] == 0) & known["runs_total"]
        for span in _BALL_SPANS:
            a = np.maximum(start, stop - span)
            put(f"runs_last_{span}_deliveries", "runs_total", a)
            out[f"_dots_{span}"] = pa.array(total(dot.astype(np.int64), a), mask=~there)
            out[f"_size_{span}"] = pa.array(stop - a, mask=~there)
        for lag in range(1, _LAGS + 1):
            at, has = stop - lag, size >= lag
            at = np.where(has, at, 0)
            for name, field in _LAG_FIELDS.items():
                ball = value[field][at] if n else np.zeros(len(size), np.int64)
                seen = has if known[field] is None else has & known[field][at]
                out[f"ball_minus_{lag}_{name}"] = pa.array(np.where(seen, ball, -1).astype(np.int32))

        def coded(field: str, *roles: str) -> tuple[np.ndarray, list[np.ndarray], int]:
            """Codes of the deliveries' names and of the roles; 0 is null."""
            every = pa.chunked_array([flat[field].cast(pa.string()), *[people[x].cast(pa.string()) for x in roles]]).combine_chunks().dictionary_encode()
            codes = pc.fill_null(pc.add(every.indices.cast(pa.int64()), 1), 0).to_numpy(zero_copy_only=False)
            return codes[:n], np.split(codes[n:], len(roles)), len(every.dictionary) + 1

        faced, roles, width = coded("batter", "batter", "non_striker")
        each, first = np.unique(row * width + faced, return_index=True)     # a batter's first ball of the innings
        order = np.argsort(first)
        rank = np.empty(len(each), np.int64)
        innings = each // width
        entered = np.bincount(innings, minlength=len(size)) if len(each) else np.zeros(len(size), np.int64)
        rank[order] = np.arange(len(each)) - np.repeat(np.cumsum(entered) - entered, entered) + 1
        out["_entered"] = pa.array(entered.astype(np.int64), mask=~there)
        for name, code in zip(("batter", "non_striker"), roles):
            own = (faced == code[row]) & (faced > 0)
            put(f"{name}_innings_runs", "runs_batter", only=own)
            put(f"{name}_innings_balls", "batter_ball", only=own)
            asked = np.arange(len(size)) * width + code
            at = np.minimum(np.searchsorted(each, asked), max(len(each) - 1, 0))
            met = (each[at] == asked) & (code > 0) if len(each) else np.zeros(len(size), bool)
            out[f"_{name}_place"] = pa.array(np.where(met, rank[at], 0) if len(each) else np.zeros(len(size), np.int64), mask=~there | (code == 0))
        bowled, (code,), _ = coded("bowler", "bowler")
        own = (bowled == code[row]) & (bowled > 0)
        for name, field in (("legal_balls", "legal"), ("conceded", "bowler_conceded"), ("wickets", "bowler_wicket")):
            put(f"bowler_match_{name}", field, only=own)
        return out
    return folded


def _identity() -> list[Column | str]:
    """What a request says about itself, under the names of the over table."""
    c = F.col
    return ["request_id", "match_id", c("date").cast("date").alias("date"), F.year(c("date").cast("date")).alias("season"), "innings", c("over").alias("over_number"),
            "venue", "team_batting", "team_bowling", c("striker").alias("batter"), "non_striker", "bowler"]


def described_requests(requests: DataFrame) -> DataFrame:
    """State before the over, ball windows, tallies and positions, from the request's own deliveries, folded in Arrow batches."""
    c, past = F.col, F.col("previous_deliveries")
    fields = [*_NUMBERS, "batter", "bowler"]
    base = requests.select(
        *_identity(), c("target").cast("bigint").alias("target"), c("score").alias("claimed_score"), c("wickets").alias("claimed_wickets"), *[past[x].alias(f"_past_{x}") for x in fields])
    kept = [x for x in base.columns if not x.startswith("_past_")]
    none = {x: pa.array([], pa.list_(pa.string() if x in ("batter", "bowler") else pa.int64())) for x in fields}
    folded = _fold()
    made = folded(np.zeros(0, np.int64), {x: pa.array([], pa.string()) for x in ("batter", "non_striker", "bowler")}, none)
    schema = T.StructType([*[base.schema[x] for x in kept], *[T.StructField(x, T.IntegerType() if a.type == pa.int32() else T.LongType()) for x, a in made.items()]])

    def run(batches):
        for b in batches:
            over = pc.fill_null(b.column("over_number").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            new = folded(over, {x: b.column(x) for x in ("batter", "non_striker", "bowler")}, {x: b.column(f"_past_{x}") for x in fields})
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in kept], *new.values()], [*kept, *new])

    rows = base.mapInArrow(run, schema)
    out: dict[str, Column] = {f"dot_rate_last_{n}_deliveries": c(f"_dots_{n}") / k.at_least(c(f"_size_{n}")) for n in _BALL_SPANS}
    for role, fallback in (("batter", 1), ("non_striker", 2)):
        place = c(f"_{role}_place")
        out |= {f"{role}_innings_sr": 100 * c(f"{role}_innings_runs") / k.at_least(c(f"{role}_innings_balls")),
                f"{role}_position_now": F.when(place > 0, place).otherwise(F.greatest(c("_entered") + 1, F.lit(fallback)).cast("bigint"))}
    legal = c("bowler_match_legal_balls")
    out |= {"bowler_match_economy": 6 * c("bowler_match_conceded") / k.at_least(legal), "bowler_overs_bowled_this_match": legal / 6,
            "bowler_overs_remaining_quota": F.greatest(F.lit(0.0), k.OVERS_PER_BOWLER - legal / 6)}
    return ot.described(rows.select(*[x for x in rows.columns if not x.startswith("_")], *ot.named(out)))


def request_verdicts(requests: DataFrame) -> DataFrame:
    """``requests`` with the first reason for which each can't be forecast; null if it can."""
    return requests.withColumn("reason", first_failure(live_state_rules()))


def live_features(requests: DataFrame, serving: DataFrame, keep: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] = dict) -> DataFrame:
    """Features of every sound request, under the names of the over table, with ``request_id``.

    A request that breaks a rule of live states, or whose score or wickets disagree with its own deliveries, is left out;
    ``request_verdicts`` names the former. ``keep`` may write what is read more than once (the folded requests, the league of their
    days, the answers) and read it back, so that its size decides the joins; without it the plan stays one lazy query.
    """
    c = F.col
    sound = request_verdicts(requests).where("reason is null").drop("reason")
    states = keep({"requests": described_requests(sound)})["requests"]
    # Nobody joins an answer that only an unsound request asked for; a lazy plan leaves the folds out of its questions.
    who = states if keep is not dict else requests.select(*_identity()).withColumn("phase", k.phase(c("over_number")))
    days = keep({"days": league_lookup(who.select("date").distinct(), serving)})["days"]
    tables = keep(history_tables(who, serving, days))
    opened = h.join_league(states, days)
    opened = opened.where(first_failure(state_rules()).isNull()).drop("claimed_score", "claimed_wickets")
    keys = ["date", "over_number", "phase", "venue", "team_batting", "team_bowling", "batter", "non_striker", "bowler"]
    era, totals = era_rates(), {f"{p}_{m}" for p in ("league", "season") for m in MEASURES}
    held = [x for x in opened.columns if x not in totals and x not in keys]
    rows = opened.select(*keys, F.struct(*held, *ot.named(era)).alias("_state"))
    columns = {**{x: c("_state")[x] for x in held}, **{x: c(x) for x in keys}, **{x: c("_state")[x] for x in era}}

    def answered(name: str, at: dict[str, str], out: str, prefix: str = "") -> None:
        """Join the table ``name`` as ``out``; ``at`` names the request's column of each of its keys, in which nulls are equal."""
        nonlocal rows
        table = tables[name].select(*[c(x).alias(f"_at_{x}") for x in (*at, "date")], c("_got").alias(out))
        on = [c(f"_at_{x}").eqNullSafe(c(own)) for x, own in {**at, "date": "date"}.items()]
        rows = rows.join(table, on, "left").drop(*[f"_at_{x}" for x in (*at, "date")])
        columns.update({f"{prefix}{x}": c(out)[x] for x in tables[name].schema["_got"].dataType.names})

    for role, side in ot.ROLES.items():
        answered(side, {"player": role}, f"_{role}", f"{role}_")
    for role in ("batter", "non_striker"):
        answered("matchups", {"player": role, "bowler": "bowler"}, f"_{role}_matchup", f"{role}_matchup_")
    for kind in ot.CONTEXTS:
        answered(kind, {x: x for x in h.CONTEXT_KINDS[kind]}, f"_{kind}")
    return rows.select(*ot.named({**columns, **ot.era_ratios(found=columns)}))
