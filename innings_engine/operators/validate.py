"""Rule sets for over states, deliveries and live match states."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cricket as k


def state_rules() -> dict[str, Column]:
    """An over start is usable when its prefix is complete and the innings still open."""
    c = F.col
    over, target = c("over_number"), c("target")
    return {
        "history_not_before_date": c("history_through") >= c("date"),
        "incomplete_over_history": c("legal_balls_before") != (over - 1) * k.BALLS_PER_OVER,
        "state_disagrees_with_history": (c("claimed_score") != c("current_score"))
        | (c("claimed_wickets") != c("current_wickets")),
        "innings_complete": (c("current_wickets") >= k.WICKETS_PER_INNINGS) | (over > 20)
        | ((target > 0) & (c("current_score") >= target)),
    }


# Fixed value ranges of a delivery: column -> (low, high).
DELIVERY_RANGES = {
    "over_number": (1, 20), "ball_number": (1, 100), "runs_batter": (0, 12), "runs_extras": (0, 20),
    "runs_total": (0, 32), "wides": (0, 20), "noballs": (0, 20), "byes": (0, 20), "legbyes": (0, 20),
    "penalty": (0, 20), "legal": (0, 1), "batter_ball": (0, 1), "wicket": (0, 2), "bowler_wicket": (0, 1),
    "boundary": (0, 1), "six": (0, 1), "bowler_conceded": (0, 32),
}


def delivery_rules(get=F.col) -> dict[str, Column]:
    """Ranges and accounting of one delivery; ``get`` reads a field (of a row or of a struct)."""
    out_of_range = F.lit(False)
    for name, (low, high) in DELIVERY_RANGES.items():
        out_of_range = out_of_range | ~get(name).between(low, high)
    for name in ("batter", "non_striker", "bowler"):
        out_of_range = out_of_range | ~F.length(get(name)).between(1, 100)
    extras = get("wides") + get("noballs") + get("byes") + get("legbyes") + get("penalty")
    legal = (get("wides") == 0) & (get("noballs") == 0)
    return {
        "out_of_range": out_of_range,
        "inconsistent_total": get("runs_total") != get("runs_batter") + get("runs_extras"),
        "inconsistent_extras": get("runs_extras") != extras,
        "invalid_ball_accounting": (get("legal") != k.flag(legal)) | (get("batter_ball") != k.flag(get("wides") == 0)),
        "invalid_bowler_conceded": get("bowler_conceded") != get("runs_batter") + get("wides") + get("noballs"),
        "invalid_boundary_flag": (get("six") > get("boundary")) | ((get("six") == 1) & (get("runs_batter") != 6))
        | ((get("boundary") == 1) & ~get("runs_batter").isin(4, 6)),
        "invalid_wicket_accounting": get("bowler_wicket") > get("wicket"),
    }


PREFIX_FIELDS = ["over_number", "ball_number", "batter", "non_striker", "bowler", "runs_batter", "runs_extras",
                 "runs_total", "wides", "noballs", "byes", "legbyes", "penalty", "legal", "batter_ball", "wicket",
                 "bowler_wicket", "boundary", "six", "bowler_conceded"]


def live_states(log_with_state: DataFrame) -> DataFrame:
    """Live request per over start: the state plus the innings prefix as an array.

    The prefix is collected once per innings (bounded by its overs) and cut per over.
    """
    c = F.col
    ball = F.struct(*[c(f) for f in PREFIX_FIELDS])
    log = log_with_state if "penalty" in log_with_state.columns else log_with_state.withColumn("penalty", F.lit(0))
    whole = log.groupBy("match_id", "innings").agg(F.sort_array(F.collect_list(ball)).alias("_all"))
    starts = log.filter(c("ball_number") == 1).select(
        "match_id", c("date").cast("string").alias("date"), "innings", c("over_number").alias("over"),
        c("current_score").alias("score"), c("current_wickets").alias("wickets"),
        c("batter").alias("striker"), "non_striker", "bowler", "venue", "team_batting", "team_bowling", "target",
        F.lit(True).alias("bowler_confirmed"))
    joined = starts.join(whole, ["match_id", "innings"])
    return joined.withColumn("previous_deliveries", F.filter(
        "_all", lambda d: d["over_number"] < c("over"))).drop("_all")


def live_state_rules() -> dict[str, Column]:
    """Checks of a live request, in the order they are reported."""
    c = F.col
    past = c("previous_deliveries")
    text = F.lit(False)
    for name, limit in (("match_id", 100), ("striker", 100), ("non_striker", 100), ("bowler", 100),
                        ("venue", 200), ("team_batting", 100), ("team_bowling", 100)):
        text = text | ~F.length(name).between(1, limit)
    numbers = (~c("innings").isin(1, 2) | ~c("over").between(1, 20) | ~c("score").between(0, 500)
               | ~c("wickets").between(0, 9) | ~c("target").between(0, 501) | ~c("bowler_confirmed")
               | (F.size(past) > 400))
    bad_date = ~c("date").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date("date", "yyyy-MM-dd").isNull()
    bad_ball = F.exists(past, _broken)
    key = lambda d: d["over_number"] * 1000 + d["ball_number"]
    keys = F.transform(past, key)
    ordered = F.array_sort(F.array_distinct(keys))

    # One pass over the prefix: every over starts at ball 1, counts up, holds six legal balls
    # and is followed by the next over number.
    def step(acc: Column, d: Column) -> Column:
        same = d["over_number"] == acc["over"]
        follows = F.when(same, d["ball_number"] == acc["ball"] + 1).otherwise(
            (acc["legal"] == k.BALLS_PER_OVER) & (d["over_number"] == acc["over"] + 1) & (d["ball_number"] == 1))
        return F.struct(d["over_number"].alias("over"), d["ball_number"].alias("ball"),
                        F.when(same, acc["legal"] + d["legal"]).otherwise(d["legal"]).alias("legal"),
                        (acc["ok"] & follows).alias("ok"))

    start = F.struct(F.lit(0).alias("over"), F.lit(0).alias("ball"), F.lit(k.BALLS_PER_OVER).alias("legal"), F.lit(True).alias("ok"))
    complete = F.aggregate(
        F.filter(past, lambda d: d["over_number"] < c("over")), start, step,
        lambda acc: acc["ok"] & (acc["legal"] == k.BALLS_PER_OVER) & (acc["over"] == c("over") - 1))
    return {
        "out_of_range": numbers | text,
        "invalid_date": bad_date,
        "invalid_delivery": bad_ball,
        "not_distinct": (c("striker") == c("non_striker")) | (c("team_batting") == c("team_bowling")),
        "invalid_target": ((c("innings") == 1) & (c("target") != 0)) | ((c("innings") == 2) & (c("target") <= c("score"))),
        "not_ordered": keys != ordered,
        "incomplete_over": ~complete,
        "target_over_leak": F.exists(past, lambda d: d["over_number"] >= c("over")),
    }


def _broken(delivery: Column) -> Column:
    broken = F.lit(False)
    for rule in delivery_rules(lambda name: delivery[name]).values():
        broken = broken | rule
    return F.coalesce(broken, F.lit(True))
