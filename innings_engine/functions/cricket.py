"""Column expressions for the delivery log: phases, buckets, classes and rates."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Fixed values of the domain: scoring buckets, pressure bands, over limits.
RUN_BUCKET_EDGES = [5, 8, 11, 15, 20]
RUN_BUCKET_NAMES = ["0-4", "5-7", "8-10", "11-14", "15-19", "20+"]
PRESSURE_EDGES = [6, 8, 10, 12]
RUN_CLASSES = [0, 1, 2, 3, 4, 6]          # every other value falls into one last class
LAST_POWERPLAY_OVER, LAST_MIDDLE_OVER = 6, 15
BALLS_PER_INNINGS, BALLS_PER_OVER, WICKETS_PER_INNINGS, OVERS_PER_BOWLER = 120, 6, 10, 4
SHRINK_BALLS = 24
ERA_MIN_BALLS = 600
NOT_A_WICKET = ["retired hurt", "retired not out"]
NOT_THE_BOWLERS_WICKET = ["retired hurt", "retired not out", "run out", "retired out",
                          "obstructing the field"]


def phase(over: Column) -> Column:
    return (F.when(over <= LAST_POWERPLAY_OVER, "powerplay")
            .when(over <= LAST_MIDDLE_OVER, "middle")
            .otherwise("death"))


def right_closed_bucket(value: Column, edges: Sequence[float]) -> Column:
    """Index of the bucket holding ``value``; a value equal to an edge moves up."""
    steps = [F.when(value >= F.lit(edge), 1).otherwise(0) for edge in edges]
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return total


def run_bucket(runs: Column) -> Column:
    return right_closed_bucket(runs, RUN_BUCKET_EDGES)


def pressure_bucket(target: Column, required_rate: Column) -> Column:
    return F.when(target == 0, 0).otherwise(right_closed_bucket(required_rate, PRESSURE_EDGES) + 1)


def run_class(runs: Column) -> Column:
    out = F
    for index, value in enumerate(RUN_CLASSES):
        out = out.when(runs == value, index)
    return out.otherwise(len(RUN_CLASSES))


def extra_class(extras: Column) -> Column:
    return F.least(extras, F.lit(4))


def legality_class(wides: Column, noballs: Column) -> Column:
    return F.when(wides > 0, 1).when(noballs > 0, 2).otherwise(0)


def at_least(value: Column, floor: float = 1) -> Column:
    """Denominator guard."""
    return F.greatest(value, F.lit(floor))


def canonical_text(text: Column) -> Column:
    """Leading part before a comma, dots as blanks, whitespace collapsed."""
    head = F.split(text, ",").getItem(0)
    return F.trim(F.regexp_replace(F.regexp_replace(head, r"\.", " "), r"\s+", " "))


def renamed(value: Column, names: Mapping[str, str]) -> Column:
    """Map old names to current ones through a literal map; others pass unchanged."""
    if not names:
        return value
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[value], value)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def chase_columns(target: Column, score: Column, legal: Column, wickets: Column) -> dict[str, Column]:
    """Arithmetic of a chase; every column is 0 when no target is set."""
    chasing = target > 0
    required = F.when(chasing, F.greatest(F.lit(0), target - score)).otherwise(0)
    balls_left = BALLS_PER_INNINGS - legal
    wickets_left = WICKETS_PER_INNINGS - wickets
    current_rate = 6 * score / at_least(legal)
    required_rate = F.when(chasing, 6 * required / at_least(balls_left)).otherwise(0.0)
    return {
        "balls_remaining": balls_left,
        "wickets_remaining": wickets_left,
        "current_run_rate": current_rate,
        "runs_required": required,
        "required_run_rate": required_rate,
        "required_minus_current_rate": F.when(chasing, required_rate - current_rate).otherwise(0.0),
        "required_runs_per_wicket": F.when(chasing, required / at_least(wickets_left)).otherwise(0.0),
        "balls_per_wicket_remaining": balls_left / at_least(wickets_left),
        "pressure_bucket": pressure_bucket(target, required_rate),
    }
