"""The ball sample against a hand-built over."""
import pytest
from pyspark.sql import functions as F

from innings_engine.operators import delivery as d

#: batter, non_striker, runs, wide, wicket
BALLS = [("A", "B", 1, 0, 0), ("B", "A", 0, 1, 0), ("B", "A", 4, 0, 0), ("B", "A", 0, 0, 1), ("C", "A", 6, 0, 0), ("C", "A", 1, 0, 0), ("A", "C", 0, 0, 0)]


@pytest.fixture(scope="module")
def rows(spark):
    log = spark.createDataFrame(
        [("m", 2, 3, i + 1, a, b, r, w, r + w, w, 0, out, 1 - w, 1 - w, int(r in (4, 6)), int(r == 6)) for i, (a, b, r, w, out) in enumerate(BALLS)],
        "match_id string, innings int, over_number int, ball_number int, batter string, non_striker string, runs_batter int, runs_extras int, "
        "runs_total int, wides int, noballs int, wicket int, legal int, batter_ball int, boundary int, six int")
    values = {f"{r}_{s}": base + i for r, base in (("batter", 100.0), ("non_striker", 200.0)) for i, s in enumerate(d.STRIKER_STATS)}
    values |= {x: 1.0 for x in d.BALL_CONTEXT} | {"chase_target": 41, "era_strike_rate": 130.0, "batter_matchup_balls": None}
    over = {"current_score": 20, "current_wickets": 8, "legal_balls_before": 12}
    overs = spark.range(1).select(
        F.lit("m").alias("match_id"), F.lit(2).alias("innings"), F.lit(3).alias("over_number"), F.lit("2020-01-01").alias("date"), F.lit(2020).alias("season"),
        *[F.lit(v).cast("double").alias(n) for n, v in values.items()], *[F.lit(v).alias(n) for n, v in over.items()],
        *[F.lit(x).alias(x) for x in d.BALL_NAMES])
    return d.striker_samples(log, overs.unionByName(overs.withColumn("over_number", F.lit(9))))


def test_slots_statistics_and_tallies(rows):
    got = rows.orderBy("ball_number").collect()
    assert [r.striker_slot for r in got] == ["batter", "non_striker", "non_striker", "non_striker", "replacement", "replacement", "batter"]
    assert [r.striker_career_strike_rate for r in got] == [100.0, 200.0, 200.0, 200.0, 130.0, 130.0, 100.0]
    assert [r.striker_is_replacement for r in got] == [0, 0, 0, 0, 1, 1, 0]
    first, new, last = got[0], got[4], got[6]
    assert (first.striker_matchup_balls, new.striker_sr_vs_era, new.striker_mean_position, new.striker_position_now, new.striker_career_balls) == (0.0, 1.0, 7.0, 7.0, 0.0)
    assert [(r.striker_live_runs, r.striker_live_balls) for r in got] == [(0, 0), (0, 0), (0, 0), (4, 1), (0, 0), (6, 1), (1, 1)]
    assert (last.other_live_runs, last.other_live_balls, last.striker_live_sr) == (7, 2, 100.0)
    assert [r.current_score for r in got] == [20, 21, 22, 26, 26, 32, 33]
    assert [(r.current_wickets, r.wickets_remaining) for r in (got[3], got[4])] == [(8, 2), (9, 1)]
    assert [(r.balls_in_over, r.legal_in_over, r.illegal_in_over) for r in (got[1], got[2])] == [(1, 1, 0), (2, 1, 1)]
    assert (last.runs_required, last.legal_balls_innings, last.balls_remaining) == (8, 17, 103)
    assert last.required_run_rate == pytest.approx(48 / 103) and last.required_runs_per_wicket == pytest.approx(8.0)
    assert [(r.target_runs, r.target_extras, r.target_legality, r.target_wicket) for r in got[:5]] == [(1, 0, 0, 0), (0, 1, 1, 0), (4, 0, 0, 0), (0, 0, 0, 1), (5, 0, 0, 0)]


def test_81_inputs_without_python(rows):
    others = {"match_id", "ball_number", "striker", "date", "season"}
    assert len([x for x in rows.columns if x not in others and not x.startswith("target_")]) == 81
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
