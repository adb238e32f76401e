"""The sample tables: narrow ones equal the full one, and no table per over or ball goes through the driver."""
import pytest
from pyspark.sql import functions as F

from innings_engine.operators import delivery as d, windows as w
from innings_engine.plans import forecast as fc, over_table as ot
from innings_engine.sources.delivery_log import OVER_KEY


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def overs(log):
    return ot.over_samples(log, ("career",))


@pytest.mark.parametrize("of", [lambda log, overs: d.delivery_dataset(log, overs), lambda log, overs: w.position_now(log)])
def test_balls_and_overs_are_never_broadcast(log, overs, of):
    assert "BroadcastHashJoin [match_id" not in plan_of(of(log, overs))


def test_the_ball_sample_is_never_broadcast(log):
    overs = w.over_starts(log).select(
        *OVER_KEY, "date", "season", *d.BALL_NAMES[1:], F.lit("death").alias("phase"), *[F.lit(1.0).alias(x) for x in d.BALL_CONTEXT],
        *[F.lit(1.0).alias(f"{r}_{s}") for r in ("batter", "non_striker") for s in d.STRIKER_STATS],
        *[F.lit(0).alias(x) for x in ("current_score", "current_wickets", "legal_balls_before")])
    assert "BroadcastHashJoin [match_id" not in plan_of(d.striker_samples(log, overs))


@pytest.mark.parametrize("groups", [fc.STATE, fc.HISTORY, fc.REPORT, fc.BALL])
def test_narrow_tables_equal_the_full_one(spark, sf, groups):
    full, narrow = fc.samples(spark, sf), fc.samples(spark, sf, groups)
    names = [x for x in narrow.columns if x in full.columns]
    assert set(names) == set(narrow.columns) and len(names) < len(full.columns)
    assert full.select(*names).exceptAll(narrow.select(*names)).isEmpty() and full.count() == narrow.count() > 500


def test_overs_are_combined_without_sorting_aggregates(log):
    plan = plan_of(ot.overs_in_one_pass(log, ot.GROUPS))
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_state_before_an_over_is_that_of_its_first_ball(log):
    names = [*OVER_KEY, "current_score", "current_wickets", "legal_balls_before", "target", "batter", "non_striker", "bowler"]
    slow = w.over_starts(w.running_state(log)).select(*names)
    fast = ot.overs_in_one_pass(log, ()).select(*names)
    assert slow.exceptAll(fast).isEmpty() and fast.exceptAll(slow).isEmpty()


def test_only_one_join_of_the_full_table_is_wide(log):
    """As-of tables come in as one struct each: their joins don't copy hundreds of columns."""
    def widths(node):
        here = [node.output().size()] if node.nodeName() == "Join" else []
        children = node.children()
        return here + [x for i in range(children.size()) for x in widths(children.apply(i))]
    found = widths(ot.over_samples(log)._jdf.queryExecution().analyzed())
    assert len(found) > 15 and sum(x > 60 for x in found) == 1        # the overs and the totals of the league, before anything is packed


def test_overs_are_not_shuffled_for_the_as_of_probabilities(spark, sf):
    """The as-of tables have a row per key and date; their size is known before the overs are joined."""
    from innings_engine.plans import probabilities as pb
    overs = fc.samples(spark, sf, fc.STATE)
    for rates, name in ((pb.event_rates, "bowler_events"), (pb.bucket_rates, "phase_buckets")):
        df = rates(overs)
        assert any(f"/stage-{name}-" in x for x in df.inputFiles()) and "SortMergeJoin" not in plan_of(df), name
