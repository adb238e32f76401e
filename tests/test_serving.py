"""Live requests: look-ups by validity interval, and features of matches that aren't in the log."""
import datetime

import pytest
from pyspark.sql import functions as F

from innings_engine.plans import over_table as ot, serving as sv
from tests.test_semantics import ball, frame

STATE = ("request_id string, match_id string, date string, innings int, over int, score int, wickets int, striker string, non_striker string, bowler string, venue string, "
         "team_batting string, team_bowling string, target int, bowler_confirmed boolean, previous_deliveries array<struct<over_number:int,ball_number:int,batter:string,"
         "non_striker:string,bowler:string,runs_batter:int,runs_extras:int,runs_total:int,wides:int,noballs:int,byes:int,legbyes:int,penalty:int,legal:int,batter_ball:int,"
         "wicket:int,bowler_wicket:int,boundary:int,six:int,bowler_conceded:int>>")


def delivery(over, number, batter="a", runs=1, wicket=0):
    return (over, number, batter, "b", "c", runs, 0, runs, 0, 0, 0, 0, 0, 1, 1, wicket, wicket, int(runs in (4, 6)), int(runs == 6), runs)


def request(name, date, over=1, striker="a", past=(), score=None, **more):
    row = dict(request_id=name, match_id="live", date=date, innings=1, over=over, score=sum(d[7] for d in past) if score is None else score, wickets=0, striker=striker,
               non_striker="b", bowler="c", venue="V", team_batting="T", team_bowling="U", target=0, bowler_confirmed=True, previous_deliveries=list(past))
    row.update(more)
    return tuple(row[x.split(" ")[0]] for x in STATE.split(", previous")[0].split(", ")) + (row["previous_deliveries"],)


def day(s):
    return datetime.date.fromisoformat(s)


@pytest.fixture(scope="module")
def history(spark):
    """Player a scores one run a ball on three days in different months; d only on the last."""
    rows = [ball(f"m{i}", d, over=1, ball_no=n, batter="a", runs=1) for i, d in enumerate(["2020-01-05", "2020-01-20", "2021-04-07"]) for n in range(1, 7)]
    rows += [ball("m9", "2021-04-07", over=1, ball_no=n, batter="d", runs=4) for n in range(1, 7)]
    return sv.serving_table(frame(spark, rows)).cache()


def test_the_newest_row_before_the_date(spark, history):
    want = {"2020-01-05": (0, 0), "2020-01-06": (6, 6), "2020-01-20": (6, 6), "2020-01-21": (12, 12), "2020-12-31": (12, 12),
            "2021-04-07": (12, 0), "2021-04-08": (18, 6), "2031-01-01": (18, 0), "2001-01-01": (0, 0)}
    played = [day(d) for d in ("2020-01-05", "2020-01-20", "2021-04-07")]
    got = sv.live_features(spark.createDataFrame([request(d, d) for d in want], STATE), history).collect()
    assert {r.request_id: (r.batter_career_balls, r.batter_season_balls) for r in got} == want
    for r in got:
        assert r.date == day(r.request_id) and r.season == r.date.year
        assert r.batter_last_365d_innings == sum(0 < (r.date - d).days <= 365 for d in played)
        assert r.history_through == max((d for d in played if d < r.date), default=None)


def test_a_player_never_seen_and_an_empty_store(spark, history):
    asked = spark.createDataFrame([request("new", "2022-01-01", striker="nobody"), request("old", "2022-01-01", striker="d")], STATE)
    rows = {r.request_id: r for r in sv.live_features(asked, history).collect()}
    assert rows["new"].batter_career_balls == 0 and rows["new"].batter_recent_5_sr == 0 and rows["new"].batter_innings_seen == 0
    assert rows["old"].batter_career_runs == 24 and rows["old"].batter_position_now == 1 and rows["old"].batter_mean_position == 1
    nothing = sv.live_features(asked, history.limit(0)).collect()
    assert {r.batter_career_balls for r in nothing} == {0} and {r.era_balls_observed for r in nothing} == {0}


def test_state_windows_and_tallies_come_from_the_request(spark, history):
    past = [delivery(1, n, runs=r) for n, r in enumerate((4, 0, 1, 6, 0, 0), 1)] + [delivery(2, n, batter="b", runs=n - 1) for n in range(1, 7)]
    row = sv.live_features(spark.createDataFrame([request("r", "2022-01-01", over=3, past=past, bowler="c")], STATE), history).collect()[0]
    assert (row.current_score, row.legal_balls_before, row.runs_last_1_overs, row.runs_last_2_overs, row.runs_last_6_deliveries) == (26, 12, 15, 26, 15)
    assert (row.batter_innings_runs, row.non_striker_innings_runs, row.batter_position_now, row.non_striker_position_now) == (11, 15, 1, 2)
    assert (row.ball_minus_1_runs, row.ball_minus_12_runs, row.dot_rate_last_12_deliveries) == (5, 4, 4 / 12)
    assert row.bowler_match_legal_balls == 12 and row.bowler_overs_remaining_quota == 2


def test_unsound_requests_are_named_and_left_out(spark, history):
    past = [delivery(1, n) for n in range(1, 7)]
    asked = spark.createDataFrame([
        request("ok", "2022-01-01", over=2, past=past), request("score", "2022-01-01", over=2, past=past, score=7), request("leak", "2022-01-01", over=1, past=past),
        request("short", "2022-01-01", over=2, past=past[1:]), request("same", "2022-01-01", striker="b")], STATE)
    assert [r.request_id for r in sv.live_features(asked, history).collect()] == ["ok"]
    reasons = {r.request_id: r.reason for r in sv.request_verdicts(asked).collect()}
    assert reasons["ok"] is None and reasons["leak"] == "target_over_leak" and reasons["short"] == "incomplete_over" and reasons["same"] == "not_distinct"


def test_live_rows_have_every_feature(spark, history, log):
    batch = ot.over_samples(log)
    live = sv.live_features(spark.createDataFrame([request("r", "2022-01-01")], STATE), history)
    assert set(ot.feature_columns(batch)) <= set(live.columns)
    assert len(ot.feature_columns(batch)) == 236


def test_a_day_is_met_once(history):
    """Buckets of one row never overlap with those of another for one date."""
    spans = history.where("kind = 'bat' and key = 'a'").select("bucket", "valid_from", F.coalesce("valid_to", F.lit(day("9999-01-01"))).alias("valid_to")).distinct().collect()
    for date in ("2020-01-06", "2020-02-01", "2021-04-07", "2022-01-01"):
        month = day(date).year * 12 + day(date).month
        assert len([s for s in spans if s.bucket in (month, sv.OPEN) and s.valid_from < day(date) <= s.valid_to]) == 1


def test_odd_deliveries_and_the_cost_of_a_fold(spark, history):
    """Unknown values and names, no deliveries and a missing list, against the rules written out; folds don't run row by row in SQL."""
    past = [delivery(1, 1, batter=None, runs=2), delivery(1, 2, batter="b", runs=0), (1, 3, "a", "b", None, None, 0, None, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0)]
    asked = spark.createDataFrame([request("odd", "2022-01-01", over=2, past=past, score=0), request("none", "2022-01-01"),
                                   tuple(None if i == 15 else x for i, x in enumerate(request("missing", "2022-01-01")))], STATE)
    described = sv.described_requests(asked)
    rows = {r.request_id: r for r in described.collect()}
    odd, none, missing = rows["odd"], rows["none"], rows["missing"]
    assert (odd.current_score, odd.current_wickets, odd.runs_last_1_overs, odd.runs_last_6_deliveries, odd.wickets_last_1_overs) == (None, 0, None, None, 0)
    assert odd.dot_rate_last_6_deliveries == 1 / 3 and (odd.ball_minus_1_runs, odd.ball_minus_2_runs, odd.ball_minus_3_runs, odd.ball_minus_4_runs) == (-1, 0, 2, -1)
    assert (odd.batter_position_now, odd.non_striker_position_now, odd.batter_innings_runs, odd.non_striker_innings_runs) == (3, 2, None, 0)
    assert odd.bowler_match_legal_balls == 2
    assert (none.current_score, none.batter_position_now, none.non_striker_position_now, none.dot_rate_last_6_deliveries, none.ball_minus_1_runs) == (0, 1, 2, 0, -1)
    assert (missing.current_score, missing.dot_rate_last_6_deliveries, missing.ball_minus_1_runs, missing.batter_position_now, missing.non_striker_position_now) == (None, None, -1, 1, 2)
    plan = described._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
