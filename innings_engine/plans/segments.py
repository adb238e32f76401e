"""Named segments and error conditions of the over table, as column predicates."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

SUPPORT = ["batter_career_balls", "non_striker_career_balls", "bowler_career_balls"]


def support() -> Column:
    """Balls of history of the least-seen of the three players."""
    return F.least(*SUPPORT)


def audit_segments() -> dict[str, Column]:
    """Twenty overlapping segments of the held-out overs."""
    c = F.col
    over, second, rate = c("over_number"), c("innings") == 2, c("required_run_rate")
    return {
        "powerplay": over <= 6, "middle_overs": over.between(7, 15), "death_overs": over >= 16,
        "first_innings": c("innings") == 1, "second_innings": second,
        "chase_low_rrr": second & (rate < 8), "chase_medium_rrr": second & (rate >= 8) & (rate < 12),
        "chase_high_rrr": second & (rate >= 12),
        "wickets_0_2": c("current_wickets") <= 2, "wickets_3_5": c("current_wickets").between(3, 5),
        "wickets_6_plus": c("current_wickets") >= 6,
        "set_batter": c("batter_innings_balls") >= 20, "new_batter": c("batter_innings_balls") < 6,
        "known_player": support() >= 300, "low_history_player": (support() > 0) & (support() < 120),
        "cold_start_player": support() == 0,
        "known_matchup": c("batter_matchup_balls") >= 12, "sparse_matchup": c("batter_matchup_balls") == 0,
        "known_venue": c("venue_balls") >= 5000, "sparse_venue": c("venue_balls") < 1500,
    }


def report_segments() -> dict[str, Column]:
    """Segments of the training report, and overs picked by what actually happened."""
    c = F.col
    return {
        "unseen_matchup": c("batter_matchup_balls") == 0, "seen_matchup": c("batter_matchup_balls") > 0,
        "high_required_rate": c("required_run_rate") >= 12,
        "low_required_rate_chase": (c("required_run_rate") < 8) & (c("innings") == 2),
        "actual_15_plus": c("y") >= 15, "actual_20_plus": c("y") >= 20, "actual_under_5": c("y") < 5,
    }


def situations() -> dict[str, Column]:
    """Seven match situations from which a representative over is taken."""
    c = F.col
    second, rate = c("innings") == 2, c("required_run_rate")
    return {
        "powerplay": c("over_number") <= 6, "middle": c("over_number").between(7, 15), "death": c("over_number") >= 16,
        "low_pressure_chase": second & (rate < 8), "high_pressure_chase": second & (rate >= 12),
        "high_scoring_state": c("current_run_rate") >= 11, "low_scoring_state": c("current_run_rate") <= 6,
    }


def error_conditions() -> dict[str, Column]:
    """Conditions tested for over-representation among the largest errors.

    ``six_hit`` is the sum of the six and boundary flags reaching two, i.e. a six was hit.
    """
    c = F.col
    return {
        "wicket_fell": c("target_wicket") == 1,
        "six_hit": c("target_six") + c("target_boundary") >= 2,
        "extreme_over": c("y") >= 20,
        "extras_of_two_or_more": c("target_extras") >= 2,
        "death_overs": c("over_number") >= 16, "powerplay": c("over_number") <= 6,
        "new_batter_under_6_balls": c("batter_innings_balls") < 6,
        "sparse_batter_history": c("batter_career_balls") < 120,
        "sparse_bowler_history": c("bowler_career_balls") < 120,
        "unseen_matchup": c("batter_matchup_balls") == 0,
        "required_rate_at_least_12": c("required_run_rate") >= 12,
        "high_pressure_chase": (c("innings") == 2) & (c("required_run_rate") >= 12),
        "second_innings_chase": c("innings") == 2,
        "cold_start_player": support() == 0, "sparse_venue": c("venue_balls") < 1500,
    }
