"""Rates over the eight-measure history aggregate."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .cricket import ERA_MIN_BALLS, SHRINK_BALLS, at_least

MEASURES = ["runs", "balls", "outs", "boundaries", "sixes", "dots", "conceded", "legal"]


def shrunk_rates(prefix: str = "", own: str = "", league: str = "league_") -> dict[str, Column]:
    """Rates pulled towards the league's own rate with the weight of 24 balls.

    ``own`` and ``league`` are the prefixes of the measure columns on the joined row.
    """
    a = {m: F.col(f"{own}{m}") for m in MEASURES}
    g = {m: F.col(f"{league}{m}") for m in MEASURES}

    def per_ball(measure: str) -> Column:
        prior = SHRINK_BALLS * g[measure] / at_least(g["balls"])
        return (a[measure] + prior) / (a["balls"] + SHRINK_BALLS)

    economy_prior = SHRINK_BALLS * g["conceded"] / at_least(g["legal"])
    return {
        f"{prefix}runs": a["runs"],
        f"{prefix}balls": a["balls"],
        f"{prefix}outs": a["outs"],
        f"{prefix}average": a["runs"] / at_least(a["outs"]),
        f"{prefix}strike_rate": 100 * per_ball("runs"),
        f"{prefix}boundary_rate": per_ball("boundaries"),
        f"{prefix}six_rate": per_ball("sixes"),
        f"{prefix}dot_rate": per_ball("dots"),
        f"{prefix}economy": 6 * (a["conceded"] + economy_prior) / (a["legal"] + SHRINK_BALLS),
    }


def plain_rates(batting: bool) -> dict[str, Column]:
    """Unshrunk rates of the feature-store tables."""
    c = F.col
    if batting:
        out = {
            "average": c("runs") / at_least(c("outs")),
            "strike_rate": 100 * c("runs") / at_least(c("balls")),
            "boundary_rate": c("boundaries") / at_least(c("balls")),
            "six_rate": c("sixes") / at_least(c("balls")),
        }
    else:
        out = {
            "economy": 6 * c("conceded") / at_least(c("legal")),
            "bowling_average": c("conceded") / at_least(c("outs")),
            "balls_per_wicket": c("legal") / at_least(c("outs")),
        }
    return {**out, "dot_rate": c("dots") / at_least(c("balls"))}


def context_rates(prefix: str, own: str = "") -> dict[str, Column]:
    """Venue and team rates; slot ``runs`` holds total runs, ``outs`` holds all wickets."""
    c = lambda m: F.col(f"{own}{m}")
    return {
        f"{prefix}run_rate": 6 * c("runs") / at_least(c("legal")),
        f"{prefix}balls": c("legal"),
        f"{prefix}boundary_rate": c("boundaries") / at_least(c("balls")),
        f"{prefix}wicket_rate": c("outs") / at_least(c("balls")),
    }


def era_rates(season: str = "season_", league: str = "league_") -> dict[str, Column]:
    """Current-season league rates once 600 balls are seen, lifetime rates before."""
    s = lambda m: F.col(f"{season}{m}")
    g = lambda m: F.col(f"{league}{m}")
    tiny = lambda m: F.greatest(g(m).cast("double"), F.lit(1e-9))
    return {
        "era_strike_rate": F.when(s("balls") >= ERA_MIN_BALLS, 100 * s("runs") / s("balls"))
        .otherwise(100 * g("runs") / tiny("balls")),
        "era_boundary_rate": F.when(s("balls") >= ERA_MIN_BALLS, s("boundaries") / s("balls"))
        .otherwise(g("boundaries") / tiny("balls")),
        "era_economy": F.when(s("legal") >= ERA_MIN_BALLS, 6 * s("conceded") / s("legal"))
        .otherwise(6 * g("conceded") / tiny("legal")),
        "era_balls_observed": s("balls"),
    }
