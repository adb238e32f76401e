"""Delivery log derived from the bundled ``lineitem`` table by integer arithmetic."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.cricket import flag
from ..operators.ordered import SLICE, sliced_prefix_sums

# Total order inside a month; (l_orderkey, l_linenumber) alone repeats.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
OVER_KEY = ["match_id", "innings", "over_number"]
BALL_ORDER = ["over_number", "ball_number"]
ORDERS_PER_SLICE = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def delivery_log(spark: SparkSession, sf_dir: str, orders_per_slice: int = ORDERS_PER_SLICE) -> DataFrame:
    """One row per ball, hash-partitioned by match.

    The only unbounded group is the month, whose running ball count is built from slices of
    ``orders_per_slice`` order keys. Every later window is per over, innings or match.
    """
    c = F.col
    raw = read_table(spark, sf_dir, "lineitem").select(*ORDER)
    coded = raw.select(
        "*",
        F.trunc(c("l_shipdate"), "MM").alias("date"),
        ((c("l_orderkey") * 31 + c("l_partkey") * 7 + c("l_suppkey") * 3 + c("l_linenumber")) % 100)
        .cast("int").alias("h"),
        (c("l_quantity").cast("int") % 8).alias("q"),
        F.floor(c("l_orderkey") / orders_per_slice).alias(SLICE),
    ).withColumn("legal", flag(c("h") > 3))
    counted = sliced_prefix_sums(coded, ["date"], ORDER, {"legal": "clb"})

    match_no = F.floor(c("clb") / 240)
    placed = counted.select(
        "*",
        match_no.alias("mno"),
        F.concat(c("date").cast("string"), F.lit("-"), match_no.cast("string")).alias("match_id"),
        (F.floor((c("clb") % 240) / 120) + 1).cast("int").alias("innings"),
        (F.floor((c("clb") % 120) / 6) + 1).cast("int").alias("over_number"),
        (F.year("date") * 12 + F.month("date")).alias("mi"),
    ).repartition("match_id")

    in_over = W.partitionBy(*OVER_KEY).orderBy(*ORDER)
    balls = placed.select(
        "*",
        F.row_number().over(in_over).cast("int").alias("ball_number"),
        F.first("l_suppkey").over(in_over).alias("first_supp"),
    )
    h, q = c("h"), c("q")
    wides, noballs = flag(h < 3), flag(h == 3)
    byes, legbyes = flag(h == 6), flag(h.isin(4, 5))
    wicket, bowler_wicket = flag(h.between(10, 14)), flag(h.between(10, 13))
    batter = _name("B", c("l_partkey") % 40)
    non_striker = _name("B", (c("l_partkey") % 40 + 1 + c("l_linenumber")) % 40)
    no_bat = (h < 3) | h.isin(4, 5, 6) | h.between(10, 14) | q.isin(5, 7)
    runs = F.when(no_bat, 0).otherwise(q)
    extras = flag(h <= 6)                    # every irregular ball carries exactly one extra
    home = _name("T", (c("mi") + c("mno")) % 8)
    away = _name("T", (c("mi") + c("mno") + 1 + c("mno") % 7) % 8)
    first = c("innings") == 1
    return balls.select(
        "match_id", "date", F.year("date").cast("int").alias("season"), "innings", "over_number",
        "ball_number",
        _name("V", (c("mi") + c("mno") * 5) % 12).alias("venue"),
        F.when(first, home).otherwise(away).alias("team_batting"),
        F.when(first, away).otherwise(home).alias("team_bowling"),
        batter.alias("batter"), non_striker.alias("non_striker"),
        _name("P", c("first_supp") % 30).alias("bowler"),
        wides.alias("wides"), noballs.alias("noballs"), legbyes.alias("legbyes"), byes.alias("byes"),
        wicket.alias("wicket"), bowler_wicket.alias("bowler_wicket"),
        F.when(bowler_wicket == 1, batter).when(h == 14, non_striker).otherwise("").alias("dismissed_player"),
        F.when(h == 10, "bowled").when(h == 11, "caught").when(h == 12, "lbw").when(h == 13, "stumped")
        .when(h == 14, "run out").otherwise("").alias("dismissal_type"),
        runs.alias("runs_batter"), "legal", (1 - wides).alias("batter_ball"),
        extras.alias("runs_extras"), (runs + extras).alias("runs_total"),
        (runs + wides + noballs).alias("bowler_conceded"),
        flag(runs.isin(4, 6)).alias("boundary"), flag(runs == 6).alias("six"),
    )
