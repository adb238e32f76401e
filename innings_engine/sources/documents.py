"""Nested match documents: schema, file scan and the documents built from the delivery log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shuffles_freed

DELIVERY = ("struct<batter:string,non_striker:string,bowler:string,"
            "runs:struct<batter:int,extras:int,total:int,non_boundary:boolean>,"
            "extras:map<string,int>,wickets:array<struct<player_out:string,kind:string>>>")
INNINGS = ("struct<team:string,super_over:boolean,target:struct<runs:int,overs:int>,"
           "penalty_runs:int,miscounted_overs:string,"
           f"overs:array<struct<over:int,deliveries:array<{DELIVERY}>>>>")
INFO = ("struct<dates:array<string>,match_type:string,venue:string,city:string,teams:array<string>,"
        "overs:int,balls_per_over:int,outcome:struct<method:string,result:string>,"
        "missing:array<string>,registry:struct<people:map<string,string>>>")
DOCUMENT = f"struct<info:{INFO},innings:array<{INNINGS}>>"


def parse_documents(texts: DataFrame, text: str = "text") -> DataFrame:
    """``match_id`` and the parsed document; null for text that is not JSON as a whole, of which nothing is kept.

    The document comes out of a generator of one row: a later filter is not pushed below it, which would parse the text
    once more for every field that the filter reads.
    """
    whole = F.try_parse_json(text).isNotNull()
    return texts.select("match_id", F.explode(F.array(F.when(whole, F.from_json(text, DOCUMENT)))).alias("doc"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, text) of one JSON document per file; the match id is the file stem."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("match_id"), F.col("value").alias("text"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents of one file each."""
    return parse_documents(read_texts(spark, path))


def write_files(texts: DataFrame, path: str) -> None:
    """One file per document, in a folder named by its match id; a match id that repeats has a file for each of its texts."""
    # Dealt by id: a document's folder is written by one task, and no task holds more than one open file.
    texts.select("match_id", "text").repartition("match_id").write.partitionBy("match_id").option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, text) of the documents that ``write_files`` wrote.

    Spark packs small files into scan tasks by ``spark.sql.files.openCostInBytes``; readers that come back often should read
    what ``pack`` wrote instead.
    """
    raw = spark.read.schema("value string, match_id string").text(path, wholetext=True)
    return raw.select("match_id", F.regexp_replace("value", r"\n\z", "").alias("text"))


def write_lines(texts: DataFrame, path: str, per_file: int = 4096) -> None:
    """Bulk form of ``write_files``: one JSON object (match_id, text) a line, at most ``per_file`` documents in a compressed file.

    A file per document costs a folder, a rename and a listing on the driver for each.
    """
    with shuffles_freed(texts.sparkSession):
        texts.select("match_id", "text").write.option("maxRecordsPerFile", per_file).option("compression", "gzip").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, text) of the documents that ``write_lines`` wrote, exactly as they were, nulls and repeated ids included."""
    return spark.read.schema("match_id string, text string").json(path)


def unreadable_reason(text: str = "text") -> Column:
    """Why a text can't be read as a document; null if it can."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return F.when(blank, "empty").when(F.try_parse_json(text).isNull(), "not_json")


def pack(texts: DataFrame, path: str, unreadable_path: str) -> DataFrame:
    """Many small files as few parquet files of (match_id, text), and the written table.

    Texts that can't be read go to ``unreadable_path`` as (match_id, reason, bytes, sha256) and aren't packed; together the two have
    every document.
    """
    spark = texts.sparkSession
    judged = texts.select("match_id", "text", unreadable_reason().alias("reason"))
    judged.where("reason is null").select("match_id", "text").hint("rebalance").write.parquet(path)
    judged.where("reason is not null").select(
        "match_id", "reason", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256")
    ).write.parquet(unreadable_path)
    return spark.read.schema("match_id string, text string").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File name, byte size and sha256 of every raw file.

    The content is hashed inside the scan task and never leaves it.
    """
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("length").alias("bytes"),
                      F.sha2("content", 256).alias("sha256"))


def month_code(match_id: Column) -> Column:
    """(month index + 5 * match number) % 18: picks which irregularity a built document carries."""
    parts = F.split(match_id, "-")
    number = lambda i: parts.getItem(i).cast("int")
    return (number(0) * 12 + number(1) + number(3) * 5) % 18


def _ordered(array: Column, field: str) -> Column:
    """Sort structs that hold maps (which have no order of their own) by one integer field."""
    return F.array_sort(array, lambda a, b: a[field] - b[field])


def documents_from_log(log: DataFrame) -> DataFrame:
    """Rebuild nested documents (as JSON text) from the log, irregular ones included.

    Every group is one over, one innings or one match, so the collected lists are bounded. Balls are dealt by match once, as narrow rows:
    every level is grouped where they are, and no nested list is shuffled.
    """
    c = F.col
    log = log.repartition("match_id")
    person = lambda name: F.concat(F.lit("Player "), name)
    extras = F.map_filter(
        F.create_map(*[x for e in ("wides", "noballs", "byes", "legbyes") for x in (F.lit(e), c(e))]),
        lambda _, v: v > 0)
    dismissed = F.when(c("wicket") > 0, F.array(F.struct(
        person(c("dismissed_player")).alias("player_out"), c("dismissal_type").alias("kind"))))
    retired = F.when((c("legbyes") > 0) & (c("ball_number") == 1), F.array(F.struct(
        person(c("non_striker")).alias("player_out"), F.lit("retired hurt").alias("kind"))))
    none = F.array().cast("array<struct<player_out:string,kind:string>>")
    ball = F.struct(
        person(c("batter")).alias("batter"), person(c("non_striker")).alias("non_striker"),
        person(c("bowler")).alias("bowler"),
        F.struct(c("runs_batter").alias("batter"), c("runs_extras").alias("extras"), c("runs_total").alias("total"),
                 ((c("runs_batter") == 4) & (c("ball_number") == 2)).alias("non_boundary")).alias("runs"),
        extras.alias("extras"),
        F.concat(F.coalesce(dismissed, none), F.coalesce(retired, none)).alias("wickets"))
    keys = ["match_id", "date", "venue", "innings", "team_batting", "team_bowling"]
    overs = log.groupBy(*keys, "over_number").agg(
        F.sum("runs_total").alias("runs"),
        F.transform(_ordered(F.collect_list(F.struct("ball_number", ball.alias("ball"))), "ball_number"),
                    lambda b: b["ball"]).alias("deliveries"),
        F.collect_set("batter").alias("b1"), F.collect_set("non_striker").alias("b2"),
        F.collect_set("bowler").alias("b3"))
    code = month_code(c("match_id"))
    skips = (code == 8) & (c("innings") == 1) & (c("over_number") >= 3)
    innings = overs.groupBy(*keys).agg(
        F.sum("runs").alias("runs"),
        F.transform(_ordered(F.collect_list(F.struct("over_number", F.struct(
            (c("over_number") - 1 + F.when(skips, 1).otherwise(0)).alias("over"), c("deliveries")).alias("o"))),
            "over_number"), lambda x: x["o"]).alias("overs"),
        F.array_distinct(F.flatten(F.collect_list(F.concat("b1", "b2", "b3")))).alias("names"))
    body = F.struct(c("innings"), c("runs"), c("team_batting"), c("team_bowling"), c("overs"), c("names"))
    matches = innings.groupBy("match_id", "date", "venue").agg(_ordered(F.collect_list(body), "innings").alias("parts"))
    first_runs = F.coalesce(F.element_at(F.filter("parts", lambda p: p["innings"] == 1), 1)["runs"], F.lit(0))

    def side(p: Column) -> Column:
        chase = p["innings"] == 2
        goal = F.struct((first_runs + 1 + F.when(code == 7, 5).otherwise(0)).cast("int").alias("runs"),
                        F.lit(20).alias("overs"))
        return F.struct(
            p["team_batting"].alias("team"), F.lit(False).alias("super_over"),
            F.when(chase, goal).alias("target"),
            F.when((code == 6) & (p["innings"] == 1), 5).alias("penalty_runs"),
            F.lit(None).cast("string").alias("miscounted_overs"), p["overs"].alias("overs"))

    def extra_side(p: Column) -> Column:
        return F.struct(
            p["team_batting"].alias("team"), F.lit(True).alias("super_over"),
            F.lit(None).cast("struct<runs:int,overs:int>").alias("target"),
            F.lit(None).cast("int").alias("penalty_runs"), F.lit(None).cast("string").alias("miscounted_overs"),
            F.slice(p["overs"], 1, 1).alias("overs"))

    played = F.transform("parts", side)
    with_super = F.when(F.size("parts") == 2,
                        F.concat(played, F.transform(F.slice("parts", 1, 1), extra_side))).otherwise(played)
    names = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["names"])))
    known = F.filter(names, lambda n: ~((code == 0) & (n == "P7")))
    people = F.map_from_arrays(F.transform(known, person), known)
    info = F.struct(
        F.array(c("date").cast("string")).alias("dates"),
        F.when(code == 1, "ODI").otherwise("T20").alias("match_type"),
        F.concat(F.regexp_replace("venue", "V", "V."), F.lit("  , Town")).alias("venue"),
        F.when(code != 3, F.lit("Town")).alias("city"),
        F.array(F.element_at("parts", 1)["team_batting"], F.element_at("parts", 1)["team_bowling"]).alias("teams"),
        F.when(code.isin(2, 5), 10).otherwise(20).alias("overs"), F.lit(6).alias("balls_per_over"),
        F.struct(F.when(code == 2, F.lit("D/L")).alias("method"),
                 F.when(code.isin(1, 3), F.lit("no result")).alias("result")).alias("outcome"),
        F.when(code == 4, F.array(F.lit("powerplays"))).alias("missing"),
        F.struct(people.alias("people")).alias("registry"))
    doc = F.struct(info.alias("info"), with_super.alias("innings"))
    return matches.select("match_id", F.to_json(doc).alias("text"))
