"""Operator semantics on small hand-built rows, leak checks and brute-force comparisons."""
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from innings_engine.functions import cricket as k
from innings_engine.functions.rules import all_failures, divide, first_failure, strict
from innings_engine.operators import (asof, blend, delivery as dl, encode, history as h, logs, metrics as m, normalize as n,
                                      ordered as o, split as s, store as st, validate as v, windows as w)
from innings_engine.plans import models as md, over_table as ot
from innings_engine.sources import documents as docs, files


def one(df):
    return df.collect()[0]


# --- scalar rules -----------------------------------------------------------------------

@pytest.mark.parametrize("runs,bucket", [(0, 0), (4, 0), (5, 1), (7, 1), (8, 2), (10, 2), (11, 3), (14, 3), (15, 4), (19, 4), (20, 5), (36, 5)])
def test_bucket_edges(spark, runs, bucket):
    assert one(spark.range(1).select(k.run_bucket(F.lit(runs)).alias("b")))["b"] == bucket


def test_phase_classes_and_text(spark):
    df = spark.createDataFrame([(1, "Main Ground, City"), (6, "M.Some Ground"), (7, "M Some  Ground"), (15, "x"), (16, "y")], "o int, t string")
    rows = df.select(k.phase(F.col("o")).alias("p"), k.canonical_text(F.col("t")).alias("t")).collect()
    assert [r["p"] for r in rows] == ["powerplay", "powerplay", "middle", "middle", "death"]
    assert rows[0]["t"] == "Main Ground" and rows[1]["t"] == rows[2]["t"] == "M Some Ground"
    got = one(spark.range(1).select(k.run_class(F.lit(5)).alias("r"), k.extra_class(F.lit(7)).alias("x"), k.legality_class(F.lit(1), F.lit(1)).alias("l")))
    assert tuple(got) == (6, 4, 1)


def test_rules(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "a int, b int")
    rules = {"a_big": F.col("a") > 1, "differs": F.col("a") != F.col("b")}
    rows = df.select(first_failure(rules).alias("f"), all_failures(rules).alias("all")).collect()
    assert [r["f"] for r in rows] == [None, "a_big", "a_big"]
    assert [r["all"] for r in rows] == [[], ["a_big", "differs"], ["a_big"]]
    good, bad = divide(df, rules)
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(Exception, match="a_big"):
        strict(df, rules).collect()


# --- ordered operators against brute force -------------------------------------------------

def test_sliced_prefix_equals_window(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < .6 else f"g{rng.randrange(4)}", i, rng.randrange(10)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i int, v int").withColumn(o.SLICE, F.floor(F.col("i") / 37))
    got = {(r["g"], r["i"]): (r["b"], r["v_total"]) for r in o.sliced_prefix_sums(df, ["g"], ["i"], {"v": "b"}, totals_too=True).collect()}
    for g in {r[0] for r in rows}:
        mine = [(i, x) for gg, i, x in rows if gg == g]
        total = 0
        for i, x in mine:
            assert got[(g, i)][0] == total and got[(g, i)][1] == sum(y for _, y in mine)
            total += x


def test_null_group_and_one_shuffle(spark):
    df = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").alias("g"), F.col("id").alias("i"), F.lit(1).alias("v"))
    sliced = df.withColumn(o.SLICE, F.floor(F.col("i") / 7))
    rows = o.sliced_prefix_sums(sliced, ["g"], ["i"], {"v": "b"}).collect()
    assert len(rows) == 40 and all(r["b"] == r["i"] // 2 for r in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = o.sliced_prefix_sums(sliced, ["g"], ["i"], {"v": "b"})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the rows themselves, the slice totals, the totals per group and back: no second shuffle of the rows
    assert plan.count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("slices", [2, 5, 64])
def test_quantiles_and_curves(spark, slices):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    q = one(o.exact_quantiles(df, [], "p", {"a": .1, "b": .5, "c": .975}, slices))
    assert np.allclose([q["a"], q["b"], q["c"]], np.quantile(p, [.1, .5, .975]))
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + .5 * (a == b) for a in pos for b in neg])
    assert math.isclose(one(m.roc_auc(df, [], slices=slices))["roc_auc"], auc, rel_tol=1e-12)
    steps, prev = 0.0, 0.0
    best = (-1, None)
    for t in sorted(set(p), reverse=True):
        hit, flagged = y[p >= t].sum(), (p >= t).sum()
        steps += (hit / y.sum() - prev) * hit / flagged
        prev = hit / y.sum()
        f1 = 2 * hit / (flagged + y.sum())
        if f1 >= best[0]:
            best = (f1, t)
    assert math.isclose(one(m.pr_auc(df, [], slices=slices))["pr_auc"], steps, rel_tol=1e-9)
    got = one(m.best_f1_threshold(df, [], slices=slices))
    assert math.isclose(got["f1"], best[0]) and got["threshold"] == best[1]


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, .2), (1, .4)], "y int, p double")
    assert one(m.roc_auc(df, []))["roc_auc"] is None
    none = spark.createDataFrame([(0, .2), (0, .4)], "y int, p double")
    assert one(m.pr_auc(none, []))["pr_auc"] is None


def test_conformal_ranks(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "match_id int, y double, p double")
    assert one(m.conformal_radius(df, [], .2))["radius"] == 8
    assert one(m.conformal_block_radius(df, [], "match_id", .2))["radius"] == 8
    blocks = spark.createDataFrame([(b, 2.0 if i < 9 else 20.0, 0.0) for b in range(10) for i in range(10)], "match_id int, y double, p double")
    assert one(m.conformal_radius(blocks, [], .2))["radius"] == 2
    assert one(m.conformal_block_radius(blocks, [], "match_id", .2))["radius"] == 20
    with pytest.raises(Exception, match="too few"):
        m.conformal_radius(df.limit(3), [], .2).collect()


def test_coverage_on_normal_errors(spark):
    rng = np.random.default_rng(1)
    cal = spark.createDataFrame(pd.DataFrame({"y": rng.normal(size=2000), "p": 0.0}))
    r = one(m.conformal_radius(cal, [], .2))["radius"]
    assert abs(np.mean(np.abs(rng.normal(size=20000)) <= r) - .8) < .03


def test_calibration_bins(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.30000000000000004), (1, .05)], "y int, p double")
    bins = df.select(m.equal_bin(F.col("p")).alias("b")).collect()
    assert [r["b"] for r in bins] == [9, 3, 0]
    assert one(m.reliability_table(df, []).agg(F.sum("n").alias("n")))["n"] == 3      # 1.0 is clipped into the last bin


def test_classification_labels_present_only(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (2, 0)], "y bigint, pred bigint").withColumn("g", F.lit("x"))
    counts = m.confusion_counts(df, ["g"])
    got = one(m.classification_metrics(counts, ["g"], F.lit(False)))
    f = [2 * 1 / (2 + 2), 0.0, 2 * 1 / (2 + 1)]
    assert math.isclose(got["f1"], sum(f) / 3) and got["accuracy"] == .5
    cells = m.confusion_matrix(df, ["g"], F.lit(3)).collect()
    assert len(cells) == 9 and sum(r["n"] for r in cells) == 4


def test_bootstrap_matches_standard_error(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(.1, 1, 3000)
    df = spark.createDataFrame(pd.DataFrame({"d": x}))
    got = one(m.bootstrap_ci(df, F.col("d"), draws=1000))
    se = x.std(ddof=1) / math.sqrt(len(x))
    assert abs(got["bootstrap_se"] / se - 1) < .12
    assert abs(got["low"] - (x.mean() - 1.96 * se)) < .5 * se and got["draws"] == 1000


# --- history: leaks, same date, form ------------------------------------------------------------

def ball(match, date, batter="A", bowler="X", runs=1, over=1, ball_no=1, innings=1, **more):
    row = dict(match_id=match, date=pd.Timestamp(date).date(), season=int(date[:4]), innings=innings, over_number=over, ball_number=ball_no,
               venue="V1", team_batting="T1", team_bowling="T2", batter=batter, non_striker="N", bowler=bowler, wides=0, noballs=0,
               legbyes=0, byes=0, wicket=0, bowler_wicket=0, dismissed_player="", dismissal_type="", runs_batter=runs, legal=1,
               batter_ball=1, runs_extras=0, runs_total=runs, bowler_conceded=runs, boundary=int(runs in (4, 6)), six=int(runs == 6))
    row.update(more)
    return row


def frame(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows))


def test_same_date_is_invisible(spark):
    log = frame(spark, [ball("a", "2020-01-01", runs=4), ball("b", "2020-01-01", runs=6), ball("c", "2020-01-02", runs=1)])
    totals = {str(r["date"]): r["career_runs"] for r in h.player_totals(log, "bat").filter("player = 'A'").collect()}
    assert totals == {"2020-01-01": 0, "2020-01-02": 10}


def test_future_changes_nothing_earlier(spark):
    base = [ball(f"m{d}", f"2020-01-{d:02d}", runs=d % 5) for d in range(1, 12)]
    bent = [dict(r, runs_batter=6, runs_total=6) if r["match_id"] == "m9" else r for r in base]
    read = lambda rows: {(r["player"], str(r["date"])): r["career_runs"] for r in h.player_totals(frame(spark, rows), "bat").collect()}
    a, b = read(base), read(bent)
    assert all(a[key] == b[key] for key in a if key[1] <= "2020-01-09")
    assert a[("A", "2020-01-10")] != b[("A", "2020-01-10")]


def test_unseen_probe_gets_history(spark):
    log = frame(spark, [ball("a", "2020-01-01", runs=4)])
    probes = spark.createDataFrame([("A", pd.Timestamp("2020-03-01").date())], "player string, date date")
    got = h.player_totals(log, "bat", probes).filter("date = '2020-03-01'").collect()
    assert [(r["player"], r["career_runs"], r["season_runs"]) for r in got] == [("A", 4, 4)]


def test_outs_follow_the_dismissed_player(spark):
    log = frame(spark, [ball("a", "2020-01-01", wicket=1, bowler_wicket=0, dismissed_player="N"),
                        ball("a", "2020-01-01", ball_no=2, wicket=2, bowler_wicket=1, dismissed_player="A|N")])
    outs = {r["batter"]: r["outs"] for r in h.kind_totals(log, "bat").collect()}
    assert outs == {"A": 1, "N": 2}
    assert one(h.kind_totals(log, "bowl"))["outs"] == 1 and one(h.kind_totals(log, "bat_phase"))["outs"] == 0
    assert one(h.kind_totals(log, "team"))["outs"] == 3


def test_form_is_the_last_25_even_for_a_hot_day(spark):
    rng = random.Random(4)
    rows = [ball(f"m{i:03d}", "2020-01-01", runs=rng.randrange(7)) for i in range(60)]
    rows += [ball(f"n{i:03d}", "2020-02-01", runs=rng.randrange(7)) for i in range(10)]
    rows.append(ball("z", "2020-03-01"))
    probes = spark.createDataFrame([("A", pd.Timestamp("2020-03-01").date()), ("A", pd.Timestamp("2020-02-01").date()),
                                    ("A", pd.Timestamp("2020-01-01").date())], "player string, date date")
    got = {str(r["date"]): [e["match_id"] for e in r["form"]] for r in h.form_asof(frame(spark, rows), probes, "bat").collect()}
    assert got["2020-03-01"] == [f"m{i:03d}" for i in range(45, 60)] + [f"n{i:03d}" for i in range(10)]
    assert got["2020-02-01"] == [f"m{i:03d}" for i in range(35, 60)] and got["2020-01-01"] == []


def test_context_and_league_bootstrap(spark):
    log = frame(spark, [ball("a", "2020-01-01", runs=4), ball("b", "2020-01-02", runs=2)])
    league = {str(r["date"]): (r["league_balls"], r["history_through"]) for r in h.league_asof(log).collect()}
    assert league["2020-01-01"] == (0, None) and league["2020-01-02"][0] == 1
    assert h.bootstrap_ready(h.league_asof(log)).count() == 0


# --- splits -------------------------------------------------------------------------------------

def season_frame(spark, seasons):
    rows = [(y, pd.Timestamp(f"{y}-01-01").date() + pd.Timedelta(days=d).to_pytimedelta(), f"{y}-{d}") for y in seasons for d in range(28)]
    return spark.createDataFrame(rows, "season int, date date, match_id string")


def test_chrono_split(spark):
    df = s.with_partition(season_frame(spark, range(2014, 2021)))
    counts = {r["partition"]: r["overs"] for r in s.partition_summary(df).collect()}
    assert counts == {"train": 112, "validation": 28, "refit_extra": 14, "probability_calibration": 7, "interval_calibration": 7, "test": 28}
    assert s.partition_overlap(df).count() == 0
    with pytest.raises(Exception, match="five seasons"):
        s.with_partition(season_frame(spark, range(2017, 2021))).collect()


def test_walk_forward_arms(spark):
    labels = s.walk_forward_labels(season_frame(spark, range(2014, 2021)))
    got = {(r["strategy"], r["test_season"]) for r in labels.select("strategy", "test_season").distinct().collect()}
    assert got == {(a, y) for a in s.STRATEGIES for y in (2018, 2019, 2020)}


# --- windows, slots, sequences ------------------------------------------------------------------------

def test_prefix_excludes_target_over(spark, log):
    rows = [ball("a", "2020-01-01", over=v, ball_no=b, runs=v) for v in range(1, 4) for b in range(1, 7)]
    before = {r["over_number"]: r["current_score"] for r in w.over_starts(w.running_state(frame(spark, rows))).collect()}
    assert before == {1: 0, 2: 6, 3: 18}
    seq = {r["over_number"]: r["sequence"] for r in w.sequence_windows(frame(spark, rows)).collect()}
    assert all(len(x) == 24 for x in seq.values())
    assert seq[1] == [[0.0] * 12] * 24
    assert [x[0] for x in seq[3]][-12:] == [1.0] * 6 + [2.0] * 6 and sum(x[0] for x in seq[3][:12]) == 0
    bent = [dict(r, runs_total=6, runs_batter=6) if r["over_number"] == 3 else r for r in rows]
    again = {r["over_number"]: r["sequence"] for r in w.sequence_windows(frame(spark, bent)).collect()}
    assert again[3] == seq[3]


def test_tracked_slots(spark):
    seen = ["A", "N", "C", "A", "C", "N"]           # N is replaced by C at N's end, A returns, N returns
    rows = [ball("a", "2020-01-01", batter=b, ball_no=i + 1, runs=1) for i, b in enumerate(seen)]
    got = [r["striker_slot"] for r in dl.tracked_slots(frame(spark, rows)).orderBy("ball_number").collect()]
    assert got == ["batter", "non_striker", "replacement", "batter", "replacement", "replacement"]
    rule = [r["striker_slot"] for r in dl.rule_slots(frame(spark, rows)).orderBy("ball_number").collect()]
    assert rule == ["batter", "non_striker", "replacement", "batter", "replacement", "non_striker"]


def test_slots_agree_without_a_third_batter(spark, log):
    third = log.groupBy("match_id", "innings", "over_number").agg(F.size(F.array_union(F.collect_set("batter"), F.array(F.lit("?")))).alias("k"))
    tracked = dl.tracked_slots(log).select("match_id", "innings", "over_number", "ball_number", F.col("striker_slot").alias("t"))
    rule = dl.rule_slots(log)
    only_pair = rule.groupBy("match_id", "innings", "over_number").agg(F.max((F.col("striker_slot") == "replacement").cast("int")).alias("r")).filter("r = 0")
    joined = rule.join(tracked, ["match_id", "innings", "over_number", "ball_number"]).join(only_pair, ["match_id", "innings", "over_number"])
    assert joined.filter(F.col("striker_slot") != F.col("t")).count() == 0
    assert tracked.count() == log.count() and third.count() > 0


# --- documents, files, store -----------------------------------------------------------------------------

def test_documents_round_trip(spark, log, tmp_path):
    texts = docs.documents_from_log(log)
    some = texts.orderBy("match_id").limit(3).collect()
    for r in some:
        (tmp_path / f"{r['match_id']}.json").write_text(r["text"])
    got = docs.read_matches(spark, str(tmp_path))
    assert sorted(r["match_id"] for r in got.collect()) == [r["match_id"] for r in some]
    listing = {r["file"]: r for r in docs.manifest(spark, str(tmp_path)).collect()}
    import hashlib
    name = f"{some[0]['match_id']}.json"
    assert listing[name]["sha256"] == hashlib.sha256(some[0]["text"].encode()).hexdigest()


def test_document_files_and_packing(spark, tmp_path):
    """Files keep ids and texts as they are; packing parts with what can't be read, and loses nothing."""
    rows = [("2020-01-01-0", '{"a": 1}'), ("2020-01-01", '{"a": "x\\ny"}'), ("p/q=1 é", "{}"), ("torn", '{"a": '), ("blank", " "), ("none", ""), ("twice", "[1]"), ("twice", "[2]")]
    texts = spark.createDataFrame(rows, "match_id string, text string")
    docs.write_files(texts, str(tmp_path / "files"))
    got = docs.read_files(spark, str(tmp_path / "files"))
    assert sorted((r.match_id, r.text) for r in got.collect()) == sorted(rows)
    packed = docs.pack(got, str(tmp_path / "pack"), str(tmp_path / "bad"))
    assert sorted((r.match_id, r.text) for r in packed.collect()) == sorted(r for r in rows if r[0] not in ("torn", "blank", "none"))
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted((r.match_id, r.reason, r.bytes) for r in bad) == [("blank", "empty", 1), ("none", "empty", 0), ("torn", "not_json", 6)]


def test_document_lines_round_trip_in_few_files(spark, tmp_path):
    """Many documents a file; ids and texts as they are, nulls, line breaks and repeated ids included."""
    rows = [("p/q=1 é", '{"a": "x\ny"}'), ("torn", '{"a": '), ("blank", " "), ("none", ""), ("null", None), (None, "[0]"), (None, None), ("twice", "[1]"), ("twice", "[2]")]
    rows += [(f"m{i}", f'{{"a": {i}}}') for i in range(200)]
    docs.write_lines(spark.createDataFrame(rows, "match_id string, text string").coalesce(2), str(tmp_path / "lines"), per_file=100)
    key = lambda r: (str(r[0]), str(r[1]))
    got = docs.read_lines(spark, str(tmp_path / "lines")).collect()
    assert sorted(((r.match_id, r.text) for r in got), key=key) == sorted(rows, key=key)
    assert 2 <= len(list((tmp_path / "lines").glob("part-*"))) <= 4


def test_a_filter_on_what_was_parsed_does_not_parse_again(spark, sf):
    """Predicates that read the document stay above its parsing."""
    from innings_engine.catalog import load
    queries = load()[0]
    for name in ("noncontiguous_groups", "exclusion_reasons", "normalize_nested"):
        assert queries[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1, name


def document(**info):
    base = {"dates": ["2020-01-01"], "match_type": "T20", "venue": "G", "teams": ["A", "B"], "registry": {"people": {"p": "1", "q": "2", "r": "3"}}}
    base.update(info)
    d = {"batter": "p", "non_striker": "q", "bowler": "r", "runs": {"batter": 0, "extras": 1, "total": 1}, "extras": {"wides": 1},
         "wickets": [{"player_out": "q", "kind": "run out"}, {"player_out": "p", "kind": "retired hurt"}]}
    return {"info": base, "innings": [{"team": "A", "overs": [{"over": 0, "deliveries": [d]}]}, {"team": "B", "super_over": True, "overs": []}]}


def test_exclusion_priority_and_flags(spark):
    cases = {"ok": document(), "odi": document(match_type="ODI", outcome={"method": "D/L"}), "rain": document(outcome={"method": "D/L", "result": "no result"}),
             "none": document(outcome={"result": "no result"}, overs=10), "miss": document(missing=["x"], overs=10), "short": document(overs=10)}
    texts = spark.createDataFrame([(a, json.dumps(b)) for a, b in cases.items()], "match_id string, text string")
    judged = n.judge(docs.parse_documents(texts))
    reasons = {r["match_id"]: r["reason"] for r in judged.collect()}
    assert reasons == {"ok": None, "odi": "unsupported_format", "rain": "revised_target_or_rain_method", "none": "no_result",
                       "miss": "missing_data", "short": "shortened_match"}
    row = one(n.flatten(judged.filter("reason IS NULL")))
    assert (row["legal"], row["batter_ball"], row["wicket"], row["bowler_wicket"]) == (0, 0, 1, 0)
    assert row["dismissed_player"] == "2" and row["dismissal_type"] == "run out|retired hurt" and row["city"] == "unknown"
    assert row["team_bowling"] == "B" and row["extra_type"] == "wides"


def test_duplicates_keep_the_first_name(spark):
    text, turned = json.dumps(document()), json.dumps(dict(reversed(document().items())))
    other = document()
    other["innings"][0]["overs"][0]["deliveries"][0]["fielders"] = ["z"]
    texts = spark.createDataFrame([("b", text), ("a", turned), ("c", json.dumps(document(venue="H"))), ("d", json.dumps(other))], "match_id string, text string")
    kept, dropped = n.drop_duplicates_first(n.fingerprinted(texts), "fingerprint", "match_id")
    assert sorted(r["match_id"] for r in kept.collect()) == ["a", "c", "d"] and [r["match_id"] for r in dropped.collect()] == ["b"]


def test_sinks(spark, log, tmp_path):
    files.write_log(log, str(tmp_path / "log"))
    back = files.read_log(spark, str(tmp_path / "log"), [1995])
    assert back.count() == log.filter("season = 1995").count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "1995" in plan
    (tmp_path / "alias.csv").write_text("alias,canonical,reason\nV1,V2,renamed\n")
    aliases = files.read_aliases(spark, str(tmp_path / "alias.csv"))
    assert files.apply_aliases(log.select("venue"), "venue", aliases).filter("venue = 'V1'").count() == 0
    files.write_csv(log.groupBy("venue").count(), str(tmp_path / "csv"))
    files.write_report(log.groupBy("venue").count(), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == log.select("venue").distinct().count()
    people = n.player_aliases(docs.parse_documents(docs.documents_from_log(log)))
    tables = st.build_store(log, people)
    assert len(tables) == 17
    few = {name: tables[name] for name in ("players", "venues", "player_form", "matches")}
    files.write_store(few, str(tmp_path / "store"))
    files.write_store(few, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/venues")).count() == log.select("venue").distinct().count()
    assert spark.read.parquet(str(tmp_path / "store/player_form")).groupBy("role", "player_id").count().agg(F.max("count")).collect()[0][0] <= 25


def test_fingerprint_ignores_order(spark, log):
    a = one(encode.table_fingerprint(log))
    b = one(encode.table_fingerprint(log.orderBy(F.rand(1))))
    c = one(encode.table_fingerprint(log.limit(log.count() - 1)))
    assert a == b and a != c
    assert encode.schema_hash(log) != encode.schema_hash(log.drop("venue"))


# --- over table, models, logs --------------------------------------------------------------------------

def test_full_over_table(spark, log):
    df = ot.over_samples(log)
    names = ot.feature_columns(df)
    assert len(df.columns) == len(set(df.columns)) and not any(x.startswith(("target_", "ball_minus_")) for x in names)
    assert len(names) == 236 and len([x for x in df.columns if x.startswith("ball_minus_")]) == 36
    assert len([x for x in df.columns if x.startswith("target_")]) == 13
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"`{x}`").isNull().cast("int")).alias(x) for x in names]).collect()[0].asDict()
    assert got.pop("n") > 500
    assert {x: v for x, v in got.items() if v} == {}
    assert df.filter(F.col("history_through") >= F.col("date")).count() == 0
    with pytest.raises(ValueError, match="missing"):
        ot.require_columns(df, ["nope"])


def test_blend_and_reconcile(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": y + 1, "b": y - 1, "c": rng.normal(size=300)}))
    weights, mae = blend.simplex_search(df, "y", ["a", "b", "c"])
    assert weights == {"a": .5, "b": .5, "c": 0.0} and mae < 1e-9
    errors = {r["index"]: r["mae"] for r in blend.grid_errors(df, "y", ["a", "b"], blend.blend_grid()).collect()}
    assert len(errors) == 21 and min(errors, key=errors.get) == 10
    parts = {c: F.lit(v) for c, v in zip(blend.COMPONENTS, (1.0, 2.0, -1.0, 1.0))}
    got = one(spark.range(1).select(*[c.alias(x) for x, c in blend.reconcile(F.lit(8.0), parts, F.lit(9.0)).items()]))
    assert (got["batter_runs"], got["non_striker_runs"], got["extras"], got["other_batters"], got["bowler_conceded"]) == (2, 4, 0, 2, 8)
    zero = {c: F.lit(0.0) for c in blend.COMPONENTS}
    got = one(spark.range(1).select(*[c.alias(x) for x, c in blend.reconcile(F.lit(8.0), zero, F.lit(9.0)).items()]))
    assert got["other_batters"] == 8 and got["batter_runs"] == 0


def test_permutation_finds_the_signal(spark):
    rng = np.random.default_rng(9)
    x, z = rng.normal(size=2000), rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"y": 3 * x, "x": x, "z": z, "id": range(len(x))}))
    found = [{r["feature"]: r["mae_increase"] for r in md.permutation_importance(d, ["x", "z"], "y", lambda p: 3 * p["x"].to_numpy(), ["id"]).collect()}
             for d in (df.repartition(2), df.repartition(7, "z"))]
    assert found[0]["x"] > 2 and found[0]["z"] == 0 and abs(found[0]["x"] - found[1]["x"]) < 1e-9


def test_monitoring_single_outcome(spark):
    rows = [("v1", 10.0, 8.0, 5, 12, 1, .4), ("v1", 2.0, 8.0, 5, 12, 0, .4), ("v2", 9.0, 8.0, 5, 12, 0, .2), ("v2", None, 8.0, 5, 12, 0, .2)]
    df = spark.createDataFrame(rows, "version string, y double, p double, lower int, upper int, wicket int, wicket_p double")
    got = {r["version"]: r for r in logs.monitoring(df).collect()}
    assert got["v2"]["mae"] == 1 and got["v2"]["rmse"] is None and got["v1"]["rmse"] is not None and got["v1"]["interval_coverage"] == .5


def test_live_request_matches_batch(spark, log):
    """The same column functions give the same features for a stored over and a live request."""
    state = w.running_state(log)
    batch = ot.opening_states(log).select("match_id", "innings", "over_number", "current_run_rate", "required_run_rate")
    live = v.live_states(state).select(
        "match_id", "innings", F.col("over").alias("over_number"),
        *[c.alias(x) for x, c in k.chase_columns(F.col("target"), F.col("score"), F.aggregate("previous_deliveries", F.lit(0), lambda a, d: a + d["legal"]), F.col("wickets")).items()
          if x in ("current_run_rate", "required_run_rate")])
    assert batch.exceptAll(live).count() == 0 and live.exceptAll(batch).count() == 0


def test_target_over_does_not_change_features(spark):
    rows = [ball("a", "2020-01-01", over=v, ball_no=b, runs=1) for v in (1, 2) for b in range(1, 7)]
    bent = [dict(r, runs_batter=6, runs_total=6, wicket=1) if r["over_number"] == 2 else r for r in rows]
    read = lambda r: [tuple(x) for x in ot.overs_in_one_pass(frame(spark, r), ["momentum", "lags"]).join(w.innings_so_far(frame(spark, r)), ot.OVER_KEY)
        .filter("over_number = 2").select("current_score", "current_wickets", "runs_last_1_overs", "runs_last_6_deliveries",
                                          "ball_minus_1_runs", "bowler_match_legal_balls", "batter_innings_runs").collect()]
    assert read(rows) == read(bent)


def test_no_static_single_task_over_rows(spark, log):
    """League-wide sums combine per date before any single-partition window."""
    plan = h.league_asof(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")


def test_strict_accounting(spark):
    doc = document()
    doc["innings"][0]["overs"][0]["deliveries"][0]["runs"]["total"] = 5
    texts = spark.createDataFrame([("a", json.dumps(doc))], "match_id string, text string")
    flat = n.flatten(docs.parse_documents(texts))
    with pytest.raises(Exception, match="inconsistent_total"):
        strict(flat, n.accounting_rules()).collect()
    unknown = document(registry={"people": {"p": "1", "r": "3"}})
    flat = n.flatten(docs.parse_documents(spark.createDataFrame([("a", json.dumps(unknown))], "match_id string, text string")))
    assert one(flat)["unknown_names"] == ["q"]


def test_partitions_must_be_whole_and_apart(spark):
    from innings_engine.operators import split as sp
    rows = [(f"m{i}", f"2020-01-{i + 1:02d}", p) for i, p in enumerate(sp.PARTITIONS)]
    table = lambda r: spark.createDataFrame(r, "match_id string, date string, partition string").withColumn("date", F.col("date").cast("date"))
    assert sp.require_partitions(table(rows)).count() == len(rows)
    for bad, said in ((rows[1:], "empty"), (rows + [("x", "2020-01-03", "train")], "share dates"), (rows + [("m1", "2020-01-01", "train")], "two")):
        with pytest.raises(ValueError, match=said):
            sp.require_partitions(table(bad))
    other = table([("z", "2020-01-02", None), ("y", "2021-01-01", None)]).drop("partition")
    assert [tuple(r) for r in sp.by_windows(other, sp.recorded_windows(table(rows))).select("match_id", "partition").collect()] == [("z", "validation")]


def test_late_rows_are_listed(spark):
    """Days arrive out of order: facts of closed days and late rows together are all rows of closed days."""
    from innings_engine.streaming import live
    rows = [("2024-01-05 10:00:00", 1, 0), ("2024-01-06 10:00:00", 2, 0), ("2024-01-03 10:00:00", 3, 1), ("2024-01-09 10:00:00", 4, 1),
            ("2024-01-08 10:00:00", 5, 2), ("2024-01-10 10:00:00", 6, 3), ("2024-01-09 11:00:00", 7, 3)]
    table = spark.createDataFrame(rows, "ts string, v int, part int").withColumn("ts", F.col("ts").cast("timestamp"))
    streams = live.deliveries(table, F.col("part"), 4, "late-test")
    facts, late = live.closed_day_facts(streams, table, "ts", [], "v", 1, "late-test")
    assert {str(r["date"]): r["total"] for r in facts.collect()} == {"2024-01-05": 1, "2024-01-06": 2, "2024-01-08": 5}
    assert [r["v"] for r in late.collect()] == [3]


def test_every_feature_has_the_family_of_its_group(log):
    found = ot.feature_families(log)
    assert set(found) == set(ot.feature_columns(ot.over_samples(log))) and len(found) == 236
    for name, family in {"runs_last_3_overs": "momentum", "batter_career_balls": "player", "bowler_ewma_10_economy": "ewma", "batter_matchup_balls": "matchup",
                         "head_to_head_run_rate": "venue_team", "bowler_economy_vs_era": "era", "pressure_bucket": "pressure", "batter_innings_seen": "player", "current_score": "base"}.items():
        assert found.get(name, family) == family


def test_torn_documents_are_malformed(spark):
    text = json.dumps(document())
    cuts = [text[:k] for k in range(1, len(text), 7)] + ["", "{}", "[1]"]
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(cuts)], "match_id string, text string")
    judged = n.judge(docs.parse_documents(texts))
    assert {r["reason"] for r in n.exclusions(judged).collect()} == {"malformed_document"} and judged.count() == len(cuts)
