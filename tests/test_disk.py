"""Written stages leave nothing behind that nobody reads: no shuffle files, and the vectors in one form only."""
import time
from pathlib import Path

from innings_engine import session as se
from innings_engine.operators import normalize as n
from innings_engine.plans import models as md, over_table as ot, prepare as pp, staging
from innings_engine.sources.documents import documents_from_log


def _shuffles(spark):
    """Names of shuffle files that hold more than a few counts."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in folders for p in Path(d.getPath()).rglob("shuffle_*.data") if p.stat().st_size > 1000}


def test_a_written_table_leaves_no_shuffle(spark):
    before, setting = _shuffles(spark), spark.conf.get(se.FREE_SHUFFLES)
    rows = lambda: spark.range(1000).repartition(3, "id")
    kept = se.written(rows(), "plain")
    many = se.all_written({f"t{i}": rows() for i in range(3)})
    once = staging.staged_once(spark, ("disk", "/root/testdata/sf0.001"), rows)
    assert {df.count() for df in (kept, *many.values(), once)} == {1000}
    for _ in range(50):                             # files are deleted in the background
        if not _shuffles(spark) - before:
            break
        time.sleep(.2)
    assert not _shuffles(spark) - before and spark.conf.get(se.FREE_SHUFFLES) == setting


def test_vectors_are_written_once_and_balls_pass_one_after_the_other(spark, sf, log, monkeypatch):
    names = []
    keep = lambda tables: names.append(sorted(tables)) or tables
    ot.over_samples(log, md.MODEL, keep)
    assert [n for n in names if set(n) & {"overs", "over_innings", "over_positions"}] == [["overs"], ["over_innings"], ["over_positions"]]
    names.clear()
    ot.over_samples(log, (), keep)
    assert ["overs"] not in names
    md.vector_table(spark, sf)
    stages = [key[1] for key in staging._WRITTEN]
    assert "model_vectors" in stages and "model_rows" not in stages


def test_texts_are_neither_shuffled_by_level_nor_written_again(spark, log, monkeypatch):
    plan = documents_from_log(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == 1, plan
    tables = {}
    write = pp.written
    monkeypatch.setattr(pp, "written", lambda df, name, *a, **kw: tables.setdefault(name, write(df, name, *a, **kw)))
    one, other = documents_from_log(log).select("text").limit(2).collect()
    rows = [("b", one.text), ("a", one.text), ("c", other.text), ("c", "torn"), (None, "x"), (None, one.text)]
    done = pp.prepare(spark.createDataFrame(rows, "match_id string, text string"))
    assert not [name for name, df in tables.items() if "text" in df.columns]
    marked = n.fingerprinted(spark.createDataFrame(rows, "match_id string, text string"))
    kept, dropped = n.drop_duplicates_first(marked, "fingerprint", "match_id")
    assert sorted(r.match_id for r in tables["judged"].collect()) == sorted(r.match_id for r in kept.collect()) == ["a", "c", "c"]
    key = lambda r: (r.match_id or "", r.fingerprint)
    assert sorted(map(key, done.duplicates.collect())) == sorted(map(key, dropped.collect()))
