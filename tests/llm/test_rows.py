"""Extra columns with clashing names, and repeated rows, through every operator on documents."""
from pyspark.sql import functions as F

from innings_engine.llm import decontaminate, repeats, simhash, toxicity

PASSAGE = " ".join(f"w{i}" for i in range(60))


def docs(make_docs):
    plain = make_docs([PASSAGE, f"x {PASSAGE} y", "own text", f"x {PASSAGE} y"], ids=[0, 1, 2, 1])
    for c in ("kept_text", "score", "gone", "root", "spans", "clean_text", "n_words", "symbol"):
        plain = plain.withColumn(c, F.lit("x"))
    return plain


def test_repeats(spark, make_docs):
    got = repeats.without_repeats(docs(make_docs))
    assert got.columns == docs(make_docs).columns
    assert sorted(r.text for r in got.collect()) == sorted([PASSAGE, "x y", "x y", "own text"])
    assert sorted((r.doc_id, r.n_removed) for r in repeats.removal_report(docs(make_docs)).collect()) == [(0, 0), (1, 60), (1, 60), (2, 0)]


def test_simhash(spark, make_docs):
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(make_docs)).collect()) == [(0, 0), (1, 1), (1, 1), (2, 2)]


def test_decontaminated(spark, make_docs):
    items = spark.createDataFrame([(5, PASSAGE[:60])], "item_id long, text string")
    got = decontaminate.decontaminated(docs(make_docs), items)
    assert got.columns == docs(make_docs).columns and [r.text for r in got.collect()] == ["own text"]


def test_toxicity(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs(make_docs), none).count() == 0  # no labels: every score is 0.5
    assert toxicity.scores(docs(make_docs), none).count() == 4
