"""The pipeline against its stages written out by brute force, on a small table with planted cases."""
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from innings_engine.llm import toxicity, units
from tests.llm.test_decontaminate import cut, slow_report
from tests.llm.test_repeats import slow_removal
from tests.llm.test_simhash import slow_components, slow_fingerprint


def planted():
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: [rng.choice(pool) for _ in range(n)]
    passage, items = prose(80), [(i, " ".join(prose(20))) for i in range(6)]
    texts, labels = [None, "", "one", "Two words"], []
    for i in range(4, 260):
        words = prose(rng.randint(20, 300))
        if i % 9 == 0:
            words[5:5] = passage
        if i % 13 == 0:
            words[3:3] = items[i % 6][1].split()
        if i % 26 == 0:
            words = items[i % 6][1].upper().split() + prose(2000)
        if i % 4 == 1:
            for w in rng.sample(["qvile", "qscum", "qworthless"], 2):
                words.insert(rng.randrange(len(words)), w)
        labels.append((i, int(i % 4 == 1)))
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [texts[k] for k in (6, 6, 7, 12)] + [texts[10] + " tail", texts[15].upper()]
    return texts, items, labels


def without_spans(text, items):
    """Text without maximal runs of hit words, from the first to the last byte of a run."""
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    places = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)]
    words, hit = [low[a:b] for a, b in places], set()
    _, windows = slow_report({}, items, 13)
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in windows:
                hit.update((j, j + 1 < i + n) for j in range(i, i + n))
    gone = {j for j, _ in hit}
    runs, at, out = [], 0, []
    for j in sorted(gone):
        if runs and runs[-1][1] == j - 1 and (j - 1, True) in hit or runs and runs[-1][1] == j - 1:
            runs[-1][1] = j
        else:
            runs.append([j, j])
    for a, b in runs:
        out.append(text[at:places[a][0]])
        at = places[b][1]
    return "".join(out) + text[at:], len(gone), len(words)


@pytest.fixture(scope="module")
def case(spark, make_docs, tmp_path_factory):
    texts, items, labels = planted()
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = make_docs(texts)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items, labels


def test_pipeline_equals_brute_force(spark, case):
    folder, texts, items, labels = case
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}

    toxic = {r.doc_id for r in toxicity.scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert {d for d, t in labels if t} <= toxic and not toxic & {d for d, t in labels if not t}
    left = {d: t for d, t in enumerate(texts) if d not in toxic}
    heads = slow_components({d: slow_fingerprint(t) for d, t in left.items()})
    left = {d: t for d, t in left.items() if heads[d] == d}
    removed = slow_removal(left, 50)
    left = {d: removed[d][2] if removed[d][1] else t for d, t in left.items()}
    cleaned, spans_cut = {}, 0
    for d, t in left.items():
        text, n_hit, n_words = without_spans(t or "", items)
        assert n_words == len(cut(t))
        if not (n_hit and 20 * n_hit >= n_words):
            cleaned[d] = text
            spans_cut += n_hit > 0
    tokenizer = units.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert {d: r.ids for d, r in got.items()} == {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in cleaned.items()}
    assert spans_cut and len(cleaned) < len(left) < len(texts) and any(r[1] for r in removed.values())


def test_stages_keep_the_columns(spark, case, tmp_path):
    folder = case[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == columns
    assert docs.count() > 0


def test_empty_documents(spark, case, tmp_path):
    docs = spark.read.parquet(f"{case[0]}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, case[0]).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_null_and_repeated_ids_in_the_near_copy_stage(spark, make_docs):
    rng = random.Random(22)
    prose = lambda: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(80))
    a, b, c, d = prose(), prose(), prose(), prose()
    docs = make_docs([a, a, a, b, b, c, d, d, None], ids=[1, 1, 2, None, None, 3, 5, 5, None]).withColumn("times", F.lit("x"))
    docs = docs.union(docs.where("doc_id = 3").withColumn("text", F.lit(prose())))  # one id, two different texts
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()]
    again = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_near_copies(spark, docs.repartition(5), "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(i for i, _ in got if i is not None) == [1, 3, 5] and sorted(str(t) for i, t in got if i is None) == sorted([b, b, "None"])


def test_lists_of_documents_are_merged_not_broadcast(spark, make_docs, tmp_path):
    """Joins of texts with heads or verdicts have one plan at any size, and near copies take one shuffle of the texts."""
    texts, items, _ = planted()
    docs = make_docs(texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stored = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for stage in (corpus_pipeline.one_of_near_copies, corpus_pipeline.without_benchmark):
        out = stage(spark, stored, str(tmp_path))
        assert out.count() > 0
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, stage.__name__
