"""Event classifiers: every task, boosted trees for two classes and for more, stopped early on validation."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from innings_engine.catalog import ml_stream_queries as ml
from innings_engine.plans import models as md


def test_every_task_is_fitted(spark, sf, monkeypatch):
    tasks = []
    rows = spark.createDataFrame([("t", 0, [.5, .5], [.5, .5])], "task string, y bigint, raw array<double>, calibrated array<double>")
    monkeypatch.setattr(md, "vector_table", lambda *a: None)
    monkeypatch.setattr(md, "assembled", lambda data: data)
    monkeypatch.setattr(md, "calibrated_classifier", lambda data, task, classes: tasks.append((task, classes)) or rows)
    ml._classifiers(spark, sf)
    assert dict(tasks) == {"wicket": 2, "boundary": 2, "six": 2, "ten_plus": 2, "run_bucket": 6}


def test_classes_are_boosted_with_early_stopping(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 600
    x, part = rng.normal(size=n), np.array(["train", "validation", "refit_extra", "probability_calibration", "test"])[np.arange(n) % 5]
    frame = pd.DataFrame({"match_id": [f"m{i}" for i in range(n)], "innings": 1, "over_number": 1, "partition": part, "x": x, "target_kind": np.digitize(x, [-.5, .5])})
    data = md.VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(frame))
    made = []
    fitted = md.GBTClassifier
    monkeypatch.setattr(md, "GBTClassifier", lambda **kw: made.append(kw) or fitted(**kw))
    rows = md.calibrated_classifier(data, "kind", 3).toPandas()
    assert len(made) == 3 and {kw["validationIndicatorCol"] for kw in made} == {"held_out"}
    raw, calibrated = np.stack(rows.raw), np.stack(rows.calibrated)
    assert len(rows) == n // 5 and np.allclose(raw.sum(axis=1), 1) and np.allclose(calibrated.sum(axis=1), 1)
    assert (raw.argmax(axis=1) == rows.y).mean() > .9 and (calibrated.argmax(axis=1) == rows.y).mean() > .9
