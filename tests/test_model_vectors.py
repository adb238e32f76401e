"""The vectors the models read: equal to the full sample table, narrow, and scored without hundreds of column expressions."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from innings_engine.operators import encode as e
from innings_engine.plans import forecast as fc, models as md, over_table as ot

KEY = ["match_id", "innings", "over_number"]


def test_vectors_equal_the_full_table(spark, sf):
    data = md.vector_table(spark, sf)
    assert data.columns == [*md.KEYS, *md.TARGETS, "features"]
    full = fc.samples(spark, sf).toPandas().sort_values(KEY).reset_index(drop=True)
    got = md.model_table(spark, sf).toPandas().sort_values(KEY).reset_index(drop=True)
    assert len(got) == len(full) > 500 and (got.partition == full.partition).all() and (got[md.TARGETS] == full[md.TARGETS]).all().all()
    names = ot.feature_columns(fc.samples(spark, sf))
    texts = [x for x in names if full[x].dtype == object and x in ot.CATEGORICAL]
    numbers = [x for x in names if x not in texts and x not in md.KEYS]
    assert md.features_of(data) == ["innings", "over_number", *numbers, *[f"{x}_code" for x in ot.CATEGORICAL if x in texts]]
    assert np.array_equal(got[numbers].to_numpy(), full[numbers].fillna(0).to_numpy(dtype=float))
    for x in texts:
        codes = {v: i for i, v in enumerate(sorted(full.loc[full.partition == "train", x].unique()))}
        assert (got[f"{x}_code"] == full[x].map(lambda v: codes.get(v, -1))).all(), x


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=4000), rng.integers(-8_000_000, 8_000_000, 4000) / 1e6 + 5e-7, [0.0, -0.0, -2e-7, 8.0, -8.0, .0000005]])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "mine": e.half_up()(x)}))
    assert df.filter(F.round("x", 6) != F.col("mine")).isEmpty()


def test_rescoring_one_column_equals_rescoring_all(spark):
    class Fitted:
        coefficients = type("V", (), {"toArray": staticmethod(lambda: np.array([3.0, -.5]))})
        intercept = .25
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"x": rng.normal(size=3000), "z": rng.normal(size=3000), "id": range(3000)})
    frame["y"] = 3 * frame.x + rng.normal(size=3000)
    df, scorer = spark.createDataFrame(frame), md.linear_scorer(Fitted, ["x", "z"])
    plain = md.permutation_importance(df, ["x", "z"], "y", lambda p: scorer(p), ["id"]).toPandas().set_index("feature")
    quick = md.permutation_importance(df, ["x", "z"], "y", scorer, ["id"]).toPandas().set_index("feature")
    assert set(scorer.weights) == {"x", "z"} and np.allclose(plain, quick.loc[plain.index], atol=1e-9) and plain.mae_increase["x"] > 1
