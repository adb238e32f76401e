"""Queries over every feature against numpy, on the whole tables."""
import numpy as np

from innings_engine.catalog import load
from innings_engine.plans import forecast as fc, models as md, over_table as ot

QUERIES, _ = load()


def slow_scores(spark, sf):
    table = md.model_table(spark, sf)
    names = md.numbers_of(table)
    rows = table.withColumn("row_key", fc.row_key()).toPandas().set_index("row_key").sort_index()
    train = rows.loc[rows.partition == "train", names]
    sigma = train.std(ddof=0)
    z = ((rows[names] - train.mean()) / sigma.where(sigma >= 1e-6, 1.0)).clip(-8, 8)
    return rows, z, names


def test_scores_and_contributions_of_all_features(spark, sf):
    rows, z, names = slow_scores(spark, sf)
    got = QUERIES["standardize_clip_all"](spark, sf).toPandas().set_index("row_key").sort_index()
    assert len(names) > 200 and (got.index == z.index).all() and (got.partition == rows.partition).all() and got.partition.nunique() > 3
    assert np.allclose(got[names], z, atol=2e-6)
    top = QUERIES["top_contributions_all"](spark, sf).toPandas().sort_values(["row_key", "rank"])
    assert len(top) == 3 * len(z) and top["rank"].tolist() == [1, 2, 3] * len(z)
    want = -np.sort(-np.abs(z.to_numpy()), axis=1)[:, :3]
    assert np.allclose(np.abs(top.contribution.to_numpy()).reshape(-1, 3), want, atol=2e-6)
    assert np.allclose([z.at[k, f] for k, f in zip(top.row_key, top.feature)], top.contribution, atol=2e-6)
    assert not top.duplicated(["row_key", "feature"]).any() and top.feature.nunique() > 15


def test_selection_of_all_features(spark, sf):
    table = md.model_table(spark, sf)
    got = QUERIES["feature_selection_all"](spark, sf).toPandas()
    removal = md.feature_removal(table).collect()[0]
    assert sorted(got.feature) == sorted(md.numbers_of(table)) and removal.features == len(got)
    assert max(1, (got.dropped == 0).sum()) == removal.kept and set(got.adopt) == {int(removal.adopt)}


def test_families_of_all_features(spark, sf):
    df = fc.samples(spark, sf)
    got = QUERIES["feature_families_all"](spark, sf).toPandas().set_index("feature")
    assert sorted(got.index) == sorted(ot.feature_columns(df)) and got.family.nunique() > 6
    rows = df.toPandas()
    for x in got.index:
        assert got.n[x] == rows[x].notna().sum()
        if rows[x].dtype != object:
            assert abs(got["mean"][x] - rows[x].mean()) < 2e-6 * max(1, abs(rows[x].mean()))
