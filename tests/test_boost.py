"""Boosted trees: sums, cuts, leaves, blocks, and the loss against Spark's own boosting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import boost

COLS = ["a", "b", "c"]


def frame(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    p = 1 / (1 + np.exp(-(2 * (x[:, 0] > 0.3) - 1.5 * (x[:, 1] < -0.2) * (x[:, 0] < 1) + 0.2)))
    y = (rng.random(n) < p).astype(int)
    return spark.createDataFrame([(*map(float, r), int(l)) for r, l in zip(x, y)], "a double, b double, c double, label int"), x, y


def plain_tree(x, y, cuts, depth, step, penalty=1.0, least=1.0):
    """One tree over all rows by direct search; returns the margin of each row."""
    g, h = 0.5 - y, np.full(len(y), 0.25)
    out = np.zeros(len(y))

    def grow(rows, level):
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
        best = (1e-9, None)
        if level < depth:
            for c in range(x.shape[1]):
                for cut in cuts[c]:
                    left, right = rows[x[rows, c] <= cut], rows[x[rows, c] > cut]
                    if h[left].sum() >= least and h[right].sum() >= least:
                        gain = round(score(left) + score(right) - score(rows), 9)
                        if gain > best[0]:
                            best = (gain, (left, right))
        if best[1] is None:
            out[rows] = -step * g[rows].sum() / (h[rows].sum() + penalty)
        else:
            for part in best[1]:
                grow(part, level + 1)

    grow(np.arange(len(y)), 0)
    return out


@pytest.fixture(scope="module")
def data(spark):
    return frame(spark)


def test_first_tree_equals_direct_search(data):
    df, x, y = data
    model = boost.fit_boosted(df, COLS, trees=1, depth=2, step=0.3, subsample=1.0, columns_per_tree=1.0)
    assert model.margin(model.bins(x)) == pytest.approx(plain_tree(x, y, model.cuts, 2, 0.3))


def test_blocks_and_written_margins_change_nothing(data, monkeypatch):
    df, x, _ = data
    args = dict(trees=4, depth=2, step=0.3, subsample=1.0, seed=3)
    want = boost.fit_boosted(df, COLS, **args).margin
    monkeypatch.setattr(boost, "ROWS", 50)
    monkeypatch.setattr(boost, "KEEP", 1)
    model = boost.fit_boosted(df.repartition(3), COLS, **args)
    assert model.margin(model.bins(x)) == pytest.approx(want(model.bins(x)))


def test_loss_not_above_first_order_boosting(spark, data):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df, _, _ = data
    test, x, y = frame(spark, 400, 9)
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    model = boost.fit_boosted(df, COLS, trees=16, depth=2, step=0.15)
    mine = 1 / (1 + np.exp(-model.margin(model.bins(x))))
    vec = VectorAssembler(inputCols=COLS, outputCol="features")
    other = GBTClassifier(maxIter=16, maxDepth=2, stepSize=0.15, seed=1).fit(vec.transform(df.withColumn("label", F.col("label").cast("double"))))
    theirs = np.array([r.p for r in other.transform(vec.transform(test)).select(vector_to_array("probability")[1].alias("p")).collect()])
    assert loss(mine) <= loss(np.clip(theirs, 1e-9, 1 - 1e-9)) + 0.005 and loss(mine) < loss(np.full(len(y), y.mean())) - 0.05
    got = np.array([r.symptom_risk for r in model.predict(test).collect()])
    assert got == pytest.approx(mine)


def test_models_fitted_together_equal_those_fitted_alone(data):
    df, x, _ = data
    some = df.withColumn("part", F.when(F.col("a") < 0.5, "train").otherwise("test"))
    how = dict(trees=2, depth=2, step=0.3, subsample=1.0, columns_per_tree=1.0)
    one, both = boost.fit_together(some, COLS, [(F.col("part") == "train", 2.0), (F.lit(True), 1.0)], **how)
    alone = boost.fit_boosted(df, COLS, **how)
    bins = alone.bins(x)
    assert both.margin(bins) == pytest.approx(alone.margin(bins)) and one.margin(bins) != pytest.approx(alone.margin(bins))


def test_older_columns_nulls_and_one_class(spark, data):
    df, _, _ = data
    model = boost.fit_boosted(df.withColumn("c", F.lit(None).cast("double")).withColumn("b", F.lit(float("nan"))), COLS, trees=1, depth=1)
    assert len(model.cuts[2]) == 0
    got = model.predict(df.select("a", "label", F.lit("x").alias("extra"))).collect()
    assert len(got) == 600 and all(0 < r.symptom_risk < 1 for r in got)
    flat = boost.fit_boosted(df.where("label = 1"), COLS, trees=1, depth=1)
    assert flat.predict(df).agg(F.min("symptom_risk")).first()[0] > 0.5
    assert model.predict(df.limit(0)).collect() == []
