"""Top products by blocks against all products, and how many blocks are left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import maxproduct, preference

U, I = "user_id string, vec array<double>", "recipe_id long, bias double, vec array<double>"


def world(kind, n_items=1500, n_users=60, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    x, u = rng.normal(size=(n_items, dims)), rng.normal(size=(n_users, dims))
    if kind == "norms":
        x *= rng.pareto(1.5, n_items)[:, None]
    if kind == "clusters":
        centres = rng.normal(size=(8, dims)) * 3
        x, u = centres[rng.integers(0, 8, n_items)] + 0.2 * x, centres[rng.integers(0, 8, n_users)] + 0.2 * u
        x, u = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, u))
    if kind == "equal":
        x[:] = x[0]
    bias = np.zeros(n_items) if kind == "clusters" else rng.normal(size=n_items) * 0.1 * (kind != "equal")
    return u, x, bias


def frames(spark, u, x, bias):
    return (spark.createDataFrame([(i, float(b), v.tolist()) for i, (b, v) in enumerate(zip(bias, x))], I),
            spark.createDataFrame([(f"u{i}", v.tolist()) for i, v in enumerate(u)], U))


@pytest.mark.parametrize("kind", ["norms", "clusters", "equal", "plain"])
def test_equals_all_products(spark, kind):
    u, x, bias = world(kind, 700)
    items, users = frames(spark, u, x, bias)
    barred = [(f"u{i}", j) for i in range(0, 60, 3) for j in range(i, 700, 5)] + [("u1", j) for j in range(698)]
    got = preference.recommend(items, users, spark.createDataFrame(barred, "user_id string, recipe_id long"), n=5, block=64)
    have = {(r.user_id, r.rn): (r.recipe_id, round(r.preference_score, 9)) for r in got.collect()}
    gone = {}
    for name, j in barred:
        gone.setdefault(name, set()).add(j)
    for i, row in enumerate(np.round(u @ x.T + bias, 9)):
        want = sorted((j for j in range(700) if j not in gone.get(f"u{i}", ())), key=lambda j: (-row[j], j))[:5]
        mine = [have.get((f"u{i}", k + 1)) for k in range(5)]
        assert [m[1] for m in mine if m] == pytest.approx([row[j] for j in want], abs=1e-8)
        if kind != "equal":
            assert [m[0] for m in mine if m] == want


@pytest.mark.parametrize("kind,least", [("norms", 0.5), ("clusters", 0.5), ("plain", 0.0)])
def test_blocks_left_out(spark, kind, least):
    u, x, bias = world(kind)
    items, users = frames(spark, u, x, bias)
    blocks, n = maxproduct.item_blocks(items, 64)
    assert blocks.agg(F.sum(F.size("recipe_ids"))).first()[0] == 1500 and blocks.agg(F.max(F.size("recipe_ids"))).first()[0] < 160
    met = maxproduct.asked_blocks(users.withColumn("need", F.lit(5).cast("long")), blocks, n, 64).count()
    assert 1 - met / (n * 60) >= least


def test_empty_sides(spark):
    items, users = frames(spark, *world("plain", 5, 2))
    none = spark.createDataFrame([], "user_id string, recipe_id long")
    assert preference.recommend(items.limit(0), users, none, n=3).collect() == []
    assert preference.recommend(items, users.limit(0), none, n=3).collect() == []
    assert preference.recommend(items, users, none, n=9).count() == 10


def test_packs_share_copies_of_their_block(spark):
    users = spark.range(3000).select(F.col("id").cast("string").alias("user_id"), F.array(F.lit(1.0)).alias("vec"), F.lit(1).cast("long").alias("need"),
                                     F.lit(0.0).alias("least"), F.when(F.col("id") < 2900, "a").otherwise("b").alias("block"))
    blocks = spark.createDataFrame([("a", [1, 2], [0.0, 0.0], [1.0, 2.0]), ("b", [3], [0.0], [3.0]), ("c", [4], [0.0], [4.0])],
                                   "block string, recipe_ids array<long>, biases array<double>, flat array<double>")
    met = maxproduct._met(users, blocks, 100).collect()
    assert sorted(int(u) for r in met for u in r.user_ids) == list(range(3000)) and len(met) > 25
    assert all(r.recipe_ids == {"a": [1, 2], "b": [3]}[r.block] and r.block == ("a" if int(u) < 2900 else "b") for r in met for u in r.user_ids)
    assert len({(r.block, r._share) for r in met}) <= -(-29 // maxproduct.SHARE) + 1


def test_packs_are_scored_in_pieces_and_few_reach_python_at_a_time(spark):
    from types import SimpleNamespace

    rng = np.random.default_rng(5)
    x, b, u = rng.normal(size=(40, 6)), rng.normal(size=40), rng.normal(size=(1000, 6))
    pieces = list(maxproduct._scores(SimpleNamespace(flat=x.ravel(), recipe_ids=np.arange(40), user_flat=u.ravel(), user_ids=np.arange(1000), biases=b)))
    assert max(len(p) for _, p in pieces) <= maxproduct.SCORED and np.allclose(np.vstack([p for _, p in pieces]), u @ x.T + b)
    assert np.concatenate([np.arange(1000)[part] for part, _ in pieces]).tolist() == list(range(1000))
    none = spark.createDataFrame([], "user_id string, recipe_id long")
    maxproduct.recommend(spark.createDataFrame([(1, 0.0, [1.0])], I), spark.createDataFrame([("a", [1.0])], U), none, 1).collect()
    wide = spark.range(0, 64, 1, 1).withColumn("x", F.array_repeat(F.lit(1.0), 1 << 17))  # 1 MB a row
    def count(it):
        import pandas as pd
        for pdf in it:
            yield pd.DataFrame({"n": [len(pdf)]})
    assert max(r.n for r in wide.mapInPandas(count, "n int").collect()) <= 16
