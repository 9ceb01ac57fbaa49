"""Work that is dealt over tasks, done once, and settled without multiplying rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from platewise.operators import maxproduct, preference, risk
from platewise.plans import tables
from platewise.plans.mapping import Domain
from platewise.session import even_tasks


@pytest.fixture
def base(spark, tmp_path):
    at = dt.datetime(1999, 1, 1)
    spark.createDataFrame([(1, "a", 0, 5.0, "BUILDING"), (2, "b", 0, -5.0, "AUTOMOBILE")],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 4.0, "A", 1, at), (1, 2, 3.0, "N", 2, at), (2, 1, 4.0, "R", 1, at), (3, 1, 0.0, "N", 1, at)],
                          "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linenumber int, l_shipdate timestamp").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packs_of_one_block_are_dealt_over_tasks(spark):
    users = spark.range(400).select(F.col("id").cast("string").alias("user_id"), F.array(F.rand(1), F.rand(2)).alias("vec"),
                                    F.lit(2).cast("long").alias("need"), F.lit(float("-inf")).alias("least"), F.lit("b").alias("block"))
    blocks = spark.createDataFrame([("b", [1, 2], [0.0, 0.0], [1.0, 0.0, 0.0, 1.0])], "block string, recipe_ids array<long>, biases array<double>, flat array<double>")
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        met = maxproduct._met(users, blocks, 25).select(F.spark_partition_id().alias("p"), "user_ids").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(u for r in met for u in r["user_ids"]) == sorted(str(i) for i in range(400))
    assert len({r["p"] for r in met}) > 1


def test_shuffles_have_more_parts_than_the_session_names(spark):
    keys = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    for key in keys:
        spark.conf.unset(key)
    even_tasks(spark)
    assert "512)" in _plan(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    spark.conf.set(keys[0], "7")
    even_tasks(spark)
    assert spark.conf.get(keys[0]) == "7"
    spark.conf.unset(keys[0])
    even_tasks(spark)


def test_candidates_are_put_to_their_users_once(spark, base, rows):
    d = Domain(spark, base)
    assert _plan(d.preference).count("Exchange ") == 3  # two for the lines' orders, one by user
    assert rows(d.preference, "user_id", "rn", "recipe_id", "preference_score") == [("1", 1, 2, 4.0), ("1", 2, 1, 3.0), ("2", 1, 1, 5.0)]


def test_new_generation_is_made_once(spark, base, rows, monkeypatch):
    seen, real = [], tables.sinks.replace_generation_table
    monkeypatch.setattr(tables.sinks, "replace_generation_table", lambda s, root, new, *a: (seen.append(new.inputFiles()), real(s, root, new, *a)))
    out = tables.sink_replace_generation(Domain(spark, base))
    assert len(seen) == 2 and all("new-generation" in f for files in seen for f in files)
    assert rows(out) == [("1", 2, 4.0, "base@1"), ("1", 2, 5.0, "base@2"), ("2", 1, 5.0, "base@2")]


def test_items_of_clusters_are_scaled_once(spark):
    recipes = spark.createDataFrame([(i, i % 7, i % 3, 2, [float(i)] * 7, ["a", "b"]) for i in range(12)],
                                    "recipe_id long, minutes long, n_steps long, n_ingredients long, nutrition array<double>, ingredients array<string>")
    items, centers = preference.kmeans_items(recipes, k=2)
    assert all("kmeans-scaled" in f for f in items.inputFiles()) and items.count() == 12 and centers.count() == 2


def test_pairs_meet_their_signals_in_one_row(spark, rows):
    recipes = spark.createDataFrame([(1, ["hot sauce", "rice"]), (2, [])], "recipe_id long, ingredients array<string>")
    personal = spark.createDataFrame([("u", "hot", "Hot", 0.8, 0.5, "personal"), ("u", "sauce", "Sauce", 0.6, 0.5, "personal"), ("u", "milk", "Milk", 1.0, 1.0, "personal"),
                                      ("v", "rice", "Rice", 0.4, 0.1, "personal")], "user_id string, normalized_name string, ingredient_name string, risk_score double, confidence double, source string")
    population = spark.createDataFrame([("rice", "rice", 0.2, 0.4, "prior")], "normalized_name string, ingredient_name string, risk_score double, confidence double, source string")
    pairs = spark.createDataFrame([("u", 1), ("u", 1), ("v", 1), ("w", 1), ("u", 2), (None, 1)], "user_id string, recipe_id long")
    out = risk.recipe_ingredient_risk(pairs, recipes, personal, population, {"hot": 0.4}, masks=(), aliases={"none": ("none",)}, masked_names=("none",))
    assert not [line for line in _plan(out).splitlines() if "Join" in line and "user_id" in line and "normalized_name" in line]
    got = {(r["user_id"], r["recipe_id"]): r for r in out.collect()}
    assert len(got) == out.count() == 5
    u, v, w = got["u", 1], got["v", 1], got["w", 1]
    # Of two equally certain signals the riskier counts: .5 * .8 + .5 * .4 beside the prior of rice.
    assert (round(u["score"], 9), round(u["confidence"], 9), u["matched"], u["max_personal_risk"], u["personal_match_count"], u["personal_coverage"]) == (
        0.4, 0.45, ["Hot", "rice"], 0.8, 1, 0.5)
    assert (round(v["score"], 9), round(v["confidence"], 9), v["matched"], v["mean_personal_confidence"], v["ingredient_count"]) == (
        round((0.4 + 0.25 * 0.4 + 0.75 * 0.2) / 2, 9), 0.2, ["Rice"], 0.1, 2)
    assert (round(w["score"], 9), w["matched"], w["personal_match_count"]) == (0.3, ["rice"], 0)
    assert all((got[k]["score"], got[k]["matched"], got[k]["ingredient_count"]) == (0.12, [], 0) for k in (("u", 2), (None, 1)))


def test_shuffled_factors_of_earlier_turns_are_dropped_soon(spark, monkeypatch):
    """ALS removes the shuffle files of the turns before at its checkpoints only."""
    from pyspark.ml import recommendation

    seen = {}
    monkeypatch.setattr(recommendation, "ALS", lambda **params: seen.update(params) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        preference._als(spark.createDataFrame([("u", 1, 1.0)], "user_id string, recipe_id long, r double"), 4, 20, False, 0.1, 1)
    assert seen["checkpointInterval"] <= 2
