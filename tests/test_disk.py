"""Shuffle files that go with their query, and work done by slices."""

import os

import pytest
from pyspark.sql import functions as F

from platewise.operators import preference, ranking, refresh
from platewise.plans import all_queries
from platewise.session import write_and_read

BASE = "/root/testdata/sf0.001"


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in dirs for _, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    assert write_and_read(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "few").count() == 10
    assert shuffle_files(spark) <= before


@pytest.mark.parametrize("name", ["rerank_final", "category_greedy_rows"])
def test_slices_of_users_rank_alike(spark, monkeypatch, rows, name):
    whole = rows(all_queries()[name](spark, BASE))
    written = []
    monkeypatch.setattr(refresh, "SLICE_ROWS", 500)
    monkeypatch.setattr(refresh, "write_and_read", lambda df, folder: written.append(folder) or write_and_read(df, folder))
    assert rows(all_queries()[name](spark, BASE)) == whole and written.count("ranked") == refresh.SLICES


def test_ranking_shuffles_candidates_by_recipe_and_by_user_only(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(refresh, "write_and_read", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write_and_read(df, name))
    all_queries()["rerank_final"](spark, BASE)
    assert plans["ranked"].count("Exchange hashpartitioning") <= 4  # candidates and what they meet, twice


def test_category_rows_take_one_cosine_per_recipe(spark, rows):
    ranked = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 2, 2, 0.4), ("b", 2, 1, 0.9), ("b", 9, 2, 0.1)], "user_id string, recipe_id long, rn int, final_score double")
    factors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "recipe_id long, vec array<double>")
    center = spark.createDataFrame([([0.0, 1.0],)], "vec array<double>")
    recipes = spark.createDataFrame([(1,), (2,)], "recipe_id long")
    trend = spark.createDataFrame([(9, 1)], "recipe_id long, rn int")
    none = spark.createDataFrame([], "user_id string, recipe_id long")
    yes = {name: F.lit(True) for name in ("flavor", "healthy", "quick")}
    by_pair, by_recipe = (ranking.category_rows(ranked, trend, preference.flavor_similarity(of, factors, center), recipes, none, yes, k=1)
                          for of in (ranked, ranked.select("recipe_id")))
    assert rows(by_recipe) == rows(by_pair)
    assert ("b", "trending", 1, 9, 0.1) in rows(by_recipe) or ("b", "trending", 1, 9, 0.1) in rows(by_pair)


def test_no_row_per_user_and_block_is_shuffled(spark):
    users = spark.range(300).select(F.col("id").cast("string").alias("user_id"))
    recipes = spark.range(400).select(F.col("id").alias("recipe_id"))
    barred = spark.createDataFrame([("7", 3), ("7", 399), (None, 5)], "user_id string, recipe_id long")
    found = ranking.cross_candidates(users, recipes, barred, block=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Generate" not in plan[plan.index("Exchange"):]  # what is shuffled is a row per user
    assert found.distinct().count() == found.count() == 300 * 400 - 2
    assert found.where("user_id = '7' and recipe_id in (3, 399)").count() == 0


def test_candidates_without_a_recipe_count_as_recipe_0(spark):
    """As they did when risks were joined by user and recipe."""
    candidates = spark.createDataFrame([("a", 0, 4.0, 1), ("a", 5, 3.0, 2), ("a", None, 2.0, 3), ("b", 0, 4.0, 1), (None, 5, 4.0, 1)],
                                       "user_id string, recipe_id long, preference_score double, rn int")
    recipes = spark.createDataFrame([(0, ["red onion"], [900.0] + [50.0] * 6, 5, 1, 1), (5, ["rice"], [1.0] * 7, 5, 1, 1)],
                                    "recipe_id long, ingredients array<string>, nutrition array<double>, minutes long, n_steps long, n_ingredients long")
    bars = spark.createDataFrame([], "user_id string, ingredient_name string, normalized_name string, restriction_type string")
    personal = spark.createDataFrame([("a", "onion", "onion", 0.9, 0.8, "personal")],
                                     "user_id string, normalized_name string, ingredient_name string, risk_score double, confidence double, source string")
    meals = spark.createDataFrame([], "user_id string, logged_at timestamp, trigger_load double")
    reports = spark.createDataFrame([], "user_id string, reported_at timestamp, severity double, no_symptoms boolean")
    out = refresh.ranked(candidates, recipes, bars, personal, personal.drop("user_id").limit(0).select(
        "normalized_name", "ingredient_name", "risk_score", "confidence", "source"), meals, reports, "2024-01-31 00:00:00").collect()
    keys = sorted((r.user_id, r.recipe_id) for r in out)
    assert keys == [("a", 0)] * 4 + [("a", 5), ("b", 0)]
    mine = [r for r in out if (r.user_id, r.recipe_id) == ("a", 0)]
    assert len({r.ingredient_risk for r in mine}) == 2 and min(r.ingredient_risk for r in mine) == 0.12 and len({r.symptom_risk for r in mine}) == 2
    assert sorted(r.rn for r in out if r.user_id == "a") == [1, 2, 3, 4, 5]
