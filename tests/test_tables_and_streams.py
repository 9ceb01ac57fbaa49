"""Shared folders, tables that are written, whole windows, and streams over several batches."""

import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from platewise import session
from platewise.operators import catalog, checkins as ck, matching, ratings, risk
from platewise.plans import streams
from platewise.plans.mapping import Domain
from platewise.sources import readers, sinks
from platewise.streaming import jobs

BASE = "/root/testdata/sf0.001"


def stub(master, shared=None):
    seen = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: seen[-1] if seen else None, setCheckpointDir=seen.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: shared or default), sparkContext=sc)


def test_shared_folder_is_required_off_local_masters():
    assert session.ensure_checkpoint_dir(stub("local[4]")) and session.ensure_checkpoint_dir(stub("spark://h:7077", "s3a://b/c")) == "s3a://b/c"
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(RuntimeError):
            session.ensure_checkpoint_dir(stub(master))


def test_entry_points_without_the_text_subpackage(monkeypatch):
    monkeypatch.setattr(entry_points, "find_spec", lambda name: None)
    assert not [n for n in entry_points.queries() if n.startswith("op") and n[2].isdigit()] and "pipeline" not in entry_points.queries()
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert "platewise" in sys.modules


def test_upsert_and_generation_tables(spark, rows):
    root = session.scratch_path(spark, "t")
    start = spark.createDataFrame([("a", "x", 1.0, 1), ("b", "x", 2.0, 1)], "user_id string, name string, risk double, n int")
    new = spark.createDataFrame([("a", "x", 5.0, 2), ("a", "x", 6.0, 3), ("c", "y", 7.0, 1)], start.schema)
    sinks.write_table(start, root)
    for _ in range(2):
        sinks.upsert_table(spark, root, new, ["user_id", "name"], "n")
        assert rows(sinks.read_table(spark, root)) == [("a", "x", 6.0, 3), ("b", "x", 2.0, 1), ("c", "y", 7.0, 1)]
    root = session.scratch_path(spark, "g")
    schema = "user_id string, recipe_id long, preference_score double, model_name string"
    sinks.write_table(spark.createDataFrame([("a", 1, 1.0, "m"), ("b", 2, 1.0, "m"), ("a", 9, 1.0, "other")], schema), root)
    for _ in range(2):
        sinks.replace_generation_table(spark, root, spark.createDataFrame([("a", 3, 2.0, "m")], schema), spark.createDataFrame([("a",)], "user_id string"), "m")
        assert rows(sinks.read_table(spark, root)) == [("a", 3, 2.0, "m"), ("a", 9, 1.0, "other"), ("b", 2, 1.0, "m")]


def test_only_touched_buckets_are_written(spark, rows):
    root = session.scratch_path(spark, "b")
    start = spark.range(400).selectExpr("cast(id as string) as user_id", "id as n", "cast(id as double) as risk")
    sinks.write_table(start, root, ["user_id"], 16)
    first = sinks._pointer(spark, root)["parts"]
    assert set(first) == set(range(16)) and len(set(first.values())) == 1
    change = spark.createDataFrame([("7", 900, 1.5), ("7", 901, 2.5), (None, 902, 3.5)], "user_id string, n long, risk double")
    for round in (2, 3):  # a null key is nobody's, so it is added each time
        sinks.upsert_table(spark, root, change, ["user_id"], "n")
        at = sinks._pointer(spark, root)
        assert at["version"] == round and 1 <= sum(first[b] != r for b, r in at["parts"].items()) <= 2
        got = sinks.read_table(spark, root)
        assert got.columns == start.columns and got.count() == 399 + round
        assert rows(got.where("user_id = '7'")) == [("7", 901, 2.5)]
    assert sinks.read_table(spark, root, 1).count() == 400
    sinks.upsert_table(spark, root, change.limit(0), ["user_id"], "n")
    assert sinks._pointer(spark, root)["version"] == 3
    # What a lost writer left behind is not read.
    start.withColumn("bucket__", F.lit(0)).write.partitionBy("bucket__").parquet(f"{root}/data/000000004-dead")
    assert sinks.read_table(spark, root).count() == 402


def test_tables_without_rows(spark):
    root = session.scratch_path(spark, "e")
    schema = "user_id string, recipe_id long, preference_score double, model_name string"
    sinks.write_table(spark.createDataFrame([], schema), root, ["user_id"], 4)
    assert sinks.read_table(spark, root).count() == 0
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    sinks.replace_generation_table(spark, root, spark.createDataFrame([("a", 3, 2.0, "m")], schema), users, "m")
    assert [tuple(r) for r in sinks.read_table(spark, root).collect()] == [("a", 3, 2.0, "m")]
    sinks.replace_generation_table(spark, root, spark.createDataFrame([], schema), users, "m")
    assert sinks.read_table(spark, root).count() == 0 and sinks.read_table(spark, root).columns == ["user_id", "recipe_id", "preference_score", "model_name"]


def test_csv_is_split_unless_line_breaks_are_asked_for(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,note\n1,"a, ""b"""\n2,"two\nlines"\n')
    whole = readers.read_csv(spark, str(tmp_path / "x.csv"), "id long, note string", breaks=True)
    assert [tuple(r) for r in whole.orderBy("id").collect()] == [(1, 'a, "b"'), (2, "two\nlines")]
    (tmp_path / "y.csv").write_text("id,note\n" + "".join(f'{i},"n, {i}"\n' for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        split = readers.read_csv(spark, str(tmp_path / "y.csv"), "id long, note string")
        assert split.rdd.getNumPartitions() > 1 and split.where("note = concat('n, ', id)").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_trending_counts_the_whole_window(spark):
    log = spark.range(120_000).select((F.col("id") % 7).alias("recipe_id"), F.lit("liked").alias("interaction_type"), F.lit("2024-01-30").cast("timestamp").alias("created_at"))
    got = ratings.trending(log, "2024-01-31 00:00:00", n=3).collect()
    assert [r.cnt for r in got] == [17143, 17143, 17143] and [r.recipe_id for r in got] == [0, 1, 2]


def test_search_answers_repeated_texts(spark, rows):
    recipes = spark.createDataFrame([(1, "Red Ring", None, ["a"]), (2, "blue ring", "x", None)], "recipe_id long, name string, description string, ingredients array<string>")
    asks = spark.createDataFrame([(1, "RING "), (2, "ring"), (3, "zz"), (4, " "), (5, "b")], "query_id long, q string")
    assert rows(catalog.search_contains(recipes, asks)) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (5, 1, 2)]


def test_long_checkins_are_rejected_not_cut(spark):
    raw = spark.createDataFrame([(1, "u", None, "0.5", ["s"] * 12, "sum", False, {"hours_0_8": ["f"] * 40})],
                                "checkin_id long, user_id string, created_at timestamp, severity string, symptoms array<string>, summary string, complete boolean, food_windows map<string,array<string>>")
    whole, limited = ck.validate_checkins(raw).first(), ck.validate_checkins(raw, most_foods=25, most_symptoms=8).first()
    assert len(whole.symptoms) == 12 and len(whole["hours_0_8"]) == 40 and whole.valid and not limited.valid


def test_hard_filter_fails_closed(spark, rows):
    recipes = spark.createDataFrame([(1, ["peanut butter"]), (2, ["rice"]), (3, [])], "recipe_id long, ingredients array<string>")
    bars = spark.createDataFrame([("a", "peanut", "peanut", "allergy", True), ("c", "", "", "allergy", True)], "user_id string, ingredient_name string, normalized_name string, restriction_type string, is_strict boolean")
    pairs = spark.createDataFrame([(u, r) for u in "abc" for r in (1, 2, 3, 4)], "user_id string, recipe_id long")
    assert rows(matching.hard_filter(pairs, recipes, bars)) == [("a", 2), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]


def test_signals_meet_only_wanted_texts(spark, rows):
    wanted = spark.createDataFrame([("a", "garlic powder"), ("b", "rice")], "user_id string, normalized_name string")
    signals = spark.createDataFrame([("a", "garlic", "Garlic", 0.9, 0.5), ("b", "garlic", "Garlic", 0.1, 0.5)], "user_id string, normalized_name string, ingredient_name string, risk_score double, confidence double")
    assert rows(risk.best_signals(wanted, signals), "user_id", "normalized_name", "risk_score") == [("a", "garlic powder", 0.9)]


def test_streams_run_in_several_batches(spark):
    d, seen = Domain(spark, BASE), []
    log = streams._as_stream(d, d.app_log, "log", order="created_at")
    jobs.run_once(log, "count", each=lambda batch, i: seen.append((batch.agg(F.min("created_at"), F.max("created_at"), F.count(F.lit(1))).first())))
    data = [s for s in seen if s[2]]
    assert len(data) >= 3 and sum(s[2] for s in data) == d.app_log.count()
    assert all(a[1] <= b[0] for a, b in zip(data, data[1:]))


def test_repeats_and_late_rows_across_batches(spark, at):
    root = session.scratch_path(spark, "late")
    for k, (user, key, when) in enumerate([("u", "k", "2024-01-01T00:00"), ("u", "k", "2024-01-01T10:00"), ("u", "j", "2024-01-20T00:00"), ("u", "m", "2024-01-20T00:30"), ("u", "old", "2024-01-02T00:00"), ("u", "j", "2024-01-20T01:00")]):
        spark.createDataFrame([(user, key, at(when))], "user_id string, event_key string, at timestamp").coalesce(1).write.mode("append").parquet(root)
    stream = jobs.file_stream(spark, root, spark.read.parquet(root).schema, files=1)
    out = jobs.run_once(jobs.stream_reward_dedup(stream), "dedup")
    assert sorted(r.event_key for r in spark.read.parquet(out).collect()) == ["j", "k", "m"]  # "old" came when the watermark was past it
