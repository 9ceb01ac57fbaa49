import math

import pytest
from pyspark.sql import functions as F

from platewise.functions import numbers as num, text as tx, vectors as vec
from platewise.operators import catalog, content, dialog, matching
from platewise.sources import readers


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("Sun-Dried Tomatoes", "sun dried tomato"), ("Potatoes & Leaves", "potato and leaf"), ("Gas", "gas"), ("glasses", "glasse"),
    ("berries", "berry"), ("boxes", "box"), ("hummus", "hummus"), ("couscous", "couscous"), ("  ", ""), ("peas", "pea"), ("radishes", "radish")])
def test_normalize_ingredient(spark, raw, want):
    assert one(spark, tx.normalize_ingredient(F.lit(raw))) == want


def test_normalizers_differ(spark):
    assert one(spark, tx.normalize_text(F.lit("Sugar-Free & Co."))) == "sugar-free and co"
    assert one(spark, tx.normalize_text(F.lit("Sugar-Free & Co."), keep_hyphen=False)) == "sugar free co"


def test_mask_consumes_shared_space(spark):
    assert one(spark, tx.mask_phrases(F.lit("almond milk whey protein"))) == "whey protein"
    assert one(spark, tx.mask_phrases(F.lit("oat milk oat milk"), ("oat milk",))) == "oat milk"


@pytest.mark.parametrize("value, want", [(None, 0.0), (float("nan"), 0.0), (float("inf"), 0.0), (-1.0, 0.0), (0.4, 0.4), (7.0, 1.0)])
def test_clamp(spark, value, want):
    assert one(spark, num.clamp01(F.lit(value).cast("double"))) == want


def test_optional_float_and_buckets(spark):
    get = lambda v, m=None: one(spark, num.optional_float(F.lit(v), m))
    assert get("") is None and get("x") is None and get("-1", 0.0) is None and get("2.5") == 2.5 and get("NaN") is None
    assert one(spark, num.bucket_name(F.lit(28), (15.0, 30.0, 60.0))) == "le_30"
    assert one(spark, num.bucket_name(F.lit(99), (15.0, 30.0))) == "gt_30"
    assert one(spark, num.bucket_name(F.lit(None).cast("double"), (15.0,))) == "unknown"


def test_parse_timestamp(spark):
    get = lambda v: one(spark, F.date_format(num.parse_timestamp(F.lit(v)), "yyyy-MM-dd HH:mm"))
    assert get("2024-01-02T03:04:00Z") == "2024-01-02 03:04"
    assert get("2024-01-02T03:04:00+02:00") == "2024-01-02 01:04"
    assert get("2024-01-02") == "2024-01-02 00:00" and get("2024") is None and get("soon") is None


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    none = F.lit(None).cast("array<double>")
    assert one(spark, vec.cosine(a(1, 0), a(0, 0))) == 0.0
    assert one(spark, vec.blend(a(2, 0), a(0, 2), F.lit(0.25))) == [1.5, 0.5]
    assert one(spark, vec.blend(none, a(2, 4), F.lit(0.1))) == pytest.approx([0.2, 0.4])
    assert one(spark, vec.blend(a(1, 1), a(1), F.lit(0.5))) == [1.0, 1.0]
    assert one(spark, vec.clipped_delta(a(5, 0), a(7, 0), F.lit(1.0), 1.0)) == 1.0


def test_title_and_display_names(spark):
    assert one(spark, tx.title_case(F.lit("bob's 2nd soup"))) == "Bob'S 2Nd Soup"
    assert one(spark, tx.format_name(F.lit("bbq & go soup"))) == "Bbq And GO Soup"


def test_parse_list(spark):
    get = lambda v: one(spark, readers.parse_list(F.lit(v)))
    assert get("['a', \"b's\", 'c,d']") == ["a", "b's", "c,d"]
    assert get("[]") == [] and get("oops") == [] and get("['open") == [] and get('["x", null]') == ["x", None]
    assert one(spark, readers.parse_number_list(F.lit("[51.5, 0.0, 3]"))) == [51.5, 0.0, 3.0]


def test_csv_with_quotes_and_breaks(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('food_group,fodmap_category,fodmap_severity\n"111 - Milk, cow\'s",Lactose,High\n"two\nlines ""q""",GOS,Low\n')
    got = {r["food_group"]: r["fodmap_category"] for r in readers.read_fodmap_lookup(spark, str(f)).collect()}
    assert got == {"111 - Milk, cow's": "Lactose", 'two\nlines "q"': "GOS"}


def test_item_features(spark, rows):
    df = spark.createDataFrame(
        [(1, [f"ing {i}" for i in range(40)], 28, 3, 40, [350.0] + [0.0] * 6, True), (2, [], None, None, None, None, None)],
        "recipe_id long, ingredients array<string>, minutes int, n_steps int, n_ingredients int, nutrition array<double>, is_ibs_friendly boolean")
    got = {(r["recipe_id"], r["feature"]): r["weight"] for r in catalog.item_features(df, max_ingredients=24).collect()}
    assert sum(k[1].startswith("item:ingredient:") for k in got if k[0] == 1) == 24
    assert catalog.item_features(df).where("recipe_id = 1 and feature like 'item:ingredient:%'").count() == 40  # nothing is cut by default
    assert got[(1, "item:minutes:le_30")] == 0.30 and got[(1, "item:nutrition:calories:le_500")] == 0.12
    assert got[(1, "item:ibs_friendly:True")] == 0.15 and got[(2, "item:ingredient:unknown")] == 0.25
    assert got[(2, "item:minutes:unknown")] == 0.30 and not any(k[0] == 2 and "friendly" in k[1] for k in got)


def test_weighted_tokens(spark):
    docs = spark.createDataFrame([("a", "The quick red-hot Rice, rice!", 2.0)], "id string, text string, weight double")
    assert {r["token"]: r["weight"] for r in content.weighted_tokens(docs).collect()} == {"red": 2.0, "hot": 2.0, "rice": 4.0}


@pytest.mark.parametrize("text, kind", [
    ("an apple", "food"), ("do you like pizza?", "not_food"), ("never mind", "cancel"), ("", "not_food"), ("ok!", "not_food"), ("two tomatoes", "food"),
    ("forget it", "cancel"), ("word " * 33, "not_food")])
def test_classify_food(spark, text, kind):
    msgs = spark.createDataFrame([("m", text)], "id string, text string")
    vocabulary = dialog.food_terms(spark, ("apple", "pizza", "tomato", "rice"))
    assert dialog.classify_food(msgs, vocabulary).first()["kind"] == kind


@pytest.mark.parametrize("text, names", [
    ("I have allergies to peanuts, eggs and tree nuts", {"peanut", "egg", "tree nut"}), ("I think I am allergic to potatoes", set()),
    ("I'm very allergic to the soy products. Thanks", {"soy"}), ("I am allergic to that", set()), ("you are allergic to nuts", set()),
    ("Maybe later. " + "x" * 60 + " I am allergic to milk but not rice", {"milk"})])
def test_extract_allergies(spark, text, names):
    msgs = spark.createDataFrame([(1, text)], "id long, text string")
    assert {r["allergy"] for r in dialog.extract_allergies(msgs).collect()} == names


def test_bidirectional(spark, rows):
    left = spark.createDataFrame([("a", "brown rice"), ("b", "ric"), ("c", "pea")], "left_id string, text string")
    right = spark.createDataFrame([("x", "rice"), ("y", "cooked brown rice"), ("z", "peanut")], "right_id string, text string")
    assert rows(matching.bidirectional_hits(left, right)) == [("a", "x"), ("a", "y")]
    assert ("c", "z") in rows(matching.bidirectional_hits(left, right, tokenized=False))
    assert ("b", "y") in rows(matching.bidirectional_hits(left, right, tokenized=False))


def test_history_keeps_greeting_and_last(spark):
    msgs = [(1, i, "user" if i % 2 else "ai", f"m{i}") for i in range(6)] + [(2, 0, "ai", "Hi"), (2, 1, "user", "x")]
    out = dialog.trim_history(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string"), 4, "Hi")
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["conv_id"], r["pos"])):
        got.setdefault(r["conv_id"], []).append(r["text"])
    assert got == {1: ["Hi", "m3", "m4", "m5"], 2: ["Hi", "x"]}


def test_context_text_is_bounded(spark):
    from platewise.plans.mapping import Domain
    from platewise.plans.safety import context_assembly

    out = context_assembly(Domain(spark, "/root/testdata/sf0.001"))
    worst = out.agg(F.max(F.length("context_text")).alias("n"), F.min("source_count").alias("m")).first()
    assert worst["n"] <= 7000 and worst["m"] >= 1


def test_decay_is_zero_after_window(spark, at):
    w = lambda a, b: one(spark, num.decay_weight(F.lit(at(a)), F.lit(at(b))))
    assert w("2024-01-01T00:00", "2024-01-03T00:00") == pytest.approx(math.exp(-48 / 18))
    assert w("2024-01-01T00:00", "2024-01-03T00:01") == 0.0 and w("2024-01-02T00:00", "2024-01-01T00:00") == 1.0


def test_sides_that_only_look_small_are_not_broadcast(spark, tmp_path):
    from platewise.plans.mapping import Domain

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        Domain(spark, str(tmp_path))
        spark.range(2000).selectExpr("id", "sequence(0, 499) AS xs").write.parquet(str(tmp_path / "packed"))
        side = spark.read.parquet(str(tmp_path / "packed")).selectExpr("id", "explode(xs) AS x")
        # A million rows in a file of some kB, against a table that is larger still.
        met = spark.range(3000).join(side, "id")
        assert met.count() == 1_000_000
        assert "BroadcastHashJoin" not in met._jdf.queryExecution().sparkPlan().toString()
        few = spark.range(3000).join(spark.range(5), "id")
        few.collect()
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
