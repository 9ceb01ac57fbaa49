import pytest
from pyspark.sql import functions as F

from platewise.operators import matching, risk
from platewise.sources import readers

RECIPES = "recipe_id long, ingredients array<string>"
RESTRICTIONS = "user_id string, ingredient_name string, normalized_name string, restriction_type string, is_strict boolean"


def kept(spark, ingredients, name, kind="allergy", strict=True):
    recipes = spark.createDataFrame([(1, ingredients)], RECIPES)
    limits = spark.createDataFrame([("u", name, None, kind, strict)], RESTRICTIONS)
    pairs = spark.createDataFrame([("u", 1), ("v", 1)], "user_id string, recipe_id long")
    got = {r["user_id"] for r in matching.hard_filter(pairs, recipes, limits).collect()}
    assert "v" in got  # users without restrictions keep everything
    return "u" in got


@pytest.mark.parametrize("name, text", [
    ("peanut", "salted peanuts"), ("peanut", "creamy peanut-butter"), ("gluten", "durum wheat semolina"), ("dairy", "aged cheddar cheese"),
    ("soy", "roasted soybeans"), ("dairy", "almond milk with whey protein"), ("cream", "cream of tartar and heavy cream"), ("Tree-Nuts", "walnut oil")])
def test_forbidden(spark, name, text):
    assert not kept(spark, ["rice", text], name)


@pytest.mark.parametrize("name, text", [
    ("peanut butter", "roasted peanuts"), ("pea", "peanut oil"), ("dairy", "unsweetened almond milk"), ("milk", "coconut milk"), ("cream", "cream of tartar"),
    ("peanut", "pea protein"), ("peanut", "chickpeas"), ("peanut", "walnut oil"), ("peanut", "almond butter")])
def test_allowed(spark, name, text):
    assert kept(spark, [text], name)


@pytest.mark.parametrize("ingredients", [None, [], [""], ["  "]])
def test_fails_closed_without_ingredients(spark, ingredients):
    assert not kept(spark, ingredients, "peanut")
    assert kept(spark, ingredients, "peanut", kind="preference", strict=False)


def test_fails_closed_on_blank_name(spark):
    assert not kept(spark, ["rice"], " ")


def test_strict_rules(spark):
    assert not kept(spark, ["peanut"], "peanut", kind="Strict Sensitivity", strict=False)
    assert not kept(spark, ["peanut"], "peanut", kind="taste", strict=True)
    assert kept(spark, ["peanut"], "peanut", kind="taste", strict=None)
    no_flag = spark.createDataFrame([("u", "peanut", "taste")], "user_id string, ingredient_name string, restriction_type string").withColumn("normalized_name", F.lit(None).cast("string"))
    assert matching.strict_restrictions(no_flag).count() == 1


def test_guard_stops_on_missing_table(spark):
    with pytest.raises(readers.RestrictionDataUnavailable):
        readers.read_restrictions(lambda: spark.read.parquet("/tmp/no-such-folder-here"))
    with pytest.raises(readers.RestrictionDataUnavailable):
        readers.read_restrictions(lambda: spark.range(1))


def test_trigger_profile(spark):
    items = ["garlic powder", "almond flour", "coconut milk", "apple", "avocado", "broccoli", "fried chicken", "coffee", "bran"]
    row = matching.trigger_profile(spark.createDataFrame([(1, items), (2, [])], RECIPES)).orderBy("recipe_id").first().asDict()
    assert row["trigger_lactose_present"] == 0
    assert all(row[f"trigger_{g}_present"] == 1 for g in matching.vocab.TRIGGER_GROUPS if g != "lactose")


def test_trigger_exclusions(spark):
    words = ["rice flour", "plain flour", "buckwheat flour wheat", "milk", "oat milk", "rice"]
    df = spark.createDataFrame([(w,) for w in words], "normalized_name string")
    got = {r["normalized_name"]: set(r["groups"]) for r in matching.ingredient_groups(df).collect()}
    assert "rice flour" not in got and got["plain flour"] == {"fructans_gos"} and "buckwheat flour wheat" not in got
    assert got["milk"] == {"lactose"} and "oat milk" not in got and "rice" not in got


def test_specific_trigger_does_not_spread(spark):
    df = spark.createDataFrame([("rice",), ("cooked brown rice",)], "normalized_name string")
    assert {r["normalized_name"] for r in matching.ingredient_groups(df).collect()} == {"cooked brown rice"}


def signals(spark, rows, user=True):
    cols = "user_id string, " if user else ""
    return spark.createDataFrame(rows, cols + "normalized_name string, ingredient_name string, risk_score double, confidence double")


def test_ingredient_risk_coverage(spark):
    recipes = spark.createDataFrame([(1, ["garlic", "rice"]), (2, [])], RECIPES)
    pairs = spark.createDataFrame([("u", 1), ("u", 2)], "user_id string, recipe_id long")
    out = {r["recipe_id"]: r for r in risk.recipe_ingredient_risk(
        pairs, recipes, signals(spark, [("u", "garlic", "Garlic", 0.9, 0.8)]), signals(spark, [("zzz", "zzz", 0.5, 0.5)], False)).collect()}
    assert out[1]["personal_match_count"] == 1 and out[1]["personal_coverage"] == 0.5 and out[1]["matched"] == ["Garlic"]
    assert out[1]["score"] == pytest.approx(((0.8 * 0.9 + 0.2 * 0.65) + 0.08) / 2)
    assert out[2]["score"] == 0.12 and out[2]["confidence"] == 0 and out[2]["matched"] == []


def test_profile_signal_wins_ties(spark):
    generic = spark.createDataFrame([("u", "Garlic", "garlic", 0.9, 0.5), ("u", "Rice", "rice", 0.1, 0.9)],
                                    "user_id string, ingredient_name string, normalized_name string, risk_score double, confidence double")
    profile = spark.createDataFrame([("u", "garlics", 0.2, 0.5), ("u", "rice", 0.8, 0.3)], "user_id string, ingredient_name string, grade double, confidence double")
    got = {r["normalized_name"]: (r["source"], r["risk_score"]) for r in risk.personal_signals(generic, profile).collect()}
    assert got == {"garlic": ("ibs_profile", 0.2), "rice": ("personal", 0.1)}


def test_cold_start(spark):
    catalog = spark.createDataFrame([("milk", "lactose"), ("coffee", "caffeine_alcohol_fizzy")], "ingredient_name string, trigger_group string")
    answers = spark.createDataFrame([("u", "lactose", 3), ("u", "drinks", None)], "user_id string, question string, value int")
    got = {r["ingredient_name"]: (r["grade"], r["confidence"]) for r in risk.coldstart_questionnaire(answers, catalog).collect()}
    assert got == {"milk": (1.0, 0.35), "coffee": (0.0, 0.05)}
