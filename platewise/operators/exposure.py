"""Meals to exposures, attribution of reports, personal risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import numbers as num, text as tx
from ..functions.timeline import MICROS_PER_HOUR, window_aggregate


def meal_exposures(meals: DataFrame, bridge: DataFrame, recipes: DataFrame) -> DataFrame:
    """One row per ingredient eaten.  A recipe's bridge rows win over its ingredient array; a meal
    without a recipe counts as its food name."""
    listed = bridge.where(F.coalesce("ingredient_name", F.lit("")) != "").select("recipe_id", "ingredient_name")
    covered = listed.select("recipe_id").distinct()
    fallback = (recipes.join(covered, "recipe_id", "left_anti")
                .select("recipe_id", F.explode(tx.ingredient_texts(F.col("ingredients"))).alias("ingredient_name")))
    # Normalize once per catalog row, not once per meal.
    names = (listed.unionByName(fallback)
             .withColumn("normalized_name", tx.normalize_ingredient(F.col("ingredient_name"))))
    cols = ["user_id", "meal_log_id", "recipe_id", "ingredient_name", "normalized_name", "exposed_at", "portion_weight"]
    base = meals.select("user_id", "meal_log_id", "recipe_id", "food_name", F.col("logged_at").alias("exposed_at"),
                        num.falsy_to(F.col("portion_size").cast("double"), 1.0).alias("portion_weight"))
    cooked = base.where(F.col("recipe_id").isNotNull()).join(names, "recipe_id")
    plain = (base.where(F.col("recipe_id").isNull()).withColumn("ingredient_name", F.col("food_name"))
             .withColumn("normalized_name", tx.normalize_ingredient(F.col("food_name"))))
    return cooked.select(*cols).unionByName(plain.select(*cols)).where(F.col("normalized_name") != "")


def meal_nutrition(meals: DataFrame, recipes: DataFrame, digits: int | None = None) -> DataFrame:
    """User macros when any is given, else the catalog slots with their source and confidence."""
    cat = recipes.select("recipe_id", *[
        num.optional_float(F.get("nutrition", F.lit(i)), 0.0).alias(f"_{name}")
        for name, i in (("calories", 0), ("protein_g", 4), ("fat_g", 1))])
    mine = {c: num.optional_float(F.col(c), 0.0) for c in ("calories", "protein_g", "fat_g")}
    blank = mine["calories"].isNull() & mine["protein_g"].isNull() & mine["fat_g"].isNull()
    found = F.col("_calories").isNotNull() | F.col("_protein_g").isNotNull() | F.col("_fat_g").isNotNull()
    use = blank & found
    rounded = (lambda c: num.half_up(c, digits)) if digits is not None else (lambda c: c)
    known_source = F.col("nutrition_source").isin(*vocab.NUTRITION_SOURCES)
    keep = [c for c in meals.columns if c not in mine and c not in ("nutrition_source", "nutrition_confidence")]
    return meals.join(cat, "recipe_id", "left").select(
        *keep, *[F.when(use, rounded(F.col(f"_{c}"))).otherwise(e).alias(c) for c, e in mine.items()],
        F.when(use, "catalog_recipe").otherwise(F.when(known_source, F.col("nutrition_source"))).alias("nutrition_source"),
        F.when(use, 0.9).otherwise(F.when(F.col("nutrition_confidence").isNotNull(),
                                          num.clamp01(F.col("nutrition_confidence")))).alias("nutrition_confidence"))


def attribution_pairs(reports: DataFrame, exposures: DataFrame, hours: float = vocab.WINDOW_HOURS,
                      tau: float = vocab.DECAY_HOURS) -> DataFrame:
    """Each report with the exposures of its prior window and their weight (the pair form; totals
    come from `risk_evidence`, which builds no pairs).

    Time buckets as wide as the window are part of the join key, so an active user is spread over
    many tasks and every exposure meets two buckets only.
    """
    width = int(hours * MICROS_PER_HOUR)
    bucket = lambda c: F.floor(F.unix_micros(F.col(c)) / width)
    r = reports.select("report_id", "user_id", "reported_at", "severity", "no_symptoms",
                       bucket("reported_at").alias("_b"))
    e = exposures.select("user_id", "normalized_name", "exposed_at", "portion_weight",
                         F.explode(F.array(bucket("exposed_at"), bucket("exposed_at") + 1)).alias("_b"))
    gap = F.unix_micros("reported_at") - F.unix_micros("exposed_at")
    weight = num.decay_weight(F.col("exposed_at"), F.col("reported_at"), tau, hours) * num.falsy_to(
        F.col("portion_weight"), 1.0)
    return (r.join(e, ["user_id", "_b"]).where((gap >= 0) & (gap <= width))
            .withColumn("weight", weight).where(F.col("weight") > 0)
            .select("report_id", "user_id", "normalized_name", "weight", "severity", "no_symptoms"))


def _good(severity: Column, no_symptoms: Column) -> Column:
    return F.coalesce(no_symptoms, F.lit(False)) | (severity <= vocab.POSITIVE_SEVERITY)


def risk_evidence(reports: DataFrame, exposures: DataFrame, hours: float = vocab.WINDOW_HOURS,
                  tau: float = vocab.DECAY_HOURS) -> DataFrame:
    """Exposure counts and positive / negative evidence per (user, ingredient), without pairs.

    exp(-(r - e) / tau) splits into a part of the report and a part of the exposure.  Each meal
    instant of a user is a probe that sums the report parts of the window ahead of it; the sums
    then go to the meal's ingredients.  The report part is taken relative to its own time bucket
    and put back by bucket, so that it cannot overflow on long histories.
    """
    width = hours * 3600.0
    sec = lambda c: F.unix_micros(F.col(c)) / 1e6
    instants = (exposures.select("user_id", "exposed_at").distinct()
                .withColumn("_pid", F.concat_ws("|", "user_id", F.unix_micros("exposed_at").cast("string"))))
    good = _good(F.col("severity"), F.col("no_symptoms"))
    size = F.when(good, F.greatest(F.lit(0.1), 1 - F.col("severity"))).otherwise(F.col("severity"))
    # Report time enters as the offset in its bucket; a probe sees at most two buckets.
    bucket = F.floor(sec("reported_at") / width)
    part = F.exp(-(sec("reported_at") - bucket * width) / (tau * 3600.0)) * size
    even = F.pmod(bucket, F.lit(2)) == 0
    pick = lambda cond: F.when(cond, part).otherwise(F.lit(0.0))
    sums = window_aggregate(
        instants, reports, ["user_id"], "_pid", "exposed_at", "reported_at", hours,
        {"n": ("sum", F.lit(1)),
         "pos0": ("sum", pick(~good & even)), "pos1": ("sum", pick(~good & ~even)),
         "neg0": ("sum", pick(good & even)), "neg1": ("sum", pick(good & ~even))}, direction="ahead")
    at = sec("exposed_at")
    here = F.floor(at / width)
    # Scale from the bucket start of the same / the next bucket back to the exposure.
    scale = lambda b: F.exp(-(b * width - at) / (tau * 3600.0))
    same_even = F.pmod(here, F.lit(2)) == 0
    total = lambda k: (F.when(same_even, F.col(f"{k}0")).otherwise(F.col(f"{k}1")) * scale(here)
                       + F.when(same_even, F.col(f"{k}1")).otherwise(F.col(f"{k}0")) * scale(here + 1))
    seen = (instants.join(sums, "_pid").where(F.col("n") > 0)
            .select("user_id", "exposed_at", "n", total("pos").alias("pos"), total("neg").alias("neg")))
    portion = num.falsy_to(F.col("portion_weight"), 1.0)
    rows = (exposures.where(portion > 0).groupBy("user_id", "normalized_name", "exposed_at")
            .agg(F.count(F.lit(1)).alias("k"), F.sum(portion).alias("w")))
    return (rows.join(seen, ["user_id", "exposed_at"]).groupBy("user_id", "normalized_name")
            .agg(F.sum(F.col("k") * F.col("n")).alias("exposures"),
                 F.sum(F.col("w") * F.col("pos")).alias("positive"),
                 F.sum(F.col("w") * F.col("neg")).alias("negative")))


def risk_columns(positive: Column, negative: Column) -> tuple[Column, Column]:
    risk = num.clamp01((positive + vocab.PRIOR_POSITIVE) / (positive + negative + vocab.PRIOR_TOTAL))
    return risk, num.clamp01((positive + negative) / vocab.EVIDENCE_FULL)


def risk_update(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """Add new evidence to the current totals; rows without new evidence stay as they are.

    Totals stay unrounded; scores are rounded to four places, the status uses the full values.
    """
    old = current.select("user_id", "normalized_name", F.col("exposure_count").alias("_n"),
                         F.col("positive_evidence").alias("_p"), F.col("negative_evidence").alias("_q"))
    both = evidence.join(old, ["user_id", "normalized_name"], "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = both.select("user_id", "normalized_name", (z("exposures") + z("_n")).alias("exposure_count"),
                       (z("positive") + z("_p")).alias("positive_evidence"),
                       (z("negative") + z("_q")).alias("negative_evidence"))
    risk, conf = risk_columns(F.col("positive_evidence"), F.col("negative_evidence"))
    return both.select("*", F.round(risk, 4).alias("risk_score"), F.round(conf, 4).alias("confidence"),
                       num.status_ladder(risk, conf).alias("status"))
