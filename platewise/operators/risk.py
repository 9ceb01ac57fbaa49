"""Ingredient signals, recipe risk, symptom features and the final rerank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import vocab
from ..functions import numbers as num, text as tx
from .catalog import recipe_ingredients
from .matching import name_hits


#: Risk of a recipe without known ingredients.
UNKNOWN = 0.12


def personal_signals(generic: DataFrame, profile: DataFrame) -> DataFrame:
    """Generic risks by user and name; a profile risk takes over when it is at least as certain."""
    def shape(df: DataFrame, name: Column, score: str, source: str) -> DataFrame:
        rows = df.select(
            "user_id", tx.normalize_ingredient(name).alias("normalized_name"), "ingredient_name",
            num.clamp01(F.col(score)).alias("risk_score"), num.clamp01(F.col("confidence")).alias("confidence"),
            F.lit(source).alias("source"))
        value = F.struct("ingredient_name", "risk_score", "confidence", "source")
        return rows.groupBy("user_id", "normalized_name").agg(
            F.max_by(value, F.struct("confidence", "risk_score", "ingredient_name")).alias(source))

    given = F.when(F.coalesce("normalized_name", F.lit("")) != "", F.col("normalized_name")).otherwise(
        F.col("ingredient_name"))
    a = shape(generic, given, "risk_score", "personal")
    b = shape(profile, F.col("ingredient_name"), "grade", "ibs_profile")
    both = a.join(b, ["user_id", "normalized_name"], "full_outer")
    take = F.col("personal").isNull() | (F.col("ibs_profile.confidence") >= F.col("personal.confidence"))
    best = F.when(take, F.col("ibs_profile")).otherwise(F.col("personal"))
    return both.select("user_id", "normalized_name", best.alias("s")).select(
        "user_id", "normalized_name", *[F.col(f"s.{c}").alias(c)
                                        for c in ("ingredient_name", "risk_score", "confidence", "source")])


def population_signals(population: DataFrame, catalog: DataFrame,
                       priors: Mapping[str, float] = vocab.GROUP_PRIORS) -> DataFrame:
    """Population priors first, catalog entries only where no prior exists."""
    given = F.when(F.coalesce("normalized_name", F.lit("")) != "", F.col("normalized_name")).otherwise(
        F.col("ingredient_name"))
    a = population.select(
        tx.normalize_ingredient(given).alias("normalized_name"), "ingredient_name",
        num.clamp01(F.col("population_risk_score")).alias("risk_score"),
        num.clamp01(num.falsy_to(F.col("confidence"), 0.35)).alias("confidence"),
        F.lit("population_prior").alias("source"))
    table = F.create_map(*[F.lit(x) for kv in priors.items() for x in kv])
    b = catalog.select(
        tx.normalize_ingredient(F.col("ingredient_name")).alias("normalized_name"), "ingredient_name",
        F.coalesce(F.try_element_at(table, F.col("trigger_group")), F.lit(vocab.DEFAULT_GROUP_PRIOR)).alias("risk_score"),
        F.lit(0.25).alias("confidence"), F.lit("ibs_catalog_prior").alias("source"))

    def one(df: DataFrame) -> DataFrame:
        cols = ["ingredient_name", "risk_score", "confidence", "source"]
        return (df.groupBy("normalized_name").agg(F.max_by(F.struct(*cols), F.struct(
            "confidence", "risk_score", "ingredient_name")).alias("s"))
            .select("normalized_name", *[F.col(f"s.{c}").alias(c) for c in cols]))

    first = one(a)
    return first.unionByName(one(b).join(first.select("normalized_name"), "normalized_name", "left_anti"))


def best_signals(wanted: DataFrame, signals: DataFrame, **rule) -> DataFrame:
    """Best matching signal per wanted text: the most certain, then the riskiest, then by name.

    Signals of users need wanted texts of users (user_id, normalized_name).  Texts meet the signals' names once
    per distinct text; a user's wanted texts then meet only that user's signals, by user and name.
    """
    per_user = "user_id" in signals.columns
    names = signals.select(*(["user_id"] if per_user else []), F.col("normalized_name").alias("signal"),
                           "ingredient_name", "risk_score", "confidence")
    vocabulary = names.select("signal").distinct()
    hits = name_hits(wanted.select("normalized_name").distinct(), vocabulary, "signal", **rule)
    keys = (["user_id"] if per_user else []) + ["normalized_name"]
    met = wanted.select(*keys).distinct().join(hits, "normalized_name").join(names, ["user_id", "signal"]) if per_user else hits.join(names, "signal")
    best = met.groupBy(*keys).agg(
        F.max(F.struct("confidence", "risk_score", "signal", "ingredient_name")).alias("s"))
    return best.select(*keys, "s.signal", "s.ingredient_name", "s.risk_score", "s.confidence")


def recipe_parts(recipes: DataFrame, personal: DataFrame, population: DataFrame, keywords: Mapping[str, float] | None = None, **rule) -> DataFrame:
    """recipe_id, _parts: a recipe's ingredients in order, each with its population score and the personal signals it answers to.
    Both are settled once per catalog ingredient."""
    rows = recipe_ingredients(recipes)
    dictionary = rows.select("normalized_name").distinct()
    pop = best_signals(dictionary, population, **rule).select(
        "normalized_name", F.col("risk_score").alias("pop_risk"), F.col("confidence").alias("pop_conf"),
        F.col("ingredient_name").alias("pop_name"))
    # Keyword priors normalize twice, which changes nothing.
    settled = (dictionary.join(pop, "normalized_name", "left")
               .withColumn("base", F.coalesce("pop_risk", tx.keyword_prior(F.col("normalized_name"), keywords)))
               .withColumn("base_conf", F.coalesce("pop_conf", F.lit(0.15))))
    answers = name_hits(dictionary, personal.select(F.col("normalized_name").alias("signal")).distinct(), "signal", **rule).groupBy("normalized_name").agg(
        F.collect_set("signal").alias("signals"))
    ready = rows.select("recipe_id", "pos", "normalized_name").join(settled, "normalized_name").join(answers, "normalized_name", "left")
    return ready.groupBy("recipe_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "base", "base_conf", "pop_name", "signals"))),
        lambda p: F.struct(*[p[c].alias(c) for c in ("base", "base_conf", "pop_name", "signals")])).alias("_parts"))


def user_signals(personal: DataFrame) -> DataFrame:
    """user_id, _own: a user's signals as one array."""
    names = personal.select("user_id", F.col("normalized_name").alias("signal"), "ingredient_name", "risk_score", "confidence")
    # `trust` follows from the certainty, so it changes no order.
    trusted = names.where("user_id is not null and signal is not null").withColumn("trust", num.clamp01(F.greatest(F.lit(0.25), F.col("confidence"))))
    return trusted.groupBy("user_id").agg(
        F.collect_list(F.struct("confidence", "risk_score", "signal", "ingredient_name", "trust")).alias("_own"))


def recipe_ingredient_risk(pairs: DataFrame, recipes: DataFrame, personal: DataFrame, population: DataFrame,
                           keywords: Mapping[str, float] | None = None, **rule) -> DataFrame:
    """Ingredient risk of every (user, recipe) pair.

    A recipe's ingredients travel as one array and a user's signals as another; a pair meets both once and is
    settled in its own row, so no pair is multiplied by its ingredients.
    """
    keyed = pairs.select("user_id", "recipe_id").distinct()
    met = keyed.join(recipe_parts(recipes, personal, population, keywords, **rule), "recipe_id", "left").join(user_signals(personal), "user_id", "left")
    return settled_risk(met).fillna(0)


def settled_risk(met: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The ingredient risk of rows with _parts and _own, beside their user, recipe and the columns to keep."""
    met = met.withColumn("_parts", F.when(F.col("user_id").isNotNull(), F.col("_parts")))
    # The most certain of the user's signals that the ingredient answers to, then the riskiest, then by name.
    own = lambda p: F.array_max(F.filter("_own", lambda s: F.array_contains(p["signals"], s["signal"])))
    mixed = lambda x: x["own"]["trust"] * x["own"]["risk_score"] + (1 - x["own"]["trust"]) * x["base"]
    best = met.withColumn("_best", F.transform("_parts", lambda p: F.struct(
        p["base"].alias("base"), p["base_conf"].alias("base_conf"), p["pop_name"].alias("pop_name"), own(p).alias("own"))))
    unit = lambda v: F.when(v.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    score = lambda x: F.coalesce(mixed(x), x["base"])
    conf = lambda x: F.coalesce(x["own"]["trust"], x["base_conf"])
    total = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + of(x))
    size = F.size("_best")
    hit = F.filter("_best", lambda x: x["own"].isNotNull())
    out = best.withColumn("_hit", hit).withColumn("_scores", F.transform("_best", score))
    n_hit = F.size("_hit")
    known = F.col("_best").isNotNull()  # pairs of recipes without ingredients and rows without a user know nothing
    mean = lambda of: F.when(known & (n_hit > 0), total("_hit", of) / n_hit).otherwise(0.0)
    return out.select(
        "user_id", "recipe_id", *keep,
        F.when(known, num.clamp01(total("_scores", unit) / size)).otherwise(UNKNOWN).alias("score"),
        F.when(known, num.clamp01(total("_best", conf) / size)).otherwise(0.0).alias("confidence"),
        F.when(known, F.array_sort(F.array_distinct(F.filter(F.transform("_best", lambda x: F.coalesce(x["own"]["ingredient_name"], x["pop_name"])), lambda x: x.isNotNull()))))
        .otherwise(F.array().cast("array<string>")).alias("matched"),
        F.coalesce(F.when(known, F.array_max(F.transform("_hit", lambda x: x["own"]["risk_score"]))), F.lit(0.0)).alias("max_personal_risk"),
        mean(lambda x: x["own"]["risk_score"]).alias("mean_personal_risk"), mean(lambda x: x["own"]["confidence"]).alias("mean_personal_confidence"),
        F.when(known, n_hit).otherwise(0).cast("long").alias("personal_match_count"), F.when(known, size).otherwise(0).cast("long").alias("ingredient_count"),
        F.when(known, n_hit / size).otherwise(0.0).alias("personal_coverage")).fillna(0, [*RISK_COLUMNS, "ingredient_count"])


#: What the symptom features take of the ingredient risk.
RISK_COLUMNS = ("score", "confidence", "max_personal_risk", "mean_personal_risk", "mean_personal_confidence", "personal_match_count", "personal_coverage")


def recipe_features(recipes: DataFrame, triggers: DataFrame) -> DataFrame:
    """What the symptom features take of a recipe, by recipe_id."""
    items = tx.ingredient_texts(F.col("ingredients"))
    text = F.lower(F.array_join(items, " "))
    finite = lambda c: num.optional_float(F.col(c), 0.0)
    size = F.size(items).cast("double")
    count = F.coalesce(finite("n_ingredients"), F.when(F.size(items) > 0, size))
    steps = F.coalesce(finite("n_steps"), F.size("steps").cast("double") if "steps" in recipes.columns else F.lit(None))
    nut, present = num.non_negative_nutrition(F.col("nutrition")), num.nutrition_present(F.col("nutrition"))
    plain = num.nutrition_array(F.col("nutrition"))
    nut = F.when(F.size("nutrition") >= 7, nut).otherwise(plain)
    yes = lambda c: c.cast("double")
    return recipes.select(
        "recipe_id", F.lit(1.0).alias("_cat"),
        *[yes(tx.any_substring(text, words)).alias(name) for name, words in vocab.LEGACY_FLAGS.items()],
        nut.alias("_nut"), yes(F.size(items) == 0).alias("recipe_ingredients_missing"),
        yes(count.isNull()).alias("recipe_ingredient_count_missing"), yes(~present).alias("recipe_nutrition_missing"),
        yes(finite("minutes").isNull()).alias("recipe_minutes_missing"),
        yes(steps.isNull()).alias("recipe_step_count_missing"),
        F.coalesce(finite("minutes"), F.lit(0.0)).alias("recipe_minutes"),
        F.coalesce(count, F.lit(0.0)).alias("recipe_ingredient_count"),
        F.coalesce(steps, F.lit(0.0)).alias("recipe_step_count")).join(triggers, "recipe_id", "left")


def symptom_features(pairs: DataFrame, recipes: DataFrame, triggers: DataFrame, context: DataFrame,
                     risk: DataFrame | None = None, context_key: str = "ref_id") -> DataFrame:
    """One feature row per pair: training columns and the older ones kept beside them.

    `pairs` has user_id, recipe_id, the context key and `at`; meal columns are optional.
    """
    full = pairs.join(recipe_features(recipes, triggers), "recipe_id", "left").join(context, context_key, "left")
    for c in RISK_COLUMNS:
        if risk is None:
            full = full.withColumn(f"_risk_{c}", F.lit(0.0))
    if risk is not None:
        renamed = risk.select("user_id", "recipe_id", *[
            F.col(c).cast("double").alias(f"_risk_{c}") for c in risk.columns
            if c not in ("user_id", "recipe_id", "matched", "ingredient_count")])
        full = full.join(renamed, ["user_id", "recipe_id"], "left")
    return feature_rows(full, triggers.columns, pairs.columns, ["user_id", "recipe_id", context_key])


def feature_rows(full: DataFrame, trigger_columns: Sequence[str], given: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The feature rows of rows that hold all they are made from: recipe features, recent context and _risk_ columns.  Of the
    meal's columns those in `given` count."""
    yes = lambda c: c.cast("double")
    z = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d))
    slot = {name: F.coalesce(F.get("_nut", F.lit(i)), F.lit(0.0)) for i, name in enumerate(vocab.NUTRITION_SLOTS)}
    sin, cos = num.time_cyclic(F.col("at"))
    opt = lambda c: num.optional_float(F.col(c), 0.0) if c in given else F.lit(None).cast("double")
    source = F.lower(F.trim(F.coalesce("nutrition_source", F.lit("")))) if "nutrition_source" in given else F.lit("")
    grams = source.isin(*vocab.GRAM_SOURCES)
    confid = opt("nutrition_confidence")
    logged = {
        "logged_calories": opt("calories"), "logged_protein_g": F.when(grams, opt("protein_g")),
        "logged_fat_g": F.when(grams, opt("fat_g")), "logged_portion_size": opt("portion_size"),
        "logged_nutrition_confidence": F.when(confid.isNotNull(), num.clamp01(confid))}
    family = tx.unit_family(F.col("portion_unit")) if "portion_unit" in given else F.lit("unknown")
    groups = [c for c in trigger_columns if c.startswith("trigger_")]
    window = float(vocab.WINDOW_HOURS)
    missing = {"recipe_ingredients_missing", "recipe_ingredient_count_missing", "recipe_nutrition_missing",
               "recipe_minutes_missing", "recipe_step_count_missing"}
    cols = [z(c).alias(c) for c in vocab.LEGACY_FLAGS]
    cols += [slot[s].alias(s) for s in vocab.NUTRITION_SLOTS]
    cols += [z("_risk_mean_personal_risk").alias("personal_risk_mean"), z("_risk_max_personal_risk").alias("personal_risk_max"),
             z("_risk_mean_personal_confidence").alias("personal_confidence_mean"),
             z("recent_symptom_max").alias("recent_symptom_severity"), z("_cat").alias("catalog_recipe_present")]
    cols += [z(c, 1.0).alias(c) for c in sorted(missing)]
    cols += [slot["calories"].alias("recipe_calories")]
    cols += [slot[s].alias(f"recipe_{s}_pdv") for s in vocab.NUTRITION_SLOTS[1:]]
    cols += [z(c).alias(c) for c in ("recipe_minutes", "recipe_ingredient_count", "recipe_step_count", *groups)]
    cols += [z("_risk_score").alias("ingredient_risk_score"), z("_risk_confidence").alias("ingredient_risk_confidence"),
             z("_risk_personal_match_count").alias("personal_risk_match_count"),
             z("_risk_personal_coverage").alias("personal_risk_coverage")]
    cols += [z(c).alias(c) for c in ("recent_symptom_max", "recent_symptom_mean", "recent_positive_report_count",
                                     "recent_meal_count")]
    cols += [num.clamp01(F.col(c)).alias(c) for c in ("recent_no_symptom_fraction", "recent_trigger_load")]
    for c in ("hours_since_last_symptom", "hours_since_last_meal"):
        cols += [z(c, window).alias(c), z(f"{c}_missing", 1.0).alias(f"{c}_missing")]
    for name, value in logged.items():
        cols += [F.coalesce(value, F.lit(0.0)).alias(name), yes(value.isNull()).alias(f"{name}_missing")]
    cols += [yes(family == f).alias(f"portion_unit_{f}") for f in (*vocab.UNIT_FAMILIES, "other", "unknown")]
    cols += [sin.alias("time_of_day_sin"), cos.alias("time_of_day_cos")]
    return full.select(*dict.fromkeys(keep), *cols)


def heuristic_risk(ingredient: Column | None = None) -> Column:
    """Weighted sum over the feature row."""
    ingredient = F.col("ingredient_risk_score") if ingredient is None else ingredient
    part = lambda c, full: num.clamp01(F.col(c) / full)
    return num.clamp01(
        0.08 + 0.52 * ingredient + 0.12 * part("recipe_fat_pdv", 40.0) + 0.08 * part("recipe_calories", 700.0)
        + 0.10 * part("trigger_group_count", 4.0) + 0.06 * num.clamp01(F.col("recent_symptom_max"))
        + 0.04 * num.clamp01(F.col("recent_trigger_load")))


def combined_risk(ingredient: Column, symptom: Column, wi: float = 0.4, ws: float = 0.6) -> Column:
    if wi + ws <= 0:
        wi, ws = 0.4, 0.6
    return num.clamp01((wi * ingredient + ws * symptom) / (wi + ws))


def rerank(candidates: DataFrame, risk: DataFrame | None = None, lam: float = 1.0, wi: float = 0.4, ws: float = 0.6) -> DataFrame:
    """final = preference - lambda * combined risk; ranked per user, ties by input rank `rn`, then id.

    `risk` has user_id, recipe_id, ingredient_risk, symptom_risk; without it the candidates have these themselves.
    """
    both = candidates.withColumnRenamed("rn", "_in")
    if risk is not None:
        both = both.join(risk, ["user_id", "recipe_id"])
    scored = (both.withColumn("combined_risk", combined_risk(F.col("ingredient_risk"), F.col("symptom_risk"), wi, ws))
              .withColumn("final_score", F.col("preference_score") - lam * F.col("combined_risk")))
    # Ten places: sums of the same parts in another order must not break a tie.
    w = W.partitionBy("user_id").orderBy(F.round("final_score", 10).desc(), "_in", "recipe_id")
    return scored.withColumn("rn", F.row_number().over(w)).drop("_in")


def persist_predictions(reranked: DataFrame, n: int = vocab.PREDICTION_LIMIT, model_name: str = "online_risk_rerank") -> DataFrame:
    payload = F.to_json(F.struct(
        "preference_score", F.col("ingredient_risk").alias("ingredient_risk_score"),
        F.col("symptom_risk").alias("symptom_risk_score"), F.col("combined_risk").alias("combined_risk_score"),
        *(["matched"] if "matched" in reranked.columns else [])))
    return reranked.where(F.col("rn") <= n).select(
        "user_id", "recipe_id", F.lit(model_name).alias("model_name"), F.lit("online_rerank").alias("prediction_type"),
        F.col("final_score").alias("score"), payload.alias("features"))


def coldstart_questionnaire(answers: DataFrame, catalog: DataFrame,
                            questions: Mapping[str, tuple[Sequence[str], float]] = vocab.QUESTIONS) -> DataFrame:
    """Starter risks of every user for the whole catalog; the strongest answered question of a group wins."""
    spark = answers.sparkSession
    rows = [(q, g, w) for q, (groups, w) in questions.items() for g in groups]
    table = spark.createDataFrame(rows, "question string, trigger_group string, weight double")
    graded = (answers.join(F.broadcast(table), "question").where(F.col("value").isNotNull())
              .withColumn("grade", F.round(num.clamp01(F.col("value") / 3.0) * F.col("weight"), 4))
              .groupBy("user_id", "trigger_group").agg(F.max("grade").alias("grade")))
    groups = catalog.select("trigger_group").distinct()
    per = (answers.select("user_id").distinct()
           .withColumn("trigger_group", F.explode(groups.agg(F.collect_set("trigger_group")).scalar()))
           .join(graded, ["user_id", "trigger_group"], "left"))
    return per.join(catalog.select("ingredient_name", "trigger_group"), "trigger_group").select(
        "user_id", "ingredient_name", "trigger_group", F.coalesce("grade", F.lit(0.0)).alias("grade"),
        F.when(F.col("grade").isNull(), 0.05).otherwise(0.35).alias("confidence"),
        F.when(F.col("grade").isNull(), 0).otherwise(1).cast("long").alias("evidence_count"))
