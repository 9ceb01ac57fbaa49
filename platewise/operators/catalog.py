"""Catalog rows: typing, presence flags, predicates, features, categories, search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import vocab
from ..functions import numbers as num, text as tx


def project_recipe_row(raw: DataFrame) -> DataFrame:
    as_int = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    return raw.select(
        F.col("recipe_id").cast("long").alias("recipe_id"),
        tx.title_case(F.col("name")).alias("name"),
        *[as_int(c).alias(c) for c in ("minutes", "n_steps", "n_ingredients")],
        F.coalesce(F.col("description"), F.lit("")).alias("description"))


def metadata_presence(recipes: DataFrame) -> DataFrame:
    items = tx.ingredient_texts(F.col("ingredients"))
    flag = lambda c: c.cast("int")
    return recipes.select(
        "*",
        flag(F.col("minutes").isNotNull()).alias("minutes_present"),
        flag(F.col("n_steps").isNotNull()).alias("n_steps_present"),
        flag(F.col("n_ingredients").isNotNull() | (F.size(items) > 0)).alias("n_ingredients_present"),
        flag(num.nutrition_present(F.col("nutrition"))).alias("nutrition_present"),
        flag(F.size(items) > 0).alias("ingredients_present"),
        F.coalesce(F.col("is_ibs_friendly").cast("int"), F.lit(-1)).alias("friendly_state"))


def _joined(recipes: DataFrame):
    return F.lower(F.array_join(F.coalesce(F.col("ingredients"), F.array().cast("array<string>")), " "))


PREDICATES = {
    "quick": lambda minutes=vocab.QUICK_MINUTES: F.coalesce(F.col("minutes") < minutes, F.lit(False)),
    "healthy": lambda cal=vocab.HEALTHY_CALORIES, fat=vocab.HEALTHY_FAT: F.coalesce(
        (F.size("nutrition") >= 2) & (F.get("nutrition", F.lit(0)) < cal) & (F.get("nutrition", F.lit(1)) < fat),
        F.lit(False)),
    "flavor": lambda keywords=vocab.FLAVOR_KEYWORDS: tx.any_substring(_joined(None), keywords),
}


def filter_quick(recipes: DataFrame, minutes: int = vocab.QUICK_MINUTES) -> DataFrame:
    return recipes.where(PREDICATES["quick"](minutes))


def filter_healthy(recipes: DataFrame, cal: float = vocab.HEALTHY_CALORIES, fat: float = vocab.HEALTHY_FAT) -> DataFrame:
    return recipes.where(PREDICATES["healthy"](cal, fat))


def filter_flavorful(recipes: DataFrame, keywords: Sequence[str] = vocab.FLAVOR_KEYWORDS) -> DataFrame:
    return recipes.where(PREDICATES["flavor"](keywords))


def flavor_seeds(recipes: DataFrame, keywords: Sequence[str] = vocab.FLAVOR_SEEDS) -> DataFrame:
    return recipes.where(PREDICATES["flavor"](keywords)).select("recipe_id")


def flag_friendly(recipes: DataFrame, triggers: Sequence[str] = vocab.FRIENDLY_TRIGGERS) -> DataFrame:
    items = F.coalesce(F.col("ingredients"), F.array().cast("array<string>"))
    hit = F.exists(items, lambda x: tx.any_substring(F.lower(x), triggers))
    return recipes.select("recipe_id", (~hit).alias("is_ibs_friendly"))


def deterministic_match(recipes: DataFrame) -> DataFrame:
    return recipes.select("recipe_id", num.match_pct(F.col("recipe_id")).cast("long").alias("match_pct"))


def recipe_ingredients(recipes: DataFrame) -> DataFrame:
    """One row per non-blank ingredient: recipe_id, pos, ingredient_name, normalized_name."""
    return (recipes.select("recipe_id", F.posexplode(tx.ingredient_texts(F.col("ingredients")))
                           .alias("pos", "ingredient_name"))
            .withColumn("normalized_name", tx.normalize_ingredient(F.col("ingredient_name"))))


def item_features(recipes: DataFrame, max_ingredients: int | None = None) -> DataFrame:
    """Weighted feature rows of every recipe: recipe_id, feature, weight; of the first ingredients only if a limit is given."""
    clean = F.filter(F.array_distinct(F.transform(
        F.coalesce(F.col("ingredients"), F.array().cast("array<string>")), lambda x: tx.normalize_text(x))), lambda x: x != "")
    base = recipes.withColumn("_ing", clean if max_ingredients is None else F.slice(clean, 1, max_ingredients))
    entry = lambda name, weight: F.struct(name.alias("feature"), F.lit(weight).cast("double").alias("weight"))
    share = 1.0 / F.size("_ing")
    named = F.when(F.size("_ing") > 0, F.transform(
        "_ing", lambda x: F.struct(F.concat(F.lit("item:ingredient:"), x).alias("feature"),
                                   share.cast("double").alias("weight")))
    ).otherwise(F.array(entry(F.lit("item:ingredient:unknown"), 0.25)))
    fixed = [
        entry(F.concat(F.lit("item:minutes:"), num.bucket_name(F.col("minutes"), vocab.ITEM_BUCKETS["minutes"])), 0.30),
        entry(F.concat(F.lit("item:steps:"), num.bucket_name(F.col("n_steps"), vocab.ITEM_BUCKETS["steps"])), 0.20),
        entry(F.concat(F.lit("item:ingredient_count:"),
                       num.bucket_name(F.col("n_ingredients"), vocab.ITEM_BUCKETS["ingredient_count"])), 0.20),
    ]
    for i, (name, limits) in enumerate(vocab.NUTRITION_BUCKETS.items()):
        fixed.append(entry(F.concat(F.lit(f"item:nutrition:{name}:"),
                                    num.bucket_name(F.get("nutrition", F.lit(i)), limits)), 0.12))
    friendly = F.when(F.col("is_ibs_friendly").isNotNull(), F.array(entry(
        F.concat(F.lit("item:ibs_friendly:"), F.when(F.col("is_ibs_friendly"), "True").otherwise("False")), 0.15))
    ).otherwise(F.array().cast("array<struct<feature:string,weight:double>>"))
    return (base.select("recipe_id", F.explode(F.concat(named, F.array(*fixed), friendly)).alias("f"))
            .select("recipe_id", "f.feature", "f.weight"))


def macro_features(recipes: DataFrame) -> DataFrame:
    per_carb, per_cal = num.macro_ratios(F.col("nutrition"))
    return recipes.select("recipe_id", per_carb.alias("protein_to_carb_ratio"),
                          per_cal.alias("protein_to_calorie_ratio"))


def categories(recipes: DataFrame, rules: Mapping[str, Sequence[tuple[str, Sequence[str]]]]) -> DataFrame:
    """First matching category over three ordered rule lists.

    `rules` holds "specific", "general" and "meal": lists of (category, keywords).  One-word
    keywords are bounded, others are substrings.
    """
    def matcher(c, entries):
        low = F.lower(c)
        out = None
        for name, words in entries:
            single = [w for w in words if " " not in w and "-" not in w]
            hit = tx.any_substring(low, [w for w in words if w not in single])
            if single:
                hit = hit | low.rlike("(^|[^a-z0-9])(" + "|".join(single) + ")([^a-z0-9]|$)")
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return F.lit(None).cast("string") if out is None else out

    title = F.coalesce(F.col("name"), F.lit(""))
    items = F.array_join(F.coalesce(F.col("ingredients"), F.array().cast("array<string>")), " ")
    everything = F.concat_ws(" ", title, items, F.coalesce(F.col("description"), F.lit("")))
    return recipes.select("recipe_id", F.coalesce(
        matcher(title, rules["specific"]), matcher(title, rules["general"]),
        matcher(items, rules["specific"]), matcher(everything, rules["meal"]),
        matcher(items, rules["general"]), F.lit(vocab.FALLBACK_CATEGORY)).alias("category"))


def search_contains(recipes: DataFrame, queries: DataFrame, n: int = 8) -> DataFrame:
    """Case-insensitive substring search; the first n recipes by id per query.

    Each distinct text meets the catalog through its rarest character gram (three letters, or all of a
    shorter text).  Postings hold grams and ids only; the searched text is fetched for the candidates of that
    gram, and repeated texts are searched once.
    """
    hay = recipes.select("recipe_id", F.lower(F.concat_ws(
        " ", "name", F.coalesce(F.col("description"), F.lit("")),
        F.array_join(F.coalesce(F.col("ingredients"), F.array().cast("array<string>")), " "))).alias("hay"))
    qs = queries.select("query_id", F.lower(F.trim("q")).alias("q")).where(F.col("q") != "")
    texts = qs.select("q").distinct().withColumn("_k", F.least(F.lit(3), F.length("q")))
    gram = lambda c, k: F.array_distinct(F.expr(
        f"transform(sequence(1, greatest(1, length({c}) - {k} + 1)), i -> substring({c}, i, {k}))"))
    wanted = texts.select("q", F.explode(gram("q", "_k")).alias("gram"))
    sizes = texts.agg(F.collect_set("_k")).scalar()  # one to three lengths
    used_size = lambda k: F.when(F.array_contains("_sizes", k), gram("hay", str(k))).otherwise(F.array().cast("array<string>"))
    postings = (hay.withColumn("_sizes", sizes).select("recipe_id", F.explode(F.array_distinct(F.concat(
        used_size(1), used_size(2), used_size(3)))).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"))
    freq = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = wanted.join(freq, "gram").groupBy("q").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    hits = postings.join(rarest, "gram").select("q", "recipe_id").join(hay, "recipe_id").where(F.col("hay").contains(F.col("q")))
    w = W.partitionBy("q").orderBy("recipe_id")
    top = hits.select("q", "recipe_id", F.row_number().over(w).alias("rn")).where(F.col("rn") <= n)
    return qs.join(top, "q").select("query_id", "rn", "recipe_id")


def food_photos(photos: DataFrame) -> DataFrame:
    """Keep rows whose alt text names food, names nothing else, and whose URL is not blocked."""
    alt = F.lower(F.coalesce(F.col("alt"), F.lit("")))
    return photos.where((alt != "") & ~tx.blocked_image_url(F.col("url"))
                        & ~tx.any_substring(alt, vocab.NON_FOOD_TERMS) & tx.any_substring(alt, vocab.FOOD_IMAGE_TERMS))


def url_signature_dups(images: DataFrame, auto_tier: str = "auto") -> DataFrame:
    """Automatic images whose signature is used more than once, or whose URL is blocked."""
    sig = images.withColumn("signature", tx.image_signature(F.col("url")))
    auto = F.col("source_tier") == auto_tier
    uses = sig.where(auto).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    return (sig.join(uses, "signature", "left").select(
        "id", "signature", F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce(auto, F.lit(False)) & (tx.blocked_image_url(F.col("url")) | (F.coalesce("n", F.lit(0)) > 1)))
        .alias("needs_refresh")))


def diverse_titles(recipes: DataFrame, n: int) -> DataFrame:
    """First item of every three-word title key, then the others, in input order (`pos`)."""
    key = F.array_join(F.slice(F.split(tx.plain_words(F.col("name")), " "), 1, 3), " ")
    keyed = recipes.withColumn("_key", F.when(key == "", F.col("recipe_id").cast("string")).otherwise(key))
    first = keyed.groupBy("_key").agg(F.min("pos").alias("_first"))
    flagged = keyed.join(first, "_key").withColumn("_later", (F.col("pos") != F.col("_first")).cast("int"))
    top = flagged.orderBy("_later", "pos").limit(n)
    w = W.orderBy("_later", "pos")
    return top.select(F.row_number().over(w).alias("pos"), "recipe_id")


def random_pool(recipes: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Distinct recipes in seeded random order."""
    return recipes.dropDuplicates(["recipe_id"]).orderBy(num.hash_unit(F.col("recipe_id"), seed=seed), "recipe_id").limit(n)


def sync_ingredients(recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ingredients (last spelling wins) and the recipe bridge."""
    rows = recipe_ingredients(recipes).where(F.col("normalized_name") != "")
    dim = rows.groupBy("normalized_name").agg(
        F.max_by(F.trim("ingredient_name"), F.struct("recipe_id", "pos")).alias("ingredient_name"))
    bridge = rows.groupBy("recipe_id", "normalized_name").agg(
        F.max_by("ingredient_name", "pos").alias("ingredient_name")).withColumn("confidence", F.lit(1.0))
    return dim, bridge


def sync_priors(catalog: DataFrame, priors: Mapping[str, float] = vocab.GROUP_PRIORS) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in priors.items() for x in kv])
    name = tx.normalize_ingredient(F.col("ingredient_name"))
    return (catalog.withColumn("normalized_name", name)
            .where((F.col("normalized_name") != "") & (F.coalesce("trigger_group", F.lit("")) != ""))
            .select("ingredient_name", "normalized_name", "trigger_group",
                    F.coalesce(F.try_element_at(table, F.col("trigger_group")), F.lit(vocab.DEFAULT_GROUP_PRIOR))
                    .alias("population_risk_score"), F.lit(0.35).alias("confidence")))
