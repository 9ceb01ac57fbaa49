"""Phrase matching as equi-joins, hard restrictions, trigger groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import text as tx
from .catalog import recipe_ingredients


def alias_frame(spark: SparkSession, aliases: Mapping[str, Sequence[str]], key: str = "key") -> DataFrame:
    rows = [(k, p) for k, phrases in aliases.items() for p in phrases]
    return spark.createDataFrame(rows, f"{key} string, phrase string")


#: First tokens or letter grams that are sent along with every text at most; with more, texts meet them in a join.
PRUNE = 20_000


def _known(df: DataFrame, col: str):
    """The distinct values as one array, null if there are more than PRUNE: a scalar column."""
    some = df.select(F.col(col).alias("_v")).where("_v is not null").distinct().limit(PRUNE + 1)
    return some.agg(F.when(F.count(F.lit(1)) <= PRUNE, F.collect_list("_v"))).scalar()


def _only(values: str, known: str):
    """Distinct values that are known, or all of them where what is known is too much to be sent along."""
    return F.when(F.col(known).isNull(), F.array_distinct(values)).otherwise(F.array_intersect(values, known))


def phrase_hits(texts: DataFrame, phrases: DataFrame, text_col: str, phrase_col: str = "phrase") -> DataFrame:
    """Rows of `texts` joined to the phrases their text contains, token-bounded.

    Phrases are indexed by their first token.  Of a text only the tokens that begin some phrase leave it; at their places it is
    cut to the lengths of the phrases that begin so, and these pieces meet the phrases by equality.  Null and
    empty texts and phrases match nothing.
    """
    tokens = F.split(phrase_col, " ")
    index = (phrases.where(F.col(phrase_col) != "").select(tokens[0].alias("_first"), F.size(tokens).alias("_k")).distinct()
             .groupBy("_first").agg(F.collect_list("_k").alias("_sizes")))
    begun = (texts.withColumn("_known", _known(phrases.where(F.col(phrase_col) != "").select(tokens[0].alias("_first")), "_first"))
             .withColumn("_tok", F.split(text_col, " ")).withColumn("_first", F.explode(_only("_tok", "_known"))).drop("_known")
             .join(index, "_first"))
    pieces = F.expr("array_distinct(flatten(transform(filter(sequence(1, size(_tok)), i -> _tok[i - 1] = _first), i -> transform("
                    "filter(_sizes, k -> i + k - 1 <= size(_tok)), k -> array_join(slice(_tok, i, k), ' ')))))")
    cut = begun.withColumn("_gram", F.explode(pieces)).where("_gram != ''").drop("_first", "_tok", "_sizes")
    return cut.join(phrases, cut["_gram"] == phrases[phrase_col]).drop("_gram")


def bidirectional_hits(left: DataFrame, right: DataFrame, tokenized: bool = True) -> DataFrame:
    """(left_id, right_id) where one text contains the other; texts are normalized and not blank."""
    a = left.select("left_id", F.col("text").alias("lt")).where("lt != ''")
    b = right.select("right_id", F.col("text").alias("rt")).where("rt != ''")
    if tokenized:
        one = phrase_hits(a, b, "lt", "rt")
        two = phrase_hits(b, a, "rt", "lt")
    else:
        one = _substring_hits(a, b, "lt", "rt")
        two = _substring_hits(b, a, "rt", "lt")
    return one.select("left_id", "right_id").unionByName(two.select("left_id", "right_id")).distinct()


#: Letters of the grams that texts and needles meet by.
GRAM = 3


def _grams(text: str, size: str):
    """All runs of `size` letters, each once."""
    return F.expr(f"array_distinct(transform(sequence(1, greatest(1, length({text}) - {size} + 1)), i -> substring({text}, i, {size})))")


def _substring_hits(texts: DataFrame, needles: DataFrame, text_col: str, needle_col: str) -> DataFrame:
    """Substring containment: a needle is indexed by that of its grams of three letters that fewest texts have (shorter needles by
    themselves); texts that have the gram are compared with the needle.  A text gives no more pieces than it has letters,
    three times at most, whatever the needles' lengths."""
    size = F.least(F.lit(GRAM), F.length(needle_col))
    own = needles.where(F.length(needle_col) > 0).select(F.col(needle_col).alias("_needle")).distinct().withColumn("_size", F.least(F.lit(GRAM), F.length("_needle")))
    marks = own.select("_needle", F.explode(_grams("_needle", "_size")).alias("_gram"))
    sizes = needles.agg(F.collect_set(size)).scalar()
    pieces = F.expr(f"flatten(transform(filter(_sizes, k -> k > 0 and k <= length({text_col})), k -> transform(sequence(1, length({text_col}) - k + 1), "
                    f"i -> substring({text_col}, i, k))))")
    cut = (texts.withColumn("_sizes", sizes).withColumn("_known", _known(marks, "_gram")).withColumn("_pieces", pieces)
           .withColumn("_gram", F.explode(_only("_pieces", "_known"))).drop("_sizes", "_pieces", "_known"))
    held = cut.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = marks.join(held, "_gram", "left").groupBy("_needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
    index = needles.join(rarest.select("_needle", F.col("_r._gram").alias("_rare")), F.col(needle_col) == F.col("_needle"))
    met = cut.join(index, F.col("_gram") == F.col("_rare")).where(F.contains(text_col, needle_col))
    return met.drop("_gram", "_rare", "_needle")


def expand_names(df: DataFrame, name_col: str, aliases: Mapping[str, Sequence[str]] = vocab.RESTRICTION_ALIASES,
                 masked_names: Sequence[str] = vocab.MASKED_RESTRICTIONS) -> DataFrame:
    """Add `phrase` (the name and its aliases) and `masked` (dairy-like names look at masked text)."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    extra = F.coalesce(F.try_element_at(table, F.col(name_col)), F.array().cast("array<string>"))
    return (df.withColumn("phrase", F.explode(F.array_distinct(F.concat(F.array(F.col(name_col)), extra))))
            .withColumn("masked", F.col(name_col).isin(*masked_names)))


def two_views(dictionary: DataFrame, masks: Sequence[str] = vocab.MASK_PHRASES) -> DataFrame:
    """Every normalized text twice: as it is, and with the safe phrases masked."""
    views = F.array(
        F.struct(F.lit(False).alias("masked"), F.col("normalized_name").alias("view")),
        F.struct(F.lit(True).alias("masked"), tx.mask_phrases(F.col("normalized_name"), masks).alias("view")))
    return (dictionary.select("normalized_name", F.explode(views).alias("v"))
            .select("normalized_name", "v.masked", "v.view"))


def name_hits(dictionary: DataFrame, names: DataFrame, name_col: str, masks: Sequence[str] = vocab.MASK_PHRASES,
              aliases: Mapping[str, Sequence[str]] = vocab.RESTRICTION_ALIASES,
              masked_names: Sequence[str] = vocab.MASKED_RESTRICTIONS) -> DataFrame:
    """Directional restriction rule: rows of `names` with every dictionary text they match."""
    wanted = expand_names(names.where(F.col(name_col) != ""), name_col, aliases, masked_names)
    views = two_views(dictionary, masks).withColumnRenamed("masked", "_m")
    hits = phrase_hits(views, wanted, "view")
    return hits.where(F.col("_m") == F.col("masked")).drop("_m", "view", "phrase", "masked").distinct()


def strict_restrictions(restrictions: DataFrame) -> DataFrame:
    """user_id, name (normalized) of the restrictions that filter hard.

    Without an is_strict column the flag counts as true; an explicit null is false.
    """
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce("restriction_type", F.lit("")))), "[- ]", "_")
    if "is_strict" not in restrictions.columns:
        strict = F.lit(True)
    elif dict(restrictions.dtypes)["is_strict"] == "string":
        strict = F.coalesce(F.lower(F.trim("is_strict")).isin(*vocab.STRICT_TEXT), F.lit(False))
    else:
        strict = F.coalesce(F.col("is_strict").cast("boolean"), F.lit(False))
    given = F.when(F.coalesce("normalized_name", F.lit("")) != "", F.col("normalized_name")).otherwise(
        F.col("ingredient_name"))
    return (restrictions.where(kind.isin(*vocab.STRICT_TYPES) | strict)
            .select("user_id", tx.normalize_ingredient(given).alias("name")).distinct())


def hard_filter(candidates: DataFrame, recipes: DataFrame, restrictions: DataFrame, **rule) -> DataFrame:
    """Drop what a strict restriction forbids.  Fails closed: a user with a strict restriction gets
    no recipe without ingredients, and a blank restricted name drops all recipes of that user.

    `rule`: masks, aliases, masked_names of `name_hits`.
    """
    strict = strict_restrictions(restrictions)
    rows = recipe_ingredients(recipes)
    dictionary = rows.select("normalized_name").distinct()
    names = strict.where("name != ''").select("name").distinct()
    hits = name_hits(dictionary, names, "name", **rule)
    # One row per recipe and per user: a candidate meets both once, however many names they hold.
    per_recipe = rows.join(hits, "normalized_name", "left").groupBy("recipe_id").agg(F.collect_set("name").alias("_has"))
    per_user = strict.groupBy("user_id").agg(F.collect_set("name").alias("_bars"))
    barred = F.array_contains("_bars", "") | F.coalesce(F.arrays_overlap("_bars", "_has"), F.lit(True))
    return (candidates.join(per_user, "user_id", "left").join(per_recipe, "recipe_id", "left")
            .where(F.col("_bars").isNull() | ~barred).select(*candidates.columns))


def ingredient_groups(dictionary: DataFrame, aliases: Mapping[str, Sequence[str]] = vocab.GROUP_ALIASES,
                      flour_markers: Sequence[str] = vocab.FLOUR_MARKERS,
                      flour_dropped: Sequence[str] = vocab.FLOUR_DROPPED,
                      dairy_markers: Sequence[str] = vocab.DAIRY_MARKERS) -> DataFrame:
    """normalized_name -> sorted array of the trigger groups it belongs to."""
    spark = dictionary.sparkSession
    table = {g: list(p) for g, p in aliases.items()}
    if vocab.DAIRY_GROUP in table:
        table[vocab.DAIRY_GROUP] += list(vocab.DAIRY_BARE)
    # Two fixed flags travel with each alias, decided before normalizing.
    rows = [(g, p, g == vocab.FLOUR_GROUP and p in flour_dropped, g == vocab.DAIRY_GROUP)
            for g, ps in table.items() for p in ps]
    phrases = (spark.createDataFrame(rows, "grp string, raw string, flour boolean, masked boolean")
               .withColumn("phrase", tx.normalize_ingredient(F.col("raw"))))
    other_flour = F.lit(False)
    for m in flour_markers:
        other_flour = other_flour | tx.has_phrase(F.col("normalized_name"), tx.normalize_ingredient(F.lit(m)))
    views = (two_views(dictionary, dairy_markers).withColumnRenamed("masked", "_m")
             .withColumn("_other_flour", other_flour))
    hits = phrase_hits(views, F.broadcast(phrases), "view").where(  # as long as the alias table in code
        (F.col("_m") == F.col("masked")) & ~(F.col("flour") & F.col("_other_flour")))
    return hits.groupBy("normalized_name").agg(F.array_sort(F.collect_set("grp")).alias("groups"))


def trigger_profile(recipes: DataFrame, aliases: Mapping[str, Sequence[str]] = vocab.GROUP_ALIASES) -> DataFrame:
    """Counts per trigger group and overall, one row per recipe."""
    rows = recipe_ingredients(recipes)
    groups = ingredient_groups(rows.select("normalized_name").distinct(), aliases)
    tagged = rows.join(groups, "normalized_name", "left")
    sums = [F.sum(F.coalesce(F.array_contains("groups", g), F.lit(False)).cast("long")).alias(f"trigger_{g}_count")
            for g in aliases]
    agg = tagged.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("_n"), F.count("groups").alias("_hit"), *sums)
    full = recipes.select("recipe_id").join(agg, "recipe_id", "left")
    count = lambda g: F.coalesce(F.col(f"trigger_{g}_count"), F.lit(0))
    present = [(count(g) > 0).cast("long") for g in aliases]
    total = present[0]
    for p in present[1:]:
        total = total + p
    hit = F.coalesce("_hit", F.lit(0))
    return full.select(
        "recipe_id", total.alias("trigger_group_count"), hit.alias("trigger_ingredient_count"),
        F.coalesce(F.try_divide(hit.cast("double"), F.col("_n")), F.lit(0.0)).alias("trigger_ingredient_fraction"),
        *[c for g, p in zip(aliases, present)
          for c in (p.alias(f"trigger_{g}_present"), count(g).alias(f"trigger_{g}_count"))])


def alias_matches(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every catalog ingredient whose alias, bare or with s / es, occurs in the text (id, text)."""
    words = catalog.select("ingredient_name", F.explode(F.concat(
        F.array(F.col("ingredient_name")), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    base = words.select("ingredient_name", tx.normalize_text(F.col("a")).alias("a")).where("a != ''")
    phrases = base.select("ingredient_name", F.explode(F.array(
        F.col("a"), F.concat("a", F.lit("s")), F.concat("a", F.lit("es")))).alias("phrase")).distinct()
    clean = texts.select("id", tx.normalize_text(F.col("text")).alias("_text"))
    return phrase_hits(clean, phrases, "_text").select("id", "ingredient_name").distinct()


def annotate_gentle(pairs: DataFrame, recipes: DataFrame, easier: DataFrame) -> DataFrame:
    """Flag (user, recipe) pairs whose recipe has an ingredient that contains, or is part of, an
    easier food of the user."""
    rows = recipes.select("recipe_id", F.explode("ingredients").alias("x")).select(
        "recipe_id", tx.normalize_text(F.col("x"), keep_hyphen=False).alias("text")).where("text != ''")
    foods = easier.select("user_id", tx.normalize_text(F.col("name"), keep_hyphen=False).alias("food")).where(
        "food != ''").distinct()
    hits = bidirectional_hits(rows.select(F.col("text").alias("left_id"), "text").distinct(),
                              foods.select(F.col("food").alias("right_id"), F.col("food").alias("text")).distinct(),
                              tokenized=False)
    recipe_food = (rows.join(hits, rows["text"] == hits["left_id"])
                   .select("recipe_id", F.col("right_id").alias("food")).distinct())
    per_recipe = recipe_food.groupBy("recipe_id").agg(F.collect_set("food").alias("_has"))
    per_user = foods.groupBy("user_id").agg(F.collect_set("food").alias("_wants"))
    return pairs.join(per_recipe, "recipe_id", "left").join(per_user, "user_id", "left").select(
        "user_id", "recipe_id", F.coalesce(F.arrays_overlap("_has", "_wants"), F.lit(False)).alias("is_gentle"))
