"""Top-n lists, category rows, wide rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import vocab
from ..functions.timeline import numbered
from ..session import write_and_read
from .ratings import kept_pairs


def topn(scores: DataFrame, n: int = vocab.CANDIDATE_LIMIT) -> DataFrame:
    """Best n recipes per user; the limit is applied before the shuffle as well."""
    w = W.partitionBy("user_id").orderBy(F.col("preference_score").desc(), "recipe_id")
    return scores.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select(
        "user_id", "rn", "recipe_id", "preference_score")


def minmax(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Per list into .78 - .98; a flat list gets .9."""
    bounds = scored.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    match = F.when(span == 0, 0.9).otherwise((F.col(score) - F.col("_lo")) / span * 0.2 + 0.78)
    return scored.join(bounds, keys).withColumn("match_score", match).drop("_lo", "_hi")


def minmax_window(keys: list[str], score: Column) -> Column:
    """The same over short lists that are already placed by key."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, 0.9).otherwise((score - lo) / (hi - lo) * 0.2 + 0.78)


def topk_with_backfill(candidates: DataFrame, catalog: DataFrame, users: DataFrame, excluded: DataFrame,
                       k: int = vocab.ROW_SIZE, pad_score: float = 3.0) -> DataFrame:
    """First k candidates; short lists are filled from the catalog in its order, empty ones start it over.

    Catalog entries are numbered.  If a user's skipped positions in order are s(1) < s(2) < ..., then
    s(i) - i free entries lie before s(i), so the f-th free entry is at f + #{i: s(i) - i < f}.  The
    fill is thus counted, however long a user's exclusion list is, and no user meets the catalog.
    """
    grain = F.floor(F.col("recipe_id") / 65536)
    cat = numbered(catalog.select("recipe_id").distinct(), [], [F.col("recipe_id")], grain, "_pos")
    head = candidates.where(F.col("rn") <= k).select("user_id", "rn", "recipe_id", F.col("preference_score").alias("score"))
    have = users.select("user_id").distinct().join(
        head.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")), "user_id", "left").fillna(0, ["_n"])
    short = have.where(F.col("_n") < k)
    skip = (excluded.select("user_id", "recipe_id").unionByName(head.select("user_id", "recipe_id")).distinct()
            .join(short.select("user_id"), "user_id", "left_semi").join(cat, "recipe_id").select("user_id", "_pos"))
    ranked = numbered(skip, ["user_id"], [F.col("_pos")], F.floor(F.col("_pos") / 65536), "_i")
    jumps = ranked.groupBy("user_id").agg(*[
        F.count_if(F.col("_pos") - F.col("_i") < f).alias(f"_j{f}") for f in range(1, k + 1)])
    slots = F.array(*[F.struct(F.lit(f).alias("f"), (F.coalesce(F.col(f"_j{f}"), F.lit(0)) + f).alias("_pos"))
                      for f in range(1, k + 1)])
    fill = (short.join(jumps, "user_id", "left").select("user_id", "_n", F.explode(slots).alias("s"))
            .select("user_id", (F.col("_n") + F.col("s.f")).cast("int").alias("rn"), F.col("s._pos").alias("_pos"))
            .where(F.col("rn") <= k).join(cat, "_pos")
            .select("user_id", "rn", "recipe_id", F.lit(pad_score).alias("score")))
    some = head.unionByName(fill)
    none = have.join(some.select("user_id").distinct(), "user_id", "left_anti")
    top = (none.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rn"))
           .withColumn("_pos", F.col("rn").cast("long")).join(cat, "_pos")
           .select("user_id", "rn", "recipe_id", F.lit(pad_score).alias("score")))
    return some.unionByName(top)


def popularity_fallback(users: DataFrame, catalog: DataFrame, n: int = vocab.CANDIDATE_LIMIT) -> DataFrame:
    """Without any rating every user gets the first n catalog entries, scored by position.

    The head has at most n rows and travels as one array.
    """
    head = (catalog.select("recipe_id").distinct().orderBy("recipe_id").limit(n)
            .withColumn("rn", F.row_number().over(W.orderBy("recipe_id"))))
    pool = head.agg(F.array_sort(F.collect_list(F.struct("rn", "recipe_id")))).scalar()
    return (users.select("user_id").distinct().withColumn("c", F.explode(pool))
            .select("user_id", "c.rn", "c.recipe_id", (n - (F.col("c.rn") - 1)).cast("double").alias("preference_score")))


#: Pairs that a task makes, about, and partitions of users at most.
PAIRS, TASKS = 1 << 26, 4096


def cross_candidates(users: DataFrame, recipes: DataFrame, excluded: DataFrame, block: int = 4096) -> DataFrame:
    """Every user with every catalog recipe, minus the excluded pairs, by catalog blocks.

    A block is one row with its recipes as an array, a user is one with the excluded recipes by block, which are taken away from the
    block's.  Users and blocks meet in every combination of their partitions, so what is shuffled is a row per user and a row
    per block; the pairs arise after that and never lie on disk.  Factor models should use their block-wise top-n instead (`preference.recommend`).
    """
    size = recipes.agg(F.countDistinct("recipe_id")).scalar()
    blocks = F.ceil(size / block)
    placed = lambda df: (df.withColumn("_nb", blocks)
                         .withColumn("_blk", F.pmod(F.xxhash64("recipe_id"), F.greatest(F.lit(1), F.col("_nb")))).drop("_nb"))
    # Structs, since lists of plain values lose a null.
    cat = (placed(recipes.select("recipe_id").distinct()).groupBy("_blk").agg(F.collect_list(F.struct("recipe_id")).alias("_ids"))
           .select("_blk", F.col("_ids.recipe_id").alias("_ids")))
    kind = recipes.schema["recipe_id"].dataType
    given = excluded.select("user_id", F.col("recipe_id").cast(kind).alias("recipe_id")).where("user_id is not null and recipe_id is not null")
    barred = (placed(given).groupBy("user_id", "_blk").agg(F.collect_set("recipe_id").alias("ids"))
              .groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("_blk", "ids"))).alias("_barred")))
    # Written, as every partition of users reads all blocks; users are few bytes for the pairs they make, so tasks go by pairs.
    cat = write_and_read(cat, "cross-blocks")
    left = write_and_read(users.select("user_id").distinct().join(barred, "user_id", "left"), "cross-users")
    tasks = -(-left.count() * (cat.agg(F.sum(F.size("_ids"))).first()[0] or 0) // PAIRS)
    left = left.repartition(max(1, min(TASKS, tasks)))
    taken = F.try_element_at("_barred", F.col("_blk"))
    free = F.when(taken.isNull(), F.col("_ids")).otherwise(F.array_except("_ids", taken))
    return left.crossJoin(cat).select("user_id", F.explode(free).alias("recipe_id"))


ROW_ORDER = ("curated", "trending", "flavor", "healthy", "quick")


def category_rows(ranked: DataFrame, trending: DataFrame, flavor: DataFrame, recipes: DataFrame, excluded: DataFrame,
                  predicates: Mapping[str, Column] | None = None, k: int = vocab.ROW_SIZE) -> DataFrame:
    """Five rows per user, filled in order; a recipe is used once.

    `ranked`: user_id, rn, recipe_id, final_score.  `trending`: recipe_id, rn.  `flavor`: recipe_id, cosine, and
    user_id where it differs by user.  Row i can lose at most i * k entries to the rows before it, so k * (i + 1)
    entries of each source order suffice: one shuffle by user, then a fold over those few.
    """
    from .catalog import PREDICATES

    predicates = predicates or {name: PREDICATES[name]() for name in ("flavor", "healthy", "quick")}
    flags = recipes.select("recipe_id", *[p.alias(f"_is_{name}") for name, p in predicates.items()])
    # All that is known of recipes meets the candidates at once.
    of_recipe = flags.join(trending.select("recipe_id", F.col("rn").alias("_trend")), "recipe_id", "full_outer")
    if "user_id" not in flavor.columns:
        of_recipe = of_recipe.join(flavor.select("recipe_id", "cosine"), "recipe_id", "full_outer")
    pool = ranked.join(of_recipe, "recipe_id", "left").join(
        kept_pairs(excluded) if "interaction_type" in excluded.columns else excluded.select("user_id", "recipe_id").distinct(), ["user_id", "recipe_id"], "left_anti")
    if "user_id" in flavor.columns:
        pool = pool.join(flavor.select("user_id", "recipe_id", "cosine"), ["user_id", "recipe_id"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    eligible = {"curated": F.lit(True), "trending": F.lit(True),
                "flavor": yes("_is_flavor") & F.col("cosine").isNotNull(),
                "healthy": yes("_is_healthy"), "quick": yes("_is_quick")}
    orders = {"curated": [F.col("rn")], "trending": [F.col("_trend").asc_nulls_last(), F.col("rn")],
              "flavor": [F.col("cosine").desc_nulls_last(), F.col("final_score").desc(), F.col("rn")],
              "healthy": [F.col("rn")], "quick": [F.col("rn")]}
    # Each order keeps its first few before anything is shuffled; the pool is read once per order, as a table.
    slim = write_and_read(pool.select("user_id", "recipe_id", "rn", "final_score", "_trend", "cosine", *flags.columns[1:]), "row-pool")
    found = []
    for i, name in enumerate(ROW_ORDER):
        w = W.partitionBy("user_id").orderBy(*orders[name])
        found.append(slim.where(eligible[name]).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k * (i + 1)).select(
            "user_id", F.struct(F.lit(i).alias("row"), "pos", "recipe_id", F.col("final_score").alias("score")).alias("e")))
    entries = reduce(DataFrame.unionByName, found)
    lists = entries.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    kind = lists.schema["es"].dataType.simpleString()
    taken = F.aggregate(
        "es", F.array().cast(kind),
        lambda acc, e: F.when(
            F.exists(acc, lambda x: x["recipe_id"] == e["recipe_id"])
            | (F.size(F.filter(acc, lambda x: x["row"] == e["row"])) >= k), acc)
        .otherwise(F.concat(acc, F.array(e))))
    names = F.array(*[F.lit(n) for n in ROW_ORDER])
    picked = lists.select("user_id", F.posexplode(taken).alias("seq", "e"))
    w = W.partitionBy("user_id", F.col("e.row")).orderBy("seq")
    return picked.select("user_id", F.get(names, F.col("e.row")).alias("row_name"),
                         F.row_number().over(w).alias("rank"), F.col("e.recipe_id").alias("recipe_id"),
                         F.col("e.score").alias("score"))


def wide_recommendations(rows: DataFrame) -> DataFrame:
    """One row per user with parallel arrays per named row; lists are short by construction."""
    with_match = rows.withColumn("m", minmax_window(["user_id", "row_name"], F.col("score")))
    def pick(name, field):
        lst = F.array_sort(F.collect_list(F.when(F.col("row_name") == name, F.struct("rank", "recipe_id", "m", "score"))))
        return F.transform(lst, lambda x: x[field])

    ids = {"curated": "recommended_recipe_ids"}
    ms = {"curated": "match_scores"}
    return with_match.groupBy("user_id").agg(*[
        c for name in (*ROW_ORDER, "cookbook") for c in (
            pick(name, "recipe_id").cast("array<string>").alias(ids.get(name, f"{name}_recipe_ids")),
            pick(name, "m").alias(ms.get(name, f"{name}_match_scores")))],
        pick("curated", "score").alias("final_scores"))


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Concatenate two ranked lists per user, keep the first occurrence; positions are renumbered."""
    both = first.select("user_id", F.lit(0).alias("l"), "pos", "id").unionByName(
        second.select("user_id", F.lit(1).alias("l"), "pos", "id"))
    one = both.groupBy("user_id", "id").agg(F.min(F.struct("l", "pos")).alias("o"))
    w = W.partitionBy("user_id").orderBy("o", "id")
    return one.select("user_id", F.row_number().over(w).alias("pos"), "id")


def distinct_id_pool(wide: DataFrame, n: int = 80) -> DataFrame:
    """Distinct positive numeric ids over the five arrays in column order, first n."""
    fields = ("recommended_recipe_ids", "trending_recipe_ids", "flavor_recipe_ids", "healthy_recipe_ids", "quick_recipe_ids")
    parts = [F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields]
    number = lambda x: F.regexp_extract(x, r"^\s*\+?(\d+)", 1).try_cast("long")
    ids = F.array_distinct(F.filter(F.transform(F.concat(*parts), number), lambda x: x > 0))
    return wide.select("user_id", F.posexplode(F.slice(ids, 1, n)).alias("pos", "recipe_id")).withColumn(
        "pos", F.col("pos") + 1)


def lookup_ordered(id_arrays: DataFrame, recipes: DataFrame, fallback: str = "Unknown recipe") -> DataFrame:
    """Recipes in the order of the id list; a missing id gets the fallback name."""
    wanted = id_arrays.select("user_id", F.posexplode("ids").alias("pos", "recipe_id"))
    return wanted.join(recipes.select("recipe_id", "name"), "recipe_id", "left").select(
        "user_id", "pos", "recipe_id", F.coalesce("name", F.lit(fallback)).alias("name"),
        F.col("name").isNotNull().alias("found"))


def display_match(lists: DataFrame) -> DataFrame:
    """Percent strings beside ids, by position; a missing or zero score shows nothing."""
    pairs = F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.get("scores", i).alias("score")))
    pct = F.concat(F.floor(F.col("x.score") * 100 + 0.5).cast("string"), F.lit("%"))
    return lists.select("user_id", F.posexplode(pairs).alias("pos", "x")).select(
        "user_id", "pos", F.col("x.id").alias("id"),
        F.when(F.col("x.score").isNotNull() & (F.col("x.score") != 0), pct).alias("pct"))


def latest_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Newest n rows per key."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
