"""Interactions, ratings and catalog statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import vocab
from ..functions.numbers import hash_unit, is_finite


def weight_of(kind: Column, weights: Mapping[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(default))


def interactions_to_ratings(interactions: DataFrame, weights: Mapping[str, float] = vocab.INTERACTION_WEIGHTS,
                            default: float = vocab.UNKNOWN_INTERACTION_WEIGHT) -> DataFrame:
    return (interactions.groupBy("user_id", "recipe_id")
            .agg(F.max(weight_of(F.col("interaction_type"), weights, default)).alias("rating")))


def union_ratings(active: DataFrame, historical: DataFrame, prefix: str = vocab.HISTORICAL_PREFIX) -> DataFrame:
    cols = ["user_id", "recipe_id", "rating"]
    past = historical.withColumn("user_id", F.concat(F.lit(prefix), F.col("user_id").cast("string")))
    return active.select(*cols).unionByName(past.select(*cols))


def filter_training_boundary(interactions: DataFrame, trained_at: str | None) -> DataFrame:
    """Rows up to the boundary; rows without a time stay."""
    if trained_at is None or "created_at" not in interactions.columns:
        return interactions
    cut = F.lit(trained_at).cast("timestamp")
    return interactions.where(F.col("created_at").isNull() | (F.col("created_at") <= cut))


def filter_online_delta(interactions: DataFrame, learned_users: DataFrame | None, trained_at: str | None,
                        hybrid: bool = True) -> DataFrame:
    """Rows after the boundary; under the hybrid backend users without a learned vector keep all rows."""
    if not trained_at:
        return interactions
    if "created_at" not in interactions.columns:
        fresh = F.lit(False)
    else:
        fresh = F.coalesce(F.col("created_at") > F.lit(trained_at).cast("timestamp"), F.lit(False))
    if not hybrid or learned_users is None:
        return interactions.where(fresh)
    known = learned_users.select("user_id").distinct().withColumn("_known", F.lit(True))
    return (interactions.join(known, "user_id", "left")
            .where(F.col("_known").isNull() | fresh).drop("_known"))


def filter_positive_ratings(ratings: DataFrame, catalog: DataFrame, min_rating: float = vocab.HISTORICAL_MIN_RATING,
                            prefix: str = vocab.HISTORICAL_PREFIX) -> DataFrame:
    keep = is_finite(F.col("rating")) & (F.col("rating") > 0) & (
        ~F.col("user_id").startswith(prefix) | (F.col("rating") >= max(0.0, min_rating)))
    return (ratings.where(keep).join(catalog.select("recipe_id"), "recipe_id", "left_semi")
            .select("user_id", "recipe_id", F.col("rating").cast("double").alias("rating")))


def kept_pairs(interactions: DataFrame) -> DataFrame:
    return (interactions.where(F.lower("interaction_type").isin(*vocab.KEPT_TYPES))
            .select("user_id", "recipe_id").distinct())


def exclude_kept(candidates: DataFrame, interactions: DataFrame) -> DataFrame:
    """Drop (user, recipe) pairs the user saved or liked."""
    return candidates.join(kept_pairs(interactions), ["user_id", "recipe_id"], "left_anti")


def topk_subsample(ratings: DataFrame, top_recipes: int = 5000, min_user_ratings: int = 5) -> DataFrame:
    """The most rated recipes first, then users with enough ratings among them."""
    top = (ratings.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), "recipe_id").limit(top_recipes).select("recipe_id"))
    sub = ratings.join(top, "recipe_id", "left_semi")
    busy = sub.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_user_ratings)
    return sub.join(busy.select("user_id"), "user_id", "left_semi")


def user_item_mean(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id", "recipe_id").agg(F.avg("rating").alias("rating"))


def dataset_stats(ratings: DataFrame) -> DataFrame:
    base = ratings.agg(F.countDistinct("user_id").alias("n_users"),
                       F.countDistinct("recipe_id").alias("n_recipes"),
                       F.count(F.lit(1)).alias("n_ratings"))
    density = F.try_divide(F.col("n_ratings") * 100.0, F.col("n_users") * F.col("n_recipes"))
    return base.withColumn("density_pct", density).withColumn("sparsity_pct", 100.0 - density)


def item_bias(ratings: DataFrame) -> DataFrame:
    """Item mean minus global mean.  Repeated (user, item) entries add up first."""
    mean = ratings.agg(F.avg("rating")).scalar()
    cells = ratings.groupBy("recipe_id", "user_id").agg(F.sum("rating").alias("r"))
    means = cells.groupBy("recipe_id").agg(F.avg("r").alias("item_mean"))
    return (means.withColumn("global_mean", mean)
            .withColumn("bias", F.col("item_mean") - F.col("global_mean")))


def popularity_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("recipe_id").agg(
        F.count("rating").alias("review_count"),
        F.coalesce(F.var_samp("rating"), F.lit(0.0)).alias("rating_var"),
        F.avg("rating").alias("rating_mean"))


def popularity_threshold(stats: DataFrame, q: float = 0.5) -> DataFrame:
    return stats.agg(F.percentile("review_count", F.lit(q)).alias("min_reviews"))


def join_popularity(items: DataFrame, stats: DataFrame) -> DataFrame:
    return items.join(stats, "recipe_id", "left").fillna(
        0, subset=["review_count", "rating_var", "rating_mean"])


def trending(interactions: DataFrame, now: str, days: int = vocab.TRENDING_DAYS, n: int = vocab.TRENDING_LIMIT,
             kinds: Sequence[str] = vocab.POSITIVE_TYPES) -> DataFrame:
    """The n most used recipes of the last days: one partial aggregate over the whole window."""
    end = F.lit(now).cast("timestamp")
    week = interactions.where(F.col("interaction_type").isin(*kinds)
                              & (F.col("created_at") >= end - F.make_dt_interval(F.lit(days))))
    counts = week.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("cnt"), F.max("created_at").alias("newest"))
    top = counts.orderBy(F.col("cnt").desc(), F.col("newest").desc(), "recipe_id").limit(n)
    w = W.orderBy(F.col("cnt").desc(), F.col("newest").desc(), "recipe_id")
    return top.withColumn("rn", F.row_number().over(w)).select("recipe_id", "cnt", "rn")


def interaction_counts(interactions: DataFrame) -> DataFrame:
    feedback = F.col("interaction_type").isin("liked", "dismissed")
    return interactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(feedback).alias("n_feedback"))


def catalog_padding(ratings: DataFrame, catalog: DataFrame, pad_user: str = "__catalog_pad__",
                    rating: float = 3.0) -> DataFrame:
    pad = catalog.select(F.lit(pad_user).alias("user_id"), "recipe_id", F.lit(rating).alias("rating"))
    return ratings.select("user_id", "recipe_id", F.col("rating").cast("double").alias("rating")).unionByName(pad)


def dedup_keep_newest(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """One row per key, that of the largest id."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(id_col)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def latest_saved(interactions: DataFrame, lists: DataFrame) -> DataFrame:
    """Newest saved row per (user, recipe), put into the user's default list."""
    saved = interactions.where(F.col("interaction_type").isin("saved", "save"))
    newest = saved.groupBy("user_id", "recipe_id").agg(F.max("created_at").alias("created_at"))
    home = lists.where("is_default").select("user_id", "cooklist_id")
    return newest.join(home, "user_id").select("user_id", "recipe_id", "cooklist_id", "created_at")


def split_train_test(ratings: DataFrame, frac: float = 0.2, seed: int = 42) -> DataFrame:
    u = hash_unit(F.col("user_id"), F.col("recipe_id"), seed=seed)
    return ratings.withColumn("part", F.when(u < frac, "test").otherwise("train"))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """The n rows (or users) with the smallest seeded hash."""
    return (df.withColumn("_u", hash_unit(*map(F.col, keys), seed=seed)).orderBy("_u", *keys).limit(n).drop("_u"))
