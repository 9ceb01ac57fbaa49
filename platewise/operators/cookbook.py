"""Cookbook lists: memberships, saved recipes, cookbook picks, account erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import vocab
from ..functions import numbers as num
from .ranking import minmax
from .risk import combined_risk

EPOCH = "1970-01-01 00:00:00"


def cookbook_memberships(rows: DataFrame) -> DataFrame:
    """One row per (user, recipe): list count and, field by field, the newest value that is not blank."""
    at = F.coalesce("created_at", F.lit(EPOCH).cast("timestamp"))
    keyed = rows.where(F.coalesce("recipe_id", F.lit("")) != "").withColumn("_at", F.struct(at.alias("t"), F.col("id")))
    newest = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("_at"))).alias(c)
    agg = keyed.groupBy("user_id", "recipe_id").agg(
        *[newest(c) for c in ("recipe_title", "recipe_source", "ingredients")],
        F.max("_at.t").alias("latest_at"), F.count(F.lit(1)).alias("cooklist_count"))
    return agg.select("user_id", "recipe_id", F.coalesce("recipe_title", "recipe_id").alias("recipe_title"),
                      F.coalesce("recipe_source", F.lit("catalog")).alias("recipe_source"), "ingredients",
                      "latest_at", "cooklist_count")


def is_personal() -> Column:
    return (F.col("recipe_source") == "personal") | F.col("recipe_id").startswith("personal-")


def personal_score(items: DataFrame, now: str) -> DataFrame:
    """Recency, list count and risk of personal recipes, with the reason shown."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("latest_at")) / 8.64e10)
    fresh = num.clamp01(1.0 - age / 45.0)
    often = num.clamp01(F.when(F.col("cooklist_count") == 0, 1).otherwise(F.coalesce("cooklist_count", F.lit(1))) / 3.0)
    risk = F.col("combined_risk")
    raw = num.clamp01(0.55 * fresh + 0.20 * often + 0.25 * (1.0 - risk))
    reason = (F.when(risk <= 0.25, "Gentler personal pick").when(fresh >= 0.75, "Recently saved")
              .when(often >= 0.65, "Saved in multiple cooklists").otherwise("From your personal recipes"))
    return items.withColumn("score", 0.78 + 0.20 * raw).withColumn("reason", reason)


def client_score(items: DataFrame, now: str) -> DataFrame:
    """The offline form, without risk."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("latest_at")) / 8.64e10)
    fresh = F.greatest(F.lit(0.0), 1 - age / 45)
    often = F.least(F.lit(1.0), F.col("cooklist_count") / 3)
    reason = (F.when(F.col("cooklist_count") > 1, "Saved in multiple cooklists")
              .when(is_personal(), "Personal recipe").otherwise("Saved recipe"))
    return items.withColumn("score", 0.78 + 0.2 * (0.72 * fresh + 0.28 * often)).withColumn("reason", reason)


def cookbook_recommend(items: DataFrame, preference: DataFrame, risk: DataFrame, now: str,
                       n: int = vocab.COOKBOOK_LIMIT, lam: float = 1.0) -> DataFrame:
    """Top n saved recipes per user.

    `items` as in `cookbook_memberships`, already cut by `hard_filter`; `preference`: user_id,
    recipe_id, score; `risk`: user_id, recipe_id, ingredient_risk, symptom_risk for both kinds.
    """
    full = items.join(risk, ["user_id", "recipe_id"]).withColumn(
        "combined_risk", combined_risk(F.col("ingredient_risk"), F.col("symptom_risk")))
    mine = personal_score(full.where(is_personal()), now).withColumn("source", F.lit("personal"))
    shop = (full.where(~is_personal()).join(preference.select("user_id", "recipe_id", F.col("score").alias("_p")),
                                            ["user_id", "recipe_id"], "left")
            .withColumn("_p", F.coalesce("_p", F.lit(0.0))).withColumn("final", F.col("_p") - lam * F.col("combined_risk")))
    shop = minmax(shop, ["user_id"], "final").withColumn("score", F.col("match_score")).withColumn(
        "reason", F.when(F.col("combined_risk") <= 0.25, "Gentler saved pick").when(F.col("_p") >= 0, "Matches your taste")
        .otherwise("From your saved recipes")).withColumn("source", F.lit("catalog"))
    cols = ["user_id", "recipe_id", "source", "score", "reason", "latest_at"]
    w = W.partitionBy("user_id").orderBy(F.round("score", 9).desc(), F.col("latest_at").desc(), "recipe_id")
    both = mine.select(*cols).unionByName(shop.select(*cols))
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select(
        "user_id", "rn", "recipe_id", "source", "score", "reason")


def title_exists(titles: DataFrame, cookbook: DataFrame) -> DataFrame:
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    have = cookbook.select("user_id", key(F.col("recipe_title")).alias("_k")).distinct().withColumn("_f", F.lit(True))
    return (titles.withColumn("_k", key(F.col("title"))).join(have, ["user_id", "_k"], "left")
            .select("user_id", "title", (F.col("_f").isNotNull() & (F.col("_k") != "")).alias("found")))


def orphaned_saved(memberships: DataFrame, deleted: DataFrame) -> DataFrame:
    """Catalog recipes of deleted lists that no other list of the user holds."""
    keys = ["user_id", "cooklist_id"]
    gone = memberships.join(deleted.select(*keys), keys, "left_semi").where(~is_personal())
    kept = memberships.join(deleted.select(*keys), keys, "left_anti")
    pair = ["user_id", "recipe_id"]
    return gone.select(*pair).distinct().join(kept.select(*pair), pair, "left_anti")


def membership_replace(memberships: DataFrame, interactions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set the lists of changed recipes and refresh their one saved interaction.

    `changes`: user_id, recipe_id, recipe_title, cooklist_ids, changed_at; an empty set removes both.
    """
    pair = ["user_id", "recipe_id"]
    lists = F.array_distinct(F.col("cooklist_ids"))
    added = changes.select(*pair, "recipe_title", F.explode(lists).alias("cooklist_id"))
    cols = ["user_id", "recipe_id", "recipe_title", "cooklist_id"]
    new_lists = memberships.join(changes.select(*pair), pair, "left_anti").select(*cols).unionByName(added.select(*cols))
    saved = F.col("interaction_type").isin("saved", "save")
    touched = changes.select(*pair).distinct().withColumn("_t", F.lit(True))
    rest = interactions.join(touched, pair, "left").where(~(saved & F.col("_t").isNotNull()) | F.col("_t").isNull())
    icols = ["user_id", "recipe_id", "interaction_type", "created_at"]
    fresh = changes.where(F.size("cooklist_ids") > 0).select(*pair, F.lit("saved").alias("interaction_type"),
                                                             F.col("changed_at").alias("created_at"))
    return new_lists, rest.select(*icols).unionByName(fresh.select(*icols))


def delete_user_cascade(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """Erase the users' rows everywhere; profiles stay, with only their identity columns filled."""
    gone = user_ids.select("user_id").distinct()
    keep = ("user_id", "email", "full_name", "avatar_url")
    out = {}
    for name, df in tables.items():
        rest = df.join(gone, "user_id", "left_anti")
        if name == "profiles":
            clean = df.join(gone, "user_id", "left_semi").select(*[
                F.col(c) if c in keep else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
            rest = rest.unionByName(clean)
        out[name] = rest
    return out
