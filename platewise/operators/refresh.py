"""The refresh of users' recommendations: each step works on what the step before it returned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import vocab
from ..session import write_and_read
from . import context as ctx, matching, risk

#: Slices of users that are ranked one after the other at most, so that what is shuffled on the way lies on disk for one slice at a
#: time, and the candidates a slice has at least.
SLICES, SLICE_ROWS = 4, 4_000_000


def _contexts(candidates: DataFrame, meals: DataFrame, reports: DataFrame, now: str) -> DataFrame:
    """The recent context of every user of the candidates, by ref_id, settled once per user."""
    refs = candidates.select("user_id").distinct().withColumn("ref_id", F.col("user_id")).withColumn("ref_ts", F.lit(now).cast("timestamp"))
    return ctx.recent_context(refs, meals, reports)


def symptom_risk(candidates: DataFrame, recipes: DataFrame, ingredient_risk: DataFrame, meals: DataFrame, reports: DataFrame, now: str,
                 aliases: Mapping[str, Sequence[str]] = vocab.GROUP_ALIASES) -> DataFrame:
    """user_id, recipe_id, symptom_risk of every candidate as if it were eaten now.  `meals` carries a trigger_load."""
    pairs = candidates.select("user_id", "recipe_id", F.col("user_id").alias("ref_id"), F.lit(now).cast("timestamp").alias("at"))
    rows = risk.symptom_features(pairs, recipes, matching.trigger_profile(recipes, aliases), _contexts(candidates, meals, reports, now), ingredient_risk)
    return rows.select("user_id", "recipe_id", risk.heuristic_risk().alias("symptom_risk"))


def _strays(mine: DataFrame) -> DataFrame:
    """Rows whose user also has a candidate without a recipe, which counts as recipe 0: recipe 0 then meets its own risks and
    those of no recipe, for the ingredients and for the symptoms."""
    kinds = F.array(*[F.struct(F.lit(a).alias("ingredients"), F.lit(b).alias("symptoms")) for a in (False, True) for b in (False, True)])
    twice = F.coalesce(F.col("_stray"), F.lit(False)) & (F.col("recipe_id") == 0)
    out = mine.withColumn("_as", F.explode(F.when(twice, kinds).otherwise(F.slice(kinds, 1, 1))))
    bare = {"score": F.lit(risk.UNKNOWN), "matched": F.array().cast("array<string>")}
    values = {c: F.when(F.col("_as.ingredients"), v).otherwise(F.col(c)) for c, v in bare.items()}
    values |= {f"_risk_{c}": F.when(F.col("_as.symptoms"), risk.UNKNOWN if c == "score" else 0.0).otherwise(F.col(f"_risk_{c}")) for c in risk.RISK_COLUMNS}
    return out.withColumns(values)


def ranked(candidates: DataFrame, recipes: DataFrame, restrictions: DataFrame, personal: DataFrame, population: DataFrame, meals: DataFrame,
           reports: DataFrame, now: str, groups: Mapping[str, Sequence[str]] = vocab.GROUP_ALIASES, keywords: Mapping[str, float] | None = None,
           columns: Sequence[str] | None = None, **rule) -> DataFrame:
    """Candidates (user_id, recipe_id, preference_score, rn; one row a pair) without forbidden recipes, by preference minus the risks of
    their ingredients and of symptoms.  Forbidden recipes are gone before any risk is computed.

    A candidate goes to its recipe once, for all that both risks take of it, and then to its user, for the user's signals and
    context; both risks and the rank come from that one row.  The result is a written table, of `columns` only if they are named.
    """
    safe = write_and_read(matching.hard_filter(candidates, recipes, restrictions, **rule), "safe")
    known, triggers = F.col("user_id").isNotNull() & F.col("recipe_id").isNotNull(), matching.trigger_profile(recipes, groups)
    by_recipe = write_and_read(risk.recipe_features(recipes, triggers).join(risk.recipe_parts(recipes, personal, population, keywords, **rule), "recipe_id", "left"), "risk-recipes")
    context = _contexts(safe.where(known), meals, reports, now)
    strays = safe.where("user_id is not null and recipe_id is null").select("user_id", F.lit(True).alias("_stray")).distinct()
    by_user = write_and_read(context.withColumnRenamed("ref_id", "user_id").join(risk.user_signals(personal), "user_id", "left").join(strays, "user_id", "left"), "risk-users")
    some = isinstance(safe.schema["recipe_id"].dataType, T.NumericType) and not strays.isEmpty()
    beside = [c for df, key in ((safe, ""), (by_recipe, "recipe_id"), (context, "ref_id")) for c in df.columns if c not in (key, "user_id", "recipe_id", "_parts")]

    def rows(of: Column) -> DataFrame:
        met = safe.where(known & of).join(by_recipe, "recipe_id", "left").join(by_user.where(of), "user_id", "left")
        mine = risk.settled_risk(met, [*beside, "_stray"])
        full = mine.select("*", F.lit(now).cast("timestamp").alias("at"), *[F.col(c).cast("double").alias(f"_risk_{c}") for c in risk.RISK_COLUMNS])
        features = risk.feature_rows(_strays(full) if some else full, triggers.columns, (), [*safe.columns, "score", "matched"])
        return risk.rerank(features.select(*safe.columns, F.col("score").alias("ingredient_risk"), "matched", risk.heuristic_risk().alias("symptom_risk")))

    slices = max(1, min(SLICES, safe.count() // SLICE_ROWS))
    mine = F.pmod(F.xxhash64("user_id"), F.lit(slices))
    return reduce(DataFrame.unionByName, [write_and_read(rows(mine == i).select(*columns or "*"), "ranked") for i in range(slices)])
