"""Rating, ranking, risk and classifier metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def rmse(scored: DataFrame) -> DataFrame:
    """Null predictions are ignored; no prediction at all gives null."""
    ok = F.col("pred").isNotNull() & ~F.isnan("pred")
    return scored.where(ok).agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("pred"), 2))).alias("rmse"))


def _hits(ranked: DataFrame, test: DataFrame, k: int, liked: float) -> tuple[DataFrame, DataFrame]:
    good = test.where(F.col("rating") >= liked).select("user_id", "recipe_id").distinct()
    top = ranked.where(F.col("rn") <= k).select("user_id", "recipe_id", "rn")
    return good, top.join(good, ["user_id", "recipe_id"])


def precision_at_k(ranked: DataFrame, test: DataFrame, k: int = 10, liked: float = 4.0) -> DataFrame:
    """Mean of hits / k over users with a liked test item."""
    good, hits = _hits(ranked, test, k, liked)
    per = (good.select("user_id").distinct()
           .join(hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("h")), "user_id", "left"))
    return per.agg(F.avg(F.coalesce("h", F.lit(0)) / F.lit(float(k))).alias("precision_at_k"))


def ranking_extra(ranked: DataFrame, test: DataFrame, catalog: DataFrame, k: int = 10, liked: float = 4.0) -> DataFrame:
    """Recall, NDCG and MAP at k over users with liked items, and the share of the catalog shown."""
    good, hits = _hits(ranked, test, k, liked)
    ideal = "aggregate(sequence(1, least({k}, n)), 0D, (a, i) -> a + 1D / log2(i + 1D))".format(k=k)
    sizes = good.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("idcg", F.expr(ideal))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("rn"))
    gain = (hits.withColumn("i", nth).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("h"), F.sum(1.0 / F.log2(F.col("rn") + 1.0)).alias("dcg"),
                 F.sum(F.col("i") / F.col("rn")).alias("ap")))
    per = sizes.join(gain, "user_id", "left")
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    shown = ranked.where(F.col("rn") <= k).agg(F.countDistinct("recipe_id")).scalar()
    size = catalog.agg(F.countDistinct("recipe_id")).scalar()
    out = per.agg(F.avg(z("h") / F.col("n")).alias("recall"), F.avg(z("dcg") / F.col("idcg")).alias("ndcg"),
                  F.avg(z("ap") / F.least(F.lit(k), F.col("n"))).alias("map"))
    return out.withColumn("coverage", F.try_divide(shown.cast("double"), size))


def risk_exposure(ranked: DataFrame, k: int = 10, high: float = 0.55) -> DataFrame:
    """Mean risk of the top k, number of high-risk rows, mean preference of the low-risk rows."""
    return ranked.where(F.col("rn") <= k).agg(
        F.avg("combined_risk").alias("mean_risk"), F.count_if(F.col("combined_risk") >= high).alias("n_high"),
        F.avg(F.when(F.col("combined_risk") < 0.25, F.col("preference_score"))).alias("pref_low"))


def compare_models(metrics: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row per model, best RMSE first."""
    out = None
    for name, (r, p) in metrics.items():
        row = r.select(F.lit(name).alias("model"), "rmse").withColumn("precision_at_k", p.scalar())
        out = row if out is None else out.unionByName(row)
    return out.orderBy("rmse")


def classifier_metrics(scored: DataFrame) -> DataFrame:
    """AUC (rank form, null unless both classes occur), log loss and Brier score of (label, p).

    Ranks come from counts per distinct score, cumulated over score bins and then within the bin.
    """
    eps = 1e-15
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("p")))
    y = F.col("label").cast("double")
    base = scored.agg(
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.avg(F.pow(F.col("p") - y, 2)).alias("brier"),
        F.sum(y).alias("_np"), F.sum(1 - y).alias("_nn"))
    per = (scored.groupBy("p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
           .withColumn("bin", F.floor(F.col("p") * 4096)))
    bins = per.groupBy("bin").agg(F.sum("neg").alias("bneg"))
    below = bins.select("bin", (F.sum("bneg").over(W.orderBy("bin")) - F.col("bneg")).alias("off"))
    within = F.sum("neg").over(W.partitionBy("bin").orderBy("p")) - F.col("neg")
    wins = (per.join(below, "bin").withColumn("lower", F.col("off") + within)
            .agg(F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2))).scalar())
    return base.select(F.try_divide(wins, F.col("_np") * F.col("_nn")).alias("auc"), "log_loss", "brier")
