"""Factor models, user vectors, scoring of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import numbers as num, vectors as vec
from ..functions.timeline import numbered
from ..session import ensure_checkpoint_dir, write_and_read
from .ranking import topn


def dense_ids(df: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct values with consecutive integer ids, numbered hash slice by hash slice."""
    values = df.select(col).distinct().withColumn("_slice", F.pmod(F.xxhash64(col), F.lit(4096)))
    return numbered(values, [], [F.col("_slice"), F.col(col)], F.col("_slice"), out).select(
        col, (F.col(out) - 1).cast("int").alias(out))


def _als(ratings: DataFrame, rank: int, iters: int, implicit: bool, reg: float, seed: int):
    from pyspark.ml.recommendation import ALS

    ensure_checkpoint_dir(ratings.sparkSession)
    users, items = dense_ids(ratings, "user_id", "_u"), dense_ids(ratings, "recipe_id", "_i")
    coded = ratings.join(users, "user_id").join(items, "recipe_id").select("_u", "_i", F.col("r").cast("float").alias("r"))
    model = ALS(rank=rank, maxIter=iters, regParam=reg, implicitPrefs=implicit, userCol="_u", itemCol="_i",
                ratingCol="r", seed=seed, coldStartStrategy="drop", checkpointInterval=2).fit(coded)
    wide = lambda df, ids, key: df.join(ids, df["id"] == ids[key]).select(
        ids.columns[0], F.col("features").cast("array<double>").alias("vec"))
    return wide(model.userFactors, users, "_u"), wide(model.itemFactors, items, "_i")


def fit_explicit(ratings: DataFrame, rank: int = 50, iters: int = 20, scale: tuple[float, float] = (0.0, 5.0),
                 reg: float = 0.05, seed: int = 42) -> dict[str, DataFrame]:
    """Biased factors: ALS on what the global mean and the item bias leave over.

    Returns item_factors(recipe_id, bias, vec), user_factors(user_id, bias, vec) and a one-row meta.
    """
    mean = ratings.agg(F.avg("rating").alias("global_mean"))
    bias = ratings.groupBy("recipe_id").agg((F.avg("rating") - mean.scalar()).alias("bias"))
    rest = (ratings.join(bias, "recipe_id").withColumn("_m", mean.scalar())
            .select("user_id", "recipe_id", (F.col("rating") - F.col("_m") - F.col("bias")).alias("r")))
    users, items = _als(rest, rank, iters, False, reg, seed)
    meta = mean.select("global_mean", F.lit(rank).alias("rank"), F.lit("explicit").alias("backend"),
                       F.lit(float(scale[0])).alias("low"), F.lit(float(scale[1])).alias("high"))
    return _model(items.join(bias, "recipe_id").select("recipe_id", "bias", "vec"), users, meta)


def _model(items: DataFrame, users: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """Factors are read again and again by scoring jobs, so they are tables from here on."""
    return {"item_factors": write_and_read(items, "item-factors"),
            "user_factors": write_and_read(users.select("user_id", F.lit(0.0).alias("bias"), "vec"), "user-factors"),
            "meta": write_and_read(meta, "meta")}


def predict_explicit(pairs: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """clip(mean + item bias + dot); unknown items get the mean, unknown users no dot."""
    mean, low, high = (model["meta"].select(c).scalar() for c in ("global_mean", "low", "high"))
    items = model["item_factors"].select("recipe_id", F.col("bias").alias("_ib"), F.col("vec").alias("_iv"))
    users = model["user_factors"].select("user_id", F.col("vec").alias("_uv"))
    joined = (pairs.join(items, "recipe_id", "left").join(users, "user_id", "left")
              .withColumn("_m", mean).withColumn("_lo", low).withColumn("_hi", high))
    raw = F.col("_m") + F.col("_ib") + F.coalesce(vec.dot(F.col("_uv"), F.col("_iv")), F.lit(0.0))
    pred = F.when(F.col("_ib").isNull(), F.col("_m")).otherwise(F.greatest("_lo", F.least(F.col("_hi"), raw)))
    return joined.withColumn("pred", pred).drop("_ib", "_iv", "_uv", "_m", "_lo", "_hi")


def weighted_mean_vector(df: DataFrame, keys: list[str], vec_col: str, weight: Column, out: str = "vec") -> DataFrame:
    """Weighted mean of vectors per key, as one partial aggregate (no explode over dimensions)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.select(*keys, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"), weight.alias("_w")).where("_w > 0")
    agg = [Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m")]
    grouped = rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)
    return grouped.select(*keys, vector_to_array("_m").alias(out))


def feature_projection(features: DataFrame, factors: DataFrame, entity: str, cold: DataFrame) -> DataFrame:
    """Vectors of cold entities: the weighted mean of their features' mean vectors over warm entities."""
    warm = features.join(factors.select(entity, "vec"), entity)
    per_feature = weighted_mean_vector(warm, ["feature"], "vec", F.col("weight")).withColumnRenamed("vec", "_fv")
    need = features.join(cold.select(entity).distinct(), entity, "left_semi").join(per_feature, "feature")
    return weighted_mean_vector(need, [entity], "_fv", F.col("weight"))


def zero_cold_identity(feature_rows: DataFrame, warm_ids: DataFrame) -> DataFrame:
    """Drop identity rows of entities without positives: a row is an identity row if feature = entity."""
    warm = warm_ids.select("entity").distinct().withColumn("_warm", F.lit(True))
    return (feature_rows.join(warm, "entity", "left")
            .where((F.col("feature") != F.col("entity")) | F.col("_warm").isNotNull()).drop("_warm"))


def fit_hybrid(positive: DataFrame, item_features: DataFrame, user_features: DataFrame, catalog: DataFrame,
               users: DataFrame, rank: int = 32, iters: int = 20, reg: float = 0.05, seed: int = 42) -> dict[str, DataFrame]:
    """Implicit factors for warm ids, side-feature vectors for cold ones.

    Cold users without usable features keep only the item bias, which is the scaled log count of
    positives.
    """
    weights = positive.groupBy("user_id", "recipe_id").agg(F.max("rating").alias("r"))
    uf, itf = (write_and_read(f, "als") for f in _als(weights, rank, iters, True, reg, seed))
    cold_items = catalog.select("recipe_id").distinct().join(itf, "recipe_id", "left_anti")
    cold_users = users.select("user_id").distinct().join(uf, "user_id", "left_anti")
    items = itf.unionByName(feature_projection(item_features, itf, "recipe_id", cold_items))
    everyone = uf.unionByName(feature_projection(user_features, uf, "user_id", cold_users))
    counts = weights.groupBy("recipe_id").agg(F.log1p(F.count(F.lit(1))).alias("n"))
    top = counts.agg(F.max("n")).scalar()
    bias = counts.withColumn("_top", top).select("recipe_id", (F.col("n") / F.col("_top") * 0.1).alias("bias"))
    full = (catalog.select("recipe_id").distinct().join(items, "recipe_id", "left").join(bias, "recipe_id", "left")
            .select("recipe_id", F.coalesce("bias", F.lit(0.0)).alias("bias"),
                    F.coalesce("vec", F.array_repeat(F.lit(0.0), rank)).alias("vec")))
    spark = positive.sparkSession
    meta = spark.range(1).select(F.lit(0.0).alias("global_mean"), F.lit(rank).alias("rank"), F.lit("hybrid").alias("backend"),
                                 F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    return _model(full, everyone, meta)


def recommend(item_factors: DataFrame, user_factors: DataFrame, excluded: DataFrame, n: int = vocab.CANDIDATE_LIMIT,
              block: int | None = None) -> DataFrame:
    """Exact top n of bias + dot per user (see `maxproduct`)."""
    from . import maxproduct

    return maxproduct.recommend(item_factors, user_factors, excluded, n, block or maxproduct.BLOCK)


def validate_artifact(item_factors: DataFrame, user_factors: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per rule with the number of offending rows."""
    k = meta.select("rank").scalar()
    def bad(df: DataFrame, cond: Column, name: str) -> DataFrame:
        return df.withColumn("_k", k).agg(F.count_if(cond).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")

    def repeats(df: DataFrame, key: str, name: str) -> DataFrame:
        return (df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
                .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad"))

    size = lambda: F.coalesce(F.size("vec"), F.lit(-1)) != F.col("_k")
    fin = lambda: ~(vec.all_finite(F.col("vec")) & num.is_finite(F.col("bias")))
    rows = [bad(item_factors, size(), "item_dimension"), bad(item_factors, fin(), "item_finite"),
            repeats(item_factors, "recipe_id", "item_unique"), bad(user_factors, size(), "user_dimension"),
            bad(user_factors, fin(), "user_finite"), repeats(user_factors, "user_id", "user_unique"),
            meta.agg((F.count(F.lit(1)) != 1).cast("long").alias("n_bad")).select(F.lit("meta_single").alias("check"), "n_bad")]
    if {"trained_at", "model_name"} <= set(meta.columns):
        blank = F.coalesce("trained_at", F.lit("")) == ""
        rows.append(bad(meta, blank | (F.coalesce("model_name", F.lit("")) == ""), "meta_complete"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("check", (F.col("n_bad") == 0).alias("ok"), F.col("n_bad").cast("long").alias("n_bad"))


def user_vectors(ratings: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Rating-weighted mean of item vectors per user; ratings of 0 or less and unknown items do not count."""
    known = ratings.where("rating > 0").join(item_factors.select("recipe_id", "vec"), "recipe_id")
    return weighted_mean_vector(known, ["user_id"], "vec", F.col("rating").cast("double"))


def online_strength(ratings: DataFrame, max_weight: float = vocab.ONLINE_MAX_WEIGHT,
                    full: float = vocab.ONLINE_FULL_STRENGTH) -> DataFrame:
    total = F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("rating"))), F.lit(0.0))
    cap = max(0.0, min(1.0, max_weight))
    return ratings.groupBy("user_id").agg((cap * F.least(F.lit(1.0), total / max(full, 1e-9))).alias("weight"))


def centroid(seed_ids: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Mean vector of the seeds found among the factors (one row; null without any)."""
    found = item_factors.join(seed_ids.select("recipe_id").distinct(), "recipe_id", "left_semi")
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = found.select(array_to_vector(F.col("vec").cast("array<double>")).alias("_v"))
    return rows.agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") > 0, vector_to_array("_m")).alias("vec"), "n")


def factor_scores(pairs: DataFrame, item_factors: DataFrame, user_vectors_: DataFrame, meta: DataFrame,
                  hybrid: bool = True, limit: float = vocab.ONLINE_DELTA_LIMIT) -> DataFrame:
    """Scores of requested pairs; recipes without factors drop out.

    `user_vectors_`: user_id, vec, bias (hybrid) or user_id, vec, weight (the capped online part).
    """
    mean = meta.select("global_mean").scalar()
    items = item_factors.select("recipe_id", F.col("bias").alias("_ib"), F.col("vec").alias("_iv"))
    users = user_vectors_.withColumnRenamed("vec", "_uv")
    joined = pairs.join(items, "recipe_id").join(users, "user_id", "left").withColumn("_m", mean)
    base = F.col("_m") + F.col("_ib")
    if hybrid:
        fits = F.size("_uv") == F.size("_iv")
        score = base + F.coalesce("bias", F.lit(0.0)) + F.when(fits, vec.dot(F.col("_uv"), F.col("_iv"))).otherwise(0.0)
    else:
        score = base + vec.clipped_delta(F.col("_iv"), F.col("_uv"), F.coalesce("weight", F.lit(0.0)), limit)
    return joined.select("user_id", "recipe_id", score.alias("score"))


def bounded_delta(candidates: DataFrame, item_factors: DataFrame, online: DataFrame,
                  limit: float = vocab.ONLINE_DELTA_LIMIT, n: int = vocab.CANDIDATE_LIMIT) -> DataFrame:
    """Offline score plus the capped online adjustment; unknown recipes keep their score."""
    joined = (candidates.select("user_id", "recipe_id", "preference_score").dropDuplicates(["user_id", "recipe_id"])
              .join(item_factors.select("recipe_id", F.col("vec").alias("_iv")), "recipe_id", "left")
              .join(online.select("user_id", F.col("vec").alias("_uv"), "weight"), "user_id", "left"))
    delta = F.coalesce(vec.clipped_delta(F.col("_iv"), F.col("_uv"), F.coalesce("weight", F.lit(0.0)), limit), F.lit(0.0))
    return topn(joined.select("user_id", "recipe_id", (F.col("preference_score") + delta).alias("preference_score")), n)


def online_rescore(candidates: DataFrame, scores: DataFrame, n: int = vocab.CANDIDATE_LIMIT) -> DataFrame:
    """Candidates with their new scores (first occurrence, known only).  Users none of whose
    candidates has a score are ranked over all their scores."""
    hits = candidates.select("user_id", "recipe_id").distinct().join(
        scores.select("user_id", "recipe_id", F.col("score").alias("preference_score")), ["user_id", "recipe_id"])
    rest = scores.join(hits.select("user_id").distinct(), "user_id", "left_anti").select(
        "user_id", "recipe_id", F.col("score").alias("preference_score"))
    return topn(hits.unionByName(rest), n)


def flavor_similarity(candidates: DataFrame, item_factors: DataFrame, center: DataFrame) -> DataFrame:
    """Cosine of every candidate (user_id, recipe_id, or recipe_id alone) with the seed centroid; a vanishing centroid gives nothing."""
    anchor = center.select("vec").scalar()
    keys = [c for c in ("user_id", "recipe_id") if c in candidates.columns]
    return (candidates.select(*keys).distinct()
            .join(item_factors.select("recipe_id", "vec").withColumn("_c", anchor), "recipe_id")
            .where(F.col("_c").isNotNull() & (vec.norm(F.col("_c")) >= 1e-9))
            .select(*keys, vec.cosine_floor(F.col("vec"), F.col("_c")).alias("cosine")))


def bootstrap_vectors(feedback: DataFrame, items: DataFrame) -> DataFrame:
    """Signed mean of item vectors, sum(w v) / sum |w|, over known items."""
    known = feedback.join(items.select("recipe_id", "vec"), "recipe_id").withColumn(
        "_sv", F.transform("vec", lambda x: x.cast("double") * F.signum("w")))
    return weighted_mean_vector(known, ["user_id"], "_sv", F.abs(F.col("w")).cast("double"))


def recommend_by_vector(vectors: DataFrame, items: DataFrame, exclude: DataFrame, k: int = 5) -> DataFrame:
    """Cosine top k per user vector, without the excluded recipes.  A zero vector gets the first k
    recipes with 0.  Unit vectors turn cosine into the block product of `recommend`."""
    # The length is a column of its own: inside the lambda it would be taken anew for every component.
    unit = F.when(F.col("_length") == 0, F.col("vec").cast("array<double>")).otherwise(
        F.transform("vec", lambda x: x.cast("double") / F.col("_length")))
    measured = lambda df: df.withColumn("_length", vec.norm(F.col("vec")))
    u = measured(vectors).select("user_id", unit.alias("vec"))
    i = measured(items).select("recipe_id", F.lit(0.0).alias("bias"), unit.alias("vec"))
    return recommend(i, u, exclude, n=k).withColumnRenamed("preference_score", "similarity")


def kmeans_items(recipes: DataFrame, k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Standardized features (population sd) and clusters; returns items and centroids.

    items: recipe_id, cluster, scaled (array); centroids: cluster, center (array).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .catalog import macro_features

    nut = num.nutrition_array(F.col("nutrition"))
    full = F.size("nutrition") >= 7
    base = recipes.select("recipe_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                         for c in ("minutes", "n_steps", "n_ingredients")],
                          *[F.when(full, nut[i]).otherwise(0.0).alias(n)
                            for n, i in (("calories", 0), ("protein_pdv", 4), ("carbs_pdv", 6))])
    feats = base.join(macro_features(recipes), "recipe_id")
    names = [c for c in feats.columns if c != "recipe_id"]
    stats = feats.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in names],
                               *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).alias("st")).scalar()
    z = [((F.col(c) - F.col(f"_st.m_{c}")) / F.when(F.col(f"_st.s_{c}") == 0, 1.0).otherwise(F.col(f"_st.s_{c}"))) for c in names]
    # Read for the start, every turn and the clusters found, and by all who use the items.
    scaled = write_and_read(feats.withColumn("_st", stats).select("recipe_id", F.array(*z).alias("scaled")), "kmeans-scaled")
    data = scaled.withColumn("features", array_to_vector("scaled"))
    model = KMeans(k=k, seed=seed, maxIter=50).fit(data)
    items = model.transform(data).select("recipe_id", F.col("prediction").alias("cluster"), "scaled")
    centers = recipes.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    return items, centers


def training_medoids(items: DataFrame, centers: DataFrame, stats: DataFrame, q: float = 0.5) -> DataFrame:
    """Per cluster the item closest to its center with steady ratings, among the well-rated ones
    (all, where none is well rated).  Statistics are aggregates per cluster."""
    from .ratings import join_popularity

    merged = write_and_read(join_popularity(items, stats), "medoid-items")
    low = merged.agg(F.percentile("review_count", F.lit(q))).scalar()
    flagged = merged.withColumn("_low", low).withColumn("_ok", F.col("review_count") >= F.col("_low"))
    any_ok = flagged.groupBy("cluster").agg(F.bool_or("_ok").alias("_any"))
    pool = flagged.join(any_ok, "cluster").where(F.col("_ok") | ~F.col("_any")).join(F.broadcast(centers), "cluster")
    dist = F.sqrt(F.aggregate(F.zip_with("scaled", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y))
    pool = pool.withColumn("_d", dist)
    st = pool.groupBy("cluster").agg(F.avg("_d").alias("md"), F.stddev_pop("_d").alias("sd"), F.avg("rating_var").alias("mv"),
                                     F.stddev_samp("rating_var").alias("sv"))
    score = ((F.col("_d") - F.col("md")) / (F.col("sd") + 1e-9)
             + 0.5 * F.coalesce((F.col("rating_var") - F.col("mv")) / (F.col("sv") + 1e-9), F.lit(0.0)))
    return (pool.join(st, "cluster").withColumn("score", score).groupBy("cluster")
            .agg(F.min(F.struct("score", "recipe_id")).alias("b")).select("cluster", "b.recipe_id", "b.score"))
