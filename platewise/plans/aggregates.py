"""Queries: ratings, statistics, top-n, set logic, splits, evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import catalog, content, context, evaluation, ranking, ratings
from .mapping import LI_TRAINED_AT, NOW, Domain, day, md5_unit, r6, sql, ts
from .registry import query


@query("agg_interactions_to_ratings", sql(f"""
    SELECT user_id, recipe_id, {r6("max(CASE interaction_type WHEN 'viewed' THEN 1.5 WHEN 'started' THEN 3.5 WHEN 'liked' THEN 4.5 WHEN 'saved' THEN 5 WHEN 'completed' THEN 5 WHEN 'dismissed' THEN 0 ELSE 1 END)")} AS rating
    FROM orders_log GROUP BY ALL""", "orders_log"))
def agg_interactions_to_ratings(d: Domain):
    return ratings.interactions_to_ratings(d.orders_log)


@query("union_ratings", sql(f"""
    SELECT user_id, recipe_id, {r6('rating')} AS rating FROM (SELECT user_id, recipe_id, CASE interaction_type WHEN 'viewed' THEN 1.5 WHEN 'started' THEN 3.5 WHEN 'liked' THEN 4.5 WHEN 'saved' THEN 5 ELSE 1 END AS rating,
        FROM (SELECT user_id, recipe_id, arg_max(interaction_type, CASE interaction_type WHEN 'viewed' THEN 1.5 WHEN 'started' THEN 3.5 WHEN 'liked' THEN 4.5 WHEN 'saved' THEN 5 ELSE 1 END) AS interaction_type FROM app_log GROUP BY ALL)
        UNION ALL SELECT 'hist_' || user_id, recipe_id, rating FROM ratings)""", "app_log", "ratings"))
def union_ratings(d: Domain):
    return ratings.union_ratings(ratings.interactions_to_ratings(d.app_log), d.historical)


@query("agg_topk_subsample", sql(f"""
    SELECT user_id, recipe_id, {r6('rating')} AS rating FROM s WHERE user_id IN (SELECT user_id FROM s GROUP BY 1 HAVING count(*) >= 12)""", "ratings",
    s="SELECT * FROM ratings WHERE recipe_id IN (SELECT recipe_id FROM (SELECT recipe_id, count(*) AS n FROM ratings GROUP BY 1 ORDER BY n DESC, recipe_id LIMIT 700))"))
def agg_topk_subsample(d: Domain):
    return ratings.topk_subsample(d.ratings, 700, 12)


@query("agg_user_item_mean", sql(f"SELECT user_id, recipe_id, {r6('rating')} AS rating FROM mean_ratings", "mean_ratings"))
def agg_user_item_mean(d: Domain):
    return ratings.user_item_mean(d.ratings)


@query("agg_dataset_stats", sql(f"""
    SELECT n_users, n_recipes, n_ratings, {r6('n_ratings * 100.0 / (n_users * n_recipes)')} AS density_pct, {r6('100 - n_ratings * 100.0 / (n_users * n_recipes)')} AS sparsity_pct
    FROM (SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT recipe_id) AS n_recipes, count(*) AS n_ratings FROM ratings)""", "ratings"))
def agg_dataset_stats(d: Domain):
    return ratings.dataset_stats(d.ratings)


@query("agg_item_bias", sql(f"""
    SELECT recipe_id, {r6('avg(r)')} AS item_mean, {r6('any_value(g)')} AS global_mean, {r6('avg(r) - any_value(g)')} AS bias
    FROM (SELECT recipe_id, user_id, sum(rating) AS r FROM ratings GROUP BY ALL), (SELECT avg(rating) AS g FROM ratings) GROUP BY recipe_id""", "ratings"))
def agg_item_bias(d: Domain):
    return ratings.item_bias(d.ratings)


_STATS = "SELECT recipe_id, count(*) AS review_count, coalesce(var_samp(rating), 0) AS rating_var, avg(rating) AS rating_mean FROM ratings GROUP BY 1"


@query("agg_popularity_stats", sql(f"SELECT recipe_id, review_count, {r6('rating_var')} AS rating_var, {r6('rating_mean')} AS rating_mean FROM s", "ratings", s=_STATS))
def agg_popularity_stats(d: Domain):
    return ratings.popularity_stats(d.ratings)


@query("agg_popularity_threshold", sql(f"SELECT {r6('quantile_cont(review_count, 0.35)')} AS min_reviews FROM s", "ratings", s=_STATS))
def agg_popularity_threshold(d: Domain):
    return ratings.popularity_threshold(ratings.popularity_stats(d.ratings), 0.35)


@query("join_popularity_stats", sql(f"""
    SELECT r.recipe_id, name, coalesce(review_count, 0) AS review_count, {r6('coalesce(rating_var, 0)')} AS rating_var, {r6('coalesce(rating_mean, 0)')} AS rating_mean
    FROM recipes r LEFT JOIN s ON s.recipe_id = r.recipe_id""", "recipes", "ratings", s=_STATS.replace("GROUP", "WHERE rating >= 5 GROUP")))
def join_popularity_stats(d: Domain):
    return ratings.join_popularity(d.recipes.select("recipe_id", "name"), ratings.popularity_stats(d.ratings.where("rating >= 5")))


@query("agg_trending_7d", sql(f"""
    SELECT recipe_id, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, max(created_at) DESC, recipe_id) AS rn FROM (
        SELECT * FROM app_log WHERE interaction_type IN ('liked', 'saved', 'started', 'completed') AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)
    GROUP BY 1 QUALIFY rn <= 60""", "app_log"))
def agg_trending_7d(d: Domain):
    return ratings.trending(d.app_log, NOW, n=60)


@query("agg_interaction_counts", sql("""
    SELECT user_id, count(*) AS n_all, count(*) FILTER (interaction_type IN ('liked', 'dismissed')) AS n_feedback FROM orders_log GROUP BY 1""", "orders_log"))
def agg_interaction_counts(d: Domain):
    return ratings.interaction_counts(d.orders_log)


@query("catalog_padding", sql(f"""
    SELECT user_id, recipe_id, {r6('rating')} AS rating FROM ratings UNION ALL SELECT '__catalog_pad__', recipe_id, 3.0::DOUBLE FROM recipes""", "ratings", "recipes"))
def catalog_padding(d: Domain):
    return ratings.catalog_padding(d.ratings, d.recipes)


@query("dedup_keep_newest", sql(f"""
    SELECT user_id, recipe_id, id, interaction_type, {ts('created_at')} AS created_at FROM app_log QUALIFY row_number() OVER (PARTITION BY user_id, recipe_id ORDER BY id DESC) = 1""", "app_log"))
def dedup_keep_newest(d: Domain):
    return ratings.dedup_keep_newest(d.app_log, ["user_id", "recipe_id"], "id")


@query("distinct_on_latest", sql(f"""
    SELECT user_id, recipe_id, user_id::BIGINT * 10 AS cooklist_id, {ts('max(created_at)')} AS created_at FROM orders_log
    WHERE interaction_type IN ('saved', 'save') AND user_id::BIGINT % 6 <> 5 GROUP BY ALL""", "orders_log"))
def distinct_on_latest(d: Domain):
    u = F.col("c_custkey")
    lists = d.table("customer").select(u.cast("string").alias("user_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), u).select(
        "user_id", (u * 10 + F.col("n")).alias("cooklist_id"), ((F.col("n") == 0) & (u % 6 != 5)).alias("is_default"))
    return ratings.latest_saved(d.orders_log, lists)


@query("topn_candidates", sql(f"""
    SELECT user_id, rn, recipe_id, {r6('preference_score')} AS preference_score FROM preference""", "preference"))
def topn_candidates(d: Domain):
    return ranking.topn(d.mean_ratings.withColumnRenamed("rating", "preference_score"))


@query("topk_with_backfill", sql(f"""
    SELECT user_id, rn, recipe_id, {r6('score')} AS score FROM (SELECT user_id, recipe_id, score, row_number() OVER (PARTITION BY user_id ORDER BY side, k) AS rn FROM (
        SELECT user_id, recipe_id, preference_score AS score, 0 AS side, rn AS k FROM cand
        UNION ALL SELECT u.user_id, r.recipe_id, 3.0, 1, r.recipe_id FROM users_ u, recipes r
            WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.user_id = u.user_id AND c.recipe_id = r.recipe_id) AND NOT EXISTS (SELECT 1 FROM excl e WHERE e.user_id = u.user_id AND e.recipe_id = r.recipe_id))) WHERE rn <= 6""", "preference", "recipes", "app_log",
    users_="SELECT DISTINCT user_id FROM app_log", cand="SELECT p.* FROM preference p WHERE preference_score >= 4.5 AND user_id IN (SELECT user_id FROM app_log)",
    excl="SELECT DISTINCT user_id, recipe_id FROM app_log WHERE interaction_type IN ('liked', 'saved')"))
def topk_with_backfill(d: Domain):
    cand = d.kept("preference").where("preference_score >= 4.5").join(d.users, "user_id", "left_semi")
    return ranking.topk_with_backfill(cand, d.recipes, d.users, ratings.kept_pairs(d.app_log))


@query("popularity_fallback", sql("""
    SELECT user_id, rn, recipe_id, (100 - rn + 1)::DOUBLE AS preference_score FROM (SELECT c_custkey::VARCHAR AS user_id FROM customer),
        (SELECT recipe_id, row_number() OVER (ORDER BY recipe_id) AS rn FROM recipes) WHERE rn <= 100""", "recipes"))
def popularity_fallback(d: Domain):
    users = d.table("customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    return ranking.popularity_fallback(users, d.recipes, 100)


@query("minmax_match_score", sql(f"""
    SELECT user_id, recipe_id, {r6('CASE WHEN max(s) OVER w = min(s) OVER w THEN 0.9 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) * 0.2 + 0.78 END')} AS match_score
    FROM (SELECT user_id, recipe_id, preference_score AS s FROM preference) WINDOW w AS (PARTITION BY user_id)""", "preference"))
def minmax_match_score(d: Domain):
    return ranking.minmax(d.preference, ["user_id"], "preference_score").select("user_id", "recipe_id", "match_score")


@query("cross_candidates", sql("""
    SELECT user_id, count(*) AS n, sum(recipe_id)::BIGINT AS id_sum FROM (SELECT user_id, recipe_id FROM users, recipes EXCEPT SELECT user_id, recipe_id FROM app_log
        WHERE interaction_type IN ('liked', 'saved')) GROUP BY 1""", "users", "recipes", "app_log"))
def cross_candidates(d: Domain):
    out = ranking.cross_candidates(d.users, d.recipes, ratings.kept_pairs(d.app_log), block=512)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("recipe_id").alias("id_sum"))


@query("distinct_id_pool", """
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS pos, recipe_id FROM (SELECT user_id, recipe_id, min(i) AS first FROM (
        SELECT c_custkey::VARCHAR AS user_id, unnest([c_custkey % 7, c_custkey % 11, 5, c_custkey % 7, c_custkey % 13, c_custkey % 5, c_custkey % 3]) AS recipe_id,
            unnest([1, 2, 3, 4, 5, 6, 7]) AS i FROM customer) WHERE recipe_id > 0 GROUP BY ALL) QUALIFY pos <= 4""")
def distinct_id_pool(d: Domain):
    s = lambda m: (F.col("c_custkey") % m).cast("string")
    wide = d.table("customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.array(s(7), s(11)).alias("recommended_recipe_ids"), F.array(F.lit("5x"), s(7)).alias("trending_recipe_ids"),
        F.array(s(13), F.lit("none")).alias("flavor_recipe_ids"), F.lit(None).cast("array<string>").alias("healthy_recipe_ids"), F.array(s(5), s(3), F.lit("-4")).alias("quick_recipe_ids"))
    return ranking.distinct_id_pool(wide, 4)


@query("ordered_union_dedup", sql("""
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY l, pos, id) AS pos, id FROM (SELECT user_id, id, min(l) AS l, arg_min(pos, l * 1000 + pos) AS pos FROM (
        SELECT user_id, 0 AS l, rn AS pos, recipe_id AS id FROM preference WHERE rn % 2 = 0 UNION ALL SELECT user_id, 1, rn, recipe_id FROM preference WHERE rn <= 9) GROUP BY ALL)""", "preference"))
def ordered_union_dedup(d: Domain):
    rows = d.preference.select("user_id", F.col("rn").alias("pos"), F.col("recipe_id").alias("id"))
    return ranking.ordered_union(rows.where("pos % 2 = 0"), rows.where("pos <= 9"))


@query("exclude_logged_recipes", sql("""
    SELECT user_id, recipe_id FROM pairs EXCEPT SELECT user_id, recipe_id FROM meals""", "pairs", "meals"))
def exclude_logged_recipes(d: Domain):
    return content.exclude_logged(d.pairs, d.meals)


# ---- splits and samples by seeded md5 ------------------------------------------------------------------

@query("split_train_test", sql(f"SELECT CASE WHEN {md5_unit(42, 'user_id', 'recipe_id')} < 0.2 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM ratings GROUP BY 1", "ratings"))
def split_train_test(d: Domain):
    return ratings.split_train_test(d.ratings).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("sample_eval_users", sql(f"SELECT user_id FROM (SELECT DISTINCT user_id FROM ratings) ORDER BY {md5_unit(0, 'user_id')}, user_id LIMIT 100", "ratings"))
def sample_eval_users(d: Domain):
    return ratings.sample_rows(d.ratings.select("user_id").distinct(), ["user_id"], 100)


@query("agg_training_gate", sql("""
    SELECT *, n >= 100 AND least(n_pos, n_neg) >= 20 AND n_users >= 5 AS can_train FROM (SELECT count(*) AS n, count(*) FILTER (label = 1) AS n_pos,
        count(*) FILTER (label = 0) AS n_neg, count(DISTINCT user_id) AS n_users FROM (SELECT user_id, (rating >= 4)::INT AS label FROM ratings))""", "ratings"))
def agg_training_gate(d: Domain):
    return context.training_gate(d.ratings.select("user_id", (F.col("rating") >= 4).cast("int").alias("label")))


@query("agg_class_balance", sql(f"""
    SELECT {r6('count(*) FILTER (rating < 4) / greatest(1, count(*) FILTER (rating >= 4))')} AS pos_weight FROM ratings""", "ratings"))
def agg_class_balance(d: Domain):
    return context.class_balance(d.ratings.select((F.col("rating") >= 4).cast("int").alias("label")))


@query("eval_rmse", sql(f"""
    SELECT {r6('sqrt(avg((l_quantity / 10 - l_extendedprice / 20000) ** 2))')} AS rmse FROM lineitem WHERE l_linenumber <> 3"""))
def eval_rmse(d: Domain):
    pred = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 20000)
    return evaluation.rmse(d.table("lineitem").select((F.col("l_quantity") / 10).alias("rating"), pred.alias("pred")))


_TEST = f"SELECT cust::VARCHAR AS user_id, recipe_id, max(1 + l_quantity % 5) AS rating FROM bought WHERE created_at > TIMESTAMP '{LI_TRAINED_AT}' GROUP BY ALL"


def _test_rows(d: Domain):
    """Ratings after the training boundary."""
    late = d.bought.where(F.col("created_at") > F.lit(LI_TRAINED_AT).cast("timestamp"))
    return late.groupBy(F.col("cust").cast("string").alias("user_id"), "recipe_id").agg(F.max(1 + F.col("l_quantity") % 5).alias("rating"))


@query("eval_precision_at_k", sql(f"""
    SELECT {r6('avg(h)')} AS precision_at_k FROM (SELECT g.user_id, count(p.recipe_id) / 10.0 AS h FROM (SELECT DISTINCT user_id, recipe_id FROM t WHERE rating >= 4) g
        LEFT JOIN preference p ON p.user_id = g.user_id AND p.recipe_id = g.recipe_id AND p.rn <= 10 GROUP BY 1)""", "preference", "ratings", t=_TEST))
def eval_precision_at_k(d: Domain):
    return evaluation.precision_at_k(d.preference, _test_rows(d))


@query("eval_ranking_extra", sql(f"""
    SELECT {r6('avg(h / n)')} AS recall, {r6('avg(dcg / idcg)')} AS ndcg, {r6('avg(ap / least(10, n))')} AS "map",
        {r6('(SELECT count(DISTINCT recipe_id) FROM preference WHERE rn <= 10) / (SELECT count(*) FROM recipes)')} AS coverage FROM (
        SELECT g.user_id, any_value(n) AS n, any_value(list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1)))) AS idcg, count(h.rn)::DOUBLE AS h,
            coalesce(sum(1 / log2(h.rn + 1)), 0) AS dcg, coalesce(sum(i / h.rn), 0) AS ap
        FROM (SELECT user_id, count(*) AS n FROM g GROUP BY 1) g LEFT JOIN h ON h.user_id = g.user_id GROUP BY 1)""", "preference", "ratings", "recipes", t=_TEST,
    g="SELECT DISTINCT user_id, recipe_id FROM t WHERE rating >= 4",
    h="SELECT p.user_id, p.rn, row_number() OVER (PARTITION BY p.user_id ORDER BY p.rn) AS i FROM preference p JOIN g ON g.user_id = p.user_id AND g.recipe_id = p.recipe_id WHERE p.rn <= 10"))
def eval_ranking_extra(d: Domain):
    return evaluation.ranking_extra(d.preference, _test_rows(d), d.recipes)


@query("eval_risk_exposure", sql(f"""
    SELECT {r6('avg(cr)')} AS mean_risk, count(*) FILTER (cr >= 0.55) AS n_high, {r6('avg(preference_score) FILTER (cr < 0.25)')} AS pref_low
    FROM (SELECT preference_score, (recipe_id % 100) / 100.0::DOUBLE AS cr FROM preference WHERE rn <= 10)""", "preference"))
def eval_risk_exposure(d: Domain):
    return evaluation.risk_exposure(d.preference.withColumn("combined_risk", (F.col("recipe_id") % 100) / 100))


@query("eval_compare", sql(f"""
    SELECT 'half' AS model, {r6('sqrt(avg((rating - recipe_id % 5) ** 2))')} AS rmse, {r6('(SELECT avg(h) FROM (SELECT g.user_id, count(p.rn) / 10.0 AS h FROM g LEFT JOIN preference p ON p.user_id = g.user_id AND p.recipe_id = g.recipe_id AND p.rn <= 10 GROUP BY 1))')} AS precision_at_k FROM t
    UNION ALL SELECT 'mean', {r6('sqrt(avg((rating - 3) ** 2))')}, {r6('(SELECT avg(h) FROM (SELECT g.user_id, count(p.rn) / 5.0 AS h FROM g LEFT JOIN preference p ON p.user_id = g.user_id AND p.recipe_id = g.recipe_id AND p.rn <= 5 GROUP BY 1))')} FROM t""",
    "preference", "ratings", t=_TEST, g="SELECT DISTINCT user_id, recipe_id FROM t WHERE rating >= 4"))
def eval_compare(d: Domain):
    t = _test_rows(d)
    return evaluation.compare_models({
        "half": (evaluation.rmse(t.withColumn("pred", (F.col("recipe_id") % 5).cast("double"))), evaluation.precision_at_k(d.preference, t)),
        "mean": (evaluation.rmse(t.withColumn("pred", F.lit(3.0))), evaluation.precision_at_k(d.preference, t, k=5))})


@query("eval_classifier", sql(f"""
    SELECT {r6('(SELECT sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2 FROM k) / (sum(y) * sum(1 - y))')} AS auc,
        {r6('avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(greatest(1e-15, least(1 - 1e-15, p)))) * (y = 1)::INT - (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))')} AS log_loss,
        {r6('avg((p - y) ** 2)')} AS brier FROM s""",
    s="SELECT (l_returnflag = 'A')::INT AS y, (l_quantity * 7 % 50) / 50.0::DOUBLE AS p FROM lineitem",
    k="SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM s"))
def eval_classifier(d: Domain):
    rows = d.table("lineitem").select((F.col("l_returnflag") == "A").cast("int").alias("label"), ((F.col("l_quantity") * 7 % 50) / 50).alias("p"))
    return evaluation.classifier_metrics(rows)
