"""Queries: scans, catalog rows, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import numbers as num, text as tx
from ..operators import catalog, cookbook, dashboard, preference, ranking, ratings
from ..session import scratch_path, write_and_read
from ..sources import readers, sinks
from .mapping import LI_TRAINED_AT, NOW, Domain, lst, md5_unit, n_ing, n_text, r6, sql, ts
from .registry import query


@query("ingest_csv", f"""SELECT 'a "b", ' || o_orderpriority AS note, count(*) AS n, {r6('sum(o_totalprice)')} AS total FROM orders GROUP BY 1""")
def ingest_csv(d: Domain):
    """Orders written as CSV with quoted commas, then read back by schema."""
    path = scratch_path(d.spark, "csv")
    raw = d.table("orders").select("o_orderkey", F.concat(F.lit('a "b", '), "o_orderpriority").alias("note"), "o_totalprice")
    raw.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    back = readers.read_csv(d.spark, path, "o_orderkey long, note string, o_totalprice double")
    return back.groupBy("note").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("ingest_list_strings", sql(f"""
    SELECT recipe_id, coalesce(array_to_string(CASE WHEN recipe_id % 9 = 0 THEN []::VARCHAR[] ELSE
        [name, 'chef''s ' || split_part(name, ' ', 1), 'x' || minutes] END, '|'), '') AS items,
        {r6('CASE WHEN recipe_id % 9 = 0 THEN 0 ELSE nutrition[1] + nutrition[2] END')} AS total
    FROM (SELECT * REPLACE (coalesce(minutes, 0) AS minutes) FROM recipes)""", "recipes"))
def ingest_list_strings(d: Domain):
    quoted = F.concat(F.lit("['"), "name", F.lit("', \"chef's "), F.split("name", " ")[0], F.lit("\", 'x"),
                      F.coalesce("minutes", F.lit(0)).cast("string"), F.lit("']"))
    numbers = F.concat(F.lit("["), F.get("nutrition", F.lit(0)).cast("string"), F.lit(", "), F.get("nutrition", F.lit(1)).cast("string"), F.lit("]"))
    broken = F.col("recipe_id") % 9 == 0
    raw = d.recipes.select("recipe_id", F.when(broken, "['open, 1").otherwise(quoted).alias("items"),
                           F.when(broken, "nothing").otherwise(numbers).alias("nutrition"))
    out = readers.parse_list_columns(raw, ["items"], ["nutrition"])
    return out.select("recipe_id", "items", F.aggregate("nutrition", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("project_recipe_row", sql("""
    SELECT recipe_id, upper(left(name, 1)) || substr(split_part(name, ' ', 1), 2) || ' ' || upper(left(split_part(name, ' ', 2), 1))
        || substr(split_part(name, ' ', 2), 2) AS name, coalesce(minutes, 0) AS minutes, coalesce(n_steps, 0) AS n_steps,
        coalesce(n_ingredients, 0) AS n_ingredients, coalesce(description, '') AS description FROM recipes""", "recipes"))
def project_recipe_row(d: Domain):
    return catalog.project_recipe_row(d.recipes)


@query("scan_lookup_fodmap", """
    SELECT p_type || ', all kinds' AS food_group, CASE WHEN length(p_type) > 5 THEN 'Fructans' ELSE 'Lactose' END AS fodmap_category, 'High' AS fodmap_severity, count(*) AS n_parts FROM part GROUP BY ALL""")
def scan_lookup_fodmap(d: Domain):
    """Food-group lookup as a CSV file, joined to all parts by type."""
    path = scratch_path(d.spark, "lookup")
    kinds = d.table("part").select(F.col("p_type").alias("food_group")).distinct()
    rows = kinds.select(F.concat("food_group", F.lit(", all kinds")).alias("food_group"),
                        F.when(F.length("food_group") > 5, "Fructans").otherwise("Lactose").alias("fodmap_category"),
                        F.lit("High").alias("fodmap_severity"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    lookup = readers.read_fodmap_lookup(d.spark, path)
    parts = d.table("part").withColumn("food_group", F.concat("p_type", F.lit(", all kinds")))
    return parts.join(lookup, "food_group").groupBy("food_group", "fodmap_category", "fodmap_severity").agg(F.count(F.lit(1)).alias("n_parts"))


@query("scan_table", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) + 0.0::DOUBLE AS o_totalprice, NULL::VARCHAR AS missing_column FROM orders")
def scan_table(d: Domain):
    return readers.scan_table(d.table("orders"), ["o_orderkey", "o_custkey", "o_totalprice", "missing_column"])


@query("scan_filtered_topn", f"""
    SELECT user_id, rn, o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM (SELECT o_custkey::VARCHAR AS user_id, o_orderkey, o_totalprice,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders
        WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1995-01-01') WHERE rn <= 8""")
def scan_filtered_topn(d: Domain):
    rows = d.table("orders").where(F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")))
    rows = rows.select(F.col("o_custkey").cast("string").alias("user_id"), "o_orderkey", "o_totalprice")
    return ranking.latest_n(rows, "user_id", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 8)


@query("scan_latest_per_user", sql(f"""
    SELECT user_id, {ts("max(CASE WHEN k = 'm' THEN t END)")} AS latest_meal, {ts("max(CASE WHEN k = 'r' THEN t END)")} AS latest_report,
        {ts("max(CASE WHEN k = 'c' THEN t END)")} AS latest_checkin, count(*) FILTER (k = 'b') AS cookbook_count,
        {ts("max(CASE WHEN k = 'b' THEN t END)")} AS latest_saved FROM (
        SELECT user_id, 'm' AS k, logged_at AS t FROM meals UNION ALL SELECT user_id, 'r', reported_at FROM reports
        UNION ALL SELECT user_id, 'c', created_at FROM checkins UNION ALL SELECT user_id, 'b', created_at FROM cooklists) GROUP BY user_id""",
    "meals", "reports", "checkins", "cooklists"))
def scan_latest_per_user(d: Domain):
    return dashboard.latest_activity(d.meals, d.reports, d.checkins, d.cooklists)


@query("lookup_ids_ordered", sql("""
    SELECT user_id, pos, l.recipe_id, coalesce(r.name, 'Unknown recipe') AS name, r.name IS NOT NULL AS found FROM (
        SELECT o_custkey::VARCHAR AS user_id, o_orderkey, unnest(ids) AS recipe_id, generate_subscripts(ids, 1)::BIGINT - 1 AS pos FROM (
            SELECT o_custkey, o_orderkey, [o_orderkey % 2500, (o_orderkey * 7) % 2500, o_custkey] AS ids FROM orders)) l
    LEFT JOIN recipes r ON r.recipe_id = l.recipe_id""", "recipes"))
def lookup_ids_ordered(d: Domain):
    lists = d.table("orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.array(
        F.col("o_orderkey") % 2500, (F.col("o_orderkey") * 7) % 2500, F.col("o_custkey")).alias("ids"))
    return ranking.lookup_ordered(lists, d.recipes)


@query("semi_join_needed_ids", sql("""
    SELECT recipe_id, name, coalesce(minutes, -1) AS minutes FROM recipes WHERE recipe_id IN (SELECT recipe_id FROM preference UNION SELECT k FROM ev)""",
    "recipes", "preference", "ev"))
def semi_join_needed_ids(d: Domain):
    return readers.needed_rows(d.recipes, d.preference, d.app_log).select("recipe_id", "name", F.coalesce("minutes", F.lit(-1)).alias("minutes"))


@query("sink_replace_generation", sql(f"""
    SELECT user_id, recipe_id, {r6('preference_score')} AS preference_score, model_name FROM (
        SELECT user_id, recipe_id, rating AS preference_score, CASE WHEN recipe_id % 2 = 0 THEN 'base@1' ELSE 'base@2' END AS model_name FROM mean_ratings)
    WHERE NOT (model_name = 'base@2' AND user_id IN (SELECT user_id FROM seg))
    UNION ALL SELECT user_id, recipe_id, {r6('preference_score + 1')}, 'base@2' FROM preference WHERE user_id IN (SELECT user_id FROM seg) AND preference_score >= 4""",
    "mean_ratings", "preference", seg="SELECT c_custkey::VARCHAR AS user_id FROM customer WHERE c_mktsegment = 'BUILDING'"))
def sink_replace_generation(d: Domain):
    current = d.mean_ratings.withColumnRenamed("rating", "preference_score").withColumn(
        "model_name", F.when(F.col("recipe_id") % 2 == 0, "base@1").otherwise("base@2"))
    segment = d.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("user_id"))
    # The new rows are checked, placed and written in each run: they are a table from here on.
    new = write_and_read(d.preference.where("preference_score >= 4").join(segment, "user_id", "left_semi").select(
        "user_id", "recipe_id", (F.col("preference_score") + 1).alias("preference_score"), F.lit("base@2").alias("model_name")), "new-generation")
    root = scratch_path(d.spark, "candidates")
    sinks.write_table(current, root, ["user_id"], 8)
    for _ in range(2):  # a second run changes nothing
        sinks.replace_generation_table(d.spark, root, new, segment, "base@2")
    return sinks.read_table(d.spark, root)


@query("sink_upsert", sql(f"""
    SELECT user_id, ingredient_name, {r6('risk_score')} AS risk_score, n AS exposure_count FROM (
        SELECT coalesce(u.user_id, g.user_id) AS user_id, coalesce(u.ingredient_name, g.ingredient_name) AS ingredient_name,
            coalesce(u.risk, g.risk_score) AS risk_score, coalesce(u.n, g.exposure_count) AS n FROM generic_risks g FULL JOIN (
            SELECT user_id, ingredient_name, arg_max(severity, rid) AS risk, arg_max(rid, rid) AS n FROM (
                SELECT user_id, {lst(('red', 'gizmo', 'tofu'))}[report_id % 3 + 1] AS ingredient_name, severity, report_id AS rid FROM reports)
            GROUP BY ALL) u ON u.user_id = g.user_id AND u.ingredient_name = g.ingredient_name)""", "generic_risks", "reports"))
def sink_upsert(d: Domain):
    current = d.generic_risks.select("user_id", "ingredient_name", "risk_score", "exposure_count")
    name = F.get(F.array(*map(F.lit, ("red", "gizmo", "tofu"))), (F.col("report_id") % 3).cast("int"))
    updates = d.reports.select("user_id", name.alias("ingredient_name"), F.col("severity").alias("risk_score"),
                               F.col("report_id").alias("exposure_count"))
    root = scratch_path(d.spark, "risks")
    sinks.write_table(current, root, ["user_id", "ingredient_name"], 8)
    for _ in range(2):  # a second run changes nothing
        sinks.upsert_table(d.spark, root, updates, ["user_id", "ingredient_name"], "exposure_count")
    return sinks.read_table(d.spark, root)


@query("sink_versioned_artifact", sql(f"SELECT count(*) AS n_items, {r6('sum(bias)')} AS bias_sum, 'factors@20240120T0000' AS model_name FROM item_factors", "item_factors"))
def sink_versioned_artifact(d: Domain):
    """Two generations of factors; the reader follows the newest."""
    root = scratch_path(d.spark, "factors")
    items, users = d.item_factors.select("recipe_id", "bias", "vec"), d.item_factors.select(
        F.col("recipe_id").cast("string").alias("user_id"), F.lit(0.0).alias("bias"), "vec")
    meta = d.spark.range(1).select(F.lit(3.0).alias("global_mean"), F.lit(64).alias("rank"))
    for at in ("2024-01-01T00:00", "2024-01-20T00:00"):
        sinks.publish_factors(d.spark, root, "factors", at, items, users, meta)
    name, parts = sinks.current_factors(d.spark, root)
    return parts["item_factors"].agg(F.count(F.lit(1)).alias("n_items"), F.sum("bias").alias("bias_sum")).withColumn("model_name", F.lit(name))


@query("sink_wide_recommendations", sql(f"""
    SELECT user_id, coalesce(string_agg(recipe_id::VARCHAR, '|' ORDER BY rank) FILTER (row_name = 'curated'), '') AS recommended_recipe_ids,
        coalesce(string_agg(recipe_id::VARCHAR, '|' ORDER BY rank) FILTER (row_name = 'trending'), '') AS trending_recipe_ids,
        {r6("coalesce(sum(m) FILTER (row_name = 'curated'), 0)")} AS curated_match_sum,
        {r6("coalesce(sum(m) FILTER (row_name = 'trending'), 0)")} AS trending_match_sum
    FROM (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.9 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) * 0.2 + 0.78 END AS m
        FROM (SELECT user_id, CASE WHEN rn % 2 = 1 THEN 'curated' ELSE 'trending' END AS row_name, (rn + 1) // 2 AS rank,
            recipe_id, preference_score AS score FROM preference) WINDOW w AS (PARTITION BY user_id, row_name)) GROUP BY user_id""", "preference"))
def sink_wide_recommendations(d: Domain):
    first = F.col("rn") % 2 == 1
    rows = d.preference.select(
        "user_id", F.when(first, "curated").otherwise("trending").alias("row_name"),
        F.floor((F.col("rn") + 1) / 2).alias("rank"), "recipe_id", F.col("preference_score").alias("score"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return ranking.wide_recommendations(rows).select(
        "user_id", "recommended_recipe_ids", "trending_recipe_ids", total("match_scores").alias("curated_match_sum"),
        total("trending_match_scores").alias("trending_match_sum"))


@query("artifact_validate", """
    WITH f AS (SELECT vec_id AS recipe_id, CASE WHEN vec_id % 100 = 7 THEN 'NaN'::DOUBLE ELSE label / 10.0 END AS bias,
        CASE WHEN vec_id % 50 = 3 THEN 63 ELSE 64 END AS k FROM embeddings),
    u AS (SELECT label::VARCHAR AS user_id FROM embeddings)
    SELECT "check", n_bad = 0 AS ok, n_bad::BIGINT AS n_bad FROM (
        SELECT 'item_dimension' AS "check", count(*) FILTER (k <> 64) AS n_bad FROM f
        UNION ALL SELECT 'item_finite', count(*) FILTER (isnan(bias)) FROM f UNION ALL SELECT 'item_unique', 0
        UNION ALL SELECT 'user_dimension', 0 UNION ALL SELECT 'user_finite', 0
        UNION ALL SELECT 'user_unique', count(*) - count(DISTINCT user_id) FROM u
        UNION ALL SELECT 'meta_single', 0 UNION ALL SELECT 'meta_complete', 1)""")
def artifact_validate(d: Domain):
    i = F.col("recipe_id")
    items = d.item_factors.select("recipe_id", F.when(i % 100 == 7, F.lit(float("nan"))).otherwise(F.col("bias")).alias("bias"),
                                  F.when(i % 50 == 3, F.slice("vec", 1, 63)).otherwise(F.col("vec")).alias("vec"))
    users = d.item_factors.select(F.col("cluster").cast("string").alias("user_id"), F.lit(0.0).alias("bias"), "vec")
    meta = d.spark.range(1).select(F.lit(3.0).alias("global_mean"), F.lit(64).alias("rank"), F.lit("").alias("trained_at"), F.lit("m").alias("model_name"))
    return preference.validate_artifact(items, users, meta)


@query("recipe_metadata_presence", sql("""
    SELECT recipe_id, (minutes IS NOT NULL)::BIGINT AS minutes_present, (n_steps IS NOT NULL)::BIGINT AS n_steps_present,
        (n_ingredients IS NOT NULL OR len(ingredients) > 0)::BIGINT AS n_ingredients_present, (len(nutrition) >= 7)::BIGINT AS nutrition_present,
        (len(ingredients) > 0)::BIGINT AS ingredients_present, coalesce(is_ibs_friendly::BIGINT, -1) AS friendly_state FROM recipes""", "recipes"))
def recipe_metadata_presence(d: Domain):
    return catalog.metadata_presence(d.recipes).drop("name", "ingredients", "minutes", "n_steps", "n_ingredients", "nutrition", "description", "is_ibs_friendly")


# ---- filters over ratings and logs ---------------------------------------------------------------------

def _sum_of(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("recipe_id").alias("id_sum"))


@query("filter_training_boundary", sql(f"""
    SELECT user_id, recipe_id, interaction_type, {ts('t_at')} AS created_at FROM (SELECT *, CASE WHEN recipe_id % 50 <> 0 THEN created_at END AS t_at FROM orders_log)
    WHERE t_at IS NULL OR t_at <= TIMESTAMP '{LI_TRAINED_AT}'""", "orders_log"))
def filter_training_boundary(d: Domain):
    log = d.orders_log.withColumn("created_at", F.when(F.col("recipe_id") % 50 != 0, F.col("created_at")))
    return ratings.filter_training_boundary(log, LI_TRAINED_AT)


@query("filter_online_delta", sql(f"""
    SELECT user_id, recipe_id, interaction_type, {ts('t_at')} AS created_at FROM (SELECT *, CASE WHEN recipe_id % 50 <> 0 THEN created_at END AS t_at FROM orders_log)
    WHERE user_id NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 2000) OR coalesce(t_at > TIMESTAMP '{LI_TRAINED_AT}', false)""", "orders_log"))
def filter_online_delta(d: Domain):
    log = d.orders_log.withColumn("created_at", F.when(F.col("recipe_id") % 50 != 0, F.col("created_at")))
    learned = d.table("customer").where("c_acctbal > 2000").select(F.col("c_custkey").cast("string").alias("user_id"))
    return ratings.filter_online_delta(log, learned, LI_TRAINED_AT)


@query("filter_positive_ratings", sql(f"""
    SELECT user_id, recipe_id, {r6('rating')} AS rating FROM (SELECT CASE WHEN user_id::BIGINT % 2 = 0 THEN 'hist_' || user_id ELSE user_id END AS user_id,
        recipe_id, CASE WHEN recipe_id % 40 = 1 THEN 0 ELSE rating END AS rating FROM ratings)
    WHERE rating > 0 AND (NOT starts_with(user_id, 'hist_') OR rating >= 4) AND recipe_id IN (SELECT recipe_id FROM recipes WHERE minutes IS NOT NULL)""", "ratings", "recipes"))
def filter_positive_ratings(d: Domain):
    even = F.col("user_id").cast("long") % 2 == 0
    rows = d.ratings.select(F.when(even, F.concat(F.lit("hist_"), "user_id")).otherwise(F.col("user_id")).alias("user_id"), "recipe_id",
                            F.when(F.col("recipe_id") % 40 == 1, 0.0).otherwise(F.col("rating")).alias("rating"))
    return ratings.filter_positive_ratings(rows, d.recipes.where("minutes is not null"))


@query("filter_catalog_quick", sql("SELECT recipe_id, minutes FROM recipes WHERE minutes < 30", "recipes"))
def filter_catalog_quick(d: Domain):
    return catalog.filter_quick(d.recipes).select("recipe_id", "minutes")


@query("filter_catalog_healthy", sql("SELECT recipe_id FROM recipes WHERE len(nutrition) >= 2 AND nutrition[1] < 400 AND nutrition[2] < 20", "recipes"))
def filter_catalog_healthy(d: Domain):
    return catalog.filter_healthy(d.recipes).select("recipe_id")


@query("filter_catalog_flavorful", sql("""
    SELECT recipe_id, name FROM recipes WHERE regexp_matches(lower(array_to_string(ingredients, ' ')), 'hot|gizm|ring eco')""", "recipes"))
def filter_catalog_flavorful(d: Domain):
    return catalog.filter_flavorful(d.recipes, ("hot", "gizm", "ring eco")).select("recipe_id", "name")


@query("identify_flavor_seeds", sql("""
    SELECT recipe_id FROM recipes WHERE regexp_matches(lower(array_to_string(ingredients, ' ')), 'hot ring|red anvil')""", "recipes"))
def identify_flavor_seeds(d: Domain):
    return catalog.flavor_seeds(d.recipes, ("hot ring", "red anvil"))


@query("flag_ibs_friendly", sql("""
    SELECT recipe_id, NOT coalesce(list_bool_or(list_transform(ingredients, lambda x: regexp_matches(lower(x), 'old|widg|promo'))), false) AS is_ibs_friendly
    FROM recipes""", "recipes"))
def flag_friendly(d: Domain):
    return catalog.flag_friendly(d.recipes, ("old", "widg", "promo"))


@query("exclude_saved_liked", sql("""
    SELECT user_id, recipe_id FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM orders_log o WHERE o.user_id = p.user_id AND o.recipe_id = p.recipe_id
        AND interaction_type IN ('liked', 'saved', 'save'))""", "pairs", "orders_log"))
def exclude_saved_liked(d: Domain):
    return ratings.exclude_kept(d.pairs, d.orders_log)


@query("search_contains", sql("""
    SELECT query_id, rn, recipe_id FROM (SELECT q.query_id, r.recipe_id, row_number() OVER (PARTITION BY q.query_id ORDER BY r.recipe_id) AS rn
        FROM (SELECT s_suppkey AS query_id, lower(trim(CASE s_suppkey % 4 WHEN 0 THEN ' Red ' WHEN 1 THEN 'ring eco' WHEN 2 THEN 'Brand#' || (s_suppkey % 25) ELSE 'z' END)) AS q FROM supplier) q
        JOIN (SELECT recipe_id, lower(name || ' ' || description || ' ' || array_to_string(ingredients, ' ')) AS hay FROM recipes) r ON contains(r.hay, q.q))
    WHERE rn <= 8""", "recipes"))
def search_contains(d: Domain):
    i = F.col("s_suppkey")
    text = F.when(i % 4 == 0, " Red ").when(i % 4 == 1, "ring eco").when(i % 4 == 2, F.concat(F.lit("Brand#"), (i % 25).cast("string"))).otherwise("z")
    return catalog.search_contains(d.recipes, d.table("supplier").select(i.alias("query_id"), text.alias("q")))


@query("plan_entitlement", sql(f"""
    SELECT user_id, is_premium, days_used, CASE WHEN is_premium THEN 30 ELSE greatest(0, 30 - days_used) END AS days_remaining,
        {ts('born + to_days(30)')} AS trial_ends_at, is_premium OR born IS NULL OR days_used < 30 AS feature_access FROM (
        SELECT c_custkey::VARCHAR AS user_id, c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') AS is_premium, born,
            CASE WHEN born IS NULL THEN 0 ELSE greatest(0, floor(epoch(TIMESTAMP '{NOW}' - born) / 86400)) END::BIGINT AS days_used
        FROM (SELECT *, CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '2023-12-01 12:00:00' + to_days((c_custkey % 80)::INT) END AS born FROM customer))"""))
def plan_entitlement(d: Domain):
    c = F.col("c_custkey")
    users = d.table("customer").select(
        c.cast("string").alias("user_id"), F.concat(F.lit(" "), F.initcap("c_mktsegment")).alias("plan"),
        F.when(c % 9 != 0, F.lit("2023-12-01 12:00:00").cast("timestamp") + F.make_dt_interval((c % 80).cast("int"))).alias("created_at"))
    return dashboard.plan_entitlement(users, NOW, premium=("household", "machinery"))


_WORD_ALT = "lower('A plate of ' || p_name || CASE WHEN p_partkey % 10 = 3 THEN ' in a book' ELSE '' END)"


@query("filter_food_image_meta", sql(f"""
    SELECT page_id FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'A salad plate' WHEN 1 THEN 'Cookbook and soup' WHEN 2 THEN '' ELSE 'Fish dish' END AS alt FROM pages)
    WHERE alt <> '' AND NOT regexp_matches(lower(alt), '{'|'.join(vocab.NON_FOOD_TERMS)}') AND regexp_matches(lower(alt), '{'|'.join(vocab.FOOD_IMAGE_TERMS)}')
        AND NOT regexp_matches(lower(url), '(^|[^a-z0-9])({'|'.join(vocab.NON_FOOD_URL_TERMS + ('en',))})([^a-z0-9]|$)') """))
def filter_food_image_meta(d: Domain):
    i = F.col("page_id")
    photos = d.table("pages").select("page_id", F.regexp_replace("url", "/en/", "/book/").alias("url"),
                                     F.when(i % 4 == 0, "A salad plate").when(i % 4 == 1, "Cookbook and soup").when(i % 4 == 2, "").otherwise("Fish dish").alias("alt"))
    return catalog.food_photos(photos).select("page_id")


@query("deterministic_match", sql("SELECT recipe_id, 85 + abs(recipe_id) % 14 AS match_pct FROM recipes", "recipes"))
def deterministic_match(d: Domain):
    return catalog.deterministic_match(d.recipes)


@query("agg_url_signature_dups", """
    WITH s AS (SELECT page_id AS id, page_id % 3 <> 0 AS auto, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/'
        ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END) AS signature FROM pages),
    c AS (SELECT signature, count(*) AS n FROM s WHERE auto GROUP BY 1)
    SELECT id, s.signature, coalesce(n, 0) AS n, auto AND coalesce(n, 0) > 1 AS needs_refresh FROM s LEFT JOIN c ON c.signature = s.signature""")
def agg_url_signature_dups(d: Domain):
    images = d.table("pages").select(F.col("page_id").alias("id"), "url", F.when(F.col("page_id") % 3 != 0, "auto").otherwise("manual").alias("source_tier"))
    return catalog.url_signature_dups(images)


# ---- catalog functions ------------------------------------------------------------------------------------

@query("sync_recipe_ingredients", sql("""
    SELECT 'dim' AS part, -1::BIGINT AS recipe_id, nn AS normalized_name, arg_max(trim(ingredient_name), recipe_id * 10 + pos) AS ingredient_name FROM ri WHERE nn <> '' GROUP BY nn
    UNION ALL SELECT 'bridge', recipe_id, nn, arg_max(ingredient_name, pos) FROM ri WHERE nn <> '' GROUP BY recipe_id, nn""", "ri"))
def sync_recipe_ingredients(d: Domain):
    dim, bridge = catalog.sync_ingredients(d.recipes)
    return dim.select(F.lit("dim").alias("part"), F.lit(-1).cast("long").alias("recipe_id"), "normalized_name", "ingredient_name").unionByName(
        bridge.select(F.lit("bridge").alias("part"), "recipe_id", "normalized_name", "ingredient_name"))


@query("sync_population_priors", sql(f"""
    SELECT ingredient_name, {n_ing('ingredient_name')} AS normalized_name, trigger_group,
        CASE trigger_group WHEN 'fructans_gos' THEN 0.55 WHEN 'lactose' THEN 0.5 WHEN 'excess_fructose' THEN 0.45 WHEN 'polyols' THEN 0.45
        WHEN 'gas_producing' THEN 0.35 WHEN 'fatty_spicy_processed' THEN 0.35 WHEN 'caffeine_alcohol_fizzy' THEN 0.3 ELSE 0.25 END::DOUBLE AS population_risk_score,
        0.35::DOUBLE AS confidence FROM ingredient_catalog""", "ingredient_catalog"))
def sync_population_priors(d: Domain):
    return catalog.sync_priors(d.ingredient_catalog)


@query("diverse_titles", sql("""
    SELECT row_number() OVER (ORDER BY later, pos) AS pos, recipe_id FROM (SELECT recipe_id, recipe_id AS pos,
        (recipe_id <> min(recipe_id) OVER (PARTITION BY name))::INT AS later FROM recipes) QUALIFY row_number() OVER (ORDER BY later, pos) <= 500""", "recipes"))
def diverse_titles(d: Domain):
    return catalog.diverse_titles(d.recipes.withColumn("pos", F.col("recipe_id")), 500)


@query("random_sample_pool", sql(f"SELECT recipe_id, name FROM recipes ORDER BY {md5_unit(7, 'recipe_id')}, recipe_id LIMIT 200", "recipes"))
def random_sample_pool(d: Domain):
    return catalog.random_pool(d.recipes.select("recipe_id", "name"), 200)


@query("fn_item_features", sql(f"""
    SELECT recipe_id, 'item:ingredient:' || unnest(i) AS feature, {r6('1.0 / len(i)')} AS weight FROM x
    UNION ALL SELECT recipe_id, 'item:ingredient:unknown', 0.25::DOUBLE FROM x WHERE len(i) = 0
    UNION ALL SELECT recipe_id, 'item:minutes:' || CASE WHEN minutes IS NULL THEN 'unknown' WHEN minutes <= 15 THEN 'le_15' WHEN minutes <= 30 THEN 'le_30'
        WHEN minutes <= 60 THEN 'le_60' WHEN minutes <= 120 THEN 'le_120' ELSE 'gt_120' END, 0.3::DOUBLE FROM x
    UNION ALL SELECT recipe_id, 'item:steps:' || CASE WHEN n_steps <= 5 THEN 'le_5' WHEN n_steps <= 10 THEN 'le_10' WHEN n_steps <= 20 THEN 'le_20' ELSE 'le_35' END, 0.2::DOUBLE FROM x
    UNION ALL SELECT recipe_id, 'item:ingredient_count:' || CASE WHEN n_ingredients IS NULL THEN 'unknown' ELSE 'le_5' END, 0.2::DOUBLE FROM x
    UNION ALL SELECT recipe_id, 'item:nutrition:' || name || ':' || CASE WHEN v IS NULL THEN 'unknown' WHEN v <= l[1] THEN 'le_' || l[1]::INT WHEN v <= l[2] THEN 'le_' || l[2]::INT
        WHEN v <= l[3] THEN 'le_' || l[3]::INT WHEN v <= l[4] THEN 'le_' || l[4]::INT ELSE 'gt_' || l[4]::INT END, 0.12::DOUBLE FROM (
        SELECT recipe_id, nutrition[i] AS v, nm AS name, l FROM recipes, (VALUES (1, 'calories', [150, 300, 500, 800]), (2, 'fat', [5, 15, 30, 50]), (3, 'sugar', [5, 15, 30, 60]),
        (4, 'sodium', [5, 15, 30, 60]), (5, 'protein', [5, 15, 30, 50]), (6, 'saturated_fat', [3, 8, 15, 30]), (7, 'carbs', [15, 30, 60, 100])) t(i, nm, l))
    UNION ALL SELECT recipe_id, 'item:ibs_friendly:' || CASE WHEN is_ibs_friendly THEN 'True' ELSE 'False' END, 0.15::DOUBLE FROM x WHERE is_ibs_friendly IS NOT NULL""",
    "recipes", x=f"SELECT *, list_distinct(list_filter(list_transform(ingredients, lambda t: {n_text('t')}), lambda t: t <> '')) AS i FROM recipes"))
def fn_item_features(d: Domain):
    return catalog.item_features(d.recipes)


_RULES = {"specific": [("hot_thing", ["hot ring", "hot gear"]), ("red_thing", ["red-", "red bolt"])],
          "general": [("rings", ["ring", "rod"]), ("cheap", ["economy"]), ("heavy", ["anvil", "plat"])],
          "meal": [("brand", ["brand#1", "brand 9"]), ("widgets", ["widgets"])]}


@query("fn_cat_rules", sql("""
    SELECT recipe_id, CASE WHEN contains(t, 'hot ring') OR contains(t, 'hot gear') THEN 'hot_thing' WHEN contains(t, 'red-') OR contains(t, 'red bolt') THEN 'red_thing'
        WHEN regexp_matches(t, '(^|[^a-z0-9])(ring|rod)([^a-z0-9]|$)') THEN 'rings' WHEN regexp_matches(t, '(^|[^a-z0-9])economy([^a-z0-9]|$)') THEN 'cheap'
        WHEN regexp_matches(t, '(^|[^a-z0-9])(anvil|plat)([^a-z0-9]|$)') THEN 'heavy'
        WHEN contains(i, 'hot ring') OR contains(i, 'hot gear') THEN 'hot_thing' WHEN contains(i, 'red-') OR contains(i, 'red bolt') THEN 'red_thing'
        WHEN regexp_matches(a, '(^|[^a-z0-9])brand#1([^a-z0-9]|$)') OR contains(a, 'brand 9') THEN 'brand' WHEN regexp_matches(a, '(^|[^a-z0-9])widgets([^a-z0-9]|$)') THEN 'widgets'
        WHEN regexp_matches(i, '(^|[^a-z0-9])(ring|rod)([^a-z0-9]|$)') THEN 'rings' WHEN regexp_matches(i, '(^|[^a-z0-9])economy([^a-z0-9]|$)') THEN 'cheap'
        WHEN regexp_matches(i, '(^|[^a-z0-9])(anvil|plat)([^a-z0-9]|$)') THEN 'heavy' ELSE 'general_food' END AS category
    FROM (SELECT recipe_id, lower(name) AS t, lower(array_to_string(ingredients, ' ')) AS i, lower(name || ' ' || array_to_string(ingredients, ' ') || ' ' || description) AS a FROM recipes)""", "recipes"))
def fn_cat_rules(d: Domain):
    return catalog.categories(d.recipes, _RULES)


@query("fn_macro_ratios", sql(f"""
    SELECT recipe_id, {r6('CASE WHEN len(nutrition) >= 7 THEN nutrition[5] / (nutrition[7] + 1e-5) ELSE 0 END')} AS protein_to_carb_ratio,
        {r6('CASE WHEN len(nutrition) >= 7 THEN nutrition[5] / (nutrition[1] + 1e-5) ELSE 0 END')} AS protein_to_calorie_ratio FROM recipes""", "recipes"))
def fn_macro_ratios(d: Domain):
    return catalog.macro_features(d.recipes)


@query("fn_nutrition_array", sql(f"""
    SELECT recipe_id, i - 1 AS slot, {r6('CASE WHEN v IS NULL OR NOT isfinite(v) THEN 0 ELSE v END')} AS value, present FROM (
        SELECT recipe_id, t.i::BIGINT AS i, CASE WHEN t.i = 2 AND recipe_id % 30 = 0 THEN 'inf'::DOUBLE WHEN t.i = 3 AND recipe_id % 31 = 0 THEN -nutrition[3] - 1 ELSE nutrition[t.i] END AS v,
            len(nutrition) >= 7 AND recipe_id % 30 <> 0 AND recipe_id % 31 <> 0 AS present
        FROM recipes, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS i) t)""", "recipes"))
def fn_nutrition_array(d: Domain):
    bad = F.transform("nutrition", lambda x, i: F.when((i == 1) & (F.col("recipe_id") % 30 == 0), float("inf")).when(
        (i == 2) & (F.col("recipe_id") % 31 == 0), -x - 1).otherwise(x))
    rows = d.recipes.withColumn("nutrition", bad)
    return rows.select("recipe_id", F.posexplode(num.nutrition_array(F.col("nutrition"))).alias("slot", "value"),
                       num.nutrition_present(F.col("nutrition")).alias("present"))
