"""Queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import numbers as num, text as tx, vectors as vec
from ..operators import checkins as ck, content, preference, ranking
from .mapping import KEYWORDS, UNITS, Domain, c01, day, has, lst, mask, n_ing, n_plain, n_text, r6, sql, status, ts
from .registry import query


@query("fn_normalize_ingredient", f"SELECT doc_id, {n_ing('text')} AS norm FROM documents")
def fn_normalize_ingredient(d: Domain):
    return d.table("documents").select("doc_id", tx.normalize_ingredient(F.col("text")).alias("norm"))


@query("fn_normalize_text", f"""
    SELECT doc_id, {n_text('text')} AS hyphen, {n_plain('text')} AS plain FROM documents""")
def fn_normalize_text(d: Domain):
    t = F.col("text")
    return d.table("documents").select(
        "doc_id", tx.normalize_text(t).alias("hyphen"), tx.normalize_text(t, keep_hyphen=False).alias("plain"))


@query("fn_mask_phrases", f"""
    SELECT doc_id, {mask(n_ing('text'), ('the', 'of the', 'in a', 'and'))} AS masked FROM documents""")
def fn_mask_phrases(d: Domain):
    return d.table("documents").select(
        "doc_id", tx.mask_phrases(tx.normalize_ingredient(F.col("text")), ("the", "of the", "in a", "and")).alias("masked"))


@query("fn_keyword_prior", sql(f"""
    SELECT recipe_id, pos, CASE WHEN {has('nn', "'red'")} THEN 0.6 WHEN {has('nn', "'ring'")} THEN 0.5 WHEN {has('nn', "'gizmo'")} THEN 0.4
        WHEN {has('nn', "'bolt'")} THEN 0.35 WHEN {has('nn', "'economy'")} THEN 0.3 ELSE 0.08 END::DOUBLE AS prior FROM ri""", "ri"))
def fn_keyword_prior(d: Domain):
    from ..operators.catalog import recipe_ingredients

    return recipe_ingredients(d.recipes).select("recipe_id", "pos", tx.keyword_prior(F.col("normalized_name"), KEYWORDS).alias("prior"))


@query("fn_clamp01", f"""
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, {r6(c01("CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 AND l_quantity > 40 THEN 'NaN'::DOUBLE WHEN l_linenumber = 3 AND l_quantity > 45 THEN 'inf'::DOUBLE ELSE l_quantity / 25 - 0.2 END"))} AS v FROM lineitem""")
def fn_clamp01(d: Domain):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    x = F.when(n == 1, F.lit(None).cast("double")).when((n == 2) & (q > 40), float("nan")).when((n == 3) & (q > 45), float("inf")).otherwise(q / 25 - 0.2)
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", num.clamp01(x).alias("v"))


@query("fn_optional_float", """
    SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 7 = 1 OR event_id % 7 = 2 OR value - 100 < 0 THEN -1 ELSE round(value - 100, 6) + 0.0 END::DOUBLE AS v FROM events""")
def fn_optional_float(d: Domain):
    i = F.col("event_id") % 7
    text = F.when(i == 0, "").when(i == 1, "bad").when(i == 2, "NaN").otherwise((F.col("value") - 100).cast("string"))
    return d.events.select("event_id", F.coalesce(num.optional_float(text, 0.0), F.lit(-1.0)).alias("v"))


@query("fn_meal_nutrition", sql(f"""
    SELECT meal_log_id, {r6('coalesce(CASE WHEN u THEN rc ELSE calories END, -1)')} AS calories, {r6('coalesce(CASE WHEN u THEN rp ELSE protein_g END, -1)')} AS protein_g,
        {r6('coalesce(CASE WHEN u THEN rf ELSE fat_g END, -1)')} AS fat_g, CASE WHEN u THEN 'catalog_recipe' ELSE nutrition_source END AS nutrition_source,
        {r6('coalesce(CASE WHEN u THEN 0.9 ELSE nutrition_confidence END, -1)')} AS nutrition_confidence FROM (
        SELECT m.*, nutrition[1] AS rc, nutrition[5] AS rp, nutrition[2] AS rf,
            calories IS NULL AND protein_g IS NULL AND fat_g IS NULL AND nutrition IS NOT NULL AS u FROM meals m LEFT JOIN recipes r ON r.recipe_id = m.recipe_id)""", "meals", "recipes"))
def fn_meal_nutrition(d: Domain):
    from ..operators.exposure import meal_nutrition

    out = meal_nutrition(d.meals, d.recipes)
    z = lambda c: F.coalesce(F.col(c), F.lit(-1.0)).alias(c)
    return out.select("meal_log_id", z("calories"), z("protein_g"), z("fat_g"), "nutrition_source", z("nutrition_confidence"))


@query("fn_parse_timestamp", f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 2 THEN {ts('o_orderdate - INTERVAL 2 HOUR')} ELSE {ts('o_orderdate')} END AS at_utc FROM orders""")
def fn_parse_timestamp(d: Domain):
    i, t = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(i == 0, F.concat(t, F.lit("Z"))).when(i == 1, t).when(i == 2, F.concat(t, F.lit("+02:00")))
            .when(i == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("yesterday"))
    return d.table("orders").select("o_orderkey", num.parse_timestamp(text).alias("at_utc"))


@query("fn_bucket", f"""
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE WHEN q IS NULL THEN 'unknown' WHEN q <= 5 THEN 'le_5' WHEN q <= 12.5 THEN 'le_12.5' WHEN q <= 30 THEN 'le_30' ELSE 'gt_30' END AS bucket,
        CASE WHEN l_discount * 8 < 0.25 THEN 'low' WHEN l_discount * 8 < 0.55 THEN 'medium' ELSE 'high' END AS risk
    FROM (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS q FROM lineitem)""")
def fn_bucket(d: Domain):
    q = F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", num.bucket_name(q, (5.0, 12.5, 30.0)).alias("bucket"),
                                      num.risk_bucket(F.col("l_discount") * 8).alias("risk"))


@query("fn_status_ladder", sql(f"""
    SELECT user_id, ingredient_name, {status('risk_score', 'confidence')} AS status FROM generic_risks""", "generic_risks"))
def fn_status_ladder(d: Domain):
    return d.generic_risks.select("user_id", "ingredient_name", num.status_ladder(F.col("risk_score"), F.col("confidence")).alias("status"))


@query("fn_decay_weight", f"""
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, {r6('CASE WHEN h > 48 THEN 0 ELSE exp(-greatest(h, 0) / 18.0) END')} AS w FROM (
        SELECT *, (l_quantity * 1.5 - 10)::DOUBLE AS h FROM lineitem)""")
def fn_decay_weight(d: Domain):
    micros = F.unix_micros("l_shipdate") + ((F.col("l_quantity") * 1.5 - 10) * 3_600_000_000).cast("long")
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                      num.decay_weight(F.col("l_shipdate"), F.timestamp_micros(micros)).alias("w"))


@query("fn_time_cyclic", f"""
    SELECT event_id, {r6('sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24)')} AS t_sin, {r6('cos(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24)')} AS t_cos FROM events""")
def fn_time_cyclic(d: Domain):
    sin, cos = num.time_cyclic(F.col("ts"))
    return d.events.select("event_id", sin.alias("t_sin"), cos.alias("t_cos"))


@query("fn_portion_unit_onehot", sql("""
    SELECT meal_log_id, (u = 'g')::INT::DOUBLE AS portion_unit_grams, 0.0::DOUBLE AS portion_unit_ounces, (u = 'Pieces')::INT::DOUBLE AS portion_unit_servings,
        (u = 'cups')::INT::DOUBLE AS portion_unit_volume, (u = 'slice')::INT::DOUBLE AS portion_unit_other, (u = '')::INT::DOUBLE AS portion_unit_unknown
    FROM (SELECT meal_log_id, portion_unit AS u FROM meals)""", "meals"))
def fn_portion_unit_onehot(d: Domain):
    fam = tx.unit_family(F.col("portion_unit"))
    return d.meals.select("meal_log_id", *[(fam == f).cast("double").alias(f"portion_unit_{f}") for f in (*vocab.UNIT_FAMILIES, "other", "unknown")])


@query("fn_cosine", """
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings)""")
def fn_cosine(d: Domain):
    f = d.item_factors
    n = f.agg(F.count(F.lit(1))).scalar()
    a = f.select(F.col("recipe_id").alias("a"), F.col("vec").alias("va")).withColumn("b", (F.col("a") * 7 + 1) % n)
    return a.join(f.select(F.col("recipe_id").alias("b"), F.col("vec").alias("vb")), "b").select(
        "a", "b", vec.cosine(F.col("va"), F.col("vb")).alias("cosine"))


@query("fn_blend_vectors", """
    SELECT a.vec_id AS id, i::BIGINT - 1 AS dim, round(CASE WHEN a.vec_id % 4 = 0 THEN 0.3 * b.embedding[i] WHEN a.vec_id % 4 = 1 THEN a.embedding[i]
        WHEN a.vec_id % 4 = 2 THEN a.embedding[i] ELSE 0.7 * a.embedding[i] + 0.3 * b.embedding[i] END::DOUBLE, 4) + 0.0 AS v
    FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings), (SELECT unnest(range(1, 65)) AS i) t""")
def fn_blend_vectors(d: Domain):
    f = d.item_factors
    n = f.agg(F.count(F.lit(1))).scalar()
    a = f.select(F.col("recipe_id").alias("id"), F.col("vec").alias("va")).withColumn("b", (F.col("id") * 7 + 1) % n)
    i = F.col("id") % 4
    none = F.lit(None).cast("array<double>")
    both = a.join(f.select(F.col("recipe_id").alias("b"), F.col("vec").alias("vb")), "b").select(
        "id", F.when(i == 0, none).otherwise(F.col("va")).alias("learned"),
        F.when(i == 1, none).when(i == 2, F.slice("vb", 1, 10)).otherwise(F.col("vb")).alias("online"))
    out = vec.blend(F.col("learned"), F.col("online"), F.lit(0.3))
    return both.select("id", F.posexplode(out).alias("dim", "v")).withColumn("v", F.round("v", 4))


@query("fn_bounded_delta", sql(f"""
    SELECT p.user_id, p.recipe_id, {r6('p.preference_score + CASE WHEN f.vec IS NULL OR u.vec IS NULL THEN 0 ELSE greatest(-0.02, least(0.02, 0.25 * list_dot_product(f.vec, u.vec))) END')} AS score
    FROM preference p LEFT JOIN item_factors f ON f.recipe_id = p.recipe_id LEFT JOIN item_factors u ON u.recipe_id = p.user_id::BIGINT""", "preference", "item_factors"))
def fn_bounded_delta(d: Domain):
    online = d.item_factors.select(F.col("recipe_id").cast("string").alias("user_id"), "vec", F.lit(0.25).alias("weight"))
    out = preference.bounded_delta(d.preference, d.item_factors, online, limit=0.02)
    return out.select("user_id", "recipe_id", F.col("preference_score").alias("score"))


@query("fn_reconstruct_score", sql(f"""
    SELECT p.user_id, p.recipe_id, {r6('3 + f.bias + 0.1 + coalesce(list_dot_product(f.vec, u.vec), 0)')} AS hybrid,
        {r6('3 + f.bias + coalesce(greatest(-0.02, least(0.02, 0.5 * list_dot_product(f.vec, u.vec))), 0)')} AS plain
    FROM pairs p JOIN item_factors f ON f.recipe_id = p.recipe_id JOIN item_factors u ON u.recipe_id = p.user_id::BIGINT""", "pairs", "item_factors"))
def fn_reconstruct_score(d: Domain):
    users = d.item_factors.select(F.col("recipe_id").cast("string").alias("user_id"), "vec", F.lit(0.1).alias("bias"), F.lit(0.5).alias("weight"))
    meta = d.spark.range(1).select(F.lit(3.0).alias("global_mean"))
    pairs = d.pairs.join(users.select("user_id"), "user_id", "left_semi")
    a = preference.factor_scores(pairs, d.item_factors, users, meta).withColumnRenamed("score", "hybrid")
    b = preference.factor_scores(pairs, d.item_factors, users, meta, hybrid=False, limit=0.02).withColumnRenamed("score", "plain")
    return a.join(b, ["user_id", "recipe_id"])


@query("fn_chat_meal_time", sql(f"""
    SELECT checkin_id, w, {ts("created_at - CASE w WHEN 0 THEN INTERVAL 240 MINUTE WHEN 1 THEN INTERVAL 750 MINUTE ELSE INTERVAL 1230 MINUTE END")} AS logged_at
    FROM raw_checkins, (VALUES (0::BIGINT), (1), (2)) t(w)""", "raw_checkins"))
def fn_chat_meal_time(d: Domain):
    rows = d.raw_checkins.select("checkin_id", "created_at", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("w"))
    return rows.select("checkin_id", "w", ck.chat_meal_time(F.col("created_at"), F.col("w")).alias("logged_at"))


@query("fn_split_personal_ingredients", sql("""
    SELECT id, user_id, recipe_id, cooklist_id, CASE ingredients WHEN 'red, small ring' THEN 'red|small ring' WHEN 'gizmo' THEN 'gizmo' ELSE 'bolts|blue' END AS parts
    FROM cooklists WHERE ingredients IS NOT NULL""", "cooklists"))
def fn_split_personal_ingredients(d: Domain):
    return d.cooklists.where("ingredients is not null").select("id", "user_id", "recipe_id", "cooklist_id", tx.split_personal(F.col("ingredients")).alias("parts"))


@query("fn_format_name", sql(f"""
    SELECT recipe_id, array_to_string(list_transform(list_filter(string_split({n_text("name || ' & ' || description")}, ' '), lambda w: w <> ''),
        lambda w: CASE WHEN length(w) <= 2 THEN upper(w) ELSE upper(left(w, 1)) || substr(w, 2) END), ' ') AS shown FROM recipes""", "recipes"))
def fn_format_name(d: Domain):
    return d.recipes.select("recipe_id", tx.format_name(F.concat("name", F.lit(" & "), "description")).alias("shown"))


@query("fn_weighted_tokens", f"""
    SELECT id, token, {r6('sum(w)')} AS weight FROM (SELECT doc_id AS id, unnest(string_split(replace({n_text('text')}, '-', ' '), ' ')) AS token, CASE WHEN doc_id % 2 = 0 THEN 2.5 ELSE 0.75 END AS w FROM documents)
    WHERE length(token) > 2 AND token NOT IN ({', '.join(repr(w) for w in vocab.CONTENT_STOP_WORDS)}) GROUP BY ALL""")
def fn_weighted_tokens(d: Domain):
    docs = d.table("documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 2 == 0, 2.5).otherwise(0.75).alias("weight"))
    return content.weighted_tokens(docs)


@query("fn_generation_name", f"""
    SELECT o_orderkey, 'factors@' || regexp_replace({day('o_orderdate')} || 'T10:00:00+00:00', '[^A-Za-z0-9]', '', 'g') AS generation FROM orders""")
def fn_generation_name(d: Domain):
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00+00:00"))
    return d.table("orders").select("o_orderkey", tx.generation_name(F.lit(" factors "), at).alias("generation"))


@query("fn_display_match", sql("""
    SELECT user_id, rn - 1 AS pos, recipe_id AS id, CASE WHEN rn <= 3 AND rn % 2 = 1 THEN floor((preference_score / 7) * 100 + 0.5)::INT || '%' END AS pct
    FROM preference WHERE rn <= 5""", "preference"))
def fn_display_match(d: Domain):
    few = d.preference.where("rn <= 5").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "recipe_id", "preference_score"))).alias("x"))
    score = F.transform(F.slice("x", 1, 3), lambda e: F.when(e["rn"] % 2 == 1, e["preference_score"] / 7).otherwise(0.0))
    return ranking.display_match(few.select("user_id", F.transform("x", lambda e: e["recipe_id"]).alias("ids"), score.alias("scores")))
