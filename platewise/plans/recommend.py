"""Queries: vectors, rescoring, rerank, rows, cookbook, neighbourhood and factor models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import catalog, cf, content, cookbook, preference, ranking, ratings, refresh, risk, svd, warp
from ..session import write_and_read
from .health import _CONTEXT, _HEUR, _PROFILE, RISK
from .mapping import ALIASES, KEYWORDS, NOW, RULE, Domain, lst, md5_unit, n_ing, n_text, r6, sql, ts
from .registry import query
from .safety import SIGNAL_DEPS, _GROUPS, _HITS

_DIMS = "(SELECT unnest(range(1, 65)) AS i) t"


def _long(df, *keys):
    """Vectors as rows, rounded to what both summation orders agree on."""
    return df.select(*keys, F.posexplode("vec").alias("dim", "v"))


@query("agg_user_vector", sql(f"""
    SELECT user_id, i::BIGINT - 1 AS dim, {r6('sum(rating * vec[i]) / sum(rating)')} AS v FROM mean_ratings m JOIN item_factors f ON f.recipe_id = m.recipe_id, {_DIMS} WHERE rating > 1 GROUP BY ALL""", "mean_ratings", "item_factors"))
def agg_user_vector(d: Domain):
    return _long(preference.user_vectors(d.mean_ratings.where("rating > 1"), d.item_factors), "user_id")


@query("agg_online_strength", sql(f"""
    SELECT user_id, {r6('0.35 * least(1.0, sum(greatest(rating - 2, 0)) / 60)')} AS weight FROM ratings GROUP BY 1""", "ratings"))
def agg_online_strength(d: Domain):
    return preference.online_strength(d.ratings.withColumn("rating", F.col("rating") - 2), full=60.0)


_SEEDS = "SELECT recipe_id FROM recipes WHERE regexp_matches(lower(array_to_string(ingredients, ' ')), 'hot|red')"
_CENTER = f"SELECT list(v ORDER BY i) AS c FROM (SELECT i, avg(vec[i]) AS v FROM item_factors JOIN seeds USING (recipe_id), {_DIMS} GROUP BY i)"


@query("agg_centroid", sql(f"SELECT i::BIGINT - 1 AS dim, {r6('c[i]')} AS v FROM center, {_DIMS}", "recipes", "item_factors", seeds=_SEEDS, center=_CENTER))
def agg_centroid(d: Domain):
    return _long(preference.centroid(catalog.flavor_seeds(d.recipes, ("hot", "red")), d.item_factors))


@query("flavor_similarity", sql(f"""
    SELECT user_id, p.recipe_id, {r6('list_cosine_similarity(vec, c)')} AS cosine FROM preference p JOIN item_factors f ON f.recipe_id = p.recipe_id, center""", "preference", "recipes", "item_factors", seeds=_SEEDS, center=_CENTER))
def flavor_similarity(d: Domain):
    return preference.flavor_similarity(d.preference, d.item_factors, preference.centroid(catalog.flavor_seeds(d.recipes, ("hot", "red")), d.item_factors))


_STATE = "SELECT c_custkey::VARCHAR AS user_id, vec, 0.05::DOUBLE AS ub FROM customer JOIN item_factors ON recipe_id = c_custkey % (SELECT count(*) FROM item_factors)"


def _state(d: Domain):
    n = d.item_factors.agg(F.count(F.lit(1))).scalar()
    c = d.table("customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_custkey")).withColumn("recipe_id", F.col("c_custkey") % n)
    return c.join(d.item_factors.select("recipe_id", "vec"), "recipe_id").select("user_id", "vec", F.lit(0.05).alias("bias"))


@query("join_factor_scores", sql(f"""
    SELECT p.user_id, p.recipe_id, {r6('2.5 + bias + ub + list_dot_product(f.vec, s.vec)')} AS score FROM pairs p JOIN item_factors f ON f.recipe_id = p.recipe_id JOIN s ON s.user_id = p.user_id""", "pairs", "item_factors", s=_STATE))
def join_factor_scores(d: Domain):
    meta = d.spark.range(1).select(F.lit(2.5).alias("global_mean"))
    return preference.factor_scores(d.pairs, d.item_factors, _state(d), meta)


@query("online_rescore", sql(f"""
    SELECT user_id, rn, recipe_id, {r6('sc')} AS preference_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sc DESC, recipe_id) AS rn FROM (
        SELECT user_id, recipe_id, sc FROM scored JOIN cand USING (user_id, recipe_id) UNION ALL SELECT user_id, recipe_id, sc FROM scored
        WHERE user_id NOT IN (SELECT user_id FROM scored JOIN cand USING (user_id, recipe_id)))) WHERE rn <= 10""", "pairs", "preference", "item_factors", s=_STATE,
    cand="SELECT user_id, recipe_id FROM preference WHERE preference_score >= 4.5",
    scored="SELECT p.user_id, p.recipe_id, round(2.5 + bias + ub + list_dot_product(f.vec, s.vec), 9) AS sc FROM pairs p JOIN item_factors f ON f.recipe_id = p.recipe_id JOIN s ON s.user_id = p.user_id"))
def online_rescore(d: Domain):
    meta = d.spark.range(1).select(F.lit(2.5).alias("global_mean"))
    scores = preference.factor_scores(d.pairs, d.item_factors, _state(d), meta).withColumn("score", F.round("score", 9))
    return preference.online_rescore(d.preference.where("preference_score >= 4.5"), scores, 10)


@query("zero_cold_identity", sql(f"""
    SELECT entity, feature, {r6('w')} AS weight FROM (SELECT recipe_id::VARCHAR AS entity, recipe_id::VARCHAR AS feature, 1.0 AS w FROM recipes UNION ALL SELECT recipe_id::VARCHAR, 'word:' || nn, 0.5 FROM ri) x
    WHERE feature <> entity OR entity IN (SELECT recipe_id::VARCHAR FROM ratings WHERE rating >= 5)""", "recipes", "ri", "ratings"))
def zero_cold_identity(d: Domain):
    e = F.col("recipe_id").cast("string")
    rows = d.recipes.select(e.alias("entity"), e.alias("feature"), F.lit(1.0).alias("weight")).unionByName(
        catalog.recipe_ingredients(d.recipes).select(e.alias("entity"), F.concat(F.lit("word:"), "normalized_name").alias("feature"), F.lit(0.5).alias("weight")))
    return preference.zero_cold_identity(rows, d.ratings.where("rating >= 5").select(e.alias("entity")))


@query("bootstrap_user_vector", sql(f"""
    SELECT user_id, i::BIGINT - 1 AS dim, {r6('sum(w * vec[i]) / sum(abs(w))')} AS v FROM (SELECT user_id, recipe_id, rating - 3 AS w FROM mean_ratings WHERE rating <> 3) m JOIN item_factors f ON f.recipe_id = m.recipe_id, {_DIMS} GROUP BY ALL""",
    "mean_ratings", "item_factors"))
def bootstrap_user_vector(d: Domain):
    feedback = d.mean_ratings.where("rating != 3").select("user_id", "recipe_id", (F.col("rating") - 3).alias("w"))
    return _long(preference.bootstrap_vectors(feedback, d.item_factors), "user_id")


@query("recommend_by_vector", sql(f"""
    SELECT user_id, rn, recipe_id, {r6('sim')} AS similarity FROM (SELECT s.user_id, f.recipe_id, list_cosine_similarity(f.vec, s.vec) AS sim, row_number() OVER (PARTITION BY s.user_id ORDER BY list_cosine_similarity(f.vec, s.vec) DESC, f.recipe_id) AS rn
        FROM s, item_factors f WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.user_id = s.user_id AND p.recipe_id = f.recipe_id)) WHERE rn <= 5""", "pairs", "item_factors", s=_STATE))
def recommend_by_vector(d: Domain):
    return preference.recommend_by_vector(_state(d), d.item_factors, d.kept("pairs"))


# ---- rerank and rows ------------------------------------------------------------------------------------------

_RERANKED = f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(final, 10) DESC, rn0, recipe_id) AS rn FROM (SELECT c.user_id, c.recipe_id, c.rn AS rn0, preference_score, score AS ir, sr, least(1.0, 0.4 * score + 0.6 * sr) AS comb, matched,
    preference_score - least(1.0, 0.4 * score + 0.6 * sr) AS final FROM (SELECT *, {_HEUR} AS sr FROM (SELECT p.*, i.score, i.matched, f.groups, x.smax, x.load, CASE WHEN len(r.nutrition) >= 7 THEN r.nutrition ELSE list_concat(r.nutrition, [0.0, 0.0, 0.0, 0.0]) END AS nut
        FROM preference p JOIN irisk i ON i.user_id = p.user_id AND i.recipe_id = p.recipe_id JOIN recipes r ON r.recipe_id = p.recipe_id JOIN prof f ON f.recipe_id = p.recipe_id JOIN c x ON x.ref_id = p.user_id)) c
    JOIN safe s ON s.user_id = c.user_id AND s.recipe_id = c.recipe_id)"""
_SAFE = """SELECT p.user_id, p.recipe_id FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM strict s JOIN ri ON ri.recipe_id = p.recipe_id JOIN hits h ON h.nn = ri.nn AND h.name = s.name WHERE s.user_id = p.user_id)
    AND NOT EXISTS (SELECT 1 FROM strict s WHERE s.user_id = p.user_id AND s.name = '')
    AND (NOT EXISTS (SELECT 1 FROM strict s WHERE s.user_id = p.user_id) OR EXISTS (SELECT 1 FROM ri WHERE ri.recipe_id = p.recipe_id))"""
_RANK_DEPS = ("pairs", "preference", "strict", "recipes", "meals", "reports", *SIGNAL_DEPS)
_RANK = {**RISK, "hits": _HITS, "safe": _SAFE, "g": _GROUPS, "prof": _PROFILE, "refs": f"SELECT DISTINCT user_id, user_id AS ref_id, TIMESTAMP '{NOW}' AS ref_ts FROM pairs", "c": _CONTEXT, "reranked": _RERANKED}


def reranked(d: Domain, *columns: str):
    """Candidates without forbidden recipes, ordered by preference minus risk."""
    return refresh.ranked(d.preference, d.recipes, d.restrictions, risk.personal_signals(d.generic_risks, d.profile_risks), risk.population_signals(d.priors, d.ingredient_catalog),
                          d.meals.withColumn("trigger_load", F.col("portion_size")), d.reports, NOW, ALIASES, KEYWORDS, columns, **RULE)


@query("rerank_final", sql(f"""
    SELECT user_id, rn, recipe_id, {r6('preference_score')} AS preference_score, {r6('ir')} AS ingredient_risk, {r6('sr')} AS symptom_risk, {r6('comb')} AS combined_risk, {r6('final')} AS final_score, matched FROM reranked""", *_RANK_DEPS, **_RANK))
def rerank_final(d: Domain):
    return reranked(d).select("user_id", "rn", "recipe_id", "preference_score", "ingredient_risk", "symptom_risk", "combined_risk", "final_score", "matched")


@query("persist_predictions", sql(f"""
    SELECT user_id, recipe_id, 'online_risk_rerank' AS model_name, 'online_rerank' AS prediction_type, {r6('final')} AS score, {r6('comb')} AS combined FROM reranked WHERE rn <= 120""", *_RANK_DEPS, **_RANK))
def persist_predictions(d: Domain):
    rows = risk.persist_predictions(reranked(d))
    return rows.withColumn("combined", F.get_json_object("features", "$.combined_risk_score").cast("double")).drop("features")


def _pass(i: int, name: str, source: str) -> str:
    before = " UNION ALL ".join(f"SELECT user_id, recipe_id FROM row{j}" for j in range(i)) or "SELECT NULL AS user_id, NULL AS recipe_id WHERE false"
    return f"""SELECT user_id, '{name}' AS row_name, rank, recipe_id, final FROM (SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY {source}) AS rank FROM pool s
        WHERE ok_{name} AND NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.user_id = s.user_id AND b.recipe_id = s.recipe_id)) WHERE rank <= 2"""


@query("category_greedy_rows", sql(
    f"SELECT user_id, row_name, rank, recipe_id, {r6('final')} AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM row{i}" for i in range(5)) + ")", *_RANK_DEPS, "app_log", "item_factors", **_RANK,
    seeds=_SEEDS, center=_CENTER,
    ranked="SELECT user_id, rn, recipe_id, final FROM reranked",
    trend="SELECT recipe_id, row_number() OVER (ORDER BY count(*) DESC, max(created_at) DESC, recipe_id) AS trn FROM app_log WHERE interaction_type IN ('liked', 'saved', 'started', 'completed') AND created_at >= TIMESTAMP '2024-01-24' GROUP BY 1 QUALIFY trn <= 200",
    pool="""SELECT r.*, trn, round(list_cosine_similarity(f.vec, c), 9) AS cosine, true AS ok_curated, true AS ok_trending, f.vec IS NOT NULL AND regexp_matches(lower(array_to_string(ingredients, ' ')), 'ring|anvil|gear') AS ok_flavor,
        len(nutrition) >= 2 AND nutrition[1] < 400 AND nutrition[2] < 20 AS ok_healthy, coalesce(minutes < 30, false) AS ok_quick
        FROM ranked r JOIN recipes x ON x.recipe_id = r.recipe_id LEFT JOIN trend t ON t.recipe_id = r.recipe_id LEFT JOIN item_factors f ON f.recipe_id = r.recipe_id, center
        WHERE NOT EXISTS (SELECT 1 FROM app_log a WHERE a.user_id = r.user_id AND a.recipe_id = r.recipe_id AND interaction_type IN ('liked', 'saved'))""",
    row0=_pass(0, "curated", "rn"), row1=_pass(1, "trending", "trn NULLS LAST, rn"), row2=_pass(2, "flavor", "cosine DESC, final DESC, rn"), row3=_pass(3, "healthy", "rn"), row4=_pass(4, "quick", "rn")))
def category_greedy_rows(d: Domain):
    ranked = reranked(d, "user_id", "rn", "recipe_id", "final_score")
    center = preference.centroid(catalog.flavor_seeds(d.recipes, ("hot", "red")), d.item_factors)
    flavor = preference.flavor_similarity(ranked.select("recipe_id"), d.item_factors, center).withColumn("cosine", F.round("cosine", 9))
    rules = {"flavor": catalog.PREDICATES["flavor"](("ring", "anvil", "gear")), "healthy": catalog.PREDICATES["healthy"](), "quick": catalog.PREDICATES["quick"]()}
    return ranking.category_rows(ranked, ratings.trending(d.app_log, NOW), flavor, d.recipes, d.app_log, rules, k=2)


# ---- cookbook ----------------------------------------------------------------------------------------------------

_BOOK = f"""SELECT user_id, recipe_id, coalesce(arg_max(recipe_title, (created_at, id)) FILTER (recipe_title IS NOT NULL), recipe_id) AS recipe_title,
    coalesce(arg_max(recipe_source, (created_at, id)) FILTER (recipe_source IS NOT NULL), 'catalog') AS recipe_source, arg_max(ingredients, (created_at, id)) FILTER (ingredients IS NOT NULL) AS ingredients,
    max(created_at) AS latest_at, count(*) AS n FROM cooklists GROUP BY user_id, recipe_id"""
_NOW_BOOK = "2000-06-30 00:00:00"


@query("agg_cookbook_membership", sql(f"""
    SELECT user_id, recipe_id, recipe_title, recipe_source, ingredients, {ts('latest_at')} AS latest_at, n AS cooklist_count FROM book""", "cooklists", book=_BOOK))
def agg_cookbook_membership(d: Domain):
    return cookbook.cookbook_memberships(d.cooklists)


_NUM = "regexp_extract(recipe_id, '([0-9]+)$', 1)::BIGINT"
_PERSONAL_SCORE = "0.78 + 0.2 * greatest(0.0, least(1.0, 0.55 * fresh + 0.2 * least(1.0, n / 3) + 0.25 * (1 - comb)))"
_BOOKRISK = f"""SELECT *, greatest(0.0, 1 - greatest(0.0, (epoch_us(TIMESTAMP '{_NOW_BOOK}') - epoch_us(latest_at)) / 8.64e10) / 45)::DOUBLE AS fresh, least(1.0, 0.4 * (({_NUM} % 11) / 11.0) + 0.6 * (({_NUM} % 7) / 7.0))::DOUBLE AS comb,
    recipe_source = 'personal' OR starts_with(recipe_id, 'personal-') AS own FROM book"""


def _book_risk(items):
    n = F.regexp_extract("recipe_id", r"(\d+)$", 1).cast("long")
    return items.select("user_id", "recipe_id", ((n % 11) / 11).alias("ingredient_risk"), ((n % 7) / 7).alias("symptom_risk"))


@query("fn_personal_cookbook_score", sql(f"""
    SELECT user_id, recipe_id, {r6(_PERSONAL_SCORE)} AS score, CASE WHEN comb <= 0.25 THEN 'Gentler personal pick' WHEN fresh >= 0.75 THEN 'Recently saved' WHEN least(1.0, n / 3) >= 0.65 THEN 'Saved in multiple cooklists' ELSE 'From your personal recipes' END AS reason,
        {r6('0.78 + 0.2 * (0.72 * fresh + 0.28 * least(1.0, n / 3))')} AS client FROM b2""", "cooklists", book=_BOOK, b2=_BOOKRISK))
def fn_personal_cookbook_score(d: Domain):
    items = write_and_read(cookbook.cookbook_memberships(d.cooklists), "book")
    full = items.join(_book_risk(items), ["user_id", "recipe_id"]).withColumn("combined_risk", risk.combined_risk(F.col("ingredient_risk"), F.col("symptom_risk")))
    a = cookbook.personal_score(full, _NOW_BOOK)
    b = cookbook.client_score(items, _NOW_BOOK).select("user_id", "recipe_id", F.col("score").alias("client"))
    return a.join(b, ["user_id", "recipe_id"]).select("user_id", "recipe_id", "score", "reason", "client")


@query("cookbook_recommend", sql(f"""
    SELECT user_id, rn, recipe_id, source, {r6('sc')} AS score, reason FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sc, 9) DESC, latest_at DESC, recipe_id) AS rn FROM (
        SELECT user_id, recipe_id, 'personal' AS source, {_PERSONAL_SCORE} AS sc, CASE WHEN comb <= 0.25 THEN 'Gentler personal pick' WHEN fresh >= 0.75 THEN 'Recently saved' WHEN least(1.0, n / 3) >= 0.65 THEN 'Saved in multiple cooklists' ELSE 'From your personal recipes' END AS reason, latest_at FROM b2 WHERE own
        UNION ALL SELECT user_id, recipe_id, 'catalog', CASE WHEN max(f) OVER w = min(f) OVER w THEN 0.9 ELSE (f - min(f) OVER w) / (max(f) OVER w - min(f) OVER w) * 0.2 + 0.78 END,
            CASE WHEN comb <= 0.25 THEN 'Gentler saved pick' WHEN pref >= 0 THEN 'Matches your taste' ELSE 'From your saved recipes' END, latest_at
            FROM (SELECT b.*, coalesce(preference_score - 3, 0) AS pref, coalesce(preference_score - 3, 0) - comb AS f FROM b2 b LEFT JOIN preference p ON p.user_id = b.user_id AND p.recipe_id::VARCHAR = b.recipe_id WHERE NOT own) WINDOW w AS (PARTITION BY user_id))) WHERE rn <= 5""",
    "cooklists", "preference", book=_BOOK, b2=_BOOKRISK))
def cookbook_recommend(d: Domain):
    items = write_and_read(cookbook.cookbook_memberships(d.cooklists), "book")
    pref = d.preference.select("user_id", F.col("recipe_id").cast("string").alias("recipe_id"), (F.col("preference_score") - 3).alias("score"))
    return cookbook.cookbook_recommend(items, pref, _book_risk(items), _NOW_BOOK)


@query("title_exists", sql("""
    SELECT user_id, title, EXISTS (SELECT 1 FROM cooklists c WHERE c.user_id = t.user_id AND lower(trim(c.recipe_title)) = lower(trim(t.title))) AS found
    FROM (SELECT o_custkey::VARCHAR AS user_id, o_orderkey, ' DISH ' || (o_orderkey % 2000) || ' v1 ' AS title FROM orders) t""", "cooklists"))
def title_exists(d: Domain):
    o = F.col("o_orderkey")
    titles = d.table("orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.concat(F.lit(" DISH "), (o % 2000).cast("string"), F.lit(" v1 ")).alias("title"))
    return cookbook.title_exists(titles, d.cooklists)


@query("orphaned_saved", sql("""
    SELECT DISTINCT user_id, recipe_id FROM cooklists c WHERE cooklist_id = 2 AND coalesce(recipe_source, '') <> 'personal' AND NOT starts_with(recipe_id, 'personal-')
        AND NOT EXISTS (SELECT 1 FROM cooklists x WHERE x.user_id = c.user_id AND x.recipe_id = c.recipe_id AND x.cooklist_id <> 2)""", "cooklists"))
def orphaned_saved(d: Domain):
    deleted = d.table("customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.lit(2).cast("long").alias("cooklist_id"))
    lists = d.cooklists.withColumn("recipe_source", F.coalesce("recipe_source", F.lit("catalog")))
    return cookbook.orphaned_saved(lists, deleted)


_CHANGES = """SELECT o_custkey::VARCHAR AS user_id, (o_orderkey % 2000)::VARCHAR AS recipe_id, max(o_orderkey) % 3 AS k FROM orders GROUP BY ALL"""


@query("membership_replace", sql(f"""
    SELECT 'list' AS part, user_id, recipe_id, cooklist_id FROM cooklists c WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.user_id = c.user_id AND ch.recipe_id = c.recipe_id)
    UNION ALL SELECT 'list', user_id, recipe_id, unnest(CASE k WHEN 0 THEN []::BIGINT[] WHEN 1 THEN [7] ELSE [7, 9] END) FROM ch
    UNION ALL SELECT 'log:' || interaction_type, user_id, recipe_id::VARCHAR, 0 FROM orders_log o WHERE NOT (interaction_type IN ('saved', 'save') AND EXISTS (SELECT 1 FROM ch WHERE ch.user_id = o.user_id AND ch.recipe_id = o.recipe_id::VARCHAR))
    UNION ALL SELECT 'log:saved', user_id, recipe_id, 0 FROM ch WHERE k > 0""", "cooklists", "orders_log", ch=_CHANGES))
def membership_replace(d: Domain):
    k = F.col("k")
    empty = F.array().cast("array<bigint>")
    a = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    changes = (d.table("orders").groupBy(F.col("o_custkey").cast("string").alias("user_id"), (F.col("o_orderkey") % 2000).cast("string").alias("recipe_id"))
               .agg((F.max("o_orderkey") % 3).alias("k"))
               .select("user_id", "recipe_id", F.lit("t").alias("recipe_title"), F.when(k == 0, empty).when(k == 1, a(7, 7)).otherwise(a(7, 9)).alias("cooklist_ids"),
                       F.lit(NOW).cast("timestamp").alias("changed_at")))
    log = d.orders_log.withColumn("recipe_id", F.col("recipe_id").cast("string"))
    lists, kept = cookbook.membership_replace(d.cooklists, log, changes)
    return lists.select(F.lit("list").alias("part"), "user_id", "recipe_id", "cooklist_id").unionByName(
        kept.select(F.concat(F.lit("log:"), "interaction_type").alias("part"), "user_id", "recipe_id", F.lit(0).cast("long").alias("cooklist_id")))


@query("delete_user_cascade", sql("""
    SELECT 'profiles' AS t, user_id, CASE WHEN user_id IN (SELECT user_id FROM gone) THEN 'cleared' ELSE c_mktsegment END AS extra, 1::BIGINT AS n FROM (SELECT c_custkey::VARCHAR AS user_id, c_mktsegment FROM customer)
    UNION ALL SELECT 'log', user_id, '', count(*) FROM orders_log WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY user_id
    UNION ALL SELECT 'risks', user_id, '', count(*) FROM generic_risks WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY user_id""", "orders_log", "generic_risks",
    gone="SELECT c_custkey::VARCHAR AS user_id FROM customer WHERE c_acctbal < 0"))
def delete_user_cascade(d: Domain):
    people = d.table("customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment"))
    gone = d.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("user_id"))
    out = cookbook.delete_user_cascade({"profiles": people, "log": d.orders_log, "risks": d.generic_risks}, gone)
    per = lambda name: out[name].groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "user_id", F.lit("").alias("extra"), "n")
    prof = out["profiles"].select(F.lit("profiles").alias("t"), "user_id", F.coalesce("segment", F.lit("cleared")).alias("extra"), F.lit(1).cast("long").alias("n"))
    return prof.unionByName(per("log")).unionByName(per("risks"))


# ---- neighbourhood and factor models ----------------------------------------------------------------------------------

@query("cf_item_based", sql(f"""
    SELECT user_id, rn, recipe_id, {r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, recipe_id) AS rn FROM (
        SELECT r.user_id, s.b AS recipe_id, round(sum(sim * rating) / sum(abs(sim)), 10) AS score FROM mean_ratings r JOIN sims s ON s.a = r.recipe_id GROUP BY ALL) x
        WHERE NOT EXISTS (SELECT 1 FROM mean_ratings m WHERE m.user_id = x.user_id AND m.recipe_id = x.recipe_id)) WHERE rn <= 10""", "mean_ratings",
    nrm="SELECT recipe_id, sqrt(sum(rating * rating)) AS n FROM mean_ratings GROUP BY 1",
    sims="SELECT x.recipe_id AS a, y.recipe_id AS b, sum(x.rating * y.rating) / any_value(p.n * q.n) AS sim FROM mean_ratings x JOIN mean_ratings y ON y.user_id = x.user_id JOIN nrm p ON p.recipe_id = x.recipe_id JOIN nrm q ON q.recipe_id = y.recipe_id GROUP BY ALL"))
def cf_item_based(d: Domain):
    return cf.item_based(d.kept("mean_ratings"))


@query("cf_user_based", sql(f"""
    SELECT user_id, rn, recipe_id, {r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, recipe_id) AS rn FROM (
        SELECT s.a AS user_id, r.recipe_id, round(sum(sim * rating) / sum(abs(sim)), 10) AS score FROM nb s JOIN mean_ratings r ON r.user_id = s.b GROUP BY ALL) x
        WHERE NOT EXISTS (SELECT 1 FROM mean_ratings m WHERE m.user_id = x.user_id AND m.recipe_id = x.recipe_id)) WHERE rn <= 10""", "mean_ratings",
    nrm="SELECT user_id, sqrt(sum(rating * rating)) AS n FROM mean_ratings GROUP BY 1",
    sims="SELECT x.user_id AS a, y.user_id AS b, sum(x.rating * y.rating) / any_value(p.n * q.n) AS sim FROM mean_ratings x JOIN mean_ratings y ON y.recipe_id = x.recipe_id AND y.user_id <> x.user_id JOIN nrm p ON p.user_id = x.user_id JOIN nrm q ON q.user_id = y.user_id GROUP BY ALL",
    nb="SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 10) DESC, b) <= 50"))
def cf_user_based(d: Domain):
    return cf.user_based(d.kept("mean_ratings"))


@query("mf_explicit", sql(f"""
    SELECT backend, n, n AS n_in_scale, true AS fits FROM (SELECT count(*) AS n FROM mean_ratings WHERE {md5_unit(42, 'user_id', 'recipe_id')} < 0.2), (SELECT unnest(['explicit', 'svd']) AS backend)""", "mean_ratings"))
def mf_explicit(d: Domain):
    """Both backends: every held-out rating gets one prediction inside the scale, and the factors fit the ratings they were
    learned from: alternating least squares to three quarters of the error of mean and item bias, singular vectors to a
    twentieth of their own products.  Random factors do neither."""
    parts = write_and_read(ratings.split_train_test(d.mean_ratings), "parts")
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    models = {"explicit": preference.fit_explicit(train, reg=0.1), "svd": svd.fit_svd(train, 20, turns=2)}
    bias = train.groupBy("recipe_id").agg(F.avg("rating").alias("b"))
    known = preference.predict_explicit(train, models["explicit"]).join(bias, "recipe_id")
    off = known.agg((F.sum((F.col("rating") - F.col("pred")) ** 2) < 0.5625 * F.sum((F.col("rating") - F.col("b")) ** 2))).scalar()
    fits = {"explicit": off, "svd": svd.misfit(train, models["svd"]) < 0.05}
    rows = []
    for name, model in models.items():
        made = preference.predict_explicit(test, model).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred").between(0, 5)).alias("n_in_scale"))
        rows.append(made.select(F.lit(name).alias("backend"), "n", "n_in_scale", fits[name].alias("fits")))
    return rows[0].unionByName(rows[1])


@query("hybrid_preference", sql("""
    SELECT user_id, least(500, (SELECT count(*) FROM recipes) - coalesce(n, 0)) AS n, least(500, (SELECT count(*) FROM recipes) - coalesce(n, 0)) AS n_recipes, 0::BIGINT AS n_excluded, true AS ranks_known
    FROM (SELECT c_custkey::VARCHAR AS user_id FROM customer) LEFT JOIN (SELECT user_id, count(*) AS n FROM mean_ratings WHERE rating >= 4.5 GROUP BY 1) USING (user_id)""", "mean_ratings", "recipes"))
def hybrid_preference(d: Domain):
    """Candidates of all customers from the ranking loss with side features: as many as there can be for every user, none
    twice and none the user rated well; and whether the model ranks known pairs above drawn ones in three of four cases, where
    one that has learned nothing does in half of them."""
    positive = write_and_read(ratings.filter_positive_ratings(d.mean_ratings.withColumn("user_id", F.concat(F.lit("hist_"), "user_id")), d.recipes, 4.5), "positive")
    users = d.table("customer").select(F.concat(F.lit("hist_"), F.col("c_custkey").cast("string")).alias("user_id"))
    items = catalog.item_features(d.recipes)
    side = content.user_side_features(users, users, d.restrictions.withColumn("user_id", F.concat(F.lit("hist_"), "user_id")),
                                      d.generic_risks.withColumn("user_id", F.concat(F.lit("hist_"), "user_id")), d.profile_risks.withColumn("user_id", F.concat(F.lit("hist_"), "user_id")))
    model = warp.fit_hybrid(positive, items, side, d.recipes, users)
    found = preference.recommend(model["item_factors"], model["user_factors"], positive)
    known = positive.select("user_id", "recipe_id", F.lit(1).alias("known")).distinct()
    return (found.join(known, ["user_id", "recipe_id"], "left").groupBy(F.regexp_replace("user_id", "^hist_", "").alias("user_id"))
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("recipe_id").alias("n_recipes"), F.count("known").alias("n_excluded"))
            .withColumn("_above", warp.ranked_above(positive, model)).select("user_id", "n", "n_recipes", "n_excluded", (F.col("_above") > 0.75).alias("ranks_known")))


def _apart(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y)


@query("kmeans_items", sql("SELECT recipe_id, true AS nearest, true AS centered FROM recipes", "recipes"))
def kmeans_items(d: Domain):
    """Whether every item is in the cluster whose center is nearest and that center is the mean of its members: what k-means
    comes to rest at, and other centers do not have."""
    items, centers = preference.kmeans_items(d.recipes)
    points = centers.agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "center"))), lambda c: c["center"])).scalar()  # one row per cluster
    means = (items.select("cluster", F.posexplode("scaled").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("mean"))
             .join(centers, "cluster").groupBy("cluster").agg(F.bool_and(F.abs(F.col("mean") - F.get("center", F.col("i"))) < 0.02).alias("centered")))
    away = items.withColumn("_points", points).withColumn("_away", F.transform("_points", lambda c: _apart(F.col("scaled"), c)))
    return away.join(means, "cluster").select("recipe_id", (F.get("_away", F.col("cluster")) <= F.array_min("_away") + 1e-9).alias("nearest"), "centered")


@query("select_training_medoids", "SELECT unnest(range(5)) AS cluster, true AS own, true AS central")
def select_training_medoids(d: Domain):
    """One item per cluster, from that cluster and no further from its center than the members are on average."""
    items, centers = preference.kmeans_items(d.recipes)
    found = preference.training_medoids(items, centers, ratings.popularity_stats(d.ratings))
    placed = items.join(F.broadcast(centers), "cluster").select("recipe_id", F.col("cluster").alias("_cluster"), F.sqrt(_apart(F.col("scaled"), F.col("center"))).alias("_d"))
    spread = placed.groupBy(F.col("_cluster").alias("cluster")).agg(F.avg("_d").alias("_mean"))
    return found.join(placed, "recipe_id").join(spread, "cluster").select(
        "cluster", (F.col("_cluster") == F.col("cluster")).alias("own"), (F.col("_d") <= F.col("_mean")).alias("central"))
