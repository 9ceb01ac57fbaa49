"""Queries: exposures, attribution, labels, context, symptom model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, exposure, matching, risk
from ..session import write_and_read
from .mapping import ALIASES, KEYWORDS, NOW, RULE, Domain, c01, md5_unit, n_ing, r6, sql, status, ts
from .registry import query
from .safety import _GROUPS, SIGNAL_DEPS, SIGNALS


@query("join_recipe_ingredients", sql(f"""
    SELECT user_id, meal_log_id, coalesce(recipe_id, -1) AS recipe_id, ingredient_name, normalized_name, {ts('exposed_at')} AS exposed_at, {r6('w')} AS portion_weight FROM (
        SELECT user_id, meal_log_id, m.recipe_id, i.ingredient_name, {n_ing('i.ingredient_name')} AS normalized_name, logged_at AS exposed_at, CASE WHEN portion_size = 0 THEN 1.0 ELSE portion_size END AS w
        FROM meals m JOIN (SELECT recipe_id, ingredient_name FROM ri WHERE recipe_id NOT IN (SELECT recipe_id FROM b) UNION ALL SELECT * FROM b) i ON i.recipe_id = m.recipe_id
        UNION ALL SELECT user_id, meal_log_id, NULL, food_name, {n_ing('food_name')}, logged_at, CASE WHEN portion_size = 0 THEN 1.0 ELSE portion_size END FROM meals WHERE recipe_id IS NULL)""",
    "meals", "ri", b="SELECT recipe_id, description AS ingredient_name FROM recipes WHERE minutes > 40 UNION ALL SELECT recipe_id, 'Fresh ' || name FROM recipes WHERE minutes > 40"))
def join_recipe_ingredients(d: Domain):
    slow = d.recipes.where("minutes > 40")
    bridge = slow.select("recipe_id", F.explode(F.array("description", F.concat(F.lit("Fresh "), "name"))).alias("ingredient_name"))
    out = exposure.meal_exposures(d.meals, bridge, d.recipes)
    return out.withColumn("recipe_id", F.coalesce("recipe_id", F.lit(-1)))


_PAIRS = """SELECT report_id, r.user_id, normalized_name, exp(-(epoch_us(reported_at) - epoch_us(exposed_at)) / 3.6e9 / 18) * w AS weight, severity, no_symptoms
    FROM reports r JOIN exposures e ON e.user_id = r.user_id AND exposed_at <= reported_at AND exposed_at >= reported_at - INTERVAL 48 HOUR"""
_EVIDENCE = """SELECT user_id, normalized_name, count(*) AS exposures, sum(CASE WHEN no_symptoms OR severity <= 0.2 THEN 0 ELSE weight * severity END) AS positive,
    sum(CASE WHEN no_symptoms OR severity <= 0.2 THEN weight * greatest(0.1, 1 - severity) ELSE 0 END) AS negative FROM pairs_ GROUP BY ALL"""


@query("join_attribution_48h", sql(f"""
    SELECT report_id, user_id, normalized_name, {r6('weight')} AS weight, {r6('severity')} AS severity, no_symptoms FROM pairs_""", "reports", "exposures", pairs_=_PAIRS))
def join_attribution_48h(d: Domain):
    return exposure.attribution_pairs(d.reports, d.exposures)


@query("agg_risk_evidence", sql(f"""
    SELECT user_id, normalized_name, exposures, {r6('positive')} AS positive, {r6('negative')} AS negative FROM e""", "reports", "exposures", pairs_=_PAIRS, e=_EVIDENCE))
def agg_risk_evidence(d: Domain):
    return exposure.risk_evidence(d.reports, d.exposures)


@query("agg_risk_update", sql(f"""
    SELECT user_id, normalized_name, n AS exposure_count, {r6('p')} AS positive_evidence, {r6('q')} AS negative_evidence, round(risk, 4) + 0.0 AS risk_score, round(conf, 4) + 0.0 AS confidence,
        {status('risk', 'conf')} AS status FROM (SELECT *, least(1.0, (p + 0.75) / (p + q + 3)) AS risk, least(1.0, (p + q) / 6) AS conf FROM (
        SELECT coalesce(e.user_id, g.user_id) AS user_id, coalesce(e.normalized_name, g.nn) AS normalized_name, coalesce(exposures, 0) + coalesce(exposure_count, 0) AS n,
            coalesce(positive, 0) + coalesce(positive_evidence, 0) AS p, coalesce(negative, 0) + coalesce(negative_evidence, 0) AS q
        FROM e FULL JOIN (SELECT user_id, lower(ingredient_name) AS nn, exposure_count, positive_evidence, negative_evidence FROM generic_risks) g ON g.user_id = e.user_id AND g.nn = e.normalized_name))""",
    "reports", "exposures", "generic_risks", pairs_=_PAIRS, e=_EVIDENCE))
def agg_risk_update(d: Domain):
    return exposure.risk_update(exposure.risk_evidence(d.reports, d.exposures), d.generic_risks)


_OUTCOMES = """SELECT user_id, reported_at AS t_at, label FROM (SELECT *, CASE WHEN no_symptoms THEN 0 WHEN symptom_type <> 'none' AND severity > 0.2 THEN 1 END AS label FROM reports) WHERE label IS NOT NULL"""


@query("filter_explicit_outcome", sql(f"SELECT user_id, {ts('t_at')} AS outcome_at, label::BIGINT AS label FROM o", "reports", o=_OUTCOMES))
def filter_explicit_outcome(d: Domain):
    return context.explicit_outcomes(d.reports)


_MATCHED = """SELECT meal_log_id AS meal_id, m.user_id, logged_at, t_at, label FROM (SELECT o.user_id, o.t_at, o.label, arg_max(meal_log_id, (logged_at, -meal_log_id)) AS best FROM o
        JOIN meals m ON m.user_id = o.user_id AND m.logged_at <= o.t_at AND o.t_at <= m.logged_at + INTERVAL 48 HOUR GROUP BY ALL) b JOIN meals m ON m.meal_log_id = b.best
    QUALIFY row_number() OVER (PARTITION BY meal_log_id ORDER BY t_at, label) = 1"""


@query("join_asof_meal_outcome", sql(f"""
    SELECT meal_id, user_id, {ts('logged_at')} AS logged_at, {ts('t_at')} AS outcome_at, label::BIGINT AS label FROM x""", "reports", "meals", o=_OUTCOMES, x=_MATCHED))
def join_asof_meal_outcome(d: Domain):
    return context.match_meals_to_outcomes(d.meals, context.explicit_outcomes(d.reports))


@query("join_asof_label_forward", sql("""
    SELECT meal_log_id AS meal_id, coalesce((SELECT arg_min(label, (t_at, label)) FROM o WHERE o.user_id = m.user_id AND t_at >= logged_at AND t_at <= logged_at + INTERVAL 48 HOUR), -1)::BIGINT AS label FROM meals m""",
    "reports", "meals", o=_OUTCOMES))
def join_asof_label_forward(d: Domain):
    return context.label_forward(d.meals, context.explicit_outcomes(d.reports)).withColumn("label", F.coalesce("label", F.lit(-1)))


def _refs(d: Domain):
    return d.events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("ref_id"), F.col("ts").alias("ref_ts"))


_REFS = "SELECT user_id, event_id AS ref_id, ts AS ref_ts FROM ev WHERE event_type = 'view'"


@query("join_recent_context", sql(f"""
    SELECT ref_id, side, {ts('t_at')} AS at FROM refs r JOIN (SELECT user_id, 'meal' AS side, logged_at AS t_at FROM meals UNION ALL SELECT user_id, 'report', reported_at FROM reports) e
        ON e.user_id = r.user_id AND t_at < ref_ts AND t_at >= ref_ts - INTERVAL 48 HOUR""", "meals", "reports", refs=_REFS))
def join_recent_context(d: Domain):
    return context.recent_events(_refs(d), d.meals, d.reports)


_CONTEXT = """SELECT r.ref_id, any_value(r.user_id) AS user_id, coalesce(max(sev), 0) AS smax, coalesce(avg(sev), 0) AS smean, coalesce(avg(no), 0) AS fnone, coalesce(sum(pos), 0) AS npos, count(m) AS nmeal,
        coalesce(avg(load), 0) AS load, coalesce((epoch_us(any_value(ref_ts)) - max(CASE WHEN pos = 1 THEN epoch_us(t_at) END)) / 3.6e9, 48) AS hsym, (max(CASE WHEN pos = 1 THEN t_at END) IS NULL)::INT AS hsym_m,
        coalesce((epoch_us(any_value(ref_ts)) - max(CASE WHEN m = 1 THEN epoch_us(t_at) END)) / 3.6e9, 48) AS hmeal, (max(CASE WHEN m = 1 THEN t_at END) IS NULL)::INT AS hmeal_m
    FROM refs r LEFT JOIN (SELECT user_id, logged_at AS t_at, 1 AS m, coalesce(portion_size, 0) AS load, NULL::DOUBLE AS sev, NULL::INT AS no, NULL::INT AS pos FROM meals
        UNION ALL SELECT user_id, reported_at, NULL, NULL, greatest(0.0, least(1.0, severity)), no_symptoms::INT, (NOT no_symptoms AND severity > 0.2)::INT FROM reports) e
        ON e.user_id = r.user_id AND t_at < ref_ts AND t_at >= ref_ts - INTERVAL 48 HOUR GROUP BY r.ref_id"""


def _context(d: Domain, refs=None):
    loaded = d.meals.withColumn("trigger_load", F.col("portion_size"))
    return context.recent_context(_refs(d) if refs is None else refs, loaded, d.reports)


@query("agg_recent_context", sql(f"""
    SELECT ref_id::VARCHAR AS ref_id, {r6('smax')} AS recent_symptom_severity, {r6('smax')} AS recent_symptom_max, {r6('smean')} AS recent_symptom_mean, {r6('fnone')} AS recent_no_symptom_fraction,
        {r6('npos')} AS recent_positive_report_count, {r6('nmeal')} AS recent_meal_count, {r6('load')} AS recent_trigger_load, {r6('hsym * 3600')} AS seconds_since_last_symptom, {r6('hsym_m')} AS hours_since_last_symptom_missing,
        {r6('hmeal * 3600')} AS seconds_since_last_meal, {r6('hmeal_m')} AS hours_since_last_meal_missing FROM c""", "meals", "reports", refs=_REFS, c=_CONTEXT))
def agg_recent_context(d: Domain):
    out = _context(d)
    for c in ("symptom", "meal"):
        out = out.withColumn(f"seconds_since_last_{c}", F.col(f"hours_since_last_{c}") * 3600).drop(f"hours_since_last_{c}")
    return out


# ---- recipe risk, features, rerank -------------------------------------------------------------------------

_KEY = "CASE " + " ".join(f"WHEN contains(' ' || t.nn || ' ', ' {k.rstrip('s') if k == 'bolts' else k} ') THEN {v}" for k, v in KEYWORDS.items()) + " ELSE 0.08 END::DOUBLE"
RISK = {**SIGNALS, "base": f"""SELECT t.nn, coalesce(p.risk, {_KEY}) AS base, coalesce(p.conf, 0.15) AS base_conf, p.ingredient_name AS pop_name
    FROM (SELECT DISTINCT nn FROM ri) t LEFT JOIN popbest p ON p.nn = t.nn""",
    "irisk": f"""SELECT q.user_id, q.recipe_id, coalesce(score, 0.12) AS score, coalesce(conf, 0) AS conf, coalesce(matched, '') AS matched, coalesce(mx, 0) AS mx, coalesce(mn, 0) AS mn, coalesce(mc, 0) AS mc,
        coalesce(k, 0) AS k, coalesce(n, 0) AS n, coalesce(k / n, 0) AS coverage FROM pairs q LEFT JOIN (
        SELECT p.user_id, p.recipe_id, avg(greatest(0.0, least(1.0, CASE WHEN b.risk IS NULL THEN base ELSE greatest(0.25, b.conf) * b.risk + (1 - greatest(0.25, b.conf)) * base END))) AS score,
            avg(CASE WHEN b.risk IS NULL THEN base_conf ELSE greatest(0.25, b.conf) END) AS conf, array_to_string(list_sort(list_distinct(list(coalesce(b.ingredient_name, pop_name)) FILTER (coalesce(b.ingredient_name, pop_name) IS NOT NULL))), '|') AS matched,
            max(b.risk) AS mx, avg(b.risk) AS mn, avg(b.conf) AS mc, count(b.risk) AS k, count(*) AS n
        FROM pairs p JOIN ri ON ri.recipe_id = p.recipe_id JOIN base ON base.nn = ri.nn LEFT JOIN best b ON b.user_id = p.user_id AND b.nn = ri.nn GROUP BY ALL) x ON x.user_id = q.user_id AND x.recipe_id = q.recipe_id"""}


def ingredient_risk(d: Domain, pairs):
    return risk.recipe_ingredient_risk(pairs, d.recipes, risk.personal_signals(d.generic_risks, d.profile_risks),
                                       risk.population_signals(d.priors, d.ingredient_catalog), KEYWORDS, **RULE)


@query("agg_ingredient_risk", sql(f"""
    SELECT user_id, recipe_id, {r6('score')} AS score, {r6('conf')} AS confidence, matched, {r6('mx')} AS max_personal_risk, {r6('mn')} AS mean_personal_risk, {r6('mc')} AS mean_personal_confidence,
        k AS personal_match_count, n AS ingredient_count, {r6('coverage')} AS personal_coverage FROM irisk""", "pairs", *SIGNAL_DEPS, **RISK))
def agg_ingredient_risk(d: Domain):
    return ingredient_risk(d, d.kept("pairs"))


def _meal_pairs(d: Domain):
    """Meals of catalog recipes as feature pairs, the meal being its own reference."""
    return d.meals.where("recipe_id is not null").select(
        "user_id", "recipe_id", F.col("meal_log_id").cast("string").alias("ref_id"), F.col("logged_at").alias("at"), "calories", "protein_g", "fat_g", "portion_size",
        "portion_unit", "nutrition_source", "nutrition_confidence")


_MEAL_REFS = "SELECT user_id, meal_log_id AS ref_id, logged_at AS ref_ts FROM meals WHERE recipe_id IS NOT NULL"
_PROFILE = f"""SELECT r.recipe_id, (count(DISTINCT g.g))::DOUBLE AS groups, count(DISTINCT CASE WHEN g.g IS NOT NULL THEN ri.pos END)::DOUBLE AS hit,
    coalesce(count(DISTINCT CASE WHEN g.g IS NOT NULL THEN ri.pos END) / nullif(count(DISTINCT ri.pos), 0), 0)::DOUBLE AS frac, count(DISTINCT CASE WHEN g.g = 'lactose' THEN ri.pos END)::DOUBLE AS lac,
    count(DISTINCT CASE WHEN g.g = 'polyols' THEN ri.pos END)::DOUBLE AS pol FROM recipes r LEFT JOIN ri ON ri.recipe_id = r.recipe_id LEFT JOIN g ON g.nn = ri.nn GROUP BY 1"""


def _features(d: Domain, with_risk: bool = True):
    pairs = write_and_read(_meal_pairs(d), "meal-pairs")
    refs = pairs.select("user_id", "ref_id", F.col("at").alias("ref_ts"))
    mine = ingredient_risk(d, pairs) if with_risk else None
    return risk.symptom_features(pairs, d.recipes, matching.trigger_profile(d.recipes, ALIASES), _context(d, refs), mine)


_ROW = f"""SELECT m.user_id, m.recipe_id, m.meal_log_id::VARCHAR AS ref_id, m.logged_at, i.score, i.conf AS iconf, i.mx, i.mn, i.mc, i.k, i.coverage, p.*, r.minutes, r.n_steps, r.n_ingredients, r.ingredients,
        CASE WHEN len(r.nutrition) >= 7 THEN r.nutrition ELSE list_concat(r.nutrition, [0.0, 0.0, 0.0, 0.0]) END AS nut, len(r.nutrition) >= 7 AS nutp, c.*, m.calories AS lc, m.protein_g AS lp, m.fat_g AS lf, m.portion_size AS ps,
        m.portion_unit AS pu, m.nutrition_source AS src, m.nutrition_confidence AS nc
    FROM meals m JOIN recipes r ON r.recipe_id = m.recipe_id JOIN prof p ON p.recipe_id = m.recipe_id JOIN c ON c.ref_id = m.meal_log_id JOIN irisk i ON i.user_id = m.user_id AND i.recipe_id = m.recipe_id"""
_FEATURE_CTES = {**{k: v for k, v in RISK.items()}, "g": _GROUPS, "prof": _PROFILE, "refs": _MEAL_REFS, "c": _CONTEXT, "row_": _ROW}
_FEATURE_CTES["irisk"] = RISK["irisk"].replace("FROM pairs q", "FROM mp q").replace("FROM pairs p", "FROM mp p")
_FEATURE_CTES = {"mp": "SELECT DISTINCT user_id, recipe_id FROM meals WHERE recipe_id IS NOT NULL", **_FEATURE_CTES}
_HEUR = f"least(1.0, 0.08 + 0.52 * score + 0.12 * {c01('nut[2] / 40')} + 0.08 * {c01('nut[1] / 700')} + 0.1 * {c01('groups / 4')} + 0.06 * {c01('smax')} + 0.04 * {c01('load')})"


@query("fn_symptom_features", sql(f"""
    SELECT user_id, recipe_id, ref_id, {r6("contains(lower(array_to_string(ingredients, ' ')), 'onion')::INT")} AS contains_onion, {r6('nut[1]')} AS recipe_calories, {r6('nut[2]')} AS recipe_fat_pdv, {r6('nut[7]')} AS recipe_carbs_pdv,
        {r6('NOT nutp::INT')} AS recipe_nutrition_missing, {r6('len(ingredients) = 0')} AS recipe_ingredients_missing, {r6('minutes IS NULL')} AS recipe_minutes_missing, {r6('coalesce(minutes, 0)')} AS recipe_minutes,
        {r6('coalesce(n_ingredients, len(ingredients))')} AS recipe_ingredient_count, {r6('n_ingredients IS NULL AND len(ingredients) = 0')} AS recipe_ingredient_count_missing, {r6('n_steps')} AS recipe_step_count,
        {r6('groups')} AS trigger_group_count, {r6('hit')} AS trigger_ingredient_count, {r6('frac')} AS trigger_ingredient_fraction, {r6('lac')} AS trigger_lactose_count, {r6('lac > 0')} AS trigger_lactose_present, {r6('pol')} AS trigger_polyols_count,
        {r6('score')} AS ingredient_risk_score, {r6('iconf')} AS ingredient_risk_confidence, {r6('k')} AS personal_risk_match_count, {r6('coverage')} AS personal_risk_coverage, {r6('mx')} AS personal_risk_max, {r6('mn')} AS personal_risk_mean,
        {r6('smax')} AS recent_symptom_max, {r6('smean')} AS recent_symptom_mean, {r6('fnone')} AS recent_no_symptom_fraction, {r6('npos')} AS recent_positive_report_count, {r6('nmeal')} AS recent_meal_count, {r6('load')} AS recent_trigger_load,
        {r6('hsym * 3600')} AS seconds_since_last_symptom, {r6('hmeal_m')} AS hours_since_last_meal_missing, {r6('coalesce(lc, 0)')} AS logged_calories, {r6('lc IS NULL')} AS logged_calories_missing, {r6("coalesce(CASE WHEN src = 'manual' THEN lp END, 0)")} AS logged_protein_g,
        {r6("(CASE WHEN src = 'manual' THEN lf END) IS NULL")} AS logged_fat_g_missing, {r6('ps')} AS logged_portion_size, {r6('coalesce(nc, 0)')} AS logged_nutrition_confidence, {r6("pu = 'cups'")} AS portion_unit_volume, {r6("pu = ''")} AS portion_unit_unknown,
        {r6('sin(2 * pi() * (hour(logged_at) + minute(logged_at) / 60.0::DOUBLE) / 24)')} AS time_of_day_sin FROM row_""", "meals", "recipes", "reports", *SIGNAL_DEPS, **_FEATURE_CTES))
def fn_symptom_features(d: Domain):
    return _features(d).select(
        "user_id", "recipe_id", "ref_id", "contains_onion", "recipe_calories", "recipe_fat_pdv", "recipe_carbs_pdv", "recipe_nutrition_missing", "recipe_ingredients_missing", "recipe_minutes_missing", "recipe_minutes",
        "recipe_ingredient_count", "recipe_ingredient_count_missing", "recipe_step_count", "trigger_group_count", "trigger_ingredient_count", "trigger_ingredient_fraction", "trigger_lactose_count", "trigger_lactose_present",
        "trigger_polyols_count", "ingredient_risk_score", "ingredient_risk_confidence", "personal_risk_match_count", "personal_risk_coverage", "personal_risk_max", "personal_risk_mean", "recent_symptom_max", "recent_symptom_mean",
        "recent_no_symptom_fraction", "recent_positive_report_count", "recent_meal_count", "recent_trigger_load", (F.col("hours_since_last_symptom") * 3600).alias("seconds_since_last_symptom"), "hours_since_last_meal_missing", "logged_calories", "logged_calories_missing",
        "logged_protein_g", "logged_fat_g_missing", "logged_portion_size", "logged_nutrition_confidence", "portion_unit_volume", "portion_unit_unknown", "time_of_day_sin")


@query("fn_heuristic_symptom_risk", sql(f"SELECT user_id, recipe_id, ref_id, {r6(_HEUR)} AS risk FROM row_", "meals", "recipes", "reports", *SIGNAL_DEPS, **_FEATURE_CTES))
def fn_heuristic_symptom_risk(d: Domain):
    return _features(d).select("user_id", "recipe_id", "ref_id", risk.heuristic_risk().alias("risk"))


def _examples(d: Domain):
    pairs = _meal_pairs(d)
    labels = context.match_meals_to_outcomes(d.meals, context.explicit_outcomes(d.reports))
    feats = _features(d, with_risk=False)
    return feats.join(labels.select(F.col("meal_id").cast("string").alias("ref_id"), "meal_id", "logged_at", "outcome_at", "label"), "ref_id").select(
        "meal_id", "user_id", "logged_at", "outcome_at", "label", "ingredient_risk_score", *context.feature_columns())


_TRIES = f"""SELECT *, {md5_unit(0, 'user_id', 'try')} < 0.25 AS test FROM (SELECT user_id, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM x GROUP BY 1), (SELECT unnest(range(24)) AS try)"""
_CHOSEN = """SELECT min(try) AS try FROM (SELECT try FROM tries GROUP BY try HAVING least(coalesce(sum(p) FILTER (NOT test), 0), coalesce(sum(q) FILTER (NOT test), 0)) >= 2
    AND least(coalesce(sum(p) FILTER (test), 0), coalesce(sum(q) FILTER (test), 0)) >= 1)"""


@query("split_group_disjoint", sql(f"""
    SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS part, 'group_disjoint' AS strategy, count(*) AS n, count(DISTINCT x.user_id) AS users
    FROM x JOIN tries t ON t.user_id = x.user_id AND t.try = (SELECT try FROM chosen) GROUP BY 1""", "reports", "meals", o=_OUTCOMES, x=_MATCHED, tries=_TRIES, chosen=_CHOSEN))
def split_group_disjoint(d: Domain):
    labels = write_and_read(context.match_meals_to_outcomes(d.meals, context.explicit_outcomes(d.reports)), "labels")
    return context.split_group_disjoint(labels).groupBy("part", "strategy").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("split_chrono_purged", sql(f"""
    SELECT meal_id, CASE WHEN i >= cut THEN 'test' WHEN t_at < first THEN 'train' ELSE 'purged' END AS part, 'chronological_purged' AS strategy FROM (
        SELECT *, min(logged_at) FILTER (i >= cut) OVER () AS first FROM (SELECT *, row_number() OVER (ORDER BY logged_at, meal_id) - 1 AS i, greatest(1, least(count(*) OVER () - 1, floor(count(*) OVER () * 0.75))) AS cut FROM x))""",
    "reports", "meals", o=_OUTCOMES, x=_MATCHED))
def split_chrono_purged(d: Domain):
    labels = write_and_read(context.match_meals_to_outcomes(d.meals, context.explicit_outcomes(d.reports)), "labels")
    return context.split_chrono_purged(labels).select("meal_id", "part", "strategy")


@query("train_symptom_gbt", "SELECT true AS auc_in_range, true AS log_loss_positive, true AS brier_in_range, true AS learned")
def train_symptom_gbt(d: Domain):
    """Metrics of the held-out part, and whether the loss on the part learned from fell by a tenth of that of the mere share of
    positives, which trees that have learned nothing do not reach."""
    _, metrics = context.train_symptom_model(write_and_read(_examples(d), "examples"), trees=40)
    return metrics.select(F.col("auc").between(0, 1).alias("auc_in_range"), (F.col("log_loss") > 0).alias("log_loss_positive"), F.col("brier").between(0, 1).alias("brier_in_range"),
                          (F.col("train_log_loss") < 0.9 * F.col("base_log_loss")).alias("learned"))


@query("score_symptom_risk", sql("SELECT meal_log_id::VARCHAR AS ref_id, true AS in_range, true AS tells_apart FROM meals WHERE recipe_id IS NOT NULL AND meal_log_id NOT IN (SELECT meal_id FROM x)",
                                "reports", "meals", o=_OUTCOMES, x=_MATCHED))
def score_symptom_risk(d: Domain):
    """The model's risk of every meal without an outcome; those with one trained it, and there the mean risk is
    higher for meals with symptoms than for others, which a constant or reversed model fails."""
    rows = write_and_read(_examples(d), "examples")
    model, _ = context.train_symptom_model(rows, trees=40)
    told = context.score_symptom(rows, model)
    mean = lambda label: F.avg(F.when(F.col("label") == label, F.col("symptom_risk")))
    apart = told.agg(mean(1) > mean(0)).scalar()
    known = rows.select(F.col("meal_id").cast("string").alias("ref_id"))
    others = _features(d, with_risk=False).join(known, "ref_id", "left_anti")
    return (context.score_symptom(others, model).select("ref_id", F.col("symptom_risk").between(0, 1).alias("in_range"))
            .withColumn("tells_apart", apart))
