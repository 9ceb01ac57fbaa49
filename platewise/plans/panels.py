"""Queries: dashboards, diary, content experiments, insight cards, habit tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import content, dashboard, habits
from ..session import write_and_read
from .mapping import NOW, TODAY, Domain, c01, day, has, n_text, r6, sql, ts
from .registry import query

_TZ = "America/New_York"
_LOCAL = "INTERVAL 5 HOUR"  # the data lies in January

_SEEN = f"SELECT user_id, {n_text('normalized_name')} AS name, max(exposed_at) AS seen FROM exposures GROUP BY ALL"
_SIGNALS = f"""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.name, b.name) AS name,
    CASE WHEN b.s IS NULL THEN a.s WHEN a.s IS NULL THEN b.s WHEN b.n > a.n THEN b.s ELSE greatest(a.s, b.s) END AS score,
    greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n, coalesce(a.p, 0) AS p, coalesce(a.q, 0) AS q,
    CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN greatest(a.t, b.t, seen) ELSE coalesce(a.t, b.t, seen) END AS last,
    concat_ws(', ', CASE WHEN a.s IS NOT NULL THEN 'meal patterns' END, CASE WHEN b.s IS NOT NULL THEN 'IBS check-ins' END) AS sources
    FROM (SELECT user_id, {n_text('ingredient_name')} AS name, risk_score AS s, exposure_count AS n, positive_evidence AS p, negative_evidence AS q, last_evidence_at AS t FROM generic_risks) a
    FULL JOIN (SELECT user_id, {n_text('ingredient_name')} AS name, grade AS s, evidence_count AS n, last_evidence_at AS t FROM profile_risks) b ON a.user_id = b.user_id AND a.name = b.name
    LEFT JOIN seen x ON x.user_id = coalesce(a.user_id, b.user_id) AND x.name = coalesce(a.name, b.name)"""
_SIG_DEPS = ("generic_risks", "profile_risks", "exposures")
_SIG = {"seen": _SEEN, "sig": _SIGNALS}


def _signals(d: Domain):
    return dashboard.merge_signals(d.generic_risks, d.profile_risks, d.exposures)


@query("agg_signals_merge", sql(f"""
    SELECT user_id, name, {r6('score')} AS score, n AS support, {r6('p')} AS positive_evidence, {r6('q')} AS negative_evidence, {ts('last')} AS last_seen, sources,
        CASE WHEN score >= 0.72 AND n >= 4 THEN 'Strong signal' WHEN score >= 0.58 AND n >= 2 THEN 'Worth watching' WHEN score >= 0.58 THEN 'Early clue' WHEN score <= 0.25 AND n >= 2 THEN 'Usually goes well'
        WHEN score <= 0.35 THEN 'Looks gentle so far' ELSE 'Still learning' END AS label FROM sig""", *_SIG_DEPS, **_SIG))
def agg_signals_merge(d: Domain):
    return _signals(d).drop("display")


_LISTS = f"""SELECT user_id, 'watch' AS list_name, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, n DESC, name) AS rn, name, score, n, coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(last) <= 45 * 86400000000, false) AS recent
        FROM sig WHERE score >= 0.45 QUALIFY rn <= 8
    UNION ALL SELECT user_id, 'easier', row_number() OVER (PARTITION BY user_id ORDER BY score, n DESC, name) AS rn, name, score, n, coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(last) <= 45 * 86400000000, false)
        FROM sig WHERE score <= 0.35 AND n >= 1 QUALIFY rn <= 6"""


@query("watchlist_topn", sql(f"SELECT user_id, list_name, rn, name, {r6('score')} AS score, n AS support, recent FROM lists", *_SIG_DEPS, **_SIG, lists=_LISTS))
def watchlist_topn(d: Domain):
    return dashboard.watchlists(_signals(d), NOW)


_REPORTS = """SELECT user_id, reported_at AS t_at, greatest(0.0, least(1.0, severity)) AS sev, no_symptoms OR severity <= 0.2 AS easier FROM reports
    UNION ALL SELECT user_id, created_at, sev, sev <= 0.2 FROM checkins"""


def _reports(d: Domain):
    return dashboard.all_reports(d.reports, d.checkins)


@query("agg_weekly_pattern", sql(f"""
    SELECT user_id, week, coalesce(meals, 0) AS meals, coalesce(floor(round(sev * 100, 9) + 0.5), 0)::BIGINT AS symptom_level, coalesce(easier, 0) AS easier FROM users CROSS JOIN (SELECT unnest([1, 2, 3, 4])::BIGINT AS week) w
    LEFT JOIN (SELECT user_id, {{wk}} AS week, count(*) AS meals FROM (SELECT user_id, logged_at AS t_at FROM meals) GROUP BY ALL) m USING (user_id, week)
    LEFT JOIN (SELECT user_id, {{wk}} AS week, avg(sev) AS sev, count(*) FILTER (easier) AS easier FROM rep GROUP BY ALL) r USING (user_id, week)""".replace(
        "{wk}", f"(floor(date_diff('day', DATE '2024-01-30' - 27, (t_at - {_LOCAL})::DATE) / 7.0) + 1)::BIGINT"), "users", "meals", "reports", "checkins", rep=_REPORTS))
def agg_weekly_pattern(d: Domain):
    return dashboard.weekly_pattern(d.users, d.meals, _reports(d), NOW, _TZ)


_DAILY = f"""SELECT u.user_id, w.d AS day, floor(round(coalesce(c, 0), 9) + 0.5)::DOUBLE AS calories, floor(round(coalesce(p, 0), 9) * 10 + 0.5) / 10 AS protein, floor(round(coalesce(f, 0), 9) * 10 + 0.5) / 10 AS fat, coalesce(n, 0) AS n_meals
    FROM users u CROSS JOIN (SELECT unnest(range(DATE '2024-01-24', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS d) w
    LEFT JOIN (SELECT user_id, (logged_at - {_LOCAL})::DATE AS d, sum(coalesce(calories, 0)) AS c, sum(coalesce(protein_g, 0)) AS p, sum(coalesce(fat_g, 0)) AS f, count(*) AS n FROM meals
        WHERE coalesce(calories, 0) > 0 OR coalesce(protein_g, 0) > 0 OR coalesce(fat_g, 0) > 0 GROUP BY ALL) x ON x.user_id = u.user_id AND x.d = w.d"""


@query("agg_daily_nutrition", sql(f"SELECT user_id, {day('day')} AS day, {r6('calories')} AS calories, {r6('protein')} AS protein, {r6('fat')} AS fat, n_meals FROM daily", "users", "meals", daily=_DAILY))
def agg_daily_nutrition(d: Domain):
    return dashboard.daily_nutrition(d.users, d.meals, NOW, _TZ)


_TOTALS = f"""SELECT u.user_id, coalesce(tm, 0) AS tracked_meals, coalesce(ci, 0) AS check_ins, coalesce(er, 0) AS easier_reports, coalesce(rr, 0) AS rough_reports, c AS calories_7d, floor(round(p, 9) * 10 + 0.5) / 10 AS protein_7d,
    floor(round(f, 9) * 10 + 0.5) / 10 AS fat_7d, mn AS meals_with_nutrition, coalesce(tsig, 0) AS top_signals, coalesce(sg, 0) + coalesce(tm, 0) + coalesce(ci, 0) + mn > 0 AS has_data FROM users u
    LEFT JOIN (SELECT user_id, count(*) AS tm FROM meals GROUP BY 1) m USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS ci, count(*) FILTER (easier) AS er, count(*) FILTER (sev >= 0.55) AS rr FROM rep GROUP BY 1) r USING (user_id)
    LEFT JOIN (SELECT user_id, sum(calories) AS c, sum(protein) AS p, sum(fat) AS f, sum(n_meals)::BIGINT AS mn FROM daily GROUP BY 1) y USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS tsig FROM lists WHERE list_name = 'watch' GROUP BY 1) t USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS sg FROM sig GROUP BY 1) s USING (user_id)"""
_TOT = {**_SIG, "lists": _LISTS, "rep": _REPORTS, "daily": _DAILY, "totals": _TOTALS}
_TOT_DEPS = (*_SIG_DEPS, "users", "meals", "reports", "checkins")


def _totals(d: Domain):
    sig = write_and_read(_signals(d), "signals")
    return dashboard.dashboard_totals(d.users, d.meals, _reports(d), dashboard.daily_nutrition(d.users, d.meals, NOW, _TZ), dashboard.watchlists(sig, NOW), sig)


@query("agg_dashboard_totals", sql(f"SELECT * REPLACE ({r6('calories_7d')} AS calories_7d, {r6('protein_7d')} AS protein_7d, {r6('fat_7d')} AS fat_7d) FROM totals", *_TOT_DEPS, **_TOT))
def agg_dashboard_totals(d: Domain):
    return _totals(d)


# ---- diary ------------------------------------------------------------------------------------------------

_LINE = """SELECT user_id, logged_at AS t_at, 'meal' AS type, meal_log_id::VARCHAR AS id FROM meals UNION ALL SELECT user_id, created_at, 'chat_food', checkin_id || '-0' FROM checkins
    UNION ALL SELECT user_id, created_at, 'recipe', id::VARCHAR FROM app_log WHERE interaction_type = 'started' UNION ALL SELECT user_id, reported_at, 'checkin', report_id::VARCHAR FROM reports
    UNION ALL SELECT user_id, created_at, 'chat_checkin', checkin_id::VARCHAR FROM checkins"""
_LINE_DEPS = ("meals", "checkins", "app_log", "reports")


def _timeline(d: Domain):
    name = lambda df, at, key, title: df.select("user_id", F.col(at).alias("at"), key.alias("id"), title.alias("title"))
    sid = lambda c: F.col(c).cast("string")
    return dashboard.timeline(
        name(d.meals, "logged_at", sid("meal_log_id"), F.col("food_name")),
        name(d.checkins, "created_at", F.concat(sid("checkin_id"), F.lit("-0")), F.get("hours_0_8", F.lit(0))),
        name(d.app_log.where("interaction_type = 'started'"), "created_at", sid("id"), sid("recipe_id")),
        name(d.reports, "reported_at", sid("report_id"), F.col("symptom_type")), name(d.checkins, "created_at", sid("checkin_id"), F.col("summary")))


@query("timeline_union", sql(f"SELECT user_id, {ts('t_at')} AS at, type, id FROM line", *_LINE_DEPS, line=_LINE))
def timeline_union(d: Domain):
    return _timeline(d).drop("title")


@query("group_by_day", sql(f"""
    SELECT user_id, {day(f"t_at - {_LOCAL}")} AS day, row_number() OVER (PARTITION BY user_id, (t_at - {_LOCAL})::DATE ORDER BY t_at DESC, type, id) AS pos, type, id FROM line""", *_LINE_DEPS, line=_LINE))
def group_by_day(d: Domain):
    return dashboard.group_by_day(_timeline(d), _TZ)


@query("agg_diary_stats", sql(f"""
    SELECT user_id, count(*) FILTER (food AND now) AS meals_today, count(*) FILTER (NOT food AND now) AS reports_today, count(*) FILTER (food) AS food_entries, coalesce(any_value(rough), 0)::BIGINT AS rough_notes
    FROM (SELECT *, type IN ('meal', 'chat_food', 'recipe') AS food, (t_at - {_LOCAL})::DATE = DATE '{TODAY}' AS now FROM line)
    LEFT JOIN (SELECT user_id, count(*) AS rough FROM rep WHERE sev >= 0.55 GROUP BY 1) USING (user_id) GROUP BY user_id""", *_LINE_DEPS, line=_LINE, rep=_REPORTS))
def agg_diary_stats(d: Domain):
    return dashboard.diary_stats(_timeline(d), _reports(d), TODAY, _TZ)


@query("distinct_meal_options", sql(f"""
    SELECT user_id, {n_text('food_name')} AS name_key, food_name, meal_log_id, coalesce(recipe_id, -1) AS recipe_id, {ts('logged_at')} AS logged_at FROM meals
    QUALIFY row_number() OVER (PARTITION BY user_id, {n_text('food_name')} ORDER BY logged_at DESC, meal_log_id DESC) = 1""", "meals"))
def distinct_meal_options(d: Domain):
    return dashboard.distinct_meal_options(d.meals).withColumn("recipe_id", F.coalesce("recipe_id", F.lit(-1)))


# ---- content ------------------------------------------------------------------------------------------------

_STOP = ", ".join(repr(w) for w in vocab.CONTENT_STOP_WORDS)


def _tokens(source: str, key: str) -> str:
    return f"""SELECT {key}, token, sum(w) AS w FROM (SELECT {key}, w, unnest(string_split(replace({n_text('text')}, '-', ' '), ' ')) AS token FROM ({source})) WHERE length(token) > 2 AND token NOT IN ({_STOP}) GROUP BY ALL"""


_CONTENT = {**_SIG, "lists": _LISTS,
    "prof": _tokens("""SELECT user_id, name AS text, ((count(*) OVER (PARTITION BY user_id) - (rn - 1)) * greatest(1, least(3, n)))::DOUBLE AS w FROM lists WHERE list_name = 'easier'
        UNION ALL SELECT user_id, food_name, 0.75 FROM meals QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY logged_at DESC, meal_log_id DESC) <= 20""", "user_id"),
    "vecs": _tokens("SELECT recipe_id, name AS text, 2.0 AS w FROM recipes UNION ALL SELECT recipe_id, unnest(ingredients), 2.5 FROM recipes UNION ALL SELECT recipe_id, description, 0.75 FROM recipes", "recipe_id"),
    "cosines": """SELECT user_id, recipe_id, sum(p.w * v.w) / (any_value(pn) * any_value(vn)) AS sim FROM prof p JOIN pairs USING (user_id) JOIN vecs v USING (recipe_id, token) JOIN (SELECT user_id, sqrt(sum(w * w)) AS pn FROM prof GROUP BY 1) USING (user_id)
        JOIN (SELECT recipe_id, sqrt(sum(w * w)) AS vn FROM vecs GROUP BY 1) USING (recipe_id) GROUP BY ALL""",
    "best": f"""SELECT user_id, recipe_id, r.name AS title, sim, sim * (1 - pen) AS score FROM (SELECT c.user_id, c.recipe_id, sim, coalesce((SELECT max({c01('l.score')}) * 0.85 FROM lists l JOIN recipes x ON x.recipe_id = c.recipe_id
            WHERE l.user_id = c.user_id AND l.list_name = 'watch' AND {has(f"replace({n_text('''concat_ws(' ', x.name, array_to_string(x.ingredients, ' '), x.description)''')}, '-', ' ')", "replace(l.name, '-', ' ')")}), 0) AS pen
        FROM cosines c WHERE sim > 0 AND NOT EXISTS (SELECT 1 FROM meals m WHERE m.user_id = c.user_id AND m.recipe_id = c.recipe_id)) JOIN recipes r USING (recipe_id)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(sim * (1 - pen), 9) DESC, round(sim, 9) DESC, r.name, recipe_id) = 1"""}
_CONTENT_DEPS = (*_SIG_DEPS, "meals", "recipes", "pairs")


def _experiment(d: Domain):
    lists = write_and_read(dashboard.watchlists(_signals(d), NOW), "lists")
    return content.content_experiment(lists.where("list_name = 'watch'"), lists.where("list_name = 'easier'"), d.meals, d.kept("pairs"), d.recipes)


@query("content_experiment", sql(f"SELECT user_id, recipe_id, title, {r6('sim')} AS similarity, {r6('score')} AS score FROM best WHERE score > 0", *_CONTENT_DEPS, **_CONTENT))
def content_experiment(d: Domain):
    return _experiment(d)


@query("tfidf_experiment", sql(f"""
    SELECT user_id, recipe_id, {r6('sum(p.w * v.w) / (any_value(pn) * any_value(vn))')} AS score FROM prof p JOIN pairs USING (user_id) JOIN tv v USING (recipe_id, token) JOIN (SELECT user_id, sqrt(sum(w * w)) AS pn FROM prof GROUP BY 1) USING (user_id)
        JOIN (SELECT recipe_id, sqrt(sum(w * w)) AS vn FROM tv GROUP BY 1) USING (recipe_id) WHERE vn > 0 GROUP BY ALL""", *_CONTENT_DEPS, **{k: v for k, v in _CONTENT.items() if k not in ("cosines", "best")},
    tv="SELECT recipe_id, token, w * ln(((SELECT count(DISTINCT recipe_id) FROM vecs) + 1) / (df + 1)) AS w FROM vecs JOIN (SELECT token, count(*) AS df FROM vecs GROUP BY 1) USING (token)"))
def tfidf_experiment(d: Domain):
    lists = dashboard.watchlists(_signals(d), NOW)
    return content.tfidf_scores(content.user_profile(lists.where("list_name = 'easier'"), d.meals), content.recipe_tokens(d.recipes), d.pairs)


def _shown(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({n_text(x)}, ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) <= 2 THEN upper(w) ELSE upper(left(w, 1)) || substr(w, 2) END), ' ')"


@query("rule_next_steps", sql(f"""
    SELECT user_id, i::BIGINT AS pos, steps[i][1] AS kind, steps[i][2] AS title FROM (SELECT user_id, list_filter([
        CASE WHEN tracked_meals < 3 THEN ['logging', 'Start with a simple baseline'] END, CASE WHEN title IS NOT NULL THEN ['recipe_experiment', 'Try ' || title || ' as a familiar-feeling test'] END,
        CASE WHEN early IS NOT NULL THEN ['ingredient_experiment', 'Test ' || {_shown('early')} || ' with a similar meal'] WHEN top IS NOT NULL THEN ['ingredient_experiment', 'Give ' || {_shown('top')} || ' a quieter test week'] END,
        CASE WHEN gentle IS NOT NULL AND title IS NULL THEN ['logging', 'Use ' || {_shown('gentle')} || ' as a safe-feeling anchor'] END, CASE WHEN check_ins < 2 THEN ['logging', 'Add a quick good-day check-in'] END], lambda s: s IS NOT NULL) AS steps
        FROM totals LEFT JOIN (SELECT user_id, title FROM best WHERE score > 0) b USING (user_id) LEFT JOIN (SELECT user_id, name AS top FROM lists WHERE list_name = 'watch' AND rn = 1) t USING (user_id)
        LEFT JOIN (SELECT user_id, arg_min(name, rn) AS early FROM lists WHERE list_name = 'watch' AND n < 3 GROUP BY 1) e USING (user_id) LEFT JOIN (SELECT user_id, name AS gentle FROM lists WHERE list_name = 'easier' AND rn = 1) g USING (user_id)),
        (SELECT unnest([1, 2, 3]) AS i) WHERE i <= len(steps)""", *dict.fromkeys((*_TOT_DEPS, *_CONTENT_DEPS)), **{**_TOT, **_CONTENT}))
def rule_next_steps(d: Domain):
    return dashboard.next_steps(d.users, dashboard.watchlists(_signals(d), NOW), _totals(d), write_and_read(_experiment(d), "experiment"))


# ---- taste and side features -----------------------------------------------------------------------------------

@query("agg_user_taste", sql(f"""
    SELECT user_id, feature, {r6('raw / sum(raw) OVER (PARTITION BY user_id)')} AS weight FROM (SELECT * FROM (SELECT user_id, feature, round(sum(rating * w), 9) AS raw FROM mean_ratings JOIN f USING (recipe_id) WHERE rating > 0 AND user_id IN (SELECT user_id FROM users) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, feature) <= 24)""", "mean_ratings", "recipes", "users",
    f="""SELECT recipe_id, 'user:taste:word:' || unnest(ingredients) AS feature, 0.4 AS w FROM recipes UNION ALL SELECT recipe_id, 'user:taste:steps:' || n_steps, 0.2 FROM recipes"""))
def agg_user_taste(d: Domain):
    feats = d.recipes.select("recipe_id", F.explode("ingredients").alias("x")).select("recipe_id", F.concat(F.lit("item:word:"), "x").alias("feature"), F.lit(0.4).alias("weight")).unionByName(
        d.recipes.select("recipe_id", F.concat(F.lit("item:steps:"), F.col("n_steps").cast("string")).alias("feature"), F.lit(0.2).alias("weight"))).unionByName(
        d.recipes.select("recipe_id", F.lit("item:ingredient:unknown").alias("feature"), F.lit(0.25).alias("weight")))
    return content.user_taste(d.mean_ratings, feats, d.users)


def _risk_bucket(x: str) -> str:
    return f"CASE WHEN {x} < 0.25 THEN 'low' WHEN {x} < 0.55 THEN 'medium' ELSE 'high' END"


@query("agg_user_side_features", sql(f"""
    SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM users) THEN 'user:cohort:app' ELSE 'user:cohort:historical' END AS feature, 0.2::DOUBLE AS weight FROM all_users
    UNION ALL SELECT user_id, feature, round(0.5::DOUBLE / count(*) OVER (PARTITION BY user_id), 4) + 0.0 FROM rest
    UNION ALL SELECT user_id, feature, round(0.5 * raw / sum(raw) OVER (PARTITION BY user_id), 4) + 0.0 FROM (SELECT * FROM (SELECT user_id, feature, max(raw) AS raw FROM rk GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, feature) <= 12)""",
    "users", "restrictions", "generic_risks", "profile_risks", all_users="SELECT c_custkey::VARCHAR AS user_id FROM customer",
    rest=f"""SELECT DISTINCT user_id, 'user:restriction_type:' || lower(restriction_type) AS feature FROM restrictions UNION SELECT user_id, 'user:restricted_ingredient:' || {n_text('ingredient_name')} FROM restrictions WHERE ingredient_name <> ''""",
    rk=f"""SELECT user_id, 'user:risk_ingredient:' || {n_text('ingredient_name')} || ':' || {_risk_bucket('risk_score')} AS feature, greatest(0.05, confidence) AS raw FROM generic_risks
        UNION ALL SELECT user_id, 'user:ibs_group:' || regexp_replace(trigger_group, '_', ' ', 'g') || ':' || {_risk_bucket('grade')}, greatest(0.05, confidence) FROM profile_risks"""))
def agg_user_side_features(d: Domain):
    people = d.table("customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    rows = content.user_side_features(people, d.users, d.restrictions, d.generic_risks, d.profile_risks)
    return rows.withColumn("weight", F.round("weight", 4))  # shares of small counts tie at six places


# ---- habit tree ---------------------------------------------------------------------------------------------------

_CARE = f"""SELECT DISTINCT user_id, (t_at - {_LOCAL})::DATE AS d, kind FROM (SELECT user_id, logged_at AS t_at, 'water' AS kind FROM meals UNION ALL SELECT user_id, reported_at, 'compost' FROM reports UNION ALL SELECT user_id, created_at, 'compost' FROM checkins)"""
_CARE_DEPS = ("meals", "reports", "checkins")
_GROW = "SELECT user_id, d FROM care GROUP BY ALL HAVING count(*) = 2"


def _care(d: Domain):
    return habits.care_days(d.meals, d.reports, d.checkins, _TZ)


@query("distinct_care_days", sql(f"SELECT user_id, {day('d')} AS care_date, kind AS care_type FROM care", *_CARE_DEPS, care=_CARE))
def distinct_care_days(d: Domain):
    return _care(d)


@query("intersect_care_days", sql(f"SELECT user_id, {day('d')} AS care_date FROM grow", *_CARE_DEPS, care=_CARE, grow=_GROW))
def intersect_care_days(d: Domain):
    return habits.growth_days(_care(d))


@query("care_streaks", sql(f"""
    SELECT c.user_id, coalesce(level, 0)::BIGINT AS level, CASE WHEN date_diff('day', last, DATE '2024-02-04') >= 7 THEN 0 ELSE coalesce(cur, 0) END::BIGINT AS current_streak, coalesce(best, 0)::BIGINT AS longest_streak, {day('stop')} AS last_growth, {day('last')} AS last_care
    FROM (SELECT user_id, max(d) AS last FROM care GROUP BY 1) c LEFT JOIN (SELECT user_id, sum(n) AS level, max(n) AS best, arg_max(n, stop) AS cur, max(stop) AS stop FROM (
        SELECT user_id, count(*) AS n, max(d) AS stop FROM (SELECT user_id, d, d - (row_number() OVER (PARTITION BY user_id ORDER BY d))::INT AS isle FROM grow) GROUP BY user_id, isle) GROUP BY 1) g USING (user_id)""", *_CARE_DEPS, care=_CARE, grow=_GROW))
def care_streaks(d: Domain):
    return habits.care_streaks(_care(d), "2024-02-04")


_SPARSE = "SELECT user_id, CASE WHEN day(d) >= 8 + length(user_id) THEN d + 8 ELSE d END AS d, kind FROM care"
_PLACED = """SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY d) + 1 AS run_no FROM (SELECT user_id, d, bool_or(kind = 'water') AND bool_or(kind = 'compost') AS both_, coalesce(date_diff('day', lag(d) OVER (PARTITION BY user_id ORDER BY d), d) >= 7, false)::INT AS new
    FROM sparse GROUP BY user_id, d)"""


def _sparse(d: Domain):
    """All care days, those of the later part of the month moved on by eight days, so that runs end in between."""
    late = F.dayofmonth("care_date") >= F.length("user_id") + 8
    return _care(d).withColumn("care_date", F.when(late, F.date_add("care_date", 8)).otherwise(F.col("care_date")))


@query("care_runs", sql(f"""
    SELECT user_id, run_no::BIGINT AS run_no, {day('planted')} AS planted, {day('last')} AS last_care, {day("CASE WHEN date_diff('day', last, DATE '2024-02-12') >= 7 THEN last + 7 END")} AS died, coalesce(level, 0)::BIGINT AS level, coalesce(best, 0)::BIGINT AS best_streak,
        CASE WHEN date_diff('day', last, DATE '2024-02-12') >= 7 THEN 'dead' ELSE 'alive' END AS status FROM (SELECT user_id, run_no, min(d) AS planted, max(d) AS last FROM placed GROUP BY ALL)
    LEFT JOIN (SELECT user_id, run_no, sum(n) AS level, max(n) AS best FROM (SELECT user_id, run_no, count(*) AS n FROM (SELECT user_id, run_no, d - (row_number() OVER (PARTITION BY user_id, run_no ORDER BY d))::INT AS isle FROM placed WHERE both_) GROUP BY user_id, run_no, isle) GROUP BY ALL) USING (user_id, run_no)""",
    *_CARE_DEPS, care=_CARE, sparse=_SPARSE, placed=_PLACED))
def care_runs(d: Domain):
    return habits.care_runs(_sparse(d), "2024-02-12")


@query("care_rewards", sql(f"""
    SELECT user_id, event_key, event_type, level, {day('d')} AS care_date, CASE WHEN level >= 7 THEN 'oasis' ELSE 'ground' END AS zone FROM (
        SELECT user_id, 'run:' || run_no || ':growth:' || {day('d')} AS event_key, 'growth' AS event_type, level, d FROM lv
        UNION ALL SELECT user_id, 'run:' || run_no || CASE WHEN level = 7 THEN ':milestone:' ELSE ':cosmetic:' END || level, CASE WHEN level = 7 THEN 'milestone' ELSE 'cosmetic' END, level, d FROM lv WHERE level <= 7 OR level % 2 = 0 OR level % 5 = 0)""",
    *_CARE_DEPS, care=_CARE, sparse=_SPARSE, placed=_PLACED, lv="SELECT user_id, run_no, d, row_number() OVER (PARTITION BY user_id, run_no ORDER BY d) AS level FROM placed WHERE both_"))
def care_rewards(d: Domain):
    return habits.care_rewards(habits.growth_levels(habits.placed_care(_sparse(d))))


# ---- insight cards ---------------------------------------------------------------------------------------------------

_ACT = """SELECT user_id, max(CASE WHEN k = 'm' THEN t END) AS meal, max(CASE WHEN k = 'r' THEN t END) AS rep, max(CASE WHEN k = 'c' THEN t END) AS chk, count(*) FILTER (k = 'b') AS book FROM (
    SELECT user_id, 'm' AS k, logged_at AS t FROM meals UNION ALL SELECT user_id, 'r', reported_at FROM reports UNION ALL SELECT user_id, 'c', created_at FROM checkins UNION ALL SELECT user_id, 'b', created_at FROM cooklists) GROUP BY user_id"""
_TREE = """SELECT user_id, CASE WHEN idle >= 7 THEN 'dead' ELSE 'alive' END AS status, greatest(0, 7 - idle) AS dud, wet, fed, CASE WHEN idle >= 7 THEN (last + 7)::TIMESTAMP END AS died FROM (
    SELECT user_id, max(d) AS last, greatest(0, date_diff('day', max(d), DATE '2024-01-30')) AS idle, bool_or(kind = 'water' AND d = DATE '2024-01-30') AS wet, bool_or(kind = 'compost' AND d = DATE '2024-01-30') AS fed FROM care GROUP BY 1)"""
_E = "TIMESTAMP '1970-01-01'"


def _due(x: str, days: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN {_E} WHEN {x} + INTERVAL {days} DAY <= TIMESTAMP '{NOW}' THEN {x} + INTERVAL {days} DAY END"


_BASE = f"""SELECT *, greatest(rep, chk) AS feel, greatest(meal, rep, chk) AS anylog FROM (SELECT a.*, v.an, v.cb, t.status, t.dud, coalesce(t.wet, false) AS wet, coalesce(t.fed, false) AS fed, t.died FROM act a LEFT JOIN visits v USING (user_id) LEFT JOIN tree t USING (user_id))"""
_CARDS = f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, ord) AS rn, card_id, priority, issued FROM (SELECT * FROM allc QUALIFY row_number() OVER (PARTITION BY user_id, card_id ORDER BY priority DESC, ord) = 1) QUALIFY rn <= 3"""
_RULES = f"""SELECT user_id, 0 AS ord, 130 AS priority, 'tree-dead' AS card_id, coalesce(died, {_E}) AS issued FROM base WHERE status = 'dead'
    UNION ALL SELECT user_id, 1, 125, 'tree-danger', {_E} FROM base WHERE status = 'alive' AND dud <= 2 AND NOT (wet AND fed)
    UNION ALL SELECT user_id, 2, 112, 'tree-compost', {_E} FROM base WHERE status = 'alive' AND wet AND NOT fed UNION ALL SELECT user_id, 3, 112, 'tree-water', {_E} FROM base WHERE status = 'alive' AND fed AND NOT wet
    UNION ALL SELECT user_id, 4, 35, 'tree-full-care', NULL FROM base WHERE status = 'alive' AND NOT wet AND NOT fed AND anylog IS NOT NULL UNION ALL SELECT user_id, 5, 100, 'start-log', {_E} FROM base WHERE anylog IS NULL
    UNION ALL SELECT user_id, 6, 95, 'log-meal', {_due('meal', 3)} FROM base WHERE anylog IS NOT NULL AND ({_due('meal', 3)}) IS NOT NULL UNION ALL SELECT user_id, 7, 90, 'log-feeling', {_due('feel', 5)} FROM base WHERE anylog IS NOT NULL AND ({_due('feel', 5)}) IS NOT NULL
    UNION ALL SELECT user_id, 8, CASE WHEN an IS NULL THEN 82 ELSE 72 END, 'analysis', {_due('an', 7)} FROM base WHERE ({_due('an', 7)}) IS NOT NULL UNION ALL SELECT user_id, 9, 62, 'cookbook', {_due('cb', 14)} FROM base WHERE book > 0 AND ({_due('cb', 14)}) IS NOT NULL"""
_ALLC = """SELECT * FROM rules UNION ALL SELECT user_id, 20, 30, 'analysis', NULL FROM cnt WHERE c < 3 AND anylog IS NOT NULL
    UNION ALL SELECT user_id, 21, 20, 'steady-diary', NULL FROM cnt WHERE c + (c < 3 AND anylog IS NOT NULL)::INT < 3
    UNION ALL SELECT user_id, 22, 10, CASE WHEN book > 0 THEN 'cookbook' ELSE 'browse-recipes' END, NULL FROM cnt WHERE c + (c < 3 AND anylog IS NOT NULL)::INT + (c + (c < 3 AND anylog IS NOT NULL)::INT < 3)::INT < 3"""
_CARD_CTES = {"care": _CARE, "act": _ACT, "tree": _TREE,
    "visits": f"SELECT c_custkey::VARCHAR AS user_id, CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2024-01-20' + to_days((c_custkey % 10)::INT) END AS an, CASE WHEN c_acctbal > 3000 THEN TIMESTAMP '2024-01-10' + to_days((c_custkey % 20)::INT) END AS cb FROM customer",
    "base": _BASE, "rules": _RULES, "cnt": "SELECT user_id, book, anylog, (SELECT count(*) FROM rules r WHERE r.user_id = b.user_id) AS c FROM base b", "allc": _ALLC, "cards": _CARDS}
_CARD_DEPS = (*_CARE_DEPS, "cooklists")


def _cards(d: Domain):
    act = dashboard.latest_activity(d.meals, d.reports, d.checkins, d.cooklists)
    c, bal = F.col("c_custkey"), F.col("c_acctbal")
    at = lambda base, n: F.lit(base).cast("timestamp") + F.make_dt_interval((c % n).cast("int"))
    visits = d.table("customer").select(c.cast("string").alias("user_id"), F.when(bal > 0, at("2024-01-20", 10)).alias("analysis_visited"), F.when(bal > 3000, at("2024-01-10", 20)).alias("cookbook_visited"))
    return dashboard.insight_cards(act, visits, habits.tree_state(_care(d), TODAY), NOW)


@query("rule_insight_cards", sql(f"SELECT user_id, rn, card_id, priority::BIGINT AS priority, {ts('issued')} AS issued_at FROM cards", *_CARD_DEPS, **_CARD_CTES))
def rule_insight_cards(d: Domain):
    return _cards(d)


@query("unread_insight_count", sql(f"""
    SELECT user_id, count(*) FILTER (issued > coalesce(r, {_E})) AS n_unread FROM cards LEFT JOIN (SELECT c_custkey::VARCHAR AS user_id, TIMESTAMP '2024-01-25' AS r FROM customer WHERE c_acctbal > 1000) USING (user_id) GROUP BY 1""", *_CARD_DEPS, **_CARD_CTES))
def unread_insight_count(d: Domain):
    reads = d.table("customer").where("c_acctbal > 1000").select(F.col("c_custkey").cast("string").alias("user_id"), F.lit("2024-01-25").cast("timestamp").alias("last_read_at"))
    return dashboard.unread_cards(_cards(d), reads)
