"""Signals, weekly and daily panels, diary, next steps, insight cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import vocab
from ..functions import numbers as num, text as tx

SOURCES = ("meal patterns", "IBS check-ins")


def signal_label(score: Column, support: Column) -> Column:
    return (F.when((score >= 0.72) & (support >= 4), "Strong signal")
            .when((score >= 0.58) & (support >= 2), "Worth watching")
            .when(score >= 0.58, "Early clue")
            .when((score <= 0.25) & (support >= 2), "Usually goes well")
            .when(score <= 0.35, "Looks gentle so far").otherwise("Still learning"))


def merge_signals(risks: DataFrame, profile: DataFrame, exposures: DataFrame) -> DataFrame:
    """Meal-pattern and check-in risks merged by name.  Support is the larger one; the check-in score
    replaces the other when its support is larger, else the higher score counts."""
    finite = lambda c: F.coalesce(F.when(num.is_finite(F.col(c)), F.col(c).cast("double")), F.lit(0.0))
    support = lambda c: F.greatest(F.lit(0.0), F.floor(finite(c) + 0.5)).cast("long")

    def one(df: DataFrame, score: str, count: str, side: str, evidence: bool) -> DataFrame:
        pos, neg = ((finite("positive_evidence"), finite("negative_evidence")) if evidence else (F.lit(0.0), F.lit(0.0)))
        rows = df.select(
            "user_id", tx.normalize_text(F.col("ingredient_name")).alias("name"), num.clamp01(finite(score)).alias("s"),
            support(count).alias("n"), F.coalesce("last_evidence_at", "updated_at").alias("t"), pos.alias("p"), neg.alias("q"))
        # Names that repeat inside one source: highest support decides the score, evidence adds up.
        return rows.where("name != ''").groupBy("user_id", "name").agg(F.struct(
            F.max_by("s", F.struct("n", "s")).alias("s"), F.max("n").alias("n"), F.max("t").alias("t"),
            F.sum("p").alias("p"), F.sum("q").alias("q")).alias(side))

    a, b = one(risks, "risk_score", "exposure_count", "a", True), one(profile, "grade", "evidence_count", "b", False)
    given = F.when(F.coalesce("normalized_name", F.lit("")) != "", F.col("normalized_name")).otherwise(F.col("ingredient_name"))
    seen = (exposures.where(F.col("exposed_at").isNotNull())
            .groupBy("user_id", tx.normalize_text(given).alias("name")).agg(F.max("exposed_at").alias("seen")))
    both = a.join(b, ["user_id", "name"], "full_outer").join(seen, ["user_id", "name"], "left")
    two = F.col("a").isNotNull() & F.col("b").isNotNull()
    only = F.coalesce("a", "b")
    score = F.when(two, F.when(F.col("b.n") > F.col("a.n"), F.col("b.s")).otherwise(F.greatest("a.s", "b.s"))).otherwise(only["s"])
    n = F.when(two, F.greatest("a.n", "b.n")).otherwise(only["n"])
    last = F.when(two, F.greatest("a.t", "b.t", "seen")).otherwise(F.coalesce(only["t"], "seen"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = both.select(
        "user_id", "name", tx.format_name(F.col("name")).alias("display"), score.alias("score"), n.alias("support"),
        (z("a.p") + z("b.p")).alias("positive_evidence"), (z("a.q") + z("b.q")).alias("negative_evidence"),
        last.alias("last_seen"), F.concat_ws(", ", F.when(F.col("a").isNotNull(), SOURCES[0]),
                                             F.when(F.col("b").isNotNull(), SOURCES[1])).alias("sources"))
    return out.withColumn("label", signal_label(F.col("score"), F.col("support")))


def watchlists(signals: DataFrame, now: str) -> DataFrame:
    """Top 8 foods to watch and top 6 easier foods per user, flagged when seen in the last 45 days."""
    recent = F.coalesce(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_seen")
                        <= 45 * 86_400_000_000, F.lit(False))
    def top(cond: Column, name: str, order: Column, n: int) -> DataFrame:
        w = W.partitionBy("user_id").orderBy(order, F.col("support").desc(), "name")
        return (signals.where(cond).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
                .select("user_id", F.lit(name).alias("list_name"), "rn", "name", "score", "support", recent.alias("recent")))

    return top(F.col("score") >= 0.45, "watch", F.col("score").desc(), 8).unionByName(
        top((F.col("score") <= 0.35) & (F.col("support") >= 1), "easier", F.col("score").asc(), 6))


def all_reports(reports: DataFrame, checkins: DataFrame) -> DataFrame:
    """Symptom reports and chat check-ins as (user_id, at, severity, easier)."""
    sev = num.clamp01(F.col("severity"))
    easy = F.coalesce(F.col("severity"), F.lit(0.0)) <= 0.2
    a = reports.select("user_id", F.col("reported_at").alias("at"), sev.alias("severity"),
                       (F.coalesce("no_symptoms", F.lit(False)) | easy).alias("easier"))
    return a.unionByName(checkins.select("user_id", F.col("created_at").alias("at"), sev.alias("severity"), easy.alias("easier")))


def weekly_pattern(users: DataFrame, meals: DataFrame, reports: DataFrame, now: str, tz: str = "UTC") -> DataFrame:
    """Four 7-day buckets that end with today (local): meals, mean severity in percent, easier reports.

    Rows are summed per user and week first; the empty spine is joined to those sums.
    """
    today = F.to_date(F.from_utc_timestamp(F.lit(now).cast("timestamp"), tz))
    start = F.date_sub(today, 27)
    week = lambda c: F.floor(F.datediff(F.to_date(F.from_utc_timestamp(F.col(c), tz)), start) / 7) + 1
    inside = lambda df: df.where(F.col("week").between(1, 4))
    m = inside(meals.select("user_id", week("logged_at").alias("week"))).groupBy("user_id", "week").agg(
        F.count(F.lit(1)).alias("meals"))
    r = inside(reports.withColumn("week", week("at"))).groupBy("user_id", "week").agg(
        F.avg("severity").alias("sev"), F.count_if("easier").alias("easier"))
    spine = users.select("user_id").distinct().withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn(
        "week", F.col("week").cast("long"))
    full = spine.join(m, ["user_id", "week"], "left").join(r, ["user_id", "week"], "left")
    return full.select("user_id", "week", F.coalesce("meals", F.lit(0)).alias("meals"),
                       F.coalesce(F.floor(F.round(F.col("sev") * 100, 9) + 0.5), F.lit(0)).cast("long").alias("symptom_level"),
                       F.coalesce("easier", F.lit(0)).alias("easier"))


def daily_nutrition(users: DataFrame, meals: DataFrame, now: str, tz: str = "UTC") -> DataFrame:
    """Dense 7-day calendar (local days) of calories, protein, fat and meals with any of them."""
    today = F.to_date(F.from_utc_timestamp(F.lit(now).cast("timestamp"), tz))
    local = F.to_date(F.from_utc_timestamp(F.col("logged_at"), tz))
    z = lambda c: F.coalesce(F.when(num.is_finite(F.col(c)), F.col(c).cast("double")), F.lit(0.0))
    rows = (meals.select("user_id", local.alias("day"), z("calories").alias("c"), z("protein_g").alias("p"), z("fat_g").alias("f"))
            .where(F.col("day").between(F.date_sub(today, 6), today) & ((F.col("c") > 0) | (F.col("p") > 0) | (F.col("f") > 0))))
    sums = rows.groupBy("user_id", "day").agg(F.sum("c").alias("c"), F.sum("p").alias("p"), F.sum("f").alias("f"),
                                              F.count(F.lit(1)).alias("n"))
    spine = users.select("user_id").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(today, 6), today)))
    full = spine.join(sums, ["user_id", "day"], "left")
    up = lambda c, d: num.half_up(F.round(F.coalesce(F.col(c), F.lit(0.0)), 9), d)
    return full.select("user_id", "day", up("c", 0).alias("calories"), up("p", 1).alias("protein"), up("f", 1).alias("fat"),
                       F.coalesce("n", F.lit(0)).alias("n_meals"))


def dashboard_totals(users: DataFrame, meals: DataFrame, reports: DataFrame, daily: DataFrame, watch: DataFrame,
                     signals: DataFrame) -> DataFrame:
    m = meals.groupBy("user_id").agg(F.count(F.lit(1)).alias("tracked_meals"))
    r = reports.groupBy("user_id").agg(F.count(F.lit(1)).alias("check_ins"), F.count_if("easier").alias("easier_reports"),
                                       F.count_if(F.col("severity") >= 0.55).alias("rough_reports"))
    d = daily.groupBy("user_id").agg(F.sum("calories").alias("calories_7d"), F.sum("protein").alias("protein_7d"),
                                     F.sum("fat").alias("fat_7d"), F.sum("n_meals").alias("meals_with_nutrition"))
    w = watch.where("list_name = 'watch'").groupBy("user_id").agg(F.count(F.lit(1)).alias("top_signals"))
    s = signals.groupBy("user_id").agg(F.count(F.lit(1)).alias("_signals"))
    full = users.select("user_id").distinct()
    for part in (m, r, d, w, s):
        full = full.join(part, "user_id", "left")
    full = full.fillna(0)
    has = (F.col("_signals") + F.col("tracked_meals") + F.col("check_ins") + F.col("meals_with_nutrition")) > 0
    return (full.withColumn("protein_7d", num.half_up(F.round("protein_7d", 9), 1))
            .withColumn("fat_7d", num.half_up(F.round("fat_7d", 9), 1)).withColumn("has_data", has).drop("_signals"))


def timeline(meals: DataFrame, chat_foods: DataFrame, activity: DataFrame, reports: DataFrame, checkins: DataFrame) -> DataFrame:
    """One typed timeline; each input has user_id, at, id, title."""
    parts = [df.select("user_id", "at", F.lit(kind).alias("type"), F.col("id").cast("string").alias("id"), "title")
             for kind, df in (("meal", meals), ("chat_food", chat_foods), ("recipe", activity),
                              ("checkin", reports), ("chat_checkin", checkins))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_by_day(line: DataFrame, tz: str = "UTC") -> DataFrame:
    """Entries per local day with their position in the day, newest first.

    A day's entries stay rows; the position is the grouping, so that no day is gathered whole.
    """
    day = F.to_date(F.from_utc_timestamp(F.col("at"), tz))
    w = W.partitionBy("user_id", "day").orderBy(F.col("at").desc(), "type", "id")
    return line.withColumn("day", day).withColumn("pos", F.row_number().over(w)).select("user_id", "day", "pos", "type", "id")


def diary_stats(line: DataFrame, rough: DataFrame, today: str, tz: str = "UTC") -> DataFrame:
    """Meals and reports of today, all food entries, rough notes (severity from .55 up)."""
    food = F.col("type").isin("meal", "chat_food", "recipe")
    now = F.to_date(F.from_utc_timestamp(F.col("at"), tz)) == F.lit(today).cast("date")
    a = line.groupBy("user_id").agg(F.count_if(food & now).alias("meals_today"), F.count_if(~food & now).alias("reports_today"),
                                    F.count_if(food).alias("food_entries"))
    b = rough.where(F.col("severity") >= 0.55).groupBy("user_id").agg(F.count(F.lit(1)).alias("rough_notes"))
    return a.join(b, "user_id", "left").fillna(0)


def distinct_meal_options(meals: DataFrame) -> DataFrame:
    """Newest meal per normalized food name."""
    name = tx.normalize_text(F.col("food_name"))
    rows = meals.where(F.trim("food_name") != "").withColumn("name_key", name)
    return rows.groupBy("user_id", "name_key").agg(F.max(F.struct("logged_at", "meal_log_id", "food_name", "recipe_id")).alias("m")).select(
        "user_id", "name_key", F.trim("m.food_name").alias("food_name"), "m.meal_log_id", "m.recipe_id", "m.logged_at")


def next_steps(users: DataFrame, lists: DataFrame, totals: DataFrame, experiment: DataFrame) -> DataFrame:
    """Up to three ordered suggestions per user."""
    watch = lists.where("list_name = 'watch'")
    first = watch.where("rn = 1").select("user_id", F.col("name").alias("_top"))
    early = watch.where("support < 3").groupBy("user_id").agg(F.min_by("name", "rn").alias("_early"))
    gentle = lists.where("list_name = 'easier' and rn = 1").select("user_id", F.col("name").alias("_gentle"))
    full = users.select("user_id").distinct()
    for part in (totals.select("user_id", "tracked_meals", "check_ins"), first, early, gentle,
                 experiment.select("user_id", F.col("title").alias("_exp"))):
        full = full.join(part, "user_id", "left")
    full = full.fillna(0, ["tracked_meals", "check_ins"])
    step = lambda cond, kind, title: F.when(cond, F.struct(F.lit(kind).alias("kind"), title.alias("title")))
    said = lambda *parts: F.concat(*[F.lit(p) if not isinstance(p, Column) else p for p in parts])
    food = lambda c: tx.format_name(F.col(c))
    steps = F.array(
        step(F.col("tracked_meals") < 3, "logging", F.lit("Start with a simple baseline")),
        step(F.col("_exp").isNotNull(), "recipe_experiment", said("Try ", F.col("_exp"), " as a familiar-feeling test")),
        F.when(F.col("_early").isNotNull(), F.struct(F.lit("ingredient_experiment").alias("kind"),
                                                     said("Test ", food("_early"), " with a similar meal").alias("title")))
        .when(F.col("_top").isNotNull(), F.struct(F.lit("ingredient_experiment").alias("kind"),
                                                  said("Give ", food("_top"), " a quieter test week").alias("title"))),
        step(F.col("_gentle").isNotNull() & F.col("_exp").isNull(), "logging",
             said("Use ", food("_gentle"), " as a safe-feeling anchor")),
        step(F.col("check_ins") < 2, "logging", F.lit("Add a quick good-day check-in")))
    kept = F.slice(F.filter(steps, lambda x: x.isNotNull()), 1, 3)
    return full.select("user_id", F.posexplode(kept).alias("pos", "s")).select(
        "user_id", (F.col("pos") + 1).alias("pos"), "s.kind", "s.title")


def latest_activity(meals: DataFrame, reports: DataFrame, checkins: DataFrame, cookbook: DataFrame) -> DataFrame:
    """Latest time per log and user, with the cookbook count.  One aggregate over the union of the logs."""
    logs = [("m", meals, "logged_at"), ("r", reports, "reported_at"), ("c", checkins, "created_at"), ("b", cookbook, "created_at")]
    rows = None
    for tag, df, col in logs:
        part = df.select("user_id", F.lit(tag).alias("k"), F.col(col).alias("t"))
        rows = part if rows is None else rows.unionByName(part)
    last = lambda k: F.max(F.when(F.col("k") == k, F.col("t")))
    return rows.groupBy("user_id").agg(last("m").alias("latest_meal"), last("r").alias("latest_report"),
                                       last("c").alias("latest_checkin"), F.count_if(F.col("k") == "b").alias("cookbook_count"),
                                       last("b").alias("latest_saved"))


FIRST_ISSUED = "1970-01-01 00:00:00"


def insight_cards(activity: DataFrame, visits: DataFrame, tree: DataFrame, now: str, first_issued: str = FIRST_ISSUED) -> DataFrame:
    """Up to three cards per user by priority, one per card id.

    `activity` as in `latest_activity`; `visits`: analysis_visited, cookbook_visited; `tree`: status,
    days_until_death, watered_today, composted_today, died_at.
    """
    at = F.lit(now).cast("timestamp")
    first = F.lit(first_issued).cast("timestamp")
    never = F.lit(None).cast("timestamp")
    full = activity.join(visits, "user_id", "left").join(tree, "user_id", "left")
    feeling = F.greatest("latest_report", "latest_checkin")
    any_log = F.greatest(F.col("latest_meal"), feeling)
    due = lambda c, d: F.when(c.isNull(), first).when(
        c + F.make_dt_interval(F.lit(d)) <= at, c + F.make_dt_interval(F.lit(d)))
    card = lambda cond, name, issued, prio: F.when(
        F.coalesce(cond, F.lit(False)), F.struct(prio.alias("priority") if isinstance(prio, Column) else F.lit(prio).alias("priority"),
                                                 F.lit(name).alias("card_id") if isinstance(name, str) else name.alias("card_id"),
                                                 issued.alias("issued_at")))
    alive, dead = F.col("status") == "alive", F.col("status") == "dead"
    wet, fed = F.coalesce("watered_today", F.lit(False)), F.coalesce("composted_today", F.lit(False))
    stale = vocab.STALE_DAYS
    meal_due = F.when(any_log.isNotNull(), due(F.col("latest_meal"), stale["meal"]))
    feel_due = F.when(any_log.isNotNull(), due(feeling, stale["feeling"]))
    seen_due = due(F.col("analysis_visited"), stale["analysis"])
    book_due = F.when(F.col("cookbook_count") > 0, due(F.col("cookbook_visited"), stale["cookbook"]))
    rules = F.array(
        card(dead, "tree-dead", F.coalesce("died_at", first), 130),
        card(~F.coalesce(dead, F.lit(False)) & (F.col("days_until_death") <= 2) & ~(wet & fed), "tree-danger", first, 125),
        card(alive & wet & ~fed, "tree-compost", first, 112), card(alive & fed & ~wet, "tree-water", first, 112),
        card(alive & ~wet & ~fed & any_log.isNotNull(), "tree-full-care", never, 35),
        card(any_log.isNull(), "start-log", first, 100), card(meal_due.isNotNull(), "log-meal", meal_due, 95),
        card(feel_due.isNotNull(), "log-feeling", feel_due, 90),
        card(seen_due.isNotNull(), "analysis", seen_due, F.when(F.col("analysis_visited").isNotNull(), 72).otherwise(82)),
        card(book_due.isNotNull(), "cookbook", book_due, 62))
    cards = full.select("user_id", "cookbook_count", any_log.isNotNull().alias("_any"),
                        F.filter(rules, lambda x: x.isNotNull()).alias("c0"))
    kind = cards.schema["c0"].dataType.simpleString()
    more = lambda prev, cond, name, prio: F.when(
        (F.size(prev) < 3) & cond, F.concat(prev, F.array(F.struct(
            F.lit(prio).alias("priority"), (F.lit(name) if isinstance(name, str) else name).alias("card_id"),
            never.alias("issued_at"))).cast(kind))).otherwise(F.col(prev))
    has_book = F.col("cookbook_count") > 0
    cards = (cards.withColumn("c1", more("c0", F.col("_any"), "analysis", 30))
             .withColumn("c2", more("c1", F.lit(True), "steady-diary", 20))
             .withColumn("c3", more("c2", F.lit(True), F.when(has_book, F.lit("cookbook")).otherwise(F.lit("browse-recipes")), 10)))
    flat = cards.select("user_id", F.posexplode("c3").alias("pos", "c")).select("user_id", "pos", "c.*")
    one = flat.groupBy("user_id", "card_id").agg(F.max(F.struct("priority", (-F.col("pos")).alias("neg"), "issued_at")).alias("b"))
    w = W.partitionBy("user_id").orderBy(F.col("b.priority").desc(), F.col("b.neg").desc())
    return one.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 3).select(
        "user_id", "rn", "card_id", F.col("b.priority").alias("priority"), F.col("b.issued_at").alias("issued_at"))


def unread_cards(cards: DataFrame, reads: DataFrame) -> DataFrame:
    """Cards issued after the user's last read."""
    epoch = F.lit(FIRST_ISSUED).cast("timestamp")
    return (cards.join(reads, "user_id", "left").groupBy("user_id")
            .agg(F.count_if(F.col("issued_at") > F.coalesce("last_read_at", epoch)).alias("n_unread")))


def plan_entitlement(users: DataFrame, now: str, plan_cols=("plan",), premium=vocab.PREMIUM_VALUES,
                     trial_days: int = vocab.TRIAL_DAYS) -> DataFrame:
    """Premium from any plan key, trial days from the account age; without a creation time the trial runs."""
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")
    paid = F.lit(False)
    for c in plan_cols:
        paid = paid | F.coalesce(clean(F.col(c)).isin(*premium), F.lit(False))
    born = F.col("created_at")
    age = F.greatest(F.lit(0), F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(born))
    used = F.when(born.isNull(), F.lit(0)).otherwise(F.floor(age / 86_400_000_000)).cast("long")
    out = users.select("user_id", paid.alias("is_premium"), used.alias("days_used"), born.alias("_born"))
    left = F.when(F.col("is_premium"), trial_days).otherwise(F.greatest(F.lit(0), trial_days - F.col("days_used"))).cast("long")
    return out.select(
        "user_id", "is_premium", "days_used", left.alias("days_remaining"),
        (F.col("_born") + F.make_dt_interval(F.lit(trial_days))).alias("trial_ends_at"),
        (F.col("is_premium") | F.col("_born").isNull() | (F.col("days_used") < trial_days)).alias("feature_access"))
