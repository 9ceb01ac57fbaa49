import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from platewise.functions.timeline import numbered, window_aggregate
from platewise.operators import checkins, context, dashboard, exposure, habits

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def hours(h):
    return T0 + dt.timedelta(hours=h)


@pytest.mark.parametrize("direction, include", [("back", True), ("back", False), ("ahead", True)])
def test_window_aggregate_equals_brute_force(spark, direction, include):
    rnd = random.Random(5)
    ev = [(rnd.choice("ab"), rnd.randrange(0, 200), rnd.randrange(1, 9)) for _ in range(300)]
    pr = [(i, rnd.choice("abc"), rnd.randrange(0, 200)) for i in range(80)]
    events = spark.createDataFrame([(u, hours(h), v) for u, h, v in ev], "u string, t timestamp, v int")
    probes = spark.createDataFrame([(i, u, hours(h)) for i, u, h in pr], "id long, u string, p timestamp")
    got = {int(r["id"]): (r["s"], r["m"]) for r in window_aggregate(
        probes, events, ["u"], "id", "p", "t", 24, {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, direction, include).collect()}
    for i, u, h in pr:
        lo, hi = (h - 24, h) if direction == "back" else (h, h + 24)
        vals = [v for w, t, v in ev if w == u and lo <= t <= hi and (include or t != h)]
        assert got[i] == ((sum(vals), max(vals)) if vals else (None, None))


def test_numbered_equals_row_number(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "b", i * 7 % 500) for i in range(500)], "k string, x long")
    out = numbered(df, ["k"], [F.col("x")], F.floor(F.col("x") / 40), "n").collect()
    for key in ("hot", "b"):
        mine = sorted((r["x"], r["n"]) for r in out if r["k"] == key)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_recent_context_literal(spark):
    ref = spark.createDataFrame([("u", "r", hours(100))], "user_id string, ref_id string, ref_ts timestamp")
    meals = spark.createDataFrame([("u", hours(100 + h), 0.0) for h in (-2, 0, 1, -49)], "user_id string, logged_at timestamp, trigger_load double")
    reports = spark.createDataFrame([("u", hours(97), 0.8, False), ("u", hours(99), 0.0, True), ("u", hours(100), 1.0, False)],
                                    "user_id string, reported_at timestamp, severity double, no_symptoms boolean")
    r = context.recent_context(ref, meals, reports).first()
    assert (r["recent_meal_count"], r["hours_since_last_meal"], r["recent_symptom_max"]) == (1.0, 2.0, 0.8)
    assert (r["recent_symptom_mean"], r["recent_positive_report_count"], r["recent_no_symptom_fraction"]) == (0.4, 1.0, 0.5)
    assert r["hours_since_last_symptom"] == 3.0


def test_context_without_events(spark):
    ref = spark.createDataFrame([("u", "r", hours(100))], "user_id string, ref_id string, ref_ts timestamp")
    meals = spark.createDataFrame([], "user_id string, logged_at timestamp, trigger_load double")
    reports = spark.createDataFrame([], "user_id string, reported_at timestamp, severity double, no_symptoms boolean")
    r = context.recent_context(ref, meals, reports).first()
    assert r["hours_since_last_meal"] == 48.0 and r["hours_since_last_meal_missing"] == 1.0 and r["recent_meal_count"] == 0.0


def reports(spark, *rows):
    return spark.createDataFrame([("u", hours(h), kind, sev, none) for h, kind, sev, none in rows],
                                 "user_id string, reported_at timestamp, symptom_type string, severity double, no_symptoms boolean")


def meals(spark, *hs):
    return spark.createDataFrame([(i, "u", hours(h)) for i, h in enumerate(hs)], "meal_id long, user_id string, logged_at timestamp")


def test_labels(spark, rows):
    out = context.explicit_outcomes(reports(spark, (1, "pain", 0.1, False), (2, "none", 0.0, True), (3, "pain", 0.7, False), (4, "No Symptoms", 0.9, False)))
    assert [r["label"] for r in out.orderBy("outcome_at").collect()] == [0, 1]
    late = context.explicit_outcomes(reports(spark, (49, "pain", 0.7, False)))
    assert context.label_forward(meals(spark, 0), late).first()["label"] is None


def test_one_report_labels_one_meal(spark):
    two = context.explicit_outcomes(reports(spark, (10, "pain", 0.7, False), (11, "none", 0.0, True)))
    out = context.match_meals_to_outcomes(meals(spark, 8, 9), two).collect()
    assert [(r["meal_id"], r["label"]) for r in out] == [(1, 1)]


def examples(spark, rows):
    return spark.createDataFrame([(i, u, hours(m), hours(o), y) for i, (u, m, o, y) in enumerate(rows)],
                                 "meal_id long, user_id string, logged_at timestamp, outcome_at timestamp, label int")


def test_group_split_is_disjoint(spark):
    ex = examples(spark, [(f"u{i // 2}", i, i + 1, i % 2) for i in range(16)])
    out = context.split_group_disjoint(ex).collect()
    assert {r["strategy"] for r in out} == {"group_disjoint"} and len(out) == 16
    side = {p: {r["user_id"] for r in out if r["part"] == p} for p in ("train", "test")}
    assert not side["train"] & side["test"] and all({r["label"] for r in out if r["part"] == p} == {0, 1} for p in side)


def test_chronological_split_purges(spark):
    ex = examples(spark, [("u", i, 9.5 if i == 8 else i + 0.5, i % 2) for i in range(12)])
    out = {r["meal_id"]: (r["part"], r["strategy"]) for r in context.split_group_disjoint(ex).collect()}
    assert {s for _, s in out.values()} == {"chronological_purged"}
    assert out[8][0] == "purged" and out[9][0] == "test" and out[7][0] == "train"


def test_no_valid_holdout(spark):
    ex = examples(spark, [("u", i, 99, i % 2) for i in range(12)])
    assert {(r["part"], r["strategy"]) for r in context.split_group_disjoint(ex).collect()} == {("train", "no_valid_holdout")}


def test_risk_evidence_equals_pairs(spark):
    rnd = random.Random(3)
    rep = spark.createDataFrame([(i, "u", hours(rnd.randrange(0, 400)), rnd.random() if i % 3 else 0.0, i % 3 == 0) for i in range(40)],
                                "report_id long, user_id string, reported_at timestamp, severity double, no_symptoms boolean")
    exp = spark.createDataFrame([("u", rnd.choice(["a", "b"]), hours(rnd.randrange(0, 400)), rnd.choice([0.0, 0.5, 2.0])) for _ in range(60)],
                                "user_id string, normalized_name string, exposed_at timestamp, portion_weight double")
    from platewise.streaming.jobs import evidence_of

    a = {r["normalized_name"]: r for r in exposure.risk_evidence(rep, exp).collect()}
    b = {r["normalized_name"]: r for r in evidence_of(exposure.attribution_pairs(rep, exp)).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["exposures"] == b[k]["exposures"]
        assert a[k]["positive"] == pytest.approx(b[k]["positive"]) and a[k]["negative"] == pytest.approx(b[k]["negative"])


def test_near_duplicate_boundary(spark):
    meal = spark.createDataFrame([("u", "Red Rice", hours(10))], "user_id string, food_name string, logged_at timestamp")
    foods = spark.createDataFrame([("u", "red  rice", hours(h)) for h in (8.9, 9.0, 11.0, 11.1)] + [("v", "red rice", hours(10))],
                                  "user_id string, food_name string, logged_at timestamp")
    left = {(r["user_id"], r["logged_at"].replace(tzinfo=dt.timezone.utc)) for r in checkins.chat_foods_without_meal(foods, meal).collect()}
    assert left == {("u", hours(8.9)), ("u", hours(11.1)), ("v", hours(10))}


def care(spark, *events):
    return spark.createDataFrame([("u", dt.date(2024, 7, d), k) for d, k in events], "user_id string, care_date date, care_type string")


def both(*days):
    return [(d, k) for d in days for k in ("water", "compost")]


def test_dead_tree_and_best(spark):
    days = care(spark, *both(1, 2, 3))
    r = habits.care_streaks(days, "2024-07-10").first()
    assert r["current_streak"] == 0 and r["longest_streak"] == 3 and r["level"] == 3
    assert habits.care_streaks(days, "2024-07-09").first()["current_streak"] == 3


def test_gap_of_seven_days_ends_the_run(spark):
    days = care(spark, *both(1, 2), *both(9), (20, "water"))
    out = {r["run_no"]: (r["level"], r["status"], str(r["died"])) for r in habits.care_runs(days, "2024-07-21").collect()}
    assert out == {1: (2, "dead", "2024-07-09"), 2: (1, "dead", "2024-07-16"), 3: (0, "alive", "None")}


def test_care_after_death_waits_for_replant(spark):
    days = care(spark, *both(1, 2), *both(12), *both(15, 16))
    again = spark.createDataFrame([("u", dt.date(2024, 7, 14))], "user_id string, replant_date date")
    out = {r["run_no"]: (str(r["planted"]), r["level"], r["best_streak"]) for r in habits.care_runs(days, "2024-07-17", again).collect()}
    assert out == {1: ("2024-07-01", 2, 2), 2: ("2024-07-14", 2, 2)}


@pytest.mark.parametrize("level, zone, reward, milestone", [(0, "ground", 1, 7), (7, "oasis", 8, 30), (29, "oasis", 30, 30), (31, "canopy", 32, 100), (300, "ufo", 302, None)])
def test_levels(spark, level, zone, reward, milestone):
    r = spark.range(1).select(F.lit(level).alias("l")).select(
        habits.zone(F.col("l")).alias("z"), habits.next_reward_level(F.col("l")).alias("r"), habits.next_milestone(F.col("l")).alias("m")).first()
    assert (r["z"], r["r"], r["m"]) == (zone, reward, milestone)


def test_daily_nutrition_literal(spark):
    day = lambda d, h: dt.datetime(2024, 7, d, h, tzinfo=dt.timezone.utc)
    meals_ = spark.createDataFrame([("u", day(2, 8), 420.0, 18.0, 12.0), ("u", day(2, 19), 210.0, 14.0, 15.0), ("u", dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc), 999.0, 1.0, 1.0)],
                                   "user_id string, logged_at timestamp, calories double, protein_g double, fat_g double")
    out = {str(r["day"]): r for r in dashboard.daily_nutrition(meals_.select("user_id"), meals_, "2024-07-04 12:00:00").collect()}
    r = out["2024-07-02"]
    assert len(out) == 7 and (r["calories"], r["protein"], r["fat"], r["n_meals"]) == (630.0, 32.0, 27.0, 2)


def test_ewma_batch_is_step_by_step(spark):
    rows = [("u", "x", i, hours(i), s, f, s * f) for i, (s, f) in enumerate([(0.8, 1.0), (0.1, 0.5), (0.6, 0.2), (0.0, 1.0)])]
    df = spark.createDataFrame(rows, "user_id string, ingredient_name string, checkin_id long, created_at timestamp, severity double, freq double, evidence double")
    state = (0.0, 0.0, 0)
    for r in rows:
        state = checkins.ewma_step(*state, r[4], r[5], r[6])
    got = checkins.checkin_grades(df.orderBy(F.rand(1))).first()
    assert (got["grade"], got["confidence"], got["evidence_count"]) == state
