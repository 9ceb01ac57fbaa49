"""Chat check-ins: validation, evidence, meals, running grades."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import numbers as num, text as tx
from .matching import alias_matches


def clean_foods(c):
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def validate_checkins(raw: DataFrame, most_foods: int | None = None, most_symptoms: int | None = None) -> DataFrame:
    """Clean lists and decide validity: a finite severity; a complete one needs a summary and food in
    all three windows.  Lists longer than the limits, if any are given, make a check-in invalid; nothing is cut."""
    sev = F.col("severity").try_cast("double")
    out = raw.select(
        "checkin_id", "user_id", "created_at", num.clamp01(sev).alias("severity"), num.is_finite(sev).alias("_fin"),
        F.coalesce("symptoms", F.array().cast("array<string>")).alias("symptoms"),
        F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), F.coalesce("complete", F.lit(False)).alias("complete"),
        *[clean_foods(F.try_element_at("food_windows", F.lit(w))).alias(w) for w in vocab.CHECKIN_WINDOWS])
    full = (F.col("summary") != "")
    for w in vocab.CHECKIN_WINDOWS:
        full = full & (F.size(w) > 0)
    fits = F.lit(True)
    if most_foods is not None:
        for w in vocab.CHECKIN_WINDOWS:
            fits = fits & (F.size(w) <= most_foods)
    if most_symptoms is not None:
        fits = fits & (F.size("symptoms") <= most_symptoms)
    return out.withColumn("valid", F.col("_fin") & (~F.col("complete") | full) & fits).drop("_fin")


def checkin_foods(checkins: DataFrame) -> DataFrame:
    """One row per food of the three windows: checkin_id, user_id, window, index, food, created_at."""
    windows = F.array(*[F.struct(F.lit(i).alias("w"), F.col(name).alias("foods")) for i, name in enumerate(vocab.CHECKIN_WINDOWS)])
    return (checkins.select("checkin_id", "user_id", "created_at", F.explode(windows).alias("x"))
            .select("checkin_id", "user_id", "created_at", F.col("x.w").alias("w"), F.posexplode("x.foods").alias("idx", "food")))


def chat_meal_time(created_at, w):
    """Window time before the check-in: 4, 12.5 or 20.5 hours."""
    hours = F.array(*[F.lit(int(h * 3600)) for h in vocab.CHECKIN_OFFSETS])
    return F.timestamp_micros(F.unix_micros(created_at) + F.get(hours, w).cast("long") * 1_000_000)


def checkin_to_meals(checkins: DataFrame) -> DataFrame:
    return checkin_foods(checkins).select(
        "user_id", "checkin_id", "w", "idx", F.trim("food").alias("food_name"),
        chat_meal_time(F.col("created_at"), F.col("w")).alias("logged_at")).where("food_name != ''")


def chat_foods_without_meal(foods: DataFrame, meals: DataFrame, minutes: int = 60) -> DataFrame:
    """Drop chat foods for which a meal of the same name lies within the given minutes.

    The user, the name and the time bucket are the join key, and meals are reduced to the first and
    last instant per bucket and side before they are compared.
    """
    width = minutes * 60_000_000
    t = lambda c: F.unix_micros(F.col(c))
    key = tx.normalize_text(F.col("food_name"))
    near = (meals.select("user_id", key.alias("_k"), t("logged_at").alias("_t")).where("_k != '' and _t is not null").distinct()
            .withColumn("_b", F.explode(F.array(*[F.floor(F.col("_t") / width) + d for d in (-1, 0, 1)]))))
    # Within one bucket every instant is within reach of the bucket itself; of the neighbours only
    # the latest earlier and the earliest later instants can be the nearest.
    own = F.floor(F.col("_t") / width)
    edges = near.groupBy("user_id", "_k", "_b").agg(
        F.max(F.when(own < F.col("_b"), F.col("_t"))).alias("_before"), F.min(F.when(own > F.col("_b"), F.col("_t"))).alias("_after"),
        F.bool_or(own == F.col("_b")).alias("_same"))
    keyed = foods.withColumn("_k", key).withColumn("_ft", t("logged_at")).withColumn("_b", F.floor(F.col("_ft") / width))
    hit = F.coalesce(F.col("_same"), F.lit(False)) | F.coalesce(F.col("_ft") - F.col("_before") <= width, F.lit(False)) | F.coalesce(
        F.col("_after") - F.col("_ft") <= width, F.lit(False))
    return keyed.join(edges, ["user_id", "_k", "_b"], "left").where(~hit).select(*foods.columns)


def checkin_evidence(checkins: DataFrame, catalog: DataFrame) -> DataFrame:
    """Match counts of the three windows, frequency and evidence per (check-in, ingredient)."""
    foods = checkin_foods(checkins)
    # Texts repeat; match each distinct text once.
    texts = foods.select(tx.normalize_text(F.col("food")).alias("id")).where("id != ''").distinct()
    hits = alias_matches(texts.withColumn("text", F.col("id")), catalog)
    rows = foods.withColumn("id", tx.normalize_text(F.col("food"))).join(hits, "id")
    count = lambda i: F.count_if(F.col("w") == i).alias(f"c{i + 1}")
    agg = rows.groupBy("checkin_id", "ingredient_name").agg(count(0), count(1), count(2))
    a, b, c = vocab.CHECKIN_WEIGHTS
    freq = F.least(F.lit(1.0), (a * F.col("c1") + b * F.col("c2") + c * F.col("c3")) / 3)
    return (agg.withColumn("freq", freq).join(checkins.select("checkin_id", "user_id", "created_at", "severity"), "checkin_id")
            .withColumn("evidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("severity") * F.col("freq")))))


def ewma_step(grade: float, confidence: float, n: int, severity: float, freq: float, evidence: float) -> tuple[float, float, int]:
    """One check-in on one ingredient; both numbers are kept to four places after every step, rounded
    from their exact value, ties up."""
    rate = min(0.35, 1.0 / (n + 2))
    if severity > 0.2:
        grade = grade * (1 - rate) + evidence * rate
    else:
        grade = grade * (1 - rate * freq * (1 - severity))
    grade = max(0.0, min(1.0, grade))
    four = lambda x: float(Decimal(x).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return four(grade), four(min(1.0, confidence + 0.08 + 0.04 * freq)), n + 1


def checkin_grades(evidence: DataFrame) -> DataFrame:
    """Grades after all check-ins, in time order.

    The update depends on order and is rounded at each step, so each (user, ingredient) is one
    sequential pass.  Partitions are sorted by key and time and stream through in Arrow batches; only
    the state of the current key is held.
    """
    keys = ["user_id", "ingredient_name"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "grade", "confidence", "evidence_count"]
        state, key = (0.0, 0.0, 0), None
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                if (r.user_id, r.ingredient_name) != key:
                    if key is not None:
                        done.append((*key, *state))
                    state, key = (0.0, 0.0, 0), (r.user_id, r.ingredient_name)
                state = ewma_step(*state, r.severity, r.freq, r.evidence)
            yield pd.DataFrame(done, columns=names)
        if key is not None:
            yield pd.DataFrame([(*key, *state)], columns=names)

    ordered = evidence.repartition(*keys).sortWithinPartitions(*keys, "created_at", "checkin_id")
    return ordered.select(*keys, "severity", "freq", "evidence").mapInPandas(
        fold, "user_id string, ingredient_name string, grade double, confidence double, evidence_count long")


def validate_events(df: DataFrame, rules: dict) -> DataFrame:
    """Add valid and reject_reason (the first rule that fails; a null check fails)."""
    reason = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, F.lit(name)) if reason is None else reason.when(bad, F.lit(name))
    reason = F.lit(None).cast("string") if reason is None else reason
    return df.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())
