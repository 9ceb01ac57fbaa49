"""Labels, recent context, splits and the symptom model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import vocab
from ..functions import numbers as num
from ..functions.timeline import window_aggregate
from ..session import write_and_read


def explicit_outcomes(reports: DataFrame) -> DataFrame:
    """Reports that state an outcome: user_id, outcome_at, label."""
    kind = F.lower(F.trim(F.coalesce("symptom_type", F.lit(""))))
    label = (F.when(F.coalesce("no_symptoms", F.lit(False)), 0)
             .when(~kind.isin("none", "no symptoms", "no_symptoms")
                   & (num.clamp01(F.col("severity")) > vocab.POSITIVE_SEVERITY), 1))
    return (reports.where(F.col("reported_at").isNotNull())
            .select("user_id", F.col("reported_at").alias("outcome_at"), label.alias("label"))
            .where(F.col("label").isNotNull()))


def match_meals_to_outcomes(meals: DataFrame, outcomes: DataFrame, hours: float = vocab.WINDOW_HOURS) -> DataFrame:
    """Each outcome goes to the latest meal of the prior window; a meal keeps its first outcome and
    later ones are dropped, not moved to older meals."""
    probes = outcomes.groupBy("user_id", "outcome_at").agg(F.min("label").alias("label")).withColumn(
        "_pid", F.concat_ws("|", "user_id", F.unix_micros("outcome_at").cast("string")))
    latest = window_aggregate(
        probes, meals, ["user_id"], "_pid", "outcome_at", "logged_at", hours,
        {"m": ("max", F.struct(F.col("logged_at"), (-F.col("meal_id")).alias("neg_id")))})
    hit = (probes.join(latest.where("m is not null"), "_pid")
           .select("user_id", "outcome_at", "label", F.col("m.logged_at").alias("logged_at"),
                   (-F.col("m.neg_id")).alias("meal_id")))
    first = hit.groupBy("meal_id", "user_id", "logged_at").agg(
        F.min(F.struct("outcome_at", "label")).alias("o"))
    return first.select("meal_id", "user_id", "logged_at", "o.outcome_at", "o.label")


def label_forward(meals: DataFrame, outcomes: DataFrame, hours: float = vocab.WINDOW_HOURS) -> DataFrame:
    """Label of the nearest outcome in the window after each meal, else null."""
    near = window_aggregate(
        meals, outcomes, ["user_id"], "meal_id", "logged_at", "outcome_at", hours,
        {"o": ("min", F.struct("outcome_at", "label"))}, direction="ahead")
    return meals.select("meal_id").join(
        near.select(F.col("meal_id").cast("long").alias("meal_id"), F.col("o.label").alias("label")), "meal_id", "left")


def recent_events(refs: DataFrame, meals: DataFrame, reports: DataFrame, hours: float = vocab.WINDOW_HOURS) -> DataFrame:
    """Pair form of the recent context: the events strictly before each reference, within the window."""
    width = int(hours * 3_600_000_000)
    b = lambda c: F.floor(F.unix_micros(F.col(c)) / width)
    events = (meals.select("user_id", F.lit("meal").alias("side"), F.col("logged_at").alias("at"))
              .unionByName(reports.select("user_id", F.lit("report").alias("side"), F.col("reported_at").alias("at")))
              .where(F.col("at").isNotNull()))
    right = events.withColumn("_b", F.explode(F.array(b("at"), b("at") + 1)))
    left = refs.select("user_id", "ref_id", "ref_ts", b("ref_ts").alias("_b"))
    gap = F.unix_micros("ref_ts") - F.unix_micros("at")
    return left.join(right, ["user_id", "_b"]).where((gap > 0) & (gap <= width)).select("ref_id", "side", "at")


def recent_context(refs: DataFrame, meals: DataFrame, reports: DataFrame,
                   hours: float = vocab.WINDOW_HOURS) -> DataFrame:
    """Window features over [t - hours, t) for every reference; linear, no pairs."""
    load = num.clamp01(num.optional_float(F.col("trigger_load"), 0.0))
    sev = num.clamp01(num.optional_float(F.col("severity"), 0.0))
    none = F.coalesce("no_symptoms", F.lit(False))
    positive = ~none & (sev > vocab.POSITIVE_SEVERITY)
    ev = (meals.select("user_id", F.col("logged_at").alias("at"), F.lit(1).alias("m"), load.alias("load"),
                       F.lit(None).cast("double").alias("sev"), F.lit(None).cast("int").alias("none"),
                       F.lit(None).cast("int").alias("pos"))
          .unionByName(reports.select(
              "user_id", F.col("reported_at").alias("at"), F.lit(None).cast("int").alias("m"),
              F.lit(None).cast("double").alias("load"), sev.alias("sev"), none.cast("int").alias("none"),
              positive.cast("int").alias("pos"))))
    agg = window_aggregate(
        refs, ev, ["user_id"], "ref_id", "ref_ts", "at", hours,
        {"n_meals": ("sum", F.col("m")), "load_sum": ("sum", F.col("load")),
         "last_meal": ("max", F.when(F.col("m") == 1, F.col("at"))),
         "n_reports": ("sum", F.when(F.col("sev").isNotNull(), 1)), "sev_sum": ("sum", F.col("sev")),
         "sev_max": ("max", F.col("sev")), "n_none": ("sum", F.col("none")), "n_pos": ("sum", F.col("pos")),
         "last_pos": ("max", F.when(F.col("pos") == 1, F.col("at")))},
        include_probe_time=False)
    full = refs.select(F.col("ref_id").cast("string").alias("ref_id"), "ref_ts").join(agg, "ref_id", "left")
    since = lambda c: F.coalesce((F.unix_micros("ref_ts") - F.unix_micros(c)) / 3.6e9, F.lit(float(hours)))
    ratio = lambda a, n: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(n)), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return full.select(
        "ref_id", zero("sev_max").alias("recent_symptom_severity"), zero("sev_max").alias("recent_symptom_max"),
        ratio("sev_sum", "n_reports").alias("recent_symptom_mean"),
        ratio("n_none", "n_reports").alias("recent_no_symptom_fraction"),
        zero("n_pos").alias("recent_positive_report_count"), zero("n_meals").alias("recent_meal_count"),
        num.clamp01(ratio("load_sum", "n_meals")).alias("recent_trigger_load"),
        since("last_pos").alias("hours_since_last_symptom"),
        F.col("last_pos").isNull().cast("double").alias("hours_since_last_symptom_missing"),
        since("last_meal").alias("hours_since_last_meal"),
        F.col("last_meal").isNull().cast("double").alias("hours_since_last_meal_missing"))


def training_gate(examples: DataFrame, min_rows: int = 100, min_class: int = 20, min_users: int = 5) -> DataFrame:
    rows, cls, users = max(20, min_rows), max(2, min_class), max(2, min_users)
    stats = examples.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"),
                         F.count_if(F.col("label") == 0).alias("n_neg"), F.countDistinct("user_id").alias("n_users"))
    return stats.withColumn("can_train", (F.col("n") >= rows) & (F.least("n_pos", "n_neg") >= cls)
                            & (F.col("n_users") >= users))


def class_balance(examples: DataFrame) -> DataFrame:
    """Weight of a positive row: negatives over positives (an absent class counts as one)."""
    neg = F.count_if(F.col("label") == 0)
    pos = F.count_if(F.col("label") == 1)
    return examples.agg((F.when(neg == 0, 1).otherwise(neg) / F.greatest(F.lit(1), pos)).alias("pos_weight"))


def split_group_disjoint(examples: DataFrame, tries: int = 24, frac: float = 0.25, min_class: int = 2) -> DataFrame:
    """First of `tries` hashed user splits whose two sides hold both classes.

    All tries are judged by one aggregate over per-user class counts.  Falls back to the
    chronological split.
    """
    users = examples.groupBy("user_id").agg(F.count_if(F.col("label") == 1).alias("p"),
                                            F.count_if(F.col("label") == 0).alias("q"))
    draws = (users.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
             .withColumn("test", num.hash_unit(F.col("user_id"), F.col("try"), seed=0) < frac))
    side = lambda c, t: F.sum(F.when(F.col("test") == t, F.col(c)).otherwise(0))
    valid = (draws.groupBy("try").agg(side("p", False).alias("tp"), side("q", False).alias("tq"),
                                      side("p", True).alias("ep"), side("q", True).alias("eq"))
             .where((F.least("tp", "tq") >= max(1, min_class)) & (F.least("ep", "eq") >= 1))
             .agg(F.min("try").alias("try")))
    chosen = valid.scalar()
    marked = (examples.withColumn("_try", chosen)
              .withColumn("_test", num.hash_unit(F.col("user_id"), F.col("_try"), seed=0) < frac))
    grouped = (marked.where(F.col("_try").isNotNull())
               .withColumn("part", F.when(F.col("_test"), "test").otherwise("train"))
               .withColumn("strategy", F.lit("group_disjoint")).drop("_try", "_test"))
    rest = marked.where(F.col("_try").isNull()).drop("_try", "_test")
    return grouped.unionByName(split_chrono_purged(rest, 1 - frac, min_class))


def split_chrono_purged(examples: DataFrame, train_frac: float = 0.75, min_class: int = 2) -> DataFrame:
    """Last quarter by meal time is the test part; training rows need their outcome before the first
    test meal.  Without both classes left for training all rows train and none test.

    The cut is found from counts per instant, so rows are never ordered in one task.
    """
    n = examples.agg(F.count(F.lit(1))).scalar()
    per_time = examples.groupBy("logged_at").agg(F.count(F.lit(1)).alias("k"))
    # Running count over days first, then over instants within the day.
    days = per_time.groupBy(F.to_date("logged_at").alias("d")).agg(F.sum("k").alias("dk"))
    upto = days.select("d", (F.sum("dk").over(W.orderBy("d")) - F.col("dk")).alias("before_day"))
    times = (per_time.withColumn("d", F.to_date("logged_at")).join(upto, "d")
             .withColumn("before", F.col("before_day")
                         + F.sum("k").over(W.partitionBy("d").orderBy("logged_at")) - F.col("k")))
    cut = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * train_frac)))
    # Instant that holds position `cut`: rows before it train, rows after it test.
    edge = times.where((F.col("before") <= cut) & (F.col("before") + F.col("k") > cut)).agg(
        F.min(F.struct("logged_at", "before")))
    placed = examples.withColumn("_edge", edge.scalar()).withColumn("_n", n)
    at_edge = F.row_number().over(W.partitionBy("logged_at").orderBy("meal_id"))
    tie = (placed.where(F.col("logged_at") == F.col("_edge.logged_at"))
           .withColumn("_pos", F.col("_edge.before") + at_edge - 1)
           .withColumn("_test", F.col("_pos") >= F.greatest(F.lit(1), F.least(
               F.col("_n") - 1, F.floor(F.col("_n") * train_frac)))).drop("_pos"))
    others = (placed.where(F.col("_edge.logged_at").isNull() | (F.col("logged_at") != F.col("_edge.logged_at")))
              .withColumn("_test", F.coalesce(F.col("logged_at") > F.col("_edge.logged_at"), F.lit(False))))
    rows = tie.unionByName(others)
    first_test = F.col("_edge.logged_at")
    part = (F.when(F.col("_test"), "test").when(F.col("outcome_at") < first_test, "train").otherwise("purged"))
    marked = rows.withColumn("part", part).drop("_test", "_edge", "_n")
    train = marked.where("part = 'train'").agg(
        F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0))).scalar()
    ok = F.col("_ok") >= max(1, min_class)
    return (marked.withColumn("_ok", train)
            .withColumn("strategy", F.when(ok, "chronological_purged").otherwise("no_valid_holdout"))
            .withColumn("part", F.when(ok, F.col("part")).otherwise("train")).drop("_ok"))


def feature_columns() -> list[str]:
    """The training columns, in order."""
    head = ["catalog_recipe_present", "recipe_ingredients_missing", "recipe_ingredient_count_missing",
            "recipe_nutrition_missing", "recipe_minutes_missing", "recipe_step_count_missing"]
    slots = ["recipe_calories"] + [f"recipe_{s}_pdv" for s in vocab.NUTRITION_SLOTS[1:]]
    counts = ["recipe_minutes", "recipe_ingredient_count", "recipe_step_count", "trigger_group_count",
              "trigger_ingredient_count", "trigger_ingredient_fraction"]
    groups = [f"trigger_{g}_{k}" for g in vocab.TRIGGER_GROUPS for k in ("present", "count")]
    recent = ["recent_symptom_max", "recent_symptom_mean", "recent_no_symptom_fraction",
              "recent_positive_report_count", "recent_meal_count", "recent_trigger_load",
              "hours_since_last_symptom", "hours_since_last_symptom_missing",
              "hours_since_last_meal", "hours_since_last_meal_missing"]
    return head + slots + counts + groups + recent


def train_symptom_model(examples: DataFrame, columns: Sequence[str] | None = None, trees: int = 120, depth: int = 3,
                        step: float = 0.05, subsample: float = 0.9, seed: int = 42):
    """Boosted trees with class weights: (model, one-row metrics).

    Metrics come from the held-out part, with `train_log_loss` and `base_log_loss` (that of the share of positives) of the part
    learned from; the returned model is refit on all rows.  Returns (None, gate row) if the gate refuses.
    """
    from .boost import fit_together
    from .evaluation import classifier_metrics

    columns = list(columns or feature_columns())
    gate = training_gate(examples)
    if not gate.first()["can_train"]:
        return None, gate
    # Boosting reads its rows many times: the split is written once.
    data = write_and_read(split_group_disjoint(examples.fillna(0.0, subset=columns)), "split")

    # The model for the metrics and the one to keep differ in their rows only, and are fitted in the same passes.
    train = F.col("part") == "train"
    weight, whole = (float(class_balance(part).first()[0]) for part in (data.where(train), data))
    first, final = fit_together(data, columns, [(train, weight), (F.lit(True), whole)], trees, depth, step, subsample, seed=seed)
    score = lambda part: first.predict(data.where(F.col("part") == part), "p")
    w = F.when(F.col("label") == 1, F.lit(weight)).otherwise(1.0)
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    loss = -F.sum(w * F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))) / F.sum(w)
    share = F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)) / F.sum(w)
    base = F.when((share <= 0) | (share >= 1), F.lit(0.0)).otherwise(-(share * F.log(share) + (1 - share) * F.log(1 - share)))
    seen = score("train").agg(loss.alias("train_log_loss"), base.alias("base_log_loss"))
    held = score("test").select(F.col("label").cast("double").alias("label"), "p")
    metrics = classifier_metrics(held)
    return final, metrics.select("*", *[seen.select(c).scalar().alias(c) for c in seen.columns])


def score_symptom(features: DataFrame, model=None) -> DataFrame:
    """Model probability, or the heuristic for all rows when there is no model.  The model knows its own columns; those that
    are missing, as when it is older or newer than the features, count as 0."""
    from .risk import heuristic_risk

    if model is None:
        return features.withColumn("symptom_risk", heuristic_risk())
    return model.predict(features)
