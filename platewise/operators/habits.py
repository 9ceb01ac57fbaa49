"""Care calendar, streaks, runs and rewards of the habit tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import vocab


def care_days(meals: DataFrame, reports: DataFrame, checkins: DataFrame, tz: str = "UTC") -> DataFrame:
    """Distinct local dates with water (a meal) and compost (a report or check-in)."""
    day = lambda c: F.to_date(F.from_utc_timestamp(F.col(c), tz)).alias("care_date")
    rows = (meals.select("user_id", day("logged_at"), F.lit("water").alias("care_type"))
            .unionByName(reports.select("user_id", day("reported_at"), F.lit("compost").alias("care_type")))
            .unionByName(checkins.select("user_id", day("created_at"), F.lit("compost").alias("care_type"))))
    return rows.where("care_date is not null").distinct()


def growth_days(days: DataFrame) -> DataFrame:
    """Dates with both kinds of care: the intersection of the two calendars."""
    kind = lambda k: days.where(F.col("care_type") == k).select("user_id", "care_date")
    return kind("water").intersect(kind("compost"))


def _islands(growth: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive dates: keys, start, stop, length."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy("care_date"))
    return (growth.withColumn("_isle", F.date_sub(F.col("care_date"), rn)).groupBy(*keys, "_isle")
            .agg(F.min("care_date").alias("start"), F.max("care_date").alias("stop"), F.count(F.lit(1)).alias("length"))
            .drop("_isle"))


def care_streaks(days: DataFrame, today: str) -> DataFrame:
    """Level (growth days), current and longest streak; the streak of a tree left for 7 days is 0."""
    isles = _islands(growth_days(days), ["user_id"]).groupBy("user_id").agg(
        F.sum("length").alias("level"), F.max("length").alias("longest_streak"),
        F.max_by("length", "stop").alias("_last"), F.max("stop").alias("last_growth"))
    last = days.groupBy("user_id").agg(F.max("care_date").alias("last_care"))
    dead = F.datediff(F.lit(today).cast("date"), F.col("last_care")) >= vocab.DEATH_DAYS
    return last.join(isles, "user_id", "left").select(
        "user_id", F.coalesce("level", F.lit(0)).alias("level"),
        F.when(dead, 0).otherwise(F.coalesce("_last", F.lit(0))).cast("long").alias("current_streak"),
        F.coalesce("longest_streak", F.lit(0)).alias("longest_streak"), "last_growth", "last_care")


def placed_care(days: DataFrame, replants: DataFrame | None = None) -> DataFrame:
    """Care days with their run number.  With a replant table a run begins at the first care or at a
    replant, and care after its death is lost until the next replant; without one, care after a death
    begins the next run."""
    flags = days.groupBy("user_id", "care_date").agg(
        F.bool_or(F.col("care_type") == "water").alias("wet"), F.bool_or(F.col("care_type") == "compost").alias("fed"))
    order = W.partitionBy("user_id").orderBy("care_date")
    if replants is None:
        gap = F.datediff("care_date", F.lag("care_date").over(order)) >= vocab.DEATH_DAYS
        return (flags.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int"))
                .withColumn("run_no", F.sum("_new").over(order) + 1).withColumn(
                    "planted", F.min("care_date").over(W.partitionBy("user_id", "run_no"))).drop("_new"))
    marks = replants.select("user_id", F.col("replant_date").alias("care_date")).distinct()
    rows = flags.withColumn("_r", F.lit(0)).unionByName(
        marks.select("user_id", "care_date", F.lit(None).cast("boolean").alias("wet"),
                     F.lit(None).cast("boolean").alias("fed"), F.lit(1).alias("_r")))
    by = W.partitionBy("user_id").orderBy("care_date", F.col("_r").desc())
    seg = rows.withColumn("_seg", F.sum("_r").over(by))
    inside = W.partitionBy("user_id", "_seg").orderBy("care_date", F.col("_r").desc())
    gap = F.datediff("care_date", F.lag("care_date").over(inside)) >= vocab.DEATH_DAYS
    lost = seg.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int"))
    lost = lost.withColumn("_lost", F.sum("_gap").over(inside)).withColumn(
        "planted", F.min("care_date").over(W.partitionBy("user_id", "_seg")))
    first = F.min("_seg").over(W.partitionBy("user_id"))
    return (lost.where(F.col("_lost") == 0).withColumn("run_no", F.col("_seg") - first + 1)
            .select("user_id", "care_date", F.coalesce("wet", F.lit(False)).alias("wet"),
                    F.coalesce("fed", F.lit(False)).alias("fed"), "run_no", "planted"))


def care_runs(days: DataFrame, today: str, replants: DataFrame | None = None) -> DataFrame:
    """One row per run: planted, last care, death, level, best streak."""
    placed = placed_care(days, replants)
    keys = ["user_id", "run_no"]
    ends = placed.groupBy(*keys).agg(F.min("planted").alias("planted"), F.max("care_date").alias("last_care"))
    isles = _islands(placed.where("wet and fed").select(*keys, "care_date"), keys).groupBy(*keys).agg(
        F.sum("length").alias("level"), F.max("length").alias("best_streak"))
    gone = F.datediff(F.lit(today).cast("date"), F.col("last_care")) >= vocab.DEATH_DAYS
    return ends.join(isles, keys, "left").select(
        *keys, "planted", "last_care", F.when(gone, F.date_add("last_care", vocab.DEATH_DAYS)).alias("died"),
        F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("best_streak", F.lit(0)).alias("best_streak"),
        F.when(gone, "dead").otherwise("alive").alias("status"))


def growth_levels(placed: DataFrame) -> DataFrame:
    """Level reached on every growth day of a run."""
    w = W.partitionBy("user_id", "run_no").orderBy("care_date")
    return placed.where("wet and fed").select("user_id", "run_no", "care_date", F.row_number().over(w).alias("level"))


def zone(level: Column) -> Column:
    out = None
    for name, at in vocab.ZONES:
        out = F.when(level >= at, name) if out is None else out.when(level >= at, name)
    return out.otherwise(vocab.GROUND_ZONE)


def next_reward_level(level: Column) -> Column:
    up = lambda n: F.ceil((level + 1) / n) * n
    return F.when(level < 7, level + 1).otherwise(F.least(
        F.when(level % 2 == 0, level + 2).otherwise(level + 1), up(5), up(10)))


def next_milestone(level: Column) -> Column:
    out = None
    for m in vocab.MILESTONES:
        out = F.when(level < m, m) if out is None else out.when(level < m, m)
    return out


def care_rewards(levels: DataFrame) -> DataFrame:
    """Growth, milestone and cosmetic events, unique on (user, event key)."""
    lv = F.col("level")
    run = F.concat(F.lit("run:"), F.col("run_no").cast("string"))
    event = lambda kind, tail: F.struct(F.concat(run, F.lit(f":{kind}:"), tail.cast("string")).alias("event_key"),
                                        F.lit(kind).alias("event_type"))
    small = (lv <= 7) | (lv % 2 == 0) | (lv % 5 == 0)
    events = F.array(
        event("growth", F.col("care_date")), F.when(lv.isin(*vocab.MILESTONES), event("milestone", lv))
        .when(small, event("cosmetic", lv)))
    return (levels.withColumn("e", F.explode(F.filter(events, lambda x: x.isNotNull())))
            .select("user_id", "e.event_key", "e.event_type", "level", "care_date", zone(lv).alias("zone"))
            .dropDuplicates(["user_id", "event_key"]))


def tree_state(days: DataFrame, today: str) -> DataFrame:
    """Today's view per user: status, days until death, care of today."""
    now = F.lit(today).cast("date")
    agg = days.groupBy("user_id").agg(
        F.max("care_date").alias("last_care"),
        F.coalesce(F.bool_or((F.col("care_type") == "water") & (F.col("care_date") == now)), F.lit(False)).alias("watered_today"),
        F.coalesce(F.bool_or((F.col("care_type") == "compost") & (F.col("care_date") == now)), F.lit(False)).alias("composted_today"))
    idle = F.greatest(F.lit(0), F.datediff(now, F.col("last_care")))
    dead = idle >= vocab.DEATH_DAYS
    return agg.select("user_id", F.when(dead, "dead").otherwise("alive").alias("status"),
                      F.greatest(F.lit(0), vocab.DEATH_DAYS - idle).alias("days_until_death"), "watered_today",
                      "composted_today", F.when(dead, F.date_add("last_care", vocab.DEATH_DAYS).cast("timestamp")).alias("died_at"))
