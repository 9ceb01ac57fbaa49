"""Queries: the streaming jobs over the given tables, checked against SQL over the same rows.

Windowed results are compared where the watermark has passed: the last windows stay open.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checkins as ck
from ..session import scratch_path, write_and_read
from ..streaming import grades, jobs
from .health import _EVIDENCE, _PAIRS
from .mapping import TRAINED_AT, Domain, day, n_ing, r6, sql, status, ts
from .panels import _CARE, _CARE_DEPS, _PLACED, _SPARSE, _TZ
from .registry import query
from .safety import GRADE_CTES, GRADE_DEPS, GRADES


#: Rows of a file of a stream's input.
FILE_ROWS = 200_000


def _as_stream(d: Domain, df, name: str, parts: int = 4, order: str = "at", last=None):
    """Lays a frame out as the input of a stream: `parts` batches that follow each other in time, each of as many files as its
    rows need; a batch's files are written side by side and are not sorted.  `last` is a frame that arrives after all."""
    path = scratch_path(d.spark, name)
    laid = write_and_read(df.repartitionByRange(parts * 8, order).withColumn("_part", F.floor(F.spark_partition_id() / 8).cast("int")), f"{name}-laid")
    n = {r[0]: r[1] for r in laid.groupBy("_part").count().collect()}
    files = max(1, -(-max(n.values(), default=1) // FILE_ROWS))
    for k in range(parts):  # one after the other, since files are taken by the time they were written
        laid.where(F.col("_part") == k).drop("_part").repartition(files).write.mode("append").parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(d.spark, path, df.schema, files=files)


def _names(d: Domain):
    return d.recipes.select("recipe_id", F.explode("ingredients").alias("ingredient_name"))


def _exposures(d: Domain):
    meals = d.meals.select("user_id", "meal_log_id", "recipe_id", "food_name", "logged_at", "portion_size")
    return jobs.stream_exposures(_as_stream(d, meals, "meals", order="logged_at"), _names(d))


@query("stream_exposures", sql(f"""
    SELECT user_id, meal_log_id, coalesce(recipe_id, -1) AS recipe_id, ingredient_name, normalized_name, {ts('exposed_at')} AS exposed_at, {r6('w')} AS portion_weight FROM exposures""", "exposures"))
def stream_exposures(d: Domain):
    out = jobs.run_once(_exposures(d), "exposures")
    return d.spark.read.parquet(out).withColumn("recipe_id", F.coalesce("recipe_id", F.lit(-1)))


def _attributed(d: Domain):
    reports = d.reports.select("report_id", "user_id", "reported_at", "severity", "no_symptoms")
    exposures = d.exposures.select("user_id", "normalized_name", "exposed_at", "portion_weight")
    return jobs.stream_attribution(_as_stream(d, reports, "reports", order="reported_at"), _as_stream(d, exposures, "exposed", order="exposed_at"))


@query("stream_attribution", sql(f"""
    SELECT report_id, user_id, normalized_name, {r6('weight')} AS weight FROM pairs_""", "reports", "exposures", pairs_=_PAIRS))
def stream_attribution(d: Domain):
    return d.spark.read.parquet(jobs.run_once(_attributed(d), "attribution")).select("report_id", "user_id", "normalized_name", "weight")


@query("stream_risk_state", sql(f"""
    SELECT user_id, normalized_name, exposures AS exposure_count, {r6('positive')} AS positive_evidence, {r6('negative')} AS negative_evidence, round(risk, 4) + 0.0 AS risk_score, round(conf, 4) + 0.0 AS confidence, {status('risk', 'conf')} AS status
    FROM (SELECT *, least(1.0, (positive + 0.75) / (positive + negative + 3)) AS risk, least(1.0, (positive + negative) / 6) AS conf FROM e)""", "reports", "exposures", pairs_=_PAIRS, e=_EVIDENCE))
def stream_risk_state(d: Domain):
    root = scratch_path(d.spark, "risk-deltas")
    jobs.run_once(_attributed(d), "risk", each=jobs.risk_batches(root, every=2))
    return jobs.current_risks(d.spark, root)


@query("stream_checkin_ewma", sql(GRADES, *GRADE_DEPS, **GRADE_CTES))
def stream_checkin_ewma(d: Domain):
    """Final grades after all batches."""
    rows = ck.checkin_evidence(d.checkins, d.ingredient_catalog).select(
        "user_id", "ingredient_name", "checkin_id", "created_at", "severity", "freq", "evidence")
    root = scratch_path(d.spark, "grades")
    each = lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/batch={i}")
    stream = _as_stream(d, rows, "evidence", order="created_at", last=grades.closing_mark(rows))
    jobs.run_once(grades.stream_checkin_ewma(stream), "ewma", "update", each, **grades.ON_DISK)
    return grades.newest_grades(d.spark.read.schema(grades.OUT).parquet(root)).drop("late")


@query("stream_trending", sql(f"""
    SELECT {ts('s')} AS start, {ts('s + INTERVAL 7 DAY')} AS "end", recipe_id, count(*) AS cnt FROM (SELECT unnest(range(date_trunc('day', created_at) - INTERVAL 6 DAY, date_trunc('day', created_at) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS s, recipe_id
        FROM app_log WHERE interaction_type IN ('liked', 'saved', 'started', 'completed')) GROUP BY ALL
    HAVING s + INTERVAL 7 DAY <= (SELECT max(created_at) - INTERVAL 2 DAY FROM app_log WHERE interaction_type IN ('liked', 'saved', 'started', 'completed'))""", "app_log"))
def stream_trending(d: Domain):
    log = _as_stream(d, d.app_log, "log", order="created_at")
    return d.spark.read.parquet(jobs.run_once(jobs.stream_trending(log), "trending"))


@query("stream_user_vector", sql(f"""
    SELECT user_id, i::BIGINT - 1 AS dim, {r6('sum(w * vec[i])')} AS num, {r6('sum(w)')} AS den FROM (SELECT user_id, recipe_id, CASE interaction_type WHEN 'viewed' THEN 1.5 WHEN 'liked' THEN 4.5 WHEN 'saved' THEN 5 WHEN 'started' THEN 3.5 ELSE 1 END AS w
        FROM app_log WHERE created_at > TIMESTAMP '{TRAINED_AT}') a JOIN item_factors f ON f.recipe_id = a.recipe_id, (SELECT unnest(range(1, 65)) AS i) t GROUP BY ALL""", "app_log", "item_factors"))
def stream_user_vector(d: Domain):
    root = scratch_path(d.spark, "vectors")
    each = lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/batch={i}")
    log = _as_stream(d, d.app_log, "log", order="created_at")
    jobs.run_once(jobs.stream_user_vector(log, d.item_factors, TRAINED_AT), "vector", "update", each)
    last = d.spark.read.parquet(root)
    return last.groupBy("user_id", "dim").agg(F.max_by(F.struct("num", "den"), "batch").alias("x")).select("user_id", "dim", "x.num", "x.den")


@query("stream_care_state", sql(f"""
    SELECT user_id, {day('planted')} AS planted, {day('last')} AS last_care, {day('last + 7')} AS died, coalesce(level, 0)::BIGINT AS level, coalesce(streak, 0)::BIGINT AS streak, coalesce(best, 0)::BIGINT AS best_streak
    FROM (SELECT user_id, run_no, min(d) AS planted, max(d) AS last FROM placed GROUP BY ALL) LEFT JOIN (
        SELECT user_id, run_no, sum(n) AS level, max(n) AS best, arg_max(n, stop) AS streak FROM (SELECT user_id, run_no, count(*) AS n, max(d) AS stop FROM (
            SELECT user_id, run_no, d, d - (row_number() OVER (PARTITION BY user_id, run_no ORDER BY d))::INT AS isle FROM placed WHERE both_) GROUP BY user_id, run_no, isle) GROUP BY ALL) USING (user_id, run_no)""",
    *_CARE_DEPS, care=_CARE, sparse=_SPARSE, placed=_PLACED))
def stream_care_state(d: Domain):
    """All runs of care, the later part of the month moved on by eight days so that runs end in between; a last row without
    user closes those that are open at the end."""
    rows = [df.select("user_id", F.from_utc_timestamp(F.col(c), _TZ).alias("at"), F.lit(kind).alias("care_type"))
            for df, c, kind in ((d.meals, "logged_at", "water"), (d.reports, "reported_at", "compost"), (d.checkins, "created_at", "compost"))]
    late = F.dayofmonth("at") >= F.length("user_id") + 8
    care = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("at", F.when(late, F.col("at") + F.expr("interval 8 days")).otherwise(F.col("at")))
    end = care.agg((F.max("at") + F.expr("interval 30 days")).alias("at")).select(F.lit(None).cast("string").alias("user_id"), "at", F.lit("end").alias("care_type"))
    stream = _as_stream(d, care, "care-events", order="at", last=end)
    return d.spark.read.parquet(jobs.run_once(jobs.stream_care_state(stream), "care"))


@query("stream_reward_dedup", sql("""
    SELECT DISTINCT user_id, k::VARCHAR || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS event_key FROM ev""", "ev"))
def stream_reward_dedup(d: Domain):
    key = F.concat_ws(":", F.col("k").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))
    rows = d.events.select("user_id", key.alias("event_key"), F.col("ts").alias("at"))
    twice = _as_stream(d, rows.unionByName(rows), "rewards", order="at")
    return d.spark.read.parquet(jobs.run_once(jobs.stream_reward_dedup(twice), "dedup")).select("user_id", "event_key")


@query("stream_refresh_coalesce", sql("""
    SELECT user_id, count(*) AS n_liked FROM app_log WHERE interaction_type = 'liked' AND user_id IN (SELECT user_id FROM app_log WHERE interaction_type = 'viewed') GROUP BY 1""", "app_log"))
def stream_refresh_coalesce(d: Domain):
    """Views ask for a refresh; each batch scores its users once (here: counts their liked recipes)."""
    score = lambda users: d.app_log.where("interaction_type = 'liked'").join(users, "user_id", "left_semi").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_liked"))
    asks = _as_stream(d, d.app_log.where("interaction_type = 'viewed'").select("user_id", "created_at"), "asks", order="created_at")
    root = scratch_path(d.spark, "refresh")
    jobs.run_once(asks, "refresh", each=jobs.refresh_batches(root, score))
    return d.spark.read.parquet(root).drop("batch").distinct()
