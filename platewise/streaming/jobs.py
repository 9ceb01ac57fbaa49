"""Structured Streaming jobs.

Each job is a plan from streams to a stream; `run_once` drives one over the available data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import numbers as num, text as tx
from ..operators.exposure import risk_columns
from ..session import scratch_path

LATE = "2 days"


def file_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_once(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None,
             marks: str | None = None, **conf: str) -> str:
    """Process what is there, then stop; returns the folder of the results.  `conf` holds for this stream only; with
    the `marks` of an earlier run it goes on from there."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, f"{name}-out"), marks or scratch_path(spark, f"{name}-marks")
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
        query = writer.format("parquet").option("path", out).start() if each is None else writer.foreachBatch(each).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return out


def stream_exposures(meals: DataFrame, names: DataFrame) -> DataFrame:
    """Meal events become exposure rows at once.  `names`: recipe_id, ingredient_name (static)."""
    listed = names.withColumn("normalized_name", tx.normalize_ingredient(F.col("ingredient_name")))
    joined = meals.join(listed, "recipe_id", "left")
    plain = F.col("recipe_id").isNull()
    return joined.select(
        "user_id", "meal_log_id", "recipe_id",
        F.when(plain, F.col("food_name")).otherwise(F.col("ingredient_name")).alias("ingredient_name"),
        F.when(plain, tx.normalize_ingredient(F.col("food_name"))).otherwise(F.col("normalized_name")).alias("normalized_name"),
        F.col("logged_at").alias("exposed_at"), num.falsy_to(F.col("portion_size"), 1.0).alias("portion_weight")).where("normalized_name != ''")


def stream_attribution(reports: DataFrame, exposures: DataFrame, hours: int = vocab.WINDOW_HOURS,
                       tau: float = vocab.DECAY_HOURS, late: str = LATE) -> DataFrame:
    """Reports joined to the exposures of their prior window; both sides are bounded by watermarks, so
    state is dropped once no match is possible.  Meals that arrive after that stay unattributed."""
    r = reports.withWatermark("reported_at", late).select("report_id", F.col("user_id").alias("ru"), "reported_at", "severity", "no_symptoms")
    e = exposures.withWatermark("exposed_at", late)
    return r.join(e, F.expr(f"ru = user_id AND exposed_at >= reported_at - interval {hours} hours AND exposed_at <= reported_at")).select(
        "report_id", "user_id", "normalized_name", "reported_at", "severity", "no_symptoms",
        (num.decay_weight(F.col("exposed_at"), F.col("reported_at"), tau, hours) * num.falsy_to(F.col("portion_weight"), 1.0)).alias("weight"))


def evidence_of(attributed: DataFrame) -> DataFrame:
    """Evidence of one batch of attributed rows."""
    good = F.coalesce("no_symptoms", F.lit(False)) | (F.col("severity") <= vocab.POSITIVE_SEVERITY)
    w, s = F.col("weight"), F.col("severity")
    return attributed.where("weight > 0").groupBy("user_id", "normalized_name").agg(
        F.count(F.lit(1)).alias("exposures"), F.sum(F.when(good, 0.0).otherwise(w * s)).alias("positive"),
        F.sum(F.when(good, w * F.greatest(F.lit(0.1), 1 - s)).otherwise(0.0)).alias("negative"))


def risk_batches(root: str, every: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: evidence deltas, one folder per batch, folded into a base after every `every` batches.

    A batch that runs again replaces its own delta.  A base is named by the last batch in it and counts once its
    writer has committed it; it is made of the base before it and the deltas in between, so an interrupted
    folding is done again from the same parts, and nothing is lost or added twice.  What the last base but one holds is
    removed: readers may still be at work on the last.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        evidence_of(batch).write.mode("overwrite").parquet(f"{root}/deltas/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            fold_risks(batch.sparkSession, root, batch_id)
    return write


def _folders(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the committed folders `root/name=...`."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _remove(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def risk_parts(spark: SparkSession, root: str, upto: int | None = None) -> tuple[DataFrame, int, list[int]]:
    """Evidence sums of the base and the deltas after it, the base's last batch (-1 without one), and those deltas.
    With `upto` as of that batch, from a base before it."""
    bases = [b for b in _folders(spark, f"{root}/base", "upto") if upto is None or b < upto]
    last = bases[-1] if bases else -1
    open_ = [b for b in _folders(spark, f"{root}/deltas", "batch") if b > last and (upto is None or b <= upto)]
    paths = ([f"{root}/base/upto={last}"] if bases else []) + [f"{root}/deltas/batch={b}" for b in open_]
    kind = "user_id string, normalized_name string, exposures long, positive double, negative double"
    rows = spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
    return rows.groupBy("user_id", "normalized_name").agg(*[F.sum(c).alias(c) for c in ("exposures", "positive", "negative")]), last, open_


def fold_risks(spark: SparkSession, root: str, upto: int) -> None:
    sums, last, _ = risk_parts(spark, root, upto)
    sums.write.mode("overwrite").parquet(f"{root}/base/upto={upto}")
    for b in _folders(spark, f"{root}/deltas", "batch"):
        if b <= last:
            _remove(spark, f"{root}/deltas/batch={b}")
    for b in _folders(spark, f"{root}/base", "upto"):
        if b < last:
            _remove(spark, f"{root}/base/upto={b}")


def current_risks(spark: SparkSession, root: str) -> DataFrame:
    """Base plus open deltas with score, confidence and status: one row per key and fewer than `every` deltas are read."""
    sums = risk_parts(spark, root)[0].select("user_id", "normalized_name", F.col("exposures").alias("exposure_count"),
                                             F.col("positive").alias("positive_evidence"), F.col("negative").alias("negative_evidence"))
    risk, conf = risk_columns(F.col("positive_evidence"), F.col("negative_evidence"))
    return sums.select("*", F.round(risk, 4).alias("risk_score"), F.round(conf, 4).alias("confidence"), num.status_ladder(risk, conf).alias("status"))


def stream_trending(interactions: DataFrame, days: int = vocab.TRENDING_DAYS, late: str = LATE) -> DataFrame:
    """Positive interactions per recipe in windows of `days` that slide by a day."""
    return (interactions.where(F.col("interaction_type").isin(*vocab.POSITIVE_TYPES)).withWatermark("created_at", late)
            .groupBy(F.window("created_at", f"{days} days", "1 day"), "recipe_id").agg(F.count(F.lit(1)).alias("cnt"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "recipe_id", "cnt"))


def stream_user_vector(interactions: DataFrame, item_factors: DataFrame, trained_at: str) -> DataFrame:
    """Running weighted sums per (user, dimension) of everything after the training boundary."""
    weights = F.create_map(*[F.lit(x) for kv in vocab.INTERACTION_WEIGHTS.items() for x in kv])
    fresh = interactions.where(F.col("created_at") > F.lit(trained_at).cast("timestamp")).withColumn(
        "w", F.coalesce(F.try_element_at(weights, F.col("interaction_type")), F.lit(vocab.UNKNOWN_INTERACTION_WEIGHT))).where("w > 0")
    rows = fresh.join(item_factors.select("recipe_id", "vec"), "recipe_id").select("user_id", "w", F.posexplode("vec").alias("dim", "v"))
    return rows.groupBy("user_id", "dim").agg(F.sum(F.col("w") * F.col("v")).alias("num"), F.sum("w").alias("den"))


def stream_care_state(care: DataFrame, late: str = "7 days", gap: int = vocab.DEATH_DAYS) -> DataFrame:
    """Runs of care (user_id, at, care_type), each once it has ended: planted, last_care, died, level, streak, best_streak.

    A run is a session of days of care with fewer than `gap` days from one to the next; care that comes late joins the
    sessions it lies between.  A session is closed when the watermark has passed its last day by `gap` days.  Level is
    the number of days with both kinds of care, streaks are runs of such days, `streak` the last of them.
    """
    days = care.withColumn("_day", F.date_trunc("day", "at")).withWatermark("_day", late)
    kind = lambda k: F.collect_set(F.when(F.col("care_type") == k, F.to_date("_day")))
    # A second less than the gap: the day that would be the gap's last begins a session of its own.
    runs = days.groupBy("user_id", F.session_window("_day", f"{gap * 86_400 - 1} seconds").alias("_w")).agg(
        F.min("_day").alias("planted"), F.max("_day").alias("last_care"), F.max("user_id").alias("_who"), kind("water").alias("_wet"), kind("compost").alias("_fed"))
    grown = F.array_sort(F.array_intersect("_wet", "_fed"))
    start = F.struct(F.lit(None).cast("date").alias("day"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def longer(state, day):
        n = F.when(F.datediff(day, state["day"]) == 1, state["n"] + 1).otherwise(F.lit(1))
        return F.struct(day.alias("day"), n.alias("n"), F.greatest(state["best"], n).alias("best"))

    # On the aggregate: a filter on the key would go below the watermark, which rows without user may move.
    return runs.where("_who is not null").withColumn("_grown", grown).withColumn("_s", F.aggregate("_grown", start, longer)).select(
        "user_id", F.to_date("planted").alias("planted"), F.to_date("last_care").alias("last_care"), F.date_add(F.to_date("last_care"), gap).alias("died"),
        F.size("_grown").cast("long").alias("level"), F.col("_s.n").cast("long").alias("streak"), F.col("_s.best").cast("long").alias("best_streak"))


def stream_reward_dedup(events: DataFrame, late: str = LATE) -> DataFrame:
    """The first of each (user, event key); repeats within the watermark are ignored."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["user_id", "event_key"])


def refresh_batches(root: str, score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: all refresh requests of a batch become one scoring run over its users."""
    def write(batch: DataFrame, batch_id: int) -> None:
        users = batch.select("user_id").distinct()
        score(users).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return write
