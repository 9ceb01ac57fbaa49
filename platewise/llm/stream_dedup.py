"""Exact dedup by a keyed state that streams of documents run through.

The state holds one row per digest of a normalised text: how many rows had it, and the stable identifier and place of
the row that stays.  It never expires, lies in RocksDB on the executors' disks and is saved to the checkpoint folder
with every batch, so a lost executor loses nothing and a later run goes on with the same folder.
Texts are not kept; each digest that came more than once has its rows' full bytes compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import LOWER, UPPER, shared, text_or_empty

#: Bytes of input that one batch takes at most (one file at least).
BATCH = 64 << 30
#: Groups beyond this many rows, and beyond this share of all rows, are spread over several tasks.
LARGE, SHARE = 1000, 1000
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Files grow as they are written: a store would else take some 4 MB at once, however few rows it has.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor share one bounded cache.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is.  In ASCII texts `lower` does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def located(files: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, norm, sha, file, row of Parquet files read as a table or as a stream.  Null texts are empty."""
    place = files.metadataColumn("_metadata")
    norm = files.select(files[doc_id].alias("doc_id"), normalised(F.coalesce(files[text].cast("string"), F.lit(""))).alias("norm"),
                        place["file_path"].alias("file"), place["row_index"].alias("row"))
    return norm.select("doc_id", "norm", F.sha2("norm", 256).alias("sha"), "file", "row")


def digest_by(key: Callable[[Column], Column]) -> Column:
    """The state's key, never null: joins on it then need no filter, which would work it out a second time."""
    return F.coalesce(key(F.col("sha")), F.lit(b"")).alias("digest")


def remember(rows: DataFrame, marks: str, key: Callable[[Column], Column] = F.unhex) -> None:
    """Runs the rows of a stream into the state below `marks`, until none are left.

    Each task adds up its rows of a digest before they go to the state, however many there are.
    """
    kept = F.max(F.struct("doc_id", "file", "row")).alias("kept")
    state = rows.groupBy(digest_by(key)).agg(kept, F.count(F.lit(1)).alias("size"))
    with _settings(rows.sparkSession, _STATE):
        query = (state.writeStream.outputMode("update").format("noop").option("checkpointLocation", marks)
                 .trigger(availableNow=True).start())
        query.awaitTermination()


def remembered(spark: SparkSession, marks: str) -> DataFrame:
    """The state as a table: digest, doc_id, file, row, size."""
    with _settings(spark, _STATE):
        state = spark.read.format("statestore").load(marks)
        digest, (kept, size) = state.schema["key"].dataType.names[0], state.schema["value"].dataType.names
        return state.select(F.col("key")[digest].alias("digest"), F.col("value")[kept].alias("kept"), F.col("value")[size].alias("size")).select(
            "digest", "kept.*", "size")


def collided(rows: DataFrame, key: Callable[[Column], Column] = F.unhex) -> DataFrame:
    """Digests whose rows do not all have the same bytes.  Tasks compare what they hold before anything moves, so
    a digest comes to the next stage once per task."""
    return (rows.groupBy(digest_by(key)).agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
            .where("least <> most").select("digest"))


def resolve(rows: DataFrame, memory: DataFrame, key: Callable[[Column], Column] = F.unhex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, by the state.

    Digests of more than 1/SHARE of all rows, fewer than SHARE of them, are known to all tasks; their rows are
    dealt out over several.  Rows of digests that stand for several texts are grouped by the texts themselves.
    """
    total = memory.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    most = max(LARGE, total // SHARE)
    known = memory.select("digest", F.struct("doc_id", "file", "row").alias("keep"), F.col("size").alias("group_size"),
                          F.ceil(F.col("size") / most).cast("int").alias("shares"))
    large = known.where("shares > 1").select(F.col("digest").alias("of"), F.col("shares").alias("n"))
    dealt = known.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    slim = rows.select("doc_id", "file", "row", "sha", digest_by(key))
    share = F.coalesce(F.pmod(F.xxhash64("file", "row"), F.col("n")).cast("int"), F.lit(0))
    met = (slim.join(F.broadcast(large), F.col("digest") == F.col("of"), "left").withColumn("share", share).drop("of", "n")
           .join(dealt, ["digest", "share"]).drop("share"))
    clash = shared(collided(rows, key), "dedup-collided")
    if clash.first() is not None:
        texts = rows.select("doc_id", "file", "row", "sha", digest_by(key), "norm").join(clash, "digest", "left_semi")
        by_text = texts.groupBy("norm").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        met = met.join(clash, "digest", "left_anti").unionByName(texts.join(by_text, "norm").drop("norm"))
    place = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    return met.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", place.alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", marks: str | None = None,
                key: Callable[[Column], Column] = F.unhex, batch: int = BATCH) -> DataFrame:
    """One row per row of the Parquet files in `path`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  The row with the largest doc_id stays; of several with that
    doc_id the one that lies last (file, then row); a null doc_id is smaller than any other.  Null texts are empty, and
    empty texts are equal.  Repeated rows are rows of their own.  An empty table gives no rows; other columns
    are not read.  `key` makes the state's key of the SHA-256; texts that share a key are told apart by their bytes.
    With the `marks` of an earlier run only files that are new go through the state.
    """
    table = spark.read.parquet(path)
    path = path.rstrip("/")
    # A stream takes a plain path for a folder; a pattern may also name a single file.
    stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", batch).parquet(f"{path[:-1]}[{path[-1]}]")
    marks = marks or scratch_path(spark, "dedup-state")
    remember(located(stream, doc_id, text), marks, key)
    return resolve(located(table, doc_id, text), remembered(spark, marks), key)
