"""Merges and writers: generations, upserts, versioned factors."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..functions.text import generation_name


def replace_generation(current: DataFrame, new: DataFrame, users: DataFrame, model_name: str) -> DataFrame:
    """Replace exactly the rows of the given users and model; an empty new set still clears them.

    A blank model name and rows of another model are errors.  Repeated (user, recipe) rows keep the
    best score.
    """
    if not str(model_name).strip():
        raise ValueError("model_name is required")
    stray = new.where(F.coalesce(F.col("model_name"), F.lit("")) != model_name).limit(1).count()
    if stray:
        raise ValueError("every new row must carry the model name being replaced")
    gone = users.select("user_id").distinct().withColumn("model_name", F.lit(model_name))
    kept = current.join(gone, ["user_id", "model_name"], "left_anti")
    one = new.groupBy("user_id", "recipe_id", "model_name").agg(F.max("preference_score").alias("preference_score"))
    cols = ["user_id", "recipe_id", "preference_score", "model_name"]
    return kept.select(*cols).unionByName(one.select(*cols))


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """Updates win over current rows; among updates of one key the last by `order_col` wins."""
    cols = current.columns
    rest = [c for c in cols if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("_u"))
    new = last.select(*keys, *[F.col(f"_u.{c}").alias(c) for c in rest])
    return current.join(new.select(*keys), list(keys), "left_anti").select(*cols).unionByName(new.select(*cols))


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _folder(spark, path)
    return files.exists(where)


#: Column and folders of the buckets, and how many a table with keys has if nothing else is said.
_BUCKET, BUCKETS = "bucket__", 64


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


def _pointer(spark: SparkSession, root: str, version: int | None = None) -> Row | None:
    """The row that names the parts of the newest version, or of a given one."""
    if not _exists(spark, f"{root}/versions"):
        return None
    rows = spark.read.parquet(f"{root}/versions")
    rows = rows if version is None else rows.where(F.col("version") == version)
    return rows.agg(F.max_by(F.struct("version", "columns", "keys", "buckets", "parts"), "version").alias("p")).first()["p"]


def _read_parts(spark: SparkSession, root: str, at: Row, only: set[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets: no other folder is listed or read."""
    schema = T.StructType.fromJson(json.loads(at["columns"]))
    paths = [f"{root}/data/{run}/{_BUCKET}={b}" for b, run in sorted(at["parts"].items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest complete version of a table written by `write_table`, or an earlier one."""
    at = _pointer(spark, root, version)
    if at is None:
        raise ValueError(f"no such version of {root}")
    return _read_parts(spark, root, at)


def _publish(df: DataFrame, root: str, keys: Sequence[str], buckets: int, last: Row | None, touched: set[int] | None) -> None:
    """Writes rows into a folder of their own by buckets; the new version has them in place of the touched buckets (None:
    of all) and shares the others with the version before."""
    spark = df.sparkSession
    version = last["version"] + 1 if last else 1
    run = f"{version:09d}-{os.urandom(4).hex()}"
    # The rebalance keeps a bucket in few files and cuts a large one over several tasks.
    df.withColumn(_BUCKET, _bucket(keys, buckets)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{root}/data/{run}")
    files, where = _folder(spark, f"{root}/data/{run}")
    names = [f.getPath().getName() for f in files.listStatus(where)]
    parts = {b: r for b, r in last["parts"].items() if b not in touched} if last and touched is not None else {}
    parts.update({int(n.split("=")[1]): run for n in names if n.startswith(f"{_BUCKET}=")})
    row = (version, df.schema.json(), list(keys), buckets, parts)
    spark.createDataFrame([row], "version long, columns string, keys array<string>, buckets int, parts map<int,string>").coalesce(1).write.mode(
        "append").parquet(f"{root}/versions")


def write_table(df: DataFrame, root: str, keys: Sequence[str] = (), buckets: int = BUCKETS) -> None:
    """Writes a whole table, by buckets of `keys` if there are any, then appends the pointer that makes it current.

    Readers see the old version until the pointer is there, so a lost writer leaves nothing behind that is read, and
    `df` may be derived from the version it replaces.  One writer at a time.
    """
    _publish(df, root, keys, buckets if keys else 1, _pointer(df.sparkSession, root), None)


def _touched(rows: DataFrame, at: Row) -> set[int]:
    """Buckets that rows fall into: at most as many numbers as the table has buckets."""
    return {r[0] for r in rows.select(_bucket(at["keys"], at["buckets"])).distinct().collect()}


def upsert_table(spark: SparkSession, root: str, updates: DataFrame, keys: Sequence[str], order_col: str, buckets: int = BUCKETS) -> None:
    """Reads and writes the buckets that the updates fall into; the others are shared with the version before.

    A table that was not written by these keys is written anew by them once.
    """
    at = _pointer(spark, root)
    if list(at["keys"]) != list(keys):
        return _publish(upsert(_read_parts(spark, root, at), updates, keys, order_col), root, keys, buckets, at, None)
    touched = _touched(updates, at)
    if touched:
        _publish(upsert(_read_parts(spark, root, at, touched), updates, keys, order_col), root, keys, at["buckets"], at, touched)


def replace_generation_table(spark: SparkSession, root: str, new: DataFrame, users: DataFrame, model_name: str, buckets: int = BUCKETS) -> None:
    """The same for whole generations, by buckets of user_id."""
    at = _pointer(spark, root)
    if list(at["keys"]) != ["user_id"]:
        return _publish(replace_generation(_read_parts(spark, root, at), new, users, model_name), root, ["user_id"], buckets, at, None)
    touched = _touched(users.select("user_id").unionByName(new.select("user_id")), at)
    rows = replace_generation(_read_parts(spark, root, at, touched), new, users, model_name)
    if touched:
        _publish(rows, root, ["user_id"], at["buckets"], at, touched)


def publish_factors(spark: SparkSession, root: str, base_name: str, trained_at: str, item_factors: DataFrame,
                    user_factors: DataFrame, meta: DataFrame) -> str:
    """Write the factors below their generation name, check them, then append the pointer row.

    Readers follow the newest pointer, so they keep the old generation until the last step, and a
    failed write is never seen.
    """
    if not base_name.strip() or not any(ch.isalnum() for ch in trained_at):
        raise ValueError("a base name and a training time are required")
    name = spark.range(1).select(generation_name(F.lit(base_name), F.lit(trained_at))).first()[0]
    folder = f"{root}/model={name}"
    parts = {"item_factors": item_factors, "user_factors": user_factors, "meta": meta}
    for part, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{part}")
    from ..operators.preference import validate_artifact

    report = validate_artifact(*[spark.read.parquet(f"{folder}/{p}") for p in parts])
    broken = [r["check"] for r in report.where("not ok").collect()]
    if broken:
        raise ValueError(f"factors of {name} fail {broken}")
    spark.range(1).select(F.lit(name).alias("model_name"), F.lit(trained_at).alias("trained_at"),
                          F.current_timestamp().alias("published_at")).write.mode("append").parquet(f"{root}/published")
    return name


def current_factors(spark: SparkSession, root: str) -> tuple[str, dict[str, DataFrame]]:
    name = spark.read.parquet(f"{root}/published").agg(F.max_by("model_name", "published_at")).first()[0]
    return name, {p: spark.read.parquet(f"{root}/model={name}/{p}") for p in ("item_factors", "user_factors", "meta")}
