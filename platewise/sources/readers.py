"""Readers: raw CSV files, list columns, lookups, tables, guarded reads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

RAW_RECIPES = ("name string, recipe_id long, minutes long, contributor_id long, submitted string, tags string, "
               "nutrition string, n_steps long, steps string, description string, ingredients string, n_ingredients long")
RAW_INTERACTIONS = "user_id long, recipe_id long, date string, rating double, review string"
FODMAP_LOOKUP = "food_group string, fodmap_category string, fodmap_severity string"


def read_csv(spark: SparkSession, path: str, schema: str, breaks: bool = False) -> DataFrame:
    """CSV with a header, quoted commas and doubled quotes; large files are split over tasks.

    `breaks` allows line breaks inside quotes.  Files with such breaks cannot be split: keep them small.
    """
    return (spark.read.schema(schema).option("header", True).option("multiLine", breaks)
            .option("quote", '"').option("escape", '"').csv(path))


def read_fodmap_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The lookup is a small file whose food groups may hold line breaks."""
    return read_csv(spark, path, FODMAP_LOOKUP, breaks=True)


_ITEM = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def parse_list(c: Column) -> Column:
    """Stringified list to ARRAY<STRING>; anything else gives an empty array.

    Items may hold apostrophes inside double quotes.  Text that is no list literal is tried as JSON
    with its single quotes doubled.
    """
    whole = c.rlike(rf"^\s*\[\s*(?:(?:{_ITEM})\s*(?:,\s*(?:{_ITEM})\s*)*,?)?\s*\]\s*$")
    raw = F.regexp_extract_all(c, F.lit(f"({_ITEM})"), F.lit(1))
    plain = F.transform(raw, lambda x: F.when(
        x.rlike(r"^['\"]"), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")).otherwise(x))
    fallback = F.from_json(F.regexp_replace(c, "'", '"'), T.ArrayType(T.StringType()))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(whole, plain).otherwise(fallback), empty)


def parse_number_list(c: Column) -> Column:
    return F.transform(parse_list(c), lambda x: x.try_cast("double"))


def parse_list_columns(df: DataFrame, text_cols: Sequence[str], number_cols: Sequence[str] = ()) -> DataFrame:
    """List columns parsed in place; columns that are arrays already pass through."""
    kinds = dict(df.dtypes)
    for cols, fn in ((text_cols, parse_list), (number_cols, parse_number_list)):
        for name in cols:
            if not kinds[name].startswith("array"):
                df = df.withColumn(name, fn(F.col(name)))
    return df


def load_table(spark: SparkSession, base: str, name: str, evolved: bool = False) -> DataFrame:
    """One parquet table; local timestamps become UTC instants.  `evolved` merges the schemas of all
    files, which reads every footer."""
    df = spark.read.option("mergeSchema", evolved).parquet(f"{base}/{name}.parquet")
    for field in df.schema:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def scan_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns; columns the table does not have come as null strings."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


class RestrictionDataUnavailable(RuntimeError):
    """Restrictions could not be read; nothing may be recommended without them."""


def read_restrictions(reader: Callable[[], DataFrame], required: Sequence[str] = ("user_id", "ingredient_name")) -> DataFrame:
    """Read restrictions or stop.  A missing table or column is an error, never an empty frame."""
    try:
        df = reader()
        missing = [c for c in required if c not in df.columns]
    except Exception as exc:
        raise RestrictionDataUnavailable("restrictions could not be read") from exc
    if missing:
        raise RestrictionDataUnavailable(f"restrictions lack {missing}")
    return df


def needed_rows(recipes: DataFrame, *id_frames: DataFrame) -> DataFrame:
    """Catalog rows for the ids that occur in the given frames."""
    ids = id_frames[0].select("recipe_id")
    for df in id_frames[1:]:
        ids = ids.unionByName(df.select("recipe_id"))
    return recipes.join(ids.distinct(), "recipe_id", "left_semi")
