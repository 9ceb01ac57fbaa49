"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, numbered_by_range, ranged, shared, text_or_empty

WEIGHTS = (5, 2, 1)
#: Documents of like size among which the draws of a source are balanced.
STRATUM = 4


def word_count(column: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_sizes(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row per source (null is a source of its own): source, source_size."""
    return sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))


def weighted(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Weights dealt in turn to the sources by code point, null last."""
    at = numbered_by_range(sizes, [F.col("source").asc_nulls_last()], "__place", "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return at.withColumn("weight", F.element_at(cycle, (F.col("__place") % len(weights) + 1).cast("int"))).drop("__place")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `target`: a share of all sizes dealt by weight; targets stop at `most` times the source's size and the
    excess goes to the others by weight until none is above.

    Each round adds up one row per source where the data lie and returns two numbers; a source once at its
    limit stays there, so the rounds end, and usually after a few.
    """
    limit = F.col("source_size") * F.lit(float(most))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        row = sizes.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("used"),
                        F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if not row["open"]:
            break
        rise = (share * total - row["used"]) / row["open"]
        if rise <= level:
            break
        level = rise
    return sizes.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS,
        share: float = 1.5, most: float = 2.0, seed: str = "mix", stratum: int = STRATUM) -> DataFrame:
    """Copies per document: doc_id, size, source_size, target, copies, taken.

    The repetition rate of a source is its target by its size.  A document comes floor(rate) times, and once
    more by a Bernoulli draw from its own hash (of seed and doc_id) whose probability is the fraction f.  The draws are
    stratified: the documents of a source are dealt by falling size into strata of `stratum`, and in a stratum a draw is the rank
    of the document's hash among the others' against f, so that n documents of like size get n f copies to within one.
    Strata go on where the one before ended, from a start hashed from the source; ranks of hashes are
    even, so the probability stays f for every document.  Unstratified draws would miss the target by the root of their number.
    All draws are hashes, so reruns agree.

    Empty and null texts have size 0 and take 0 words; a source without words has rate 0.  A null source is a
    source.  Rows with a null or repeated doc_id are documents of their own.  An empty table gives no rows.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    placed = ranged(sized.withColumn("__hash", digest(F.col("doc_id"), seed)), _order("source"), "mix-sized")
    sources = shared(targets(weighted(source_sizes(placed), weights), share, most), "mix-targets")
    start = digest(F.col("source"), seed)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = sources.select(F.col("source").alias("__source"), "source_size", "target", rate.alias("__rate"),
                           (F.conv(F.substring(start, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))).alias("__start"))
    return (_turns(_place(placed), stratum).join(rated, F.col("source").eqNullSafe(F.col("__source")))
            .withColumn("__part", F.col("__rate") - F.floor("__rate"))
            .withColumn("copies", F.floor("__rate") + F.floor(F.col("__start") + (F.col("__turn") + 1) * F.col("__part"))
                        - F.floor(F.col("__start") + F.col("__turn") * F.col("__part")))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def _order(source: str) -> list[Column]:
    return [F.col(source).asc_nulls_last(), F.col("size").desc(), F.col("__hash")]


def _place(placed: DataFrame) -> DataFrame:
    """Adds `__place`: 0, 1, ... inside each source, counted inside its ranges and over one row per range."""
    counts = placed.groupBy("source", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("__of"), F.col("__range").alias("__in"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("__range", "source").orderBy(*_order("source")[1:])) - 1
    return (placed.withColumn("__at", within)
            .join(offsets, (F.col("__range") == F.col("__in")) & F.col("source").eqNullSafe(F.col("__of")))
            .withColumn("__place", F.col("__at") + F.col("__before")))


def _turns(placed: DataFrame, stratum: int) -> DataFrame:
    """Adds `__turn`: the places of each stratum dealt anew by the documents' own hashes."""
    first = F.col("__place") - F.col("__place") % stratum
    own = W.partitionBy("source", "__first").orderBy("__hash", F.col("size").desc())
    return placed.withColumn("__first", first).withColumn("__turn", F.col("__first") + F.row_number().over(own) - 1)


def digest(value: Column, seed: str) -> Column:
    """md5 of seed and value as hex: the same in SQL, and its first 13 digits are exact in a double."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit("null"))))


def emit(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS,
         share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The documents as often as the mix takes them, all columns; documents without a copy go.

    Rows of one doc_id, source and size are told apart by a number, so that repeated rows meet their own copies.
    """
    def keyed(df: DataFrame, *key: Column) -> DataFrame:
        names = [f"__k{i}" for i in range(len(key))]
        df = df.withColumns(dict(zip(names, key)))
        return df.withColumn("__k3", F.row_number().over(W.partitionBy(names[0]).orderBy(*names[1:])))

    left = keyed(docs, F.col(doc_id), F.col(source), word_count(text))
    right = keyed(mix(docs, doc_id, source, text, weights, share, most, seed).where("copies is not null"), F.col("doc_id"), F.col("source"), F.col("size"))
    right = right.select(F.col("__k0").alias("__r0"), F.col("__k3").alias("__r3"), F.col("copies").alias("__copies"))
    joined = left.join(right, F.col("__k0").eqNullSafe(F.col("__r0")) & (F.col("__k3") == F.col("__r3"))).where("__copies > 0")
    return (joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
