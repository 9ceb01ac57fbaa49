"""Sliding time windows per key, linear in the rows and split by time.

A window of length W that ends (or starts) at t covers the tail of one W-wide
time bucket and the head of the next.  Events and probes are laid out once by
(keys, bucket); running aggregates from both ends of every bucket answer each
probe, and the two halves are combined by the same aggregate.  No event-probe
pairs are produced, and a busy key is spread over its time buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

MICROS_PER_HOUR = 3_600_000_000


def _combine(kind: str, c: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](c)


def window_aggregate(
    probes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    probe_id: str,
    probe_time: str,
    event_time: str,
    hours: float,
    aggs: dict[str, tuple[str, Column]],
    direction: str = "back",
    include_probe_time: bool = True,
) -> DataFrame:
    """Aggregate events in [t-hours, t] ("back") or [t, t+hours] ("ahead") for every probe.

    `aggs` maps an output name to ("sum" | "max" | "min", event expression).  The far end
    is inclusive; `include_probe_time=False` leaves out events at exactly t.  Probes without
    events get nulls.  Output: probe_id and the aggregates.
    """
    width = int(hours * MICROS_PER_HOUR)
    sign = -1 if direction == "back" else 1
    values = [expr.alias(f"_v{i}") for i, (_, expr) in enumerate(aggs.values())]
    kinds = [kind for kind, _ in aggs.values()]
    # Mirror time for windows that look ahead, so that one layout serves both.
    clock = lambda c: F.unix_micros(F.col(c)) * (-sign)

    ev = events.where(F.col(event_time).isNotNull()).select(
        *keys, clock(event_time).alias("_t"), F.lit(None).cast("string").alias("_pid"),
        F.lit(1).alias("_side"), *values)
    empty = [F.lit(None).cast(ev.schema[f"_v{i}"].dataType).alias(f"_v{i}") for i in range(len(kinds))]
    base = probes.where(F.col(probe_time).isNotNull())
    ends = F.array(
        F.struct(clock(probe_time).alias("_t"), F.lit(0 if not include_probe_time else 2).alias("_side")),
        F.struct((clock(probe_time) - width).alias("_t"), F.lit(3).alias("_side")))
    pr = (base.select(*keys, F.col(probe_id).cast("string").alias("_pid"), F.explode(ends).alias("_e"))
          .select(*keys, F.col("_e._t").alias("_t"), "_pid", F.col("_e._side").alias("_side"), *empty))
    # _side orders rows of one instant: 0 end probe without its instant, 1 event,
    # 2 end probe with its instant.  3 start probe: it sees events at its own instant
    # because the reverse pass reads 1 before 3.
    rows = ev.unionByName(pr).withColumn("_b", F.floor(F.col("_t") / width))
    part = [*keys, "_b"]
    head = W.partitionBy(*part).orderBy(F.col("_t"), F.col("_side")).rowsBetween(W.unboundedPreceding, 0)
    tail = (W.partitionBy(*part).orderBy(F.col("_t").desc(), F.col("_side"))
            .rowsBetween(W.unboundedPreceding, 0))
    run = rows
    for i, kind in enumerate(kinds):
        run = run.withColumn(f"_h{i}", _combine(kind, F.col(f"_v{i}")).over(head))
    for i, kind in enumerate(kinds):
        run = run.withColumn(f"_r{i}", _combine(kind, F.col(f"_v{i}")).over(tail))
    halves = run.where(F.col("_side") != 1).select(
        "_pid", *[F.when(F.col("_side") == 3, F.col(f"_r{i}")).otherwise(F.col(f"_h{i}")).alias(f"_x{i}")
                  for i in range(len(kinds))])
    return halves.groupBy(F.col("_pid").alias(probe_id)).agg(
        *[_combine(kind, F.col(f"_x{i}")).alias(name)
          for i, (name, kind) in enumerate(zip(aggs, kinds))])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], grain: Column, out: str) -> DataFrame:
    """row_number() per key in two levels, so that a busy key is sorted grain by grain.

    `grain` must not decrease along `order`.
    """
    parted = df.withColumn("_g", grain)
    sizes = parted.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = W.partitionBy(*keys, "_g").orderBy(*order)
    return (parted.withColumn("_rn", F.row_number().over(within))
            .join(offsets, [*keys, "_g"])  # one offset row per key and grain
            .withColumn(out, F.col("_rn") + F.col("_off"))
            .drop("_g", "_rn", "_off", "_n"))
