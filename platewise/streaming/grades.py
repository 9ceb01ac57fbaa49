"""Running grades of check-in evidence in time order, whatever order the rows arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.checkins import ewma_step

#: The state lies in RocksDB on the executors' disks; its files are not preallocated and one cache is shared.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}
OUT = "user_id string, ingredient_name string, grade double, confidence double, evidence_count long, late long"
_KEY = ["user_id", "ingredient_name"]
_ROW = ["at_us", "checkin_id", "severity", "freq", "evidence"]
#: Groups of (user, ingredient) that share a state; fixed for the life of a stream.  A state call costs milliseconds and most keys
#: have a few rows a batch, so a call takes all rows of a group.  What a group holds is written anew when it changes.
GROUPS = 512


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


class OrderedGrades(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then applies them by (time, check-in) to the grade of their user and
    ingredient.  A call serves a group of these.

    Rows that come when the watermark is past them are counted and not applied.  A group's waiting rows span the watermark's
    delay at most; a timer is set for the first of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.grades = handle.getValueState("grades", "rows binary")

    def _now(self) -> dict[tuple, tuple]:
        if not self.grades.exists():
            return {}
        columns = [c.to_pylist() for c in _unpacked(self.grades.get()[0]).columns]
        return dict(zip(zip(*columns[:2]), zip(*columns[2:])))

    def _put(self, known: dict[tuple, tuple], moved: dict[tuple, tuple]) -> Iterator[pd.DataFrame]:
        known.update(moved)
        names = [*_KEY, "grade", "confidence", "n", "late"]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        columns = zip(*((*key, *state) for key, state in known.items()))
        self.grades.update((_packed(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)),))
        yield pd.DataFrame([(*key, *state) for key, state in moved.items()], columns=[*_KEY, "grade", "confidence", "evidence_count", "late"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        late, first = [], None
        for pdf in rows:
            pdf = pdf[pdf["user_id"].notna() & pdf["ingredient_name"].notna()]
            gone = pdf["at_us"] < mark
            late.append(pdf.loc[gone, _KEY])
            fresh = pdf.loc[~gone, [*_KEY, *_ROW]]
            if len(fresh):
                self.waiting.appendValue((_packed(pa.Table.from_pandas(fresh, preserve_index=False)),))
                first = min(first, int(fresh["at_us"].min())) if first is not None else int(fresh["at_us"].min())
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        counts = pd.concat(late).value_counts() if late else ()
        if len(counts):
            known, moved = self._now(), {}
            for name, n in counts.items():
                grade, confidence, seen, before = known.get(name, (0.0, 0.0, 0, 0))
                moved[name] = (grade, confidence, seen, before + n)
            yield from self._put(known, moved)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [_unpacked(r[0]) for r in self.waiting.get()]
        if not parts:
            return
        held = pa.concat_tables(parts, promote_options="permissive").to_pandas()
        rest, ready = held[held["at_us"] >= mark], held[held["at_us"] < mark]
        if len(rest):
            if len(ready):
                self.waiting.put([(_packed(pa.Table.from_pandas(rest, preserve_index=False)),)])
            self.handle.registerTimer(int(rest["at_us"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        if len(ready):
            known, moved = self._now(), {}
            for *name, _, _, severity, freq, evidence in ready.sort_values([*_KEY, *_ROW]).itertuples(index=False, name=None):
                name = tuple(name)
                grade, confidence, n, late = moved.get(name) or known.get(name, (0.0, 0.0, 0, 0))
                moved[name] = (*ewma_step(grade, confidence, n, severity, freq, evidence), late)
            yield from self._put(known, moved)

    def close(self) -> None:
        pass


def stream_checkin_ewma(evidence: DataFrame, late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """user_id, ingredient_name, grade, confidence, evidence_count, late: a row whenever a key's grade moves or late rows
    come; the row with the largest counts is a key's newest.

    evidence: user_id, ingredient_name, checkin_id, created_at, severity, freq, evidence.  Rows may arrive in any order within
    `late` of the newest row seen.  Rows without a time, user or ingredient do not count.
    """
    marked = evidence.withWatermark("created_at", late)
    # Plain microseconds carry no watermark, so that late rows reach the state and are counted there.
    slim = marked.where("created_at is not null").select(
        "user_id", "ingredient_name", F.unix_micros("created_at").alias("at_us"), F.col("checkin_id").cast("long").alias("checkin_id"),
        *[F.col(c).cast("double").alias(c) for c in ("severity", "freq", "evidence")])
    grouped = slim.withColumn("group", F.pmod(F.xxhash64("user_id", "ingredient_name"), F.lit(groups)).cast("int")).groupBy("group")
    return grouped.transformWithStateInPandas(OrderedGrades(), OUT, "Update", "EventTime")


def closing_mark(evidence: DataFrame, late: str = "1 day") -> DataFrame:
    """One row without user, later than all others by more than the delay: it moves the watermark past all that waits."""
    end = evidence.agg((F.max("created_at") + F.expr(f"interval {late}") + F.expr("interval 1 minute")).alias("created_at"))
    return end.select(*[F.col(f.name) if f.name == "created_at" else F.lit(None).cast(f.dataType).alias(f.name) for f in evidence.schema.fields])


def newest_grades(rows: DataFrame) -> DataFrame:
    """The last state of every key among the rows of all batches."""
    return rows.groupBy("user_id", "ingredient_name").agg(
        F.max_by(F.struct("grade", "confidence", "evidence_count", "late"), F.struct("evidence_count", "late")).alias("g")).select("user_id", "ingredient_name", "g.*")
