"""Streams with state: arrival out of order, late rows, folding of deltas, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from platewise import session
from platewise.operators import checkins as ck
from platewise.streaming import grades, jobs

ROWS = "user_id string, ingredient_name string, checkin_id long, created_at timestamp, severity double, freq double, evidence double"


@pytest.fixture
def evidence(at):
    rng = random.Random(7)
    return [(f"u{i % 3}", f"f{i % 2}", i, at(f"2024-01-{1 + i // 24:02d}T{i % 24:02d}:00"), rng.random(), rng.random(), rng.random()) for i in range(90)]


def fed(spark, batches, files=1):
    root = session.scratch_path(spark, "fed")
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(root)
    return jobs.file_stream(spark, root, spark.read.schema(ROWS).parquet(root).schema, files=files)


def streamed(spark, stream, late, marks=None, root=None):
    root = root or session.scratch_path(spark, "grades")
    each = lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/batch={i}")
    jobs.run_once(grades.stream_checkin_ewma(stream, late), "ewma", "update", each, marks, **grades.ON_DISK)
    return grades.newest_grades(spark.read.schema(grades.OUT).parquet(root))


def test_any_order_of_arrival_gives_the_batch_grades(spark, rows, evidence):
    """Rows dealt over the batches by chance; two at one instant, and rows without time or user."""
    evidence.append((*evidence[0][:2], 500, *evidence[0][3:]))
    mixed = evidence[:]
    random.Random(1).shuffle(mixed)
    odd = [("u0", "f0", 901, None, 1.0, 1.0, 1.0), (None, "f0", 902, evidence[5][3], 1.0, 1.0, 1.0)]
    close = [tuple(r) for r in grades.closing_mark(spark.createDataFrame(evidence, ROWS), "9 days").collect()]
    got = streamed(spark, fed(spark, [mixed[:40] + odd, mixed[40:70], mixed[70:], close]), "9 days")
    cols = ("user_id", "ingredient_name", "grade", "confidence", "evidence_count")
    assert rows(got, *cols) == rows(ck.checkin_grades(spark.createDataFrame(evidence, ROWS)), *cols)
    assert got.agg(F.sum("late")).first()[0] == 0


def test_late_rows_are_counted_and_a_restart_goes_on(spark, rows, evidence):
    first, then = [r for r in evidence if r[2] < 60], [r for r in evidence if r[2] >= 60]
    late = [("u0", "f0", 700, first[0][3], 0.9, 0.9, 0.9), ("new", "f0", 701, first[0][3], 0.9, 0.9, 0.9)]
    marks, root = session.scratch_path(spark, "marks"), session.scratch_path(spark, "grades")
    close = [tuple(r) for r in grades.closing_mark(spark.createDataFrame(evidence, ROWS), "1 hour").collect()]
    where = session.scratch_path(spark, "fed")
    put = lambda part: spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(where)
    put(first)
    stream = lambda: jobs.file_stream(spark, where, spark.read.parquet(where).schema, files=1)
    streamed(spark, stream(), "1 hour", marks, root)
    for part in (late + then, close):
        put(part)
    got = streamed(spark, stream(), "1 hour", marks, root)
    cols = ("user_id", "ingredient_name", "grade", "confidence", "evidence_count")
    assert rows(got.where("evidence_count > 0"), *cols) == rows(ck.checkin_grades(spark.createDataFrame(evidence, ROWS)), *cols)
    assert {(r.user_id, r.ingredient_name): r.late for r in got.where("late > 0").collect()} == {("u0", "f0"): 1, ("new", "f0"): 1}


def test_a_state_call_serves_many_keys(spark, rows, at):
    """Three hundred keys in two groups of state have the batch grades, each its own."""
    rng = random.Random(3)
    many = [(f"u{i % 100}", f"f{i % 3}", i, at(f"2024-01-{1 + i // 300:02d}T{i % 24:02d}:00"), rng.random(), rng.random(), rng.random()) for i in range(1200)]
    root = session.scratch_path(spark, "grades")
    close = [tuple(r) for r in grades.closing_mark(spark.createDataFrame(many, ROWS), "1 day").collect()]
    stream = grades.stream_checkin_ewma(fed(spark, [many[:600], many[600:], close]), "1 day", groups=2)
    each = lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/batch={i}")
    jobs.run_once(stream, "ewma", "update", each, **grades.ON_DISK)
    got = grades.newest_grades(spark.read.schema(grades.OUT).parquet(root))
    cols = ("user_id", "ingredient_name", "grade", "confidence", "evidence_count")
    assert rows(got, *cols) == rows(ck.checkin_grades(spark.createDataFrame(many, ROWS)), *cols)
    assert got.count() == 300


PAIRS = "user_id string, normalized_name string, severity double, no_symptoms boolean, weight double"


def pairs_of(batch):
    return [(f"u{i % 3}", f"f{i % 2}", (i + batch) % 5 / 5, False, 0.5 + batch) for i in range(12)]


def sums(spark, root, rows):
    return rows(jobs.current_risks(spark, root), "user_id", "normalized_name", "exposure_count", "positive_evidence", "negative_evidence")


def test_folded_deltas_equal_all_deltas(spark, rows):
    root, plain = session.scratch_path(spark, "folded"), session.scratch_path(spark, "plain")
    for k in range(8):
        batch = spark.createDataFrame(pairs_of(k), PAIRS)
        jobs.risk_batches(root, every=3)(batch, k)
        jobs.risk_batches(plain, every=100)(batch, k)
        _, last, open_ = jobs.risk_parts(spark, root)
        assert last == (k + 1) // 3 * 3 - 1 and len(open_) < 3
    a, b = sums(spark, root, rows), sums(spark, plain, rows)
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert [x for r in a for x in r[3:]] == pytest.approx([x for r in b for x in r[3:]])
    assert jobs._folders(spark, f"{root}/deltas", "batch") == [3, 4, 5, 6, 7] and jobs._folders(spark, f"{root}/base", "upto") == [2, 5]


@pytest.mark.parametrize("broken", ["before", "half", "after"])
def test_restart_during_folding(spark, rows, monkeypatch, broken):
    """The batch whose folding failed comes again, as a restarted stream hands it over."""
    root, plain = session.scratch_path(spark, "restart"), session.scratch_path(spark, "plain")
    batches = [spark.createDataFrame(pairs_of(k), PAIRS) for k in range(6)]
    for k in range(5):
        jobs.risk_batches(root, every=3)(batches[k], k)
    fold = jobs.fold_risks

    def fails(session_, where, upto):
        if broken == "half":  # rows lie there, but nothing was committed
            jobs.risk_parts(spark, where, upto)[0].write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{where}/base/upto={upto}")
        if broken == "after":
            fold(session_, where, upto)
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs, "fold_risks", fails)
    with pytest.raises(RuntimeError):
        jobs.risk_batches(root, every=3)(batches[5], 5)
    monkeypatch.setattr(jobs, "fold_risks", fold)
    for k in range(6):
        jobs.risk_batches(plain, every=100)(batches[k], k)
    for _ in range(2):
        assert [x for r in sums(spark, root, rows) for x in r[2:]] == pytest.approx([x for r in sums(spark, plain, rows) for x in r[2:]])
        jobs.risk_batches(root, every=3)(batches[5], 5)


def test_no_batches_yet(spark):
    assert jobs.current_risks(spark, session.scratch_path(spark, "none")).collect() == []


CARE = "user_id string, at timestamp, care_type string"


def test_late_care_joins_the_runs_it_lies_between(spark, at, rows):
    """Days 1-2 and 14 of one user, then day 8 in a later batch; another user whose gap is just a week."""
    care = lambda *x: [(u, at(f"2024-01-{d:02d}T{h:02d}:00"), k) for u, d, h, k in x]
    batches = [care(("a", 1, 8, "water"), ("a", 1, 9, "compost"), ("a", 2, 23, "water"), ("a", 2, 1, "compost"), ("b", 1, 5, "water"), ("b", 8, 5, "water")),
               care(("a", 14, 7, "compost"), ("a", 14, 8, "water"), ("a", 14, 9, "water")), care(("a", 8, 1, "compost")), [(None, at("2024-03-01T00:00"), "end")],
               care(("a", 3, 1, "water"))]
    root = session.scratch_path(spark, "care")
    for part in batches:
        spark.createDataFrame(part, CARE).coalesce(1).write.mode("append").parquet(root)
    out = jobs.run_once(jobs.stream_care_state(jobs.file_stream(spark, root, spark.read.parquet(root).schema, files=1), late="9 days"), "care")
    got = [(r.user_id, r.planted.day, r.last_care.day, r.died.day, r.level, r.streak, r.best_streak) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [("a", 1, 14, 21, 3, 1, 2), ("b", 1, 1, 8, 0, 0, 0), ("b", 8, 8, 15, 0, 0, 0)]
