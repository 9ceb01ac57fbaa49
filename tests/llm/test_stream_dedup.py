"""Streaming exact dedup against a plain grouping of whole texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from platewise.llm import stream_dedup as sd
from platewise.llm.common import FOLD

SCHEMA = "doc_id long, text string, digest string, size long, file string, norm string"
LONG = "Word " * 60_000
TEXTS = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (None, "same text"), (None, "alone"), (None, None), (7, "Straße"), (8, "STRAßE"),
         (9, "ÉCOLE"), (10, "école"), (11, LONG), (12, LONG.upper()), (13, LONG + "x"), (14, "twice"), (14, "twice"), (14, "other"), (15, " same text")]


def plain(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for n, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i))
        sha = hashlib.sha256(n.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), k == len(ids) - 1, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def written(spark, path, texts, files=3):
    rows = [(i, t, "x", 1, "y", "z") for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(path)
    return path


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("key", [F.unhex, lambda sha: F.substring(sha, 1, 1).cast("binary"), lambda sha: F.substring(sha, 100, 1).cast("binary")])
@pytest.mark.parametrize("batch", [sd.BATCH, 1])
def test_equals_grouping_of_texts(spark, tmp_path, key, batch):
    """Also when digests clash, so that only the bytes tell the texts apart, and with a batch per file."""
    path = written(spark, str(tmp_path / "docs"), TEXTS)
    df = sd.deduplicate(spark, path, key=key, batch=batch)
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert result(df) == plain(TEXTS)


def test_goes_on_where_it_stopped(spark, tmp_path):
    path, marks = written(spark, str(tmp_path / "docs"), TEXTS), str(tmp_path / "marks")
    sd.deduplicate(spark, path, marks=marks)
    more = [(20, "Same text"), (21, "new"), (3, "")]
    written(spark, path, more, 1)
    assert result(sd.deduplicate(spark, path, marks=marks)) == plain(TEXTS + more)
    assert sd.remembered(spark, marks).agg(F.sum("size")).first()[0] == len(TEXTS) + len(more)


def test_large_groups_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "LARGE", 3)
    texts = TEXTS + [(100 + i, "hot") for i in range(40)]
    assert result(sd.deduplicate(spark, written(spark, str(tmp_path / "docs"), texts))) == plain(texts)


def test_empty_table_single_file_and_no_python(spark, tmp_path):
    path = written(spark, str(tmp_path / "docs"), [], 1)
    assert sd.deduplicate(spark, path).collect() == []
    df = sd.deduplicate(spark, "/root/testdata/sf0.001/documents.parquet")
    assert df.count() == 200
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_settings_are_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    sd.deduplicate(spark, "/root/testdata/sf0.001/documents.parquet")
    assert spark.conf.get(name) == before
