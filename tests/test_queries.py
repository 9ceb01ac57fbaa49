"""Registered queries against their SQL, and streams against their batch forms, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from platewise.operators import checkins as ck
from platewise.plans import all_queries, all_sql
from platewise.plans.mapping import Domain

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPREAD = ("rerank_final", "category_greedy_rows", "agg_risk_update", "agg_recent_context", "join_asof_meal_outcome", "content_experiment", "rule_insight_cards",
          "cookbook_recommend", "care_runs", "stream_risk_state", "search_contains", "agg_checkin_evidence", "split_chrono_purged", "membership_replace", "context_assembly")
NAMES = sorted(all_sql()) if os.environ.get("PLATEWISE_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{BASE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    a, b = all_queries()[name](spark, BASE).toPandas(), duck.execute(all_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = list(a.columns)
    key = lambda df: sorted(map(repr, df[cols].itertuples(index=False, name=None)))
    assert key(a) == key(b.astype(a.dtypes.to_dict()) if len(a) else b)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.limit(1).count() == 1 and "final_score" in df.columns


@pytest.mark.parametrize("named,folder", [(None, BASE), ("/some/where", "/some/where")])
def test_entry_reads_the_named_folder(monkeypatch, named, folder):
    monkeypatch.delenv("PLATEWISE_DATA", raising=False)
    if named:
        monkeypatch.setenv("PLATEWISE_DATA", named)
    monkeypatch.setattr(entry_points, "all_queries", lambda: {"rerank_final": lambda spark, base: (spark, base)})
    assert entry_points.entry("session") == ("session", folder)


def test_every_query_but_models_has_a_check():
    assert set(all_queries()) == set(all_sql())


def test_every_check_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_stream_grades_equal_batch(spark, rows):
    d = Domain(spark, BASE)
    batch = ck.checkin_grades(ck.checkin_evidence(d.checkins, d.ingredient_catalog))
    stream = all_queries()["stream_checkin_ewma"](spark, BASE)
    cols = ("user_id", "ingredient_name", "grade", "evidence_count")
    assert rows(stream, *cols) == rows(batch, *cols)
