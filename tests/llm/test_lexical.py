"""Ranked lexical search against a plain scoring of every document."""

import math
import re

import duckdb
import pytest

from platewise.llm import lexical
from platewise.llm.checks import SQL
from platewise.llm.common import FOLD
from platewise.llm.queries import QUERIES

DOCS = "doc_id long, text string, item_id string, score double, rank int"
ITEMS = "item_id long, text string, doc_id string, extra int"
_RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=10):
    split = [(i, _RUN.findall((t or "").translate(FOLD))) for i, t in docs]
    n_docs, total = sum(bool(x) for _, x in split), sum(len(x) for _, x in split)
    df = {}
    for _, x in split:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    groups = {}
    for i, t in items:
        groups.setdefault(i, set()).update(_RUN.findall((t or "").translate(FOLD)))
    out = []
    for item, own in groups.items():
        found = []
        for i, x in split:
            if x:
                m = 10 + 90 * len(x) * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * x.count(t) // (1000 * x.count(t) + 8 * m)) for t in own if t in x)
                if s > 0:
                    found.append((-s, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(i, t, "c", 1.0, 9) for i, t in docs], DOCS).repartition(parts)
    b = spark.createDataFrame([(i, t, "c", 1) for i, t in items], ITEMS)
    return sorted(map(tuple, lexical.ranked_search(d, b, **more).collect()), key=repr)


CASES = [(1, "The cat, the hat"), (2, "cat"), (3, "cats and-dogs"), (4, None), (5, ""), (6, " ,;. "), (7, "Ünïcode cat—hat 42"), (None, "cat"), (8, "cat"), (8, "cat"),
         (9, "über cat ÜBER"), (10, "hat\x00cat\x7fdog"), (11, "the " * 30_000 + "zebra"), (12, "a_cat cat_a")]
ASKED = [(1, "the cat"), (2, "HAT hat hat"), (3, None), (4, ""), (5, "nowhere"), (None, "zebra 42"), (6, "dogs"), (6, "über cat—hat"), (7, "cat"), (7, "cat")]


def test_equals_plain_scores(spark):
    assert run(spark, CASES, ASKED) == plain(CASES, ASKED)
    assert run(spark, CASES, ASKED, k=2, parts=1) == plain(CASES, ASKED, 2)


def test_blocks_of_items_and_of_terms(spark, monkeypatch):
    assert run(spark, CASES, ASKED, most_items=2) == plain(CASES, ASKED)
    monkeypatch.setattr(lexical, "TERMS", 2)
    assert sorted(lexical.terms_of("A b-ß")) == ["a", "b", "ß".encode().decode("latin-1")]
    assert run(spark, CASES, ASKED, most_bytes=10) == plain(CASES, ASKED)


def test_few_terms_at_a_time_and_integer_sums():
    """Scores by terms in pieces and by integers equal those of one table of doubles."""
    import numpy as np

    terms, postings = ["a", "b", "c"], [[0], [0, 1], [1]]
    m = lexical.Matcher(terms, postings, 2)
    assert m.table(np.array([0, 2])).tolist() == [[1, 0], [0, 1]]
    best = lexical.Best(2, 2)
    best.take(np.array([[5, 0], [5, 7], [6, 7]]), np.array([3, 1, 9]), np.array([False, False, True]))
    best.take(np.array([[5, 7]]), np.array([0]), np.array([False]))
    assert [x.tolist() for x in best.rows[:3]] == [[0, 0, 1, 1], [6, 5, 7, 7], [9, 0, 0, 1]]


def test_many_ties_over_many_tasks(spark):
    docs = [(i, "hot words here") for i in range(300, 0, -1)]
    assert run(spark, docs, [(1, "hot"), (2, "cold")], parts=16) == plain(docs, [(1, "hot"), (2, "cold")])


def test_empty_tables(spark):
    assert run(spark, [], ASKED) == [] and run(spark, CASES, []) == [] and run(spark, [(1, None)], ASKED) == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql_and_plain(spark, sf):
    base = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    want = sorted(tuple(map(int, r)) for r in con.execute(SQL["op11_lexical_search"]).fetchall())
    got = sorted(tuple(map(int, r)) for r in QUERIES["op11_lexical_search"](spark, base).select("item_id", "rank", "doc_id", "score").collect())
    docs, items = (con.execute(f"select {c}, text from {t}").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert got == want == sorted(plain(docs, items))
