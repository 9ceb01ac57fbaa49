import math

import numpy as np
import pytest

from platewise.llm import ann
from platewise.llm.queries import QUERIES


def brute(rows, k=5, every=50):
    usable = {}
    for i, v in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        usable[i] = min(usable.get(i, v), v)
    ids = np.array(sorted(usable))
    x = np.array([usable[i] for i in ids], float)
    out = {}
    for q in ids[ids % every == 0]:
        own = x[np.searchsorted(ids, q)]
        score = np.einsum("nd,d->n", x, own) / (np.linalg.norm(x, axis=1) * np.linalg.norm(own))
        keep = ids != q
        order = np.lexsort((ids[keep], -score[keep]))[:k]
        out[int(q)] = [(int(ids[keep][o]), float(score[keep][o])) for o in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / max(1, len(want[q])) for q in want])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    base = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows), answers(QUERIES["op10_nearest_neighbours"](spark, base))
    assert recall(got, want) >= 0.9
    for q, near in got.items():
        exact = dict(brute([r for r in rows if r[0] in {q, *(v for v, _ in near)}])[q])
        assert all(s == pytest.approx(exact[v], abs=1e-12) for v, s in near)


def test_clustered_vectors_need_few_parts():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((40, 16)) * 4
    x = centers[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16)) * 0.3
    router = ann.fit_router(x, 16, 5)
    assert router.probes <= 4
    label = ann.balanced_parts(ann.neighbour_graph(ann.unit(x), 10), 16)
    assert np.bincount(label, minlength=16).max() - np.bincount(label, minlength=16).min() <= 4


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(200)]  # a large group of copies
    rows += [(5000, [2.0, 4.0, 6.0, 8.0]), (5001, None), (5050, [0.0] * 4), (5100, [1.0, float("nan"), 0.0, 0.0]), (5150, [1.0, float("inf"), 0.0, 0.0]),
             (None, [1.0, 0.0, 0.0, 0.0]), (5200, [1.0, None, 0.0, 0.0]), (0, [9.0, 9.0, 9.0, 9.0]), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1.0, i) for i, v in rows], "vec_id long, embedding array<double>, score double, uid long")
    got, want = answers(ann.search(df, target=1.0)), brute(rows)
    assert recall(got, want) >= 0.95
    assert [v for v, _ in got[1000]] == [v for v, _ in want[1000]] == [1001, 1002, 1003, 1004, 1005]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 5001")).count() == 0
    assert ann.search(df.where("vec_id = 100")).count() == 0
    two = answers(ann.search(df.where("vec_id in (100, 101)")))
    assert list(two) == [100] and [v for v, _ in two[100]] == [101]
