import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import cf, cookbook, evaluation, preference, ranking, ratings
from platewise.sources import sinks

R = "user_id string, recipe_id long, rating double"
LOG = "user_id string, recipe_id long, interaction_type string, created_at timestamp"


def test_ratings(spark, rows, at):
    log = spark.createDataFrame([("u", 1, "viewed", None), ("u", 1, "liked", None), ("u", 2, "save", None), ("u", 3, "dismissed", None)], LOG)
    assert rows(ratings.interactions_to_ratings(log)) == [("u", 1, 4.5), ("u", 2, 1.0), ("u", 3, 0.0)]


def test_positive_ratings(spark, rows):
    df = spark.createDataFrame([("hist_1", 1, 3.0), ("hist_1", 2, 4.0), ("u", 1, 1.5), ("u", 9, 5.0), ("u", 2, 0.0)], R)
    catalog = spark.createDataFrame([(1,), (2,)], "recipe_id long")
    assert rows(ratings.filter_positive_ratings(df, catalog)) == [("hist_1", 2, 4.0), ("u", 1, 1.5)]


def test_training_boundary(spark, at):
    log = spark.createDataFrame([("u", 1, "liked", at("2024-01-01T09:59")), ("u", 2, "liked", at("2024-01-01T10:01")), ("u", 3, "liked", None), ("new", 4, "liked", at("2023-01-01T00:00"))], LOG)
    cut = "2024-01-01 10:00:00"
    ids = lambda df: {r["recipe_id"] for r in df.collect()}
    assert ids(ratings.filter_training_boundary(log, cut)) == {1, 3, 4}
    learned = spark.createDataFrame([("u",)], "user_id string")
    assert ids(ratings.filter_online_delta(log, learned, cut)) == {2, 4}
    assert ids(ratings.filter_online_delta(log, learned, cut, hybrid=False)) == {2}
    assert ids(ratings.filter_online_delta(log, learned, None)) == {1, 2, 3, 4}


def random_ratings(spark, users=40, items=25, seed=2, hot=()):
    rng = np.random.default_rng(seed)
    data = [(f"u{u:02d}", int(i), float(rng.integers(1, 4))) for u in range(users) for i in range(items) if rng.random() < (0.9 if i in hot else 0.12)]
    return data, spark.createDataFrame(data, R)


def dense(data):
    us, its = sorted({d[0] for d in data}), sorted({d[1] for d in data})
    m = np.zeros((len(us), len(its)))
    for u, i, r in data:
        m[us.index(u), its.index(i)] = r
    return us, its, m


def sims(m):
    n = np.linalg.norm(m, axis=1)
    return (m @ m.T) / np.outer(n, n)


@pytest.mark.parametrize("hot_raters, chunk", [(10_000, 1024), (12, 1024), (12, 3), (1, 4)])
def test_user_based_equals_brute_force(spark, hot_raters, chunk):
    data, df = random_ratings(spark, hot=(0, 1))
    us, its, m = dense(data)
    s = sims(m)
    got = {}
    for r in cf.neighbours(df, 5, hot_raters, chunk).collect():
        got.setdefault(r["user_id"], {})[r["nb"]] = r["sim"]
    for a, u in enumerate(us):
        order = sorted((round(-s[a, b], 10), v) for b, v in enumerate(us) if b != a and s[a, b] > 0)[:5]
        assert set(got[u]) == {v for _, v in order}
        for k, v in order:
            assert got[u][v] == pytest.approx(-k)


def test_item_based_equals_brute_force(spark):
    data, df = random_ratings(spark)
    us, its, m = dense(data)
    s = sims(m.T)
    got = {(r["user_id"], r["recipe_id"]): r["score"] for r in cf.item_based(df, 100, chunk=4).collect()}
    for a, u in enumerate(us):
        rated = m[a] > 0
        for b, i in enumerate(its):
            d = s[rated, b].sum()
            if not rated[b] and d > 0:
                assert got.pop((u, i)) == pytest.approx((s[rated, b] * m[a, rated]).sum() / d)
    assert not got


def test_item_based_by_blocks_keeps_ties_nulls_and_users_without_id(spark, monkeypatch):
    """Scores are cut to the best in the tasks; sums per user and recipe are not shuffled."""
    data, _ = random_ratings(spark, 30, 20, 5)
    data = [(u, i, None if (n := k % 7) == 3 else 2.0 if n else r) for k, (u, i, r) in enumerate(data)] + [(None, 3, 2.0), (None, 4, 1.0)]
    df = spark.createDataFrame(data, R)
    whole = cf._best(cf._item_scores(df, cf.item_similarity(df)).withColumn("score", F.round("score", 10)), df, 4)
    for name, value in ("CELLS", 50), ("BLOCKS", 3), ("DENSE", 9):
        monkeypatch.setattr(cf, name, value)
    got = cf.item_based(df, 4)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    # A rating without user is no one's: its recipes are not left out.
    shown = lambda rows: {(r.user_id, r.rn, r.recipe_id, r.score if r.score is None else round(r.score, 8)) for r in rows.collect()}
    assert shown(got) == shown(whole) and len(shown(got)) > 100


def test_predict_user_based(spark):
    data, df = random_ratings(spark)
    us, its, m = dense(data)
    s = sims(m)
    cells = [(a, b) for a in range(3) for b in range(4)]
    pairs = spark.createDataFrame([(us[a], its[b]) for a, b in cells], "user_id string, recipe_id long")
    got = {(r["user_id"], r["recipe_id"]): r["pred"] for r in cf.predict_user_based(pairs, df, 50).collect()}
    for a, b in cells:
        who = [c for c in range(len(us)) if c != a and m[c, b] > 0]
        total = s[a, who].sum()
        assert got[(us[a], its[b])] == (pytest.approx((s[a, who] * m[who, b]).sum() / total) if total else None)


def factors(spark, n, k, key, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-2, 3, size=(n, k)).astype(float)
    rows = [(i if key == "recipe_id" else f"u{i}", float(i % 3) / 10, v[i].tolist()) for i in range(n)]
    return v, spark.createDataFrame(rows, f"{key} {'long' if key == 'recipe_id' else 'string'}, bias double, vec array<double>")


@pytest.mark.parametrize("block", [4, 1000])
def test_block_recommend_equals_brute_force(spark, block):
    iv, items = factors(spark, 30, 3, "recipe_id", 1)
    uv, users = factors(spark, 9, 3, "user_id", 2)
    out = [("u1", i) for i in range(25)] + [("u2", 3)]
    got = {}
    for r in preference.recommend(items, users, spark.createDataFrame(out, "user_id string, recipe_id long"), 4, block).collect():
        got.setdefault(r["user_id"], {})[r["rn"]] = r["recipe_id"]
    for u in range(9):
        left = [i for i in range(30) if (f"u{u}", i) not in out]
        want = sorted(left, key=lambda i: (-(uv[u] @ iv[i] + (i % 3) / 10), i))[:4]
        assert [got[f"u{u}"][k] for k in range(1, len(want) + 1)] == want


def test_vectors_and_strength(spark):
    items = spark.createDataFrame([(1, 0.0, [0.0, 2.0]), (2, 0.0, [9.0, 9.0])], "recipe_id long, bias double, vec array<double>")
    rated = spark.createDataFrame([("u", 1, 4.5), ("u", 2, 0.0), ("u", 7, 5.0)], R)
    assert preference.user_vectors(rated, items).first()["vec"] == [0.0, 2.0]
    w = lambda r: preference.online_strength(spark.createDataFrame([("u", 1, r)], R)).first()["weight"]
    assert w(1.5) == pytest.approx(0.105) and w(5.0) == pytest.approx(0.35) and w(50.0) == pytest.approx(0.35)


def test_bounded_delta_literal(spark):
    cand = spark.createDataFrame([("u", 2, 5.0), ("u", 1, 4.5)], "user_id string, recipe_id long, preference_score double")
    items = spark.createDataFrame([(1, 0.0, [5.0])], "recipe_id long, bias double, vec array<double>")
    online = spark.createDataFrame([("u", [7.0], 1.0)], "user_id string, vec array<double>, weight double")
    got = [(r["recipe_id"], r["preference_score"]) for r in preference.bounded_delta(cand, items, online).orderBy("rn").collect()]
    assert got == [(1, 5.5), (2, 5.0)]


def test_factors_beat_the_mean(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(60, 2)), rng.normal(size=(40, 2))
    data = [(f"u{u}", i, float(3 + a[u] @ b[i])) for u in range(60) for i in range(40) if rng.random() < 0.5]
    split = ratings.split_train_test(spark.createDataFrame(data, R))
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    model = preference.fit_explicit(train, rank=4, iters=8, scale=(-10, 16))
    err = evaluation.rmse(preference.predict_explicit(test, model)).first()["rmse"]
    flat = evaluation.rmse(test.withColumn("pred", F.lit(3.0))).first()["rmse"]
    assert err < 0.6 * flat
    ghost = spark.createDataFrame([("u1", 999)], "user_id string, recipe_id long")
    assert preference.predict_explicit(ghost, model).first()["pred"] == pytest.approx(model["meta"].first()["global_mean"])


def test_hybrid_serves_cold_items(spark):
    pos = spark.createDataFrame([(f"u{u}", i, 5.0) for u in range(12) for i in range(6) if (u + i) % 2 == 0], R)
    feats = spark.createDataFrame([(i, f"f{i % 2}", 1.0) for i in range(8)], "recipe_id long, feature string, weight double")
    users = spark.createDataFrame([(f"u{u}",) for u in range(13)], "user_id string")
    side = users.select("user_id", F.lit("all").alias("feature"), F.lit(1.0).alias("weight"))
    model = preference.fit_hybrid(pos, feats, side, feats, users, rank=3, iters=5)
    got = {r["recipe_id"]: r["vec"] for r in model["item_factors"].collect()}
    assert len(got) == 8 and any(got[6]) and got[6] == pytest.approx(np.mean([got[0], got[2], got[4]], axis=0).tolist())
    assert model["user_factors"].count() == 13


def test_backfill(spark):
    catalog = spark.createDataFrame([(i,) for i in range(10, 22)], "recipe_id long")
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    cand = spark.createDataFrame([("a", 1, 15, 9.0), ("a", 2, 11, 8.0)], "user_id string, rn int, recipe_id long, preference_score double")
    excl = spark.createDataFrame([("a", 10), ("a", 12)] + [("c", i) for i in range(10, 22)], "user_id string, recipe_id long")
    got = {}
    for r in ranking.topk_with_backfill(cand, catalog, users, excl).collect():
        got.setdefault(r["user_id"], {})[r["rn"]] = r["recipe_id"]
    as_list = {u: [x[k] for k in sorted(x)] for u, x in got.items()}
    assert as_list == {"a": [15, 11, 13, 14, 16, 17], "b": [10, 11, 12, 13, 14, 15], "c": [10, 11, 12, 13, 14, 15]}


def test_greedy_rows_use_a_recipe_once(spark):
    ranked = spark.createDataFrame([("u", i, i, 10.0 - i) for i in range(1, 31)], "user_id string, rn int, recipe_id long, final_score double")
    trend = spark.createDataFrame([(30, 1), (1, 2), (29, 3)], "recipe_id long, rn int")
    flavor = spark.createDataFrame([("u", i, i / 30.0) for i in range(1, 31)], "user_id string, recipe_id long, cosine double")
    recipes = spark.createDataFrame([(i, ["chili"] if i % 2 else ["rice"], 10, [100.0, 1.0]) for i in range(1, 31)],
                                    "recipe_id long, ingredients array<string>, minutes int, nutrition array<double>")
    excl = spark.createDataFrame([("u", 2)], "user_id string, recipe_id long")
    got = {}
    for r in ranking.category_rows(ranked, trend, flavor, recipes, excl, k=3).collect():
        got.setdefault(r["row_name"], {})[r["rank"]] = r["recipe_id"]
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {
        "curated": [1, 3, 4], "trending": [30, 29, 5], "flavor": [27, 25, 23], "healthy": [6, 7, 8], "quick": [9, 10, 11]}


def test_generation_replace(spark, rows):
    cols = "user_id string, recipe_id long, preference_score double, model_name string"
    now = spark.createDataFrame([("a", 1, 1.0, "m@1"), ("a", 2, 1.0, "m@2"), ("b", 1, 1.0, "m@1")], cols)
    users = spark.createDataFrame([("a",), ("a",)], "user_id string")
    new = spark.createDataFrame([("a", 9, 2.0, "m@1")], cols)
    assert rows(sinks.replace_generation(now, new, users, "m@1")) == [("a", 2, 1.0, "m@2"), ("a", 9, 2.0, "m@1"), ("b", 1, 1.0, "m@1")]
    assert rows(sinks.replace_generation(now, new.limit(0), users, "m@1")) == [("a", 2, 1.0, "m@2"), ("b", 1, 1.0, "m@1")]
    for bad, name in ((new, " "), (now, "m@1")):
        with pytest.raises(ValueError):
            sinks.replace_generation(now, bad, users, name)


def test_broken_factors_are_not_published(spark, tmp_path):
    root = str(tmp_path)
    good = spark.createDataFrame([(1, 0.1, [1.0, 2.0])], "recipe_id long, bias double, vec array<double>")
    users = spark.createDataFrame([("u", 0.0, [1.0, 0.0])], "user_id string, bias double, vec array<double>")
    meta = spark.createDataFrame([(3.0, 2)], "global_mean double, rank int")
    first = sinks.publish_factors(spark, root, "m", "2024-01-01", good, users, meta)
    with pytest.raises(ValueError):
        sinks.publish_factors(spark, root, "m", "2024-01-02", good.withColumn("vec", F.slice("vec", 1, 1)), users, meta)
    assert first == "m@20240101" and sinks.current_factors(spark, root)[0] == first


def test_membership_blank_fields_keep_older_value(spark, at):
    df = spark.createDataFrame([(1, "u", "7", "Old", "catalog", "a", at("2024-01-01T00:00")), (2, "u", "7", None, "personal", "", at("2024-01-02T00:00")), (3, "u", "", "x", None, None, None)],
                               "id long, user_id string, recipe_id string, recipe_title string, recipe_source string, ingredients string, created_at timestamp")
    r = cookbook.cookbook_memberships(df).collect()
    assert len(r) == 1 and (r[0]["recipe_title"], r[0]["recipe_source"], r[0]["ingredients"], r[0]["cooklist_count"]) == ("Old", "personal", "a", 2)


def test_classifier_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "label int, p double")
    r = evaluation.classifier_metrics(df).first()
    assert r["auc"] == pytest.approx(0.875) and r["brier"] == pytest.approx((0.01 + 0.01 + 0.36 + 0.16) / 4)
    assert evaluation.classifier_metrics(df.where("label = 1")).first()["auc"] is None


def test_medoids_of_single_item_clusters(spark):
    items = spark.createDataFrame([(1, 0, [0.0]), (2, 1, [5.0]), (3, 1, [6.0])], "recipe_id long, cluster int, scaled array<double>")
    centers = spark.createDataFrame([(0, [0.0]), (1, [5.1])], "cluster int, center array<double>")
    stats = spark.createDataFrame([(2, 5, 0.1, 4.0), (3, 5, 0.1, 4.0)], "recipe_id long, review_count long, rating_var double, rating_mean double")
    got = {r["cluster"]: r["recipe_id"] for r in preference.training_medoids(items, centers, stats).collect()}
    assert got == {0: 1, 1: 2}


def test_candidates_leave_out_pairs_before_they_arise(spark, rows):
    users = spark.createDataFrame([("u",), ("u",), ("v",), (None,)], "user_id string")
    catalog = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5, None)], "recipe_id long")
    barred = spark.createDataFrame([("u", 2), ("u", 2), ("u", 5), ("v", None), (None, 1), ("w", 1), ("v", 9)], "user_id string, recipe_id long")
    for block in (2, 4096):
        found = ranking.cross_candidates(users, catalog, barred, block)
        every = [1, 2, 3, 4, 5, None]
        assert rows(found) == sorted([("u", i) for i in (1, 3, 4, None)] + [("v", i) for i in every] + [(None, i) for i in every], key=repr)
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        last = min(k for k, line in enumerate(plan) if "Generate" in line)
        assert all(k > last for k, line in enumerate(plan) if "Join" in line)
