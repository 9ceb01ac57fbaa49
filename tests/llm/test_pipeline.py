import collections
import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from platewise.llm import cotraining, mixing, resemblance, secrets, simhash
from tests.llm.test_mixing_simhash import brute_components, brute_prints

BASE = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What went into each stage and what came out."""
    docs, out = spark.read.parquet(f"{BASE}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.shared(stage(spark, docs, BASE), "t")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "simhash near-dedup", "secret scans", "mixing sources", "packing"]
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    rated = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    good, bad = [d for d, q in rated.items() if q == 1], [d for d, q in rated.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d not in kept for d in bad) >= 0.7 * len(bad)
    assert sorted(map(tuple, after.collect())) == sorted(tuple(r) for r in before.collect() if r.doc_id in kept)


def test_dedup_keeps_the_first_of_each_group(stages):
    _, before, after = stages[1]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in resemblance.near_copies(before).where("doc_id = component_id").collect()}
    assert after.count() < before.count() and {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}


def resembling(rows):
    """Jaccard of the five-word shingles of all pairs that share one, by brute force."""
    sets = {d: set(simhash.shingles((t or "").encode(), 5)) for d, t in rows}
    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = collections.Counter(p for docs in where.values() for p in itertools.combinations(sorted(docs), 2))
    return {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in common.items()}


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pairs = resembling(rows)
    got = {r.doc_id: r.component_id for r in resemblance.near_copies(docs).collect()}
    assert all(got[a] == got[b] for (a, b), j in pairs.items() if j >= 0.9)
    near = [got[a] == got[b] for (a, b), j in pairs.items() if j >= 0.8]
    assert sum(near) >= 0.9 * len(near) > 0
    linked = {d for p, j in pairs.items() if j >= 0.65 for d in p}
    assert all(got[d] == d for d in got if d not in linked)  # clean documents stay
    prints = brute_prints(rows, 5)
    assert all(got[d] == got[c] for d, c in brute_components(prints).items())  # and no SimHash link is lost


def test_edited_copies_are_found(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(300)) for _ in range(20)]
    rows, group = [], {}
    for g, text in enumerate(base):
        for k in range(6):
            words = text.split()
            for at in rng.sample(range(300), 0 if k == 0 else 3):
                words[at] = f"x{rng.randrange(10**6)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.component_id for r in resemblance.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 6 * g for d, g in group.items()}


def test_resemblance_is_exact(spark):
    """Pairs whose last shingles differ, on both sides of 0.8."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for shingles, changed in (12, 1), (20, 1), (30, 2), (40, 3), (96, 10), (40, 6), (20, 3), (12, 2), (600, 66), (600, 68):
        for _ in range(100):
            base = words(shingles + 4)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:len(base) - changed] + words(changed)))]
    pairs = resembling(rows)
    assert len(pairs) == 1000 and 0.7 < min(pairs.values()) < 0.8 < max(pairs.values())
    prints = brute_prints(rows, 5)
    near = {p for p, j in pairs.items() if j >= 0.8 or (prints[p[0]] ^ prints[p[1]]).bit_count() <= 2}
    got = {r.doc_id: r.component_id for r in resemblance.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {p for p in pairs if got[p[0]] == got[p[1]]} == near


def test_members_of_a_large_band_led_by_another_text_meet(spark, monkeypatch):
    """Thirty classes share one band; 10 and 20 are alike and unlike the smallest key."""
    rng = np.random.default_rng(3)
    sketches = rng.integers(0, 1 << 16, (31, resemblance.BINS), dtype=np.uint16)
    sketches[:, 10:15] = 7
    sketches[20, :15] = sketches[10, :15]
    sketches[20, 20:] = sketches[10, 20:]
    classes = spark.createDataFrame([(k, 400, bytearray(sketches[k].tobytes())) for k in range(1, 31)], "key long, size int, sketch binary")
    # The pair shares small bands as well, which are taken away here.
    met = resemblance.banded(classes).where("n > 16")
    assert (20, 10) not in {(r.a, r.b) for r in resemblance.proposed(classes, met).collect()}
    monkeypatch.setattr(resemblance, "BLOCK", 4)
    assert resemblance.crossing(classes, met, classes.select("key", F.lit(1).alias("component"))).count() == 0
    sketches[20, :10], sketches[20, 20:25] = sketches[0, :10], sketches[0, 20:25]
    sketches[20, 29::5] += 1
    classes = spark.createDataFrame([(k, 400, bytearray(sketches[k].tobytes())) for k in range(1, 31)], "key long, size int, sketch binary")
    placed = classes.select("key", F.when(F.col("key") < 5, 1).otherwise(F.col("key")).alias("component"))
    assert [(r.a, r.b) for r in resemblance.crossing(classes, resemblance.banded(classes), placed).collect()] == [(20, 10)]


def test_short_members_of_a_large_band_are_compared_in_its_blocks(spark, monkeypatch):
    """Sixty short classes share a band and a passage; three groups of four are alike.  Pairs of unlike ones leave no row."""
    monkeypatch.setattr(resemblance, "BLOCK", 16)
    own = {k: 1000 * (k // 4 + 1 if k < 12 else k) for k in range(1, 61)}
    sets = {k: [*range(30), *range(at, at + 60), 10**6 + k] for k, at in own.items()}
    classes = spark.createDataFrame([(k, 91, bytearray(2 * resemblance.BINS)) for k in sets], "key long, size int, sketch binary")
    met = resemblance.banded(classes).where("i = 0")
    placed = spark.createDataFrame([(k, 41 if k > 40 else k) for k in sets], "key long, component long")
    hashes = spark.createDataFrame(list(sets.items()), "key long, hashes array<long>")
    found = resemblance.crossing(classes, met, placed, sets=hashes).collect()
    assert all(r.sure and max(r.a, r.b) < 12 for r in found)
    group = {k: {k} for k in sets}
    for r in found:
        both = group[r.a] | group[r.b]
        group.update((k, both) for k in both)
    assert {frozenset(g) for g in group.values() if len(g) > 1} == {frozenset(range(1, 4)), frozenset(range(4, 8)), frozenset(range(8, 12))}


def test_components_are_joined_by_exact_links_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "FIRST", 1)
    sets = {k: list(range(100 * (k % 3), 100 * (k % 3) + 20 + k // 3)) for k in range(12)}  # three groups
    placed = spark.createDataFrame([(k, k) for k in sets], "key long, component long")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a > b], "a long, b long")
    hashes = spark.createDataFrame(list(sets.items()), "key long, hashes array<long>")
    moved = {r.node: r.component for r in resemblance.joined(pairs, hashes, placed).collect()}
    assert {k: moved.get(k, k) for k in sets} == {k: k % 3 for k in sets}


def test_texts_that_share_a_fingerprint_or_doc_id_keep_their_links(spark):
    line = [f"w{i}" for i in range(34)]
    rows = [(1, "some other words"), (5, " ".join(line)), (5, "one two three"), (7, " ".join(line[:32] + ["x", "y"]))]
    got = {(r.doc_id, r.component_id) for r in resemblance.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (5, 5), (7, 5)}


def test_secrets_are_gone(spark, stages):
    _, before, after = stages[2]
    old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    assert old.keys() == new.keys()
    for d, r in new.items():
        assert not secrets.spans(r.text) and (r == old[d] if not secrets.spans(old[d].text) else r.n_chars == len(r.text))


def test_mixing_emits_the_copies(stages):
    _, before, after = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    got = collections.Counter(r.doc_id for r in after.collect())
    assert got == {d: c for d, c in copies.items() if c}
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}


def test_packing_covers_all_documents(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert sum(r.start == 0 for r in rows) == before.count()
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert divmod(at, 2048) == (r.sequence_id, r.offset) and len(r.ids) == 4 * r.length
        at += r.length


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, BASE)
    assert corpus_pipeline.ORACLE_SQL is None and got.columns == stages[-1][2].columns
    total = lambda df: df.agg({"length": "sum"}).first()[0]
    assert total(got) == total(stages[-1][2])


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "some words", "en", "s", 10, None), (4, "long " * 30000, "de", None, 150000, "y"),
            (4, "long " * 30000, "de", None, 150000, "y"), (5, "token = abcdef1234", "en", "s", 18, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __keep string")
    for df in (docs.withColumnRenamed("__keep", "label"), docs.withColumnRenamed("__keep", "copies").limit(0)):
        columns = df.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = corpus_pipeline.shared(stage(spark, df, BASE), "odd")
            assert df.columns == columns, name
        assert (corpus_pipeline.packing(spark, df, BASE).count() > 0) == (df.count() > 0)


# ---- the classifier --------------------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    """Rows that neither view was fitted or calibrated on."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    unseen = labels.where("doc_id % 4 = 0")
    slim = docs.select(*COLUMNS)
    model = cotraining.fit(slim, labels.where("doc_id % 4 != 0"), labelled=1500)
    got = cotraining.score(slim, model).join(unseen, "doc_id").select("quality", "__text_score", "__score", "__keep").toPandas()
    assert len(got) > 800
    assert ((got["__keep"]) == (got.quality == 1)).mean() > 0.98
    assert got[got.quality == 1]["__keep"].mean() > 0.98
    brier = ((got["__score"] - got.quality) ** 2).mean()
    assert brier < 0.02  # calibrated


def test_views_teach_each_other():
    """Few labels, two informative views: pseudo-labels help both."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 3000)
    text = (rng.standard_normal((3000, 30)) + 0.9 * (2 * y - 1)[:, None] * (np.arange(30) < 8)).astype(np.float32)
    meta = (rng.standard_normal((3000, 10)) + 0.9 * (2 * y - 1)[:, None] * (np.arange(10) < 4)).astype(np.float32)
    label = np.full(3000, -1)
    label[:60] = y[:60]
    held = np.zeros(3000, bool)
    held[:60:3] = True
    alone, both = cotraining.co_train(text, meta, label, held, rounds=0), cotraining.co_train(text, meta, label, held, rounds=4, each=100)
    right = lambda m, k: ((m.scores(text, meta)[k][60:] > 0.5) == (y[60:] == 1)).mean()
    assert right(both, 1) >= right(alone, 1) and right(both, 2) > 0.95
    assert cotraining.co_train(text, meta, np.where(label == 1, 1, -1), held) is None


def test_exchange_over_a_table_equals_arrays(spark):
    """Pool rows in many partitions, with copies: the rows given, and so the weights, are those of a plain version over all distinct rows."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 1500)
    text = (rng.standard_normal((1500, 30)) + 0.9 * (2 * y - 1)[:, None] * (np.arange(30) < 8)).astype("<f2")
    meta = (rng.standard_normal((1500, 10)) + 0.9 * (2 * y - 1)[:, None] * (np.arange(10) < 4)).astype("<f2")
    label, held = np.where(np.arange(1500) < 90, y, -1), np.arange(1500) % 3 == 0
    rows = [(a.tobytes(), b.tobytes()) for a, b in zip(text, meta)]
    df = spark.createDataFrame(rows + rows[100:101] * 700, "x binary, m binary").repartition(7).selectExpr("x", "m", "xxhash64(x, m) as key")
    given = {(bytes(r.x), bytes(r.m)): r.key for r in df.collect()}
    keys = np.array([given[r] for r in rows])
    pool = cotraining.TablePool(df, keys[:90])
    assert len(pool) == 1410
    by_key = np.argsort(keys[90:]) + 90
    text, meta = text.astype(np.float32), meta.astype(np.float32)
    plain = cotraining.ArrayPool({"text": text[by_key], "meta": meta[by_key]})
    args = text[:90], meta[:90], label[:90], held[:90]
    a, b = cotraining.co_train(*args, rounds=3, each=100, pool=pool), cotraining.co_train(*args, rounds=3, each=100, pool=plain)
    assert len(pool) == len(plain) < 1410
    assert np.allclose(a.text, b.text, atol=1e-5) and np.allclose(a.meta, b.meta, atol=1e-5) and np.allclose(a.both, b.both, atol=1e-4)


def test_classify_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", "en", "s", -5), (4, "w " * 50000, "en", "s", 100000), (4, "w " * 50000, "en", "s", 100000)],
                                 "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "2 as label")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = cotraining.classify(docs, none).collect()
    assert len(got) == 5 and all(r.keep and r.score is None for r in got)
    base = "/root/testdata/sf0.001"
    both = spark.read.parquet(f"{base}/documents.parquet").unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    odd = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (2, None), (10**9, 0)], "doc_id long, quality int"))
    got = cotraining.classify(both, odd).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got)
    assert cotraining.classify(docs.limit(0), odd).count() == 0
