import duckdb
import pytest
import xxhash
from pyspark.sql import types as T

from platewise.llm import components, mixing, resemblance, simhash
from platewise.llm.checks import SQL
from platewise.llm.queries import QUERIES

BASE = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def same(spark, name, base=BASE):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    got, want = QUERIES[name](spark, base).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(repr, df[list(want.columns)].itertuples(index=False, name=None)))
    assert key(got) == key(want.astype(got.dtypes.to_dict()))
    return got


def test_mix_equals_sql(spark):
    got = same(spark, "op8_mix_sources")
    by = got.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert abs(by.target.sum() - 1.5 * by.source_size.sum()) < 1e-6 * by.target.sum()


def test_mix_draws_by_own_hash_near_target(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 10 < 7, 'a', if(id % 10 < 9, 'b', 'c')) as source", "repeat('w ', cast(1 + id * id % 211 as int)) as text")
    got = mixing.mix(docs).toPandas()
    for _, rows in got.groupby("source"):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) < 0.01 * rows.target.iloc[0]
    # Another seed draws others, each with the same probability.
    drawn = [mixing.mix(docs.where("source = 'b'"), seed=f"s{k}", share=1.25).toPandas().set_index("doc_id").copies - 1 for k in range(12)]
    assert all(0 <= d.min() and d.max() <= 1 for d in drawn) and len({tuple(d.sort_index()) for d in drawn}) == 12
    times = sum(d.sort_index() for d in drawn)
    assert abs(times.mean() - 3) < 0.1 and abs(times.var() - 12 * 0.25 * 0.75) < 0.5


def test_mix_native(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "s", 0), (2, None, "x", "s", 0), (3, " \t ", "x", None, 0), (None, "a", None, "t", None),
                                  (5, "w " * 5000, "x", "t", 0), (5, "w " * 5000, "x", "t", 0), (6, "", None, "empty", 0)], SCHEMA)
    rows = {(r.doc_id, r.size): r for r in mixing.mix(docs.withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "target")).collect()}
    assert rows[(2, 0)].taken == 0 and rows[(3, 0)].taken == 0 and rows[(6, 0)].source_size == 0
    assert all(r.taken <= 2 * r.size for r in rows.values()) and rows[(1, 3)].source_size == 3
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), ("c", 1000, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and abs(got["b"] - 2995 * 2 / 3) < 1e-9 and abs(got["c"] - 2995 / 3) < 1e-9


def brute_prints(rows, width=3):
    out = {}
    for doc, text in rows:
        words = [w for w in (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()]
        parts = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        out[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out


def brute_components(prints):
    parent = {d: d for d in prints}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = brute_prints(rows)
    want = brute_components(prints)
    got = QUERIES["op1_simhash_near_dedup"](spark, BASE).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}
    assert len(got) == len(rows)


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame([(3, None, "x"), (1, "", "x"), (2, " \n", "y"), (None, "A b", "z"), (7, "a B", "z"), (8, "a b", None),
                                  (8, "a b", None), (9, "word " * 30000, None)], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert {c for d, f, c in got if d in (1, 2, 3)} == {1} and {c for d, f, c in got if d in (None, 7, 8)} == {7}
    assert len(got) == 8 and all(f == "0" * 16 for d, f, c in got if d in (1, 2, 3))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = resemblance.keep_first(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 7, 9, None]


@pytest.mark.parametrize("compared", [2, 256])
def test_large_variant_groups_lose_no_link(spark, monkeypatch, compared):
    import random
    rng = random.Random(5)
    monkeypatch.setattr(simhash, "COMPARED", compared)
    base, prints = rng.getrandbits(64), {}
    for i in range(300):
        p = base if rng.random() < .7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            p ^= 1 << rng.randrange(64)
        prints.setdefault(p, i)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    classes = spark.createDataFrame([(signed(p), i) for p, i in prints.items()], "fp long, rep long")
    # The task function is shipped by reference: run it here on the sorted variants.
    rows = simhash.variants(classes).select("key", "fp", "rep").orderBy("key").toArrow().to_batches(max_chunksize=500)
    out = [r for b in simhash._links(iter(rows)) for r in b.to_pylist()]
    hot = {r["a"]: r["fp"] for r in out if r["b"] is None}
    links = {(r["a"], r["b"]) for r in out if r["b"] is not None}
    for a, p in hot.items():
        links |= {(a, b) for b, q in hot.items() if a > b and ((p ^ q) & (2**64 - 1)).bit_count() <= 2}
    assert bool(hot) == (compared == 2)
    want = brute_components({i: p for p, i in prints.items()})
    pairs = spark.createDataFrame([*links, (-1, -2)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(pairs).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_long_chains(spark):
    n = 200
    chain = spark.range(n).selectExpr("(id * 37) % 211 a", "((id + 1) * 37) % 211 b")
    got = components.connected_components(chain).collect()
    assert {r.component for r in got} == {0} and len(got) == n + 1
    assert components.connected_components(chain.limit(0)).count() == 0
