import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from platewise.llm import packing, ppm, rans
from platewise.llm.queries import QUERIES
from platewise.llm.tokens import Encoder
from platewise.session import scratch_path

BASE = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b", " a b ", "a\n\nb c\n d", "don't  it's\tok", "x y z", "<|endoftext|> a b", "é é ́x", "a\x1cb c", "İSTANBUL ΑΣ ΑΣ.", "  lead",
       "tail  ", "\n", "12 345 6.7", "a b", "a　b", "a\r\nb", "﻿a b", "a\x85b c", "`x` [y] {z}~ \\", "naïve Straße ÿ", "\x00 a\x00b", "½ m² ªº ¬­b", "‘so’ – it’s … €5 ‹a›", "a" * 1500 + " b", " " * 300 + "x", ("\n " * 150) + "y", "w " * 400 + "\t\t x",
       "x" * 600 + " y", "a\x0bb a\x1fb", "don’t DON'T 'tis we'll", "a <|endoftext|>"]
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


@pytest.mark.parametrize("name,word", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_encode_as_the_whole(docs, name, word):
    path = public_tokenizers.path(name)
    plain, enc = Tokenizer.from_file(path), Encoder(path, word, 7)
    texts = ODD + [r.text for r in docs.limit(150).collect()]
    for _ in range(2):
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, enc.kind).tolist() == plain.encode(t, add_special_tokens=False).ids + [7], repr(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_equals_plain_cut(spark, docs):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces = QUERIES["op3_packing"](spark, BASE).collect()
    covered, places = collections.defaultdict(int), []
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == covered[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == crc(ids[p.doc_id][p.start:p.start + p.length])
        covered[p.doc_id] += p.length
        places.append((p.sequence_id, p.offset, p.length))
    assert dict(covered) == {d: len(x) for d, x in ids.items()}
    at = 0
    for s, o, n in sorted(places):
        assert (s, o) == divmod(at, 2048) and o + n <= 2048
        at += n


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "one two", 6), (3, "ab " * 9000, 7), (3, "ab " * 9000, 7)], "doc_id long, text string, part long").repartition(3)
    pieces = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("none", "none").cache()
    total = sum(r.length for r in pieces.collect())
    assert total == 1 + 1 + 3 + 2 * 9001
    seqs = sorted(packing.sequences(pieces).collect(), key=lambda r: r.sequence_id)
    assert [len(s.ids) for s in seqs[:-1]] == [2048] * (len(seqs) - 1) and len(seqs[-1].ids) & (len(seqs[-1].ids) - 1) == 0
    assert sum(g["length"] for s in seqs for g in s.segments) == total
    assert packing.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (63, 5), (5000, 1), (200_000, 50257), (300_001, 300)])
def test_coder_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, kinds - 1).astype(np.uint16)
    freq = rans.frequencies(np.bincount(ids, minlength=1 << 16))
    coder = rans.Coder(freq)
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    if n > 5000:
        share = np.bincount(ids) / n
        entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() * n / 8
        assert len(block) < entropy * 1.03 + 20_000
        broken = bytearray(block)
        broken[-3] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(broken))


def test_token_files_equal_plain_encoding(spark, docs):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op4_token_files"](spark, BASE).collect()) == want


def test_token_files_odd_rows(spark):
    df = spark.createDataFrame([(2, None, 1), (1, "", 1), (None, "x y", 1), (9, "long text " * 60000, 1), (9, "long text " * 60000, 1)], "doc_id long, text string, range long").repartition(4)
    for part, n in ((df, 5), (df.limit(0), 0)):
        path = scratch_path(spark, "odd")
        rans.write_ids(part, public_tokenizers.path("byte_bpe_50k.json"), path, path + "-u")
        rows = sorted(rans.read_ids(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [None, 1, 2, 9, 9][:n]
        at = 0
        for r in rows:
            assert r.start == at and len(r.ids) == 4 * r.n_tokens
            at += r.n_tokens


def test_token_files_of_large_vocabularies(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    words = {f"ж{i}": i for i in range(70_000)}
    large = Tokenizer(models.WordLevel(words, unk_token="ж0"))
    large.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    large.save(f"{tmp_path}/large.json")
    df = spark.range(300).selectExpr("id as doc_id", "concat('ж', id * 233, ' ж', 69999 - id) as text")
    path = scratch_path(spark, "large")
    rans.write_ids(df, f"{tmp_path}/large.json", path, path + "-u", end=69_998, word=True)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rans.read_ids(spark, path).collect()}
    assert got == {i: [i * 233, 69_999 - i, 69_998] for i in range(300)}


def naive_ppm(train, order):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        s = b"\xff" * order + t + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k:i]][s[i]] += 1

    def score(t):
        s, total = b"\xff" * order + t + b"\xff", 0.0
        for i in range(order, len(s)):
            out = set()
            for k in range(order, -1, -1):
                seen = {b: n for b, n in counts[k].get(s[i - k:i], {}).items() if b not in out}
                if not seen:
                    continue
                n, q = sum(seen.values()), sum(x == 1 for x in seen.values()) + 1
                if s[i] in seen:
                    total += math.log10(seen[s[i]] / (n + q))
                    break
                total += math.log10(q / (n + q))
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total

    return score


def brute_scores(rows, order=ppm.ORDER):
    fold = lambda t: (t or "").translate(FOLD).encode()
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    train = [fold(t) for d, t in rows if not held[d]]
    words = collections.Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(words.values()), len(words)
    score = naive_ppm(train, order)
    out = []
    for d, t in rows:
        tokens = [*fold(t).split(), None]
        base = sum(math.log10((words[w] + .5) / (n + .5 * (v + 1))) for w in tokens)
        out.append((d, held[d], len(tokens), sum(words[w] > 0 for w in tokens), n, base, score(fold(t))))
    return out


def test_scores_equal_naive_model(spark, docs, monkeypatch):
    monkeypatch.setattr(ppm, "COMMON", 500)  # many words then take the way over the join
    some = docs.where("length(text) < 1500")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    got = sorted(tuple(r) for r in ppm.score_documents(some).collect())
    want = sorted(brute_scores(rows))
    assert len(got) == len(want) > 50
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_scores_come_from_the_whole_trie_whatever_tasks_know(spark):
    rows = [(i, f"plum {chr(97 + i % 26) * (i % 7)} tart {i * 7919} and {i * i} pears é") for i in range(120)]
    want = sorted(brute_scores(rows))
    grams = ppm.gram_counts(spark.createDataFrame([(t,) for _, t in rows], "t string"), "t")
    assert ppm.trie_nodes(grams).count() > 4000
    for most in (0, 300, 10 ** 6):
        got = sorted(map(tuple, ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()))
        for a, b in zip(got, want, strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_grams_are_counted_apart_in_training_texts(spark):
    df = spark.createDataFrame([("abab", True), ("ab", False), (None, False)], "t string, training boolean")
    got = {r.gram: (r.n, r.m) for r in ppm.gram_counts(df, "t", 0, "training").collect()}
    assert got == {97: (2, 3), 98: (2, 3), 0xFF: (1, 3)}


def test_score_beats_base_on_held_out(spark):
    got = ppm.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_scores_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Ab ab"), (None, "Ab ab"), (7, " \t\n"), (8, "zz " * 3000), (9, "\xff é")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    got = sorted(map(tuple, ppm.score_documents(df).collect()), key=repr)
    want = sorted(brute_scores(rows), key=repr)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert ppm.score_documents(df.limit(0)).count() == 0
    alone = ppm.score_documents(df.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 for r in alone)


def test_trie_limits_keep_shorter_contexts(spark):
    df = spark.createDataFrame([("abracadabra " * 3,), ("banana bandana",)], "t string")
    nodes = ppm.trie_nodes(ppm.gram_counts(df, "t", 3), 3).cache()
    least = ppm.node_limits(nodes, 40, 3)
    assert least == sorted(least) and sum(r.n >= least[r.k] for r in nodes.collect()) <= 40
    trie = ppm.train(df, "t", 3, 40)
    trie.table()
    grams = next(ppm._stretches(pa.array(["abx bana"]), 3))[2]
    assert np.isfinite(trie.score(grams)).all() and (trie.score(grams) < 0).all()
    # Over all bytes the probabilities after a context add up to at most one.
    context = grams[4] & ~np.uint64(255)
    assert 0.5 < (10 ** trie.score(context | np.arange(256, dtype=np.uint64))).sum() <= 1 + 1e-9
