"""Alignment of two tokenizers against a plain walk over every document."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from platewise.llm import alignment as al
from platewise.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a long, row string, pairs binary"
TEXTS = ["The cat sat on the mat.", "the cat  sat", " leading", "trailing ", "  two  blanks  ", "line\nbreak\ttab\r\n", "", None, "▁ looks like a blank", "naïve café ﬁ ① 𝒳 日本語",
         "<|endoftext|> and </s> <unk> <0x41>", "a\x00b", "same same same", "same same same", "  hard blank", "é combining", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, " ", "   ",
         "word " * 5000 + "end", "1234567890 3.14159"]


@pytest.fixture(scope="module")
def plainly():
    """Both libraries on whole texts, without any memory of words."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    back = {chr(b if b in printable else next(rest)): b for b in range(256)}

    def spell_b(i):
        return bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()

    def rows(docs):
        found, held = [], Counter()
        for i, t in docs:
            a = tok.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
            b = model.encode(t) if t else []
            sa, sb = [bytes(back[c] for c in tok.id_to_token(x)) for x in a], [spell_b(x) for x in b]
            raw = b" " + (t or "").encode()
            if not t or b"".join(sa) != raw or b"".join(sb) != raw:
                a, b, groups = [], [], []
            else:
                ea, eb = np.cumsum([len(x) for x in sa]).tolist(), np.cumsum([len(x) for x in sb]).tolist()
                groups, x, y = [], 0, 0
                for end in sorted(set(ea) & set(eb)):
                    u, v = ea.index(end) + 1, eb.index(end) + 1
                    groups.append((a[x:u], b[y:v]))
                    x, y = u, v
            links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
            held.update(links.keys())
            found.append((i, len(a), len(b), groups, links))
        top = defaultdict(int)
        for (p, _), n in held.items():
            top[p] = max(top[p], n)
        out = []
        for i, na, nb, groups, links in found:
            text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
            out.append((i, na, nb, len(groups), sum(links.values()), sum(n for x, n in links.items() if held[x] == top[x[0]]), sum(n * held[x] for x, n in links.items()),
                        hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return sorted(out, key=repr)
    return rows


def frame(spark, texts, parts=3):
    ids = [None if i == 3 else 5 if i in (4, 5) else i for i in range(len(texts))]
    docs = list(zip(ids, texts))
    return docs, spark.createDataFrame([(i, t, 1, "r", b"p") for i, t in docs], SCHEMA).repartition(parts)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("most", [al.KNOWN, 40, 0])
def test_report_equals_plain_walk(spark, plainly, most):
    """Also when few or no pair counts go to all tasks."""
    docs, df = frame(spark, TEXTS)
    assert result(al.alignment_report(df, A, B, most=most)) == plainly(docs)


def test_small_pieces_of_work(spark, plainly, monkeypatch):
    docs, df = frame(spark, TEXTS, 1)
    monkeypatch.setattr(al, "TOGETHER", 64)
    assert result(al.alignment_report(df, A, B)) == plainly(docs)


def test_query_equals_plain_walk(spark, plainly):
    base = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op12_cross_tokenizer"](spark, base)) == plainly(docs)


def test_detail_gives_ids_and_cuts(spark):
    _, df = frame(spark, TEXTS)
    for r in al.align(df, A, B, detail=True).collect():
        assert (len(r.a_ids), len(r.b_ids), len(r.a_cuts), len(r.b_cuts)) == (r.n_a, r.n_b, r.n_groups, r.n_groups)
        if r.n_a:
            groups = [f"{','.join(map(str, r.a_ids[i:j]))}|{','.join(map(str, r.b_ids[k:m]))}" for i, j, k, m in zip(
                [0, *r.a_cuts], r.a_cuts, [0, *r.b_cuts], r.b_cuts)]
            assert hashlib.sha256(";".join(groups).encode()).hexdigest() == r.groups_sha256


def test_fast_rules_equal_the_file(plainly):
    """Mixed characters, long words and gaps, and texts that only the tokenizers library may encode."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    side = al.Bytewise(A)
    assert side.fast is not None
    rng = np.random.default_rng(11)
    letters = list("abcXYZ019 \t\n\r'\".,-_éÜñß¿·½²×…’—\xa0\u2003\u3000\x85\x1c\u0301日①🙂\u200b") + ["'s", "'ll", "  ", " don't"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)] + ["x" * 5000, " " * 900 + "y", "a b " * 2000]
    for t, ids in zip(texts, side.encode(texts)):
        assert ids.tolist() == tok.encode(" " + t, add_special_tokens=False).ids, repr(t)


def test_empty_table(spark):
    assert al.alignment_report(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_lockstep_equals_common_ends():
    rng = np.random.default_rng(3)
    ends_a, ends_b, at_a, at_b, base = [], [], [0], [0], 0
    for size in rng.integers(1, 400, 60):
        for ends, at in ((ends_a, at_a), (ends_b, at_b)):
            own = np.union1d(rng.integers(1, size + 1, rng.integers(1, size + 1)), [size])
            ends.extend(base + own)
            at.append(len(ends))
        base += size
    ea, eb = np.array(ends_a), np.array(ends_b)
    groups = al.lockstep(ea, eb, np.array(at_a[:-1]), np.array(at_a[1:]), np.array(at_b[:-1]))
    cuts = np.intersect1d(ea, eb)
    a, b = np.array(at_a), np.array(at_b)
    for size, look in ((1, 1), (3, 2), (10, 64), (1024, 64)):
        assert (al.lockstep(ea, eb, *al.lanes(ea, eb, a, b, size, look)) == groups).all()
    assert (ea[groups[1] - 1] == cuts).all() and (eb[groups[3] - 1] == cuts).all()
    assert (groups[0][1:] == groups[1][:-1]).all() and (groups[2][1:] == groups[3][:-1]).all()


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_pairs_in_pieces(most):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, 40), rng.integers(0, 7, 50)
    groups = np.array([[0, 1, 9, 12], [1, 9, 12, 40], [0, 2, 3, 20], [2, 3, 20, 50]])
    doc = np.array([0, 0, 1, 1])
    want = Counter()
    for (a0, a1, b0, b1), d in zip(groups.T, doc):
        for x in a[a0:a1]:
            for y in b[b0:b1]:
                want[(d, x * 7 + y)] += 1
    of, code, n = al.linked_pairs(groups, doc, a, b, 7, most)
    assert dict(zip(zip(of.tolist(), code.tolist()), n.tolist())) == {(int(d), int(c)): v for (d, c), v in want.items()}
    assert al._unpacked(al._packed(code[:3], n[:3], bytes), bytes)[0].tolist() == code[:3].tolist()
