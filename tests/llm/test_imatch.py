import collections
import hashlib

import pytest

from platewise.llm import imatch
from platewise.llm.queries import QUERIES

BASE = "/root/testdata/sf0.001"


def brute(rows):
    rows = sorted(rows)
    df = collections.Counter(w for _, t in rows for w in imatch.terms(t))
    n = len(rows)
    words = sorted(w for w, c in df.items() if max(2, n / 4000) <= c <= max(2, n / 20))
    printer = imatch.Printer(words)
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % n][1]
        q = len(t) // 4
        new = t[:len(t) - q] + after[:q]
        a, b, c = (printer.fingerprint(x) for x in (t, new, after))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, imatch.likeness(a, b), imatch.likeness(a, c)))
    return out


def test_fingerprints_equal_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op6_document_fingerprints"](spark, BASE).collect())
    assert got == brute(rows)
    by = collections.defaultdict(set)
    for g, (_, t) in zip(got, sorted(rows)):
        by[t].add(g[3])
    assert all(len(p) == 1 for p in by.values())
    assert sum(g[5] for g in got) / len(got) > 0.3 > 0.1 > sum(g[6] for g in got) / len(got)


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_rows(spark, parts):
    rows = [(4, None, "a"), (1, "", "b"), (None, "first Text of all", "c"), (9, "x " * 40000, None), (9, "x " * 40000, None), (12, "éü 漢字 " * 9, "d"), (7, "ab", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(parts)
    got = sorted((tuple(r) for r in imatch.fingerprints(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(-1 if d is None else d, t or "") for d, t, _ in rows]
    assert [(-1 if r[0] is None else r[0], *r[1:3]) for r in got] == [w[:3] for w in brute(want)]
    assert got[-2][3] == got[-3][3] and all(0 <= v <= 1 for r in got for v in r[5:])
    assert imatch.fingerprints(docs.limit(0)).count() == 0
    one = imatch.fingerprints(docs.where("doc_id = 12")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_likeness():
    printer = imatch.Printer([])
    a, b = printer.fingerprint("some words here"), printer.fingerprint("other things there")
    assert imatch.likeness(a, a) == 1 and imatch.likeness(a, b) < 0.2 and imatch.likeness(printer.fingerprint(""), a) == 0
    assert imatch.edited("abcdefgh", "xyz") == "abcdefxy" and imatch.edited("abcd", "") == "abc" and imatch.edited("", "x") == ""
