"""Ranked lexical search by one automaton of all item terms that runs over the texts; no index of the documents.

Two passes: the first adds up the collection's figures (documents, terms, documents per item term), the second
scores every document for every item and keeps each task's best.  Only counts and the best go over the network.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import batches, binary_views

#: Items are met in blocks of about this many items and bytes of text at most, each with an automaton of its own; one item
#: is never cut.  That bounds what tasks hold and what is broadcast, however many items there are.
ITEMS, ITEM_BYTES = 500, 1 << 20
#: Terms whose items are laid out as a table at a time.
TERMS = 4096
#: Term bytes: digits, letters and all bytes of other characters; A-Z become a-z, the rest becomes a blank.
_TERM = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
FOLDED = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM else 32 for b in range(256))
_IS_TERM = np.isin(np.arange(256), np.frombuffer(_TERM, np.uint8))
_BUILT: dict[str, "Matcher"] = {}


def terms_of(text: str | None) -> list[str]:
    """Terms of a text in order, each byte of its UTF-8 as one character."""
    return [t.decode("latin-1") for t in (text or "").encode().translate(FOLDED).split()]


class Matcher:
    """Finds the terms of a block of items.  `postings`: for each term the places of its items."""

    def __init__(self, terms: list[str], postings: list[list[int]], n_items: int):
        self.size, self.n_items = len(terms), n_items
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):  # blanks guard both ends, so that only whole terms match
            self.automaton.add_word(f" {term} ", k)
        if terms:
            self.automaton.make_automaton()
        self.starts = np.cumsum([0] + [len(p) for p in postings])
        self.items = np.array([i for p in postings for i in p], np.int64)

    def table(self, terms: np.ndarray) -> np.ndarray:
        """Terms by items, 1 where the item holds the term."""
        out = np.zeros((len(terms), self.n_items))
        for row, t in enumerate(terms):
            out[row, self.items[self.starts[t]:self.starts[t + 1]]] = 1
        return out

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each text, and (text, term, occurrences) of the item terms in them."""
        offsets, data = binary_views(column)
        at, data = offsets - offsets[0], data[offsets[0]:offsets[-1]]
        word = _IS_TERM[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        first = at[:-1][at[:-1] < at[1:]]
        begins[first] = word[first]
        before = np.concatenate([[0], np.cumsum(begins)])
        n = before[at[1:]] - before[at[:-1]]
        plain = data.tobytes().translate(FOLDED).decode("latin-1")
        rows, cols, times = [], [], []
        if self.size:
            find, second = self.automaton.iter, itemgetter(1)
            for r in np.flatnonzero(n):
                found = Counter(map(second, find(f" {plain[at[r]:at[r + 1]]} ")))
                rows.append(np.full(len(found), r))
                cols.append(np.fromiter(found.keys(), np.int64, len(found)))
                times.append(np.fromiter(found.values(), np.int64, len(found)))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return n, join(rows), join(cols), join(times)


def _matcher(name: str, block) -> Matcher:
    """One per worker and block."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(*block.value)
    return _BUILT[name]


class Best:
    """The k highest scores of each item, equal ones by ascending id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]

    def take(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.floor)
        if not len(doc):
            return
        item, score, i, none = (np.concatenate(x) for x in zip(self.rows, (item, scores[doc, item], ids[doc], nulls[doc])))
        order = np.lexsort((i, none, -score, item))
        item = item[order]
        keep = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        self.rows = [item[keep], *(x[order][keep] for x in (score, i, none))]
        item, score = self.rows[:2]
        full = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == self.k - 1)
        self.floor[item[full]] = score[full]


def _figures(docs: DataFrame, name: str, block) -> dict[int, int]:
    """Documents that hold each item term; at -1 the documents with a term, at -2 all their terms."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, block)
        held, some, total = np.zeros(matcher.size, np.int64), 0, 0
        for batch in batches(it, 256):
            n, _, cols, _ = matcher.counts(batch.column(1))
            held += np.bincount(cols, minlength=matcher.size)
            some, total = some + int((n > 0).sum()), total + int(n.sum())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at], pa.int32()), pa.array([some, total, *held[at]], pa.int64())], names=["term", "n"])

    return dict(map(tuple, docs.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()))


def _best(docs: DataFrame, name: str, block, ids: pa.Array, kind: str, weights: np.ndarray, some: int, total: int, k: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, block)
        best = Best(matcher.n_items, k)
        whole = matcher.table(np.arange(matcher.size)) if matcher.size <= TERMS else None
        # Sums below 2**53 are exact in doubles; beyond that integers are added, which takes longer.
        most = np.bincount(matcher.items, np.repeat(weights, np.diff(matcher.starts)), matcher.n_items).max(initial=0) * 1e6
        exact = float if most < 2**53 else np.int64
        for batch in batches(it, 256):
            n, rows, cols, times = matcher.counts(batch.column(1))
            m = np.array([10 + 90 * int(x) * some // total if x else 0 for x in n], np.int64)
            part = weights[cols] * (1_000_000_000 * times // (1000 * times + 8 * m[rows]))
            scores = np.zeros((len(n), matcher.n_items), exact)
            seen, place = np.unique(cols, return_inverse=True)
            if whole is not None:
                seen, place = np.arange(matcher.size), cols
            for at in range(0, len(seen), TERMS):
                here = (place >= at) & (place < at + TERMS)
                parts = np.zeros((len(n), min(TERMS, len(seen) - at)), exact)
                parts[rows[here], place[here] - at] = part[here]
                scores += parts @ (matcher.table(seen[at:at + TERMS]) if whole is None else whole).astype(exact, copy=False)
            id_ = batch.column(0).cast(pa.int64())
            best.take(scores.astype(np.int64), id_.fill_null(0).to_numpy(zero_copy_only=False), id_.is_null().to_numpy(zero_copy_only=False))
        item, score, i, none = best.rows
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(item)), pa.array(i, mask=none), pa.array(score)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", most_items: int = ITEMS, most_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item with the highest scores above 0.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.  With N documents that hold a term, L terms
    in all, n terms in a document, df documents that hold a term and tf occurrences: a term weighs
    floor(1000 ln((2N+2)/(2df+1))), m is 10 + 90nN div L, and a document's score is the sum of
    weight * (10^9 tf div (1000 tf + 8m)) over the item's terms, once each.

    Null and empty texts hold no term.  Items without terms, or whose terms no document holds, have no rows.  Rows of items with
    one item_id (null is one, too) are one item with the terms of all of them.  Equal scores stand by
    ascending doc_id, a null doc_id last; repeated rows are documents of their own, with ranks of their own.
    doc_id is an integer.  Other columns are not read.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / most_items), math.ceil(size / most_bytes))
    parts = []
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        groups: dict = {}
        for i, t in zip(held.column(0).to_pylist(), held.column(1).to_pylist()):
            groups.setdefault(i, set()).update(terms_of(t))
        terms = sorted(set().union(*groups.values()))
        place = {t: at for at, t in enumerate(terms)}
        postings: list[list[int]] = [[] for _ in terms]
        for at, own in enumerate(groups.values()):
            for t in own:
                postings[place[t]].append(at)
        name, block = uuid4().hex, spark.sparkContext.broadcast((terms, postings, len(groups)))
        known = _figures(slim, name, block)
        some, total = known.get(-1, 0), known.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * known.get(at, 0) + 1))) for at in range(len(terms))], np.int64)
        parts.append(_best(slim, name, block, pa.array(groups, held.column(0).type), kind, weights, some, total, k))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Tasks' best meet in two steps, so that an item's rows do not grow with the tasks in one place.
    some_best = reduce(DataFrame.unionByName, parts).withColumn("__share", F.spark_partition_id() % 64)
    first = some_best.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "__share").orderBy(*order))).where(F.col("rank") <= k)
    return (first.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
