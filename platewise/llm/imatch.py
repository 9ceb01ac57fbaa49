"""Document fingerprints by I-Match over randomised lexicon subsets."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import FOLD_BYTES, batches, shared

#: Terms are kept whose document frequency is a share of all documents in this band: an inverse document frequency of
#: ln 20 to ln 4000.  A lexicon has no more terms than 4000 times the mean number of distinct terms of a document.
RAREST, COMMONEST = 1 / 4000, 1 / 20
#: Subsets per level, and on average one term in so many is in a subset of each level: for short, usual and long texts.
SUBSETS, LEVELS = 32, (32, 256, 2048)
#: A level is compared if so many of its subsets hold terms; the sparsest such level is taken.
FILLED = 8
DIGITS = 3
_EMPTY = "-" * DIGITS
_HEX = [f"{k:0{DIGITS}x}" for k in range(16**DIGITS)]


def terms(text: str) -> set[bytes]:
    return set(text.encode().translate(FOLD_BYTES).split())


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, n over whole texts, and the number of documents under the null term; summed up in the tasks first."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

        seen: Counter = Counter()
        for batch in batches(it, 256):
            for t in batch.column(0).to_pylist():
                seen.update(terms(t or ""))
            seen[None] += batch.num_rows
            if len(seen) > 1_000_000:
                yield out()
                seen = Counter()
        yield out()

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> list[bytes]:
    """The terms of the band, sorted.  Terms of one document only are never in it."""
    counted = shared(document_frequencies(docs, text), "imatch-terms")
    total = counted.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = counted.where(F.col("term").isNotNull() & (F.col("n") >= max(2, rarest * total)) & (F.col("n") <= max(2, commonest * total)))
    return sorted(kept.select("term").toArrow().column("term").to_pylist())


class Printer:
    """Fingerprints by one lexicon: for each level and subset the digits of a hash over the document's terms in it."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.place = None

    def __getstate__(self):
        return {"words": self.words, "place": None}

    def _ready(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}
        hashes = np.array([xxhash.xxh64_intdigest(w, 11) for w in self.words], np.uint64)
        self.hash = hashes
        # Independent draws per level; a subset's number is the draw if it is below SUBSETS.
        self.subset = np.array([[xxhash.xxh32_intdigest(w, level) % level for level in LEVELS] for w in self.words], np.int64).reshape(-1, len(LEVELS))

    def fingerprint(self, text: str) -> str:
        """Terms of the band, or all terms where none is in it, so that such texts differ; empty texts: all empty."""
        if self.place is None:
            self._ready()
        place, all_ = self.place, terms(text)
        at = np.sort(np.array([i for i in map(place.get, all_) if i is not None], np.int64))
        if len(at):
            hashes, subset = self.hash[at], self.subset[at]
        else:
            found = sorted(all_)
            hashes = np.array([xxhash.xxh64_intdigest(w, 11) for w in found], np.uint64)
            subset = np.array([[xxhash.xxh32_intdigest(w, level) % level for level in LEVELS] for w in found], np.int64).reshape(-1, len(LEVELS))
        digits = [_EMPTY] * (len(LEVELS) * SUBSETS)
        level, term = np.nonzero(subset.T < SUBSETS)
        which = level * SUBSETS + subset[term, level]
        order = np.argsort(which, kind="stable")  # terms stay sorted inside a subset
        which, data = which[order], hashes[term[order]].tobytes()
        start = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else which
        ends = [*start[1:].tolist(), len(which)]
        for k, lo, hi in zip(which[start].tolist(), start.tolist(), ends):
            digits[k] = _HEX[xxhash.xxh64_intdigest(data[8 * lo:8 * hi], k) % len(_HEX)]
        return "".join(digits)


def likeness(a: str, b: str) -> float:
    """The share of equal subsets among those that hold terms in either, at the sparsest level that is filled enough.
    Equal fingerprints: 1."""
    if a == b:
        return 1.0
    size = SUBSETS * DIGITS
    for level in range(len(LEVELS) - 1, -1, -1):
        pairs = [(a[k:k + DIGITS], b[k:k + DIGITS]) for k in range(level * size, (level + 1) * size, DIGITS)]
        pairs = [p for p in pairs if p != (_EMPTY, _EMPTY)]
        if len(pairs) >= FILLED or (level == 0 and pairs):
            return sum(x == y for x, y in pairs) / len(pairs)
    return 0.0


def edited(text: str, after: str) -> str:
    """The text with its last quarter (rounded down) replaced by the first as many code points of the next one, or all."""
    n = len(text) // 4
    return text[:len(text) - n] + after[:n]


def _bounds(docs: DataFrame, doc_id: str, ranges: int) -> list:
    """The least doc_id of each range, by a range partitioning of the ids alone, so that no text is read for them.
    Their count is given, or small ids would be put into one range."""
    ids = docs.select(F.col(doc_id).alias("i")).where("i is not null").repartitionByRange(ranges, F.col("i"))
    return [r.low for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("i").alias("low")).orderBy("low").collect()]  # a row per range


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is that of the next doc_id (null first, repeated ones by the hash of the text), after the last
    the first.  Texts are compressed, dealt into ranges of doc_id and read in order; only the first and the
    last document of each range meet their neighbours in a join.

    Null texts are empty; empty texts have a fingerprint without terms.  A single document is its own next one.  An
    empty table gives no rows.
    """
    words = docs.sparkSession.sparkContext.broadcast(Printer(lexicon(docs, text, rarest, commonest)))
    parts = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(docs, doc_id, 4 * parts)  # several small ranges a task even out what hashing them deals unevenly
    kind = docs.schema[doc_id].dataType.simpleString()

    def squeeze(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3).compress
        for batch in batches(it):
            bucket = [0 if d is None else bisect_right(bounds, d) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), batch.column(0), batch.column(1), pa.array([small((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())],
                                             names=["bucket", "tie", "doc_id", "body"])

    packed = docs.select(F.xxhash64(F.col(text).cast("string")).alias("tie"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(
        squeeze, f"bucket int, tie long, doc_id {kind}, body binary")
    order = [F.col("bucket"), F.col("doc_id").asc_nulls_first(), F.col("tie")]

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    done_type = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finish(doc, text_, print_, after, print_after):
        new = edited(text_, after)
        new_print = words.value.fingerprint(new)
        return (doc, len(text_), hashlib.sha256(new.encode()).hexdigest(), print_, new_print, likeness(print_, new_print), likeness(print_, print_after))

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows, and for each bucket its first and last document with their texts (edge 1 and 2)."""
        expand, printer = zstandard.ZstdDecompressor().decompress, words.value
        held = id_type = None
        for batch in batches(it, 256):
            rows, id_type = [], batch.column(2).type
            for bucket, doc, body in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                text_ = expand(body).decode()
                now = (bucket, doc.as_py(), text_, printer.fingerprint(text_), body)
                if held is None or held[0] != bucket:
                    if held is not None:
                        rows.append((held[0], 2, held[4], held[1], None, None, held[3], None, None, None))
                    rows.append((bucket, 1, body, now[1], None, None, now[3], None, None, None))
                else:
                    rows.append((bucket, 0, None, *finish(held[1], held[2], held[3], text_, now[3])))
                held = now
            yield _table(rows, id_type)
        if held is not None:
            yield _table([(held[0], 2, held[4], held[1], None, None, held[3], None, None, None)], id_type)

    def _table(rows, id_type):
        columns_ = list(zip(*rows)) if rows else [()] * 10
        types = [pa.int32(), pa.int32(), pa.binary(), id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, types)], names=["bucket", "edge", "body", *columns])

    rows = shared(packed.repartition(parts, "bucket").sortWithinPartitions(*order).mapInArrow(walk, f"bucket int, edge int, body binary, {done_type}"), "imatch-rows")
    # One first and one last document per bucket: each last one meets the first of the next bucket that has rows.
    first = rows.where("edge = 1").select(F.col("bucket").alias("at"), F.col("body").alias("after"), F.col("fingerprint").alias("print_after"))
    ring = first.select("at").withColumn("next", F.coalesce(F.lead("at").over(W.orderBy("at")), F.min("at").over(W.partitionBy(F.lit(0)))))
    last = (rows.where("edge = 2").join(ring, F.col("bucket") == F.col("at")).drop("at").join(first, F.col("next") == F.col("at"))
            .select("doc_id", "body", "fingerprint", "after", "print_after"))

    def close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches(it, 64):
            out = [finish(d, expand(a).decode(), p, expand(b).decode(), q) for d, a, p, b, q in zip(*(c.to_pylist() for c in batch.columns))]
            types = [batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=columns)

    return rows.where("edge = 0").select(*columns).unionByName(last.mapInArrow(close, done_type))
