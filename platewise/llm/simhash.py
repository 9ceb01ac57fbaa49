"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import FOLD_BYTES, batches, shared
from .components import connected_components

BITS, DISTANCE = 64, 2
#: Two differing bits over two segments: one of the segments differs by one bit at most.
SEGMENTS = DISTANCE // 2 + 1
WIDTH = BITS // SEGMENTS
#: Fingerprints under one variant that are compared with each other; larger groups are linked through shared one-bit neighbours.
COMPARED = 256
SEED = 42


def shingles(text: bytes, width: int) -> list[bytes]:
    words = text.translate(FOLD_BYTES).split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [line[a:b - 1] for a, b in zip(starts, ends[width - 1:])]


def fingerprint(text: bytes, width: int = 3) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words: 0."""
    parts = shingles(text, width)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(parts), 16384):
        hashes = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts[at:at + 16384]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(parts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            values = [fingerprint((t or "").encode(), width) for t in batch.column(1).to_pylist()]
            bits = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long")


def variants(classes: DataFrame) -> DataFrame:
    """key, fp, rep: for each segment and each of its bits, the segment with that bit blanked."""
    def key(j: Column) -> Column:
        segment, bit = F.floor(j / WIDTH).cast("int"), (j % WIDTH).cast("int")
        value = F.call_function("shiftrightunsigned", F.col("fp"), segment * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
        blank = value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
        return F.call_function("shiftleft", j.cast("long"), F.lit(WIDTH)).bitwiseOR(blank)

    return classes.select("fp", "rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), key)).alias("key"))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the pairs (a, b), as links of each node to the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: links (a, b) between verified members of small groups; members of large groups as
    (rep, null, fp).  Keeps at most one batch and one small group in memory."""
    def out(a, b, fp):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(fp, pa.int64())], names=["a", "b", "fp"])

    def hot(fp, rep):
        return out(rep, pa.nulls(len(rep), pa.int64()), fp)

    key = fp = rep = np.zeros(0, np.int64)
    large = None  # the key of a large group that goes on
    for batch in it:
        key, fp, rep = (np.concatenate([old, batch.column(n).to_numpy(zero_copy_only=False)]) for old, n in ((key, 0), (fp, 1), (rep, 2)))
        if large is not None:
            n = int(np.searchsorted(key, large, side="right"))
            if n:
                yield hot(fp[:n], rep[:n])
                key, fp, rep = key[n:], fp[n:], rep[n:]
            if not len(key):
                continue
            large = None
        last = int(np.searchsorted(key, key[-1], side="left"))
        if len(key) - last > COMPARED:
            large, last = key[-1], len(key)
        yield from _groups(key[:last], fp[:last], rep[:last], out, hot)
        key, fp, rep = key[last:], fp[last:], rep[last:]
    if len(key):
        yield from _groups(key, fp, rep, out, hot)


def _groups(key, fp, rep, out, hot):
    if not len(key):
        return
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    many = np.repeat(size > COMPARED, size)
    if many.any():
        yield hot(fp[many], rep[many])
    keep = ~many & np.repeat(size > 1, size)
    if not keep.any():
        return
    key, fp, rep = key[keep], fp[keep].view(np.uint64), rep[keep]
    found = []
    step, at = 1, np.arange(len(key) - 1)
    while len(at):
        at = at[key[at] == key[at + step]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= DISTANCE]
        found.append((rep[near], rep[near + step]))
        step += 1
        at = at[at + step < len(key)]
    a, b = (np.concatenate(x) for x in zip(*found))
    if len(a):
        a, b = _stars(a, b)
        yield out(a, b, pa.nulls(len(a), pa.int64()))


def links(classes: DataFrame) -> DataFrame:
    """a, b: links between representatives that keep every component of fingerprints at two or fewer differing bits.

    Rows of one variant meet by equality.  Up to 256 distinct fingerprints under a variant are verified against
    each other inside the task.  Of larger groups every member is put under itself and its 64 one-bit neighbours:
    two fingerprints at two or fewer differing bits share one of these, and all that share one are that near, so
    each shared neighbour (at most 65 members) is a star of true links and needs no comparison.
    """
    found = shared(variants(classes).select("key", "fp", "rep").repartition("key").sortWithinPartitions("key")
                   .mapInArrow(_links, "a long, b long, fp long"), "simhash-links")
    flip = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda j: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))
    large = found.where("b is null").select(F.col("a").alias("rep"), "fp").distinct()
    under = large.select("rep", F.explode(F.concat(F.array("fp"), flip)).alias("z"))
    star = under.groupBy("z").agg(F.sort_array(F.collect_set("rep")).alias("reps")).where(F.size("reps") > 1)  # 65 at most
    near = star.select(F.element_at("reps", 1).alias("b"), F.explode("reps").alias("a")).where("a <> b").select("a", "b").distinct()
    return found.where("b is not null").select("a", "b").unionByName(near)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over fingerprints that differ in
    two or fewer bits, itself included) for every row.

    Equal fingerprints are one class from the start, so copies are never paired.  Null, empty and blank texts have
    fingerprint zero and are linked like others; texts shorter than a shingle are one shingle.  Rows with a null
    doc_id get the component of their fingerprint (null if all its rows have none).  Repeated rows repeat in the
    result.  An empty table gives no rows.
    """
    prints = shared(fingerprints(docs, doc_id, text, width), "simhash-prints")
    classes = shared(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    groups = connected_components(links(classes.where("rep is not null")))
    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("__fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("__fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
