"""Near copies by resemblance: SimHash links, and for what SimHash cannot reach, pairs by min-hashed shingles, compared exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batches, shared
from .components import connected_components
from .simhash import SEED, _stars, fingerprint, links, shingles

#: Words in a shingle and the least share of common shingles of near copies.
WIDTH, RESEMBLANCE = 5, 0.8
#: Least hashes per text, by bins of the hash range, and how many of them make a band.
BINS, ROWS = 128, 5
#: Members of bands up to this size are all paired; those of larger bands with the smallest key of the band first, see `crossing`.
PAIRED = 16
#: Members of one side of a block of a large band, and pairs of two components that are compared in the first round of `joined`.
BLOCK, FIRST = 512, 16
#: From so many shingles on, sketches that agree in less than SIEVE of their places are not compared exactly: over four standard errors.
LONG, SIEVE = 256, 0.6


def hashed(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The hashes of the distinct shingles, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(p, SEED) for p in shingles(text, width)], np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin of the hash range, 16 bits each; an empty bin takes the next full one's, changed by the
    distance.  Equal places of two sketches are as frequent as common shingles.  No words: all zero."""
    if not len(hashes):
        return np.zeros(BINS, np.uint16)
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    full, first = np.unique(bins, return_index=True)
    least = (hashes[first] >> np.uint64(20)) & np.uint64(0xFFFF)
    at = np.searchsorted(full, np.arange(BINS))
    step = np.where(at < len(full), full[at % len(full)], full[0] + BINS) - np.arange(BINS)
    return ((least[at % len(full)] + step.astype(np.uint64) * np.uint64(40503)) & np.uint64(0xFFFF)).astype(np.uint16)


def _prints(docs: DataFrame, doc_id: str, text: str, width: int, whole: bool = False) -> DataFrame:
    """doc_id, fp, digest and size of the set of shingles, and its sketch or, if `whole`, all its hashes as an array."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 64 if whole else 1024):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            sets = [hashed(t, width) for t in texts]
            bits = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            digests = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            shown = pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())) if whole else pa.array([sketch(h).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits), pa.array(digests), pa.array([len(h) for h in sets], pa.int32()), shown],
                                             names=["doc_id", "fp", "digest", "size", "sketch"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long, digest long, size int, sketch {'array<bigint>' if whole else 'binary'}").withColumn("key", F.xxhash64("fp", "digest"))


def banded(classes: DataFrame) -> DataFrame:
    """band, i, key, low, n: the bands of every class that more than one class is in, with the band's smallest key and its size."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BINS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = shared(classes.select("key", F.posexplode(keys).alias("i", "band")), "sketch-bands")
    least = bands.groupBy("band").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("of"), "low", "n")
    return shared(bands.join(least, F.col("band") == F.col("of")).select("band", "i", "key", "low", "n"), "sketch-met")


def proposed(classes: DataFrame, met: DataFrame, resemblance: float = RESEMBLANCE) -> DataFrame:
    """a, b: keys of classes (key, size, sketch) that share a band (see `banded`) and whose sizes and sketches do not rule `resemblance` out.

    The members of a small band are all paired.  Those of a large one are paired with its smallest key: the minimum is aggregated
    before the shuffle and met in a join that Spark may split, so that a band of many near copies gives as many
    pairs as it has members and gathers nowhere.  The other pairs of a large band are left to `crossing`.
    """
    small = met.where(F.col("n") <= PAIRED).groupBy("band").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    small = small.select("keys", F.posexplode("keys").alias("i", "b")).select(F.explode(F.slice("keys", F.col("i") + 2, F.lit(PAIRED))).alias("a"), "b")
    pairs = met.where((F.col("n") > PAIRED) & (F.col("key") != F.col("low"))).select(F.col("key").alias("a"), F.col("low").alias("b")).unionByName(small).distinct()
    full = (pairs.join(classes.select(F.col("key").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("p")), "a")
            .join(classes.select(F.col("key").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("q")), "b")
            .where(F.least("p", "q") / F.greatest("p", "q") >= resemblance).select("a", "b", "x", "y", F.least("p", "q").alias("size")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 4096):
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BINS) for k in (2, 3))
            near = np.flatnonzero(((x == y).mean(axis=1) >= min(SIEVE, resemblance - 0.2)) | (batch.column(4).to_numpy() < LONG))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(near)), batch.column(1).take(pa.array(near))], names=["a", "b"])

    return full.mapInArrow(run, "a long, b long")


def opened(met: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the large bands that hold more than one component (`placed`: key, component): band, i, key, component of their members, and
    band, main (the largest component), nl, nr: blocks of the members outside it and of all."""
    rows = met.where(F.col("n") > PAIRED).select("band", "i", "key").join(placed, "key")
    parts = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"))
    blocks = (parts.groupBy("band").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("parts"))
              .where("parts > 1").select("band", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("nl"), F.ceil(F.col("all") / BLOCK).alias("nr")))
    return rows, blocks


def _common(x: pa.ChunkedArray, y: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """For each array of x the number of values that it has in common with each array of y; values of an array are distinct."""
    values = [np.concatenate([np.zeros(0, np.int64), *(c.values.to_numpy()[c.offsets[0].as_py():c.offsets[-1].as_py()] for c in side.chunks)]) for side in (x, y)]
    sizes = [pa.compute.list_value_length(side).to_numpy() for side in (x, y)]
    order = np.argsort(values[1], kind="stable")
    of, held = np.repeat(np.arange(len(y)), sizes[1])[order], values[1][order]
    lo, hi = np.searchsorted(held, values[0]), np.searchsorted(held, values[0], "right")
    ends = np.r_[0, np.cumsum(sizes[0])]
    for k in range(len(x)):
        first, many = lo[ends[k]:ends[k + 1]], (hi - lo)[ends[k]:ends[k + 1]]
        at = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        yield np.bincount(of[at], minlength=len(y))


def crossing(classes: DataFrame, met: DataFrame, placed: DataFrame, resemblance: float = RESEMBLANCE, sets: DataFrame | None = None) -> DataFrame:
    """a, b, sure: the pairs of members of a large band that are in different components so far (`placed`: key, component) and that sizes and
    sketches do not rule out.  Pairs within a component are settled, so the members outside a band's largest component meet all
    its members, in blocks of about BLOCK by BLOCK; a pair counts in the first band that it shares.

    With `sets` (key, hashes: distinct) the pairs that have theirs and that sketches say nothing of, being short, are compared
    exactly in the block, which gives fewer links than it has components, `sure`: a band of many texts that are unlike each other but for
    a passage gives none, however many pairs it has."""
    rows, open_ = opened(met, placed)
    full = rows.join(open_, "band").join(classes.select("key", "size", "sketch"), "key")
    full = full.withColumn("hashes", F.lit(None).cast("array<bigint>")) if sets is None else full.join(sets.select("key", "hashes"), "key", "left")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    chunk = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    columns = ["band", "i", "key", "component", "size", "sketch", "hashes", (F.col("component") == F.col("main")).alias("major")]
    left = full.where("component != main").select(*columns, F.lit(True).alias("left"), chunk("nl").alias("c"), upto("nr").alias("d"))
    right = full.select(*columns, F.lit(False).alias("left"), upto("nl").alias("c"), chunk("nr").alias("d"))

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.filter(side) for side in (table.column("left"), pa.compute.invert(table.column("left"))))
        keys, parts, sizes = ([t.column(c).to_numpy() for t in (x, y)] for c in ("key", "component", "size"))
        marks = [np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, BINS) for t in (x, y)]
        held = [t.column("hashes").is_valid().to_numpy() for t in (x, y)]
        major, band = y.column("major").to_numpy(), table.column("i")[0].as_py()
        found, sure = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        names, code = np.unique(np.concatenate(parts), return_inverse=True)
        of = code[:x.num_rows], code[x.num_rows:]
        mine, theirs = (np.flatnonzero(h) for h in held)
        for k, common in zip(mine.tolist(), _common(*(t.column("hashes").filter(pa.array(h)) for t, h in zip((x, y), held)))):
            both = np.maximum(1, sizes[0][k] + sizes[1][theirs] - common)
            alike = theirs[(np.minimum(sizes[0][k], sizes[1][theirs]) < LONG) & (common / both >= resemblance) & (of[1][theirs] != of[0][k])]
            near = np.unique(of[1][alike])
            sure.append(np.stack([np.full(len(near), of[0][k]), near], axis=1))
        for k in range(x.num_rows):
            small = np.minimum(sizes[0][k], sizes[1])
            at = np.flatnonzero((of[0][k] != of[1]) & (major | (keys[0][k] > keys[1])) & (small / np.maximum(sizes[0][k], sizes[1]) >= resemblance)
                                & ~(held[0][k] & held[1] & (small < LONG)))
            if not len(at):
                continue
            same = marks[0][k] == marks[1][at]
            whole = same[:, :BINS // ROWS * ROWS].reshape(-1, BINS // ROWS, ROWS).all(axis=2)
            near = at[(whole.argmax(axis=1) == band) & ((same.mean(axis=1) >= min(SIEVE, resemblance - 0.2)) | (small[at] < LONG))]
            found.append(np.stack([np.full(len(near), keys[0][k]), keys[1][near]], axis=1))
        pairs, linked = np.concatenate(found), np.concatenate(sure)
        some = np.zeros(len(names), np.int64)  # a member of every component
        some[of[1]], some[of[0]] = keys[1], keys[0]
        links_ = np.stack(_stars(linked[:, 0], linked[:, 1]), axis=1) if len(linked) else linked
        pairs = np.concatenate([pairs, some[links_]])
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "sure": np.arange(len(pairs)) >= len(pairs) - len(links_)})

    return left.unionByName(right).groupBy("band", "c", "d").applyInArrow(run, "a long, b long, sure boolean")


def verified(pairs: DataFrame, sets: DataFrame, resemblance: float = RESEMBLANCE) -> DataFrame:
    """Those of the pairs a, b of keys whose sets (key, hashes: distinct) have a Jaccard of `resemblance` or more."""
    full = (pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return full.where(common / F.greatest(F.lit(1), F.size("x") + F.size("y") - common) >= resemblance).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))


def _sets(docs: DataFrame, doc_id: str, text: str, width: int, keys: DataFrame, known: DataFrame) -> DataFrame:
    """key, hashes of the classes in `keys`, taken anew from the texts of one document each."""
    wanted = shared(keys.distinct().join(known.select("key", "rep"), "key"), "copies-wanted")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    return shared(_prints(texts, "id", "t", width, whole=True).join(wanted.select("key"), "key", "left_semi")
                  .dropDuplicates(["key"]).select("key", F.col("sketch").alias("hashes")), "copies-sets")


def joined(pairs: DataFrame, sets: DataFrame, placed: DataFrame, resemblance: float = RESEMBLANCE) -> DataFrame | None:
    """node, component: the components of `placed` (key, component) that links among the pairs a, b join; None if there are none.

    All pairs whose ends are not in one component by then are compared exactly, a few of every two components at first, then
    64 times as many: most components that belong together are found so with few comparisons."""
    moved, many = None, FIRST
    at = lambda c: placed.select(F.col("key").alias(c), F.col("component").alias(f"p{c}"))
    rest = shared(pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.least("pa", "pb").alias("p"), F.greatest("pa", "pb").alias("q")).where("p != q"), "copies-rest")
    while rest.limit(1).count():
        sizes = rest.groupBy("p", "q").agg(F.count(F.lit(1)).alias("m"))
        rest = shared(rest.join(sizes, ["p", "q"]).withColumn("now", F.pmod(F.xxhash64("a", "b"), F.col("m")) < many), "copies-round")
        links_ = connected_components(verified(rest.where("now"), sets, resemblance).join(rest, ["a", "b"]).select(F.col("q").alias("a"), F.col("p").alias("b")))
        links_ = shared(links_, "copies-moved")
        to = lambda c: F.coalesce(f"_{c}", c).alias(c)
        name = lambda c: links_.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        rest = rest.where("not now").select("a", "b", "p", "q").join(name("p"), "p", "left").join(name("q"), "q", "left").select("a", "b", to("p"), to("q"))
        rest = shared(rest.where("p != q").select("a", "b", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")), "copies-rest")
        if moved is None:
            moved = links_
        else:  # what moved before moves on
            then = moved.withColumnRenamed("component", "p").join(name("p"), "p", "left").select("node", to("p")).withColumnRenamed("p", "component")
            moved = shared(then.unionByName(links_.join(moved.select("node"), "node", "left_anti")), "copies-moved")
        many *= 64
    return moved


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, resemblance: float = RESEMBLANCE) -> DataFrame:
    """doc_id, component_id of every row: near copies at a resemblance of `resemblance` or more over word shingles.

    Fingerprints at two or fewer differing bits are linked by deletion variants.  Texts that share eight of ten
    shingles differ in about nine of 64 bits, more than any two segments with one wildcard can bridge, so they
    are proposed by bands of least hashes; the members of large bands meet the band's smallest key first and then all
    members that are in other components.  A proposed pair is accepted by the Jaccard of all its shingles, which
    are taken anew from the texts of proposed classes only.

    Null, empty and blank texts are copies of each other.  Rows with a null doc_id take part, under the smallest
    doc_id of their group if there is one.  Repeated rows repeat; an empty table gives no rows.
    """
    prints = shared(_prints(docs, doc_id, text, width), "copies-prints")
    # A class has one set of shingles and one fingerprint; the classes of one fingerprint are copies as well.
    classes = shared(prints.groupBy("key").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "copies-classes")
    firsts = classes.groupBy("fp").agg(F.min("rep").alias("rep"))
    known = classes.where("rep is not null")
    met = banded(known)
    pairs = shared(proposed(known, met, resemblance), "copies-pairs")
    sets = _sets(docs, doc_id, text, width, _ends(pairs), known)
    rep = lambda c: known.select(F.col("key").alias(c), F.col("rep").alias(f"rep_{c}"))
    near = verified(pairs, sets, resemblance).join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    alike = known.select("fp", F.col("rep").alias("a")).join(firsts.select("fp", F.col("rep").alias("b")), "fp").select("a", "b")
    groups = connected_components(links(firsts.where("rep is not null")).unionByName(near.unionByName(alike).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    named = firsts.join(groups, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "rep").alias("component_id"))
    if met.where(F.col("n") > PAIRED).limit(1).count():
        named = shared(named, "copies-named")
        placed = shared(known.join(named, F.col("fp") == F.col("__fp")).select("key", F.col("component_id").alias("component")), "copies-placed")
        rows, blocks = opened(met, placed)
        short = known.where(F.col("size") <= LONG / resemblance).select("key").join(rows.join(blocks, "band").select("key"), "key", "left_semi")
        more = shared(crossing(known, met, placed, resemblance, _sets(docs, doc_id, text, width, short, known)), "copies-crossing")
        named = named.withColumnRenamed("component_id", "component")
        at = lambda c: placed.select(F.col("key").alias(c), F.col("component").alias(f"p{c}"))
        sure = shared(more.where("sure").select("a", "b").join(at("a"), "a").join(at("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "copies-sure")
        if sure.limit(1).count():
            moved = shared(connected_components(sure), "copies-moved").withColumnRenamed("component", "_to")
            named, placed = (shared(df.join(moved, F.col("component") == F.col("node"), "left").select(df.columns[0], F.coalesce("_to", "component").alias("component")), "copies-placed")
                             for df in (named, placed))
        rest = more.where("not sure").select("a", "b")
        moved = joined(rest, _sets(docs, doc_id, text, width, _ends(rest), known), placed, resemblance) if rest.limit(1).count() else None
        if moved is not None:
            moved = moved.withColumnRenamed("component", "_to")
            named = named.join(moved, F.col("component") == F.col("node"), "left").select("__fp", F.coalesce("_to", "component").alias("component"))
        named = named.withColumnRenamed("component", "component_id")
    return prints.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, resemblance: float = RESEMBLANCE) -> DataFrame:
    """The documents with the smallest doc_id of each group, all columns; of repeated rows of one doc_id one stays, and
    rows without a doc_id stay."""
    first = near_copies(docs, doc_id, text, width, resemblance).where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(first, F.col(doc_id) == F.col("__keep")).drop("__keep")
    return named.dropDuplicates([doc_id]).unionByName(docs.where(F.col(doc_id).isNull()))
