"""Language-model scores: prediction by partial matching over byte contexts, and a word baseline."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import FOLD_BYTES, batches, binary_views, shared

#: Longest context in bytes.
ORDER = 5
#: Grams whose probabilities are known to every task, at most; the others meet theirs in a join.
KNOWN = 4_000_000
#: Grams of a part of the model, about, and the longest contexts that all parts have.
PART, SHORT = 1 << 20, 2
#: Stands before and behind every text; it is no byte of UTF-8.
EDGE = 0xFF
STRETCH = 1 << 22
#: Words whose share of all tokens is at least one in so many are looked up in a table in the task; the table cannot have more rows than this.
COMMON = 1 << 17
_FOLD = np.frombuffer(FOLD_BYTES, np.uint8)
_U = np.uint64


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in five by crc32 of its id as text (null: empty text, in training)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _stretches(column: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, grams): the symbols of whole texts, each as its context and itself in one integer.

    Long texts are taken in stretches that carry their context along; every text ends with EDGE.
    """
    offsets, data = binary_views(column)
    edge = np.full(order, EDGE, np.uint8)
    held, rows, size = [], [], 0
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        body = np.concatenate([edge, _FOLD[data[lo:hi]], edge[:1] if order else np.array([EDGE], np.uint8)])
        for at in range(0, len(body) - order, STRETCH):
            piece = body[at:at + STRETCH + order]
            held.append(piece)
            rows.append(row)
            size += len(piece)
            if size >= STRETCH:
                yield _grams(held, rows, order)
                held, rows, size = [], [], 0
    if held:
        yield _grams(held, rows, order)


def _grams(held: list[np.ndarray], rows: list[int], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate(held)
    grams = np.zeros(len(flat) - order, _U)
    for j in range(order + 1):
        grams <<= _U(8)
        grams |= flat[j:len(flat) - order + j]
    size = np.array([len(h) for h in held])
    keep = np.ones(len(flat), bool)
    for back in range(1, order + 1):
        keep[np.cumsum(size) - back] = False
    return np.array(rows), np.cumsum(size - order) - (size - order), grams[keep[:len(grams)]]


def _combine(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    at = np.argsort(key, kind="stable")
    key, count = key[at], count[at]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[start], np.add.reduceat(count, start) if len(key) else count


def gram_counts(docs: DataFrame, text: str, order: int = ORDER, training: str | None = None) -> DataFrame:
    """gram (long), n: counts of all contexts of the longest order with their next byte; with `training`, a column of truths,
    n counts in its texts and m in all.  Tasks count whole stretches and hand on what they have when it grows, so a task's memory
    is bounded and a common gram leaves it a few times at most."""
    names = ["n"] if training is None else ["n", "m"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, count):
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(c) for c in np.ascontiguousarray(count.T))], names=["gram", *names])

        keys, counts, size, merged = [], [], 0, 0
        for batch in batches(it):
            counted = np.asarray(batch.column(1)) if training else None
            for rows, starts, grams in _stretches(batch.column(0), order):
                mine = np.repeat(counted[rows], np.diff(starts, append=len(grams))) if training else np.ones(len(grams), bool)
                for part, weight in ((grams[mine], [1] * len(names)), (grams[~mine], [0, 1][:len(names)])):
                    key, count = np.unique(part, return_counts=True)
                    keys.append(key)
                    counts.append(count[:, None] * np.array(weight))
                    size += len(key)
                if size > merged + 4_000_000:
                    key, count = _combine(keys, counts)
                    if len(key) > 4_000_000:
                        yield out(key, count)
                        keys, counts, size = [], [], 0
                    else:
                        keys, counts, size = [key], [count], len(key)
                    merged = size
        if keys:
            yield out(*_combine(keys, counts))

    return (docs.select(F.col(text).cast("string").alias("t"), *[training] * (len(names) - 1))
            .mapInArrow(run, ", ".join(["gram long", *(f"{c} long" for c in names)]))
            .groupBy("gram").agg(*[F.sum(c).alias(c) for c in names]))


def trie_nodes(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """k, gram, n for the orders 0 to `order`: a shorter context's counts are the sums over the bytes before it."""
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << (8 * k + 8)) - 1).cast("long")).alias("gram")) for k in range(order + 1)])
    return (grams.select("n", F.explode(levels).alias("e")).groupBy("e.k", "e.gram").agg(F.sum("n").alias("n")))


def node_limits(nodes: DataFrame, most: int, order: int = ORDER) -> list[int]:
    """The least count a node of each order must have so that all fit: the limit of the longest orders is doubled first.
    Limits do not fall with the order, so every node's shorter contexts stay."""
    steps = nodes.groupBy("k", F.floor(F.log2("n")).cast("int").alias("j")).agg(F.count(F.lit(1)).alias("c")).collect()  # 64 rows an order at most
    sizes = [[sum(r["c"] for r in steps if r["k"] == k and r["j"] >= j) for j in range(64)] for k in range(order + 1)]
    least = [0] * (order + 1)
    while sum(sizes[k][least[k]] for k in range(order + 1)) > most:
        k = max(range(order + 1), key=lambda k: (sizes[k][least[k]], k))
        for up in range(k, order + 1):
            least[up] = max(least[up], least[k] + (up == k))
    return [1 << j for j in least]


class Lookup:
    """Numbers by gram: an open hash table of places, made where it is first asked."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        self.grams, self.logs, self.slots = grams, logs, None

    def __getstate__(self):
        return {"grams": self.grams, "logs": self.logs, "slots": None}

    def _fill(self) -> None:
        self.bits = max(4, int(2 * len(self.grams)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        place, at = np.arange(len(self.grams), dtype=np.int32), self._slot(self.grams)
        while len(place):
            free = self.slots[at] < 0
            self.slots[at[free]] = place[free]
            stay = self.slots[at] != place
            place, at = place[stay], (at[stay] + 1) & (len(self.slots) - 1)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The number of each gram, NaN where it is not in the table."""
        if self.slots is None:
            self._fill()
        out = np.full(len(grams), np.nan)
        todo, key, at = np.arange(len(grams)), grams, self._slot(grams)
        while len(todo):
            place = self.slots[at]
            hit = place >= 0
            hit[hit] = self.grams[place[hit]] == key[hit]
            out[todo[hit]] = self.logs[place[hit]]
            on = (place >= 0) & ~hit
            todo, key, at = todo[on], key[on], (at[on] + 1) & (len(self.slots) - 1)
        return out


class Trie:
    """Counts by context and what PPM derives from them.  In a context with n occurrences, of which u by next bytes seen
    once, a byte seen c times has probability c / (n + u + 1) and the escape (u + 1) / (n + u + 1); after an
    escape the bytes of the longer context are excluded from n and u of the shorter one."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray]):
        self.order, self.grams, self.counts = len(grams) - 1, grams, counts
        self.contexts, self.total, self.kinds, self.once, self.shadow, self.shadow_once = [], [], [], [], [], []
        for k, (g, c) in enumerate(zip(grams, counts)):
            x = g >> _U(8)
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
            self.contexts.append(x[start])
            self.kinds.append(np.diff(np.r_[start, len(x)]))
            low = counts[k - 1][np.searchsorted(grams[k - 1], g & self._mask(k))] if k and len(x) else c
            # `shadow`: what the context's bytes count in the next shorter context.
            for name, value in (("total", c), ("once", c == 1), ("shadow", low), ("shadow_once", low == 1)):
                value = value.astype(np.int64)
                getattr(self, name).append(np.add.reduceat(value, start) if len(x) else value)

    @staticmethod
    def _mask(bytes_: int) -> np.uint64:
        return _U((1 << (8 * bytes_)) - 1)

    def table(self) -> None:
        """Prepares the lookup of the longest grams."""
        g, c = self.grams[-1], self.counts[-1]
        x = np.searchsorted(self.contexts[-1], g >> _U(8))
        self.longest = Lookup(g, np.log10(c / (self.total[-1][x] + self.once[-1][x] + 1)) if len(g) else np.zeros(0))

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the others."""
        out = self.longest.find(grams)
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            kinds, back = np.unique(grams[new], return_inverse=True)
            out[new] = self.walk(kinds)[back]
        return out

    def walk(self, grams: np.ndarray) -> np.ndarray:
        """The same by going down from the longest context seen, with escapes and exclusion."""
        cost, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        out_n, out_q, out_u = (np.zeros(len(grams), np.int64) for _ in range(3))
        for k in range(self.order, -1, -1):
            g, c = self.grams[k], self.counts[k]
            if not len(g):
                continue
            context, gram = (grams & self._mask(k + 1)) >> _U(8), grams & self._mask(k + 1)
            x = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            seen = open_ & (self.contexts[k][x] == context)
            at = np.minimum(np.searchsorted(g, gram), len(g) - 1)
            hit = seen & (g[at] == gram)
            n, q, u = self.total[k][x] - out_n, self.kinds[k][x] - out_q, self.once[k][x] - out_u + 1
            cost[hit] += np.log10(c[at[hit]] / (n[hit] + u[hit]))
            miss = seen & ~hit & (q > 0)
            cost[miss] += np.log10(u[miss] / (n[miss] + u[miss]))
            open_ &= ~hit
            out_n, out_q, out_u = (np.where(seen, v[k][x], 0) for v in (self.shadow, self.kinds, self.shadow_once))
        known = len(self.grams[0])
        cost[open_] -= math.log10(max(1, 256 - known))
        return cost


def _collected(nodes: DataFrame, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Grams in order and their counts, for each order."""
    got = nodes.select(F.col("k").cast("byte").alias("k"), "gram", "n").toArrow()
    k, g, n = got.column("k").to_numpy(), got.column("gram").to_numpy().view(_U), got.column("n").to_numpy()
    grams, counts = [], []
    for level in range(order + 1):
        mine = np.flatnonzero(k == level)
        mine = mine[np.argsort(g[mine])]
        grams.append(g[mine])
        counts.append(n[mine])
    return grams, counts


def train(docs: DataFrame, text: str = "text", order: int = ORDER, most: int | None = None) -> Trie:
    """The trie of all texts of `docs` at the driver, whole, or the `most` nodes of `node_limits`.  For corpora whose trie is larger than a
    machine, `gram_scores` gives its probabilities without ever having it in one place."""
    nodes = shared(trie_nodes(gram_counts(docs, text, order), order), "ppm-nodes")
    if most is not None:
        nodes = nodes.where(F.element_at(F.array(*map(F.lit, node_limits(nodes, most, order))), F.col("k") + 1) <= F.col("n"))
    return Trie(*_collected(nodes, order))


def gram_scores(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, m, log: the log10 probability of every gram's last byte after the others, under the whole trie of the grams with n.

    `grams` is a written table of gram, n, m.  What a gram's probability takes are the counts after its contexts, from the longest
    to none, and contexts that agree in their last bytes are dealt to one part: a part has all it needs but the contexts of at
    most `SHORT` bytes, which every part gets (their number does not grow with the corpus).
    """
    spark, low = grams.sparkSession, min(order, SHORT)
    short = spark.sparkContext.broadcast(_collected(trie_nodes(grams.where("n > 0"), low), low))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // PART))
    ends = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << (8 * (low + 1))) - 1))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(it), pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("m", pa.int64())]))
        gram, n = part.column("gram").to_numpy().view(_U), part.column("n").to_numpy()
        levels, counts = (list(x) for x in short.value)
        for k in range(low + 1, order + 1):
            level, count = _combine([gram[n > 0] & Trie._mask(k + 1)], [n[n > 0]])
            levels.append(level)
            counts.append(count)
        trie = Trie(levels, counts)
        for at in range(0, len(gram), 1 << 17):
            piece = part.slice(at, 1 << 17)
            yield pa.RecordBatch.from_arrays([*(piece.column(c).combine_chunks() for c in ("gram", "m")), pa.array(trie.walk(gram[at:at + (1 << 17)]))], names=["gram", "m", "log"])

    return grams.select("gram", "n", "m").repartition(parts, ends).mapInArrow(run, "gram long, m long, log double")


def common_grams(scored: DataFrame, most: int = KNOWN) -> Column:
    """Whether a gram is among the commonest, by steps of an eighth of a doubling of m, of which at most `most` are taken."""
    step = F.floor(F.log2("m") * 8).cast("int")
    left, least = most, 64 * 8
    for row in sorted(scored.groupBy(step.alias("j")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True):  # 512 rows at most
        left -= row["c"]
        if left < 0:
            break
        least = row["j"]
    return step >= least


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), n: tokens of all texts, A-Z lower-cased, and under the null word the ends of texts."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in batches(it, 256):
            for t in batch.column(0).to_pylist():
                seen.update((t or "").encode().translate(FOLD_BYTES).split())
            seen[None] += batch.num_rows
            if len(seen) > 1_000_000:
                yield out()
                seen = Counter()
        yield out()

    return (docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, most: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    `score` is the log10 probability of the whole lower-cased text and its end under PPM trained on all documents not held out;
    base_score that of its words and end under add-half word frequencies of the same documents.

    Null and empty texts are one end.  Null doc_ids are in training; repeated rows count and are scored one by
    one.  Without training texts every byte has probability 1/256 and the base one; an empty table gives no rows.

    Words whose share is over 1 in 131,072 are known to every task (there cannot be more of them than that); the
    other words of a document meet their counts in a join, in which no word is common among the training texts.  Likewise the
    `most` commonest grams are known to every task, and the others of a document meet their probabilities in a join.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"), held_out(doc_id).alias("held_out"))
    training = slim.where("not held_out")
    words = shared(word_counts(training, "t"), "ppm-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(1, -(-total // COMMON))
    common = words.where(F.col("n") >= least).toArrow()
    logs = {w: math.log10(n + 0.5) for w, n in zip(common.column("word").to_pylist(), common.column("n").to_pylist())}
    ends = words.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    logs[None] = math.log10(ends + 0.5)
    grams = shared(gram_counts(slim.select("t", (~F.col("held_out")).alias("training")), "t", order, "training"), "ppm-grams")
    scores = shared(gram_scores(grams, order), "ppm-scores")
    frequent = common_grams(scores, most)
    near = scores.where(frequent).select("gram", "log").toArrow()
    model = spark.sparkContext.broadcast((Lookup(near.column("gram").to_numpy().view(_U), near.column("log").to_numpy()), logs))
    unit = math.log10(total + 0.5 * (distinct + 1))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = model.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches(it, 256):
            scores, far, of = np.zeros(batch.num_rows), [np.zeros(0, _U)], [np.zeros(0, int)]
            for rows, starts, grams in _stretches(batch.column(1), order):
                found = table.find(grams)
                new = np.isnan(found)
                far.append(grams[new])
                of.append(np.repeat(rows, np.add.reduceat(new, starts, dtype=int)))
                np.add.at(scores, rows, np.add.reduceat(np.where(new, 0.0, found), starts))
            cuts = np.r_[0, np.cumsum(np.bincount(np.concatenate(of), minlength=batch.num_rows))]  # rows ascend
            unknown = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(far).view(np.int64)))
            sums, found, tokens, rare = [], [], [], []
            for t in batch.column(1).to_pylist():
                these = (t or "").encode().translate(FOLD_BYTES).split()
                hits = [known[w] for w in these if w in known]
                rare.append([w for w in these if w not in known] if len(hits) < len(these) else [])
                sums.append(math.fsum(hits) + known[None])
                found.append(len(hits) + (ends > 0))
                tokens.append(len(these) + 1)
            keys = row + np.arange(batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(sums, pa.float64()),
                 pa.array(scores), pa.array(rare, pa.list_(pa.binary())), unknown], names=["row", "doc_id", "held_out", "n_tokens", "found", "sums", "score", "rare", "far"])

    scored = shared(slim.mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, found long, sums double, score double, rare array<binary>, far array<bigint>"), "ppm-scored")
    rest = scored.select("row", F.explode("rare").alias("word")).join(words.where(F.col("n") < least), "word", "left")
    rest = rest.groupBy(F.col("row").alias("of")).agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("also"))
    lost = scored.select("row", F.explode("far").alias("gram")).join(scores.where(~frequent).select("gram", "log"), "gram")
    lost = lost.groupBy(F.col("row").alias("at")).agg(F.sum("log").alias("logs"))
    return scored.join(rest, F.col("row") == F.col("of"), "left").join(lost, F.col("row") == F.col("at"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("found") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"))
