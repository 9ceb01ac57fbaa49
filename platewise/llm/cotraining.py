"""A quality classifier by co-training on two views: the text, and what is known about the page."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import batches, binary_views, shared

#: Labelled rows that the fit reads at most; the unlabelled ones all take part in the exchange.
LABELLED = 6000
ROUNDS, EACH = 4, 400
PAIRS, META_DIMS = 1024, 128
TEXT_DIMS = PAIRS + 2
#: Added to the number of byte pairs, so that the shares of very short texts are not taken at face value.
PRIOR = 100


def text_features(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of byte pairs in hashed places, the share of words that repeat the one before and
    of words that came before at all, over whole texts; empty texts are all zero."""
    offsets, data = binary_views(column)
    out = np.zeros((len(column), TEXT_DIMS), np.float32)
    for row, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
        for at in range(lo, hi - 1, 1 << 22):  # long texts in stretches that share one byte
            part = data[at:min(hi, at + (1 << 22) + 1)].astype(np.uint32)
            place = ((part[:-1] << 8 | part[1:]) * np.uint32(2654435761)) >> np.uint32(22)
            out[row, :PAIRS] += np.bincount(place, minlength=PAIRS)
        out[row] = np.sqrt(out[row] / (max(0, hi - lo - 1) + PRIOR))
        words = data[lo:hi].tobytes().split()
        if words:
            out[row, PAIRS] = 2 * sum(map(eq, words, words[1:])) / len(words)
            out[row, PAIRS + 1] = 1 - len(set(words)) / len(words)
    return out


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Hashed language and source, and the length as steps of a factor two; nulls are a value of their own."""
    out = np.zeros((len(lang), META_DIMS), np.float32)
    for row, values in enumerate(zip(lang, source, n_chars)):
        size = "null" if values[2] is None else str(int(max(0, values[2])).bit_length())
        for name, value in zip(("lang", "source", "size"), (*values[:2], size)):
            out[row, zlib.crc32(f"{name}={value}".encode()) % META_DIMS] += 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights and, last, the intercept; accelerated gradient steps of a fixed number, so that reruns agree."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = weight / weight.sum()
    rate = 1.0 / (0.25 * float((weight * (x**2).sum(axis=1)).sum()) + l2)
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        grad = x.T @ (weight * (p - y)) + l2 * np.r_[z[:-1], 0]
        new, s = z - rate * grad, (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


@dataclass
class Model:
    """Weights of both views, their calibrations (scale, shift), the weights of the combination and the threshold."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray
    threshold: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = logit(logit(text, self.text)[:, None], self.text_scale)
        m = logit(logit(meta, self.meta)[:, None], self.meta_scale)
        prob = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30).astype(np.float64)))
        return prob(t), prob(m), prob(logit(np.stack([t, m], axis=1), self.both))


def _balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))


class ArrayPool:
    """Unlabelled rows in arrays; given rows are gone."""

    def __init__(self, views: dict[str, np.ndarray]):
        self.views, self.free = views, np.arange(len(views["text"]))

    def __len__(self) -> int:
        return len(self.free)

    def surest(self, view: str, other: str, w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """What the other view sees of the rows with the lowest and the highest scores."""
        order = np.argsort(logit(self.views[view][self.free], w), kind="stable")
        chosen = order[:low], order[len(order) - high:]
        out = tuple(self.views[other][self.free[c]] for c in chosen)
        self.free = np.delete(self.free, np.concatenate(chosen))
        return out


class TablePool:
    """The same over a written table x, m, key of any size, where `key` is the hash of both features.

    Rows with equal features count once, so that a group of copies does not fill a round.  A round scores all rows where they
    lie; tasks give the keys of their surest rows only, as many as the round takes, and the features of the chosen keys, a bounded number, come
    to the driver.
    """

    def __init__(self, rows: DataFrame, given: np.ndarray):
        self.rows, self.given = rows, np.unique(given)
        self.size = rows.where(~F.col("key").isin(self.given.tolist())).select("key").distinct().count() if len(given) else rows.select("key").distinct().count()

    def __len__(self) -> int:
        return self.size

    def surest(self, view: str, other: str, w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        given, column = self.given, {"text": "x", "meta": "m"}

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {1: (np.zeros(0), np.zeros(0, np.int64)), -1: (np.zeros(0), np.zeros(0, np.int64))}
            for batch in it:
                key, score = batch.column(1).to_numpy(), logit(_matrix(batch.column(0)), w).astype(np.float64)
                free = ~np.isin(key, given)
                for sign, many in ((1, low), (-1, high)):
                    k, at = np.unique(np.r_[best[sign][1], key[free]], return_index=True)
                    v = np.r_[best[sign][0], sign * score[free]][at]
                    order = np.lexsort((sign * k, v))[:many]
                    best[sign] = v[order], k[order]
            for sign, (v, k) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), sign, np.int32)), pa.array(v), pa.array(k)], names=["sign", "v", "key"])

        found = self.rows.select(column[view], "key").mapInArrow(run, "sign int, v double, key long").groupBy("sign", "key").agg(F.min("v").alias("v"))
        first = W.partitionBy("sign").orderBy("v", F.col("sign") * F.col("key"))
        ranked = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= F.when(F.col("sign") == 1, low).otherwise(high)).select("sign", "key").toArrow()
        sign, key = ranked.column("sign").to_numpy(), ranked.column("key").to_numpy()
        # The features of a chosen key, once.
        got = (self.rows.where(F.col("key").isin(key.tolist())).groupBy("key").agg(F.min(column[other]).alias("f"))).toArrow()
        seen = dict(zip(got.column("key").to_pylist(), _matrix(got.column("f").combine_chunks())))
        self.given, self.size = np.union1d(self.given, key), self.size - len(key)
        return tuple(np.stack([seen[k] for k in np.sort(key[sign == s]).tolist()]) for s in (1, -1))


def _matrix(column: pa.Array) -> np.ndarray:
    offsets, data = binary_views(column)
    return data[offsets[0]:offsets[-1]].view("<f2").reshape(len(column), -1).astype(np.float32)


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, held: np.ndarray, rounds: int = ROUNDS, each: int = EACH,
             pool: ArrayPool | TablePool | None = None) -> Model | None:
    """Fits on rows with a label (1, 0; -1: none) that are not held out.  In each round either view gives the other
    the pool rows it is surest of, in the proportion of the labels; a row is given once.  Held-out rows calibrate the views, weigh
    them against each other and set the threshold.  None without both labels on both sides.  Without a pool the rows without a label are it."""
    train, cal = np.flatnonzero((label >= 0) & ~held), np.flatnonzero((label >= 0) & held)
    if any(len(np.unique(label[r])) < 2 for r in (train, cal)):
        return None
    share = label[train].mean()
    quota = max(1, round(each * share)), max(1, round(each * (1 - share)))
    views = {"text": text, "meta": meta}
    pool = pool if pool is not None else ArrayPool({v: views[v][label < 0] for v in views})
    rows = {v: views[v][train] for v in views}
    known = {v: label[train].astype(float) for v in views}
    fit = lambda v: fit_logistic(rows[v], known[v], _balanced(known[v]))
    for _ in range(rounds):
        for view, other in (("text", "meta"), ("meta", "text")):
            if len(pool) < sum(quota):
                break
            w = fit(view)
            own = 1 / (1 + np.exp(-np.clip(logit(views[view][train], w), -30, 30)))
            if ((own > 0.5) == (label[train] == 1)).mean() < max(share, 1 - share):
                continue  # a view that knows less than the share of the larger class has nothing sure to give
            for seen, value in zip(pool.surest(view, other, w, quota[1], quota[0]), (0.0, 1.0)):
                rows[other] = np.concatenate([rows[other], seen])
                known[other] = np.r_[known[other], np.full(len(seen), value)]
    w = {v: fit(v) for v in views}
    y, even = label[cal].astype(float), np.full(len(cal), 1.0)
    scale, cal_logit = {}, {}
    for v in views:
        raw = logit(views[v][cal], w[v])[:, None]
        scale[v] = fit_logistic(raw, y, even, l2=1e-4)
        cal_logit[v] = logit(raw, scale[v])
    both = fit_logistic(np.stack([cal_logit["text"], cal_logit["meta"]], axis=1), y, even, l2=1e-4)
    model = Model(w["text"], w["meta"], scale["text"], scale["meta"], both, 0.5)
    score = model.scores(text[cal], meta[cal])[2]
    # The largest threshold that rejects no more than one good held-out row in a hundred, but never above one half.
    model.threshold = float(min(0.5, np.quantile(score[y == 1], 0.01)))
    return model


def _features(docs: DataFrame, names: tuple[str, ...], extra: str) -> DataFrame:
    _, text, lang, source, n_chars = names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            x = text_features(batch.column(0)).astype("<f2")
            m = meta_features(*(batch.column(k).to_pylist() for k in (1, 2, 3))).astype("<f2")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in m]), batch.column(4), batch.column(5)],
                                             names=["x", "m", "label", "place"])

    return docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s"),
                       F.col(n_chars).cast("long").alias("n"), F.col("__label").alias("label"), F.col("__place").alias("place")).mapInArrow(run, extra)


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", columns: tuple[str, ...] = COLUMNS, labelled: int = LABELLED) -> Model | None:
    """Reads the labelled documents with the smallest hashes, `labelled` at most, one row of each doc_id: about 14 MB of features at
    the driver at any size of the tables.  A fifth of them is held out.  The features of all documents are written once to the
    shared folder, and the exchange runs over all whose features are not those of a labelled row read."""
    key = columns[0]
    rated = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg((F.avg(label) >= 0.5).cast("int").alias("__label")).withColumnRenamed("doc_id", "__id"))
    ids = docs.select(F.col(key).alias("__id")).where("__id is not null").distinct()
    place = F.xxhash64(F.col("__id").cast("string"))
    known = ids.join(rated, "__id").withColumn("__place", place).orderBy("__place", "__id").limit(labelled)
    rows = "x binary, m binary, label int, place long"
    got = (_features(docs.join(F.broadcast(known), F.col(key) == F.col("__id")), columns, rows)
           .groupBy("place").agg(F.min(F.struct("x", "m", "label")).alias("r")).select("r.x", "r.m", "r.label", "place", F.xxhash64("r.x", "r.m").alias("key"))
           .orderBy("place").toArrow())
    if not got.num_rows:
        return None
    x, m = (_matrix(got.column(k).combine_chunks()) for k in (0, 1))
    y, held = got.column(2).to_numpy(), got.column(3).to_numpy() % 5 == 0
    nothing = F.lit(None)
    everything = shared(_features(docs.withColumns({"__label": nothing.cast("int"), "__place": nothing.cast("long")}), columns, rows)
                        .select("x", "m", F.xxhash64("x", "m").alias("key")), "quality-features")
    return co_train(x, m, y, held, pool=TablePool(everything, got.column(4).to_numpy()))


def score(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """All columns of the documents, and __text_score, __meta_score, __score (calibrated probabilities that the document is good) and
    __keep.  Without a model every document is kept and the scores are null."""
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({"__text_score": none, "__meta_score": none, "__score": none, "__keep": F.lit(True)})
    at = [docs.columns.index(c) for c in columns[1:]]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            text, lang, source, n_chars = (batch.column(k) for k in at)
            t, m, s = model.scores(text_features(text), meta_features(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t), pa.array(m), pa.array(s), pa.array(s >= model.threshold)],
                                             names=[*batch.schema.names, "__text_score", "__meta_score", "__score", "__keep"])

    schema = docs.schema
    for name, kind in (("__text_score", "double"), ("__meta_score", "double"), ("__score", "double"), ("__keep", "boolean")):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep for every row of the documents.

    Null and empty texts score by what the text view makes of no text; nulls of the page view are a value.  Labels
    of unknown documents and null labels are left out, several labels of one document are averaged.  Repeated
    rows score alike.  An empty table gives no rows.
    """
    key = columns[0]
    slim = docs.select(*columns)
    return score(slim, fit(slim, labels, label, columns), columns).select(
        F.col(key).alias("doc_id"), F.col("__text_score").alias("text_score"), F.col("__meta_score").alias("meta_score"),
        F.col("__score").alias("score"), F.col("__keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The documents that the classifier does not reject, all columns."""
    return score(docs, fit(docs, labels, label, columns), columns).where("__keep").select(*[F.col(f"`{c}`") for c in docs.columns])
