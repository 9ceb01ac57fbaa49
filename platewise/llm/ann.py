"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import batches, shared

#: Vectors that the partitioning and the classifier are fitted on, at any size of the table.
SAMPLE = 6000
#: Neighbours in the graph over the sample.
DEGREE = 10
#: Share of the sample's neighbours that the probed parts must hold; the sample's neighbours lie farther off than those
#: among all rows, which makes the measured share a cautious one.
TARGET = 0.95
#: Rows and queries that meet in one task.
ROWS, QUERIES = 8192, 2048


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // len(column) if len(column) else 0
    if width * len(column) != len(flat) or (len(column) and (np.diff(column.offsets.to_numpy()) != width).any()):
        raise ValueError("vectors of several lengths")
    return flat.reshape(len(column), width)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The nearest others of each row, by blocks."""
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 512):
        near = x[at:at + 512] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        top = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
        out[at:at + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size (to one) with few edges between them: halves of halves, each split at the median of the
    second eigenvector of its graph's random walk, found by power iteration."""
    label = np.zeros(len(graph), np.int64)
    a = np.repeat(np.arange(len(graph)), graph.shape[1])
    b = graph.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    rng = np.random.default_rng(7)
    for _ in range(int(math.log2(parts))):
        same = label[a] == label[b]
        i, j = a[same], b[same]
        degree = np.bincount(i, minlength=len(graph)) + 1.0
        members = np.bincount(label)
        mass = np.bincount(label, degree)
        v = rng.standard_normal(len(graph))
        for _ in range(60):  # all parts of this level at once
            v = (v + (np.bincount(i, v[j], len(graph)) + v) / degree) / 2
            v -= (np.bincount(label, v * degree) / mass)[label]
            v /= np.sqrt(np.bincount(label, v * v) / members + 1e-300)[label]
        order = np.lexsort((v, label))
        rank = np.empty(len(graph), np.int64)
        rank[order] = np.arange(len(graph)) - np.repeat(np.cumsum(members) - members, members)
        label = label * 2 + (rank >= (members // 2)[label])
    return label


def fit_classifier(x: np.ndarray, target: np.ndarray, steps: int = 200, l2: float = 1e-4) -> np.ndarray:
    """Weights (one column a part, the last row the intercepts) of a softmax regression on shares of parts."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = y = np.zeros((z.shape[1], target.shape[1]))
    rate, t = 1.0 / (0.5 * (z**2).sum(axis=1).max() * 0.25 + l2), 1.0
    for _ in range(steps):
        p = softmax(z @ y)
        new = y - rate * (z.T @ (p - target) / len(z) + l2 * y)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Router:
    weights: np.ndarray
    probes: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability."""
        x = unit(x)
        return np.argsort(-(x @ self.weights[:-1] + self.weights[-1]), axis=1, kind="stable")


def fit_router(x: np.ndarray, parts: int, k: int, target: float = TARGET) -> Router:
    """Partitions the graph over the sample, learns the parts of a vector and its neighbours, and takes so many
    parts for a query as hold the wanted share of its neighbours in the sample."""
    if parts < 2 or len(x) < 2 * parts:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1)
    x = unit(x)
    graph = neighbour_graph(x, min(max(DEGREE, k), len(x) - 1))
    label = balanced_parts(graph, parts)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    share[np.arange(len(x)), label] += 0.5
    router = Router(fit_classifier(x, share), parts)
    ranks = np.empty((len(x), parts), np.int64)
    order = router.ranked(x)
    np.put_along_axis(ranks, order, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    near = graph[:, :k]
    need = ranks[np.arange(len(x))[:, None], order[:, 0][near]]  # how far down the part of each neighbour stands
    router.probes = int(np.quantile(need.ravel(), target, method="higher")) + 1
    return router


def usable(column: str) -> Column:
    """Vectors with components that are all finite, one of them not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda x: x != 0)


def parts_for(n: int) -> int:
    """A power of two near an eighth of the root of the number of vectors."""
    return 1 << max(2, min(10, round(math.log2(max(1.0, math.sqrt(n) / 8)))))


def _top(q_ids, q, r_ids, r, k):
    """(query, row, cosine) of each query's k best rows, ties to the smaller row."""
    r_norm = np.linalg.norm(r, axis=1)
    out = []
    for at in range(0, len(q), 256):
        x = q[at:at + 256]
        norm = np.linalg.norm(x, axis=1)
        near = (x @ r.T) / r_norm
        keep = min(k + 4, len(r))
        top = np.argpartition(-near, keep - 1, axis=1)[:, :keep] if keep < len(r) else np.tile(np.arange(len(r)), (len(x), 1))
        # Scores are taken anew pair by pair, so that equal vectors score alike wherever they lie.
        exact = np.einsum("ijd,id->ij", r[top], x) / (norm[:, None] * r_norm[top])
        order = np.lexsort((r_ids[top], -exact), axis=1)[:, :k]
        out.append((np.repeat(q_ids[at:at + 256], order.shape[1]), r_ids[np.take_along_axis(top, order, 1)].ravel(), np.take_along_axis(exact, order, 1).ravel()))
    return [np.concatenate(c) for c in zip(*out)]


def _meet(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    if not rows.num_rows or not queries.num_rows:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    else:
        take = lambda t: (t.column("uid").to_numpy(), matrix(t.column("vector").combine_chunks()))
        found = _top(*take(queries), *take(rows), k)
    return pa.table({"query": found[0], "uid": found[1], "score": found[2]})


def search(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE,
           parts: int | None = None, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine found for every row whose id is divisible by `every`,
    among all rows but the query's own; ties to the smaller id.

    A neighbour graph over a sample is cut into balanced parts, and a softmax classifier learns them.  It puts every
    row into its most probable part and sends every query to the `probes` most probable ones, where rows are
    ranked by their exact cosines.  Rows and queries of a part meet in blocks of bounded size, so a
    large part is spread.  Equal vectors are one row of the index with their k + 1 smallest ids (cut in the tasks before they are
    moved), and equal queries are searched once.

    Null, zero and non-finite vectors and rows without an id take no part; of several vectors under one id the
    smallest counts.  Vectors of several lengths raise ValueError.  A table without usable vectors gives no rows.
    """
    spark = vectors.sparkSession
    clean = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
             .where(F.col("vec_id").isNotNull() & usable("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    clean = shared(clean, "ann-vectors")
    same = W.partitionBy("vector").orderBy("vec_id")
    ranked = clean.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k + 1)
    members = shared(ranked.withColumn("uid", F.first("vec_id").over(same)), "ann-members")
    unique = members.where("rn = 1").select("uid", "vector")
    n = unique.count()
    fitted = unique.orderBy(F.xxhash64("uid"), "uid").limit(sample).toArrow()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit_router(matrix(fitted.column("vector").combine_chunks()), parts or parts_for(n), k, target)

    def route(probes: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(it, 4096):
                if batch.num_rows:
                    chosen = router.ranked(matrix(batch.column(1)))[:, :probes].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(chosen), pa.list_(pa.int32()))], names=["uid", "vector", "parts"])
        return run

    schema = "uid long, vector array<double>, parts array<int>"
    indexed = shared(unique.mapInArrow(route(1), schema).select("uid", "vector", F.col("parts")[0].alias("part")), "ann-index")
    asked = clean.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    asked = shared(asked.join(unique, "vector").select("query_id", "uid", "vector"), "ann-queries")
    probed = shared(asked.groupBy("uid").agg(F.first("vector").alias("vector")).mapInArrow(route(router.probes), schema)
                    .select("uid", "vector", F.explode("parts").alias("part")), "ann-probes")
    # A row per part: how many blocks its rows and its queries are dealt into.
    blocks = (indexed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("across"))
              .join(probed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("down")), "part"))
    blocks = F.broadcast(shared(blocks, "ann-blocks"))
    own = lambda m: F.pmod(F.xxhash64("uid"), F.col(m)).cast("int")
    all_ = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    rows = indexed.join(blocks, "part").select("part", own("across").alias("i"), all_("down").alias("j"), "uid", "vector")
    queries = probed.join(blocks, "part").select("part", all_("across").alias("i"), own("down").alias("j"), "uid", "vector")
    found = rows.groupBy("part", "i", "j").cogroup(queries.groupBy("part", "i", "j")).applyInArrow(
        lambda a, b: _meet(a, b, k + 1), "query long, uid long, score double")
    best = W.partitionBy("query").orderBy(F.col("score").desc(), "uid")
    top = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).select("query", "uid", "score")
    # At most (k + 1)^2 ids per query vector, then the answers of each query row from its vector's list.
    named = top.join(members.select(F.col("uid").alias("of"), "vec_id"), F.col("uid") == F.col("of"))
    lists = named.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    answer = asked.select("query_id", "uid").join(lists, F.col("uid") == F.col("query"))
    others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    return (answer.select("query_id", F.posexplode(others).alias("p", "c"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.s")).alias("score")))
