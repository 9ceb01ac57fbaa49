"""Boosted trees by gradients and curvatures over binned columns.

Rows become blocks of small bin numbers in a written table.  Every level of a tree is one pass: tasks add up gradient and
curvature by node, column and bin, Spark sums these, and the driver, which sees a fixed number of sums whatever the number of
rows, chooses the cuts.  Leaves are minus the gradient by the curvature with a penalty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import write_and_read

#: Bins of a column at most, rows of a block, and trees after which the margins are written down.
BINS, ROWS, KEEP = 64, 16_384, 24


@dataclass
class Tree:
    """A full tree in heap order: column and bin of each inner node (rows up to the bin go left), values of the leaves.
    A node without a cut has column -1, and all rows go left."""

    depth: int
    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Place within the level after `levels` cuts."""
        at = np.zeros(len(bins), np.int64)
        for level in range(levels):
            heap = at + (1 << level) - 1
            column = self.column[heap]
            right = (column >= 0) & (bins[np.arange(len(bins)), np.maximum(column, 0)] > self.bin[heap])
            at = 2 * at + right
        return at


@dataclass
class Boosted:
    """Columns, their cuts and the trees.  Columns a table does not have count as 0, so older models keep working."""

    columns: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, values[:, k], "left") for k, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def margin(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        """Sum of the leaves met, of the trees from `start` on."""
        out = np.zeros(len(bins))
        for t in self.trees[start:]:
            out += t.value[t.node(bins, t.depth)]
        return out

    def predict(self, rows: DataFrame, out: str = "symptom_risk") -> DataFrame:
        """Adds the probability of label 1."""
        have = [c for c in self.columns if c in rows.columns]
        model, names = self, rows.columns
        numbers = rows.select(*[F.col(f"`{c}`") for c in names], F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in have]).alias("_x") if have else F.array().cast("array<double>").alias("_x"))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            full = np.zeros((len(x), len(model.columns)))
            if have and len(x):
                full[:, [model.columns.index(c) for c in have]] = np.nan_to_num(np.stack(x.to_numpy()), nan=0.0)
            return pd.Series(1 / (1 + np.exp(-model.margin(model.bins(full)))))

        return numbers.withColumn(out, score("_x")).drop("_x")


def _unit(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) hashed from the row's id and the seed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def column_cuts(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Quantiles of each column, each once: values up to a cut stand in its bin."""
    probs = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), probs).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [np.unique(np.array(found[f"c{k}"] or [], float)) for k in range(len(columns))]


_BLOCK = "n long, ids binary, bins binary, label binary, weights binary, margins binary"


def _blocks(rows: DataFrame, model: Boosted, members: Sequence[tuple[Column, float]]) -> DataFrame:
    """Arrays of up to ROWS rows as bytes; weights and margins have a column per model, weight 0 where a row is not its."""
    values = F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in model.columns])
    weights = F.array(*[F.when(F.coalesce(own, F.lit(False)), F.when(F.col("label") == 1, F.lit(float(w))).otherwise(1.0)).otherwise(0.0) for own, w in members])
    slim = rows.select(values.alias("x"), F.col("label").cast("double").alias("y"), weights.alias("w"), F.monotonically_increasing_id().alias("id"))
    n_models = len(members)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k in range(0, len(pdf), ROWS):
                part = pdf.iloc[k:k + ROWS]
                yield pd.DataFrame({"n": [len(part)], "ids": [part["id"].to_numpy("int64").tobytes()], "bins": [model.bins(np.stack(part["x"].to_numpy())).tobytes()],
                                    "label": [part["y"].to_numpy().tobytes()], "weights": [np.stack(part["w"].to_numpy()).tobytes()],
                                    "margins": [np.zeros((len(part), n_models)).tobytes()]})

    return slim.mapInPandas(run, _BLOCK)


def _unpack(r: dict, width: int, models: int) -> tuple[np.ndarray, ...]:
    return (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["bins"], np.uint8).reshape(r["n"], width), np.frombuffer(r["label"], np.float64),
            *(np.frombuffer(r[c], np.float64).reshape(r["n"], models) for c in ("weights", "margins")))


def _sums(blocks: DataFrame, models: list[Boosted], start: int, trees: list[Tree], level: int, chosen: np.ndarray, subsample: float, seed: int) -> np.ndarray:
    """Gradient and curvature sums of each model's tree: (model, node, chosen column, bin, 2)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    nodes, width = 1 << level, len(models[0].columns)
    shape = (len(models), nodes, len(chosen), BINS, 2)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in it:
            for r in batch.to_pylist():
                ids, bins, y, weights, margins = _unpack(r, width, len(models))
                kept = _unit(ids, seed) < subsample
                for m, (model, tree) in enumerate(zip(models, trees)):
                    w = np.where(kept, weights[:, m], 0.0)
                    p = 1 / (1 + np.exp(-(margins[:, m] + model.margin(bins, start))))
                    g, h = w * (p - y), w * p * (1 - p)
                    at = tree.node(bins, level)
                    for j, c in enumerate(chosen):
                        place = at * BINS + bins[:, c]
                        total[m, :, j, :, 0] += np.bincount(place, g, nodes * BINS).reshape(nodes, BINS)
                        total[m, :, j, :, 1] += np.bincount(place, h, nodes * BINS).reshape(nodes, BINS)
        flat = total.reshape(len(models) * nodes, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], names=["node", "s"])

    rows = (blocks.mapInArrow(run, "node int, s array<double>").groupBy("node").agg(Summarizer.sum(array_to_vector("s")).alias("s"))
            .select("node", vector_to_array("s").alias("s")).collect())
    out = np.zeros((len(models) * nodes, int(np.prod(shape[2:]))))
    for r in rows:
        out[r["node"]] = r["s"]
    return out.reshape(shape)


def best_cut(sums: np.ndarray, cuts: list[int], penalty: float, least: float) -> tuple[int, int, float] | None:
    """(place among the chosen columns, bin, gain) of the best cut of a node; `cuts` are the columns' numbers of bins."""
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + penalty)
    gain = score(left) + score(right) - score(whole)
    open_ = (left[..., 1] >= least) & (right[..., 1] >= least) & (np.arange(BINS) < np.array(cuts)[:, None])
    gain = np.where(open_, np.round(gain, 9), -np.inf)
    col, at = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(col), int(at), float(gain[col, at])) if gain[col, at] > 1e-9 else None


def fit_together(rows: DataFrame, columns: Sequence[str], members: Sequence[tuple[Column, float]], trees: int = 120, depth: int = 3,
                 step: float = 0.05, subsample: float = 0.9, columns_per_tree: float = 0.9, penalty: float = 1.0, least: float = 1.0,
                 seed: int = 42) -> list[Boosted]:
    """One model per member (the rows it learns from, the weight of its positive rows), all in the same passes.

    rows: the columns and label (0 or 1).  Nulls and NaN count as 0.  Cuts of the columns are taken from all rows.  Every tree
    has its own sample of rows and columns; a cut needs curvature `least` on both sides.
    """
    cuts = column_cuts(rows, columns)
    models = [Boosted(list(columns), cuts) for _ in members]
    blocks = write_and_read(_blocks(rows, models[0], members), "boost-blocks")
    rng, width, start = np.random.default_rng(seed), len(columns), 0
    for t in range(trees):
        chosen = np.sort(rng.permutation(width)[:max(1, int(columns_per_tree * width))])
        grown = [Tree(depth, np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64), np.zeros(1 << depth)) for _ in models]
        for level in range(depth):
            for tree, sums in zip(grown, _sums(blocks, models, start, grown, level, chosen, subsample, seed * 100_003 + t)):
                _cut_level(tree, sums, level, chosen, [len(cuts[c]) for c in chosen], step, penalty, least)
        for model, tree in zip(models, grown):
            model.trees.append(tree)
        if t + 1 - start >= KEEP and t + 1 < trees:
            blocks, start = write_and_read(_kept(blocks, models, start), "boost-blocks"), t + 1
    return models


def _cut_level(tree: Tree, sums: np.ndarray, level: int, chosen: np.ndarray, sizes: list[int], step: float, penalty: float, least: float) -> None:
    """The best cuts of a level's nodes; after the last level the leaves."""
    for node in range(1 << level):
        heap, whole = node + (1 << level) - 1, sums[node, 0].sum(axis=0)
        cut, parts = best_cut(sums[node], sizes, penalty, least), [whole, np.zeros(2)]
        if cut:
            tree.column[heap], tree.bin[heap] = chosen[cut[0]], cut[1]
            parts[0] = sums[node, cut[0], :cut[1] + 1].sum(axis=0)
            parts[1] = whole - parts[0]
        if level == tree.depth - 1:
            tree.value[2 * node:2 * node + 2] = [-step * g / (h + penalty) for g, h in parts]


def _kept(blocks: DataFrame, models: list[Boosted], start: int) -> DataFrame:
    """The blocks with the margins of the trees since `start` added."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for r in batch.to_pylist():
                _, bins, _, _, margins = _unpack(r, len(models[0].columns), len(models))
                out.append((margins + np.stack([m.margin(bins, start) for m in models], axis=1)).tobytes())
            yield batch.set_column(batch.schema.get_field_index("margins"), "margins", pa.array(out, pa.binary()))

    return blocks.mapInArrow(run, _BLOCK)


def fit_boosted(rows: DataFrame, columns: Sequence[str], positive_weight: float = 1.0, **how) -> Boosted:
    """A single model of all rows; `how` as in `fit_together`."""
    return fit_together(rows, columns, [(F.lit(True), positive_weight)], **how)[0]
