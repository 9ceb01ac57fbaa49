"""Alignment of two tokenizers over the same texts, and how often their tokens meet corpus-wide.

Both token sequences of a batch of documents are walked in lockstep: one state vector holds a pointer into A and one
into B for every document, each step moves all of them, and documents that are done leave the vectors.
Documents keep their distinct linked pairs in a table; pair counts are added up from it, and go back to the
documents: the commonest pairs, a bounded number, to all tasks, the others by an equality join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import shared
from .tokens import _byte_letters

#: Bytes of text that are walked together, and that are encoded at a time, in whole documents.
TOGETHER, ENCODED = 4 << 20, 1 << 18
#: Links laid out at a time; a larger group is taken by its distinct ids.
LINKS = 1 << 20
#: Pairs whose counts are sent to all tasks at most, 17 bytes each.
KNOWN = 1 << 20
#: Words remembered in each of two generations.
REMEMBERED = 150_000
_SEGMENT = re.compile(" +[^ ]*")
#: Characters whose classes all libraries agree on, and runs that backtracking patterns had better not see.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ÿ‐-‧‹›€]*")
_LONG = re.compile(r"\S{1000}|\s{200}")
#: A tokens of a document that one place of the state vector walks at most, about.
LANE = 1024


class Bytewise:
    """A: a byte-level file of the tokenizers library over a blank and the text; spellings of special tokens are text.

    The file's vocabulary and merges, if each merge is numbered in its turn and the file does nothing else, are also what tiktoken
    works by, which takes a third of the time: texts of plain characters without very long words or gaps are
    encoded by it, all others by the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {letter: byte for byte, letter in enumerate(_byte_letters())}
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = [bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for t in tokens]
        self.fast = self._same_rules(path, tokens)

    def _same_rules(self, path: str, tokens: list[str]):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        special = {t["content"] for t in file.get("added_tokens") or []}
        turn = [model["vocab"][m] for m in merges]
        plain = (file.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
                 and not model.get("ignore_merges") and turn == sorted(turn) and len(set(tokens)) == len(tokens))
        if not plain:
            return None
        return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={b: i for i, (t, b) in enumerate(zip(tokens, self.bytes)) if t not in special})

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, None where they do not spell it back."""
        fast = [self.fast is not None and _PLAIN.fullmatch(t) is not None and _LONG.search(t) is None for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([" " + t for t, f in zip(texts, fast) if not f], add_special_tokens=False))
        out = []
        for t, f in zip(texts, fast):
            if f:
                out.append(np.array(self.fast.encode_ordinary(" " + t), np.int32))
            else:
                ids = next(rest).ids
                out.append(np.array(ids, np.int32) if b"".join(map(self.bytes.__getitem__, ids)) == b" " + t.encode() else None)
        return out


class Piecewise:
    """B: a model of the sentencepiece library, which sets the blank itself.

    If no piece reaches from other characters over a blank, and the model leaves characters as they are, the ids of a text are
    those of its words in turn, each with the blanks before it, and words need not be encoded again.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        probe = "ﬁ ① é  x"
        same = self.model.normalize(probe).lstrip("▁").replace("▁", " ") == probe
        self.by_word = same and not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("") == []
        self.kind = "<u2" if len(pieces) <= 1 << 16 else "<u4"
        self.old: dict[str, bytes | None] = {}
        self.young: dict[str, bytes | None] = {"": np.array([self.model.piece_to_id("▁")], self.kind).tobytes()}

    def _spells(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == text.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, None where they do not spell it back with a blank before it."""
        if not self.by_word:
            return [np.array(x, np.int32) if self._spells(x, " " + t) else None for t, x in zip(texts, self.model.encode(texts, num_threads=1))]
        cut = [t.split(" ") if "  " not in t and t[:1] != " " and t[-1:] != " " else [s[1:] for s in _SEGMENT.findall(" " + t)] for t in texts]
        known, old = self.young, self.old
        fresh = []
        for w in set().union(*cut):
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    fresh.append(w)
        for w, ids in zip(fresh, self.model.encode(fresh, num_threads=1)):
            known[w] = np.array(ids, self.kind).tobytes() if not w or self._spells(ids, " " + w) else None
        get, out = known.__getitem__, []
        for t, words in zip(texts, cut):
            ids = list(map(get, words)) if t else []
            out.append(None if None in ids else np.frombuffer(b"".join(ids), self.kind).astype(np.int32))
        if len(known) > REMEMBERED:
            self.old, self.young = known, {"": known[""]}
        return out


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Bytewise(a_path), Piecewise(b_path)
        self.a_len, self.b_len = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.width = len(self.b.bytes)
        #: What the printed groups hold for each id: inside a group, and at its end.
        self.printed = [f"{i}{mark}" for n, marks in ((len(self.a.bytes), ",|"), (self.width, ",;")) for i in range(n) for mark in marks]


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Pair:
    """One pair per worker; it lives on from task to task."""
    return Pair(a_path, b_path)


def spans(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive rows of about `most` in all."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most, prepend=-1)).tolist()
    return list(zip(edges, [*edges[1:], len(sizes)]))


def lanes(a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, size: int = LANE, look: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where places of the state vector begin (A), stop (A) and begin (B): one for each document, and for long ones more,
    each at a common end of both sides among the `look` A tokens from every `size`th on, if there is one there."""
    lengths = np.diff(a_at)
    more = np.maximum(0, (lengths - 1) // size)
    k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    stop = np.repeat(a_at[1:], more)
    near = np.minimum((np.repeat(a_at[:-1], more) + k * size)[:, None] + np.arange(look), stop[:, None] - 1)
    place = np.minimum(np.searchsorted(b_end, a_end[near]), len(b_end) - 1)
    same = (b_end[place] == a_end[near]) & (near < stop[:, None] - 1)
    row = np.flatnonzero(same.any(axis=1))
    col = same[row].argmax(axis=1)
    a0 = np.concatenate([a_at[:-1], near[row, col] + 1])
    b0 = np.concatenate([b_at[:-1], place[row, col] + 1])
    a0, first = np.unique(a0, return_index=True)
    return a0.astype(a_at.dtype), np.append(a0[1:], a_at[-1]).astype(a_at.dtype), b0[first].astype(b_at.dtype)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, a_stop: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Groups of all documents: rows (first A, after the last A, first B, after the last B), by position.

    a_end, b_end: byte offsets of the token ends of all documents, one after the other.  a_at, a_stop, b_at: where each
    document's tokens, or those of a part of it, begin and stop.  Both sides of each end at the same offset.
    """
    a, b, last = a_at.copy(), b_at.copy(), a_stop - 1
    a_open, b_open = a.copy(), b.copy()
    found: list[list[np.ndarray]] = [[], [], [], []]
    while len(a):
        ea, eb = a_end[a], b_end[b]
        cut = ea == eb
        at = np.flatnonzero(cut)
        if len(at):  # a cut, and with it the links of all A and B tokens since the last one
            a_cut, b_cut = a[at] + 1, b[at] + 1
            for held, x in zip(found, (a_open[at], a_cut, b_open[at], b_cut)):
                held.append(x)
            a_open[at], b_open[at] = a_cut, b_cut
        done = cut & (a == last)
        a += ea <= eb
        b += eb <= ea
        if done.any():
            a, b, last, a_open, b_open = (x[~done] for x in (a, b, last, a_open, b_open))
    if not found[0]:
        return np.zeros((4, 0), a_at.dtype)
    first = np.concatenate(found[0])
    order = np.argsort(first, kind="stable").astype(np.int32)
    return np.stack([first[order], *(np.concatenate(x)[order] for x in found[1:])])


def linked_pairs(groups: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, most: int = LINKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) with the number of links, by document and pair.  A pair is A id * width + B id."""
    a0, a1, b0, b1 = groups
    na, nb = a1 - a0, b1 - b0
    n = na.astype(np.int64) * nb
    space = (int(a.max(initial=0)) + 1) * width
    keys, times = [], []

    def add(key: np.ndarray, count: np.ndarray | None = None) -> None:
        if count is None:
            key, count = np.unique(key, return_counts=True)
        keys.append(key)
        times.append(count)

    large = n > most
    for g in np.flatnonzero(large):
        ua, ca = np.unique(a[a0[g]:a1[g]], return_counts=True)
        ub, cb = np.unique(b[b0[g]:b1[g]], return_counts=True)
        for k in range(0, len(ua), step := max(1, most // len(ub))):
            add((doc[g] * space + ua[k:k + step, None].astype(np.int64) * width + ub).ravel(), (ca[k:k + step, None] * cb).ravel())
    small = np.flatnonzero(~large)
    ends = np.cumsum(n[small])
    k = 0
    while k < len(small):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 4 * most, "right")))
        g = small[k:stop]
        of = np.repeat(g, n[g])
        place = np.arange(len(of)) - np.repeat(np.cumsum(n[g]) - n[g], n[g])
        add(doc[of] * space + a[a0[of] + place // nb[of]].astype(np.int64) * width + b[b0[of] + place % nb[of]])
        k = stop
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, count = np.concatenate(keys), np.concatenate(times)
    if len(keys) > 1:
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, count = key[first], np.add.reduceat(count, first)
    return key // space, key % space, count


def _packed(pair: np.ndarray, count: np.ndarray, squeeze) -> bytes:
    """Ascending pairs as differences, then their counts."""
    return squeeze(np.diff(pair, prepend=0).astype("<u8").tobytes() + count.astype("<u4").tobytes()) if len(pair) else b""


def _unpacked(data: bytes, plain) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = plain(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u8", n).astype(np.int64)), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)


def _rows(texts: list[str | None], pair: Pair, squeeze, detail: bool) -> dict[str, list]:
    """The result columns of a batch of texts."""
    n = len(texts)
    filled = [t or "" for t in texts]
    ids, good = [], []
    for lo, hi in spans(np.array([len(t) for t in filled]), ENCODED):
        for t, x, y in zip(filled[lo:hi], pair.a.encode(filled[lo:hi]), pair.b.encode(filled[lo:hi])):
            if t and x is not None and y is not None:
                good.append(len(ids))
            ids.append((x, y))
    out = {"n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "n_links": [0] * n, "groups_sha256": [""] * n, "pairs": [b""] * n}
    if detail:
        out |= {name: [[] for _ in range(n)] for name in ("a_ids", "b_ids", "a_cuts", "b_cuts")}
    if not good:
        return out
    a, b = (np.concatenate([ids[i][side] for i in good]) for side in (0, 1))
    a_at, b_at = (np.cumsum([0] + [len(ids[i][side]) for i in good], dtype=np.int32) for side in (0, 1))
    a_end, b_end = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    groups = lockstep(a_end, b_end, *lanes(a_end, b_end, a_at, b_at))
    a0, a1, b0, b1 = groups
    na, nb = a1 - a0, b1 - b0
    doc = np.searchsorted(a_at, a0, "right") - 1
    links = np.zeros(len(good), np.int64)
    np.add.at(links, doc, na.astype(np.int64) * nb)
    group_at = np.searchsorted(doc, np.arange(len(good) + 1))
    # Printed order: the A tokens of a group stand after all B tokens of earlier groups, its B tokens after its A tokens.
    print_at = np.empty(len(a) + len(b), np.int32)
    for side, base, stop, gap, n_own in ((a, 0, a1, b0, na), (b, len(pair.a.bytes), b1, a1, nb)):
        shown = 2 * (base + side)
        shown[stop - 1] += 1
        print_at[np.arange(len(side)) + np.repeat(gap, n_own)] = shown
    of, code, count = linked_pairs(groups, doc, a, b, pair.width)
    pair_at = np.searchsorted(of, np.arange(len(good) + 1))
    for k, i in enumerate(good):
        text = "".join(map(pair.printed.__getitem__, print_at[a_at[k] + b_at[k]:a_at[k + 1] + b_at[k + 1]].tolist()))
        own = slice(pair_at[k], pair_at[k + 1])
        out["n_a"][i], out["n_b"][i] = len(ids[i][0]), len(ids[i][1])
        out["n_groups"][i], out["n_links"][i] = int(group_at[k + 1] - group_at[k]), int(links[k])
        out["groups_sha256"][i] = hashlib.sha256(text[:-1].encode()).hexdigest()
        out["pairs"][i] = _packed(code[own], count[own], squeeze)
        if detail:
            span = slice(group_at[k], group_at[k + 1])
            out["a_ids"][i], out["b_ids"][i] = ids[i][0].tolist(), ids[i][1].tolist()
            out["a_cuts"][i], out["b_cuts"][i] = (a1[span] - a_at[k]).tolist(), (b1[span] - b_at[k]).tolist()
    return out


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", detail: bool = False) -> DataFrame:
    """One row per document: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, and with `detail` the
    ids of both sides and, for each group, the tokens of the document up to its end (a_cuts, b_cuts).

    A text is encoded by A with a blank before it and by B, which sets the blank itself.  Places where both have a token end cut it
    into groups; all A and B tokens of a group are linked.  Null and empty texts, and texts that either side does not spell back byte
    for byte, have no tokens.  Rows with a null or repeated doc_id are documents of their own; `row` tells them
    apart in the written result.  An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    numbers, lists = ("n_a", "n_b", "n_groups", "n_links"), ("a_ids", "b_ids", "a_cuts", "b_cuts")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, squeeze = tokenizers(a_path, b_path), zstandard.ZstdCompressor(level=1).compress
        at = TaskContext.get().partitionId() << 36
        for batch in it:
            for lo, hi in spans(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), TOGETHER):
                cols = _rows(batch.column(1).slice(lo, hi - lo).to_pylist(), pair, squeeze, detail)
                arrays = {"row": pa.array(np.arange(at, at + hi - lo)), "doc_id": batch.column(0).slice(lo, hi - lo)}
                arrays |= {k: pa.array(cols[k], pa.int64()) for k in numbers}
                arrays |= {"groups_sha256": pa.array(cols["groups_sha256"], pa.string()), "pairs": pa.array(cols["pairs"], pa.binary())}
                arrays |= {k: pa.array(cols[k], pa.list_(pa.int32())) for k in lists if detail}
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
                at += hi - lo

    schema = f"row long, doc_id {kind}, {', '.join(f'{k} long' for k in numbers)}, groups_sha256 string, pairs binary"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, schema + "".join(f", {k} array<int>" for k in lists if detail))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of its A id has more).  Tasks add up before they send."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        pair, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            key, times = np.concatenate([pair, *held]), np.concatenate([n, *(np.ones(len(x), np.int64) for x in held)])
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            return key[first], np.add.reduceat(times, first) if len(first) else times

        for batch in it:
            for data in batch.column(0).to_pylist():
                held.append(_unpacked(data, plain)[0])
                size += len(held[-1])
                if size > 2 * LINKS:
                    (pair, n), held, size = merged(), [], 0
            if len(pair) > 4 * LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, n = merged()
        for k in range(0, len(pair), LINKS):
            yield pa.RecordBatch.from_arrays([pa.array(pair[k:k + LINKS]), pa.array(n[k:k + LINKS])], names=["pair", "n"])

    counts = shared(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    a_id = F.expr(f"pair div {width}")
    # One row per A id at most: no more than A's vocabulary.
    top = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    return counts.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def common_pairs(counts: DataFrame, most: int = KNOWN) -> tuple[DataFrame, bool]:
    """The pairs with the largest counts, `most` at most, and whether these are all: by powers of two."""
    size = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1))).collect()}
    power, held = 64, 0
    while power > 0 and held + size.get(power - 1, 0) <= most:
        power -= 1
        held += size.get(power, 0)
    return counts.where(F.col("n") >= F.lit(2**power if power < 63 else 2**63 - 1)), power == 0


def link_scores(aligned: DataFrame, counts: DataFrame, most: int = KNOWN) -> DataFrame:
    """Adds n_best and count_sum to the rows of `align`: links whose pair no other pair of the A id beats, and the sum of the
    links' counts.  `aligned` and `counts` are written tables, which are read several times."""
    common, all_ = common_pairs(counts, most)
    held = common.orderBy("pair").toArrow()
    table = aligned.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "n", "best")))
    names = [c for c in aligned.columns if c != "pairs"]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "pairs")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, (known, n, best) = zstandard.ZstdDecompressor().decompress, table.value
        for batch in it:
            sums, bests, rare_pairs, rare_times = [], [], [], []
            for data in batch.column(batch.schema.get_field_index("pairs")).to_pylist():
                pair, times = _unpacked(data, plain)
                at = np.searchsorted(known, pair)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == pair[hit]
                own, t = at[hit], times[hit]
                sums.append(int((n[own] * t).sum()))
                bests.append(int(t[best[own]].sum()))
                rare_pairs.append(pair[~hit])
                rare_times.append(times[~hit])
            more = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()),
                    "rare": pa.array(rare_pairs, pa.list_(pa.int64())), "times": pa.array(rare_times, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *more.values()], names=[*names, *more])

    scored = aligned.mapInArrow(run, f"{kept}, n_best long, count_sum long, rare array<long>, times array<long>")
    if all_:
        return scored.drop("rare", "times")
    scored = shared(scored, "align-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), "x.times")
    more = rare.join(counts, "pair").groupBy(F.col("row").alias("of")).agg(
        F.sum(F.col("n") * F.col("times")).alias("s"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"))
    add = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    return scored.join(more, F.col("row") == F.col("of"), "left").select(*names, add("n_best", "b"), add("count_sum", "s"))


def alignment_report(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", most: int = KNOWN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document (see `align`).

    A pair's count is the number of documents that hold it linked; equal highest counts of an A id are all best."""
    aligned = shared(align(docs, a_path, b_path, doc_id, text), "aligned")
    counts = shared(pair_counts(aligned, tokenizers(a_path, b_path).width), "align-counts")
    return link_scores(aligned, counts, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
