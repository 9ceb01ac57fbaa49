"""Packing documents into fixed windows: concatenate and cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, running_total, shared
from .tokens import encoder, token_rows, wide

LENGTH = 2048


def pack(docs: DataFrame, path: str, end: int = 1, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", word: bool = True,
         with_ids: bool = True) -> DataFrame:
    """The pieces of all documents in sequences of `length` ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves (little-endian 32-bit) if asked for.

    First pass: every partition encodes its documents, counts its ids and writes both.  The totals, one row per
    partition, are summed up in partition order.  Second pass: total before a partition plus place in it is a
    document's place in the whole stream, which is cut every `length` ids; a document that lies over a cut gives
    a piece per window, which are the boundary records.  All sequences are full but the last, whatever the
    lengths, and no row is sorted or moved between the passes.

    Null and empty texts are their end id alone.  Every row is a document, also with a null or repeated doc_id.
    An empty table gives no rows.
    """
    rows = shared(token_rows(docs, path, word, end, doc_id, text), "pack-ids")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = running_total(totals, "part", "__n", "__before").select("part", "__before")
    placed = rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("__before")).alias("at"), "n_tokens", "ids")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = encoder(path, word, end).kind
        for batch in batches(it):
            out = []
            for k, (at, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                data = wide(ids, stored).tobytes()
                lo = 0
                while lo < n:
                    hi = min(n, (at + lo) // length * length + length - at)
                    piece = data[4 * lo:4 * hi]
                    out.append((k, lo, hi - lo, zlib.crc32(piece), n, (at + lo) // length, (at + lo) % length, piece if with_ids else None))
                    lo = hi
            row, *rest = zip(*out)
            arrays = [batch.column(0).take(pa.array(row, pa.int64()))] + [pa.array(np.array(c, np.int64)) for c in rest[:-1]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(rest[-1], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
                             + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, pad: int = 0, length: int = LENGTH) -> DataFrame:
    """sequence_id, ids (array of `length` ids), segments (doc_id, length, offset of each piece) for training.  The
    last sequence is padded to the next power of two only, as a window of its own size."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    ordered = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("parts"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            out = {"sequence_id": [], "ids": [], "segments": []}
            for row in batch.to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in row["parts"]), "<u4").astype(np.int32)
                size = min(length, 1 << max(0, len(ids) - 1).bit_length())
                out["sequence_id"].append(row["sequence_id"])
                out["ids"].append(np.pad(ids, (0, size - len(ids)), constant_values=pad))
                out["segments"].append([{n: p[n] for n in ("doc_id", "length", "offset")} for p in row["parts"]])
            yield pa.RecordBatch.from_pydict(out)

    return ordered.mapInArrow(run, f"sequence_id long, ids array<int>, segments array<struct<doc_id: {kind}, length: long, offset: long>>")
