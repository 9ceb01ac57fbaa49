"""Token-id files: static range asymmetric numeral system with interleaved lanes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batches, running_total
from .tokens import encoder, token_rows

#: Frequencies add up to 2**SCALE; lane states lie in [2**31, 2**63) and give off 32-bit words.
SCALE, LOW = 18, 31
#: A block closes with the document that brings it to this many ids, so documents never lie in two blocks.
BLOCK, LANES = 1 << 19, 2048
_HEAD = struct.Struct("<4sIQQI")  # magic, lanes, ids, words, crc32 of the ids
_MAGIC = b"RNS1"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts by id scaled to 2**SCALE; every id that occurs keeps at least one part."""
    seen = counts > 0
    spare = (1 << SCALE) - int(seen.sum())
    if spare < 0:
        raise ValueError("more distinct ids than parts")
    out = seen.astype(np.int64)
    if seen.any():
        out += np.floor(counts * (spare / counts.sum())).astype(np.int64)
        out[int(counts.argmax())] += (1 << SCALE) - int(out.sum())
    return out


class Coder:
    """Encodes and decodes blocks by one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.below = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, n // 64))
        freq, below = self.freq[ids], self.below[ids]
        limit = freq << np.uint64(LOW - SCALE + 32)
        x = np.full(lanes, 1 << LOW, np.uint64)
        words = []
        for lo in range((n - 1) // lanes * lanes if n else 0, -1, -lanes):
            hi = min(n, lo + lanes)
            now, f = x[:hi - lo], freq[lo:hi]
            full = now >= limit[lo:hi]
            words.append(now[full].astype("<u4"))  # the low 32 bits
            now = np.where(full, now >> np.uint64(32), now)
            quotient = now // f
            x[:hi - lo] = (quotient << np.uint64(SCALE)) + (now - quotient * f) + below[lo:hi]
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        head = _HEAD.pack(_MAGIC, lanes, n, len(stream), zlib.crc32(ids.astype("<u4").tobytes()))
        return head + x.astype("<u8").tobytes() + stream.tobytes()

    def decode(self, block: bytes) -> np.ndarray:
        """The ids of a block; raises ValueError on any damage that its checksum shows."""
        magic, lanes, n, size, crc = _HEAD.unpack_from(block)
        if magic != _MAGIC or len(block) != _HEAD.size + 8 * lanes + 4 * size:
            raise ValueError("not a block")
        x = np.frombuffer(block, "<u8", lanes, _HEAD.size).astype(np.uint64)
        words = np.frombuffer(block, "<u4", size, _HEAD.size + 8 * lanes).astype(np.uint64)
        ids, at, mask = np.empty(n, np.uint32), 0, np.uint64((1 << SCALE) - 1)
        for lo in range(0, n, lanes):
            hi = min(n, lo + lanes)
            now = x[:hi - lo]
            slot = now & mask
            s = self.symbol[slot]
            ids[lo:hi] = s
            now = self.freq[s] * (now >> np.uint64(SCALE)) + slot - self.below[s]
            low = np.flatnonzero(now < np.uint64(1 << LOW))
            if at + len(low) > size:
                raise ValueError("a block ends too early")
            now[low] = now[low] << np.uint64(32) | words[at:at + len(low)]
            at += len(low)
            x[:hi - lo] = now
        if at != size or zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        return ids


def write_ids(docs: DataFrame, tokenizer: str, path: str, scratch: str, end: int = 2, doc_id: str = "doc_id", text: str = "text", word: bool = False) -> None:
    """Writes the ids of all documents by ascending doc_id (null first; repeated ones in the order of their ids).
    The vocabulary may have any size; more than 2**SCALE distinct ids in the texts raise ValueError.

    `path`/blocks holds one row per block: its range, its place in the range, the ids before it in the range, the
    doc_ids and lengths of its documents and the payload.  `path`/table holds the frequencies that all blocks
    share, counted over all ids.  Payloads are decoded on their own: each carries the states of its lanes, so that
    every block is a checkpoint, and the checksum of its ids.  Spark commits both tables, so a lost executor
    leaves no part of a file.

    Documents are encoded where they lie and kept compressed in `scratch`; only these ids are moved into ranges.
    """
    spark = docs.sparkSession

    kind = docs.schema[doc_id].dataType.simpleString()
    token_rows(docs, tokenizer, word, end, doc_id, text, squeeze=True).write.option("compression", "none").parquet(scratch)
    rows = spark.read.parquet(scratch)
    known = encoder(tokenizer, word, end)
    form, size_of = known.kind, known.size
    width = np.dtype(form).itemsize

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, total = zstandard.ZstdDecompressor().decompress, np.zeros(size_of, np.int64)
        for batch in batches(it):
            ids = np.frombuffer(b"".join(map(expand, batch.column(0).to_pylist())), form)
            total += np.bincount(ids, minlength=size_of)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids])], names=["id", "n"])

    counted = rows.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row per id of the vocabulary
    counts = np.zeros(size_of, np.int64)
    counts[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    freq = frequencies(counts)
    ids = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int32()), "freq": pa.array(freq[ids], pa.int32())})).coalesce(1).write.parquet(f"{path}/table")

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, expand = Coder(freq), zstandard.ZstdDecompressor().decompress
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held, names, size = [], [], 0

        def close():
            nonlocal held, names, size, number, before
            ids = np.frombuffer(b"".join(held), form)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()),
                 pa.array([[d.as_py() for d in names]], pa.list_(names[0].type)), pa.array([[len(b) // width for b in held]], pa.list_(pa.int64())),
                 pa.array([coder.encode(ids)], pa.binary())], names=["range", "block", "before", "doc_ids", "lengths", "payload"])
            number, before = number + 1, before + len(ids)
            held, names, size = [], [], 0
            return out

        for batch in batches(it):
            for d, b in zip(batch.column(0), batch.column(1).to_pylist()):
                held.append(expand(b))
                names.append(d)
                size += len(held[-1]) // width
                if size >= BLOCK:
                    yield close()
        if held:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    dealt.mapInArrow(blocks, f"range int, block long, before long, doc_ids array<{kind}>, lengths array<long>, payload binary").write.option(
        "compression", "none").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The block rows with `start`, the ids of all documents before the block, and the frequencies."""
    table = spark.read.parquet(f"{path}/table").toArrow()  # a row per id of the vocabulary
    known = table.column("id").to_numpy()
    freq = np.zeros(int(known.max()) + 1 if len(known) else 0, np.int64)
    freq[known] = table.column("freq").to_numpy()
    rows = spark.read.parquet(f"{path}/blocks")
    totals = rows.groupBy("range").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("__n"))
    ahead = running_total(totals, "range", "__n", "__ahead").select("range", "__ahead")
    return rows.join(F.broadcast(ahead), "range").withColumn("start", F.col("before") + F.col("__ahead")).drop("__ahead"), freq


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document as decoded from the files, and its ids if asked for."""
    rows, freq = read_blocks(spark, path)
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches(it, 1):
            data = coder.decode(batch.column(3)[0].as_py()).astype("<u4").tobytes()
            n = np.array(batch.column(2)[0].as_py(), np.int64)
            ends = np.cumsum(n)
            parts = [data[4 * (b - k):4 * b] for b, k in zip(ends.tolist(), n.tolist())]
            arrays = [batch.column(1).flatten(), pa.array(batch.column(0)[0].as_py() + ends - n), pa.array(n), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(parts, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.select("start", "doc_ids", "lengths", "payload").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
