"""Token ids in patched frame-of-reference blocks.

A segment is a run of whole documents: header, document table, block index, packed blocks, exceptions.
A block holds 128 ids: its minimum is subtracted, the rest is packed at the width that a percentile of
its differences needs (2 words of 64 bits for each bit of width), and what doesn't fit keeps its low
bits in the block and its high bits in the exception list. The index has each block's minimum, width,
start of its words and start of its exceptions, so any range of ids is read without the others. Segments
are rows of Parquet files, so that files are written and read by Spark on whatever store it runs on.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shared_folder
from .wordtable import word_table

BLOCK, MAGIC, PERCENTILE = 128, b"PFR1", 90
#: Ids at which a segment is closed (it ends with the document that reaches it).
SEGMENT_IDS = 1_000_000
#: Texts whose new words are learnt together.
ENCODE_ROWS = 100
#: Segments whose starts are broadcast (16 bytes each); beyond this number they are joined by a shuffle.
BROADCAST_SEGMENTS = 500_000
SCHEMA = "part int, segment int, n_docs int, n_tokens long, payload binary"
_HEAD = struct.Struct("<4sIQIIB")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.where(x == 0, 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))) + 1).astype(np.uint8)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    words = np.zeros((len(rows), 2 * width), np.uint64)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        words[:, at] |= rows[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return words


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = np.zeros((len(words), BLOCK), np.uint64)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        rows[:, i] = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            rows[:, i] |= words[:, at + 1] << np.uint64(64 - shift)
    return rows & np.uint64((1 << width) - 1)


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """A segment of documents (ids null or 64-bit) whose ids lie one after the other in ``ids`` (unsigned 32-bit)."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    rows = np.empty(blocks * BLOCK, np.uint64)
    rows[:n] = ids
    rows[n:] = ids[-1] if n else 0
    rows = rows.reshape(blocks, BLOCK)
    low = rows.min(1) if blocks else np.zeros(0, np.uint64)
    rows = rows - low[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _bits(np.partition(rows, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    high = rows >> width[:, None].astype(np.uint64)
    block, place = np.nonzero(high)
    spill = high[block, place].astype("<u4")
    rows &= ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    starts = np.concatenate(([0], np.cumsum(2 * width.astype(np.int64))))
    words = np.zeros(int(starts[-1]), "<u8")
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            words[starts[own][:, None] + np.arange(2 * int(w))] = _pack(rows[own], int(w))
    return b"".join((
        _HEAD.pack(MAGIC, len(doc_ids), n, blocks, len(spill), percentile),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is not None for x in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u4").tobytes(),
        low.astype("<u4").tobytes(), width.tobytes(), starts.astype("<u4").tobytes(), np.searchsorted(block, np.arange(blocks + 1)).astype("<u4").tobytes(),
        words.tobytes(), place.astype(np.uint8).tobytes(), spill.tobytes(),
    ))


class Segment:
    """Reads a packed segment; ``ids(lo, hi)`` opens only the blocks of that range."""

    def __init__(self, payload: bytes):
        magic, docs, self.n, blocks, spills, _ = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        ids, known, self.lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.low, self.width, self.starts, self.exceptions = take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1), take("<u4", blocks + 1)
        self.words = take("<u8", int(self.starts[-1]))
        self.place, self.spill = take("u1", spills), take("<u4", spills)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n if hi is None else min(hi, self.n)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // BLOCK, -(-hi // BLOCK)
        width = self.width[first:last]
        rows = np.zeros((last - first, BLOCK), np.uint64)
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                rows[own] = _unpack(self.words[self.starts[first + own].astype(np.int64)[:, None] + np.arange(2 * int(w))], int(w))
        a, b = int(self.exceptions[first]), int(self.exceptions[last])
        block = np.repeat(np.arange(last - first), np.diff(self.exceptions[first : last + 1]))
        rows[block, self.place[a:b]] |= self.spill[a:b].astype(np.uint64) << width[block].astype(np.uint64)
        rows += self.low[first:last, None]
        return rows.reshape(-1)[lo - first * BLOCK : hi - first * BLOCK].astype(np.uint32)


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", kind: str = "word", segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes whole texts (null: empty), appends ``end_id`` and writes segments in ascending ``id_col`` order.

    Texts are dealt out by ranges of the id and sorted there; the number of a part is its place in the
    order. Null ids come first; rows of equal id are ordered by text hash, and repeated rows repeat.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, segment = word_table(tokenizer, kind), TaskContext.get().partitionId(), 0
        ids, lengths, parts, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            payload = pack_segment(ids, lengths, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], ["part", "segment", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                some = batch.slice(at, ENCODE_ROWS)
                for i, own in zip(some.column(0).to_pylist(), table.encode_many(some.column(1).to_pylist()), strict=True):
                    ids.append(i)
                    lengths.append(len(own) // 4 + 1)
                    parts += (own, end)
                    n += lengths[-1]
                    if n >= segment_ids:
                        yield row()
                        ids, lengths, parts, n, segment = [], [], [], 0, segment + 1
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    rows.repartitionByRange("i", "h").sortWithinPartitions("i", "h", "t").select("i", "t").mapInArrow(pack, SCHEMA).write.parquet(to)


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """One row per document of the files at ``at``: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (array), ``ids_le`` (little-endian 32-bit bytes)."""
    rows = spark.read.schema(SCHEMA).parquet(at)
    sizes = rows.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each writing task
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    inside = sizes.withColumn("inside", F.sum("n_tokens").over(W.partitionBy("part").orderBy("segment")) - F.col("n_tokens"))
    base = cut(inside.join(before, "part").select("part", "segment", (F.col("base") + F.col("inside")).alias("base")))
    if base.count() <= BROADCAST_SEGMENTS:
        base = F.broadcast(base)  # the packed segments themselves stay where they are read

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(payload.as_py())
                ids = s.ids().astype("<u4")
                ends = np.concatenate(([0], np.cumsum(s.lengths, dtype=np.int64)))
                flat, cuts = pa.py_buffer(ids.tobytes()), ends.astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.Array.from_buffers(pa.int32(), len(ids), [None, flat]))
                raw = pa.Array.from_buffers(pa.binary(), len(s.doc_ids), [None, pa.py_buffer((4 * cuts).tobytes()), flat])
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(base + ends[:-1]), pa.array(s.lengths.astype(np.int64)), lists, raw], ["doc_id", "start", "n_tokens", "ids", "ids_le"])

    full = rows.join(base, ["part", "segment"]).select("base", "payload")
    return full.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids array<int>, ids_le binary")


def token_digests(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` to a new folder under ``folder`` (default: the shared checkpoint folder), reads it back and
    returns ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``. An empty table gives an empty result."""
    spark = docs.sparkSession
    at = f"{(folder or shared_folder(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, at, tokenizer, id_col=id_col, text_col=text_col)
    return read_tokens(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
