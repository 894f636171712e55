"""Token-ID output: shards of concatenated ids whose document boundaries are Elias-Fano coded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import elias_fano as ef
from .common import arrow_schema, has_columns, materialize, partitions, text_slices
from .tokens import default_path, encoder
from pyspark.sql import types as T

MAGIC = b"EFTOK001"
_HEAD = struct.Struct("<8sBxxxIqqq")
_SEQ = struct.Struct("<qqqqq")

SHARDS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("blob", T.BinaryType()),
])


def _put(e: dict) -> bytes:
    return _SEQ.pack(e["n"], e["l"], len(e["low"]), len(e["high"]), len(e["samples"])) + e["low"] + e["high"] + e["samples"]


def _get(raw: memoryview, at: int) -> tuple[dict, int]:
    n, l, *sizes = _SEQ.unpack_from(raw, at)
    at += _SEQ.size
    out: dict = {"n": n, "l": l}
    for k, size in zip(("low", "high", "samples"), sizes):
        out[k] = raw[at : at + size].tobytes()
        at += size
    return out, at


def pack_shard(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One shard: header, boundaries (the end of each document) and document ids as Elias-Fano
    sequences, then the ids. ``doc_ids`` ascend, nulls first."""
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    head = _HEAD.pack(MAGIC, width, nulls, len(ids), int(ends[-1]) if len(ends) else 0, least)
    span = known.astype(np.uint64) - np.uint64(least & (1 << 64) - 1)
    last = int(span[-1]) if len(span) else 0
    return head + _put(ef.encode(ends, int(ends[-1]) if len(ends) else 0)) + _put(ef.encode(span, last)) + b"".join(ids)


class Shard:
    """Reads a packed shard: ``bounds(i)`` and ``offsets(a, b)`` by select, ``doc_ids()`` in bulk."""

    def __init__(self, blob: bytes):
        raw = memoryview(blob)
        magic, width, self.nulls, self.n_docs, self.n_tokens, self.least = _HEAD.unpack_from(raw, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self._ends, at = _get(raw, _HEAD.size)
        self._docs, at = _get(raw, at)
        self.ids = np.frombuffer(raw, f"<u{width}", offset=at)

    def bounds(self, i: int) -> tuple[int, int]:
        return (ef.select(self._ends, i - 1) if i else 0), ef.select(self._ends, i)

    def offsets(self, a: int, b: int) -> np.ndarray:
        """Where documents a .. b - 1 begin, and where the last of them ends."""
        ends = ef.select_many(self._ends, np.arange(max(a - 1, 0), b))
        return ends if a else np.concatenate([np.zeros(1, np.int64), ends])

    def doc_ids(self) -> list[int | None]:
        known = ef.decode(self._docs).astype(np.uint64) + np.uint64(self.least & (1 << 64) - 1)
        return [None] * self.nulls + known.astype(np.int64).tolist()

    def tokens(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shard_tokens: int = 1 << 21) -> DataFrame:
    """Encode every text and write shards in ascending ``doc_id`` order; returns the written table.

    Texts are range-partitioned by ``doc_id`` and sorted, so a shard is a run of neighbours and
    (part, seq) is the order of the whole. A shard closes at ``shard_tokens``; a longer document
    fills one alone. Null texts are empty (the end id alone), null ids come first, repeated ids keep
    all their rows, in the order of a hash of their texts and spread by it over tasks; an empty table gives
    no shard; other columns of ``docs`` take no part.
    """
    path = tokenizer or default_path()
    wanted = arrow_schema(SHARDS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(path)
        width = enc.dtype.itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            row = [part, seq, len(ids), size // width, pack_shard(names, ids, width)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, wanted)], schema=wanted)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, "text", 4 << 20):
                for k, x in zip(keys[first:], enc.encode(texts)):
                    ids.append(x + end)
                    names.append(k)
                    size += len(x) + width
                    if size >= shard_tokens * width:
                        yield close()
                        ids, names, size, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    rows = has_columns(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return materialize(rows.select("doc_id", "text").mapInArrow(write, SHARDS), "token-shards")


def read_documents(shards: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """Per document of written shards: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    Starts add each shard's base, a running sum over the shards' counts alone (the id columns aren't
    read for it). Up to ``broadcast_rows`` bases (16 bytes each) are broadcast, more are joined.
    """
    counts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    own = Window.partitionBy("part").orderBy("seq")
    starts = shards.select("part", "seq", (F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("own_base"))
    starts = starts.join(base, "part").select("part", "seq", (F.col("part_base") + F.col("own_base")).alias("base"))
    if shards.count() <= broadcast_rows:
        starts = F.broadcast(starts)
    out = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    wanted = arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Shard(blob.as_py())
                at = s.offsets(0, s.n_docs)
                begins, ends = at[:-1], at[1:]
                crc = [zlib.crc32(s.ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                cols = [s.doc_ids(), begins + base, ends - begins, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=wanted)

    return shards.join(starts, ["part", "seq"]).select("base", "blob").mapInArrow(read, out)
