"""Token-id shards in patched frame-of-reference blocks.

A segment holds the ids of some whole documents in ascending ``doc_id`` order::

    magic "PFR1" | n_ids, n_docs, n_blocks: u32 | doc ids: n_docs i64 | doc is null: n_docs u8
    | ids of each doc: n_docs u32 | block index: start u32, minimum u32, width u8, exceptions u8
    | blocks

A block has 128 ids (the last is padded with its minimum).  From each id the block's minimum is
subtracted; the rest is packed at the bit width that the given percentile of the block needs;
what does not fit is an exception: its position (u8) and its value less the minimum (u32) follow
the packed bits.  The index of block starts lets a reader decode any block alone.

Segments are rows of a Parquet table (part, seg, local_start, n_ids, n_docs, payload): Spark's
committer then makes each shard appear whole, on any store, if an executor is lost while it
writes.  ``part`` follows the order of ``doc_id``; ``local_start`` counts the part's ids before.

Null ``doc_id`` sorts first; null text is empty; rows that share a ``doc_id`` are each kept, in
the order of their texts; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, small_batches, staged
from .tokens import encoder, vocabulary

BLOCK = 128
SHARD_SCHEMA = "part int, seg int, local_start bigint, n_ids bigint, n_docs int, payload binary"


def _bits(x: np.ndarray) -> np.ndarray:
    """The bit length of each value."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray, percentile: float = 90.0) -> tuple[np.ndarray, bytes]:
    """The block index (rows of start, minimum, width, exceptions) and the blocks' bytes."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    if len(ids) % BLOCK:
        full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    nth = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile / 100)) - 1))
    width = _bits(np.partition(rest, nth, axis=1)[:, nth]) if n else np.zeros(0, np.int64)
    over = (rest >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0) & (width < 32)[:, None]
    n_over = over.sum(axis=1)
    size = width * (BLOCK // 8) + 5 * n_over
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width):
        if not w:
            continue
        of = np.flatnonzero(width == w)
        mask = np.uint64((1 << int(w)) - 1)
        v = np.ascontiguousarray(rest[of].T).astype(np.uint64) & mask
        words = np.zeros((2 * w, len(of)), np.uint64)
        for j in range(BLOCK):
            k, at = divmod(j * int(w), 64)
            words[k] |= v[j] << np.uint64(at)
            if at + w > 64:
                words[k + 1] |= v[j] >> np.uint64(64 - at)
        raw = np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(of), -1)
        out[start[of][:, None] + np.arange(16 * w)] = raw
    block, where = np.nonzero(over)
    if len(block):
        nth_over = np.arange(len(block)) - np.searchsorted(block, block)
        base = start[block] + width[block] * 16
        out[base + nth_over] = where
        value = rest[block, where].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + n_over[block] + 4 * nth_over)[:, None] + np.arange(4)] = value
    index = np.zeros(n, [("start", "<u4"), ("low", "<u4"), ("width", "u1"), ("over", "u1")])
    index["start"], index["low"], index["width"], index["over"] = start[:-1], low, width, n_over
    return index, out.tobytes()


def decode_blocks(index: np.ndarray, data: bytes, n_ids: int) -> np.ndarray:
    """The ids; ``index`` may be a run of a segment's blocks, ``data`` always all its bytes."""
    raw = np.frombuffer(data, np.uint8)
    n = len(index)
    start, width, over = index["start"].astype(np.int64), index["width"].astype(np.int64), index["over"].astype(np.int64)
    rest = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        of = np.flatnonzero(width == w)
        words = np.ascontiguousarray(raw[start[of][:, None] + np.arange(16 * w)]).view("<u8").T
        words = np.ascontiguousarray(words)
        mask = np.uint64((1 << int(w)) - 1)
        v = np.empty((BLOCK, len(of)), np.uint32)
        for j in range(BLOCK):
            k, at = divmod(j * int(w), 64)
            x = words[k] >> np.uint64(at)
            if at + w > 64:
                x = x | (words[k + 1] << np.uint64(64 - at))
            v[j] = x & mask
        rest[of] = v.T
    block = np.repeat(np.arange(n), over)
    if len(block):
        nth_over = np.arange(len(block)) - np.searchsorted(block, block)
        base = start[block] + width[block] * 16
        value = np.ascontiguousarray(raw[(base + over[block] + 4 * nth_over)[:, None] + np.arange(4)]).view("<u4").ravel()
        rest[block, raw[base + nth_over]] = value
    return (rest + index["low"].astype(np.uint32)[:, None]).ravel()[:n_ids]


def pack_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, percentile: float = 90.0) -> bytes:
    index, data = encode_blocks(ids, percentile)
    return b"".join([
        b"PFR1", struct.pack("<3I", len(ids), len(doc_ids), len(index)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        lengths.astype("<u4").tobytes(), index.tobytes(), data,
    ])


def unpack_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, ids per document, and all ids of a segment."""
    if payload[:4] != b"PFR1":
        raise ValueError("not a PFR1 segment")
    n_ids, n_docs, n_blocks = struct.unpack_from("<3I", payload, 4)
    at = 16
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
    null = np.frombuffer(payload, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(payload, "<u4", n_docs, at + 9 * n_docs)
    index = np.frombuffer(payload, [("start", "<u4"), ("low", "<u4"), ("width", "u1"), ("over", "u1")], n_blocks, at + 13 * n_docs)
    ids = decode_blocks(index, payload[at + 13 * n_docs + 10 * n_blocks :], n_ids)
    return [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist())], lengths, ids


def write_shards(docs: DataFrame, vocab: str, end_id: int, segment_ids: int = 1 << 18, percentile: float = 90.0) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) in doc_id order and write the shard table; returns it as read back."""
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches):
        coder, end = encoder(vocab, True), np.array([end_id], "<u4").tobytes()
        part, seg, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def row():
            nonlocal seg, before, names, held, size
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = np.array([len(h) // 4 for h in held], np.int64)
            out = (part, seg, before, len(ids), len(names), pack_segment(names, lengths, ids, percentile))
            seg, before, names, held, size = seg + 1, before + len(ids), [], [], 0
            return out

        for b in batches:
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), coder.encode_batch(b.column(1).to_pylist())):
                names.append(d)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= segment_ids:
                    rows.append(row())
            if rows:
                yield _shards(rows)
        if names:
            yield _shards([row()])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = some.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(encode, SHARD_SCHEMA), "token_shards")


def _shards(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "seg", "local_start", "n_ids", "n_docs", "payload"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode every segment: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def decode(batches):
        for b in batches:
            for base, local, payload in zip(*(b.column(c).to_pylist() for c in ("base", "local_start", "payload"))):
                names, lengths, ids = unpack_segment(payload)
                raw = ids.astype("<u4").tobytes()
                end = np.cumsum(lengths.astype(np.int64))
                first = end - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(first.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first + base + local), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per write task, so the broadcast side and the window are small by construction
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(before), "part").select("base", "local_start", "payload").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_index(docs: DataFrame, vocab: str | None = None, end_id: int = 2) -> DataFrame:
    return read_shards(write_shards(docs, vocab or vocabulary("word_bpe_49k.json"), end_id))
