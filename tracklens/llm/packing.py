"""Best-fit packing with certified bin counts.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens (only longer documents
are cut; their first piece may be shorter).  Pieces are dealt over partitions; each partition packs
its own by best-fit decreasing and holds the number of bins against a lower bound from
dual-feasible functions (Martello-Toth thresholds and Fekete-Schepers' u(k)).  While the whole is
not certified optimal, the partitions with a gap (or, if none has one, all) put the pieces of
their bins that are not full into a pool, which is dealt anew over fewer partitions and repacked;
a repacking is kept only if it needs fewer bins.

Sizes are integers up to ``capacity``, so a bound works on a histogram of at most ``capacity``
counts and best fit finds the tightest bin through a bit set, at any number of pieces.

Null text is an empty document (its end id alone); rows that repeat are each packed; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .tokens import encoder, vocabulary

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(docs: DataFrame, vocab: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of each document with the checksum of their ids."""
    small_batches(docs.sparkSession)

    def pieces(batches):
        coder, end = encoder(vocab, False), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), coder.encode_batch(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n % capacity or capacity) if not k else capacity
                    rows.append((d, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            if rows:
                yield _batch(rows, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECE)


def _batch(rows, types, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that ``counts[size]`` items of each size need at least, by dual-feasible functions."""
    size = np.arange(capacity + 1)
    counts = counts.astype(np.int64)
    total = int((counts * size).sum())
    best = -(-total // capacity)
    # thresholds e: above capacity - e an item counts as a whole bin, below e as nothing
    items, mass = np.cumsum(counts), np.cumsum(counts * size)
    for e in range(1, capacity // 2 + 1):
        big = items[capacity] - items[capacity - e]
        mid = mass[capacity - e] - mass[e - 1]
        best = max(best, int(big) - (-int(mid) // capacity))
    for k in range(1, 32):
        whole = (size * (k + 1)) % capacity == 0
        # u(k) in units of 1 / (k * capacity)
        u = np.where(whole, size * k, ((k + 1) * size // capacity) * capacity)
        best = max(best, -(-int((counts * u).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items in descending order: bin, offset in it, and the fill of each bin."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins, fill = 0, np.empty(len(lengths), np.int64), []
    offset = np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            rooms[room].append(b)
            some |= 1 << room
    return bins, offset, np.array(fill, np.int64)


PACKED = PIECE + ", sequence_id bigint, offset bigint, fill bigint, part_bins bigint, part_bound bigint"


def _pack(items: DataFrame, parts: int, seed: int, first_id: int, capacity: int) -> DataFrame:
    """Deal the items over ``parts`` partitions by a hash and pack each."""

    def pack(batches):
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        if not t.num_rows:
            return
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t.column("length").to_numpy()
        bins, offset, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        base = first_id + (TaskContext.get().partitionId() << 32)
        for name, x in (("sequence_id", bins + base), ("offset", offset), ("fill", fill[bins]), ("part_bins", np.full(len(bins), len(fill))), ("part_bound", np.full(len(bins), bound))):
            t = t.append_column(name, pa.array(x, pa.int64()))
        yield from t.to_batches(50_000)

    dealt = items.repartition(parts, F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed)))
    return dealt.mapInArrow(pack, PACKED)


def pack(pieces: DataFrame, capacity: int = 1024, per_part: int = 100_000, rounds: int = 4) -> DataFrame:
    """Pack staged ``pieces``; ``per_part`` bounds what one task holds (about 100 bytes an item)."""
    n = pieces.count()
    parts = max(1, -(-n // per_part))
    packed = staged(_pack(pieces, parts, 0, 0, capacity), "packed")
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        hist[r["length"]] = r["count"]
    bound = lower_bound(hist, capacity)
    done: list[DataFrame] = []
    full_bins = 0
    for turn in range(1, rounds + 1):
        bins = packed.where("offset = 0")
        now, gaps = bins.agg(F.count("*"), F.coalesce(F.max(F.col("part_bins") - F.col("part_bound")), F.lit(0))).first()
        if parts == 1 or full_bins + now <= bound:
            break
        open_bin = F.col("fill") < capacity
        if gaps:
            open_bin &= F.col("part_bins") > F.col("part_bound")
        pool = packed.where(open_bin)
        m, pool_bins = pool.agg(F.count("*"), F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0))).first()
        parts = max(1, -(-m // per_part), parts // 8 if m > per_part else 1)
        again = staged(_pack(pool.select("doc_id", "piece", "start", "length", "ids_crc32"), parts, turn, turn << 52, capacity), "packed")
        if again.where("offset = 0").count() >= pool_bins:
            break
        kept = packed.where(~open_bin)
        done.append(kept)
        full_bins += now - pool_bins
        packed = again
    for d in done:
        packed = packed.unionByName(d)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocab: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    return pack(staged(cut(docs, vocab or vocabulary("byte_bpe_50k.json"), end_id, capacity), "pieces"), capacity)
