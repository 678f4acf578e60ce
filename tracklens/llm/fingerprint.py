"""Document fingerprints from content-defined chunks.

A gear hash (each byte's random word, shifted left by its distance over 32 bytes) marks places
that depend on the text around them only, so an edit moves no chunk border far from it.  Cuts are
normalised: below ``NORMAL`` bytes a place must match the strict mask, beyond it the loose one; no
chunk is below ``SMALLEST`` (but a text's last) or above ``LARGEST`` bytes.  A fingerprint is the
set of chunk digests with their lengths (48-bit digest, 16-bit length, sorted, hex), and the
likeness of one to another the share of its length that the other's chunks contain.

Null text is empty; an empty text has the fingerprint "" and is like (1.0) an empty text only.
Rows that share a ``doc_id`` follow each other by their texts; null ids come last in descending
order; one row alone is its own next; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, small_batches, staged

SMALLEST, NORMAL, LARGEST = 32, 96, 512
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xF8000000)
WINDOW = 32
#: A random word for each byte value.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def cuts(texts: list[bytes]) -> list[list[int]]:
    """The chunk ends of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + WINDOW)])
    h = np.zeros(int(starts[-1]), np.uint32)  # zeros between texts keep one from reaching into the next
    raw = np.frombuffer(bytes(WINDOW).join(texts) + bytes(WINDOW), np.uint8)
    np.take(GEAR, raw, out=h)
    for s, n in zip(starts.tolist(), sizes.tolist()):
        h[s + n : s + n + WINDOW] = 0
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    places = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[places] & STRICT) == 0).tolist()
    bounds = np.searchsorted(places, starts).tolist()
    places = places.tolist()
    out = []
    for t, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        ends, at, i, last = [], 0, bounds[t], bounds[t + 1]
        while n - at > SMALLEST:
            least, usual, most = at + SMALLEST, at + NORMAL, min(at + LARGEST, n)
            end = most
            while i < last:
                p = places[i] - s + 1
                if p > most:
                    break
                i += 1
                if p >= usual or p >= least and strict[i - 1]:
                    end = p
                    break
            ends.append(end)
            at = end
        if at < n:
            ends.append(n)
        out.append(ends)
    return out


def fingerprints(texts: list[str]) -> list[frozenset[int]]:
    """The chunks of each text as words of 48 digest and 16 length bits."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    raw = [t.encode() for t in texts]
    out = []
    for t, ends in zip(raw, cuts(raw)):
        at, words = 0, set()
        for e in ends:
            words.add(digest(t[at:e]) & ~0xFFFF | (e - at))
            at = e
        out.append(frozenset(words))
    return out


def as_text(words: frozenset[int]) -> str:
    return np.array(sorted(words), ">u8").tobytes().hex()


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    """The share of a's length whose chunks b has too."""
    if not a:
        return float(not b)
    both = a & b
    return sum(x & 0xFFFF for x in both) / sum(x & 0xFFFF for x in a) if both else 0.0


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by the beginning of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
EDGE = [pa.int32(), pa.int32(), pa.string()]
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _judge(ids: list, texts: list[str], nexts: list[str], own: list[frozenset], after: list[frozenset]) -> list[list]:
    changed = [edited(t, x) for t, x in zip(texts, nexts)]
    prints = fingerprints(changed)
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(c.encode()).hexdigest() for c in changed], [as_text(w) for w in own], [as_text(w) for w in prints],
        [likeness(a, b) for a, b in zip(own, prints)], [likeness(a, b) for a, b in zip(own, after)],
    ]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint each document, its edited text, and compare them and the next document.

    Documents are range-sorted once; each finds its neighbour in the task's stream.  The first
    document of each task and the last of the task before are matched afterwards, a row a task.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def walk(batches):
        part = TaskContext.get().partitionId()
        text_before, print_before, d = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            prints = fingerprints(texts)
            rows = [ids, texts, [text_before, *texts[:-1]], prints, [print_before, *prints[:-1]]]
            if text_before is None:
                yield _rows([[ids[0]], *[[None]] * 6], [[part], [1], [texts[0]]])
                rows = [c[1:] for c in rows]
            text_before, print_before, d = texts[-1], prints[-1], ids[-1]
            if rows[0]:
                n = len(rows[0])
                yield _rows(_judge(*rows), [[part] * n, [0] * n, [None] * n])
        if text_before is not None:
            yield _rows([[d], *[[None]] * 6], [[part], [2], [text_before]])

    def ends(batches):
        for b in batches:
            ids, texts, nexts = (b.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_judge(ids, texts, nexts, fingerprints(texts), fingerprints(nexts)), TYPES)], NAMES)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = some.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    walked = staged(ordered.mapInArrow(walk, RESULT + ", part int, edge int, text string"), "z_fingerprints")
    lasts = walked.where("edge = 2")
    # a row for each task: the one before it that has documents, for the first the last
    turn = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = lasts.select("part").withColumns({"before": F.lag("part").over(Window.orderBy("part")), "top": F.max("part").over(turn)})
    parts = parts.select("part", F.coalesce("before", "top").alias("before"))
    pairs = (
        walked.where("edge = 1").select("part", "doc_id", "text").join(parts, "part")
        .join(lasts.select(F.col("part").alias("before"), F.col("text").alias("next_text")), "before").select("doc_id", "text", "next_text")
    )
    return walked.where("edge = 0").select(*NAMES).unionByName(pairs.mapInArrow(ends, RESULT))


def _rows(values: list[list], edge: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*values, *edge], [*TYPES, *EDGE])], [*NAMES, "part", "edge", "text"])
