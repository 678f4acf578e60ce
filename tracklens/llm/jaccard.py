"""Near duplicates: a Jaccard join on shingles of five words with Bayesian candidate pruning.

1. Each document gets its set of shingle hashes (64 bits), a 128-bit key of the set, and the band
   keys of a MinHash signature (20 bands of 4 values: a pair at 0.8 misses all with p = 3e-5).
   Documents of equal sets are one node from here on.
2. Nodes that share a band key are linked to the least of them; components of those links are the
   candidate groups.  No pairs are made within a bucket.
3. A group of more than ``block`` nodes or ``most`` shingles is dealt into blocks by a hash, and each pair of blocks is a
   unit of work; all pairs of a unit are compared in the task and none is emitted: values of the
   signatures are compared 16 at a time, a pair is dropped once the posterior probability (uniform
   prior) that its similarity reaches the threshold is below ``tolerance``, and the rest are
   verified on the whole sets.
4. A unit gives for each node its number of verified links and the least node it is connected to;
   components of the latter are the classes.

Documents of one to four words have one shingle of all their words; empty or null texts have none
and stand alone.  Words are cut at white space, case counts.  Rows of null ``doc_id`` stand alone
with null ids.  Repeated rows are copies.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import kept, partitions, small_batches, staged
from .graph import components

WORDS, BANDS, ROWS = 5, 20, 4
HASHES = BANDS * ROWS
STEP = 16
_P = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240501)
#: Odd multipliers of the hash functions, and of a band's values.
MULTIPLIERS = _RNG.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
BAND_MULTIPLIERS = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    def __init__(self, capacity: int = 200_000):
        self.known: dict[str, int] = {}
        self.capacity = capacity

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        if len(self.known) > self.capacity:
            self.known = {}
        known, out = self.known, []
        for t in texts:
            words = (t or "").split()
            for w in set(words).difference(known):
                known[w] = digest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            n = min(WORDS, len(h))
            if not n:
                out.append(h)
                continue
            s = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                s = s * _P + h[k : len(h) - n + 1 + k]
            out.append(np.unique(_mix(s + np.uint64(n))))
        return out


def shingler() -> Shingler:
    """One for all tasks of a Python worker."""
    return kept(("shingler",), Shingler)


def signature(s: np.ndarray) -> np.ndarray:
    """The MinHash values (32 bits) of a non-empty set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max)
    for lo in range(0, len(s), 512):
        low = np.minimum(low, (s[lo : lo + 512, None] * MULTIPLIERS).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    h = (sig.reshape(BANDS, ROWS).astype(np.uint64) * BAND_MULTIPLIERS).sum(axis=1, dtype=np.uint64)
    return _mix(h + np.arange(1, BANDS + 1, dtype=np.uint64) * _P).view(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values: fewest matches at which a pair may still reach the threshold.

    With a uniform prior the posterior of m matches in n values is Beta(m + 1, n - m + 1), and
    P(J >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def links_of(sets: list[np.ndarray], sigs: np.ndarray, first: int, threshold: float, least: list[int]) -> list[tuple[int, int]]:
    """Linked pairs (i, j), i < j, of a unit: within all if ``first`` is 0, else between the first ones and the rest."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, place = np.unique(flat, return_inverse=True)
    ends = np.cumsum(n).tolist()
    of = [place[e - k : e] for e, k in zip(ends, n.tolist())]
    seen = np.zeros(int(place.max()) + 1, bool)
    out = []
    for i in range(first or len(sets)):
        js = np.arange(first or i + 1, len(sets))
        js = js[(np.minimum(n[js], n[i]) >= threshold * np.maximum(n[js], n[i]) - 1e-9)]
        match = np.zeros(len(js), np.int64)
        for k, m in enumerate(least):
            if not len(js):
                break
            match += (sigs[js, k * STEP : (k + 1) * STEP] == sigs[i, k * STEP : (k + 1) * STEP]).sum(axis=1)
            js, match = js[match >= m], match[match >= m]
        if len(js):
            seen[of[i]] = True
            for j in js.tolist():
                both = int(np.count_nonzero(seen[of[j]]))
                if both >= threshold * (n[i] + n[j] - both) - 1e-9:
                    out.append((i, j))
            seen[of[i]] = False
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key and size of the shingle set, band keys (none for an empty set)."""
    small_batches(docs.sparkSession)

    def sketch(batches):
        import xxhash

        for b in batches:
            sets = shingler().sets(b.column(1).to_pylist())
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            rows = [bands(signature(s)) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "key", "shingles", "bands"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return some.mapInArrow(sketch, "doc_id bigint, key binary, shingles bigint, bands array<bigint>")


def candidate_groups(sketched: DataFrame) -> DataFrame:
    """node, root for each node that shares a band key with another."""
    rows = sketched.where("doc_id IS NOT NULL").select("key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("band", "low")
    # merge joins here and for the texts: one plan at every size
    return components(rows.join(shared.hint("merge"), "band").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct())


def verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float, tolerance: float, block: int, most: int) -> tuple[DataFrame, bool]:
    """node, near (least node it is connected to in a unit), links (to documents); whether any group has several units."""
    spark = docs.sparkSession
    # staged, so that both sides of the next join come straight from a shuffle and a large group can be split
    members = staged(groups.join(nodes, groups["node"] == nodes["key"]).select("root", "key", "rep", "copies", "shingles"), "members")
    sizes = staged(members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("shingles") / most)).alias("blocks")), "sizes")
    members = members.join(sizes, "root").select("root", "blocks", "key", "rep", "copies")
    members = staged(members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))), "members")
    several = members.agg(F.coalesce(F.max("blocks"), F.lit(0))).first()[0] > 1
    texts = members.hint("merge").join(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")), "rep")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def to_sets(batches):
        import xxhash

        for b in batches:
            sets = shingler().sets(b.column(b.schema.get_field_index("text")).to_pylist())
            raw = [s.tobytes() for s in sets]
            # another row of that id may have another text
            keep = pa.array([xxhash.xxh3_128_digest(r) == k for r, k in zip(raw, b.column(b.schema.get_field_index("key")).to_pylist())], pa.bool_())
            cols = [b.column(b.schema.get_field_index(c)) for c in ("root", "blocks", "block", "key", "copies")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(raw, pa.binary())], ["root", "blocks", "block", "key", "copies", "shingles"]).filter(keep)

    sets = texts.mapInArrow(to_sets, "root binary, blocks bigint, block bigint, key binary, copies bigint, shingles binary")
    units = sets.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")})
    units = units.repartition(partitions(spark), "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "side", "key").select("root", "lo", "hi", "side", "key", "copies", "shingles")
    least = least_matches(threshold, tolerance)

    def unit(rows: list[tuple]):
        rows = list({(r[3], r[4]): r for r in rows}.values())  # a row that repeats in the input
        first = sum(not r[3] for r in rows) if rows[0][1] != rows[0][2] else 0
        # of two blocks, pairs of one alone are compared in that block's own unit
        if len(rows) < 2 or rows[0][1] != rows[0][2] and first in (0, len(rows)):
            return
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        up, links = list(range(len(rows))), [0] * len(rows)

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for i, j in links_of(sets, np.array([signature(s) for s in sets]), first, threshold, least):
            links[i] += rows[j][5]
            links[j] += rows[i][5]
            a, b = top(i), top(j)
            if a != b:
                a, b = (a, b) if rows[a][4] < rows[b][4] else (b, a)
                up[b] = a
        for i, n in enumerate(links):
            if n:
                yield rows[i][4], rows[top(i)][4], n

    def compare(batches):
        held: list[tuple] = []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][:3] != r[:3]:
                    out += unit(held)
                    held = []
                held.append(r)
            if out:
                yield _links(out)
        if held and (out := list(unit(held))):
            yield _links(out)

    return units.mapInArrow(compare, "node binary, near binary, links bigint"), several


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64()))], ["node", "near", "links"])


def classified(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 256, most: int = 4_000_000) -> DataFrame:
    """What near_duplicates gives, and each row's set (key) and class (class_key), both null for an empty set."""
    sketched = staged(sketches(docs), "sketches")
    nodes = staged(sketched.where("doc_id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("shingles").alias("shingles")), "nodes")
    found, several = verified(docs, nodes, candidate_groups(sketched), threshold, tolerance, block, most)
    found = staged(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("near").alias("near"))
    if several:
        roots = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
        links = links.join(roots, "node").select("node", "links", F.col("root").alias("near"))
    links = staged(links, "classes")
    least = links.join(nodes, links["node"] == nodes["key"]).groupBy("near").agg(F.min("rep").alias("class_id"))
    linked = links.join(least, "near").select(F.col("node").alias("key"), "links", "class_id", "near")
    named = nodes.join(linked, "key", "left").select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("near", "key").alias("class_key"))
    named = staged(named, "named")  # then both sides come straight from a shuffle, and a set of very many copies can be split
    own = F.when(F.col("rep").isNull() | F.col("doc_id").isNull(), F.col("doc_id"))
    counted = own.isNull() & F.col("rep").isNotNull() & F.col("doc_id").isNotNull()
    return sketched.select("doc_id", "key").join(named, "key", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "rep")).alias("rep_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "class_id")).alias("class_id"),
        F.when(counted, F.col("copies")).otherwise(1).alias("n_copies"), F.when(counted, F.col("links") + F.col("copies") - 1).otherwise(0).alias("n_links"), "key", "class_key",
    )


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """A row for each document: doc_id, rep_id (least id of its shingle set), class_id (least id of its
    class of near duplicates), n_copies (documents of its set, itself too), n_links (other documents
    at the threshold or above, copies too)."""
    return classified(docs, **how).drop("key", "class_key")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents without all but one of each class of near duplicates: the row of the least id stays.

    Rows of null ids and empty texts stay.  If ids repeat, rows are told apart by their sets too: of the
    rows of the least id that of the least set stays, of rows of one id and set the least.
    """
    judged = staged(classified(docs, **how), "judged")
    repeats = judged.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeats:
        return docs.join(judged.where("doc_id <> class_id").select("doc_id").hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    stay = judged.where("doc_id = class_id AND key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct("doc_id", "key")).alias("s")).select("s.doc_id", "s.key")
    rows = keyed(docs)
    kept = rows.join(stay, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.min("doc").alias("doc"))
    return kept.select("doc.*").unionByName(rows.where("doc_id IS NULL OR key IS NULL").select("doc.*"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc (all columns), doc_id and the key of the shingle set of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def key(batches):
        import xxhash

        for b in batches:
            sets = shingler().sets(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())], ["doc", "doc_id", "key"])

    return rows.mapInArrow(key, StructType([*rows.schema.fields[:2], StructField("key", BinaryType())]))
