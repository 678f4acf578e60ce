"""WARC archives: a deduplicating writer and a splittable reader.

Writer: one gzip member a record.  Of pages with equal payloads (of ``min_bytes`` at least) the one
with the smallest page_id is a ``response`` (of several rows of that id the one of the smallest url,
null first); the others are ``revisit`` records that carry its digest, its id and the payload's
length (in the HTTP header), but not the payload.  Which rows are which is worked out on narrow rows
without payloads; revisits are written from those.  Each attempt of a task writes a file of its own
name, and the manifest, which Spark's committer writes, names the files of the attempts that count.

Reader: files are cut into byte ranges.  A task looks for gzip magic in its range, validates a
candidate by decoding the start of the member (a WARC version line must follow), and owns all
records that start inside, reading beyond the range's end for the last.  Nothing is lost in silence:
a file must have the manifest's size and begin with a record; a record must decode to its end and
hold its digest; what follows it must be the next record, whichever task owns that, or the file's
end.  Otherwise the task fails with the path and the place; with ``damaged="skip"`` it goes on to
the next record.

Null html is an empty payload; a null url has no target line; a null page_id is a response unless
its payload is another page's, then a revisit.  An empty table gives no files and no rows; other
columns are not read.  A payload that itself holds gzipped WARC records, stored without compression,
could be misread at a range's start; the writer's deflate does not store whole payloads of text.
Folders may be local or on a store that pyarrow knows (s3a and s3n are taken for s3).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, staged

MAGIC = b"\x1f\x8b\x08"
ID = "urn:x-page:"
MANIFEST = "path string, size bigint, records bigint"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, path string, at bigint"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int | None, revisits: int | None, sha: str | None, date: str) -> bytes:
    """The bytes of one record's gzip member: of a response with ``payload``, or of a revisit with its size and hex digest."""
    again = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (size if again else len(payload))
    block = http if again else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(sha) if again else hashlib.sha1(payload).digest())}")
    if again:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{revisits}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def judged(narrow: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Of ``narrow`` rows (page_id, url, sha, bytes): the revisits (page_id, url, sha, bytes, first), and the
    responses of repeated payloads (sha, first, url, same: how many rows are alike)."""
    repeats = narrow.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "first")
    rows = staged(narrow.where(F.col("bytes") >= min_bytes).join(repeats, "sha"), "repeats")
    own = rows.where("page_id = first")
    chief = own.groupBy("sha", "first").agg(F.min_by(F.struct("url"), F.struct("url")).alias("least"))
    chief = own.join(chief, ["sha", "first"]).where(F.col("url").eqNullSafe(F.col("least.url"))).groupBy("sha", "first", "url").agg(F.count("*").alias("same"), F.first("bytes").alias("bytes"))
    chief = staged(chief, "chiefs")
    # all rows but the chief, which may have equals
    others = rows.join(chief.select("sha", F.col("url").alias("chief_url")), "sha").where(~F.col("page_id").eqNullSafe(F.col("first")) | ~F.col("url").eqNullSafe(F.col("chief_url")))
    again = chief.where("same > 1").select(F.explode(F.sequence(F.lit(2).cast("long"), F.col("same"))), F.col("first").alias("page_id"), "url", "sha", "bytes", "first").drop("col")
    return others.select("page_id", "url", "sha", "bytes", "first").unionByName(again), chief


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html) under ``folder``; returns the manifest (path, size, records) of whole files."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("sha"))
    narrow = staged(base.select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("bytes")), "narrow")
    revisits, chiefs = judged(narrow, min_bytes)
    # payloads meet narrow rows by digest and id, so that a payload of very many pages is spread
    known = revisits.select("page_id", "sha").unionByName(chiefs.where("same > 1").select(F.col("first").alias("page_id"), "sha")).distinct()
    alone = base.join(known, base["sha"].eqNullSafe(known["sha"]) & base["page_id"].eqNullSafe(known["page_id"]), "left_anti")
    # rows that share id and payload with a revisit, or are all alike: few, told apart by url, one of each kept
    mixed = base.join(chiefs.select("sha", F.col("first").alias("page_id"), F.col("url").alias("chief_url")), ["sha", "page_id"]).where(F.col("url").eqNullSafe(F.col("chief_url")))
    mixed = mixed.join(known, ["sha", "page_id"], "left_semi").groupBy("sha", "page_id", "url").agg(F.min("payload").alias("payload"))
    none = F.lit(None).cast("long")
    rows = alone.select("page_id", "url", "payload", none.alias("bytes"), none.alias("first"), F.lit(None).cast("string").alias("sha"))
    rows = rows.unionByName(mixed.select("page_id", "url", "payload", none.alias("bytes"), none.alias("first"), F.lit(None).cast("string").alias("sha")))
    rows = rows.unionByName(revisits.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "bytes", "first", "sha"))

    def write(batches):
        task, out, n = TaskContext.get(), None, 0
        for b in batches:
            for page_id, url, payload, size, first, sha in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "bytes", "first", "sha"))):
                if out is None:
                    store, root = filesystem(folder)
                    store.create_dir(root, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)  # the members are compressed already
                out.write(record(page_id, url, payload, size, first, sha, date))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "records"])

    return staged(rows.mapInArrow(write, MANIFEST), "manifest")


class _Window:
    """Bytes of a file from any place on, read a piece at a time."""

    def __init__(self, source, size: int, piece: int = 1 << 20):
        self.source, self.size, self.piece, self.base, self.data = source, size, piece, 0, b""

    def at(self, lo: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``lo`` on."""
        if not self.base <= lo or lo + n > self.base + len(self.data):
            self.source.seek(lo)
            self.base, self.data = lo, self.source.read(min(max(n, self.piece), self.size - lo))
        return self.data[lo - self.base : lo - self.base + n]

    def find(self, lo: int, hi: int) -> int:
        """The first gzip magic that begins in [lo, hi), or -1."""
        while lo < hi:
            got = self.at(lo, min(self.piece, self.size - lo))
            if len(got) < len(MAGIC):
                return -1
            if (k := got.find(MAGIC)) >= 0:
                return lo + k if lo + k < hi else -1
            lo += max(1, len(got) - len(MAGIC) + 1)
        return -1


class Damaged(ValueError):
    pass


def _begins_record(window: _Window, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(window.at(at, 4096), 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(source, size: int, lo: int, hi: int, damaged: str = "raise"):
    """(place, decoded bytes) of each WARC member that starts in [lo, hi) of a file; ``damaged``: "raise" or "skip"."""
    window, at, sure = _Window(source, size), lo, lo == 0
    while at < hi:
        if not _begins_record(window, at):
            if sure and damaged == "raise":
                raise Damaged(f"no record begins at {at}")
            sure = False
            if (at := window.find(at + 1, hi)) < 0:
                return
            continue
        d, end, parts = zlib.decompressobj(31), at, []
        try:
            while not d.eof:
                if not (got := window.at(end, 1 << 16)):
                    raise zlib.error("the file ends inside a member")
                parts.append(d.decompress(got))
                end += len(got)
        except zlib.error as e:
            if damaged == "raise":
                raise Damaged(f"the record at {at} cannot be decoded: {e}") from e
            at, sure = at + 1, False
            continue
        yield at, b"".join(parts)
        # the next record is held to begin here even if another task owns it
        at, sure = end - len(d.unused_data), True
    if sure and at < size and at >= hi and damaged == "raise" and not _begins_record(window, at):
        raise Damaged(f"no record begins at {at}")


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC header, the HTTP header, and the payload of a decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda b: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in b.decode("utf-8", "replace").split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def read_archives(manifest: DataFrame, split_bytes: int = 64 << 20, with_payload: bool = False, damaged: str = "raise") -> DataFrame:
    """The records of the files of a manifest (path, size), read by byte ranges; digests are computed anew and must agree."""

    def read(batches):
        for b in batches:
            for path, size, lo in zip(*(b.column(c).to_pylist() for c in ("path", "size", "lo"))):
                store, place = filesystem(path)
                rows, held = [], 0
                with store.open_input_file(place) as source:
                    if source.size() != size and damaged == "raise":
                        raise Damaged(f"{path} has {source.size()} bytes, not {size}")
                    found = members(source, min(size, source.size()), lo, min(lo + split_bytes, size), damaged)
                    while True:
                        try:
                            at, raw = next(found)
                        except StopIteration:
                            break
                        except Damaged as e:
                            raise Damaged(f"{path}: {e}") from e
                        warc, http, payload = parse(raw)
                        if warc.get("warc-type") not in ("response", "revisit"):
                            continue
                        ident = lambda k: int(v) if (v := warc.get(k, "").strip("<>").removeprefix(ID)) else None
                        digest = warc.get("warc-payload-digest", "").removeprefix("sha1:")
                        again = warc["warc-type"] == "revisit"
                        if not again and base32(hashlib.sha1(payload).digest()) != digest:
                            if damaged == "raise":
                                raise Damaged(f"{path}: the payload of the record at {at} does not have the digest {digest}")
                            continue
                        n = int(http["content-length"]) if again else len(payload)
                        rows.append((ident("warc-record-id"), warc.get("warc-target-uri"), n, digest, warc["warc-type"], ident("warc-refers-to") if again else None, path, at, payload if with_payload else None))
                        held += len(payload) if with_payload else 0
                        if len(rows) == 500 or held > 16 << 20:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, with_payload)

    ranges = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("lo"))
    n = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("size") / split_bytes)), F.lit(0))).first()[0]
    return ranges.repartition(max(1, int(n)), "path", "lo").mapInArrow(read, READ + (", payload binary" if with_payload else ""))


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in READ.split(", ")] + ["payload"]
    k = len(names) - (not with_payload)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*rows), kinds))[:k]], names[:k])


def archived(pages: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    found = read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")), split_bytes)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
