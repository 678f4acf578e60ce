"""URL filter: rules first, then a character language-model ratio.

Rules (``host/path``) fit a host and its subdomains where the path starts with the rule's; the
longest wins.  The URLs that rules accept and reject teach two Markov models over a small alphabet
(ASCII letters without case, one sign for digits, some punctuation, one for the rest): Witten-Bell
smoothing mixes orders 0 to 3, and a context seen fewer than ``least`` times passes on to the
shorter one, so the order varies with the evidence.  A URL's score is the mean over its characters
of the log-likelihood difference; the threshold is the score that separates a held-out fifth of the
taught URLs with the least mean error of the two kinds.  URLs that no rule fits are allowed at the
threshold or above.

Counts cover all URLs; there are at most 40**4 of a kind whatever the input, which bounds what the
driver gets and sends out.  Null URLs, and URLs without ``://``, have empty host and path and no
rule; their verdict comes from the models over what follows the scheme (all, if there is none).
Without URLs of both kinds to learn from, all others are allowed.  The threshold lies midway
between the scores that it parts; ties of error take the lower.  Rows that repeat are each judged; an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import small_batches

# The rules of the registered query, and the alphabet (0 is the mark before the start and after the end).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_?=&%#:~"
SIGNS = 40
ORDER = 4

_CODE = np.full(256, len(ALPHABET) + 1, np.int64)
for _i, _c in enumerate(ALPHABET, 1):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i
_CODE[ord("0") : ord("9") + 1] = ALPHABET.index("0") + 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)).otherwise(out)
    return out


def codes(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram codes (order ORDER, one for each character and the end) of some URLs, and where each begins."""
    marks = bytes(ORDER - 1)
    raw = [(u or "").partition("://")[2].encode() or (u or "").encode() for u in urls]
    flat = np.frombuffer(b"".join(marks + r.replace(b"\0", b"\x01") + b"\0" for r in raw), np.uint8)
    sign = np.where(flat == 0, 0, _CODE[flat])
    gram = np.zeros(max(0, len(sign) - ORDER + 1), np.int64)
    for k in range(ORDER):
        gram = gram * SIGNS + sign[k : len(sign) - ORDER + 1 + k]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]]).astype(np.int64)
    at = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    return gram[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def log_model(counts: np.ndarray, least: int) -> np.ndarray:
    """The log-probability of each sign after each context, from counts of n-grams by code."""
    low = np.full(SIGNS, 1.0 / SIGNS)
    for order in range(1, ORDER + 1):
        c = counts.reshape(-1, SIGNS**order).sum(axis=0).reshape(-1, SIGNS)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        below = np.tile(low.reshape(-1, SIGNS), (max(1, len(c) // max(1, low.size // SIGNS)), 1)) if order > 1 else low[None, :]
        own = (c + kinds * below) / np.maximum(total + kinds, 1)
        low = np.where(total >= least, own, below)
    return np.log(low).ravel()


def fit(judged: DataFrame, least: int = 3) -> tuple[np.ndarray, float] | None:
    """The log-ratio of each n-gram and the threshold, from ``judged`` (url, kind: 1 accepted, 0 rejected, fold)."""
    small_batches(judged.sparkSession)
    size = SIGNS**ORDER

    def count(batches):
        held = np.zeros(2 * size, np.int64)
        for b in batches:
            urls, kinds = b.column(0).to_pylist(), b.column(1).to_numpy()
            if urls:
                gram, begins = codes(urls)
                owner = np.repeat(kinds, np.diff(np.append(begins, len(gram))))
                np.add.at(held, gram + size * owner, 1)
        some = np.flatnonzero(held)
        for lo in range(0, len(some), 100_000):
            at = some[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["gram", "n"])

    taught = judged.where("fold <> 0").select("url", "kind").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    found = taught.toPandas()  # at most 2 * 40**4 rows
    counts = np.zeros(2 * size)
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    if not counts[:size].any() or not counts[size:].any():
        return None
    ratio = (log_model(counts[size:], least) - log_model(counts[:size], least)).astype(np.float32)
    step = 1 / 256
    at = F.floor(F.col("lm_score") / step).cast("long")
    seen = scored(judged.where("fold = 0"), ratio).groupBy("kind", at.alias("at")).count().collect()  # scores are bounded
    if not {0, 1} <= {r["kind"] for r in seen}:
        return ratio, 0.0
    n = {k: sum(r["count"] for r in seen if r["kind"] == k) for k in (0, 1)}
    places = sorted({r["at"] for r in seen} | {max(r["at"] for r in seen) + 1})
    error = lambda t: sum(r["count"] for r in seen if r["kind"] == 1 and r["at"] < t) / n[1] + sum(r["count"] for r in seen if r["kind"] == 0 and r["at"] >= t) / n[0]
    best = min(range(len(places)), key=lambda i: (error(places[i]), i))
    below = places[best - 1] + 1 if best else places[best]
    return ratio, (below + places[best]) / 2 * step  # the middle between the scores that it parts


def scored(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``rows`` (with a column url) and lm_score, the mean log-ratio of a URL's characters."""
    held = rows.sparkSession.sparkContext.broadcast(ratio)

    def score(batches):
        for b in batches:
            urls = b.column(b.schema.get_field_index("url")).to_pylist()
            if urls:
                gram, begins = codes(urls)
                sums = np.add.reduceat(held.value[gram].astype(np.float64), begins)
                mean = sums / np.diff(np.append(begins, len(gram)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mean)], [*b.schema.names, "lm_score"])

    return rows.mapInArrow(score, StructType([*rows.schema.fields, StructField("lm_score", DoubleType())]))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, lm_score (null where a rule decides) of every page."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    rows = rows.withColumn("verdict", verdict)
    model = fit(rows.where("rule IS NOT NULL").select("url", (F.col("verdict") == "allow").cast("int").alias("kind"), (F.crc32(F.col("url").cast("binary")) % 5).alias("fold")))
    if model is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("lm_score"))
    ratio, threshold = model
    out = scored(rows, ratio)
    by_model = F.when(F.col("lm_score") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), F.when(F.col("rule").isNull(), F.col("lm_score")).alias("lm_score"))
