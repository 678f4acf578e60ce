"""Choosing between passes and joining their rows into one transcript."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache, reduce
from itertools import accumulate, compress, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import KEY, chars_before

BUCKET = 30_000


def bucket_winners(segs: DataFrame, recordings: DataFrame, width: int = BUCKET) -> DataFrame:
    """For each bucket of start times the pass with most characters, the later one on a tie: recording_id, bucket, pass_id, chars.

    Buckets before 0 or beyond the duration's next one do not count.
    """
    rows = segs.join(recordings, KEY).withColumn("bucket", F.floor(F.col("start") / width))
    rows = rows.where((F.col("bucket") >= 0) & (F.col("bucket") <= F.floor(F.col("duration") / width) + 1))
    sums = rows.groupBy(KEY, "bucket", "pass_id").agg(F.sum("chars").alias("chars")).where("chars > 0")
    return sums.groupBy(KEY, "bucket").agg(F.max_by("pass_id", F.struct("chars", "pass_id")).alias("pass_id"), F.max("chars").alias("chars"))


def winning_rows(segs: DataFrame, recordings: DataFrame, width: int = BUCKET) -> DataFrame:
    win = bucket_winners(segs, recordings, width).select(KEY, "bucket", "pass_id")
    return segs.withColumn("bucket", F.floor(F.col("start") / width)).join(win, [KEY, "bucket", "pass_id"], "left_semi").drop("bucket").withColumn("src", F.concat(F.lit("pass"), F.col("pass_id") + 1))


def best_attempts(patch: DataFrame, pad: int = 500) -> DataFrame:
    """For each span the attempt with most characters near it, the earlier one on a tie: recording_id, span_ord, attempt_ord, chars."""
    near = patch.where((F.col("start") >= F.col("a") - pad) & (F.col("start") <= F.col("b") + pad))
    return _most(near.groupBy(KEY, "span_ord", "attempt_ord").agg(F.sum("chars").alias("chars")))


def best_attempts_at(spans: DataFrame, rows: DataFrame, pad: int = 500) -> DataFrame:
    """``best_attempts`` where attempts are whole passes over a recording, not rows made for one span.

    ``spans``: recording_id, span_ord, a, b; ``rows``: recording_id, attempt_ord, start, chars.  Spans do
    not meet rows: an attempt's characters near a span are the difference of two running sums.
    """
    rows = rows.where(F.col(KEY).isNotNull() & F.col("start").isNotNull()).select(KEY, "attempt_ord", F.col("start").alias("at"), "chars")
    edges = F.array(F.struct((F.col("a") - pad).cast("long").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("b") + pad + 1).cast("long").alias("at"), F.lit(1).alias("sign")))
    asks = spans.where(F.col("a") - pad <= F.col("b") + pad).join(rows.select(KEY, "attempt_ord").distinct(), KEY).select(KEY, "attempt_ord", "span_ord", F.explode(edges).alias("e"))
    sums = chars_before(rows, asks.select(KEY, "attempt_ord", "span_ord", "e.*"), [KEY, "attempt_ord"]).repartition(KEY, "span_ord")
    return _most(sums.groupBy(KEY, "span_ord", "attempt_ord").agg(F.sum(F.col("sign") * F.col("before")).alias("chars")))


def _most(sums: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(KEY, "span_ord").orderBy(F.desc("chars"), "attempt_ord"))
    return sums.where("chars > 0").withColumn("nth", first).where("nth = 1").drop("nth")


def _grams(text: str, n: int) -> list[str]:
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def _hashes(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The characters of ``text``, and a hash of the ``n`` from each on."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    count = max(0, len(chars) - n + 1)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + chars[k : k + count]
    return chars, h


@lru_cache(maxsize=16)
def _index(text: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chars, h = _hashes(text, n)
    order = h.argsort(kind="stable")
    return chars, h[order], order


def _common_runs(old: str, new: str, least: int, most: int = 1_000_000):
    """The longest common runs (places in old and new, lengths less ``least`` - 1); None if above ``most`` places match."""
    (x, found, order), (y, h) = _index(old, least), _hashes(new, least)
    none = np.empty(0, int), np.empty(0, int), np.empty(0, int)
    if not len(found) or not len(h):
        return none
    lo = found.searchsorted(h)
    j = np.flatnonzero(found[np.minimum(lo, len(found) - 1)] == h)
    if not len(j):
        return none
    n = found.searchsorted(h[j], "right") - lo[j]
    if n.sum() > most:
        return None
    i = order[np.repeat(lo[j] - (n.cumsum() - n), n) + np.arange(n.sum())]
    j = np.repeat(j, n)
    same = np.logical_and.reduce([x[i + k] == y[j + k] for k in range(least)])  # hashes may be equal by chance
    i, j = i[same], j[same]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)][: len(i)])
    return i[first], j[first], np.diff(np.r_[first, len(i)])


def _finder(old: str, new: str, least: int):
    """difflib's find_longest_match, with runs of ``least`` characters as letters; None if nothing is shared."""
    runs = _common_runs(old, new, least)
    if runs is None:  # the same character over and over: more time, but no more memory
        match = SequenceMatcher(None, _grams(old, least), _grams(new, least), autojunk=False)
        return lambda *window: tuple(match.find_longest_match(*window))
    at, to, size = runs
    if not len(at):
        return None

    def find(a, a_end, b, b_end):
        skip = np.maximum(np.maximum(a - at, b - to), 0)
        n = np.minimum(np.minimum(size, a_end - at), b_end - to) - skip
        best = np.flatnonzero(n == n.max())
        k = min(best, key=lambda k: (at[k] + skip[k], to[k] + skip[k]))
        return int(at[k] + skip[k]), int(to[k] + skip[k]), max(0, int(n[k]))

    return find


def without_shared(old: str, new: str, least: int) -> str:
    """``new`` without the blocks of ``least`` or more characters that it shares with ``old``.

    The blocks are difflib's.  As it looks for the longest first, nothing remains to be found where that is
    shorter, so runs of ``least`` characters serve as its letters; texts without a common run cost next to nothing.
    """
    find, left, todo = _finder(old, new, least), [True] * len(new), [(0, len(old), 0, len(new))]
    if find is None:
        return new
    while todo:
        a, a_end, b, b_end = todo.pop()
        if min(a_end - a, b_end - b) < least:
            continue
        i, j, size = find(a, a_end - least + 1, b, b_end - least + 1)
        if size:
            size += least - 1
            left[j : j + size] = [False] * size
            todo += [(a, i, b, j), (i + size, a_end, j + size, b_end)]
    return "".join(compress(new, left))


def deduplicated(rows: list[dict], look_back: int = 6, slack: int = 300) -> list[dict]:
    """Rows in time order, each without what the last few kept rows have said already.

    Against a row it overlaps in time, shared blocks of 8 characters go.  Against one it does not,
    a row goes only as a whole: if all but a few characters, in number and in share, are shared
    blocks of 10.  Rows of less than 3 characters go; a row whose text has changed loses its words.
    """

    def said_anew(row: dict, text: str, seen: dict) -> str:
        """What of ``text`` a kept row has not said."""
        overlaps = seen["end"] > row["start"] + slack
        rest = without_shared(seen["text"], text, 8 if overlaps else 10)
        return rest if overlaps else text if len(rest) >= min(6, 0.3 * len(text)) else ""

    def add(kept: list[dict], row: dict) -> list[dict]:
        texts = accumulate(reversed(kept[-look_back:]), lambda text, seen: said_anew(row, text, seen) if len(text.strip()) >= 3 else "", initial=row["text"])
        *_, text = map(str.strip, texts)
        if len(text) >= 3:
            kept.append(row | {"text": text} | ({} if text == row["text"].strip() else {"words": None}))
        return kept

    return reduce(add, sorted(rows, key=lambda r: (r["start"], r["start"] - r["end"])), [])


def patched(rows: list[dict], patches: list[dict], pad: int = 500) -> list[dict]:
    """Rows with each patch (a, b, rows) in order put in the place of what it clearly betters.

    A patch must have over half as many characters again as the rows that overlap its span, and 10 more.
    """
    times = lambda rows: np.array([(r["start"], r["end"], len(r["text"])) for r in rows], float).reshape(-1, 3)
    at = times(rows)
    for p in patches:
        have = at[(at[:, 0] < p["b"]) & (at[:, 1] > p["a"]), 2].sum()
        if 2 * sum(len(r["text"]) for r in p["rows"]) > 3 * have + 20:
            keep = (at[:, 0] < p["a"] - pad) | (at[:, 1] > p["b"] + pad)
            rows, at = [*compress(rows, keep), *p["rows"]], np.concatenate([at[keep], times(p["rows"])])
    return rows


MERGED = "recording_id string, row_ord int, start bigint, end bigint, text string, src string"


def merged(rows: DataFrame, patch: DataFrame | None = None) -> DataFrame:
    """The transcript of each recording from winning rows and the best attempts of its patches.

    Both steps depend on what earlier rows became, so they are a fold; a recording is the unit
    (a day of speech is some 20,000 rows).  ``rows``: recording_id, start, end, text, src, seg_ord;
    ``patch``: recording_id, span_ord, a, b, row_ord, start, end, text.
    """
    kinds = rows.select(KEY, F.lit(-1).alias("span_ord"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("seg_ord").alias("row_ord"), "start", "end", "text", "src")
    if patch is not None:
        kinds = kinds.unionByName(patch.select(KEY, "span_ord", "a", "b", "row_ord", "start", "end", "text", F.lit("patch").alias("src")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rec, cols = pdf[KEY].iloc[0], ["start", "end", "text", "src"]
        rows = sorted(zip(*(pdf[c].tolist() for c in ["span_ord", "row_ord", "a", "b", *cols])), key=itemgetter(0, 1))
        spans = {span: [*group] for span, group in groupby(rows, key=itemgetter(0))}
        base, *_ = [[dict(zip(cols, r[4:])) for r in group] for span, group in spans.items() if span < 0] or [[]]
        patches = [{"a": group[0][2], "b": group[0][3], "rows": [dict(zip(cols, r[4:])) for r in group]} for span, group in spans.items() if span >= 0]
        out = deduplicated(patched(deduplicated(base), patches))
        return pd.DataFrame([(rec, i, r["start"], r["end"], r["text"], r["src"]) for i, r in enumerate(out)], columns=["recording_id", "row_ord", *cols])

    return kinds.groupBy(KEY).applyInPandas(fold, MERGED)


def replaced(text: Column, fixes: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other, in their order."""
    for wrong, right in fixes:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def count_of(text: Column, word: Column) -> Column:
    """How often ``word`` occurs in ``text`` without overlaps."""
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")).otherwise(0)


def glossary_hits(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """How often each wrong form occurs in all ``rows`` before replacement, entries without hits too: ord, wrong, hits.

    ``fixes`` is a glossary of some dozens of entries; it is sent to the rows (its size is checked).
    """
    if fixes.count() > 10_000:
        raise ValueError("a glossary of more than 10,000 entries")
    hits = rows.join(F.broadcast(fixes), F.col("text").contains(F.col("wrong"))).groupBy("ord").agg(F.sum(count_of(F.col("text"), F.col("wrong"))).alias("hits"))
    return fixes.join(hits, "ord", "left").select("ord", "wrong", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def valid_edits(rows: DataFrame) -> DataFrame:
    """The edits of final ``rows`` (row key columns, start, text, edits) whose target is still there often enough: ..., from, to, t."""
    edits = rows.select(KEY, "row_ord", "start", "text", F.explode("edits").alias("e")).select(KEY, "row_ord", "start", "text", "e.pos", "e.from", "e.to")
    nth = F.row_number().over(Window.partitionBy(KEY, "row_ord", "to").orderBy("pos", "from"))
    return edits.withColumn("nth", nth).where(F.col("nth") <= count_of(F.col("text"), F.col("to"))).select(KEY, "row_ord", "from", "to", F.col("start").alias("t"))


def top_edits(edits: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent (from, to); ties in the order of first use (t), then by text."""
    return edits.groupBy("from", "to").agg(F.count("*").alias("n"), F.min("t").alias("first")).orderBy(F.desc("n"), "first", "from", "to").limit(n).select("from", "to", "n")
