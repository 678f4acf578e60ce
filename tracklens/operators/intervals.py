"""Interval analytics over (recording_id, start, end) tables: islands, gaps, coverage, membership.

Everything is a window or an aggregate per recording, so Catalyst plans one shuffle on
``recording_id`` for a chain of these operators.  Order among equal starts never shows in results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = "recording_id"
#: Characters of speech a second that a text can account for.
SPEECH_RATE = 3


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def islands(segs: DataFrame) -> DataFrame:
    """The union of each recording's intervals; intervals that touch belong together.

    Returns recording_id, island (from 1), a, b, n_segments.
    """
    w = Window.partitionBy(KEY).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("start") > reach)).cast("int")
    marked = segs.select(KEY, "start", "end", opens.alias("opens"))
    numbered = marked.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(KEY, "island").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.count("*").alias("n_segments"))


def gaps(isl: DataFrame, recordings: DataFrame, least: int = 3000) -> DataFrame:
    """Stretches of at least ``least`` between islands, before the first and after the last."""
    ends = isl.select(KEY, F.col("a"), F.col("b")).unionByName(recordings.select(KEY, F.col("duration").alias("a"), F.lit(None).cast("long").alias("b")))
    w = Window.partitionBy(KEY).orderBy("a", F.col("b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("b").over(w), F.lit(0).cast("long"))
    return ends.select(KEY, before.alias("from_ms"), F.col("a").alias("to_ms")).where(F.col("to_ms") - F.col("from_ms") >= least)


def coverage(segs: DataFrame, recordings: DataFrame, least: int = 15_000, density: float = 1.2) -> DataFrame:
    """The audit of a deliverable: cover, effective speech, starved segments and characters a recording.

    ``segs`` needs chars (of the text) and spoken (of the stripped text).  Speech counts no more of
    a segment than its characters account for.  Percentages are 0 for recordings without duration.
    """
    length = F.col("end") - F.col("start")
    cover = islands(segs).groupBy(KEY).agg(F.sum(F.col("b") - F.col("a")).alias("cover"))
    starved = (length >= least) & (F.col("spoken") * 1000 < density * F.greatest(length, F.lit(1)))
    totals = segs.groupBy(KEY).agg(
        F.sum(F.least(length * SPEECH_RATE, F.col("spoken") * 1000)).alias("speech_thirds"),
        F.count_if(starved).alias("starved"), F.sum("chars").alias("chars"), F.count("*").alias("n_segments"),
    )
    pct = lambda x: F.when(F.col("duration") > 0, F.round(100.0 * x / F.col("duration"), 6)).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = recordings.join(totals, KEY, "left").join(cover, KEY, "left")
    return out.select(
        KEY, "duration", zero("cover").alias("cover"), pct(zero("cover")).alias("cover_pct"), F.round(zero("speech_thirds") / SPEECH_RATE, 3).alias("speech"),
        pct(zero("speech_thirds") / SPEECH_RATE).alias("speech_pct"), zero("starved").alias("starved"), zero("chars").alias("chars"), zero("n_segments").alias("n_segments"),
    )


def starved_spans(segs: DataFrame, least: int = 15_000, density: float = 1.2, most: int = 90_000) -> DataFrame:
    """Long segments with too few characters, cut into equal pieces of at most ``most``; confidence plays no part."""
    length = F.col("end") - F.col("start")
    hungry = segs.where((length >= least) & (F.col("spoken") * 1000 < density * length)).select(KEY, "start", length.alias("n"), F.greatest(F.lit(1), F.ceil(length / most)).cast("long").alias("pieces"))
    cut = hungry.select(KEY, "start", "n", "pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("k"))
    edge = lambda k: F.col("start") + F.expr(f"({k} * n) div pieces")
    return cut.select(KEY, edge("k").alias("a"), edge("(k + 1)").alias("b"), F.lit("starved").alias("label"))


def in_any(rows: DataFrame, spans: DataFrame, pad: int = 0, keep: bool = True, step: int | None = None) -> DataFrame:
    """``rows`` whose start lies in a span of its recording, closed at both ends and padded (or, not ``keep``, in none).

    A semi or anti join on the recording and a range.  With ``step`` the spans are spread over
    buckets of that width and the bucket is a join key too, which splits recordings of many spans.
    """
    a, b = F.col("a") - pad, F.col("b") + pad
    how = "left_semi" if keep else "left_anti"
    s = spans.select(F.col(KEY).alias("span_of"), a.alias("lo"), b.alias("hi"))
    inside = (rows[KEY] == F.col("span_of")) & (rows["start"] >= F.col("lo")) & (rows["start"] <= F.col("hi"))
    if step:
        s = s.withColumn("bucket", F.explode(F.sequence(F.expr(f"lo div {step} - 1"), F.expr(f"hi div {step}"))))
        return rows.join(s, inside & (F.floor(rows["start"] / step) == F.col("bucket")), how)
    return rows.join(s, inside, how)


def chars_before(rows: DataFrame, asks: DataFrame, by: list[str], step: int = 3_600_000) -> DataFrame:
    """``asks`` (by, at, ...) with before: the characters of ``rows`` (by, at, chars) of the same ``by`` and an earlier ``at``.

    Running sums, so the work grows with rows and asks and not with what they meet.  They run inside
    stretches of ``step``, each a group of its own that begins with the sum of all stretches before it, so
    a long recording is many groups.  Nulls in ``by`` are one group; ``at`` must not be null.
    """
    slot, rest = F.floor(F.col("at") / step), [c for c in asks.columns if c not in by and c != "at"]
    nothing = {c: F.lit(None).cast(asks.schema[c].dataType) for c in rest}
    said = rows.select(*by, "at", F.coalesce(F.col("chars").cast("long"), F.lit(0)).alias("chars"), F.lit(1).alias("turn")).withColumns(nothing)
    asked = asks.select(*by, "at", F.lit(0).cast("long").alias("chars"), F.lit(0).alias("turn"), *rest)
    marks = said.unionByName(asked).withColumn("slot", slot)
    earlier = F.sum("chars").over(Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = marks.groupBy(*by, "slot").agg(F.sum("chars").alias("chars")).withColumn("chars", F.coalesce(earlier, F.lit(0)))
    slots = slots.withColumns({"at": F.col("slot") * step, "turn": F.lit(-1)} | nothing)
    inside = Window.partitionBy(*by, "slot").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(slots).withColumn("before", F.sum("chars").over(inside)).where("turn = 0").select(*by, "at", *rest, "before")


def overlapping_chars(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """For each span the characters of rows that overlap it (open ends): recording_id, span_ord, have.

    Those of rows that start before its end, without those of rows that end by its start: running sums.
    That needs rows that end no earlier than they start, and spans that end later than they start; only
    where one does not, row and span are compared as a pair.
    """
    edge = lambda name, at, sign=0: F.struct(F.lit(name).alias("edge"), at.alias("at"), F.lit(sign).alias("sign"))
    r = rows.select(F.col(KEY).alias("row_of"), "start", "end", "chars")
    ends = r.where("end >= start AND row_of IS NOT NULL").select(F.col("row_of").alias(KEY), "chars", F.explode(F.array(edge("start", F.col("start")), edge("end", F.col("end")))).alias("e"))
    none = F.array(edge("none", F.lit(0).cast("long")))
    both = F.when(F.col(KEY).isNotNull() & (F.col("a") < F.col("b")), F.array(edge("start", F.col("b").cast("long"), 1), edge("end", F.col("a").cast("long") + 1, -1))).otherwise(none)
    asks = spans.select(KEY, "span_ord", F.explode(both).alias("e")).select(KEY, "span_ord", "e.*")
    met = chars_before(ends.select(KEY, "chars", "e.edge", "e.at"), asks, [KEY, "edge"]).select(KEY, "span_ord", (F.col("sign") * F.col("before")).alias("chars"))
    meets = (F.col(KEY) == F.col("row_of")) & (F.col("start") < F.col("b")) & (F.col("end") > F.col("a"))
    for some, others in ((spans.where("a < b"), r.where("end < start")), (spans.where("a >= b"), r)):
        met = met.unionByName(some.join(others, meets).select(KEY, "span_ord", F.col("chars").cast("long").alias("chars")))
    return met.groupBy(KEY, "span_ord").agg(F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("have"))
