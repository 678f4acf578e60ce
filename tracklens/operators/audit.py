"""Audit of a transcription against loudness: levels, loud gaps, hallucinations, breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import KEY, gaps, islands, starved_spans

# Stock phrases that a recogniser writes over silence, and labels of spans.
STOCK_PHRASES = ["点赞", "订阅", "打赏", "字幕志愿者", "中文字幕", "谢谢观看", "感谢观看", "请不吝", "字幕组", "翻译by", "本视频", "下期再见"]
LOUD_GAP, REPLACED, STARVED = "VAD响空洞", "幻觉替换段", "段内饥饿"
LOUD_MARGIN, DEAD_AIR, LOW_CONFIDENCE, NO_LEVEL = 8.0, 25.0, -1.0, -30.0

STOCK_PATTERN = "|".join(STOCK_PHRASES)


def is_stock(text: Column, pattern: str = STOCK_PATTERN) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def range_db(ranges: DataFrame, energy: DataFrame, frame_ms: int = 10, rate: int = 16_000) -> DataFrame:
    """``ranges`` (recording_id, a, b, ...) with db, the level of [a, b) in dB below full scale.

    ``energy`` holds the sum of squares of each frame.  Prefix sums make a range two equi-joins
    instead of a scan.  Edges go down to whole frames; fewer than 50 ms of samples give null.
    """
    w = Window.partitionBy(KEY).orderBy("frame_ord").rowsBetween(Window.unboundedPreceding, 0)
    sums = energy.select(KEY, (F.col("frame_ord") + 1).alias("at"), F.sum("n_samples").over(w).alias("n"), F.sum("sum_sq").over(w).alias("sq"))
    top = energy.groupBy(KEY).agg((F.max("frame_ord") + 1).alias("frames"))
    r = ranges.join(top, KEY, "left")
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.expr(f"{c} div {frame_ms}"), F.col("frames")))
    r = r.withColumns({"_lo": clamp("a"), "_hi": clamp("b")})
    for side in ("lo", "hi"):
        s = sums.select(F.col(KEY).alias(f"_{side}_of"), F.col("at").alias(f"_{side}_at"), F.col("n").alias(f"_{side}_n"), F.col("sq").alias(f"_{side}_sq"))
        r = r.join(s, (r[KEY] == s[f"_{side}_of"]) & (r[f"_{side}"] == s[f"_{side}_at"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n, sq = zero("_hi_n") - zero("_lo_n"), F.greatest(zero("_hi_sq") - zero("_lo_sq"), F.lit(0.0))
    db = 20 * F.log10(F.greatest(F.sqrt(sq / n), F.lit(1e-9)) / 32768)
    return r.withColumn("db", F.when(n >= rate // 20, db)).select(*ranges.columns, "db")


def level_windows(isl: DataFrame, first: int = 200, least: int = 3000, most: int = 20_000) -> DataFrame:
    """The stretches that set the speech level: of the first islands those long enough, cut short."""
    nth = F.row_number().over(Window.partitionBy(KEY).orderBy("a"))
    return isl.withColumn("nth", nth).where((F.col("nth") <= first) & (F.col("b") - F.col("a") > least)).select(KEY, "a", F.least("b", F.col("a") + most).alias("b"))


def upper_rank(x: Column, num: int, den: int) -> Column:
    """The value at place ``n * num // den`` (from 0) of a group in ascending order, without nulls."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, (F.expr("0") + F.floor(F.count(x) * num / den)).cast("int"))


def speech_level(levels: DataFrame) -> DataFrame:
    """The upper median of the level windows' db: recording_id, speech_db."""
    return levels.groupBy(KEY).agg(upper_rank(F.col("db"), 1, 2).alias("speech_db"))


def loud_gaps(gap_levels: DataFrame, levels: DataFrame) -> DataFrame:
    """Gaps (recording_id, a, b, db) nearly as loud as speech: somebody spoke and nothing was written."""
    level = F.coalesce("speech_db", F.lit(NO_LEVEL))
    return gap_levels.join(levels, KEY, "left").where(F.col("db") > level - LOUD_MARGIN).select(KEY, "a", "b", F.lit(LOUD_GAP).alias("label"))


def judged(segs: DataFrame, pattern: str = STOCK_PATTERN) -> DataFrame:
    """``segs`` (start, end, spoken, text, avg_logprob, db, speech_db) with action and is_hallucination.

    Loudness decides between the two remedies: a doubtful segment as loud as speech covers real
    words and is to be transcribed again, one far below stands over nothing and is to be dropped.
    Actions: keep, drop, retranscribe.
    """
    length = F.col("end") - F.col("start")
    level = F.coalesce("speech_db", F.lit(NO_LEVEL))
    stock = is_stock(F.col("text"), pattern)
    unsure = F.coalesce(F.col("avg_logprob"), F.lit(0.0)) < LOW_CONFIDENCE
    hollow = unsure & (length > 5000) & (F.col("spoken") * 1000 < 0.5 * length)
    dead = (F.col("spoken") > 0) & (F.col("db") < level - DEAD_AIR)
    loud = F.col("db") > level - LOUD_MARGIN
    action = F.when(F.col("db").isNull() | ~(stock | unsure | dead), "keep").when(hollow, "drop").when(loud & stock, "retranscribe").when(loud, "keep").otherwise("drop")
    return segs.withColumn("action", action).withColumn("is_hallucination", F.col("action") != "keep")


def audit(segs: DataFrame, recordings: DataFrame, energy: DataFrame, gap_min: int = 3000) -> dict[str, DataFrame]:
    """The whole audit of one pass: report, gaps, spans to transcribe again, drops, hallucinations."""
    isl = islands(segs)
    level = speech_level(range_db(level_windows(isl), energy))
    holes = gaps(isl, recordings, gap_min)
    hole_db = range_db(holes.select(KEY, F.col("from_ms").alias("a"), F.col("to_ms").alias("b")), energy)
    rated = range_db(segs.withColumns({"a": F.col("start"), "b": F.col("end")}), energy).drop("a", "b").join(level, KEY, "left")
    seen = judged(rated).where("is_hallucination")
    span = lambda what, label: seen.where(F.col("action") == what).select(KEY, F.col("start").alias("a"), F.col("end").alias("b"), F.lit(label).alias("label"))
    spans = loud_gaps(hole_db, level).unionByName(span("retranscribe", REPLACED)).unionByName(starved_spans(segs).withColumn("label", F.lit(STARVED)))
    cover = isl.groupBy(KEY).agg(F.sum(F.col("b") - F.col("a")).alias("cover"))
    report = recordings.join(cover, KEY, "left").join(level, KEY, "left").select(
        KEY, "duration", F.coalesce("cover", F.lit(0)).alias("cover"), F.round(F.try_divide(100.0 * F.col("cover"), F.col("duration")), 6).alias("cover_pct"), F.coalesce("speech_db", F.lit(NO_LEVEL)).alias("speech_db")
    )
    return {"report": report, "gaps": hole_db, "spans": spans.orderBy(KEY, "a", "b", "label"), "drop": span("drop", "drop").drop("label"), "hallucinations": seen}


def windows(recordings: DataFrame, step: int = 10_000) -> DataFrame:
    """Tumbling windows of whole seconds of each recording: recording_id, t (start)."""
    last = F.expr("duration div 1000 * 1000") - 1
    return recordings.where(last >= 0).select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))).alias("t"))


def quiet_windows(levels: DataFrame, segs: DataFrame, step: int = 10_000, margin: float = 6.0, few: int = 8, pattern: str = STOCK_PATTERN) -> DataFrame:
    """``levels`` (recording_id, t, db) with quiet: below the upper quartile by ``margin`` and few credible characters."""
    ref = levels.groupBy(KEY).agg(upper_rank(F.col("db"), 3, 4).alias("ref"))
    credible = ~is_stock(F.col("text"), pattern) & ~(F.coalesce(F.col("avg_logprob"), F.lit(0.0)) < LOW_CONFIDENCE)
    said = segs.where(credible).groupBy(KEY, (F.floor(F.col("start") / step) * step).alias("t")).agg(F.sum("spoken").alias("said"))
    low = F.coalesce(F.col("db") < F.col("ref") - margin, F.lit(False))
    return levels.join(ref, KEY).join(said, [KEY, "t"], "left").select(KEY, "t", (low & (F.coalesce("said", F.lit(0)) < few)).alias("quiet"))


def break_runs(flags: DataFrame, step: int = 10_000, least: int = 120_000, top: int = 3) -> DataFrame:
    """The longest runs of quiet windows (recording_id, t, quiet): recording_id, a, b; ties to the earlier."""
    w = Window.partitionBy(KEY).orderBy("t")
    runs = flags.where("quiet").withColumn("run", F.col("t") / step - F.row_number().over(w)).groupBy(KEY, "run").agg(F.min("t").alias("a"), (F.max("t") + step).alias("b"))
    nth = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(F.col("b") - F.col("a")), "a"))
    return runs.where(F.col("b") - F.col("a") >= least).withColumn("nth", nth).where(F.col("nth") <= top).select(KEY, "a", "b")
