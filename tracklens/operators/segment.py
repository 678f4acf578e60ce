"""From words to segments and cues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import KEY

CUE_GAP = 300


def pause_segments(words: DataFrame, pause: int = 800) -> DataFrame:
    """Runs of words (recording_id, word_ord, start, end, word) without a pause: recording_id, seg, start, end, text, n_words."""
    w = Window.partitionBy(KEY).orderBy("word_ord")
    opens = F.coalesce(F.col("start") - F.lag("end").over(w) >= pause, F.lit(True)).cast("int")
    marked = words.withColumn("opens", opens).withColumn("seg", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.sort_array(F.collect_list(F.struct("word_ord", "start", "end", "word")))
    runs = marked.groupBy(KEY, "seg").agg(ordered.alias("w"))
    return runs.select(KEY, "seg", F.get("w", F.lit(0)).start.alias("start"), F.element_at("w", -1).end.alias("end"), F.array_join("w.word", "").alias("text"), F.size("w").alias("n_words"))


def capped_runs(words: Column, pause: int = 800, most: int = 28_000) -> Column:
    """An array of words cut into an array of runs at pauses, and where a run would begin ``most`` before a word.

    The cap starts anew at each cut, so this is a fold over the array, still inside the engine; it
    carries the places of the cuts, not the words.
    """

    def step(acc: Column, w: Column) -> Column:
        new = (acc["n"] == 0) | (w["start"] - acc["last"] >= pause) | (w["start"] - acc["first"] >= most)
        cuts = F.when(new, F.concat(acc["cuts"], F.array(acc["n"] + 1))).otherwise(acc["cuts"])
        return F.struct(cuts.alias("cuts"), (acc["n"] + 1).alias("n"), F.when(new, w["start"]).otherwise(acc["first"]).alias("first"), w["end"].alias("last"))

    none = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    cuts = F.aggregate(words, none, step, lambda acc: acc["cuts"])
    return F.transform(cuts, lambda c, k: F.slice(words, c, F.coalesce(F.get(cuts, k + 1), F.size(words) + 1) - c))


def capped_segments(rows: DataFrame, pause: int = 800, most: int = 28_000) -> DataFrame:
    """Segments of raw recognitions (recording_id, item_ord, words): recording_id, item_ord, seg, start, end, text, words."""
    runs = rows.select(KEY, "item_ord", F.posexplode(capped_runs(F.col("words"), pause, most)).alias("seg", "words"))
    return runs.select(KEY, "item_ord", "seg", F.element_at("words", 1).start.alias("start"), F.element_at("words", -1).end.alias("end"), F.array_join(F.col("words.word"), "").alias("text"), "words")


def from_characters(raw: DataFrame, pause: int = 800, most: int = 28_000) -> DataFrame:
    """Adapter for recognisers that give characters between spaces and a [start, end] for each.

    ``raw``: recording_id, item_ord, text, timestamp array<array<bigint>>.  If the counts differ the
    item is one segment without words, from the first to the last time (0 without any).
    """
    chars = F.filter(F.split(F.trim("text"), " +"), lambda c: c != "")
    t = F.coalesce("timestamp", F.array().cast("array<array<bigint>>"))
    base = raw.select(KEY, "item_ord", chars.alias("chars"), t.alias("t")).where(F.size("chars") > 0)
    same = F.size("chars") == F.size("t")
    words = F.zip_with("chars", "t", lambda c, p: F.struct(p[0].alias("start"), p[1].alias("end"), c.alias("word")))
    good = capped_segments(base.where(same).select(KEY, "item_ord", words.alias("words")), pause, most)
    edge = lambda i, k: F.coalesce(F.get(F.get("t", i), F.lit(k)), F.lit(0).cast("long"))
    whole = base.where(~same).select(KEY, "item_ord", F.lit(0).alias("seg"), edge(F.lit(0), 0).alias("start"), edge(F.size("t") - 1, 1).alias("end"), F.array_join("chars", "").alias("text"), F.array().cast("array<struct<start:bigint,end:bigint,word:string>>").alias("words"))
    return good.unionByName(whole)


def aligned_texts(text: str, groups: list[list[str]]) -> list[str] | None:
    """The share of ``text`` of each group of items, found one after the other.

    What lies between items (punctuation) goes to the group that has just ended, or to the current
    one if it has begun; the rest of the text to the last.  None if an item is not found.
    """
    out, at = [""] * len(groups), 0
    for g, items in enumerate(groups):
        for item in items:
            begin = text.find(item, at)
            if begin < 0:
                return None
            out[g if out[g] or not g else g - 1] += text[at:begin]
            out[g] += item
            at = begin + len(item)
    if out:
        out[-1] += text[at:]
    return out


def from_items(raw: DataFrame, pause: int = 800, most: int = 28_000) -> DataFrame:
    """Adapter for recognisers that give a punctuated text and aligned items without punctuation.

    ``raw``: recording_id, duration, text, words (the items).  Without items, or if one is not in the
    text, the text is one segment over the duration without words; an empty text gives none.
    """
    texts = F.pandas_udf(lambda t, g: pd.Series([aligned_texts(a or "", [[w for w in x] for x in b]) for a, b in zip(t, g)]), "array<string>")
    runs = F.when(F.size("words") > 0, capped_runs(F.col("words"), pause, most))
    base = raw.withColumn("runs", runs)
    base = base.withColumn("texts", F.when(F.col("runs").isNotNull(), texts("text", F.transform("runs", lambda r: r["word"]))))
    cut = base.where(F.col("texts").isNotNull()).select(KEY, F.posexplode(F.arrays_zip("runs", "texts")).alias("seg", "r"))
    good = cut.select(KEY, "seg", F.element_at("r.runs", 1).start.alias("start"), F.element_at("r.runs", -1).end.alias("end"), F.col("r.texts").alias("text"), F.col("r.runs").alias("words"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,word:string>>")
    whole = base.where(F.col("texts").isNull() & (F.length("text") > 0)).select(KEY, F.lit(0).alias("seg"), F.lit(0).cast("long").alias("start"), F.col("duration").alias("end"), "text", none.alias("words"))
    return good.unionByName(whole)


def split_points(db: np.ndarray, frame_ms: int, total_ms: int, most: int = 300_000, reach: int = 3000, window: int = 200, step: int = 50) -> list[int]:
    """Chunk edges of a long recording: each at the quietest window near its nominal place, which follows from the edge before."""
    power, w, s = np.concatenate([[0.0], np.cumsum(db)]), window // frame_ms, step // frame_ms
    edges = [0]
    while total_ms - edges[-1] > most:
        nominal = edges[-1] + most
        lo, hi = max(edges[-1] + window, nominal - reach), min(total_ms - window, nominal + reach)
        starts = np.arange(lo // frame_ms, (hi - window) // frame_ms, s)
        if len(starts):
            nominal = int(starts[np.argmin(power[starts + w] - power[starts])]) * frame_ms + window // 2
        edges.append(nominal)
    return [*edges, total_ms]


def chunked(energy: DataFrame, frame_ms: int = 50, **how) -> DataFrame:
    """Edges of each recording's chunks from its energy frames: recording_id, edge_ord, edge."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_ord")
        edges = split_points(pdf["sum_sq"].to_numpy(), frame_ms, len(pdf) * frame_ms, **how)
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "edge_ord": range(len(edges)), "edge": edges})

    return energy.groupBy(KEY).applyInPandas(fold, "recording_id string, edge_ord int, edge bigint")


def split_row(text: str, words: list, most: int = 8000, chars: int = 30) -> list[tuple[int, int, str]]:
    """A row's cues (start, end, text) at word edges, none longer than ``most`` unless a word is.

    The text may differ from the words (it is corrected), so each cue takes the share of the text
    that its words have of all words' characters.
    """
    total = sum(len(w["word"]) for w in words)
    if not total or not text:
        return []
    groups: list[list] = []
    for w in words:
        if not groups or w["end"] - groups[-1][0]["start"] > most or sum(len(x["word"]) for x in groups[-1]) >= chars:
            groups.append([])
        groups[-1].append(w)
    ends = np.cumsum([sum(len(w["word"]) for w in g) for g in groups])
    places = [0, *(round(int(e) * len(text) / total) for e in ends)]
    return [(g[0]["start"], g[-1]["end"], text[a:b]) for g, a, b in zip(groups, places, places[1:]) if b > a]


def cut_rows(rows: DataFrame, most: int = 8000, chars: int = 30) -> DataFrame:
    """``rows`` (recording_id, seg_ord, start, end, text, words, ...) cut into cues by words; rows without words stay whole."""

    def cut(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "text": t} for a, b, t in split_row(x or "", list(w) if w is not None else [], most, chars)] for x, w in zip(texts, words)])

    pieces = F.pandas_udf(cut, "array<struct<start:bigint,end:bigint,text:string>>")("text", "words")
    whole = F.array(F.struct("start", "end", "text"))
    out = rows.withColumn("piece", F.explode(F.when(F.size(pieces) > 0, pieces).otherwise(whole)))
    keep = [c for c in rows.columns if c not in ("start", "end", "text", "words")]
    return out.select(*keep, "piece.start", "piece.end", "piece.text")


def clamped(cues: DataFrame, least: int = CUE_GAP) -> DataFrame:
    """Cues (recording_id, start, end, ...) pushed forward so that none overlaps and each lasts ``least``.

    Each end is the greater of its own, its start plus ``least`` and the previous end plus ``least``.
    So end minus ``least`` times the cue's number is a running maximum, one window instead of a fold.
    """
    tie = [c for c in ("seg_ord", "cue_ord") if c in cues.columns]
    w = Window.partitionBy(KEY).orderBy("start", "end", *tie)
    n = F.row_number().over(w)
    numbered = cues.withColumn("_n", n)
    lead = F.greatest("end", F.greatest("start", F.lit(0)) + least) - F.col("_n") * least
    numbered = numbered.withColumn("_t", F.max(lead).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * least)
    numbered = numbered.withColumn("_s", F.greatest("start", F.lag("_t", 1, 0).over(w)))
    keep = [c for c in cues.columns if c not in ("start", "end", "cue_ord")]
    return numbered.select(*keep, (F.col("_n") - 1).cast("int").alias("cue_ord"), F.col("_s").alias("start"), F.col("_t").alias("end"))


def pause_thresholds(words: DataFrame, low: int = 250, high: int = 600, least: int = 20) -> DataFrame:
    """Comma and stop thresholds from each recording's own pauses between the words of a segment.

    ``words``: recording_id, seg_ord, word_ord, start, end.  recording_id, comma, period in ms.
    """
    gap = F.col("start") - F.lag("end").over(Window.partitionBy(KEY, "seg_ord").orderBy("word_ord"))
    pauses = words.select(KEY, gap.alias("gap")).groupBy(KEY).agg(F.sort_array(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))).alias("g"))
    at = lambda tenths: F.get("g", F.least(F.size("g") - 1, F.expr(f"size(g) * {tenths} div 100")).cast("int"))
    comma = F.greatest(F.lit(low), at(80))
    period = F.greatest(comma * 1.6, F.lit(float(high)), at(95).cast("double"))
    few = F.size("g") < least
    return pauses.select(KEY, F.when(few, 350).otherwise(comma).cast("long").alias("comma"), F.when(few, 900.0).otherwise(period).alias("period"))
