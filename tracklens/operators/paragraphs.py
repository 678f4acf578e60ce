"""Paragraphs of a transcript."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPS, punctuated, tidy
from .intervals import KEY
from .segment import pause_thresholds
from .speakers import labelled

PARAGRAPHS = "recording_id string, par_ord int, start bigint, end bigint, text string, speaker string"


def assembled(rows: list[dict], pause: int = 1500, full: int = 220, comma: int = 300, period: int = 800) -> list[dict]:
    """Rows (start, end, text, speaker) in order joined into paragraphs.

    A long pause, a full paragraph or another speaker begins a new one; within one, a pause adds a mark
    unless there is one.  Rows without text leave no trace, nor does their time.
    """
    out: list[dict] = []
    for r in rows:
        text = r["text"].strip()
        if not text:
            continue
        gap = r["start"] - out[-1]["end"] if out else 0
        if not out or gap >= pause or len(out[-1]["text"]) >= full or r["speaker"] != out[-1]["speaker"]:
            out.append({"start": r["start"], "end": r["end"], "text": text, "speaker": r["speaker"]})
            continue
        mark = "" if gap < comma or out[-1]["text"][-1] in STOPS else "，" if gap < period else "。"
        out[-1] |= {"text": out[-1]["text"] + mark + text, "end": r["end"]}
    return out


def paragraphs(rows: DataFrame, leads: list[str] | None = None) -> DataFrame:
    """Paragraphs of rows (recording_id, seg_ord, start, end, text, words, speaker), tidied and labelled.

    recording_id, par_ord, start, end, text, speaker, label.  A recording is a fold: a full paragraph
    starts the count anew.
    """
    words = rows.select(KEY, "seg_ord", F.posexplode("words").alias("word_ord", "w")).select(KEY, "seg_ord", "word_ord", "w.start", "w.end")
    limits = pause_thresholds(words)
    rows = rows.join(limits, KEY, "left").select(KEY, "seg_ord", "start", "end", "text", "words", "speaker", F.coalesce("comma", F.lit(350)).cast("double").alias("comma"), F.coalesce("period", F.lit(900.0)).alias("period"))
    mark = F.pandas_udf(lambda t, w, c, p: pd.Series([punctuated(a or "", list(b) if b is not None else [], x, y) for a, b, x, y in zip(t, w, c, p)]), "string")
    rows = rows.withColumn("text", mark("text", "words", "comma", "period")).drop("words", "comma", "period")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_ord").astype({"speaker": object})
        pdf["speaker"] = pdf["speaker"].where(pdf["speaker"].notna(), None)
        out = assembled(pdf[["start", "end", "text", "speaker"]].to_dict("records"))
        return pd.DataFrame([(pdf[KEY].iloc[0], i, r["start"], r["end"], r["text"], r["speaker"]) for i, r in enumerate(out)], columns=[c.split()[0] for c in PARAGRAPHS.split(", ")])

    done = rows.groupBy(KEY).applyInPandas(fold, PARAGRAPHS)
    return labelled(done.withColumn("text", tidy(F.col("text"), leads)), "par_ord")
