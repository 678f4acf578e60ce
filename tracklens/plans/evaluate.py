"""Scoring of transcripts: against gold sheets, and over manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.text import micro, score_udf, without_gloss
from ..operators.intervals import KEY


def against_gold(gold: DataFrame, cues: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Scores a recording: the gold text against that of the cues that overlap the gold's window.

    Overlap, not membership: a hypothesis cut at other places is not charged for its cuts.
    ``gold`` (recording_id, start, end, text) without rows is an error, as is one without cues.
    """
    window = gold.groupBy(KEY).agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    met = cues.join(window, KEY).where((F.col("end") > F.col("lo")) & (F.col("start") < F.col("hi")))
    said = lambda df, name: df.groupBy(KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "text"))), lambda x: x["text"]), "").alias(name))
    both = window.join(said(gold, "ref"), KEY).join(said(met, "hyp"), KEY, "left")
    return with_rates(both.select(KEY, F.col("lo").alias("window_start"), F.col("hi").alias("window_end"), score_udf(lexicon)("ref", F.coalesce("hyp", F.lit(""))).alias("s")).select(KEY, "window_start", "window_end", "s.*"))


def over_manifest(items: DataFrame, lexicon: Lexicon | None = None, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(summary, items with scores) of items (audio, text, hyp): glosses leave the references, rates are of summed counts."""
    scored = items.withColumn("s", score_udf(lexicon)(without_gloss(F.col("text")), F.col("hyp"))).select(*(items.columns if keep else ["audio"]), "s.*")
    return micro(scored), scored


def transcripts_with_audio(transcripts: DataFrame, audio: DataFrame) -> DataFrame:
    """The manifest of a corpus: transcripts (utt_id, text) whose audio (utt_id, audio) is there."""
    return transcripts.join(audio, "utt_id").select("audio", F.regexp_replace("text", r"\s+", "").alias("text"))


def with_rates(scores: DataFrame) -> DataFrame:
    rate = lambda x, n, k: F.when(n > 0, k * x / n).otherwise(0.0)
    errors = F.col("sub") + F.col("dele") + F.col("ins")
    return scores.withColumns({"cer": rate(errors, F.col("n_ref"), 1.0), "homo_pct": rate(F.col("homo"), F.col("sub"), 100.0), "near_pct": rate(F.col("near"), F.col("sub"), 100.0)})


def summary(name: Column) -> Column:
    """A line for people of a row of rates."""
    return F.format_string(
        "%s: CER %.2f%% (%d of %d characters), deleted %d, inserted %d, substituted %d, of these alike %.1f%% and nearly alike %.1f%%",
        name, 100 * F.col("cer"), F.col("sub") + F.col("dele") + F.col("ins"), F.col("n_ref"), F.col("dele"), F.col("ins"), F.col("sub"), F.col("homo_pct"), F.col("near_pct"),
    )
