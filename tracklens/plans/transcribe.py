"""The whole chain over many recordings: passes, loudness, patches and glossary in, transcript out."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon, words_in
from ..functions.text import EDITS, repair_udf
from ..operators import audit as audits
from ..operators import merge, segment, speakers
from ..operators.intervals import KEY, coverage, in_any, stripped
from ..operators.paragraphs import paragraphs


@dataclass(frozen=True)
class Profile:
    """What differs between kinds of recording: passes to use, repair of spans, sound-alike matching."""

    name: str
    passes: int = 1
    patch: bool = True
    phonetic: bool = False
    loose: bool = False


PROFILES = {p.name: p for p in (Profile("lecture"), Profile("meeting", passes=2), Profile("fast", patch=False))}


def usable(rows: DataFrame, breaks: DataFrame, drops: DataFrame) -> DataFrame:
    """Rows with text, without stock phrases, outside breaks, and not beginning within 0.2 s of a drop."""
    rows = rows.where((F.col("text") != "") & ~audits.is_stock(F.col("text")))
    return in_any(in_any(rows, breaks, keep=False), drops, pad=200, keep=False)


def normal(rows: DataFrame, fixes: list[tuple[str, str]], terms: list[str], lexicon: Lexicon | None, profile: Profile) -> DataFrame:
    """Text simplified, stripped (``plain``), and repaired by the glossary: literal fixes in order, then (if asked for) terms that sound alike, with the edits."""
    simple = F.pandas_udf(lambda s: pd.Series([lexicon.simplified(t or "") if lexicon else t or "" for t in s]), "string")
    rows = rows.withColumn("plain", stripped(simple("text")))
    fixed = merge.replaced(F.col("plain"), fixes)
    if profile.phonetic and lexicon and terms:
        fixed = repair_udf(terms, lexicon, profile.loose)(fixed)
    else:
        fixed = F.struct(fixed.alias("text"), F.array().cast(EDITS).alias("edits"))
    return rows.withColumn("fixed", fixed).withColumns({"text": F.col("fixed.text"), "edits": F.col("fixed.edits")}).drop("fixed").withColumn("chars", F.length("text"))


def run(
    segs: DataFrame, recordings: DataFrame, energy: DataFrame, patch: DataFrame | None = None, fixes: list[tuple[str, str]] = (), terms: list[str] = (),
    lexicon: Lexicon | None = None, profile: Profile = PROFILES["lecture"], leads: list[str] | None = None, vectors: DataFrame | None = None, guard_rows: int = 20_000,
) -> dict[str, DataFrame]:
    """The products of all recordings: audit of the first pass, breaks, rows, final audit, paragraphs, cues, edits and glossary.

    ``edits`` are those of sound-alike terms that the final rows still show; ``glossary`` counts the
    wrong forms in all rows before replacement.  Sound-alike terms keep to word edges: those of the
    lexicon's words, else of the words that ICU finds in ``guard_rows`` rows (a bounded sample) and of
    the terms.  ``vectors`` (recording_id, seg_ord, embedding) give the speakers of the final rows.
    """
    segs = segs.where(F.col("pass_id") < profile.passes)
    if profile.phonetic and lexicon and terms and not lexicon.words:
        some = [lexicon.simplified(r[0]) for r in segs.where("text IS NOT NULL").select("text").limit(guard_rows).collect()]
        lexicon = replace(lexicon, words=words_in(segs.sparkSession, some) | frozenset(t for t in terms if len(t) > 1))
    spoken = lambda t: F.length(stripped(t))
    first = segs.where("pass_id = 0").withColumn("spoken", spoken(F.col("text")))
    found = audits.audit(first, recordings, energy)
    windows = audits.range_db(audits.windows(recordings).select(KEY, "t", F.col("t").alias("a"), (F.col("t") + 10_000).alias("b")), energy).select(KEY, "t", "db")
    breaks = audits.break_runs(audits.quiet_windows(windows, first))
    said = normal(segs, list(fixes), list(terms), lexicon, profile)
    ready = usable(said, breaks, found["drop"])
    heard, ledger = said.select("plain"), ready.select(KEY, "start", "end", F.concat(F.lit("pass"), F.col("pass_id") + 1).alias("src"), "edits")
    best = None
    if patch is not None and profile.patch:
        near = normal(patch, list(fixes), list(terms), lexicon, profile)
        heard = heard.unionByName(near.select("plain"))
        near = usable(near, breaks, found["drop"])
        spans = in_any(near.withColumnsRenamed({"start": "row_start", "a": "start"}), breaks, keep=False).withColumnsRenamed({"start": "a", "row_start": "start"})
        spans = spans.where((F.col("start") >= F.col("a") - 500) & (F.col("start") <= F.col("b") + 500))
        best = spans.join(merge.best_attempts(spans).select(KEY, "span_ord", "attempt_ord"), [KEY, "span_ord", "attempt_ord"], "left_semi")
        ledger = ledger.unionByName(best.select(KEY, "start", "end", F.lit("patch").alias("src"), "edits"))
    rows = merge.merged(merge.winning_rows(ready, recordings), best)
    rows = rows.withColumns({"chars": F.length("text"), "spoken": spoken(F.col("text")), "seg_ord": F.col("row_ord"), "speaker": F.lit(None).cast("string")})
    words = ready.select(KEY, "start", "end", "text", "words").dropDuplicates([KEY, "start", "end", "text"])
    rows = rows.join(words, [KEY, "start", "end", "text"], "left")
    ledger = ledger.where(F.size("edits") > 0).groupBy(KEY, "start", "end", "src").agg(F.first("edits").alias("edits"))
    rows = rows.join(ledger, [KEY, "start", "end", "src"], "left").withColumn("edits", F.coalesce("edits", F.array().cast(EDITS)))
    if vectors is not None:
        rows = with_speakers(rows, vectors)
    pairs = rows.sparkSession.createDataFrame([(i, a) for i, (a, _) in enumerate(fixes)], "ord int, wrong string")
    return {
        **{f"first_{k}": v for k, v in found.items()}, "breaks": breaks, "rows": rows, "final": coverage(rows, recordings),
        "paragraphs": paragraphs(rows, leads), "edits": merge.valid_edits(rows), "glossary": merge.glossary_hits(heard.withColumnRenamed("plain", "text"), pairs), "cues": segment.clamped(segment.cut_rows(rows.select(KEY, "seg_ord", "start", "end", "text", "words", "speaker"))),
    }


def with_speakers(rows: DataFrame, vectors: DataFrame, **how) -> DataFrame:
    """``rows`` with speakers from voice vectors (recording_id, seg_ord, embedding)."""
    return speakers.assigned(rows.drop("speaker").join(vectors, [KEY, "seg_ord"], "left"), **how).drop("embedding")
