"""Readers: files of any store that Spark reads, many recordings at once, explicit schemas.

A recording's id is its file's name without folder and suffixes.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefmt import parse_hms, parse_srt_time
from ..schema import CUES, ENERGY

_WORD = "struct<start:double,end:double,word:string>"
_SEGMENT = f"struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,words:array<{_WORD}>>"


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)*$", 1)


def ms(seconds: Column) -> Column:
    return F.rint(seconds * 1000).cast("long")


def _words(words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(ms(w["start"]).alias("start"), ms(w["end"]).alias("end"), w["word"].alias("word")))


def _segment(s: str) -> list[Column]:
    c = lambda n: F.col(f"{s}.{n}")
    return [ms(c("start")).alias("start"), ms(c("end")).alias("end"), F.coalesce(c("text"), F.lit("")).alias("text"), c("avg_logprob").alias("avg_logprob"), c("no_speech_prob").alias("no_speech_prob"), _words(c("words")).alias("words")]


def read_pass(spark: SparkSession, path: str, pass_id: int) -> tuple[DataFrame, DataFrame]:
    """One engine's pass over recordings, JSON {duration, segments}: (recordings, segments)."""
    raw = spark.read.schema(f"duration double, segments array<{_SEGMENT}>").option("multiLine", True).json(path).withColumn("recording_id", _name(F.input_file_name()))
    rows = raw.select("recording_id", F.posexplode("segments").alias("seg_ord", "s")).select("recording_id", F.lit(pass_id).alias("pass_id"), "seg_ord", *_segment("s"))
    return raw.select("recording_id", ms(F.col("duration")).alias("duration")), rows


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Repairs, JSON [{span, label, attempts: [{mode, rows}]}]: a row for each row of each attempt."""
    schema = f"array<struct<span:array<double>,label:string,attempts:array<struct<mode:string,rows:array<{_SEGMENT}>>>>>"
    text = spark.read.text(path, wholetext=True).withColumn("recording_id", _name(F.input_file_name()))
    items = text.select("recording_id", F.posexplode(F.from_json("value", schema)).alias("span_ord", "p"))
    tries = items.select("recording_id", "span_ord", ms(F.col("p.span")[0]).alias("a"), ms(F.col("p.span")[1]).alias("b"), F.col("p.label").alias("label"), F.posexplode("p.attempts").alias("attempt_ord", "t"))
    rows = tries.select("recording_id", "span_ord", "a", "b", "label", "attempt_ord", F.col("t.mode").alias("mode"), F.posexplode("t.rows").alias("row_ord", "s"))
    return rows.select("recording_id", "span_ord", "a", "b", "label", "attempt_ord", "mode", "row_ord", *_segment("s")).drop("avg_logprob", "no_speech_prob")


def read_glossary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A glossary's tables: fixes (ord, wrong, right), terms (ord, term), leads (ord, lead)."""
    raw = spark.read.schema("name string, note string, fixes array<array<string>>, terms array<string>, clause_lead array<string>").option("multiLine", True).json(path)
    fixes = raw.select(F.posexplode("fixes").alias("ord", "f")).select("ord", F.col("f")[0].alias("wrong"), F.col("f")[1].alias("right"))
    return {"fixes": fixes, "terms": raw.select(F.posexplode("terms").alias("ord", "term")), "leads": raw.select(F.posexplode("clause_lead").alias("ord", "lead"))}


def cues_of(text: Column) -> Column:
    """The cues of an SRT text; blocks of fewer than three lines or without times are skipped, lines are joined without a space."""
    blocks = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "^﻿", ""), r"\n[ \t]*\n+")
    lines = F.transform(blocks, lambda b: F.split(F.regexp_replace(b, r"^\n+|\s+$", ""), "\n"))
    timed = F.filter(lines, lambda x: (F.size(x) >= 3) & F.get(x, F.lit(1)).rlike(r"^\s*\d+:\d+:\d+[,.]\d+\s*-->\s*\d+:\d+:\d+[,.]\d+"))
    side = lambda x, i: parse_srt_time(F.split(F.get(x, F.lit(1)), "-->")[i])
    said = lambda x: F.array_join(F.transform(F.slice(x, 3, F.size(x)), lambda t: F.trim(t)), "")
    return F.transform(timed, lambda x: F.struct(side(x, 0).alias("start"), side(x, 1).alias("end"), said(x).alias("text")))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(_name(F.input_file_name()).alias("recording_id"), cues_of(F.col("value")).alias("c"))
    return raw.select("recording_id", F.posexplode("c").alias("cue_ord", "c")).select("recording_id", "cue_ord", "c.start", "c.end", "c.text").to(spark.createDataFrame([], CUES).schema)


def gold_of(lines: DataFrame) -> DataFrame:
    """Gold rows (start, end, text) of lines ``value``: start, end, text between tabs, or start and text; blank lines skipped."""
    part = F.split("value", "\t", 3)
    rows = lines.where(F.trim("value") != "").withColumn("p", part).where(F.size("p") >= 2)
    three = F.size("p") == 3
    start = ms(parse_hms(F.col("p")[0]))
    keep = [c for c in lines.columns if c != "value"]
    return rows.select(*keep, start.alias("start"), F.when(three, ms(parse_hms(F.get("p", F.lit(1))))).otherwise(start).alias("end"), F.trim(F.when(three, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1)))).alias("text"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return gold_of(spark.read.text(path).withColumn("recording_id", _name(F.input_file_name())))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Items (audio, text) of JSON lines; blank lines are skipped."""
    return spark.read.schema("audio string, text string").json(path)


def read_energy(spark: SparkSession, path: str, frame_ms: int = 10) -> DataFrame:
    """Energy frames of 16-bit WAV files, the first channel."""

    def frames(batches):
        for pdf in batches:
            for name, content in zip(pdf["recording_id"], pdf["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError(f"{name}: samples of {w.getsampwidth() * 8} bits")
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2")[:: w.getnchannels()].astype(np.float64)
                    size = w.getframerate() * frame_ms // 1000
                edges = np.arange(0, len(x), size)
                sums = np.add.reduceat(x * x, edges) if len(x) else np.zeros(0)
                yield pd.DataFrame({"recording_id": name, "frame_ord": np.arange(len(edges)), "n_samples": np.diff(np.append(edges, len(x))), "sum_sq": sums})

    files = spark.read.format("binaryFile").load(path).select(_name(F.col("path")).alias("recording_id"), "content")
    return files.mapInPandas(frames, ENERGY)
