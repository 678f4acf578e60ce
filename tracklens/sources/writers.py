"""Sinks: transcripts, cues, gold sheets and reports as text, a folder for each recording.

Each product is first one string a recording, made by ordered aggregation, then written by
Spark's committer under ``recording_id=...`` so that any number of recordings is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import hms, srt_time
from ..operators.intervals import KEY


def joined(rows: DataFrame, order: str, line: Column, sep: str = "") -> DataFrame:
    """recording_id, body: the lines of a recording in order."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return rows.groupBy(KEY).agg(F.array_join(F.transform(lines, lambda x: x["line"]), sep).alias("body"))


def srt(cues: DataFrame) -> DataFrame:
    """SRT bodies of cues (recording_id, cue_ord, start, end, text[, speaker]); speakers are shown if there are two or more."""
    text = F.col("text")
    if "speaker" in cues.columns:
        several = cues.groupBy(KEY).agg((F.count_distinct("speaker") >= 2).alias("several"))
        cues = cues.join(several, KEY)
        text = F.when(F.col("several") & F.col("speaker").isNotNull(), F.concat(F.lit("["), F.col("speaker"), F.lit("] "), text)).otherwise(text)
    line = F.concat((F.col("cue_ord") + 1).cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), text, F.lit("\n\n"))
    return joined(cues, "cue_ord", line)


def transcript(paragraphs: DataFrame, recordings: DataFrame, title: str = "", note: str = "") -> tuple[DataFrame, DataFrame]:
    """Markdown and plain bodies of paragraphs (recording_id, par_ord, start, text, label)."""
    tag = F.when(F.col("label") != "", F.concat(F.lit(" "), F.col("label"))).otherwise("")
    time = F.concat(F.lit("["), hms(F.col("start")), F.lit("]"))
    sizes = paragraphs.groupBy(KEY).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
    head = recordings.join(sizes, KEY).withColumn("name", F.concat(F.lit(title), F.col(KEY)) if title else F.col(KEY))
    hours = F.format_string("%s（%.2f 小时）　正文约 %,d 字　共 %d 段", hms(F.col("duration")), F.col("duration") / 3_600_000.0, "chars", "n")
    md = joined(paragraphs, "par_ord", F.concat(F.lit("**"), time, tag, F.lit("**　"), F.col("text"), F.lit("\n")), "\n")
    top = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n**录音全文转录**\n\n> 录音时长 "), hours, F.lit("  \n> 方括号内为录音时间戳，可据此回听核对原音。\n\n---\n\n"))
    md = md.join(head, KEY).select(KEY, F.concat(top, "body", F.lit("\n\n---\n\n## 附：转录说明\n\n" + note)).alias("body"))
    txt = joined(paragraphs, "par_ord", F.concat(time, tag, F.lit(" "), F.col("text"), F.lit("\n\n")))
    top = F.concat(F.col("name"), F.lit("　录音全文转录\n时长 "), hms(F.col("duration")), F.format_string("　约 %,d 字\n\n", "chars"))
    return md, txt.join(head, KEY).select(KEY, F.concat(top, "body").alias("body"))


def gold_sheet(cues: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Gold bodies: cues that begin in [start, end), times and text between tabs."""
    rows = cues
    if start is not None:
        rows = rows.where(F.col("start") >= start)
    if end is not None:
        rows = rows.where(F.col("start") < end)
    return joined(rows, "cue_ord", F.concat_ws("\t", hms(F.col("start")), hms(F.col("end")), "text"), "\n")


def report(**tables: DataFrame) -> DataFrame:
    """QA reports as JSON: for each recording the rows of each table under the table's name."""
    out = None
    for name, t in tables.items():
        rows = F.sort_array(F.collect_list(F.struct(*[c for c in t.columns if c != KEY])))
        one = t.groupBy(KEY).agg(rows.alias(name))
        out = one if out is None else out.join(one, KEY, "full")
    return out.select(KEY, F.to_json(F.struct(*tables)).alias("body"))


def write(bodies: DataFrame, folder: str) -> None:
    """A folder for each recording with one text file."""
    bodies.select(KEY, F.col("body").alias("value")).repartition(KEY).write.partitionBy(KEY).mode("overwrite").option("lineSep", "\n").text(folder)


def one_file(folder: str, suffix: str, spark) -> str:
    """The only file of that suffix in a folder; an error if there is none or more than one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().toString() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if s.getPath().getName().endswith(suffix)]
    if not found:
        raise FileNotFoundError(f"no {suffix} in {folder}")
    if len(found) > 1:
        raise ValueError(f"{len(found)} files {suffix} in {folder}")
    return found[0]


def products(folder: str, spark) -> dict[str, list[str]]:
    """The products under a folder by kind."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, todo = [], fs.listFiles(p, True)
    while todo.hasNext():
        files.append(todo.next().getPath().toString())
    return {k: sorted(f for f in files if f.endswith(s)) for k, s in (("markdown", ".md"), ("text", ".txt"), ("cues", ".srt"), ("report", ".json"))}
