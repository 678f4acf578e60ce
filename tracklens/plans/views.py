"""Segment-like views of the general test tables, in Spark and (the same) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments: 80 ms a character, with a pause before each that depends on the conversation."""
    n = F.length("text").cast("long")
    before = F.coalesce(F.sum(n * 80).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("recording_id"), F.col("turn").cast("int").alias("seg_ord"), F.col("role").alias("speaker"), "text",
        n.alias("chars"), F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).cast("long").alias("spoken"), (before + F.col("turn") * (F.col("conv_id") % 5 * 450)).alias("start"),
    )
    return rows.withColumn("end", F.col("start") + F.col("chars") * 80)


CONV = r"""conv_seg AS (SELECT *, start + chars * 80 AS "end" FROM (
  SELECT conv_id::VARCHAR AS recording_id, turn::INT AS seg_ord, role AS speaker, text, length(text)::BIGINT AS chars, length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::BIGINT AS spoken,
    (coalesce(sum(length(text) * 80) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + turn * (conv_id % 5 * 450))::BIGINT AS start FROM conversations)),
conv_rec AS (SELECT recording_id, max("end") + 1000 AS duration FROM conv_seg GROUP BY 1)"""


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments of ten recordings, of a length after their value; passes are event types."""
    e = F.col("event_id")
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000")
    pass_id = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int") - 1
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("recording_id"), e.alias("seg_ord"), pass_id.alias("pass_id"), start.alias("start"), (start + F.round(F.col("value") * 60).cast("long") * 1000).alias("end"),
        F.col("event_type").alias("text"), (e * 37 % 400).alias("chars"), (e * 37 % 400).alias("spoken"), (-(e % 7) * 0.25).cast("double").alias("avg_logprob"), (-20 - e % 60).cast("double").alias("db"),
    )
    return rows


EV = """ev_seg AS (SELECT *, start + secs * 1000 AS "end" FROM (
  SELECT (user_id % 10)::VARCHAR AS recording_id, event_id AS seg_ord, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::INT AS pass_id,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000 AS start, round(value * 60)::BIGINT AS secs, event_type AS text, event_id * 37 % 400 AS chars, event_id * 37 % 400 AS spoken,
    (-(event_id % 7) * 0.25)::DOUBLE AS avg_logprob, (-20 - event_id % 60)::DOUBLE AS db FROM events)),
ev_rec AS (SELECT recording_id, max("end") + 3600000 AS duration FROM ev_seg GROUP BY 1)"""


def recordings_of(segs: DataFrame, rest: int) -> DataFrame:
    return segs.groupBy("recording_id").agg((F.max("end") + rest).alias("duration"))


#: Of some rows (recording_id, start, end) named {0}: its islands as {1}.
ISLANDS = """{1} AS (SELECT recording_id, island, min(start) AS a, max("end") AS b, count(*) AS n_segments FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max("end") OVER (PARTITION BY recording_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {0})) GROUP BY ALL)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and damaged hypotheses: every passage, every 17th character lost, vowels changed in odd items."""
    b = table(spark, sf_dir, "benchmark")
    lost = F.regexp_replace("text", "(?s)(.{16}).", "$1")
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("ref"), F.when(F.col("item_id") % 2 == 1, F.translate(lost, "aeiou", "eioua")).otherwise(lost).alias("hyp"))
