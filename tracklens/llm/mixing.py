"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, ...; they share the words of all
documents by weight, none above ``most`` times its own words; what is cut off is shared again by
weight.  That is ``least(most * size, level * weight)`` for the one level at which targets add up.

Takes: a source's documents, in the order of a hash of their ids, repeat as an endless stream of
words; a copy of a document is taken if its middle lies before the source's target.

Curriculum: source number r has the weight density ``1 + slope_r * (2u - 1)`` at training time u in
[0, 1], so by u it has given ``target * ((1 - slope_r) * u + slope_r * u * u)`` words.  A copy that
begins at word x of its source's stream gets the u at which the source's demand reaches x, the
inverse of that quadratic; documents are range-sorted by u.

A prefix sum over a source of any size: ids' hashes deal each source's documents into ranges, small
ones by construction; sums of the ranges are added up first, then documents within each range.

Null text has size 0 and is never taken; documents of no words take 0; repeated rows count each;
an empty table gives no rows; a null id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir

# Fixed values.
WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def turn_of(doc_id: Column) -> Column:
    """The hash that orders a source's documents."""
    return F.coalesce(F.md5(doc_id.cast("string").cast("binary")), F.lit(""))


def name_of(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sized: DataFrame, most: int = 3) -> DataFrame:
    """A row for each source: source, source_size, weight, slope, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # from here on a row for each source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    third = F.pmod(place, F.lit(3))
    pick = lambda values: F.when(third == 0, values[0]).when(third == 1, values[1]).otherwise(values[2])
    per = per.withColumns({"weight": pick([F.lit(w) for w in WEIGHTS]).cast("long"), "slope": pick([F.lit(s) for s in SLOPES])})
    by_cap = Window.orderBy((F.col("source_size") * most / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if the sources before this one, in order of cap by weight, are at their caps
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / heavy)
    right = F.when(F.col("level") * F.col("weight") <= F.col("source_size") * most, F.col("level"))
    level = F.coalesce(F.max(right).over(everything), F.lit(0.0))  # levels fall once one is right
    return per.withColumn("target", F.least((F.col("source_size") * most).cast("double"), level * F.col("weight"))).drop("level")


def ranged(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` (name, turn, ...) with their source's columns and the range that their hash falls into."""
    at = F.conv(F.substring("turn", 1, 8), 16, 10).cast("long")
    share = F.coalesce(F.floor(at * F.col("ranges") / F.lit(1 << 32)), F.lit(0)).cast("long")
    return rows.join(per, "name").withColumn("range", share)


def range_starts(narrow: DataFrame, block: int = 1000) -> DataFrame:
    """The words of a source before each of its ranges; no task adds up more than ``block`` ranges."""
    sums = narrow.groupBy("name", "range").agg(F.sum("size").alias("words")).withColumn("block", F.floor(F.col("range") / block))
    blocks = sums.groupBy("name", "block").agg(F.sum("words").alias("words"))
    before = lambda key, by: F.coalesce(F.sum("words").over(Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("name", "block", before(["name"], "block").alias("base"))
    return sums.join(blocks, ["name", "block"]).select("name", "range", (F.col("base") + before(["name", "block"], "range")).alias("base"))


def takes(rows: DataFrame, starts: DataFrame, most: int = 3) -> DataFrame:
    """Ranged ``rows`` with the word of the stream where they begin, the copies and the words taken."""
    w = Window.partitionBy("name", "range").orderBy("turn", "doc_id", "size", *(["tie"] if "tie" in rows.columns else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(starts, ["name", "range"]).withColumn("begins", F.col("base") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    taken = lambda k: (2.0 * (k * F.col("source_size") + F.col("begins")) + F.col("size") <= 2.0 * F.col("target")).cast("long")
    copies = F.when(F.col("size") > 0, sum((taken(k) for k in range(1, most)), taken(0))).otherwise(0).cast("long")
    return rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def position(begins: Column, target: Column, slope: Column) -> Column:
    """The training time at which a source's cumulative demand reaches its word ``begins``."""
    share = F.least(F.coalesce(F.try_divide(begins.cast("double"), target), F.lit(0.0)), F.lit(1.0))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def _plan(docs: DataFrame, per_range: int, small: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sized documents, their sources, and where ranges start; all of narrow rows, the texts read once.

    The sources are broadcast only if there are at most ``small`` of them.
    """
    shared_dir(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), name_of(F.col("source")).alias("name"), size_of(F.col("text")).alias("size"), turn_of(F.col("doc_id")).alias("turn")).checkpoint()
    per = targets(narrow).select(name_of(F.col("source")).alias("name"), "source_size", "weight", "slope", "target", F.ceil(F.col("n") / per_range).alias("ranges")).checkpoint()
    per = F.broadcast(per) if per.count() <= small else per
    narrow = ranged(narrow.drop("source"), per)
    return narrow, per, range_starts(narrow)


def mix(docs: DataFrame, per_range: int = 500) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, copies, position (of the first copy; null if not taken), in its order."""
    narrow, _, starts = _plan(docs, per_range)
    rows = takes(narrow, starts).withColumn("position", F.when(F.col("copies") > 0, position(F.col("begins"), F.col("target"), F.col("slope"))))
    out = rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").checkpoint()
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, per_range: int = 500) -> DataFrame:
    """The documents, all columns, each as often as it is taken, range-sorted by training position."""
    _, per, starts = _plan(docs, per_range)
    text, doc_id = F.col("text"), F.col("doc_id")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), doc_id.cast("long").alias("doc_id"), name_of(F.col("source")).alias("name"), size_of(text).alias("size"), turn_of(doc_id).alias("turn"), F.xxhash64(text).alias("tie"))
    rows = takes(ranged(whole, per), starts).where("copies > 0")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    rows = rows.select("doc", "doc_id", "begins", "source_size", "target", "slope", copy.alias("copy"))
    rows = rows.select("doc", "doc_id", position(F.col("begins") + F.col("copy") * F.col("source_size"), F.col("target"), F.col("slope")).alias("position"))
    return rows.orderBy("position", "doc_id").select("doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS turn FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CASE place % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0 ELSE 0.5 END AS slope FROM per),
levels AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed WINDOW before AS (ORDER BY source_size * 3 / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT *, least((source_size * 3)::DOUBLE, coalesce(max(CASE WHEN level * weight <= source_size * 3 THEN level END) OVER (), 0) * weight) AS target FROM levels),
placed AS (SELECT s.doc_id, s.size, g.source_size, g.target, g.slope,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS begins
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
counted AS (SELECT *, CASE WHEN size > 0 THEN (2.0::DOUBLE * begins + size <= 2.0::DOUBLE * target)::BIGINT + (2.0::DOUBLE * (source_size + begins) + size <= 2.0::DOUBLE * target)::BIGINT
    + (2.0::DOUBLE * (2 * source_size + begins) + size <= 2.0::DOUBLE * target)::BIGINT ELSE 0 END AS copies FROM placed),
shared AS (SELECT *, least(CASE WHEN target > 0 THEN begins / target ELSE 0 END, 1.0::DOUBLE) AS share FROM counted)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies,
  CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END END AS position
FROM shared
"""
