"""Operators on many rows that all meet each other: right, and without the square of their number."""

import random

from tracklens.operators import intervals, merge
from tracklens.plans import registry

R = "recording_id string, start bigint, end bigint, chars bigint"
S = "recording_id string, span_ord int, a bigint, b bigint"


def most_rows(df):
    """The result, and the most rows that a node of its plan gave."""
    rows, todo, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def test_overlaps_of_many(spark):
    n = 2000
    rows = spark.createDataFrame([("x", i, 100_000 + i, 3) for i in range(n)], R)
    spans = spark.createDataFrame([("x", i, 50_000 - i, 60_000 + i) for i in range(n)], S)
    got, most = most_rows(intervals.overlapping_chars(rows, spans))
    assert sorted(tuple(r) for r in got) == [("x", i, 3 * n) for i in range(n)]
    assert most <= 10 * n


def test_overlaps_of_odd_rows(spark):
    """Rows and spans of no length, the wrong way round, at the same time, with nulls, in stretches before 0 and far away."""
    some = random.Random(5)
    at = lambda: some.choice([None, -7_200_000, -3, 0, 1, 2, 3, 4, 5, 3_599_999, 3_600_000, 3_600_001, 9 * 10**9])
    rows = [(some.choice(["x", "y", None]), at(), at(), some.choice([None, 0, 1, 7, 100])) for _ in range(300)]
    spans = [(r, i, at(), at()) for i in range(100) for r in ("x", "z", None)]
    met = lambda r, s: None not in (*r[:3], *s) and r[0] == s[0] and r[1] < s[3] and r[2] > s[2]
    want = {s[:2]: sum(r[3] or 0 for r in rows if met(r, s)) for s in spans}
    got = intervals.overlapping_chars(spark.createDataFrame(rows, R), spark.createDataFrame(spans, S)).collect()
    assert {(r["recording_id"], r["span_ord"]): r["have"] for r in got} == want and len(got) == len(want)


def test_attempts_of_many(spark, tmp_path):
    """A second of speech each, all near every span: 900 spans, 1800 rows of two passes."""
    events = spark.sql(
        """SELECT id AS event_id, timestampadd(SECOND, cast(id % 900 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts, 0L AS user_id,
        CASE WHEN id < 900 THEN 'purchase' ELSE 'view' END AS event_type, 1.0D AS value, '' AS props FROM range(1800)"""
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    got, most = most_rows(registry.QUERIES["best_attempt"](spark, str(tmp_path)))
    assert len(got) == 900 and most <= 12 * 1800
    rows = {(i % 900) * 1000: (i * 37 % 400, (i + 900) * 37 % 400) for i in range(900)}
    for r in got:
        a = (r["span_ord"] - 1) * 1000
        sums = [sum(c[k] for t, c in rows.items() if a - 500 <= t <= a + 1_800_500) for k in (0, 1)]
        assert (r["attempt_ord"], r["chars"]) == ((2, sums[0]) if sums[0] >= sums[1] else (4, sums[1]))


def test_attempts_at_equal_those_of_pairs(spark):
    some = random.Random(7)
    at = lambda: some.choice([None, -3_600_000, -501, -500, -1, 0, 1, 500, 1000, 3_599_999, 3_600_000, 7_200_500, 9 * 10**9])
    rows = spark.createDataFrame([(some.choice(["x", "y", None]), some.choice([0, 1, 2, None]), at(), some.choice([None, 0, 1, 7])) for _ in range(200)], "recording_id string, attempt_ord int, start bigint, chars bigint")
    spans = spark.createDataFrame([(r, i, at(), at()) for i in range(60) for r in ("x", "z", None)], S)
    want = merge.best_attempts(spans.join(rows, "recording_id")).select("recording_id", "span_ord", "attempt_ord", "chars").collect()
    got = merge.best_attempts_at(spans, rows).select("recording_id", "span_ord", "attempt_ord", "chars").collect()
    assert want and sorted(map(str, got)) == sorted(map(str, want))
