"""The whole chain on one small recording."""

from pyspark.sql import functions as F

from tracklens import schema
from tracklens.functions.lexicon import Lexicon
from tracklens.plans.transcribe import PROFILES, Profile, run, with_speakers


def test_chain(spark):
    words = lambda t, s: [{"start": s + i * 200, "end": s + i * 200 + 180, "word": c} for i, c in enumerate(t)]
    seg = lambda p, i, a, b, t, lp=0.0: ("r", p, i, a, b, t, lp, 0.0, words(t, a))
    one, two = "今天我们讲大型活动的账目", "第二部分讲财务管理办法和登记义务"
    rows = [
        seg(0, 0, 0, 5000, one), seg(1, 0, 100, 5000, one + "好"), seg(0, 1, 31_000, 36_000, two), seg(1, 1, 31_000, 36_000, two[:8]),
        seg(0, 2, 62_000, 64_000, "谢谢观看"), seg(0, 3, 65_000, 67_000, "没有没有"),
    ]
    segs = spark.createDataFrame(rows, schema.SEGMENTS)
    rec = spark.createDataFrame([("r", 70_000)], schema.RECORDINGS)
    energy = spark.range(7000).select(F.lit("r").alias("recording_id"), F.col("id").alias("frame_ord"), F.lit(160).cast("long").alias("n_samples"), F.when(F.col("id") < 6400, 160 * 3000.0**2).otherwise(0.0).alias("sum_sq"))
    patch = spark.createDataFrame([("r", 0, 40_000, 60_000, "x", 0, "m", 0, 41_000, 50_000, "补上的一段话有二十多个字这样才够长可以放进去了", [])], schema.PATCH_ROWS)
    out = run(segs, rec, energy, patch, [("账目", "帐目")], profile=PROFILES["meeting"], lexicon=Lexicon())
    texts = [r["text"] for r in out["rows"].orderBy("start").collect()]
    assert texts == ["今天我们讲大型活动的帐目好", two, "补上的一段话有二十多个字这样才够长可以放进去了"]
    assert out["final"].first()["n_segments"] == 3
    assert [r["text"][-1] for r in out["paragraphs"].orderBy("par_ord").collect()] == ["。"] * 3
    cues = out["cues"].orderBy("cue_ord").collect()
    assert all(a["end"] <= b["start"] for a, b in zip(cues, cues[1:])) and "".join(c["text"] for c in cues) == "".join(texts)
    assert {r["action"] for r in out["first_hallucinations"].collect()} == {"retranscribe", "drop"}
    assert out["glossary"].collect() == [(0, "账目", 2)] and out["edits"].count() == 0  # in both passes
    alike = Lexicon({c: s for c, s in zip("账帐目木讲", ["zhang", "zhang", "mu", "mu", "jiang"])}, words=frozenset(["讲大"]))
    chain = run(segs, rec, energy, patch, terms=["帐目", "奖大"], lexicon=alike, profile=Profile("m", passes=2, phonetic=True), leads=["第二"], vectors=spark.createDataFrame([("r", 0, [1.0, 0.0]), ("r", 1, [0.0, 1.0])], "recording_id string, seg_ord int, embedding array<double>"))
    assert [(r["from"], r["to"], r["t"]) for r in chain["edits"].collect()] == [("账目", "帐目", 100)]
    assert [r["speaker"] for r in chain["rows"].orderBy("start").collect()][:2] == ["S1", "S2"]
    fast = run(segs, rec, energy, patch, profile=Profile("fast", patch=False), lexicon=Lexicon())
    assert fast["rows"].count() == 2
    vectors = spark.createDataFrame([("r", 0, [1.0, 0.0]), ("r", 1, [0.0, 1.0]), ("r", 2, [1.0, 0.1])], "recording_id string, seg_ord int, embedding array<double>")
    who = with_speakers(out["rows"], vectors)
    assert [r["speaker"] for r in who.orderBy("start").collect()] == ["S1", "S2", "S1"]
