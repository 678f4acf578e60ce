"""Results that are known for small inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklens.functions import text as T
from tracklens.functions import timefmt
from tracklens.functions.lexicon import Lexicon, build, loosened, word_edges, words_in
from tracklens.operators import audit, intervals, merge, paragraphs, segment, speakers
from tracklens.sources import readers, writers


@pytest.fixture(scope="module")
def lexicon(spark):
    return build(spark)


# ---- scoring


def test_score_kinds(lexicon):
    s = T.score("甲乙丙丁", "甲X丙丁戊", lexicon)
    assert (s["sub"], s["ins"], s["dele"]) == (1, 1, 0)
    assert T.score("甲乙丙丁戊己", "甲乙丙", lexicon)["dele"] == 3
    s = T.score("猫乙", "乙猫", lexicon)
    assert (s["dele"], s["ins"], s["sub"]) == (1, 1, 0)
    s = T.score("旧账", "旧赃", lexicon)
    assert (s["sub"], s["homo"], s["near"]) == (1, 0, 1)
    s = T.score("旧账APP", "旧帐ABC", lexicon)
    assert (s["sub"], s["homo"], s["near"]) == (3, 1, 1)


def test_normalized(lexicon):
    assert T.normalized("上課的時間，差不多到了。", lexicon) == "上课的时间差不多到了"
    assert T.normalized("2019年") == T.normalized("二零一九年") == T.normalized("二〇一九年")


def test_micro_rates(spark):
    rows = [("a" * 100, "a" * 100), ("bc", "xy")]
    s = spark.createDataFrame(rows, "ref string, hyp string").select(T.score_udf()("ref", "hyp").alias("s")).select("s.*")
    assert T.micro(s).first()["cer"] == pytest.approx(2 / 102, abs=1e-6)
    s = spark.createDataFrame([("", "abcd"), ("abcd", "abcx")], "ref string, hyp string").select(T.score_udf()("ref", "hyp").alias("s")).select("s.*")
    assert T.micro(s).first()["cer"] == 1.25


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=200, deadline=None)
def test_path_is_shortest_and_replays(a, b):
    path = T.edit_path(a, b)
    assert len(path) == _levenshtein(a, b)
    out = list(a)
    for kind, i, j in reversed(path):
        if kind == "delete":
            del out[i]
        elif kind == "insert":
            out.insert(i, b[j])
        else:
            out[i] = b[j]
    assert "".join(out) == b


def test_gloss(spark):
    rows = [("甲（Recep Tayyip Erdoğan）乙",), ("（以下简称甲方）",), ("（第三次）",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.without_gloss(F.col("t"))).collect()]
    assert got == ["甲乙", "（以下简称甲方）", "（第三次）"]


# ---- sounds


def test_repairs(spark, lexicon):
    fix = lambda t, terms, **k: T.repaired(t, terms, lexicon, word_edges(spark, t), **k)
    assert fix("才税管理的要点", ["财税管理"]) == ("财税管理的要点", [{"pos": 0, "from": "才税管理", "to": "财税管理"}])
    assert fix("前面才税管理后面", ["财税管理"])[1][0]["pos"] == 2
    assert fix("大型活动场所的税务登记义务", ["所得税"]) == ("大型活动场所的税务登记义务", [])
    assert fix("缴纳所的税的问题", ["所得税"])[0] == "缴纳所得税的问题"
    assert fix("ABC", ["APP"]) == ("ABC", [])
    assert lexicon.key("女") != lexicon.key("奴") and loosened("zhang") == "zan"


def test_word_edges_of_the_lexicon(spark, lexicon):
    from dataclasses import replace

    texts = ["才税管理的要点", "大型活动场所的税务登记义务", "缴纳所的税的问题"]
    known = replace(lexicon, words=words_in(spark, texts))
    assert {"场所", "登记", "义务"} <= known.words
    fix = lambda t, terms: T.repaired(t, terms, known, known.edges(t))[0]
    assert [fix(texts[0], ["财税管理"]), fix(texts[1], ["所得税"]), fix(texts[2], ["所得税"])] == ["财税管理的要点", texts[1], "缴纳所得税的问题"]
    cut = Lexicon(words=frozenset(["ab", "abc", "cd", "de"]))
    assert cut.edges("abcde") == ({0, 3}, {3, 5}) and cut.edges("") == (set(), {0}) and cut.edges("xy") == ({0, 1}, {1, 2})


def test_leftmost_then_longest_place_is_repaired(lexicon):
    fix = lambda t, terms: T.repaired(t, terms, lexicon)
    assert fix("才税管理", ["财税", "财税管理", "税管"])[0] == "财税管理"
    assert fix("才山管理", ["财税", "税管"]) == ("才山管理", []) and fix("才税管", ["税管", "财税"])[0] == "财税管"
    assert fix("财税才税", ["财税", "菜税"]) == ("财税财税", [{"pos": 2, "from": "才税", "to": "财税"}])


def test_polished_rows_keep_their_number(lexicon):
    rows = ["旧帐和固定资产", "才税管理"]
    fine = T.polished(rows, "旧账和固定资全\n财税管理", lexicon)
    assert (fine["texts"], fine["refused"], fine["rejected"]) == (["旧账和固定资产", "财税管理"], False, 1)
    merged = T.polished(rows, "旧账和固定资产财税管理", lexicon)
    assert (merged["texts"], merged["refused"], merged["edits"]) == (rows, True, [])
    back = T.polished(["财税管理"], "才税管理", lexicon, ["财税管理"])  # a proposal that undoes a term
    assert back["texts"] == ["财税管理"] and back["edits"] == [{"row": 0, "pos": 0, "from": "才税管理", "to": "财税管理"}]


def test_constrained(lexicon):
    c = T.constrained("旧帐和固定资产", "旧账和固定资全", lexicon)
    assert c["text"] == "旧账和固定资产" and c["rejected"] == 1
    assert [e["pos"] for e in T.constrained("旧帐和往帐都要查", "旧账和往账都要查", lexicon)["edits"]] == [1, 4]
    assert T.constrained("会议室A", "会议室B", lexicon)["rejected"] == 1
    assert T.constrained("甲乙", "甲", lexicon)["reason"] == "length"


# ---- punctuation


def test_clause_breaks_keep_all():
    assert T.clause_breaks("业务交流业务交流") == "业务交流业务交流"
    assert T.clause_breaks("一" * 20 + "但是天") == "一" * 20 + "，但是天"
    assert T.clause_breaks("一" * 19 + "是但是天") == "一" * 19 + "是但是天"
    assert T.clause_breaks("一" * 40 + "了天") == "一" * 40 + "了，天"


@given(st.text("甲了，但是。", max_size=80))
@settings(max_examples=100, deadline=None)
def test_clause_breaks_only_add(t):
    assert T.clause_breaks(t).replace("，", "") == t.replace("，", "")


def test_punctuated():
    words = [{"start": i * 100 + (1500 if i >= 5 else 0), "end": i * 100 + 90 + (1500 if i >= 5 else 0), "word": "字"} for i in range(10)]
    assert T.punctuated("字" * 10, words, 350, 900) == "字" * 5 + "。" + "字" * 5
    assert T.punctuated("字" * 10, [], 350, 900) == "字" * 10


def test_chunks():
    text = "字" * 20_000
    got = T.chunks(text, 1200)
    assert max(map(len, got)) <= 1800 and "".join(got) == text
    assert T.chunks("ab。cd", 2) == ["ab。", "cd"]


# ---- intervals and audit


def _segs(spark, rows):
    return spark.createDataFrame([("r", *r) for r in rows], "recording_id string, start long, end long, chars long, spoken long")


def test_coverage(spark):
    segs = _segs(spark, [(0, 100_000, 300, 300), (100_000, 200_000, 30, 30)])
    r = intervals.coverage(segs, spark.createDataFrame([("r", 400_000), ("none", 0)], "recording_id string, duration long"))
    a = {x["recording_id"]: x for x in r.collect()}
    assert a["r"]["cover_pct"] == 50 and a["r"]["speech"] < a["r"]["cover"] and a["r"]["starved"] == 1
    assert a["none"]["cover_pct"] == 0 and a["none"]["n_segments"] == 0


def test_starved(spark):
    segs = _segs(spark, [(1_575_000, 1_871_000, 128, 128), (0, 30_000, 100, 100), (0, 6_000, 2, 2)])
    got = intervals.starved_spans(segs).collect()
    assert len(got) >= 3 and all(x["b"] - x["a"] <= 90_000 for x in got) and min(x["a"] for x in got) == 1_575_000


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), min_size=1, max_size=25))
@settings(max_examples=10, deadline=None)
def test_islands_brute_force(spark, pairs):
    segs = _segs(spark, [(a, a + n, 1, 1) for a, n in pairs])
    got = sorted((x["a"], x["b"]) for x in intervals.islands(segs).collect())
    want = []
    for a, b in sorted((a, a + n) for a, n in pairs):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert got == [tuple(w) for w in want]


def _judge(spark, db, text="字" * 30, logprob=0.0):
    rows = [("r", 60_000, 65_000, text, len(text.strip()), logprob, db, -28.0)]
    df = spark.createDataFrame(rows, "recording_id string, start long, end long, text string, spoken long, avg_logprob double, db double, speech_db double")
    return audit.judged(df).first()["action"]


def test_hallucinations(spark):
    assert _judge(spark, -270.0) == "drop"
    assert _judge(spark, -43.0) == "keep"
    assert _judge(spark, -270.0, " ") == "keep"
    assert _judge(spark, -30.0, "谢谢观看") == "retranscribe"
    assert _judge(spark, None, "谢谢观看") == "keep"
    assert _judge(spark, -40.0, "谢谢观看") == "drop"


def test_loudness(spark):
    energy = spark.range(100).selectExpr("'r' AS recording_id", "id AS frame_ord", "160L AS n_samples", "CAST(160 * 3000.0 * 3000.0 AS double) AS sum_sq")
    ranges = spark.createDataFrame([("r", 0, 20), ("r", 0, 500)], "recording_id string, a long, b long")
    got = {x["b"]: x["db"] for x in audit.range_db(ranges, energy).collect()}
    assert got[20] is None and got[500] == pytest.approx(20 * np.log10(3000 / 32768))


# ---- cues


@pytest.mark.parametrize("rows", [[(25, 108), (65, 113), (112, 142)], [(0, 10), (1, 1.05), (1.02, 1.03)]])
def test_cues_do_not_overlap(spark, rows):
    df = spark.createDataFrame([("r", i, int(a * 1000), int(b * 1000), "t") for i, (a, b) in enumerate(rows)], "recording_id string, seg_ord int, start long, end long, text string")
    got = sorted((x["start"], x["end"]) for x in segment.clamped(df).collect())
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    t, want = 0, []
    for a, b in sorted((int(a * 1000), int(b * 1000)) for a, b in rows):
        s = max(a, t)
        t = max(b, s + 300)
        want.append((s, t))
    assert got == want


def test_split_row():
    words = [{"start": i * 1000, "end": i * 1000 + 900, "word": "字"} for i in range(120)]
    got = segment.split_row("字" * 120, words, 8000, 16)
    assert len(got) >= 4 and all(b - a <= 8000 for a, b, _ in got) and "".join(t for *_, t in got) == "字" * 120


def test_character_adapter(spark):
    shape = "recording_id string, item_ord int, text string, timestamp array<array<bigint>>"
    seg = lambda text, ts: segment.from_characters(spark.createDataFrame([("r", 0, text, ts)], shape)).orderBy("start").collect()
    assert [s["text"] for s in seg("你 好", [[0, 200], [210, 400]])] == ["你好"]
    assert [s["text"] for s in seg("你 好", [[0, 200], [4800, 5000]])] == ["你", "好"]
    long = seg(" ".join("字" * 120), [[i * 500, i * 500 + 490] for i in range(120)])
    assert len(long) >= 2 and all(s["end"] - s["start"] <= 28_500 for s in long)
    assert seg("你 好", [[0, 200]])[0]["words"] == []
    assert seg("", None) == []


def test_item_adapter():
    assert segment.aligned_texts("大中，请起立。", [["大", "中"], ["请", "起", "立"]]) == ["大中，", "请起立。"]
    assert segment.aligned_texts("大中", [["小"]]) is None


def test_split_points():
    loud = np.full(600, 1e6)
    loud[190:210] = 0
    loud[380:400] = 0
    got = segment.split_points(loud, 50, 30_000, 10_000, 2000)
    assert 9_500 <= got[1] <= 10_500 and 19_000 <= got[2] <= 20_000 and got[0] == 0 and got[-1] == 30_000


def test_thresholds(spark):
    def of(gap, n):
        rows = [("r", 0, i, i * (100 + gap), i * (100 + gap) + 100) for i in range(n)]
        return segment.pause_thresholds(spark.createDataFrame(rows, "recording_id string, seg_ord int, word_ord int, start long, end long")).first()

    assert of(500, 60)["comma"] >= 450 and of(20, 60)["comma"] <= 350
    assert (of(500, 3)["comma"], of(500, 3)["period"]) == (350, 900.0)


# ---- merging


def test_bucket_tie_goes_to_the_later_pass(spark):
    rows = [("r", 0, 0, 1000, 5), ("r", 1, 0, 1000, 5)]
    segs = spark.createDataFrame(rows, "recording_id string, pass_id int, start long, end long, chars long")
    assert merge.bucket_winners(segs, spark.createDataFrame([("r", 60_000)], "recording_id string, duration long")).first()["pass_id"] == 1


def _row(a, b, text):
    return {"start": a * 1000, "end": b * 1000, "text": text, "words": []}


def test_deduplicated():
    cite = "根据大型活动场所财务管理办法第九条"
    assert [r["text"] for r in merge.deduplicated([_row(0, 5, cite + "要登记"), _row(10, 15, cite + "还要做年度报告")])] == [cite + "要登记", cite + "还要做年度报告"]
    got = merge.deduplicated([_row(0, 10, cite), _row(5, 15, cite + "应当指定三人管理")])
    assert got[1]["text"] == "应当指定三人管理" and got[1]["words"] is None
    assert len(merge.deduplicated([_row(0, 5, cite), _row(6, 9, cite)])) == 1


def test_patched():
    rows = merge.patched([_row(0, 90, "旧" * 10)], [{"a": 0, "b": 90_000, "rows": [_row(0, 90, "新" * 60)]}])
    assert [r["text"][0] for r in rows] == ["新"]
    rows = merge.patched([_row(0, 90, "旧" * 10)], [{"a": 0, "b": 90_000, "rows": [_row(0, 90, "新" * 25)]}])
    assert [r["text"][0] for r in rows] == ["旧"]


# ---- speakers


@pytest.mark.parametrize("who, want", [
    (["S1", "S1", "S2", "S2", "S1"], ["S1", "", "S2", "", "S1"]), (["S1", "S1", "S1"], ["", "", ""]),
    (["S1", None, "S1", "S2"], ["S1", "", "S1", "S2"]), (["S1", None, "S1"], ["", "", ""]),
])
def test_labels(spark, who, want):
    df = spark.createDataFrame([("r", i, w) for i, w in enumerate(who)], "recording_id string, seg_ord int, speaker string")
    assert [r["label"] for r in speakers.labelled(df).orderBy("seg_ord").collect()] == want


def test_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.eye(8)[0] + rng.normal(0, 0.05, (5, 8)), -np.eye(8)[0] + rng.normal(0, 0.05, (4, 8))])
    got = speakers.average_linkage(x)
    assert len(set(got)) == 2 and len(set(got[:5])) == 1 and (speakers.average_linkage(100 * x) == got).all()
    assert len(set(speakers.average_linkage(x[:3], 10))) == 3
    assert len(speakers.average_linkage(np.zeros((0, 4)))) == 0 and speakers.average_linkage(x[:1]).tolist() == [0]
    with pytest.raises(ValueError):
        speakers.average_linkage(x, 0)


def test_short_rows_are_filled(spark):
    rows = [("r", 0, 0, 2000, [1.0, 0.0]), ("r", 1, 2000, 2200, [1.0, 0.0]), ("r", 2, 2200, 4200, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "recording_id string, seg_ord int, start long, end long, embedding array<double>")
    assert [r["speaker"] for r in speakers.assigned(df).orderBy("seg_ord").collect()] == ["S1", "S1", "S2"]


def test_paragraph_per_speaker():
    rows = [{"start": 0, "end": 3000, "text": "甲", "speaker": "S1"}, {"start": 3100, "end": 6000, "text": "乙", "speaker": "S2"}]
    assert len(paragraphs.assembled(rows)) == 2
    rows[1]["speaker"] = "S1"
    assert paragraphs.assembled(rows)[0]["text"] == "甲乙"
    rows[1]["start"] = 3400
    assert paragraphs.assembled(rows)[0]["text"] == "甲，乙"


# ---- files


def test_times(spark):
    got = spark.createDataFrame([("00:12:34",), ("12:34",), ("754",), ("",)], "t string").select(timefmt.parse_hms(F.col("t"))).collect()
    assert [r[0] for r in got] == [754, 754, 754, None]


def test_files(spark, tmp_path):
    cues = spark.createDataFrame([("r", 0, 0, 1500, "甲"), ("r", 1, 1500, 62_345, "乙")], "recording_id string, cue_ord int, start long, end long, text string")
    body = writers.srt(cues).first()["body"]
    assert "2\n00:00:01,500 --> 00:01:02,345\n乙" in body
    (tmp_path / "r.srt").write_text(body + "9\nbad\nx\n\n", encoding="utf-8")
    assert [tuple(x) for x in readers.read_srt(spark, str(tmp_path / "r.srt")).orderBy("cue_ord").collect()] == [tuple(x) for x in cues.collect()]
    (tmp_path / "g.tsv").write_text("1\t2\t a\tb \n\n3\tc\n", encoding="utf-8")
    assert [(x["start"], x["end"], x["text"]) for x in readers.read_gold(spark, str(tmp_path / "g.tsv")).orderBy("start").collect()] == [(1000, 2000, "a\tb"), (3000, 3000, "c")]
    assert writers.one_file(str(tmp_path), ".srt", spark).endswith("r.srt")
    (tmp_path / "s.srt").write_text("")
    with pytest.raises(ValueError):
        writers.one_file(str(tmp_path), ".srt", spark)
    with pytest.raises(FileNotFoundError):
        writers.one_file(str(tmp_path), ".none", spark)
    (tmp_path / "p.json").write_text('{"duration": 2.5, "segments": [{"start": 0.1, "end": 1.2, "text": "x", "words": [{"start": 0.1, "end": 0.3, "word": "x"}]}]}')
    rec, segs = readers.read_pass(spark, str(tmp_path / "p.json"), 0)
    assert rec.first()["duration"] == 2500 and segs.first()["words"][0]["end"] == 300
    (tmp_path / "q.json").write_text('[{"span": [1, 2], "label": "l", "attempts": [{"mode": "m", "rows": [{"start": 1, "end": 2, "text": "y"}]}]}]')
    assert readers.read_patches(spark, str(tmp_path / "q.json")).first()["text"] == "y"
    (tmp_path / "t.json").write_text('{"name": "n", "fixes": [["a", "b"]], "terms": ["c"]}')
    assert readers.read_glossary(spark, str(tmp_path / "t.json"))["fixes"].first()["right"] == "b"


def test_energy(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((1, 2, 16_000, 0, "NONE", ""))
        w.writeframes(np.full(16_000, 3000, "<i2").tobytes())
    e = readers.read_energy(spark, str(tmp_path / "a.wav"))
    assert e.count() == 100 and e.first()["sum_sq"] == 160 * 3000.0**2 and e.first()["recording_id"] == "a"
