"""Scoring against gold and over manifests, adapters, kept tables, the command line."""

import glob
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens import cli
from tracklens.plans import evaluate
from tracklens.sources import adapters


def rows(spark, data):
    return spark.createDataFrame([("r", *d) for d in data], "recording_id string, start long, end long, text string")


def test_cuts_are_not_charged(spark):
    gold = rows(spark, [(0, 1000, "你好吗"), (1000, 2000, "我很好")])
    cues = rows(spark, [(0, 1500, "你好吗我"), (1500, 1900, "很好"), (2000, 3000, "后面的话")])
    r = evaluate.against_gold(gold, cues).first()
    assert (r["cer"], r["n_ref"], r["window_end"]) == (0.0, 6, 2000)
    r = evaluate.against_gold(gold, cues.limit(0)).first()
    assert r["dele"] == 6 and r["cer"] == 1.0


def test_manifest_strips_glosses(spark):
    items = spark.createDataFrame([("a", "甲（Alpha）乙", "甲乙"), ("b", "丙丁", "丙")], "audio string, text string, hyp string")
    total, each = evaluate.over_manifest(items)
    assert total.first()["cer"] == 0.25 and each.count() == 2
    assert evaluate.summary(F.lit("x")) is not None and "CER 25.00%" in total.select(evaluate.summary(F.lit("x"))).first()[0]
    t = spark.createDataFrame([("u1", "a b"), ("u2", "c")], "utt_id string, text string")
    assert [tuple(r) for r in evaluate.transcripts_with_audio(t, spark.createDataFrame([("u1", "u1.wav")], "utt_id string, audio string")).collect()] == [("u1.wav", "ab")]


def test_adapters_and_kept_tables(spark, tmp_path):
    with pytest.raises(KeyError, match="characters"):
        adapters.adapter("none")
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert adapters.kept(spark, str(tmp_path / "k"), config, make).count() == 3
    assert len(made) == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "rec.json").write_text(json.dumps({"duration": 20.0, "segments": [{"start": 0.0, "end": 8.0, "text": "今天我们来讲财务管理", "words": []}, {"start": 9.0, "end": 18.0, "text": "第二部分讲登记义务", "words": []}]}))
    with wave.open(str(tmp_path / "rec.wav"), "wb") as w:
        w.setparams((1, 2, 16_000, 0, "NONE", ""))
        w.writeframes(np.full(320_000, 3000, "<i2").tobytes())
    (tmp_path / "g.json").write_text(json.dumps({"name": "g", "fixes": [["登记", "登计"]], "terms": []}))
    cli.main(["run", str(tmp_path / "rec.json"), "--energy", str(tmp_path / "rec.wav"), "--glossary", str(tmp_path / "g.json"), "--out", str(tmp_path / "out")])
    read = lambda kind: "".join(open(f, encoding="utf-8").read() for f in glob.glob(f"{tmp_path}/out/{kind}/recording_id=rec/*.txt"))
    assert "登计义务" in read("txt") and "00:00:09,000 --> 00:00:18,000" in read("srt") and json.loads(read("json"))["final"][0]["n_segments"] == 2
    (tmp_path / "rec.srt").write_text(read("srt"), encoding="utf-8")
    cli.main(["goldset", str(tmp_path / "rec.srt"), "--start", "5", "--out", str(tmp_path / "gold")])
    sheet = "".join(open(f, encoding="utf-8").read() for f in glob.glob(f"{tmp_path}/gold/recording_id=rec/*.txt"))
    assert sheet.strip() == "00:00:09\t00:00:18\t第二部分讲登计义务"
    (tmp_path / "rec.tsv").write_text(sheet.replace("登计", "登记"), encoding="utf-8")
    cli.main(["eval", "--gold", str(tmp_path / "rec.tsv"), "--hyp", str(tmp_path / "rec.srt"), "--out", str(tmp_path / "e")])
    assert "substituted 1, of these alike 100.0%" in capsys.readouterr().out
