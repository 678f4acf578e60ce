"""The pipeline's stages against brute force on their own inputs, and the whole run."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tracklens.llm import language  # noqa: E402
from tracklens.llm.common import staged  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("own")).withColumn("name", F.lit(7))
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0, "own", 7), (10**6 + 1, "123 ...", None, None, 7, "own", 7), (0, docs.first()["text"], "en", "src0", 1, "own", 7)], docs.schema)
    docs = staged(docs.unionByName(extra), "docs")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], sf_dir), name))
    return out


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_language_stage_drops_only_what_has_no_language(stages):
    before, after = ({r["doc_id"] for r in s.select("doc_id").collect()} for s in stages[:2])
    assert before - after == {10**6, 10**6 + 1}


def test_language_stage_drops_what_no_language_holds(spark, sf_dir):
    rng = random.Random(5)
    noise = [" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9))) for _ in range(60)) for _ in range(20)]
    foreign = ["Это текст на русском языке, и больше ничего", "これは日本語の文章です", "Αυτό είναι ένα κείμενο", "नमस्ते दुनिया", "ሰላም ለዓለም"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").limit(100)
    mixed = " ".join(docs.where("lang = 'en'").first()["text"].split()[:30]) + " " + " ".join(docs.where("lang = 'de'").first()["text"].split()[:30])
    texts = [*noise, *foreign, mixed]
    planted = spark.createDataFrame([(10**6 + i, t, None, "src0", len(t)) for i, t in enumerate(texts)], docs.schema)
    both = staged(docs.unionByName(planted), "docs")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both, sf_dir).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} | {10**6 + len(texts) - 1}


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    up = list(range(len(rows)))
    top = lambda i: i if up[i] == i else top(up[i])
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                up[top(i)] = top(j)
    least: dict = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    assert sorted(r["doc_id"] for r in stages[2].select("doc_id").collect()) == sorted(least.values())


def test_mixing_takes_near_its_targets(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = stages[2].collect(), stages[3].collect()
    total = sum(size(r["text"]) for r in before)
    assert sum(size(r["text"]) for r in after) == pytest.approx(total, rel=0.1)
    n: dict = {}
    for r in after:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert max(n.values()) <= 3 and set(n) <= {r["doc_id"] for r in before}


def test_packing_holds_all_tokens(stages):
    pieces = stages[4].collect()
    by: dict = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    ids = sorted(r["doc_id"] for r in pieces if r["piece"] == 0)
    assert ids == sorted(r["doc_id"] for r in stages[3].select("doc_id").collect())


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    a, b = (corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect() for _ in range(2))
    assert sorted(map(str, a)) == sorted(map(str, b)) and a
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_empty_and_long(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    long = docs.limit(1).withColumn("text", F.expr("repeat(concat(text, ' '), 300)"))
    assert language.identify(long, language.fit(docs)).count() == 1
