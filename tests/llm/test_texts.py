"""Language identification (op 2), near duplicates (op 7), mixing (op 9) and fingerprints (op 10)."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklens.llm import fingerprint, jaccard, language, mixing
from tracklens.llm.graph import components

EN, DE = "the cat and the dog were walking with that other thing", "der hund und die katze gingen nicht über die straße"


# ---- language


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, spans int")


@pytest.fixture(scope="module")
def model():
    return language.Model(dict(language.grams([("en", EN + " " + EN), ("de", DE + " " + DE), ("ru", "и кот и собака шли вместе")])))


def test_batch_scores_equal_single_ones(model):
    def slow(w):
        w, out = f" {w.lower()} ", 0.0
        for i in range(1, len(w)):
            for lo in range(max(0, i - 3), i + 1):
                if (s := model.score.get(w[lo : i + 1])) is not None:
                    out = out + s + language.BACK_OFF * (lo - max(0, i - 3))
                    break
        return out

    words = ["the", "Straße", "katze", "и", "walking"]
    assert np.allclose(model.of(words), [slow(w) for w in words])


def test_spans_and_scripts(model):
    text = EN + " " + DE + " собака шли"
    lang, score, spans = model.labeller(8.0, -6.0).label([text])[0]
    assert [s[2] for s in spans] == ["en", "de", "ru"] and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and 0 <= score <= 1
    assert model.labeller(8.0, -6.0).label([None, "", "123 %%%"]) == [("und", 0.0, [])] * 3
    assert model.labeller(8.0, -6.0).label(["日本語"])[0][0] in model.langs


@given(st.lists(st.tuples(*[st.floats(-6, 0)] * 3), min_size=1, max_size=7))
@settings(max_examples=150, deadline=None)
def test_viterbi_is_best(rows):
    s = np.array(rows)
    cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    every = np.array(np.meshgrid(*[range(3)] * len(s))).T.reshape(-1, len(s))
    assert cost(language.viterbi(s, 2.0)) == pytest.approx(max(cost(p) for p in every))


def test_scripts_without_blanks_are_cut_into_windows():
    zh, ja = "今天的天气非常好我们一起去公园里散步吧那里有很多美丽的花和树木孩子们在草地上玩耍", "今日はとても天気がいいので公園へ散歩に行きましょう子供たちは芝生で遊んでいます"
    th, en = "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะกันเถอะเด็กๆกำลังเล่นอยู่บนสนามหญ้า", "the weather is very nice today and we all go for a walk in the park "
    model = language.Model(dict(language.grams([("zh", zh), ("ja", ja), ("th", th), ("en", en)])))
    label = language.Labeller(model, 8.0, -6.0).label
    for parts in ((("zh", zh * 5), ("ja", ja * 6)), (("th", th * 2), ("zh", zh * 2)), (("en", en * 2), ("zh", zh * 2), ("en", en))):
        [(_, _, spans)] = label(["".join(t for _, t in parts)])
        ends = np.cumsum([len(t) for _, t in parts])
        assert [lang for *_, lang in spans] == [lang for lang, _ in parts]
        assert all(abs(e - end) <= language.WINDOW for (_, e, _), end in zip(spans, ends))  # to a window
    [mixed] = label(["кот" + en[:9] + "の"])  # no language uses all scripts of a word: any may hold it, none does
    assert mixed[1] < 0.9
    assert language.Model.key("abcd") != language.Model.key("bcd") and len({language.Model.key(a + b) for a in "abcdefgh" for b in "abcdefgh"}) == 64


def test_held_out_accuracy_and_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    odd = docs_of(spark, [(None, None, None, "s", 1), (1, "", "en", "s", 1), (2, EN, None, "s", 1), (2, EN, None, "s", 1)])
    assert [r["lang_pred"] for r in language.languages(odd).collect()] == ["und"] * 4  # nothing to learn from
    kept = language.identify(odd.union(docs_of(spark, [(3, "x " * 200_000, "en", "s", 1)])), language.fit(docs))
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score", "spans"] and kept.count() == 5
    assert language.languages(docs.limit(0)).count() == 0


# ---- near duplicates


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n, up = [0] * len(rows), list(range(len(rows)))
    top = lambda i: i if up[i] == i else top(up[i])
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return {r[0]: (n[i], least[top(i)]) for i, r in enumerate(rows)}


def near_rows(n=60, words=80, seed=3):
    rng = np.random.default_rng(seed)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, words)) for _ in range(8)]
    rows = []
    for i in range(n):
        w = base[i % 8].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, "two words"), (n + 4, "two words"), (n + 5, " ".join(map(str, range(30_000)))), (n + 6, " ".join(map(str, range(29_990))))]


@pytest.mark.parametrize("block", [256, 4])
def test_links_and_classes_equal_brute_force(spark, block):
    rows = near_rows()
    df = spark.createDataFrame([(a, b, "k", 1) for a, b in rows], "doc_id bigint, text string, key string, links int")
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.near_duplicates(df, block=block).collect()}
    assert got == brute(rows)


def test_links_are_counted_once_where_blocks_are_empty(spark):
    # 30 groups of two near copies, each cut by shingles into more blocks than it has nodes
    words = lambda g, last: " ".join([f"w{g}x{i}" for i in range(60)] + [last])
    docs = spark.createDataFrame([(2 * g + k, words(g, f"end{k}")) for g in range(30) for k in range(2)], "doc_id bigint, text string")
    got = jaccard.near_duplicates(docs, most=40).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(i, i - i % 2, 1) for i in range(60)}


def test_near_duplicates_of_nothing_and_repeats(spark):
    shape = "doc_id bigint, text string"
    assert jaccard.near_duplicates(spark.createDataFrame([], shape)).count() == 0
    text = "a b c d e f g h"
    rows = spark.createDataFrame([(None, text), (4, text), (4, text), (7, text), (8, "other words that are quite different here"), (None, None)], shape)
    got = sorted(jaccard.near_duplicates(rows).collect(), key=str)
    assert [(r["n_copies"], r["n_links"]) for r in got if r["doc_id"] in (4, 7)] == [(3, 2)] * 3
    kept = jaccard.one_of_each(rows).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [4, 8] and sum(r["doc_id"] is None for r in kept) == 2
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(rows.where("doc_id <> 4")).collect()) == [7, 8]


def test_rows_of_one_id_and_several_texts(spark):
    a, b = "one two three four five six seven eight", "quite another text that has nothing in common with it"
    rows = spark.createDataFrame([(2, a), (2, b), (2, b), (5, a), (6, b), (7, ""), (7, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.one_of_each(rows).collect())) == sorted([(2, a), (2, b), (7, ""), (7, "")])


def test_pruning_keeps_what_may_match():
    least = jaccard.least_matches(0.8, 1e-6)
    assert least == sorted(least) and least[-1] < 0.8 * jaccard.HASHES


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=8, deadline=None)
def test_components(spark, pairs):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: up[x] for a, b in pairs if a != b for x in (a, b)}


# ---- mixing


def test_mix_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", F.lit(1).alias("size"), F.lit(2).alias("target"))
    docs = docs.union(spark.createDataFrame([(10**6, None, None, 1, 2), (10**6 + 1, "one two", None, 1, 2), (None, "three", "src1", 1, 2), (5, "four four", "tiny", 1, 2), (5, "four four", "tiny", 1, 2)], docs.schema))
    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total: dict = {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + size(r["text"])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free = set(names)
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in names if s not in free)) / sum(weight[s] for s in free)
        if not (over := {s for s in free if level * weight[s] > 3 * total[s]}):
            break
        free -= over
    want = {s: level * weight[s] if s in free else 3 * total[s] for s in names}
    for per_range in (500, 3):
        got = mixing.mix(docs, per_range).collect()
        assert len(got) == len(rows)
        assert [r["position"] for r in got if r["position"] is not None] == sorted(r["position"] for r in got if r["position"] is not None)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        assert sum(r["taken"] for r in got) == pytest.approx(sum(total.values()), rel=0.2)
        by = {}
        for r in got:
            by.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
        assert {k for k in by} == {(total[s], round(want[s], 6)) for s in names}
        for (n, target), part in by.items():
            assert abs(sum(r["taken"] for r in part) - target) <= max(r["size"] for r in part) * max(1, len(by) and sum(total[s] == n for s in names))
        again = mixing.mix(docs.repartition(3), per_range).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc", F.lit("x")).withColumn("name", F.lit("y"))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    n: dict = {}
    for r in out.select("doc_id").collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n == {d: c for d, c in copies.items() if c}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("slope", [-0.5, 0.0, 0.5])
def test_position_inverts_demand(spark, slope):
    rows = spark.range(101).select(mixing.position(F.col("id"), F.lit(100.0), F.lit(slope)).alias("u"), F.col("id")).collect()
    for u, x in rows:
        assert 100 * ((1 - slope) * u + slope * u * u) == pytest.approx(x, abs=1e-9)


# ---- fingerprints


def slow_cuts(data: bytes) -> list[int]:
    hashes = [sum(int(fingerprint.GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) & 0xFFFFFFFF for i in range(len(data))]
    out, at = [], 0
    while len(data) - at > fingerprint.SMALLEST:
        end = min(at + fingerprint.LARGEST, len(data))
        for e in range(at + fingerprint.SMALLEST, end + 1):
            mask = fingerprint.STRICT if e < at + fingerprint.NORMAL else fingerprint.LOOSE
            if hashes[e - 1] & int(mask) == 0:
                end = e
                break
        out.append(end)
        at = end
    return out + [len(data)] * (at < len(data))


def test_cuts_equal_plain_ones():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (0, 1, 31, 32, 33, 200, 3000)] + [b"a" * 2000, "é".encode() * 500]
    assert fingerprint.cuts(texts) == [slow_cuts(t) for t in texts]


def test_edits_keep_most_chunks():
    rng = np.random.default_rng(1)
    text = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(800))
    a, b, c = fingerprint.fingerprints([text, "new words in front " + text, text[::-1]])
    assert fingerprint.likeness(a, b) > 0.95 and fingerprint.likeness(a, c) == 0.0 and fingerprint.likeness(a, a) == 1.0
    assert fingerprint.likeness(frozenset(), frozenset()) == 1.0 and fingerprint.likeness(frozenset(), a) == 0.0


def test_fingerprints_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(0).alias("part"), F.lit("x").alias("fingerprint"))
    docs = docs.union(spark.createDataFrame([(10**6, None, 0, ""), (10**6 + 1, "", 0, ""), (-5, "é" * 1001, 0, ""), (None, "null", 0, "")], docs.schema))
    rows = sorted(((r[0], r[1] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = {}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        changed = fingerprint.edited(t, after)
        a, b, c = fingerprint.fingerprints([t, changed, after])
        want[d] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.as_text(a), fingerprint.as_text(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    got = {r[0]: tuple(r)[1:] for r in fingerprint.fingerprint_documents(docs).collect()}
    assert got == want
    assert fingerprint.fingerprint_documents(docs.limit(0)).count() == 0
    one = fingerprint.fingerprint_documents(docs.where("doc_id = -5")).first()
    assert one["near_next"] == 1.0
