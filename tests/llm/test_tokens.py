"""Token shards (op 1) and best-fit packing (op 8)."""

import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklens.llm import packing, pfor
from tracklens.llm.tokens import Encoder, vocabulary

ODD = ["", None, " ", "  a   b \n c", " x", " \n y  \t z ", "a\x1c b \x85 c  d", "it's I'll  don't", "ÀÉ é ́x    q", "<|endoftext|> a<|endoftext|>", "x\n\n  y", "a \n",
       "a .b ,c", "x .", "Foo.Bar, 5.5 é. ê, ??. a.. ,b", "a\0b c", "ǅ İ. ß ſ. Σας.", "word " * 3000]


@pytest.fixture(scope="module")
def encoders():
    return {n: Encoder(vocabulary(n), d, capacity=200) for n, d in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False))}


def whole(encoder, text):
    return array("I", encoder.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_odd_and_real_texts(encoders, spark, sf_dir, name):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(100).collect()]
    e = encoders[name]
    for lo in range(0, len(texts), 7):  # small batches, so that the cache turns over
        part = texts[lo : lo + 7]
        assert e.encode_batch(part) == [whole(e, t) for t in part]


@given(st.text(st.sampled_from("aB. ,\n\tÉ'9-!ß\x1c\xa0"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(encoders, text):
    for e in encoders.values():
        assert e.encode_batch([text])[0] == whole(e, text)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.sampled_from([50.0, 90.0, 100.0]))
@settings(max_examples=100, deadline=None)
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    index, data = pfor.encode_blocks(ids, percentile)
    assert (pfor.decode_blocks(index, data, len(ids)) == ids).all()
    if len(index) > 1:  # a block alone, by its start
        assert (pfor.decode_blocks(index[1:2], data, 128) [: len(ids) - 128] == ids[128:256]).all()


def test_exceptions_keep_blocks_narrow():
    ids = np.arange(128, dtype=np.uint32) % 16
    ids[5] = 4_000_000_000
    index, data = pfor.encode_blocks(ids)
    assert index["width"][0] == 4 and index["over"][0] == 1 and len(data) == 16 * 4 + 5


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, part int, payload string")


def test_shards_against_brute_force(spark, encoders):
    rows = [(i * 7 % 31, t, 1, "x") for i, t in enumerate(ODD)] + [(None, "null id", 1, "x"), (3, "same id", 1, "x"), (3, "same id", 1, "x")]
    got = pfor.token_index(frame(spark, rows)).orderBy("start").collect()
    e, start, want = encoders["word_bpe_49k.json"], 0, []
    for d, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = whole(e, t) + array("I", [2]).tobytes()
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert [tuple(r) for r in got] == want
    assert pfor.token_index(frame(spark, [])).count() == 0


def test_many_segments(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = pfor.read_shards(pfor.write_shards(docs, vocabulary("word_bpe_49k.json"), 2, segment_ids=500))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, pfor.token_index(docs).collect()))


# ---- packing


def test_pieces_and_places(spark, encoders, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (5, "again"), (5, "again"), (None, "n")], "doc_id bigint, text string"))
    got = packing.pack_documents(docs).collect()
    e, want = encoders["byte_bpe_50k.json"], []
    for d, t in docs.collect():
        ids = whole(e, t) + array("I", [2]).tobytes()
        n, at, k = len(ids) // 4, 0, 0
        for size in ([n % 1024] if n % 1024 else []) + [1024] * (n // 1024):
            want.append((d, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
            at, k = at + size, k + 1
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    hist = np.bincount([r["length"] for r in got], minlength=1025)
    assert packing.lower_bound(hist, 1024) <= len(by) <= packing.lower_bound(hist, 1024) * 1.02 + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_repacking_over_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 1025, 3000))]
    pieces = spark.createDataFrame(rows, packing.PIECE).cache()
    many = packing.pack(pieces, per_part=100).select("sequence_id").distinct().count()
    bound = packing.lower_bound(np.bincount([r[3] for r in rows], minlength=1025), 1024)
    once = sum(len(packing.best_fit_decreasing(np.sort([r[3] for r in rows[k::30]])[::-1], 1024)[2]) for k in range(30))
    assert bound <= many < once
    assert packing.pack(pieces, per_part=100).count() == 3000


@given(st.lists(st.integers(1, 12), max_size=9))
@settings(max_examples=100, deadline=None)
def test_bound_is_below_the_optimum(sizes):
    def best(rest, rooms):
        if not rest:
            return len(rooms)
        options = [best(rest[1:], [*rooms, 12 - rest[0]])]
        for i in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
            options.append(best(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1 :]]))
        return min(options)

    optimum = best(sorted(sizes, reverse=True), [])
    assert packing.lower_bound(np.bincount(sizes, minlength=13) if sizes else np.zeros(13, int), 12) <= optimum
    bins, offset, fill = packing.best_fit_decreasing(np.sort(np.array(sizes, int))[::-1], 12)
    assert len(fill) >= optimum and (len(fill) == 0 or fill.max() <= 12)


def test_letters_before_commas_and_stops():
    import unicodedata
    from array import array

    from tracklens.llm.tokens import Encoder, vocabulary

    letters = [c for c in map(chr, range(0xC0, 0x2000)) if unicodedata.category(c) != "Cn"]
    texts = [f"a{c}{s}b {c}{s} x{s}{c} {c}{s}{c}" for c in letters for s in ".,"]
    for name, drops_space in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        coder = Encoder(vocabulary(name), drops_space)
        want = [array("I", e.ids).tobytes() for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert coder.encode_batch(texts) == want
