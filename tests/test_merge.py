"""Shared blocks and the fold of a recording's rows against their plain forms."""

import random
import time
from difflib import SequenceMatcher

from tracklens.operators import merge


def plain_without_shared(old, new, least):
    gone = [False] * len(new)
    for m in SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks():
        if m.size >= least:
            gone[m.b : m.b + m.size] = [True] * m.size
    return "".join(c for c, g in zip(new, gone) if not g)


def test_shared_blocks_are_those_of_difflib():
    some = random.Random(2)
    for n in range(3000):
        parts = ["".join(some.choices("ab" if n % 2 else "abcdefgh", k=some.randint(0, 14))) for _ in range(5)]
        old, new = ("".join(some.choices(parts, k=some.randint(0, 7))) for _ in range(2))
        for least in (1, 2, 5, 8, 10):
            assert merge.without_shared(old, new, least) == plain_without_shared(old, new, least)

    assert merge.without_shared("a" * 1500 + "b", "a" * 1200, 8) == plain_without_shared("a" * 1500 + "b", "a" * 1200, 8)
    assert merge.without_shared("x\ud800𝒳" * 5, "𝒳" + "x\ud800𝒳" * 4, 8) == plain_without_shared("x\ud800𝒳" * 5, "𝒳" + "x\ud800𝒳" * 4, 8)


def test_texts_without_shared_blocks_are_quick():
    some = random.Random(6)
    texts = ["".join(some.choices("etaoin shrdlu", k=2000)) for _ in range(21)]
    began = time.process_time()
    assert all(merge.without_shared(a, b, 10) == b for a, b in zip(texts, texts[1:]))
    quick = time.process_time() - began
    began = time.process_time()
    plain_without_shared(texts[0], texts[1], 10)
    assert quick < 10 * (time.process_time() - began)  # twenty of them cost less than ten of difflib's, by far


def plain_patched(rows, patches, pad=500):
    for p in patches:
        have = sum(len(r["text"]) for r in rows if r["start"] < p["b"] and r["end"] > p["a"])
        if 2 * sum(len(r["text"]) for r in p["rows"]) > 3 * have + 20:
            rows = [r for r in rows if r["start"] < p["a"] - pad or r["end"] > p["b"] + pad] + p["rows"]
    return rows


def test_many_patches_of_a_long_recording():
    some = random.Random(8)
    row = lambda a, n, size: {"start": a, "end": a + n, "text": "x" * size}
    rows = [row(2000 * k, some.randint(0, 2500), some.randint(3, 40)) for k in range(6000)]
    patches = []
    for k in range(0, 6000, 3):
        a = 2000 * k + some.randint(-600, 600)
        b = a + some.randint(0, 6000)
        patches.append({"a": a, "b": b, "rows": [row(some.randint(a, b), 900, some.randint(0, 90)) for _ in range(some.randint(0, 3))]})
    began = time.process_time()
    got = merge.patched(rows, patches)
    quick = time.process_time() - began
    began = time.process_time()
    assert got == plain_patched(rows, patches) and got != rows
    assert quick < 0.5 * (time.process_time() - began)
    assert merge.patched([], []) == [] and merge.patched([], patches) == plain_patched([], patches)
