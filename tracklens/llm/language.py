"""Language identification of whole, possibly mixed texts.

Fit: up to about ``per_lang`` documents of each language (a sample by a hash of the id, bounded by
that parameter) give counts of letter 1- to 4-grams within words and the scripts of each language.
Predict: a word's script narrows the languages to those that use it; each gets the word's
log-likelihood by a back-off n-gram model, less the best one's and floored; Viterbi with a penalty
for switching labels every word; runs of a label are spans.  The document's language has most
letters; the score is that share times the odds of it against the
runner-up over its own spans, and falls to 0 where the language holds few of the letters it got: it
holds a word in a script it uses whose log-likelihood a letter is above the mean of that of its own
words and that of its letters at random.

Text of scripts that are written without blanks is cut into windows of ``WINDOW`` letters, which stand for
words, in learning and labelling alike.  A word of several scripts narrows the languages to those that use
them all.  More than MOST_LANGUAGES languages are an error: the model holds a number for each language and gram.

Null text, or text without letters, is ``und`` with score 0 and no spans; so is every text if
there is nothing to learn from.  Words in a script that no language has may be of any language, and none holds them.
Equal letter counts go to the smaller code.  Only ``doc_id``, ``text`` and (to learn) ``lang`` are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches

# First and last code points of scripts' letters.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]

ORDER = 4
MOST_LANGUAGES = 10_000
BACK_OFF = np.log(0.4)
LETTERS = re.compile(r"[^\W\d_]+")
WINDOW = 6
# Letters of scripts written without blanks between words (kana and Han; Thai, Lao, Burmese, Khmer).
EAST, SOUTH = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff", "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
SPACED = re.compile(r"\S+")
DENSE = re.compile(f"[{EAST}{SOUTH}]")
WORD = re.compile(rf"[{EAST}]{{1,{WINDOW}}}|[{SOUTH}]{{1,{WINDOW}}}|[^\s{EAST}{SOUTH}]+")
#: Multipliers of the letters of a gram, from its last, and of its length, which make its key.
PARTS = np.random.default_rng(20240707).integers(0, 1 << 63, ORDER, np.uint64) * np.uint64(2) + np.uint64(1)
LENGTH = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words between blanks, windows of letters where a script has no blanks."""
    return text.split() if text.isascii() or not DENSE.search(text) else WORD.findall(text)


def script(ch: str) -> str:
    c = ord(ch)
    return next((n for n, a, b in SCRIPTS if a <= c <= b), "other")


def scripts_of(run: str) -> tuple[str, ...]:
    """The scripts of a run of letters."""
    return ("latin",) if run.isascii() else tuple(sorted({script(c) for c in run}))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """N-gram scores of each language; small (bounded by the sample), so tasks get it whole."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        """counts: of (language, gram) with grams of 1 to ORDER letters in words between blanks, and of scripts as "\\tname"."""
        self.langs = sorted({lang for lang, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        n_langs = len(self.langs)
        use = Counter()
        by: dict[str, np.ndarray] = {}
        for (lang, g), n in counts.items():
            if g[0] == "\t":
                use[lang, g[1:]] += n
            else:
                by.setdefault(g, np.zeros(n_langs))[at[lang]] += n
        self.scripts: dict[str, np.ndarray] = {}
        total = Counter()
        for (lang, s), n in use.items():
            total[lang] += n
        for (lang, s), n in use.items():
            if n >= 0.01 * total[lang]:
                self.scripts.setdefault(s, np.zeros(n_langs, bool))[at[lang]] = True
        ones = np.maximum(sum((v for g, v in by.items() if len(g) == 1), np.zeros(n_langs)), 1)
        self.none = np.log(0.1 / ones)
        self.score: dict[str, np.ndarray] = {}
        for g in sorted(by, key=len):
            v = by[g]
            if len(g) == 1:
                self.score[g] = np.where(v > 0, np.log(np.maximum(v, 1e-9) / ones), self.none)
            else:
                context = by.get(g[:-1], np.zeros(n_langs))
                self.score[g] = np.where((v > 0) & (context > 0), np.log(np.maximum(v, 1e-9) / np.maximum(context, 1)), self.score.get(g[1:], self.none) + BACK_OFF)
        self.least = self.calibrated(by, ones)

        # the grams as sorted keys, and their rows, for many words at once
        known = list(self.score)
        keys = np.array([self.key(g) for g in known], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rows = np.array([self.score[known[i]] for i in order]).reshape(len(known), n_langs)
        names = sorted(self.scripts)
        self.may = np.array([*(self.scripts[n] for n in names), np.ones(n_langs, bool)])
        self.script_row = {(n,): i for i, n in enumerate(names)}

    def calibrated(self, by: dict[str, np.ndarray], ones: np.ndarray) -> np.ndarray:
        """The log-likelihood a letter above which a language holds a word: half-way from its own words to its letters at random."""
        zero = np.zeros(len(self.langs))
        # the longest gram that ends at each place of the sample's words
        places = [g for g in by if len(g) == ORDER or 1 < len(g) and g[0] == " "]
        own = sum((by[g] * self.score[g] for g in places), zero) / np.maximum(sum((by[g] for g in places), zero), 1)
        chance = sum((v / ones * self.score[g] for g, v in by.items() if len(g) == 1), zero) + 2 * BACK_OFF
        return (own + chance) / 2

    def __getstate__(self) -> dict:
        """Tasks need the arrays only."""
        return self.__dict__ | {"score": {}}

    @staticmethod
    def key(gram: str) -> int:
        return (sum(ord(c) * int(m) for c, m in zip(reversed(gram), PARTS)) + len(gram) * int(LENGTH)) & (1 << 64) - 1

    def row_of(self, run: str) -> int:
        """The row of ``may`` with the languages that use all scripts of a run; -1 (any) if none does."""
        names = scripts_of(run)
        if names not in self.script_row:
            rows = [self.script_row.get((n,), -1) for n in names]
            both = np.logical_and.reduce(self.may[rows]) if -1 not in rows else np.zeros(len(self.langs), bool)
            self.script_row[names] = -1
            if both.any():
                self.script_row[names] = len(self.may) - 1
                self.may = np.concatenate([self.may[:-1], both[None], self.may[-1:]])
        return self.script_row[names]

    def labeller(self, penalty: float, floor: float) -> "Labeller":
        """One for all tasks of a Python worker, so its words stay known."""
        return kept(("labeller", id(self), penalty, floor), lambda: Labeller(self, penalty, floor))

    def of(self, runs: list[str]) -> np.ndarray:
        """Log-likelihoods of letter runs (a row each) in each language."""
        text = " " + " ".join(runs).lower()
        if text.count(" ") != len(runs):
            raise ValueError("a run of letters holds a blank")
        points = np.frombuffer((text + " ").encode("utf-32-le"), "<u4").astype(np.int64)
        blank = points == 32
        sign = points.astype(np.uint64)
        begin = np.maximum.accumulate(np.where(blank, np.arange(len(points)), 0))
        begin[1:] = np.where(blank[1:], begin[:-1], begin[1:])  # the blank after a word ends it
        at = np.arange(1, len(points))
        size = np.minimum(at - begin[1:] + 1, ORDER)
        keys = [np.zeros(len(at), np.uint64)]  # of grams of 0, 1, ... letters that end at each place
        for k in range(ORDER):
            keys.append(keys[-1] + sign[np.maximum(at - k, 0)] * PARTS[k])
        keys = np.stack(keys) + np.arange(ORDER + 1, dtype=np.uint64)[:, None] * LENGTH
        out = np.zeros((len(at), len(self.langs)))
        left = np.arange(len(at))
        for back in range(ORDER):
            n = size[left] - back
            out[left[n < 1]] = self.none + back * BACK_OFF
            left, n = left[n >= 1], n[n >= 1]
            if not len(left):
                break
            own = keys[n, left]
            place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            hit = self.keys[place] == own
            out[left[hit]] = self.rows[place[hit]] + back * BACK_OFF
            left = left[~hit]
        out[left] = self.none + ORDER * BACK_OFF
        first = np.flatnonzero(blank[:-1])
        return np.add.reduceat(out, first, axis=0)

    def words(self, tokens: list[str], floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's scores (0 for the best language, none below ``floor``), its letters, and how many of them each language holds."""
        found = [LETTERS.findall(t) for t in tokens]
        scores, letters = np.zeros((len(tokens), len(self.langs))), np.array([sum(len(r) if r.isalpha() else sum(map(str.isalpha, r)) for r in f) for f in found], np.int64)
        held = np.zeros((len(tokens), len(self.langs)), np.int64)
        number: dict[str, int] = {}
        for f in found:
            for r in f:
                number.setdefault(r, len(number))
        if number and self.langs:
            runs = list(number)
            s = self.of(runs)
            rows = [self.row_of(r) for r in runs]
            size = np.array([len(r) for r in runs])[:, None]
            known = np.array(rows)[:, None] >= 0
            holds = np.where(known & self.may[rows] & (s >= self.least * (size + 1)), size, 0)  # the blank after a word counts
            s = np.where(self.may[rows], s, s.max(axis=1, keepdims=True) + floor)
            of, which = np.repeat(np.arange(len(tokens)), [len(f) for f in found]), [number[r] for f in found for r in f]
            np.add.at(scores, of, s[which])
            np.add.at(held, of, holds[which])
            scores = np.maximum(scores - scores.max(axis=1, keepdims=True), floor)
        return scores, letters, held


def grams(texts_by_lang) -> Counter:
    """Counts for Model of (language, text) pairs."""
    out: Counter = Counter()
    words: Counter = Counter()
    for lang, text in texts_by_lang:
        words.update((lang, w) for t in words_of(text) for w in LETTERS.findall(t))
    for (lang, w), n in words.items():
        for c in w if not w.isascii() else ():
            out[lang, "\t" + script(c)] += n
        if w.isascii():
            out[lang, "\tlatin"] += n * len(w)
        w = f" {w.lower()} "
        for i in range(len(w)):
            for k in range(1, ORDER + 1):
                if i + k <= len(w):
                    out[lang, w[i : i + k]] += n
    return out


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row of ``s`` if each change of label costs ``penalty``."""
    n, k = s.shape
    best = int(s.sum(axis=0).argmax())
    if k == 1:
        return np.zeros(n, np.int64)
    other = s.copy()
    other[:, best] = -np.inf
    gain = np.cumsum(other.max(axis=1) - s[:, best])
    low = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
    if (gain - low).max() <= penalty:  # no run of words, even each in its best other language, pays for a switch
        return np.full(n, best)
    came, score = np.empty((n, k), np.int64), s[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        top = int(score.argmax())
        change = score < score[top] - penalty
        came[t] = np.where(change, top, stay)
        score = np.where(change, score[top] - penalty, score) + s[t]
    out = np.empty(n, np.int64)
    out[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = came[t, out[t]]
    return out


def trust(held: float) -> float:
    """What a score counts if a language holds this share of the letters given to it: all from a half on, nothing up to a quarter."""
    return min(1.0, max(0.0, 4 * held - 1))


class Labeller:
    """Labels texts; keeps the scores of words of up to LONG letters it has met, about ``capacity`` bytes of them, which changes speed only."""

    LONG = 64

    def __init__(self, model: Model, penalty: float, floor: float, capacity: int = 48 << 20):
        self.model, self.penalty, self.floor, self.capacity = model, penalty, floor, capacity // (150 + 8 * len(model.langs))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.n = 0
        self.scores, self.letters = np.zeros((1024, len(self.model.langs)), np.float32), np.zeros(1024, np.int64)
        self.held = np.zeros((1024, len(self.model.langs)), np.int32)

    def learn(self, words: list[str]) -> None:
        n = self.n
        while n + len(words) > len(self.scores):
            self.scores, self.letters, self.held = (np.concatenate([a, np.zeros_like(a)]) for a in (self.scores, self.letters, self.held))
        self.scores[n : n + len(words)], self.letters[n : n + len(words)], self.held[n : n + len(words)] = self.model.words(words, self.floor)
        self.known.update(zip(words, range(n, n + len(words))))
        self.n += len(words)

    @staticmethod
    def plain(text: str) -> str:
        """The text in lower case, commas and stops as blanks, if that keeps all places."""
        low = text.lower()
        return (low if len(low) == len(text) else text).replace(",", " ").replace(".", " ")

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Of each text: language, score, spans (start, end, language) in code points."""
        if self.n > self.capacity:
            self.clear()
        plain = [self.plain(t) if t else "" for t in texts]
        split = [words_of(t) for t in plain]
        new = list(set().union(*split).difference(self.known))
        self.learn(new)
        get, langs, out = self.known.__getitem__, self.model.langs, []
        for text, words in zip(plain, split):
            at = np.fromiter(map(get, words), np.int64, len(words))
            letters = self.letters[at]
            if not langs or not letters.any():
                out.append(("und", 0.0, []))
                continue
            s = self.scores[at].astype(np.float64)
            path = viterbi(s, self.penalty)
            share = np.bincount(path, letters, len(langs))
            best = int(share.argmax())
            total = s[path == best].sum(axis=0)  # over its own spans: what others say of theirs is no doubt about it
            margin = total[best] - np.delete(total, best).max() if len(langs) > 1 else 50.0
            score = share[best] / share.sum() / (1 + np.exp(-np.clip(margin, -50, 50)))
            score *= trust(self.held[at[path == best], best].sum() / share[best])
            change = np.flatnonzero(np.diff(path)) + 1
            if not len(change):
                spans = [(0, len(text), langs[best])]
            else:
                begins = [m.start() for m in (WORD if DENSE.search(text) else SPACED).finditer(text)]
                edges = [0, *(begins[c] for c in change.tolist()), len(text)]
                spans = [(a, b, langs[path[c]]) for a, b, c in zip(edges, edges[1:], [0, *change.tolist()])]
            out.append((langs[best], float(score), spans))
        for w in new:
            if len(w) > self.LONG:
                del self.known[w]
        return out


def fit(docs: DataFrame, per_lang: int = 2000, least: int = 2) -> Model:
    """Learn from documents that are not held out and have a language: about ``per_lang`` of each, grams (but single letters) of ``least`` occurrences."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    labels = usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(labels) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not labels:
        return Model({})
    upto = F.create_map(*(F.lit(x) for r in labels for x in (r["lang"], min(1.0, per_lang / r["count"]))))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40) < upto[F.col("lang")]).select("lang", "text")

    def count(batches):
        n: Counter = Counter()
        for b in batches:
            n.update(grams(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        items = list(n.items())
        for lo in range(0, len(items), 50_000):
            part = items[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part]), pa.array([k[1] for k, _ in part]), pa.array([v for _, v in part], pa.int64())], ["lang", "gram", "n"])

    found = sample.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(f"n >= {int(least)} or length(gram) = 1")
    return Model({(r[0], r[1]): r[2] for r in found.collect()})  # bounded by the sample


LABELLED = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, floor: float = -6.0) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and spans (they replace columns of those names)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "spans")
    held = docs.sparkSession.sparkContext.broadcast(model)
    ours = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def label(batches):
        labeller = held.value.labeller(penalty, floor)
        for b in batches:
            got = labeller.label(b.column(b.schema.get_field_index("text")).to_pylist())
            spans = pa.array([[{"start": a, "end": e, "lang": lang} for a, e, lang in x[2]] for x in got], pa.list_(ours))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), spans], [*b.schema.names, "lang_pred", "score", "spans"])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*docs.schema.fields, *_parse_datatype_string(LABELLED).fields])
    return docs.mapInArrow(label, schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every document."""
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
