"""Whole-text tokenisation with a piece cache in front of a public BPE vocabulary.

Most words of a corpus repeat.  A text is cut where the vocabulary's own pre-tokeniser is certain
to cut, each new piece is encoded once by the ``tokenizers`` library, and the ids of known pieces
come from a dictionary.  The ids equal those of encoding the whole text (tested).
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import kept

#: A white-space character before a space: then a space need not begin a token.
_CROWDED = re.compile(r"\s ")
#: A space after a character that is no white space (Python's set holds all that the library knows).
_CUT = re.compile(r"(?<=[^\s]) ")
#: A comma or stop after anything but a Latin letter, a digit or plain white space: it may be part of a run of signs.
_RUN = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-įı-ɏ \n][.,]")  # İ's lower case ends in a mark
#: The same, where white space counts.
_APART = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-įı-ɏ][.,]")
#: Letters whose lower case or normal form might depend on more than themselves.
_BEYOND = re.compile(r"[^\x00-įı-ɏ]")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``drops_space``: the vocabulary ignores white space and case (else words carry the space before
    them).  ``capacity``: about how many bytes each of two generations of the cache holds; pieces of
    more than ``LONG`` characters are not kept.  Both change speed only.
    """

    LONG = 64

    def __init__(self, path: str, drops_space: bool, capacity: int = 80 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space, self.capacity = drops_space, capacity
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        # by id: whether the token ends a word (where white space is dropped) or begins one after a space
        mark = (lambda w: w.endswith("</w>")) if drops_space else (lambda w: w.startswith("Ġ"))
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for w, i in vocab.items() if mark(w)]] = True

    def pieces(self, text: str) -> list[str]:
        """A cut of the text at places where a pre-token is sure to begin."""
        if self.drops_space:
            if text.isascii() or not _BEYOND.search(text):
                text = text.lower()
            if not _RUN.search(text):
                text = text.replace(",", " ,").replace(".", " .")
            return text.replace("\n", " ").split(" ")
        if "\0" in text:
            first, *rest = _CUT.split(text)
            return [first, *(" " + w for w in rest)]
        text = _CUT.sub("\0 ", text) if _CROWDED.search(text) else text.replace(" ", "\0 ")
        if not _APART.search(text):
            text = text.replace(",", "\0,").replace(".", "\0.")
        return text.split("\0")

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces not seen yet."""
        if old := self.old:
            again = pieces & old.keys()
            self.known.update(zip(again, map(old.__getitem__, again)))
            pieces = pieces - again
        if self.drops_space:
            words = [w for w in pieces if w.isalpha() and w.isascii()]
        else:
            words = [w for w in pieces if w[:1] == " " and w[1:].isalpha() and w.isascii()]
        self._encode_each(list(pieces.difference(words)))
        self._encode_words(words)

    def _encode_words(self, words: list[str], at_once: int = 400) -> None:
        """Encode words of ASCII letters many at a time; each is one pre-token, so its edge shows in the ids."""
        lots = [words[lo : lo + at_once] for lo in range(0, len(words), at_once)]
        glue = " " if self.drops_space else ""
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([glue.join(x) for x in lots], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(lot):
                self._encode_each(lot)
                continue
            at = [0, *(at + 1).tolist()] if self.drops_space else [*at.tolist(), len(ids)]
            raw = ids.tobytes()
            self.known.update(zip(lot, [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])]))

    def _encode_each(self, pieces: list[str], at_once: int = 20_000) -> None:
        for lo in range(0, len(pieces), at_once):
            part = pieces[lo : lo + at_once]
            got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, (array("I", e.ids).tobytes() for e in got)))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text; a null text is empty."""
        if self.held > self.capacity:
            self.old, self.known, self.held = self.known, {}, 0
        known = self.known
        cut = [self.pieces(t) if t else [] for t in texts]
        if new := set().union(*cut).difference(known):
            self._learn(new)
        get = known.__getitem__
        out = [b"".join(map(get, p)) for p in cut]
        for p in new:
            if len(p) > self.LONG:
                del known[p]
            else:
                self.held += 190 + 2 * len(p)  # two objects, their place in the dictionary, and what they hold
        return out


def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder for all tasks of a Python worker, so its cache stays warm."""
    return kept(("encoder", path, drops_space), lambda: Encoder(path, drops_space))


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
