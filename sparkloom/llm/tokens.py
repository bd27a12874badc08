"""Token ids of whole texts with a public tokenizer, in Arrow batches."""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np

from . import memo

#: How many words a worker remembers in each of two generations; a bound on memory, not on texts.
REMEMBERED = 700_000
SEPARATOR, SEPARATOR_ID, WORD_END = "<|endoftext|>", 49407, "</w>"
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


class Words:
    """Encodes texts with a word-level BPE whose pre-tokenizer never joins what a space separates.

    Words between spaces are encoded once and remembered; when a generation is full it becomes the old one, from which
    words that are met again move on.  New words of letters go through the tokenizer in one text and are told apart by
    the mark on their last token.  A stop or comma behind letters is a token of its own.  Other new words are set apart
    by a special token that none of them holds; texts with special tokens in them are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.marks = {c: self._whole(c) for c in ".,"}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                self._apart(part)
                continue
            raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update(zip(part, [raw[a:b] for a, b in zip(bounds, bounds[1:])]))

    def _apart(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(SEPARATOR.join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == SEPARATOR_ID), len(ids))
            starts = np.append(0, ends[:-1] + 1)
            raw = ids.tobytes()
            self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, starts.tolist(), ends.tolist()))

    def _learn(self, new: set[str]) -> None:
        letters = set(filter(str.isalpha, new))
        marked, rest = [], []
        for w in new - letters:
            if w[-1:] in self.marks and w[:-1].isalpha():
                marked.append(w)
            else:
                rest.append(w)
        letters.update({w[:-1] for w in marked}.difference(self.known))
        self._letters(list(letters))
        self._apart(rest)
        known, marks = self.known, self.marks
        known.update([(w, known[w[:-1]] + marks[w[-1]]) for w in marked])

    def _know(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.old, self.known, new = self.known, {}, words
        fresh = new.difference(self.old)
        again = new - fresh
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        self._learn(fresh)

    def rest(self) -> None:
        """At the end of a task: an idle worker keeps one generation only."""
        self.old = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for at in range(0, len(texts), 512):
            some = texts[at : at + 512]
            whole = {i: self._whole(t) for i, t in enumerate(some) if "<|" in t and _SPECIAL.search(t)}
            split = [[] if i in whole else _fold(t).replace("\n", " ").split(" ") for i, t in enumerate(some)]
            self._know(set(chain.from_iterable(split)))
            ids = self.known.__getitem__
            out += [whole[i] if i in whole else b"".join(map(ids, ws)) for i, ws in enumerate(split)]
        return out


def _fold(text: str) -> str:
    """Lower case where that surely equals the tokenizer's own; it only makes more words alike."""
    return text.lower() if text.isascii() or ("Σ" not in text and unicodedata.is_normalized("NFC", text)) else text


_MADE: dict[str, Words] = {}


def encoder(path: str) -> Words:
    """One encoder for each worker and file."""
    memo.use("tokens")
    if path not in _MADE:
        _MADE[path] = Words(path)
    return _MADE[path]


def _forget() -> None:
    for words in _MADE.values():
        words.known, words.old = {}, {}


memo.register("tokens", _forget)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
