"""Token ids of texts with public tokenizer files, the same ids as the library gives for whole texts."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from .rows import worker_store
from .wordtable import WordTable, by_text, joined

# The classes of the split pattern of the byte-level tokenizers, for the characters
# U+0009, U+000A, U+000D, U+0020-U+007E and U+00A1-U+017F, on which all Unicode versions agree.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
BREAKS = "\t\n\r"
SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")  # one word with the apostrophe before them

UNUSUAL, LETTER, NUMBER, SIGN, BLANK, BREAK, END = range(7)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and of the characters of two bytes C2 to C5, by 64 times lead plus rest."""

    def kind(char: str) -> int:
        if char == " ":
            return BLANK
        if char in BREAKS:
            return BREAK
        if re.match(f"[{LETTERS}]", char):
            return LETTER
        if re.match(f"[{NUMBERS}]", char):
            return NUMBER
        return SIGN if re.match(r"[!-~\u00a1-\u017f]", char) else UNUSUAL

    one = np.array([kind(chr(b)) if b < 0x80 else UNUSUAL for b in range(256)], dtype=np.uint8)
    one[0] = END
    return one, np.array([kind(chr(n)) for n in range(0x80, 0x180)], dtype=np.uint8)


_ONE, _TWO = _classes()


def classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; both bytes of a character have the class of the character. A zero byte ends a text."""
    kinds = _ONE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    if len(lead):
        kinds[lead] = _TWO[(data[lead].astype(np.int64) - 0xC2) * 64 + (data[lead + 1] & 0x3F)]
        kinds[lead + 1] = kinds[lead]
    return kinds


def word_starts(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the words of the split pattern begin, as flags; a zero byte is a word of its own.

    A run of one class is a word, with a blank before it if there is one. Of several blanks and breaks before
    another character all but the last are a word. After an apostrophe that begins a word, a suffix ends it.
    """
    blank = (kinds == BLANK) | (kinds == BREAK)
    other = (kinds >= LETTER) & (kinds <= SIGN)
    start = np.ones(len(kinds), dtype=bool)
    start[1:] = other[1:] & (kinds[1:] != kinds[:-1]) & (kinds[:-1] != BLANK)
    start[1:] |= blank[1:] & ~blank[:-1] | (kinds[1:] == END)
    start[1:-1] |= blank[1:-1] & other[2:]
    quotes = np.flatnonzero(start & (data == ord("'")))
    if len(quotes):
        for suffix in SUFFIXES:
            at = quotes[quotes + len(suffix) < len(data)]
            for k, letter in enumerate(suffix.encode(), 1):
                at = at[data[at + k] == letter]
            start[at + 1] = False
            start[np.minimum(at + 1 + len(suffix), len(data) - 1)] = True
    return start


class JsonEncoder:
    """Ids by a file of the ``tokenizers`` library.

    A byte-level tokenizer cuts a text into words and merges within each word alone. So each
    word is encoded by the library once and kept in a table (:mod:`wordtable`), and
    a text is the concatenation of its words. Texts with characters outside
    the plain classes above or with an added token, and all texts of other kinds of tokenizer,
    go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        cut = parts["pre_tokenizer"] or {}
        self.by_word = cut.get("type") == "ByteLevel" and cut.get("use_regex") is True and not cut.get("add_prefix_space")
        self.by_word = self.by_word and parts["normalizer"] is None and parts["post_processor"] is None and parts["model"].get("dropout") is None
        self.added = [t["content"].encode() for t in parts["added_tokens"]]
        self.blank_in_added = any(re.search(r"\s", t["content"]) for t in parts["added_tokens"])
        self.words = WordTable(self._words)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._library([w.decode() for w in words])
        counts = np.array([len(ids) for ids in found], dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list = [None] * len(texts)
        raw = [t.encode() for t in texts]
        plain = [i for i, t in enumerate(raw) if self.by_word and b"\0" not in t and not any(a in t for a in self.added)]
        data, bounds = joined([raw[i] for i in plain])
        kinds = classes(data)
        odd = np.flatnonzero(kinds[: bounds[-1]] == UNUSUAL)
        if len(odd):
            bad = set(np.searchsorted(bounds, np.unique(odd), side="right") - 1)
            plain = [i for n, i in enumerate(plain) if n not in bad]
            data, bounds = joined([raw[i] for i in plain])
            kinds = classes(data)
        if plain:
            size = int(bounds[-1])
            starts = np.flatnonzero(word_starts(data[:size], kinds[:size]))
            sizes = np.diff(starts, append=size)
            real = kinds[starts] != END
            starts, sizes = starts[real], sizes[real]
            ids, counts = self.words.ids(data, starts, sizes)
            for i, found in zip(plain, by_text(ids, counts, starts, bounds)):
                out[i] = found
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = np.array(ids, dtype="<u4").tobytes()
        return out

    def with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and end character of each token."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        bounds = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        return np.array(found.ids, dtype=np.int64), bounds[:, 0], bounds[:, 1]


class PieceEncoder:
    """Ids by a model file of the ``sentencepiece`` library."""

    blank_in_added = False

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pieces = self.model.encode(text, return_type="proto").pieces
        table = np.array([(p.id, p.begin, p.end) for p in pieces], dtype=np.int64).reshape(-1, 3)
        # Offsets count bytes; the character of a byte is the number of characters begun before it.
        begun = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(begun)])
        return table[:, 0], at[table[:, 1]], at[table[:, 2]]


def encoder(path: str):
    """The worker's encoder of a file: ``.json`` by tokenizers, ``.model`` by sentencepiece."""
    store = worker_store("encoders")
    if path not in store:
        store[path] = PieceEncoder(path) if path.endswith(".model") else JsonEncoder(path)
    return store[path]
