"""Token ids of whole columns with a public tokenizer file.

The tokenizer works on runs of characters that never reach across white space,
so a text is cut at ASCII white space and each different piece is encoded once
per worker. The pieces' ids are joined by numpy for a whole batch of texts.
"""

from __future__ import annotations

import json
from array import array
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from itertools import count, islice

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Pieces kept by a worker; beyond it, the ``KEPT_PIECES`` that were met most often stay.
CACHE_PIECES = 500_000
KEPT_PIECES = 200_000
#: Words of pieces kept by a worker; beyond it, all are forgotten at once.
CACHE_WORDS = 150_000

#: Pieces of these printable Latin characters have stable classes and no combining
#: marks, so they are split here; all others by the tokenizer's own steps.
_PLAIN = "\x21-\x7e\u00a1-\u012f\u0131-\u024f"
#: Stands behind the ids of a piece; no id of a vocabulary.
_END = np.uint32(0xFFFFFFFF)


def _packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """An array with at least so many places, grown by half at least."""
    if size <= len(held):
        return held
    return np.concatenate([held, np.zeros(max(size - len(held), len(held) >> 1), held.dtype)])


class WordEncoder:
    """Encodes by ``Tokenizer.encode(text, add_special_tokens=False)``, piece by piece.

    Only for tokenizers whose normaliser turns white space into spaces and whose
    words end at white space (word-end BPE without a space marker).
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self._model = self.tokenizer.model
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        # Words of many pieces with line ends between them.
        self._split = regex.compile(f"{steps[0]['pattern']['Regex']}|\n")
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._spelling = {ord(c): spell(c)[0][0] for c in map(chr, range(0x21, 0x250)) if regex.fullmatch(f"[{_PLAIN}]", c)}
        self._special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # From the first thing in a piece that is not plain to the piece's end.
        self._odd = regex.compile("(?:%s)[^\n]*" % "|".join([f"[^{_PLAIN}\n]", *(regex.escape(s.decode()) for s in self._special)]))
        self._number: dict[bytes, int] = defaultdict(count().__next__)
        self._words: dict[str, bytes] = {}
        self._ids = np.zeros(1 << 18, np.uint32)
        self._ends = np.zeros(1 << 16, np.int64)
        self._met = np.zeros(1 << 16, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that were met most often, numbered anew, and count from the start."""
        known = len(self._number)
        order = np.argsort(-self._met[:known], kind="stable")[:KEPT_PIECES]
        stays = np.zeros(known, bool)
        stays[order] = True
        lengths = np.diff(self._ends[: known + 1])
        ids = self._ids[: self._ends[known]][np.repeat(stays, lengths)]
        # A dictionary is in the order in which it was filled, which is that of the numbers.
        pieces = [p for p, stay in zip(self._number, stays.tolist()) if stay]
        self._number = defaultdict(count(len(pieces)).__next__, zip(pieces, range(len(pieces))))
        self._words = {}
        self._ids = np.concatenate([ids, np.zeros(1 << 18, np.uint32)])
        self._ends = np.zeros(len(pieces) + (1 << 16), np.int64)
        np.cumsum(lengths[stays], out=self._ends[1 : len(pieces) + 1])
        self._met = np.zeros(len(self._ends), np.int64)

    def _encoded(self, piece: bytes) -> bytes:
        """Ids of an odd piece: with added tokens by the whole tokenizer, else by its own steps."""
        text = piece.decode()
        if any(s in piece for s in self._special):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        text = self.tokenizer.normalizer.normalize_str(text)
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return b"".join(_packed(t.id for t in self._model.tokenize(word)) for word, _ in words)

    def _learn_words(self, words: list[str]) -> None:
        """The model's ids of words, each different one once."""
        spelled = " ".join(words).translate(self._spelling).split(" ") if words else ()
        for word, found in zip(words, map(self._model.tokenize, spelled)):
            self._words[word] = _packed([t.id for t in found])

    def _learn(self, pieces: list[bytes]) -> None:
        """The ids of new, different pieces, which have the next numbers."""
        text = b"\n".join(pieces).decode()
        odd: dict[int, bytes] = {}
        found = [m.start() for m in self._odd.finditer(text)]
        if found:
            texts = text.split("\n")
            ends = np.cumsum([len(t) + 1 for t in texts])
            for i in np.searchsorted(ends, found, "right").tolist():
                odd[i] = self._encoded(pieces[i])
                texts[i] = ""
            text = "\n".join(texts)
        if len(self._words) > CACHE_WORDS:
            self._words = {}
        self._words["\n"] = _END.tobytes()
        # In lower case, which the normaliser would make as well.
        words = self._split.findall(text.lower())
        self._learn_words([w for w in dict.fromkeys(words) if w not in self._words])
        ids = np.frombuffer(b"".join(map(self._words.__getitem__, words)) + _END.tobytes(), np.uint32)
        ends = np.flatnonzero(ids == _END)
        sizes = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != _END]
        if odd:
            at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            ids = np.concatenate([np.frombuffer(odd[i], np.uint32) if i in odd else ids[at[i] : at[i + 1]] for i in range(len(pieces))])
            for i, own in odd.items():
                sizes[i] = len(own) >> 2
        known = len(self._number) - len(pieces)
        start = int(self._ends[known])
        self._ids = _room(self._ids, start + len(ids))
        self._ids[start : start + len(ids)] = ids
        self._ends, self._met = _room(self._ends, known + len(pieces) + 1), _room(self._met, known + len(pieces))
        self._ends[known + 1 : known + len(pieces) + 1] = start + np.cumsum(sizes)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each UTF-8 text."""
        if len(self._number) > CACHE_PIECES:
            self._forget()
        pieces: list[bytes] = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            # A-Z first: fewer different pieces; added tokens must keep their case.
            found = (text if b"<|" in text else text.lower()).split()
            counts[i] = len(found)
            pieces += found
        # A piece that is not known gets the next number.
        known = len(self._number)
        numbers = np.fromiter(map(self._number.__getitem__, pieces), np.int64, len(pieces))
        if len(self._number) > known:
            self._learn(list(islice(self._number, known, None)))
        self._met[: len(self._number)] += np.bincount(numbers, minlength=len(self._number))
        starts = self._ends[numbers]
        lengths = self._ends[numbers + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self._ids[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    return WordEncoder(path)
