"""Token ids exactly as the tokenizers library gives them, with each distinct piece encoded once.

A byte-level BPE treats every pre-token on its own, so a text's ids are those of
its pre-tokens in a row. ``Encoder`` splits a text by the vocabulary's own
pre-token pattern and looks each piece up; a piece not met before is encoded by
the library. Characters on whose class two Unicode tables could differ (all but
ASCII and the letters of Latin-1) are never split here: the library gets the
whole white-space delimited stretch or text around them, and every text that holds an added token
(``<|endoftext|>``), which it treats as it does by default.

Lower-cased texts are cut and looked up as arrays: pieces are told apart by 64-bit
hashes, within a batch and in what an encoder remembers.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import repeat

import numpy as np

from rosterfold.llm.words import joined, prefix_hashes, span_hashes

#: Letters beyond ASCII that NFC, lower-casing and every Unicode table treat alike.
_MORE = "À-ÖØ-öø-ÿ"
_LETTER = f"A-Za-z{_MORE}"
_SPACE = "\t-\r "

#: The contractions of both vocabularies' patterns.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"

_SAFE = re.compile(f"[\\x00-\\x1b\\x20-\\x7f{_MORE}]*")
_SPACED = re.compile(
    f"{_SHORT}| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

#: Pieces an encoder remembers; later ones are encoded each time they are met.
MEMORY = 400_000

#: The same for lower-cased pieces, which are remembered by hash.
ROWS = 700_000

_ENCODERS: dict = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for this file; its memory lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """``ids(text)`` gives little-endian unsigned 32-bit ids as bytes.

    The file's pattern decides the split: with white space kept in front of a
    word (``spaced``), or lower-cased with white space dropped. Any other
    normaliser or pattern sends whole texts to the library.
    """

    def __init__(self, path: str) -> None:
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        self.kind = _kind(about)
        added = [t["content"] for t in about["added_tokens"]]
        # lower-cased added tokens: texts that may hold one go to the library whole
        pattern = "|".join(re.escape(t.lower()) for t in added) or "(?!)"
        self.added, self.added_bytes = re.compile(pattern), re.compile(pattern.encode())
        #: Characters behind a place that can decide whether something ends there.
        self.reach = max([len(_SHORT.split("|")[-1]), *map(len, added)])
        self.known: dict[str, bytes] = {}
        # of lower-cased pieces: the row of each hash, and of each row the number of its ids among all ids
        self.rows: dict[int, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [
            array("I", e.ids).tobytes()
            for e in self.library.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            new = list({p for p, f in zip(pieces, found, strict=True) if f is None})
            more = dict(zip(new, self._library(new), strict=True))
            for p, i in more.items():
                if len(known) >= MEMORY:
                    break
                if len(p) < 48:
                    known[p] = i
            found = [more[p] if f is None else f for p, f in zip(pieces, found, strict=True)]
        return found

    def _lowered(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text for a vocabulary of lower-cased texts."""
        lowered = [t.lower() for t in texts]
        apart = [k for k, t in enumerate(lowered) if self.added_bytes.search(t)]
        if apart:
            out = dict(zip(apart, self._library([texts[k].decode() for k in apart]), strict=True))
            others = iter(self._lowered([t for k, t in enumerate(texts) if k not in out]))
            return [out[k] if k in out else next(others) for k in range(len(texts))]
        data, first, last = joined(lowered)
        starts, ends = _cut(data)
        if not len(starts):
            return [b""] * len(texts)
        keys, place, number = np.unique(
            span_hashes(prefix_hashes(data), starts, ends), return_index=True, return_inverse=True
        )
        row = np.fromiter(map(self.rows.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(row < 0)
        whole = data.tobytes()
        at = place[new]
        added = self._library([whole[i:j].decode() for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        sizes = np.array([len(i) >> 2 for i in added], np.int64)
        row[new] = len(self.sizes) + np.arange(len(new))
        ids = np.concatenate((self.ids, np.frombuffer(b"".join(added), np.uint32)))
        length = np.concatenate((self.sizes, sizes))
        begin = np.cumsum(length) - length
        room = max(0, min(len(new), ROWS - len(self.sizes)))
        if room:
            self.rows.update(zip(keys[new[:room]].tolist(), row[new[:room]].tolist(), strict=True))
            self.sizes = length[: len(self.sizes) + room]
            self.ids = ids[: int(self.sizes.sum())]
        n, base = length[row][number], begin[row][number]
        past = np.cumsum(n)
        out = ids[np.repeat(base - (past - n), n) + np.arange(int(past[-1]))].tobytes()
        edge = 4 * np.concatenate(([0], past))[np.searchsorted(starts, np.append(first, len(data)))]
        return [out[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def spans(self, text: str) -> list[str]:
        """Pre-tokens of a ``spaced`` text; the whole text where it may not be split here."""
        if self.kind == "spaced" and _SAFE.fullmatch(text) and not self.added.search(text.lower()):
            return _SPACED.findall(text)
        return [text]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, encoded together so that new pieces meet the library once."""
        if self.kind == "lowered":
            return self._lowered(texts)
        split = [self.spans(t.decode()) for t in texts]
        flat = self._look_up([p for s in split for p in s])
        out, at = [], 0
        for s in split:
            out.append(b"".join(flat[at : at + len(s)]))
            at += len(s)
        return out

    def counts(self, pieces: list[str]) -> list[int]:
        """Number of ids of each piece."""
        return [len(i) >> 2 for i in self._look_up(pieces)]


#: Classes of bytes: white space, letters, digits, other ASCII, and what only the library may split.
_SPACE_, _LETTER_, _DIGIT_, _OTHER_, _ODD_ = range(5)
_CLASS = np.full(256, _ODD_, np.uint8)
_CLASS[0:0x1C] = _CLASS[0x21:0x80] = _OTHER_
_CLASS[9:14] = _CLASS[32] = _SPACE_
_CLASS[97:123] = _LETTER_
_CLASS[48:58] = _DIGIT_
_CLASS[39] = _ODD_  # an apostrophe may open a contraction


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of lower-cased (A-Z) text; a stretch between white space that holds anything odd is one piece."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & ((data[1:] & 0x1F) != 0x17))
    kind[lead] = kind[lead + 1] = _LETTER_
    turn = np.ones(len(data), bool)
    turn[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT_)
    odd = np.concatenate(([0], np.cumsum(kind == _ODD_)))
    gap = kind == _SPACE_
    opens = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    closes = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    for i, j in zip(*(x[odd[closes] > odd[opens]].tolist() for x in (opens, closes)), strict=True):
        turn[i + 1 : j] = False
    begin = np.flatnonzero(turn)
    end = np.append(begin[1:], len(data))
    some = ~gap[begin]
    return begin[some], end[some]


def _kind(about: dict) -> str:
    model, pre = about["model"], about["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and not model.get("dropout")
        and about["post_processor"] is None
        and all(t["special"] for t in about["added_tokens"])
    )
    if plain and about["normalizer"] is None and pre == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
    }:
        return "spaced"
    steps = [s["type"] for s in (about["normalizer"] or {}).get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    if plain and steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {
        "Regex": f"{_SHORT}|[\\p{{L}}]+|[\\p{{N}}]|[^\\s\\p{{L}}\\p{{N}}]+"
    }:
        return "lowered"
    return "whole"
