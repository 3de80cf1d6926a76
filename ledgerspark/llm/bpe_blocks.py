"""Encoding of blocks of texts in arrays: nothing is done word by word in Python.

Texts are composed and lower-cased as strings; all words of a block are cut at once, by the classes of
their code points. A table that lives as long as the Python worker has the ids of short words; those
that it lacks, and long ones, go through the model's speculation and verification.

Defined results: those of `ledgerspark.llm.bpe`, for files with its usual pattern of words; a file
with another pattern is an error.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from ledgerspark.llm.bpe import DIGIT, MARK, OTHER, SPACE, SPACES, BpeModel, remembered

#: The pattern of words that is cut here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters to a block, about; longer texts are cut at white space, which no token crosses.
BLOCK = 1 << 20
#: Words looked up at once; words, and ids to a word on the average, that are kept before all are forgotten.
SLICE, KEPT_WORDS, KEPT_IDS = 1 << 17, 1 << 20, 8
#: Longer words, in bytes, are not kept: a key is 23 bytes and their number.
SHORT = 23
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SPACE = re.compile(f"[{SPACES}]")
_BEYOND = "\u0370-\U0010ffff"
#: A stretch between white space that has a character from Greek on.
_BEYOND_LATIN = re.compile(f"((?<![^{SPACES}])[^{SPACES}{_BEYOND}]*(?![{SPACES}])[{_BEYOND}][^{SPACES}]*)")


class KnownWords:
    """Ids of the words met lately, in arrays of bounded size: some 50 MB when they are full."""

    def __init__(self, most: int = KEPT_WORDS):
        self.most, self.bits = most, (2 * (most + SLICE) - 1).bit_length()
        self._forget()

    def _forget(self) -> None:
        self.slots, self.n, self.used = np.full(1 << self.bits, -1, np.int32), 0, 0
        self.keys = [np.empty(self.most + SLICE, np.uint64) for _ in range(3)]
        self.first, self.count = np.empty(self.most + SLICE, np.int64), np.empty(self.most + SLICE, np.int64)
        self.pool = np.empty(1 << 16, "<u4")

    def _keep(self, ids: np.ndarray) -> int:
        """Adds ids to the pool; their place."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.empty(max(self.used, at) + len(ids), "<u4")])
        self.pool[at : self.used] = ids
        return at

    def _numbers(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, and which of these words have the new numbers, in order."""
        mixed = (keys[0] * _ODD[0]) ^ (keys[1] * _ODD[1]) ^ (keys[2] * _ODD[2])
        at = (((mixed ^ (mixed >> np.uint64(29))) * _ODD[3]) >> np.uint64(64 - self.bits)).astype(np.int64)
        out, left, new = np.empty(len(at), np.int64), np.arange(len(at)), []
        while left.size:
            there = self.slots[at]
            free = np.flatnonzero(there < 0)
            if free.size:  # of the words that want a slot one gets it
                self.slots[at[free]] = free
                won = free[self.slots[at[free]] == free]
                number = np.arange(self.n, self.n + len(won))
                self.slots[at[won]] = number
                for mine, other in zip(self.keys, keys, strict=True):
                    mine[number] = other[won]
                self.n += len(won)
                new.append(left[won])
                there = self.slots[at]
            same = self.keys[0][there] == keys[0]
            for mine, other in zip(self.keys[1:], keys[1:], strict=True):
                same &= mine[there] == other
            out[left[same]] = there[same]
            more = np.flatnonzero(~same)
            left, at, keys = left[more], (at[more] + 1) & ((1 << self.bits) - 1), [k[more] for k in keys]
        return out, np.concatenate(new) if new else left

    def encode(self, model: BpeModel, text: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has. 24 bytes follow the last word."""
        parts = [self._encode(model, text, starts[i : i + SLICE], lens[i : i + SLICE]) for i in range(0, len(starts), SLICE)]
        ids, counts = zip(*parts, strict=True) if parts else ([np.empty(0, "<u4")], [np.empty(0, np.int64)])
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, model: BpeModel, text: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.most or self.used > KEPT_IDS * self.most:
            self._forget()
        first, count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        short = np.flatnonzero(lens <= SHORT)
        at, n = starts[short], lens[short]
        eight = np.ndarray(len(text) - 7, "<u8", text, 0, (1,))
        keys = [eight[at + 8 * k] & _KEEP[np.clip(n - 8 * k, 0, 8)] for k in range(3)]
        keys[2] |= n.astype(np.uint64) << np.uint64(56)
        known = self.n
        number, new = self._numbers(keys)
        if new.size:
            ids, counts = self._ids(model, text, at[new], n[new])
            self.count[known : self.n] = counts
            self.first[known : self.n] = self._keep(ids) + np.cumsum(counts) - counts
        first[short], count[short] = self.first[number], self.count[number]
        if len(short) < len(starts):
            long = np.flatnonzero(lens > SHORT)
            ids, counts = self._ids(model, text, starts[long], lens[long])
            first[long], count[long] = self._keep(ids) + np.cumsum(counts) - counts, counts
        place = np.repeat(first - np.cumsum(count) + count, count)
        place += np.arange(len(place))
        return self.pool[place], count

    @staticmethod
    def _ids(model: BpeModel, text: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the text by the model; a mark stands for a special token."""
        stored, ends = np.frombuffer(text, np.uint8), np.cumsum(lens)
        flat = stored[np.repeat(starts - ends + lens, lens) + np.arange(lens.sum())]
        marks = np.flatnonzero(stored[starts] == 0xFF)
        if not marks.size:
            return model.encode_text(flat.astype(np.int64), lens)
        plain = np.ones(len(lens), bool)
        plain[marks] = False
        counts, tokens = np.ones(len(lens), np.int64), np.zeros(0, np.int64)
        if plain.any():
            tokens, counts[plain] = model.encode_text(flat[np.repeat(plain, lens)].astype(np.int64), lens[plain])
        ids = np.empty(counts.sum(), np.int64)
        of_mark = np.repeat(~plain, counts)
        ids[~of_mark], ids[of_mark] = tokens, [model.marked[text[a : a + n]] for a, n in zip(starts[marks].tolist(), lens[marks].tolist(), strict=True)]
        return ids, counts


def _latin(text: str) -> str:
    """Composed and lower-cased. Below Greek, Python's tables are those of any later Unicode version."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()


class BlockEncoder:
    """Encodes batches of texts; what it knows of words lives as long as the Python worker."""

    def __init__(self, model: BpeModel):
        if model.words != WORDS:
            raise ValueError(f"words are cut by {WORDS} only, not by {model.words}")
        self.model, self.known = model, remembered(model.path, "blocks", KnownWords)
        self.kinds = bytes(model.classes[:128]) + bytes([OTHER]) * 120 + bytes([MARK]) * 8
        self.common = lru_cache(1 << 15)(model.normalizer.normalize_str)
        self.special = re.compile("(" + "|".join(map(re.escape, model.special)) + ")").split if model.special else None

    def _normal(self, text: str) -> bytes:
        """Composed and lower-cased; special tokens are marks."""
        if self.special and len(parts := self.special(text)) > 1:
            return b"".join([self.model.marks[x] if x in self.model.marks else self._normal(x) for x in parts])
        parts = [text] if text.isascii() else _BEYOND_LATIN.split(text)
        parts[::2] = map(_latin, parts[::2])
        parts[1::2] = [self.common(x) if len(x) <= 64 else self.model.normalizer.normalize_str(x) for x in parts[1::2]]
        return "".join(parts).encode()

    def _cut(self, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the words. The last byte is white space."""
        text, kind = np.frombuffer(flat, np.uint8), np.frombuffer(bytearray(flat.translate(self.kinds)), np.uint8)
        ascii = flat.isascii()
        if not ascii:
            lead = np.flatnonzero((text >= 0xC0) & (text < 0xF8))
            size = 2 + (text[lead] >= 0xE0) + (text[lead] >= 0xF0)
            point, more = text[lead].astype(np.int64) & (0x7F >> size), [np.flatnonzero(size > k) for k in (1, 2, 3)]
            for k, which in enumerate(more, 1):
                point[which] = point[which] << 6 | text[lead[which] + k] & 0x3F
            kind[lead] = self.model.classes[point]
            for k, which in enumerate(more, 1):
                kind[lead[which] + k] = kind[lead[which]]
        begin = np.ones(len(text), bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin |= kind == DIGIT
        if not ascii:
            begin[(text & 0xC0) == 0x80] = False
            begin |= text == 0xFF
        quote = np.flatnonzero(text == ord("'"))
        quote = quote[kind[quote - 1] != OTHER]  # before the first comes the last, which is white space
        if quote.size:
            a, b = text[quote + 1], text[np.minimum(quote + 2, len(text) - 1)]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = (b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))
            begin[quote[one | two] + 1] = False
            begin[quote[one] + 2] = True
            begin[quote[two] + 3] = True
        at = np.flatnonzero(begin)
        lens, word = np.diff(at, append=len(text)), kind[at] != SPACE
        return at[word], lens[word]

    def _block(self, texts: list[str]) -> list[bytes]:
        parts = list(map(self._normal, texts))
        flat = b"\n".join(parts) + b"\n" * 32
        starts, lens = self._cut(flat)
        ids, counts = self.known.encode(self.model, flat, starts, lens)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        to = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, ends)].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *to], to, strict=False)]

    def batch(self, texts: list) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        block, size = [], 0
        for i, text in enumerate(texts):
            for part in stretches(text or ""):
                block.append((i, part))
                size += len(part)
                if size >= BLOCK:
                    self._add(block, out)
                    block, size = [], 0
        self._add(block, out)
        return list(map(b"".join, out))

    def _add(self, block: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        for (i, _), ids in zip(block, self._block([part for _, part in block]) if block else [], strict=True):
            out[i].append(ids)


def stretches(text: str) -> Iterator[str]:
    """A text in stretches of about a block, cut at white space."""
    at = 0
    while len(text) - at > BLOCK and (space := _SPACE.search(text, at + BLOCK)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]
