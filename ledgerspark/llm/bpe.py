"""Byte-pair encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word, a vectorised test checks every adjacent pair of
proposed tokens against the merge order, and only words with a failing pair are merged exactly.

A token sequence is the encoding of a word if every token encodes to itself and every adjacent pair
is compatible: no merge across their border would have happened before the merges that built them.
Tokens that do not encode to themselves are left out of the proposals.

Defined results: a null or empty text has no tokens and decodes to the empty string; a null id stays
null; repeated rows are encoded each; an empty table gives no rows; texts of any length are encoded
whole, and words of any length too; further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

#: Words kept per Python worker between batches and tasks, in each of two generations: when the younger
#: is full the older goes, so words that keep coming stay. Some 200 bytes each.
CACHE_WORDS = 250_000
NO_PARENT = 1 << 40
#: Words of more bytes are proposed for from every place at once, and merged one by one where the proposal fails.
LONG_WORD = 64
#: Classes of code points; MARK is of no code point: bytes that stand for a special token.
SPACE, LETTER, DIGIT, OTHER, MARK = range(5)


class _HashTable:
    """An int64 -> int32 map as numpy arrays with vectorised lookups (-1: absent)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while left.size:
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while left.size:
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (there != -1)
            left, at = left[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])


class BpeModel:
    """Tables of one tokenizer file. Its size is bounded by the vocabulary, so it can be broadcast."""

    def __init__(self, path: str):
        self.path = str(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        ranges = {kind: _ranges_of(kind) for kind in ("L", "N")}
        self.pattern = plain_pattern(self.words, lambda kind: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[kind]))
        self.ascii_pattern = plain_pattern(self.words, {"L": "a-z", "N": "0-9"}.get)
        self.classes = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        self.classes[[c for c in range(1 << 16) if _SPACE.match(chr(c))]] = SPACE
        for kind, name in (("L", LETTER), ("N", DIGIT)):
            for a, b in ranges[kind]:
                self.classes[a : b + 1] = name
        self.normalizer = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None})).normalizer
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.marks = {text: bytes([0xFF, *(0xF8 + int(d) for d in np.base_repr(i, 7))]) for text, i in self.special.items()}  # no text has these bytes
        self.marked = {self.marks[text]: i for text, i in self.special.items()}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in (*vocab.items(), *self.special.items()):
            self.names[i] = name
        letters = byte_alphabet()
        self.base = np.array([vocab[c] for c in letters] + [vocab[c + suffix] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        lefts = np.array([vocab[a] for a, _ in merges], np.int64)
        rights = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        size = len(self.names)
        self.rank = np.zeros(size, np.int64)  # 0: a single byte, else 1 + the place of its merge
        self.rank[made] = np.arange(1, len(made) + 1)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left[made], self.right[made] = lefts, rights
        if (self.rank[lefts] >= self.rank[made]).any() or (self.rank[rights] >= self.rank[made]).any():
            raise ValueError("a merge comes before the merges of its parts")
        self.pairs = _HashTable(lefts << 20 | rights, made)
        self.pair_id = dict(zip((lefts << 20 | rights).tolist(), made.tolist(), strict=True))
        self._build_trie()

    def _build_trie(self) -> None:
        symbol = {int(t): (s,) for s, t in enumerate(self.base)}
        for t in np.argsort(self.rank, kind="stable"):
            if self.rank[t]:
                symbol[int(t)] = symbol[int(self.left[t])] + symbol[int(self.right[t])]
        nodes: dict[int, int] = {}
        final = [-1]
        for t, path in symbol.items():
            if self.merge([int(self.base[s]) for s in path]) != [t]:
                continue
            at = 0
            for s in path:
                key = at << 9 | s
                if key not in nodes:
                    nodes[key] = len(final)
                    final.append(-1)
                at = nodes[key]
            final[at] = t
        self.trie = _HashTable(np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.final = np.array(final, np.int32)
        pairs = np.arange(1 << 18, dtype=np.int64)
        self.one = self.trie.get(pairs[:512])  # the nodes of one and of two symbols, without hashing
        first = self.one[pairs >> 9].astype(np.int64)
        self.two = np.where(first >= 0, self.trie.get(np.maximum(first, 0) << 9 | pairs & 511), -1)

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: lowest rank first, leftmost first among equals."""
        n, ids = len(ids), list(ids)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pair_id.get
        heap = [(int(self.rank[m]), i, m) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, m = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] << 20 | ids[j]) != m:
                continue
            ids[i], ids[j], after[i] = m, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (int(self.rank[x]), a, x))
        return [t for t in ids if t >= 0]

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For every pair of tokens: whether the border between them survives exact merging.

        Both tokens are taken apart along the border, the latest merge first. A merge across the
        border that is older than the merges that swallow its parts would have come first.
        """
        good = np.ones(len(first), bool)
        at, a, b = np.arange(len(first)), first.astype(np.int64), second.astype(np.int64)
        over_a, over_b = np.full(len(at), NO_PARENT), np.full(len(at), NO_PARENT)
        while at.size:
            across = self.pairs.get(a << 20 | b)
            rank = np.where(across >= 0, self.rank[across], NO_PARENT)
            bad = (rank < over_a) & (rank <= over_b) & (across >= 0)
            good[at[bad]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~bad & ((rank_a > 0) | (rank_b > 0))
            first_side = rank_a > rank_b
            over_a, over_b = np.where(first_side, rank_a, over_a), np.where(first_side, over_b, rank_b)
            a, b = np.where(first_side, self.right[a], a), np.where(first_side, b, self.left[b])
            at, a, b, over_a, over_b = at[go], a[go], b[go], over_a[go], over_b[go]
        return good

    def _longest(self, text: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token from each place, and its length; a byte is always one."""
        best, length = self.final[self.one[text[at]]], np.ones(len(at), np.int64)
        who = np.flatnonzero(at + 1 < stop)
        node, depth = self.two[text[at[who]] << 9 | text[at[who] + 1]], 2
        while True:
            who, node = who[node >= 0], node[node >= 0].astype(np.int64)
            token = self.final[node]
            found = who[token >= 0]
            best[found], length[found] = token[token >= 0], depth
            more = at[who] + depth < stop[who]
            who, node = who[more], node[more]
            if not who.size:
                return best, length
            node = self.trie.get(node << 9 | text[at[who] + depth])
            depth += 1

    def _proposed(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in stretches of the text, all at once: (place, token) of each token, in order."""
        found, cur, stop = [], starts, ends
        while cur.size:
            best, length = self._longest(text, cur, stop)
            found.append((cur, best))
            cur = cur + length
            more = cur < stop
            cur, stop = cur[more], stop[more]
        at, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], ids[order]

    def _proposed_in_long(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where stretches are long: the longest token from every place first."""
        lens = ends - starts
        places = np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        best, length = self._longest(text, places, np.repeat(ends, lens))
        taken, cur, stop = np.zeros(len(places), bool), np.cumsum(lens) - lens, np.cumsum(lens)
        while cur.size:
            taken[cur] = True
            cur = cur + length[cur]
            more = cur < stop
            cur, stop = cur[more], stop[more]
        return places[taken], best[taken]

    def encode_text(self, text: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has (none may be empty).

        text: the words' bytes one after the other as int64, changed here; lens: how many each word has.
        """
        ends = np.cumsum(lens)
        text[ends - 1] += 256
        long = lens > LONG_WORD
        parts = [f(text, (ends - lens)[which], ends[which]) for f, which in ((self._proposed, ~long), (self._proposed_in_long, long)) if which.any()]
        at, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            order = np.argsort(at, kind="stable")
            at, ids = at[order], ids[order]
        word = np.repeat(np.arange(len(lens)), lens)[at]
        pair = np.flatnonzero(word[1:] == word[:-1])
        wrong = np.zeros(len(lens), bool)
        wrong[word[pair[~self.compatible(ids[pair], ids[pair + 1])]]] = True
        if wrong.any():
            merged = []
            for w in np.flatnonzero(wrong & long).tolist():
                out = self.merge(self.base[text[ends[w] - lens[w] : ends[w]]].tolist())
                merged.append((np.full(len(out), w), np.array(out, np.int64)))
            short = np.flatnonzero(wrong & ~long)
            if short.size:
                name, out = self._merge_all(self.base[text[np.repeat(wrong & ~long, lens)]], lens[short])
                merged.append((short[name], out))
            right = ~wrong[word]
            word, ids = (np.concatenate(x) for x in zip((word[right], ids[right]), *merged, strict=True))
            order = np.argsort(word, kind="stable")
            word, ids = word[order], ids[order]
        return ids, np.bincount(word, minlength=len(lens))

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word (none may be empty)."""
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ids, counts = self.encode_text(text, np.fromiter(map(len, words), np.int64, len(words)))
        flat, to = ids.tolist(), np.cumsum(counts).tolist()
        return [flat[a:b] for a, b in zip([0, *to], to, strict=False)]

    def _merge_all(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words side by side, one merge a word in each round: (word, id) of each token."""
        done: list[tuple] = []
        name, ids = np.arange(len(lens)), ids.astype(np.int64)
        while name.size:
            ends = np.cumsum(lens)
            starts = ends - lens
            made = np.full(len(ids), -1, np.int64)
            made[:-1] = self.pairs.get(ids[:-1] << 20 | ids[1:])
            made[ends - 1] = -1
            rank = np.where(made >= 0, self.rank[made], NO_PARENT)
            least = np.minimum.reduceat(rank, starts)
            over = least == NO_PARENT
            of_over = np.repeat(over, lens)
            if over.any():
                done.append((np.repeat(name[over], lens[over]), ids[of_over]))
            hit = np.flatnonzero((rank == np.repeat(least, lens)) & ~of_over)
            word = np.repeat(np.arange(len(lens)), lens)
            first = np.ones(len(hit), bool)
            first[1:] = word[hit[1:]] != word[hit[:-1]]
            hit = hit[first]
            ids[hit] = made[hit]
            stay = ~of_over
            stay[hit + 1] = False
            ids, name, lens = ids[stay], name[~over], lens[~over] - 1
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return word, ids


#: White space as Unicode defines it; str.split() also splits at the four separators 1C to 1F.
SPACES = "\t-\r \x85\xa0  -     　"
_NOT_SPACE, _SPACE = re.compile(f"[^{SPACES}]+"), re.compile(f"[{SPACES}]")


def chunks_of(text: str) -> list[str]:
    """The stretches of a text between white space; no token crosses one."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _NOT_SPACE.findall(text)
    return text.split()


def _ranges_of(kind: str) -> list[list[int]]:
    """The characters of one general category letter (L, N) as ranges of code points.

    Python's own tables may be of another Unicode version than the tokenizer's, so that is asked, in
    blocks that keep the driver's memory small.
    """
    cut, ranges = Split(Regex(f"[^\\p{{{kind}}}]+"), "removed"), []
    for first in range(0, sys.maxunicode + 1, 1 << 12):
        points = [c for c in range(first, first + (1 << 12)) if not 0xD800 <= c <= 0xDFFF]
        for _, (a, b) in cut.pre_tokenize_str("".join(map(chr, points))) if points else []:
            if ranges and ranges[-1][1] == points[a] - 1:
                ranges[-1][1] = points[b - 1]
            else:
                ranges.append([points[a], points[b - 1]])
    return ranges


def plain_pattern(pattern: str, class_of: Callable[[str], str]) -> str:
    """A pattern with \\p{L} and \\p{N} for Python's own re module; \\s is white space as Unicode defines it."""
    for kind in ("L", "N"):
        named = class_of(kind)
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[{named}]").replace(f"\\p{{{kind}}}", named)
    return pattern.replace("\\s", SPACES)


class Recent:
    """What was computed for words lately, in two generations of bounded size."""

    def __init__(self, most: int = CACHE_WORDS):
        self.most, self.known, self.older = most, {}, {}

    def missing(self, words: set) -> list:
        """Those of the words that must be computed; the others are in `known` from now on."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        fresh = words.difference(self.known)
        again = fresh.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        return list(fresh.difference(again))


#: What this Python worker remembers: of one vocabulary and one rendering at a time.
_REMEMBERED: dict = {}


def remembered(path: str, kind: str, make: Callable = Recent):
    if (path, kind) not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[path, kind] = make()
    return _REMEMBERED[path, kind]


def forget_words() -> None:
    """Other operators' tasks give back what this worker remembers of words: some 100 MB when it is full."""
    _REMEMBERED.clear()


class Encoder:
    """Encodes batches of texts, remembering `render(ids)` of chunks as long as the Python worker lives.

    kind: a name for what render makes; equal names share their memory between tasks.
    """

    def __init__(self, model: BpeModel, render, kind: str):
        self.model, self.render, self.recent = model, render, remembered(model.path, kind)
        self.find, self.find_ascii = re.compile(model.pattern).findall, re.compile(model.ascii_pattern).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, model.special)) + ")").split if model.special else None
        self.mark, self.marked = model.marks, {mark: [i] for mark, i in model.marked.items()}

    def _normal(self, chunk: str) -> str:
        """Composed and lower-cased. Below Greek, Python's tables are those of any later Unicode version."""
        return unicodedata.normalize("NFC", chunk).lower() if max(chunk) < "\u0370" else self.model.normalizer.normalize_str(chunk)

    def _words(self, chunk: str) -> list[bytes]:
        """The words of a chunk; special tokens are marks."""
        if self.cut and "<" in chunk and len(parts := self.cut(chunk)) > 1:
            return [y for x in parts if x for y in ([self.mark[x]] if x in self.mark else self._words(x))]
        if not chunk.isascii():
            return [x.encode() for x in self.find(self._normal(chunk))]
        chunk = chunk.lower()
        return [chunk.encode()] if chunk.isalpha() else [x.encode() for x in self.find_ascii(chunk)]

    def _remember(self, new: list[str]) -> None:
        """Render new chunks. Most are one word of ASCII letters: those are lower-cased and cut in one stretch."""
        plain = [c for c in new if c.isalpha() and c.isascii()]
        rest = [c for c in new if not (c.isalpha() and c.isascii())]
        single = "\n".join(plain).lower().encode().split(b"\n") if plain else []
        words = [self._words(c) for c in rest]
        flat = list(dict.fromkeys(chain(single, chain.from_iterable(words))).keys() - self.marked.keys())
        of = self.marked | (dict(zip(flat, self.model.encode_words(flat), strict=True)) if flat else {})
        self.recent.known.update(zip(plain, map(self.render, map(of.__getitem__, single)), strict=True))
        self.recent.known.update((c, self.render([t for w in ws for t in of[w]])) for c, ws in zip(rest, words, strict=True))

    def batch(self, texts: list) -> list[list]:
        """For each text the rendered chunks, in order."""
        split = [chunks_of(x) if x else [] for x in texts]
        if new := self.recent.missing(set(chain.from_iterable(split))):
            self._remember(new)
        get = self.recent.known.__getitem__
        return [list(map(get, x)) for x in split]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: hand them to Python in batches of at most so many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def broadcast_model(spark: SparkSession, path: str):
    """The vocabulary's tables for all tasks; some MB, fixed by the vocabulary."""
    return spark.sparkContext.broadcast(BpeModel(path))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, text): n_tokens, the ids and their decoding as SHA-256 digests."""
    spark = docs.sparkSession
    small_batches(spark)
    model = broadcast_model(spark, path)

    def run(batches):
        names = model.value.names
        text_of = [str(i) for i in range(len(names))]
        encoder = Encoder(model.value, lambda ids: (" ".join([text_of[i] for i in ids]), " ".join([names[i] for i in ids])), "lines")
        for b in batches:
            n, ids, decoded = [], [], []
            for parts in encoder.batch(b.column(1).to_pylist()):
                line = " ".join([p[0] for p in parts])
                n.append(line.count(" ") + 1 if line else 0)
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, text): ids as array<int>; the general interface."""
    spark = docs.sparkSession
    small_batches(spark)
    model = broadcast_model(spark, path)

    def run(batches):
        encoder = Encoder(model.value, lambda ids: ids, "lists")
        for b in batches:
            ids = [list(chain.from_iterable(parts)) for parts in encoder.batch(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): the text that the file's decoder gives: token names joined by a space.

    Built-in functions only: the vocabulary is a constant array of the plan.
    """
    spark = encoded.sparkSession
    names = spark.createDataFrame([(BpeModel(path).names,)], "names array<string>")
    return encoded.crossJoin(F.broadcast(names)).select("doc_id", F.array_join(F.transform("ids", lambda i: F.element_at("names", i + 1)), " ").alias("text"))
