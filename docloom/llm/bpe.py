"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's most frequent words are compiled, with their token ids as output,
into one minimal automaton over UTF-8 bytes: equal suffixes share states, and
every edge carries how many words come before it, so that a walk adds up to the
word's number in the id table. The automaton is one flat array of 32-bit integers
in a file that Spark ships to the executors, where workers map it into memory and
walk all distinct words of a batch at once. Words that it doesn't hold are merged
exactly, lowest rank first and leftmost first, with a heap.

The result is that of the tokenizer file's own library: special tokens are cut
out of the raw text first; what is between is NFC-normalised, lower-cased (code
point by code point) and split into words; white space is dropped. Decoding joins
the tokens' strings by spaces, as a tokenizer without a decoder does.

Defined results: a null or empty text has no tokens and decodes to an empty text;
texts of any length are encoded whole (time n log n in a word's length); repeated
rows give repeated results; an empty table gives an empty result and an empty
lexicon; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.deploy import ship_file, temporary_folder
from docloom.llm.common import drop, small_batches, stage

LEXICON_WORDS = 1 << 16
WORDS_HELD = 1 << 17  # distinct words that a worker remembers before it starts anew
ROWS_AT_ONCE = 512
STEPS_IN_OCTAVE = 8  # frequency classes: 512 at most, for counts of 64 bits
LONG_WORD = 64  # longer words are merged one by one, with a heap

# The split of words, once for text below U+0250 and once for any text. Fixed values of the tokenizer format.
_NARROW = re.compile(
    r"[a-zªµºß-öø-ɏA-ZÀ-ÖØ-Þ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]"
    r"|[^\t-\r \u0085\u00a0A-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+"
)
_WIDE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_BEYOND = re.compile(r"[^\u0000-ɏ]")


def split_words(text: str) -> list[str]:
    """The words of one text without special tokens."""
    if text.isascii():
        return _NARROW.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # str.lower() minds the end of words here, code points alone don't
        text = text.replace("Σ", "σ")
    text = text.lower()
    return (_WIDE if _BEYOND.search(text) else _NARROW).findall(text)


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class PairTable:
    """Rank and result of a merge by its pair of ids, for whole arrays: an open-addressing hash table."""

    BITS, NONE = 19, np.int64(1 << 30)

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.key = np.full(1 << self.BITS, -1, np.int64)
        self.rank = np.full(1 << self.BITS, self.NONE)
        self.made = np.zeros(1 << self.BITS, np.int64)
        left, right = np.array([*merges], np.int64).reshape(-1, 2).T
        slots = self._slot(left << 20 | right)
        for (a, b), (rank, made), slot in zip(merges, merges.values(), slots.tolist(), strict=True):
            while self.key[slot] >= 0:
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            self.key[slot], self.rank[slot], self.made[slot] = a << 20 | b, rank, made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; that of a pair that doesn't merge has rank ``NONE``."""
        key = left << 20 | right
        slot = self._slot(key)
        open_ = np.flatnonzero((self.key[slot] != key) & (self.key[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
            held = self.key[slot[open_]]
            open_ = open_[(held != key[open_]) & (held >= 0)]
        return slot


class Vocabulary:
    """Token strings, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        alphabet = byte_alphabet()
        self.inner = [self.ids[c] for c in alphabet]
        self.final = [self.ids[c + self.suffix] for c in alphabet]
        self.pairs = PairTable(self.merges)

    def merge(self, word: str) -> list[int]:
        """The ids of one word by exact merging."""
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(at: int) -> None:
            to = after[at]
            if to < len(ids) and (found := self.merges.get((ids[at], ids[to]))):
                heapq.heappush(queue, (found[0], at, found[1], ids[at], ids[to]))

        for at in range(len(ids) - 1):
            offer(at)
        while queue:
            _, at, made, left, right = heapq.heappop(queue)
            to = after[at]
            if ids[at] != left or to >= len(ids) or ids[to] != right:
                continue  # one of the two has been merged meanwhile
            ids[at], ids[to] = made, -1
            after[at] = after[to]
            if after[at] < len(ids):
                before[after[at]] = at
            if before[at] >= 0:
                offer(before[at])
            offer(at)
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, their numbers) by exact merging: every step does one merge in every word."""
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        short = np.flatnonzero(size <= LONG_WORD)
        parts = {int(i): self.merge(words[i]) for i in np.flatnonzero(size > LONG_WORD)}
        letters = np.frombuffer(b"".join([raw[i] for i in short]), np.uint8)
        word = np.repeat(short, size[short])
        ids = np.array(self.inner, np.int64)[letters]
        ends = np.cumsum(size[short]) - 1
        ids[ends] = np.array(self.final, np.int64)[letters[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.repeat(i, len(x)), np.array(x, np.int64)) for i, x in parts.items()]
        while len(ids):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            slot = self.pairs.find(ids[:-1], ids[1:])
            rank = np.append(np.where(word[:-1] == word[1:], self.pairs.rank[slot], PairTable.NONE), PairTable.NONE)
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), start)
            merges = best < (int(PairTable.NONE) << 32)
            goes_on = np.repeat(merges, np.diff(np.append(start, len(ids))))
            done.append((word[~goes_on], ids[~goes_on]))
            at = best[merges] & 0xFFFFFFFF
            ids[at] = self.pairs.made[slot[at]]
            goes_on[at + 1] = False
            word, ids = word[goes_on], ids[goes_on]
        word, ids = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return ids[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lexicon:
    """A minimal acyclic transducer from words to id sequences, in one array of 32-bit integers.

    Layout: sizes; edge keys (state * 256 + byte, ascending); edge targets; words
    before each edge; 1 for accepting states; start of each word's ids; ids.
    """

    def __init__(self, flat: np.ndarray) -> None:
        sizes = flat[:6].astype(int)
        cuts = np.cumsum([6, *sizes])
        self.key, self.target, self.skip, self.accepts, self.start, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        self.root = len(self.accepts) - 1

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.int32, "r"))

    @staticmethod
    def build(entries: dict[str, list[int]]) -> np.ndarray:
        """The flat array for ``entries``; equal suffixes end in the same states."""
        words = sorted((w.encode("utf-8"), ids) for w, ids in entries.items())
        known: dict[tuple, int] = {}
        counts: list[int] = []

        def settled(node: list) -> int:
            accepts, edges = node
            state = (accepts, tuple(edges))
            if state not in known:
                known[state] = len(known)
                counts.append(accepts + sum(counts[t] for _, t in edges))
            return known[state]

        path: list[list] = [[0, []]]
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], settled(node)))

        for word, _ in words:
            shared = len(os.path.commonprefix([last, word]))
            close(shared)
            path.extend([0, []] for _ in word[shared:])
            path[-1][0] = 1
            last = word
        close(0)
        accepts, edges = path[0]
        known[("root", accepts, tuple(edges))] = len(known)  # the root comes last, even if another state equals it
        key, target, skip = [], [], []
        accepting = np.zeros(len(known), np.int32)
        for state, number in known.items():
            accepts, edges = state[-2:]
            accepting[number] = accepts
            passed = accepts
            for byte, to in edges:
                key.append(number * 256 + byte)
                target.append(to)
                skip.append(passed)
                passed += counts[to]
        lengths = [len(ids) for _, ids in words]
        parts = [key, target, skip, accepting, np.cumsum([0, *lengths]), [i for _, ids in words for i in ids]]
        return np.concatenate([[len(x) for x in parts], *parts]).astype(np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the id table, -1 where the lexicon doesn't hold it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive = np.arange(len(words)) if len(self.key) else np.arange(0)
        at = 0
        while len(alive := alive[lengths[alive] > at]):
            wanted = state[alive] * 256 + letters[starts[alive] + at]
            edge = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            found = self.key[edge] == wanted
            state[alive[~found]] = -1
            alive, edge = alive[found], edge[found]
            state[alive] = self.target[edge]
            number[alive] += self.skip[edge]
            at += 1
        held = (state >= 0) & (self.accepts[state] == 1) if len(self.key) else np.zeros(len(words), bool)
        return np.where(held, number, -1)


class _Codes(dict):
    """Numbers words in the order in which they come."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code


class Encoder:
    """Encodes texts; ``resolve`` gives the ids, one after the other, and their numbers, of words not met before."""

    def __init__(self, special: dict[str, int], split_special: re.Pattern, resolve) -> None:
        self.special, self.split_special, self.resolve = special, split_special, resolve
        self._restart()

    def _restart(self) -> None:
        self.codes = _Codes()
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for token in self.special:
            self.codes[token]
        self._add(np.array([*self.special.values()], np.uint32), np.ones(len(self.special), np.int64))

    def _add(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])
        self.codes.fresh = []

    def _text(self, text: str) -> list[int]:
        number = self.codes.__getitem__
        if "<|" not in text:
            return list(map(number, split_words(text)))
        out: list[int] = []
        for i, part in enumerate(self.split_special.split(text)):
            out.extend([number(part)] if i % 2 else map(number, split_words(part)))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for at in range(0, len(texts), ROWS_AT_ONCE):
            if len(self.codes) > WORDS_HELD:
                self._restart()
            coded = [np.array(self._text(t) if t else [], np.int64) for t in texts[at : at + ROWS_AT_ONCE]]
            if self.codes.fresh:
                self._add(*self.resolve(self.codes.fresh))
            for codes in coded:
                length = self.length[codes]
                ends = np.cumsum(length)
                total = int(ends[-1]) if len(ends) else 0
                out.append(self.ids[np.repeat(self.start[codes] - ends + length, length) + np.arange(total)])
        return out


def lexicon_encoder(tokenizer_path: str, lexicon_path: str) -> Encoder:
    words, lexicon = vocabulary(tokenizer_path), Lexicon.open(lexicon_path)

    def resolve(fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number = lexicon.numbers([w.encode("utf-8") for w in fresh])
        held, start = number >= 0, np.asarray(lexicon.start, np.int64)
        others, other_length = words.merge_many([fresh[i] for i in np.flatnonzero(~held)])
        length = np.zeros(len(fresh), np.int64)
        length[held], length[~held] = start[number[held] + 1] - start[number[held]], other_length
        # Where each word's ids begin: in the lexicon, or behind it among the merged ones.
        begin = np.zeros(len(fresh), np.int64)
        begin[held], begin[~held] = start[number[held]], len(lexicon.ids) + np.cumsum(other_length) - other_length
        source = np.concatenate([np.asarray(lexicon.ids).astype(np.uint32), others])
        return source[np.repeat(begin - np.cumsum(length) + length, length) + np.arange(int(length.sum()))], length

    return Encoder(words.special, words.split_special, resolve)


def merging_encoder(tokenizer_path: str) -> Encoder:
    """The same without a lexicon: all words are merged."""
    words = vocabulary(tokenizer_path)
    return Encoder(words.special, words.split_special, words.merge_many)


def word_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(word, n) over all texts, counted in each partition before the shuffle."""

    def batch(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*counts.keys()], pa.string()), pa.array([*counts.values()], pa.int64())], names=["word", "n"])

    tokenizer = ship_file(docs.sparkSession, tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = vocabulary(SparkFiles.get(tokenizer)).split_special
        counts: Counter[str] = Counter()
        for rows in batches:
            for text in rows.column("text").to_pylist():
                if text:
                    for part in special.split(text)[::2] if "<|" in text else [text]:
                        counts.update(split_words(part))
                if len(counts) > WORDS_HELD:
                    yield batch(counts)
                    counts.clear()
        yield batch(counts)

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of ``docs``, ``size`` at most; the name under which Spark ships the file.

    Frequencies are first counted in classes by their logarithm, and the classes from the top that hold no more than
    ``size`` words are taken. So the driver gets that many numbers and words at most, however many tasks there are. Words over 64
    characters are left to merging.
    """
    spark = docs.sparkSession
    counted = word_counts(docs, tokenizer_path).where(F.length("word") <= 64).select("word", F.floor(F.log2("n") * STEPS_IN_OCTAVE).cast("int").alias("class"))
    counts = stage(counted, "words")
    total, lowest = 0, None
    for row in sorted(counts.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["class"]):
        total += row.n
        if total > size:
            break
        lowest = row["class"]
    words = vocabulary(tokenizer_path)
    top = [] if lowest is None else [r.word for r in counts.where(F.col("class") >= lowest).select("word").collect()]
    drop(counts)
    flat = Lexicon.build({w: words.merge(w) for w in top})
    path = os.path.join(temporary_folder("docloom-"), f"lexicon-{uuid.uuid4().hex}.i32")
    flat.tofile(path)
    return ship_file(spark, path)


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in a binary column."""
    small_batches(docs.sparkSession)
    tokenizer = ship_file(docs.sparkSession, tokenizer_path)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = lexicon_encoder(SparkFiles.get(tokenizer), SparkFiles.get(lexicon))
        for texts in batches:
            yield pd.Series([x.astype("<u4").tobytes() for x in encoder.encode(texts.tolist())], index=texts.index, dtype=object)

    return docs.select("doc_id", ids("text").alias("ids"))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its column ``ids``."""
    tokenizer = ship_file(encoded.sparkSession, tokenizer_path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = vocabulary(SparkFiles.get(tokenizer)).tokens.__getitem__
        for rows in batches:
            yield pd.Series([" ".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in rows], index=rows.index, dtype=object)

    return encoded.withColumn("decoded", text("ids"))
