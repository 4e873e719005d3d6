"""BPE encoding and decoding of whole texts through a transducer lexicon.

Frequent words - counted over all texts - are compiled with their ids into the minimal acyclic transducer of
:mod:`cueloom.llm.lexicon`, which every Python worker memory-maps. Words that it doesn't hold are merged exactly, all of a
batch together: in each round every word applies its leftmost pair of least rank, until none has a pair left.

The vocabulary is a file of the ``tokenizers`` library with NFC, white space and lower-case normalisation, a contraction /
letters / single number / other split, byte-level symbols and an end-of-word suffix; another kind is an error. Texts are
cut into words by comparing character classes over whole arrays. White space is never part of a word, so very long texts
pass in pieces that end at white space. Characters that Python's Unicode tables (15.1 in 3.13) don't know yet count as
neither letters nor numbers.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cueloom.llm.common import materialize, release_memory, small_batches
from cueloom.llm.lexicon import Lexicon, compile_lexicon

#: Words of the lexicon, and counters that a task keeps while it counts (a word with over 1/COUNTERS of a task's words is never missed).
LEXICON_WORDS = COUNTERS = 65_536
#: Code points handled at once.
PIECE = 1 << 20
#: Bytes of the longest word that is merged together with others.
TOGETHER = 40

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Fixed value: the split pattern that this module implements.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    first = np.fromiter((ord(unicodedata.category(chr(i))[0]) for i in range(sys.maxunicode + 1)), dtype=np.uint8)
    table[first == ord("L")], table[first == ord("N")] = LETTER, NUMBER
    table[WHITE] = SPACE
    return table


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file."""

    def __init__(self, blob: bytes) -> None:
        spec = json.loads(blob)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split != PATTERN or spec.get("decoder") or model.get("continuing_subword_prefix"):
            raise ValueError("a vocabulary of another kind")
        suffix, self.ids = model["end_of_word_suffix"] or "", model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.inner = np.array([self.ids[s] for s in byte_symbols()], dtype=np.int64)
        self.last = np.array([self.ids[s + suffix] for s in byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.tokens = np.empty(self.size, dtype=object)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        # the same ranks as an open-addressing table for whole arrays
        bits = (4 * len(ranks)).bit_length()
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, dtype=np.int64)
        self.rank, self.made = np.full(1 << bits, NEVER, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)
        for (a, b), (rank, made) in ranks.items():
            key = a * self.size + b
            at = int(self._slot(np.array([key]))[0])
            while self.key[at] >= 0:
                at = (at + 1) & self.mask
            self.key[at], self.rank[at], self.made[at] = key, rank, made

    def __getstate__(self) -> dict:
        """What workers need; the vocabulary's strings and the merges stay behind."""
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "ranks")}

    @cached_property
    def ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, id made) of each pair that merges."""
        at = np.flatnonzero(self.key >= 0)
        pairs = zip((self.key[at] // self.size).tolist(), (self.key[at] % self.size).tolist(), self.rank[at].tolist(), self.made[at].tolist(), strict=True)
        return {(a, b): (rank, made) for a, b, rank, made in pairs}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Table places of pairs, -1 where a pair has no merge (or a < 0 or b < 0)."""
        key = np.where((a < 0) | (b < 0), -2, a * self.size + b)
        at = self._slot(key)
        todo = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            todo = todo[(self.key[at[todo]] != key[todo]) & (self.key[at[todo]] >= 0)]
        return np.where(self.key[at] == key, at, -1)

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one word of any length, by a heap of pairs."""
        ids: list[int] = [int(self.inner[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.ranks[p][0], i, self.ranks[p][1], p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, made, pair = heapq.heappop(heap)
            j = after[i]
            if j >= len(ids) or ids[i] < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (p := (ids[left], ids[right])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p][0], left, self.ranks[p][1], p))
        return [i for i in ids if i >= 0]

    def merge_many(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, (n, length) bytes: (n, length) ids from the left, and how many are used."""
        n, size = words.shape
        ids = np.concatenate((self.inner[words[:, :-1]], self.last[words[:, -1:]]), axis=1)
        left = np.full(n, size, dtype=np.int64)
        place = self.find(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(n, size - 1)
        rank = np.where(place >= 0, self.rank[place], NEVER)
        rows = np.arange(n)
        columns = np.arange(size)
        while size > 1:
            best = rank[rows].argmin(axis=1) if len(rows) else rows
            rows_on = rank[rows, best] < NEVER
            rows, best = rows[rows_on], best[rows_on]
            if not len(rows):
                break
            at = self.find(ids[rows, best], ids[rows, best + 1])
            # close the gap after the merged pair
            move = np.minimum(columns + (columns > best[:, None]), size - 1)
            fresh = np.take_along_axis(ids[rows], move, axis=1)
            fresh[:, -1] = np.where(left[rows] == size, -1, fresh[:, -1])
            fresh[np.arange(len(rows)), best] = self.made[at]
            left[rows] -= 1
            fresh[columns[None, :] >= left[rows][:, None]] = -1
            ids[rows] = fresh
            moved = np.take_along_axis(rank[rows], np.minimum(columns[:-1] + (columns[:-1] > best[:, None]), size - 2), axis=1)
            moved[columns[None, :-1] >= (left[rows] - 1)[:, None]] = NEVER
            every = np.arange(len(rows))
            for pair in (best - 1, best):
                ok = (pair >= 0) & (pair < left[rows] - 1)
                found = self.find(fresh[every[ok], pair[ok]], fresh[every[ok], pair[ok] + 1])
                moved[every[ok], pair[ok]] = np.where(found >= 0, self.rank[found], NEVER)
            rank[rows] = moved
        return ids, left


NEVER = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Words:
    """Words of joined texts: where each starts and how long it is in ``data`` (UTF-8), and how many each text has."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray


def _normalised(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone would make a final sigma
    return text.lower()


def cut_words(texts: list[str]) -> Words:
    """The words of each text, in order."""
    shown = [_normalised(t) for t in texts]
    joined = "\n".join(shown) + "\n\n\n\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = classes()[points]
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    # contractions: a run that is one apostrophe, and one or two letters
    at = np.flatnonzero(start & (points == 0x27))
    at = at[kind[at + 1] == LETTER] if len(at) else at
    if len(at):
        one, two = points[at + 1], points[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(short, 1, np.where(long, 2, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        beyond = at + 1 + size
        start[beyond] |= kind[beyond] == LETTER
    end = kind != SPACE
    end[:-1] &= start[1:] | (kind[1:] == SPACE)
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    ends = np.cumsum([len(s) + 1 for s in shown])
    counts = np.diff(np.concatenate(([0], np.searchsorted(first, ends))))
    if joined.isascii():
        return Words(np.frombuffer(joined.encode(), dtype=np.uint8), first, last + 1 - first, counts)
    width = np.ones(len(points), dtype=np.int64)
    for limit in (0x80, 0x800, 0x10000):
        width += points >= limit
    offset = np.concatenate(([0], np.cumsum(width)))
    return Words(np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8), offset[first], offset[last + 1] - offset[first], counts)


def _distinct(words: Words, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (distinct words as (n, length) bytes, members of ``which``, the distinct word of each)."""
    for size in np.unique(words.lengths[which]).tolist():
        own = which[words.lengths[which] == size]
        if size > 4096:  # few and long: as Python's bytes
            every = [words.data[a : a + size].tobytes() for a in words.starts[own].tolist()]
            order = {w: i for i, w in enumerate(dict.fromkeys(every))}
            yield np.frombuffer(b"".join(order), dtype=np.uint8).reshape(-1, size), own, np.array([order[w] for w in every])
            continue
        for low in range(0, len(own), 1 << 16):
            part = own[low : low + (1 << 16)]
            matrix = words.data[words.starts[part][:, None] + np.arange(size)]
            once, back = _unique_rows(matrix)
            yield once, part, back


def _unique_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = matrix.shape[1]
    once, back = np.unique(np.ascontiguousarray(matrix).view(f"S{size}").reshape(-1), return_inverse=True)
    return np.frombuffer(once.tobytes(), dtype=np.uint8).reshape(-1, size), back


def encode_words(vocabulary: Vocabulary, lexicon: Lexicon, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and how many each word has."""
    number = lexicon.lookup(words.data, words.starts, words.lengths)
    starts, held = lexicon.arrays["starts"], [lexicon.arrays["ids"]]
    known = number >= 0
    at, size = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
    at[known] = starts[number[known]]
    size[known] = starts[number[known] + 1] - at[known]
    total = len(held[0])
    for once, own, back in _distinct(words, np.flatnonzero(~known)):
        if once.shape[1] <= TOGETHER:
            ids, used = vocabulary.merge_many(once)
            flat = ids[np.arange(ids.shape[1])[None, :] < used[:, None]]
        else:
            listed = [vocabulary.merge_one(w.tobytes()) for w in once]
            flat, used = np.array([i for x in listed for i in x], dtype=np.int64), np.array([len(x) for x in listed])
        begin = total + np.concatenate(([0], np.cumsum(used)[:-1]))
        at[own], size[own] = begin[back], used[back]
        held.append(flat.astype(np.int32))
        total += len(flat)
    ends = np.cumsum(size)
    flat = np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return np.concatenate(held)[flat], size


def _pieces(text: str) -> Iterator[str]:
    """Pieces of about PIECE characters that end at white space."""
    low = 0
    while len(text) - low > 2 * PIECE:
        found = re.compile(r"[ \n\t]").search(text, low + PIECE)
        high = found.end() if found else len(text)
        yield text[low:high]
        low = high
    yield text[low:]


def _units(vocabulary: Vocabulary, row: int, text: str) -> Iterator[tuple[int, str, int]]:
    """(row, text, -1) or, for a special token, (row, '', its id)."""
    at = 0
    for m in vocabulary.special_pattern.finditer(text) if "<|" in text or not vocabulary.special else ():
        yield from ((row, p, -1) for p in _pieces(text[at : m.start()]))
        yield row, "", vocabulary.special[m[0]]
        at = m.end()
    yield from ((row, p, -1) for p in _pieces(text[at:]))


def encoded(vocabulary: Vocabulary, lexicon: Lexicon, texts: Iterator[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) in order, one or more for each text."""

    def flush(units: list[tuple[int, str, int]]) -> Iterator[tuple[int, np.ndarray]]:
        words = cut_words([t for _, t, _ in units])
        ids, size = encode_words(vocabulary, lexicon, words)
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(words.counts)))]
        for (row, _, special), a, b in zip(units, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield row, (ids[a:b] if special < 0 else np.array([special], dtype=np.int32))

    units, held = [], 0
    for row, text in enumerate(texts):
        for unit in _units(vocabulary, row, text):
            units.append(unit)
            held += len(unit[1]) + 1
            if held >= PIECE:
                yield from flush(units)
                units, held = [], 0
    if units:
        yield from flush(units)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n long): counts of the frequent words of all texts (Misra-Gries counters, one set for each task)."""
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def add(texts: list[str]) -> None:
            words = cut_words(texts)
            fit = np.flatnonzero(words.lengths <= TOGETHER)
            for once, _, back in _distinct(words, fit):
                for w, n in zip(map(bytes, once), np.bincount(back).tolist(), strict=True):
                    counts[w] += n
            if len(counts) > 2 * COUNTERS:
                least = heapq.nlargest(COUNTERS, counts.values())[-1]
                for w in [w for w, n in counts.items() if n <= least]:
                    del counts[w]
                for w in counts:
                    counts[w] -= least

        held: list[str] = []
        size = 0
        for batch in batches:
            for value in batch.column(0):
                for piece in _pieces(value.as_py()):
                    held.append(piece)
                    size += len(piece) + 1
                    if size >= PIECE:
                        add(held)
                        held, size = [], 0
        if held:
            add(held)
        top = heapq.nlargest(COUNTERS, counts.items(), key=lambda x: (x[1], x[0]))
        counts.clear()
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    return source.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(vocabulary: Vocabulary, docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the ``words`` most frequent words of all texts.

    Only words with over 1 / (4 * words) of all counts are gathered, so at most 4 * words rows leave all tasks together.
    """
    counts = materialize(word_counts(docs, text))
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.where(F.col("n") * (4 * words) > total).orderBy(F.col("n").desc(), F.col("word")).limit(words).collect()
    return compile_lexicon({w: vocabulary.merge_one(w) for w in (bytes(r["word"]) for r in top)})


class _Worker:
    """A worker process's lexicon, by the broadcast's digest."""

    held: dict[bytes, Lexicon] = {}

    @classmethod
    def get(cls, lexicon: bytes) -> Lexicon:
        key = hashlib.sha256(lexicon).digest()
        if key not in cls.held:
            cls.held.clear()
            cls.held[key] = Lexicon.from_bytes(lexicon)
        return cls.held[key]


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", ident: str = "doc_id", ids: bool = True, lexicon: bytes | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and with ``ids`` the array ``ids``, for every row.

    Ids are those of the tokenizers library without added special tokens; special tokens that a text spells out are found
    as that library finds them. The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded
    text. Defined cases: a null or empty text has no tokens and the digests of nothing; texts of any length are encoded
    whole; rows are independent, so repeated rows give equal results and an empty table stays empty; other columns are
    ignored. ``lexicon`` changes the speed only.
    """
    with open(vocabulary_path, "rb") as f:
        blob = f.read()
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    known = Vocabulary(blob)
    shared = context.broadcast((known, build_lexicon(known, docs, text) if lexicon is None else lexicon))
    source = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, lexicon = shared.value[0], _Worker.get(shared.value[1])
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in range(part.num_rows)]
                count, kept = [0] * part.num_rows, [[] for _ in range(part.num_rows)]
                for row, found in encoded(vocabulary, lexicon, (x.as_py() for x in part.column(1))):
                    if len(found):
                        hashes[row][0].update(found.astype("<u4").tobytes())
                        hashes[row][1].update((b" " if count[row] else b"") + b" ".join(vocabulary.tokens[found].tolist()))
                        count[row] += len(found)
                        if ids:
                            kept[row].append(found)
                columns = [part.column(0), pa.array(count, pa.int64()), pa.array([a.hexdigest() for a, _ in hashes]), pa.array([b.hexdigest() for _, b in hashes])]
                if ids:
                    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                    flat = np.concatenate([y for x in kept for y in x] or [np.empty(0, dtype=np.int32)])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
        release_memory()

    fields = [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return source.mapInArrow(run, T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids))


def decode(rows: DataFrame, vocabulary_path: str, ids: str = "ids", ident: str = "doc_id") -> DataFrame:
    """(doc_id, text): tokens joined as the library joins them without a decoder, special tokens included. Null ids: empty."""
    with open(vocabulary_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))
    source = rows.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(ids), F.expr("cast(array() as array<int>)")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for batch in batches:
            made = [b" ".join(tokens[np.asarray(x.as_py(), dtype=np.int64)].tolist()).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("text", T.StringType())]))
