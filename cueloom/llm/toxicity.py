"""Toxicity scores of texts that a noisy-channel decoder has restored.

Words may be disguised: letters written as digits or symbols, letters repeated, letters set apart by spaces or marks. A
disguised stretch becomes a lattice - each symbol may stand for some letters or for nothing, each run of a letter for one or
two - and Viterbi decoding under a character trigram model takes the likeliest path, which replaces the stretch. A stretch
without disguise has one path only, which is itself, so only disguised ones are decoded. The trigram counts come from all
texts, mixed with those of the words that mark toxic rows.

The classifier is a logistic regression over whether a restored text has certain words and word beginnings; training rows
are restored in the same way. The features are chosen by their log-likelihood ratio between toxic and clean training rows:
CHOSEN of the CANDIDATES that most toxic rows have. Training rows are a bounded sample of the labelled ones (POSITIVES and
NEGATIVES rows at most, those with the least hash of the identifier). All else covers all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cueloom.llm.common import free_name, materialize, release_memory, small_batches

#: Labelled rows of each kind that the classifier is fitted on, at most.
POSITIVES, NEGATIVES = 6_000, 12_000
#: Candidate features, those chosen, and the lengths of word beginnings.
CANDIDATES, CHOSEN, BEGINNINGS = 60_000, 512, range(3, 9)
#: A text is toxic from this score on.
THRESHOLD = 0.3

#: Letters that a symbol may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c", "<": "c",
}
#: Negative log probabilities of the channel: a letter written as a symbol, a symbol put in, letters set apart by marks, a
#: vowel masked by a star, a letter repeated, one of a pair that is dropped; a mark that stands between words.
AS_SYMBOL, PUT_IN, SET_APART, MASKED, REPEATED, DROPPED, BETWEEN = 0.7, 6.0, 0.5, 1.5, 0.7, 3.0, 1.0

WORDS = re.compile(r"[^\W\d_]+")
_SIGN, _MARKS = re.escape("".join(STANDS_FOR)), r".\-_*~"
#: In lower-cased text: single letters or symbols apart by the same blanks or marks; a run of letters, symbols and marks with
#: a symbol or inner mark in it; a word with a letter three times. Each begins only where its run begins, so the search is
#: linear in the text.
DISGUISED = re.compile(
    rf"(?<![^\W_])[a-z{_SIGN}]([ {_MARKS}]{{1,3}})[a-z{_SIGN}](?:\1[a-z{_SIGN}])+(?![^\W_])"
    rf"|(?<![a-z{_SIGN}{_MARKS}])[a-z{_MARKS}]*+[{_SIGN}][a-z{_SIGN}{_MARKS}]*+"
    rf"|(?<![a-z{_SIGN}{_MARKS}])[a-z]++[{_MARKS}]++[a-z][a-z{_MARKS}]*+"
    r"|(?<![^\W_])[a-z]*([a-z])\2\2[a-z]*(?![^\W_])"
)
#: RE2, passes every text that DISGUISED has a stretch in.
MAYBE = (
    rf"[A-Za-z{_SIGN}][ {_MARKS}]{{1,3}}[A-Za-z{_SIGN}][ {_MARKS}]{{1,3}}[A-Za-z{_SIGN}]|[A-Za-z][{_SIGN}{_MARKS}]+[A-Za-z]|[{_SIGN}][{_MARKS}]*[A-Za-z]|[A-Za-z][{_MARKS}]*[{_SIGN}]|"
    + "|".join(f"(?i:{c}{c}{c})" for c in "abcdefghijklmnopqrstuvwxyz")
)
#: Words with a letter twice.
DOUBLED = re.compile(r"(?<![^\W_])[a-z]*([a-z])\1[a-z]*(?![^\W_])")
_RUNS = re.compile(r"(.)\1+", re.DOTALL)

LETTERS = 27  # the border, then a to z


class CharModel:
    """Trigram model over a-z and word borders, interpolated with lower orders."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
        two, one = three.sum(0), three.sum((0, 1))
        flat = (one + 1) / (one.sum() + LETTERS)
        pair = (two + 8 * flat) / (two.sum(1, keepdims=True) + 8)
        self.cost = (-np.log((three + 4 * pair[None]) / (three.sum(2, keepdims=True) + 4))).tolist()

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The cheapest reading of a lattice of (letters, cost) arcs; a space is a word border. Linear in its length."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for arcs in lattice:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (spent, read) in states.items():
                for letters, extra in arcs:
                    x, y, cost = a, b, spent + extra
                    for letter in letters:
                        z = 0 if letter == " " else ord(letter) - 96
                        cost += self.cost[x][y][z]
                        x, y = (y, z) if z else (0, 0)
                    held = after.get((x, y))
                    if held is None or cost < held[0]:
                        after[x, y] = cost, (read, letters)
            states = after
        (a, b), (_, path) = min(states.items(), key=lambda s: (s[1][0] + self.cost[s[0][0]][s[0][1]][0], s[0]))
        out = []
        while path is not None:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))


def lattice_of(stretch: str) -> list[list[tuple[str, float]]]:
    out = []
    for m in re.finditer(r"(.)\1*", stretch.lower(), re.DOTALL):
        c, n = m[1], m.end() - m.start()
        if "a" <= c <= "z":
            out.append([(c, 0.0)] if n == 1 else [(c, DROPPED if n == 2 else REPEATED), (2 * c, 0.0 if n == 2 else REPEATED)])
        elif c in STANDS_FOR:
            out.append([(s, AS_SYMBOL + REPEATED * (n > 1)) for s in STANDS_FOR[c]] + [(2 * s, 2 * AS_SYMBOL) for s in STANDS_FOR[c] if n > 1] + [("", PUT_IN)])
        else:
            out.append([("", SET_APART), (" ", BETWEEN)] + [(v, MASKED) for v in "aeiou" if c == "*" and n == 1])
    return out


def _disguised(stretch: str) -> str:
    """The part of a found stretch to decode, or nothing: words with a sentence's marks around them aren't disguised, nor are
    compounds of longer words, nor is what has no letter."""
    core = stretch if " " in stretch else stretch.lstrip("(<.-_~*").rstrip("!.-_~*")
    if core.isalpha():
        return core if _RUNS.search(core) and len(max(_RUNS.finditer(core), key=lambda m: len(m[0]))[0]) > 2 else ""
    parts = re.split(rf"[{_MARKS}]+", core)
    if "*" not in core and all(len(p) > 2 and p.isalpha() for p in parts):
        return ""
    return core if any("a" <= c <= "z" for c in core) else ""


def _read(stretch: str, model: CharModel, cache: dict[str, str]) -> str:
    read = cache.get(stretch)
    if read is None:
        if len(cache) >= 20_000:
            cache.clear()
        read = cache[stretch] = model.decode(lattice_of(stretch))
    return read


def restored(text: str, model: CharModel, cache: dict[str, str]) -> str:
    """Lower-cased text with every disguised stretch replaced by its likeliest reading."""
    low, out, at = text.lower(), [], 0
    for m in DISGUISED.finditer(low):
        if core := _disguised(m[0]):
            out += [low[at : m.start()], " ", _read(core, model, cache), " "]
            at = m.end()
    return "".join([*out, low[at:]]) if out else low


def trigram_counts(words: Iterable[str]) -> np.ndarray:
    return _count_bytes(" ".join(words).encode())


@lru_cache(1)
def _letter_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = np.arange(1, LETTERS)
    return table


def _count_bytes(data: bytes) -> np.ndarray:
    at = _letter_table()[np.frombuffer(b"  " + data + b" ", dtype=np.uint8)]
    # after a border the one before it doesn't matter
    first = np.where(at[1:-1] == 0, 0, at[:-2])
    return np.bincount((first * LETTERS + at[1:-1]) * LETTERS + at[2:], minlength=LETTERS**3)


def corpus_trigrams(docs: DataFrame, text: str) -> np.ndarray:
    """Trigram counts over all texts (19,683 numbers, summed on the executors)."""
    source = docs.select(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LETTERS**3, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                data = value.as_py()
                for low in range(0, len(data), 1 << 20):
                    counts += _count_bytes(data[low : low + (1 << 20)])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["gram", "n"])

    out = np.zeros(LETTERS**3, dtype=np.int64)
    for row in source.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


def features(words: Iterable[str]) -> set[str]:
    """Words (marked =), word beginnings, and beginnings that two or four different words share (marked #)."""
    once, begun = set(words), Counter()
    for w in once:
        for k in BEGINNINGS:
            if len(w) < k:
                break
            begun[w[:k]] += 1
    return {w + "=" for w in once} | begun.keys() | {f"{b}#{n}" for b, c in begun.items() if c > 1 for n in (2, 4) if c >= n}


def held_out(ident: Column) -> Column:
    """Rows that never train: crc32 of the identifier as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """What scoring takes to every worker: weights of features, the intercept and the character model's counts."""

    def __init__(self, weights: dict[str, float], intercept: float, grams: np.ndarray) -> None:
        self.weights, self.intercept, self.grams = weights, intercept, grams
        self.whole = {k[:-1] for k in weights if k.endswith("=")}
        self.heads = {k[:3] for k in weights if not k.endswith("=")}
        self.squeezed = {_RUNS.sub(r"\1", k[:-1]) for k, w in weights.items() if k.endswith("=") and w > 0 and len(k) > 4}

    def score(self, words: set[str]) -> float:
        some = [w for w in words if w in self.whole or w[:3] in self.heads]
        z = self.intercept + math.fsum(self.weights.get(f, 0.0) for f in features(some)) if some else self.intercept
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sampled(docs: DataFrame, labels: DataFrame, text: str, ident: str) -> DataFrame:
    """(body, toxic) of the training rows; copies of a text are one row, toxic if one of them is."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("l_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(f"toxic = {t}").orderBy(F.xxhash64("l_id"), "l_id").limit(n) for t, n in ((1, POSITIVES), (0, NEGATIVES))]
    # POSITIVES + NEGATIVES rows of 12 bytes at most
    return docs.select(F.col(ident).alias("d_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(drawn[0].unionAll(drawn[1])), F.col("d_id") == F.col("l_id")).groupBy("body").agg(F.max("toxic").alias("toxic"))


def _positive_features(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for body in batch.column(0):
                counts.update(features(WORDS.findall(body.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["f", "n"])

    return rows.where("toxic = 1").select("body").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _counted(rows: DataFrame, listed: list[str], emit_rows: bool) -> DataFrame:
    """Counts of listed features in clean rows, or each row's listed features."""
    shared = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(listed)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = shared.value, np.zeros(len(listed), dtype=np.int64)
        for batch in batches:
            found = [[at[f] for f in features(WORDS.findall(body.as_py())) if f in at] for body in batch.column(0)]
            if emit_rows:
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])
            else:
                for x in found:
                    counts[x] += 1
        if not emit_rows:
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["i", "n"])

    if emit_rows:
        return rows.select("body", "toxic").mapInArrow(run, "toxic int, found array<int>")
    return rows.where("toxic = 0").select("body").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))


def _ratio(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> np.ndarray:
    """Signed log-likelihood ratio of presence among toxic and clean rows."""
    def term(k: np.ndarray, n: float) -> np.ndarray:
        p = np.clip(k / n, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = np.clip((n1 + n0) / (all1 + all0), 1e-12, 1 - 1e-12)
    shared = (n1 + n0) * np.log(both) + (all1 + all0 - n1 - n0) * np.log(1 - both)
    return np.sign(n1 / all1 - n0 / all0) * 2 * (term(n1, all1) + term(n0, all0) - shared)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.15) -> tuple[np.ndarray, float]:
    """Weights and intercept by damped Newton steps over blocks of rows; the intercept isn't shrunk."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, len(x), 2048):
            part = x[low : low + 2048].astype(np.float64)
            yield np.concatenate((part, np.ones((len(part), 1))), axis=1), y[low : low + 2048]

    def loss(v: np.ndarray) -> float:
        return sum(float((np.logaddexp(0, a @ v) - b * (a @ v)).sum()) for a, b in rows()) + float((shrink * v * v).sum()) / 2

    now = loss(w)
    for _ in range(30):
        slope, curve = shrink * w, np.diag(shrink)
        for a, b in rows():
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope = slope + a.T @ (p - b)
            curve = curve + (a * (p * (1 - p))[:, None]).T @ a
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and (ahead := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - ahead < 1e-7 * max(1.0, now):
            break
        w, now = w - size * step, ahead
    return w[:-1], float(w[-1])


def _restored_rows(rows: DataFrame, grams: np.ndarray) -> DataFrame:
    """(body, toxic) with restored bodies."""
    shared = rows.sparkSession.sparkContext.broadcast(Model({}, 0.0, grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, cache = _char_model(shared.value), _cache()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([restored(x.as_py(), chars, cache) for x in batch.column(0)], pa.string()), batch.column(1)], ["body", "toxic"])

    return rows.select("body", "toxic").mapInArrow(run, "body string, toxic int")


def _chosen(rows: DataFrame, all1: int, all0: int) -> list[str]:
    """The features that tell toxic rows best, best first."""
    least = max(2 if all1 < 100 else 3, all1 // 200)
    top = _positive_features(rows).where(F.col("n") >= least).orderBy(F.col("n").desc(), "f").limit(CANDIDATES).toArrow()
    listed, n1 = top["f"].to_pylist(), top["n"].to_numpy().astype(np.float64)
    n0, seen = np.zeros(len(listed)), _counted(rows, listed, False).toArrow()
    n0[seen["i"].to_numpy()] = seen["n"].to_numpy()
    gain = _ratio(n1, n0, all1, all0)
    order = sorted(range(len(listed)), key=lambda i: (-gain[i], listed[i]))
    return [listed[i] for i in order[:CHOSEN] if gain[i] > 10]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id") -> Model:
    """A model from all texts and the labelled ones of ``docs``; without toxic training rows it scores all alike."""
    small_batches(docs.sparkSession)
    grams = corpus_trigrams(docs, text)
    rows = materialize(_sampled(docs, labels, text, ident).withColumn("body", F.lower("body")))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    all1, all0 = sizes.get(1, 0), sizes.get(0, 0)
    if not all1 or not all0:
        return Model({}, 30.0 if all1 else -30.0, grams)
    # disguises are of words that tell toxic rows: their trigrams weigh a quarter as much as the corpus'
    own = trigram_counts(f[:-1] for f in _chosen(rows, all1, all0) if f.endswith("=") and f[:-1].isascii() and len(f) > 4)
    grams = grams + own * max(1, int(grams.sum() / 4 / max(1, own.sum())))
    rows = materialize(_restored_rows(rows, grams))
    chosen = _chosen(rows, all1, all0)
    if not chosen:
        return Model({}, math.log(all1 / all0), grams)
    held = _counted(rows, chosen, True).toArrow().combine_chunks()
    x, y = np.zeros((held.num_rows, len(chosen)), dtype=np.float32), held["toxic"].to_numpy().astype(np.float64)
    for k, found in enumerate(held["found"]):
        x[k, found.values.to_numpy()] = 1
    order_rows = np.lexsort((*x.T[:64], y))  # the same sums whatever order the rows came in
    weights, intercept = _logistic(x[order_rows], y[order_rows])
    weights = dict(zip(chosen, np.round(weights, 6).tolist(), strict=True))
    del x, y, held
    release_memory()
    return Model(weights, round(intercept, 6), grams)


def score(self, words: set[str]) -> float:
        some = [w for w in words if w in self.whole or w[:3] in self.heads]
        z = self.intercept + math.fsum(self.weights.get(f, 0.0) for f in features(some)) if some else self.intercept
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sampled(docs: DataFrame, labels: DataFrame, text: str, ident: str) -> DataFrame:
    """(body, toxic) of the training rows; copies of a text are one row, toxic if one of them is."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("l_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(f"toxic = {t}").orderBy(F.xxhash64("l_id"), "l_id").limit(n) for t, n in ((1, POSITIVES), (0, NEGATIVES))]
    # POSITIVES + NEGATIVES rows of 12 bytes at most
    return docs.select(F.col(ident).alias("d_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(drawn[0].unionAll(drawn[1])), F.col("d_id") == F.col("l_id")).groupBy("body").agg(F.max("toxic").alias("toxic"))


def _positive_features(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for body in batch.column(0):
                counts.update(features(WORDS.findall(body.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["f", "n"])

    return rows.where("toxic = 1").select("body").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _counted(rows: DataFrame, listed: list[str], emit_rows: bool) -> DataFrame:
    """Counts of listed features in clean rows, or each row's listed features."""
    shared = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(listed)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = shared.value, np.zeros(len(listed), dtype=np.int64)
        for batch in batches:
            found = [[at[f] for f in features(WORDS.findall(body.as_py())) if f in at] for body in batch.column(0)]
            if emit_rows:
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])
            else:
                for x in found:
                    counts[x] += 1
        if not emit_rows:
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["i", "n"])

    if emit_rows:
        return rows.select("body", "toxic").mapInArrow(run, "toxic int, found array<int>")
    return rows.where("toxic = 0").select("body").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))


def _ratio(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> np.ndarray:
    """Signed log-likelihood ratio of presence among toxic and clean rows."""
    def term(k: np.ndarray, n: float) -> np.ndarray:
        p = np.clip(k / n, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = np.clip((n1 + n0) / (all1 + all0), 1e-12, 1 - 1e-12)
    shared = (n1 + n0) * np.log(both) + (all1 + all0 - n1 - n0) * np.log(1 - both)
    return np.sign(n1 / all1 - n0 / all0) * 2 * (term(n1, all1) + term(n0, all0) - shared)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.15) -> tuple[np.ndarray, float]:
    """Weights and intercept by damped Newton steps over blocks of rows; the intercept isn't shrunk."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, len(x), 2048):
            part = x[low : low + 2048].astype(np.float64)
            yield np.concatenate((part, np.ones((len(part), 1))), axis=1), y[low : low + 2048]

    def loss(v: np.ndarray) -> float:
        return sum(float((np.logaddexp(0, a @ v) - b * (a @ v)).sum()) for a, b in rows()) + float((shrink * v * v).sum()) / 2

    now = loss(w)
    for _ in range(30):
        slope, curve = shrink * w, np.diag(shrink)
        for a, b in rows():
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope = slope + a.T @ (p - b)
            curve = curve + (a * (p * (1 - p))[:, None]).T @ a
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and (ahead := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - ahead < 1e-7 * max(1.0, now):
            break
        w, now = w - size * step, ahead
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id") -> Model:
    """A model from all texts and the labelled ones of ``docs``; without toxic training rows it scores all alike."""
    small_batches(docs.sparkSession)
    grams = corpus_trigrams(docs, text)
    rows = materialize(_sampled(docs, labels, text, ident))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    all1, all0 = sizes.get(1, 0), sizes.get(0, 0)
    if not all1 or not all0:
        return Model({}, 30.0 if all1 else -30.0, grams)
    least = max(2 if all1 < 100 else 3, all1 // 200)
    top = _positive_features(rows).where(F.col("n") >= least).orderBy(F.col("n").desc(), "f").limit(CANDIDATES).toArrow()
    listed, n1 = top["f"].to_pylist(), top["n"].to_numpy().astype(np.float64)
    n0, seen = np.zeros(len(listed)), _counted(rows, listed, False).toArrow()
    n0[seen["i"].to_numpy()] = seen["n"].to_numpy()
    gain = _ratio(n1, n0, all1, all0)
    order = sorted(range(len(listed)), key=lambda i: (-gain[i], listed[i]))
    chosen = [listed[i] for i in order[:CHOSEN] if gain[i] > 10]
    if not chosen:
        return Model({}, math.log(all1 / all0), grams)
    held = _counted(rows, chosen, True).toArrow().combine_chunks()
    x, y = np.zeros((held.num_rows, len(chosen)), dtype=np.float32), held["toxic"].to_numpy().astype(np.float64)
    for k, found in enumerate(held["found"]):
        x[k, found.values.to_numpy()] = 1
    order_rows = np.lexsort((*x.T[:64], y))  # the same sums whatever order the rows came in
    weights, intercept = _logistic(x[order_rows], y[order_rows])
    weights = dict(zip(chosen, np.round(weights, 6).tolist(), strict=True))
    del x, y, held, top
    release_memory()
    # disguises are of toxic words: their trigrams weigh a quarter as much as the corpus'
    words = [f[:-1] for f, w in weights.items() if f.endswith("=") and w > 0 and f[:-1].isascii() and len(f) > 4]
    own = trigram_counts(words)
    return Model(weights, round(intercept, 6), grams + own * max(1, int(grams.sum() / 4 / max(1, own.sum()))))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the score of every whole text, from 0 to 1.

    Defined cases: null and empty texts score as a text without any of the features; texts of any length are read whole;
    rows are independent, so repeated rows score alike and an empty table stays empty; a column named ``out`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        held = shared.value
        chars, cache = _char_model(held), _cache()
        maybe = pc.match_substring_regex(texts, MAYBE)
        made = []
        for value, disguise in zip(texts, maybe.to_pylist(), strict=True):
            body = value.as_py()
            low = restored(body, chars, cache) if disguise else body.lower()
            words = set(WORDS.findall(low))
            if held.squeezed:
                for m in DOUBLED.finditer(low):  # a doubled letter is a disguise where the word without it tells something
                    if m[0] not in held.whole and _RUNS.sub(r"\1", m[0]) in held.squeezed:
                        words.discard(m[0])
                        words.update(_read(m[0], chars, cache).split())
            made.append(held.score(words))
        return pa.array(made, pa.float64())

    return docs.withColumn(out, scored(F.coalesce(F.col(text), F.lit(""))))


_held: list = []


def _char_model(model: Model) -> CharModel:
    if not _held or _held[0] is not model:
        _held[:] = [model, CharModel(model.grams), {}]
    return _held[1]


def _cache() -> dict[str, str]:
    return _held[2]


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score is under THRESHOLD, with its columns."""
    name = free_name(docs.columns, "_score")
    return score(docs, fit(docs, labels, text, ident), text, name).where(F.col(name) < THRESHOLD).drop(name)
