"""URL filters through Bloom filter cascades.

A rule is a host and the beginning of a path; it fits the host, all its subdomains and every path that starts so. Of the
rules that fit a url the longest decides. A url therefore has a bounded set of candidate keys: host suffixes with as many
labels as some rule has, joined with path beginnings as long as some rule's.

The candidate keys of all urls are the key universe. Level 0 of a cascade is a Bloom filter of the listed keys; level 1 one
of the universe's keys that level 0 passes by mistake; level 2 one of the listed keys that level 1 passes, and so on until
a level makes no mistake. A key is listed exactly if it passes an odd number of levels before its first miss. That is exact
for every key of the universe, needs no join and no shuffle, and level 0 is sized so that about as many mistakes are left as
there are listed keys: a cascade takes O(rules * log(universe / rules)) bits, whatever the corpus holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cueloom.llm.common import ascii_lower, free_name

_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = values + np.uint64((salt * int(_SPREAD[0])) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _SPREAD[1]
        x = (x ^ (x >> np.uint64(27))) * _SPREAD[2]
        return x ^ (x >> np.uint64(31))


class Bloom:
    def __init__(self, hashes: np.ndarray, bits_per_key: float, salt: int) -> None:
        self.bits, self.rounds, self.salt = max(64, math.ceil(len(hashes) * bits_per_key)), max(1, round(bits_per_key * math.log(2))), salt
        self.field = np.zeros(self.bits, dtype=bool)
        for at in self._places(hashes):
            self.field[at] = True
        self.field = np.packbits(self.field)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        first, second = _mixed(hashes, 2 * self.salt + 1), _mixed(hashes, 2 * self.salt + 2) | np.uint64(1)
        with np.errstate(over="ignore"):
            for i in range(self.rounds):
                yield ((first + np.uint64(i) * second) % np.uint64(self.bits)).astype(np.int64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for at in self._places(hashes):
            found &= (self.field[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return found


class Cascade:
    """Exact membership for the keys it was built over; takes and returns arrays over 64-bit key hashes."""

    def __init__(self, listed: np.ndarray, first: Bloom, mistakes: np.ndarray) -> None:
        self.levels, inside, outside = [first], listed, mistakes
        while len(outside):
            self.levels.append(Bloom(outside, 3.0, len(self.levels)))
            inside, outside = outside, inside[self.levels[-1].passes(inside)]

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        depth, alive = np.zeros(len(hashes), dtype=np.int64), np.ones(len(hashes), dtype=bool)
        for level in self.levels:
            alive[alive] = level.passes(hashes[alive])
            depth[alive] += 1
        return depth % 2 == 1

    @property
    def size_bytes(self) -> int:
        return sum(len(x.field) for x in self.levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where there is no ``://``."""
    shown = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(shown, pattern, 1)), F.regexp_extract(shown, pattern, 2)


def candidates(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """array<string>: the keys under which a rule could fit, longest first, of equal ones that with the longer host."""
    labels, lengths = sorted({r.host.count(".") + 1 for r in rules}, reverse=True), sorted({len(r.path) for r in rules}, reverse=True)
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: (n <= F.size(parts)) & (host != "")), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    begins = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.left(path, n))
    made = F.flatten(F.transform(suffixes, lambda s: F.transform(begins, lambda b: F.struct((-F.length(s) - F.length(b)).alias("o"), (-F.length(s)).alias("h"), F.concat(s, b).alias("k")))))
    return F.transform(F.array_sort(made), lambda x: x["k"])


def _hashes(keys: Column, seed: int) -> Column:
    return F.transform(keys, lambda k: F.xxhash64(F.concat(F.lit(f"{seed}:"), k)))


def _driver_hashes(spark, keys: list[str], seed: int) -> np.ndarray:
    if not keys:
        return np.empty(0, dtype=np.uint64)
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64(F.concat(F.lit(f"{seed}:"), F.col("k")))).collect()
    return np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)


def _mistakes(keys: DataFrame, seed: int, filters: list[Bloom], lists: list[set[str]]) -> list[list[str]]:
    """For each filter the distinct keys of the universe (column k, arrays) that it passes though they aren't listed."""
    shared = keys.sparkSession.sparkContext.broadcast((filters, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms, listed = shared.value
        seen: list[set[str]] = [set() for _ in blooms]
        for batch in batches:
            hashes, names = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), batch.column(0).flatten()
            once, at = np.unique(hashes, return_index=True)
            for i, bloom in enumerate(blooms):
                seen[i] |= set(names.take(pa.array(at[bloom.passes(once)])).to_pylist()) - listed[i]
        found = [(i, k) for i, s in enumerate(seen) for k in sorted(s)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], ["i", "k"])

    wrong = keys.select("k", _hashes(F.col("k"), seed).alias("h")).mapInArrow(run, "i int, k string").distinct()
    out: list[list[str]] = [[] for _ in filters]
    for row in wrong.limit(sum(_bound(len(x)) for x in lists) + len(lists)).collect():
        out[row["i"]].append(row["k"])
    return out


def _bound(listed: int) -> int:
    """Mistakes of level 0 that the driver takes; with more, the level is built anew and larger."""
    return 4 * listed + 4096


def build(urls: DataFrame, lists: list[list[str]], rules: list[Rule], host: str = "host", path: str = "path") -> tuple[int, list[Cascade]]:
    """Cascades of key lists, exact over the candidate keys of all ``urls``; also the seed of the key hash."""
    spark, keys = urls.sparkSession, urls.select(candidates(F.col(host), F.col(path), rules).alias("k"))
    most = max(1, urls.count()) * max(1, len({r.host.count(".") for r in rules}) * len({len(r.path) for r in rules}))
    listed, seed, extra = [sorted(set(x)) for x in lists], 0, 2.0
    while True:
        own = [_driver_hashes(spark, x, seed) for x in listed]
        first = [Bloom(h, (math.log2(max(2.0, most / max(1, len(h)))) + extra) / math.log(2), 0) for h in own]
        wrong = _mistakes(keys, seed, first, [set(x) for x in listed])
        if any(len(w) > _bound(len(x)) for w, x in zip(wrong, listed, strict=True)):
            extra += 4
            continue
        others = [_driver_hashes(spark, w, seed) for w in wrong]
        if any(np.isin(a, b).any() or len(np.unique(b)) < len(b) for a, b in zip(others, own, strict=True)):
            seed += 1  # two keys with one hash can't be told apart
            continue
        return seed, [Cascade(a, f, b) for a, f, b in zip(own, first, others, strict=True)]


def judge(pages: DataFrame, rules: list[Rule], denied: Iterable[str] = (), url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of those names are replaced).

    ``denied`` are hosts that are blocked, with their subdomains, where no rule fits; any other url without a rule is
    allowed. Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; an
    empty path fits only rules without a path; repeated rows are judged alike; an empty table stays empty. A key that is
    both allowed and blocked is an error.
    """
    rules, hosts = list(rules), sorted(set(denied))
    allow, block = ([r.key for r in rules if r.verdict == v] for v in ("allow", "block"))
    if set(allow) & set(block):
        raise ValueError(f"both allowed and blocked: {sorted(set(allow) & set(block))}")
    every = rules + [Rule(h, "", "block") for h in hosts]
    added = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c.lower() not in added or c == url]
    source = free_name(kept + added, "_url")
    host, path = host_and_path(F.col(source))
    parsed = pages.select(*kept, F.col(url).alias(source)).withColumns({"host": host, "path": path})
    seed, cascades = build(parsed, [allow, block, hosts], every)
    shared = pages.sparkSession.sparkContext.broadcast(cascades)

    @F.arrow_udf("struct<place:int,blocked:boolean,denied:boolean>")
    def probe(hashes: pa.Array) -> pa.Array:
        allowed, blocked, refused = shared.value
        flat, ends = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(hashes.value_lengths()).cumsum()
        rows = len(hashes)
        once, back = np.unique(flat, return_inverse=True)
        is_block = blocked.listed(once)[back]
        hit, bad = (allowed.listed(once)[back]) | is_block, refused.listed(once)[back]
        starts = np.concatenate(([0], ends[:-1])) if rows else ends
        place, ban, none = np.full(rows, -1, dtype=np.int32), np.zeros(rows, dtype=bool), np.zeros(rows, dtype=bool)
        at = np.flatnonzero(hit)
        owner = np.searchsorted(ends, at, side="right")
        first = np.unique(owner, return_index=True)
        place[first[0]], ban[first[0]] = at[first[1]] - starts[first[0]], is_block[at[first[1]]]
        none[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = True
        return pa.StructArray.from_arrays([pa.array(place), pa.array(ban), pa.array(none)], ["place", "blocked", "denied"])

    keys, found = free_name(kept + added, "_keys"), free_name(kept + added, "_found")
    judged = parsed.withColumn(keys, candidates(F.col("host"), F.col("path"), every)).withColumn(found, probe(_hashes(F.col(keys), seed)))
    has_rule = F.col(found)["place"] >= 0
    return judged.select(
        *[c for c in kept if c not in added], "host", "path",
        F.when(has_rule, F.get(F.col(keys), F.col(found)["place"])).alias("rule"),
        F.when(F.when(has_rule, F.col(found)["blocked"]).otherwise(F.col(found)["denied"]), "block").otherwise("allow").alias("verdict"),
    )
