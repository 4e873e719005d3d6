"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments, each padded to the 23 bits of the perfect binary Golay code. A
segment's keys are the codewords that the segment and its 23 one-bit neighbours decode to - one or six. Two segments that
differ in at most two bits have a common point at distance one, so they share a key. Of two errors over three segments at
least one segment has none: the join key is (which segment is exact, its bits, a codeword near the segment that follows),
and every candidate is verified by counting the differing bits.

Equal fingerprints are one vertex. A key under which few vertices meet is joined to itself. Under a key where many meet
no pairs are made: each such vertex is linked to the 65 points within one bit of it, and vertices that meet in a point are
within two bits of each other - the same links without the square. Components come from alternating large-star and
small-star steps, checkpointed each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from cueloom.llm.common import Scratch, free_name, materialize, small_batches

SEED = 42
#: Fixed value: generator polynomial of the (23, 12) Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
#: Lowest bit and width of the segments of 64 bits.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Vertices under one key up to which pairs are made.
PAIRWISE = 24


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = np.array(words, dtype=np.int64)
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def coset_leaders() -> np.ndarray:
    """The error of weight at most three behind each of the 2048 syndromes (the code is perfect)."""
    errors = np.array([sum(1 << b for b in bits) for weight in range(4) for bits in combinations(range(23), weight)], dtype=np.int64)
    leaders = np.empty(2048, dtype=np.int64)
    leaders[syndrome(errors)] = errors
    return leaders


LEADERS = coset_leaders()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the only codeword within three bits (its upper bits; the code is systematic there)."""
    return (words ^ LEADERS[syndrome(words)]) >> 11


def near_indices(words: np.ndarray) -> np.ndarray:
    """(n, 24): indices that a word and its one-bit neighbours decode to, ascending, repeats as -1."""
    found = np.sort(np.stack([decode(words), *(decode(words ^ (1 << bit)) for bit in range(23))], axis=1), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """SimHash over word shingles of whole UTF-8 bytes, repeats included; no words: zero."""
    words = (data or b"").lower().split()  # on bytes both are ASCII only
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size, joined, digest = min(shingle, len(words)), b" ".join(words), xxhash.xxh64_intdigest
    counts, total = np.zeros(64, dtype=np.int64), len(words) - size + 1
    for low in range(0, total, 16384):  # bounded memory for texts of any length
        high = min(total, low + 16384)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[low:high].tolist(), ends[low + size - 1 : high + size - 1].tolist(), strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """``docs`` without ``text`` and with ``out``, the fingerprint as a signed long."""
    others = [c for c in docs.columns if c != text]
    name = free_name(others, "_text")
    small_batches(docs.sparkSession)
    source = docs.select(*others, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias(name))
    schema = T.StructType([*[source.schema[c] for c in others], T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(name)
            made = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns) if i != at], pa.array(made, pa.int64())], [*others, out])

    return source.mapInArrow(run, schema)


def golay_keys(classes: DataFrame, fp: str = "fp") -> DataFrame:
    """(key, fp): 3 to 18 rows for each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 20_000):
                signed = batch.column(0).slice(low, 20_000).to_numpy(zero_copy_only=False)
                bits = signed.view(np.uint64)
                parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
                keys, whose = [], []
                for i in range(3):
                    near = near_indices(parts[(i + 1) % 3])
                    row, col = np.nonzero(near >= 0)
                    keys.append((i << 36) | (parts[i][row] << 12) | near[row, col])
                    whose.append(signed[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(whose))], ["key", "fp"])

    return classes.select(fp).mapInArrow(run, "key long, fp long")


def _anew(name: str) -> Column:
    """The same value under an expression of its own, so that a join shuffles it again and may divide crowded keys."""
    return F.col(name).bitwiseXOR(F.lit(0).cast("long"))


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(classes: DataFrame) -> DataFrame:
    """Edges (u, v) whose connected components are those of all pairs of distinct ``fp`` within two bits.

    Small keys give the verified pairs themselves; vertices under a crowded key give stars around the points they share.
    """
    keyed = materialize(golay_keys(classes))
    crowd = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_anew("key").alias("c_key"), "n")
    sized = materialize(keyed.join(crowd, F.col("key") == F.col("c_key")).select("key", "fp", "n"))
    small = sized.where(F.col("n") <= PAIRWISE)
    pairs = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (_differing("a", "b") <= 2))
        .select("a", "b")
        .distinct()
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1).cast("long") if b == 0 else F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)])
    points = sized.where(F.col("n") > PAIRWISE).select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # within a point the least vertex is the centre: at most 65 vertices meet in one
    centre = W.partitionBy("point")
    stars = points.withColumn("a", F.min("fp").over(centre)).where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): for every vertex of ``edges`` (a, b) that isn't the least of its component, that least vertex.

    Alternating large-star and small-star steps until the edges are stars, each written to the shared folder. Where a side
    is too large to be broadcast, a step joins through a sort-merge join, whose crowded keys adaptive execution divides;
    minima are combined before they are shuffled.
    """
    scratch = Scratch(edges.sparkSession)
    now, before = scratch.store(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()), None
    while True:
        # large star: the greater neighbours of a vertex go to its least neighbour
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(_anew("v").alias("c"), F.least("v", "m").alias("m"))
        large = scratch.store(both.where("u > v").join(least, F.col("v") == F.col("c")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        # small star: the lesser neighbours of a vertex go to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m")).select(_anew("v").alias("c"), "m")
        joined = large.join(least, F.col("v") == F.col("c"))
        now = scratch.store(joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select(F.col("c").alias("v"), F.col("m").alias("u"))).distinct())
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if seen == before:
            scratch.drop_all_but_last()
            return now.select("v", F.col("u").alias("root"))
        before = seen


def near_groups(docs: DataFrame, text: str = "text", ident: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: fingerprints link at two or fewer differing bits.

    component_id is the smallest identifier in the row's connected component, the row's own included.
    Defined cases: null and empty texts and texts without words have fingerprint zero and link like any other; fewer words
    than a shingle make one shingle of all of them; a null identifier never becomes a component_id unless all of the
    component are null; rows that repeat an identifier are separate rows; an empty table gives an empty table.
    """
    made = materialize(fingerprints(docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")), shingle=shingle))
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(classes))
    rooted = roots.join(classes, roots["v"] == classes["fp"]).select("fp", "root", "rep")
    heads = classes.join(roots.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").select("fp", F.col("fp").alias("root"), "rep")
    members = rooted.union(heads)
    smallest = members.groupBy("root").agg(F.min("rep").alias("component_id")).select(_anew("root").alias("s_root"), "component_id")
    grouped = members.join(smallest, F.col("root") == F.col("s_root")).select(F.col("fp").alias("g_fp"), "component_id")
    named = classes.join(grouped, F.col("fp") == F.col("g_fp"), "left").select(_anew("fp").alias("c_fp"), F.coalesce("component_id", "rep").alias("component_id"))
    return made.join(named, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")
