"""Near-duplicates at a Jaccard similarity of word shingles: Golay-code links first, then an exact filter for all the rest.

Candidates. Every text has a sketch, its SKETCH least shingle hashes. Texts of similarity t share nearly t of the least hashes
of their union, so those that have fewer than a threshold's worth of their sketch in other sketches are alone; the threshold
loses a pair with a probability of LOST at most (texts shorter than the sketch: none). For the others, whole shingle sets
are made, and shingles that stand in one of these sets only are dropped and counted: nobody shares them.

Links. The SimHash fingerprints of the candidates go through the Golay-code links of :mod:`simhash`. They find copies with
few differences; those of similarity t may differ in a sixth of all bits, which no keys of 64-bit fingerprints find without
loss. So shingles are put in one order, seldom ones first, and sets of similarity t and more share one of their first
|x| - ceil(t |x|) + 1 - that is, one of the few that remain there beside the dropped ones - whatever the difference is.
Rounds compare, under each such key, vertices that stand side by side in an order by minima of hashed shingles, a few partners
for each vertex, and connected ones become one component. At last all pairs of a key whose vertices are in
different components meet in a join whose condition holds what similarity t allows: sizes, dropped shingles on both sides,
and parity bitmaps of the others (sets that differ in n shingles differ in at most n bits). None of these turns down
a pair of t or more, and what passes is verified on the whole sets. Components of verified pairs are the groups.

Texts with equal shingle sets are one vertex.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cueloom.llm.common import Scratch, release_memory, small_batches, tidy
from cueloom.llm.simhash import SEED, _anew, components, fingerprint, links

#: Shingles of a sketch, and the probability with which it may miss a pair at the similarity asked for.
SKETCH, LOST = 64, 1e-11
#: Rounds that compare neighbours, the partners of a vertex in a round, and the vertices of a block of a crowded key.
ROUNDS, PARTNERS, BLOCK = 2, 4, 256
#: Keys before one that tell whether a pair has met already.
EARLIER = 16
#: Longs of a parity bitmap, one bit for each value of a hash's upper byte; orders of minima.
BITMAP, ORDERS = ("b0", "b1", "b2", "b3"), 16


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """Ascending distinct hashes of the word shingles of A-Z-lower-cased UTF-8 bytes; fewer words make one shingle."""
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    k = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64))


def least_shared(similarity: float) -> int:
    """Of a full sketch, how many shingles two texts of this similarity share but for a chance of LOST."""
    below = 0.0
    for s in range(SKETCH + 1):
        below += math.comb(SKETCH, s) * similarity**s * (1 - similarity) ** (SKETCH - s)
        if below > LOST:
            return s
    return SKETCH


def _lists(made: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*made, np.empty(0, dtype=np.uint64)]).view(np.int64)))


def _heads(source: DataFrame, size: int) -> DataFrame:
    """(id, mark, n, digest, sketch) of (id, mark, data): the size of every shingle set, its digest and its least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, least = [], [], []
            for x in batch.column(2):
                made = shingle_hashes(x.as_py(), size)
                n.append(len(made))
                digests.append(hashlib.blake2b(made.tobytes(), digest_size=16).digest())
                least.append(made[:SKETCH].copy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), _lists(least)], ["id", "mark", "n", "digest", "sketch"])
        release_memory()

    return source.mapInArrow(run, "id long, mark long, n int, digest binary, sketch array<long>")


def _sets(source: DataFrame, size: int) -> DataFrame:
    """(v, n, fp, shingles) of (v, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                texts = [x.as_py() for x in batch.column(1).slice(low, 256)]
                made = [shingle_hashes(x, size) for x in texts]
                marks = np.array([fingerprint(x, size) for x in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 256), pa.array([len(x) for x in made], pa.int32()), pa.array(marks), _lists(made)], ["v", "n", "fp", "shingles"])
        release_memory()

    return source.mapInArrow(run, "v long, n int, fp long, shingles array<long>")


def _minima(hashes: np.ndarray) -> list[int]:
    out = []
    for turn in range(1, ORDERS + 1):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * turn % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(int((mixed ^ (mixed >> np.uint64(31))).min().view(np.int64)))
    return out


def _live(shared: DataFrame, similarity: float) -> DataFrame:
    """(v, n, u, k, fp, minima, bitmap, shingles, crowds) of (v, n, fp, held): sets some of whose first shingles others have.

    held has (df, h) for every shingle that two sets or more have. u counts the others, which come first in the order; the
    first k of ``shingles`` are the set's keys, and ``crowds`` says how many sets have them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            sets, parities, crowds = [], [], []
            for v, n, fp, held in zip(*[batch.column(i) for i in range(4)], strict=True):
                size, both = n.as_py(), held.values
                hashes = both.field("h").to_numpy(zero_copy_only=False).view(np.uint64)
                df = both.field("df").to_numpy(zero_copy_only=False)
                order = np.lexsort((hashes, df))
                alone = size - len(hashes)
                keys = size - math.ceil(similarity * size - 1e-9) + 1 - alone
                if keys > 0:
                    for column, value in zip(out, (v.as_py(), size, alone, keys, fp.as_py(), _minima(hashes)), strict=True):
                        column.append(value)
                    sets.append(hashes[order])
                    crowds.append(df[order[:keys]].astype(np.uint64))
                    parities.append(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) & 1)
            bits = np.packbits(np.array(parities, dtype=np.uint8).reshape(-1, 256), axis=1, bitorder="little").view("<i8")
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            columns = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4)], _lists(sets), _lists(crowds)], ["v", "n", "u", "k", "fp", "minima", *BITMAP, "shingles", "crowds"])
        release_memory()

    return shared.select("v", "n", "fp", "held").mapInArrow(run, f"v long, n int, u int, k int, fp long, minima array<long>, {', '.join(f'{b} long' for b in BITMAP)}, shingles array<long>, crowds array<long>")


def _possible(x: dict[str, Column], y: dict[str, Column], similarity: float) -> Column:
    """Whether sets may be alike enough, by sizes, own shingles and, where given, parity; never false for those that are."""
    most = (1 - similarity) / (1 + similarity) * (x["n"] + y["n"]) + 1e-9  # shingles in which they may differ
    may = (F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]) - 1e-9) & (x["u"] + y["u"] <= most)
    if "b0" in x:
        may &= x["u"] + y["u"] + sum((F.bit_count(x[b].bitwiseXOR(y[b])) for b in BITMAP), F.lit(0)) <= most
    return may


def _sides(pairs: DataFrame, live: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with columns of both sides, named x_ and y_."""
    for side, name in (("a", "x"), ("b", "y")):
        own = live.select(_anew("v").alias(f"{name}_v"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
        pairs = pairs.join(own, F.col(side) == F.col(f"{name}_v"))
    return pairs


def _verified(pairs: DataFrame, live: DataFrame, similarity: float) -> DataFrame:
    """(a, b, alike): by the whole sets. A shingle of two sets is in the list of either."""
    both = _sides(pairs.select("a", "b"), live, "n", "shingles")
    shared = F.size(F.array_intersect("x_shingles", "y_shingles"))
    return both.select("a", "b", (shared >= similarity * (F.col("x_n") + F.col("y_n") - shared) - 1e-9).alias("alike"))


def _partners(pairs: DataFrame, live: DataFrame, similarity: float) -> DataFrame:
    """Of the possible ``pairs`` (a, b, c) PARTNERS for each vertex, those with the greatest c; the others stay open."""
    columns = ("n", "u", *BITMAP)
    both = _sides(pairs, live, *columns)
    may = both.where(_possible(*({n: F.col(f"{s}_{n}") for n in columns} for s in "xy"), similarity)).select("a", "b", "c")
    each = may.withColumn("v", F.explode(F.array("a", "b")))
    rank = F.row_number().over(W.partitionBy("v").orderBy(F.desc("c"), F.xxhash64("a", "b")))
    return each.withColumn("rank", rank).where(F.col("rank") <= PARTNERS).select("a", "b").distinct()


def _golay_pairs(live: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, c): vertices of equal fingerprints, and of fingerprints that Golay codes link."""
    classes = scratch.store(live.groupBy("fp").agg(F.min("v").alias("rep")))
    named = lambda fp, rep: classes.select(_anew("fp").alias(fp), F.col("rep").alias(rep))
    equal = live.select("fp", "v").join(named("e_fp", "rep"), F.col("fp") == F.col("e_fp")).where("v <> rep").select(F.col("rep").alias("a"), F.col("v").alias("b"))
    near = links(classes.select("fp")).withColumnsRenamed({"a": "l_a", "b": "l_b"}).join(named("a_fp", "a"), F.col("l_a") == F.col("a_fp")).join(named("b_fp", "b"), F.col("l_b") == F.col("b_fp"))
    return equal.union(near.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("c", F.lit(2**31).cast("long"))


def _labelled(live: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``live`` with ``comp``, the least vertex that a vertex is known to be connected with."""
    if roots is None:
        return live.withColumn("comp", F.col("v"))
    return live.join(roots.select(_anew("v").alias("r_v"), "root"), F.col("v") == F.col("r_v"), "left").withColumn("comp", F.coalesce("root", "v"))


def _neighbours(live: DataFrame, roots: DataFrame | None, turn: int, similarity: float) -> DataFrame:
    """(a, b, c): vertices of different components side by side in a block of c of their keys.

    Under each key another two of the minima order the vertices, so that much alike ones come together; both
    divide crowded keys into blocks.
    """
    minimum = lambda i: F.get("minima", F.pmod(F.xxhash64("key", F.lit(turn), F.lit(i)), F.lit(ORDERS)).cast("int"))
    keyed = _labelled(live, roots).select("v", "n", "u", "comp", "minima", F.explode(F.arrays_zip(F.slice("shingles", F.lit(1), F.col("k")).alias("key"), "crowds")).alias("at"))
    rows = keyed.select("v", "n", "u", "comp", "minima", "at.key", "at.crowds").select("v", "n", "u", "comp", "key", "crowds", minimum(0).alias("first"), minimum(1).alias("second"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("first", "second"), F.ceil(F.col("crowds") / BLOCK))).drop("crowds").repartition("key", "block")
    order = W.partitionBy("key", "block").orderBy("first", "second", "v")
    met = rows.withColumn("before", F.lag(F.struct("v", "n", "u", "comp")).over(order)).where("before.comp <> comp")
    met = met.where(_possible({n: F.col(n) for n in "nu"}, {n: F.col(f"before.{n}") for n in "nu"}, similarity))
    return met.groupBy(F.least("v", "before.v").alias("a"), F.greatest("v", "before.v").alias("b")).agg(F.count(F.lit(1)).alias("c"))


def _remaining(live: DataFrame, roots: DataFrame | None, scratch: Scratch, similarity: float) -> DataFrame:
    """(a, b): all possible pairs of a key whose vertices are in different components.

    A pair that has one of the EARLIER keys before this one in common meets there too, so it isn't made again here.
    """
    keyed = _labelled(live, roots).select(F.posexplode(F.slice("shingles", F.lit(1), F.col("k"))).alias("pos", "key"), "v", "n", "u", "comp", "shingles", *BITMAP)
    earlier = F.slice("shingles", F.greatest(F.lit(1), F.col("pos") + 1 - EARLIER), F.least(F.col("pos"), F.lit(EARLIER)))
    keyed = keyed.select("key", "v", "n", "u", "comp", earlier.alias("earlier"), *BITMAP)
    met = keyed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(_anew("key").alias("c_key"))
    open_ = scratch.store(keyed.join(met, F.col("key") == F.col("c_key")).drop("c_key"))
    other = open_.select(*[F.col(c).alias(f"o_{c}") for c in open_.columns])
    columns = ("n", "u", *BITMAP)
    may = _possible({n: F.col(n) for n in columns}, {n: F.col(f"o_{n}") for n in columns}, similarity)
    met = open_.join(other, (F.col("key") == F.col("o_key")) & (F.col("v") < F.col("o_v")) & (F.col("comp") != F.col("o_comp")) & may & ~F.arrays_overlap("earlier", "o_earlier"))
    return met.select(F.col("v").alias("a"), F.col("o_v").alias("b")).distinct()


def _linked(live: DataFrame, scratch: Scratch, similarity: float) -> DataFrame | None:
    """(v, root): the components of all pairs that are alike enough."""
    roots = tried = None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = _neighbours(live, roots, turn, similarity)
            pairs = pairs.union(_golay_pairs(live, scratch)) if turn == 0 else pairs
        else:
            pairs = _remaining(live, roots, scratch, similarity)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        found = scratch.store(_verified(_partners(pairs, live, similarity) if turn < ROUNDS else pairs, live, similarity))
        failed, good = found.where("not alike").select("a", "b"), found.where("alike").select("a", "b")
        tried = failed if tried is None else tried.union(failed)
        if not good.isEmpty():
            roots = components(good if roots is None else good.union(roots.select("v", "root")))
        tidy(live.sparkSession)
    return roots


def _grouped(docs: DataFrame, scratch: Scratch, text: str, ident: str, shingle: int, similarity: float) -> DataFrame:
    small_batches(docs.sparkSession)
    source = docs.select(F.col(ident).cast("long").alias("id"), _mark(text).alias("mark"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))
    tidy(docs.sparkSession)
    heads = scratch.store(_heads(source, shingle).withColumn("v", F.monotonically_increasing_id()))
    copies = scratch.store(heads.groupBy("digest").agg(F.min("v").alias("r"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.concat("digest", F.lit("").cast("binary")).alias("c_digest"), "r"))
    named = heads.join(copies, F.col("digest") == F.col("c_digest"), "left").withColumn("r", F.coalesce("r", "v"))
    # candidates: enough of the sketch stands in other sketches
    firsts = named.where("r = v")
    sketched = firsts.select("v", F.explode("sketch").alias("h"))
    shared = sketched.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(_anew("h").alias("s_h"))
    held = sketched.join(shared, F.col("h") == F.col("s_h")).groupBy("v").agg(F.count(F.lit(1)).alias("held")).select(_anew("v").alias("h_v"), "held")
    least = F.when(F.col("n") <= math.floor(similarity * SKETCH), F.ceil(similarity * F.col("n") - 1e-9)).otherwise(least_shared(similarity))
    wanted = scratch.store(firsts.select("id", "mark", "v", "n").join(held, F.col("v") == F.col("h_v")).where(F.col("held") >= least).select(F.col("id").alias("w_id"), F.col("mark").alias("w_mark"), "v"))
    sets = scratch.store(_sets(source.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).select("v", "data"), shingle))
    if not sets.groupBy("v").count().where("count > 1").isEmpty():  # rows that are equal in identifier and text
        sets = scratch.store(sets.dropDuplicates(["v"]))
    every = sets.select("v", F.explode("shingles").alias("h"))
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(_anew("h").alias("s_h"), "df")
    held = every.join(shared, F.col("h") == F.col("s_h")).groupBy("v").agg(F.collect_list(F.struct("df", "h")).alias("held"))
    live = scratch.store(_live(held.join(sets.select(_anew("v").alias("n_v"), "n", "fp"), F.col("v") == F.col("n_v")), similarity))
    tidy(docs.sparkSession)
    roots = _linked(live, scratch, similarity)
    rows = named.select("id", "mark", F.col("r").alias("comp"))
    if roots is not None:
        rows = named.select("id", "mark", "r").join(roots.select(_anew("v").alias("r_v"), "root"), F.col("r") == F.col("r_v"), "left").select("id", "mark", F.coalesce("root", "r").alias("comp"))
    rows = scratch.store(rows)
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("void"), "id", "mark")).alias("first")).select(_anew("comp").alias("f_comp"), "first")
    return rows.join(first, F.col("comp") == F.col("f_comp")).select("id", "mark", F.col("first.id").alias("group_id"), (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))).alias("stays"))


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_groups(docs: DataFrame, text: str = "text", ident: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, mark, group_id, stays) of every row: group_id is the least identifier of its group, itself where it is alone.

    mark is a hash of the text; it tells rows that share an identifier apart. Defined cases: null and empty texts and texts
    without words are alike; fewer words than a shingle make one shingle of all; rows that share an identifier but not the
    text are documents of their own, and the one with the least mark stays; rows equal in both stay or go together; a null
    identifier comes after all others; an empty table gives an empty table. Identifiers are cast to long.
    """
    return _grouped(docs, Scratch(docs.sparkSession), text, ident, shingle, similarity)


def near_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with its columns. Defined cases as in :func:`near_groups`."""
    scratch = Scratch(docs.sparkSession)
    dropped = scratch.store(_grouped(docs, scratch, text, ident, shingle, similarity).where("not stays").select(F.col("id").alias("_dropped_id"), F.col("mark").alias("_dropped_mark")).distinct())
    scratch.drop_all_but_last()
    return docs.join(dropped, F.col(ident).cast("long").eqNullSafe(F.col("_dropped_id")) & (_mark(text) == F.col("_dropped_mark")), "left_anti")
