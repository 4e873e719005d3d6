"""Exact de-duplication by sorting content.

Sampled splitters range-partition the normalised bytes, each task's external sort places equal texts side by side, and a
window over neighbours that are equal in full finds the row that stays. The sample only steers balance: the result is
the same whatever rows it holds.

A splitter is (prefix of the normalised text, 64-bit hash of it, document id), so the id divides even one text that a
third of all rows share over many tasks. A text that lies across a splitter is then known from the splitters alone; only
such texts - at most one for each splitter - take a second, pre-aggregated step over a table of at most one row for each
partition and text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cueloom.llm.common import ascii_lower, free_name, shuffle_partitions

#: Bytes of text in a splitter; equal prefixes are told apart by the hash, so this bounds the driver's share, not precision.
PREFIX_BYTES = 48
#: Sampled rows for each partition.
SAMPLES = 24


def _rank_among(keys: list[str], key: Column, equal: bool = False) -> Column:
    """How many of the ascending ``keys`` are at most ``key``: a branchless binary search that stays in the JVM.

    With ``equal``, 0 unless the last of those is ``key`` itself. The key is carried along, so it is computed once, and the
    list is a literal.
    """
    if not keys:
        return F.lit(0)
    listed, width = F.split(F.lit(",".join(keys)), ","), 1 << len(keys).bit_length()
    steps = F.array(*[F.lit(width >> i) for i in range(1, width.bit_length())])
    reached = lambda at, step, key: F.when(F.coalesce(F.get(listed, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), key.alias("key")),
        lambda now, step: F.struct(reached(now["at"], step, now["key"]).alias("at"), now["key"].alias("key")),
        lambda now: F.when(F.get(listed, now["at"] - 1) == now["key"], now["at"]).otherwise(F.lit(0)) if equal else now["at"],
    )


@dataclass(frozen=True)
class Splitters:
    """Ascending keys in hex; partition k holds the keys from number k-1 up to number k."""

    keys: list[str]
    partitions: int

    def bucket(self, key: Column) -> Column:
        return _rank_among(self.keys, key)


def _content(norm: Column) -> Column:
    """The part of a key that equal texts share, in hex digits, which order as the bytes do."""
    return F.concat(F.rpad(F.hex(F.substring(F.encode(norm, "UTF-8"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0"), F.lpad(F.hex(F.xxhash64(norm)), 16, "0"))


def _key(norm: Column, ident: Column) -> Column:
    sign_flipped = F.coalesce(ident, F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63)))
    return F.concat(_content(norm), F.lpad(F.hex(sign_flipped), 16, "0"))


def sampled_splitters(rows: DataFrame, norm: Column, ident: Column, partitions: int) -> Splitters:
    """Splitters that share out bytes, from about SAMPLES rows a partition (about 130 bytes each reach the driver)."""
    if partitions < 2:
        return Splitters([], 1)
    count = rows.count()
    if not count:
        return Splitters([], 1)
    fraction = min(1.0, SAMPLES * partitions / count)
    sample = rows.select("*") if fraction >= 1 else rows.sample(fraction, seed=17)
    drawn = sorted((k, 64 + n) for k, n in sample.select(_key(norm, ident), F.octet_length(norm)).collect())
    total, run, keys = sum(n for _, n in drawn), 0, []
    for key, weight in drawn:
        if run >= total * (len(keys) + 1) / partitions and len(keys) < partitions - 1 and (not keys or key > keys[-1]):
            keys.append(key)
        run += weight
    return Splitters(keys, len(keys) + 1)


def exact_groups(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "max", partitions: int | None = None) -> DataFrame:
    """Adds ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to every row of ``docs``.

    Texts are equal when identical after A-Z is lower-cased. ``keep`` is ``max`` or ``min``: which identifier of a group
    stays. Columns of ``docs`` that have one of the four names are replaced.

    Defined cases: a null text counts as empty, and all empty texts are one group. A row without an identifier counts in
    its group and stays only when no row of the group has one (keep_id is then null). Of rows that repeat identifier and
    text exactly one stays. An empty table gives an empty table. Texts of any length are compared whole.
    """
    spark, added = docs.sparkSession, ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added and c not in (text, ident)])
    norm, bucket, rank, local = (free_name(docs.columns + added, n) for n in ("_norm", "_bucket", "_rank", "_local"))
    best = {"max": F.max, "min": F.min}[keep]
    whole = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    key_id = F.col(ident).cast("long")
    cut = sampled_splitters(docs.select(text, ident), whole, key_id, partitions or shuffle_partitions(spark))
    dealt = docs.withColumn(bucket, cut.bucket(_key(whole, key_id))).repartitionById(cut.partitions, bucket).withColumn(norm, whole)
    order = F.col(ident).desc_nulls_last() if keep == "max" else F.col(ident).asc_nulls_last()
    same = W.partitionBy(bucket, norm)
    found = (
        dealt.withColumn(rank, F.row_number().over(same.orderBy(order)))
        .withColumn(local, best(ident).over(same))
        .withColumn("group_size", F.count(F.lit(1)).over(same))
        .withColumn("text_sha256", F.sha2(norm, 256))
    )
    # the content part of a text that lies across a splitter is that splitter's
    crossing = sorted({k[: 2 * PREFIX_BYTES + 16] for k in cut.keys})
    if crossing:
        sha, size, stays = (free_name(docs.columns + added, n) for n in ("_sha", "_size", "_stays"))
        first = F.col(ident).isNotNull() if keep == "max" else F.col(ident).isNull()
        across = (
            docs.select(F.col(ident), whole.alias(norm))
            .where(_rank_among(crossing, _content(F.col(norm)), equal=True) > 0)
            .withColumn(bucket, cut.bucket(_key(F.col(norm), key_id)))
            .groupBy(F.sha2(norm, 256).alias(sha))
            .agg(F.count(F.lit(1)).alias(size), best(F.struct(first.alias("first"), F.col(ident).alias("ident"), F.col(bucket).alias("bucket"))).alias(stays))
        )
        # a row for each crossing text: fewer than there are partitions, about 150 bytes each
        found = found.join(F.broadcast(across), found["text_sha256"] == across[sha], "left")
        home = F.col(size).isNull() | (F.col(stays)["bucket"] == F.col(bucket))
        found = found.withColumns({
            "keep_id": F.when(F.col(size).isNull(), F.col(local)).otherwise(F.col(stays)["ident"]),
            "group_size": F.coalesce(F.col(size), F.col("group_size")),
        })
    else:
        home = F.lit(True)
        found = found.withColumn("keep_id", F.col(local))
    found = found.withColumn("kept", home & (F.col(rank) == 1) & F.col(ident).eqNullSafe(F.col("keep_id")))
    return found.select(*docs.columns, *added)


def exact_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``; cases as in :func:`exact_groups`."""
    taken = docs.columns
    renamed = [c for c in taken if c.lower() in ("keep_id", "group_size", "kept", "text_sha256")]
    safe = {c: free_name(taken + ["keep_id", "group_size", "kept", "text_sha256"], f"in_{c}") for c in renamed}
    back = {v: k for k, v in safe.items()}
    out = exact_groups(docs.withColumnsRenamed(safe), safe.get(text, text), safe.get(ident, ident), keep).where("kept")
    return out.select(*[F.col(safe.get(c, c)).alias(c) for c in taken]) if back else out.select(*taken)
