"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents are ordered by that key, and the exclusive prefix sum of
their sizes decides what the mix takes: whole epochs while the target allows them, then the documents whose words come
before the source's exact budget.

The prefix sum is distributed: keys are uniform, so their leading hex digits range-partition a source of any size into even
pieces. Piece totals make a small table whose own prefix sums offset the running sums inside the pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cueloom.llm.common import WORD, Scratch, free_name, materialize, shuffle_partitions


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def cycled(rank: Column) -> Column:
    """Weights of sources by their place in the order: 5, 2, 1, repeating."""
    return F.when(rank % 3 == 0, 5).when(rank % 3 == 1, 2).otherwise(1)


def shares(sizes: DataFrame, weights: Callable[[Column], Column] = cycled, factor: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) of (source, source_size), targets in words.

    Sources stand in code-point order, null last, and weigh what ``weights`` says of their place from 0 on. A target over
    ``most_epochs`` times its source's size is cut to that, and what is left is shared out again among the others by weight
    until none is above: in order of size by weight the cut ones come first, so prefix sums tell them. One row for each
    source passes through one task.
    """
    every, cap = W.partitionBy(), most_epochs * F.col("source_size")
    placed = sizes.withColumn("weight", weights(F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1))
    ahead = W.orderBy(cap / F.col("weight").cast("double"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumns({
        "whole": factor * F.sum("source_size").over(every), "weighs": F.sum("weight").over(every),
        "caps": F.coalesce(F.sum(cap).over(ahead), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(ahead), F.lit(0)),
    })
    placed = placed.withColumn("above", (F.col("whole") - F.col("caps")) * F.col("weight") / (F.col("weighs") - F.col("gone")) > cap)
    left = F.col("whole") - F.sum(F.when(F.col("above"), cap).otherwise(0)).over(every)
    open_ = F.col("weighs") - F.sum(F.when(F.col("above"), F.col("weight")).otherwise(0)).over(every)
    return placed.select("source", "source_size", F.when(F.col("above"), cap.cast("double")).otherwise(F.try_divide(left * F.col("weight").cast("double"), open_)).alias("target"))


def random_key(ident: str, seed: str) -> Column:
    """Hex digits in hash-random order; equal identifiers get equal keys, a null one is keyed as the word null."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit("null"))), 256), 1, 16)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mixed(docs: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", seed: str = "mix", **plan: object) -> DataFrame:
    """One row for each of ``docs``: doc_id, source, mix_key, size, before, source_size, target, taken.

    ``before`` is the words of the source ahead of the row in one epoch; ``taken`` sums, over a source, to its target
    rounded down. Defined cases: a null or blank text has size 0 and nothing taken; a null source is a source of its own;
    rows that repeat an identifier have equal keys and stand in order of size, and rows equal in both are told apart by an
    arbitrary but complete order (their sum is the same in any); an empty table gives an empty table.
    """
    spark = docs.sparkSession
    pieces = max(1, min(4096, 4 * shuffle_partitions(spark)))
    digits = 1
    while 16**digits < pieces:
        digits += 1
    slim = materialize(
        docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
        .withColumn("mix_key", random_key("doc_id", seed))
        .withColumn("piece", F.substring("mix_key", 1, digits))
    )
    totals = slim.groupBy("source", "piece").agg(F.sum("size").alias("piece_size"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    budget = Scratch(spark).store(shares(sizes, **plan)).select(F.col("source").alias("b_source"), "source_size", "target")
    ahead = W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("piece_size").over(ahead), F.lit(0))).select(F.col("source").alias("o_source"), F.col("piece").alias("o_piece"), "offset")
    running = W.partitionBy("source", "piece").orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        slim.withColumn("inside", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(offsets, _same(F.col("source"), F.col("o_source")) & (F.col("piece") == F.col("o_piece")))
        .join(budget, _same(F.col("source"), F.col("b_source")))
        .withColumn("before", F.col("offset") + F.col("inside"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc_id", "source", "mix_key", "size", "before", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", seed: str = "mix", **plan: object) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``; a row comes once for each epoch that takes it.

    Documents stay whole: the one that holds a source's budget comes along when at least half of its words fit. It is
    found from the prefix sums, one row for each source, and every document then knows by its key alone how often it comes:
    texts are never shuffled. Rows that share the cutting identifier come together. Defined cases as in :func:`mixed`.
    """
    found = materialize(mixed(docs, text, ident, source, seed, **plan))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - epochs * F.col("source_size")
    inside = 2 * (rest - F.col("before")) >= F.greatest(F.col("size"), F.lit(1))
    c_source, c_epochs, c_key, key, times = (free_name(docs.columns, n) for n in ("_c_source", "_c_epochs", "_c_key", "_key", "_times"))
    cuts = Scratch(docs.sparkSession).store(found.groupBy(F.col("source").alias(c_source)).agg(F.max(epochs).alias(c_epochs), F.max(F.when(inside, F.col("mix_key"))).alias(c_key)))
    keyed = docs.withColumn(key, random_key(ident, seed)).join(cuts, _same(F.col(source), F.col(c_source)))
    count = F.col(c_epochs) + F.coalesce((F.col(key) <= F.col(c_key)).cast("long"), F.lit(0))
    copies = F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))
    return keyed.withColumn(times, count).where(F.col(times) > 0).withColumn(times, copies).select(*docs.columns)
