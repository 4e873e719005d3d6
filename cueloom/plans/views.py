"""Deterministic caption views of general tables, so that every operator can run over ordinary data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as cues: 400 ms and 60 ms a character, one after the other; each seventh begins 500 ms early."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("track_id"), F.posexplode(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).alias("pos", "text"))
    rows = lines.select("track_id", (F.col("pos") + 1).alias("cue"), "text", (400 + 60 * F.length("text")).cast("long").alias("dur"))
    earlier = W.partitionBy("track_id").orderBy("cue").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("dur").over(earlier), F.lit(0))
    rows = rows.withColumn("base", base)
    return rows.select("track_id", "cue", (F.col("base") - F.when(F.col("cue") % 7 == 0, 500).otherwise(0)).alias("start_ms"), (F.col("base") + F.col("dur")).alias("end_ms"), "text")


def translated(source: DataFrame) -> DataFrame:
    """The same cues with digits dropped from even ones, each eleventh 3 ms late, and no last cue in each fiftieth track."""
    last = F.max("cue").over(W.partitionBy("track_id"))
    rows = source.withColumn("last", last).where((F.col("track_id") % 50 != 0) | (F.col("cue") < F.col("last")) | (F.col("last") == 1))
    return rows.select("track_id", "cue", (F.col("start_ms") + F.when(F.col("cue") % 11 == 0, 3).otherwise(0)).alias("start_ms"), "end_ms", F.when(F.col("cue") % 2 == 0, F.regexp_replace("text", "[0-9]", "")).otherwise(F.col("text")).alias("text"))


def children(source: DataFrame) -> DataFrame:
    """Cues cut in two at the middle blank; with faults: a gap in each 13th, other text in each 17th, a late end in each 19th."""
    words = F.split("text", " ", -1)
    rows = source.select("track_id", "cue", "start_ms", "end_ms", "text", words.alias("words"))
    half = F.floor((F.size("words") + 1) / 2).cast("int")
    middle = (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2)).cast("long")
    first = F.struct(F.lit(1).alias("k"), F.col("start_ms").alias("start_ms"), middle.alias("end_ms"), F.array_join(F.slice("words", 1, half), " ").alias("text"))
    second = F.struct(
        F.lit(2).alias("k"), (middle + F.when(F.col("cue") % 13 == 0, 40).otherwise(0)).alias("start_ms"), (F.col("end_ms") + F.when(F.col("cue") % 19 == 0, 7).otherwise(0)).alias("end_ms"),
        F.concat(F.array_join(F.slice("words", half + 1, F.greatest(F.size("words"), F.lit(1))), " "), F.when(F.col("cue") % 17 == 0, "x").otherwise("")).alias("text"),
    )
    parts = rows.select("track_id", F.col("cue").alias("parent_cue"), F.explode(F.when(F.size("words") > 1, F.array(first, second)).otherwise(F.array(F.struct(F.lit(1).alias("k"), "start_ms", "end_ms", "text")))).alias("p"))
    number = F.row_number().over(W.partitionBy("track_id").orderBy("parent_cue", "p.k"))
    return parts.select("track_id", number.alias("cue"), "parent_cue", "p.start_ms", "p.end_ms", "p.text")


def words(source: DataFrame) -> DataFrame:
    """(word, n): lower-cased words of six ASCII letters and more with the number of cues that have them; 200 most frequent."""
    found = source.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?<![\\p{L}\\p{N}])[a-z]{6,}(?![\\p{L}\\p{N}])"), F.lit(0)))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(200)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared term table from the 200 words: rank in pos; even ranks case-sensitive, every tenth a job term.

    The alias of a term is its word in capitals, but for every third term none; the target is the word reversed, and for
    every fourth term the word itself.
    """
    ranked = words(cues(spark, sf_dir)).withColumn("pos", F.row_number().over(W.orderBy(F.col("n").desc(), "word")))
    return ranked.select(
        "pos", F.col("word").alias("en"), F.when(F.col("pos") % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.upper("word"))).alias("aliases"), (F.col("pos") % 2 == 0).alias("case_sensitive"),
        F.when(F.col("pos") % 4 == 0, F.col("word")).otherwise(F.reverse("word")).alias("target"), F.lit("approved").alias("approval"), F.when(F.col("pos") % 10 == 0, "job").otherwise("project").alias("scope"),
    )
