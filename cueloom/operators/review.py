"""Incremental review: batches of cues with a neighbour on each side, reused while their inputs are unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cueloom.operators.findings import finding, union
from cueloom.operators.terms import forms

SIZE = 25


def batches(source: DataFrame, translated: DataFrame, size: int = SIZE, terms: DataFrame | None = None) -> DataFrame:
    """(track_id, cue_start, cue_end, input): ``input`` is canonical JSON of the cues, neighbours included, and the terms.

    terms: (track_id, kind, pos, entry); all of a track's entries belong to each of its batches.
    """
    total = source.groupBy(F.col("track_id").alias("n_track")).agg(F.max("cue").alias("total"))

    def dealt(cues: DataFrame, name: str) -> DataFrame:
        own = F.floor((F.col("cue") - 1) / size).cast("int")
        beside = F.array_distinct(F.array(own, F.floor((F.col("cue") - 2) / size).cast("int"), F.floor(F.col("cue") / size).cast("int")))
        rows = cues.select("track_id", "cue", "start_ms", "end_ms", "text", F.explode(beside).alias("batch")).where("batch >= 0")
        return rows.groupBy("track_id", "batch").agg(F.array_sort(F.collect_list(F.struct("cue", "start_ms", "end_ms", "text"))).alias(name))

    both = dealt(source, "source").join(dealt(translated, "translated"), ["track_id", "batch"], "left")
    rows = both.join(total, F.col("track_id") == F.col("n_track")).where(F.col("batch") * size < F.col("total"))
    held = [F.col("source"), F.col("translated")]
    if terms is not None:
        entries = terms.groupBy(F.col("track_id").alias("e_track")).agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "entry"))).alias("terms"))
        rows, held = rows.join(entries, F.col("track_id") == F.col("e_track"), "left"), [*held, F.col("terms")]
    first = F.col("batch") * size + 1
    return rows.select("track_id", first.cast("int").alias("cue_start"), F.least(F.col("batch") * size + size, "total").cast("int").alias("cue_end"), F.to_json(F.struct(*held)).alias("input"))


def relevant_terms(source: DataFrame, glossary: DataFrame) -> DataFrame:
    """(track_id, pos): glossary terms with a form anywhere in a track's joined source text."""
    from cueloom.functions.text import simple_fold, term_pattern, unicode_forms

    text = source.groupBy(F.col("track_id").alias("s_track")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", "text"))), lambda x: x["text"]), "\n").alias("said")).withColumn("folded", unicode_forms("said")["fold"])
    met = forms(glossary).join(text, F.col("track_id") == F.col("s_track"))
    found = F.when(F.col("exact_case"), F.regexp_like("said", term_pattern(F.col("norm")))).otherwise(F.regexp_like("folded", term_pattern(F.col("fold"))))
    return met.where(found).select("track_id", "pos").distinct()


def reused(now: DataFrame, previous: DataFrame, coverage: DataFrame) -> DataFrame:
    """``now`` with ``reused``: an earlier passed review had this batch, one of its ranges covers it, and the input is the same."""
    old = previous.select(F.col("track_id").alias("o_track"), F.col("cue_start").alias("o_start"), F.col("cue_end").alias("o_end"), F.col("input").alias("o_input"))
    joined = now.join(old, (F.col("track_id") == F.col("o_track")) & (F.col("cue_start") == F.col("o_start")) & (F.col("cue_end") == F.col("o_end")), "left")
    ranges = coverage.groupBy(F.col("track_id").alias("c_track")).agg(F.collect_list(F.struct("cue_start", "cue_end")).alias("ranges"))
    joined = joined.join(ranges, F.col("track_id") == F.col("c_track"), "left")
    covered = F.exists("ranges", lambda r: (r["cue_start"] <= F.col("cue_start")) & (r["cue_end"] >= F.col("cue_end")))
    return joined.select("track_id", "cue_start", "cue_end", "input", F.coalesce((F.col("input") == F.col("o_input")) & covered, F.lit(False)).alias("reused"))


def coverage_complete(coverage: DataFrame, totals: DataFrame) -> DataFrame:
    """(track_id, complete): whether the well-formed ranges of a track cover cues 1 to ``total``."""
    ok = coverage.join(totals.select(F.col("track_id").alias("t_track"), "total"), F.col("track_id") == F.col("t_track")).where("cue_start >= 1 and cue_end >= cue_start and cue_end <= total")
    seen = ok.select("track_id", F.explode(F.sequence("cue_start", "cue_end")).alias("cue")).distinct().groupBy(F.col("track_id").alias("v_track")).agg(F.count(F.lit(1)).alias("n"))
    return totals.join(seen, F.col("track_id") == F.col("v_track"), "left").select("track_id", (F.coalesce("n", F.lit(0)) == F.col("total")).alias("complete"))


def review_issues(reviews: DataFrame, coverage: DataFrame, totals: DataFrame) -> DataFrame:
    """reviews: (track_id, schema_version, job, status, reviewed_at, issues variant). One review for each track."""
    rows = reviews.join(coverage_complete(coverage, totals).withColumnRenamed("track_id", "c_track"), F.col("track_id") == F.col("c_track"), "left")
    issues = F.try_variant_get("issues", "$", "array<variant>")
    rows = rows.withColumn("listed", issues)
    objects = ~F.exists("listed", lambda v: v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"))
    open_ = F.size(F.filter("listed", lambda v: ~F.coalesce(F.try_variant_get(v, "$.resolved", "boolean") & (F.schema_of_variant(F.try_variant_get(v, "$.resolved", "variant")) == "BOOLEAN"), F.lit(False))))
    said = lambda rows, code, seq: finding(rows, "review", "error", code, seq=F.lit(seq))
    return union(
        said(rows.where("not (schema_version <=> 1)"), "ai_review_schema", 0),
        said(rows.where("not (job <=> cast(track_id as string))"), "ai_review_job", 1),
        said(rows.where("not (status <=> 'passed')"), "ai_review_not_passed", 2),
        said(rows.where(F.try_to_timestamp("reviewed_at").isNull()), "ai_review_timestamp", 3),
        said(rows.where("not coalesce(complete, false)"), "ai_review_incomplete_coverage", 4),
        said(rows.where("listed is null"), "ai_review_issues_invalid", 5),
        said(rows.where(F.col("listed").isNotNull() & ~objects), "ai_review_issue_invalid", 6),
        said(rows.where(F.col("listed").isNotNull() & objects & (open_ > 0)), "ai_review_unresolved_issues", 7),
    )


def stale_issues(now: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Tracks whose reviewed batches aren't those of now."""
    key = lambda d, p: d.groupBy(F.col("track_id").alias(p)).agg(F.array_sort(F.collect_list(F.struct("cue_start", "cue_end", "input"))).alias(f"{p}_all"))
    both = key(reviewed, "r").join(key(now, "n"), F.col("r") == F.col("n"), "left")
    return finding(both.where("not (r_all <=> n_all)").withColumnRenamed("r", "track_id"), "review_stale", "error", "ai_review_stale")
