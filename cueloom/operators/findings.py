"""Findings are rows: (track_id, check_order, seq, severity, code, cue, details)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Findings of a track that a report keeps.
MOST_FINDINGS = 1000

#: The order in which checks report.
ORDER = {
    name: i
    for i, name in enumerate(
        "glossary timeline alignment readable readability numbers terminology term_boundaries latin review review_stale readable_en source_terms english layers ass title description".split()
    )
}


def _fields(check: str, severity: str, code: Column | str, cue: Column | None = None, seq: Column | None = None, details: dict[str, Column] | None = None) -> list[Column]:
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]
    return [
        F.lit(ORDER[check]).alias("check_order"),
        (seq if seq is not None else F.lit(0)).cast("int").alias("seq"),
        F.lit(severity).alias("severity"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        (cue if cue is not None else F.lit(None)).cast("int").alias("cue"),
        (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>").alias("details"),
    ]


def finding(rows: DataFrame, check: str, severity: str, code: Column | str, cue: Column | None = None, seq: Column | None = None, details: dict[str, Column] | None = None) -> DataFrame:
    """Rows with a track_id as findings; without a cue they concern the whole track. seq orders those of one cue."""
    return rows.select("track_id", *_fields(check, severity, code, cue, seq, details))


def several(rows: DataFrame, *kinds: tuple) -> DataFrame:
    """Findings of several kinds in one pass: each is (times, check, severity, code, cue, seq), times how often a row has it."""
    made = [F.array_repeat(F.struct(*_fields(*kind[1:])), F.coalesce(kind[0].cast("int"), F.lit(0))) for kind in kinds]
    return rows.select("track_id", F.explode(F.concat(*made)).alias("f")).select("track_id", "f.*")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def capped(findings: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """The first ``most`` findings of a track in order of check, cue and seq, with ``rank``; one error more where there are more.

    The limit belongs to the report: it is the reader's, and its own error says that it was reached.
    """
    order = W.partitionBy("track_id").orderBy("check_order", F.col("cue").asc_nulls_first(), "seq", "code")
    ranked = findings.withColumn("rank", F.row_number().over(order))
    over = ranked.where(F.col("rank") == most + 1).withColumns({"severity": F.lit("error"), "code": F.lit("issue_limit_reached"), "cue": F.lit(None).cast("int"), "details": F.lit(None).cast("map<string,string>")})
    return ranked.where(F.col("rank") <= most).unionByName(over)


def report(findings: DataFrame, tracks: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """(track_id, errors, warnings, passed) of every track in ``tracks``."""
    counted = capped(findings, most).groupBy("track_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    named = counted.withColumnRenamed("track_id", "f_track")
    return tracks.select("track_id").distinct().join(named, F.col("track_id") == F.col("f_track"), "left").select(
        "track_id", F.coalesce("e", F.lit(0)).cast("long").alias("errors"), F.coalesce("w", F.lit(0)).cast("long").alias("warnings"), (F.coalesce("e", F.lit(0)) == 0).alias("passed")
    )


def is_terminology(code: Column) -> Column:
    """Whether a code belongs to terminology."""
    return (code == "glossary_invalid") | code.contains("term") | code.contains("candidate")


def rendered(findings: DataFrame, tracks: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(track_id, body): a Markdown report, errors before warnings; ``counts`` (track_id, layer, cues) are listed first."""
    line = F.concat(F.lit("- "), "code", F.coalesce(F.concat(F.lit(" (cue "), F.col("cue").cast("string"), F.lit(")")), F.lit("")))
    lines = capped(findings).withColumn("line", line).groupBy("track_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == "error", F.struct("rank", "line")))), lambda x: x["line"]), "\n").alias("errors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == "warning", F.struct("rank", "line")))), lambda x: x["line"]), "\n").alias("warnings"),
    ).withColumnRenamed("track_id", "l_track")
    shown = tracks.select("track_id").distinct().join(lines, F.col("track_id") == F.col("l_track"), "left")
    head = F.lit("")
    if counts is not None:
        each = counts.groupBy(F.col("track_id").alias("c_track")).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("Cues, %s: %d", "layer", "cues"))), "\n").alias("shown"))
        shown = shown.join(each, F.col("track_id") == F.col("c_track"), "left")
        head = F.coalesce(F.concat("shown", F.lit("\n\n")), F.lit(""))
    none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "None.").otherwise(c)
    result = F.when(F.coalesce("errors", F.lit("")) == "", "PASS").otherwise("FAIL")
    return shown.select("track_id", F.concat(F.lit("# Quality report\n\nResult: **"), result, F.lit("**\n\n"), head, F.lit("## Errors\n\n"), none(F.col("errors")), F.lit("\n\n## Warnings\n\n"), none(F.col("warnings")), F.lit("\n")).alias("body"))
