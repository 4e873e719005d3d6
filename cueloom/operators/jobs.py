"""Job state: which phases a step resets, as updates of a table of jobs.

jobs: (job_id, project, source_path, track_hash, options struct<bilingual,title,description>, phases map<string,string>,
created_at, updated_at). Steps invalidate what lies downstream before they do what may fail, so callers write the result of
:func:`begin` first and that of :func:`finish` after the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cueloom.functions.text import slug, unicode_forms

PHASES = ("normalized", "terminology", "translation", "aiReview", "readable", "ass", "qa")
#: Phases that a step resets when it begins, and what it sets when it is done.
RESETS = {
    "glossary": ("terminology", "aiReview", "readable", "ass", "qa"),
    "readable": ("aiReview", "ass", "qa"),
    "review": ("aiReview", "qa"),
    "ass": ("ass", "qa"),
    "qa": (),
}
SETS = {"glossary": {"terminology": "applied"}, "readable": {"readable": "generated", "translation": "present"}, "review": {}, "ass": {"ass": "generated"}}


def _with(phases: Column, values: dict[str, Column | str]) -> Column:
    """A phase map with some values replaced."""
    entries = [F.struct(F.lit(p).alias("key"), F.coalesce(F.lit(values[p]) if isinstance(values.get(p), str) else values[p] if p in values else F.get(F.map_values(F.map_filter(phases, lambda k, v: k == p)), F.lit(0)), F.lit("pending")).alias("value")) for p in PHASES]
    return F.map_from_entries(F.array(*entries))


def pending(bilingual: Column, normalized: str = "verified") -> Column:
    return F.map_from_entries(F.array(*[F.struct(F.lit(p).alias("key"), (F.lit(normalized) if p == "normalized" else F.when(bilingual, "pending").otherwise("not-requested") if p == "ass" else F.lit("pending")).alias("value")) for p in PHASES]))


def track_hashes(bodies: DataFrame) -> DataFrame:
    """(track_id, track_hash): the digest of a track's normalised SRT body, which tells a changed source."""
    return bodies.select("track_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("track_hash"))


def job_ids(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """(source_path, job_id) of new sources: a slug of the file's name; -2, -3 and on where others have it. Known paths keep theirs."""
    base = F.regexp_replace(F.regexp_extract("source_path", r"([^/\\]+)\z", 1), r"\.[^.]+\z", "")
    named = sources.select("source_path").distinct().join(jobs.select("source_path", F.col("job_id").alias("own")), "source_path", "left").withColumn("slug", slug(unicode_forms(base)["nfkc"]))
    taken = jobs.select(F.regexp_replace("job_id", r"-[0-9]+\z", "").alias("t_slug"), F.coalesce(F.regexp_extract("job_id", r"-([0-9]+)\z", 1).try_cast("int"), F.lit(1)).alias("k")).groupBy("t_slug").agg(F.max("k").alias("most"))
    fresh = named.where("own is null").join(taken, F.col("slug") == F.col("t_slug"), "left").withColumn("n", F.row_number().over(W.partitionBy("slug").orderBy("source_path")) + F.coalesce("most", F.lit(0)))
    made = fresh.select("source_path", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("n").cast("string"))).alias("job_id"))
    return made.unionByName(named.where("own is not null").select("source_path", F.col("own").alias("job_id")))


def refreshed(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs after sources (job_id, source_path, track_hash, bilingual, title, description; null options keep the job's) come in.

    ``state`` is created, refreshed (another text, or an earlier refresh that broke off), reoptioned or resumed.
    """
    old = jobs.select(F.col("job_id").alias("o_id"), F.col("track_hash").alias("o_hash"), F.col("options").alias("o"), F.col("phases").alias("o_phases"), "created_at", "project")
    rows = sources.join(old, F.col("job_id") == F.col("o_id"), "left")
    option = lambda n: F.coalesce(n, f"o.{n}", F.lit(False))
    options = F.struct(*[option(n).alias(n) for n in ("bilingual", "title", "description")])
    rows = rows.withColumn("options", options)
    known = F.col("o_id").isNotNull()
    changed = known & (~F.col("track_hash").eqNullSafe(F.col("o_hash")) | (F.get(F.map_values(F.map_filter("o_phases", lambda k, v: k == "normalized")), F.lit(0)) == "refreshing"))
    differ = known & (F.to_json("options") != F.to_json("o"))
    state = F.when(~known, "created").when(changed, "refreshed").when(differ, "reoptioned").otherwise("resumed")
    newly = F.col("options.bilingual") & ~F.coalesce("o.bilingual", F.lit(False))
    kept = lambda p: F.get(F.map_values(F.map_filter("o_phases", lambda k, v: k == p)), F.lit(0))
    again = _with(F.col("o_phases"), {
        "normalized": "verified", "qa": F.when(differ, "pending").otherwise(kept("qa")), "readable": F.when(newly, "pending").otherwise(kept("readable")),
        "ass": F.when(~F.col("options.bilingual"), "not-requested").when(newly, "pending").otherwise(kept("ass")),
    })
    phases = F.when(state.isin("created", "refreshed"), pending(F.col("options.bilingual"))).otherwise(again)
    return rows.select("job_id", "project", "source_path", "track_hash", "options", phases.alias("phases"), "created_at", state.alias("state"))


def begin(jobs: DataFrame, step: str, job_ids: list[str]) -> DataFrame:
    """``jobs`` with all that lies downstream of ``step`` pending in the named jobs."""
    reset = {p: F.when(F.col("phases")[p] == "not-requested", "not-requested").otherwise("pending") for p in RESETS[step]}
    return jobs.withColumn("phases", F.when(F.col("job_id").isin(job_ids), _with(F.col("phases"), reset)).otherwise(F.col("phases")))


def finish(jobs: DataFrame, step: str, job_ids: list[str]) -> DataFrame:
    return jobs.withColumn("phases", F.when(F.col("job_id").isin(job_ids), _with(F.col("phases"), SETS[step])).otherwise(F.col("phases")))


def glossary_changed(jobs: DataFrame, project: str) -> DataFrame:
    """A changed glossary resets all jobs of its project, before it is written."""
    reset = {p: F.when(F.col("phases")[p] == "not-requested", "not-requested").otherwise("pending") for p in RESETS["glossary"]}
    return jobs.withColumn("phases", F.when(F.col("project") == project, _with(F.col("phases"), reset)).otherwise(F.col("phases")))


def checked(jobs: DataFrame, reports: DataFrame, terminology: DataFrame, reviews: DataFrame) -> DataFrame:
    """Phases after quality checks. reports: (job_id, passed); the others (job_id) of jobs with errors of that kind."""
    rows = jobs.join(reports.select(F.col("job_id").alias("r_id"), "passed"), F.col("job_id") == F.col("r_id"), "left")
    for name, bad in (("t", terminology), ("a", reviews)):
        rows = rows.join(bad.select(F.col("job_id").alias(f"{name}_id")).distinct(), F.col("job_id") == F.col(f"{name}_id"), "left")
    verdict = lambda c: F.when(F.col(c).isNull(), "verified").otherwise("failed")
    told = _with(F.col("phases"), {"terminology": verdict("t_id"), "aiReview": verdict("a_id"), "qa": F.when(F.col("passed"), "passed").otherwise("failed")})
    return rows.withColumn("phases", F.when(F.col("r_id").isNull(), F.col("phases")).otherwise(told)).select(*jobs.columns)


def ready_for_checks(jobs: DataFrame) -> DataFrame:
    """Jobs whose readable layers, and ASS file if one is asked for, are generated."""
    return jobs.where("phases['readable'] = 'generated' and (not options.bilingual or phases['ass'] = 'generated')")


def status(jobs: DataFrame) -> DataFrame:
    """(job_id, phase, state), phases in order."""
    return jobs.select("job_id", F.posexplode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col("phases")[p].alias("state")) for p in PHASES])).alias("at", "x")).select("job_id", "at", "x.phase", "x.state")


def with_history(records: DataFrame, reason: str) -> DataFrame:
    """Term or review records made empty, with what they held in ``previous``: (track_id, completed, updated_at, terms, previous)."""
    held = F.to_json(F.struct("completed", "updated_at", "terms", F.lit(reason).alias("reason")))
    kept = F.when(F.coalesce("completed", F.lit(False)) | (F.size("terms") > 0), held).otherwise(F.col("previous"))
    return records.select("track_id", F.lit(False).alias("completed"), F.lit(None).cast("string").alias("updated_at"), F.slice("terms", 1, 0).alias("terms"), kept.alias("previous"))
