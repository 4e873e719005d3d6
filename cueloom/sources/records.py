"""JSON records of jobs, glossaries, term candidates and term decisions.

Readers take (track_id, body, code), one row for each file, as :func:`files` gives them; ``code`` says why a file has no body.
Entries and headers with a fault are rows of ``rejects`` (track_id, pos, code), pos -1 for the file itself, and nothing else is
lost with them. JSON is read strictly: nothing may follow the value, and an object that repeats a key is a fault too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cueloom.functions.text import strict_json
from cueloom.operators.findings import finding
from cueloom.operators.glossary import MOST_TERMS
from cueloom.operators.jobs import PHASES, track_hashes
from cueloom.sources.captions import decoded

#: Fixed values of the record formats.
VERSION, SOURCE_LANGUAGE, TARGET_LANGUAGE = 1, "en", "zh-Hans"
JOB_FILE, SOURCE_FILE = "job.json", "source.en.srt"
OPTIONS = {"bilingual": "bilingualAss", "title": "chineseTitle", "description": "videoDescription"}
ENTRY = {"id": "id", "en": "en", "target": "zhHans", "category": "category", "approval": "approvalStatus", "scope": "syncScope", "status": "status", "rationale": "rationale"}


@dataclass(frozen=True)
class Records:
    headers: DataFrame
    terms: DataFrame
    rejects: DataFrame

    def findings(self, code: str) -> DataFrame:
        """The faults as findings of a check."""
        return finding(self.rejects, "glossary", "error", code, seq=F.col("pos"), details={"reason": F.col("code")})


def files(spark: SparkSession, path: str, name: str, above: int = 0) -> DataFrame:
    """(track_id, body, code) of all files called ``name`` under ``path``, none if there is no such folder.

    track_id is the name of the folder that holds the file, or of one further ``above``.
    """
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path).select("path", "content")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], "path string, content binary")
    return decoded(found).select(F.element_at(F.split("path", "/"), -2 - above).alias("track_id"), "body", "code")


def _at(value: str | Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a type of number; null where the field is missing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _whole(value: Column) -> Column:
    """A number without a fraction; null for any other value."""
    number = F.when(_kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(value, "$", "double"))
    return F.when(number == F.floor(number), number.cast("long"))


def parsed(bodies: DataFrame) -> DataFrame:
    """(track_id, value variant, code): undecodable, too_large, not_json or not_object, else null.

    Generators stand between the steps, so that a value is decoded and parsed once, not once for each field that reads it.
    """
    rows = bodies.select("track_id", "code", F.explode(F.array("body")).alias("body"))
    rows = rows.select("track_id", "code", F.explode(F.array(strict_json("body"))).alias("value"))
    code = F.coalesce("code", F.when(F.col("value").isNull(), "not_json").when(_kind(F.col("value")) != "OBJECT", "not_object"))
    return rows.select("track_id", "value", code.alias("code"))


def _entries(rows: DataFrame) -> DataFrame:
    """(track_id, pos, entry, aliases, code) of the objects in ``terms``."""
    each = rows.where("code is null").select("track_id", F.posexplode(_at("value", "terms", "array<variant>")).alias("pos", "entry"))
    exact, listed = _kind(_at("entry", "caseSensitive")), _kind(_at("entry", "aliases"))
    aliases = _at("entry", "aliases", "array<variant>")
    code = (
        F.when(~_kind(F.col("entry")).eqNullSafe("OBJECT"), "entry_not_object")
        .when(exact.isNotNull() & (exact != "BOOLEAN"), "case_not_boolean")
        .when(listed.isNotNull() & (listed != "ARRAY"), "aliases_not_list")
        .when(F.exists(aliases, lambda a: ~_kind(a).eqNullSafe("STRING")), "alias_not_text")
    )
    texts = F.transform(aliases, lambda a: F.try_variant_get(a, "$", "string"))
    return each.select("track_id", "pos", "entry", F.coalesce(texts, F.expr("cast(array() as array<string>)")).alias("aliases"), code.alias("code"))


def _records(bodies: DataFrame, checks: dict[str, Column], headers: list[Column], columns: list[Column]) -> Records:
    rows = parsed(bodies)
    listed = _kind(_at("value", "terms")).eqNullSafe("ARRAY")
    many = listed & (F.size(_at("value", "terms", "array<variant>")) > MOST_TERMS)
    checks = {"version_unknown": _whole(_at("value", "schemaVersion")).eqNullSafe(F.lit(VERSION).cast("long")), **checks, "terms_not_list": listed, "too_many_terms": ~many}
    faults = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda c: c.isNotNull())
    faults = F.when(F.col("code").isNotNull(), F.array("code")).otherwise(faults)
    entries = _entries(rows)
    bad = rows.select("track_id", F.lit(-1).alias("pos"), F.explode(faults).alias("code"))
    return Records(
        rows.where("code is null").select("track_id", *headers),
        entries.where("code is null").select("track_id", "pos", *columns),
        bad.unionByName(entries.where("code is not null").select("track_id", "pos", "code")),
    )


def _term_columns() -> list[Column]:
    text = {name: _at("entry", field, "string").alias(name) for name, field in ENTRY.items()}
    exact = _at("entry", "caseSensitive", "boolean").alias("case_sensitive")
    return [text["id"], text["en"], F.col("aliases"), exact, *[text[n] for n in ("target", "category", "approval", "scope", "status", "rationale")]]


def read_glossaries(bodies: DataFrame) -> Records:
    """Glossaries: headers (track_id, revision, updated_at) and raw terms as :mod:`cueloom.operators.glossary` takes them."""
    revision = _whole(_at("value", "revision"))
    checks = {
        "source_language_unknown": _at("value", "sourceLanguage", "string") == SOURCE_LANGUAGE,
        "target_language_unknown": _at("value", "targetLanguage", "string") == TARGET_LANGUAGE,
        "revision_unknown": revision >= 0,
    }
    return _records(bodies, checks, [revision.alias("revision"), _at("value", "updatedAt", "string").alias("updated_at")], _term_columns())


def _term_headers() -> tuple[dict[str, Column], list[Column]]:
    done = _kind(_at("value", "completed")) == "BOOLEAN"
    completed = F.when(done, _at("value", "completed", "boolean")).alias("completed")
    return {"completed_not_boolean": done}, [_at("value", "job", "string").alias("job"), completed, _at("value", "updatedAt", "string").alias("updated_at")]


def read_decisions(bodies: DataFrame) -> Records:
    """Term decisions: headers (track_id, job, completed, updated_at), raw terms, and whether a decision brings an id."""
    own = _at("entry", "id", "string").isNotNull().alias("own_id")
    return _records(bodies, *_term_headers(), [*_term_columns(), own])


def read_candidates(bodies: DataFrame) -> Records:
    """Term candidates: headers as of decisions, raw candidates (track_id, pos, en, aliases, case_sensitive, category, cues, reason)."""
    cues = F.filter(F.transform(_at("entry", "cueIndexes", "array<variant>"), lambda c: F.try_variant_get(c, "$", "double")), lambda c: (c == F.floor(c)) & c.between(1, 2**31 - 1))
    columns = [_at("entry", "en", "string").alias("en"), F.col("aliases"), _at("entry", "caseSensitive", "boolean").alias("case_sensitive"), _at("entry", "category", "string").alias("category"), cues.cast("array<int>").alias("cues"), _at("entry", "reason", "string").alias("reason")]
    return _records(bodies, *_term_headers(), columns)


def read_jobs(bodies: DataFrame, project: str, hashes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs as :mod:`cueloom.operators.jobs` takes them, and rejects. track_id is the folder's name, which a job's id must equal.

    hashes: (track_id, track_hash) of the normalised sources; a job without one has a null track_hash.
    """
    rows = parsed(bodies)
    code = F.coalesce(
        "code",
        F.when(~_whole(_at("value", "schemaVersion")).eqNullSafe(F.lit(VERSION).cast("long")), "version_unknown")
        .when(~_at("value", "id", "string").eqNullSafe(F.col("track_id")), "id_differs")
        .when(_kind(_at("value", "phases")) != "OBJECT", "phases_not_object"),
    )
    rows = rows.withColumn("code", code)
    option = lambda field: F.coalesce(_at("value", f"options.{field}", "boolean"), F.lit(False))
    phases = F.map_from_entries(F.array(*[F.struct(F.lit(p).alias("key"), F.coalesce(_at("value", f"phases.{p}.status", "string"), F.lit("pending")).alias("value")) for p in PHASES]))
    good = rows.where("code is null").select(
        F.col("track_id").alias("job_id"), F.lit(project).alias("project"), _at("value", "source.originalPath", "string").alias("source_path"),
        F.struct(*[option(field).alias(n) for n, field in OPTIONS.items()]).alias("options"), phases.alias("phases"),
        _at("value", "createdAt", "string").alias("created_at"), _at("value", "updatedAt", "string").alias("updated_at"),
    )
    if hashes is None:
        good = good.withColumn("track_hash", F.lit(None).cast("string"))
    else:
        good = good.join(hashes.select(F.col("track_id").alias("h_id"), "track_hash"), F.col("job_id") == F.col("h_id"), "left")
    order = ("job_id", "project", "source_path", "track_hash", "options", "phases", "created_at", "updated_at")
    return good.select(*order), rows.where("code is not null").select("track_id", F.lit(-1).alias("pos"), "code")


def project_jobs(spark: SparkSession, root: str, project: str) -> tuple[DataFrame, DataFrame]:
    """All jobs under ``root``/jobs by name, with the hashes of their normalised sources, and rejects."""
    place = f"{root.rstrip('/')}/jobs/*"
    sources = files(spark, f"{place}/source", SOURCE_FILE, above=1).where("code is null")
    jobs, rejects = read_jobs(files(spark, place, JOB_FILE), project, track_hashes(sources.select("track_id", "body")))
    return jobs.orderBy(F.collate("job_id", "UNICODE"), "job_id"), rejects


def job_bodies(jobs: DataFrame) -> DataFrame:
    """(track_id, body): jobs as JSON that :func:`read_jobs` reads back."""
    options = F.struct(*[F.col(f"options.{n}").alias(field) for n, field in OPTIONS.items()])
    phases = F.struct(*[F.struct(F.col("phases")[p].alias("status")).alias(p) for p in PHASES])
    fields = [F.lit(VERSION).alias("schemaVersion"), F.col("job_id").alias("id"), F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"), F.lit(SOURCE_LANGUAGE).alias("sourceLanguage"), F.lit(TARGET_LANGUAGE).alias("targetLanguage")]
    return jobs.select(F.col("job_id").alias("track_id"), F.to_json(F.struct(*fields, options.alias("options"), F.struct(F.col("source_path").alias("originalPath")).alias("source"), phases.alias("phases"))).alias("body"))
