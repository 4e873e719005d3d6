"""Caption sources: files to bodies, bodies to cues.

Every reader takes (track_id, body) and gives :class:`Scan`: the cues (track_id, cue, start_ms, end_ms, text, source_number)
of the tracks that read without a fault, and for each other track its first fault as (track_id, pos, code). Reading is closed
per track: one bad block keeps all of its track out, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cueloom.functions.text import WS, clean_lines, clean_text, rtrim, strict_json, trim, utf16_length, without_bom
from cueloom.functions.timing import IS_TIMELINE, LATEST_MS, centi_clock_ms, timeline
from cueloom.operators.words import split_words

#: Admission limits: bytes of any file and of a caption file, cues of a track, UTF-16 units of a cue.
MOST_BYTES, MOST_CAPTION_BYTES, MOST_CUES, MOST_UNITS = 64 << 20, 32 << 20, 20_000, 4_000
STYLE_WARNING = "styles, positions and effects of the source are not kept"

CUE_COLUMNS = ["track_id", "cue", "start_ms", "end_ms", "text", "source_number"]


@dataclass(frozen=True)
class Scan:
    cues: DataFrame
    rejects: DataFrame

    def strict(self) -> DataFrame:
        """The cues; an error that names the first fault where there is one."""
        worst = self.rejects.orderBy("track_id", "pos").first()
        if worst:
            raise ValueError(f"track {worst['track_id']}: {worst['code']} at {worst['pos']}")
        return self.cues


def decoded(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, content binary) to (path, body, code): strict UTF-8, or UTF-16 by its byte order mark."""
    head = F.hex(F.substring("content", 1, 2))
    wide = F.when(head == "FFFE", "UTF-16LE").when(head == "FEFF", "UTF-16BE")
    rest = F.expr("substring(content, 3)")
    even = F.octet_length("content") % 2 == 0
    # lone surrogates don't survive a round trip, so such bytes are told apart without raising
    sound = lambda name: (F.hex(rest).rlike(_sound(name)))
    body = (
        F.when((wide == "UTF-16LE") & even & sound("LE"), F.decode(rest, "UTF-16LE"))
        .when((wide == "UTF-16BE") & even & sound("BE"), F.decode(rest, "UTF-16BE"))
        .when(wide.isNull(), without_bom(F.try_validate_utf8(F.col("content").cast("string"))))
    )
    held = F.octet_length("content") <= most
    return files.select("path", F.when(held, body).alias("body"), F.when(~held, "too_large").when(body.isNull(), "undecodable").alias("code"))


def _sound(order: str) -> str:
    """Hex digits of UTF-16 in which surrogates come in pairs only."""
    high, low, other = ("..D[89AB]", "..D[CDEF]", "..(?:[0-9A-CEF].|D[0-7])") if order == "LE" else ("D[89AB]..", "D[CDEF]..", "(?:[0-9A-CEF].|D[0-7])..")
    return rf"^(?:{high}{low}|{other})*+\z"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?s)\.([^./\\]+)$", 1))


def format_of(path: Column) -> Column:
    """srt, vtt, json3 or ass by extension; null for any other."""
    e = extension(path)
    return F.when(e == "srt", "srt").when(e == "vtt", "vtt").when(e.isin("json", "json3"), "json3").when(e.isin("ass", "ssa"), "ass")


def _lines(body: Column) -> Column:
    return F.replace(without_bom(body), F.lit("\r\n"), F.lit("\n"))


def _finish(rows: DataFrame, tracks: DataFrame) -> Scan:
    """rows: (track_id, pos, start_ms, end_ms, text, source_number, code), one for each cue; limits and totals are added."""
    late = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "bad_time")
        .when(F.col("end_ms") <= F.col("start_ms"), "no_duration")
        .when(F.col("text") == "", "no_text")
        .when(utf16_length("text") > MOST_UNITS, "cue_too_long")
    )
    checked = rows.withColumn("code", late)
    faults = checked.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("code").isNotNull(), F.struct("pos", "code"))).alias("bad"))
    judged = tracks.select(F.col("track_id").alias("t_id")).distinct().join(faults, F.col("t_id") == F.col("track_id"), "left").select(
        F.col("t_id").alias("track_id"),
        F.coalesce("bad", F.when(F.col("n").isNull(), F.struct(F.lit(0).alias("pos"), F.lit("no_cues").alias("code"))).when(F.col("n") > MOST_CUES, F.struct(F.lit(MOST_CUES).alias("pos"), F.lit("too_many_cues").alias("code")))).alias("bad"),
    )
    rejects = judged.where("bad is not null").select("track_id", F.col("bad.pos").alias("pos"), F.col("bad.code").alias("code"))
    cues = checked.withColumn("cue", F.col("pos").cast("int")).join(rejects.select("track_id"), "track_id", "left_anti")
    return Scan(cues.select(*CUE_COLUMNS), rejects)


def _blocks(bodies: DataFrame, kind: str) -> Scan:
    parts = F.filter(F.split(_lines(F.coalesce("body", F.lit(""))), rf"\n{WS}*\n", -1), lambda b: trim(b) != "")
    if kind == "vtt":
        # a directive block counts only where it swallows a timeline, which is a fault
        directive = lambda b: trim(F.substring_index(b, "\n", 1)).rlike(rf"^(?:WEBVTT|NOTE|STYLE|REGION)(?:{WS}|\z)")
        parts = F.filter(parts, lambda b: ~directive(b) | b.rlike("(?m)" + IS_TIMELINE))
    rows = bodies.select("track_id", F.posexplode(parts).alias("pos", "block"))
    rows = rows.select("track_id", (F.col("pos") + 1).alias("pos"), F.transform(F.split("block", "\n", -1), rtrim).alias("lines"))
    first, second = F.get("lines", F.lit(0)), F.get("lines", F.lit(1))
    labelled = trim(first).rlike(r"^[0-9]+\z") if kind == "srt" else trim(first) != ""
    at = F.when(first.rlike(IS_TIMELINE), 0).when(labelled & second.rlike(IS_TIMELINE), 1)
    rows = rows.withColumn("at", at).withColumn("rest", F.slice("lines", F.coalesce("at", F.lit(0)) + 2, F.greatest(F.size("lines"), F.lit(1))))
    told = timeline(F.get("lines", F.col("at")), kind)
    body = F.array_join("rest", "\n")
    if kind == "vtt":
        # one pass over the references: the ampersand last
        for name, value in (("lt", "<"), ("gt", ">"), ("lrm", "‎"), ("rlm", "‏"), ("nbsp", " "), ("amp", "&")):
            body = F.replace(body, F.lit(f"&{name};"), F.lit(value))
    directive = trim(first).rlike(rf"^(?:WEBVTT|NOTE|STYLE|REGION)(?:{WS}|\z)") if kind == "vtt" else F.lit(False)
    number = F.when(F.col("at") == 1, trim(first).try_cast("long")) if kind == "srt" else F.lit(None).cast("long")
    return _finish(
        rows.withColumn("told", told).select(
            "track_id", "pos", F.col("told.start_ms").alias("start_ms"), F.col("told.end_ms").alias("end_ms"), clean_lines(body).alias("text"),
            F.coalesce(number, F.col("pos").cast("long")).alias("source_number"),
            F.when(directive, "timeline_in_directive").when(F.col("at").isNull(), "no_timeline").when(F.exists("rest", lambda x: x.rlike(IS_TIMELINE)), "two_timelines").alias("code"),
        ),
        bodies,
    )


def read_srt(bodies: DataFrame) -> Scan:
    return _blocks(bodies, "srt")


def read_vtt(bodies: DataFrame) -> Scan:
    return _blocks(bodies, "vtt")


def read_ass(bodies: DataFrame) -> Scan:
    """Dialogue rows of the [Events] section; the last Format line before a row names its fields."""
    default = ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"]
    lines = bodies.select("track_id", F.posexplode(F.split(_lines(F.coalesce("body", F.lit(""))), "\n", -1)).alias("at", "raw")).withColumn("line", trim("raw"))
    sofar = W.partitionBy("track_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    payload = trim(F.regexp_replace("line", r"^[^:]*:", ""))
    lines = lines.withColumn("events", F.last(F.when(F.col("line").rlike(r"(?i)^\[events\]\z"), True).when(F.col("line").startswith("["), False), True).over(sofar)).where("events")
    named = F.when(F.col("line").rlike(rf"(?i)^format{WS}*:"), F.transform(F.split(payload, ",", -1), lambda f: F.lower(trim(f))))
    lines = lines.withColumn("fields", F.coalesce(F.last(named, True).over(sofar), F.array(*map(F.lit, default)))).where(F.col("line").rlike(rf"(?i)^dialogue{WS}*:"))
    values = F.split(payload, F.lit(","), F.size("fields"))
    rows = lines.withColumn("pos", F.row_number().over(W.partitionBy("track_id").orderBy("at"))).withColumn("values", values)
    field = lambda name: F.coalesce(trim(F.get("values", F.array_position("fields", name).cast("int") - 1)), F.lit(""))
    text = F.replace(F.regexp_replace(F.regexp_replace(field("text"), r"\{[^}]*\}", ""), r"\\[Nn]", "\n"), F.lit("\\h"), F.lit(" "))
    return _finish(
        rows.select(
            "track_id", "pos", centi_clock_ms(field("start")).alias("start_ms"), centi_clock_ms(field("end")).alias("end_ms"), clean_lines(text).alias("text"), F.col("pos").cast("long").alias("source_number"),
            F.when(F.size("values") < F.size("fields"), "too_few_fields").when(~F.array_contains("fields", "text"), "no_text_field").alias("code"),
        ),
        bodies,
    )


def read_json3(bodies: DataFrame, most_characters: int = 92, most_seconds: float = 7.5) -> Scan:
    """Caption events of a JSON body; long ones are split into several cues of timed words."""
    numeric = lambda v: F.schema_of_variant(v).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")
    events = F.try_variant_get(strict_json("body"), "$.events", "array<variant>")
    rows = bodies.select("track_id", F.posexplode(events).alias("at", "event"))
    rows = rows.withColumn("segs", F.try_variant_get("event", "$.segs", "array<variant>")).where("segs is not null")
    said = F.transform("segs", lambda s: F.try_variant_get(s, "$.utf8", "variant"))
    rows = rows.withColumns({"said": said, "begin": F.try_variant_get("event", "$.tStartMs", "variant"), "lasts": F.try_variant_get("event", "$.dDurationMs", "variant")})
    known = lambda v: v.isNotNull() & (F.schema_of_variant(v) != "VOID")
    foreign = F.exists("said", lambda v: v.isNotNull() & ~F.schema_of_variant(v).isin("STRING"))
    text = clean_text(F.array_join(F.transform("said", lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))), ""))
    start = F.when(numeric(F.col("begin")), F.try_variant_get("begin", "$", "double"))
    length = F.when(numeric(F.col("lasts")), F.try_variant_get("lasts", "$", "double"))
    rows = rows.withColumns({"foreign": foreign, "text": text, "start": start, "length": length}).where("foreign or text <> ''")
    code = (
        F.when(F.col("foreign"), "segment_not_text")
        .when(F.col("start").isNull() | (F.col("start") < 0) | (F.floor(F.col("start") + 0.5) > LATEST_MS), "bad_start")
        .when(known(F.col("lasts")) & (F.col("length").isNull() | (F.col("length") <= 0)), "bad_length")
    )
    order = W.partitionBy("track_id").orderBy("start", "at")
    ahead = F.lead("start").over(order)
    end = F.when(F.col("length").isNotNull(), F.col("start") / 1000 + F.col("length") / 1000).when(ahead > F.col("start"), ahead / 1000).otherwise(F.col("start") / 1000 + 2)
    rows = rows.withColumn("code", code).withColumn("end", end).withColumn("begin_s", F.col("start") / 1000)
    rounded = lambda c: F.floor(F.col(c) * 1000 + 0.5)
    rows = rows.withColumn("code", F.coalesce("code", F.when((rounded("end") <= rounded("begin_s")) | (rounded("end") > LATEST_MS), "bad_end")))
    parts = split_words(F.col("text"), F.col("begin_s"), F.col("end"), F.lit(most_characters), F.lit(most_seconds))
    whole = F.array(F.struct(F.col("begin_s").alias("start"), F.col("end").alias("end"), F.col("text").alias("text")))
    rows = rows.withColumn("parts", F.when(F.col("code").isNull(), parts).otherwise(whole)).select("track_id", "at", "start", "code", F.posexplode("parts").alias("k", "part"))
    return _finish(
        rows.select(
            "track_id", F.row_number().over(W.partitionBy("track_id").orderBy("start", "at", "k")).alias("pos"),
            F.floor(F.col("part.start") * 1000 + 0.5).alias("start_ms"), F.floor(F.col("part.end") * 1000 + 0.5).alias("end_ms"), clean_lines("part.text").alias("text"),
            (F.col("at") + 1).cast("long").alias("source_number"), "code",
        ),
        bodies,
    )


READERS: dict[str, Callable[[DataFrame], Scan]] = {"srt": read_srt, "vtt": read_vtt, "ass": read_ass, "json3": read_json3}


def read_files(spark: SparkSession, path: str, most: int = MOST_CAPTION_BYTES) -> tuple[Scan, DataFrame]:
    """All caption files under ``path``; also (track_id, format, warning) of every file. track_id is the file's path."""
    return read_contents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), most)


def read_contents(files: DataFrame, most: int = MOST_CAPTION_BYTES) -> tuple[Scan, DataFrame]:
    bodies = decoded(files, most).withColumn("format", format_of(F.col("path"))).withColumnRenamed("path", "track_id")
    bodies = bodies.withColumn("code", F.coalesce(F.when(F.col("format").isNull(), "unsupported_format"), "code"))
    readable = bodies.where("code is null")
    scans = [reader(readable.where(F.col("format") == name)) for name, reader in READERS.items()]
    cues, rejects = scans[0].cues, bodies.where("code is not null").select("track_id", F.lit(0).alias("pos"), "code")
    for scan in scans[1:]:
        cues = cues.unionByName(scan.cues)
    for scan in scans:
        rejects = rejects.unionByName(scan.rejects)
    return Scan(cues, rejects), bodies.select("track_id", "format", F.when(F.col("format") == "ass", STYLE_WARNING).alias("warning"))
