"""Sinks: cues to SRT and ASS bodies, terms to Markdown, reports and journals to files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from cueloom.functions.text import clean_lines, clean_text, display_units, trim, utf16_length
from cueloom.functions.timing import ass_clock, srt_clock
from cueloom.operators.layers import MAX_ENGLISH, MAX_UNITS, paired

FONT, SCREEN, TARGET_SIZE, SOURCE_SIZE = "Noto Sans CJK SC", (1920, 1080), 56, 32


def _in_order(key: str, value: str, joiner: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), joiner)


def srt_bodies(cues: DataFrame) -> DataFrame:
    """(track_id, body): SRT text, cues numbered from 1 in order. A time that a file can't hold makes the body null."""
    block = F.concat(srt_clock(F.col("start_ms")), F.lit(" --> "), srt_clock(F.col("end_ms")), F.lit("\n"), clean_lines("text"))
    held = cues.select("track_id", F.struct("cue", block.alias("block")).alias("x"), block.isNull().alias("bad"))
    ordered = held.groupBy("track_id").agg(F.array_sort(F.collect_list("x")).alias("all"), F.bool_or("bad").alias("bad"))
    body = F.concat(F.array_join(F.transform("all", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["block"])), "\n\n"), F.lit("\n"))
    return ordered.select("track_id", F.when(~F.col("bad"), body).alias("body"))


def ass_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(clean_lines(text), F.lit("{"), F.lit("｛")), F.lit("}"), F.lit("｝")), F.lit("\n"), F.lit("\\N"))


def ass_header(language: str = "bilingual", font: str = FONT, screen: tuple[int, int] = SCREEN, target_size: int = TARGET_SIZE, source_size: int = SOURCE_SIZE, title: str = "cueloom") -> str:
    """Script, style (23 fields) and event (10 fields) headers; the bottom margin is 8 % of the height."""
    style = "Name Fontname Fontsize PrimaryColour SecondaryColour OutlineColour BackColour Bold Italic Underline StrikeOut ScaleX ScaleY Spacing Angle BorderStyle Outline Shadow Alignment MarginL MarginR MarginV Encoding".split()
    event = "Layer Start End Style Name MarginL MarginR MarginV Effect Text".split()
    size = source_size if language == "en" else target_size
    values = ["Bilingual", font, size, "&H00FFFFFF", "&H00FFFFFF", "&H00000000", "&HFF000000", 0, 0, 0, 0, 100, 100, 0, 0, 1, 2, 0, 2, 80, 80, int(screen[1] * 0.08 + 0.5), 1]
    return "\n".join([
        "[Script Info]", f"Title: {title} {language}", f"; SubtitleLanguage: {language}", "ScriptType: v4.00+", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "YCbCr Matrix: TV.709", f"PlayResX: {screen[0]}", f"PlayResY: {screen[1]}",
        "", "[V4+ Styles]", "Format: " + ", ".join(style), "Style: " + ",".join(map(str, values)), "", "[Events]", "Format: " + ", ".join(event), "",
    ])


def ass_bodies(target: DataFrame, source: DataFrame, language: str = "bilingual", font: str = FONT, source_size: int = SOURCE_SIZE, **style: object) -> tuple[DataFrame, DataFrame]:
    """(bodies, problems): (track_id, body) of tracks without a problem, and (track_id, cue, code), the first of each other.

    Both layers have equal counts and times, one line a cue, and keep within the widths.
    """
    if language not in ("bilingual", "zh", "en"):
        raise ValueError(f"language {language!r}")
    font = font.strip()
    if not font or "," in font or any(ord(c) < 32 or ord(c) == 127 for c in font):
        raise ValueError("a font name without commas and control characters is needed")
    both, differ = paired(target, source)
    lines = lambda c: F.filter(F.split(c, "\n", -1), lambda x: trim(x) != "")
    near = lambda a, b: F.abs(F.col(a) / 1000 - F.col(b) / 1000) <= F.lit(0.002)
    rows = both.withColumns({"a": lines("a_text"), "b": lines("b_text")})
    rows = rows.withColumns({"a1": F.coalesce(F.get("a", F.lit(0)), F.lit("")), "b1": F.coalesce(F.get("b", F.lit(0)), F.lit(""))})
    code = (
        F.when(~(near("a_start", "b_start") & near("a_end", "b_end")), "ass_times_differ")
        .when(F.size("a") != 1, "ass_target_lines").when(F.size("b") != 1, "ass_source_lines")
        .when(display_units("a1") > MAX_UNITS, "ass_target_wide").when(utf16_length(clean_text("b1")) > MAX_ENGLISH, "ass_source_wide")
    )
    rows = rows.withColumn("code", code)
    problems = rows.where("code is not null").select("track_id", "cue", "code").unionByName(differ.select("track_id", F.lit(0).alias("cue"), F.lit("ass_counts_differ").alias("code")))
    problems = problems.groupBy("track_id").agg(F.min(F.struct("cue", "code")).alias("p")).select("track_id", "p.cue", "p.code")
    a, b = ass_escape(F.col("a1")), ass_escape(F.col("b1"))
    shown = {"zh": a, "en": b, "bilingual": F.concat(a, F.lit(f"\\N{{\\fs{source_size}}}"), b)}[language]
    event = F.concat(F.lit("Dialogue: 0,"), ass_clock(F.col("a_start")), F.lit(","), ass_clock(F.col("a_end")), F.lit(",Bilingual,,0,0,0,,{\\q2}"), shown)
    made = rows.withColumn("event", event).groupBy("track_id").agg(_in_order("cue", "event", "\n").alias("events")).join(problems.select("track_id"), "track_id", "left_anti")
    head = ass_header(language, font, source_size=source_size, **style)
    return made.select("track_id", F.concat(F.lit(head), "events", F.lit("\n")).alias("body")), problems


def glossary_markdown(terms: DataFrame) -> DataFrame:
    """(track_id, body): a table of a glossary's terms in their order."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("en")), cell(F.col("target")), cell(F.col("category")), cell(F.array_join(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), ", ")), cell(F.col("rationale"))), F.lit(" |"))
    head = "# Glossary\n\n| Source | Target | Category | Aliases | Rationale |\n| --- | --- | --- | --- | --- |\n"
    return terms.withColumn("row", row).groupBy("track_id").agg(_in_order("pos", "row", "\n").alias("rows")).select("track_id", F.concat(F.lit(head), "rows", F.lit("\n")).alias("body"))


def append_journal(changes: DataFrame, path: str) -> None:
    """Adds rows to a journal of JSON lines."""
    changes.write.mode("append").json(path)


def replace_folder(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes beside ``path`` and then takes its place by a rename, so a reader sees the old rows or the new ones."""
    spark = rows.sparkSession
    part, old = f"{path}.{uuid.uuid4().hex}.part", f"{path}.{uuid.uuid4().hex}.old"
    rows.write.format(kind).save(part)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        files.rename(at(path), at(old))
    if not files.rename(at(part), at(path)):
        files.rename(at(old), at(path))
        raise OSError(f"{part} can't be renamed to {path}")
    files.delete(at(old), True)
