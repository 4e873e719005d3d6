"""Checks of an ASS file against the layers that it was built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cueloom.functions.text import comparison_key, trim
from cueloom.functions.timing import same_time
from cueloom.operators.findings import finding, union


def ass_issues(bodies: DataFrame, target: DataFrame, source: DataFrame, language: str = "bilingual") -> DataFrame:
    """bodies: (track_id, body). Style, events, times and texts; and the whole body against one built anew with its own font."""
    from cueloom.sources.captions import read_ass
    from cueloom.sources.writers import FONT, ass_bodies, ass_header

    lines = bodies.select("track_id", F.posexplode(F.split("body", "\r?\n", -1)).alias("at", "raw")).withColumn("line", trim("raw"))
    sofar = W.partitionBy("track_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.lower(F.last(F.when(F.col("line").rlike(r"^\[[^\]]+\]\z"), F.regexp_extract("line", r"^\[([^\]]+)\]", 1)), True).over(sofar)))
    fields = F.transform(F.split(F.regexp_replace("line", "^[^:]*:", ""), ",", -1), trim)
    is_format, styles, events = F.col("line").rlike("(?i)^format:"), F.col("section") == "v4+ styles", F.col("section") == "events"
    dialogue = F.col("raw").rlike("(?i)^dialogue:")
    marks = F.regexp_count("raw", F.lit(r"\\N"))
    told = lines.groupBy("track_id").agg(
        F.max_by(F.when(styles & is_format, F.size(fields)), F.when(styles & is_format, F.col("at"))).alias("style_fields"),
        F.max_by(F.when(events & is_format, F.size(fields)), F.when(events & is_format, F.col("at"))).alias("event_fields"),
        F.collect_list(F.when(styles & F.col("line").rlike("(?i)^style:"), fields)).alias("styles"),
        F.count_if(dialogue).alias("events"),
        F.count_if(dialogue & (marks != (1 if language == "bilingual" else 0))).alias("odd"),
    )
    counts = target.groupBy(F.col("track_id").alias("t_track")).agg(F.count(F.lit(1)).alias("wanted"))
    rows = told.join(counts, F.col("track_id") == F.col("t_track"), "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    one = (F.size("styles") == 1) & (F.size(F.get("styles", F.lit(0))) == 23)
    font = F.get(F.get("styles", F.lit(0)), F.lit(1))
    made, problems = ass_bodies(target, source, language)
    # the body built anew, with the font that the file names
    fresh = made.select(F.col("track_id").alias("m_track"), F.substring("body", len(ass_header(language)) + 1, 2**30).alias("made_events"))
    named = F.replace(F.lit(ass_header(language)), F.lit(f"Style: Bilingual,{FONT},"), F.concat(F.lit("Style: Bilingual,"), font, F.lit(",")))
    whole = bodies.select(F.col("track_id").alias("b_track"), F.replace("body", F.lit("\r\n"), F.lit("\n")).alias("body"))
    rebuilt = rows.where(one & (F.get(F.get("styles", F.lit(0)), F.lit(1)) != "")).join(whole, F.col("track_id") == F.col("b_track")).join(fresh, F.col("track_id") == F.col("m_track"))
    bad = rows.where(one).join(problems.select(F.col("track_id").alias("p_track"), F.col("code").alias("why")), F.col("track_id") == F.col("p_track"))
    scan = read_ass(bodies)
    events_of = scan.cues.select(F.col("track_id").alias("e_track"), F.col("cue").alias("e_cue"), F.col("start_ms").alias("e_start"), F.col("end_ms").alias("e_end"), F.col("text").alias("e_text"))
    sides = target.select("track_id", "cue", "start_ms", "end_ms", F.col("text").alias("a_text")).join(source.select(F.col("track_id").alias("s_track"), F.col("cue").alias("s_cue"), F.col("text").alias("b_text")), (F.col("track_id") == F.col("s_track")) & (F.col("cue") == F.col("s_cue")))
    equal = rows.where("events = wanted").select(F.col("track_id").alias("q_track"))
    shown = {"zh": F.col("a_text"), "en": F.col("b_text"), "bilingual": F.concat("a_text", F.lit("\n"), "b_text")}[language]
    both = sides.join(equal, F.col("track_id") == F.col("q_track"), "left_semi").join(events_of, (F.col("track_id") == F.col("e_track")) & (F.col("cue") == F.col("e_cue")))
    timed = same_time(F.col("e_start"), F.col("start_ms")) & same_time(F.col("e_end"), F.col("end_ms"))
    say = lambda rows, code, seq: finding(rows, "ass", "error", code, seq=F.lit(seq))
    return union(
        say(rows.where("not (style_fields <=> 23)"), "ass_style_format", 0),
        say(rows.where(~(one & (F.get(F.get("styles", F.lit(0)), F.lit(0)) == "Bilingual"))), "ass_style_invalid", 1),
        say(rows.where("not (event_fields <=> 10)"), "ass_event_format", 2),
        say(rebuilt.where(F.concat(named, F.col("made_events")) != F.col("body")), "ass_structure_drift", 3),
        say(bad, "ass_structure_invalid", 4),
        say(rows.where("events <> wanted"), "ass_event_count", 5),
        say(rows.where("odd > 0"), "ass_row_count", 6),
        say(scan.rejects, "ass_invalid", 7),
        finding(both.where(~timed), "ass", "error", "ass_timing_drift", F.col("cue"), F.lit(8)),
        finding(both.where(comparison_key("e_text") != comparison_key(shown)), "ass", "error", "ass_text_drift", F.col("cue"), F.lit(9)),
    )


def title_issues(titles: DataFrame) -> DataFrame:
    """titles: (track_id, body) of exactly two lines, an original and a translated title."""
    lines = F.filter(F.transform(F.split("body", "\r?\n", -1), trim), lambda x: x != "")
    rows = titles.withColumn("lines", lines)
    ok = (F.size("lines") == 2) & F.get("lines", F.lit(0)).rlike(r"^Original:\s*\S") & F.get("lines", F.lit(1)).rlike(r"^Chinese:\s*\S")
    return finding(rows.where(~ok), "title", "error", "title_invalid")


def description_issues(descriptions: DataFrame) -> DataFrame:
    """descriptions: (track_id, body) with a source address, a creator and another line of text."""
    other = F.exists(F.split("body", "\r?\n", -1), lambda x: (trim(x) != "") & ~x.rlike("^(?:#|来源：|作者：)"))
    ok = F.col("body").rlike(r"(?m)^来源：[ \t]*https?://\S+") & F.col("body").rlike(r"(?m)^作者：[ \t]*\S+") & other
    return finding(descriptions.where(~ok), "description", "error", "description_invalid")
