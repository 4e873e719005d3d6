"""Clock formats and the tolerance of time comparisons. Times at rest are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cueloom.functions.text import WS, trim

#: The last time that a caption file can hold.
LATEST_MS = 3_599_999_999
CLOCK = r"(?:[0-9]{1,3}:)?[0-9]{1,2}:[0-9]{1,2}[,.][0-9]{1,3}"


def same_time(a: Column, b: Column) -> Column:
    """Two millisecond columns within 2 ms, decided in double seconds."""
    return F.abs(a / F.lit(1000.0) - b / F.lit(1000.0)) <= F.lit(0.002)


def before(a: Column, b: Column) -> Column:
    """Whether a is over 2 ms before b, decided in double seconds."""
    return a / F.lit(1000.0) < b / F.lit(1000.0) - F.lit(0.002)


def clock_ms(text: Column) -> Column:
    """[H:]M:S,ms as milliseconds; null where it is none or a minute or second is over 59."""
    pattern = r"^(?:([0-9]{1,3}):)?([0-9]{1,2}):([0-9]{1,2})[,.]([0-9]{1,3})\z"
    part = lambda i: F.regexp_extract(trim(text), pattern, i)
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    total = number(part(1)) * 3_600_000 + number(part(2)) * 60_000 + number(part(3)) * 1000 + number(F.rpad(part(4), 3, "0"))
    return F.when(trim(text).rlike(pattern) & (number(part(2)) <= 59) & (number(part(3)) <= 59), total)


def centi_clock_ms(text: Column) -> Column:
    """H:MM:SS.cc as milliseconds, or null."""
    pattern = r"^([0-9]{1,2}):([0-9]{2}):([0-9]{2})[.]([0-9]{2})\z"
    part = lambda i: F.regexp_extract(trim(text), pattern, i).try_cast("long")
    return F.when(trim(text).rlike(pattern), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4) * 10)


def srt_clock(ms: Column) -> Column:
    """HH:MM:SS,mmm; null outside what a file can hold."""
    shown = F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)
    return F.when(ms.between(0, LATEST_MS), shown)


def ass_clock(ms: Column) -> Column:
    """H:MM:SS.cc, rounded to hundredths, never negative."""
    centi = F.greatest(F.lit(0), F.floor(ms / 10 + F.lit(0.5))).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(centi / 360_000), F.floor(centi % 360_000 / 6000), F.floor(centi % 6000 / 100), centi % 100)


def timeline(line: Column, kind: str) -> Column:
    """struct<start_ms,end_ms> of a timeline line; null fields where it isn't one."""
    tail = rf"(?:{WS}+X1:[0-9]+{WS}+X2:[0-9]+{WS}+Y1:[0-9]+{WS}+Y2:[0-9]+)?" if kind == "srt" else rf"(?:{WS}+[A-Za-z][\w-]*:(?!{WS})\S+)*"
    pattern = rf"^{WS}*({CLOCK}){WS}*-->{WS}*({CLOCK}){tail}{WS}*\z"
    ok = line.rlike(pattern) & (F.regexp_count(line, F.lit("-->")) == 1)
    return F.struct(F.when(ok, clock_ms(F.regexp_extract(line, pattern, 1))).alias("start_ms"), F.when(ok, clock_ms(F.regexp_extract(line, pattern, 2))).alias("end_ms"))


IS_TIMELINE = rf"^{WS}*{CLOCK}{WS}*-->"
