"""Text functions as Column builders.

All of them follow ECMAScript string semantics, as caption tools do: white space includes U+FEFF and U+3000 but not U+0085,
and lengths are UTF-16 units. Unicode normalisation has no SQL function, so one Arrow UDF gives all its forms in one pass.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

#: Inside a Java character class: white space as ECMAScript has it.
BLANK = r"\s\x{FEFF}&&[^\x{85}]"
WS = rf"(?U:[{BLANK}])"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), rf"^{WS}+|{WS}+\z", "")


def rtrim(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), rf"{WS}+\z", "")


def squeeze(value: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return trim(F.regexp_replace(_col(value), f"{WS}+", " "))


def without_bom(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), r"^\x{FEFF}", "")


def utf16_length(value: Column | str) -> Column:
    return F.length(_col(value)) + F.regexp_count(_col(value), F.lit(r"[\x{10000}-\x{10FFFF}]"))


def strict_json(value: Column | str) -> Column:
    """The variant of a JSON text; null unless the text is one value and nothing else.

    Spark's parser stops behind the first value. So the text is read as the first of two elements whose second, its digest,
    can't be part of it.
    """

    def first(text: Column) -> Column:
        digest = F.sha2(text, 256)
        both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]'))), "$", "array<variant>")
        return F.get(F.transform(F.array(both), lambda b: F.when((F.size(b) == 2) & F.try_variant_get(F.get(b, F.lit(1)), "$", "string").eqNullSafe(digest), F.get(b, F.lit(0)))), F.lit(0))

    # lambda variables, so that neither the text nor the parsed value is computed anew for each use
    return F.get(F.transform(F.array(_col(value)), first), F.lit(0))


#: Tags that mark up captions; any other angle bracket is speech.
_TAGS = r"(?i)</?(?:i|b|u|s|font|lang|ruby|rt|v(?:" + WS + r"+[^>]*)?|c(?:\.[\w-]+)*)(?:" + WS + r"+[^>]*)?>"


#: What cleaning might change: anything but single blanks between characters that it never touches.
_UNCLEAN = r"[^\x{20}-\x{3B}\x{3D}-\x{7E}\x{A1}-\x{2FF}\x{3001}-\x{303F}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF60}]|^ | \z|  "


def _unless_clean(value: Column | str, clean: Callable[[Column], Column]) -> Column:
    """``clean`` of a text, by one pattern only for texts that it leaves as they are; null counts as empty."""
    text = F.coalesce(_col(value), F.lit(""))
    return F.when(F.regexp_like(text, F.lit(_UNCLEAN)), clean(text)).otherwise(text)


def clean_lines(value: Column | str) -> Column:
    """Caption text without markup, its line breaks kept; null counts as empty."""
    return _unless_clean(value, _clean_lines)


def _clean_lines(text: Column) -> Column:
    text = without_bom(text)
    text = F.translate(text, " ⁠", "  ")
    text = F.regexp_replace(text, rf"(?i)<br{WS}*/?>", "\n")
    text = F.regexp_replace(text, _TAGS, "")
    text = F.regexp_replace(text, r"<[0-9]{1,3}:[0-9]{2}(?::[0-9]{2})?[.,][0-9]{3}>", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return trim(F.regexp_replace(text, r" *\n+ *", "\n"))


def clean_text(value: Column | str) -> Column:
    """Caption text on one line."""
    return _unless_clean(value, lambda text: squeeze(_clean_lines(text)))


def comparison_key(value: Column | str) -> Column:
    """Caption text without any white space."""
    return F.regexp_replace(clean_text(value), f"{WS}+", "")


_WIDE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\x{3001}-\x{303F}\x{FF01}-\x{FF60}“”‘’…&&[^\p{M}]]"


def display_units(value: Column | str) -> Column:
    """Columns on screen: wide characters 1, marks 0, all others one half."""
    text = _col(value)
    return (F.length(F.regexp_replace(text, r"\p{M}", "")) + F.regexp_count(text, F.lit(_WIDE))) * F.lit(0.5)


def numbers(value: Column | str) -> Column:
    """Sorted number strings without thousands commas, repeats kept."""
    return F.array_sort(F.transform(F.regexp_extract_all(_col(value), F.lit(r"[0-9]+(?:[.,][0-9]+)*%?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def latin_words(value: Column | str) -> Column:
    return F.regexp_extract_all(_col(value), F.lit(r"[A-Za-z][A-Za-z'-]+"), F.lit(0))


def graphemes(value: Column | str) -> Column:
    return F.regexp_extract_all(_col(value), F.lit(r"(?s)\X"), F.lit(0))


def simple_fold(text: str) -> str:
    """Case folding one code point at a time, as ignore-case regular expressions with the u flag compare."""
    if text.isascii():
        return text.lower()
    out = []
    for c in text:
        folded = c.casefold()
        if len(folded) != 1:
            folded = c.lower()
        out.append(folded if len(folded) == 1 else c)
    return "".join(out)


def source_form(text: str) -> str:
    return " ".join(part for part in unicodedata.normalize("NFKC", text).replace("﻿", " ").split() if part)


def _each(values: pa.Array, function) -> pa.Array:
    return pa.array([None if v is None else function(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("nfc", "nfkc", "fold")]))
def unicode_forms(values: pa.Array) -> pa.Array:
    """NFC, NFKC and the simple case folding of NFKC."""
    nfkc = _each(values, lambda v: unicodedata.normalize("NFKC", v))
    return pa.StructArray.from_arrays([_each(values, lambda v: unicodedata.normalize("NFC", v)), nfkc, _each(nfkc, simple_fold)], ["nfc", "nfkc", "fold"])


def has_capital(value: Column | str) -> Column:
    """Default case sensitivity of a term: whether it has a capital letter."""
    return _col(value).rlike(r"[\p{Lu}\p{Lt}]")


def quoted(value: Column) -> Column:
    """A string as a regular expression that matches it alone."""
    return F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|\-&#~])", r"\\$1")


def term_pattern(form: Column) -> Column:
    """A pattern for a normalised form: whole words where it begins or ends with a letter or number, any inner white space."""
    begins, ends = form.rlike(r"^[\p{L}\p{N}]"), form.rlike(r"[\p{L}\p{N}]\z")
    return F.concat(
        F.when(begins, r"(?<![\p{L}\p{N}])").otherwise(""),
        F.regexp_replace(quoted(form), " ", WS.replace("\\", "\\\\") + "+"),
        F.when(ends, r"(?![\p{L}\p{N}])").otherwise(""),
    )


def slug(value: Column, fallback: str = "track") -> Column:
    """Lower-case letters and numbers joined by hyphens, 48 at most; reserved device names get a suffix."""
    base = F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+\z", ""), 1, 48)
    base = F.when(base == "", fallback).otherwise(base)
    return F.when(base.rlike(r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])\z"), F.concat(base, F.lit("-job"))).otherwise(base)


def term_slug(value: Column) -> Column:
    base = F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), r"^-+|-+\z", ""), 1, 48)
    return F.when(base == "", "term").otherwise(base)
