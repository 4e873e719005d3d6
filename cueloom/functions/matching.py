"""Occurrences of terms in text, with positions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from cueloom.functions.text import simple_fold, source_form


def _wordy(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def occurrences(text: str, form: str, exact_case: bool) -> list[tuple[int, int]]:
    """Spans of a form in NFKC text, left to right.

    A form that begins with a letter or number needs another character before it that no earlier occurrence has used (or the
    text's beginning); one that ends so needs another after it. A blank in the form stands for any run of white space.
    """
    wanted, shown = (form, text) if exact_case else (simple_fold(form), simple_fold(text))
    parts = wanted.split(" ")
    if not form or len(shown) != len(text):
        return []
    begins, ends, out, free, at = _wordy(wanted[0]), _wordy(wanted[-1]), [], 0, 0
    while (start := shown.find(parts[0], at)) >= 0:
        at, end = start + 1, start + len(parts[0])
        for part in parts[1:]:
            gap = end
            while end < len(shown) and (shown[end].isspace() or shown[end] == "﻿"):
                end += 1
            if end == gap or not shown.startswith(part, end):
                end = -1
                break
            end += len(part)
        if end < 0 or begins and start > 0 and (start - 1 < free or _wordy(shown[start - 1])) or ends and end < len(shown) and _wordy(shown[end]):
            continue
        if start < free:
            continue
        out.append((start, end))
        free = at = end
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("exact", T.StringType())])))
def term_occurrences(text: pa.Array, form: pa.Array, exact_case: pa.Array) -> pa.Array:
    """Spans (code points) and normalised wording of a form's occurrences in NFKC text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("exact", pa.string())]))
    rows = zip(text.to_pylist(), form.to_pylist(), exact_case.to_pylist(), strict=True)
    return pa.array([None if t is None or f is None else [{"start": a, "end": b, "exact": source_form(t[a:b])} for a, b in occurrences(t, f, bool(c))] for t, f, c in rows], kind)
