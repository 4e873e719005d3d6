"""Word timing and the splitting of long caption events."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import functions as F, types as T

#: Words before which a long event may be cut, and characters that close or open a quotation or bracket beside a cut.
LINKING = frozenset("and but which that because so while where when then".split())
CLOSERS, OPENERS = "\"'’”)]", "\"'‘“(["
PAUSE = (",", ";", ":")


def units(text: str) -> int:
    """UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def timed_words(text: str, start: float, end: float) -> list[tuple[str, float, float]]:
    """Words that share the time by their number of characters; the last one ends with the event."""
    words = re.findall(r"\S+", text)
    total, at, out = sum(map(len, words)), start, []
    for i, word in enumerate(words):
        upto = end if i == len(words) - 1 else at + (end - start) * len(word) / total
        out.append((word, at, upto))
        at = upto
    return out


def cut_points(words: list[str], most: int) -> list[int]:
    """Ends of the groups into which words are dealt: none over 1.2 times ``most`` units where a cut allows it.

    A cut keeps at least a third of ``most`` (0.35, and 20) on both sides and is the one nearest to ``most``, the earlier of
    two as near; after a pause or before a linking word where there is such a cut.
    """
    least, limit = max(20, math.floor(most * 0.35)), math.floor(most * 1.2)
    sums = [0]
    for word in words:
        sums.append(sums[-1] + units(word) + 1)
    width = lambda a, b: sums[b] - sums[a] - 1 if b > a else 0
    pause = [False] + [w.rstrip(CLOSERS).endswith(PAUSE) for w in words]
    link = [w.lower().lstrip(OPENERS) in LINKING for w in words] + [False]
    out, start, n = [], 0, len(words)
    while width(start, n) > limit and start < n - 1:
        end = start + 1
        while end < n and width(start, end + 1) <= limit:
            end += 1
        fit = [k for k in range(start + 1, end + 1) if width(start, k) >= least and width(k, n) >= least]
        usable = [k for k in fit if pause[k] or link[k]] or fit
        start = min(usable, key=lambda k: abs(width(start, k) - most)) if usable else end
        out.append(start)
    if start < n:
        out.append(n)
    return out


def split_event(text: str, start: float, end: float, most_characters: int, most_seconds: float) -> list[dict]:
    words = timed_words(text, start, end)
    most = most_characters
    if end - start > most_seconds:
        most = max(20, min(most, math.ceil(units(text) * most_seconds / (end - start))))
    out, low = [], 0
    for high in cut_points([w for w, _, _ in words], most):
        out.append({"start": words[low][1], "end": words[high - 1][2], "text": " ".join(w for w, _, _ in words[low:high])})
        low = high
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])))
def split_words(text: pa.Array, start: pa.Array, end: pa.Array, characters: pa.Array, seconds: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))
    rows = zip(text.to_pylist(), start.to_pylist(), end.to_pylist(), characters.to_pylist(), seconds.to_pylist(), strict=True)
    return pa.array([split_event(*r) if r[0] and r[1] is not None and r[2] is not None else [] for r in rows], kind)
