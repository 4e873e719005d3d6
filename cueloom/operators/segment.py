"""Readable layers: long cues become short ones whose texts join to the original and whose times tile it.

A cue of the target language is cut into as many chunks as its width demands, at the cheapest legal places; the source text
into as many at word ends; the time is dealt by width. Both cuts are shortest paths, solved for one cue at a time in an Arrow
UDF; cues that need no cut never reach it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import cache
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types

from cueloom.functions.matching import occurrences
from cueloom.functions.text import clean_text, comparison_key, display_units, graphemes, unicode_forms, utf16_length
from cueloom.operators import terms as T
from cueloom.operators.layers import EPSILON, MAX_ENGLISH, MAX_UNITS
from cueloom.operators.words import units as utf16_units

SHORTEST_S, MOST_UNITS = 0.45, 4_000

# Fixed values of the layout rules.
STRONG, SOFT = "。！？；!?;", "，、：,:"
OPENING, CLOSING = "（【《“‘([<\"'", "）】》”’)]>，。！？；：,.!?;:"
PAIRS = ("（）", "【】", "《》", "“”", "‘’", "()", "[]")
CONNECTIVES = ("但", "而", "因为", "所以", "如果", "不过", "同时", "然后", "以及", "并且")
AFTER = "了着过里中上下前后时吧呢吗啊"
NO_CUT = 40


def width(text: str) -> float:
    """Display units, as :func:`cueloom.functions.text.display_units`."""
    return sum(map(_width, text))


@cache
def _width(c: str) -> float:
    if unicodedata.category(c)[0] == "M":
        return 0.0
    if c in "“”‘’…" or "、" <= c <= "〿" or "！" <= c <= "｠":
        return 1.0
    name = unicodedata.name(c, "")
    return 1.0 if name.startswith(("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HIRAGANA", "KATAKANA", "HANGUL", "HALFWIDTH KATAKANA", "HALFWIDTH HANGUL")) or c in "々〇〡〢〣〤〥〦〧〨〩〸〹〺〻" else 0.5


#: A place where a target text may be cut: not inside a word of ASCII letters and digits, and not before a closing mark.
_PLACE = re.compile(f"(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])|(?=[^A-Za-z0-9的{re.escape(CLOSING)}])")


@cache
def _class(c: str) -> str:
    return unicodedata.category(c)[0]


@cache
def _ascii_wordy(c: str) -> bool:
    return c.isascii() and c.isalnum()


def cut_costs(text: str, clusters: list[str] | None, terms: list[str]) -> dict[int, int]:
    """Legal cuts of a target text (offsets) and what each costs; 0 at the end of the text. clusters None: each character is one."""
    open_until: list[bool] = []
    for left, right in PAIRS:
        if left not in text:
            continue
        last, open_until = False, open_until or [False] * (len(text) + 1)
        for i, c in enumerate(text):
            last = True if c == left else False if c == right else last
            open_until[i + 1] |= last
    spans = []
    normal = unicodedata.normalize("NFC", text)
    for term in terms:
        at = normal.find(term)
        while at >= 0:
            spans.append((at, at + len(term)))
            at = normal.find(term, at + 1)
    costs = {len(text): 0}
    whole = None if clusters is None else set(accumulate(map(len, clusters)))
    for place in _PLACE.finditer(text, 1):
        cut = place.start()
        a, b = text[cut - 1], text[cut]
        if a in OPENING or open_until and open_until[cut] or whole is not None and cut not in whole:
            continue
        if _class(a) == "N" and (_class(b) == "L" or b in "%％°℃℉"):
            continue
        if spans:
            inside = len(unicodedata.normalize("NFC", text[:cut]))
            if any(x < inside < y for x, y in spans):
                continue
        if a in STRONG:
            cost = 0
        elif a in SOFT or a.isspace():
            cost = 1
        elif text.startswith(CONNECTIVES, cut):
            cost = 2
        elif a in AFTER:
            cost = 4
        else:
            cost = 5 if _ascii_wordy(a) != _ascii_wordy(b) else NO_CUT
        if cost < NO_CUT:
            costs[cut] = cost
    return costs


def _cheapest(at: list[float], ink: list[int], extra: list[float], count: int, fair: float, most: float, gap: float, narrow: float) -> list[int] | None:
    """Numbers of the ends of ``count`` chunks with the least sum of costs, the earliest predecessor of equal ones.

    ``at`` and ``ink`` are the width of the text and the pieces that aren't blank up to each end. A chunk, ``gap`` less than
    what lies between two ends, is no wider than ``most`` and not blank; it costs the square of its distance to ``fair``, what
    its end adds, and 15 for each unit below ``narrow``. Ends after which the remaining chunks can't hold what is left are
    passed over, and so are those that no path as cheap as one near the even cut can have: the squares of chunks that fill a
    given width are least where all are as wide.
    """
    final, total, share = len(at) - 1, at[-1], gap + fair

    def reach(k: int, rest: int) -> tuple[int, int]:
        least = bisect_left(at, total - rest * (most + gap)) if rest else final
        return max(k + 1, least), min(final + 1 - rest, bisect_right(at, (at[k] if k >= 0 else 0) + most + gap, k + 1))

    def cost(k: int, j: int) -> float:
        wide = at[j] - (at[k] if k >= 0 else 0) - gap
        return (wide - fair) ** 2 + extra[j] + max(0.0, narrow - wide) * 15

    bound, k = 0.0, -1
    for rest in range(count - 1, -1, -1):
        low, high = reach(k, rest)
        if low >= high:
            bound = math.inf
            break
        near = min(max(bisect_left(at, total * (count - rest) / count), low), high - 1)
        near -= near > low and at[near] - total * (count - rest) / count > total * (count - rest) / count - at[near - 1]
        if ink[near] == (ink[k] if k >= 0 else 0):
            bound = math.inf
            break
        bound, k = bound + cost(k, near), near
    spare = bound * (1 + 1e-9) + 1e-6 - min(extra) * count - (total - count * share) ** 2 / count
    layers: list[dict[int, tuple[float, int]]] = [{-1: (0.0, -2)}]
    for rest in range(count - 1, -1, -1):
        following: dict[int, tuple[float, int]] = {}
        first, behind = 0, final + 1
        if rest and spare < math.inf:
            done = count - rest
            middle, off = (done * share * rest + (total - rest * share) * done) / count, math.sqrt(max(0.0, spare) * done * rest / count) + 1e-6
            first, behind = bisect_left(at, middle - off), bisect_right(at, middle + off)
        for k, (spent, _) in sorted(layers[-1].items()):
            low, high = reach(k, rest)
            before, dark = ((at[k], ink[k]) if k >= 0 else (0, 0))
            for j in range(max(low, first), min(high, behind)):
                wide = at[j] - before - gap
                added = spent + ((wide - fair) ** 2 + extra[j] + (narrow - wide) * 15 if wide < narrow else (wide - fair) ** 2 + extra[j])
                if ink[j] > dark and (j not in following or added < following[j][0]):
                    following[j] = (added, k)
        layers.append(following)
    if final not in layers[-1]:
        return None
    out, k = [], final
    for layer in reversed(layers[1:]):
        out.append(k)
        k = layer[k][1]
    return out[::-1]


def cut_target(text: str, clusters: list[str] | None, count: int, terms: list[str], most: float = MAX_UNITS) -> list[str] | None:
    """``count`` chunks of a target text, none wider than ``most``, or None."""
    if count == 1:
        return [text] if width(text) <= most else None
    costs = cut_costs(text, clusters, terms)
    ends = sorted(costs)
    sums = [0.0, *accumulate(map(_width, text))]
    ink = list(accumulate(not text[a:b].isspace() for a, b in pairwise([0, *ends])))
    found = _cheapest([sums[e] for e in ends], ink, [costs[e] * 12 for e in ends], count, sums[-1] / count, most, 0, 4)
    return found and [text[a:b].strip() for a, b in pairwise([0, *(ends[k] for k in found)])]


def cut_source(text: str, count: int, terms: list[tuple[str, bool]], most: int = MAX_ENGLISH) -> list[str] | None:
    """``count`` chunks of whole words, none over ``most`` UTF-16 units, no term cut; or None."""
    words = text.split()
    if count == 1:
        return [text] if utf16_units(text) <= most else None
    if len(words) < count:
        return None
    ends = list(range(1, len(words) + 1))
    if terms:
        shown = [unicodedata.normalize("NFKC", w) for w in words]
        line, starts = " ".join(shown), [0, *accumulate(len(w) + 1 for w in shown)]
        spans = [s for form, exact in terms for s in occurrences(line, form, exact)]
        ends = [k for k in ends if k == len(words) or not any(a < starts[k] - 1 < b for a, b in spans)]
    sums = [0, *accumulate(len(w) + 1 for w in words)] if text.isascii() else [0, *accumulate(utf16_units(w) + 1 for w in words)]
    fair = (sums[-1] - 1) / count
    # protected ends only bar a cut: chunks may run over them
    extra = [-12 if words[k - 1].endswith((".", "!", "?", ",", ";", ":")) else 0 for k in ends]
    found = _cheapest([sums[k] for k in ends], ends, extra, count, fair, most, 1, 0) if len(ends) >= count else None
    return found and [" ".join(words[a:b]) for a, b in pairwise([0, *(ends[k] for k in found)])]


def windows(start: float, end: float, weights: list[float], shortest: float = SHORTEST_S) -> list[tuple[float, float]] | None:
    """Adjoining windows: ``shortest`` each and the rest by weight; None where the time doesn't suffice."""
    spare = end - start - shortest * len(weights)
    if end - start < shortest * len(weights):
        return None
    total, at, out = sum(weights), start, []
    for i, weight in enumerate(weights):
        upto = end if i == len(weights) - 1 else at + shortest + spare * weight / total
        out.append((at, upto))
        at = upto
    return out


_PART = types.StructType([types.StructField(n, types.DoubleType()) for n in ("start", "end")] + [types.StructField(n, types.StringType()) for n in ("target", "source")])
_TYPE = types.StructType([types.StructField("problem", types.StringType()), types.StructField("parts", types.ArrayType(_PART))])
_PARTS = pa.struct([("problem", pa.string()), ("parts", pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("target", pa.string()), ("source", pa.string())])))])


@F.arrow_udf(_TYPE)
def cut_cue(count: pa.Array, target: pa.Array, clusters: pa.Array, targets: pa.Array, source: pa.Array, sources: pa.Array, start: pa.Array, end: pa.Array, bilingual: pa.Array) -> pa.Array:
    rows = zip(*[x.to_pylist() for x in (count, target, clusters, targets, source, sources, start, end, bilingual)], strict=True)
    return pa.array([None if row[0] is None else _cut(*row) for row in rows], _PARTS)


def _cut(count: int, target: str, clusters: list[str] | None, targets: list[str] | None, source: str, sources: list[dict] | None, start: float, end: float, bilingual: bool) -> dict:
    top = cut_target(target, clusters, count, targets or [])
    if top is None:
        return {"problem": "target_unsplittable", "parts": None}
    low = [source] if count == 1 else cut_source(source, count, [(f["norm"], f["exact_case"]) for f in sources or []])
    if low is None:
        if bilingual:
            return {"problem": "source_unsplittable", "parts": None}
        low = [source] * count
    dealt = windows(start, end, [max(width(a), utf16_units(b) / 2, 1) for a, b in zip(top, low, strict=True)])
    if dealt is None:
        return {"problem": "too_short", "parts": None}
    return {"problem": None, "parts": [{"start": s, "end": e, "target": a, "source": b} for (s, e), a, b in zip(dealt, top, low, strict=True)]}


#: Characters that may be part of a grapheme of several: text without any is cut between all of its characters.
_JOINED = r"[^\x{20}-\x{7E}\x{A1}-\x{A8}\x{AA}-\x{AC}\x{AF}-\x{2FF}\x{2010}-\x{2027}\x{3001}-\x{3029}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF60}]"


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """(track_id, cue, a_start, a_end, a_text, b_start, b_end, b_text, differ), all in the partitions of the tracks.

    A row for each cue of ``left`` with that of the same number in ``right``; of tracks whose layers differ in their numbers of
    cues one row, which has ``differ``. Both layers go through one shuffle by track, and none if they lie in such already.
    """
    side = lambda d, k: d.where("cue is not null").select("track_id", "cue", F.lit(k).alias("side"), "start_ms", "end_ms", "text")
    order, track = W.partitionBy("track_id").orderBy("cue", "side"), W.partitionBy("track_id")
    rows = side(left, 0).unionByName(side(right, 1)).withColumns({"next": F.lead(F.struct("cue", "side", "start_ms", "end_ms", "text")).over(order), "n": F.row_number().over(order)})
    rows = rows.withColumn("differ", F.sum(1 - 2 * F.col("side")).over(track) != 0)
    met = (F.col("side") == 0) & (F.col("next.side") == 1) & (F.col("next.cue") == F.col("cue"))
    rows = rows.where(F.when(F.col("differ"), F.col("n") == 1).otherwise(met & F.col("track_id").isNotNull()))
    return rows.select("track_id", "cue", F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"), F.col("text").alias("a_text"), F.col("next.start_ms").alias("b_start"), F.col("next.end_ms").alias("b_end"), F.col("next.text").alias("b_text"), "differ")


def readable_layers(source: DataFrame, translated: DataFrame, glossary: DataFrame | None = None, decisions: DataFrame | None = None, bilingual: bool = False) -> tuple[DataFrame, DataFrame]:
    """(layers, problems): layers are (track_id, cue, parent_cue, start_ms, end_ms, target, source) of tracks without a problem.

    problems: (track_id, cue, code), the first of each track: layer_misaligned, cue_too_long, target_unsplittable,
    source_unsplittable, too_short.
    """
    near = lambda a, b: F.abs(F.col(a) / 1000 - F.col(b) / 1000) <= F.lit(EPSILON)
    apart = F.col("differ") | ~(near("a_start", "b_start") & near("a_end", "b_end"))
    early = F.when(apart, "layer_misaligned").when((utf16_length("a_text") > MOST_UNITS) | (utf16_length("b_text") > MOST_UNITS), "cue_too_long")
    # the cleaned texts are made once: their many patterns would run anew for each use
    rows = _beside(source, translated).withColumn("early", early).withColumn("c", F.explode(F.array(F.struct(clean_text("b_text").alias("target"), clean_text("a_text").alias("source"))))).select("*", "c.target", "c.source")
    needed = F.ceil(display_units("target") / MAX_UNITS)
    rows = rows.withColumn("count", F.greatest(F.lit(1), needed, F.ceil(utf16_length("source") / MAX_ENGLISH) if bilingual else F.lit(1)).cast("int"))
    rows = rows.withColumns({"near_targets": F.expr("cast(null as array<string>)"), "near_sources": F.expr("cast(null as array<struct<norm:string,exact_case:boolean>>)")})
    approved = None
    for part in (glossary, decisions.where("approval = 'approved'") if decisions is not None else None):
        if part is not None:
            part = part.select("track_id", "pos", "en", "aliases", "case_sensitive", "target")
            approved = part if approved is None else approved.unionByName(part.withColumn("pos", F.col("pos") + 100_000))
    if approved is not None:
        # only cues that are cut look for terms
        long_ = rows.where("count > 1 and early is null")
        t = T.target_hits(long_.select("track_id", "cue", F.col("target").alias("text")), approved.select("track_id", "target"), 1)
        t = t.groupBy(F.col("track_id").alias("t_track"), F.col("cue").alias("t_cue")).agg(F.array_sort(F.collect_set("term")).alias("t_terms"))
        s = T.hits(long_.select("track_id", "cue", F.col("source").alias("text")), T.forms(approved).where(F.contains("norm", F.lit(" "))))
        s = s.groupBy(F.col("track_id").alias("s_track"), F.col("cue").alias("s_cue")).agg(F.array_sort(F.collect_set(F.struct("norm", "exact_case"))).alias("s_terms"))
        rows = rows.join(t, (F.col("track_id") == F.col("t_track")) & (F.col("cue") == F.col("t_cue")), "left").join(s, (F.col("track_id") == F.col("s_track")) & (F.col("cue") == F.col("s_cue")), "left")
        rows = rows.withColumns({"near_targets": F.col("t_terms"), "near_sources": F.col("s_terms")})
    seconds = lambda c: F.col(c) / F.lit(1000.0)
    short = seconds("a_end") - seconds("a_start") < SHORTEST_S
    alone = F.struct(
        F.when(short, "too_short").alias("problem"),
        F.array(F.struct(seconds("a_start").alias("start"), seconds("a_end").alias("end"), F.col("target").alias("target"), F.col("source").alias("source"))).alias("parts"),
    )
    cut = F.col("early").isNull() & (F.col("count") > 1)
    only = lambda c: F.when(cut, F.col(c) if isinstance(c, str) else c)
    clusters = F.when(cut & F.col("target").rlike(_JOINED), graphemes("target"))
    parts = cut_cue(only("count"), only("target"), clusters, only("near_targets"), only("source"), only("near_sources"), seconds("a_start"), seconds("a_end"), F.lit(bilingual))
    made = rows.withColumn("cut", parts).withColumn("made", F.when(F.col("early").isNull(), F.coalesce("cut", alone)))
    made = made.select("track_id", F.when(F.col("differ"), 0).otherwise(F.col("cue")).alias("parent_cue"), "made.parts", F.coalesce("early", "made.problem").alias("code"))
    problems = made.where("code is not null").groupBy("track_id").agg(F.min(F.struct(F.col("parent_cue").alias("cue"), "code")).alias("p")).select("track_id", "p.cue", "p.code")
    sound = made.withColumn("faults", F.count("code").over(W.partitionBy("track_id"))).where("faults = 0")
    parts = sound.select("track_id", "parent_cue", F.posexplode("parts").alias("k", "part"))
    ms = lambda c: F.floor(F.col(c) * 1000 + F.lit(0.5)).cast("long")
    number = F.row_number().over(W.partitionBy("track_id").orderBy("parent_cue", "k"))
    return parts.select("track_id", number.alias("cue"), "parent_cue", ms("part.start").alias("start_ms"), ms("part.end").alias("end_ms"), F.col("part.target").alias("target"), F.col("part.source").alias("source")), problems


def layer(layers: DataFrame, side: str) -> DataFrame:
    """One side ("target" or "source") of readable layers as cues."""
    return layers.select("track_id", "cue", "parent_cue", "start_ms", "end_ms", F.col(side).alias("text"))


_SPLITS = pa.struct([("grapheme", pa.bool_()), ("terms", pa.list_(pa.string()))])


@F.arrow_udf(types.StructType([types.StructField("grapheme", types.BooleanType()), types.StructField("terms", types.ArrayType(types.StringType()))]))
def _target_splits(lines: pa.Array, clusters: pa.Array, master: pa.Array, terms: pa.Array) -> pa.Array:
    out = []
    for pieces, parts, whole, near in zip(*[x.to_pylist() for x in (lines, clusters, master, terms)], strict=True):
        joined = "".join(pieces)
        bounds = list(accumulate(map(len, pieces)))[:-1]
        cuts = {0, *accumulate(map(len, parts or []))}
        normal = [len(unicodedata.normalize("NFC", joined[:b])) for b in bounds]
        hit = []
        for term in near or []:
            at = whole.find(term)
            while at >= 0 and not any(at < b < at + len(term) for b in normal):
                at = whole.find(term, at + 1)
            if at >= 0:
                hit.append(term)
        out.append({"grapheme": any(b not in cuts for b in bounds), "terms": hit})
    return pa.array(out, _SPLITS)


def _pieces(children: DataFrame, members: DataFrame) -> DataFrame:
    inside = members.where("kind = 'member'") if "kind" in members.columns else members
    own = children.select(F.col("track_id").alias("k_track"), F.col("cue").alias("k_cue"), "text")
    held = inside.join(own, (F.col("track_id") == F.col("k_track")) & (F.col("child") == F.col("k_cue")))
    return held.groupBy("track_id", "parent").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("child", F.split("text", "\n", -1).alias("lines")))), lambda x: x["lines"])).alias("lines")).where(F.size("lines") > 1)


def target_boundary_issues(masters: DataFrame, children: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """Graphemes and target terms (track_id, target) that child or line boundaries split."""
    from cueloom.operators.findings import finding, union

    pieces = _pieces(children, members).withColumn("lines", F.transform("lines", comparison_key)).withColumn("joined", F.array_join("lines", ""))
    text = masters.select(F.col("track_id").alias("m_track"), F.col("cue").alias("m_cue"), unicode_forms(comparison_key("text"))["nfc"].alias("master"))
    near = T.target_hits(masters, targets).groupBy(F.col("track_id").alias("n_track"), F.col("cue").alias("n_cue")).agg(F.array_sort(F.collect_set("term")).alias("near"))
    rows = pieces.join(text, (F.col("track_id") == F.col("m_track")) & (F.col("parent") == F.col("m_cue"))).join(near, (F.col("track_id") == F.col("n_track")) & (F.col("parent") == F.col("n_cue")), "left")
    rows = rows.withColumn("split", _target_splits("lines", graphemes("joined"), "master", "near"))
    return union(
        finding(rows.where("split.grapheme"), "term_boundaries", "error", "grapheme_split_across_cues", F.col("parent")),
        finding(rows.select("track_id", "parent", F.posexplode("split.terms").alias("k", "term")), "term_boundaries", "error", "term_split_across_cues", F.col("parent"), F.col("k") + 1, {"term": F.col("term")}),
    )


def source_boundary_issues(masters: DataFrame, children: DataFrame, members: DataFrame, active: DataFrame) -> DataFrame:
    """Source forms of active terms that child or line boundaries split."""
    from cueloom.functions.matching import term_occurrences
    from cueloom.operators.findings import finding

    nfkc = lambda line: unicode_forms(clean_text(line))["nfkc"]
    pieces = _pieces(children, members).select("track_id", "parent", F.posexplode("lines").alias("k", "line")).withColumn("size", F.length(nfkc("line")))
    bounds = pieces.groupBy("track_id", "parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "size"))), lambda x: x["size"]).alias("sizes"))
    # ends of all pieces but the last, blanks between them counted
    ends = F.transform(F.sequence(F.lit(1), F.size("sizes") - 1), lambda n: F.aggregate(F.slice("sizes", 1, n), F.lit(0), lambda a, x: a + x) + n - 1)
    bounds = bounds.where(F.size("sizes") > 1).select(F.col("track_id").alias("b_track"), "parent", ends.alias("ends"))
    found = T.hits(masters.withColumn("text", clean_text("text")), T.forms(active)).where(F.length("norm") > 1)
    rows = found.join(bounds, (F.col("track_id") == F.col("b_track")) & (F.col("cue") == F.col("parent"))).withColumn("spans", term_occurrences("nfkc", "norm", "exact_case"))
    split = rows.where(F.exists("spans", lambda s: F.exists("ends", lambda e: (s["start"] < e) & (e < s["end"]))))
    return finding(split, "source_terms", "error", "source_term_split_across_cues", F.col("cue"), F.col("pos") * 64 + F.col("form_pos"), {"form": F.col("norm")})
