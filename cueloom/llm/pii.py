"""Personal data: candidate spans that boosted trees accept or turn down.

Four strict patterns always report. Beyond them high-recall generators propose further spans, which may overlap: obfuscated
addresses, IPv6, national telephone numbers, short card numbers. Gradient-boosted trees score each by its format and the
words around it, and a threshold for each kind, calibrated on rows that didn't fit the trees, selects. The trees are fitted on
the driver, over examples drawn from the templates below, and become one SQL expression: everything that touches a text is
Spark SQL, in one projection without a shuffle.

Positions come from ``split`` and ``regexp_extract_all``: the pieces between matches and the matches give every start. Patterns
use possessive groups and begin only where a run begins or the last match ended, so they are linear in a text's length.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cueloom.llm.common import free_name, let, offsets

KINDS = ("email", "ip", "card", "phone")

_LOCAL = r"A-Za-z0-9._%+-"
#: The strict patterns; each finds what its greedy, backtracking form finds leftmost.
STRICT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates.
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[A-Za-z0-9](?:[{_LOCAL}]{{0,62}}[A-Za-z0-9])?\x20?[\[({{]\x20?(?:at|AT|At)\x20?[\])}}]\x20?[A-Za-z0-9-]{{1,62}}(?:\x20?(?:\.|[\[({{]\x20?(?:dot|DOT|Dot)\x20?[\])}}])\x20?[A-Za-z0-9-]{{1,62}}){{1,4}}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[\x20-][0-9]{4,6}){1,2}[\x20-]?[0-9]{2,5}(?![0-9A-Za-z]|[.-][0-9])",
    "phone": r"(?<![0-9A-Za-z.+/-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,8}){1,4}(?![0-9A-Za-z]|[./-][0-9])",
}
#: No text without one of these has a match of any pattern above.
MAYBE = r"[0-9@]|[\[({]\x20?(?:at|AT|At)\x20?[\])}]"
#: Characters of context to each side.
AROUND = 28

CONTEXT = {
    "tells_phone": r"(?i)phone|\btel\b|telef|call|mobile|fax|whatsapp|sms|handy|appel|llam",
    "tells_card": r"(?i)card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "tells_mail": r"(?i)mail|write|contact|reach|@|correo|courriel",
    "tells_net": r"(?i)\bip\b|ipv6|server|host|address|client|login|adresse",
    "tells_other": r"(?i)version|page|order|isbn|invoice|date|year|chapter|section|serial|score|ratio|\bno\b|\bnr\b|item|build|license|[$€£%]",
}
#: Features of a candidate: names and SQL over its fields kind, hit, before, after (booleans count as 0 or 1).
FEATURES: dict[str, str] = {
    "length": "length(c.hit)",
    "digits": "length(regexp_replace(c.hit, '[^0-9]', ''))",
    "groups": r"size(split(c.hit, '[^0-9A-Za-z]+'))",
    "parenthesis": "cast(instr(c.hit, '(') > 0 as int)",
    "dots": "length(c.hit) - length(replace(c.hit, '.', ''))",
    "slashes": "length(c.hit) - length(replace(c.hit, '/', ''))",
    "dashes": "length(c.hit) - length(replace(c.hit, '-', ''))",
    "zero_first": r"cast(regexp_like(c.hit, '^\\(?0') as int)",
    "last_group": r"length(regexp_extract(c.hit, '([0-9A-Za-z]+)[^0-9A-Za-z]*$', 1))",
    "like_date": r"cast(regexp_like(c.hit, '^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:[0-9]{2}|[0-9]{4}))$') as int)",
    "luhn": "cast(c.luhn as int)",
    **{name: f"cast(regexp_like(concat(c.before, ' ', c.after), r'{pattern}') as int)" for name, pattern in CONTEXT.items()},
}


@dataclass(frozen=True)
class Tree:
    """A split (feature, limit, lower side, upper side) or, without a feature, a value."""

    value: float = 0.0
    feature: int | None = None
    limit: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def sql(self, names: list[str]) -> str:
        if self.feature is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {names[self.feature]} <= {self.limit!r}D THEN {self.low.sql(names)} ELSE {self.high.sql(names)} END"

    def read(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.limit, self.low.read(x), self.high.read(x))


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, rate: float) -> Tree:
    leaf = Tree(round(float(-slope.sum() / (curve.sum() + 1.0)) * rate, 6))
    best = (1e-3, None, 0.0)
    if depth and len(x) >= 16:
        own = slope.sum() ** 2 / (curve.sum() + 1)
        for f in range(x.shape[1]):
            for limit in np.unique(x[:, f])[:-1]:
                side = x[:, f] <= limit
                if 8 <= side.sum() <= len(x) - 8:
                    a, b = slope[side].sum(), slope[~side].sum()
                    gain = a * a / (curve[side].sum() + 1) + b * b / (curve[~side].sum() + 1) - own
                    if gain > best[0]:
                        best = (gain, f, float(limit))
    if best[1] is None:
        return leaf
    side = x[:, best[1]] <= best[2]
    return Tree(0.0, best[1], best[2], _grow(x[side], slope[side], curve[side], depth - 1, rate), _grow(x[~side], slope[~side], curve[~side], depth - 1, rate))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> list[Tree]:
    """Trees whose sum is the log odds."""
    z, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(_grow(x, p - y, p * (1 - p), depth, rate))
        z = z + trees[-1].read(x)
    return trees


# Templates of training examples: (kind, shape, words before, label). In a shape # is a digit, X a hex digit, W a word.
_POSITIVE = [
    ("phone", ["(###) ###-####", "###-###-####", "0## #######", "0### ### ## ##", "0##/########", "### ### ####", "0# ## ## ## ##"], ["call me at", "phone:", "tel", "mobile number", "fax:", "Telefon", "appelez le", "whatsapp", "llame al"]),
    ("email", ["W (at) W.com", "W.W [at] W [dot] org", "W(at)W(dot)net", "W [AT] W.W.de"], ["mail", "write to", "contact:", "reach me", "", "e-mail"]),
    ("ip", ["XXXX:XXXX:XXXX:XXXX:XXXX:XXXX:XXXX:XXXX", "X:XX:X:XXX:X:X:XXXX:X"], ["server", "host", "login from", "", "client address"]),
    ("card", ["3### ###### #####", "3###-######-#####"], ["card", "amex", "credit card", "payment by"]),
]
_NEGATIVE = [
    ("phone", ["####-##-##", "##.##.####", "##/##/####", "#### ####", "##-##", "### ###", "####-####", "##.## ##.##", "## ## ##", "###.###.###"], ["version", "page", "order no", "date", "year", "score", "isbn", "of the", "and", "between", "invoice", "chapter", ""]),
    ("phone", ["(###) ###-####", "### ### ####", "0## #######"], ["isbn", "order", "serial no", "invoice", "item"]),
    ("email", ["W (at) W. W"], ["met", "stood", "the"]),
    ("ip", ["##:##:##:##:##:##:##:##"], ["ratio", "score", "of"]),
    ("card", ["3### ###### #####", "#### #### ####", "####-####-##"], ["serial", "order", "item", "of the", "isbn", ""]),
]


def _luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(int(c) for c in reversed(digits)))
    return bool(digits) and total % 10 == 0


def _example(rng: random.Random, shape: str, luhn: bool | None) -> str:
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    while True:
        made = "".join(rng.choice("0123456789") if c == "#" else rng.choice("0123456789abcdef") if c == "X" else word() if c == "W" else c for c in shape)
        if luhn is None or _luhn("".join(c for c in made if c.isdigit())) == luhn:
            return made


def examples(seed: int = 5, each: int = 12) -> list[tuple[str, str, str, str, bool, int]]:
    """(kind, hit, before, after, luhn, label)."""
    rng, out = random.Random(seed), []
    fill = lambda: "".join(rng.choice("the of and ing tion er on re st ou ".split()) + rng.choice(["", " "]) for _ in range(6))
    for label, groups in ((1, _POSITIVE), (0, _NEGATIVE)):
        for kind, shapes, words in groups:
            for shape in shapes:
                for word in words:
                    for _ in range(each):
                        hit = _example(rng, shape, label == 1 if kind == "card" else None)
                        digits = "".join(c for c in hit if c.isdigit())
                        out.append((kind, hit, f"{fill()} {word} "[-AROUND:], f" {fill()}"[:AROUND], kind == "card" and _luhn(digits), label))
    rng.shuffle(out)
    return out


def _features(rows: DataFrame) -> np.ndarray:
    made = rows.select(F.struct("kind", "hit", "before", "after", "luhn").alias("c"), "label").selectExpr(*[f"cast({sql} as double)" for sql in FEATURES.values()], *[f"cast(c.kind = '{k}' as double)" for k in KINDS], "label")
    return np.array([tuple(r) for r in made.collect()], dtype=np.float64)


@dataclass(frozen=True)
class Selector:
    trees: tuple[Tree, ...]
    #: For each kind the log odds from which a candidate is taken.
    limits: dict[str, float]

    def log_odds(self) -> str:
        names = [f"f.{n}" for n in FEATURES] + [f"cast(c.kind = '{k}' as int)" for k in KINDS]
        return " + ".join(f"({t.sql(names)})" for t in self.trees)


_fitted: dict[tuple[int, float], Selector] = {}


def selector(spark, precision: float = 0.98, seed: int = 5) -> Selector:
    """Trees over the template examples; limits are the least log odds with this precision on the third set aside."""
    if (seed, precision) not in _fitted:
        data = _features(spark.createDataFrame(examples(seed), "kind string, hit string, before string, after string, luhn boolean, label int"))
        x, y = data[:, :-1], data[:, -1]
        cut = 2 * len(y) // 3
        trees = boost(x[:cut], y[:cut])
        z, limits = sum(t.read(x[cut:]) for t in trees), {}
        for k, kind in enumerate(KINDS):
            own = x[cut:, len(FEATURES) + k] == 1
            ranked = sorted(zip(z[own].tolist(), y[cut:][own].tolist(), strict=True), reverse=True)
            good, limit = 0.0, math.inf
            for i, (score, label) in enumerate(ranked):
                good += label
                if good >= precision * (i + 1) and (i + 1 == len(ranked) or ranked[i + 1][0] < score):
                    limit = score
            limits[kind] = max(limit, 0.0)
        _fitted[seed, precision] = Selector(tuple(trees), limits)
    return _fitted[seed, precision]


def found_spans(text: Column, pattern: str) -> Column:
    """array<struct<a:int,b:int,hit:string>> of all matches: code points, end exclusive."""
    empty = F.expr("cast(array() as array<struct<a:int,b:int,hit:string>>)")
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    span = lambda p, at: F.struct((at + F.length(p["gap"])).alias("a"), (at + F.length(p["gap"]) + F.length(p["hit"])).alias("b"), p["hit"].alias("hit"))
    long_ = lambda found: F.transform(found, lambda p: F.length(p["gap"]) + F.length(p["hit"]))
    placed = lambda found: let(offsets(long_(found)), lambda at: F.transform(found, lambda p, i: span(p, F.get(at, i))))
    walked = let(F.filter(pairs, lambda p: p["hit"].isNotNull()), placed)
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        value = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("long"), F.lit(256))
        return F.forall(F.split(hit, r"\."), lambda p: value(p) <= 255)
    if kind == "card":
        return F.length(_digits(hit)).between(16, 19) & luhn_ok(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), spans in code points, end exclusive.

    Strict spans are always there; added ones overlap neither them nor each other. Defined cases: a null or empty text has
    no spans; texts are scanned whole; rows are independent, so repeated rows give equal results and an empty table stays
    empty; other columns are ignored.
    """
    chosen = selector(docs.sparkSession)
    body = free_name([], "body")
    strict_type, empty = "array<struct<kind:string,a:int,b:int>>", F.expr("cast(array() as array<struct<kind:string,a:int,b:int>>)")
    # flagged: the text where anything can match, else null - a null costs nothing further on
    base = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias(body)).withColumn("flagged", F.when(F.col(body).rlike(MAYBE), F.col(body)))
    named = lambda kind, spans: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["a"].alias("a"), s["b"].alias("b")))
    holding = lambda kind: lambda s: _holds(kind, s["hit"])
    strict = F.concat(*[named(k, F.filter(found_spans(F.col("flagged"), STRICT[k]), holding(k))) for k in KINDS])
    rows = base.withColumn("strict", F.when(F.col("flagged").isNull(), empty).otherwise(strict).cast(strict_type))
    # further candidates, with what the features need
    around = lambda kind: lambda s: F.struct(
        F.lit(kind).alias("kind"), s["a"].alias("a"), s["b"].alias("b"), s["hit"].alias("hit"),
        F.substr(F.col("flagged"), F.greatest(F.lit(1), s["a"] - AROUND + 1), F.least(F.lit(AROUND), s["a"])).alias("before"),
        F.substr(F.col("flagged"), s["b"] + 1, F.lit(AROUND)).alias("after"),
        (luhn_ok(_digits(s["hit"])) if kind == "card" else F.lit(False)).alias("luhn"),
    )
    proposed = F.concat(*[F.transform(found_spans(F.col("flagged"), LOOSE[k]), around(k)) for k in KINDS])
    overlap = lambda c, s: (c["a"] < s["b"]) & (s["a"] < c["b"])
    open_ = F.filter(proposed, lambda c: ~F.exists(F.col("strict"), lambda s: overlap(c, s)))
    rows = rows.withColumn("open", F.when(F.col("flagged").isNotNull(), open_))
    fields = ", ".join(f"'{n}', cast({sql} as double)" for n, sql in FEATURES.items())
    limits = " ".join(f"WHEN '{k}' THEN {chosen.limits[k]!r}D" if math.isfinite(chosen.limits[k]) else f"WHEN '{k}' THEN 1e9D" for k in KINDS)
    scored = f"transform(open, c -> named_struct('kind', c.kind, 'a', c.a, 'b', c.b, 'over', get(transform(array(named_struct({fields})), f -> {chosen.log_odds()}), 0) - CASE c.kind {limits} END))"
    rows = rows.withColumn("scored", F.expr(f"filter({scored}, c -> c.over >= 0)"))
    # of overlapping candidates the surest stays, the leftmost and then the earlier kind of equal ones
    rank = F.array_sort(F.transform("scored", lambda c: F.struct((-c["over"]).alias("o"), c["a"].alias("a"), F.array_position(F.lit(list(KINDS)), c["kind"]).alias("k"), c["b"].alias("b"), c["kind"].alias("kind"))))
    added = F.aggregate(
        rank,
        empty,
        lambda kept, c: F.when(F.exists(kept, lambda s: overlap(c, s)), kept).otherwise(F.array_append(kept, F.struct(c["kind"].alias("kind"), c["a"].alias("a"), c["b"].alias("b")))),
    )
    rows = rows.withColumn("added", F.when(F.size("scored") > 0, added).otherwise(empty))
    every = F.transform(
        F.array_sort(F.transform(F.concat("strict", "added"), lambda s: F.struct(F.array_position(F.lit(list(KINDS)), s["kind"]).alias("k"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("a"), s["b"].alias("b")),
    )
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("strict", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("strict")), 256).alias("base_sha256"), _joined(every).alias("spans"))
