"""Secret scans with multipart credential linking.

Strong patterns (assignments, access keys, long hex) always report. Beyond them each text has weak parts: identifiers,
secrets and endpoints that mean nothing alone. Within a scope - a paragraph - weak parts are interval-joined with
complementary parts: an identifier is reported where a secret is, a secret where an identifier or an endpoint is. Scopes
don't overlap, so each part is placed in its scope by its start, and the cost is n log n in a text's parts.

An RE2 pass over whole Arrow columns first finds the texts in which anything can match; only those reach the patterns with
positions. It passes every text that holds a strong match or a weak secret, and no weak part reports without a secret.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cueloom.llm.common import small_batches

KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more among all maximal runs

WEAK_ID = re.compile(r"""(?<![A-Za-z0-9])(?:A[SBC]IA[A-Z0-9]{12,}|(?:client|account|access|user|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,})""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
WEAK_ASSIGN = re.compile(r"""(?<![A-Za-z0-9])(?:pwd|pass|passphrase|credentials?|auth)["']?\x20*[:=]\x20*["']?[^\s"'<>]{6,}""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"(?:https?|wss?|ftp|jdbc:[a-z]+|mongodb|postgres(?:ql)?|redis|amqp)://[^\s\"'<>]+|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]+\.)+(?:amazonaws\.com|internal|local)(?![A-Za-z0-9])", re.ASCII)
PARAGRAPH = re.compile(r"\n[ \t]*\n")

#: RE2: any text with a strong match, or with a weak secret (20 or more characters with a digit among them, or an assignment).
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[0-9][A-Za-z0-9+/_=-]{9}|[A-Za-z0-9+/_=-]{9}[0-9]|(?i:pwd|pass|passphrase|credentials?|auth)[\"']?\x20*[:=]"

Span = tuple[str, int, int]


def strong(text: str) -> list[Span]:
    """Leftmost, non-overlapping for each kind; by start, then kind."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token) and len(set(token)) >= 10


def linked(text: str, sure: list[Span]) -> list[Span]:
    """Weak identifiers and secrets that a complementary part accompanies, outside the strong spans."""
    taken = _merged([(a, b) for _, a, b in sure])

    def free(a: int, b: int) -> bool:
        at = bisect_left(taken, (a, a))
        return not any(x < b and a < y for x, y in taken[max(0, at - 1) : at + 1])

    secrets = [(m.start(), m.end()) for m in WEAK_ASSIGN.finditer(text)]
    secrets += [(m.start(), m.end()) for m in WEAK_SECRET.finditer(text) if _mixed(m[0])]
    weak_secrets = _disjoint([x for x in secrets if free(*x)])
    if not weak_secrets and not sure:
        return []
    weak_ids = _disjoint([(m.start(), m.end()) for m in WEAK_ID.finditer(text) if free(m.start(), m.end())])
    cuts = [m.start() for m in PARAGRAPH.finditer(text)]
    scope = lambda a: bisect_right(cuts, a)
    ids = {scope(a) for a, _ in weak_ids} | {scope(a) for k, a, _ in sure if k == "access"}
    known = {scope(a) for a, _ in weak_secrets} | {scope(a) for k, a, _ in sure if k != "access"}
    ends = {scope(m.start()) for m in ENDPOINT.finditer(text)}
    out = [("weak_id", a, b) for a, b in weak_ids if scope(a) in known]
    out += [("weak_secret", a, b) for a, b in weak_secrets if scope(a) in ids | ends]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans cover, sorted and disjoint; spans may overlap or hold one another."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_NONE = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    sure = strong(text)
    order = ("assign", "access", "hex", "weak_id", "weak_secret")
    every = sorted(sure + linked(text, sure), key=lambda s: (s[1], order.index(s[0])))
    n = [sum(k == kind for k, _, _ in sure) for kind in order[:3]]
    return (*n, hashlib.sha256(joined(sure).encode()).hexdigest(), joined(every))


def scan(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), spans in code points, end exclusive.

    Defined cases: a null or empty text has no spans; texts are scanned whole; rows are independent, so repeated rows give
    equal results and an empty table stays empty; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_NONE] * batch.num_rows
            for i, hit in enumerate(pc.match_substring_regex(batch.column(1), ANY).to_pylist()):
                if hit:
                    rows[i] = scan_text(batch.column(1)[i].as_py())
            columns = [pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
