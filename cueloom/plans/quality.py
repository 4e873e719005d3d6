"""All quality checks of a set of tracks as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cueloom.functions.text import clean_text
from cueloom.operators import ass_checks, glossary as G, layers as L, review as R, segment as S, terms as T
from cueloom.operators.findings import finding, union


@dataclass(frozen=True)
class Artifacts:
    """What a check run reads. Terms are as in :mod:`cueloom.operators.glossary`; None is an artifact that isn't asked for."""

    source: DataFrame
    translated: DataFrame
    readable: DataFrame
    glossary: DataFrame
    decisions: DataFrame
    candidates: DataFrame
    readable_source: DataFrame | None = None
    ass: DataFrame | None = None
    language: str = "bilingual"
    titles: DataFrame | None = None
    descriptions: DataFrame | None = None
    candidate_records: DataFrame | None = None
    decision_records: DataFrame | None = None
    reviews: DataFrame | None = None
    coverage: DataFrame | None = None
    reviewed_batches: DataFrame | None = None


def _coded(findings: DataFrame, code: str, check: int, seq: int) -> DataFrame:
    return findings.withColumns({"code": F.lit(code), "check_order": F.lit(check), "seq": (F.col("seq") + seq).cast("int")})


def findings(a: Artifacts, by_time: bool = True) -> DataFrame:
    """Findings of every check. With ``by_time`` children belong to parents by time, else by their ``parent_cue``.

    Checks that build on a valid term table leave out the tracks whose table isn't.
    """
    members = L.members_by_time if by_time else L.members_by_parent
    glossary, decisions, candidates = G.normalised_terms(a.glossary), G.normalised_terms(a.decisions, decisions=True), G.normalised_candidates(a.candidates)
    linted = G.lint(glossary)
    bad_g = linted.where("severity = 'error'").select("track_id").distinct()
    lint_d, lint_c = G.lint(decisions, "term_decisions_invalid", ids=False, warn=False), G.lint(candidates, "term_candidates_invalid", ids=False, warn=False)
    order = {"check_order": F.lit(6)}
    lint_d, lint_c = (x.join(bad_g, "track_id", "left_anti").withColumns(order | {"seq": F.col("seq") - shift}) for x, shift in ((lint_d, 40_000), (lint_c, 80_000)))
    bad_t = lint_d.unionByName(lint_c).select("track_id").distinct().unionByName(bad_g).distinct()
    sound = lambda d: d.where("code is null").drop("code").join(bad_t, "track_id", "left_anti")
    g, d, c = sound(glossary), sound(decisions), sound(candidates)
    _, differ = L.paired(a.source, a.translated)
    equal = lambda x: x.join(differ.select("track_id"), "track_id", "left_anti")
    inside = members(a.translated, a.readable)
    good = lambda x: x.join(bad_g, "track_id", "left_anti")
    targets = glossary.where("code is null").select("track_id", "target").unionByName(decisions.where("code is null and approval = 'approved'").select("track_id", "target"))
    parts = [
        linted,
        L.timeline_issues(a.source),
        L.alignment_issues(a.source, a.translated),
        L.segmentation_issues(a.translated, a.readable, inside),
        L.readability_issues(a.readable),
        L.number_issues(a.source, a.translated),
        lint_d, lint_c,
        T.candidate_issues(c, d, a.source),
        T.application_issues(d, g),
        T.missing_terms(equal(a.source), equal(a.translated), g, d),
        good(S.target_boundary_issues(a.translated, a.readable, inside, targets)),
        good(L.latin_issues(a.translated, targets)),
    ]
    for records, kind in ((a.candidate_records, "candidates"), (a.decision_records, "decisions")):
        if records is not None:
            parts.append(good(T.record_issues(records, kind)))
    if a.reviews is not None:
        totals = a.source.groupBy("track_id").agg(F.count(F.lit(1)).alias("total"))
        parts.append(R.review_issues(a.reviews, a.coverage, totals))
    if a.reviewed_batches is not None:
        parts.append(R.stale_issues(R.batches(a.source, a.translated, terms=review_terms(a)), a.reviewed_batches))
    if a.readable_source is not None:
        inner = members(a.source, a.readable_source)
        parts += [
            L.segmentation_issues(a.source, a.readable_source, inner, "readable_en", "readable_en", clean_text, " "),
            S.source_boundary_issues(a.source, a.readable_source, inner, T.active_terms(g, d)),
            L.english_issues(a.readable_source),
            L.alignment_issues(a.readable_source, a.readable, "layers", "ass_alignment", "ass_alignment"),
        ]
    if a.ass is not None:
        parts.append(ass_checks.ass_issues(a.ass, a.readable, a.readable_source, a.language))
    if a.titles is not None:
        parts.append(ass_checks.title_issues(a.titles))
    if a.descriptions is not None:
        parts.append(ass_checks.description_issues(a.descriptions))
    return union(*parts)


def review_terms(a: Artifacts) -> DataFrame:
    """(track_id, kind, pos, entry): what a review batch is told of terms."""
    entry = lambda d: F.to_json(F.struct(*[x for x in d.columns if x not in ("track_id", "pos")])).alias("entry")
    near = a.glossary.join(R.relevant_terms(a.source, a.glossary), ["track_id", "pos"], "left_semi")
    return union(*[d.select("track_id", F.lit(k).alias("kind"), "pos", entry(d)) for k, d in (("glossary", near), ("decisions", a.decisions), ("candidates", a.candidates))])


def missing_artifacts(tracks: DataFrame, found: DataFrame, needed: list[str]) -> DataFrame:
    """(track_id, artifact): needed artifacts that ``found`` (track_id, artifact) lacks."""
    wanted = tracks.select("track_id", F.explode(F.array(*map(F.lit, needed))).alias("artifact"))
    return wanted.join(found, ["track_id", "artifact"], "left_anti")


__all__ = ["Artifacts", "findings", "finding", "missing_artifacts", "review_terms"]
