"""Terminology: forms, occurrences, overrides, and the checks between candidates, decisions, glossary and cues.

A term table has (track_id, pos, en, aliases, case_sensitive, target, approval, scope). Its forms are ``en`` and the
aliases. A glossary that all tracks share is first given to each track (:func:`for_tracks`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cueloom.functions.matching import term_occurrences
from cueloom.functions.text import has_capital, squeeze, term_pattern, unicode_forms
from cueloom.operators.findings import finding, union


def for_tracks(glossary: DataFrame, tracks: DataFrame) -> DataFrame:
    """A project's glossary (at most 2,000 terms) for each of its tracks; both have ``project``."""
    return tracks.select("track_id", "project").distinct().join(glossary, "project").drop("project")


def forms(terms: DataFrame, *keep: str) -> DataFrame:
    """(track_id, pos, form_pos, form, norm, fold, exact_case, en) and ``keep``: a row for each form."""
    every = F.concat(F.array("en"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))
    rows = terms.select("track_id", "pos", "en", F.coalesce("case_sensitive", has_capital(unicode_forms(F.col("en"))["nfkc"])).alias("exact_case"), *keep, F.posexplode(every).alias("form_pos", "form"))
    rows = rows.where(squeeze("form") != "").withColumn("u", unicode_forms(F.col("form")))
    return rows.select("track_id", "pos", "form_pos", "form", squeeze("u.nfkc").alias("norm"), squeeze("u.fold").alias("fold"), "exact_case", "en", *keep)


def covers(cover_norm: Column, cover_fold: Column, cover_exact: Column, norm: Column, fold: Column, exact: Column) -> Column:
    """A case-sensitive form covers only an identical case-sensitive one; any other covers all that are equal but for case."""
    return F.when(cover_exact, exact & (cover_norm == norm)).otherwise(cover_fold == fold)


def tokens(text: Column) -> Column:
    """Distinct words of folded text; for text without any, its distinct other characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def token_frequencies(rows: DataFrame, text: str = "fold") -> DataFrame:
    """(token, n): rows in which each token occurs."""
    return rows.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def anchored(listed: DataFrame, *keys: str) -> DataFrame:
    """Forms with ``anchor``: the rarest of their tokens among all forms, the longer and then the first in order of equal ones.

    ``keys`` tell forms apart (none given: track_id, pos, form_pos). A form without letters or numbers has its first
    character, marked, as anchor.
    """
    keys = keys or ("track_id", "pos", "form_pos")
    split = listed.withColumn("token", F.explode_outer(tokens(F.col("fold"))))
    counted = split.join(token_frequencies(listed).withColumnRenamed("token", "f_token"), F.col("token") == F.col("f_token"), "left")
    best = counted.groupBy(*keys).agg(F.min_by("token", F.struct("n", -F.length("token"), "token")).alias("anchor"))
    return listed.join(best, list(keys)).withColumn("anchor", F.coalesce("anchor", F.concat(F.lit("\u0001"), F.substring("fold", 1, 1))))


def with_forms(cues: DataFrame) -> DataFrame:
    u = unicode_forms(F.col("text"))
    return cues.withColumn("u", u).select("*", F.col("u.nfkc").alias("nfkc"), F.col("u.fold").alias("folded")).drop("u")


def hits(cues: DataFrame, listed: DataFrame, shared: bool = False) -> DataFrame:
    """Forms that occur in cues: the cue's track_id, cue, nfkc with the form's columns.

    An inverted index over the anchors of the distinct wordings finds candidates through equi-joins of keys alone; the texts
    of cues that have any are fetched once, and the pattern verifies them. With ``shared`` the forms hold for every track
    (one glossary: 2,000 terms) and are broadcast; else each form is looked for in its own track. Cues without a track or
    number are in no track and not searched.
    """
    small = F.broadcast if shared else (lambda d: d)
    texts, wording = cues.select("track_id", "cue", "text"), ("norm", "fold", "exact_case")
    marks = F.transform(F.array_distinct(F.regexp_extract_all("folded", F.lit(r"[^\p{L}\p{N}\s]"), F.lit(0))), lambda c: F.concat(F.lit("\u0001"), c))
    probes = with_forms(texts).select("track_id", "cue", F.explode(F.concat(tokens(F.col("folded")), marks)).alias("probe"))
    named = probes.join(small(anchored(listed.select(*wording).distinct(), *wording)), F.col("probe") == F.col("anchor"))
    same = [F.col(c) == F.col(f"f_{c}") for c in (wording if shared else ("track_id", *wording))]
    owned = named.join(small(listed.select(*[F.col(c).alias(f"f_{c}") for c in listed.columns])), same)
    form = F.struct(*[F.col(f"f_{c}").alias(c) for c in listed.columns if c != "track_id"])
    may = owned.groupBy("track_id", "cue").agg(F.collect_set(form).alias("may"))
    rows = with_forms(texts.join(may, ["track_id", "cue"])).select("track_id", "cue", "nfkc", "folded", F.explode("may").alias("f")).select("track_id", "cue", "nfkc", "folded", "f.*")
    verified = F.when(F.col("exact_case"), F.regexp_like("nfkc", term_pattern(F.col("norm")))).otherwise(F.regexp_like("folded", term_pattern(F.col("fold"))))
    return rows.where(verified).drop("folded")


def _covered(glossary: DataFrame, job: DataFrame, shared: bool = False) -> DataFrame:
    """(track_id, pos): glossary terms all of whose forms the track's job terms cover."""
    keys = ["pos"] if shared else ["track_id", "pos"]
    g = forms(glossary).select(*keys, "form_pos", "norm", "fold", "exact_case")
    j = forms(job).select(F.col("track_id").alias("j_track"), F.col("norm").alias("j_norm"), F.col("fold").alias("j_fold"), F.col("exact_case").alias("j_exact"))
    same = (F.col("fold") == F.col("j_fold")) & covers(F.col("j_norm"), F.col("j_fold"), F.col("j_exact"), F.col("norm"), F.col("fold"), F.col("exact_case"))
    met = g.join(j, same if shared else same & (F.col("track_id") == F.col("j_track")))
    counted = met.groupBy("j_track", "pos").agg(F.size(F.collect_set("form_pos")).alias("c")).withColumnsRenamed({"j_track": "c_track", "pos": "c_pos"})
    sizes = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    whole = (F.col("pos") == F.col("c_pos")) & (F.col("n") == F.col("c"))
    return counted.join(sizes, whole if shared else whole & (F.col("track_id") == F.col("c_track"))).select(F.col("c_track").alias("track_id"), "pos")


def active_terms(glossary: DataFrame, decisions: DataFrame) -> DataFrame:
    """Glossary terms that job decisions don't cover in every form, and those decisions; with ``is_job``."""
    job = decisions.where("approval = 'approved' and scope = 'job'")
    gone = _covered(glossary, job)
    columns = ["track_id", "pos", "en", "aliases", "case_sensitive", "target"]
    return glossary.join(gone, ["track_id", "pos"], "left_anti").select(*columns, F.lit(False).alias("is_job")).unionByName(job.select(*columns, F.lit(True).alias("is_job")))


def missing_terms(source: DataFrame, translated: DataFrame, glossary: DataFrame, decisions: DataFrame, shared: bool = False) -> DataFrame:
    """Cues whose source has an active term while the translation lacks its target wording.

    A job term that occurs in a cue overrides, occurrence by occurrence, what it covers of project terms there. With
    ``shared`` the glossary holds for every track (its track_id doesn't matter) and isn't copied to them.
    """
    job = decisions.where("approval = 'approved' and scope = 'job'")
    project = hits(source, forms(glossary, "target"), shared).join(_covered(glossary, job, shared), ["track_id", "pos"], "left_anti")
    every = F.collect_list(F.struct("norm", "fold", "exact_case")).over(W.partitionBy("track_id", "pos"))
    own = hits(source, forms(job, "target").withColumn("wordings", every))
    none = F.lit(None).cast(own.schema["wordings"].dataType)
    found = project.withColumns({"wordings": none, "is_job": F.lit(False)}).unionByName(own.withColumn("is_job", F.lit(True)))
    rows = found.withColumn("overrides", F.flatten(F.collect_list("wordings").over(W.partitionBy("track_id", "cue"))))
    free = F.col("is_job") | (F.size("overrides") == 0)
    spans = term_occurrences(F.when(~free, F.col("nfkc")), F.col("norm"), F.col("exact_case"))
    seen = rows.withColumn("o", F.explode_outer(spans)).withColumn("o_fold", unicode_forms(F.col("o.exact"))["fold"])
    overridden = F.exists("overrides", lambda w: (w["fold"] == F.col("o_fold")) & covers(w["norm"], w["fold"], w["exact_case"], F.col("o.exact"), F.col("o_fold"), F.lit(True)))
    needed = seen.where(free | (F.col("o").isNotNull() & ~overridden)).select("track_id", "cue", "pos", "is_job", "en", "target").distinct()
    said = translated.select(F.col("track_id").alias("t_track"), F.col("cue").alias("t_cue"), unicode_forms(F.col("text"))["nfc"].alias("said"))
    lacking = needed.join(said, (F.col("track_id") == F.col("t_track")) & (F.col("cue") == F.col("t_cue"))).where(~F.contains("said", unicode_forms(F.coalesce("target", F.lit("")))["nfc"]))
    return finding(lacking, "terminology", "error", "missing_active_term", F.col("cue"), F.lit(10_000) + F.col("pos") + F.when(F.col("is_job"), 100_000).otherwise(0), {"en": F.col("en"), "target": F.col("target")})


def _first_covering(wanted: DataFrame, by: DataFrame, *keep: str) -> DataFrame:
    """For each term of ``wanted`` the first of ``by`` whose forms cover all of its forms: track_id, pos, en and keep of it (null: none)."""
    a, b = forms(wanted), forms(by, *keep)
    b = b.select(F.col("track_id").alias("b_track"), F.col("pos").alias("b_pos"), F.col("norm").alias("b_norm"), F.col("fold").alias("b_fold"), F.col("exact_case").alias("b_exact"), *[F.col(k).alias(f"b_{k}") for k in keep])
    met = a.join(b, (F.col("track_id") == F.col("b_track")) & (F.col("fold") == F.col("b_fold")) & covers(F.col("b_norm"), F.col("b_fold"), F.col("b_exact"), F.col("norm"), F.col("fold"), F.col("exact_case")))
    full = met.groupBy("track_id", "pos", "b_pos", *[f"b_{k}" for k in keep]).agg(F.countDistinct("form_pos").alias("c"))
    sizes = a.groupBy("track_id", "pos", "en").agg(F.count(F.lit(1)).alias("n"))
    best = full.join(sizes.select("track_id", "pos", "n"), ["track_id", "pos"]).where("c = n").groupBy("track_id", "pos").agg(F.min_by(F.struct("b_pos", *[f"b_{k}" for k in keep]), "b_pos").alias("best"))
    return sizes.join(best, ["track_id", "pos"], "left")


def _packed(pos: str, cue: str) -> Column:
    """Position and cue number in one long."""
    return F.shiftleft(F.col(pos).cast("long"), 32) + F.col(cue)


def candidate_issues(candidates: DataFrame, decisions: DataFrame, source: DataFrame, shared: bool = False) -> DataFrame:
    """Candidates (with cues array<int>): cited cues exist and hold a form; one decision covers all forms and is settled.

    With ``shared`` candidates and decisions hold for every track of ``source`` (their track_id doesn't matter): they are
    judged once, and only what a track's cues decide is looked for in each track. A track's cited cues that exist, and those
    that hold a form, are two arrays; citations meet them in one pass, without a shuffle of the citations.
    """
    if shared:
        candidates, decisions = (d.withColumn("track_id", F.lit(0)) for d in (candidates, decisions))
    cited = candidates.select("track_id", "pos", "en", F.explode(F.array_sort(F.array_distinct(F.filter("cues", lambda c: c > 0)))).alias("cited"))
    wanted = cited.select(*[F.col(c).alias(f"w_{c}") for c in ("track_id", "pos", "cited")])
    same = (F.col("cue") == F.col("w_cited")) if shared else (F.col("cue") == F.col("w_cited")) & (F.col("track_id") == F.col("w_track_id"))
    small = F.broadcast if shared else (lambda d: d)
    named = source.where("track_id is not null").join(small(wanted.drop("w_pos").distinct()), same, "left_semi")
    there = named.groupBy("track_id").agg(F.collect_set("cue").alias("there"))
    proof = hits(named, forms(candidates), shared).select("track_id", "pos", "cue").join(small(wanted.distinct()), same & (F.col("pos") == F.col("w_pos")), "left_semi")
    proof = proof.groupBy("track_id").agg(F.collect_set(_packed("pos", "cue")).alias("proof"))
    if shared:
        tracks = source.select("track_id").distinct()
        spread = lambda d: tracks.crossJoin(F.broadcast(d.drop("track_id")))
        rows = tracks.join(there, "track_id", "left").join(proof, "track_id", "left").crossJoin(F.broadcast(cited.drop("track_id")))
    else:
        spread, rows = (lambda d: d), cited.join(there, "track_id", "left").join(proof, "track_id", "left")
    has = lambda array, value: F.coalesce(F.array_contains(array, value), F.lit(False))
    settled = _first_covering(candidates, decisions, "approval")
    return union(
        finding(rows.where(~has(F.col("there"), F.col("cited"))), "terminology", "error", "term_candidate_range", seq=F.col("pos"), details={"en": F.col("en"), "cited": F.col("cited")}),
        finding(rows.where(has(F.col("there"), F.col("cited")) & ~has(F.col("proof"), _packed("pos", "cited"))), "terminology", "error", "term_candidate_evidence", F.col("cited"), F.col("pos"), {"en": F.col("en")}),
        finding(spread(settled.where("best is null")), "terminology", "error", "candidate_without_decision", seq=F.lit(3000) + F.col("pos"), details={"en": F.col("en")}),
        finding(spread(settled.where("best.b_approval = 'review-required'")), "terminology", "error", "term_unresolved", seq=F.lit(3000) + F.col("pos"), details={"en": F.col("en")}),
    )


def application_issues(decisions: DataFrame, glossary: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Approved project decisions that no glossary term with the same target covers.

    With ``tracks`` (track_id) both tables hold for every one of these (their track_id doesn't matter): they are judged once
    and each track gets the findings.
    """
    if tracks is not None:
        decisions, glossary = (d.withColumn("track_id", F.lit(0)) for d in (decisions, glossary))
    approved = decisions.where("approval = 'approved' and scope = 'project'")
    found = _first_covering(approved, glossary, "target").join(approved.select("track_id", "pos", "target"), ["track_id", "pos"])
    stale = found.where(F.col("best").isNull() | ~F.col("best.b_target").eqNullSafe(F.col("target")))
    if tracks is not None:
        stale = tracks.select("track_id").distinct().crossJoin(F.broadcast(stale.drop("track_id")))
    return finding(stale, "terminology", "error", "project_term_not_applied", seq=F.lit(6000) + F.col("pos"), details={"en": F.col("en")})


def record_issues(records: DataFrame, kind: str) -> DataFrame:
    """Headers of candidate or decision records: (track_id, job, completed, updated_at)."""
    done, seq = ("term_extraction_incomplete", 0) if kind == "candidates" else ("term_decisions_incomplete", 1)
    stamp = F.col("completed") & (F.col("updated_at").isNull() | F.try_to_timestamp("updated_at").isNull())
    return union(
        finding(records.where("not (job <=> track_id)"), "terminology", "error", f"term_{kind}_job", seq=F.lit(-30 + seq)),
        finding(records.where(stamp), "terminology", "error", f"term_{kind}_timestamp", seq=F.lit(-20 + seq)),
        finding(records.where("not coalesce(completed, false)"), "terminology", "error", done, seq=F.lit(-10 + seq)),
    )


def form_conflicts(terms: DataFrame) -> DataFrame:
    """(track_id, pos, form, other_pos): forms that overlap one of an earlier term; the first of those holds the form."""
    a = forms(terms)
    b = a.select(F.col("track_id").alias("b_track"), F.col("pos").alias("b_pos"), F.col("norm").alias("b_norm"), F.col("fold").alias("b_fold"), F.col("exact_case").alias("b_exact"))
    overlap = F.when(F.col("exact_case") & F.col("b_exact"), F.col("norm") == F.col("b_norm")).otherwise(True)
    met = a.join(b, (F.col("track_id") == F.col("b_track")) & (F.col("fold") == F.col("b_fold")) & (F.col("b_pos") < F.col("pos")) & overlap)
    return met.groupBy("track_id", "pos", "form_pos", "form").agg(F.min("b_pos").alias("other_pos")).select("track_id", "pos", "form", "other_pos")


def target_hits(cues: DataFrame, targets: DataFrame, least: int = 2) -> DataFrame:
    """(track_id, cue, term): target terms (track_id, target) of ``least`` characters or more found in NFC text without blanks.

    The first three characters (fewer for shorter terms) anchor an equi-join with the text's n-grams.
    """
    from cueloom.functions.text import comparison_key

    terms = targets.select("track_id", unicode_forms(comparison_key("target"))["nfc"].alias("term")).where(F.length("term") >= least).distinct()
    terms = terms.select(F.col("track_id").alias("m_track"), "term", F.substring("term", 1, 3).alias("anchor"))
    text = cues.select("track_id", "cue", unicode_forms(comparison_key("text"))["nfc"].alias("said"))
    grams = F.flatten(F.transform(F.array(*[F.lit(k) for k in range(least, 4)]), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("said") - k + 1)), lambda i: F.substr(F.col("said"), i, k))))
    probes = text.select("track_id", "cue", "said", F.explode(F.array_distinct(grams)).alias("gram"))
    return probes.join(terms, (F.col("track_id") == F.col("m_track")) & (F.col("gram") == F.col("anchor"))).where(F.contains("said", F.col("term"))).select("track_id", "cue", "term").distinct()


def term_ids(terms: DataFrame) -> DataFrame:
    """(track_id, pos, id): slugs of ``en``; later terms with a taken slug get -2, -3 and so on."""
    from cueloom.functions.text import term_slug

    slugged = terms.withColumn("slug", term_slug(unicode_forms(squeeze("en"))["nfkc"]))
    n = F.row_number().over(W.partitionBy("track_id", "slug").orderBy("pos"))
    return slugged.select("track_id", "pos", F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n.cast("string"))).alias("id"))
