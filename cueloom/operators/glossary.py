"""The versioned glossary: term validation, lint, and the merge of decisions with its change journal.

A raw term table has (track_id, pos, id, en, aliases, case_sensitive, target, category, approval, scope, status, rationale),
any of them null but the first two; ``track_id`` names the glossary or record that a term belongs to.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cueloom.functions.text import has_capital, squeeze, term_slug, unicode_forms, utf16_length
from cueloom.operators.findings import finding, union
from cueloom.operators.terms import form_conflicts, forms

MOST_TERMS, MOST_ALIASES, MOST_CHARACTERS = 2000, 32, 256

TERM_COLUMNS = ["track_id", "pos", "id", "en", "aliases", "case_sensitive", "target", "category", "approval", "scope", "status", "rationale"]


def _text(name: str, default: str = "") -> Column:
    shown = squeeze(F.coalesce(F.col(name), F.lit("")))
    return F.when(shown == "", default).otherwise(shown) if default else shown


def aliases_without_repeats(terms: DataFrame) -> DataFrame:
    """``terms`` with ``aliases`` squeezed and without those equal to the term or an earlier alias under its case rule."""
    plain = terms.withColumn("aliases", F.transform(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), squeeze))
    each = forms(plain).withColumn("same", F.when(F.col("exact_case"), F.col("norm")).otherwise(F.col("fold")))
    first = W.partitionBy("track_id", "pos", "same").orderBy("form_pos")
    kept = each.withColumn("n", F.row_number().over(first)).where("n = 1 and form_pos > 0")
    listed = kept.groupBy(F.col("track_id").alias("k_track"), F.col("pos").alias("k_pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("form_pos", "form"))), lambda x: x["form"]).alias("k_aliases"))
    joined = plain.join(listed, (F.col("track_id") == F.col("k_track")) & (F.col("pos") == F.col("k_pos")), "left")
    return joined.withColumn("aliases", F.coalesce("k_aliases", F.expr("cast(array() as array<string>)"))).drop("k_track", "k_pos", "k_aliases")


def normalised_terms(raw: DataFrame, decisions: bool = False) -> DataFrame:
    """TERM_COLUMNS with defaults filled in, and ``code``: why a term is not valid, else null."""
    rows = raw.withColumn("en", _text("en")).withColumn("given", F.coalesce("aliases", F.expr("cast(array() as array<string>)")))
    rows = aliases_without_repeats(rows)
    rows = rows.withColumns({
        "target": _text("target"), "category": _text("category", "term"), "rationale": _text("rationale"), "status": _text("status", "ai-proposed" if decisions else "approved"),
        "approval": F.coalesce("approval", F.lit("" if decisions else "approved")), "scope": F.coalesce("scope", F.lit("" if decisions else "project")),
        "case_sensitive": F.coalesce("case_sensitive", has_capital(unicode_forms(F.col("en"))["nfkc"])), "id": F.coalesce("id", term_slug(unicode_forms(F.col("en"))["nfkc"])),
    })
    long_ = lambda c: utf16_length(c) > MOST_CHARACTERS
    code = (
        F.when(F.col("en") == "", "en_missing").when(long_(F.col("en")), "en_too_long")
        .when(~F.col("approval").isin(["approved", "review-required", "rejected"] if decisions else ["approved"]), "approval_unknown")
        .when(~F.col("scope").isin("project", "job"), "scope_unknown").when(long_(F.col("target")), "target_too_long")
        .when((F.col("approval") == "approved") & (F.col("target") == ""), "target_missing")
        .when(F.size("given") > MOST_ALIASES, "too_many_aliases").when(F.exists("given", lambda a: a.isNull() | (squeeze(a) == "")), "alias_empty").when(F.exists("given", long_), "alias_too_long")
    )
    return rows.withColumn("code", code).select(*TERM_COLUMNS, "code")


def normalised_candidates(raw: DataFrame) -> DataFrame:
    """(track_id, pos, en, aliases, case_sensitive, category, cues, reason, code) of candidates."""
    rows = aliases_without_repeats(raw.withColumn("en", _text("en")))
    rows = rows.withColumns({"cues": F.array_sort(F.array_distinct(F.filter(F.coalesce("cues", F.expr("cast(array() as array<int>)")), lambda c: c > 0))), "category": _text("category", "term"), "reason": _text("reason"), "case_sensitive": F.coalesce("case_sensitive", has_capital(unicode_forms(F.col("en"))["nfkc"]))})
    code = F.when(F.col("en") == "", "en_missing").when(utf16_length("en") > MOST_CHARACTERS, "en_too_long").when(F.size("cues") == 0, "cues_missing")
    return rows.withColumn("code", code).select("track_id", "pos", "en", "aliases", "case_sensitive", "category", "cues", "reason", "code")


def lint(terms: DataFrame, code: str = "glossary_invalid", ids: bool = True, warn: bool = True) -> DataFrame:
    """Findings of a term table as :func:`normalised_terms` gives it: invalid terms, repeated ids, conflicting forms, counts."""
    valid = terms.where("code is null")
    found = [finding(terms.where("code is not null"), "glossary", "error", code, seq=F.col("pos"), details={"reason": F.col("code")})]
    found.append(finding(form_conflicts(valid), "glossary", "error", code, seq=F.col("pos"), details={"reason": F.lit("form_repeated"), "form": F.col("form"), "other": F.col("other_pos")}))
    over = terms.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_TERMS)
    found.append(finding(over, "glossary", "error", code, seq=F.lit(-1), details={"reason": F.lit("too_many_terms")}))
    if ids:
        again = valid.withColumn("n", F.row_number().over(W.partitionBy("track_id", "id").orderBy("pos"))).where("n > 1")
        found.append(finding(again, "glossary", "error", code, seq=F.col("pos"), details={"reason": F.lit("id_repeated"), "id": F.col("id")}))
    if warn:
        found.append(finding(valid.where("rationale = ''"), "glossary", "warning", "glossary_warning", seq=F.lit(10_000) + F.col("pos")))
    return union(*found)


def selected(decisions: DataFrame, only: list[str]) -> tuple[DataFrame, list[str]]:
    """Decisions named in ``only`` - exactly, or but for case where they ignore it - and the names that none has."""
    if not only:
        return decisions, []
    spark = decisions.sparkSession
    wanted = spark.createDataFrame([(o,) for o in only], "wanted string").withColumn("u", unicode_forms(F.col("wanted"))).select("wanted", squeeze("u.nfkc").alias("w_norm"), squeeze("u.fold").alias("w_fold"))
    named = decisions.withColumn("u", unicode_forms(F.col("en"))).withColumns({"norm": squeeze("u.nfkc"), "fold": squeeze("u.fold")})
    # as many rows as the caller named
    met = named.join(F.broadcast(wanted), (F.col("fold") == F.col("w_fold")) & (~F.col("case_sensitive") | (F.col("en") == F.col("w_norm"))))
    known = {r["wanted"] for r in met.select("wanted").distinct().collect()}
    return met.select(*decisions.columns).distinct(), [o for o in only if o not in known]


_ROW = "id string, en string, aliases array<string>, case_sensitive boolean, target string, category string, approval string, scope string, status string, rationale string"
_FIELDS = _ROW.replace(", ", ",").replace(" ", ":")


def merged(glossary: DataFrame, decisions: DataFrame) -> DataFrame:
    """(track_id, pos, action, before, <term columns>) after approved project decisions are applied in order.

    A decision updates the first term whose ``en`` overlaps its own, keeping that term's id unless it brings one (column
    ``own_id``), or is added with an id that no other term has. action is keep, add or update; ``before`` is the term that an
    update replaced. Later decisions see what earlier ones did, so one glossary (2,000 terms at most) is one group.
    pos orders the result by ``en`` without case, then ``en``.
    """
    names = TERM_COLUMNS[2:]

    def apply(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        rows = [{**{n: r[n] for n in names}, "action": "keep", "before": None, "norm": r["norm"], "fold": r["fold"]} for r in old.sort_values("pos").to_dict("records")]
        plain = lambda t: [list(t[n]) if n == "aliases" else t[n] for n in names]
        for r in new.sort_values("pos").to_dict("records"):
            fresh = {**{n: r[n] for n in names}, "approval": "approved", "scope": "project", "norm": r["norm"], "fold": r["fold"]}
            at = next((i for i, t in enumerate(rows) if (t["norm"] == r["norm"] if t["case_sensitive"] and r["case_sensitive"] else t["fold"] == r["fold"])), None)
            if at is None:
                used, wanted, n = {t["id"] for t in rows}, fresh["id"], 2
                while fresh["id"] in used:
                    fresh["id"], n = f"{wanted}-{n}", n + 1
                rows.append({**fresh, "action": "add", "before": None})
                continue
            if not r["own_id"]:
                fresh["id"] = rows[at]["id"]
            if plain(fresh) != plain(rows[at]):
                was = rows[at]["before"] if rows[at]["action"] == "update" else None if rows[at]["action"] == "add" else {n: rows[at][n] for n in names}
                rows[at] = {**fresh, "action": "add" if rows[at]["action"] == "add" else "update", "before": was}
        made = pd.DataFrame(rows, columns=["action", "before", *names])
        made.insert(0, "track_id", (old if len(old) else new)["track_id"].iloc[0])
        return made

    keyed = lambda d: d.withColumn("u", unicode_forms(F.col("en"))).withColumns({"norm": squeeze("u.nfkc"), "fold": squeeze("u.fold")}).drop("u")
    kind = glossary.schema["track_id"].dataType.simpleString()
    wanted = decisions.where("approval = 'approved' and scope = 'project'")
    if "own_id" not in wanted.columns:
        wanted = wanted.withColumn("own_id", F.lit(False))
    both = keyed(glossary.select(*TERM_COLUMNS)).groupBy("track_id").cogroup(keyed(wanted.select(*TERM_COLUMNS, "own_id")).groupBy("track_id"))
    made = both.applyInPandas(apply, f"track_id {kind}, action string, before struct<{_FIELDS}>, {_ROW}")
    order = W.partitionBy("track_id").orderBy(F.collate(F.lower(squeeze("en")), "UNICODE"), F.collate("en", "UNICODE"))
    return made.withColumn("pos", F.row_number().over(order) - 1).select("track_id", "pos", "action", "before", *names)


def journal(result: DataFrame, revisions: DataFrame) -> DataFrame:
    """(track_id, revision_before, revision_after, changes): one row for each glossary that a merge changed."""
    after = F.struct(*TERM_COLUMNS[2:])
    changed = result.where("action <> 'keep'").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("pos", "action", "en", "before", after.alias("after")))).alias("changes"))
    return changed.join(revisions.withColumnRenamed("track_id", "r_track"), F.col("track_id") == F.col("r_track")).select("track_id", F.col("revision").alias("revision_before"), (F.col("revision") + 1).alias("revision_after"), "changes")
