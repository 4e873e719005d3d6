import pytest
from pyspark.sql import functions as F

from cueloom.operators import glossary as G, jobs as J, review as R, terms as T

CUE = "track_id long, cue int, start_ms long, end_ms long, text string"
TERM = "track_id long, pos int, en string, aliases array<string>, case_sensitive boolean, target string, approval string, scope string"


def cues(spark, *texts):
    return spark.createDataFrame([(0, i + 1, i * 1000, i * 1000 + 1000, t) for i, t in enumerate(texts)], CUE)


def terms(spark, *rows):
    """(en, target, case_sensitive, aliases, approval, scope)."""
    full = [(*r, *(None, [], "approved", "project")[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(0, i, en, al, cs, target, ap, sc) for i, (en, target, cs, al, ap, sc) in enumerate(full)], TERM)


def missing(spark, source, translated, glossary, decisions):
    found = T.missing_terms(cues(spark, *source), cues(spark, *translated), terms(spark, *glossary), terms(spark, *decisions) if decisions else terms(spark, ("zz", "zz")).limit(0))
    return sorted((r.cue, r.details["en"]) for r in found.collect())


def test_case_ignoring_greek_and_sharp_s(spark):
    assert missing(spark, ["ΣΑΣ", "STRAẞE"], ["x", "y"], [("σας", "你", False), ("straße", "街", False)], None) == [(1, "σας"), (2, "straße")]


def test_case_sensitive_homonyms(spark):
    glossary = [("Mercury", "水星", True), ("mercury", "汞", True)]
    assert missing(spark, ["Mercury rises", "mercury is toxic"], ["水星升起", "汞有毒"], glossary, None) == []
    assert missing(spark, ["Mercury rises"], ["汞升起"], glossary, None) == [(1, "Mercury")]


def test_job_terms_override_occurrences(spark):
    glossary, job = [("terminal", "终端", False)], [("Terminal", "航站楼", True, [], "approved", "job")]
    source = ["open the terminal", "at Terminal two", "the terminal at Terminal two"]
    assert missing(spark, source, ["终端", "航站楼", "终端 航站楼"], glossary, job) == []
    assert missing(spark, source, ["终端", "终端", "航站楼"], glossary, job) == [(2, "Terminal"), (3, "terminal")]


def test_a_shared_glossary_is_that_of_every_track(spark):
    glossary = terms(spark, ("terminal", "终端", False, ["end station"], "approved", "project"), ("gate", "门", False))
    decisions = terms(spark, ("Terminal", "航站楼", True, [], "approved", "job"), ("gate", "口", False, [], "approved", "job"))
    source = cues(spark, "the terminal at Terminal two", "an end  station", "Gate, gate", "nothing", "")
    translated = cues(spark, "航站楼", "x", "门", "y", "z")
    found = [
        sorted((r.track_id, r.cue, r.details["en"], r.details["target"]) for r in T.missing_terms(source, translated, g, decisions, shared).collect())
        for g, shared in ((glossary, False), (glossary.withColumn("track_id", F.lit(None).cast("long")), True))
    ]
    assert found[0] == found[1] == [(0, 1, "terminal", "终端"), (0, 2, "terminal", "终端"), (0, 3, "gate", "口")]


def test_hits_of_repeated_cues_and_tracks_apart(spark):
    twice = cues(spark, "a term", "no word")
    other = cues(spark, "a term").withColumn("track_id", F.lit(1).cast("long"))
    found = T.hits(twice.union(twice).union(other), T.forms(terms(spark, ("term", "x"), ("Term", "y", False))))
    assert sorted((r.track_id, r.cue, r.pos) for r in found.collect()) == [(0, 1, 0)] * 2 + [(0, 1, 1)] * 2
    shared = T.hits(twice.union(other), T.forms(terms(spark, ("term", "x"))), shared=True)
    assert sorted((r.track_id, r.cue) for r in shared.collect()) == [(0, 1), (1, 1)]
    assert T.hits(twice.limit(0), T.forms(terms(spark, ("term", "x")))).count() == T.hits(twice, T.forms(terms(spark, ("term", "x")).limit(0))).count() == 0


def test_shadowing_needs_all_forms(spark):
    glossary = terms(spark, ("alpha", "甲", False, ["beta"], "approved", "project"))
    half = terms(spark, ("alpha", "乙", False, [], "approved", "job"))
    whole = terms(spark, ("alpha", "乙", False, ["beta"], "approved", "job"))
    assert sorted(r.is_job for r in T.active_terms(glossary, half).collect()) == [False, True]
    assert [r.is_job for r in T.active_terms(glossary, whole).collect()] == [True]


def test_marks_only_and_many_word_forms(spark):
    listed = T.forms(terms(spark, ("+++", "加"), ("new york", "纽约", False)))
    found = T.hits(cues(spark, "a +++ b", "New\nYORK!", "news york"), listed)
    assert sorted((r.cue, r.en) for r in found.collect()) == [(1, "+++"), (2, "new york")]


def test_candidates(spark):
    raw = spark.createDataFrame([(0, 0, "Term", None, None, [1, 999]), (0, 1, "other", None, None, [1])], "track_id long, pos int, en string, aliases array<string>, case_sensitive boolean, cues array<int>")
    decisions = terms(spark, ("Term", "x", True, [], "review-required", "job"))
    found = T.candidate_issues(raw, decisions, cues(spark, "a Term here"))
    assert sorted((r.code, r.cue) for r in found.collect()) == [("candidate_without_decision", None), ("term_candidate_evidence", 1), ("term_candidate_range", None), ("term_unresolved", None)]
    narrow = terms(spark, ("Term", "x", True))
    broad = raw.where("pos = 0").withColumn("case_sensitive", F.lit(False))
    assert "candidate_without_decision" in [r.code for r in T.candidate_issues(broad, narrow, cues(spark, "Term")).collect()]


def test_target_hits(spark):
    targets = spark.createDataFrame([(0, "人工智能"), (0, "工智"), (0, "能"), (0, "没有")], "track_id long, target string")
    assert sorted(r.term for r in T.target_hits(cues(spark, "我爱 人工智能"), targets).collect()) == ["人工智能", "工智"]


RAW = "track_id long, pos int, id string, en string, aliases array<string>, case_sensitive boolean, target string, category string, approval string, scope string, status string, rationale string"


def raw(spark, *rows, approval="approved", scope="project"):
    return spark.createDataFrame([(1, i, ident, en, al, cs, target, None, approval, scope, None, "r") for i, (ident, en, al, cs, target) in enumerate(rows)], RAW)


def test_normalised_terms_and_codes(spark):
    rows = [(None, " C++ ", ["c++", "C++", "cpp"], None, "x"), (None, "", [], None, "x"), (None, "a", [" "], None, "x"), (None, "b", [], None, ""), (None, "é" * 257, [], None, "x"), (None, "c", [str(i) for i in range(33)], None, "x")]
    found = {r.pos: r for r in G.normalised_terms(raw(spark, *rows)).collect()}
    assert found[0].aliases == ["c++", "cpp"] and found[0].id == "c" and found[0].case_sensitive
    assert [found[i].code for i in range(6)] == [None, "en_missing", "alias_empty", "target_missing", "en_too_long", "too_many_aliases"]
    assert G.normalised_terms(raw(spark, (None, "a", [], None, "x"), approval="review-required")).first()["code"] == "approval_unknown"


def test_ids_and_conflicts(spark):
    table = raw(spark, (None, "C++", [], None, "x"), (None, "C#", [], None, "y"), (None, "c++", [], False, "z"))
    assert [r.id for r in T.term_ids(table).orderBy("pos").collect()] == ["c", "c-2", "c-3"]
    assert [(r.pos, r.other_pos) for r in T.form_conflicts(table).collect()] == [(2, 0)]


def merged(spark, old, new):
    g, d = G.normalised_terms(raw(spark, *old)).drop("code"), G.normalised_terms(raw(spark, *new), decisions=True).drop("code")
    return G.merged(g, d)


def test_merge(spark):
    got = merged(spark, [("one", "Alpha", [], False, "甲"), (None, "C++", [], None, "x")], [(None, "alpha", [], False, "乙"), (None, "C#", [], None, "y"), (None, "C++", [], None, "x")])
    rows = {r.en: (r.id, r.action, r.target) for r in got.collect()}
    assert rows == {"alpha": ("one", "update", "乙"), "C++": ("c", "update", "x"), "C#": ("c-2", "add", "y")}
    journal = G.journal(got, spark.createDataFrame([(1, 0)], "track_id long, revision int")).first()
    assert (journal.revision_before, journal.revision_after) == (0, 1) and {c["en"] for c in journal.changes} >= {"alpha", "C#"}


def test_only_selection(spark):
    table = G.normalised_terms(raw(spark, (None, "Alpha", [], True, "x"), (None, "beta", [], False, "y")), decisions=True)
    got, unknown = G.selected(table, ["BETA", "alpha"])
    assert [r.en for r in got.collect()] == ["beta"] and unknown == ["alpha"]


def test_incremental_review(spark):
    src = spark.createDataFrame([(0, i, i * 3000, i * 3000 + 3000, "same text") for i in range(1, 61)], CUE)
    other = src.withColumn("text", F.lit("同"))
    now = R.batches(src, other)
    assert [(r.cue_start, r.cue_end) for r in now.orderBy("cue_start").collect()] == [(1, 25), (26, 50), (51, 60)]
    whole = spark.createDataFrame([(0, 1, 60)], "track_id long, cue_start int, cue_end int")
    again = lambda a, b: [r.reused for r in R.reused(a, b, whole).orderBy("cue_start").collect()]
    assert again(now, now) == [True] * 3
    edited = src.withColumn("text", F.when(F.col("cue") == 25, "other").otherwise(F.col("text")))
    assert again(R.batches(edited, other), now) == [False, False, True]
    glossary = terms(spark, ("text", "文"), ("absent", "无"))
    near = R.relevant_terms(src, glossary)
    assert [r.pos for r in near.collect()] == [0]
    entries = glossary.join(near, ["track_id", "pos"]).select("track_id", F.lit("glossary").alias("kind"), "pos", F.col("en").alias("entry"))
    assert again(R.batches(src, other, terms=entries), now) == [False] * 3
    assert [r.code for r in R.stale_issues(R.batches(edited, other), now).collect()] == ["ai_review_stale"] and R.stale_issues(now, now).count() == 0


def test_review_record(spark):
    totals = spark.createDataFrame([(0, 10), (1, 10)], "track_id long, total int")
    cover = spark.createDataFrame([(0, 1, 6), (0, 5, 10), (1, 1, 9)], "track_id long, cue_start int, cue_end int")
    rows = spark.createDataFrame([(0, 1, "0", "passed", "2024-05-01T00:00:00Z", '[{"resolved":true}]'), (1, 2, "x", "pending", "never", '[{"resolved":"yes"}]')], "track_id long, schema_version int, job string, status string, reviewed_at string, issues string")
    found = R.review_issues(rows.withColumn("issues", F.parse_json("issues")), cover, totals)
    assert {r.code for r in found.where("track_id = 1").collect()} == {"ai_review_schema", "ai_review_job", "ai_review_not_passed", "ai_review_timestamp", "ai_review_incomplete_coverage", "ai_review_unresolved_issues"}
    assert found.where("track_id = 0").count() == 0
    bad = rows.where("track_id = 0").withColumn("issues", F.parse_json(F.lit('"none"')))
    assert [r.code for r in R.review_issues(bad, cover, totals).collect()] == ["ai_review_issues_invalid"]


JOB = "job_id string, project string, source_path string, track_hash string, options struct<bilingual:boolean,title:boolean,description:boolean>, phases map<string,string>, created_at string, updated_at string"
SOURCE = "job_id string, source_path string, track_hash string, bilingual boolean, title boolean, description boolean"


def test_job_states(spark):
    done = dict.fromkeys(J.PHASES, "verified") | {"readable": "generated", "ass": "not-requested", "qa": "passed"}
    jobs = spark.createDataFrame([(f"j{i}", "p", f"/{i}.srt", "h", (False, False, False), done | ({"normalized": "refreshing"} if i == 3 else {}), "t", "t") for i in range(4)], JOB)
    new = spark.createDataFrame([("j0", "/0.srt", "h", None, None, None), ("j1", "/1.srt", "h2", None, None, None), ("j2", "/2.srt", "h", True, None, None), ("j3", "/3.srt", "h", None, None, None), ("j9", "/9.srt", "h", True, None, None)], SOURCE)
    got = {r.job_id: r for r in J.refreshed(jobs, new).collect()}
    assert {k: r.state for k, r in got.items()} == {"j0": "resumed", "j1": "refreshed", "j2": "reoptioned", "j3": "refreshed", "j9": "created"}
    assert got["j0"].phases == done and got["j1"].phases["qa"] == "pending" and got["j2"].phases["readable"] == "pending" and got["j2"].phases["terminology"] == "verified"
    assert got["j9"].phases["ass"] == "pending" and got["j1"].phases["ass"] == "not-requested"
    begun = {r.job_id: r.phases for r in J.begin(jobs, "readable", ["j0"]).collect()}
    assert begun["j0"]["qa"] == "pending" and begun["j0"]["readable"] == "generated" and begun["j1"] == done
    assert {r.phases["aiReview"] for r in J.glossary_changed(jobs, "p").collect()} == {"pending"}
    assert J.ready_for_checks(jobs).count() == 4 and J.status(jobs).where("job_id = 'j0'").count() == 7
    after = J.checked(jobs, spark.createDataFrame([("j0", True), ("j1", False)], "job_id string, passed boolean"), spark.createDataFrame([("j1",)], "job_id string"), spark.createDataFrame([], "job_id string"))
    told = {r.job_id: r.phases for r in after.collect()}
    assert told["j0"]["qa"] == "passed" and told["j1"]["qa"] == "failed" and told["j1"]["terminology"] == "failed" and told["j2"] == done


def test_job_ids(spark):
    jobs = spark.createDataFrame([("talk", "/a/talk.srt")], "job_id string, source_path string")
    new = spark.createDataFrame([("/a/talk.srt",), ("/b/Talk.srt",), ("/c/talk.vtt",), ("/d/" + "é" * 60 + ".srt",)], "source_path string")
    got = {r.source_path: r.job_id for r in J.job_ids(new, jobs).collect()}
    assert got["/a/talk.srt"] == "talk" and {got["/b/Talk.srt"], got["/c/talk.vtt"]} == {"talk-2", "talk-3"} and got["/d/" + "é" * 60 + ".srt"] == "é" * 48


@pytest.mark.parametrize("terms_", [0, 1])
def test_history_is_kept(spark, terms_):
    rows = spark.createDataFrame([(0, bool(terms_), "t", ["x"] * terms_, "old")], "track_id long, completed boolean, updated_at string, terms array<string>, previous string")
    got = J.with_history(rows, "changed").first()
    assert got.terms == [] and not got.completed and (("changed" in got.previous) == bool(terms_))


def test_tables_that_all_tracks_share_are_judged_once(spark):
    one = lambda d: d.withColumn("track_id", F.lit(7).cast("long"))
    raw_ = spark.createDataFrame([(0, "Term", None, None, [1, 2, 2, 999]), (1, "other", ["more"], None, [1, 0]), (2, "late", None, None, None)], "pos int, en string, aliases array<string>, case_sensitive boolean, cues array<int>")
    listed = terms(spark, ("Term", "x", True, [], "review-required", "job"), ("other", "y", False, ["more"], "approved", "project"), ("late", "z", False, [], "approved", "project"))
    source = cues(spark, "a Term here", "more of it").unionByName(cues(spark, "other", "Term").withColumn("track_id", F.lit(3).cast("long")))
    source = source.unionByName(cues(spark, "late").withColumns({"track_id": F.lit(4).cast("long"), "cue": F.lit(50)}))
    tracks = source.select("track_id").distinct()
    each = lambda d: tracks.crossJoin(d.drop("track_id"))
    rows = lambda d: sorted(str((r.track_id, r.check_order, r.seq, r.severity, r.code, r.cue, r.details)) for r in d.collect())
    shared = T.candidate_issues(one(raw_), one(listed), source, shared=True)
    assert rows(shared) == rows(T.candidate_issues(each(raw_), each(listed), source))
    assert (3, "term_candidate_evidence", 1) in [(r.track_id, r.code, r.cue) for r in shared.collect()] and (4, "term_candidate_range", None) in [(r.track_id, r.code, r.cue) for r in shared.collect()]
    glossary = listed.withColumn("target", F.when(F.col("pos") == 1, "w").otherwise(F.col("target")))
    stale = T.application_issues(one(listed), one(glossary), source)
    assert rows(stale) == rows(T.application_issues(each(listed), each(glossary))) and sorted((r.track_id, r.details["en"]) for r in stale.collect()) == [(0, "other"), (3, "other"), (4, "other")]
