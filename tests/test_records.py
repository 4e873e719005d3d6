import json

import pytest
from cueloom.functions.text import strict_json
from cueloom.operators import glossary as G, jobs as J
from cueloom.sources import captions as C, records as R
from pyspark.sql import functions as F

GLOSSARY = {"schemaVersion": 1, "sourceLanguage": "en", "targetLanguage": "zh-Hans", "revision": 3, "updatedAt": None, "terms": []}
RECORD = {"schemaVersion": 1, "job": "a", "completed": True, "updatedAt": "2024-01-02T03:04:05Z", "terms": []}


def bodies(spark, rows):
    return spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v), None) for k, v in rows], "track_id string, body string, code string")


def test_json_is_read_strictly(spark):
    good = ["1", "null", ' {"a": [1, "x"]}\n', '"]"', "[]"]
    bad = ["", " ", "1 2", "1,2", "1],[2", '{"a":1} x', "{'a':1}", '{"a":1,}', "[1", "NaN", "01", '{"a":1,"a":2}', None]
    got = spark.createDataFrame([(b,) for b in good + bad], "b string").select("b", strict_json("b").isNotNull().alias("ok")).collect()
    assert [r.b for r in got if r.ok] == good


def test_json3_with_a_tail_is_no_track(spark):
    body = json.dumps({"events": [{"tStartMs": 0, "dDurationMs": 900, "segs": [{"utf8": "one"}]}]})
    scan = C.read_json3(spark.createDataFrame([(0, body), (1, body + " tail")], "track_id long, body string"))
    assert [r.track_id for r in scan.cues.collect()] == [0] and [(r.track_id, r.code) for r in scan.rejects.collect()] == [(1, "no_cues")]


def test_glossaries(spark):
    terms = [
        {"en": "Harbour", "zhHans": "港", "aliases": ["port", " the  port "], "caseSensitive": False}, 7, {"en": "x", "caseSensitive": "true"}, {"en": "x", "caseSensitive": None},
        {"en": "x", "aliases": "y"}, {"en": "x", "aliases": [1]}, {"en": 5, "zhHans": "五", "id": 9}, {},
    ]
    broken = {"schemaVersion": 2, "sourceLanguage": "fr", "targetLanguage": "zh", "revision": -1, "terms": {}}
    made = R.read_glossaries(bodies(spark, [("g", GLOSSARY | {"terms": terms}), ("bad", broken), ("list", []), ("text", "no"), ("none", None), ("empty", GLOSSARY), ("many", GLOSSARY | {"revision": 1.5, "terms": [{}] * 2001})]))
    got = sorted((r.track_id, r.pos, r.code) for r in made.rejects.collect())
    heads = ["revision_unknown", "source_language_unknown", "target_language_unknown", "terms_not_list", "version_unknown"]
    assert got == sorted(
        [("bad", -1, c) for c in heads] + [("list", -1, "not_object"), ("text", -1, "not_json"), ("none", -1, "not_json"), ("many", -1, "revision_unknown"), ("many", -1, "too_many_terms")]
        + [("g", k, c) for k, c in ((1, "entry_not_object"), (2, "case_not_boolean"), (3, "case_not_boolean"), (4, "aliases_not_list"), (5, "alias_not_text"))]
    )
    kept = [r for r in G.normalised_terms(made.terms).orderBy("pos").collect() if r.track_id == "g"]
    assert [(r.pos, r.id, r.en, r.target, list(r.aliases), r.case_sensitive, r.code) for r in kept] == [
        (0, "harbour", "Harbour", "港", ["port", "the port"], False, None), (6, "9", "5", "五", [], False, None), (7, "term", "", "", [], False, "en_missing"),
    ]
    assert {r.track_id: r.revision for r in made.headers.collect()} == {"g": 3, "bad": -1, "empty": 3, "many": None}
    assert {r.code for r in made.findings("glossary_invalid").collect()} == {"glossary_invalid"}


def test_candidates_and_decisions(spark):
    candidate = {"en": "keeper", "cueIndexes": [3, "2", 2, 0, -1, 1.5, None, 1e12], "reason": "seen"}
    made = R.read_candidates(bodies(spark, [("a", RECORD | {"terms": [candidate, {"en": "b", "cueIndexes": 4}]}), ("b", RECORD | {"completed": "yes"})]))
    rows = G.normalised_candidates(made.terms).orderBy("pos").collect()
    assert [(r.en, list(r.cues), r.reason, r.code) for r in rows] == [("keeper", [2, 3], "seen", None), ("b", [], "", "cues_missing")]
    assert [(r.track_id, r.code) for r in made.rejects.collect()] == [("b", "completed_not_boolean")]
    assert {r.track_id: (r.job, r.completed) for r in made.headers.collect()} == {"a": ("a", True), "b": ("a", None)}
    chosen = R.read_decisions(bodies(spark, [("a", RECORD | {"terms": [{"en": "k", "zhHans": "守", "approvalStatus": "approved", "syncScope": "project", "id": "k-1"}, {"en": "m"}]})]))
    assert [(r.en, r.own_id) for r in chosen.terms.orderBy("pos").collect()] == [("k", True), ("m", False)]
    assert [r.code for r in G.normalised_terms(chosen.terms, decisions=True).orderBy("pos").collect()] == [None, "approval_unknown"]


def job(name, **more):
    phases = {"normalized": {"status": "verified"}, "ass": {"status": "not-requested"}}
    return {"schemaVersion": 1, "id": name, "createdAt": "c", "updatedAt": "u", "options": {"bilingualAss": True}, "source": {"originalPath": f"/in/{name}.srt"}, "phases": phases} | more


def test_jobs_of_a_folder(spark, tmp_path):
    texts = {"b": json.dumps(job("b")), "a": "﻿" + json.dumps(job("a")), "other": json.dumps(job("b")), "old": json.dumps(job("old", schemaVersion=0)), "text": "{", "flat": json.dumps(job("flat", phases=[]))}
    for name, text in texts.items():
        (tmp_path / "jobs" / name / "source").mkdir(parents=True)
        (tmp_path / "jobs" / name / "job.json").write_text(text, encoding="utf-8")
    (tmp_path / "jobs" / "wide").mkdir()
    (tmp_path / "jobs" / "wide" / "job.json").write_bytes(b"\xff\xfe" + json.dumps(job("wide")).encode("utf-16-le"))
    (tmp_path / "jobs" / "bytes").mkdir()
    (tmp_path / "jobs" / "bytes" / "job.json").write_bytes(b"\x80")
    (tmp_path / "jobs" / "nothing").mkdir()
    srt = "1\n00:00:00,000 --> 00:00:01,000\none\n"
    (tmp_path / "jobs" / "a" / "source" / "source.en.srt").write_text(srt)
    jobs, rejects = R.project_jobs(spark, str(tmp_path), "p")
    rows = jobs.collect()
    assert [r.job_id for r in rows] == ["a", "b", "wide"] and rows[0].source_path == "/in/a.srt"
    want = J.track_hashes(spark.createDataFrame([("a", srt)], "track_id string, body string")).first().track_hash
    assert [r.track_hash for r in rows] == [want, None, None]
    assert rows[0].options.asDict() == {"bilingual": True, "title": False, "description": False}
    assert rows[0].phases["normalized"] == "verified" and rows[0].phases["qa"] == "pending"
    assert {r.track_id: r.code for r in rejects.collect()} == {"other": "id_differs", "old": "version_unknown", "text": "not_json", "bytes": "undecodable", "flat": "phases_not_object"}
    again, none = R.read_jobs(R.job_bodies(jobs).withColumn("code", F.lit(None).cast("string")), "p")
    assert none.count() == 0 and sorted(map(str, again.drop("track_hash").collect())) == sorted(map(str, jobs.drop("track_hash").collect()))
    begun = J.begin(jobs, "qa", ["a"])
    assert J.status(begun).count() == 3 * len(J.PHASES)


@pytest.mark.parametrize("made", [False, True])
def test_no_jobs(spark, tmp_path, made):
    if made:
        (tmp_path / "jobs").mkdir()
    jobs, rejects = R.project_jobs(spark, str(tmp_path), "p")
    assert jobs.count() == rejects.count() == 0
