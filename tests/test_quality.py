"""All quality checks as one plan, over a sound track and one with a fault for each group of checks."""

from cueloom.operators import findings as FI
from cueloom.plans import quality as Q
from pyspark.sql import functions as F

CUE = "track_id long, cue int, start_ms long, end_ms long, text string"
TERM = "track_id long, pos long, id string, en string, aliases array<string>, case_sensitive boolean, target string, category string, approval string, scope string, status string, rationale string"


def artifacts(spark):
    said = [(1, 0, 4000, "the harbour has 25 boats"), (2, 4000, 8000, "nobody came")]
    told = [(1, 0, 4000, "港口有25条船"), (2, 4000, 8000, "没有人来")]
    source = spark.createDataFrame([(t, *r) for t in (1, 2) for r in said], CUE)
    wrong = [(1, 0, 4000, "码头有船 Abc"), (2, 4100, 8000, "没有人来")]
    translated = spark.createDataFrame([(1, *r) for r in told] + [(2, *r) for r in wrong], CUE)
    readable = spark.createDataFrame([(1, *r) for r in told] + [(2, 1, 0, 4000, "码头有船 Abc"), (2, 2, 4100, 8000, "没有人")], CUE)
    term = lambda t, en, target: (t, 0, None, en, [], False, target, None, "approved", "project", None, "why")
    glossary = spark.createDataFrame([term(t, "harbour", "港口") for t in (1, 2)], TERM)
    candidates = spark.createDataFrame([(1, 0, "harbour", [], False, None, [1], None), (2, 0, "harbour", [], False, None, [9], None)], "track_id long, pos long, en string, aliases array<string>, case_sensitive boolean, category string, cues array<int>, reason string")
    bodies = lambda *rows: spark.createDataFrame(rows, "track_id long, body string")
    return Q.Artifacts(
        source, translated, readable, glossary, spark.createDataFrame([term(t, "harbour", "港口") for t in (1, 2)], TERM), candidates,
        titles=bodies((1, "Original: a\nChinese: 甲"), (2, "Original: a")),
        descriptions=bodies((1, "来源：https://host/1\n作者：b\n\ntext"), (2, "text")),
    )


def test_all_checks(spark):
    a = artifacts(spark)
    found = Q.findings(a, by_time=True)
    rows = found.collect()
    assert [(r.track_id, r.code) for r in rows if r.track_id == 1] == []
    assert {(r.code, r.cue) for r in rows} == {
        ("semantic_timing_changed", 2), ("readable_text_drift", 2), ("number_mismatch", 1), ("term_candidate_range", None), ("missing_active_term", 1),
        ("untranslated_latin", 1), ("title_invalid", None), ("description_invalid", None),
    }
    report = FI.report(spark.createDataFrame(rows, found.schema), a.source).orderBy("track_id").collect()
    assert [(r.passed, r.errors, r.warnings) for r in report] == [(True, 0, 0), (False, 6, 2)]


def test_missing_artifacts(spark):
    tracks, found = spark.range(2).select(F.col("id").alias("track_id")), spark.createDataFrame([(0, "source"), (0, "readable"), (1, "source")], "track_id long, artifact string")
    assert [(r.track_id, r.artifact) for r in Q.missing_artifacts(tracks, found, ["source", "readable"]).collect()] == [(1, "readable")]
