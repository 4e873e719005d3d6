import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import words
from cueloom.sources import captions as C, writers as W


def read(spark, reader, *bodies):
    scan = reader(spark.createDataFrame(list(enumerate(bodies)), "track_id long, body string"))
    cues = sorted((r.track_id, r.cue, r.start_ms, r.end_ms, r.text) for r in scan.cues.collect())
    return cues, {r.track_id: r.code for r in scan.rejects.collect()}


SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello <i>there</i>\nyou\n\n2\n00:00:03,000 --> 00:00:04,000 X1:1 X2:2 Y1:3 Y2:4\nA --> B\n"


def test_srt_and_back(spark):
    cues, rejects = read(spark, C.read_srt, SRT, "﻿" + SRT.replace("\n", "\r\n"))
    assert not rejects and cues[:2] == [(0, 1, 1000, 2500, "Hello there\nyou"), (0, 2, 3000, 4000, "A --> B")] and [c[1:] for c in cues[:2]] == [c[1:] for c in cues[2:]]
    rows = spark.createDataFrame(cues, "track_id long, cue int, start_ms long, end_ms long, text string")
    again = C.read_srt(W.srt_bodies(rows)).cues.select("track_id", "cue", "start_ms", "end_ms", "text")
    assert sorted(map(tuple, again.collect())) == cues


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ("1\nno time\n", "no_timeline"), ("", "no_cues"), (None, "no_cues"), ("x\n00:00:01,000 --> 00:00:02,000\nhi\n", "no_timeline"), ("00:00:01,000 --> 00:00:02,000\na\n00:00:03,000 --> 00:00:04,000\nb\n", "two_timelines"),
        ("00:00:02,000 --> 00:00:02,000\na\n", "no_duration"), ("00:00:01,000 --> 00:61:02,000\na\n", "bad_time"), ("00:00:01,000 --> 00:00:02,000\n<i></i>\n", "no_text"), ("00:00:01,000 --> 00:00:02,000 --> 3\na\n", "bad_time"),
        ("00:00:01,000 --> 00:00:02,000\n" + "x" * 4001 + "\n", "cue_too_long"),
    ],
)
def test_a_fault_keeps_its_track_out_and_no_other(spark, body, code):
    cues, rejects = read(spark, C.read_srt, body, SRT)
    assert rejects == {0: code} and {c[0] for c in cues} == {1}
    with pytest.raises(ValueError, match=code):
        C.read_srt(spark.createDataFrame([(0, body)], "track_id long, body string")).strict()


def test_vtt(spark):
    body = "WEBVTT\n\nNOTE a\n\nid one\n00:01.000 --> 00:02.000 align:start line:3\nFish &amp; chips &lt;3 &amp;lt;\n\n00:03.000 --> 00:04.000\n<v Ann>hi</v>\n"
    cues, rejects = read(spark, C.read_vtt, body, "WEBVTT\n00:01.000 --> 00:02.000\nx\n", body.replace("WEBVTT\n\n", ""))
    assert rejects == {1: "timeline_in_directive"}
    assert [c[2:] for c in cues if c[0] == 0] == [(1000, 2000, "Fish & chips <3 &lt;"), (3000, 4000, "hi")] and len([c for c in cues if c[0] == 2]) == 2


def test_ass(spark):
    body = "[Script Info]\nDialogue: ignored\n[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.50,{\\i1}a, b\\Nc\\hd\n[Fonts]\nDialogue: x\n"
    cues, rejects = read(spark, C.read_ass, body, body.replace("0:00:01.00,0:00:02.50,", ""), body.replace("Text", "Words"))
    assert cues == [(0, 1, 1000, 2500, "a, b\nc d")] and rejects == {1: "too_few_fields", 2: "no_text_field"}


def test_json3(spark):
    good = '{"events":[{"tStartMs":5000,"segs":[{"utf8":"b"},{}]},{"tStartMs":1000,"segs":[{"utf8":"a\\u2060c"}]},7,{"segs":3},{"tStartMs":"x","segs":[{"utf8":" "}]},{"tStartMs":9000,"dDurationMs":500.4,"segs":[{"utf8":"d"}]}]}'
    bad = ['{"events":[{"tStartMs":"1","segs":[{"utf8":"a"}]}]}', '{"events":[{"tStartMs":1,"dDurationMs":0,"segs":[{"utf8":"a"}]}]}', '{"events":[{"tStartMs":1,"segs":[{"utf8":5}]}]}', '{"events":[{"tStartMs":-1,"segs":[{"utf8":"a"}]}]}', "{", '{"events":[{"tStartMs":1,"dDurationMs":"9","segs":[{"utf8":"a"}]}]}']
    cues, rejects = read(spark, C.read_json3, good, *bad)
    assert cues == [(0, 1, 1000, 5000, "a c"), (0, 2, 5000, 9000, "b"), (0, 3, 9000, 9500, "d")]
    assert rejects == {1: "bad_start", 2: "bad_length", 3: "segment_not_text", 4: "bad_start", 5: "no_cues", 6: "bad_length"}


def test_long_events_are_cut_at_pauses(spark):
    rng = random.Random(3)
    for _ in range(200):
        some = [rng.choice(["and", "word", "a,", "longerword", "because", "x"]) for _ in range(rng.randrange(1, 120))]
        most = rng.randrange(20, 100)
        ends = words.cut_points(some, most)
        assert ends[-1] == len(some) and ends == sorted(set(ends))
        low = 0
        for high in ends[:-1]:
            assert len(" ".join(some[low:high])) <= int(1.2 * most) or high == low + 1
            low = high
    parts = words.split_event("one two three", 0.0, 3.0, 92, 7.5)
    assert parts == [{"start": 0.0, "end": 3.0, "text": "one two three"}]
    many = words.split_event(" ".join(["word"] * 1500), 0.0, 120.0, 92, 7.5)
    assert len(many) > 50 and all(a["end"] == b["start"] for a, b in zip(many, many[1:], strict=False)) and many[-1]["end"] == 120.0


def test_files(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(b"\xff\xfe" + SRT.encode("utf-16-le"))
    (tmp_path / "b.VTT").write_bytes(b"\xfe\xff" + "00:01.000 --> 00:02.000\né\n".encode("utf-16-be"))
    (tmp_path / "c.srt").write_bytes(b"caf\xe9")
    (tmp_path / "d.srt").write_bytes(b"\xff\xfeabc")
    (tmp_path / "e.txt").write_bytes(b"x")
    (tmp_path / "f.ass").write_text("[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,S,,0,0,0,,hi\n")
    (tmp_path / "g.srt").write_bytes(b"\xff\xfe" + b"\x00\xd8a\x00")
    scan, told = C.read_files(spark, str(tmp_path))
    name = F.regexp_extract("track_id", "([^/]+)$", 1)
    assert {r.n: r.c for r in scan.cues.groupBy(name.alias("n")).agg(F.count("*").alias("c")).collect()} == {"a.srt": 2, "b.VTT": 1, "f.ass": 1}
    assert {r[0]: r[1] for r in scan.rejects.select(name, "code").collect()} == {"c.srt": "undecodable", "d.srt": "undecodable", "e.txt": "unsupported_format", "g.srt": "undecodable"}
    assert told.where("warning is not null").count() == 1


def test_ass_round_trip_and_problems(spark):
    rows = [(0, 1, 1000, 2000, "中{文}"), (0, 2, 2000, 3010, "二"), (1, 1, 0, 1000, "宽" * 25), (2, 1, 0, 1000, "一\n二")]
    zh = spark.createDataFrame(rows, "track_id long, cue int, start_ms long, end_ms long, text string")
    en = zh.withColumn("text", F.lit("an english line"))
    bodies, problems = W.ass_bodies(zh, en)
    assert {r.track_id: r.code for r in problems.collect()} == {1: "ass_target_wide", 2: "ass_target_lines"}
    back = C.read_ass(bodies).cues.orderBy("cue").collect()
    assert [(r.start_ms, r.text) for r in back] == [(1000, "中｛文｝\nan english line"), (2000, "二\nan english line")]
    with pytest.raises(ValueError, match="font"):
        W.ass_bodies(zh, en, font="a,b")
    with pytest.raises(ValueError, match="language"):
        W.ass_bodies(zh, en, language="fr")


def test_folder_is_replaced_and_journal_appended(spark, tmp_path):
    W.replace_folder(spark.range(3), str(tmp_path / "t"))
    W.replace_folder(spark.range(5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    for _ in range(2):
        W.append_journal(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_streaming_reads_each_file_once(spark, tmp_path):
    from cueloom.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    for round_, name in enumerate(["a.srt", "b.srt", "bad.srt"]):
        (tmp_path / "in" / name).write_text(SRT if name != "bad.srt" else "nothing")
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "cues"), str(tmp_path / "rejects"), str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "cues")).count() == 2 * min(round_ + 1, 2)
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1
