"""Caption files, short-form captions, verdicts given twice and moods."""

import re

import pytest
from pyspark.sql import functions as F

from seqlens.operators import evidence as E
from seqlens.operators import review as R
from seqlens.operators import timeline as L
from seqlens.sources import writers


@pytest.fixture(scope="module")
def captions(spark):
    rows = [("b", 7300.5, 7301.25, "late"), ("a", 61.0, 62.5, "second"), ("a", 0.0, 1.005, "first"), ("a", 4000.0, 4001.0, "third")]
    return spark.createDataFrame(rows, "g string, start double, end double, text string")


def test_files_hold_header_and_numbered_blocks(captions, spark, tmp_path):
    rows = writers.caption_lines(captions, ["g"]).orderBy("g", "kind", "line").collect()
    ass = [r.text for r in rows if (r.g, r.kind) == ("a", "ass")]
    assert ass[0] == "[Script Info]" and ass[len(writers.ASS_HEADER) - 2] == "[Events]"
    assert [re.sub(".*,,", "", x) for x in ass[len(writers.ASS_HEADER):]] == ["first", "second", "third"]
    srt = "\n".join(r.text for r in rows if (r.g, r.kind) == ("a", "srt"))
    assert srt.startswith("1\n00:00:00,000 --> 00:00:01,005\nfirst\n\n2\n00:01:01,000 --> 00:01:02,500\nsecond\n\n3\n01:06:40,000 -->")
    writers.write_captions(captions, ["g"], f"{tmp_path}/c")
    assert spark.read.text(f"{tmp_path}/c/g=b/kind=srt").count() == 4


def test_short_captions(spark):
    words = spark.createDataFrame(
        [("c", 0, i, w, 0.4 * i, 0.4 * i + 0.3) for i, w in enumerate(["He", "dies!", "a", "KING's", "end"])],
        "c string, scene int, pos int, word string, w_start double, w_end double")
    spans = spark.createDataFrame([("c", 0, 10.0, 11.8)], "c string, scene int, t0 double, total double")
    got = L.caption_chunks(words, spans, ["c"], short=True, total="total").orderBy("chunk").collect()
    assert [(r.text, round(r.start, 2), round(r.end, 2)) for r in got] == [("He dies!", 10.0, 10.76), ("a KING's", 10.8, 11.56), ("end", 11.6, 11.8)]
    classes = words.select("pos", L.short_word_class(F.col("word"), F.array(F.lit("Kings"))).alias("k")).orderBy("pos").collect()
    assert [r.k for r in classes] == ["none", "shock", "none", "keyword", "none"]


def test_two_verdicts_do_not_double_a_fault(spark):
    faults = spark.createDataFrame([("c", 1, "high", "x")], "c string, scene int, severity string, detail string")
    panels = spark.createDataFrame([("c", 1, "p1"), ("c", 1, "p2")], "c string, scene int, panel string")
    verdicts = spark.createDataFrame([("c", 1, "dismiss", []), ("c", 1, "drop", ["p1"])], "c string, scene int, decision string, panels array<string>")
    updated, left = R.apply_verdicts(faults, panels, verdicts, ["c"])
    assert [r.severity for r in updated.collect()] == ["resolved_drop"] and [r.panel for r in left.collect()] == ["p2"]


def test_moods_by_the_real_cues(spark):
    scenes = spark.createDataFrame(
        [(1, "They fight and clash.", "a duel", ["tears"]), (2, "nothing", None, None), (3, "fight", "", ["war"]), (4, "war", "grief", ["sad"])],
        "s int, narration string, caption string, keywords array<string>")
    scripts = spark.createDataFrame([(1, "x", None), (2, "x", ""), (3, "x", "Chill"), (4, "Loneliness", None), (5, "no scenes", None)], "s int, title string, music_mood string")
    got = {r.s: (r.mood, r.why) for r in E.derive_mood(scenes, scripts, ["s"]).collect()}
    assert got == {1: ("Action", "vote"), 2: ("Cinematic", "default"), 3: ("Chill", "script"), 4: ("Sad", "vote"), 5: ("Cinematic", "default")}
    assert {(r.mood, r.why) for r in E.derive_mood(scenes, scripts, ["s"], "Epic").collect()} == {("Epic", "override")}
