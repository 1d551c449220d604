"""Voting, vetoes, sinks and jobs on constructed tables."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from seqlens.catalog import QUERIES, oracles
from seqlens.operators import ranking as K
from seqlens.operators import review as R
from seqlens.operators import timeline as L
from seqlens.plans import jobs
from seqlens.sources import readers, writers
from seqlens.streaming.evidence import keep_evidence

FAULT = "g int, arm string, pass int, scene int, type string, severity string, t double, detail string, ord int, frame_md5 string"
MEDIA = "g int, duration double, base_duration double, lufs double"


def _arms(base, cur):
    rows, n = [], 0
    for arm, faults in (("baseline", base), ("experiment", cur)):
        for p, scene, kind, sev, t, md5 in faults:
            rows.append((1, arm, p, scene, kind, sev, t, "d", n, md5))
            n += 1
    return rows


def _verdict(spark, base, cur, n_base=3, n_cur=3, frames=()):
    passes = [(1, "baseline", p) for p in range(n_base)] + [(1, "experiment", p) for p in range(n_cur)]
    return jobs.score_experiments(
        spark.createDataFrame(passes, "g int, arm string, pass int"), spark.createDataFrame(_arms(base, cur), FAULT),
        spark.createDataFrame(list(frames), "g int, t double, md5 string"), spark.createDataFrame([(1, 100.0, 100.0, -14.0)], MEDIA), ["g"], 2.0,
    ).first()


def test_same_input_has_no_veto(spark):
    faults = [(p, s, k, "high", 5.0, "x") for p in range(3) for s in (None, 1, 2) for k in ("a", "b")]
    r = _verdict(spark, faults, faults)
    assert r.base_score == r.cur_score == 30 and r.vetoes == [] and r.verdict == "FAIL"


def test_moved_fault_is_netted_and_new_one_vetoes(spark):
    base = [(p, s, "a", "high", 5.0, "x") for p in range(3) for s in (1, 2, 3)]
    moved = [(p, s, "a", "medium", 5.0, "x") for p in range(3) for s in (4, 2, 3)]
    assert _verdict(spark, base, moved).verdict == "PASS"
    new = moved + [(p, 9, "b", "low", 50.0, "new") for p in range(3)]
    r = _verdict(spark, base, new)
    assert r.vetoes == ["new_type", "worsened"] and r.verdict == "FAIL"
    # the same picture in the baseline within two seconds lifts the veto
    assert _verdict(spark, base, new, frames=[(1, 51.5, "new")]).verdict == "PASS"
    assert _verdict(spark, base, new, frames=[(1, 52.5, "new"), (1, 50.0, "old")]).verdict == "FAIL"


def test_unequal_pass_counts_share_the_stricter_bar(spark):
    base = [(p, 1, "a", "high", 5.0, "x") for p in range(3)]
    weak = [(p, 1, "a", "low", 5.0, "x") for p in range(5)] + [(p, 2, "a", "low", 9.0, "y") for p in range(3)]
    # 3 of 5 is a majority there but below two of three
    r = _verdict(spark, base, weak, n_cur=5)
    assert r.vetoes == [] and r.cur_score == 2
    strong = [(p, 1, "a", "low", 5.0, "x") for p in range(5)] + [(p, 2, "a", "low", 9.0, "y") for p in range(4)]
    assert _verdict(spark, base, strong, n_cur=5).vetoes == ["worsened"]


def test_vote_edges(spark):
    rows = [(1, 0, None, "a", "high", 1.0, "first", 0), (1, 0, None, "a", "low", 2.0, "second", 1), (1, 2, None, "a", "low", 3.0, "x", 2),
            (1, 1, 3, "b", "high", 4.0, "x", 3), (1, 1, 4, "b", "odd", 4.0, "x", 4)]
    faults = spark.createDataFrame(rows, "g int, pass int, scene int, type string, severity string, t double, detail string, ord int")
    passes = spark.createDataFrame([(1, p) for p in range(4)], "g int, pass int")
    got = {(r.scene, r.type): (r.votes, r.status, r.detail) for r in R.majority_vote(faults, passes, ["g"]).collect()}
    assert got == {(None, "a"): ("2/4", "scored", "first"), (3, "b"): ("1/4", "unconfirmed", "x"), (4, "b"): ("1/4", "dropped", "x")}
    assert R.weighted_score(faults, ["g"]).first().score == 5 + 1 + 1 + 5 + 1
    shuffled = R.majority_vote(faults.orderBy(F.rand(1)).repartition(7), passes, ["g"])
    assert {(r.scene, r.type): r.votes for r in shuffled.collect()} == {k: v[0] for k, v in got.items()}


def test_pick_rank_out_of_range(spark):
    df = spark.createDataFrame([(1, "A b", 0.5, 1), (2, "C", 0.9, 2)], "source_id int, title string, video_score double, ord int")
    assert K.pick_rank(df, 2).first().slug == "a-b"
    with pytest.raises(Exception, match="out of range"):
        K.pick_rank(df, 3).collect()


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / "ch1").mkdir(parents=True)
    (tmp_path / "in" / "ch2").mkdir()
    (tmp_path / "in" / "ch1" / "review.json").write_text(json.dumps([{"type": "a", "severity": "low", "t": 61.2, "scene": 1, "detail": "x"}, {"detail": "no"}, {"type": "b", "severity": "high", "t": 5.0}]))
    (tmp_path / "in" / "ch2" / "review.json").write_text(json.dumps({"faults": [{"type": "c", "severity": "medium"}]}))
    faults = readers.read_faults(spark, f"{tmp_path}/in/*/review.json")
    counts = writers.write_report(faults, ["chapter_id"], f"{tmp_path}/out")
    assert {tuple(r) for r in counts.collect()} == {("ch1", 1, 0), ("ch2", 0, 1)}
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/text/chapter_id=ch1").collect()]
    assert lines == ["- [HIGH] 0:05 b: ", "- [LOW] 1:01 scene 1 a: x"]


def test_evidence_stream_replaces_chapters(spark, tmp_path):
    src, ledger = tmp_path / "faults", tmp_path / "ledger"
    src.mkdir()
    write = lambda name, rows: (src / name).write_text("\n".join(json.dumps({"chapter_id": c, "type": t}) for c, t in rows))
    read = lambda: {(str(r.chapter_id), r.type): r.n for r in spark.read.parquet(str(ledger)).collect()}
    write("1.json", [("x1", "a"), ("x1", "a"), ("x2", "b")])
    keep_evidence(spark, str(src), str(ledger), str(tmp_path / "cp")).awaitTermination()
    assert read() == {("x1", "a"): 2, ("x2", "b"): 1}
    write("2.json", [("x1", "c")])
    keep_evidence(spark, str(src), str(ledger), str(tmp_path / "cp")).awaitTermination()
    assert read() == {("x1", "c"): 1, ("x2", "b"): 1}


def test_verify_job_runs_whole(spark):
    rnd = random.Random(3)
    words = "Kara opens the heavy gate while storm winds howl above Mirel castle and guards sleep".split()
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    reads = [(1, p, f"p{p}", rnd.choice(["story", "story", "cover", "textonly"]), "ok", [("x", text(10))], "", "", text(4)) for p in range(15)]
    reads = spark.createDataFrame(reads, "g int, read_pos int, panel string, kind string, quality string, dialogue array<struct<speaker:string,text:string>>, narration_text string, sfx string, scene_beat string")
    scenes = spark.createDataFrame([(1, s, text(12) + ' She says: "guards sleep above castle".') for s in range(5)], "g int, scene int, narration string")
    slots = spark.createDataFrame([(1, p // 3, p % 3, f"p{p}") for p in range(15)], "g int, scene int, ord int, panel string")
    answers = spark.createDataFrame([(1, 0, 0, False)], "g int, scene int, ord int, relevant boolean")
    out = jobs.verify_scripts(scenes, slots, reads, answers, ["g"], strict=True)
    assert {r.scene for r in out["units"].collect()} == set(range(5))
    assert out["summary"].count() > 0


ORACLE_SAMPLE = ("majority_vote", "matched_vetoes", "tier1_gate", "relevance_join", "rank_windows", "interval_remap", "discover", "time_to_scene")


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in "customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.execute(oracles()[name])
    cols = [c[0] for c in want.description]
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_archived_proofs_stand_in_for_missing_frames(spark):
    faults = spark.createDataFrame(
        [("a", 1.0, "x"), ("a", 9.0, "y"), ("b", 1.0, "x"), ("b", 2.0, "y"), ("b", 3.0, None), ("b", None, "x"), ("c", 1.0, "x"), ("d", 1.0, "x")],
        "ch string, t double, frame_md5 string")
    frames = spark.createDataFrame([("a", 1.5, "x")], "ch string, t double, md5 string")
    rows = [("a", "9.000", "y", ["y"], 2.0), ("b", "1.000", "x", ["w", "x"], 2.0), ("b", "1.000", None, [], 2.0),
            ("b", "2.000", "z", ["y"], 2.0), ("c", "1.000", "x", ["x"], 2.5)]
    sidecar = spark.createDataFrame(rows, "ch string, t_key string, md5 string, window_md5s array<string>, window_s double")
    got = R.frame_proofs(faults, frames, sidecar, ["ch"], 2.0)
    assert got.columns == ["ch", "t", "frame_md5", "exempt", "origin"]
    assert {tuple(r) for r in got.collect()} == {
        ("a", 1.0, "x", True, "live"), ("a", 9.0, "y", False, "live"), ("b", 1.0, "x", True, "archived"), ("b", 2.0, "y", False, "archived"),
        ("b", 3.0, None, False, "none"), ("b", None, "x", False, "none"), ("c", 1.0, "x", False, "none"), ("d", 1.0, "x", False, "none")}
    again = R.hash_window_sidecar(
        faults.filter("ch = 'b'").withColumn("ord", F.monotonically_increasing_id()),
        spark.createDataFrame([("b", "1.000", "x")], "ch string, t_key string, md5 string"),
        spark.createDataFrame([("b", 2.5, "x")], "ch string, t double, md5 string"), ["ch"], 2.0)
    kept = R.frame_proofs(faults, frames, again, ["ch"], 2.0).filter("exempt").select("ch", "t", "origin").collect()
    assert {tuple(r) for r in kept} == {("a", 1.0, "live"), ("b", 1.0, "archived")}


def test_hits_of_one_time_open_a_stretch_together(spark):
    # (chapter, t, luma, event_id): blank is 250; the rest is empty. At 20 both types meet, in either order
    rows = [(1, 0.0, 250.0, 0), (1, 20.0, 250.0, 1), (1, 20.0, 100.0, 2), (1, 40.0, 100.0, 3), (1, 60.0, 250.0, 4),
            (2, 0.0, 250.0, 5), (2, 20.0, 100.0, 6), (2, 20.0, 250.0, 7), (2, 40.0, 250.0, 8),
            (3, 0.0, 250.0, 9), (3, 0.0, 250.0, 10), (3, 20.0, 250.0, 11)]
    samples = spark.createDataFrame([(g, t, luma, 0.01, n) for g, t, luma, n in rows], "g int, t double, luma double, frac double, event_id int")
    got = sorted((r.g, r.type[0], r.t, r.t_end) for r in R.fault_runs(samples, ["g"], 30.0, ["event_id"]).collect())
    assert got == [(1, "b", 0.0, 0.0), (1, "b", 20.0, 20.0), (1, "b", 60.0, 60.0), (1, "e", 20.0, 40.0),
                   (2, "b", 0.0, 0.0), (2, "b", 20.0, 40.0), (2, "e", 20.0, 20.0), (3, "b", 0.0, 20.0)]
    con = duckdb.connect()
    con.sql("CREATE TABLE s (g INT, t DOUBLE, luma DOUBLE, event_id INT)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?)", rows)
    con.sql("CREATE VIEW events AS SELECT g AS user_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(t * 1200 AS BIGINT)) AS ts, event_id, "
            "CASE WHEN luma > 200 THEN 'view' ELSE 'click' END AS event_type FROM s")
    # the SQL with its ties settled by event_id
    sql = oracles()["fault_runs"].replace("WINDOW w AS (PARTITION BY chapter_id ORDER BY t)", "WINDOW w AS (PARTITION BY chapter_id ORDER BY t, event_id)")
    assert sql != oracles()["fault_runs"]
    assert sorted((g, kind[0], t / 1200, end / 1200) for g, kind, t, end, _ in con.sql(sql).fetchall()) == got


def test_nearest_frame_of_equal_times_is_the_first(spark):
    frames = spark.createDataFrame([(1, 5.0, i) for i in (7, 3, 9, 4)] + [(1, 25.0, i) for i in (8, 2, 6)], "g int, t double, event_id int")
    times = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 15.0), (1, 20.0), (1, 30.0)], "g int, t double")
    got = {r.t: r.frame.event_id for r in L.nearest_frames(times, frames, ["g"], ["event_id"]).collect()}
    assert got == {0.0: 3, 5.0: 3, 15.0: 3, 20.0: 2, 30.0: 2}
