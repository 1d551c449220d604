"""Column expressions and small readers that no query calls by themselves."""

import json

from pyspark.sql import functions as F

from seqlens.functions import text as X
from seqlens.functions import values as V
from seqlens.operators.timeline import pace_of
from seqlens.sources import readers, writers


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_values(spark):
    box = lambda x, y, w, h: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((x, y, w, h), "xywh", strict=True)])
    got = _one(
        spark, iou=V.iou(box(0, 0, 4, 4), box(2, 0, 4, 4)), apart=V.iou(box(0, 0, 1, 1), box(5, 5, 1, 1)),
        dice=V.dice(F.lit(3), F.lit(4), F.lit(5)), none=V.dice(F.lit(0), F.lit(0), F.lit(0)), srt=V.srt_time(F.lit(3723.0045)),
        whole=V.chapter_number(F.lit(" 12.50")), text=V.chapter_number(F.lit("12-b")),
        form=F.array(*[V.format_label(F.lit(c)) for c in ("JP", "KR", "CN", "US")]))
    assert (round(got.iou, 6), got.apart, round(got.dice, 6), got.none) == (round(8 / 24, 6), 0.0, round(6 / 9, 6), 0.0)
    assert got.srt == "01:02:03,004" and (got.whole, got.text) == (12.5, None) and got.form == ["manga", "manhwa", "manhua", "US"]


def test_quotes_of_either_mark(spark):
    said = "He said 'don't you dare' and whispered \"run\". She shouted 'stop now\"."
    got = _one(spark, anchored=X.anchored_quotes(F.lit(said)), review=X.review_quotes(F.lit(said)))
    assert got.anchored == ["don't you dare"] and got.review == ["don't you dare", "run", "stop now"]


def test_pace(spark):
    cases = [("quiet", True, False, "quiet"), (None, True, True, "hype"), ("odd", None, True, "quiet"), (None, None, None, "normal")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, pace string, emphasis boolean, focus boolean, want string")
    assert df.filter(pace_of(F.col("pace"), F.col("emphasis"), F.col("focus")) != F.col("want")).count() == 0


def test_blocklists_and_documents(spark, tmp_path):
    spark.createDataFrame([("# note",), ("Some One — A Title",), ("",)], "value string").coalesce(1).write.text(f"{tmp_path}/b")
    assert [tuple(r) for r in readers.read_blocklist(spark, f"{tmp_path}/b").select("artist", "title").collect()] == [("some one", "a title")]
    sidecar = spark.createDataFrame(
        [("c", "1.000", "h1", ["h1", "h2"]), ("c", "2.000", None, [])], "c string, t_key string, md5 string, window_md5s array<string>")
    docs = writers.sidecar_document(sidecar, ["c"], 3.0)
    writers.write_documents(docs, ["c"], "document", f"{tmp_path}/d")
    got = json.loads(spark.read.text(f"{tmp_path}/d").first().value)
    assert got["frames"] == {"1.000": "h1"} and got["baseline_windows"] == {"1.000": ["h1", "h2"], "2.000": []} and got["hash_window_s"] == 3.0
