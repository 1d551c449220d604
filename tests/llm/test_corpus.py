"""Mixing, the archive and the whole pipeline."""

import hashlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqlens.llm import mixing, warc
from seqlens.llm.common import shared_folder


def plain_targets(sizes, weights, epochs=3):
    """Targets by plain redistribution. sizes, weights: lists by source."""
    total, capped = sum(sizes), set()
    while True:
        free = total - sum(epochs * sizes[i] for i in capped)
        open_ = sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i, w in enumerate(weights) if i not in capped and free * w / open_ > epochs * sizes[i]}
        if not over:
            return [epochs * s if i in capped else free * weights[i] / open_ for i, s in enumerate(sizes)]
        capped |= over


def test_mix_meets_targets(frame, odd):
    rng = np.random.default_rng(21)
    names = ["a", "b", "c", "é", None]
    rows = [(i, "w " * int(rng.integers(0, 30)), "en", names[min(4, int(rng.exponential(1.2)))]) for i in range(600)]
    got = mixing.mix_counts(odd(frame(rows))).collect()
    by = {n: [r for r, g in zip(sorted(rows), sorted(got), strict=True) if r[3] == n] for n in names}
    sizes = [sum(r[1].count("w") for r in by[n]) for n in names]
    want = dict(zip(names, plain_targets(sizes, [1, 2, 3, 1, 2]), strict=True))
    source = {r[0]: r[3] for r in rows}
    for n in names:
        mine = [g for g in got if source[g.doc_id] == n]
        assert all(g.target == pytest.approx(want[n]) and g.taken <= 3 * g.size for g in mine)
        assert abs(sum(g.taken for g in mine) - want[n]) <= 30
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(frame(rows, 7)).collect()))
    copies = {r.doc_id: r["n"] for r in mixing.mix_documents(odd(frame(rows))).groupBy("doc_id").agg(F.count("chunk").alias("n")).collect()}
    assert all(copies.get(g.doc_id, 0) * g.size == g.taken for g in got)


def test_mix_of_odd_rows(frame, odd, odd_rows):
    got = mixing.mix_counts(odd(frame(odd_rows))).collect()
    assert len(got) == len(odd_rows) and all(0 <= g.taken <= 3 * g.size for g in got)
    assert mixing.mix_documents(odd(frame(odd_rows))).columns == odd(frame(odd_rows)).columns
    empty = frame([(1, None, "en", "a"), (2, "", "en", None)])
    assert [g.taken for g in mixing.mix_counts(empty).collect()] == [0, 0]
    assert mixing.mix_counts(frame([])).count() == 0 and mixing.mix_documents(frame([])).count() == 0


def test_mix_with_null_and_repeated_ids(frame, odd):
    rng = np.random.default_rng(22)
    text = lambda: " ".join(f"w{rng.integers(0, 999)}" for _ in range(int(rng.integers(1, 20))))
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text(), "en", "abc"[i % 7 % 3]) for i in range(900)]
    rows += [(5, "one two three four", "en", "a")] * 400
    words = lambda t: len(t.split())
    sizes = [sum(words(r[1]) for r in rows if r[3] == n) for n in "abc"]
    want = dict(zip(sizes, plain_targets(sizes, [1, 2, 3]), strict=True))
    got = mixing.mix_counts(odd(frame(rows))).collect()
    assert len(got) == len(rows) and len(want) == 3
    for size, target in want.items():
        assert abs(sum(g.taken for g in got if g.source_size == size) - target) <= 20
    mixed = mixing.mix_documents(odd(frame(rows))).collect()
    assert sum(words(r.text) for r in mixed) == sum(g.taken for g in got)
    for n, size in zip("abc", sizes, strict=True):
        assert sum(words(r.text) for r in mixed if r.source == n) == sum(g.taken for g in got if g.source_size == size)
    # copies of one text, and nothing else, around the edge
    same = frame([(1, "a b", "en", "x")] * 50 + [(2, "c", "en", "y")] * 200)
    taken = mixing.mix_counts(same).collect()
    for n, target in zip((100, 200), plain_targets([100, 200], [1, 2]), strict=True):
        assert abs(sum(g.taken for g in taken if g.source_size == n) - target) <= 2


def test_archive_round_trip(spark, odd):
    big, odd_text = "x" * 1200, "é\r\n\r\n" * 300
    rows = [(1, "u1", big), (5, "u5", big), (3, None, big), (2, "u\r\n2", "small"), (4, "u4", "small"), (6, "u6", None), (7, "u7", ""),
            (None, "u0", odd_text), (8, "u8", odd_text), (9, "u9", "y" * 2000), (9, "u9", "y" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(warc.page_records(pages.withColumn("digest", F.lit("x"))), folder)
    got = warc.read_archive(spark, folder)
    texts = {(r.record_key, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in got.collect()}
    assert got.count() == len(rows) and spark.read.parquet(f"{folder}/payloads").count() == 5
    assert texts == {
        (1, "revisit", 5, big), (5, "response", None, big), (3, "revisit", 5, big), (2, "response", None, "small"), (4, "response", None, "small"),
        (6, "response", None, ""), (7, "response", None, ""), (None, "revisit", 8, odd_text), (8, "response", None, odd_text), (9, "response", None, "y" * 2000)}
    for r in warc.record_bytes(got).collect():
        head, http, body = bytes(r.record).split(b"\r\n\r\n", 2)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(http) + 4 + len(body) - 4
        assert datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ")
        assert (fields.get("WARC-Profile") == warc.SAME_PAYLOAD) == (r.record_type == "revisit")
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest()
        assert body == (b"" if r.record_type == "revisit" else bytes(r.payload)) + b"\r\n\r\n"


def test_hot_payloads_and_damage(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES_PER_SALT", 3)
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("z" * 1500).alias("html"))
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(warc.page_records(pages), folder)
    assert warc.read_archive(spark, folder).groupBy("record_type").count().sort("record_type").collect() == [("response", 1), ("revisit", 39)]
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"other"))
    bad.write.parquet(f"{folder}-2/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-2/headers")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"{folder}-2").collect()
    # a damaged header is noticed as well
    spark.read.parquet(f"{folder}/payloads").write.parquet(f"{folder}-3/payloads")
    other = F.encode(F.regexp_replace(F.decode("header", "UTF-8"), "Length: 1500", "Length: 1501"), "UTF-8")
    spark.read.parquet(f"{folder}/headers").withColumn("header", other).write.parquet(f"{folder}-3/headers")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"{folder}-3").collect()


def test_fields_come_from_the_header_alone(spark):
    odd_uri = "http://x/\u2028WARC-Refers-To: <urn:page:77>"
    rows = [("a>b c", odd_uri, "p" * 1000), ("é", odd_uri, "p" * 1000), ("", "u", "q"), (None, "u", "q")]
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(warc.page_records(spark.createDataFrame(rows, "page_id string, url string, html string")), folder, "2020-01-02T03:04:05Z")
    got = {(r.record_key, r.record_type, r.refers_to, bytes(r.header).count(b"WARC-Date: 2020-01-02T03:04:05Z\r\n"))
           for r in warc.read_archive(spark, folder).collect()}
    assert got == {("a>b c", "revisit", "é", 1), ("é", "response", None, 1), ("", "response", None, 1), (None, "response", None, 1)}


def test_empty_archive(spark):
    folder = shared_folder(spark, "warc-test")
    warc.write_archive(warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")), folder)
    assert warc.read_archive(spark, folder).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, frame, odd_rows, tmp_path_factory):
    """A folder with documents and labels: prose, toxic texts, copies, near copies and a shared passage."""
    rng = np.random.default_rng(31)
    some = lambda n: " ".join(f"w{rng.integers(0, 5000)}" for _ in range(n))
    passage = some(60)
    rows, labels = [*odd_rows], []
    for i in range(300):
        bad, text = i % 6 == 0, some(120)
        rows.append((1000 + i, text + (" you stupid idiot vermin " if bad else " "), "en", f"s{i % 3}"))
        labels.append((1000 + i, int(bad)))
    clean = rows[len(odd_rows) + 1][1]
    rows += [(2000, clean, "en", "s1"), (2001, clean.replace(" ", " new ", 1), "en", "s1"),
             (2002, f"{some(50)} {passage} {some(50)}", "en", "s2"), (2003, f"{some(70)} {passage}", "en", "s0")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, passage


def test_every_stage_of_the_pipeline(spark, corpus, tmp_path):
    import base64

    import public_tokenizers as P
    import tiktoken

    folder, rows, passage = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        kept.append(docs.collect())
        assert at == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    calm, single, cut, mixed, coded = kept
    toxic = {1000 + i for i in range(0, 300, 6)}
    ids = [{r.doc_id for r in k} for k in kept]
    assert len(ids[0] & toxic) <= 2 and ids[0] >= {1000 + i for i in range(300) if i % 6} | {2000, 2001, 2002, 2003}
    assert ids[0] - ids[1] <= {2000, 2001, 3, 2, 5, 7, 8, None} | toxic and not ids[1] & {2000, 2001} and 1001 in ids[1]
    assert len(cut) == len(single)
    left = {r.doc_id: r.text for r in cut}
    assert passage not in left[2002] and passage not in left[2003] and len(left[2002].split()) == 100
    assert all(left[r.doc_id] == r.text for r in single if r.doc_id in range(1000, 1300))
    sizes, words = {}, lambda r: len((r.text or "").encode().split())
    for r in cut:
        sizes[r.source] = sizes.get(r.source, 0) + words(r)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, plain_targets([sizes[n] for n in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    for n in names:
        assert abs(sum(words(r) for r in mixed if r.source == n) - want[n]) <= max(map(words, cut))
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
            base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    again = [
        (r.doc_id, len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in mixed for t in [library.encode_ordinary(r.text or "")]]
    assert sorted(map(str, again)) == sorted(str(tuple(r)[:4]) for r in coded)
    assert len(coded) == len(mixed) and all(len(r.ids_le) == 4 * r.n_tokens for r in coded)


def test_pipeline_of_nothing(spark, frame, tmp_path):
    frame([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
