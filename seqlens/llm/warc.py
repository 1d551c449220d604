"""Content-addressed WARC archive.

Payload bytes are stored once per strong digest; the exact header block of every
record is stored apart and names its payload by that digest. Reading joins the two and
gives the original records. All of it is Spark tables in the shared folder.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage, text_of

#: Payloads shorter than this are stored by every record as a response.
LEAST_REVISIT = 1000
#: Copies of a payload that one task puts together; more are dealt over more copies of the stored payload.
COPIES_PER_SALT = 500
#: Fixed value of the format: a revisit whose payload has the digest of the record it refers to.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def page_records(pages: DataFrame) -> DataFrame:
    """record_key, uri, payload of a page table; a null html is an empty payload."""
    return pages.select(
        F.col("page_id").alias("record_key"), F.col("url").alias("uri"), F.encode(text_of("html"), "UTF-8").alias("payload"))


def record_id(key: Column) -> Column:
    """``<urn:page:key>`` with the key URL-encoded, ``<urn:none>`` for a null key."""
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(key.cast("string")), F.lit(">")), F.lit("<urn:none>"))


def header_block(record_type: Column, refers_to: Column, date: str) -> Column:
    """The bytes before a record's payload: WARC fields, then an HTTP status block for the page."""
    crlf = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(crlf + crlf))
    block = F.octet_length(http) + F.when(record_type == "revisit", 0).otherwise(F.col("payload_bytes"))
    return F.encode(F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), record_type,
        F.lit(f"{crlf}WARC-Record-ID: "), record_id(F.col("record_key")),
        F.lit(f"{crlf}WARC-Date: {date}{crlf}WARC-Target-URI: "), F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]+", " "),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(record_type == "revisit", F.concat(
            F.lit(f"{crlf}WARC-Profile: {SAME_PAYLOAD}{crlf}WARC-Refers-To: "), record_id(refers_to),
        )).otherwise(""),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "), block.cast("string"),
        F.lit(crlf + crlf), http,
    ), "UTF-8")


def field(name: str, pattern: str) -> Column:
    """What ``pattern``'s group finds in the header field ``name``; null if the field is missing or other."""
    found = F.regexp_extract_all(F.decode("header", "UTF-8"), F.lit(rf"\r\n{name}: {pattern}\r\n"), F.lit(1))
    return F.get(found, F.lit(0))


def write_archive(records: DataFrame, folder: str, date: str | None = None) -> None:
    """Write ``headers`` and ``payloads`` under ``folder``. date: WARC-Date of the records, the time of the call if not given.

    records: record_key, uri, payload (bytes). Of equal payloads of LEAST_REVISIT bytes or
    more the record with the largest key is the response and the others are revisits
    that refer to it. A null payload counts as empty; a null key sorts first; records with
    equal keys and payloads are all responses if their key is the largest.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    stored = records.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumn("digest", F.sha2("payload", 256))
    # fixed-width sums only: hot payloads combine before the shuffle, and no payload is shuffled
    facts = stored.groupBy("digest").agg(
        F.max("record_key").alias("first_key"), F.count(F.lit(1)).alias("copies"))
    facts = cut_lineage(facts)
    described = stored.select(
        "record_key", "uri", "digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    revisit = (F.col("payload_bytes") >= LEAST_REVISIT) & ~F.col("record_key").eqNullSafe(F.col("first_key"))
    kind = F.when(revisit, "revisit").otherwise("response")
    refers = F.when(revisit, F.col("first_key"))
    (
        described.join(facts, "digest").select(
            "record_key", "digest", "copies", header_block(kind, refers, date).alias("header"))
        .write.mode("overwrite").parquet(f"{folder}/headers")
    )
    # one record per digest brings its bytes: the one with the largest key; equal keys fold by digest
    carriers = facts.select(F.col("first_key").alias("record_key"), "digest", "copies")
    carried = (
        stored.select("record_key", "digest", "payload")
        .join(carriers, (stored.record_key.eqNullSafe(carriers.record_key)) & (stored.digest == carriers.digest))
        .select(stored.digest, "copies", "payload")
    )
    headers = stored.sparkSession.read.parquet(f"{folder}/headers")
    # only rows with equal keys and payloads can bring the same bytes twice; payloads are not shuffled again without them
    if not headers.groupBy("digest", "record_key").count().filter("count > 1").isEmpty():
        carried = carried.dropDuplicates(["digest"])
    carried.write.mode("overwrite").parquet(f"{folder}/payloads")


def read_archive(spark, folder: str) -> DataFrame:
    """record_key, record_type, refers_to, sha1, header, payload of every record.

    All but the payload is parsed from the header's bytes. A payload is checked against the
    strong digest it is stored under and against the digest and the length in the record's header; what
    does not match stops the read. A payload with more than COPIES_PER_SALT records is dealt
    out in as many copies as its records need, so a payload shared by a third of all records is put
    together by many tasks.
    """
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    key_type = headers.schema["record_key"].dataType
    salts = F.ceil(F.col("copies") / COPIES_PER_SALT).cast("bigint")
    key = lambda name: F.url_decode(field(name, "<urn:page:([^>]*)>")).cast(key_type)
    parsed = headers.select(
        "digest", "header", F.pmod(F.xxhash64("header"), salts).alias("salt"),
        key("WARC-Record-ID").alias("record_key"), key("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(F.decode("header", "UTF-8"), r"^WARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})").alias("sha1"),
        F.regexp_extract(F.decode("header", "UTF-8"), r"\r\nContent-Length: (\d+)\r\n\r\n$", 1).cast("bigint").alias("length"))
    stop = lambda text: F.raise_error(F.lit(text)).cast("binary")
    checked = payloads.withColumn("payload", F.when(
        F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(stop("a stored payload does not match its digest")))
    dealt = checked.select(
        "digest", "payload", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    agrees = (F.sha1("payload") == F.col("sha1")) & (F.octet_length("payload") == F.col("length"))
    return parsed.join(dealt, ["digest", "salt"]).select(
        "record_key", "record_type", "refers_to", "sha1", "header",
        F.when(agrees, F.col("payload")).otherwise(stop("a payload does not match its record's header")).alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """``record``: the exact WARC record, header block, payload unless it is a revisit, and the closing blank lines."""
    return records.withColumn("record", F.concat(
        F.col("header"), F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")))


PAGES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""
