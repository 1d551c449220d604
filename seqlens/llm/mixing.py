"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Sizes and hashes are narrow columns, cut once. The water level is found by rounds
of one fixed-size aggregate over the table of sources. A source's fractional
repetition goes to the documents that come first by a seeded hash of id and text: sums
over the hash's leading digits find the boundary bucket, and only that bucket is ordered.
The decision for a document is then a comparison with its source's row, so the
texts are not shuffled, but for the one text of each source on which the boundary
falls: its copies fold to one row, and as many of them as fit are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage, n_words, small, text_of
from seqlens.plans.scan import ranked_positions

#: Sources whose rows are broadcast to the documents at most; each row is under 200 bytes.
MOST_BROADCAST = 10_000


@dataclass(frozen=True)
class Mix:
    """weights: cycled over the sources in code point order, null last. epochs: most repetitions. seed: of the order."""

    weights: tuple[int, ...] = (1, 2, 3)
    epochs: int = 3
    seed: int = 42
    digits: int = 3


def order_key(mix: Mix) -> Column:
    """32 hex digits; rows with equal ids and texts share a key."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of()), F.lit(str(mix.seed))))


def water_fill(sources: DataFrame, mix: Mix) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: the total shared by weight, at most ``epochs`` times each size.

    A source is clamped once its share passes its cap; the level only rises when the
    rest is shared again, so a clamped source stays clamped and the last level tells all.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cap = exact("source_size") * mix.epochs
    total, weights = sources.agg(F.sum(exact("source_size")), F.sum(exact("weight"))).first()
    free, open_weight = total or 0, weights or 0
    while open_weight:
        clamped = cap * F.lit(open_weight).cast("decimal(38,0)") < F.lit(free).cast("decimal(38,0)") * exact("weight")
        kept, left = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0).cast("decimal(38,0)")),
            F.coalesce(F.sum(F.when(~clamped, exact("weight"))), F.lit(0).cast("decimal(38,0)")),
        ).first()
        if (total - kept, left) == (free, open_weight):
            break
        free, open_weight = total - kept, left
    level = F.lit(float(free)) * F.col("weight").cast("double") / F.lit(float(open_weight or 1))
    most = (F.col("source_size") * mix.epochs).cast("double")
    return sources.withColumn("target", F.least(most, level) if open_weight else most)


def plan_mix(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame, int]:
    """(documents, sources, number of sources).

    documents: doc_id, size, key and the null-safe source columns, cut. sources: per
    source ``source_size``, ``target``, ``whole`` repetitions and ``edge``: documents
    whose key is below ``edge``, and ``extra`` of those whose key equals it, get one repetition more.
    """
    sized = cut_lineage(docs.select(
        "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_name"),
        n_words(text_of()).alias("size"), order_key(mix).alias("key"),
    ))
    by = ["no_source", "source_name"]
    totals = ranked_positions(sized.groupBy(*by).agg(F.sum("size").alias("source_size")), [], by, "place")
    cycle = F.array(*[F.lit(w) for w in mix.weights])
    weighted = cut_lineage(totals.select(
        *by, "source_size", F.get(cycle, (F.col("place") % len(mix.weights)).cast("int")).alias("weight")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = cut_lineage(
        water_fill(weighted, mix).withColumn("whole", F.floor(ratio).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    n = filled.count()

    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        sized.groupBy(*by, F.substring("key", 1, mix.digits).alias("bucket")).agg(F.sum("size").alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    )
    open_bucket = (
        buckets.join(small(filled, n, MOST_BROADCAST), by)
        .filter((F.col("rest") > 0) & (F.col("start") + F.col("words") > F.col("rest")))
        .groupBy(*by).agg(F.min_by(F.struct("bucket", "start", "rest"), "bucket").alias("b"))
        .select(*by, "b.bucket", "b.start", "b.rest")
    )
    inside = Window.partitionBy(*by).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        sized.withColumn("bucket", F.substring("key", 1, mix.digits))
        .join(small(open_bucket, n, MOST_BROADCAST), [*by, "bucket"])
        .groupBy(*by, "start", "rest", "key").agg(F.sum("size").alias("words"), F.max("size").alias("one"))
        .withColumn("from", F.col("start") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .filter(F.col("from") + F.col("words") > F.col("rest"))
        .groupBy(*by).agg(F.min_by(F.struct("key", "from", "rest", "one"), "key").alias("e"))
        .select(*by, F.col("e.key").alias("edge"),
                F.floor((F.col("e.rest") - F.col("e.from")) / F.col("e.one") + 0.5).cast("bigint").alias("extra"))
    )
    edges = F.when(F.col("rest") > 0, F.coalesce("edge", F.lit("g"))).otherwise("")
    return sized, filled.join(taken, by, "left").withColumns(
        {"edge": edges, "extra": F.coalesce("extra", F.lit(0).cast("bigint"))}), n


def mix_counts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken: words the mix takes of each document, repeats counted.

    Null texts have size 0; null sources form the last source; null ids are ids like any
    other; rows with equal ids, texts and sources differ by one repetition at most; an empty
    table gives no rows. Other columns are ignored. A document takes 0 to ``epochs``
    repetitions, and a source's sum is within half a document of its target.
    """
    sized, sources, n = plan_mix(docs, mix)
    joined = sized.join(small(sources, n, MOST_BROADCAST), ["no_source", "source_name"])
    kept = ["doc_id", "size", "source_size", "target"]
    apart = joined.filter("key != edge").select(
        *kept, (F.col("size") * (F.col("whole") + (F.col("key") < F.col("edge")).cast("bigint"))).alias("taken"))
    ties = joined.filter("key = edge").groupBy("no_source", "source_name", *kept, "whole", "extra").agg(F.count(F.lit(1)).alias("copies"))
    return apart.unionByName(
        ties.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .select(*kept, (F.col("size") * (F.col("whole") + (F.col("copy") <= F.col("extra")).cast("bigint"))).alias("taken")))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is repeated.

    Nulls, equal rows and empty tables as in :func:`mix_counts`; of rows that agree in id,
    text and source but not elsewhere, those that get one repetition more are told by a
    hash of all columns. Columns of any name go through.
    """
    _, sources, n = plan_mix(docs, mix)
    plan = small(cut_lineage(sources.select(
        F.col("no_source").alias("__no"), F.col("source_name").alias("__name"), "whole", "edge", "extra")), n, MOST_BROADCAST)
    plan = plan.select("__no", "__name", F.struct("whole", "edge", "extra").alias("__plan"))
    joined = docs.join(
        plan, (F.col("source").isNull() == F.col("__no")) & (F.coalesce("source", F.lit("")) == F.col("__name")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = joined.withColumn("__key", order_key(mix))
    whole, edge = F.col("__plan.whole"), F.col("__plan.edge")
    apart = keyed.filter(F.col("__key") != edge).withColumn("__times", whole + (F.col("__key") < edge).cast("bigint"))
    before = Window.partitionBy("__no", "__name").orderBy("__hash").rowsBetween(Window.unboundedPreceding, -1)
    ties = (
        keyed.filter(F.col("__key") == edge).groupBy(*own, "__no", "__name", "__plan").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__hash", F.xxhash64(*own))
        .withColumn("__left", F.col("__plan.extra") - F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("__times", whole * F.col("__n") + F.greatest(F.lit(0), F.least("__n", "__left")))
    )
    repeat = lambda df: df.filter("__times > 0").withColumn(
        "__copy", F.explode(F.expr("sequence(1L, __times)"))).select(*own)
    return repeat(apart).unionByName(repeat(ties))


#: DuckDB SQL for the repetitions of each document of table {docs}; {columns} go through.
PLAN_SQL = r"""
    m_sized AS (
        SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':42') AS key FROM {docs}),
    m_sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM m_sized GROUP BY source),
    m_ratio AS (
        SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
               coalesce(sum(3 * source_size) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS gone
        FROM m_sources
        WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    m_level AS (
        SELECT (total - caps)::DOUBLE AS free, (weights - gone)::DOUBLE AS open FROM m_ratio
        WHERE 3 * source_size::DOUBLE / weight >= (total - caps) / (weights - gone)
        ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
    m_filled AS (
        SELECT source, source_size, least((3 * source_size)::DOUBLE, free * weight::DOUBLE / open) AS target
        FROM m_sources, m_level),
    m_whole AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM m_filled),
    m_keys AS (SELECT source, key, sum(size) AS words, max(size) AS one, count(*) AS copies FROM m_sized GROUP BY ALL),
    m_from AS (
        SELECT k.*, whole, target - whole * source_size AS rest,
               coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY key
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM m_keys k JOIN m_whole s ON k.source IS NOT DISTINCT FROM s.source),
    m_times AS (
        SELECT source, key, whole, CASE WHEN rest <= 0 OR start >= rest THEN 0 WHEN start + words <= rest THEN copies
                                        ELSE floor((rest - start) / one + 0.5)::BIGINT END AS extra FROM m_from),
    m_rows AS (SELECT *, row_number() OVER (PARTITION BY source, key) AS copy FROM m_sized)
"""

MIX_SQL = "WITH" + PLAN_SQL.replace("{docs}", "documents") + """
SELECT doc_id, size, source_size, target, (size * (t.whole + (copy <= extra)::BIGINT))::BIGINT AS taken
FROM m_rows d JOIN m_whole s ON d.source IS NOT DISTINCT FROM s.source
JOIN m_times t ON d.source IS NOT DISTINCT FROM t.source AND d.key = t.key"""
