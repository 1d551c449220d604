"""Hard-negative mining with summaries of vector segments.

Rows are packed into chunks of a bounded size. A chunk keeps, for several cuts of its vectors into
equal segments, each segment's mean and deviation. For two segments of n components the inner
product is n * (mean * mean + covariance), and the covariance is at most the product of the deviations; so the sums of n * mean * mean
plus and minus n * deviation * deviation bound a score. Anchors come in blocks of a bounded size, and every
block meets every chunk. There, pairs whose bounds on the coarsest cut cannot matter are left out, the others are
bounded again on the next finer cut, and what is left is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage

#: Rows of a chunk and anchors of a block.
CHUNK, BLOCK = 8192, 512
#: Numbers of segments of the cuts, coarse to fine; a vector of fewer components is cut into single ones.
CUTS = (1, 4, 16)
_PACKED = "chunk long, n int, dims int, ids binary, labels binary, vectors binary"
#: Largest integers whose sums single and double precision hold exactly.
_SINGLE, _DOUBLE = 1 << 24, 1 << 53


def packed(rows: DataFrame, scale: int, relabel_every: int, classes: int) -> DataFrame:
    """Chunks of rows (vec_id, label, embedding) that take part, with integer vectors; a row is known by its chunk plus its place.

    A row without a label, a vector or one of its components, or with a component that is not finite, takes no part.
    Vectors of different lengths lie in different chunks.
    """

    def chunk(task: int, seq: int, held: list) -> pa.RecordBatch:
        ids, labels, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([(task << 40) + seq * 2 * CHUNK], pa.int64()), "n": pa.array([len(ids)], pa.int32()),
            "dims": pa.array([vectors.shape[1]], pa.int32()), "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vectors": [vectors.tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, sizes = TaskContext.get().partitionId(), 0, {}, {}
        for batch in batches:
            column = batch.column(2)
            flat = column.flatten()
            length = np.diff(column.offsets.to_numpy())
            here = np.asarray(column.is_valid()) & np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(1).is_valid())
            length = np.where(np.asarray(column.is_valid()), length, 0)
            value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            starts = np.cumsum(length) - length
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
            good = here & (bad[starts + length] == bad[starts])
            all_ids, all_labels = (batch.column(i).fill_null(0).to_numpy().astype(np.int64) for i in (0, 1))
            for dims in np.unique(length[good]).tolist():
                at = np.flatnonzero(good & (length == dims))
                vectors = np.floor(scale * value[starts[at][:, None] + np.arange(dims)]).astype(np.int64)
                ids, labels = all_ids[at], all_labels[at]
                labels = np.where(ids % relabel_every == 0, (labels + 1) % classes, labels)
                for a in range(0, len(at), CHUNK):
                    held.setdefault(dims, []).append((ids[a:a + CHUNK], labels[a:a + CHUNK], vectors[a:a + CHUNK]))
                    sizes[dims] = sizes.get(dims, 0) + len(ids[a:a + CHUNK])
                    if sizes[dims] >= CHUNK:
                        yield chunk(task, seq, held.pop(dims))
                        sizes[dims], seq = 0, seq + 1
        for rest in held.values():
            yield chunk(task, seq, rest)
            seq += 1

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, _PACKED)


def unpacked(ids, labels, vectors, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(labels.as_buffer(), np.int64),
            np.frombuffer(vectors.as_buffer(), np.int64).reshape(-1, dims) if dims else np.zeros((len(ids.as_buffer()) // 8, 0), np.int64))


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per cut the means and deviations of the segments, times the root of their size, rows by segments."""
    dims, out = vectors.shape[1], []
    for cut in sorted({min(c, dims) for c in CUTS} - {0}):
        edges = np.arange(cut) * dims // cut
        n = np.diff(np.append(edges, dims))
        values = vectors.astype(np.float64)
        mean = np.add.reduceat(values, edges, axis=1) / n
        off = values - np.repeat(mean, n, axis=1)
        spread = np.sqrt(np.add.reduceat(off * off, edges, axis=1) / n)
        out.append((mean * np.sqrt(n), spread * np.sqrt(n)))
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    for kind, limit in ((np.float32, _SINGLE), (np.float64, _DOUBLE)):
        if most < limit:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a @ b.T


def matched(anchors: np.ndarray, rows: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(indices of anchors, of rows, scores) of the ``wanted`` pairs, left out only where the score is surely outside of low to high of the anchor."""
    at_a, at_r = np.arange(len(anchors)), np.arange(len(rows))
    for (mean_a, spread_a), (mean_r, spread_r) in zip(summaries(anchors), summaries(rows), strict=True):
        if not wanted.any():
            break
        middle, slack = mean_a[at_a] @ mean_r[at_r].T, spread_a[at_a] @ spread_r[at_r].T
        slack += 1e-9 * (1 + np.abs(middle) + slack)  # rounding
        wanted &= (middle + slack >= low[at_a, None]) & (middle - slack <= high[at_a, None])
        keep_a, keep_r = wanted.any(axis=1), wanted.any(axis=0)
        at_a, at_r, wanted = at_a[keep_a], at_r[keep_r], wanted[np.ix_(keep_a, keep_r)]
    return at_a, at_r, np.where(wanted, exact(anchors[at_a], rows[at_r]), np.iinfo(np.int64).min)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by the smaller id; the least integer is none."""
    none = np.iinfo(np.int64).min
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= kth) & (scores > none))
    else:
        at = np.flatnonzero(scores > none)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def blocks_of(anchors: DataFrame, key: str) -> DataFrame:
    """Anchors (any columns) with ``block``, dealt by ``key`` into blocks of about ``BLOCK``."""
    n = max(1, -(-anchors.count() // BLOCK))
    return anchors.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def met(chunks: DataFrame, anchors: DataFrame, fields: list[str]) -> DataFrame:
    """Every block of anchors (block, dims, fields) next to every chunk of vectors of the same length."""
    whole = anchors.groupBy("dims", "block").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("anchors"))
    whole = cut_lineage(whole)
    pairs = chunks.select("chunk", "dims").join(whole.select("dims", "block"), "dims")
    return chunks.drop("dims").join(pairs.join(whole, ["dims", "block"]), "chunk")


def top(found: DataFrame, keys: list[str], id_column: str, k: int) -> DataFrame:
    """``rank`` from 1 within keys, by score and smaller id; at most k rows."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), id_column, "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor_every: int = 100, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90,
    scale: int = 256, relabel_every: int = 7, classes: int = 10,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    rows: (vec_id, label, embedding). Components become floor(scale * x), labels of ids divisible by ``relabel_every``
    (label + 1) modulo ``classes``. Anchors are rows whose id is divisible by ``anchor_every``, their
    positives the first ``n_positives`` other rows of the label. Negatives of a positive are the first ``n_negatives`` rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score. Higher inner products come first, then smaller ids.

    Rows without a label, a vector or an id, or with a component that is null or not finite, take no part. Rows with equal ids are
    rows of their own, as anchors too. Vectors of other lengths do not meet. Empty vectors score 0. Other columns are
    ignored; an empty table gives no rows.
    """
    chunks = cut_lineage(packed(rows, scale, relabel_every, classes))

    def own_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, dims = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                ids, labels, vectors = unpacked(batch.column(2)[r], batch.column(3)[r], batch.column(4)[r], dims)
                at = np.flatnonzero(ids % anchor_every == 0)
                yield pa.RecordBatch.from_pydict({
                    "own": pa.array(chunk + at, pa.int64()), "dims": pa.array(np.full(len(at), dims, np.int32)), "anchor_id": pa.array(ids[at]),
                    "label": pa.array(labels[at]), "vector": pa.array([v.tobytes() for v in vectors[at]], pa.binary())})

    anchors = cut_lineage(blocks_of(chunks.select("chunk", "dims", "ids", "labels", "vectors").mapInArrow(
        own_anchors, "own long, dims int, anchor_id long, label long, vector binary"), "own"))

    def read(batch: pa.RecordBatch, r: int):
        dims = batch.column("dims")[r].as_py()
        ids, labels, vectors = unpacked(*(batch.column(c)[r] for c in ("ids", "labels", "vectors")), dims)
        block = batch.column("anchors")[r].values
        mine = np.array([np.frombuffer(v.as_buffer(), np.int64) for v in block.field("vector")], np.int64).reshape(len(block), dims)
        return batch.column("chunk")[r].as_py(), ids, labels, vectors, block, mine

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                base, ids, labels, vectors, block, mine = read(batch, r)
                own, label = block.field("own").to_numpy(), block.field("label").to_numpy()
                found = []
                for name in np.intersect1d(label, labels):
                    a, b = np.flatnonzero(label == name), np.flatnonzero(labels == name)
                    wanted = own[a][:, None] != base + b
                    # the first rows tell what is too low for the others
                    head = np.where(wanted[:, :16 * n_positives], exact(mine[a], vectors[b[:16 * n_positives]]), np.iinfo(np.int64).min)
                    low = np.sort(head, axis=1)[:, -n_positives] if head.shape[1] >= n_positives else np.full(len(a), np.iinfo(np.int64).min)
                    at_a, at_r, scores = matched(mine[a], vectors[b], wanted, low.astype(np.float64), np.full(len(a), np.inf))
                    for i, mark in enumerate(at_a):
                        near = best(scores[i], ids[b[at_r]], n_positives)
                        found.append((np.full(len(near), own[a[mark]]), ids[b[at_r[near]]], base + b[at_r[near]], scores[i][near]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["own", "positive_id", "row", "score"])

    first = met(chunks, anchors, ["own", "label", "vector"]).select("chunk", "dims", "ids", "labels", "vectors", "anchors").mapInArrow(
        positives, "own long, positive_id long, row long, score long")
    # copies of a row are positives of their own, told apart by ``row``
    chosen = cut_lineage(top(first, ["own"], "positive_id", n_positives).select(
        "own", F.col("rank").alias("at"), "positive_id", F.col("score").alias("positive_score")))
    asked = chosen.groupBy("own").agg(F.collect_list(F.struct("at", "positive_score")).alias("asked"))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                base, ids, labels, vectors, block, mine = read(batch, r)
                own, label = block.field("own").to_numpy(), block.field("label").to_numpy()
                lists = [[(x["at"], x["positive_score"]) for x in one.as_py()] for one in block.field("asked")]
                low = np.array([min(least * s for _, s in one) for one in lists]) / 100
                high = np.array([max(most * s for _, s in one) for one in lists]) / 100
                at_a, at_r, scores = matched(mine, vectors, label[:, None] != labels, low - 1, high + 1)
                found = []
                for i, a in enumerate(at_a):
                    for at, score in lists[a]:
                        fits = (least * score <= 100 * scores[i]) & (100 * scores[i] <= most * score) & (scores[i] > np.iinfo(np.int64).min // 200)
                        j = np.flatnonzero(fits)
                        j = j[best(scores[i][j], ids[at_r[j]], n_negatives)]
                        found.append((np.full(len(j), own[a]), np.full(len(j), at), ids[at_r[j]], base + at_r[j], scores[i][j]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)],
                                                     ["own", "at", "negative_id", "row", "score"])

    second = met(chunks, anchors.join(asked, "own"), ["own", "label", "vector", "asked"]).select(
        "chunk", "dims", "ids", "labels", "vectors", "anchors").mapInArrow(negatives, "own long, at long, negative_id long, row long, score long")
    ranked = top(second, ["own", "at"], "negative_id", n_negatives)
    named = chosen.join(anchors.select("own", "anchor_id"), "own").withColumn("at", F.col("at").cast("bigint"))
    return ranked.join(named, ["own", "at"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


NEGATIVES_SQL = """
WITH rows AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, o) AS nth FROM scored WHERE same) WHERE nth <= 5),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.r, p.nth ORDER BY n.score DESC, n.vec_id, n.o) AS INTEGER) AS rank
    FROM positives p JOIN scored n ON n.r = p.r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
