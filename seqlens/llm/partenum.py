"""N-gram Jaccard join by partitioned signatures.

Documents are sets of word shingles. Sizes are cut into bands so that sets of a similarity
of ``percent`` or more lie in the same band or in neighbouring ones. The hashes' domain is cut into
as many partitions as a band asks for; a set's signature in a partition is a hash of its elements
there. Two sets of sizes x and y at the similarity differ in d = (x + y) * (100 - percent) / (100 + percent)
elements at most, and each spoils one partition. So a set with more than d partitions that are not empty shares
one of these signatures, whole, with every such partner: signatures of empty partitions are never needed. A set with
fewer is signed once more over finer partitions, at last over single elements, where it always has
more than d; a pair meets on the first of these levels where one of both has enough.

A signature that more than ``MOST`` sets have is common. Pairs are made only under the others, at most ``MOST`` times
as many as signatures, and only those with as many signatures in common as they need are compared. A set
that needs common signatures, because too few of its own are rare, meets the others of this kind
that hang together with it by common signatures in blocks of a bounded size. Either way sets are compared themselves.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage, small
from seqlens.llm.shingles import mixed, shingle_sets
from seqlens.llm.simhash import linked_sets
from seqlens.plans.rounds import connected_components

#: Sets with a signature beyond which it is common.
MOST = 16
#: Elements of the largest set of a band's upper neighbour per partition, about. Over 4.4 few sets would have enough partitions.
ELEMENTS = 4.2
#: Levels of partitions: as the band asks for, three times as many, and single elements.
FINER = (1, 3, None)
#: Signature rows that a task looks through for common ones at a time, and the parts that it deals those of one signature to.
PORTION, PARTS = 1_000_000, 64
#: Sets of a block.
BLOCK = 500
#: Documents whose sets are compared that are still broadcast by id.
BROADCAST = 1_000_000
#: Rows of keys that a task reads at least; smaller tables are gathered in fewer tasks.
ROWS_PER_TASK = 50_000
_CODE_BITS = 10


@lru_cache(maxsize=8)
def bands(percent: int) -> list[int]:
    """Least size of each band: a size and its partner lie at most one band apart."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return low


def band_of(size: int, percent: int) -> int:
    return bisect_right(bands(percent), size) - 1


def signatures(own: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """Signatures of one set and how many of them a partner must have at least, per instance and level.

    An instance joins a band and the next one; a set takes part as one of the lower and as one of the upper band.
    """
    size = len(own)
    if not size:
        return
    band, low = band_of(size, percent), bands(percent)
    for at, differing in ((band, size * (100 - percent) // percent), (band - 1, 2 * size * (100 - percent) // (100 + percent))):
        if at < 0:
            continue
        parts = -(-int(low[at] * 10_000 * 10_000 // (percent * percent)) // int(ELEMENTS * 10_000))
        for level, finer in enumerate(FINER):
            if finer is None:
                sums = mixed(own)
            else:
                part = (own >> np.uint64(32)) * np.uint64(parts * finer) >> np.uint64(32)
                sums = np.add.reduceat(mixed(own), np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1]))
            code = np.array([at * len(FINER) + level], np.uint64)
            named = mixed(sums ^ mixed(code + np.uint64(1))) >> np.uint64(_CODE_BITS) << np.uint64(_CODE_BITS) | code
            yield named, len(sums) - differing
            if len(sums) > differing:
                break


def gathered(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, in as many partitions as its rows ask for."""
    df = cut_lineage(df)
    return df.coalesce(df.count() // ROWS_PER_TASK + 1)


def digest_of(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, ``h`` of its text, number of shingles and ``d``, the digest of their set (null without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(own), digest_of(own) if len(own) else None) for own in shingle_sets(batch.column(2), width)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([n for n, _ in sets], pa.int64()), pa.array([d for _, d in sets], pa.int64())],
                ["doc_id", "h", "n_shingles", "d"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, n_shingles long, d long")


def signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (sig, d, need, part) of the different sets that a task comes to.

    A signature that a task already finds common keeps one row without ``d`` in part 0, which tells that it is; its sets go to other parts.
    """

    def rows(held: list) -> pa.RecordBatch:
        sig = np.concatenate([s for _, s, _ in held])
        d = np.repeat(np.array([d for d, _, _ in held], np.int64), [len(s) for _, s, _ in held])
        need = np.repeat(np.array([n for _, _, n in held], np.int32), [len(s) for _, s, _ in held])
        different, of, times = np.unique(sig, return_inverse=True, return_counts=True)
        common = times > MOST
        part = np.where(common[of], 1 + d % PARTS, 0).astype(np.int32)
        told = different[common]
        nothing = pa.nulls(len(told), pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([sig, told]).view(np.int64)), pa.concat_arrays([pa.array(d), nothing]),
            pa.concat_arrays([pa.array(need), nothing.cast(pa.int32())]),
            pa.array(np.concatenate([part, np.zeros(len(told), np.int32)]))], ["sig", "d", "need", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for batch in batches:
            for own in shingle_sets(batch.column(0), width):
                if not len(own) or (d := digest_of(own)) in seen:
                    continue
                if len(seen) >= 1_000_000:  # copies that come later are only signed again
                    seen.clear()
                seen.add(d)
                for sig, need in signatures(own, percent):
                    held.append((d, sig, need))
                    n += len(sig)
                if n >= PORTION:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    return docs.select("text").mapInArrow(run, "sig long, d long, need int, part int")


def shared_signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, d, need, code, common) of signatures that several sets have."""
    of = Window.partitionBy("sig", "part")
    told = F.max(F.col("d").isNull()).over(of)
    counted = signed(docs, width, percent).select(
        "sig", "d", "need", "part", told.alias("told"), F.count(F.lit(1)).over(of).alias("n"), F.min("d").over(of).alias("lo"),
        F.max("d").over(of).alias("hi"))
    several = (F.col("part") > 0) | F.col("told") | (F.col("lo") < F.col("hi"))
    common = (F.col("part") > 0) | F.col("told") | (F.col("n") > MOST)
    return counted.filter(several & F.col("d").isNotNull()).select(
        "sig", "d", "need", F.col("sig").bitwiseAND((1 << _CODE_BITS) - 1).alias("code"), common.alias("common")).dropDuplicates(["sig", "d"])


def rare_pairs(shared: DataFrame, lost: DataFrame) -> DataFrame:
    """(a, b): sets with as many rare signatures in common as both need. lost: (d, code, h), common signatures of a set."""
    lists = shared.filter("NOT common").groupBy("sig", "code").agg(F.array_sort(F.collect_list(F.struct("d", "need"))).alias("l"))
    pair = F.explode(F.expr(
        "flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x.d AS a, y.d AS b, x.need AS na, y.need AS nb))))"))
    met = lists.select("code", pair.alias("p")).groupBy("code", "p.a", "p.b").agg(
        F.count(F.lit(1)).alias("n"), F.max("p.na").alias("na"), F.max("p.nb").alias("nb"))
    side = lambda c: lost.select("code", F.col("d").alias(c), F.col("h").alias(f"h{c}"))
    known = met.join(side("a"), ["code", "a"], "left").join(side("b"), ["code", "b"], "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    enough = F.greatest(F.col("na") - none("ha"), F.col("nb") - none("hb"), F.lit(1))
    return known.filter(F.col("n") >= enough).select("a", "b").distinct()


def sets_of(docs: DataFrame, documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(d, own): the sets of the ``wanted`` digests, each from the text of one document that has it."""
    one = documents.join(wanted, "d", "left_semi").groupBy("d").agg(F.min(F.struct("doc_id", "h")).alias("k"))
    one = cut_lineage(one.select("d", F.col("k.doc_id").alias("__id"), F.col("k.h").alias("__h")))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    texts = keyed.join(small(one, one.count(), BROADCAST), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [own.tobytes() for own in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.large_binary()).cast(pa.binary())], ["d", "own"])

    return texts.select("d", "text").mapInArrow(run, "d long, own binary").dropDuplicates(["d"])


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    side = lambda c: sets.select(F.col("d").alias(c), F.col("own").alias(f"own_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    near[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "own_a", "own_b")
    return met.mapInArrow(run, "a long, b long")


def near_in_blocks(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of a forest with the components of all similar pairs of each group. groups: (root, d).

    A group is dealt into blocks by size band and digest, and every two blocks whose sizes may go together meet once.
    """
    low = F.array(*[F.lit(n).cast("bigint") for n in bands(percent)])
    band = F.size(F.filter(low, lambda n: n <= F.octet_length("own") / 8)) - 1
    sized = cut_lineage(groups.join(sets, "d").withColumn("band", band))
    cells = sized.groupBy("root", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    near = lambda by, name: cells.select("root", (F.col("band") + by).alias("band"), F.col("blocks").alias(name))
    known = sized.join(cells, ["root", "band"]).join(near(-1, "above"), ["root", "band"], "left").join(near(1, "below"), ["root", "band"], "left")
    i = F.pmod(F.xxhash64("d"), F.col("blocks"))
    to = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    key = lambda lo, a, b, up: F.struct(lo.alias("lo"), a.alias("i"), b.alias("j"), up.alias("up"))
    none = F.array().cast("array<struct<lo:int,i:bigint,j:bigint,up:boolean>>")
    meets = F.concat(
        F.transform(to("blocks"), lambda j: key(F.col("band"), F.least(i, j), F.greatest(i, j), F.lit(False))),
        F.when(F.col("above").isNull(), none).otherwise(F.transform(to("above"), lambda j: key(F.col("band"), i, j, F.lit(True)))),
        F.when(F.col("below").isNull(), none).otherwise(F.transform(to("below"), lambda j: key(F.col("band") - 1, j, i, F.lit(True)))))
    dealt = known.select("root", "d", "own", F.explode(meets).alias("m")).select("root", "m.*", "d", "own")

    def run(table: pa.Table) -> pa.Table:
        names = table.column("d").to_numpy()
        label = linked_sets([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("own")], percent / 100)
        child = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": pa.array(names[label[child]]), "b": pa.array(names[child])})

    return dealt.groupBy("root", "lo", "i", "j", "up").applyInArrow(run, "a long, b long")


def near_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles (size of the set of ``width``-word shingles) and component_id of every document.

    Words are runs of anything but ASCII white space, with A-Z in lower case; a text of fewer words is one shingle.
    Two documents link if 100 * intersection >= ``percent`` * union of their sets; component_id is the
    smallest doc_id reachable by links, the document's own included. Null or empty texts and texts without words have
    no shingles and link with nothing. Rows with equal ids stay separate rows; a null id never names a component
    unless nothing else is in it; other columns are ignored; an empty table gives no rows. Sets are known by a 64-bit digest.
    """
    documents = gathered(prints(docs, width))
    shared = gathered(shared_signatures(docs, width, percent))
    lost = gathered(shared.filter("common").groupBy("d", "code").agg(F.count(F.lit(1)).alias("h"), F.max("need").alias("need")))
    pairs = gathered(rare_pairs(shared, lost))
    # those with too few rare signatures to be found by them
    loose = shared.filter("common").join(lost.filter("h >= need").select("d", "code"), ["d", "code"], "left_semi").select("sig", "d")
    loose = gathered(loose)
    star = loose.join(loose.groupBy("sig").agg(F.min("d").alias("least")), "sig").filter("d <> least")
    groups = gathered(connected_components(
        star.select(F.col("least").alias("id_a"), F.col("d").alias("id_b")), loose.select(F.col("d").alias("id")).distinct(), [], ROWS_PER_TASK
    ).select("root", F.col("id").alias("d")))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("d")).unionByName(groups.select("d")).distinct()
    sets = cut_lineage(sets_of(docs, documents, wanted, width))
    edges = gathered(similar(pairs, sets, percent).unionByName(near_in_blocks(groups, sets, percent)))
    touched = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    roots = connected_components(edges.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")), touched, [], ROWS_PER_TASK)
    classes = documents.filter("d IS NOT NULL").groupBy("d").agg(F.min("doc_id").alias("least")).join(
        roots.withColumnRenamed("id", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("d", "component_id")
    return documents.join(named, "d", "left").select(
        "doc_id", "n_shingles", F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: The same in SQL: every two documents that share a shingle are compared.
NEAR_SQL = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
near AS (
    SELECT p.a, p.b FROM (
        SELECT x.r AS a, y.r AS b, count(*) AS both FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2) p
    JOIN sizes m ON m.r = p.a JOIN sizes n ON n.r = p.b WHERE 100 * p.both >= 80 * (m.n + n.n - p.both)),
reached AS (SELECT r AS a, r AS b FROM words UNION SELECT c.a, n.b FROM reached c JOIN near n ON n.a = c.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM words d LEFT JOIN sizes s ON s.r = d.r JOIN reached c ON c.a = d.r JOIN words o ON o.r = c.b GROUP BY d.r, d.doc_id, s.n
"""
