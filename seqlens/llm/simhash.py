"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints are points of a 64-bit binary trie. Two nodes of equal depth are followed
together, their differing bits are added up, and the pair is dropped once the error
budget is spent. The bits are cut into ``parts`` equal parts, and there is one trie for each
part that may come first, the others following in turn. If two fingerprints differ in
at most ``errors`` bits, then in one of these turns the first k parts hold at most
``errors * k / parts`` of them for every k, so each trie may use this smaller budget.

The upper levels are followed by Spark: a trie is cut at a depth that grows with the
number of fingerprints, and every surviving pair of nodes there becomes one group. The
lower levels are followed by one task per group, a level at a time over arrays. Links
are reduced to a forest per group, so what leaves a task is no more than its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage, small
from seqlens.plans.rounds import connected_components

BITS = 64
#: Leaves under a node where Spark hands a pair of nodes to a task, about; and the depth at which it does so at least.
LEAST_DEPTH = 5
LEAVES = 32_000
#: Pairs of nodes that a task follows at a time.
PORTION = 500_000
#: Leaf pairs that a task looks at a time, about.
LEAF_PAIRS = 1_000_000
#: Documents whose sets are compared word for word that are still broadcast by id.
BROADCAST = 1_000_000
#: Odd factors that put 32-bit hashes in 128 orders.
_ORDERS = np.random.default_rng(42).integers(0, 1 << 32, 2 * BITS, dtype=np.uint32) | np.uint32(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of the word shingles of one text, in order; a text of fewer words is one shingle."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    return np.fromiter(
        (hashed(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1:].tolist(), strict=True)),
        np.uint64, n)


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of one text: bit set if over half of the shingle hashes set it."""
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at:at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def set_bits(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit fingerprints of a set of hashes: a bit is that of the set's least hash in one of 128 orders.

    A bit differs with probability (1 - J) / 2 between sets of Jaccard similarity J, so at 0.8 a fingerprint
    differs in 6.4 bits, with a deviation of 2.4.
    """
    if not len(hashes):
        return 0, 0
    low = hashes.astype(np.uint32)
    least = np.full(2 * BITS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4_096):
        least = np.minimum(least, (_ORDERS[:, None] * low[at:at + 4_096]).min(axis=1))
    a, b = np.packbits(least * np.uint32(0x9E3779B1) >> np.uint32(31) == 1).view(">i8")
    return int(a), int(b)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and ``fp``, the SimHash as a signed 64-bit number. Null texts count as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t.as_py() or "").encode() for t in batch.column(1))
            found = np.fromiter((fingerprint_of(t, width) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def set_prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, ``h``, ``digest`` of the set of shingles and its fingerprints ``fp`` and ``other``. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(2)):
                own = np.unique(shingle_hashes((text.as_py() or "").encode(), width))
                found[i] = np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64), *set_bits(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(found[:, c]) for c in range(3))], ["doc_id", "h", "digest", "fp", "other"])

    return docs.select("doc_id", "h", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, digest long, fp long, other long")


def budget_at(depth: int, errors: int, parts: int) -> int:
    """Differing bits that the first ``depth`` bits may hold."""
    return min(errors, errors * -(-depth * parts // BITS) // parts)


def masks_at(depth: int, errors: int, parts: int) -> list[int]:
    """What two nodes at ``depth`` may differ by."""
    masks = {0: 0}
    for at in range(1, depth + 1):
        budget = budget_at(at, errors, parts)
        masks = {m << 1 | bit: n + bit for m, n in masks.items() for bit in (0, 1) if n + bit <= budget}
    return sorted(masks)


def turned(fp: Column, bits: Column) -> Column:
    """The fingerprint turned left by ``bits``."""
    return F.when(bits == 0, fp).otherwise(
        F.call_function("shiftleft", fp, bits).bitwiseOR(F.call_function("shiftrightunsigned", fp, BITS - bits)))


def node_pairs(points: DataFrame, depth: int, errors: int, parts: int) -> DataFrame:
    """Rows (turn, low, high, side, fp, other): the leaves of each pair of nodes at ``depth`` within the budget.

    A pair is named by its two nodes, the smaller first; ``side`` tells under which the leaf is.
    """
    turn = BITS // parts
    own = points.withColumn("turn", F.explode(F.array(*[F.lit(i * turn) for i in range(parts)])))
    node = F.shiftrightunsigned(turned(F.col("fp"), F.col("turn")), BITS - depth) if depth else F.lit(0).cast("bigint")
    met = own.withColumn("node", node).withColumn(
        "mask", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks_at(depth, errors, parts)])))
    partner = F.col("node").bitwiseXOR(F.col("mask"))
    return met.select(
        "turn", F.least("node", partner).alias("low"), F.greatest("node", partner).alias("high"),
        (F.col("node") > partner).cast("int").alias("side"), "fp", "other", "id")


def follow(left: np.ndarray, right: np.ndarray, depth: int, errors: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (into the sorted arrays) of leaf pairs within ``errors`` bits, followed from two nodes at ``depth``.

    left, right: sorted unsigned fingerprints under the two nodes; the same array for a
    node with itself. Pairs come in portions; a long list of node pairs is followed a portion at a time.
    """
    if not len(left) or not len(right):
        return
    same = left is right
    first = int(left[0] >> np.uint64(BITS - depth)) ^ int(right[0] >> np.uint64(BITS - depth)) if depth else 0
    start = tuple(np.array([x], np.int64) for x in (0, len(left), 0, len(right), first.bit_count()))
    waiting = [(depth, start)]
    while waiting:
        depth, (a0, a1, b0, b1, errs) = waiting.pop()
        done = ((a1 - a0 == 1) & (b1 - b0 == 1)) | (depth == BITS)
        if done.any():
            la0, lb0, wide = a0[done], b0[done], (b1 - b0)[done]
            ends = np.cumsum((a1 - a0)[done] * wide)
            for at in range(0, int(ends[-1]), LEAF_PAIRS):
                nth = np.arange(at, min(at + LEAF_PAIRS, int(ends[-1])))
                of = np.searchsorted(ends, nth, "right")
                nth -= np.concatenate([[0], ends[:-1]])[of]
                x, y = la0[of] + nth // wide[of], lb0[of] + nth % wide[of]
                near = np.bitwise_count(left[x] ^ right[y]) <= errors
                if same:
                    near &= x < y
                yield x[near], y[near]
        a0, a1, b0, b1, errs = (v[~done] for v in (a0, a1, b0, b1, errs))
        if not len(errs):
            continue
        if len(errs) > PORTION:
            half = len(errs) // 2
            waiting += [(depth, tuple(v[:half] for v in (a0, a1, b0, b1, errs))), (depth, tuple(v[half:] for v in (a0, a1, b0, b1, errs)))]
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        depth += 1
        budget = budget_at(depth, errors, parts)
        above = ~np.uint64(0) << np.uint64(BITS - depth)
        a_mid = np.clip(np.searchsorted(left, (left[a0] & above) | bit), a0, a1)
        b_mid = np.clip(np.searchsorted(right, (right[b0] & above) | bit), b0, b1)
        next_ = []
        for alo, ahi, blo, bhi, more in (
            (a0, a_mid, b0, b_mid, 0), (a_mid, a1, b_mid, b1, 0), (a0, a_mid, b_mid, b1, 1), (a_mid, a1, b0, b_mid, 1),
        ):
            keep = (alo < ahi) & (blo < bhi) & (errs + more <= budget)
            if same:  # a pair of nodes is followed once
                keep &= alo <= blo
            next_.append((alo[keep], ahi[keep], blo[keep], bhi[keep], errs[keep] + more))
        waiting.append((depth, tuple(np.concatenate(c) for c in zip(*next_, strict=True))))


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` (smallest member of each point's component) after linking x to y, by hooking and pointer jumping."""
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
        while not ((up := root[root]) == root).all():
            root = up


def links(
    points: DataFrame, errors: int, parts: int, other_errors: int | None = None, leaves: int = LEAVES, least_depth: int = LEAST_DEPTH,
) -> DataFrame:
    """Edges (a, b) of a forest with the same components as all linked pairs of points.

    points: distinct (fp, other, id). Two link if their ``fp`` differ in at most ``errors`` bits and,
    where ``other_errors`` is given, their ``other`` in at most so many. Edges name the points by ``id``.
    """
    n = points.count()
    depth = min(BITS // 2, max(least_depth, (n // leaves).bit_length()))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        turn, alone = key[0].as_py(), key[1].as_py() == key[2].as_py()
        fps, others, side = (group.column(c).to_numpy() for c in ("fp", "other", "side"))
        fps, ids = fps.view(np.uint64), group.column("id").to_numpy()
        if turn:
            fps = (fps << np.uint64(turn)) | (fps >> np.uint64(BITS - turn))
        order = np.lexsort((others, fps, side))
        fps, others, ids = fps[order], others.view(np.uint64)[order], ids[order]
        cut = len(fps) if alone else int((side == 0).sum())
        left = fps[:cut]
        right, shift = (left, 0) if alone else (fps[cut:], cut)
        root = np.arange(len(fps))
        for x, y in follow(left, right, depth, errors, parts):
            if other_errors is not None:
                alike = np.bitwise_count(others[x] ^ others[y + shift]) <= other_errors
                x, y = x[alike], y[alike]
            root = joined(root, x, y + shift)
        child = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": pa.array(ids[root[child]]), "b": pa.array(ids[child])})

    pairs = node_pairs(points, depth, errors, parts)
    return pairs.groupBy("turn", "low", "high").applyInArrow(run, "a long, b long")


def components(prints: DataFrame, errors: int, parts: int, other_errors: int | None = None, either: bool = False) -> DataFrame:
    """``prints`` (doc_id, fp, other) with ``component_id``, the smallest doc_id reachable over links, and ``root``.

    ``root`` is the component itself, a point's id; components of null or repeated ids may share their smallest doc_id.
    With ``either`` two points link as well if it is their ``other`` that differs in at most ``errors`` bits.
    """
    # copies fold to one point before anything is paired
    points = cut_lineage(prints.groupBy("fp", "other").agg(F.min("doc_id").alias("least")).withColumn(
        "id", F.monotonically_increasing_id()))
    edges = links(points.select("fp", "other", "id"), errors, parts, other_errors)
    if either:
        turned_round = points.select(F.col("other").alias("fp"), F.col("fp").alias("other"), "id")
        edges = edges.unionByName(links(turned_round, errors, parts, other_errors))
    edges = cut_lineage(edges)
    touched = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    roots = connected_components(edges.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")), touched, [])
    linked = roots.select("id", "root").join(points.select("id", "fp", "other", "least"), "id")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("id", "root", "component_id")
    labels = points.join(named, "id", "left").select(
        "fp", "other", F.coalesce("root", "id").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(labels, ["fp", "other"])


def near_duplicates(docs: DataFrame, width: int = 3, errors: int = 3, parts: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Fingerprints link at ``errors`` or fewer differing bits; component_id is the smallest
    doc_id reachable. Texts without words have fingerprint zero, linked like any other.
    Rows with equal ids stay separate rows; a null id never names a component unless
    nothing else is in it; other columns are ignored; an empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, width).withColumn("other", F.lit(0).cast("bigint")))
    return components(prints, errors, parts).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def linked_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A number per set, equal for sets connected by pairs of a Jaccard similarity of ``similarity`` or more.

    Every set is compared with all those that are not yet connected to it. Each set is sorted and without repeats.
    """
    size = np.array([len(x) for x in sets], np.int64)
    label, open_ = np.full(len(sets), -1, np.int64), np.arange(len(sets))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts, marked = np.cumsum(size) - size, np.zeros(len(names) + 1, bool)
    where: list[int] = []
    while len(open_):
        if not where:  # the next component
            where, open_ = [int(open_[0])], open_[1:]
            label[where[0]] = where[0]
        i = where.pop()
        least, most = np.minimum(size[open_], size[i]), np.maximum(size[open_], size[i])
        like = np.zeros(len(open_), bool)
        may = np.flatnonzero((least >= similarity * most * (1 - 1e-9)) & (least > 0))
        if len(may):
            mine = flat[starts[i]:starts[i] + size[i]]
            marked[mine] = True
            n = size[open_[may]]
            for part in np.split(np.arange(len(may)), np.flatnonzero(np.diff(np.cumsum(n) // 4_000_000)) + 1):
                m = n[part]
                before = np.cumsum(m) - m
                at = np.arange(int(m.sum())) + np.repeat(starts[open_[may[part]]] - before, m)
                both = np.add.reduceat(marked[flat[at]].astype(np.int64), before)
                like[may[part]] = both / (m + size[i] - both) >= similarity
            marked[mine] = False
        where += open_[like].tolist()
        label[open_[like]] = label[i]
        open_ = open_[~like]
    return label


def verified(docs: DataFrame, chosen: DataFrame, width: int, similarity: float) -> DataFrame:
    """(root, digest, label): which sets of shingles under a root are connected by pairs of ``similarity`` or more.

    docs: doc_id, h, text; chosen: root, digest and the doc_id and h of one document that has the set.
    """
    chosen = small(chosen.withColumnsRenamed({"doc_id": "__id", "h": "__h"}), chosen.count(), BROADCAST)
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("root", "digest", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingle_hashes((t.as_py() or "").encode(), width)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.binary())], ["root", "digest", "own"])

    def run(group: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("own")]
        return group.select(["root", "digest"]).append_column("label", pa.array(linked_sets(own, similarity)))

    one = texts.mapInArrow(sets, "root long, digest long, own binary").groupBy("root", "digest").agg(F.first("own").alias("own"))
    return one.groupBy("root").applyInArrow(run, "root long, digest long, label long")


def without_near_copies(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, search_errors: int = 10, other_errors: int = 16, parts: int = 8,
) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id.

    Two documents are near copies if the sets of their ``width``-word shingles have a Jaccard similarity of
    ``similarity`` or more. Pairs are sought by two fingerprints of the set, of which one differs in at most
    ``search_errors`` of 64 bits and the other in at most ``other_errors``: at 0.8 that leaves out three pairs of a thousand. All sets
    that hang together by such pairs are then compared themselves. Documents without words are copies of each other. Of
    rows with equal ids and texts one stays; a null id stays only if no other is in its group.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    prints = cut_lineage(set_prints(keyed, width))
    grouped = cut_lineage(components(prints, search_errors, parts, other_errors, either=True).select("doc_id", "h", "digest", "root"))
    several = grouped.groupBy("root").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("root")
    chosen = cut_lineage(grouped.join(several, "root", "left_semi").groupBy("root", "digest").agg(
        F.min(F.struct("doc_id", "h")).alias("k")).select("root", "digest", "k.doc_id", "k.h"))
    labels = cut_lineage(verified(keyed, chosen, width, similarity))
    kept = grouped.join(labels, ["root", "digest"], "left").groupBy("root", "label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k")).select("k.doc_id", "k.h")
    kept = cut_lineage(kept.withColumnRenamed("doc_id", "__id").withColumnRenamed("h", "__h"))
    staying = docs.withColumn("__key", F.xxhash64("text")).join(
        kept, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__key").eqNullSafe(F.col("__h")), "left_semi")
    if prints.count() > prints.select("doc_id", "h").distinct().count():
        staying = staying.dropDuplicates(["doc_id", "__key"])
    return staying.select(*docs.columns)
