"""Units on the page: boxes, overlaps, duplicates, ordering and measures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions.values import box_intersection, hamming, iou, upper_median
from seqlens.operators.evidence import nearest_by_number
from seqlens.operators.timeline import anchor_chain
from seqlens.plans.batches import fold_groups
from seqlens.plans.ranges import box_pairs, interval_join
from seqlens.plans.rounds import connected_components
from seqlens.plans.scan import ordinal_block, ranked_positions, scan
from seqlens.session import cut_lineage

# Size limits, overlap limits, weights.
MIN_SIDE, MIN_AREA = 180, 120000
INSIDE_SHARE = 0.5
SAME_BOX = 0.6
NMS_IOU = 0.7
CLUSTER_PAD = 24
BAND_SHARE = 0.08
STRIP_ASPECT = 2.2
TALL_ASPECT = 2.5
MARK_UNITS, MARK_SHARE = 3, 0.30
W_BEAT, W_TEXT, W_POS = 0.40, 0.35, 0.25
SPLASH = 0.02
TEXT_PRIOR = 0.10
GUARD_HEIGHT, GUARD_HEIGHT_TEXT = 0.45, 0.55
COMFORT_PX, TRIGGER_PX, BASE_HEIGHT = 40.0, 30.0, 1080.0


def unit_size_ok(w: Column, h: Column) -> Column:
    """large enough to show."""
    return (F.least(w, h) >= MIN_SIDE) & (w * h >= MIN_AREA)


def nearest_healthy(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units (keys, number, path, ok) with ``shown``: the own path, or for a bad
    unit the path of the healthy unit with the nearest other number (null if none)."""
    good = units.filter("ok")
    bad = nearest_by_number(units.filter("NOT ok"), good, keys, "number", "path")
    return good.withColumn("shown", F.col("path")).unionByName(bad.withColumnRenamed("nearest", "shown"))


def interval_remap(old: DataFrame, new: DataFrame, keys: Sequence[str], width: float = 512.0) -> DataFrame:
    """New units standing in for each old unit: (keys, old, new, y).

    old, new: (keys, unit, page or null, y, h). Strip units (page null) map to the
    unit of largest overlap plus every unit at least half inside; page units map to
    the unit of the same page.
    """
    keys = list(keys)
    span = lambda df, tag: df.filter("page IS NULL").select(
        *keys, F.col("unit").alias(tag), F.col("y").cast("double").alias(f"{tag}_y"), F.col("h").cast("double").alias(f"{tag}_h"),
        (F.col("y") + F.col("h")).cast("double").alias(f"{tag}_end"))
    pairs = interval_join(span(old, "old"), span(new, "new"), keys, ("old_y", "old_end"), ("new_y", "new_end"), width)
    shared = F.least("old_end", "new_end") - F.greatest("old_y", "new_y")
    pairs = pairs.withColumn("ov", shared).filter("ov > 0")
    # one shuffle by old unit: the best pair, the pairs inside and the distinct rows are all told there
    place = F.row_number().over(Window.partitionBy(*keys, "old").orderBy(F.desc("ov"), "new_y", "new"))
    chosen = pairs.select(*keys, "old", "new", "new_y", "ov", (F.col("ov") >= INSIDE_SHARE * F.col("new_h")).alias("inside")).withColumn("place", place)
    strips = chosen.filter("inside OR place = 1").select(*keys, "old", "new", F.col("new_y").alias("y")).distinct()
    pages = old.filter("page IS NOT NULL").select(*keys, "page", F.col("unit").alias("old")).join(
        new.select(*keys, "page", F.col("unit").alias("new"), F.col("y").cast("double").alias("y")), [*keys, "page"]
    ).drop("page")
    return strips.unionByName(pages)


def rewrite_references(refs: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit lists after a remap, duplicates within a scene kept once, first wins.

    refs: (keys, scene, ord, panel); mapping: (keys, old, new, y).
    """
    rows = refs.join(mapping.withColumnRenamed("old", "panel"), [*keys, "panel"])
    return rows.groupBy(*keys, "scene", "new").agg(F.min(F.struct("ord", "y")).alias("at")).select(
        *keys, "scene", F.col("new").alias("panel"), "at.ord", "at.y"
    )


def box_clusters(boxes: DataFrame, keys: Sequence[str], pad: float = CLUSTER_PAD, cell: float = 128.0) -> DataFrame:
    """J17 b: (keys, id, cluster) of boxes whose padded rectangles overlap, transitively."""
    pairs = box_pairs(boxes, keys, "box_id", cell, grow=pad)
    strict = (
        (F.col("box_a.x") - pad < F.col("box_b.x") + F.col("box_b.w") + pad)
        & (F.col("box_b.x") - pad < F.col("box_a.x") + F.col("box_a.w") + pad)
        & (F.col("box_a.y") - pad < F.col("box_b.y") + F.col("box_b.h") + pad)
        & (F.col("box_b.y") - pad < F.col("box_a.y") + F.col("box_a.h") + pad)
    )
    nodes = boxes.select(*keys, F.col("box_id").alias("id"))
    return connected_components(pairs.filter(strict), nodes, keys).withColumnRenamed("root", "cluster")


def closed_groups(boxes: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """``boxes`` with ``__part``: a number of the blocks of ``cell`` rows that a box lies in, so that boxes of two parts never meet, united or not.

    A part begins at a block that no box of a block above reaches into; it holds one or more stretches. Only one row per block is looked at in
    order, so a unit of any number of boxes is spread over tasks.
    """
    keys = list(keys)
    rows = cut_lineage(boxes.withColumn("__block", F.floor(F.col("y") / F.lit(cell)).cast("bigint")))
    across = Window.partitionBy(*keys).orderBy("__block")
    blocks = rows.groupBy(*keys, "__block").agg(F.min("y").alias("__top"), F.max(F.col("y") + F.col("h")).alias("__end"))
    blocks = blocks.withColumn("__far", F.max("__end").over(across.rowsBetween(Window.unboundedPreceding, -1)))
    part = F.sum(F.when(F.col("__far") > F.col("__top"), 0).otherwise(1)).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(blocks.select(*keys, "__block", part.alias("__part")).hint("merge"), [*keys, "__block"]).drop("__block")


def stretches(y: np.ndarray, end: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the stretch of every box; boxes go downward in each group. A stretch begins at a box that no box above it reaches."""
    ends, rank = np.unique(end, return_inverse=True)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(y)))) * len(ends)
    far = ends[np.maximum.accumulate(group + rank) - group]
    begins = np.append(True, far[:-1] <= y[1:])
    begins[starts] = True
    return np.cumsum(begins) - 1


#: Cells (stretches times boxes kept) that are compared in one step.
LANE_CELLS = 1 << 16


def united(boxes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (id, x, y, w, h as rows) of many stretches after serial merging, and how many are left of each.

    In a stretch the last box goes to the first kept box with which it shares 60 % of the smaller, until nothing changes. Stretches of
    like length take their steps together.
    """
    sizes = np.diff(np.append(starts, boxes.shape[1]))
    left: list[np.ndarray | None] = [None] * len(starts)
    order = np.argsort(sizes, kind="stable")
    alone = order[sizes[order] == 1]
    for i in alone:
        left[i] = boxes[:, starts[i]:starts[i] + 1]
    at = len(alone)
    while at < len(order):
        width = int(sizes[order[at]])
        upto = at + 1
        while upto < len(order) and sizes[order[upto]] <= 2 * width and (upto - at + 1) * sizes[order[upto]] <= LANE_CELLS:
            upto += 1
        lanes = order[at:upto]
        at = upto
        width = int(sizes[lanes[-1]])
        place = starts[lanes][:, None] + np.arange(width)
        there = np.arange(width) < sizes[lanes][:, None]
        todo, count = boxes[:, np.where(there, place, 0)], sizes[lanes].copy()
        while len(lanes):
            kept, n = _one_pass(todo, count)
            settled = n == count
            for j in np.flatnonzero(settled):
                left[lanes[j]] = kept[:, j, :n[j]]
            lanes, todo, count = lanes[~settled], kept[:, ~settled], n[~settled]
    return np.concatenate(left, axis=1), np.array([x.shape[1] for x in left])


def _one_pass(todo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every lane's boxes from the last to the first, each united with the first kept one it doubles or kept: (kept, how many)."""
    kept, n = np.zeros_like(todo), np.zeros(len(count), np.int64)
    every, width = np.arange(len(count)), todo.shape[2]
    for step in range(int(count.max())):
        live = every[count > step]
        box = todo[:, live, count[live] - 1 - step][:, :, None]
        most = max(int(n[live].max()), 1)
        k = kept[:, live, :most]
        across = np.minimum(box[1] + box[3], k[1] + k[3]) - np.maximum(box[1], k[1])
        down = np.minimum(box[2] + box[4], k[2] + k[4]) - np.maximum(box[2], k[2])
        same = (across > 0) & (down > 0) & (across * down >= SAME_BOX * np.minimum(box[3] * box[4], k[3] * k[4])) & (np.arange(most) < n[live][:, None])
        hit = same.any(axis=1)
        own, one = live[~hit], box[:, ~hit, 0]
        kept[:, own, n[own]] = one
        n[own] += 1
        lane, (name, x, y, w, h) = live[hit], box[:, hit, 0]
        spot = same[hit].argmax(axis=1)
        o = kept[:, lane, spot]
        left, top = np.minimum(x, o[1]), np.minimum(y, o[2])
        kept[:, lane, spot] = np.stack([np.minimum(name, o[0]), left, top, np.maximum(x + w, o[1] + o[3]) - left, np.maximum(y + h, o[2] + o[4]) - top])
    return kept, n


def merge_duplicate_boxes(boxes: DataFrame, keys: Sequence[str], cell: float = 128.0) -> DataFrame:
    """J17 a: (keys, box_id, x, y, w, h) with duplicates united in the serial order of ``box_id``.

    Boxes are taken from the last to the first; one that shares 60 % of the smaller box with a kept one is united with the first
    such, else it is kept; this is repeated over the kept boxes until none is united. A union has the smallest id of its boxes. Stretches of
    rows that no box leaves are folded apart, each in one row: a stretch holds what overlaps in one place of one unit.
    """
    keys = list(keys)
    cols = ["box_id", "x", "y", "w", "h"]
    rows = closed_groups(boxes.select(*keys, "box_id", *[F.col(c).cast("double").alias(c) for c in cols[1:]]), keys, cell)

    def fold(table: pa.Table, starts: np.ndarray) -> pa.Table:
        # ids go by their place in order, which a double holds whatever they are
        known, place = np.unique(table.column("box_id").to_numpy(), return_inverse=True)
        values = np.stack([place.astype(float), *[table.column(c).to_numpy() for c in cols[1:]]])
        stretch = stretches(values[2], values[2] + values[4], starts)
        order = np.lexsort([place, stretch])
        firsts = np.flatnonzero(np.diff(stretch, prepend=-1))
        left, n = united(values[:, order], firsts)
        group = table.select(keys).take(pa.array(np.repeat(firsts, n)))
        for name, column in zip(cols, [known[left[0].astype(np.int64)], *left[1:]], strict=True):
            group = group.append_column(name, pa.array(column))
        return group

    return fold_groups(rows, [*keys, "__part"], ["y", "box_id"], fold, rows.select(*keys, *cols).schema)


#: Boxes of a group of overlapping ones that one task settles at a time, and rounds of local winners before groups are looked for.
SETTLE_BOXES, LOCAL_ROUNDS = 20_000, 3


def nms(boxes: DataFrame, keys: Sequence[str], limit: float = NMS_IOU, cell: float = 128.0) -> DataFrame:
    """Greedy suppression: drop boxes overlapping a kept box of higher score.

    The order is strict (score descending, then id), so the result is the serial one. Equal rectangles fold to their best box
    before boxes are paired. First, boxes without an undecided better neighbour are kept and their neighbours
    dropped, for a few rounds. What long chains leave is settled by group of boxes that hang together: the best ``SETTLE_BOXES`` boxes
    of a group in one task, whose survivors strike their neighbours among the rest at once. So a chain of n boxes takes
    about n / SETTLE_BOXES rounds.
    """
    keys = list(keys)
    rect = ["x", "y", "w", "h"]
    best = F.struct(F.col("score").alias("s"), (-F.col("box_id")).alias("i"))
    if limit >= 1:  # even equal boxes stay then
        return boxes
    rest = [c for c in boxes.columns if c not in (*keys, *rect)]
    scored = cut_lineage(boxes.groupBy(*keys, *rect).agg(F.max_by(F.struct(*rest), best).alias("b")).select(*keys, *rect, "b.*").select(*boxes.columns))
    pairs = box_pairs(scored, keys, "box_id", cell, grow=1.0, carry=["score"])
    pairs = pairs.filter(iou(F.col("box_a"), F.col("box_b"), plus=1.0) > limit)
    s_a, s_b = F.col("box_a.score"), F.col("box_b.score")
    a_wins = (s_a > s_b) | ((s_a == s_b) & (F.col("id_a") < F.col("id_b")))
    edges = cut_lineage(pairs.select(
        *keys, F.when(a_wins, F.col("id_a")).otherwise(F.col("id_b")).alias("better"),
        F.when(a_wins, F.col("id_b")).otherwise(F.col("id_a")).alias("worse")))
    dropped, rounds = [], 0
    while not edges.isEmpty():
        if rounds < LOCAL_ROUNDS:
            beaten = edges.select(*keys, F.col("worse").alias("better")).distinct()
            kept = edges.select(*keys, "better").distinct().join(beaten, [*keys, "better"], "left_anti")
            decided = kept
        else:
            decided = cut_lineage(settled_heads(edges, scored, keys))
            kept = decided.filter("keep").select(*keys, F.col("id").alias("better"))
            decided = decided.select(*keys, F.col("id").alias("better"))
        out = edges.join(kept, [*keys, "better"], "left_semi").select(*keys, F.col("worse").alias("id")).distinct()
        out = cut_lineage(out)
        dropped.append(out)
        gone = out.select(*keys, F.col("id").alias("better")).unionByName(decided.select(*keys, "better")).distinct()
        edges = edges.join(out.withColumnRenamed("id", "worse"), [*keys, "worse"], "left_anti").join(gone, [*keys, "better"], "left_anti")
        edges, rounds = cut_lineage(edges), rounds + 1
    left = scored
    if dropped:
        left = left.join(reduce(DataFrame.unionByName, dropped).withColumnRenamed("id", "box_id"), [*keys, "box_id"], "left_anti")
    return left


def settled_heads(edges: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, keep) of the best ``SETTLE_BOXES`` boxes of every group of boxes that hang together by ``edges`` (better, worse).

    What is not among the best is beaten by none but better boxes, so the serial rule holds within them.
    """
    keys = list(keys)
    ends = edges.select(*keys, F.explode(F.array("better", "worse")).alias("id")).distinct()
    roots = cut_lineage(connected_components(edges.select(*keys, F.col("better").alias("id_a"), F.col("worse").alias("id_b")), ends, keys))
    ranked = roots.join(scored.select(*keys, F.col("box_id").alias("id"), "score"), [*keys, "id"])
    order = Window.partitionBy(*keys, "root").orderBy(F.desc("score"), "id")
    heads = cut_lineage(ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SETTLE_BOXES).select(*keys, "root", "id", "rank"))
    inner = edges.withColumnRenamed("better", "id").join(heads.select(*keys, "root", "id", F.col("rank").alias("hi")), [*keys, "id"]).drop("id").join(
        heads.select(*keys, F.col("id").alias("worse"), F.col("rank").alias("lo")), [*keys, "worse"]).select(*keys, "root", "hi", "lo")
    # the boxes of a group come as edges to themselves
    rows = inner.unionByName(heads.select(*keys, "root", F.col("rank").alias("hi"), F.col("rank").alias("lo")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, ends in zip(batch.index, batch["__ends"], strict=True):
                hi, lo = np.array([(e["hi"], e["lo"]) for e in ends], np.int64).T
                keep, starts = np.ones(hi.max() + 1, bool), np.searchsorted(hi, np.arange(hi.max() + 2))
                for rank in range(1, len(keep)):
                    if keep[rank]:
                        struck = lo[starts[rank]:starts[rank + 1]]
                        keep[struck[struck != rank]] = False
                out = batch.loc[[i] * (len(keep) - 1), [*keys, "root"]].reset_index(drop=True)
                yield out.assign(rank=np.arange(1, len(keep), dtype=np.int32), keep=keep[1:])

    ends = rows.groupBy(*keys, "root").agg(F.sort_array(F.collect_list(F.struct("hi", "lo"))).alias("__ends"))
    done = ends.mapInPandas(run, heads.select(*keys, "root", "rank").withColumn("keep", F.lit(True)).schema)
    return heads.join(done, [*keys, "root", "rank"]).select(*keys, "id", "keep")


def hash_groups(items: DataFrame) -> DataFrame:
    """Distinct hashes with their first item and number of copies: (hash, id, copies)."""
    return items.groupBy("hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def near_duplicate_hash(items: DataFrame, bits: int, agree: int = 2) -> DataFrame:
    """Pairs of distinct 64-bit hashes at most ``bits`` apart.

    Exact copies are folded first, so a mass of equal items is one row and emits no
    pairs. The hash is split into bits + agree parts; two close hashes agree on at
    least ``agree`` of them, so every choice of ``agree`` parts is a join key. A pair
    is kept only under its first agreeing choice.
    """
    parts = bits + agree
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    part = lambda h, i: F.shiftrightunsigned(h, edges[i]).bitwiseAND(
        F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("bigint"))
    choices = list(combinations(range(parts), agree))
    uniq = hash_groups(items)
    keys = F.array(*[
        F.struct(F.lit(n).alias("choice"), F.xxhash64(*[part(F.col("hash"), i) for i in c]).alias("value"))
        for n, c in enumerate(choices)
    ])
    listed = uniq.select("id", "hash", F.explode(keys).alias("k")).select("id", "hash", "k.choice", "k.value")
    a, b = [listed.select("choice", "value", F.col("id").alias(f"id_{t}"), F.col("hash").alias(f"hash_{t}")) for t in "ab"]
    pairs = a.join(b, ["choice", "value"]).filter("id_a < id_b")
    pairs = pairs.withColumn("distance", hamming(F.col("hash_a"), F.col("hash_b"))).filter(F.col("distance") <= bits)
    same = F.array(*[F.when(part(F.col("hash_a"), i) == part(F.col("hash_b"), i), F.lit(i)) for i in range(parts)])
    first = F.slice(F.array_compact(same), 1, agree)
    chosen = F.element_at(F.array(*[F.array(*[F.lit(i) for i in c]) for c in choices]), F.col("choice") + 1)
    return pairs.filter(first == chosen).select("id_a", "id_b", "distance")


def watermark_gates(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """accepted match per unit.

    candidates: (keys, unit, tier, score, scale, white_dice, dark_dice). Tier 1 is the
    edge bands, tier 2 the full scan, which counts only where tier 1 gave nothing.
    """
    on = [*keys, "unit"]
    pick = F.struct("score", "scale", "white_dice", "dark_dice", "tier")
    best = candidates.groupBy(*on).agg(
        F.max(F.when(F.col("tier") == 1, pick)).alias("m1"), F.max(F.when(F.col("tier") == 2, pick)).alias("m2")
    )

    def passes(m: Column, floor: float, strong: float) -> Column:
        dark = m["dark_dice"] >= 0.60
        good = (m["white_dice"] >= 0.30) & ((m["score"] >= strong) | ((m["score"] >= floor) & dark))
        return F.coalesce(good & ((m["scale"] >= 0.8) | dark), F.lit(False))

    one, two = F.col("m1"), F.col("m2")
    match = F.when(passes(one, 0.45, 0.50), one).when((two["score"] >= 0.85) & passes(two, 0.85, 0.85), two)
    return best.withColumn("m", match).filter("m IS NOT NULL").select(*on, "m.*")


def reading_order(boxes: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position of every box in reading order.

    boxes: (keys, box_id, x, y); pages: (keys, mode, page_h). Strips read downward.
    Pages read in bands: a band holds boxes within 8 % of the page height of its
    first box, bands go down, boxes in a band from right to left.
    """
    keys = list(keys)
    rows = boxes.join(pages, keys)
    # in units of the tolerance every page has the same reach
    scaled = rows.withColumn("__v", F.col("y") / (F.lit(BAND_SHARE) * F.col("page_h")))
    bands = anchor_chain(scaled.filter("mode <> 'webtoon'"), keys, "__v", 1.0, False, 64.0)
    rows = scaled.join(bands.select(*keys, F.col("at").alias("__v"), "anchor"), [*keys, "__v"], "left")
    strip = F.col("mode") == "webtoon"
    rows = rows.withColumns({
        "__p": F.when(strip, F.col("y").cast("double")).otherwise(F.col("anchor")),
        "__q": F.when(strip, 0.0).otherwise(-F.col("x").cast("double")),
        "__r": F.when(strip, 0.0).otherwise(F.col("y").cast("double")),
    })
    placed = ranked_positions(rows, keys, ["__p", "__q", "__r", "box_id"], "position")
    return placed.drop("__p", "__q", "__r", "__v", "anchor")


def mode_majority_vote(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10: class of most pages by aspect, first seen on ties; ``overruled`` when page one differs.

    pages: (keys, pos, w, h).
    """
    keys = list(keys)
    kind = F.when(F.col("h") / F.greatest(F.col("w"), F.lit(1)) >= STRIP_ASPECT, "webtoon").otherwise("manga")
    votes = pages.withColumn("mode", kind).groupBy(*keys, "mode").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    return votes.groupBy(*keys).agg(
        F.max_by("mode", F.struct("n", (-F.col("p")).alias("p"))).alias("mode"), F.min_by("mode", "p").alias("first_mode")
    ).select(*keys, "mode", (F.col("mode") != F.col("first_mode")).alias("overruled"))


def dominant_width(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Can a group be stitched, and which width dominates?

    Yes with one width over several pages, or two widths over more than two pages
    with at most two odd ones (these are emitted alone).
    """
    keys = list(keys)
    widths = pages.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    out = widths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_widths"), F.sum("n").alias("n_pages"),
        F.max_by("w", F.struct("n", (-F.col("p")).alias("p"), (-F.col("w")).alias("w"))).alias("width"), F.max("n").alias("n_main"),
    )
    odd = F.col("n_pages") - F.col("n_main")
    one = (F.col("n_widths") == 1) & (F.col("n_pages") > 1)
    two = (F.col("n_widths") == 2) & (F.col("n_pages") > 2) & (odd <= 2)
    return out.select(*keys, "width", "n_widths", odd.alias("n_odd"), (one | two).alias("stitch"))


def recurring_marks(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clusters of corner runs of one size seen on three or more units.

    runs: (keys, unit, band, corner, w, h); sizes are rounded half-even.
    """
    size = [F.bround(F.col("h") / 8).cast("bigint").alias("h8"), F.bround(F.col("w") / 60).cast("bigint").alias("w60")]
    rows = runs.select(*keys, "unit", "band", "corner", *size)
    return rows.groupBy(*keys, "band", "corner", "h8", "w60").agg(
        F.countDistinct("unit").alias("n_units"), F.count(F.lit(1)).alias("n_runs")
    ).filter(F.col("n_units") >= MARK_UNITS)


def validate_marks(candidates: DataFrame, matches: DataFrame, units: DataFrame, keys: Sequence[str], probes: int | None = None) -> DataFrame:
    """A mark is real when it matches 3 or more, and at most 30 %, of the probed units.

    units: (keys, unit, pos) with dense 0-based pos. All are probed; with ``probes``, above
    so many units only every (n div probes)-th. matches: (keys, mark, unit).
    """
    keys = list(keys)
    probed = units.select(*keys, "unit")
    if probes is not None:
        sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn(
            "step", F.when(F.col("n") > probes, F.floor(F.col("n") / probes)).otherwise(1))
        probed = units.join(sizes, keys).filter(F.col("pos") % F.col("step") == 0).select(*keys, "unit")
    n_probed = probed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_probed"))
    hits = matches.select(*keys, "mark", "unit").distinct().join(probed, [*keys, "unit"]).groupBy(*keys, "mark").agg(
        F.count(F.lit(1)).alias("n_match"))
    rows = candidates.select(*keys, "mark").distinct().join(hits, [*keys, "mark"], "left").join(n_probed, keys)
    n = F.coalesce("n_match", F.lit(0))
    return rows.select(*keys, "mark", n.alias("n_match"), "n_probed",
                       ((n >= MARK_UNITS) & (n / F.col("n_probed") <= MARK_SHARE)).alias("valid"))


def text_coverage(units: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each unit covered by text boxes, at most 1.

    units: (keys, unit, w, h, has_text); without boxes a text-bearing unit counts 0.10.
    """
    on = [*keys, "unit"]
    area = boxes.groupBy(*on).agg(F.sum(F.col("w") * F.col("h")).alias("covered"))
    prior = F.when(F.coalesce("has_text", F.lit(True)), TEXT_PRIOR).otherwise(0.0)
    return units.join(area, on, "left").withColumn(
        "coverage", F.when(F.col("covered").isNull(), prior).otherwise(F.least(F.col("covered") / (F.col("w") * F.col("h")), F.lit(1.0)))
    ).drop("covered")


def importance_weights(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Layout weight and hero score of each unit of a scene.

    units: (keys, pos, w, h, coverage, beat, dur); ``keys`` identify the scene. The
    next beat is the neighbour's, the last unit holds until ``dur``.
    """
    keys = list(keys)
    ranked = units.withColumn("__area", F.col("w") * F.col("h"))
    sums = ranked.groupBy(*keys).agg(
        F.max("coverage").alias("__top"), F.max("pos").alias("__last"), upper_median("__area").alias("__median")
    )
    follow = scan(ranked, keys, ["pos"], ordinal_block("pos"), nxt={"__pos": F.col("pos"), "__next": F.col("beat")})
    rows = follow.withColumn("__next", F.when(F.col("__pos") == F.col("pos") + 1, F.col("__next"))).join(sums, keys)
    share = F.greatest(F.coalesce("__next", "dur") - F.col("beat"), F.lit(0.0)) / F.greatest(F.col("dur"), F.lit(1e-6))
    dense = F.col("coverage") / F.when(F.col("__top") > 0, F.col("__top")).otherwise(1.0)
    place = F.when(F.col("pos") == F.col("__last"), 1.0).when(F.col("pos") == 0, 0.6).otherwise(0.3)
    splash = F.when((F.col("coverage") < SPLASH) & (F.col("__area") >= F.col("__median")), 1.0).otherwise(0.0)
    return rows.withColumns({
        "weight": W_BEAT * share + W_TEXT * dense + W_POS * place, "hero": 0.6 * splash + 0.4 * place,
    }).drop("__area", "__top", "__last", "__median", "__next", "__pos")


def readability_guard(units: DataFrame, boxes: DataFrame, keys: Sequence[str], frame_w: float = 1920.0, frame_h: float = 1080.0) -> DataFrame:
    """Needed height share of each unit, and whether its text is too small as shown.

    units: (keys, unit, w, h, has_text); has_text null means no read, treated as text.
    """
    on = [*keys, "unit"]
    lines = boxes.groupBy(*on).agg(upper_median("h").alias("line_h"))
    rows = units.join(lines, on, "left")
    plain = F.when(F.coalesce("has_text", F.lit(True)), GUARD_HEIGHT_TEXT).otherwise(GUARD_HEIGHT)
    need = COMFORT_PX * frame_h / BASE_HEIGHT * F.col("h") / (F.col("line_h") * frame_h)
    fit = F.least(frame_w / F.col("w"), frame_h / F.col("h"))
    return rows.withColumns({
        "min_height": F.when(F.col("line_h").isNull(), plain).otherwise(F.least(F.greatest(need, F.lit(GUARD_HEIGHT)), F.lit(1.0))),
        "too_small": F.coalesce(F.col("line_h") * fit < TRIGGER_PX * frame_h / BASE_HEIGHT, F.lit(False)),
    })


#: What a cut's window does: it moves, it holds all boxes or it does not. Cuts whose beats are laid out at a time.
SCROLLS, HOLDS, LEAVES = 0, 1, 2
BEAT_ROWS = 4096


def judged_beats(cuts: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct beats of each cut, how many of them a box leaves the window at, and the first of these (infinity: none).

    cuts: (view, cut_off, dur, y0, y1, top, bottom, ss_h, said). Beats are a grid of half seconds, three fixed ones and the times
    of words, as far as they lie in the cut. Only the beats of moving windows are laid out; of others the ends of the grid tell all.
    """
    at = {n: cuts.column(n).to_numpy(zero_copy_only=False) for n in ("view", "cut_off", "dur", "y0", "y1", "top", "bottom", "ss_h")}
    off, dur, view, n = at["cut_off"], at["dur"], at["view"], len(cuts)
    total = dur + off
    last = np.maximum(np.ceil(total * 2).astype(np.int64) - 1, 0)

    def in_cut(r: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b >= 0) & (b <= total[r] + 1e-6) & (b >= off[r]) & (b - off[r] <= dur[r] + 1e-6)

    def leaves(r: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.minimum(np.maximum((b - off[r]) / dur[r], 0.0), 1.0)
        top = at["y0"][r] + (at["y1"][r] - at["y0"][r]) * (s * s * (3.0 - 2.0 * s))
        return (at["top"][r] < top) | (at["bottom"][r] > top + at["ss_h"][r])

    # the grid from k = lo to hi
    every = np.arange(n)
    lo, hi = np.maximum(np.ceil(off * 2), 0).astype(np.int64), last.copy()
    while (late := (hi >= lo) & ~in_cut(every, hi * 0.5)).any():
        hi[late] -= 1
    held = np.maximum(hi - lo + 1, 0)
    # the others, each once and none that the grid has
    said = cuts.column("said")
    words = said.flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.concatenate([np.tile(every, 3), np.repeat(every, said.value_lengths().to_numpy(zero_copy_only=False))])
    beat = np.concatenate([np.zeros(n), total * 0.5, np.maximum(total - 1e-3, 0.0), words])
    there = in_cut(row, beat)
    row, beat = row[there], beat[there]
    there = ~((beat * 2 == np.floor(beat * 2)) & (beat * 2 >= lo[row]) & (beat * 2 <= hi[row]))
    row, beat = row[there], beat[there]
    order = np.lexsort([beat, row])
    row, beat = row[order], beat[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (beat[1:] != beat[:-1])
    row, beat = row[new], beat[new]
    checked = held + np.bincount(row, minlength=n)
    first = np.where(held > 0, lo * 0.5, np.inf)
    np.minimum.at(first, row, beat)
    first[view != LEAVES] = np.inf
    bad = np.where(view == LEAVES, checked, 0)
    moving = np.flatnonzero((view == SCROLLS) & (held > 0))
    grid = np.repeat(moving, held[moving])
    k = np.arange(len(grid)) - np.repeat(np.cumsum(held[moving]) - held[moving], held[moving]) + lo[grid]
    kept = view[row] == SCROLLS
    row, beat = np.concatenate([grid, row[kept]]), np.concatenate([k * 0.5, beat[kept]])
    out = leaves(row, beat)
    row, beat = row[out], beat[out]
    bad += np.bincount(row, minlength=n)
    np.minimum.at(first, row, beat)
    return checked, bad, first


def containment_audit(
    plans: DataFrame, words: DataFrame, boxes: DataFrame, keys: Sequence[str], box_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Beats of each tall cut at which a text box leaves the visible window.

    plans: (keys, scene, cut, panel, cut_off, dur, mode, pw, ph, ss_w, ss_h, cy, zmax,
    fw, y0, y1, rx, ry, rw, rh); words: (keys, scene, w_start, w_end); boxes: (keys,
    panel, x, y, w, h), or with ``box_keys`` (box_keys, panel, x, y, w, h) where a panel's
    boxes hold in several groups. One row per cut with boxes: checked beats, violations, first.

    All boxes of a panel lie in a window exactly when their extent does, so boxes
    shrink to one extent for each way in which the panel is framed, and cuts join that. The beats of a cut (the words of
    one scene and a grid) are made and judged in numpy, batch by batch of cuts: nothing is exploded or shuffled per beat.
    """
    keys = list(keys)
    cid = [*keys, "scene", "cut"]
    tall = plans.filter(F.col("ph") / F.col("pw") > TALL_ASPECT)
    box_on = [*(keys if box_keys is None else box_keys), "panel"]
    in_crop = F.coalesce(F.col("mode") == "crop", F.lit(False))
    frame = ["pw", "ph", "__crop", *[f"__r{i}" for i in "xywh"]]
    tall = tall.withColumns({"__crop": in_crop, **{f"__r{i}": F.coalesce(f"r{i}", F.lit(0.0)) for i in "xywh"}})
    # dealt out by panel at once: nearly every frame of a panel is another one
    met = tall.select(*box_on, *frame).repartition(*box_on).distinct().join(boxes, box_on)
    x0, y0 = F.greatest("x", F.lit(0.0)), F.greatest("y", F.lit(0.0))
    x1, y1 = F.least(F.col("x") + F.col("w"), F.col("pw")), F.least(F.col("y") + F.col("h"), F.col("ph"))
    met = met.select(*box_on, *frame, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    met = met.filter("x1 > x0 AND y1 > y0")
    seen = ~F.col("__crop") | ((F.col("x1") > F.col("__rx")) & (F.col("x0") < F.col("__rx") + F.col("__rw"))
                               & (F.col("y1") > F.col("__ry")) & (F.col("y0") < F.col("__ry") + F.col("__rh")))
    keep = lambda agg, c: agg(F.when(seen, F.col(c))).alias(f"b{c}")
    extent = met.groupBy(*box_on, *frame).agg(keep(F.min, "x0"), keep(F.min, "y0"), keep(F.max, "x1"), keep(F.max, "y1"))
    spoken = words.groupBy(*keys, "scene").agg(F.collect_list(F.array("w_start", "w_end")).alias("__said"))
    rows = tall.join(spoken, [*keys, "scene"], "left").join(extent, [*box_on, *frame])
    c = F.col
    g = c("fw") / c("pw")
    fit = F.least(c("ss_w") / c("pw"), c("ss_h") / c("ph"))
    ox, oy = (c("ss_w") - c("pw") * fit) / 2.0, (c("ss_h") - c("ph") * fit) / 2.0
    cy = F.coalesce("cy", F.lit(0.5))
    hh, hw = c("ss_h") / (2.0 * c("zmax")), c("ss_w") / (2.0 * c("zmax"))
    still = (
        (ox + c("bx0") * fit >= c("ss_w") / 2.0 - hw) & (ox + c("bx1") * fit <= c("ss_w") / 2.0 + hw)
        & (oy + c("by0") * fit >= cy * c("ss_h") - hh) & (oy + c("by1") * fit <= cy * c("ss_h") + hh)
    )
    ccx, ccy = c("rx") + c("rw") / 2.0, c("ry") + c("rh") / 2.0
    hx, hy = c("rw") / (2.0 * c("zmax")), c("rh") / (2.0 * c("zmax"))
    crop = c("bx0").isNull() | ((c("bx0") >= ccx - hx) & (c("bx1") <= ccx + hx) & (c("by0") >= ccy - hy) & (c("by1") <= ccy + hy))
    fixed_view = F.when(c("mode") == "contain", True).when(c("mode") == "crop", crop).otherwise(still)
    said = F.coalesce(F.flatten("__said"), F.array().cast("array<double>"))
    view = F.when(c("mode") == "scroll", SCROLLS).when(fixed_view, HOLDS).otherwise(LEAVES).cast("int")
    cuts = rows.filter("dur IS NOT NULL AND cut_off IS NOT NULL").select(
        *cid, view.alias("view"), "cut_off", "dur", c("y0").cast("double").alias("y0"), c("y1").cast("double").alias("y1"), (c("by0") * g).alias("top"),
        (c("by1") * g).alias("bottom"), c("ss_h").cast("double").alias("ss_h"), said.alias("said"))
    counted = "checked long, violations long, first_at double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), BEAT_ROWS):
                rows = batch.slice(part, BEAT_ROWS)
                checked, bad, first = judged_beats(rows)
                out = pa.record_batch([*[rows.column(k) for k in cid], pa.array(checked), pa.array(bad), pa.array(first, mask=np.isinf(first))],
                                      names=[*cid, "checked", "violations", "first_at"])
                yield out.filter(pa.array(checked > 0))

    schema = ", ".join([*[f"`{k}` {cuts.schema[k].dataType.simpleString()}" for k in cid], counted])
    return cuts.mapInArrow(run, schema)
