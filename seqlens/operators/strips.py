"""Long strips given as one row per pixel row: gutters, slices, cuts, edges.

rows: (keys, y, rmin, rmax, rmean, ink), y dense from 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from seqlens.plans.batches import fold_groups
from seqlens.plans.ranges import interval_join
from seqlens.plans.scan import islands, ordinal_block, scan
from seqlens.session import cut_lineage

# Gutter, slice, cut and edge limits.
WHITE, BLACK, FLAT = 245, 12, 8
MIN_SLICE, MAX_SLICE = 220, 2600
SOFT_CAP, CLEAN_INK, INK_CEIL = 1.25, 0.20, 0.55
CUT_LAMBDA, INK_WEIGHT = 4.0, 120.0
CUT_PAD = 16
OVER_TALL, SNAP_SPREAD, SNAP_GAP, SNAP_PAD = 1.5, 40, 8, 4
STOP, INK, EDGE = 0, 1, 2


def is_gutter() -> Column:
    """A row without artwork: near white, near black or one flat colour."""
    c = F.col
    return (c("rmin") >= WHITE) | (c("rmean") >= WHITE) | (c("rmax") <= BLACK) | (c("rmax") - c("rmin") <= FLAT)


def _heights(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg((F.max("y") + 1).cast("bigint").alias("height"))


def content_runs(rows: DataFrame, keys: Sequence[str], min_gap: int | None = None) -> DataFrame:
    """W13, first half: (keys, y0, y1) of content between gutters of min_gap rows or more.

    The gap defaults to max(12, min(⌊0.006 h⌋, 28)) per strip. A run that reaches the
    end without a full gutter takes the rest of the strip; runs of 4 rows or less vanish.
    """
    keys = list(keys)
    gap = F.lit(min_gap) if min_gap is not None else F.greatest(
        F.lit(12), F.least(F.floor(F.col("height") * 0.006), F.lit(28)))
    sizes = _heights(rows, keys).withColumn("gap", gap.cast("bigint"))
    # rows join at the least gap first, so that only runs have to know their strip's
    least = F.lit(12 if min_gap is None else min_gap)
    ink = rows.filter(~is_gutter()).select(*keys, "y")
    close = islands(
        ink, keys, ["y"], ordinal_block("y"), watch={"y": F.col("y")}, same=lambda p, c: c("y") - p("y") - 1 < least,
        aggs={"y0": ("min", F.col("y")), "y1": ("max", F.col("y") + 1)},
    ).join(sizes, keys)
    runs = close if min_gap is not None else islands(
        close, keys, ["y0"], ordinal_block("y0"), watch={"y0": F.col("y0"), "y1": F.col("y1"), "gap": F.col("gap")},
        same=lambda p, c: c("y0") - p("y1") < c("gap"),
        aggs={"y0": ("min", F.col("y0")), "y1": ("max", F.col("y1")), "height": ("max", F.col("height")), "gap": ("max", F.col("gap"))},
    )
    end = F.when(F.col("height") - F.col("y1") < F.col("gap"), F.col("height")).otherwise(F.col("y1"))
    return runs.select(*keys, "y0", end.alias("y1")).filter("y1 - y0 > 4")


def gutter_segments(runs: DataFrame, keys: Sequence[str], min_slice: int = MIN_SLICE) -> DataFrame:
    """W13, second half: short slices join the nearer neighbour, the upper on ties.

    Working downward, a slice long enough by itself ends every open decision above
    it, so a strip falls into independent stretches that each start with a long
    slice; a stretch is folded over its few short slices. Remaining slivers vanish.
    """
    keys = list(keys)
    long = F.col("y1") - F.col("y0") >= min_slice
    runs = cut_lineage(runs)
    rows = scan(
        runs, keys, ["y0"], ordinal_block("y0"), nxt={"__next": F.col("y0")}, running={"part": F.when(long, 1).otherwise(0)},
    ).withColumn("gap_next", F.col("__next") - F.col("y1"))
    one = F.struct(F.col("y0"), F.col("y1"), F.col("gap_next"), long.alias("long"))
    parts = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(one)).alias("s"), F.max_by("gap_next", "y0").alias("gap_last"))
    piece = "struct<y0:bigint,y1:bigint>"
    none = F.lit(None).cast(piece)

    def step(st: Column, x: Column) -> Column:
        cur = F.struct(F.coalesce(st["cur"]["y0"], x["y0"]).cast("bigint").alias("y0"), x["y1"].cast("bigint").alias("y1"))
        done = st["done"]
        n = F.size(done)
        above = cur["y0"] - F.element_at(done, F.greatest(n, F.lit(1)))["y1"]
        full = cur["y1"] - cur["y0"] >= min_slice
        up = (n > 0) & (x["gap_next"].isNull() | (above <= x["gap_next"]))  # null: there is no next slice
        top = F.element_at(done, F.greatest(n, F.lit(1)))
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.struct(top["y0"].alias("y0"), cur["y1"].alias("y1"))))
        return F.struct(
            F.when(full, F.concat(done, F.array(cur))).when(up, grown).otherwise(done).alias("done"),
            F.when(full | up, none).otherwise(cur).alias("cur"),
        )

    start = F.struct(F.array().cast(f"array<{piece}>").alias("done"), none.alias("cur"))
    folded = parts.select(*keys, "part", "gap_last", F.aggregate("s", start, step).alias("f"))
    # an open slice at the end of a stretch joins the long slice that opens the next one
    carry = scan(
        folded.withColumn("open", F.when(F.col("gap_last").isNotNull(), F.col("f.cur.y0"))),
        keys, ["part"], ordinal_block("part"), prev={"carry": F.col("open")},
    )
    closing = F.when(F.col("gap_last").isNull() & F.col("f.cur").isNotNull(), F.array("f.cur")).otherwise(F.array().cast(f"array<{piece}>"))
    slices = carry.select(*keys, "carry", F.posexplode(F.concat("f.done", closing)).alias("i", "p"))
    y0 = F.when((F.col("i") == 0) & F.col("carry").isNotNull(), F.col("carry")).otherwise(F.col("p.y0"))
    floor = max(48, min_slice // 4)
    return slices.select(*keys, y0.alias("y0"), F.col("p.y1").alias("y1")).filter(F.col("y1") - F.col("y0") >= floor)


def row_energy(rows: DataFrame, keys: Sequence[str], boxes: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """Cut measures per row: mean spread of the nine rows around it, Laplacian of the
    mean, ink, and whether a padded text box forbids a cut there.

    Rows near a block's edge are copied to the neighbour block, so the nine-row
    frame never needs the whole strip in one task; boxes are listed in every block they
    cover and lie in the same window as the rows. boxes: (keys, box_y0, box_y1).
    """
    keys = list(keys)
    y = F.col("y")
    home = F.floor(y / block).cast("bigint")
    inside = y - home * block
    places = F.array_compact(F.array(home, F.when(inside < 4, home - 1), F.when(inside >= block - 4, home + 1)))
    spread = rows.select(*keys, "y", "rmean", "ink", (F.col("rmax") - F.col("rmin")).cast("double").alias("spread"), home.alias("home"),
                         F.explode(places).alias("cell"))
    if boxes is not None:
        spans = boxes.select(*keys, (F.col("box_y0") - CUT_PAD).cast("bigint").alias("y"), (F.col("box_y1") + CUT_PAD - 1).cast("bigint").alias("until"))
        cells = F.sequence(F.floor(F.col("y") / block).cast("bigint"), F.floor(F.col("until") / block).cast("bigint"))
        spans = spans.filter("until >= y").withColumn("cell", F.explode(cells))
        spread = spread.withColumn("y", y.cast("bigint")).unionByName(spans, allowMissingColumns=True)
    # frames go by y, so boxes between the rows change nothing but the farthest end above
    near = Window.partitionBy(*keys, "cell").orderBy("y")
    nine = near.rangeBetween(-4, 4)
    up, down = F.sum("rmean").over(near.rangeBetween(-1, -1)), F.sum("rmean").over(near.rangeBetween(1, 1))
    covered = F.lit(False) if boxes is None else F.coalesce(F.max("until").over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow)) >= y, F.lit(False))
    return spread.withColumns({
        "mean9": F.avg("spread").over(nine), "n9": F.count("home").over(nine),
        "lap": F.coalesce(2 * F.col("rmean") - up - down, F.lit(0.0)), "forbidden": covered,
    }).filter("cell = home").select(*keys, "y", "rmean", "ink", "spread", "mean9", "n9", "lap", "forbidden")


#: Rows, in times the soft cap, of one slice that a round reads.
CUT_ROWS = 32


def forced_cuts(slices: DataFrame, energy: DataFrame, keys: Sequence[str], max_slice: int = MAX_SLICE, guard: bool = True, stretch: int = CUT_ROWS) -> DataFrame:
    """Cut slices above ``max_slice`` at their flattest legal row, top down.

    One round cuts every over-tall slice of every strip as often as ``stretch`` times 1.25 · max_slice of its
    rows allow, in numpy; rounds go on with the lower parts until all fit.
    Ladder: band, widened down, widened up, with the ink ceiling and then without;
    finally the flattest row of the band.
    """
    keys = list(keys)
    soft = int(max_slice * SOFT_CAP)
    reach = stretch * soft
    fits = F.col("y1") - F.col("y0") <= max_slice
    tall = slices.select(*keys, F.col("y0").cast("bigint").alias("y0"), F.col("y1").cast("bigint").alias("y1"))
    done = [tall.filter(fits)]
    live = cut_lineage(tall.filter(~fits))
    if live.isEmpty():
        return done[0]
    energy = cut_lineage(energy.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("mean9").cast("double").alias("mean9"),
                                       F.col("lap").cast("double").alias("lap"), F.col("ink").cast("double").alias("ink"), "forbidden"))
    schema = StructType([*live.schema.fields, StructField("open", BooleanType())])

    def fold(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ends = np.append(starts[1:], len(table))
        col = {n: table.column(n).to_numpy() for n in ("y0", "y1", "y", "mean9", "lap", "ink", "forbidden")}
        # a measure that is missing comes before all others
        flat = np.where(np.isnan(col["mean9"]), -np.inf, col["mean9"])
        calm = col["mean9"] - CUT_LAMBDA * col["lap"]
        calm, inked = [np.where(np.isnan(e), -np.inf, e) for e in (calm, calm + INK_WEIGHT * col["ink"])]
        row, top, bottom, more = [], [], [], []
        for at, (a, b) in enumerate(zip(starts, ends, strict=True)):
            y0, y1 = int(col["y0"][a]), int(col["y1"][a])
            read = min(y1, y0 + reach)
            while True:
                part = y1 - y0 <= max_slice
                if part or min(y0 + soft, y1) > read:
                    cut = y1
                else:
                    cut = _cut(y0, y1, max_slice, col["y"][a:b], flat[a:b], calm[a:b], inked[a:b], col["ink"][a:b], col["forbidden"][a:b], guard)
                    part = True
                row.append(at)
                top.append(y0)
                bottom.append(cut)
                more.append(not part)
                if cut == y1:
                    break
                y0 = cut
        out = table.select(keys).take(pa.array(starts[row]))
        for name, values in (("y0", np.array(top, np.int64)), ("y1", np.array(bottom, np.int64)), ("open", np.array(more, bool))):
            out = out.append_column(name, pa.array(values))
        return out

    while True:
        spans = live.withColumn("reach", F.least(F.col("y1"), F.col("y0") + reach))
        near = interval_join(spans, energy.withColumn("y_end", F.col("y")), keys, ("y0", "reach"), ("y", "y_end"), 4096.0).drop("y_end", "reach")
        turned = cut_lineage(fold_groups(near, [*keys, "y0", "y1"], ["y"], fold, schema))
        done.append(turned.filter("NOT open").drop("open"))
        live = turned.filter("open").drop("open")
        if live.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _cut(
    y0: int, y1: int, max_slice: int, y: np.ndarray, flat: np.ndarray, calm: np.ndarray, inked: np.ndarray, ink: np.ndarray, forbidden: np.ndarray, guard: bool,
) -> int:
    """Row at which the slice from y0 is cut; y1 if it is left whole."""
    tall, soft = y1 - y0, int(max_slice * SOFT_CAP)
    lo, hi, reach = y0 + min(int(np.floor(tall * 0.35)), int(max_slice * 0.5)), y0 + min(int(np.floor(tall * 0.75)), max_slice), y0 + min(tall, soft)

    def least(e: np.ndarray, a: int, b: int, ok: np.ndarray | None) -> int | None:
        a, b = np.searchsorted(y, [max(a, y0), min(b, reach) + 1])
        spots = np.arange(a, b) if ok is None else a + np.flatnonzero(ok[a:b])
        return int(spots[e[spots].argmin()]) if len(spots) else None

    for use_ink in (True, False) if guard else ():
        ok = ~forbidden & (ink <= INK_CEIL) if use_ink else ~forbidden
        for a, b in ((lo, hi), (lo, reach), (y0 + int(max_slice * 0.25), reach)):
            a, b = max(a, y0 + 9), min(b, y1 - 9)
            best = least(inked if use_ink else calm, a + 4, b - 6, ok) if b - a >= 9 else None
            if best is not None:
                return y1 if tall <= soft and ink[best] > CLEAN_INK else int(y[best])
    best = least(flat, lo + 4, hi - 6, None)
    return lo if best is None else int(y[best])


def snap_edges(slices: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over-tall slices grow over inky gutter rows beside them.

    Marks may be up to eight empty rows apart, content rows and the neighbour slice
    stop the walk, and four rows of margin are added. Lower edges are settled first;
    upper edges then stop at the neighbour's new lower edge, as in a downward pass.
    """
    keys = list(keys)
    slices = cut_lineage(slices.select(*keys, "y0", "y1"))
    sums = slices.groupBy(*keys).agg(F.median(F.col("y1") - F.col("y0")).alias("med"), F.count(F.lit(1)).alias("n"))
    heights = _heights(rows, keys)
    base = scan(slices, keys, ["y0"], ordinal_block("y0"), nxt={"ceil": F.col("y0")}).join(sums, keys).join(heights, keys)
    base = base.withColumns({
        "tall": (F.col("y1") - F.col("y0") > F.col("med") * OVER_TALL) & (F.col("n") > 1), "ceil": F.coalesce("ceil", "height"),
    })
    base = cut_lineage(base.select(*keys, "y0", "y1", "tall", "ceil"))
    # a walk stays between a tall slice and its neighbours, so only marks there matter
    sides = scan(base, keys, ["y0"], ordinal_block("y0"), prev={"above": F.col("y1")}, nxt={"below": F.col("tall")})
    gaps = sides.select(*keys, F.explode(F.array(
        F.struct(F.col("y1").alias("a"), F.col("ceil").alias("b"), (F.col("tall") | F.coalesce("below", F.lit(False))).alias("near")),
        F.struct(F.lit(0).cast("bigint").alias("a"), F.col("y0").alias("b"), (F.col("tall") & F.col("above").isNull()).alias("near")))).alias("e"))
    gaps = gaps.filter("e.near AND e.b > e.a").select(*keys, F.explode(F.sequence(F.col("e.a"), F.col("e.b") - 1)).alias("y"))
    marks = rows.select(
        *keys, F.col("y").cast("bigint").alias("y"), F.when(~is_gutter(), STOP).when(F.col("rmax") - F.col("rmin") > SNAP_SPREAD, INK).alias("kind"),
    ).filter("kind IS NOT NULL")
    marks = cut_lineage(marks.join(gaps, [*keys, "y"]))

    def walk(edges: DataFrame, stops: DataFrame, sign: int) -> DataFrame:
        """Farthest chained mark from each edge: (keys, edge, reach)."""
        spots = edges.select(*keys, F.col("edge").alias("y"), F.lit(EDGE).alias("kind"), F.lit(0).alias("rank")).unionByName(
            stops.select(*keys, F.col("stop").alias("y"), F.lit(STOP).alias("kind"), F.lit(1).alias("rank"))
        ).unionByName(marks.withColumn("rank", F.lit(2)))
        spots = spots.withColumn("v", F.col("y") * sign)
        # at one position a boundary comes before the row itself; an edge after everything
        spots = spots.withColumn("rank", F.when(F.col("kind") == EDGE, 3).otherwise(F.col("rank")))
        runs = islands(
            spots, keys, ["v", "rank"], ordinal_block("v"), watch={"v": F.col("v"), "kind": F.col("kind")},
            same=lambda p, c: (c("kind") == INK) & p("kind").isin(INK, EDGE) & (c("v") - p("v") <= SNAP_GAP + 1),
            aggs={"head": ("first", F.col("kind")), "from": ("min", F.col("v")), "to": ("max", F.col("v"))},
        )
        return runs.filter((F.col("head") == EDGE) & (F.col("to") > F.col("from"))).select(
            *keys, (F.col("from") * sign).alias("edge"), (F.col("to") * sign).alias("reach"))

    tall = base.filter("tall")
    down = walk(tall.select(*keys, (F.col("y1") - 1).alias("edge")), base.select(*keys, F.col("ceil").alias("stop")), 1)
    lower = base.join(down.select(*keys, (F.col("edge") + 1).alias("y1"), F.col("reach").alias("low")), [*keys, "y1"], "left")
    lower = lower.withColumn("z", F.when(F.col("low").isNull(), F.col("y1")).otherwise(F.least("ceil", F.col("low") + 1 + SNAP_PAD)))
    lower = cut_lineage(scan(lower.select(*keys, "y0", "z", "tall"), keys, ["y0"], ordinal_block("y0"), prev={"floor": F.col("z")}).withColumn(
        "floor", F.coalesce("floor", F.lit(0)).cast("bigint")))
    up = walk(lower.filter("tall").select(*keys, F.col("y0").alias("edge")), lower.select(*keys, (F.col("floor") - 1).alias("stop")), -1)
    upper = lower.join(up.select(*keys, F.col("edge").alias("y0"), F.col("reach").alias("high")), [*keys, "y0"], "left")
    return upper.select(*keys, F.when(F.col("high").isNull(), F.col("y0")).otherwise(F.greatest("floor", F.col("high") - SNAP_PAD)).alias("y0"), F.col("z").alias("y1"))


def cut_box_audit(units: DataFrame, rows: DataFrame, boxes: DataFrame, keys: Sequence[str], pad: int = 0) -> DataFrame:
    """Faults of a finished split: (keys, unit, y, fault).

    units: (keys, unit, y, h); boxes: (keys, box_y0, box_y1). A forced cut is the start
    of any but the first unit without a gutter row within two rows. It is bad inside
    a text box (text) or on a row with much ink (art). An over-tall unit is bad where
    an inky gutter row lies within five rows outside an edge (top, bottom).
    """
    keys = list(keys)
    units = cut_lineage(units.select(*keys, "unit", "y", "h"))
    head = units.groupBy(*keys).agg(F.min_by("unit", F.struct("y", "unit")).alias("unit"))
    inner = units.join(head, [*keys, "unit"], "left_anti").select(*keys, "unit", F.col("y").alias("cut"))
    marked = cut_lineage(rows.select(*keys, F.col("y"), is_gutter().alias("gutter"), "ink", (F.col("rmax") - F.col("rmin")).alias("spread")))
    around = inner.withColumn("y", F.explode(F.sequence(F.col("cut") - 2, F.col("cut") + 2)))
    natural = around.join(marked.filter("gutter").select(*keys, "y"), [*keys, "y"], "left_semi").select(*keys, "unit").distinct()
    forced = cut_lineage(inner.join(natural, [*keys, "unit"], "left_anti"))
    spots = forced.withColumns({"c0": F.col("cut"), "c1": F.col("cut")})
    spans = boxes.select(*keys, (F.col("box_y0") - pad).alias("b0"), (F.col("box_y1") + pad).alias("b1"))
    text = interval_join(spots, spans, keys, ("c0", "c1"), ("b0", "b1"), 256.0).filter("b0 < cut AND cut < b1").select(
        *keys, "unit", F.col("cut").alias("y"), F.lit("text").alias("fault")).distinct()
    art = forced.join(marked.select(*keys, F.col("y").alias("cut"), "ink"), [*keys, "cut"]).filter(F.col("ink") > INK_CEIL).select(
        *keys, "unit", F.col("cut").alias("y"), F.lit("art").alias("fault"))
    med = units.groupBy(*keys).agg(F.median("h").alias("med"))
    tall = units.join(med, keys).filter(F.col("h") > F.col("med") * OVER_TALL)
    bottom = F.col("y") + F.col("h")
    reach = SNAP_PAD + 1
    out = [F.struct(F.lit("top").alias("fault"), (F.col("y") - F.lit(i)).alias("r")) for i in range(1, reach + 1)]
    out += [F.struct(F.lit("bottom").alias("fault"), (bottom + F.lit(i)).alias("r")) for i in range(0, reach + 1)]
    edge = tall.select(*keys, "unit", F.explode(F.array(*out)).alias("e")).select(*keys, "unit", "e.fault", F.col("e.r").alias("y"))
    edge = edge.filter("fault = 'bottom' OR y > 0")
    inky = marked.filter(F.col("gutter") & (F.col("spread") > SNAP_SPREAD)).select(*keys, "y")
    hit = edge.join(inky, [*keys, "y"]).groupBy(*keys, "unit", "fault").agg(
        F.when(F.first("fault") == "top", F.max("y")).otherwise(F.min("y")).alias("y"))
    return text.unionByName(art).unionByName(hit.select(*keys, "unit", "y", "fault"))
