"""Interval and box joins through bins instead of nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(
        F.floor(lo / F.lit(float(width))).cast("bigint"), F.floor(hi / F.lit(float(width))).cast("bigint")
    )


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
    how: str = "inner",
) -> DataFrame:
    """Pairs whose closed spans touch, matched on ``keys`` plus a bin.

    Both sides are listed in every bin their span covers; a pair is kept only in
    the first bin it shares, so no distinct is needed. Column names other than
    ``keys`` must differ between the sides. Callers add the exact predicate.
    Pick ``width`` near the usual span length: a row is copied span/width+1 times.
    """
    keys = list(keys)
    a0, a1 = left_span
    b0, b1 = right_span
    lhs = left.withColumn("__bin", F.explode(_bins(F.col(a0), F.col(a1), width)))
    rhs = right.withColumn("__bin", F.explode(_bins(F.col(b0), F.col(b1), width)))
    joined = lhs.join(rhs, [*keys, "__bin"], how)
    first = F.floor(F.greatest(F.col(a0), F.col(b0)) / F.lit(float(width))).cast("bigint")
    return joined.filter((F.col("__bin") == first) & (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1))).drop(
        "__bin"
    )


def box_pairs(boxes: DataFrame, keys: Sequence[str], box_id: str, width: float, grow: float = 0.0, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b), a < b, of boxes x, y, w, h whose rectangles touch.

    Each box is listed in every grid cell it covers; a pair is kept only in the
    first cell it shares. ``grow`` pads each rectangle on all sides; ``carry`` names more columns for the struct of a box.
    """
    keys = list(keys)
    g = F.lit(float(grow))
    cell = boxes.select(
        *keys,
        F.col(box_id).alias("id"),
        F.struct("x", "y", "w", "h", *carry).alias("box"),
        (F.col("x") - g).cast("double").alias("x0"),
        (F.col("y") - g).cast("double").alias("y0"),
        (F.col("x") + F.col("w") + g).cast("double").alias("x1"),
        (F.col("y") + F.col("h") + g).cast("double").alias("y1"),
    )
    cell = cell.withColumn("cx", F.explode(_bins(F.col("x0"), F.col("x1"), width)))
    cell = cell.withColumn("cy", F.explode(_bins(F.col("y0"), F.col("y1"), width)))
    values = ["id", "box", "x0", "y0", "x1", "y1"]
    a = cell.select(*keys, "cx", "cy", *[F.col(v).alias(f"{v}_a") for v in values])
    b = cell.select(*keys, "cx", "cy", *[F.col(v).alias(f"{v}_b") for v in values])
    pair = a.join(b, [*keys, "cx", "cy"])
    w = F.lit(float(width))
    pair = pair.filter(
        (F.col("id_a") < F.col("id_b"))
        & (F.col("x0_a") <= F.col("x1_b")) & (F.col("x0_b") <= F.col("x1_a"))
        & (F.col("y0_a") <= F.col("y1_b")) & (F.col("y0_b") <= F.col("y1_a"))
        & (F.col("cx") == F.floor(F.greatest("x0_a", "x0_b") / w))
        & (F.col("cy") == F.floor(F.greatest("y0_a", "y0_b") / w))
    )
    return pair.select(*keys, "id_a", "id_b", "box_a", "box_b")
