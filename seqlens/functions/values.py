"""Numbers, votes, time stamps, boxes and lenient JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_votes(votes: str | Column) -> tuple[Column, Column]:
    """(k, n) of a "k/n" string; anything else counts as one of one."""
    text = F.coalesce(_c(votes), F.lit(""))
    ok = text.rlike(r"^\s*[+-]?\d{1,9}\s*/\s*[+-]?\d{1,9}\s*$")
    parts = F.split(text, "/")
    k = F.when(ok, F.trim(parts[0]).cast("int")).otherwise(F.lit(1))
    n = F.when(ok, F.trim(F.get(parts, 1)).try_cast("int")).otherwise(F.lit(1))
    return k, n


def time_key(t: str | Column) -> Column:
    """Three-decimal text key of a time."""
    return F.format_string("%.3f", _c(t))


def minutes_seconds(t: str | Column) -> Column:
    """m:ss of a time in seconds."""
    whole = F.floor(_c(t)).cast("bigint")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("bigint"), (whole % 60).cast("bigint"))


def subtitle_time(t: str | Column) -> Column:
    """h:mm:ss.cc with half-even rounding to centiseconds."""
    cs = F.bround(_c(t) * 100).cast("bigint")
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(cs / 360000).cast("bigint"),
        (F.floor(cs / 6000) % 60).cast("bigint"),
        (F.floor(cs / 100) % 60).cast("bigint"),
        cs % 100,
    )


def srt_time(t: str | Column) -> Column:
    """hh:mm:ss,mmm with half-even rounding to milliseconds."""
    ms = F.bround(_c(t) * 1000).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3600000).cast("bigint"),
        (F.floor(ms / 60000) % 60).cast("bigint"),
        (F.floor(ms / 1000) % 60).cast("bigint"),
        ms % 1000,
    )


def chapter_number(label: str | Column) -> Column:
    """Numeric chapter label as double, else null."""
    text = F.trim(_c(label).cast("string"))
    return F.when(text.rlike(r"^-?\d+(\.\d*)?$"), text.try_cast("double"))


def chapter_label(label: str | Column) -> Column:
    """Canonical chapter label: 3.0 becomes 3, text stays as it is."""
    text = _c(label).cast("string")
    number = F.trim(text).try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number))
    return F.when(whole, F.floor(number).cast("bigint").cast("string")).when(
        number.isNotNull(), number.cast("string")
    ).otherwise(text)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length shared by two spans, negative when apart."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def box_intersection(a: Column, b: Column, plus: float = 0.0) -> Column:
    """Area shared by two boxes; ``plus`` is 1 for inclusive pixel edges."""
    w = overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) + F.lit(plus)
    h = overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"]) + F.lit(plus)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column, plus: float = 0.0) -> Column:
    """Intersection over union of two boxes."""
    inter = box_intersection(a, b, plus)
    area = lambda r: (r["w"] + F.lit(plus)) * (r["h"] + F.lit(plus))
    return inter / (area(a) + area(b) - inter)


def dice(inter: Column, a: Column, b: Column) -> Column:
    """Dice coefficient of two masks from their counts."""
    return F.lit(2.0) * inter / F.greatest(a + b, F.lit(1))


def smoothstep(s: Column) -> Column:
    """s²(3 − 2s) on [0, 1]."""
    c = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    return c * c * (F.lit(3.0) - F.lit(2.0) * c)


def strip_fence(text: str | Column) -> Column:
    """Text without a surrounding Markdown code fence."""
    bare = F.regexp_replace(F.trim(_c(text)), r"^```(?:json)?\s*", "")
    return F.trim(F.regexp_replace(bare, r"\s*```$", ""))


def lenient_json(text: str | Column, schema: str, array: bool = True) -> Column:
    """Parse JSON that may be fenced or surrounded by prose; null when hopeless."""
    bare = strip_fence(text)
    span = r"(?s)(\[.*\])" if array else r"(?s)(\{.*\})"
    options = {"mode": "PERMISSIVE"}
    return F.coalesce(
        F.from_json(bare, schema, options), F.from_json(F.regexp_extract(bare, span, 1), schema, options)
    )


def format_label(country: str | Column) -> Column:
    """Usual word for the work's origin."""
    col = _c(country)
    # Origin to format.
    return F.when(col == "JP", "manga").when(col == "KR", "manhwa").when(col == "CN", "manhua").otherwise(col)


def upper_median(value: str) -> Column:
    """Element n div 2 (0-based) of the ascending values, mergeable across tasks."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")
