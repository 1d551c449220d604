"""Writers: reports, captions, sidecars and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.functions.values import minutes_seconds, srt_time, subtitle_time
from seqlens.operators.review import severity_rank
from seqlens.plans.scan import scan

#: Captions of this many seconds are numbered by one task.
BLOCK_SECONDS = 3600


def report_lines(faults: DataFrame) -> DataFrame:
    """Faults with their sort rank and one readable line each."""
    scene = F.when(F.col("scene").isNull(), "").otherwise(F.concat(F.lit(" scene "), F.col("scene").cast("string")))
    item = F.lit("")
    if "item" in faults.columns:
        item = F.when(F.coalesce("item", F.lit("")) == "", "").otherwise(F.concat(F.lit(" ["), F.col("item"), F.lit("]")))
    t = F.coalesce("t", F.lit(0.0))
    line = F.concat(
        F.lit("- ["), F.upper("severity"), F.lit("] "), minutes_seconds(t), scene, item, F.lit(" "), F.col("type"),
        F.lit(": "), F.coalesce("detail", F.lit("")),
    )
    return faults.withColumns({"severity_rank": severity_rank(F.col("severity")), "line": line})


def write_report(faults: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Per-group JSON and text files sorted by severity then time; returns the counts.

    Rows are range-partitioned by (group, rank, time), so a huge group becomes
    several ordered files instead of one task.
    """
    keys = list(keys)
    rows = report_lines(faults).withColumn("__t", F.coalesce("t", F.lit(0.0)))
    order = [*keys, "severity_rank", "__t"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.drop("__t", "line").write.mode("overwrite").partitionBy(*keys).json(f"{path}/json")
    ordered.select(*keys, "line").write.mode("overwrite").partitionBy(*keys).text(f"{path}/text")
    return faults.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium")
    )


def caption_events(captions: DataFrame, style: str = "Kinetic") -> DataFrame:
    """Subtitle event lines of timed captions (start, end, text)."""
    return captions.withColumns({
        "ass": F.concat(F.lit("Dialogue: 0,"), subtitle_time("start"), F.lit(","), subtitle_time("end"),
                        F.lit(f",{style},,0,0,0,,"), F.col("text")),
        "srt": F.concat(srt_time("start"), F.lit(" --> "), srt_time("end"), F.lit("\n"), F.col("text")),
    })


# The format lines of an ASS file and its caption style.
ASS_HEADER = (
    "[Script Info]", "ScriptType: v4.00+", "PlayResX: 1920", "PlayResY: 1080", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "",
    "[V4+ Styles]",
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, "
    "ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
    "Style: {style},{font},{size},&H00FFFFFF,&H00FFFFFF,&H00000000,&H00000000,1,0,0,0,100,100,0,0,1,{outline},2,2,60,60,{margin},1", "",
    "[Events]",
    "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
)


def caption_lines(
    captions: DataFrame, keys: Sequence[str], style: str = "Kinetic", font: str = "Arial Black", vertical: bool = False,
) -> DataFrame:
    """The lines of each group's caption files: (keys, kind, line, text), kind ass or srt.

    An ASS file opens with its header; SRT blocks are numbered from one in time order and end with a blank line.
    """
    keys = list(keys)
    look = {"size": 110, "outline": 6, "margin": 470} if vertical else {"size": 76, "outline": 5, "margin": 300}
    numbered = scan(
        caption_events(captions, style).withColumn("__at", F.col("start").cast("double")), keys, ["__at", "end", "text"],
        F.floor(F.col("__at") / BLOCK_SECONDS), number="n")
    head = F.array(*[F.lit(h.format(style=style, font=font, **look)) for h in ASS_HEADER])
    opening = captions.select(*keys).distinct().select(*keys, F.posexplode(head).alias("at", "text")).select(
        *keys, F.lit("ass").alias("kind"), (F.col("at") - len(ASS_HEADER)).cast("bigint").alias("line"), "text")
    block = F.concat((F.col("n") + 1).cast("string"), F.lit("\n"), F.col("srt"), F.lit("\n"))
    body = numbered.select(*keys, F.col("n").cast("bigint").alias("line"), F.explode(F.array(
        F.struct(F.lit("ass").alias("kind"), F.col("ass").alias("text")), F.struct(F.lit("srt").alias("kind"), block.alias("text")),
    )).alias("c")).select(*keys, "c.kind", "line", "c.text")
    return opening.unionByName(body)


def write_captions(captions: DataFrame, keys: Sequence[str], path: str, style: str = "Kinetic") -> None:
    """One folder per group and kind, its parts in time order; one after another they are the file."""
    order = [*keys, "kind", "line"]
    caption_lines(captions, keys, style).repartitionByRange(*order).sortWithinPartitions(*order).select(
        *keys, "kind", "text").write.mode("overwrite").partitionBy(*keys, "kind").text(path)


def write_documents(documents: DataFrame, keys: Sequence[str], column: str, path: str) -> None:
    """One JSON document per row, foldered by group."""
    documents.select(*keys, column).write.mode("overwrite").partitionBy(*keys).text(path)


def overwrite_groups(rows: DataFrame, keys: Sequence[str], path: str) -> None:
    """Replace only the groups present in ``rows`` (dynamic partition overwrite)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def sidecar_document(sidecar: DataFrame, keys: Sequence[str], window: float) -> DataFrame:
    """One JSON sidecar per group with frames and baseline windows.

    The document lists every fault time of a group, so it grows with the faults
    of one video; the table form is the one to use for joins.
    """
    pairs = lambda value, cond: F.map_from_entries(F.array_compact(F.array_sort(F.collect_list(
        F.when(cond, F.struct(F.col("t_key"), value))))))
    true: Column = F.lit(True)
    return sidecar.groupBy(*keys).agg(
        pairs(F.col("md5"), F.col("md5").isNotNull()).alias("frames"),
        pairs(F.col("window_md5s"), true).alias("baseline_windows"),
    ).select(*keys, F.to_json(F.struct(
        F.lit("benchmark-hash-sidecar/v1").alias("schema"), F.lit(float(window)).alias("hash_window_s"),
        F.col("frames"), F.col("baseline_windows"),
    )).alias("document"))
