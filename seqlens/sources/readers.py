"""Readers: files and model answers to typed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens import schemas
from seqlens.functions.text import clean_synopsis, natural_key
from seqlens.functions.values import lenient_json, strip_fence
from seqlens.plans.scan import ranked_positions

# Image file endings.
IMAGE_ENDINGS = ("bmp", "gif", "jpeg", "jpg", "png", "webp")


def parse_faults(files: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """Fault rows of JSON documents that are an array or {"faults": array}."""
    text = strip_fence(column)
    rows = F.coalesce(
        F.when(text.startswith("["), F.from_json(text, f"array<{schemas.FAULT}>")),
        F.from_json(text, f"struct<faults:array<{schemas.FAULT}>>")["faults"],
    )
    return files.select(*keys, F.posexplode(rows).alias("file_pos", "f")).select(*keys, "file_pos", "f.*").filter(
        F.coalesce(F.col("type"), F.lit("")) != ""
    )


def read_faults(spark: SparkSession, path: str) -> DataFrame:
    """Every review file below ``path``; the chapter is its folder."""
    files = spark.read.option("wholetext", "true").text(path).withColumn(
        "chapter_id", F.element_at(F.split(F.input_file_name(), "/"), -2)
    )
    return parse_faults(files, ["chapter_id"])


def ingest_ordered_units(
    files: DataFrame, keys: Sequence[str], path: str = "path", endings: Sequence[str] = IMAGE_ENDINGS, tie: Sequence[str] = ()
) -> DataFrame:
    """Number the image files of each group in natural order, from 1.

    Adds ``unit`` (position) and ``unit_name`` (three digits or more plus ending).
    """
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    images = files.withColumn("__end", ending).filter(F.col("__end").isin(*endings))
    placed = ranked_positions(images, keys, [natural_key(path), F.col(path), *tie], "unit")
    number = (F.col("unit") + 1).cast("string")
    wide = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return placed.withColumns({
        "unit": F.col("unit") + 1, "unit_name": F.concat(wide, F.lit("."), F.col("__end"))
    }).drop("__end")


def parse_reads(batches: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S3: align model answers to units by position.

    batches: (keys, batch, answer); units: (keys, batch, pos, panel). Names come
    from ``units``; missing items and unparseable batches give empty reads.
    """
    on = [*keys, "batch"]
    items = batches.select(*on, F.posexplode(lenient_json("answer", f"array<{schemas.READ_ITEM}>")).alias("pos", "item"))
    item = lambda field, default: F.coalesce(F.col(f"item.{field}"), default).alias(field)
    return units.join(items, [*on, "pos"], "left").select(
        *on, "pos", "panel",
        item("dialogue", F.array().cast("array<struct<speaker:string,text:string>>")),
        item("narration_text", F.lit("")), item("sfx", F.lit("")), item("scene_beat", F.lit("")),
        item("kind", F.lit("story")), item("quality", F.lit("ok")),
    )


def parse_script(files: DataFrame, keys: Sequence[str], column: str = "value") -> dict[str, DataFrame]:
    """Script documents to scenes, scene_panels, words, sfx_events and music_plan.

    words are the narration's words in order; their times come with the spoken audio.
    """
    keys = list(keys)
    doc = files.select(*keys, F.from_json(column, schemas.SCRIPT).alias("d"))
    scenes = doc.select(*keys, F.posexplode("d.scenes").alias("scene", "s"))
    listed = F.when(F.size(F.coalesce("s.panels", F.array().cast("array<string>"))) > 0, F.col("s.panels"))
    lone = F.when(F.coalesce(F.col("s.panel"), F.lit("")) != "", F.array("s.panel"))
    panels = scenes.select(*keys, "scene", F.posexplode(F.coalesce(listed, lone)).alias("ord", "ref"))
    fields = ["narration", "caption", "pace", "motion", "ambience", "emphasis", "cta", "keywords"]
    return {
        "scenes": scenes.select(*keys, "scene", *[F.col(f"s.{f}").alias(f) for f in fields]),
        "words": scenes.select(*keys, "scene", F.posexplode(
            F.filter(F.split(F.coalesce("s.narration", F.lit("")), r"\s+"), lambda w: w != "")).alias("pos", "word")),
        "scene_panels": panels.withColumn("panel", F.element_at(F.split("ref", "/"), -1)),
        "sfx_events": scenes.select(*keys, "scene", F.posexplode("s.sfx_events").alias("ord", "e")).select(
            *keys, "scene", "ord", "e.*"
        ),
        "music_plan": doc.select(*keys, F.posexplode("d.music_plan").alias("ord", "m")).select(*keys, "ord", "m.*"),
    }


def parse_blocklist(lines: DataFrame, column: str = "value") -> DataFrame:
    """(artist, title), lower case, of "Artist — Title" lines; # starts a comment."""
    line = F.trim(F.col(column))
    parts = F.split(line, r"\s+[—–-]\s+", 2)
    return lines.filter((line != "") & ~line.startswith("#") & (F.size(parts) == 2)).select(
        F.lower(F.trim(parts[0])).alias("artist"), F.lower(F.trim(F.get(parts, 1))).alias("title")
    ).distinct()


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocklist(spark.read.text(path))


def _filled(*cols: Column) -> Column:
    """First non-blank string."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def load_candidates(primary: DataFrame, fallback: DataFrame, include_adult: bool = False) -> DataFrame:
    """Candidates of the primary catalog; the fallback only when it is empty.

    The emptiness test is a one-row scalar subquery inside the plan, so there is
    no driver branch. Fallback rows need ``rank`` (0-based list position).
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    genres = F.coalesce("genres", F.array().cast("array<string>"))
    adult = F.coalesce(F.col("is_adult"), F.lit(False))
    first = primary.filter(F.lit(include_adult) | ~adult).select(
        "source_id",
        F.coalesce(_filled(F.col("english"), F.col("romaji"), F.col("native")), F.lit("?")).alias("title"),
        F.coalesce(_filled(F.col("romaji"), F.col("native")), F.lit("")).alias("title_alt"),
        zero("trending").alias("trending"), zero("popularity").alias("popularity"),
        zero("favourites").alias("favourites"), zero("average_score").alias("score"), "chapters",
        text("status").alias("status"), genres.alias("genres"), text("format").alias("format"),
        text("country").alias("country"), adult.alias("is_adult"), clean_synopsis("description").alias("synopsis"),
        F.lit("primary").alias("origin"), F.col("rank").alias("ord"),
    )
    n_fallback = fallback.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_primary = first.agg(F.count(F.lit(1)).alias("n")).scalar()
    second = fallback.filter(n_primary == 0).select(
        F.coalesce("source_id", F.lit(0)).cast("bigint").alias("source_id"),
        F.coalesce(_filled(F.col("title_english"), F.col("title")), F.lit("?")).alias("title"),
        text("title").alias("title_alt"),
        (n_fallback - F.col("rank")).cast("bigint").alias("trending"),
        zero("members").alias("popularity"), zero("favorites").alias("favourites"),
        (F.coalesce("score", F.lit(0.0)) * 10).cast("bigint").alias("score"), "chapters",
        F.replace(F.upper(text("status")), F.lit(" "), F.lit("_")).alias("status"), genres.alias("genres"),
        text("format").alias("format"), F.lit("JP").alias("country"),
        F.coalesce(F.col("rating").contains("Rx"), F.lit(False)).alias("is_adult"),
        clean_synopsis("synopsis").alias("synopsis"), F.lit("fallback").alias("origin"), F.col("rank").alias("ord"),
    )
    return first.unionByName(second)


def incremental_refresh(units: DataFrame, cache: DataFrame, keys: Sequence[str], method: str) -> tuple[DataFrame, DataFrame]:
    """(stale units to recompute, cache rows still valid).

    units: (keys, mtime); a cache row is valid when its mtime differs by less
    than 1e-6 and the same method made it. Rows of units no longer listed stay.
    """
    keys = list(keys)
    seen = units.groupBy(*keys).agg(F.min("mtime").alias("mtime"))
    rows = cache.withColumnsRenamed({"mtime": "__mtime", "method": "__method"})
    both = seen.join(rows.select(*keys, "__mtime", "__method"), keys, "left")
    fresh = (F.abs(F.col("mtime") - F.col("__mtime")) < 1e-6) & (F.col("__method") == method)
    stale = both.filter(~F.coalesce(fresh, F.lit(False))).select(*keys, "mtime")
    return stale, cache.join(stale.select(*keys), keys, "left_anti")
