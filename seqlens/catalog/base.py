"""Query registry and the logical tables built from the given parquet tables.

``@query`` registers a Spark query; its oracle is plain SQL over the same tables
with the logical tables as common table expressions (``TABLES_SQL``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.plans.scan import blocks_of, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` as query ``name`` with an optional SQL oracle."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the logical tables it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in TABLES_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({TABLES_SQL[n].strip()})" for n in needed)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


TABLES_SQL: dict[str, str] = {
    # every event is one fault of a chapter (= user); five review passes, two arms
    "v_faults": """
        SELECT user_id AS chapter_id,
               CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(hour(ts) // 6 AS INTEGER) END AS scene,
               CAST(day(ts) % 5 AS INTEGER) AS pass, CAST(day(ts) % 3 AS INTEGER) AS pass3,
               event_id AS ord,
               CAST((epoch_us(ts) - 1704067200000000) // 1000 AS DOUBLE) / 1000 AS t,
               CASE WHEN event_type = 'error' THEN 'review_error' ELSE event_type END AS type,
               CASE WHEN value >= 100 THEN 'high' WHEN value >= 40 THEN 'medium'
                    WHEN value >= 5 THEN 'low' ELSE 'dismissed' END AS severity,
               event_type || '#' || CAST(event_id AS VARCHAR) AS detail,
               CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'experiment' END AS arm,
               md5(CAST(user_id AS VARCHAR) || event_type) AS frame_md5
        FROM events""",
    # every order is a chapter, every line a scene of it
    "v_scenes": """
        SELECT l_orderkey AS chapter_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                   l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS scene,
               l_quantity AS dur,
               CASE l_returnflag WHEN 'R' THEN 'hype' WHEN 'N' THEN 'normal' ELSE 'quiet' END AS pace,
               l_linestatus AS ambience, l_partkey AS panel, l_suppkey AS supp,
               l_tax >= 0.06 AS emphasis, CAST(l_linenumber % 4 AS INTEGER) AS n_keywords,
               l_discount < 0.005 AS meta, l_extendedprice AS price, l_discount AS discount
        FROM lineitem""",
    # every conversation is a chapter, every turn one unit with its read text
    "v_reads": """
        SELECT conv_id AS chapter_id, turn AS read_pos, 'p' || lpad(CAST(turn AS VARCHAR), 4, '0') AS panel,
               role, text,
               CASE (conv_id * 3 + turn) % 7 WHEN 0 THEN 'cover' WHEN 1 THEN 'textonly' WHEN 2 THEN 'credits'
                    ELSE 'story' END AS kind,
               CASE length(text) % 4 WHEN 0 THEN 'cut' WHEN 1 THEN 'sparse' ELSE 'ok' END AS quality
        FROM conversations""",
    # scene s shows units 2s, 2s+1 and 2s+2; its narration is the text of unit 2s
    "v_scene_panels": """
        SELECT chapter_id, scene, read_pos - 2 * scene AS ord, panel, read_pos
        FROM (SELECT chapter_id, panel, read_pos,
                     unnest(range(greatest((read_pos - 1) // 2, 0), read_pos // 2 + 1)) AS scene FROM v_reads)""",
    "v_script": """
        SELECT chapter_id, read_pos // 2 AS scene, min_by(text, read_pos) AS narration
        FROM v_reads GROUP BY 1, 2""",
    # every document is a tagged unit of its source
    "v_panels": """
        SELECT source AS chapter_id, d.doc_id AS unit, text, n_chars,
               CASE WHEN toxic = 1 THEN 'cover' WHEN quality = 0 THEN 'textonly' ELSE 'story' END AS kind,
               CASE n_chars % 5 WHEN 0 THEN 'cut' WHEN 1 THEN 'sparse' ELSE 'ok' END AS quality
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # boxes and row spans of the lines of an order
    "v_boxes": """
        SELECT chapter_id, scene AS box_id, CAST(panel % 700 AS DOUBLE) AS x,
               CAST(supp * 37 % 3000 AS DOUBLE) AS y, 20 + dur AS w,
               10 + CAST(round(discount * 500) AS DOUBLE) AS h, price AS score
        FROM v_scenes""",
    # every part is a title
    "v_candidates": """
        SELECT p_partkey AS source_id, p_name AS title, p_brand AS title_alt, [p_type] AS genres, p_type AS genre,
               least(p_size * 2, 100) AS score, p_size * 5 AS chapters,
               CASE WHEN p_partkey % 2 = 0 THEN 'RELEASING' ELSE 'FINISHED' END AS status,
               coalesce(popularity, 0) AS popularity, coalesce(favourites, 0) AS favourites,
               coalesce(trending, 0) AS trending, CAST(p_partkey AS BIGINT) AS ord
        FROM part LEFT JOIN (
            SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS popularity,
                   count(DISTINCT l_suppkey) AS favourites,
                   count(*) FILTER (l_shipdate >= TIMESTAMP '2000-01-01') AS trending
            FROM lineitem GROUP BY 1) s ON s.l_partkey = p_partkey""",
    # every customer is a title, every order a chapter offered for it
    "v_feed": """
        SELECT o_custkey AS title_id, CAST(c AS VARCHAR) AS chapter, CAST(o_totalprice / 20000 AS INTEGER) AS pages,
               CASE WHEN o_orderstatus = 'F' THEN 'external' END AS external_url
        FROM (SELECT *, o_orderkey % 30 + CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE 0 END AS c FROM orders)""",
    # timed words: every word of a unit takes 0.3 s
    "v_words": """
        SELECT chapter_id, scene, pos - 1 AS pos, word, (pos - 1) * 0.5 AS w_start, (pos - 1) * 0.5 + 0.25 AS w_end
        FROM (SELECT chapter_id, scene, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos
              FROM (SELECT chapter_id, scene,
                           list_filter(string_split_regex(narration, '\\s+'), lambda x: x <> '') AS w FROM v_script))""",
    "v_word_scenes": """
        SELECT s.chapter_id, s.scene, s.narration, coalesce(n, 0) * 0.5 + 1.0 AS dur
        FROM v_script s LEFT JOIN (SELECT chapter_id, scene, count(*) AS n FROM v_words GROUP BY 1, 2) w
          ON w.chapter_id = s.chapter_id AND w.scene = s.scene""",
}


class Tables:
    """The given tables and the logical tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def faults(self) -> DataFrame:
        value = F.col("value")
        ts = F.col("ts")
        return self.events.select(
            F.col("user_id").alias("chapter_id"),
            F.when(F.col("event_id") % 50 == 0, None).otherwise(F.floor(F.hour(ts) / 6).cast("int")).alias("scene"),
            (F.dayofmonth(ts) % 5).alias("pass"),
            (F.dayofmonth(ts) % 3).alias("pass3"),
            F.col("event_id").alias("ord"),
            (
                F.floor((F.unix_micros(ts.cast("timestamp")) - 1704067200000000) / 1000).cast("double") / 1000
            ).alias("t"),
            F.when(F.col("event_type") == "error", "review_error").otherwise(F.col("event_type")).alias("type"),
            F.when(value >= 100, "high").when(value >= 40, "medium").when(value >= 5, "low")
            .otherwise("dismissed").alias("severity"),
            F.concat_ws("#", "event_type", F.col("event_id").cast("string")).alias("detail"),
            F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("experiment").alias("arm"),
            F.md5(F.concat(F.col("user_id").cast("string"), F.col("event_type"))).alias("frame_md5"),
        )

    #: What orders the lines of a chapter, by the names of ``lines``.
    LINE_ORDER = ("l_linenumber", "panel", "supp", "l_shipdate", "price", "dur", "discount", "l_tax")

    def lines(self) -> DataFrame:
        """Lines by the names of scenes, not numbered yet."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("chapter_id"), F.col("l_partkey").alias("panel"), F.col("l_suppkey").alias("supp"),
            F.col("l_quantity").alias("dur"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
            F.col("l_linestatus").alias("ambience"), "l_returnflag", "l_linenumber", "l_shipdate", "l_tax",
        )

    def line_blocks(self) -> list[Column]:
        """Blocks of lines along their order; none while all line numbers are below eight."""
        return blocks_of(self.lineitem, F.floor(F.col("l_linenumber") / 8))

    def scenes(self) -> DataFrame:
        return self.as_scenes(scan(self.lines(), ["chapter_id"], self.LINE_ORDER, self.line_blocks(), number="scene"))

    @staticmethod
    def as_scenes(lines: DataFrame, *more: str) -> DataFrame:
        """The columns of scenes, and ``more``, from numbered lines."""
        return lines.select(
            "chapter_id",
            "scene",
            "dur",
            F.when(F.col("l_returnflag") == "R", "hype").when(F.col("l_returnflag") == "N", "normal")
            .otherwise("quiet").alias("pace"),
            "ambience",
            "panel",
            "supp",
            (F.col("l_tax") >= 0.06).alias("emphasis"),
            (F.col("l_linenumber") % 4).cast("int").alias("n_keywords"),
            (F.col("discount") < 0.005).alias("meta"),
            "price",
            "discount",
            *more,
        )

    def reads(self) -> DataFrame:
        tag = (F.col("conv_id") * 3 + F.col("turn")) % 7
        size = F.length("text") % 4
        return self.conversations.select(
            F.col("conv_id").alias("chapter_id"),
            F.col("turn").alias("read_pos"),
            F.concat(F.lit("p"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("panel"),
            "role",
            "text",
            F.when(tag == 0, "cover").when(tag == 1, "textonly").when(tag == 2, "credits")
            .otherwise("story").alias("kind"),
            F.when(size == 0, "cut").when(size == 1, "sparse").otherwise("ok").alias("quality"),
        )

    def full_reads(self) -> DataFrame:
        """Reads in the data model's shape: dialogue list, embedded narration, beat."""
        return self.reads().select(
            "chapter_id", "read_pos", "panel", "kind", "quality",
            F.array(F.struct(F.col("role").alias("speaker"), F.col("text").alias("text"))).alias("dialogue"),
            F.lit("").alias("narration_text"), F.lit("").alias("sfx"), F.col("role").alias("scene_beat"),
        )

    def scene_panels(self) -> DataFrame:
        pos = F.col("read_pos")
        first = F.greatest(F.floor((pos - 1) / 2), F.lit(0)).cast("bigint")
        return self.reads().select(
            "chapter_id", "panel", "read_pos",
            F.explode(F.sequence(first, F.floor(pos / 2).cast("bigint"))).alias("scene"),
        ).select("chapter_id", "scene", (pos - 2 * F.col("scene")).alias("ord"), "panel", "read_pos")

    def script(self) -> DataFrame:
        return self.reads().groupBy("chapter_id", F.floor(F.col("read_pos") / 2).cast("bigint").alias("scene")).agg(
            F.min_by("text", "read_pos").alias("narration")
        )

    def panels(self) -> DataFrame:
        size = F.col("n_chars") % 5
        return self.documents.join(self.labels, "doc_id", "left").select(
            F.col("source").alias("chapter_id"), F.col("doc_id").alias("unit"), "text", "n_chars",
            F.when(F.col("toxic") == 1, "cover").when(F.col("quality") == 0, "textonly")
            .otherwise("story").alias("kind"),
            F.when(size == 0, "cut").when(size == 1, "sparse").otherwise("ok").alias("quality"),
        )

    def boxes(self) -> DataFrame:
        return self.scenes().select(
            "chapter_id", F.col("scene").alias("box_id"),
            (F.col("panel") % 700).cast("double").alias("x"),
            (F.col("supp") * 37 % 3000).cast("double").alias("y"),
            (F.lit(20) + F.col("dur")).alias("w"),
            (F.lit(10) + F.round(F.col("discount") * 500)).alias("h"),
            F.col("price").alias("score"),
        )

    def candidates(self) -> DataFrame:
        stats = self.lineitem.groupBy("l_partkey").agg(
            F.sum("l_quantity").cast("bigint").alias("popularity"),
            F.countDistinct("l_suppkey").alias("favourites"),
            F.count_if(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("trending"),
        )
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
        return self.part.join(stats, F.col("l_partkey") == F.col("p_partkey"), "left").select(
            F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title"),
            F.col("p_brand").alias("title_alt"), F.array("p_type").alias("genres"),
            F.least(F.col("p_size") * 2, F.lit(100)).alias("score"), (F.col("p_size") * 5).alias("chapters"),
            F.when(F.col("p_partkey") % 2 == 0, "RELEASING").otherwise("FINISHED").alias("status"),
            zero("popularity"), zero("favourites"), zero("trending"),
            F.col("p_partkey").alias("ord"),
        )

    def feed(self) -> DataFrame:
        number = F.col("o_orderkey") % 30 + F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
        return self.orders.select(
            F.col("o_custkey").alias("title_id"),
            number.cast("string").alias("chapter"),
            F.bround(F.col("o_totalprice") / 20000).cast("int").alias("pages"),
            F.when(F.col("o_orderstatus") == "F", "external").alias("external_url"),
        )

    def words(self) -> DataFrame:
        split = F.filter(F.split("narration", r"(?U)\s+"), lambda w: w != "")
        return self.script().select("chapter_id", "scene", F.posexplode(split).alias("pos", "word")).select(
            "chapter_id", "scene", F.col("pos").cast("bigint").alias("pos"), "word",
            (F.col("pos") * 0.5).alias("w_start"), (F.col("pos") * 0.5 + 0.25).alias("w_end"),
        )

    def word_scenes(self) -> DataFrame:
        split = F.filter(F.split("narration", r"(?U)\s+"), lambda w: w != "")
        return self.script().withColumn("dur", F.size(split) * 0.5 + 1.0)
