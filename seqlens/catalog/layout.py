"""Queries on boxes, hashes, page measures and pixel-row strips."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlens.catalog.base import TABLES_SQL, Tables, query
from seqlens.functions.frames import frame_features, mean_hash
from seqlens.operators import layout as G
from seqlens.operators import strips as S
from seqlens.plans.scan import scan
from seqlens.session import cut_lineage

CH = ["chapter_id"]

TABLES_SQL.update({
    # parts are panels, their lines boxes on a 400 x 200 area
    "v_part_boxes": """
        SELECT panel AS chapter_id, chapter_id * 100 + scene AS box_id, CAST(supp * 7 % 400 AS DOUBLE) AS x,
               CAST(chapter_id % 200 AS DOUBLE) AS y, 20 + dur AS w, 10 + CAST(round(discount * 500) AS DOUBLE) AS h, price AS score
        FROM v_scenes""",
    # suppliers are strips: an old and a new unit per line
    "v_old_units": """
        SELECT supp AS chapter_id, chapter_id * 100 + scene AS unit, CAST(panel * 7 % 20000 AS DOUBLE) AS y, 10 + dur AS h FROM v_scenes""",
    "v_new_units": """
        SELECT supp AS chapter_id, chapter_id * 100 + scene AS unit, CAST(chapter_id % 20000 AS DOUBLE) AS y, CAST(5 + dur / 2 AS DOUBLE) AS h FROM v_scenes""",
    "v_overlaps": """
        SELECT o.chapter_id, o.unit AS old, n.unit AS new, n.y AS y, n.h AS nh, least(o.y + o.h, n.y + n.h) - greatest(o.y, n.y) AS ov
        FROM v_old_units o JOIN v_new_units n ON n.chapter_id = o.chapter_id AND n.y < o.y + o.h AND o.y < n.y + n.h""",
    "v_remap": """
        SELECT chapter_id, old, new, y FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, old ORDER BY ov DESC, y, new) AS rn FROM v_overlaps)
        WHERE rn = 1 OR ov >= 0.5 * nh""",
    "v_bits": """
        SELECT vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN CAST(embedding[i] AS DOUBLE) > m
                   THEN CAST(1 AS HUGEINT) << CAST(64 - i AS INTEGER) ELSE CAST(0 AS HUGEINT) END))::UBIGINT AS hash
        FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 64 AS m FROM embeddings)""",
    "v_hash_items": """
        SELECT id, hash FROM v_bits UNION ALL
        SELECT id + 1000000, xor(hash, (CAST(1 AS UBIGINT) << CAST(id % 8 AS UBIGINT)) - CAST(1 AS UBIGINT)) FROM v_bits""",
    # suppliers as strips of pixel rows, one line per row
    "v_rows": """
        SELECT chapter_id, y, CASE WHEN blank THEN CASE WHEN tax >= 0.07 THEN 200 ELSE 246 END ELSE 20 END AS rmin,
               CASE WHEN blank THEN 255 ELSE 120 + CAST(q AS BIGINT) END AS rmax,
               CASE WHEN blank THEN 250.0 ELSE 60.0 + q END AS rmean, tax * 10 AS ink
        FROM (SELECT chapter_id, y, q, tax, (((y // 25) + chapter_id) % 3 = 0) <> (disc > 0.095) AS blank
              FROM (SELECT l_suppkey AS chapter_id, l_quantity AS q, l_tax AS tax, l_discount AS disc,
                           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS y
                    FROM lineitem))""",
    "v_gutter": "SELECT *, rmin >= 245 OR rmean >= 245 OR rmax <= 12 OR rmax - rmin <= 8 AS gutter FROM v_rows",
    "v_pages": """
        SELECT regexp_extract(url, 'https?://([^/?#]+)', 1) AS chapter_id, page_id AS pos, CAST(500 + length(url) AS BIGINT) AS w,
               CAST(length(html) AS BIGINT) AS h, url, html FROM pages""",
})


def _part_boxes(t: Tables):
    return t.scenes().select(
        F.col("panel").alias("chapter_id"), (F.col("chapter_id") * 100 + F.col("scene")).alias("box_id"),
        (F.col("supp") * 7 % 400).cast("double").alias("x"), (F.col("chapter_id") % 200).cast("double").alias("y"),
        (F.lit(20) + F.col("dur")).alias("w"), (F.lit(10) + F.round(F.col("discount") * 500)).alias("h"), F.col("price").alias("score"),
    )


def _rows(t: Tables):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    lines = scan(t.lineitem.select("l_suppkey", *order), ["l_suppkey"], order, F.floor(F.col("l_orderkey") / 65536), number="y")
    blank = ((F.floor(F.col("y") / 25) + F.col("l_suppkey")) % 3 == 0) != (F.col("l_discount") > 0.095)
    q, tax = F.col("l_quantity"), F.col("l_tax")
    return lines.select(
        F.col("l_suppkey").alias("chapter_id"), "y",
        F.when(blank, F.when(tax >= 0.07, 200).otherwise(246)).otherwise(20).alias("rmin"),
        F.when(blank, F.lit(255).cast("bigint")).otherwise(120 + q.cast("bigint")).alias("rmax"),
        F.when(blank, 250.0).otherwise(60.0 + q).alias("rmean"), (tax * 10).alias("ink"),
    )


def _pages(t: Tables):
    return t.pages.select(
        F.regexp_extract("url", "https?://([^/?#]+)", 1).alias("chapter_id"), F.col("page_id").alias("pos"),
        (F.length("url") + 500).cast("bigint").alias("w"), F.length("html").cast("bigint").alias("h"), "url", "html",
    )


@query("nearest_healthy", """
    WITH u AS (SELECT l_suppkey AS g, l_partkey AS number, min(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
    k AS (SELECT g, number, q, least(100 + q * 10, p / 100) >= 180 AND (100 + q * 10) * (p / 100) >= 120000 AS ok FROM u)
    SELECT b.g AS chapter_id, b.number, CASE WHEN b.ok THEN b.number ELSE (
        SELECT arg_min(n.number, abs(n.number - b.number) * 1000000 + n.number) FROM k n WHERE n.g = b.g AND n.ok AND n.number <> b.number) END AS shown
    FROM k b""")
def nearest_healthy(t: Tables):
    """Parts of a supplier as numbered units; size from quantity and price."""
    u = t.lineitem.groupBy(F.col("l_suppkey").alias("chapter_id"), F.col("l_partkey").alias("number")).agg(
        F.min("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))
    units = u.select("chapter_id", "number", F.col("number").alias("path"), G.unit_size_ok(100 + F.col("q") * 10, F.col("p") / 100).alias("ok"))
    return G.nearest_healthy(units, CH).select("chapter_id", "number", "shown")


@query("unit_size_filter", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE least(100 + l_quantity * 10, l_extendedprice / 100) >= 180 AND (100 + l_quantity * 10) * (l_extendedprice / 100) >= 120000""")
def unit_size_filter(t: Tables):
    return t.lineitem.filter(G.unit_size_ok(100 + F.col("l_quantity") * 10, F.col("l_extendedprice") / 100)).select(
        "l_orderkey", "l_linenumber", "l_partkey")


def _units(t: Tables):
    s = t.scenes()
    unit = (F.col("chapter_id") * 100 + F.col("scene")).alias("unit")
    none = F.lit(None).cast("string").alias("page")
    old = s.select(F.col("supp").alias("chapter_id"), unit, none, (F.col("panel") * 7 % 20000).cast("double").alias("y"), (10 + F.col("dur")).alias("h"))
    new = s.select(F.col("supp").alias("chapter_id"), unit, none, (F.col("chapter_id") % 20000).cast("double").alias("y"), (5 + F.col("dur") / 2).alias("h"))
    return old, new


@query("interval_remap", "SELECT * FROM v_remap")
def interval_remap(t: Tables):
    old, new = _units(t)
    return G.interval_remap(old, new, CH, 64.0)


@query("rewrite_references", """
    WITH r AS (SELECT supp AS chapter_id, scene, chapter_id AS ord, chapter_id * 100 + scene AS panel FROM v_scenes)
    SELECT r.chapter_id, r.scene, m.new AS panel, min(r.ord) AS ord FROM r JOIN v_remap m ON m.chapter_id = r.chapter_id AND m.old = r.panel GROUP BY 1, 2, 3""")
def rewrite_references(t: Tables):
    """Every old unit referenced once per supplier and scene number."""
    old, new = _units(t)
    refs = t.scenes().select(F.col("supp").alias("chapter_id"), "scene", F.col("chapter_id").alias("ord"), (F.col("chapter_id") * 100 + F.col("scene")).alias("panel"))
    return G.rewrite_references(refs, G.interval_remap(old, new, CH, 64.0), CH).select("chapter_id", "scene", "panel", "ord")


@query("box_clusters", """
    WITH RECURSIVE e AS (SELECT a.chapter_id, a.box_id AS a, b.box_id AS b FROM v_part_boxes a JOIN v_part_boxes b ON a.chapter_id = b.chapter_id
        AND a.x - 4 < b.x + b.w + 4 AND b.x - 4 < a.x + a.w + 4 AND a.y - 4 < b.y + b.h + 4 AND b.y - 4 < a.y + a.h + 4),
    r AS (SELECT chapter_id, a AS id, b AS seen FROM e UNION SELECT r.chapter_id, r.id, e.b FROM r JOIN e ON e.chapter_id = r.chapter_id AND e.a = r.seen)
    SELECT chapter_id, id, min(seen) AS cluster FROM r GROUP BY 1, 2""")
def box_clusters(t: Tables):
    return G.box_clusters(cut_lineage(_part_boxes(t)), CH, 4.0, 64.0)


#: The serial rule, one box a step: the last of ``todo`` goes to the first of ``kept`` that it doubles.
_MERGED_SQL = """WITH RECURSIVE r AS (
    SELECT chapter_id, list({'id': box_id, 'x': x, 'y': y, 'w': CAST(w AS DOUBLE), 'h': CAST(h AS DOUBLE)} ORDER BY box_id) AS todo,
           CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]) AS kept, FALSE AS changed FROM v_part_boxes GROUP BY 1
    UNION ALL
    SELECT chapter_id, CASE WHEN a IS NULL THEN kept ELSE todo[1:len(todo) - 1] END,
           CASE WHEN a IS NULL THEN [] WHEN hit > 0 THEN list_concat(list_append(kept[1:hit - 1], {'id': least(a.id, kept[hit].id), 'x': least(a.x, kept[hit].x), 'y': least(a.y, kept[hit].y),
               'w': greatest(a.x + a.w, kept[hit].x + kept[hit].w) - least(a.x, kept[hit].x), 'h': greatest(a.y + a.h, kept[hit].y + kept[hit].h) - least(a.y, kept[hit].y)}), kept[hit + 1:])
           ELSE list_append(kept, a) END, CASE WHEN a IS NULL THEN FALSE ELSE changed OR hit > 0 END
    FROM (SELECT *, coalesce(list_position(list_transform(kept, lambda o: least(a.x + a.w, o.x + o.w) > greatest(a.x, o.x) AND least(a.y + a.h, o.y + o.h) > greatest(a.y, o.y)
                 AND (least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * (least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y)) >= CAST(0.6 AS DOUBLE) * least(a.w * a.h, o.w * o.h)), TRUE), 0) AS hit
          FROM (SELECT *, todo[len(todo)] AS a FROM r WHERE len(todo) > 0 OR changed)))
    SELECT chapter_id, b.id AS box_id, b.x AS x, b.y AS y, b.w AS w, b.h AS h
    FROM (SELECT chapter_id, unnest(kept) AS b FROM r WHERE len(todo) = 0 AND NOT changed)"""


@query("merge_duplicate_boxes", _MERGED_SQL)
def merge_duplicate_boxes(t: Tables):
    """Lines of a part as boxes."""
    return G.merge_duplicate_boxes(_part_boxes(t), CH, 64.0)


_NMS_SQL = """WITH RECURSIVE r AS (
    SELECT chapter_id, 0 AS i, list({'id': box_id, 'x': x, 'y': y, 'w': w, 'h': h} ORDER BY score DESC, box_id) AS todo,
           CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]) AS kept FROM v_part_boxes GROUP BY 1
    UNION ALL
    SELECT chapter_id, i + 1, todo, CASE WHEN len(list_filter(kept, lambda o: common(a, o) / ((a.w + 1) * (a.h + 1) + (o.w + 1) * (o.h + 1) - common(a, o)) > CAST(0.7 AS DOUBLE))) > 0
        THEN kept ELSE list_append(kept, a) END
    FROM (SELECT *, todo[i + 1] AS a FROM r WHERE i < len(todo)))
    SELECT b.chapter_id, b.box_id, b.x, b.y, b.w, b.h, b.score FROM v_part_boxes b
    JOIN (SELECT chapter_id, unnest(kept).id AS box_id FROM r WHERE i = len(todo)) k USING (chapter_id, box_id)"""
_NMS_SQL = _NMS_SQL.replace(
    "common(a, o)", "(greatest(least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x) + 1, 0) * greatest(least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y) + 1, 0))")


@query("nms", _NMS_SQL)
def nms(t: Tables):
    """Lines of a part as scored boxes."""
    return G.nms(_part_boxes(t), CH, cell=64.0)


@query("near_duplicate_hash", """
    WITH u AS (SELECT hash, min(id) AS id FROM v_hash_items GROUP BY 1)
    SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance
    FROM u a JOIN u b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 6""")
def near_duplicate_hash(t: Tables):
    """Every vector and a copy with its low bits flipped."""
    h = t.embeddings.select(F.col("vec_id").alias("id"), mean_hash(F.col("embedding")).alias("hash"))
    mask = F.expr("CAST(shiftleft(1L, CAST(id % 8 AS INT)) - 1 AS BIGINT)")
    items = h.unionByName(h.select((F.col("id") + 1000000).alias("id"), F.col("hash").bitwiseXOR(mask).alias("hash")))
    return G.near_duplicate_hash(items, 6)


@query("hash_groups", "SELECT min(id) AS id, count(*) AS copies FROM v_hash_items GROUP BY hash")
def hash_groups(t: Tables):
    h = t.embeddings.select(F.col("vec_id").alias("id"), mean_hash(F.col("embedding")).alias("hash"))
    mask = F.expr("CAST(shiftleft(1L, CAST(id % 8 AS INT)) - 1 AS BIGINT)")
    items = h.unionByName(h.select((F.col("id") + 1000000).alias("id"), F.col("hash").bitwiseXOR(mask).alias("hash")))
    return G.hash_groups(items).select("id", "copies")


@query("neighbour_hash", """
    SELECT label, vec_id, CAST(bit_count(xor(hash, lag(hash) OVER (PARTITION BY label ORDER BY vec_id))) AS INTEGER) AS distance
    FROM (SELECT label, vec_id, hash FROM embeddings JOIN v_bits ON id = vec_id)""")
def neighbour_hash(t: Tables):
    """Hamming distance to the previous vector of the label (J19 in time order)."""
    from seqlens.functions.values import hamming
    from seqlens.plans.scan import ordinal_block

    h = t.embeddings.select("label", "vec_id", mean_hash(F.col("embedding")).alias("hash"))
    rows = scan(h, ["label"], ["vec_id"], ordinal_block("vec_id"), prev={"p": F.col("hash")})
    return rows.select("label", "vec_id", hamming(F.col("hash"), F.col("p")).alias("distance"))


@query("frame_features")
def frames(t: Tables):
    """Vectors as 8 × 8 grey frames."""
    level = F.transform("embedding", lambda v: F.least(F.greatest((v * 400 + 128).cast("int"), F.lit(0)), F.lit(255)))
    text = F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    rows = t.embeddings.select(
        F.col("label").cast("bigint").alias("video_id"), F.col("vec_id").cast("double").alias("t"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.unhex(text).alias("grey"))
    return frame_features(rows)


@query("watermark_gates", """
    WITH c AS (SELECT l_suppkey AS chapter_id, l_partkey AS unit, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS tier, l_quantity / 50 AS score,
                      0.6 + l_linenumber / 10.0::DOUBLE AS scale, l_discount * 10 AS white_dice, l_tax * 12 AS dark_dice FROM lineitem),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, unit, tier ORDER BY score DESC, scale DESC, white_dice DESC, dark_dice DESC) AS rn FROM c) WHERE rn = 1),
    g AS (SELECT *, white_dice >= 0.3 AND (score >= CASE tier WHEN 1 THEN 0.5 ELSE 0.85 END OR (score >= CASE tier WHEN 1 THEN 0.45 ELSE 0.85 END AND dark_dice >= 0.6))
                 AND (scale >= 0.8 OR dark_dice >= 0.6) AND (tier = 1 OR score >= 0.85) AS ok FROM b)
    SELECT chapter_id, unit, score, min(tier) AS tier FROM g WHERE ok AND (tier = 1 OR NOT EXISTS (
        SELECT 1 FROM g x WHERE x.chapter_id = g.chapter_id AND x.unit = g.unit AND x.tier = 1 AND x.ok)) GROUP BY 1, 2, 3""")
def watermark_gates(t: Tables):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    c = t.lineitem.select(
        F.col("l_suppkey").alias("chapter_id"), F.col("l_partkey").alias("unit"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("tier"),
        (q / 50).alias("score"), (F.lit(0.6) + n / 10.0).alias("scale"), (F.col("l_discount") * 10).alias("white_dice"), (F.col("l_tax") * 12).alias("dark_dice"))
    return G.watermark_gates(c, CH).select("chapter_id", "unit", "score", "tier")


@query("mode_majority_vote", """
    WITH m AS (SELECT chapter_id, pos, CASE WHEN h / w >= 2.2 THEN 'webtoon' ELSE 'manga' END AS mode FROM v_pages),
    c AS (SELECT chapter_id, mode, count(*) AS n, min(pos) AS p FROM m GROUP BY 1, 2)
    SELECT chapter_id, arg_max(mode, n * 1000000 - p) AS mode, arg_max(mode, n * 1000000 - p) <> arg_min(mode, p) AS overruled FROM c GROUP BY 1""")
def mode_majority_vote(t: Tables):
    return G.mode_majority_vote(_pages(t), CH)


@query("dominant_width", """
    WITH c AS (SELECT l_orderkey AS chapter_id, l_linenumber % 3 AS w, count(*) AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
    s AS (SELECT chapter_id, arg_max(w, (n, -p, -w)) AS width, count(*) AS n_widths, CAST(sum(n) AS BIGINT) AS pages, max(n) AS main FROM c GROUP BY 1)
    SELECT chapter_id, CAST(width AS BIGINT) AS width, n_widths, pages - main AS n_odd,
           (n_widths = 1 AND pages > 1) OR (n_widths = 2 AND pages > 2 AND pages - main <= 2) AS stitch FROM s""")
def dominant_width(t: Tables):
    """Line number modulo three as page width."""
    pages = t.lineitem.select(F.col("l_orderkey").alias("chapter_id"), (F.col("l_linenumber") % 3).cast("bigint").alias("w"), F.col("l_partkey").alias("pos"))
    return G.dominant_width(pages, CH)


TABLES_SQL["v_mark_runs"] = """
    SELECT source AS chapter_id, doc_id AS unit, band, CASE WHEN regexp_matches(line, '^[A-Z]') THEN 'l' ELSE 'r' END AS corner,
           length(line) AS w, length(line) - length(replace(line, ' ', '')) AS h, line
    FROM (SELECT source, doc_id, unnest(['top', 'bottom']) AS band, unnest([l[1], l[len(l)]]) AS line
          FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def _mark_runs(t: Tables):
    lines = F.split("text", "\n")
    ends = F.array(F.struct(F.lit("top").alias("band"), F.element_at(lines, 1).alias("line")), F.struct(F.lit("bottom").alias("band"), F.element_at(lines, -1).alias("line")))
    rows = t.documents.select(F.col("source").alias("chapter_id"), F.col("doc_id").alias("unit"), F.explode(ends).alias("e"))
    line = F.col("e.line")
    return rows.select(
        "chapter_id", "unit", F.col("e.band").alias("band"), F.when(line.rlike("^[A-Z]"), "l").otherwise("r").alias("corner"),
        F.length(line).alias("w"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))).alias("h"), line.alias("line"))


@query("recurring_marks", """
    SELECT chapter_id, band, corner, CAST(round_even(h / 8, 0) AS BIGINT) AS h8, CAST(round_even(w / 60, 0) AS BIGINT) AS w60,
           count(DISTINCT unit) AS n_units, count(*) AS n_runs FROM v_mark_runs GROUP BY ALL HAVING count(DISTINCT unit) >= 3""")
def recurring_marks(t: Tables):
    return G.recurring_marks(_mark_runs(t), CH)


@query("validate_marks", """
    WITH u AS (SELECT source AS chapter_id, doc_id AS unit, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                      count(*) OVER (PARTITION BY source) AS n FROM documents),
    p AS (SELECT * FROM u),
    m AS (SELECT DISTINCT chapter_id, unit, md5(line) AS mark FROM v_mark_runs),
    h AS (SELECT m.chapter_id, mark, count(*) AS n_match FROM m JOIN p ON p.chapter_id = m.chapter_id AND p.unit = m.unit GROUP BY 1, 2)
    SELECT c.chapter_id, c.mark, coalesce(n_match, 0) AS n_match, n_probed, coalesce(n_match, 0) >= 3 AND coalesce(n_match, 0) / n_probed <= 0.3 AS valid
    FROM (SELECT DISTINCT chapter_id, mark FROM m) c LEFT JOIN h ON h.chapter_id = c.chapter_id AND h.mark = c.mark
    JOIN (SELECT chapter_id, count(*) AS n_probed FROM p GROUP BY 1) q ON q.chapter_id = c.chapter_id""")
def validate_marks(t: Tables):
    """A mark is the exact first or last line; every unit is probed."""
    from seqlens.plans.scan import ordinal_block

    runs = _mark_runs(t).select("chapter_id", "unit", F.md5("line").alias("mark"))
    docs = t.documents.select(F.col("source").alias("chapter_id"), F.col("doc_id").alias("unit"))
    units = scan(docs, CH, ["unit"], ordinal_block("unit"), number="pos")
    return G.validate_marks(runs.select("chapter_id", "mark"), runs, units, CH)


TABLES_SQL["v_big_units"] = """
    SELECT l_partkey AS unit, CAST(max(l_orderkey) % 400 + 100 AS BIGINT) AS w, CAST(max(l_orderkey) % 900 + 100 AS BIGINT) AS h,
           CASE WHEN min(l_orderkey) % 3 = 0 THEN TRUE WHEN min(l_orderkey) % 3 = 1 THEN FALSE END AS has_text FROM lineitem GROUP BY 1"""


def _big_units(t: Tables):
    hi, lo = F.max("l_orderkey"), F.min("l_orderkey")
    return t.lineitem.groupBy(F.col("l_partkey").alias("unit")).agg(
        (hi % 400 + 100).alias("w"), (hi % 900 + 100).alias("h"), F.when(lo % 3 == 0, True).when(lo % 3 == 1, False).alias("has_text")
    ).withColumn("chapter_id", F.lit(0))


def _line_boxes(t: Tables):
    """Text boxes of the parts: one per line."""
    return t.lineitem.select(
        F.lit(0).alias("chapter_id"), F.col("l_partkey").alias("unit"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("h"))


@query("text_coverage", """
    SELECT unit, CASE WHEN covered IS NULL THEN CASE WHEN coalesce(has_text, TRUE) THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
                ELSE least(covered / (w * h), 1.0) END AS coverage
    FROM v_big_units LEFT JOIN (SELECT l_partkey, sum(l_quantity * (l_linenumber * 10 + l_quantity)) AS covered FROM lineitem GROUP BY 1) ON l_partkey = unit""")
def text_coverage(t: Tables):
    return G.text_coverage(_big_units(t), _line_boxes(t), CH).select("unit", "coverage")


@query("readability_guard", """
    WITH m AS (SELECT l_partkey, list_sort(list(l_linenumber * 10 + l_quantity)) AS l FROM lineitem GROUP BY 1),
    r AS (SELECT unit, w, h, has_text, l[len(l) // 2 + 1] AS m FROM v_big_units LEFT JOIN m ON l_partkey = unit)
    SELECT unit, CASE WHEN m IS NULL THEN CASE WHEN coalesce(has_text, TRUE) THEN CAST(0.55 AS DOUBLE) ELSE CAST(0.45 AS DOUBLE) END
                 ELSE least(greatest(40.0::DOUBLE * h / (m * 1080), CAST(0.45 AS DOUBLE)), 1.0) END AS min_height,
           coalesce(m * least(1920.0::DOUBLE / w, 1080.0::DOUBLE / h) < 30, FALSE) AS too_small FROM r""")
def readability_guard(t: Tables):
    return G.readability_guard(_big_units(t), _line_boxes(t), CH).select("unit", "min_height", "too_small")


@query("importance_weights", """
    WITH u AS (SELECT chapter_id, scene AS pos, 100 + panel % 300 AS w, 100 + supp % 300 AS h, discount AS coverage, t0 AS beat,
                      max(t1) OVER (PARTITION BY chapter_id) AS dur FROM v_spans),
    k AS (SELECT *, lead(beat) OVER (PARTITION BY chapter_id ORDER BY pos) AS nb, max(coverage) OVER (PARTITION BY chapter_id) AS top,
                 max(pos) OVER (PARTITION BY chapter_id) AS last FROM u),
    a AS (SELECT chapter_id, list_sort(list(w * h)) AS l FROM u GROUP BY 1)
    SELECT k.chapter_id, pos, round(0.4::DOUBLE * ((coalesce(nb, dur) - beat) / greatest(dur, 1e-6)) + 0.35::DOUBLE * (coverage / CASE WHEN top > 0 THEN top ELSE 1 END)
               + 0.25::DOUBLE * CASE WHEN pos = last THEN 1.0 WHEN pos = 0 THEN 0.6 ELSE 0.3 END, 9) AS weight,
           round(0.6::DOUBLE * CASE WHEN coverage < 0.02 AND w * h >= l[len(l) // 2 + 1] THEN 1.0 ELSE 0.0 END
               + 0.4::DOUBLE * CASE WHEN pos = last THEN 1.0 WHEN pos = 0 THEN 0.6 ELSE 0.3 END, 9) AS hero
    FROM k JOIN a ON a.chapter_id = k.chapter_id""")
def importance_weights(t: Tables):
    """Scenes of an order as units of one layout."""
    from seqlens.operators.timeline import scene_spans

    s = cut_lineage(scene_spans(cut_lineage(t.scenes().select("chapter_id", "scene", "dur", "panel", "supp", "discount")), CH))
    total = s.groupBy("chapter_id").agg(F.max("t1").alias("total"))
    units = s.join(total, "chapter_id").select(
        "chapter_id", F.col("scene").alias("pos"), (100 + F.col("panel") % 300).alias("w"), (100 + F.col("supp") % 300).alias("h"),
        F.col("discount").alias("coverage"), F.col("t0").alias("beat"), F.col("total").alias("dur"))
    rows = G.importance_weights(units, CH)
    return rows.select("chapter_id", "pos", F.round("weight", 9).alias("weight"), F.round("hero", 9).alias("hero"))


@query("reading_order", """WITH RECURSIVE a AS (SELECT chapter_id, min(y) AS top FROM v_part_boxes WHERE chapter_id % 2 = 0 GROUP BY 1
        UNION ALL SELECT a.chapter_id, (SELECT min(b.y) FROM v_part_boxes b WHERE b.chapter_id = a.chapter_id AND b.y - a.top > CAST(0.08 AS DOUBLE) * 400.0) FROM a WHERE a.top IS NOT NULL),
    b AS (SELECT b.*, a.top FROM v_part_boxes b ASOF LEFT JOIN (SELECT * FROM a WHERE top IS NOT NULL) a ON a.chapter_id = b.chapter_id AND b.y >= a.top)
    SELECT chapter_id, box_id, row_number() OVER (PARTITION BY chapter_id ORDER BY CASE WHEN chapter_id % 2 = 0 THEN top ELSE y END,
        CASE WHEN chapter_id % 2 = 0 THEN -x ELSE 0 END, CASE WHEN chapter_id % 2 = 0 THEN y ELSE 0 END, box_id) - 1 AS position FROM b""")
def reading_order(t: Tables):
    """Lines of a part as boxes on a page of 400; odd parts are strips."""
    boxes = _part_boxes(t)
    pages = boxes.select("chapter_id").distinct().select(
        "chapter_id", F.when(F.col("chapter_id") % 2 == 0, "manga").otherwise("webtoon").alias("mode"), F.lit(400.0).alias("page_h"))
    return G.reading_order(boxes, pages, CH).select("chapter_id", "box_id", "position")


_PLAN_SQL = """
    WITH plans AS (SELECT chapter_id, scene, 0 AS cut, panel, CAST(n_keywords AS DOUBLE) AS cut_off, dur, CAST(100 AS DOUBLE) AS pw,
            CAST(200 + supp % 300 AS DOUBLE) AS ph, CASE scene % 4 WHEN 0 THEN 'scroll' WHEN 1 THEN 'anchor' WHEN 2 THEN 'crop' ELSE 'contain' END AS mode
        FROM v_scenes),
    bx AS (SELECT l_partkey AS panel, CAST(l_suppkey % 90 - 5 AS DOUBLE) AS x, CAST(l_orderkey % 260 AS DOUBLE) AS y, l_quantity AS w, l_quantity AS h FROM lineitem),
    m AS (SELECT p.*, greatest(x, 0) AS bx0, greatest(y, 0) AS by0, least(x + w, pw) AS bx1, least(y + h, ph) AS by1 FROM plans p JOIN bx ON bx.panel = p.panel WHERE ph / pw > 2.5),
    ok AS (SELECT * FROM m WHERE bx1 > bx0 AND by1 > by0),
    b AS (SELECT DISTINCT chapter_id, scene, unnest(list_concat(list_transform(range(0, greatest(CAST(ceil((dur + cut_off) * 2) AS BIGINT), 1)), lambda k: k * CAST(0.5 AS DOUBLE)),
              [0.0, (dur + cut_off) * 0.5, greatest(dur + cut_off - CAST(0.001 AS DOUBLE), 0.0), CAST(1.25 AS DOUBLE), CAST(2.75 AS DOUBLE)])) AS b FROM ok),
    j AS (SELECT o.*, b, b - cut_off AS t FROM ok o JOIN b ON b.chapter_id = o.chapter_id AND b.scene = o.scene
          WHERE b BETWEEN 0 AND dur + cut_off + 1e-6 AND b - cut_off BETWEEN 0 AND dur + 1e-6),
    s AS (SELECT *, CASE mode WHEN 'contain' THEN TRUE
            WHEN 'scroll' THEN by0 * 2 >= 40 + 200 * least(greatest(t / dur, 0), 1) * least(greatest(t / dur, 0), 1) * (3 - 2 * least(greatest(t / dur, 0), 1))
                 AND by1 * 2 <= 40 + 200 * least(greatest(t / dur, 0), 1) * least(greatest(t / dur, 0), 1) * (3 - 2 * least(greatest(t / dur, 0), 1)) + 400
            WHEN 'crop' THEN (bx1 <= 20 OR bx0 >= 80 OR by1 <= 30 OR by0 >= 230) OR (bx0 >= 50 - 25 AND bx1 <= 50 + 25 AND by0 >= 130 - 200 / 2.4 AND by1 <= 130 + 200 / 2.4)
            ELSE (400 - pw * f) / 2 + bx0 * f >= 200 - 400 / 2.4 AND (400 - pw * f) / 2 + bx1 * f <= 200 + 400 / 2.4
                 AND (300 - ph * f) / 2 + by0 * f >= 150 - 300 / 2.4 AND (300 - ph * f) / 2 + by1 * f <= 150 + 300 / 2.4 END AS inside
          FROM (SELECT *, least(400 / pw, 300 / ph) AS f FROM j)),
    r AS (SELECT chapter_id, scene, b, bool_and(inside) AS inside FROM s GROUP BY 1, 2, 3)"""


@query("containment_audit", _PLAN_SQL.replace("2.4", "CAST(2.4 AS DOUBLE)").replace("50 - 25", "50 - 60 / CAST(2.4 AS DOUBLE)").replace("50 + 25", "50 + 60 / CAST(2.4 AS DOUBLE)") + """
    SELECT chapter_id, scene, count(*) AS checked, count(*) FILTER (NOT inside) AS violations, min(b) FILTER (NOT inside) AS first_at FROM r GROUP BY 1, 2""")
def containment_audit(t: Tables):
    """A framing plan per scene in four modes; boxes are the lines of the part."""
    s = cut_lineage(t.scenes().select("chapter_id", "scene", "panel", "supp", "dur", "n_keywords"))
    mode = F.element_at(F.array(F.lit("scroll"), F.lit("anchor"), F.lit("crop"), F.lit("contain")), (F.col("scene") % 4 + 1).cast("int"))
    num = lambda v: F.lit(float(v))
    plans = s.select(
        "chapter_id", "scene", F.lit(0).alias("cut"), "panel", F.col("n_keywords").cast("double").alias("cut_off"), "dur", mode.alias("mode"),
        num(100).alias("pw"), (200 + F.col("supp") % 300).cast("double").alias("ph"), num(400).alias("ss_w"),
        F.when(mode == "scroll", 400.0).otherwise(300.0).alias("ss_h"), F.lit(None).cast("double").alias("cy"), num(1.2).alias("zmax"),
        num(200).alias("fw"), num(40).alias("y0"), num(240).alias("y1"), num(20).alias("rx"), num(30).alias("ry"), num(60).alias("rw"), num(200).alias("rh"))
    words = s.select("chapter_id", "scene", F.lit(1.25).alias("w_start"), F.lit(2.75).alias("w_end"))
    q = F.col("l_quantity")
    lines = t.lineitem.select(F.col("l_partkey").alias("panel"), (F.col("l_suppkey") % 90 - 5).cast("double").alias("x"),
                              (F.col("l_orderkey") % 260).cast("double").alias("y"), q.alias("w"), q.alias("h"))
    return G.containment_audit(plans, words, lines, CH, box_keys=[]).select("chapter_id", "scene", "checked", "violations", "first_at")


@query("content_runs", """
    WITH c AS (SELECT chapter_id, y, y - lag(y) OVER (PARTITION BY chapter_id ORDER BY y) - 1 AS g FROM v_gutter WHERE NOT gutter),
    i AS (SELECT *, sum(CASE WHEN g < 12 THEN 0 ELSE 1 END) OVER (PARTITION BY chapter_id ORDER BY y) AS k FROM c),
    s AS (SELECT chapter_id, min(y) AS y0, max(y) + 1 AS y1 FROM i GROUP BY chapter_id, k)
    SELECT s.chapter_id, y0, CASE WHEN height - y1 < 12 THEN height ELSE y1 END AS y1
    FROM s JOIN (SELECT chapter_id, max(y) + 1 AS height FROM v_rows GROUP BY 1) h ON h.chapter_id = s.chapter_id
    WHERE CASE WHEN height - y1 < 12 THEN height ELSE y1 END - y0 > 4""")
def content_runs(t: Tables):
    """Suppliers as strips of pixel rows."""
    return S.content_runs(cut_lineage(_rows(t)), CH)


def _segments(t: Tables, rows):
    return S.gutter_segments(S.content_runs(rows, CH), CH, min_slice=70)


@query("gutter_segments")
def gutter_segments(t: Tables):
    """Slices of at least 70 rows; tested by properties of its result."""
    return _segments(t, cut_lineage(_rows(t)))


TABLES_SQL["v_text_boxes"] = "SELECT chapter_id, unnest(range(20, max(y) + 1, 100)) AS b FROM v_rows GROUP BY chapter_id"
TABLES_SQL["v_strip_units"] = """
    SELECT *, median(h) OVER (PARTITION BY chapter_id) AS med FROM (
        SELECT chapter_id, unit, unit * 13 AS y, CASE WHEN unit % 5 = 0 THEN 30 ELSE 13 END AS h
        FROM (SELECT chapter_id, unnest(range(0, max(y) // 13 + 1)) AS unit FROM v_rows GROUP BY chapter_id))"""


def _text_rows(rows):
    """Text boxes of thirty rows, one every hundred rows down to the end of each strip."""
    ends = rows.groupBy("chapter_id").agg(F.max("y").cast("bigint").alias("end")).filter("end >= 20")
    return ends.select("chapter_id", F.explode(F.expr("sequence(20L, end, 100L)")).alias("box_y0")).withColumn("box_y1", F.col("box_y0") + 30)


@query("forced_cuts")
def forced_cuts(t: Tables):
    """Slices above 90 rows cut at flat rows; tested by properties of its result."""
    rows = cut_lineage(_rows(t))
    return S.forced_cuts(_segments(t, rows), S.row_energy(rows, CH, _text_rows(rows)), CH, max_slice=90)


@query("snap_edges")
def snap_edges(t: Tables):
    """Tall slices grown over marks in the gutter; tested by properties of its result."""
    rows = cut_lineage(_rows(t))
    return S.snap_edges(_segments(t, rows), rows, CH)


@query("row_energy", """
    SELECT chapter_id, y, CAST(round(avg(rmax - rmin) OVER w, 6) AS DOUBLE) AS mean9,
           CAST(round(coalesce(2 * rmean - lag(rmean) OVER o - lead(rmean) OVER o, 0), 6) AS DOUBLE) AS lap,
           EXISTS (SELECT 1 FROM v_text_boxes x WHERE x.chapter_id = v_rows.chapter_id AND y >= b - 16 AND y < b + 30 + 16) AS forbidden
    FROM v_rows WINDOW o AS (PARTITION BY chapter_id ORDER BY y), w AS (PARTITION BY chapter_id ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def row_energy(t: Tables):
    strips = _rows(t)
    rows = S.row_energy(strips, CH, _text_rows(strips), block=128)
    return rows.select("chapter_id", "y", F.round("mean9", 6).alias("mean9"), F.round("lap", 6).alias("lap"), "forbidden")


@query("cut_box_audit", """
    WITH v AS (SELECT * FROM v_strip_units),
    f AS (SELECT * FROM v WHERE unit > 0 AND NOT EXISTS (SELECT 1 FROM v_gutter g WHERE g.chapter_id = v.chapter_id AND g.gutter AND g.y BETWEEN v.y - 2 AND v.y + 2)),
    e AS (SELECT chapter_id, unit, y, h, unnest(range(1, 12)) AS k FROM v WHERE h > med * 1.5),
    g AS (SELECT chapter_id, unit, CASE WHEN k <= 5 THEN 'top' ELSE 'bottom' END AS fault, CASE WHEN k <= 5 THEN y - k ELSE y + h + k - 6 END AS r FROM e),
    i AS (SELECT g.chapter_id, g.unit, g.fault, CASE WHEN g.fault = 'top' THEN max(r) ELSE min(r) END AS y
          FROM g JOIN v_gutter w ON w.chapter_id = g.chapter_id AND w.y = r AND w.gutter AND w.rmax - w.rmin > 40 WHERE r > 0 OR g.fault = 'bottom' GROUP BY 1, 2, 3)
    SELECT chapter_id, unit, y, 'text' AS fault FROM f WHERE EXISTS (SELECT 1 FROM v_text_boxes x WHERE x.chapter_id = f.chapter_id AND y > b AND y < b + 30)
    UNION ALL SELECT f.chapter_id, unit, f.y, 'art' FROM f JOIN v_rows w ON w.chapter_id = f.chapter_id AND w.y = f.y WHERE ink > 0.55
    UNION ALL SELECT chapter_id, unit, y, fault FROM i""")
def cut_box_audit(t: Tables):
    """Units of thirteen rows down to the end of each strip, every fifth over-tall."""
    rows = cut_lineage(_rows(t))
    ends = rows.groupBy("chapter_id").agg(F.max("y").cast("bigint").alias("end"))
    units = ends.select("chapter_id", F.explode(F.expr("sequence(0L, end div 13)")).alias("unit")).select(
        "chapter_id", "unit", (F.col("unit") * 13).alias("y"), F.when(F.col("unit") % 5 == 0, 30).otherwise(13).alias("h"))
    return S.cut_box_audit(units, rows, _text_rows(rows), CH)
