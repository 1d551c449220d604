"""Queries of the catalog family: parts are titles, customers channels, orders chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlens.catalog.base import TABLES_SQL, Tables, query
from seqlens.functions import text as X
from seqlens.functions.values import format_label
from seqlens.operators import ranking as K
from seqlens.session import cut_lineage
from seqlens.sources import readers

TABLES_SQL.update({
    "v_feed_sums": """
        SELECT title_id, count(*) AS n_rows, count(*) FILTER (ok) AS n, min(c) FILTER (ok) AS first
        FROM (SELECT *, external_url IS NULL AND pages > 0 AS ok, CAST(chapter AS DOUBLE) AS c FROM v_feed) GROUP BY 1""",
    "v_tops": "SELECT greatest(max(trending), 1) AS t, greatest(max(popularity), 1) AS p, greatest(max(favourites), 1) AS f FROM v_candidates",
    "v_base_score": """
        SELECT c.*, 0.35::DOUBLE * (CAST(trending AS DOUBLE) / t) + 0.25::DOUBLE * (CAST(popularity AS DOUBLE) / p) + 0.15::DOUBLE * (CAST(favourites AS DOUBLE) / f)
               + 0.15::DOUBLE * (CAST(score AS DOUBLE) / 100) + 0.1::DOUBLE * least(CAST(hits AS DOUBLE) / 3, 1.0::DOUBLE)
               + CASE WHEN status = 'RELEASING' THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN chapters > 100 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS base,
               CAST(trending AS DOUBLE) / t AS tn, CAST(popularity AS DOUBLE) / p AS pn
        FROM (SELECT *, CASE genre WHEN 'ECONOMY' THEN 2 WHEN 'PROMO' THEN 3 ELSE 0 END AS hits FROM v_candidates) c, v_tops""",
    "v_first_rank": """
        SELECT *, row_number() OVER (ORDER BY round(least(greatest(base, 0), 1), 4) DESC, ord) AS rank FROM v_base_score""",
    "v_discovered": """
        SELECT r.*, s.title_id IS NOT NULL AND s.n > 0 AS fetchable, coalesce(s.n, 0) AS n_ok, coalesce(s.first <= 1.0, FALSE) AS early,
               round(least(greatest(base + CASE WHEN rank > 15 THEN 0.0::DOUBLE WHEN coalesce(s.first <= 1.0, FALSE) AND s.n >= 5 THEN 0.2::DOUBLE
                     WHEN s.n >= 5 THEN 0.05::DOUBLE WHEN s.n > 0 THEN -0.15::DOUBLE ELSE -0.3::DOUBLE END, 0), 1), 4) AS video_score
        FROM v_first_rank r LEFT JOIN v_feed_sums s ON s.title_id = r.source_id""",
    "v_progress": """
        SELECT o_custkey AS channel, 'Series ' || CAST(o_custkey % 40 AS VARCHAR) AS title,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'extra' WHEN o_orderstatus = 'P' THEN CAST(o_orderkey % 30 AS VARCHAR) || '.5'
                    ELSE CAST(o_orderkey % 30 AS VARCHAR) || '.0' END AS chapter FROM orders""",
    "v_tracks": """
        SELECT p_partkey AS track_id, p_type AS mood, p_name AS title, p_brand AS artist, CAST(p_size * 20 AS DOUBLE) AS duration,
               popularity AS downloads, p_partkey % 7 = 3 AS is_premium, CASE WHEN p_size > 3 THEN p_name || '.mp3' END AS file
        FROM part JOIN v_candidates ON source_id = p_partkey""",
    "v_blocked": """
        SELECT DISTINCT lower(p_brand) AS artist, lower(p_name) AS title FROM part WHERE p_size < 8 AND p_partkey % 5 <> 0""",
})


def _candidates(t: Tables):
    genre = F.element_at("genres", 1)
    lists = F.when(genre == "ECONOMY", F.array(F.lit("Action"), F.lit("Drama"), F.lit("Action"))).when(
        genre == "PROMO", F.array(F.lit("Fantasy"), F.lit("Comedy"), F.lit("Horror"), F.lit("Mystery"))).otherwise(F.array(F.lit("Comedy")))
    return t.candidates().withColumn("genres", lists)


def _listing(t: Tables):
    """Known series are looked up by a unique title; the alternative title is unknown."""
    return t.customer.select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_custkey").alias("series"))


def _named(t: Tables):
    return _candidates(t).withColumn("title", F.concat(F.lit("T"), F.col("source_id").cast("string")))


def _feed(t: Tables):
    return t.feed().withColumnRenamed("title_id", "series")


@query("rank_candidates", """
    SELECT source_id, round(least(greatest(base, 0), 1), 4) AS video_score, concat_ws(', ',
           CASE WHEN tn > 0.6 THEN 'surging in current trends' END, CASE WHEN pn > 0.6 THEN 'very large existing audience' END,
           CASE WHEN hits > 0 THEN CAST(hits AS VARCHAR) || ' high-retention genre(s)' END,
           CASE WHEN status = 'RELEASING' THEN 'ongoing — fresh chapters to recap' END,
           CASE WHEN score >= 80 THEN 'highly rated (' || CAST(score AS VARCHAR) || '/100)' END,
           CASE WHEN chapters > 100 THEN 'deep back-catalog (' || CAST(chapters AS VARCHAR) || ' ch)' END) AS reasons
    FROM v_base_score""")
def rank_candidates(t: Tables):
    return K.rank_candidates(K.unprobed(_candidates(t))).select("source_id", "video_score", F.array_join("reasons", ", ").alias("reasons"))


@query("availability_rollup", """
    SELECT c.source_id, coalesce(n, 0) > 0 AS fetchable, coalesce(n, 0) AS fetchable_chapters, coalesce(first <= 1.0, FALSE) AS starts_at_one,
           CASE WHEN c_custkey IS NULL THEN 'not found' WHEN n_rows IS NULL THEN 'no English chapters' WHEN n = 0 THEN 'licensed/external — no fetchable EN pages'
                WHEN first <= 1.0 THEN CAST(n AS VARCHAR) || ' fetchable EN chapters from ch1 (binge-in-order)'
                ELSE CAST(n AS VARCHAR) || ' fetchable EN chapters, but earliest is ch' || CASE WHEN first = floor(first) THEN CAST(CAST(first AS BIGINT) AS VARCHAR) ELSE CAST(first AS VARCHAR) END || ' (no ch1)' END AS availability_note
    FROM v_candidates c LEFT JOIN customer ON c_custkey = c.source_id LEFT JOIN v_feed_sums s ON s.title_id = c_custkey""")
def availability_rollup(t: Tables):
    """Half the titles are found by their first name, the others by the alternative."""
    name = F.concat(F.lit("T"), F.col("source_id").cast("string"))
    odd = F.col("source_id") % 2 == 1
    titles = _candidates(t).select(
        "source_id", F.when(odd, F.concat(F.lit("unknown "), name)).otherwise(name).alias("title"), F.when(odd, name).otherwise(F.lit("T-1")).alias("title_alt"))
    return K.availability_rollup(titles, _listing(t), _feed(t))


@query("discover", "SELECT source_id, video_score, early AND rank <= 15 AS starts_at_one FROM v_discovered")
def discover(t: Tables):
    return K.discover(_named(t), _listing(t), _feed(t)).select("source_id", "video_score", "starts_at_one")


@query("pick_rank", """
    SELECT source_id, 't' || CAST(source_id AS VARCHAR) AS slug, video_score FROM (
        SELECT source_id, round(least(greatest(base, 0), 1), 4) AS video_score, rank FROM v_first_rank) WHERE rank = 7""")
def pick_rank(t: Tables):
    return K.pick_rank(K.rank_candidates(K.unprobed(_named(t))), 7).select("source_id", "slug", "video_score")


@query("unseen_candidates", """
    SELECT source_id, video_score FROM v_discovered d WHERE early AND rank <= 15 AND NOT EXISTS (
        SELECT 1 FROM lineitem WHERE l_suppkey = d.source_id AND l_quantity >= 50)""")
def unseen_candidates(t: Tables):
    used = t.lineitem.filter("l_quantity >= 50").select(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("title"))
    return K.unseen_candidates(K.discover(_named(t), _listing(t), _feed(t)), used).select("source_id", "video_score")


def _channels(t: Tables):
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    return t.customer.select(
        key.alias("channel"), F.when(nation != 7, F.concat(F.lit("Series "), (key % 40).cast("string"))).alias("title"),
        F.when(nation % 2 == 0, "FINISHED").otherwise("RELEASING").alias("status"), F.when(nation % 5 != 0, nation + 5).alias("total"))


def _progress(t: Tables):
    key = (F.col("o_orderkey") % 30).cast("string")
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "extra").when(F.col("o_orderstatus") == "P", F.concat(key, F.lit(".5"))).otherwise(F.concat(key, F.lit(".0")))
    return t.orders.select(
        F.col("o_custkey").alias("channel"), F.concat(F.lit("Series "), (F.col("o_custkey") % 40).cast("string")).alias("title"), label.alias("chapter"))


def _roster(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("channel"), F.concat(F.lit("T"), (F.col("c_custkey") % 100).cast("string")).alias("title"),
        F.when(F.col("c_mktsegment") == "BUILDING", "retired").when(F.col("c_mktsegment") == "MACHINERY", "skip").otherwise("active").alias("state"))


@query("exclusion_set", """
    SELECT DISTINCT channel, title FROM v_progress UNION
    SELECT c_custkey, 'T' || CAST(c_custkey % 100 AS VARCHAR) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def exclusion_set(t: Tables):
    return K.exclusion_set(_progress(t), _roster(t), ["channel"])


@query("next_item", """
    WITH last AS (SELECT channel, title, max(try_cast(chapter AS DOUBLE)) AS last FROM v_progress GROUP BY 1, 2),
    ch AS (SELECT c_custkey AS channel, CASE WHEN c_nationkey <> 7 THEN 'Series ' || CAST(c_custkey % 40 AS VARCHAR) END AS title,
                  CASE WHEN c_nationkey % 2 = 0 THEN 'FINISHED' ELSE 'RELEASING' END AS status, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey + 5 END AS total FROM customer),
    n AS (SELECT ch.*, coalesce(CAST(floor(last) AS BIGINT) + 1, 1) AS nxt FROM ch LEFT JOIN last ON last.channel = ch.channel AND last.title = ch.title),
    x AS (SELECT *, title IS NULL OR (status = 'FINISHED' AND coalesce(nxt > total, FALSE)) AS out FROM n),
    pool AS (SELECT 'T' || CAST(source_id AS VARCHAR) AS title, row_number() OVER (ORDER BY video_score DESC, ord) AS k FROM v_discovered WHERE early AND rank <= 15),
    ex AS (SELECT c_custkey AS channel, 'T' || CAST(c_custkey % 100 AS VARCHAR) AS title FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    pr AS (SELECT channel, arg_min(title, k) AS title FROM (SELECT c_custkey AS channel, p.title, k FROM customer, pool p) o
           WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.channel = o.channel AND ex.title = o.title) GROUP BY 1)
    SELECT x.channel, CASE WHEN out THEN pr.title ELSE x.title END AS title, CASE WHEN out THEN CASE WHEN pr.title IS NOT NULL THEN 1 END ELSE nxt END AS chapter,
           out AS is_new, NOT out AND coalesce(nxt > total, FALSE) AS caught_up
    FROM x LEFT JOIN pr ON pr.channel = x.channel""")
def next_item(t: Tables):
    """Channels of nation 7 have no series; finished series are replaced."""
    channels, progress = _channels(t), _progress(t)
    ranked = cut_lineage(K.discover(_named(t), _listing(t), _feed(t)).select("source_id", "title", "starts_at_one", "video_score", "ord"))
    offer = K.promote(ranked, K.exclusion_set(progress, _roster(t), ["channel"]), channels)
    return K.next_item(channels, progress, offer).drop("slug")


@query("record_progress", """
    SELECT DISTINCT channel, CASE WHEN try_cast(chapter AS DOUBLE) IS NULL THEN chapter WHEN try_cast(chapter AS DOUBLE) = floor(try_cast(chapter AS DOUBLE))
           THEN CAST(CAST(try_cast(chapter AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE chapter END AS chapter
    FROM (SELECT channel, chapter FROM v_progress UNION ALL SELECT title_id, chapter FROM v_feed)""")
def record_progress(t: Tables):
    return K.record_progress(_progress(t), t.feed().withColumnRenamed("title_id", "channel"), ["channel"])


@query("load_candidates", """
    SELECT p_partkey AS source_id, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS title, p_brand AS title_alt, p_type AS status,
           'primary' AS origin, replace(replace(p_name || ' x', 'a', ''), '  ', ' ') AS synopsis FROM part WHERE p_size % 10 <> 9""")
def load_candidates(t: Tables):
    """Blank English titles fall back; every tenth size is adult."""
    size = F.col("p_size")
    primary = t.part.select(
        F.col("p_partkey").alias("source_id"), F.when(size % 3 == 0, "").otherwise(F.col("p_name")).alias("english"), F.col("p_brand").alias("romaji"),
        F.lit(None).cast("string").alias("native"), F.lit(1).alias("trending"), size.alias("popularity"), F.lit(None).cast("int").alias("favourites"),
        size.alias("average_score"), size.alias("chapters"), F.col("p_type").alias("status"), F.lit(None).cast("array<string>").alias("genres"),
        F.lit("M").alias("format"), F.lit("JP").alias("country"), (size % 10 == 9).alias("is_adult"),
        F.concat(F.replace("p_name", F.lit("a"), F.lit("<i></i>")), F.lit("<br>  x ")).alias("description"), F.col("p_partkey").alias("rank"))
    return readers.load_candidates(primary, _fallback(t)).select("source_id", "title", "title_alt", "status", "origin", "synopsis")


def _fallback(t: Tables):
    key = F.col("s_suppkey")
    return t.supplier.select(
        key.alias("source_id"), F.lit(None).cast("string").alias("title_english"), F.col("s_name").alias("title"), key.alias("rank"),
        F.col("s_nationkey").alias("members"), F.lit(1).alias("favorites"), (F.col("s_acctbal") / 1000).alias("score"), F.lit(None).cast("int").alias("chapters"),
        F.lit("currently publishing").alias("status"), F.lit(None).cast("array<string>").alias("genres"), F.lit("Manga").alias("format"),
        F.when(key % 3 == 0, "Rx - Hentai").otherwise("PG").alias("rating"), F.lit("").alias("synopsis"))


@query("load_candidates_fallback", """
    SELECT s_suppkey AS source_id, s_name AS title, (SELECT count(*) FROM supplier) - s_suppkey AS trending, CAST(trunc(s_acctbal / 1000 * 10) AS BIGINT) AS score,
           'CURRENTLY_PUBLISHING' AS status, s_suppkey % 3 = 0 AS is_adult, 'fallback' AS origin FROM supplier""")
def load_candidates_fallback(t: Tables):
    """Every primary title is adult, so the fallback catalog answers."""
    none = F.lit(None).cast("string")
    primary = t.part.select(
        F.col("p_partkey").alias("source_id"), F.col("p_name").alias("english"), none.alias("romaji"), none.alias("native"), F.lit(1).alias("trending"),
        F.lit(1).alias("popularity"), F.lit(1).alias("favourites"), F.lit(1).alias("average_score"), F.lit(1).alias("chapters"), none.alias("status"),
        F.lit(None).cast("array<string>").alias("genres"), none.alias("format"), none.alias("country"), F.lit(True).alias("is_adult"), none.alias("description"),
        F.col("p_partkey").alias("rank"))
    return readers.load_candidates(primary, _fallback(t)).select("source_id", "title", "trending", "score", "status", "is_adult", "origin")


@query("load_blocklist", "SELECT * FROM v_blocked")
def load_blocklist(t: Tables):
    return _blocklist(t)


def _blocklist(t: Tables):
    """Lines of the list: comments, blanks and three kinds of dash."""
    dash = F.element_at(F.array(F.lit(" — "), F.lit("  –  "), F.lit(" - ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    line = F.concat("p_brand", dash, F.col("p_name"))
    lines = t.part.select(F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), line)).when(F.col("p_size") >= 8, "").otherwise(line).alias("value"))
    return readers.parse_blocklist(lines)


def _tracks(t: Tables):
    pop = t.candidates().select("source_id", "popularity")
    return t.part.join(pop, F.col("source_id") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("track_id"), F.col("p_type").alias("mood"), F.col("p_name").alias("title"), F.array("p_brand").alias("artists"),
        (F.col("p_size") * 20).cast("double").alias("duration"), F.col("popularity").alias("downloads"), (F.col("p_partkey") % 7 == 3).alias("is_premium"),
        F.when(F.col("p_size") > 3, F.concat("p_name", F.lit(".mp3"))).alias("file"), F.col("p_partkey").alias("ord"))


_FREE_SQL = """SELECT * FROM v_tracks k WHERE NOT is_premium AND file IS NOT NULL AND duration BETWEEN 60 AND 600
    AND NOT EXISTS (SELECT 1 FROM v_blocked b WHERE b.artist = lower(k.artist) AND b.title = lower(k.title))"""


@query("track_filter", f"SELECT track_id, mood FROM ({_FREE_SQL})")
def track_filter(t: Tables):
    return K.track_filter(_tracks(t), _blocklist(t)).select("track_id", "mood")


@query("top_track", f"""
    SELECT mood, track_id FROM (SELECT *, row_number() OVER (PARTITION BY mood ORDER BY downloads DESC, track_id) AS rn, count(*) OVER (PARTITION BY mood) AS n
        FROM ({_FREE_SQL})) WHERE rn = least(3, n)""")
def top_track(t: Tables):
    return K.top_track(K.track_filter(_tracks(t), _blocklist(t)), ["mood"], pick=2).select("mood", "track_id")


def _assigned(t: Tables):
    moods = t.part.select("p_type").distinct()
    plan = t.orders.select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 6 + 1).cast("int").alias("m"))
    names = F.array(*[F.lit(m) for m in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    plan = plan.withColumn("mood", F.element_at(names, F.col("m"))).join(moods.withColumnRenamed("p_type", "mood"), "mood", "left_semi")
    # every mood offers the same few names, so the plans must avoid repeats
    tracks = _tracks(t).select(
        "mood", "track_id", F.when(F.col("track_id") % 11 > 0, F.col("title")).alias("title"),
        F.when(F.col("track_id") % 13 > 0, F.col("artists")).alias("artists"), F.md5("title").alias("md5"), "downloads", "ord")
    return plan, K.distinct_assignment(plan, tracks, ["plan_id"])


#: The serial rule: a recursion per distinct list of moods takes the tracks, a second one settles equal contents.
_ASSIGNED_SQL = """WITH RECURSIVE moods AS (SELECT DISTINCT p_type AS mood FROM part),
    plan AS (SELECT o_custkey AS plan_id, o_orderkey AS ord, ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][o_orderkey % 6 + 1] AS mood FROM orders),
    once AS (SELECT plan_id, mood, min(ord) AS ord FROM plan SEMI JOIN moods USING (mood) GROUP BY 1, 2),
    plans AS (SELECT plan_id, list(mood ORDER BY ord) AS moods FROM once GROUP BY 1),
    offer AS (SELECT p.p_type AS mood, list({'track': p.p_partkey,
                  'names': CASE WHEN p.p_partkey % 13 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lower(p.p_brand) || '/' || coalesce(CASE WHEN p.p_partkey % 11 > 0 THEN lower(p.p_name) END, '')] END,
                  'h': md5(p.p_name)} ORDER BY popularity DESC, p.p_partkey) AS cands
              FROM part p JOIN v_candidates c ON c.source_id = p.p_partkey GROUP BY 1),
    first AS (SELECT moods, 0 AS i, CAST([] AS VARCHAR[]) AS used, CAST([] AS STRUCT(track BIGINT, names VARCHAR[], h VARCHAR)[]) AS picks FROM (SELECT DISTINCT moods FROM plans)
        UNION ALL SELECT moods, i + 1, list_concat(used, coalesce(pick.names, [])), list_append(picks, pick)
        FROM (SELECT r.*, list_filter(o.cands, lambda x: NOT list_has_any(x.names, r.used))[1] AS pick FROM first r JOIN offer o ON o.mood = r.moods[i + 1] WHERE i < len(r.moods))),
    settled AS (SELECT moods, 0 AS n, used, picks, CAST([] AS VARCHAR[]) AS seen, CAST([] AS BIGINT[]) AS took FROM first WHERE i = len(moods)
        UNION ALL SELECT moods, n + 1, list_concat(used, coalesce(pick.names, [])), picks, CASE WHEN pick IS NULL THEN seen ELSE list_append(seen, pick.h) END, list_append(took, pick.track)
        FROM (SELECT s.*, CASE WHEN s.picks[n + 1] IS NULL OR NOT list_contains(s.seen, s.picks[n + 1].h) THEN s.picks[n + 1]
                ELSE list_filter(list_filter(o.cands, lambda x: NOT list_has_any(x.names, s.used))[1:6], lambda x: NOT list_contains(s.seen, x.h))[1] END AS pick
              FROM settled s JOIN offer o ON o.mood = s.moods[n + 1] WHERE n < len(s.moods)))
    SELECT plan_id, unnest(p.moods) AS mood, unnest(s.took) AS track_id FROM plans p JOIN settled s ON s.moods = p.moods AND s.n = len(s.moods)"""


@query("distinct_assignment", _ASSIGNED_SQL)
def distinct_assignment(t: Tables):
    """Customers' orders as music plans; contents repeat under many names, some tracks have no title, some no artists."""
    return _assigned(t)[1]


@query("attribution_list", """
    WITH r AS (SELECT o_custkey AS plan_id, o_orderkey * 1000000000 + p_partkey AS ord, p_name AS track, p_brand AS artist,
                      'u/' || CAST(p_partkey AS VARCHAR) AS url
               FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus <> 'P'),
    o AS (SELECT plan_id, track, artist, arg_min(url, ord) AS url, min(ord) AS ord FROM r GROUP BY 1, 2, 3)
    SELECT plan_id, string_agg('Music track: ' || track || ' by ' || artist || chr(10) || 'Source: ' || url, chr(10) || chr(10) ORDER BY ord) AS credits FROM o GROUP BY 1""")
def attribution_list(t: Tables):
    """The parts of a customer's orders as tracks of a plan."""
    lines = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    plan = lines.select(
        F.col("o_custkey").alias("plan_id"), (F.col("o_orderkey") * 1000000000 + F.col("p_partkey")).alias("ord"), F.lit("m").alias("mood"), F.col("p_name").alias("track"),
        F.col("p_brand").alias("artist"), F.concat(F.lit("u/"), F.col("p_partkey").cast("string")).alias("url"), (F.col("o_orderstatus") != "P").alias("obtained"))
    return K.attribution_list(plan, ["plan_id"])


@query("asset_manifest", """
    WITH f AS (SELECT regexp_extract(url, 'https?://([^/?#]+)', 1) AS host, url FROM pages),
    h AS (SELECT host, unnest(['long', 'short', 'thumb']) AS label FROM (SELECT DISTINCT host FROM f))
    SELECT h.host, h.label, CASE label WHEN 'long' THEN (SELECT min(url) FROM f WHERE f.host = h.host AND contains(url, '/en/'))
           WHEN 'short' THEN (SELECT min(url) FROM f WHERE f.host = h.host AND ends_with(url, '.html'))
           ELSE coalesce((SELECT min(url) FROM f WHERE f.host = h.host AND contains(url, '?page=2')), (SELECT min(url) FROM f WHERE f.host = h.host AND contains(url, '#top'))) END AS path
    FROM h""")
def asset_manifest(t: Tables):
    files = t.pages.select(F.regexp_extract("url", "https?://([^/?#]+)", 1).alias("host"), F.col("url").alias("path"))
    return K.asset_manifest(files, {"long": ["/en/"], "short": [r"\.html$"], "thumb": [r"\?page=2", "#top"]}, ["host"])


@query("short_checks", """
    WITH m AS (SELECT p_partkey, CASE WHEN p_size = 13 THEN 0 ELSE 1000 + p_size * 10 END AS w, 1920 AS h, p_size * 2.0 AS dur, -10.0 - p_size / 5.0 AS lufs,
                      p_size - 40.0 AS peak, p_size % 5 AS bars, p_size * 1.0 AS luma, p_size / 100.0 AS frac, p_size / 20.0 AS sharp FROM part),
    r AS (SELECT p_partkey, unnest(CASE WHEN w = 0 THEN ['unreadable_file'] ELSE [
        CASE WHEN abs(w::DOUBLE / h - 9::DOUBLE / 16) > 0.01 THEN 'bad_aspect' END, CASE WHEN h < 1920 OR w < 1080 THEN 'low_resolution' END,
        CASE WHEN dur < 15 THEN 'too_short' WHEN dur > 80 THEN 'too_long' WHEN dur > 60 THEN 'over_sweet_spot' END,
        CASE WHEN abs(lufs + 14) > 1.5 THEN 'loudness' END, CASE WHEN peak > -1 THEN 'true_peak' END, CASE WHEN bars >= 3 THEN 'letterbox' END,
        CASE WHEN luma < 12 OR frac < 0.04 THEN 'bad_first_frame' WHEN sharp < 1 THEN 'blurry_first_frame' END,
        CASE WHEN p_partkey % 2 = 0 THEN 'dead_ending' END] END) AS type FROM m)
    SELECT * FROM r WHERE type IS NOT NULL""")
def short_checks(t: Tables):
    s = F.col("p_size")
    m = t.part.select(
        "p_partkey", F.when(s == 13, 0).otherwise(1000 + s * 10).alias("w"), F.lit(1920).alias("h"), (s * 2.0).alias("dur"), (-10.0 - s / 5.0).alias("lufs"),
        (s - 40.0).alias("peak"), (s % 5).alias("bar_hits"), (s * 1.0).alias("luma"), (s / 100.0).alias("frac"), (s / 20.0).alias("sharp"),
        (F.col("p_partkey") % 2 == 0).alias("silent_tail"))
    return K.short_checks(m, ["p_partkey"]).select("p_partkey", "type")


@query("thumb_checks", """
    WITH m AS (SELECT page_id, length(url) <> 40 AS readable, 1200 + length(url) * 3 AS w, 720 AS h, length(html) * 500 AS bytes, length(html)::DOUBLE / 1000 AS sharp,
                      length(url)::DOUBLE / 60 AS palette, length(url) AS contrast, contains(url, 'html') AS f FROM pages),
    r AS (SELECT page_id, unnest(CASE WHEN NOT readable THEN ['unreadable_file'] ELSE [CASE WHEN w < 1280 OR h < 720 THEN 'low_resolution' END,
        CASE WHEN abs(w::DOUBLE / h - 16::DOUBLE / 9) > 0.02 THEN 'bad_aspect' END, CASE WHEN bytes > 2097152 THEN 'file_too_big' END,
        CASE WHEN f THEN 'bad_format' END, CASE WHEN sharp < 2 THEN 'soft_image' END, CASE WHEN palette > 0.85 THEN 'ui_palette' END,
        CASE WHEN contrast < 28 THEN 'low_contrast' END] END) AS type FROM m)
    SELECT * FROM r WHERE type IS NOT NULL""")
def thumb_checks(t: Tables):
    u, h = F.length("url"), F.length("html")
    m = t.pages.select(
        "page_id", (u != 40).alias("readable"), (1200 + u * 3).alias("w"), F.lit(720).alias("h"), (h * 500).alias("bytes"),
        F.when(F.contains("url", F.lit("html")), "GIF").otherwise("PNG").alias("format"), (h / 1000).alias("sharp"), (u / 60).alias("palette"), u.alias("contrast"))
    return K.thumb_checks(m, ["page_id"]).select("page_id", "type")


@query("distinct_in_order", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def distinct_in_order(t: Tables):
    return K.distinct_in_order(t.documents, ["lang"], "source", "doc_id")


@query("content_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def content_dedup(t: Tables):
    return K.content_dedup(t.documents.select("doc_id", "text"), [], "text", "doc_id").select("doc_id")


_PATH_SQL = "url || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '.txt' END"


@query("ingest_ordered_units", f"""
    WITH p AS (SELECT regexp_extract(url, 'https?://([^/?#]+)', 1) AS host, page_id, {_PATH_SQL} AS path FROM pages),
    k AS (SELECT host, page_id, path, list_transform(regexp_extract_all(path, '\\d+|\\D+'), lambda r: CASE WHEN regexp_matches(r, '^\\d')
                 THEN '0' || lpad(length(ltrim(r, '0'))::VARCHAR, 10, '0') || ':' || ltrim(r, '0') ELSE '1' || lower(r) END) AS key FROM p WHERE NOT ends_with(path, '.txt')),
    n AS (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY key, path, page_id) AS unit, lower(right(path, 4)) AS ending FROM k)
    SELECT host, page_id, unit, CASE WHEN unit < 1000 THEN lpad(CAST(unit AS VARCHAR), 3, '0') ELSE CAST(unit AS VARCHAR) END || ending AS unit_name FROM n""")
def ingest_ordered_units(t: Tables):
    """Page addresses as file names of their host."""
    key = F.col("page_id") % 3
    path = F.concat("url", F.when(key == 0, ".PNG").when(key == 1, ".jpg").otherwise(".txt"))
    files = t.pages.select(F.regexp_extract("url", "https?://([^/?#]+)", 1).alias("host"), "page_id", path.alias("path"))
    return readers.ingest_ordered_units(files, ["host"], tie=["page_id"]).select("host", "page_id", "unit", "unit_name")


@query("incremental_refresh", """
    SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT coalesce(quality = 1 AND toxic = 0, FALSE)""")
def incremental_refresh(t: Tables):
    """Labels are the cache: low quality means a changed file, toxic another method."""
    docs = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("mtime"))
    cache = t.labels.join(docs, "doc_id").select(
        "doc_id", (F.col("mtime") + F.when(F.col("quality") == 1, 1e-9).otherwise(1.0)).alias("mtime"),
        F.when(F.col("toxic") == 1, "classic").otherwise("dbnet").alias("method"))
    return readers.incremental_refresh(docs, cache, ["doc_id"], "dbnet")[0].select("doc_id")


@query("incremental_refresh_cache", """
    SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND toxic = 0""")
def incremental_refresh_cache(t: Tables):
    docs = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("mtime"))
    cache = t.labels.join(docs, "doc_id").select(
        "doc_id", (F.col("mtime") + F.when(F.col("quality") == 1, 1e-9).otherwise(1.0)).alias("mtime"),
        F.when(F.col("toxic") == 1, "classic").otherwise("dbnet").alias("method"))
    return readers.incremental_refresh(docs, cache, ["doc_id"], "dbnet")[1].select("doc_id")


@query("slugs", """
    SELECT doc_id, CASE WHEN s = '' THEN 'manga-recap' ELSE s END AS slug FROM (
        SELECT doc_id, trim(regexp_replace(lower(source || '  ' || lang || '!' || text), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)""")
def slugs(t: Tables):
    """X2 over whole texts."""
    return t.documents.select("doc_id", X.slugify(F.concat("source", F.lit("  "), F.col("lang"), F.lit("!"), F.col("text"))).alias("slug"))


@query("format_labels", """
    SELECT p_partkey AS source_id, CASE p_partkey % 5 WHEN 0 THEN 'manga' WHEN 1 THEN 'manhwa' WHEN 2 THEN 'manhua' WHEN 3 THEN 'FR' END AS label
    FROM part""")
def format_labels(t: Tables):
    """Origins of titles, some without a usual word, some unknown."""
    origins = F.array(*[F.lit(x) for x in ("JP", "KR", "CN", "FR", None)])
    origin = F.get(origins, (F.col("p_partkey") % 5).cast("int"))
    return t.part.select(F.col("p_partkey").alias("source_id"), format_label(origin).alias("label"))
