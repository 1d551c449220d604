"""Queries of the evidence family: conversations are chapters, turns are units."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlens.catalog.base import TABLES_SQL, Tables, query
from seqlens.functions import text as X
from seqlens.operators import evidence as E
from seqlens.plans.scan import ordinal_block, scan
from seqlens.session import cut_lineage, spread
from seqlens.sources import readers, writers

CH = ["chapter_id"]

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _tokens_sql(col: str) -> str:
    return f"""list_distinct(list_filter(list_transform(regexp_extract_all({col}, '[a-zA-Z'']+'), lambda w: lower(w)),
               lambda w: length(w) >= 3 AND w NOT IN ({_STOP})))"""


def _names_sql(col: str) -> str:
    return f"""list_distinct(list_filter(list_transform(list_filter(
               string_split(regexp_replace({col}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '),
               lambda w: regexp_full_match(w, '[A-Z][a-z]+')), lambda w: lower(w)), lambda w: w NOT IN ({_STOP})))"""


TABLES_SQL.update({
    "v_ntok": f"SELECT chapter_id, scene, {_tokens_sql('narration')} AS nt, {_names_sql('narration')} AS nn FROM v_script",
    "v_utok": f"""SELECT chapter_id, panel, {_tokens_sql("(role || ' ' || text)")} AS ut, {_names_sql("(role || ' ' || text)")} AS un
                  FROM v_reads""",
    "v_relevance": """
        SELECT s.chapter_id, s.scene, s.ord, s.panel, s.read_pos,
               CASE WHEN least(len(nt), len(ut)) = 0 THEN 0.0
                    ELSE least(CAST(len(list_intersect(nt, ut)) AS DOUBLE) / least(len(nt), len(ut))
                         + least(len(list_intersect(nn, un)) * CAST(0.15 AS DOUBLE), CAST(0.3 AS DOUBLE)), CAST(1.0 AS DOUBLE)) END AS score
        FROM v_scene_panels s JOIN v_ntok n ON n.chapter_id = s.chapter_id AND n.scene = s.scene
        JOIN v_utok u ON u.chapter_id = s.chapter_id AND u.panel = s.panel""",
    # word runs of narration and unit text, per scene unit
    "v_run_words_n": """
        SELECT chapter_id, scene, unnest(w) AS word, unnest(range(0, len(w))) AS pa FROM (
            SELECT chapter_id, scene, list_filter(string_split_regex(lower(narration), '\\s+'), lambda x: x <> '') AS w FROM v_script)""",
    "v_run_words_u": """
        SELECT chapter_id, panel, unnest(w) AS word, unnest(range(0, len(w))) AS pb FROM (
            SELECT chapter_id, panel, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM v_reads)""",
    "v_runs": """
        SELECT chapter_id, scene, ord, panel, count(*) AS words, CAST(sum(length(word)) + count(*) - 1 AS BIGINT) AS chars,
               min(pa) AS start_a, min(pb) AS start_b
        FROM (SELECT s.chapter_id, s.scene, s.ord, s.panel, a.word, pa, pb,
                     pa - row_number() OVER (PARTITION BY s.chapter_id, s.scene, s.ord, pa - pb ORDER BY pa) AS run
              FROM v_scene_panels s JOIN v_run_words_n a ON a.chapter_id = s.chapter_id AND a.scene = s.scene
              JOIN v_run_words_u b ON b.chapter_id = s.chapter_id AND b.panel = s.panel AND b.word = a.word)
        GROUP BY chapter_id, scene, ord, panel, pa - pb, run""",
    "v_longest": """
        SELECT chapter_id, scene, ord, panel, words, chars, start_a, start_b FROM (
            SELECT *, row_number() OVER (PARTITION BY chapter_id, scene, ord ORDER BY words DESC, start_a, start_b) AS rn FROM v_runs)
        WHERE rn = 1""",
    "v_tier_reason": """
        SELECT s.*, kind, quality, CASE WHEN kind IN ('cover', 'credits', 'endmatter') THEN 'kind=' || kind
               WHEN kind = 'textonly' THEN CASE WHEN coalesce(chars, 0) < 6 THEN 'textonly not quoted' END
               WHEN s.scene = 0 AND NOT (kind = 'story' AND quality = 'ok') THEN 'hook requires story/ok' END AS first_reason
        FROM v_scene_panels s JOIN v_reads r ON r.chapter_id = s.chapter_id AND r.panel = s.panel
        LEFT JOIN v_longest l ON l.chapter_id = s.chapter_id AND l.scene = s.scene AND l.ord = s.ord""",
    "v_tier1": """
        SELECT chapter_id, scene, ord, panel, read_pos, quality, coalesce(first_reason,
               CASE WHEN quality = 'cut' AND count(*) FILTER (first_reason IS NULL AND quality <> 'cut')
                         OVER (PARTITION BY chapter_id, scene) > 0 THEN 'cut with alternatives' END) AS reason
        FROM v_tier_reason""",
})


def _script_reads(t: Tables):
    reads = t.full_reads()
    return reads.select(
        *reads.columns, X.unit_text(F.col("scene_beat"), F.col("narration_text"), F.col("dialogue")).alias("unit_text"),
        X.dialogue_text(F.col("narration_text"), F.col("dialogue")).alias("dtext"),
    )


def _quoting_script(t: Tables):
    """Narration followed by a spoken line of a unit three turns on (or the next)."""
    line = F.regexp_extract("text", r'(?U)([^.?!"\n]{12,100})[.?!\n]', 1)
    said = t.reads().select("chapter_id", (F.floor((F.col("read_pos") - 1) / 2)).cast("bigint").alias("scene"), "read_pos", line.alias("line"))
    said = said.filter("line <> ''").groupBy("chapter_id", "scene").agg(F.min_by("line", "read_pos").alias("line"))
    late = said.select("chapter_id", (F.col("scene") - 1).alias("scene"), F.col("line").alias("later"))
    return t.script().join(said, ["chapter_id", "scene"], "left").join(late, ["chapter_id", "scene"], "left").select(
        "chapter_id", "scene",
        F.concat("narration", F.coalesce(F.concat(F.lit(' Then she says: "'), "line", F.lit('".')), F.lit("")),
                 F.coalesce(F.concat(F.lit(' And one asked “'), "later", F.lit("”.")), F.lit(""))).alias("narration"),
    )


@query("relevance_join", "SELECT chapter_id, scene, ord, panel, score FROM v_relevance")
def relevance_join(t: Tables):
    return E.relevance_join(t.scene_panels(), t.script(), _script_reads(t), CH).select(
        "chapter_id", "scene", "ord", "panel", "score"
    )


@query("ambiguous_scenes", """
    SELECT chapter_id, scene, max(score) AS best, max(score) < 0.15 AS ambiguous FROM v_relevance GROUP BY 1, 2""")
def ambiguous_scenes(t: Tables):
    return E.ambiguous_scenes(E.relevance_join(t.scene_panels(), t.script(), _script_reads(t), CH), CH)


@query("verbatim_run_join", "SELECT chapter_id, scene, ord, words, chars, start_a, start_b FROM v_longest")
def verbatim_run_join(t: Tables):
    pairs = t.scene_panels().join(t.script(), ["chapter_id", "scene"]).join(t.reads().select("chapter_id", "panel", "text"), ["chapter_id", "panel"])
    pairs = spread(pairs, "chapter_id", "scene", "ord").select("chapter_id", "scene", "ord", X.plain_words("narration").alias("a"), X.plain_words("text").alias("b"))
    return E.longest_shared_run(pairs, ["chapter_id", "scene", "ord"], "a", "b").select(
        "chapter_id", "scene", "ord", "words", "chars", F.col("start_a").cast("bigint").alias("start_a"),
        F.col("start_b").cast("bigint").alias("start_b"),
    )


@query("tier1_gate", "SELECT chapter_id, scene, ord, panel, reason IS NULL AS keep, reason FROM v_tier1")
def tier1_gate(t: Tables):
    return E.tier1_gate(t.scene_panels(), t.script(), t.full_reads(), CH).drop("read_pos")


@query("usable_reads", """
    SELECT chapter_id, unit FROM (SELECT *, count(*) FILTER (kind <> 'cover') OVER (PARTITION BY chapter_id) AS n_ok FROM v_panels)
    WHERE kind <> 'cover' OR n_ok = 0""")
def usable_reads(t: Tables):
    """Documents by source, toxic ones tagged as covers."""
    return E.usable_reads(t.panels(), CH).select("chapter_id", "unit")


@query("usable_reads_by_chapter", """
    SELECT chapter_id, panel FROM (SELECT *, kind IN ('cover', 'credits') AS hard,
           count(*) FILTER (kind NOT IN ('cover', 'credits')) OVER (PARTITION BY chapter_id) AS n_ok FROM v_reads)
    WHERE NOT hard OR n_ok = 0""")
def usable_reads_by_chapter(t: Tables):
    """Short conversations include chapters made of hard kinds only."""
    return E.usable_reads(t.reads(), CH).select("chapter_id", "panel")


@query("neighbor_kinds", """
    SELECT chapter_id, read_pos, lag(kind) OVER w AS prev_kind, lead(kind) OVER w AS next_kind FROM v_reads
    WINDOW w AS (PARTITION BY chapter_id ORDER BY read_pos)""")
def neighbor_kinds(t: Tables):
    return E.neighbor_kinds(t.reads(), CH).select("chapter_id", "read_pos", "prev_kind", "next_kind")


@query("text_dominant_gate", """
    WITH s AS (SELECT page_id, CAST(length(html) AS DOUBLE) AS n, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain,
                      html, (length(html) - length(replace(html, '<p>', ''))) // 3 AS n_boxes FROM pages),
    g AS (SELECT page_id, plain / n AS coverage, 1 - plain / n AS flat, n_boxes / 100.0 AS ink, n, n_boxes, plain,
                 contains(html, 'caption') OR contains(html, 'title card') AS says, n_boxes > 12 AS art, n_boxes % 2 = 0 AS spoken FROM s),
    k AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'cover' ELSE 'story' END AS kind FROM pages),
    nk AS (SELECT page_id, lag(kind) OVER w = 'cover' AS a, lead(kind) OVER w = 'cover' AS b FROM k WINDOW w AS (ORDER BY page_id)),
    h AS (SELECT g.page_id, concat_ws('+', CASE WHEN (coverage >= 0.10 OR flat >= 0.85) AND ink <= 0.05 THEN 'R1' END,
                 CASE WHEN n <= 450 AND n_boxes >= 1 AND plain > 0 AND plain <= 20 THEN 'R2' END,
                 CASE WHEN says THEN 'R3' END, CASE WHEN coalesce(a, FALSE) OR coalesce(b, FALSE) THEN 'S4' END) AS hits, art, spoken
          FROM g JOIN nk ON nk.page_id = g.page_id)
    SELECT page_id, hits, CASE WHEN hits = '' OR art THEN 'ok' WHEN starts_with(hits, 'R1') AND NOT spoken THEN 'drop' ELSE 'suspect' END AS verdict
    FROM h""")
def text_dominant_gate(t: Tables):
    """Pages as units: share of text, paragraphs as boxes."""
    n = F.length("html").cast("double")
    plain = F.length(F.regexp_replace("html", "<[^>]*>", ""))
    boxes = F.floor((F.length("html") - F.length(F.replace("html", F.lit("<p>"), F.lit("")))) / 3)
    pages = t.pages.select(
        "page_id", F.lit(0).alias("chapter_id"), (plain / n).alias("coverage"), (1 - plain / n).alias("flat"),
        (boxes / 100.0).alias("ink_out"), n.alias("height"), boxes.alias("n_boxes"), plain.alias("chars"),
        F.concat_ws(" ", F.when(F.contains("html", F.lit("caption")), "caption"),
                    F.when(F.contains("html", F.lit("title card")), "title card")).alias("beat"),
        (boxes % 2 == 0).alias("has_dialogue"), (boxes > 12).alias("has_art"),
        F.when(F.col("page_id") % 9 == 0, "cover").otherwise("story").alias("kind"),
    )
    near = scan(pages, CH, ["page_id"], ordinal_block("page_id"), prev={"prev_kind": F.col("kind")}, nxt={"next_kind": F.col("kind")})
    return E.text_dominant_gate(near).select("page_id", F.array_join("hits", "+").alias("hits"), "verdict")


@query("anchored_quotes", """
    SELECT doc_id, quote_pos - 1 AS quote_pos, trim(quote) AS quote FROM (
        SELECT doc_id, unnest(q) AS quote, unnest(range(1, len(q) + 1)) AS quote_pos FROM (
            SELECT doc_id, list_filter(regexp_extract_all(replace(text, 'token =', 'she says'),
                   '(?i)(?:says?|said|screams?|screamed|shouts?|shouted|yells?|yelled|asks?|asked|whispers?|whispered|cries|cried|replies|replied|answers?|answered|speaks?|spoke|echo(?:es|ed)?|mutters?|muttered|calls?|called).{0,39}?[^a-zA-Z\\n]"([^"]{3,120})"', 1),
                   lambda x: length(trim(x)) >= 4) AS q FROM documents))""")
def anchored_quotes(t: Tables):
    """Assigned tokens in documents, read as spoken lines."""
    text = F.replace("text", F.lit("token ="), F.lit("she says"))
    return t.documents.select("doc_id", F.posexplode(X.anchored_quotes(text)).alias("quote_pos", "quote")).withColumn(
        "quote_pos", F.col("quote_pos").cast("bigint")
    )


def _kept(t: Tables):
    return E.tier1_gate(t.scene_panels(), t.script(), t.full_reads(), CH).filter("keep")


def _matched(t: Tables):
    reads = _script_reads(t).select("chapter_id", "panel", "dtext")
    kept = cut_lineage(_kept(t).join(reads, ["chapter_id", "panel"]).select("chapter_id", "scene", "ord", "panel", "dtext"))
    quotes = cut_lineage(E.scene_quotes(_quoting_script(t), CH))
    return cut_lineage(E.quote_match(quotes, kept, CH))


@query("quote_match")
def quote_match(t: Tables):
    """Planted quotes against the units each scene kept; scored in Python, tested against brute force."""
    return _matched(t)


def _rescued(t: Tables):
    reads = cut_lineage(_script_reads(t).select("chapter_id", "read_pos", "panel", "kind", "dtext"))
    missing = _matched(t).filter("status = 'absent'").select("chapter_id", "scene", "quote_pos", "quote")
    sizes = reads.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n_reads"))
    windows = E.quote_windows(t.scene_panels(), t.script(), sizes, CH)
    return E.quote_rescue(missing, reads, windows, CH)


@query("quote_rescue")
def quote_rescue(t: Tables):
    """Quotes absent from their scene, searched in the whole chapter."""
    return _rescued(t)


@query("quote_windows", """
    WITH low AS (SELECT chapter_id, scene, min(read_pos) AS low FROM v_scene_panels GROUP BY 1, 2)
    SELECT s.chapter_id, s.scene,
           coalesce(last_value(low IGNORE NULLS) OVER (PARTITION BY s.chapter_id ORDER BY s.scene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, -1) AS lo,
           coalesce(first_value(low IGNORE NULLS) OVER (PARTITION BY s.chapter_id ORDER BY s.scene ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS hi
    FROM v_script s LEFT JOIN low ON low.chapter_id = s.chapter_id AND low.scene = s.scene
    JOIN (SELECT chapter_id, count(*) AS n FROM v_reads GROUP BY 1) r ON r.chapter_id = s.chapter_id""")
def quote_windows(t: Tables):
    sizes = t.reads().groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n_reads"))
    return E.quote_windows(t.scene_panels(), t.script(), sizes, CH)


@query("substitute_units")
def substitute_units(t: Tables):
    """Scenes emptied by the first gate, filled from nearby units round by round."""
    return E.substitute_units(_kept(t), t.script(), t.scene_panels(), _script_reads(t), CH)


@query("drop_protection")
def drop_protection(t: Tables):
    """Every kept unit is proposed for a drop; appended quotes protect theirs."""
    kept = _kept(t).select("chapter_id", "scene", "ord", "panel")
    kept = cut_lineage(kept)
    appended = _rescued(t).filter("status = 'append'").select("chapter_id", "scene", "panel")
    return E.drop_protection(
        kept.select("chapter_id", "scene", "panel").distinct(), kept, _quoting_script(t), _script_reads(t), appended, CH
    )


@query("apply_relevance_verdicts", """
    SELECT t.chapter_id, t.scene, t.ord, t.panel FROM v_tier1 t
    JOIN v_reads r ON r.chapter_id = t.chapter_id AND r.panel = t.panel
    WHERE reason IS NULL AND NOT (length(text) % 3 = 0 AND t.ord <> (
        SELECT max(ord) FROM v_tier1 x WHERE x.reason IS NULL AND x.chapter_id = t.chapter_id AND x.scene = t.scene))""")
def apply_relevance_verdicts(t: Tables):
    """Answers from text length; only the final unit of a scene is protected."""
    kept = _kept(t).select("chapter_id", "scene", "ord", "panel")
    answers = kept.join(t.reads().select("chapter_id", "panel", "text"), ["chapter_id", "panel"]).select(
        "chapter_id", "scene", "ord", F.when(F.length("text") % 3 == 0, False).when(F.length("text") % 3 == 1, True).alias("relevant")
    )
    final = kept.groupBy("chapter_id", "scene").agg(F.max_by("panel", "ord").alias("panel"))
    return E.apply_relevance_verdicts(kept, answers, final, CH)


TABLES_SQL["v_fix_scenes"] = """
    SELECT DISTINCT chapter_id, scene FROM v_reads JOIN (SELECT chapter_id, scene FROM v_script) s USING (chapter_id)
    WHERE length(text) % 5 = 0 AND read_pos // 2 = scene"""


@query("apply_fixes", """
    WITH r AS (SELECT s.chapter_id, s.scene, s.ord, s.panel, s.read_pos,
                      CASE WHEN kind IN ('cover', 'credits', 'endmatter', 'textonly') OR quality = 'sparse' THEN 'dropped' ELSE 'kept' END AS action
               FROM v_scene_panels s JOIN v_fix_scenes f ON f.chapter_id = s.chapter_id AND f.scene = s.scene
               JOIN v_reads u ON u.chapter_id = s.chapter_id AND u.panel = s.panel),
    e AS (SELECT chapter_id, scene, arg_min(read_pos, ord) AS n FROM r GROUP BY 1, 2 HAVING count(*) FILTER (action = 'kept') = 0)
    SELECT chapter_id, scene, CAST(ord AS BIGINT) AS ord, panel, action FROM r
    UNION ALL
    SELECT e.chapter_id, e.scene, 0, arg_min(u.panel, abs(u.read_pos - e.n) * 100000 + u.read_pos), 'replaced'
    FROM e JOIN v_reads u ON u.chapter_id = e.chapter_id AND u.kind = 'story' AND u.quality = 'ok' GROUP BY 1, 2""")
def apply_fixes(t: Tables):
    faults = t.reads().filter("length(text) % 5 = 0").select(
        "chapter_id", F.floor(F.col("read_pos") / 2).cast("bigint").alias("scene"), F.lit("irrelevant_panel").alias("type")
    )
    slots = t.scene_panels().withColumn("number", F.col("read_pos"))
    reads = t.reads().withColumn("number", F.col("read_pos"))
    return E.apply_fixes(slots, faults, reads, CH)


@query("verification_summary", """
    SELECT chapter_id, action, count(*) AS n FROM (
        SELECT chapter_id, CASE WHEN reason IS NULL THEN 'keep' ELSE 'drop' END AS action FROM v_tier1) GROUP BY 1, 2""")
def verification_summary(t: Tables):
    log = E.tier1_gate(t.scene_panels(), t.script(), t.full_reads(), CH)
    return E.verification_summary(log.withColumn("action", F.when(F.col("keep"), "keep").otherwise("drop")), CH)


@query("changed_scenes", """
    SELECT DISTINCT chapter_id, scene FROM v_tier1 WHERE reason IS NOT NULL""")
def changed_scenes(t: Tables):
    """Scenes whose unit list differs after the first gate."""
    log = E.tier1_gate(t.scene_panels(), t.script(), t.full_reads(), CH)
    units = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "panel")))).alias("units")
    before = log.groupBy("chapter_id", "scene").agg(units(F.lit(True)))
    after = log.groupBy("chapter_id", "scene").agg(units(F.col("keep")))
    return E.changed_scenes(before, after, CH)


@query("merge_reads_by_map", """
    WITH m AS (SELECT chapter_id, read_pos, role, text, kind, 'n' || CAST(read_pos // 3 AS VARCHAR) AS new_panel, quality FROM v_reads),
    u AS (SELECT DISTINCT chapter_id, 'n' || CAST(unnest([read_pos // 3, read_pos // 3 + 1]) AS VARCHAR) AS new_panel FROM v_reads)
    SELECT u.chapter_id, u.new_panel, coalesce(beats, '') AS scene_beat, coalesce(spoken, '') AS spoken,
           coalesce(kind, 'art') AS kind, coalesce(quality, 'ok') AS quality
    FROM u LEFT JOIN (SELECT chapter_id, new_panel, string_agg(role, ' / ' ORDER BY read_pos) AS beats, string_agg(text, '|' ORDER BY read_pos) AS spoken,
                             arg_min(kind, read_pos) AS kind, arg_min(quality, read_pos) AS quality FROM m GROUP BY 1, 2) g
      ON g.chapter_id = u.chapter_id AND g.new_panel = u.new_panel""")
def merge_reads_by_map(t: Tables):
    """Three turns per new unit; the unit after the last is unfed unless it exists."""
    slot = F.floor(F.col("read_pos") / 3)
    name = lambda c: F.concat(F.lit("n"), c.cast("bigint").cast("string"))
    mapping = t.reads().select("chapter_id", "panel", name(slot).alias("new_panel"))
    units = t.reads().select("chapter_id", F.explode(F.array(slot, slot + 1)).alias("slot")).select(
        "chapter_id", name(F.col("slot")).alias("panel")
    ).distinct()
    merged = E.merge_reads_by_map(t.full_reads(), mapping, units, CH)
    return merged.select(
        "chapter_id", "new_panel", "scene_beat", F.array_join(F.transform("dialogue", lambda d: d["text"]), "|").alias("spoken"),
        "kind", "quality",
    )


@query("prefer_cleaned", """
    WITH f AS (SELECT md5(text) AS h, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1)
    SELECT doc_id, CASE WHEN quality = 1 THEN 'clean/' || CAST(doc_id AS VARCHAR) ELSE 'raw/' || CAST(doc_id AS VARCHAR) END AS resolved,
           coalesce(quality, 0) <> 1 AND n > 1 AS no_crop
    FROM documents d LEFT JOIN labels l USING (doc_id) JOIN f ON f.h = md5(d.text)""")
def prefer_cleaned(t: Tables):
    """Good labels are cleaned versions; texts with copies carry a mark."""
    name = lambda folder: F.concat(F.lit(folder), F.col("doc_id").cast("string")).alias("path")
    docs = t.documents.select("source", "doc_id", F.md5("text").alias("h"))
    copies = docs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    refs = docs.select(F.lit(0).alias("chapter_id"), F.col("doc_id").alias("panel"), name("raw/"))
    cleaned = t.labels.filter("quality = 1").select(F.lit(0).alias("chapter_id"), F.col("doc_id").alias("panel"), name("clean/"))
    marked = docs.join(copies, "h").select(F.lit(0).alias("chapter_id"), F.col("doc_id").alias("panel"))
    return E.prefer_cleaned(refs, cleaned, marked, CH).select(F.col("panel").alias("doc_id"), "resolved", "no_crop")


_MOOD_CUES = {
    "Calm": r"\b(the|und|les|los)\b", "Dark": r"\b(of|der|de)\b", "Epic": r"\b(and|die|la)\b", "Fun": r"\b(token|http|copyright)\b",
}


@query("mood_vote", """
    WITH w AS (SELECT source, lang, unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ')) AS w FROM documents),
    c AS (SELECT source, lang, unnest([{'m': 'Calm', 'p': 15, 'n': count(*) FILTER (w IN ('the', 'und', 'les', 'los'))},
                 {'m': 'Dark', 'p': 20, 'n': count(*) FILTER (w IN ('of', 'der', 'de'))},
                 {'m': 'Epic', 'p': 0, 'n': count(*) FILTER (w IN ('and', 'die', 'la'))},
                 {'m': 'Fun', 'p': 13, 'n': count(*) FILTER (w IN ('token', 'http', 'copyright'))}]) AS s FROM w GROUP BY 1, 2)
    SELECT source, lang, CASE WHEN max(s.n) > 0 THEN arg_max(s.m, s.n * 100 - s.p) ELSE 'Cinematic' END AS mood, max(s.n) AS n_hits
    FROM c GROUP BY 1, 2""")
def mood_vote(t: Tables):
    return E.mood_vote(t.documents, ["source", "lang"], "text", _MOOD_CUES)


def _mood_sql() -> str:
    """Counts of every mood's cues in a text whose words stand between marks."""
    mark = "\x01"
    counts = [
        f"sum(len(regexp_extract_all(b, '{mark}{cue[2:-2].replace(' ', f'{mark} {mark}').replace('(', '(?:')}{mark}'))) AS n{i}"
        for i, cue in enumerate(E.MOOD_CUES.values())]
    votes = ", ".join(f"{{'m': '{m}', 'p': {E.MOODS.index(m)}, 'n': n{i}}}" for i, m in enumerate(E.MOOD_CUES))
    return f"""
    WITH x AS (SELECT chapter_id, lower(narration) AS b FROM v_script
               UNION ALL SELECT DISTINCT chapter_id, ['never give up', 'a secret promise', 'Fast!', 'of'][chapter_id % 4 + 1] FROM v_script),
    m AS (SELECT chapter_id, regexp_replace(lower(b), '([\\p{{L}}\\p{{N}}_]+)', '{mark}\\1{mark}', 'g') AS b FROM x),
    c AS (SELECT chapter_id, {", ".join(counts)} FROM m GROUP BY 1),
    v AS (SELECT chapter_id, unnest([{votes}]) AS s FROM c),
    t AS (SELECT chapter_id, max(s.n) AS n, arg_max(s.m, s.n * 100 - s.p) AS mood FROM v GROUP BY 1)
    SELECT chapter_id, CASE WHEN chapter_id % 5 = 0 THEN 'Calm' WHEN n > 0 THEN mood ELSE 'Cinematic' END AS mood,
           CASE WHEN chapter_id % 5 = 0 THEN 'script' WHEN n > 0 THEN 'vote' ELSE 'default' END AS why
    FROM t"""


@query("derive_mood", _mood_sql())
def derive_mood(t: Tables):
    """The whole table of cues over narrations and titles; every fifth script names its mood."""
    s = t.script()
    none = F.lit(None).cast("string")
    scenes = s.select("chapter_id", "narration", none.alias("caption"), F.array(none).alias("keywords"))
    titles = F.array(*[F.lit(x) for x in ("never give up", "a secret promise", "Fast!", "of")])
    scripts = s.select("chapter_id").distinct().select(
        "chapter_id", F.get(titles, (F.col("chapter_id") % 4).cast("int")).alias("title"),
        F.when(F.col("chapter_id") % 5 == 0, "Calm").alias("music_mood"))
    return E.derive_mood(scenes, scripts, CH)


@query("recurring_names", """
    WITH w AS (SELECT source, doc_id, unnest(l) AS name, unnest(range(0, len(l))) AS pos FROM (
                   SELECT source, doc_id, list_filter(string_split(regexp_replace(text, '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '),
                          lambda x: regexp_full_match(x, '[A-Z][a-z]{3,}')) AS l FROM documents)),
    c AS (SELECT source, name, count(*) AS n, min((doc_id, pos)) AS f FROM w WHERE name NOT IN (
              'This', 'That', 'Then', 'There', 'They', 'When', 'Where', 'What', 'With', 'From', 'Above', 'Below', 'After',
              'Before', 'Someone', 'Something', 'Chapter', 'Because', 'Instead') GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS rank FROM c)
    SELECT source, name, n, rank FROM r WHERE rank <= 6 AND n >= 5""")
def recurring_names(t: Tables):
    return E.recurring_names(t.documents, ["source"], "doc_id", "text").withColumn("rank", F.col("rank").cast("bigint"))


@query("confusion_matrix", """
    WITH r AS (SELECT source, quality = 0 AS pos, n_chars % 5 = 0 AS drop, n_chars % 5 <> 0 AND n_chars % 3 = 0 AS suspect
               FROM documents JOIN labels USING (doc_id))
    SELECT source, caught_drop, caught_suspect, missed, false_drops, negative_suspects,
           caught_drop + caught_suspect >= 2 AND false_drops = 0 AS accepted
    FROM (SELECT source, count(*) FILTER (pos AND drop) AS caught_drop, count(*) FILTER (pos AND suspect) AS caught_suspect,
                 count(*) FILTER (pos AND NOT drop AND NOT suspect) AS missed, count(*) FILTER (NOT pos AND drop) AS false_drops,
                 count(*) FILTER (NOT pos AND suspect) AS negative_suspects FROM r GROUP BY 1)""")
def confusion_matrix(t: Tables):
    """Length decides the verdict, labels the truth."""
    n = F.col("n_chars")
    log = t.documents.select(
        "source", F.col("doc_id").alias("unit"), F.explode(F.array_compact(F.array(
            F.when(n % 5 == 0, "drop"), F.when(n % 3 == 0, "suspect")))).alias("verdict"),
    )
    labels = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        "source", F.col("doc_id").alias("unit"), (F.col("quality") == 0).alias("positive")
    )
    return E.confusion_matrix(log, labels, ["source"], enough=2)


@query("window_text", """
    SELECT s.chapter_id, string_agg(narration, ' ' ORDER BY scene) AS text FROM v_script s
    LEFT JOIN (SELECT chapter_id, 1 AS lo, max(scene) - 1 AS hi FROM v_script GROUP BY 1 HAVING max(scene) >= 2) w ON w.chapter_id = s.chapter_id
    WHERE w.lo IS NULL OR scene BETWEEN lo AND hi GROUP BY 1""")
def window_text(t: Tables):
    """Short chapters have no window and give all their scenes."""
    windows = t.script().groupBy("chapter_id").agg(F.max("scene").alias("m")).filter("m >= 2").select(
        "chapter_id", F.lit(1).alias("first"), (F.col("m") - 1).alias("last")
    )
    return E.window_text(t.script(), windows, CH)


@query("load_reads", """
    SELECT chapter_id, read_pos // 6 AS batch, read_pos % 6 AS pos, panel,
           CASE WHEN read_pos // 6 = 0 AND chapter_id % 3 = 2 THEN '' WHEN (read_pos % 6) >= 4 THEN '' ELSE role END AS scene_beat,
           CASE WHEN read_pos // 6 = 0 AND chapter_id % 3 = 2 THEN 'story' WHEN (read_pos % 6) >= 4 THEN 'story' ELSE kind END AS kind,
           CASE WHEN read_pos // 6 = 0 AND chapter_id % 3 = 2 OR (read_pos % 6) >= 4 THEN 0 ELSE 1 END AS n_lines
    FROM v_reads""")
def load_reads(t: Tables):
    """Answers fenced, wrapped in prose, or broken; units past the fourth are missing."""
    r = t.full_reads().withColumns({"batch": F.floor(F.col("read_pos") / 6).cast("bigint"), "pos": F.col("read_pos") % 6})
    item = F.struct(F.lit("renamed.png").alias("panel"), "dialogue", "scene_beat", "kind")
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") < 4, F.struct("pos", item.alias("i"))))), lambda x: x["i"])
    which = F.col("chapter_id") % 3
    answers = r.groupBy("chapter_id", "batch").agg(items.alias("items")).select(
        "chapter_id", "batch",
        F.when(which == 0, F.concat(F.lit("```json\n"), F.to_json("items"), F.lit("\n```")))
        .when(which == 1, F.concat(F.lit("Here you go: "), F.to_json("items"), F.lit(" done")))
        .otherwise(F.when(F.col("batch") == 0, "no json at all").otherwise(F.to_json("items"))).alias("answer"),
    )
    units = r.select("chapter_id", "batch", "pos", "panel")
    return readers.parse_reads(answers, units, CH).select(
        "chapter_id", "batch", "pos", "panel", "scene_beat", "kind", F.size("dialogue").alias("n_lines")
    )


@query("load_script", """
    SELECT chapter_id, scene, 0 AS ord, 'a' || CAST(panel AS VARCHAR) || '.png' AS panel FROM v_scenes
    UNION ALL SELECT chapter_id, scene, 1, 'b' || CAST(panel AS VARCHAR) || '.png' FROM v_scenes WHERE NOT emphasis""")
def load_script(t: Tables):
    """Script documents with unit lists or a single unit per scene."""
    s = t.scenes()
    ref = lambda letter: F.concat(F.lit(f"panels/{letter}"), F.col("panel").cast("string"), F.lit(".png"))
    scene = F.struct(
        F.col("pace"), F.col("ambience"),
        F.when(~F.col("emphasis"), F.array(ref("a"), ref("b"))).alias("panels"),
        F.when(F.col("emphasis"), ref("a")).alias("panel"),
    )
    docs = s.select("chapter_id", F.col("scene").alias("at"), F.to_json(F.struct(F.array(scene).alias("scenes"))).alias("value"))
    parts = readers.parse_script(docs, ["chapter_id", "at"])
    return parts["scene_panels"].select("chapter_id", F.col("at").alias("scene"), "ord", "panel")


def _script_parts(t: Tables):
    """One document per scene with its narration, a sound on its first word and, on every third, a music section."""
    at = F.col("scene")
    first = F.get(F.filter(F.split("narration", r"\s+"), lambda w: w != ""), F.lit(0))
    scene = F.struct(
        "narration", F.when(at % 2 == 0, "fast").alias("pace"), (at % 5 == 0).alias("cta"),
        F.array(F.struct(F.lit("thud").alias("cue"), first.alias("word"), (at % 4 / 4).alias("gain"))).alias("sfx_events"))
    section = F.struct(F.lit("Epic").alias("mood"), at.cast("int").alias("from_scene"), F.concat(F.lit("t"), at.cast("string")).alias("track"))
    doc = F.struct(F.when(at % 3 == 0, F.array(section)).alias("music_plan"), F.array(scene).alias("scenes"))
    docs = t.script().select("chapter_id", F.col("scene").alias("at"), F.to_json(doc).alias("value"))
    return readers.parse_script(docs, ["chapter_id", "at"])


@query("script_scenes", """
    SELECT chapter_id, scene, narration, CASE WHEN scene % 2 = 0 THEN 'fast' END AS pace, scene % 5 = 0 AS cta FROM v_script""")
def script_scenes(t: Tables):
    return _script_parts(t)["scenes"].select("chapter_id", F.col("at").alias("scene"), "narration", "pace", "cta")


@query("script_words", """
    SELECT chapter_id, scene, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM (
        SELECT chapter_id, scene, list_filter(string_split_regex(narration, '\\s+'), lambda x: x <> '') AS w FROM v_script)""")
def script_words(t: Tables):
    return _script_parts(t)["words"].select("chapter_id", F.col("at").alias("scene"), F.col("pos").cast("bigint").alias("pos"), "word")


@query("script_sfx_events", """
    SELECT chapter_id, scene, 'thud' AS cue, list_filter(string_split_regex(narration, '\\s+'), lambda x: x <> '')[1] AS word,
           CAST(scene % 4 AS DOUBLE) / 4 AS gain FROM v_script""")
def script_sfx_events(t: Tables):
    return _script_parts(t)["sfx_events"].select("chapter_id", F.col("at").alias("scene"), "cue", "word", "gain")


@query("script_music_plan", """
    SELECT chapter_id, CAST(scene AS INTEGER) AS from_scene, 'Epic' AS mood, 't' || CAST(scene AS VARCHAR) AS track
    FROM v_script WHERE scene % 3 = 0""")
def script_music_plan(t: Tables):
    return _script_parts(t)["music_plan"].select("chapter_id", "from_scene", "mood", "track")


@query("caption_events", """
    SELECT chapter_id, scene, pos, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS stamp
    FROM (SELECT *, CAST(round_even(w_start * 100, 0) AS BIGINT) AS cs FROM v_words)""")
def caption_events(t: Tables):
    rows = writers.caption_events(t.words().select(
        "chapter_id", "scene", "pos", F.col("w_start").alias("start"), F.col("w_end").alias("end"), F.col("word").alias("text")
    ))
    return rows.select("chapter_id", "scene", "pos", F.regexp_extract("ass", r"^Dialogue: 0,([^,]+),", 1).alias("stamp"))
