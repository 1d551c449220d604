"""Queries of the review family: every event is one fault, users are chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlens.catalog.base import TABLES_SQL, Tables, query
from seqlens.functions.values import minutes_seconds
from seqlens.operators import review as R
from seqlens.session import cut_lineage
from seqlens.sources import readers

CH = ["chapter_id"]
WINDOW = 6 * 3600.0

TABLES_SQL.update({
    # baseline voted over five passes, experiment over three
    "v_voted_raw": """
        SELECT chapter_id, arm, scene, type, CASE arm WHEN 'baseline' THEN pass ELSE pass3 END AS pass,
               t, severity, detail, ord FROM v_faults""",
    "v_once": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, arm, scene, type, pass ORDER BY ord) AS rn
                       FROM v_voted_raw) WHERE rn = 1""",
    "v_voted": """
        SELECT chapter_id, arm, scene, type, hits, n_passes, t, severity, detail, ord,
               CAST(hits AS VARCHAR) || '/' || CAST(n_passes AS VARCHAR) AS votes
        FROM (SELECT *, CAST(count(*) OVER k AS INTEGER) AS hits, CASE arm WHEN 'baseline' THEN 5 ELSE 3 END AS n_passes,
                     row_number() OVER (PARTITION BY chapter_id, arm, scene, type ORDER BY pass) AS first
              FROM v_once WINDOW k AS (PARTITION BY chapter_id, arm, scene, type))
        WHERE first = 1""",
    "v_scored": "SELECT * FROM v_voted WHERE hits >= ceil(n_passes / 2)",
    "v_frac": """
        SELECT chapter_id, greatest(max(ceil(n / 2) / n), CASE WHEN count(*) < 2 THEN 1.0 ELSE 0.0 END) AS frac
        FROM (SELECT chapter_id, arm, max(n_passes) AS n FROM v_scored GROUP BY 1, 2) GROUP BY 1""",
    "v_kept": """
        SELECT s.* FROM v_scored s JOIN v_frac f ON s.chapter_id = f.chapter_id
        WHERE CAST(hits AS DOUBLE) / n_passes >= frac - 1e-9""",
    "v_pairs": """
        SELECT coalesce(b.chapter_id, c.chapter_id) AS chapter_id,
               CASE WHEN b.ord IS NULL THEN c.scene ELSE b.scene END AS scene, coalesce(b.type, c.type) AS type,
               b.ord AS base_ord, c.ord AS cur_ord, b.t AS base_t, c.t AS cur_t, c.severity AS cur_severity,
               c.votes AS cur_votes, b.votes AS base_votes,
               CASE WHEN b.ord IS NULL THEN 'added' WHEN c.ord IS NULL THEN 'removed' ELSE 'common' END AS status
        FROM (SELECT * FROM v_kept WHERE arm = 'baseline') b
        FULL OUTER JOIN (SELECT * FROM v_kept WHERE arm = 'experiment') c
          ON b.chapter_id = c.chapter_id AND b.type = c.type AND b.scene IS NOT DISTINCT FROM c.scene""",
    "v_added": """
        SELECT p.*, EXISTS (SELECT 1 FROM v_faults b WHERE b.arm = 'baseline' AND b.chapter_id = p.chapter_id
               AND b.frame_md5 = md5(CAST(p.chapter_id AS VARCHAR) || CASE p.type WHEN 'review_error' THEN 'error' ELSE p.type END)
               AND b.t BETWEEN greatest(0, p.cur_t - 21600) AND p.cur_t + 21600) AS exempt
        FROM v_pairs p""",
    "v_matched": """
        SELECT *, n_cur - n_base - n_exempt AS net FROM (
            SELECT chapter_id, type, count(*) FILTER (status <> 'added') AS n_base,
                   count(*) FILTER (status <> 'removed') AS n_cur,
                   count(*) FILTER (status = 'added' AND exempt) AS n_exempt
            FROM v_added WHERE type <> 'review_error' GROUP BY 1, 2) WHERE n_cur > n_base""",
    "v_media": """
        SELECT c_custkey AS chapter_id, c_acctbal / 10 AS duration, (c_acctbal + c_nationkey * 20) / 10 AS base_duration,
               CAST(c_nationkey - 20 AS DOUBLE) AS lufs FROM customer""",
    "v_defaults": """
        SELECT chapter_id, coalesce(string_agg(type, ',' ORDER BY type) FILTER (b = 0 AND c > 0 AND type <> 'review_error'), '') AS new_types,
               coalesce(string_agg(type, ',' ORDER BY type) FILTER (c > b AND type <> 'review_error'), '') AS worsened_types
        FROM (SELECT chapter_id, type, count(*) FILTER (arm = 'baseline') AS b, count(*) FILTER (arm = 'experiment') AS c
              FROM v_faults GROUP BY 1, 2) GROUP BY 1""",
})


def _voted(t: Tables):
    """Faults voted per arm with unequal pass counts."""
    rows = t.faults().withColumn(
        "pass", F.when(F.col("arm") == "baseline", F.col("pass")).otherwise(F.col("pass3"))
    ).drop("pass3", "frame_md5")
    sizes = F.when(F.col("arm") == "baseline", 5).otherwise(3)
    passes = rows.select("chapter_id", "arm").distinct().select(
        "chapter_id", "arm", F.explode(F.sequence(F.lit(0), sizes - 1)).alias("pass")
    )
    return R.majority_vote(rows, passes, ["chapter_id", "arm"])


def _kept(t: Tables):
    return R.consensus_filter(_voted(t).filter("status = 'scored'").drop("pass"), CH).filter("kept")


def _pairs(t: Tables):
    kept = _kept(t).select("chapter_id", "arm", "scene", "type", "t", "severity", "votes", "ord")
    return R.matched_pair_diff(kept, CH)


def _matched(t: Tables):
    pairs = _pairs(t)
    raw_type = F.when(F.col("type") == "review_error", "error").otherwise(F.col("type"))
    flat = pairs.select(
        *pairs.columns, F.col("cur.t").alias("t"),
        F.md5(F.concat(F.col("chapter_id").cast("string"), raw_type)).alias("frame_md5"),
    )
    marks = t.faults().filter("arm = 'baseline'").select("chapter_id", F.col("frame_md5").alias("md5"), "t")
    return R.matched_vetoes(R.frame_hash_exempt(flat, marks, CH, WINDOW), CH)


def _media(t: Tables):
    bal, nat = F.col("c_acctbal"), F.col("c_nationkey")
    return t.customer.select(
        F.col("c_custkey").alias("chapter_id"), (bal / 10).alias("duration"),
        ((bal + nat * 20) / 10).alias("base_duration"), (nat - 20).cast("double").alias("lufs"),
    )


@query("load_faults", """
    SELECT chapter_id, ord, scene, type, severity, t FROM v_faults""")
def load_faults(t: Tables):
    """Fault files: bare arrays and wrapped objects, with objects lacking a type."""
    f = t.faults()
    item = F.to_json(F.struct("scene", "t", "type", "severity", "detail"))
    bare = F.concat(F.lit("["), item, F.lit(', {"detail": "no type"}, {"type": ""}]'))
    wrapped = F.concat(F.lit('{"faults": ['), item, F.lit("]}"))
    files = f.select("chapter_id", "ord", F.when(F.col("arm") == "baseline", bare).otherwise(wrapped).alias("value"))
    return readers.parse_faults(files, ["chapter_id", "ord"]).select(
        "chapter_id", "ord", "scene", "type", "severity", "t"
    )


@query("weighted_score", """
    SELECT chapter_id, CAST(sum(CASE severity WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS score
    FROM v_faults GROUP BY 1""")
def weighted_score(t: Tables):
    return R.weighted_score(t.faults(), CH)


@query("severity_counts", """
    SELECT chapter_id, count(*) AS total, count(*) FILTER (severity = 'high') AS high,
           count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
    FROM v_faults GROUP BY 1""")
def severity_counts(t: Tables):
    return R.severity_counts(t.faults(), CH)


@query("type_counts", "SELECT chapter_id, type, count(*) AS n FROM v_faults GROUP BY 1, 2")
def type_counts(t: Tables):
    return R.type_counts(t.faults(), CH)


@query("majority_vote", """
    SELECT chapter_id, arm, scene, type, votes, t, severity, ord,
           CASE WHEN hits >= ceil(n_passes / 2) THEN 'scored' WHEN severity = 'high' THEN 'unconfirmed'
                ELSE 'dropped' END AS status
    FROM v_voted""")
def majority_vote(t: Tables):
    """Two arms, five and three passes."""
    return _voted(t).select("chapter_id", "arm", "scene", "type", "votes", "t", "severity", "ord", "status")


@query("consensus_filter", """
    SELECT s.chapter_id, arm, scene, type, votes, f.frac,
           CAST(hits AS DOUBLE) / n_passes >= f.frac - 1e-9 AS kept
    FROM v_scored s JOIN v_frac f ON s.chapter_id = f.chapter_id""")
def consensus_filter(t: Tables):
    return R.consensus_filter(_voted(t).filter("status = 'scored'"), CH).select(
        "chapter_id", "arm", "scene", "type", "votes", "frac", "kept"
    )


@query("matched_pair_diff", """
    SELECT chapter_id, scene, type, status, base_ord, cur_ord FROM v_pairs""")
def matched_pair_diff(t: Tables):
    return _pairs(t).select(
        "chapter_id", "scene", "type", "status", F.col("base.ord").alias("base_ord"), F.col("cur.ord").alias("cur_ord")
    )


@query("frame_hash_exempt", """
    SELECT c.chapter_id, c.ord, EXISTS (SELECT 1 FROM v_faults b WHERE b.arm = 'baseline'
           AND b.chapter_id = c.chapter_id AND b.frame_md5 = c.frame_md5
           AND b.t BETWEEN greatest(0, c.t - 21600) AND c.t + 21600) AS exempt
    FROM v_faults c WHERE c.arm = 'experiment'""")
def frame_hash_exempt(t: Tables):
    f = t.faults()
    marks = f.filter("arm = 'baseline'").select("chapter_id", F.col("frame_md5").alias("md5"), "t")
    return R.frame_hash_exempt(f.filter("arm = 'experiment'"), marks, CH, WINDOW).select("chapter_id", "ord", "exempt")


@query("frame_proofs", """
    WITH e AS (SELECT *, printf('%.3f', t) AS t_key FROM v_faults WHERE arm = 'experiment'),
    l AS (SELECT DISTINCT chapter_id FROM v_faults WHERE arm = 'baseline' AND chapter_id % 3 = 0),
    s AS (SELECT chapter_id, t_key, bool_or(severity <> 'low') AS proof FROM e
          WHERE chapter_id % 2 = 0 AND t IS NOT NULL GROUP BY 1, 2)
    SELECT e.chapter_id, e.ord,
           CASE WHEN l.chapter_id IS NOT NULL THEN 'live' WHEN s.t_key IS NOT NULL THEN 'archived' ELSE 'none' END AS origin,
           CASE WHEN l.chapter_id IS NULL THEN coalesce(s.proof, false) ELSE EXISTS (
               SELECT 1 FROM v_faults b WHERE b.arm = 'baseline' AND b.chapter_id = e.chapter_id AND b.frame_md5 = e.frame_md5
               AND b.t BETWEEN greatest(0, e.t - 21600) AND e.t + 21600) END AS exempt
    FROM e LEFT JOIN l ON l.chapter_id = e.chapter_id
    LEFT JOIN s ON s.chapter_id = e.chapter_id AND s.t_key = e.t_key""")
def frame_proofs(t: Tables):
    """Every third chapter still has its frames; even ones have an archive of the same window, odd ones of another."""
    f = t.faults()
    cur = f.filter("arm = 'experiment'")
    marks = f.filter("arm = 'baseline' AND chapter_id % 3 = 0").select("chapter_id", F.col("frame_md5").alias("md5"), "t")
    exempt = F.col("severity") != "low"
    pair = F.struct(
        "t", exempt.alias("frame_hash_exempt"), F.when(exempt, F.struct(F.col("frame_md5"))).alias("frame_hash_proof"))
    made = F.when(F.col("chapter_id") % 2 == 0, float(WINDOW)).otherwise(6.0)
    report = F.to_json(F.struct(F.struct(
        F.struct(made.alias("window_s")).alias("frame_hash"),
        F.array(F.struct(F.array(pair).alias("pairs_added"))).alias("annotated_vetoes"),
    ).alias("matched_vetoes")))
    archive = R.sidecar_from_reports(cur.select("chapter_id", "ord", report.alias("report")), ["chapter_id", "ord"]).drop("ord")
    return R.frame_proofs(cur, marks, archive, CH, WINDOW).select("chapter_id", "ord", "origin", "exempt")


@query("default_vetoes", "SELECT * FROM v_defaults")
def default_vetoes(t: Tables):
    return R.default_vetoes(t.faults(), CH).select(
        "chapter_id", F.array_join("new_types", ",").alias("new_types"),
        F.array_join("worsened_types", ",").alias("worsened_types"),
    )


@query("new_types", """
    SELECT DISTINCT chapter_id, type FROM v_faults c WHERE arm = 'experiment' AND type <> 'review_error'
      AND NOT EXISTS (SELECT 1 FROM v_faults b WHERE b.arm = 'baseline' AND b.chapter_id = c.chapter_id AND b.type = c.type)""")
def new_types(t: Tables):
    return R.new_types(t.faults(), CH)


@query("matched_vetoes", """
    SELECT m.chapter_id, m.type, n_base, n_cur, n_exempt, net, net <= 0 AS suppressed,
           net > 0 AND n_base = 0 AS new_type, coalesce(added, '') AS added, coalesce(removed, '') AS removed
    FROM v_matched m LEFT JOIN (
        SELECT chapter_id, type,
               string_agg(CASE WHEN status = 'added' THEN coalesce(CAST(scene AS VARCHAR), 'None') || ':' || cur_votes END, ','
                          ORDER BY '(' || coalesce(CAST(scene AS VARCHAR), 'None') || ', ') AS added,
               string_agg(CASE WHEN status = 'removed' THEN coalesce(CAST(scene AS VARCHAR), 'None') || ':' || base_votes END, ','
                          ORDER BY '(' || coalesce(CAST(scene AS VARCHAR), 'None') || ', ') AS removed
        FROM v_pairs GROUP BY 1, 2) l ON l.chapter_id = m.chapter_id AND l.type = m.type""")
def matched_vetoes(t: Tables):
    show = lambda col: F.array_join(F.transform(col, lambda p: F.concat(
        F.coalesce(p["scene"].cast("string"), F.lit("None")), F.lit(":"), p["votes"])), ",")
    return _matched(t).select(
        "chapter_id", "type", "n_base", "n_cur", "n_exempt", "net", "suppressed", "new_type",
        show(F.col("pairs_added")).alias("added"), show(F.col("pairs_removed")).alias("removed"),
    )


_VERDICT_SQL = """
    SELECT s.chapter_id, base_score, cur_score, vetoes,
           CASE WHEN cur_score < base_score AND vetoes = '' THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM (SELECT chapter_id, CAST(sum(CASE WHEN arm = 'baseline' THEN w ELSE 0 END) AS BIGINT) AS base_score,
                 CAST(sum(CASE WHEN arm = 'experiment' THEN w ELSE 0 END) AS BIGINT) AS cur_score
          FROM (SELECT *, CASE severity WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END AS w FROM v_faults)
          GROUP BY 1) s
    JOIN (SELECT f.chapter_id, concat_ws(',',
                 CASE WHEN max(m.new_type) > 0 THEN 'new_type' END, CASE WHEN max(m.worse) > 0 THEN 'worsened' END,
                 CASE WHEN max(duration) IS NULL OR max(duration) < 30 THEN 'encode' END,
                 CASE WHEN max(duration) <> 0 AND max(base_duration) <> 0
                       AND abs(max(duration) - max(base_duration)) / max(base_duration) * 100 > 5 THEN 'drift' END,
                 CASE WHEN max(lufs) NOT BETWEEN -17 AND -11 THEN 'loudness' END) AS vetoes
          FROM (SELECT DISTINCT chapter_id FROM v_faults) f
          JOIN v_media x ON x.chapter_id = f.chapter_id
          LEFT JOIN (SELECT chapter_id, CASE WHEN net > 0 AND n_base = 0 THEN 1 ELSE 0 END AS new_type,
                            CASE WHEN net > 0 THEN 1 ELSE 0 END AS worse FROM v_matched) m ON m.chapter_id = f.chapter_id
          GROUP BY 1) v ON v.chapter_id = s.chapter_id"""


def _verdicts(t: Tables, matched=None):
    m = (_matched(t) if matched is None else matched).groupBy("chapter_id").agg(
        F.array_compact(F.array(F.when(F.max("new_type"), "new_type"), F.when(F.max(F.col("net") > 0), "worsened")))
        .alias("vetoes")
    )
    return R.experiment_verdict(t.faults(), m, _media(t), CH)


@query("experiment_verdict", _VERDICT_SQL)
def experiment_verdict(t: Tables):
    return _verdicts(t).select(
        "chapter_id", "base_score", "cur_score", F.array_join("vetoes", ",").alias("vetoes"), "verdict"
    )


@query("experiment_report", f"""
    SELECT v.chapter_id, verdict, CAST(cur_score - base_score AS BIGINT) AS delta, high, coalesce(n, 0) AS n_annotated
    FROM ({_VERDICT_SQL}) v
    JOIN (SELECT chapter_id, count(*) FILTER (severity = 'high') AS high FROM v_faults GROUP BY 1) c ON c.chapter_id = v.chapter_id
    LEFT JOIN (SELECT chapter_id, count(*) AS n FROM v_matched GROUP BY 1) a ON a.chapter_id = v.chapter_id""")
def experiment_report(t: Tables):
    matched = cut_lineage(_matched(t))  # the verdicts and the report both read it
    docs = R.experiment_report(_verdicts(t, matched), R.severity_counts(t.faults(), CH), matched, CH)
    at = lambda path: F.get_json_object("report", path)
    return docs.select(
        "chapter_id", at("$.verdict").alias("verdict"), at("$.score.delta").cast("bigint").alias("delta"),
        at("$.severity_counts.high").cast("bigint").alias("high"),
        F.json_array_length(at("$.annotated_vetoes")).cast("bigint").alias("n_annotated"),
    )


@query("scope_to_changed", """
    SELECT chapter_id, ord FROM v_faults f
    WHERE EXISTS (SELECT 1 FROM v_scored s WHERE s.chapter_id = f.chapter_id AND s.scene = f.scene)""")
def scope_to_changed(t: Tables):
    """Changed scenes = scenes with a confirmed fault."""
    return R.scope_to_changed(t.faults(), _voted(t).filter("status = 'scored'"), CH).select("chapter_id", "ord")


@query("hash_window_sidecar", """
    WITH k AS (SELECT chapter_id, printf('%.3f', t) AS t_key, arg_min(t, ord) AS t, min(frame_md5) AS md5
               FROM v_faults WHERE arm = 'experiment' GROUP BY 1, 2)
    SELECT k.chapter_id, k.t_key, k.md5, coalesce(string_agg(DISTINCT b.frame_md5, ',' ORDER BY b.frame_md5), '') AS window_md5s
    FROM k LEFT JOIN v_faults b ON b.arm = 'baseline' AND b.chapter_id = k.chapter_id
         AND b.t BETWEEN greatest(0, k.t - 21600) AND k.t + 21600
    GROUP BY 1, 2, 3""")
def hash_window_sidecar(t: Tables):
    f = t.faults()
    marks = f.filter("arm = 'baseline'").select("chapter_id", F.col("frame_md5").alias("md5"), "t")
    cur = f.filter("arm = 'experiment'")
    frames = cur.select("chapter_id", F.format_string("%.3f", "t").alias("t_key"), F.col("frame_md5").alias("md5"))
    return R.hash_window_sidecar(cur, frames, marks, CH, WINDOW).select(
        "chapter_id", "t_key", "md5", F.array_join("window_md5s", ",").alias("window_md5s")
    )


@query("sidecar_from_reports", """
    SELECT user_id AS chapter_id, printf('%.3f', CAST(hour(ts) AS DOUBLE)) AS t_key,
           arg_max(md5(event_type), event_id) FILTER (value >= 40) AS md5,
           coalesce(string_agg(DISTINCT md5(event_type), ',' ORDER BY md5(event_type)) FILTER (value >= 40), '') AS window_md5s
    FROM events GROUP BY 1, 2""")
def sidecar_from_reports(t: Tables):
    """One archived report per event; several reports of a chapter share time keys."""
    exempt = F.col("value") >= 40
    pair = F.struct(
        F.hour("ts").cast("double").alias("t"), exempt.alias("frame_hash_exempt"),
        F.when(exempt, F.struct(F.md5("event_type").alias("frame_md5"))).alias("frame_hash_proof"),
    )
    report = F.to_json(F.struct(F.struct(
        F.struct(F.lit(6.0).alias("window_s")).alias("frame_hash"),
        F.array(F.struct(F.array(pair).alias("pairs_added"))).alias("annotated_vetoes"),
    ).alias("matched_vetoes")))
    reports = t.events.select(F.col("user_id").alias("chapter_id"), "event_id", report.alias("report"))
    per_report = R.sidecar_from_reports(reports, ["chapter_id", "event_id"])
    return per_report.groupBy("chapter_id", "t_key").agg(
        F.max_by("md5", F.when(F.col("md5").isNotNull(), F.col("event_id"))).alias("md5"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("window_md5s")))), ",").alias("window_md5s"),
    )


@query("recurring_types", """
    SELECT h.chapter_id, high, r.type, n_chapters, high >= 3 OR r.type IS NOT NULL AS worth_a_round
    FROM (SELECT chapter_id, count(*) FILTER (severity = 'high') AS high FROM v_faults GROUP BY 1) h
    LEFT JOIN (SELECT DISTINCT f.chapter_id, f.type, n_chapters FROM v_faults f
               JOIN (SELECT type, count(DISTINCT chapter_id) AS n_chapters FROM v_faults GROUP BY 1
                     HAVING count(DISTINCT chapter_id) >= 2) n ON n.type = f.type) r ON r.chapter_id = h.chapter_id""")
def recurring_types(t: Tables):
    return R.recurring_types(t.faults(), "chapter_id")


@query("gap_overlap", """
    WITH gaps AS (SELECT DISTINCT p_brand || '/' || p_type AS gap_id,
                         CASE p_type WHEN 'ECONOMY' THEN 'adopted' WHEN 'PROMO' THEN 'rejected' ELSE 'open' END AS status,
                         unnest(list_distinct(['click', CASE WHEN p_brand < 'Brand#2' THEN 'view' ELSE 'purchase' END])) AS type
                  FROM part)
    SELECT chapter_id, gap_id, CAST(sum(n) AS BIGINT) AS mass, string_agg(f.type, ',' ORDER BY f.type) AS types
    FROM (SELECT chapter_id, type, count(*) AS n FROM v_faults GROUP BY 1, 2) f
    JOIN gaps g ON g.type = f.type WHERE status = 'open' GROUP BY 1, 2""")
def gap_overlap(t: Tables):
    """One gap per brand and type of part; all faults of the chapters."""
    gaps = t.part.select("p_brand", "p_type").distinct().select(
        F.concat_ws("/", "p_brand", "p_type").alias("gap_id"),
        F.when(F.col("p_type") == "ECONOMY", "adopted").when(F.col("p_type") == "PROMO", "rejected")
        .otherwise("open").alias("status"),
        F.array(F.lit("click"), F.when(F.col("p_brand") < "Brand#2", "view").otherwise("purchase")).alias("fault_types"),
    )
    return R.gap_overlap(t.faults(), gaps, "chapter_id").select(
        "chapter_id", "gap_id", "mass", F.array_join("types", ",").alias("types")
    )


@query("qc_rollup", """
    SELECT c_custkey AS chapter_id, high, medium,
           CASE WHEN high IS NULL THEN 'not run' WHEN high = 0 THEN 'PASS' ELSE CAST(high AS VARCHAR) || ' HIGH' END AS verdict
    FROM customer LEFT JOIN (SELECT chapter_id, count(*) FILTER (severity = 'high') AS high,
         count(*) FILTER (severity = 'medium') AS medium FROM v_faults GROUP BY 1) f ON chapter_id = c_custkey""")
def qc_rollup(t: Tables):
    return R.qc_rollup(t.customer.select(F.col("c_custkey").alias("chapter_id")), t.faults(), CH)


@query("round_history", """
    WITH r AS (SELECT chapter_id, pass AS round, count(*) FILTER (severity = 'high') AS high,
                      count(*) FILTER (severity = 'medium') AS medium,
                      count(DISTINCT scene) FILTER (type = 'click') AS n_changed FROM v_faults GROUP BY 1, 2),
    a AS (SELECT *, CASE WHEN high = 0 THEN 'PASS' WHEN n_changed = 0 THEN 'no auto-fix applies' ELSE 'fixes applied' END AS action FROM r),
    s AS (SELECT chapter_id, coalesce(min(round) FILTER (action <> 'fixes applied'), 5) AS stop FROM a GROUP BY 1),
    k AS (SELECT a.* FROM a JOIN s ON s.chapter_id = a.chapter_id WHERE round <= stop)
    SELECT k.chapter_id, k.round, high, medium, action, f.action_l = 'PASS' AS clean,
           CASE WHEN f.action_l = 'PASS' THEN FALSE ELSE f.high_l > 0 END AS gated
    FROM k JOIN (SELECT chapter_id, arg_max(action, round) AS action_l, arg_max(high, round) AS high_l FROM k GROUP BY 1) f
      ON f.chapter_id = k.chapter_id""")
def round_history(t: Tables):
    f = t.faults().withColumn("round", F.col("pass"))
    changed = f.groupBy("chapter_id", "round").agg(
        F.countDistinct(F.when(F.col("type") == "click", F.col("scene"))).alias("n_changed")
    )
    return R.round_history(f, changed, CH, 5)


@query("run_spread", """
    SELECT chapter_id, min(score) AS lowest, max(score) AS highest, max(score) - min(score) AS spread
    FROM (SELECT chapter_id, pass, CAST(sum(CASE severity WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS score
          FROM v_faults GROUP BY 1, 2) GROUP BY 1""")
def run_spread(t: Tables):
    return R.run_spread(t.faults(), CH, "pass")


@query("retry_items", """
    SELECT DISTINCT chapter_id, type AS item FROM v_faults WHERE severity = 'high'""")
def retry_items(t: Tables):
    return R.retry_items(t.faults().withColumn("item", F.concat("type", F.lit("_final"))), CH)


TABLES_SQL["v_day_spans"] = """
    SELECT user_id AS chapter_id, CAST(day(ts) AS BIGINT) AS scene, (day(ts) - 1) * 86400.0 + 3600.0 * min(hour(ts)) AS t0,
           (day(ts) - 1) * 86400.0 + 3600.0 * max(hour(ts)) AS t1 FROM events GROUP BY 1, 2, day(ts)"""


def _day_spans(t: Tables):
    """Active hours per chapter and day: spans with gaps between them."""
    day = F.dayofmonth("ts")
    at = lambda agg: ((F.col("day") - 1) * 86400.0 + 3600.0 * agg)
    return t.events.groupBy(F.col("user_id").alias("chapter_id"), day.alias("day")).agg(
        F.min(F.hour("ts")).alias("h0"), F.max(F.hour("ts")).alias("h1")
    ).select("chapter_id", F.col("day").cast("bigint").alias("scene"), at(F.col("h0")).alias("t0"), at(F.col("h1")).alias("t1"))


@query("time_to_scene", """
    SELECT f.chapter_id, ord, s.scene AS at_scene FROM v_faults f
    LEFT JOIN v_day_spans s ON s.chapter_id = f.chapter_id AND f.t >= s.t0 AND f.t < s.t1""")
def time_to_scene(t: Tables):
    return R.time_to_scene(t.faults(), _day_spans(t), CH).select("chapter_id", "ord", "at_scene")


TABLES_SQL["v_triage"] = """
    SELECT f.chapter_id, ord, detail, type, t, CASE WHEN type IN ('click', 'view')
           AND coalesce(f.scene, s.scene) < n THEN coalesce(f.scene, s.scene) END AS scene
    FROM v_faults f LEFT JOIN v_day_spans s ON s.chapter_id = f.chapter_id AND f.t >= s.t0 AND f.t < s.t1
    LEFT JOIN (SELECT chapter_id, count(*) AS n FROM v_day_spans GROUP BY 1) c ON c.chapter_id = f.chapter_id
    WHERE severity = 'high'"""


def _packs(t: Tables):
    units = t.faults().select(
        "chapter_id", "scene", F.col("detail").alias("panel"), "ord").filter("scene IS NOT NULL")
    return R.evidence_pack(t.faults(), _day_spans(t), units, CH, ("click", "view"))


@query("evidence_pack", """
    SELECT p.*, panels FROM (
        SELECT chapter_id, scene, count(*) AS n_faults, string_agg(detail, ' | ' ORDER BY ord) AS details,
               string_agg(DISTINCT type, ',' ORDER BY type) AS types, arg_min(t, ord) AS t
        FROM v_triage GROUP BY 1, 2) p
    LEFT JOIN (SELECT chapter_id, scene, string_agg(detail, ', ' ORDER BY ord) AS panels FROM v_faults
               WHERE scene IS NOT NULL GROUP BY 1, 2) u ON u.chapter_id = p.chapter_id AND u.scene = p.scene""")
def evidence_pack(t: Tables):
    return _packs(t)


TABLES_SQL["v_decisions"] = """
    SELECT user_id AS chapter_id, CAST(hour(ts) // 6 AS INTEGER) AS scene,
           CASE WHEN sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) >= 4 THEN 'DROP'
                WHEN count(*) % 2 = 0 THEN 'dismiss' ELSE 'KEEP' END AS decision
    FROM events GROUP BY 1, 2"""


def _decisions(t: Tables):
    """A decision per chapter and scene; drops name the unit 'click'."""
    clicks = F.count_if(F.col("event_type") == "click")
    return t.events.groupBy(
        F.col("user_id").alias("chapter_id"), F.floor(F.hour("ts") / 6).cast("int").alias("scene")
    ).agg(
        F.when(clicks >= 4, "DROP").when(F.count(F.lit(1)) % 2 == 0, "dismiss").otherwise("KEEP").alias("decision"),
        F.array(F.lit("click"), F.lit("nowhere")).alias("panels"),
    )


def _unit_slots(t: Tables):
    return t.faults().filter("scene IS NOT NULL").select("chapter_id", "scene", F.col("type").alias("panel")).distinct()


TABLES_SQL["v_drop_scenes"] = """
    SELECT chapter_id, scene FROM (SELECT DISTINCT chapter_id, scene, type FROM v_faults WHERE scene IS NOT NULL) u
    JOIN v_decisions d USING (chapter_id, scene) WHERE decision = 'DROP'
    GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) FILTER (type = 'click') > 0"""


@query("apply_verdicts", """
    SELECT f.chapter_id, ord, CASE WHEN severity = 'high' AND s.scene IS NOT NULL THEN 'resolved_drop'
           WHEN severity = 'high' AND decision = 'dismiss' THEN 'dismissed' ELSE severity END AS severity
    FROM v_faults f LEFT JOIN v_decisions d ON d.chapter_id = f.chapter_id AND d.scene = f.scene
    LEFT JOIN v_drop_scenes s ON s.chapter_id = f.chapter_id AND s.scene = f.scene""")
def apply_verdicts(t: Tables):
    updated, _ = R.apply_verdicts(t.faults(), _unit_slots(t), _decisions(t), CH)
    return updated.select("chapter_id", "ord", "severity")


@query("apply_verdicts_units", """
    SELECT DISTINCT f.chapter_id, f.scene, type AS panel FROM v_faults f
    LEFT JOIN v_drop_scenes s ON s.chapter_id = f.chapter_id AND s.scene = f.scene
    WHERE f.scene IS NOT NULL AND NOT (s.scene IS NOT NULL AND type = 'click')""")
def apply_verdicts_units(t: Tables):
    _, units = R.apply_verdicts(t.faults(), _unit_slots(t), _decisions(t), CH)
    return units


@query("flags_to_faults", """
    SELECT * FROM (
        SELECT event_id AS chapter_id, CAST(hour(ts) AS BIGINT) AS scene, CAST(minute(ts) AS DOUBLE) AS t, unnest([
            CASE WHEN value >= 200 THEN 'weak_hook' END, CASE WHEN event_type <> 'view' THEN 'irrelevant_panel' END,
            CASE WHEN value < 10 THEN 'cropped_content' END, CASE WHEN value < 1 THEN 'empty_screen' END,
            CASE WHEN event_type = 'click' THEN 'unreadable_text' END, CASE WHEN event_type = 'purchase' THEN 'watermark' END,
            CASE WHEN value > 150 THEN 'phone_readability' END,
            CASE WHEN event_type = 'signup' THEN 'missing_payoff' END, CASE WHEN event_type = 'error' THEN 'review_error' END]) AS type
        FROM events) WHERE type IS NOT NULL""")
def flags_to_faults(t: Tables):
    """One sampled frame per event, flags from type and value."""
    e = t.events
    value, kind = F.col("value"), F.col("event_type")
    base = e.select(
        F.col("event_id").alias("chapter_id"), F.hour("ts").cast("bigint").alias("scene"), F.lit(0).alias("pos"),
        F.minute("ts").cast("double").alias("t"), "event_type", "value", "props",
    )
    verdicts = base.select(
        "chapter_id", "scene", "pos", (kind == "view").alias("relevant"), (value >= 200).alias("hook_weak"),
        (value < 10).alias("cropped"), (value < 1).alias("empty"), (kind == "click").alias("text_issue"),
        (kind == "purchase").alias("watermark"), (value > 150).alias("small_text"), F.col("props").alias("note"),
    )
    verdicts = verdicts.unionByName(verdicts.withColumn("pos", F.lit(9)))  # answers beyond the frames
    at = base.select("chapter_id", "scene", "t", "event_type", F.col("props").alias("quote"), F.col("props").alias("error"))
    return R.flags_to_faults(
        base.select("chapter_id", "scene", "pos", "t"), verdicts, at.filter("event_type = 'signup'"),
        at.filter("event_type = 'error'"), CH,
    ).select("chapter_id", "scene", "t", "type")


TABLES_SQL["v_samples"] = """
    SELECT user_id AS chapter_id, CAST(epoch_us(ts) // 1000000 - 1704067200 AS DOUBLE) + event_id * 1e-9 * 0 AS t, event_id,
           CASE event_type WHEN 'error' THEN 4.0 WHEN 'view' THEN 250.0 ELSE 100.0 END AS luma,
           CASE event_type WHEN 'click' THEN 0.01 ELSE 0.5 END AS frac FROM events"""


@query("fault_runs", """
    WITH h AS (SELECT chapter_id, t, event_id, CASE WHEN luma <= 8 OR luma >= 247 THEN 'blank_frame'
                      WHEN frac < 0.04 THEN 'empty_frame' END AS type FROM v_samples),
    g AS (SELECT *, lag(type) OVER w AS pt, lag(t) OVER w AS pv FROM h WHERE type IS NOT NULL
          WINDOW w AS (PARTITION BY chapter_id ORDER BY t)),
    i AS (SELECT *, sum(CASE WHEN pt = type AND t - pv <= 36000.1 THEN 0 ELSE 1 END)
                    OVER (PARTITION BY chapter_id ORDER BY t) AS island FROM g)
    SELECT chapter_id, type, min(t) AS t, max(t) AS t_end,
           CASE type WHEN 'blank_frame' THEN 'high' ELSE 'medium' END AS severity
    FROM i GROUP BY chapter_id, island, type""")
def fault_runs(t: Tables):
    """Events as frame samples about ten hours apart."""
    kind = F.col("event_type")
    samples = t.events.select(
        F.col("user_id").alias("chapter_id"), "event_id",
        (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) - 1704067200).cast("double").alias("t"),
        F.when(kind == "error", 4.0).when(kind == "view", 250.0).otherwise(100.0).alias("luma"),
        F.when(kind == "click", 0.01).otherwise(0.5).alias("frac"),
    )
    return R.fault_runs(samples, CH, 36000.0, ["event_id"]).select("chapter_id", "type", "t", "t_end", "severity")


@query("upsert_evidence", """
    SELECT chapter_id, type, count(*) AS n FROM v_faults
    WHERE arm = CASE WHEN chapter_id IN (SELECT chapter_id FROM v_faults WHERE arm = 'experiment') THEN 'experiment' ELSE 'baseline' END
    GROUP BY 1, 2""")
def upsert_evidence(t: Tables):
    """Baseline evidence overwritten by the experiment's."""
    count = lambda arm: R.type_counts(t.faults().filter(F.col("arm") == arm), CH)
    return R.upsert_evidence(count("baseline"), count("experiment"), "chapter_id")


@query("fault_report", """
    SELECT chapter_id, ord, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS severity_rank,
           '- [' || upper(severity) || '] ' || CAST(CAST(floor(t) AS BIGINT) // 60 AS VARCHAR) || ':' ||
           lpad(CAST(CAST(floor(t) AS BIGINT) % 60 AS VARCHAR), 2, '0') ||
           CASE WHEN scene IS NULL THEN '' ELSE ' scene ' || CAST(scene AS VARCHAR) END || ' ' || type || ': ' || detail AS line
    FROM v_faults""")
def fault_report(t: Tables):
    """Report lines; the writer sorts by rank and time."""
    from seqlens.sources.writers import report_lines

    return report_lines(R.all_faults(t.faults())).select("chapter_id", "ord", "severity_rank", "line")


@query("all_faults", """
    SELECT chapter_id, scene, type, severity, t FROM v_faults UNION ALL
    SELECT chapter_id, NULL, 'day_span', 'low', t0 FROM v_day_spans""")
def all_faults(t: Tables):
    spans = _day_spans(t).select(
        "chapter_id", F.lit("day_span").alias("type"), F.lit("low").alias("severity"), F.col("t0").alias("t")
    )
    return R.all_faults(t.faults(), spans).select("chapter_id", "scene", "type", "severity", "t")
