"""Fault tables: scoring, voting, arm comparison, vetoes, triage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.functions.values import parse_votes, time_key
from seqlens.plans.ranges import interval_join
from seqlens.plans.scan import asof, islands, scan, time_block
from seqlens.session import cut_lineage

# Severity weights, sort ranks and the reviewer's own failure type.
WEIGHTS = {"high": 5, "medium": 2, "low": 1}
UNKNOWN_WEIGHT = 1
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
UNKNOWN_RANK = 3
REVIEW_ERROR = "review_error"
# Fault types a triage decision can settle.
TRIAGEABLE = ("blank_frame", "empty_screen", "irrelevant_panel", "missing_payoff", "watermark", "weak_hook")
# Limits of the media checks.
MIN_DURATION = 30.0
MAX_DRIFT_PCT = 5.0
LOUDNESS_RANGE = (-17.0, -11.0)

FAULT_FIELDS = ("t", "severity", "detail", "votes")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(UNKNOWN_RANK)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank


def fault_weight(severity: Column, weights: Mapping[str, int] = WEIGHTS) -> Column:
    """Weight of a severity; a missing one is low, an unknown one weighs one."""
    level = F.coalesce(severity, F.lit("low"))
    weight = F.lit(UNKNOWN_WEIGHT)
    for name, value in weights.items():
        weight = F.when(level == name, value).otherwise(weight)
    return weight


def weighted_score(faults: DataFrame, keys: Sequence[str], weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """A1: sum of severity weights per group."""
    return faults.groupBy(*keys).agg(
        F.sum(fault_weight(F.col("severity"), weights)).cast("bigint").alias("score")
    )


def severity_counts(faults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A2: number of high, medium and low faults per group."""
    level = F.coalesce(F.col("severity"), F.lit("low"))
    return faults.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(level == s).alias(s) for s in SEVERITY_RANK]
    )


def type_counts(faults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A2: faults per type."""
    return faults.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def first_per_pair(faults: DataFrame, keys: Sequence[str], order: Column | str = "ord") -> DataFrame:
    """First fault of each (scene, type); scene may be null and is then a key of its own."""
    fields = [c for c in faults.columns if c not in (*keys, "scene", "type")]
    return faults.groupBy(*keys, "scene", "type").agg(
        F.min_by(F.struct(*fields), order).alias("__rep")
    ).select(*keys, "scene", "type", "__rep.*")


def majority_vote(faults: DataFrame, passes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A3: faults confirmed by at least half of the passes.

    ``passes`` has one row per (keys, pass), empty passes included. Status is
    scored, unconfirmed (a high fault with too few votes) or dropped.
    """
    keys = list(keys)
    once = first_per_pair(faults, [*keys, "pass"])
    rep = F.struct("t", "severity", "detail", "ord", "pass")
    voted = once.groupBy(*keys, "scene", "type").agg(
        F.count(F.lit(1)).cast("int").alias("hits"), F.min_by(rep, "pass").alias("__rep")
    )
    n = passes.groupBy(*keys).agg(F.countDistinct("pass").cast("int").alias("n_passes"))
    voted = voted.join(n, keys).select(*keys, "scene", "type", "hits", "n_passes", "__rep.*")
    need = F.ceil(F.col("n_passes") / 2)
    return voted.withColumns({
        "votes": F.concat_ws("/", F.col("hits").cast("string"), F.col("n_passes").cast("string")),
        "status": F.when(F.col("hits") >= need, "scored").when(F.col("severity") == "high", "unconfirmed")
        .otherwise("dropped"),
    })


def consensus_filter(faults: DataFrame, keys: Sequence[str], arm: str = "arm") -> DataFrame:
    """A4: hold both arms to the stricter of their majority fractions; adds ``kept`` and ``frac``."""
    keys = list(keys)
    k, n = parse_votes("votes")
    rows = faults.withColumns({"__k": k, "__n": n})
    bars = rows.groupBy(*keys, arm).agg(F.max("__n").alias("n")).groupBy(*keys).agg(
        F.greatest(F.max(F.ceil(F.col("n") / 2) / F.col("n")),
                   # an arm without faults counts as one pass, fraction 1
                   F.when(F.count(F.lit(1)) < 2, 1.0).otherwise(0.0)).alias("frac")
    )
    return rows.join(bars, keys).withColumn(
        "kept", F.col("__k") / F.col("__n") >= F.col("frac") - 1e-9
    ).drop("__k", "__n")


def matched_pair_diff(
    faults: DataFrame, keys: Sequence[str], arm: str = "arm", arms: tuple[str, str] = ("baseline", "experiment")
) -> DataFrame:
    """(scene, type) pairs of two arms as added, removed or common.

    One aggregation stands in for the null-safe full outer join: both arms' first
    faults meet in the same group.
    """
    base, cur = arms
    fields = [c for c in faults.columns if c not in (*keys, "scene", "type", arm)]
    pick = lambda name: F.min_by(
        F.when(F.col(arm) == name, F.struct(*fields)), F.when(F.col(arm) == name, F.col("ord"))
    )
    both = faults.groupBy(*keys, "scene", "type").agg(pick(base).alias("base"), pick(cur).alias("cur"))
    status = F.when(F.col("base").isNull(), "added").when(F.col("cur").isNull(), "removed").otherwise("common")
    return both.withColumn("status", status)


def frame_hash_exempt(
    faults: DataFrame, frames: DataFrame, keys: Sequence[str], window: float
) -> DataFrame:
    """Is the fault's frame identical to a baseline frame within ``window`` seconds?

    ``faults`` carries ``t`` and ``frame_md5``; ``frames`` the baseline (t, md5).
    The nearest baseline frame with the same hash on either side decides, so a
    hash shared by a third of all frames costs one ordered scan, not a pair join.
    """
    keys = list(keys)
    live = faults.filter(F.col("t").isNotNull() & F.col("frame_md5").isNotNull())
    rest = faults.filter(F.col("t").isNull() | F.col("frame_md5").isNull())
    marks = frames.select(*keys, F.col("md5").alias("frame_md5"), "t").distinct()
    both = live.select(*keys, "frame_md5", "t", F.struct(*faults.columns).alias("__fault"), F.lit(0).alias("__side"))
    both = both.withColumn("__id", F.xxhash64("__fault")).unionByName(
        marks.withColumns({"__side": F.lit(1), "__id": F.lit(0).cast("bigint")}), allowMissingColumns=True
    )
    seen = F.when(F.col("__side") == 1, F.col("t"))
    swept = scan(
        both, [*keys, "frame_md5"], ["t", "__side", "__id"], time_block("t", max(window, 1.0) * 64),
        before={"__past": seen}, after={"__next": seen},
    ).filter("__side = 0")
    lo = F.greatest(F.lit(0.0), F.col("t") - window)
    hit = F.coalesce(F.col("__past") >= lo, F.lit(False)) | F.coalesce(F.col("__next") <= F.col("t") + window, F.lit(False))
    return swept.select("__fault.*", hit.alias("exempt")).unionByName(rest.withColumn("exempt", F.lit(False)))


def frame_proofs(
    faults: DataFrame, frames: DataFrame, sidecar: DataFrame, keys: Sequence[str], window: float
) -> DataFrame:
    """J10 with archived proofs: ``exempt`` and its ``origin`` per fault.

    A group with live baseline ``frames`` is decided by them alone (origin ``live``), so a
    stale archive never hides a change. Elsewhere the archived ``sidecar`` of S10 or S14
    (t_key, md5, window_md5s, window_s) answers for the times it holds (``archived``), if it was
    made with the same window; what it does not hold is not exempt (``none``), nor is a
    fault without a time. Of several archived rows for one time any proof counts.
    """
    keys = list(keys)
    groups = frames.select(*keys).distinct().withColumn("__live", F.lit(True))
    tagged = faults.join(groups, keys, "left")
    live = frame_hash_exempt(tagged.filter("__live").drop("__live"), frames, keys, window).withColumn("origin", F.lit("live"))
    usable = sidecar.filter(F.abs(F.col("window_s") - F.lit(float(window))) <= 1e-9)
    proof = F.coalesce(F.array_contains("window_md5s", F.col("md5")), F.lit(False))
    known = usable.groupBy(*keys, F.col("t_key").alias("__t_key")).agg(F.max(proof).alias("__proof"))
    rest = tagged.filter("__live is null").drop("__live").withColumn("__t_key", F.when(F.col("t").isNotNull(), time_key("t")))
    archived = rest.join(known, [*keys, "__t_key"], "left").withColumns({
        "exempt": F.coalesce("__proof", F.lit(False)),
        "origin": F.when(F.col("__proof").isNotNull(), "archived").otherwise("none"),
    }).drop("__t_key", "__proof")
    return live.unionByName(archived)


def default_vetoes(faults: DataFrame, keys: Sequence[str], arm: str = "arm") -> DataFrame:
    """A5: new and worsened fault types per group, sorted; U2 is its ``new_types``."""
    both = faults.groupBy(*keys, "type").agg(
        F.count_if(F.col(arm) == "baseline").alias("b"), F.count_if(F.col(arm) == "experiment").alias("c")
    )
    real = F.col("type") != REVIEW_ERROR
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond & real, F.col("type"))))
    return both.groupBy(*keys).agg(
        pick((F.col("b") == 0) & (F.col("c") > 0)).alias("new_types"),
        pick(F.col("c") > F.col("b")).alias("worsened_types"),
    )


def new_types(faults: DataFrame, keys: Sequence[str], arm: str = "arm") -> DataFrame:
    """(keys, type) seen only in the experiment arm, reviewer failures aside."""
    seen = lambda name: faults.filter(F.col(arm) == name).select(*keys, "type").distinct()
    return seen("experiment").filter(F.col("type") != REVIEW_ERROR).join(
        seen("baseline"), [*keys, "type"], "left_anti"
    )


def matched_vetoes(pairs: DataFrame, keys: Sequence[str], new_type_veto: bool = True) -> DataFrame:
    """Net increases per type after netting and frame-hash exemption.

    ``pairs`` is :func:`matched_pair_diff` of the kept faults plus ``exempt`` on
    added pairs. One row per type whose count rose.
    """
    added, removed = F.col("status") == "added", F.col("status") == "removed"
    scene = F.coalesce(F.col("scene").cast("string"), F.lit("None"))
    key = F.concat(F.lit("("), scene, F.lit(", '"), F.col("type"), F.lit("')"))
    listing = lambda cond, side, *more: F.array_sort(F.collect_list(
        F.when(cond, F.struct(key.alias("key"), F.col("scene").alias("scene"), F.col(f"{side}.t").alias("t"),
                              F.col(f"{side}.votes").alias("votes"), *more))))
    per_type = pairs.filter(F.col("type") != REVIEW_ERROR).groupBy(*keys, "type").agg(
        F.count_if(~added).alias("n_base"),
        F.count_if(~removed).alias("n_cur"),
        F.count_if(added & F.col("exempt")).alias("n_exempt"),
        listing(added, "cur", F.col("cur.severity").alias("severity"), F.col("exempt").alias("exempt")).alias("pairs_added"),
        listing(removed, "base").alias("pairs_removed"),
    ).filter("n_cur > n_base")
    net = F.col("n_cur") - F.col("n_base") - F.col("n_exempt")
    return per_type.withColumns({
        "net": net,
        "suppressed": net <= 0,
        "reason": F.when(net > 0, None).when(
            F.col("n_exempt") > 0, "frame-hash exemption + matched-pair netting"
        ).otherwise("matched-pair netting (scene churn absorbed by removed pairs)"),
        "new_type": (net > 0) & (F.col("n_base") == 0) & F.lit(new_type_veto),
    })


def media_vetoes(media: DataFrame) -> DataFrame:
    """Media checks of A7: encode sanity, duration drift, loudness."""
    dur, base, lufs = F.col("duration"), F.col("base_duration"), F.col("lufs")
    lo, hi = LOUDNESS_RANGE
    truthy = lambda c: F.coalesce(c != 0, F.lit(False))
    checks = F.array(
        F.when(dur.isNull() | (dur < MIN_DURATION), "encode"),
        F.when(truthy(dur) & truthy(base) & (F.abs(dur - base) / base * 100 > MAX_DRIFT_PCT), "drift"),
        F.when(lufs.isNotNull() & ~lufs.between(lo, hi), "loudness"),
    )
    return media.withColumn("media_vetoes", F.array_compact(checks))


def experiment_verdict(
    faults: DataFrame, vetoes: DataFrame, media: DataFrame, keys: Sequence[str], arm: str = "arm"
) -> DataFrame:
    """PASS iff the score fell and nothing vetoes.

    ``vetoes`` has (keys, vetoes array); groups without vetoes may be absent.
    """
    weight = fault_weight(F.col("severity"))
    score = lambda name: F.coalesce(F.sum(F.when(F.col(arm) == name, weight)), F.lit(0)).cast("bigint")
    table = faults.groupBy(*keys).agg(score("baseline").alias("base_score"), score("experiment").alias("cur_score"))
    table = table.join(vetoes, list(keys), "left").join(media_vetoes(media), list(keys), "left")
    empty = F.array().cast("array<string>")
    table = table.withColumn(
        "vetoes", F.concat(F.coalesce("vetoes", empty), F.coalesce("media_vetoes", empty))
    )
    passed = (F.col("cur_score") < F.col("base_score")) & (F.size("vetoes") == 0)
    return table.withColumn("verdict", F.when(passed, "PASS").otherwise("FAIL"))


def scope_to_changed(faults: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """faults of the changed scenes only."""
    return faults.join(changed.select(*keys, "scene").distinct(), [*keys, "scene"], "left_semi")


def hash_window_sidecar(
    faults: DataFrame, frames: DataFrame, baseline: DataFrame, keys: Sequence[str], window: float
) -> DataFrame:
    """Per fault time key, the frame's md5 and the baseline md5s around it.

    The first fault of a key (lowest ``ord``) sets its time; ``frames`` are the
    experiment's (t_key, md5). md5 sets are distinct and sorted.
    """
    keys = list(keys)
    times = faults.filter(F.col("t").isNotNull()).withColumn("t_key", time_key("t")).groupBy(*keys, "t_key").agg(
        F.min_by("t", "ord").alias("t")
    )
    spans = times.withColumns({"t0": F.greatest(F.lit(0.0), F.col("t") - window), "t1": F.col("t") + window})
    marks = baseline.select(*keys, F.col("md5").alias("base_md5"), F.col("t").alias("b0"), F.col("t").alias("b1"))
    near = interval_join(spans, marks, keys, ("t0", "t1"), ("b0", "b1"), max(window * 2, 1.0))
    sets = near.groupBy(*keys, "t_key").agg(F.array_sort(F.collect_set("base_md5")).alias("window_md5s"))
    own = frames.select(*keys, F.col("t_key"), "md5").groupBy(*keys, "t_key").agg(F.min("md5").alias("md5"))
    return times.join(own, [*keys, "t_key"], "left").join(sets, [*keys, "t_key"], "left").withColumns({
        "window_md5s": F.coalesce("window_md5s", F.array().cast("array<string>")), "window_s": F.lit(float(window)),
    })


def sidecar_from_reports(reports: DataFrame, keys: Sequence[str], column: str = "report") -> DataFrame:
    """Rebuild the hash sidecar from archived reports.

    Only exempt pairs with a proof carry an md5; every other time keeps an empty window.
    ``window_s`` is the window the report was made with.
    """
    schema = (
        "struct<matched_vetoes:struct<frame_hash:struct<window_s:double>,annotated_vetoes:array<struct<"
        "pairs_added:array<struct<t:double,frame_hash_exempt:boolean,frame_hash_proof:struct<frame_md5:string>>>>>>>"
    )
    parsed = reports.select(*keys, F.from_json(column, schema)["matched_vetoes"].alias("m"))
    rows = parsed.select(*keys, F.col("m.frame_hash.window_s").alias("w"), F.posexplode("m.annotated_vetoes").alias("i", "v")).select(
        *keys, "w", "i", F.posexplode("v.pairs_added").alias("j", "p")
    ).filter(F.col("p.t").isNotNull())
    proof = F.when(F.col("p.frame_hash_exempt"), F.col("p.frame_hash_proof.frame_md5"))
    rows = rows.select(*keys, "w", time_key("p.t").alias("t_key"), proof.alias("md5"), F.struct("i", "j").alias("at"))
    return rows.groupBy(*keys, "t_key").agg(
        F.max_by("md5", F.when(F.col("md5").isNotNull(), F.col("at"))).alias("md5"),
        F.array_sort(F.collect_set("md5")).alias("window_md5s"),
        F.max("w").alias("window_s"),
    )


def experiment_report(verdicts: DataFrame, counts: DataFrame, annotated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One nested JSON document per experiment."""
    keys = list(keys)
    notes = annotated.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("type", "n_base", "n_cur", "net", "suppressed"))).alias("annotated")
    )
    rows = verdicts.join(counts, keys, "left").join(notes, keys, "left")
    document = F.struct(
        F.col("verdict").alias("verdict"),
        F.struct(
            F.col("base_score").alias("baseline"), F.col("cur_score").alias("experiment"),
            (F.col("cur_score") - F.col("base_score")).alias("delta"),
        ).alias("score"),
        F.struct(*[F.col(c).alias(c) for c in counts.columns if c not in keys]).alias("severity_counts"),
        F.col("vetoes").alias("vetoes"),
        F.coalesce("annotated", F.array().cast("array<struct<type:string,n_base:bigint,n_cur:bigint,net:bigint,suppressed:boolean>>")).alias("annotated_vetoes"),
    )
    return rows.select(*keys, F.to_json(document).alias("report"))


def recurring_types(faults: DataFrame, slug: str, high_now: int = 3, chapters: int = 2) -> DataFrame:
    """Types seen in several chapters, and whether each chapter deserves a round.

    One row per (chapter, recurring type), plus a null type for chapters without.
    """
    counts = faults.groupBy(slug, "type").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy("type").agg(F.count(F.lit(1)).alias("n_chapters")).filter(F.col("n_chapters") >= chapters)
    highs = faults.groupBy(slug).agg(F.count_if(F.col("severity") == "high").alias("high"))
    hits = counts.select(slug, "type").join(spread, "type")
    return highs.join(hits, slug, "left").withColumn(
        "worth_a_round", (F.col("high") >= high_now) | F.col("type").isNotNull()
    )


def gap_overlap(faults: DataFrame, gaps: DataFrame, slug: str) -> DataFrame:
    """Open gaps sharing fault types with each chapter, with the shared mass."""
    counts = faults.groupBy(slug, "type").agg(F.count(F.lit(1)).alias("n"))
    open_gaps = gaps.filter(~F.coalesce(F.col("status"), F.lit("")).isin("adopted", "rejected"))
    wanted = open_gaps.select("gap_id", F.explode(F.array_distinct("fault_types")).alias("type"))
    return counts.join(wanted, "type").groupBy(slug, "gap_id").agg(
        F.sum("n").cast("bigint").alias("mass"), F.array_sort(F.collect_set("type")).alias("types")
    )


def qc_rollup(expected: DataFrame, faults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One verdict per expected report; ``reported`` rows without faults still count as run."""
    counts = faults.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
    )
    rows = expected.join(counts, list(keys), "left")
    return rows.withColumn(
        "verdict",
        F.when(F.col("high").isNull(), "not run").when(F.col("high") == 0, "PASS")
        .otherwise(F.concat(F.col("high").cast("string"), F.lit(" HIGH"))),
    )


def round_history(faults: DataFrame, changed: DataFrame, keys: Sequence[str], max_rounds: int) -> DataFrame:
    """High and medium faults per review round, the action taken, and the encode gate.

    ``changed`` has (keys, round, n_changed): scenes rewritten after that round.
    """
    keys = list(keys)
    rounds = faults.groupBy(*keys, "round").agg(
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
    )
    rounds = rounds.join(changed, [*keys, "round"], "left")
    action = F.when(F.col("high") == 0, "PASS").when(
        F.coalesce("n_changed", F.lit(0)) == 0, "no auto-fix applies"
    ).otherwise("fixes applied")
    rounds = rounds.withColumn("action", action)
    # the loop ends at the first pass or at the first round without a fix
    stop = rounds.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("action") != "fixes applied", F.col("round"))), F.lit(max_rounds)).alias("last_round")
    )
    kept = rounds.join(stop, keys).filter(F.col("round") <= F.col("last_round"))
    final = kept.groupBy(*keys).agg(
        (F.max_by("action", "round") == "PASS").alias("clean"),
        F.when(F.max_by("action", "round") == "PASS", 0).otherwise(F.max_by("high", "round")).alias("remaining_high"),
    )
    return kept.join(final, keys).select(
        *keys, "round", "high", "medium", "action", "clean", (F.col("remaining_high") > 0).alias("gated")
    )


def run_spread(faults: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """Largest minus smallest weighted score over repeated runs."""
    per_run = weighted_score(faults, [*keys, run])
    return per_run.groupBy(*keys).agg(
        F.min("score").alias("lowest"), F.max("score").alias("highest"),
        (F.max("score") - F.min("score")).alias("spread"),
    )


def retry_items(faults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items to rebuild because of a high fault."""
    return faults.filter((F.col("severity") == "high") & (F.coalesce("item", F.lit("")) != "")).select(
        *keys, F.replace(F.col("item"), F.lit("_final"), F.lit("")).alias("item")
    ).distinct()


def time_to_scene(points: DataFrame, spans: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Scene whose [t0, t1) holds the time, else null.

    Spans of a chapter do not overlap, so the latest span that starts at or
    before ``t`` decides; empty spans never match.
    """
    steps = spans.filter("t1 > t0").select(*keys, "t0", "t1", F.col("scene").alias("__scene"))
    hit = asof(points, steps, keys, t, "t0", ["t1", "__scene"], lambda c: time_block(c))
    return hit.withColumn("at_scene", F.when(F.col(t) < F.col("t1"), F.col("__scene"))).drop("t1", "__scene")


def evidence_pack(
    faults: DataFrame, spans: DataFrame, scene_panels: DataFrame, keys: Sequence[str],
    types: Sequence[str] = TRIAGEABLE,
) -> DataFrame:
    """Per scene, the high faults to triage with details, types and panels.

    Rows with a null scene hold the faults that cannot be resolved.
    """
    keys = list(keys)
    high = faults.filter(F.col("severity") == "high")
    placed = time_to_scene(high, spans, keys)
    able = F.col("type").isin(*types)
    bounds = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("__scenes"))
    placed = placed.join(bounds, keys, "left")
    at = F.coalesce("scene", "at_scene")
    placed = placed.withColumn("scene", F.when(able & (at < F.coalesce("__scenes", F.lit(0))), at))
    packs = placed.groupBy(*keys, "scene").agg(
        F.count(F.lit(1)).alias("n_faults"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("detail", F.lit("")).alias("d")))),
                                 lambda s: s["d"]), " | ").alias("details"),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        F.min_by("t", "ord").alias("t"),
    )
    names = scene_panels.groupBy(*keys, "scene").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "panel"))), lambda s: s["panel"]), ", ")
        .alias("panels")
    )
    return packs.join(names, [*keys, "scene"], "left")


def apply_verdicts(faults: DataFrame, scene_panels: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Apply triage decisions; returns (faults, scene_panels).

    ``verdicts``: (keys, scene, decision, panels). A drop needs at least one valid
    panel and one survivor; otherwise the faults stay high. Of several verdicts on a
    scene a valid drop goes before a dismissal.
    """
    on = [*keys, "scene"]
    named = verdicts.filter("upper(decision) = 'DROP'").select(*on, F.explode("panels").alias("panel")).distinct()
    marked = scene_panels.join(named.withColumn("__named", F.lit(True)), [*on, "panel"], "left")
    tally = marked.groupBy(*on).agg(F.count("__named").alias("__hit"), F.count(F.lit(1)).alias("__all"))
    applied = tally.select(*on, ((F.col("__hit") > 0) & (F.col("__hit") < F.col("__all"))).alias("__drop"))
    panels = marked.join(applied, on).filter(~(F.col("__drop") & F.col("__named").isNotNull())).drop("__named", "__drop")
    fate = verdicts.join(applied, on, "left").select(
        *on,
        F.when((F.upper("decision") == "DROP") & F.col("__drop"), "resolved_drop")
        .when(F.upper("decision") == "DISMISS", "dismissed").alias("__fate"),
    ).groupBy(*on).agg(F.max("__fate").alias("__fate"))
    updated = faults.join(fate, on, "left").withColumn(
        "severity", F.when((F.col("severity") == "high") & F.col("__fate").isNotNull(), F.col("__fate"))
        .otherwise(F.col("severity"))
    ).drop("__fate")
    return updated, panels


# Per-frame flag -> (fault type, severity), in report order.
FRAME_FLAGS = (
    ("hook_weak", "weak_hook", "high"),
    ("irrelevant", "irrelevant_panel", "high"),
    ("cropped", "cropped_content", "medium"),
    ("empty", "empty_screen", "medium"),
    ("text_issue", "unreadable_text", "low"),
    ("watermark", "watermark", "high"),
    ("small_text", "phone_readability", "medium"),
)


def flags_to_faults(frames: DataFrame, verdicts: DataFrame, missing: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """reviewer answers per sampled frame to fault rows.

    frames: (keys, scene, pos, t); verdicts: (keys, scene, pos, relevant and the
    flag columns, note); missing: (keys, scene, t, quote); failed: (keys, scene,
    t, error). Absent flags mean fine; answers beyond the frames are ignored.
    """
    on = [*keys, "scene", "pos"]
    rows = frames.join(verdicts, on).withColumn("irrelevant", ~F.coalesce(F.col("relevant"), F.lit(True)))
    found = F.array(*[
        F.when(F.coalesce(F.col(flag), F.lit(False)), F.struct(F.lit(kind).alias("type"), F.lit(sev).alias("severity")))
        for flag, kind, sev in FRAME_FLAGS
    ])
    base = [*keys, "scene", F.round("t", 1).alias("t")]
    flagged = rows.select(*base, "note", F.explode(F.array_compact(found)).alias("f")).select(
        *keys, "scene", "t", "f.type", "f.severity", F.col("note").alias("detail")
    )
    unseen = missing.select(
        *base, F.lit("missing_payoff").alias("type"), F.lit("high").alias("severity"),
        F.concat(F.lit('quoted line never shown: "'), F.substring("quote", 1, 90), F.lit('"')).alias("detail"),
    )
    broken = failed.select(
        *base, F.lit(REVIEW_ERROR).alias("type"), F.lit("low").alias("severity"), F.col("error").alias("detail")
    )
    return flagged.unionByName(unseen).unionByName(broken)


def fault_runs(samples: DataFrame, keys: Sequence[str], step: float = 2.0, tie: Sequence[str] = ()) -> DataFrame:
    """Runs of blank or empty frames.

    samples: (keys, t, luma, frac). A hit is blank (luma ≤ 8 or ≥ 247, high) or
    else empty (frac < 0.04, medium); consecutive hits of one type no further
    than step + 0.1 apart merge into [t, t_end].

    Hits of one time belong to the same stretch. They follow each other by ``tie``, then type; where they are of both types
    a new stretch begins, which goes on with the last one's type and holds the other at this time only.
    """
    keys = list(keys)
    blank = (F.col("luma") <= 8) | (F.col("luma") >= 247)
    kind = F.when(blank, "blank_frame").when(F.col("frac") < 0.04, "empty_frame")
    hits = samples.withColumns({"type": kind, "t": F.round("t", 1)}).filter(F.col("type").isNotNull())
    detail = F.when(F.col("type") == "blank_frame", F.format_string("mean luma %.0f", "luma")).otherwise(
        F.format_string("content fraction %.3f", "frac")
    )
    at = F.struct(*tie, "type", "luma", "frac")
    one = lambda agg, cond: agg(F.struct("type", detail.alias("detail")), F.when(cond, at))
    instants = hits.groupBy(*keys, "t").agg(
        F.min_by("type", at).alias("head"), F.max_by("type", at).alias("type"),
        one(F.min_by, F.col("type") == "blank_frame").alias("blank"), one(F.min_by, F.col("type") == "empty_frame").alias("empty"),
    )
    mixed = F.col("blank").isNotNull() & F.col("empty").isNotNull()
    blank_last = F.col("type") == "blank_frame"
    instants = cut_lineage(instants.select(
        *keys, "t", "head", "type", F.when(blank_last, F.col("blank")).otherwise(F.col("empty"))["detail"].alias("detail"),
        F.when(mixed, F.when(blank_last, F.col("empty")).otherwise(F.col("blank"))).alias("other"),
    ))
    runs = islands(
        instants, keys, ["t"], time_block("t"),
        watch={"head": F.col("head"), "type": F.col("type"), "mixed": F.col("other").isNotNull(), "t": F.col("t")},
        same=lambda p, c: ~c("mixed") & (p("type") == c("head")) & (c("t") - p("t") <= step + 0.1),
        aggs={"t": ("min", F.col("t")), "t_end": ("max", F.col("t")), "type": ("first", F.col("type")),
              "detail": ("first", F.col("detail"))},
    )
    short = instants.filter("other IS NOT NULL").select(*keys, "t", F.col("t").alias("t_end"), "other.type", "other.detail")
    return runs.unionByName(short).withColumn("severity", F.when(F.col("type") == "blank_frame", "high").otherwise("medium"))


def upsert_evidence(ledger: DataFrame, fresh: DataFrame, slug: str) -> DataFrame:
    """Rows of re-run slugs replace the old ones, all others stay."""
    old = ledger.join(fresh.select(slug).distinct(), slug, "left_anti")
    return old.unionByName(fresh)


def all_faults(*parts: DataFrame) -> DataFrame:
    """Union of every scan's faults, with severity rank for ordering."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("severity_rank", severity_rank(F.col("severity")))
