"""The three end-to-end jobs, composed of operators over many chapters at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions import text as X
from seqlens.operators import evidence as E
from seqlens.operators import ranking as K
from seqlens.operators import review as R
from seqlens.session import cut_lineage


def ranked_discovery(primary: DataFrame, fallback: DataFrame, listing: DataFrame, feed: DataFrame, include_adult: bool = False) -> DataFrame:
    """Load both catalogs, rank, probe the best fifteen, rank again."""
    from seqlens.sources.readers import load_candidates

    return K.discover(cut_lineage(load_candidates(primary, fallback, include_adult)), listing, feed)


def verify_scripts(
    scenes: DataFrame, scene_panels: DataFrame, reads: DataFrame, answers: DataFrame, keys: Sequence[str], strict: bool = False
) -> dict[str, DataFrame]:
    """Check every scene's units against its narration.

    scenes: (keys, scene, narration); scene_panels: (keys, scene, ord, panel); reads:
    the read table with read_pos; answers: reviewer verdicts (keys, scene, ord,
    relevant) for ambiguous scenes. Each stage is written once before the next ones
    read it. Returns final units, log and summary.
    """
    keys = list(keys)
    texts = cut_lineage(reads.select(
        *keys, "read_pos", "panel", "kind", "quality", "dialogue", "narration_text",
        X.unit_text(F.col("scene_beat"), F.col("narration_text"), F.col("dialogue")).alias("unit_text"),
        X.dialogue_text(F.col("narration_text"), F.col("dialogue")).alias("dtext")))
    gate = cut_lineage(E.tier1_gate(scene_panels.select(*keys, "scene", "ord", "panel"), scenes, texts, keys, strict))
    kept = gate.filter("keep").select(*keys, "scene", "ord", "panel")
    spoken = texts.select(*keys, "panel", "dtext")
    quotes = cut_lineage(E.scene_quotes(scenes, keys))
    matched = cut_lineage(E.quote_match(quotes, kept.join(spoken, [*keys, "panel"]), keys))
    places = scene_panels.join(texts.select(*keys, "panel", "read_pos"), [*keys, "panel"], "left")
    sizes = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads"))
    windows = E.quote_windows(places, scenes, sizes, keys)
    absent = matched.filter("status = 'absent'").select(*keys, "scene", "quote_pos", "quote")
    rescued = cut_lineage(E.quote_rescue(absent, texts, windows, keys))
    found = rescued.filter("status = 'append'").select(*keys, "scene", F.explode(F.array_compact(F.array("panel", "next_panel"))).alias("panel")).distinct()
    added = found.join(kept, [*keys, "scene", "panel"], "left_anti")
    # appended units follow the scripted ones
    last = kept.groupBy(*keys, "scene").agg(F.max("ord").alias("last"))
    turn = Window.partitionBy(*keys, "scene").orderBy("read_pos")
    tail = added.join(texts.select(*keys, "panel", "read_pos"), [*keys, "panel"]).join(last, [*keys, "scene"], "left").select(
        *keys, "scene", "panel",
        (F.coalesce("last", F.lit(-1)) + F.row_number().over(turn)).cast(kept.schema["ord"].dataType).alias("ord"))
    kept = cut_lineage(kept.unionByName(tail))
    scores = E.relevance_join(kept, scenes, texts, keys)
    unclear = E.ambiguous_scenes(scores, keys).filter("ambiguous").select(*keys, "scene")
    asked = answers.join(unclear, [*keys, "scene"], "left_semi")
    guarded = added.select(*keys, "scene", "panel")
    if strict:
        proposed = kept.join(asked.filter("NOT relevant").select(*keys, "scene", "ord"), [*keys, "scene", "ord"], "left_semi")
        shield = E.drop_protection(proposed.select(*keys, "scene", "panel").distinct(), kept, scenes, texts, added, keys)
        guarded = shield.filter("protected_by IS NOT NULL").select(*keys, "scene", "panel")
    kept = cut_lineage(E.apply_relevance_verdicts(kept, asked, guarded, keys))
    at = kept.join(texts.select(*keys, "panel", "read_pos"), [*keys, "panel"], "left").select(*keys, "scene", F.coalesce("read_pos", F.lit(-1)).alias("read_pos"))
    filled = E.substitute_units(at, scenes, places.select(*keys, "scene", F.coalesce("read_pos", F.lit(-1)).alias("read_pos")), texts, keys)
    fresh = filled.join(texts.select(*keys, "read_pos", "panel"), [*keys, "read_pos"])
    final = kept.select(*keys, "scene", "ord", "panel").unionByName(
        fresh.select(*keys, "scene", F.col("read_pos").cast(kept.schema["ord"].dataType).alias("ord"), "panel"))
    log = gate.filter("NOT keep").select(*keys, "scene", "panel", F.lit("drop").alias("action")).unionByName(
        rescued.select(*keys, "scene", "panel", F.concat(F.lit("payoff_"), "status").alias("action"))
    ).unionByName(fresh.select(*keys, "scene", "panel", F.lit("substitute").alias("action")))
    return {"units": final, "log": log, "summary": E.verification_summary(log, keys)}


def score_experiments(
    passes: DataFrame, faults: DataFrame, frames: DataFrame, media: DataFrame, keys: Sequence[str], window: float,
    changed: DataFrame | None = None,
) -> DataFrame:
    """From raw review passes of two arms to one verdict per experiment.

    faults: (keys, arm, pass, scene, type, severity, t, detail, ord, frame_md5);
    passes: (keys, arm, pass); frames: baseline (keys, t, md5).
    """
    keys = list(keys)
    voted = R.majority_vote(faults, passes, [*keys, "arm"]).filter("status = 'scored'").drop("pass", "hits", "n_passes", "status")
    if changed is not None:
        voted = R.scope_to_changed(voted, changed, keys)
    voted = cut_lineage(voted)
    kept = R.consensus_filter(voted, keys).filter("kept").drop("kept", "frac")
    pairs = R.matched_pair_diff(kept, keys)
    prints = faults.filter("arm = 'experiment'").select(*keys, F.col("ord").alias("__ord"), "frame_md5")
    pairs = pairs.withColumns({"t": F.col("cur.t"), "__ord": F.col("cur.ord")}).join(prints, [*keys, "__ord"], "left").drop("__ord")
    matched = R.matched_vetoes(R.frame_hash_exempt(pairs, frames, keys, window), keys)
    vetoes = matched.groupBy(*keys).agg(F.array_compact(F.array(
        F.when(F.max("new_type"), "new_type"), F.when(F.max(F.col("net") > 0), "worsened"))).alias("vetoes"))
    return R.experiment_verdict(voted, vetoes, media, keys)
