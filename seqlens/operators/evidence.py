"""Text evidence: which units a narration shows, quotes, drops and rescues."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlens.functions import text as X
from seqlens.functions.similarity import QUOTE_FOUND, QUOTE_MAYBE, covered, quote_score
from seqlens.plans.scan import asof, ordinal_block, scan
from seqlens.session import cut_lineage, spread

# Unit kinds that never go on screen, and text limits.
HARD_KINDS = ("cover", "credits", "endmatter")
QUOTE_CHARS = 6
ANCHOR_CHARS = 10
AMBIGUOUS_BELOW = 0.15
NAME_BOOST = 0.15
NAME_BOOST_CAP = 0.30
RESCUE_POOL = 8
#: Below this share of quote words in the text no score can reach QUOTE_MAYBE.
_COVER_FLOOR = 0.35


def _either(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)


def usable_reads(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """drop hard kinds, but keep every row of a group that would be emptied.

    Usable rows pass without a shuffle; only hard rows are matched against the
    groups that have nothing else.
    """
    hard = F.coalesce(F.col("kind"), F.lit("story")).isin(*HARD_KINDS)
    bare = reads.groupBy(*keys).agg(F.count_if(~hard).alias("__ok")).filter("__ok = 0").select(*keys)
    return reads.filter(~hard).unionByName(reads.filter(hard).join(bare, list(keys), "left_semi"))


def longest_shared_run(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Longest common contiguous word run of two word arrays per pair: (keys, words, chars, start_a, start_b).

    Most words win, then the earliest start in a, then in b. Pairs without a shared word are absent. ``keys`` tell pairs apart.

    Inside a pair's row, stretches of 1, 2, 4, ... words are numbered by the numbers of their halves, up to the first length of which
    none is shared; the length is then found from the highest power of two down: n log n steps for n words, however often a word repeats.
    """
    pairs = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return pairs.select(*keys, F.inline(shared_run(a, b)))


def longest_run(a: Sequence[str], b: Sequence[str]) -> tuple[int, int, int, int] | None:
    """words, chars, start_a and start_b of the longest run of words that two lists share; None if they share none."""
    names: dict[str, int] = {}
    one = [np.array([names.setdefault(w, len(names)) for w in words], np.int64) for words in (a, b)]

    def joined(head: list[np.ndarray], tail: list[np.ndarray], by: int) -> list[np.ndarray] | None:
        """Numbers of stretches of ``head`` with what lies ``by`` words on in ``tail``; None if the lists share none."""
        if min(len(tail[0]), len(tail[1])) <= by:
            return None
        wide = max(int(t.max()) for t in tail) + 1
        both = [h[:len(t) - by] * wide + t[by:] for h, t in zip(head, tail, strict=True)]
        if not np.isin(both[0], both[1]).any():
            return None
        number = np.unique(np.concatenate(both), return_inverse=True)[1]
        return [number[:len(both[0])], number[len(both[0]):]]

    if not len(a) or not len(b) or not np.isin(one[0], one[1]).any():
        return None
    levels = [one]
    while (twice := joined(levels[-1], levels[-1], 1 << len(levels) - 1)) is not None:
        levels.append(twice)
    at, n = levels[-1], 1 << len(levels) - 1
    for power in range(len(levels) - 2, -1, -1):
        if (longer := joined(at, levels[power], n)) is not None:
            at, n = longer, n + (1 << power)
    start_a = int(np.isin(at[0], at[1]).argmax())
    start_b = int((at[1] == at[0][start_a]).argmax())
    return n, sum(map(len, a[start_a:start_a + n])) + n - 1, start_a, start_b


_RUN = ("words", T.LongType()), ("chars", T.LongType()), ("start_a", T.IntegerType()), ("start_b", T.IntegerType())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in _RUN])))
def shared_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """The run of two columns of words, or nothing: exploded, so that no filter on it has it worked out twice."""
    runs = [longest_run(x, y) for x, y in zip(a, b, strict=True)]
    return pd.Series([[] if r is None else [dict(zip([name for name, _ in _RUN], r, strict=True))] for r in runs], dtype=object)


def relevance(narr_tokens: Column, narr_names: Column, unit_tokens: Column, unit_names: Column) -> Column:
    """Overlap coefficient of content words plus a capped boost for shared names."""
    shared = F.size(F.array_intersect(narr_tokens, unit_tokens))
    smaller = F.least(F.size(narr_tokens), F.size(unit_tokens))
    names = F.size(F.array_intersect(narr_names, unit_names))
    boost = F.least(names * F.lit(NAME_BOOST), F.lit(NAME_BOOST_CAP))
    return F.when(smaller == 0, 0.0).otherwise(F.least(shared / smaller + boost, F.lit(1.0)))


def with_tokens(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Token and name arrays, computed once per text rather than once per pair."""
    return df.withColumns({f"{prefix}_tokens": X.content_tokens(text), f"{prefix}_names": X.proper_nouns(text)})


def relevance_join(scene_panels: DataFrame, script: DataFrame, reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J1 on the scene's own units: (keys, scene, panel, score).

    script: (keys, scene, narration); reads: (keys, panel, unit_text). Units
    without a read score 0.
    """
    keys = list(keys)
    narr = with_tokens(script, "narration", "n").select(*keys, "scene", "n_tokens", "n_names")
    unit = with_tokens(reads, "unit_text", "u").select(*keys, "panel", "u_tokens", "u_names")
    pairs = scene_panels.join(narr, [*keys, "scene"]).join(unit, [*keys, "panel"], "left")
    empty = F.array().cast("array<string>")
    score = relevance(F.col("n_tokens"), F.col("n_names"), _either(F.col("u_tokens"), empty), _either(F.col("u_names"), empty))
    return pairs.select(*scene_panels.columns, score.alias("score"))


def ambiguous_scenes(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scenes whose best unit scores below the floor."""
    return scores.groupBy(*keys, "scene").agg(F.max("score").alias("best")).withColumn(
        "ambiguous", F.col("best") < AMBIGUOUS_BELOW
    )


def tier1_gate(
    scene_panels: DataFrame, script: DataFrame, reads: DataFrame, keys: Sequence[str], strict: bool = False
) -> DataFrame:
    """keep or drop every unit of every scene, with the reason.

    reads: (keys, panel, kind, quality, dialogue, narration_text); a missing read
    counts as story/ok. A text-only unit stays only when the narration quotes it.
    """
    keys = list(keys)
    on = [*keys, "scene", "ord"]
    spoken = F.exists("dialogue", lambda d: F.coalesce(d["text"], F.lit("")) != "")
    unit = reads.select(
        *keys, "panel", "kind", "quality", F.coalesce(spoken, F.lit(False)).alias("__spoken"),
        X.dialogue_text(F.col("narration_text"), F.col("dialogue")).alias("__dtext"),
    )
    rows = scene_panels.join(unit, [*keys, "panel"], "left").withColumns({
        "kind": F.coalesce("kind", F.lit("story")), "quality": F.coalesce("quality", F.lit("ok")),
    })
    cards = spread(rows.filter("kind = 'textonly'").join(script, [*keys, "scene"]), *on).select(
        *on, X.plain_words("narration").alias("a"), X.plain_words("__dtext").alias("b")
    )
    quoted = longest_shared_run(cards, on, "a", "b").filter(F.col("chars") >= QUOTE_CHARS).select(
        *on, F.lit(True).alias("__quoted")
    )
    rows = rows.join(quoted, on, "left")
    hook = (F.col("scene") == 0) & ~((F.col("kind") == "story") & (F.col("quality") == "ok"))
    reason = F.when(F.col("kind").isin(*HARD_KINDS), F.concat(F.lit("kind="), F.col("kind"))).when(
        F.col("kind") == "textonly",
        F.when(F.lit(strict) & ~F.coalesce("__spoken", F.lit(False)), "textonly without dialogue").when(
            F.col("__quoted").isNull(), "textonly not quoted"
        ),
    ).when(hook, "hook requires story/ok")
    # the text comparison is the costly part: write its verdicts once before they are read twice
    rows = cut_lineage(rows.select(*scene_panels.columns, "quality", reason.alias("reason")))
    clean = rows.filter("reason IS NULL AND quality <> 'cut'").select(*keys, "scene").distinct().withColumn(
        "__clean", F.lit(True)
    )
    rows = rows.join(clean, [*keys, "scene"], "left")
    cut = F.when(F.col("reason").isNull() & (F.col("quality") == "cut") & F.col("__clean"), "cut with alternatives")
    rows = rows.withColumn("reason", F.coalesce("reason", cut))
    return rows.select(*scene_panels.columns, F.col("reason").isNull().alias("keep"), "reason")


def neighbor_kinds(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kind of the previous and next unit in reading order."""
    return scan(
        reads, keys, ["read_pos"], ordinal_block("read_pos"),
        prev={"prev_kind": F.col("kind")}, nxt={"next_kind": F.col("kind")},
    )


# Limits of the text-card gate and the phrases that give a card away.
CARD_COVER, CARD_INK, CARD_FLAT, CARD_HEIGHT, CARD_CHARS = 0.10, 0.05, 0.85, 450, 20
CARD_PHRASES = (
    r"(?i)(?:speech|text)\s*bubbles?|captions?\b|korean characters?|title card|text[ -]?panels?|black panel|"
    r"sound[- ]?effect\s+(?:text|characters|lettering)|form(?:s|ing)\s+(?:korean\s+)?characters"
)


def text_dominant_gate(units: DataFrame) -> DataFrame:
    """ok, suspect or drop from measured signals.

    units: coverage, flat, ink_out, height, n_boxes (null when unmeasured), chars,
    beat, has_dialogue, has_art, prev_kind, next_kind. Adds ``hits`` and ``verdict``.
    """
    c = F.col
    solid = ((c("coverage") >= CARD_COVER) | (c("flat") >= CARD_FLAT)) & (c("ink_out") <= CARD_INK)
    tiny = (c("height") <= CARD_HEIGHT) & (c("n_boxes") >= 1) & (c("chars") > 0) & (c("chars") <= CARD_CHARS)
    near = _either(c("prev_kind").isin(*HARD_KINDS), F.lit(False)) | _either(c("next_kind").isin(*HARD_KINDS), F.lit(False))
    hits = F.array_compact(F.array(
        F.when(solid, "R1"), F.when(tiny, "R2"),
        F.when(F.coalesce("beat", F.lit("")).rlike(CARD_PHRASES), "R3"), F.when(near, "S4"),
    ))
    rows = units.withColumn("hits", hits)
    first = F.get("hits", F.lit(0))
    return rows.withColumn(
        "verdict",
        F.when((F.size("hits") == 0) | c("has_art"), "ok").when((first == "R1") & ~c("has_dialogue"), "drop")
        .otherwise("suspect"),
    )


# -- quotes -----------------------------------------------------------------


def scene_quotes(script: DataFrame, keys: Sequence[str]) -> DataFrame:
    """X8 per scene: (keys, scene, quote_pos, quote)."""
    return script.select(*keys, "scene", F.posexplode(X.anchored_quotes("narration")).alias("quote_pos", "quote"))


def _score_words(text: Column | str) -> Column:
    plain = F.regexp_replace(F.lower(X.straight_quotes(text)), "[^a-z0-9' ]", " ")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def singles_and_pairs(units: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str], adjacent: bool) -> DataFrame:
    """Every unit text and every text of two neighbours.

    Adds is_pair, next_<payload> and the joined text. With ``adjacent`` only units
    whose positions differ by one form a pair.
    """
    keys = list(keys)
    ahead = {f"next_{p}": F.col(p) for p in [*payload, "dtext", order]}
    rows = scan(units, keys, [order], ordinal_block(order), nxt=ahead)
    single = units.withColumn("is_pair", F.lit(0))
    pairs = rows.filter(F.col(f"next_{order}").isNotNull())
    if adjacent:
        pairs = pairs.filter(F.col(f"next_{order}") == F.col(order) + 1)
    pairs = pairs.withColumns({
        "is_pair": F.lit(1), "dtext": F.concat_ws(" ", F.coalesce("dtext", F.lit("")), F.coalesce("next_dtext", F.lit(""))),
    })
    extra = [f"next_{p}" for p in [*payload, order]]
    return single.unionByName(pairs.select(*units.columns, "is_pair", *extra), allowMissingColumns=True)


def quote_match(quotes: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best of the scene's units, singles before neighbour pairs, per quote.

    kept: (keys, scene, ord, panel, dtext). Status is ok, fuzzy or absent; a score
    below the fuzzy bound is not resolved further and shown as null.
    """
    keys = list(keys)
    on = [*keys, "scene", "quote_pos"]
    options = singles_and_pairs(kept, [*keys, "scene"], "ord", ["panel"], adjacent=False)
    options = options.withColumn("u_words", F.array_distinct(_score_words("dtext")))
    trial = quotes.withColumn("q_words", _score_words("quote")).join(options, [*keys, "scene"])
    trial = spread(trial.filter(covered(F.col("q_words"), F.col("u_words")) >= _COVER_FLOOR), *on, "ord", "is_pair")
    scored = trial.select(*on, "ord", "is_pair", "panel", "next_panel", quote_score("quote", "dtext").alias("score"))
    best = scored.groupBy(*on).agg(F.max_by(
        F.struct("score", "is_pair", "panel", "next_panel"),
        F.struct("score", (-F.col("is_pair")).alias("s"), (-F.col("ord")).alias("o")),
    ).alias("b")).select(*on, "b.*")
    rows = quotes.join(best, on, "left")
    found = F.when(F.col("score") >= QUOTE_FOUND, "ok").when(F.col("score") >= QUOTE_MAYBE, "fuzzy").otherwise("absent")
    return rows.withColumns({"status": found, "score": F.when(F.col("score") >= QUOTE_MAYBE, F.col("score"))})


def quote_windows(scene_panels: DataFrame, scenes: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reading-order bounds (lo, hi) of every scene for quote rescues.

    scene_panels: (keys, scene, read_pos or null); scenes: every (keys, scene);
    sizes: (keys, n_reads). Both bounds are exclusive.
    """
    keys = list(keys)
    low = scene_panels.groupBy(*keys, "scene").agg(F.min("read_pos").alias("low"))
    rows = scenes.select(*keys, "scene").distinct().join(low, [*keys, "scene"], "left")
    rows = scan(rows, keys, ["scene"], ordinal_block("scene"), before={"__p": F.col("low")}, after={"__n": F.col("low")})
    return rows.join(sizes, keys).select(
        *keys, "scene", F.coalesce(F.col("__p") - 1, F.lit(-1)).alias("lo"), F.coalesce("__n", "n_reads").alias("hi")
    )


def quote_candidates(quotes: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quote-unit pairs in a group that share at least 35 % of the quote's words.

    Prefix filter: of the quote's words ordered rarest first, a match must hold
    one of the first n − ⌈0.35 n⌉ + 1, so frequent words never generate pairs
    unless the quote consists of them.
    """
    keys = list(keys)
    qid = [*keys, "scene", "quote_pos"]
    units = units.withColumn("u_words", F.array_distinct(_score_words("dtext")))
    words = units.select(*keys, F.explode("u_words").alias("word"))
    weight = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("freq"))
    q = quotes.withColumn("q_words", _score_words("quote"))
    spots = q.select(*qid, F.size("q_words").alias("n"), F.posexplode("q_words").alias("pos", "word"))
    spots = spots.join(weight, [*keys, "word"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    rare = spots.withColumn("rank", F.row_number().over(Window.partitionBy(*qid).orderBy("freq", "word", "pos")))
    need = F.ceil(F.col("n") * _COVER_FLOOR - 1e-9)
    rare = rare.filter((F.col("rank") <= F.col("n") - need + 1) & (F.col("freq") > 0)).select(*qid, "word").distinct()
    posts = units.select(*keys, "unit_id", F.explode("u_words").alias("word"))
    hits = rare.join(posts, [*keys, "word"]).select(*qid, "unit_id").distinct()
    pairs = hits.join(q.select(*qid, "quote", "q_words"), qid).join(units, [*keys, "unit_id"])
    return pairs.filter(covered(F.col("q_words"), F.col("u_words")) >= _COVER_FLOOR).drop("q_words", "u_words")


def quote_rescue(
    quotes: DataFrame, reads: DataFrame, windows: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Chapter-wide best unit or consecutive pair for quotes absent from their scene.

    reads: (keys, read_pos, panel, kind, dtext). Accepted only at a score of 0.75
    and strictly inside the scene's window, else a miss.
    """
    keys = list(keys)
    on = [*keys, "scene", "quote_pos"]
    able = reads.filter(~F.coalesce("kind", F.lit("story")).isin(*HARD_KINDS)).select(*keys, "read_pos", "panel", "dtext")
    options = singles_and_pairs(able, keys, "read_pos", ["panel"], adjacent=True)
    options = options.withColumn("unit_id", F.struct("read_pos", "is_pair"))
    trial = spread(quote_candidates(quotes, options, keys), *on, "read_pos", "is_pair")
    scored = trial.select(
        *on, "read_pos", "is_pair", "panel", "next_panel", "next_read_pos", quote_score("quote", "dtext").alias("score")
    )
    best = scored.groupBy(*on).agg(F.max_by(
        F.struct("score", "is_pair", "panel", "next_panel", "read_pos", "next_read_pos"),
        F.struct("score", (-F.col("is_pair")).alias("s"), (-F.col("read_pos")).alias("o")),
    ).alias("b")).select(*on, "b.*")
    rows = quotes.join(best, on, "left").join(windows, [*keys, "scene"])
    last = F.coalesce("next_read_pos", "read_pos")
    inside = (F.col("lo") < F.col("read_pos")) & (last < F.col("hi"))
    accept = (F.col("score") >= QUOTE_FOUND) & inside
    return rows.withColumn("status", F.when(accept, "append").otherwise("miss"))


def drop_protection(
    drops: DataFrame, kept: DataFrame, script: DataFrame, reads: DataFrame, appended: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Why a rejected unit must stay, first reason wins; null when it may go.

    drops: (keys, scene, panel); kept: (keys, scene, ord, panel); reads: (keys,
    panel, dtext); appended: units added for a quote.
    """
    keys = list(keys)
    on = [*keys, "scene", "panel"]
    last = kept.groupBy(*keys, "scene").agg(F.max_by("panel", "ord").alias("__last"))
    rows = drops.join(appended.select(*on).distinct().withColumn("__app", F.lit(True)), on, "left")
    rows = rows.join(last, [*keys, "scene"], "left")
    texts = drops.select(*on).distinct().join(script, [*keys, "scene"]).join(reads.select(*keys, "panel", "dtext"), [*keys, "panel"])
    texts = cut_lineage(spread(texts, *on))
    runs = longest_shared_run(
        texts.select(*on, X.anchor_words("narration").alias("a"), X.anchor_words("dtext").alias("b")), on, "a", "b"
    ).filter(F.col("chars") >= ANCHOR_CHARS).select(*on, F.lit(True).alias("__run"))
    said = texts.select(*on, "dtext", F.explode(X.anchored_quotes("narration")).alias("quote"))
    said = said.filter(covered(_score_words("quote"), F.array_distinct(_score_words("dtext"))) >= _COVER_FLOOR)
    said = said.filter(quote_score("quote", "dtext") >= QUOTE_FOUND).select(*on).distinct().withColumn("__said", F.lit(True))
    rows = rows.join(runs, on, "left").join(said, on, "left")
    return rows.select(*drops.columns, F.coalesce(
        F.when(F.col("__app"), "quote append"), F.when(F.col("__last") == F.col("panel"), "final panel"),
        F.when(F.col("__run"), "narration quotes it"), F.when(F.col("__said"), "carries anchored quote"),
    ).alias("protected_by"))


def apply_relevance_verdicts(
    kept: DataFrame, answers: DataFrame, protected: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Drop units a reviewer called irrelevant unless protected.

    answers: (keys, scene, ord, relevant), aligned by position; a missing or null
    answer keeps the unit.
    """
    on = [*keys, "scene", "ord"]
    rejected = answers.filter(~F.coalesce("relevant", F.lit(True))).select(*on).distinct()
    doomed = kept.join(rejected, on, "left_semi").join(
        protected.select(*keys, "scene", "panel").distinct(), [*keys, "scene", "panel"], "left_anti"
    )
    return kept.join(doomed.select(*on), on, "left_anti")


def substitute_units(
    kept: DataFrame, scenes: DataFrame, originals: DataFrame, reads: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Fill emptied scenes with the best nearby unit, in scene order.

    kept: (keys, scene, read_pos) of surviving units; scenes: (keys, scene,
    narration); originals: (keys, scene, read_pos) of the scripted units; reads:
    (keys, read_pos, kind, quality, unit_text). Returns (keys, scene, read_pos,
    how) for filled scenes: how is in-window, out-of-window or originals.

    Only neighbouring emptied scenes depend on each other, so every round fills
    the first emptied scene of each run in all groups at once; the number of
    rounds is the longest run of emptied scenes.
    """
    keys = list(keys)
    on = [*keys, "scene"]
    pool = reads.filter("kind = 'story' AND quality = 'ok'")
    pool = with_tokens(pool, "unit_text", "u").select(*keys, "read_pos", "u_tokens", "u_names")
    pool = cut_lineage(scan(pool, keys, ["read_pos"], ordinal_block("read_pos"), number="slot"))
    sizes = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads"))
    anchors = originals.filter("read_pos >= 0").groupBy(*on).agg(F.avg("read_pos").alias("mean_pos"))
    plan = with_tokens(scenes, "narration", "n").select(*on, "n_tokens", "n_names").join(anchors, on, "left").join(
        sizes, keys, "left"
    )
    spans = kept.filter("read_pos >= 0").groupBy(*on).agg(F.min("read_pos").alias("p0"), F.max("read_pos").alias("p1"))
    shown = kept.select(*on).distinct().withColumn("shown", F.lit(True))
    state = plan.join(spans, on, "left").join(shown, on, "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    stocked = pool.select(*keys).distinct().withColumn("stocked", F.lit(True))
    state = state.join(stocked, keys, "left")
    restored = state.filter("NOT shown AND stocked IS NULL").select(*on)
    done = [originals.join(restored, on, "left_semi").select(*on, "read_pos", F.lit("originals").alias("how"))]
    state = cut_lineage(state.filter("shown OR stocked"))
    while not state.filter("NOT shown").isEmpty():
        seen = scan(
            state, keys, ["scene"], ordinal_block("scene"),
            prev={"prev_shown": F.col("shown")}, before={"lo": F.col("p1")}, after={"hi": F.col("p0")},
        )
        turn = seen.filter(~F.col("shown") & F.coalesce("prev_shown", F.lit(True)))
        turn = turn.withColumns({"lo": F.coalesce("lo", F.lit(-1)), "hi": F.coalesce("hi", "n_reads")})
        turn = turn.withColumn("anchor", F.coalesce("mean_pos", (F.col("lo") + F.col("hi")) / 2))
        turn = turn.withColumn("inside", F.greatest(F.least(F.col("anchor"), F.col("hi").cast("double")), F.col("lo").cast("double")))
        picks = None
        for how, at in (("in-window", "inside"), ("out-of-window", "anchor")):
            spot = asof(
                turn.select(*on, "n_tokens", "n_names", "lo", "hi", "anchor", F.col(at).alias("at")),
                pool.select(*keys, F.col("read_pos").cast("double").alias("step"), "slot"),
                keys, "at", "step", ["slot"], ordinal_block,
            )
            # the unit on the window's rim does not count, so one slot more is looked at below
            base = F.coalesce("slot", F.lit(-1))
            near = spot.withColumn("slot", F.explode(F.sequence(base - RESCUE_POOL, base + RESCUE_POOL)))
            near = near.join(pool, [*keys, "slot"])
            if how == "in-window":
                near = near.filter((F.col("read_pos") > F.col("lo")) & (F.col("read_pos") < F.col("hi")))
            near = near.withColumns({"gap": F.abs(F.col("read_pos") - F.col("anchor")), "how": F.lit(how)})
            picks = near if picks is None else picks.unionByName(near)
        by_gap = Window.partitionBy(*on, "how").orderBy("gap", "read_pos")
        picks = picks.withColumn("rank", F.row_number().over(by_gap)).filter(F.col("rank") <= RESCUE_POOL)
        score = relevance(F.col("n_tokens"), F.col("n_names"), F.col("u_tokens"), F.col("u_names"))
        best = picks.groupBy(*on).agg(F.min_by(
            F.struct("read_pos", "how"),
            F.struct((F.col("how") != "in-window").alias("far"), (-score).alias("s"), F.col("gap"), F.col("rank")),
        ).alias("b")).select(*on, "b.*")
        best = cut_lineage(best)
        done.append(best)
        filled = best.select(*on, F.col("read_pos").alias("f"))
        state = cut_lineage(state.join(filled, on, "left").withColumns({
            "p0": F.coalesce("p0", "f"), "p1": F.coalesce("p1", "f"), "shown": F.col("shown") | F.col("f").isNotNull(),
        }).drop("f"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def nearest_by_number(points: DataFrame, pool: DataFrame, keys: Sequence[str], number: str, value: str) -> DataFrame:
    """Nearest pool row on the number line, lower number on ties (adds ``nearest``).

    One ordered scan of both sides; ``pool`` rows with the point's own number are
    skipped, so a point never gets itself.
    """
    keys = list(keys)
    ids = [c for c in points.columns]
    spots = pool.groupBy(*keys, F.col(number).alias("__n")).agg(F.min(value).alias("__value"))
    both = points.select(*keys, F.col(number).alias("__n"), F.struct(*ids).alias("__point"), F.lit(1).alias("__side"),
                         F.xxhash64(*ids).alias("__tie"))
    other = spots.select(*keys, "__n", F.lit(0).alias("__side"), F.lit(0).cast("bigint").alias("__tie"),
                         F.struct("__n", "__value").alias("__spot"))
    # the spot on the point's own number sits right before it: look one further back as well
    steps = scan(other.withColumnRenamed("__spot", "s"), keys, ["__n"], ordinal_block("__n"), prev={"p": F.col("s")})
    rows = both.unionByName(
        steps.select(*keys, "__n", "__side", "__tie", F.struct(F.col("s").alias("s"), F.col("p").alias("p")).alias("__spot")),
        allowMissingColumns=True,
    )
    rows = scan(rows, keys, ["__n", "__side", "__tie"], ordinal_block("__n"),
                before={"__b": F.col("__spot")}, after={"__a": F.col("__spot.s")}).filter("__side = 1")
    low = F.when(F.col("__b.s.__n") == F.col("__n"), F.col("__b.p")).otherwise(F.col("__b.s"))
    high = F.col("__a")
    nearer = F.when(
        high.isNull() | (F.col("__n") - low["__n"] <= high["__n"] - F.col("__n")), low["__value"]
    ).otherwise(high["__value"])
    return rows.select("__point.*", nearer.alias("nearest"))


# Kinds and faults that make a scene worth fixing.
BAD_KINDS = ("cover", "credits", "endmatter", "textonly")
FIXABLE = ("empty_screen", "irrelevant_panel", "weak_hook")


def apply_fixes(
    scene_panels: DataFrame, faults: DataFrame, reads: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """New unit list of scenes with fixable faults.

    scene_panels: (keys, scene, ord, panel, number); reads: (keys, panel, number,
    kind, quality). A scene left empty gets the healthy unit nearest to its first
    original. Adds ``action``: kept, dropped or replaced; dropped rows are reported.
    """
    keys = list(keys)
    on = [*keys, "scene"]
    hit = faults.filter(F.col("type").isin(*FIXABLE) & F.col("scene").isNotNull()).select(*on).distinct()
    rows = scene_panels.join(hit, on, "left_semi").join(reads.select(*keys, "panel", "kind", "quality"), [*keys, "panel"], "left")
    bad = F.coalesce(F.col("kind").isin(*BAD_KINDS), F.lit(False)) | F.coalesce(F.col("quality") == "sparse", F.lit(False))
    rows = rows.withColumn("action", F.when(bad, "dropped").otherwise("kept"))
    emptied = rows.groupBy(*on).agg(
        F.count_if(F.col("action") == "kept").alias("left"), F.min_by("number", "ord").alias("number")
    ).filter("left = 0").select(*on, "number")
    healthy = reads.filter(
        (F.coalesce("kind", F.lit("story")) == "story") & (F.coalesce("quality", F.lit("ok")) == "ok")
    )
    new = nearest_by_number(emptied, healthy, keys, "number", "panel").filter("nearest IS NOT NULL").select(
        *on, F.lit(0).cast("bigint").alias("ord"), F.col("nearest").alias("panel"), F.lit("replaced").alias("action")
    )
    return rows.select(*on, F.col("ord").cast("bigint").alias("ord"), "panel", "action").unionByName(new)


def verification_summary(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Log entries per action."""
    return log.groupBy(*keys, "action").agg(F.count(F.lit(1)).alias("n"))


def changed_scenes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions whose record differs; only scenes present on both sides.

    Each side is (keys, scene, record columns); records are compared by a null-safe
    struct test, no serialisation.
    """
    keys = list(keys)
    pack = lambda df, name: df.select(*keys, "scene", F.struct(
        *[F.col(c) for c in sorted(df.columns) if c not in (*keys, "scene")]).alias(name))
    both = pack(before, "__a").join(pack(after, "__b"), [*keys, "scene"])
    return both.filter(~F.col("__a").eqNullSafe(F.col("__b"))).select(*keys, "scene")


def merge_reads_by_map(reads: DataFrame, mapping: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reads of units merged into one; unfed units get an empty read of kind "art".

    reads in reading order (read_pos); mapping: (keys, panel, new_panel).
    """
    keys = list(keys)
    fed = reads.join(mapping, [*keys, "panel"])
    entries = F.array_sort(F.collect_list(F.struct(
        "read_pos", "dialogue", "narration_text", "sfx", "scene_beat", "kind", "quality"
    )))
    merged = fed.groupBy(*keys, "new_panel").agg(entries.alias("r"))
    glue = lambda field, sep: F.array_join(F.filter(F.transform("r", lambda x: F.trim(x[field])), lambda s: s != ""), sep)
    alone = F.size("r") == 1
    first = F.col("r")[0]
    built = merged.select(
        *keys, "new_panel",
        F.flatten(F.transform("r", lambda x: x["dialogue"])).alias("dialogue"),
        F.when(alone, first["narration_text"]).otherwise(glue("narration_text", " ")).alias("narration_text"),
        F.when(alone, first["sfx"]).otherwise(glue("sfx", " ")).alias("sfx"),
        F.when(alone, first["scene_beat"]).otherwise(glue("scene_beat", " / ")).alias("scene_beat"),
        first["kind"].alias("kind"), first["quality"].alias("quality"),
    )
    out = units.select(*keys, F.col("panel").alias("new_panel")).join(built, [*keys, "new_panel"], "left")
    return out.select(
        *keys, "new_panel", F.coalesce("dialogue", F.array().cast(built.schema["dialogue"].dataType)).alias("dialogue"),
        *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in
          (("narration_text", ""), ("sfx", ""), ("scene_beat", ""), ("kind", "art"), ("quality", "ok"))],
    )


def prefer_cleaned(refs: DataFrame, cleaned: DataFrame, marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cleaned version of each referenced unit, and whether cropping is off.

    A unit with a recorded mark and no cleaned version must not be cropped.
    """
    on = [*keys, "panel"]
    rows = refs.join(cleaned.select(*on, F.col("path").alias("__clean")).distinct(), on, "left")
    rows = rows.join(marked.select(*on).distinct().withColumn("__mark", F.lit(True)), on, "left")
    return rows.withColumns({
        "resolved": F.coalesce("__clean", "path"),
        "no_crop": F.col("__clean").isNull() & F.coalesce("__mark", F.lit(False)),
    }).drop("__clean", "__mark")


# -- roll-ups over text -------------------------------------------------------

# Mood names in priority order and the cue words voting for them.
MOODS = (
    "Epic", "Cinematic", "Dramatic", "Emotional", "Sad", "Inspiring", "Uplifting", "Powerful", "Hype", "Energetic",
    "Exciting", "Action", "Happy", "Fun", "Chill", "Calm", "Peaceful", "Relaxing", "Romantic", "Mysterious", "Dark",
    "Suspense", "Lofi", "Ambient",
)
MOOD_CUES = {
    "Epic": r"\b(epic|legend|ultimate|unleash|awaken|god|titan|destiny|war|battle)\b",
    "Cinematic": r"\b(cinematic|trailer|world|fate|journey|rises?|dawn|horizon)\b",
    "Dramatic": r"\b(shatter|betray|nightmare|crushing|desperate|storm|collapse)\b",
    "Emotional": r"\b(tears?|heart|memories|goodbye|alone|promise|bond|feelings?)\b",
    "Sad": r"\b(sad|grief|loss|lonely|loneliness|sorrow|cry|mourn|broken)\b",
    "Inspiring": r"\b(hope|dream|believe|rise|overcome|never give up|courage|resolve)\b",
    "Uplifting": r"\b(win|victory|triumph|together|friends?|shine|bright|future)\b",
    "Powerful": r"\b(power|strength|force|dominate|crush|overwhelming|might)\b",
    "Hype": r"\b(hype|insane|crazy|explosive|firestorm|ignite|blast|rush)\b",
    "Energetic": r"\b(fast|race|speed|chase|adrenaline|charge|sprint)\b",
    "Exciting": r"\b(exciting|thrill|shock|reveal|twist|surprise)\b",
    "Action": r"\b(fight|clash|strike|attack|slash|punch|combat|duel)\b",
    "Happy": r"\b(happy|smile|laugh|joy|cheer|fun day|celebrat)\b",
    "Chill": r"\b(chill|calm day|relax|slice of life|casual|peaceful morning)\b",
    "Romantic": r"\b(love|crush|blush|romance|date|kiss|confession)\b",
    "Mysterious": r"\b(mystery|secret|hidden|strange|unknown|shadow|whisper)\b",
}
DEFAULT_MOOD = "Cinematic"


def mood_vote(texts: DataFrame, keys: Sequence[str], text: str, cues: dict[str, str] = MOOD_CUES, moods: Sequence[str] = MOODS) -> DataFrame:
    """Mood with most cue hits per group, ties by mood order, else the default.

    One pass counts all moods side by side; the group sums are a partial aggregate.
    """
    body = F.lower(F.coalesce(text, F.lit("")))
    counts = texts.select(*keys, *[F.regexp_count(body, F.lit("(?U)" + cue)).alias(m) for m, cue in cues.items()])
    sums = counts.groupBy(*keys).agg(*[F.sum(m).cast("bigint").alias(m) for m in cues])
    rank = {m: i for i, m in enumerate(moods)}
    votes = F.array(*[
        F.struct(F.col(m).alias("n"), F.lit(-rank.get(m, 0)).alias("p"), F.lit(m).alias("mood")) for m in cues
    ])
    top = F.array_max(votes)
    return sums.select(
        *keys, F.when(top["n"] > 0, top["mood"]).otherwise(DEFAULT_MOOD).alias("mood"), top["n"].alias("n_hits")
    )


def derive_mood(scenes: DataFrame, scripts: DataFrame, keys: Sequence[str], override: str | None = None) -> DataFrame:
    """(keys, mood, why) of every script: the override, the script's own mood, the vote, or the default.

    scenes: (keys, narration, caption, keywords array); scripts: (keys, title, music_mood), one row
    per script. Narrations, captions, keywords and the title vote.
    """
    keys = list(keys)
    said = F.concat_ws(" ", "narration", "caption", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "))
    texts = scenes.select(*keys, said.alias("text")).unionByName(scripts.select(*keys, F.col("title").alias("text")))
    rows = scripts.select(*keys, "music_mood").join(mood_vote(texts, keys, "text"), keys, "left")
    own, voted = F.coalesce("music_mood", F.lit("")) != "", F.coalesce("n_hits", F.lit(0)) > 0
    mood = F.when(own, F.col("music_mood")).otherwise(F.coalesce("mood", F.lit(DEFAULT_MOOD)))
    why = F.when(own, "script").when(voted, "vote").otherwise("default")
    if override:
        mood, why = F.lit(override), F.lit("override")
    return rows.select(*keys, mood.alias("mood"), why.alias("why"))


# Capitalised words that are no names.
NAME_STOP = (
    "This", "That", "Then", "There", "They", "When", "Where", "What", "With", "From", "Above", "Below", "After", "Before",
    "Someone", "Something", "Chapter", "Because", "Instead",
)


def recurring_names(texts: DataFrame, keys: Sequence[str], order: str, text: str, at_least: int = 5, top: int = 6) -> DataFrame:
    """Most frequent capitalised words of four letters or more; first seen wins ties."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b([A-Z][a-z]{3,})\b"), F.lit(1))
    words = texts.select(*keys, order, F.posexplode(found).alias("pos", "name")).filter(~F.col("name").isin(*NAME_STOP))
    counts = words.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "pos")).alias("first"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first")))
    return ranked.filter((F.col("rank") <= top) & (F.col("n") >= at_least)).select(*keys, "name", "n", "rank")


def confusion_matrix(log: DataFrame, labels: DataFrame, keys: Sequence[str], enough: int = 9) -> DataFrame:
    """How a gate's drops and suspects fall on labelled units.

    log: (keys, unit, verdict, ord), verdict drop or suspect, last entry of a kind
    wins and a drop outweighs a suspicion; labels: (keys, unit, positive).
    """
    keys = list(keys)
    seen = log.groupBy(*keys, "unit").agg(
        F.max(F.col("verdict") == "drop").alias("dropped"), F.max(F.col("verdict") == "suspect").alias("suspected")
    )
    rows = labels.join(seen, [*keys, "unit"], "left")
    drop = F.coalesce("dropped", F.lit(False))
    suspect = ~drop & F.coalesce("suspected", F.lit(False))
    pos = F.col("positive")
    out = rows.groupBy(*keys).agg(
        F.count_if(pos & drop).alias("caught_drop"), F.count_if(pos & suspect).alias("caught_suspect"),
        F.count_if(pos & ~drop & ~suspect).alias("missed"), F.count_if(~pos & drop).alias("false_drops"),
        F.count_if(~pos & suspect).alias("negative_suspects"),
    )
    caught = F.col("caught_drop") + F.col("caught_suspect")
    return out.withColumn("accepted", (caught >= enough) & (F.col("false_drops") == 0))


def window_text(script: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordered text of the scenes a window covers; all scenes without one.

    windows: (keys, first, last). The text of a window is one value by definition.
    """
    keys = list(keys)
    rows = script.join(windows, keys, "left").filter(
        F.col("first").isNull() | F.col("scene").between(F.col("first"), F.col("last"))
    )
    parts = F.array_sort(F.collect_list(F.struct("scene", F.coalesce("narration", F.lit("")).alias("s"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["s"]), " ").alias("text"))
