"""Catalogs: ranking, availability, planning, tracks, rules and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions.text import slugify
from seqlens.functions.values import chapter_label
from seqlens.plans.scan import ranked_positions
from seqlens.session import cut_lineage

# Genres that hold viewers, and the score's parts.
HIGH_RETENTION = (
    "Action", "Adventure", "Fantasy", "Supernatural", "Drama", "Mystery", "Thriller", "Sports", "Sci-Fi", "Horror",
)
W_TREND, W_POPULARITY, W_FAVOURITE, W_SCORE, W_GENRE = 0.35, 0.25, 0.15, 0.15, 0.10
PROBE_TOP = 15
ENOUGH_CHAPTERS = 5


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``video_score`` (4 digits) and ``reasons``; best first is (score desc, ord).

    Trend, popularity and favourites are scaled by the set's maxima, taken as one-row
    scalar subqueries. Availability counts only where ``fetchable`` is known.
    """
    # one aggregate row serves all three maxima; a maximum of 0 scales by 1
    top = candidates.agg(F.struct(*[
        F.when(F.max(c) == 0, 1).otherwise(F.max(c)).alias(c) for c in ("trending", "popularity", "favourites")
    ]).alias("m")).scalar()
    c = F.col
    rows = candidates.withColumn("__top", top)
    trend, pop, fav = (c(n) / c(f"__top.{n}") for n in ("trending", "popularity", "favourites"))
    hits = F.size(F.array_intersect(F.array_distinct("genres"), F.array(*[F.lit(g) for g in HIGH_RETENTION])))
    score = F.coalesce("score", F.lit(0))
    total = (
        W_TREND * trend + W_POPULARITY * pop + W_FAVOURITE * fav + W_SCORE * (score / 100)
        + W_GENRE * F.least(hits / 3, F.lit(1.0))
    )
    running, deep = c("status") == "RELEASING", F.coalesce(c("chapters") > 100, F.lit(False))
    total = total + F.when(running, 0.03).otherwise(0.0)
    total = total + F.when(deep, 0.02).otherwise(0.0)
    known, n = c("fetchable").isNotNull(), c("fetchable_chapters")
    enough = n >= ENOUGH_CHAPTERS
    bonus = (
        F.when(~known, 0.0).when(c("starts_at_one") & enough, 0.20).when(c("fetchable") & enough, 0.05)
        .when(c("fetchable"), -0.15).otherwise(-0.30)
    )
    num = lambda x: x.cast("string")
    # The wording of reasons.
    reasons = F.array_compact(F.array(
        F.when(trend > 0.6, "surging in current trends"),
        F.when(pop > 0.6, "very large existing audience"),
        F.when(hits > 0, F.concat(num(hits), F.lit(" high-retention genre(s)"))),
        F.when(running, "ongoing — fresh chapters to recap"),
        F.when(score >= 80, F.concat(F.lit("highly rated ("), num(score), F.lit("/100)"))),
        F.when(deep, F.concat(F.lit("deep back-catalog ("), num(c("chapters")), F.lit(" ch)"))),
        F.when(known, F.when(c("starts_at_one") & enough, F.concat(F.lit("binge-able: "), num(n), F.lit(" EN ch from ch1")))
               .when(c("fetchable") & enough, F.concat(num(n), F.lit(" EN ch (not from ch1)")))
               .when(c("fetchable"), F.lit("only latest chapter fetchable (can't start ch1)"))
               .otherwise(F.lit("NOT legally downloadable in order"))),
    ))
    clamped = F.least(F.greatest(total + bonus, F.lit(0.0)), F.lit(1.0))
    return rows.withColumns({"video_score": F.round(clamped, 4), "reasons": reasons}).drop("__top")


def unprobed(candidates: DataFrame) -> DataFrame:
    """Availability columns as unknown."""
    return candidates.withColumns({
        "fetchable": F.lit(None).cast("boolean"), "fetchable_chapters": F.lit(0).cast("bigint"), "starts_at_one": F.lit(False),
    })


def best_first(ranked: DataFrame) -> DataFrame:
    """Sorted best first; input order breaks ties."""
    return ranked.orderBy(F.desc("video_score"), "ord")


def availability_rollup(titles: DataFrame, listing: DataFrame, feed: DataFrame) -> DataFrame:
    """What can be fetched of each title.

    titles: (source_id, title, title_alt); listing: (name, series) known series;
    feed: (series, chapter, pages, external_url). The alternative title is looked up
    only when the first is unknown. A series whose rows are all filtered and a series
    without rows get different notes.
    """
    number = F.trim("chapter").try_cast("double")
    ok = F.col("external_url").isNull() & (F.coalesce("pages", F.lit(0)) > 0) & number.isNotNull()
    sums = feed.groupBy("series").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("n"), F.min(F.when(ok, number)).alias("first")
    )
    names = listing.groupBy("name").agg(F.min("series").alias("series"))
    rows = titles.join(names.select(F.col("name").alias("title"), F.col("series").alias("s1")), "title", "left")
    rows = rows.join(names.select(F.col("name").alias("title_alt"), F.col("series").alias("s2")), "title_alt", "left")
    rows = rows.withColumn("series", F.coalesce("s1", "s2")).join(sums, "series", "left")
    n = F.coalesce("n", F.lit(0))
    early = F.coalesce(F.col("first") <= 1.0, F.lit(False))
    shown = F.when(F.col("first") == F.floor("first"), F.floor("first").cast("string")).otherwise(F.col("first").cast("string"))
    note = (
        F.when(F.col("series").isNull(), "not found").when(F.col("rows").isNull(), "no English chapters")
        .when(n == 0, "licensed/external — no fetchable EN pages")
        .when(early, F.concat(n.cast("string"), F.lit(" fetchable EN chapters from ch1 (binge-in-order)")))
        .otherwise(F.concat(n.cast("string"), F.lit(" fetchable EN chapters, but earliest is ch"), shown, F.lit(" (no ch1)")))
    )
    return rows.select(
        "source_id", (n > 0).alias("fetchable"), n.cast("bigint").alias("fetchable_chapters"), early.alias("starts_at_one"),
        note.alias("availability_note"))


def discover(candidates: DataFrame, listing: DataFrame, feed: DataFrame, probe_top: int = PROBE_TOP) -> DataFrame:
    """Rank, look up availability of the first ``probe_top`` only, rank again."""
    first = rank_candidates(unprobed(candidates))
    top = best_first(first).limit(probe_top).select("source_id", "title", "title_alt")
    info = availability_rollup(top, listing.join(top.select(F.explode(F.array("title", "title_alt")).alias("name")).distinct(), "name", "left_semi"), feed)
    probed = candidates.join(info.drop("availability_note"), "source_id", "left").withColumns({
        "fetchable_chapters": F.coalesce("fetchable_chapters", F.lit(0)), "starts_at_one": F.coalesce("starts_at_one", F.lit(False)),
    })
    return rank_candidates(probed)


def pick_rank(ranked: DataFrame, k: int) -> DataFrame:
    """The k-th best row (1-based) with its slug; out of range is an error."""
    if k < 1:
        raise ValueError(f"rank {k} out of range")
    head = best_first(ranked).limit(k)
    # the error is raised when the plan runs, not by a driver-side count
    checked = head.agg(F.count(F.lit(1)).alias("n"), F.max_by(
        F.struct(*head.columns), F.struct((-F.col("video_score")).alias("s"), "ord")).alias("r"))
    guard = F.when(F.col("n") < k, F.raise_error(F.lit(f"rank {k} out of range"))).otherwise(F.col("r"))
    return checked.select(guard.alias("r")).select("r.*").withColumn("slug", slugify("title"))


def exclusion_set(progress: DataFrame, roster: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Titles done, retired or skipped per channel."""
    done = progress.select(*keys, "title")
    left_out = roster.filter(F.col("state").isin("retired", "skip")).select(*keys, "title")
    return done.union(left_out).distinct()


def unseen_candidates(ranked: DataFrame, excluded: DataFrame) -> DataFrame:
    """Candidates that start at chapter one and were not used, best first."""
    return ranked.filter("starts_at_one").join(excluded.select("title").distinct(), "title", "left_anti")


def numeric_chapter(label: Column) -> Column:
    """Chapter label as a number when it consists of digits, one point and dashes."""
    text = label.cast("string")
    bare = F.regexp_replace(F.regexp_replace(text, r"^([^.]*)\.", "$1"), "-", "")
    return F.when(bare.rlike(r"^\d+$"), text.try_cast("double"))


def next_item(channels: DataFrame, progress: DataFrame, promoted: DataFrame) -> DataFrame:
    """The next chapter of every channel.

    channels: (channel, title, status, total); progress: (channel, title, chapter).
    promoted: (channel, title, …) best unseen title per channel for exhausted series.
    """
    last = progress.groupBy("channel", "title").agg(F.max(numeric_chapter(F.col("chapter"))).alias("last"), F.count(F.lit(1)).alias("n_done"))
    rows = channels.join(last, ["channel", "title"], "left")
    nxt = F.coalesce(F.col("last").cast("bigint") + 1, F.lit(1))
    total = F.when(F.col("total") != 0, F.col("total"))
    beyond = F.coalesce(nxt > total, F.lit(False))
    over = beyond & (F.upper(F.coalesce("status", F.lit(""))) == "FINISHED")
    rows = rows.withColumns({"exhausted": over | F.col("title").isNull(), "chapter": nxt, "beyond": beyond})
    rows = rows.join(promoted.select("channel", F.col("title").alias("new_title")), "channel", "left")
    title = F.when(F.col("exhausted"), F.col("new_title")).otherwise(F.col("title"))
    chapter = F.when(F.col("exhausted"), F.when(F.col("new_title").isNotNull(), F.lit(1).cast("bigint"))).otherwise(F.col("chapter"))
    return rows.select(
        "channel", title.alias("title"), chapter.alias("chapter"),
        F.when(title.isNotNull(), F.concat(slugify(title), F.lit("-ch"), chapter.cast("string"))).alias("slug"),
        F.col("exhausted").alias("is_new"), (~F.col("exhausted") & F.col("beyond")).alias("caught_up"),
    )


def promote(ranked: DataFrame, excluded: DataFrame, channels: DataFrame) -> DataFrame:
    """J13 per channel: best title starting at chapter one that the channel has not used.

    A channel that has used n titles finds a fresh one among the n + 1 best, so it is
    joined to exactly those ranks; the pool itself has no bound.
    """
    best = ranked.filter("starts_at_one").groupBy("title").agg(F.min(F.struct((-F.col("video_score")).alias("s"), "ord")).alias("at"))
    pool = ranked_positions(best.select("title", "at.s", "at.ord"), [], ["s", "ord"], "rank").select("rank", "title")
    used = excluded.select("channel", "title").distinct()
    n_used = used.join(pool, "title", "left_semi").groupBy("channel").agg(F.count(F.lit(1)).alias("n_used"))
    offers = (
        channels.select("channel").distinct().join(n_used, "channel", "left")
        .select("channel", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("n_used", F.lit(0).cast("bigint")))).alias("rank"))
        .join(pool, "rank")
    )
    fresh = offers.join(used, ["channel", "title"], "left_anti")
    return fresh.groupBy("channel").agg(F.min_by("title", "rank").alias("title"))


def record_progress(progress: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add finished chapters; whole numbers lose their point, duplicates vanish."""
    norm = lambda df: df.select(*keys, chapter_label("chapter").alias("chapter"))
    return norm(progress).union(norm(finished)).distinct()


# -- tracks -------------------------------------------------------------------


def track_filter(tracks: DataFrame, blocklist: DataFrame, min_dur: float = 60.0, max_dur: float = 600.0) -> DataFrame:
    """free tracks with a file and fitting length that no listed artist blocks.

    tracks: (track_id, mood, title, artists, duration, downloads, is_premium, file).
    """
    able = tracks.filter(
        ~F.coalesce("is_premium", F.lit(False)) & (F.coalesce("file", F.lit("")) != "")
        & F.coalesce("duration", F.lit(0.0)).between(min_dur, max_dur))
    names = able.select("track_id", F.explode("artists").alias("a"), F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("title"))
    blocked = names.select("track_id", F.lower(F.trim("a")).alias("artist"), "title").join(blocklist, ["artist", "title"], "left_semi")
    return able.join(blocked.select("track_id").distinct(), "track_id", "left_anti")


def top_track(tracks: DataFrame, keys: Sequence[str], pick: int = 0) -> DataFrame:
    """T4: per group the element ``pick`` by downloads, or the last one there is."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("downloads", F.lit(0))), "ord")
    head = tracks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pick + 1)
    fields = [c for c in tracks.columns if c not in keys]
    return head.groupBy(*keys).agg(F.max_by(F.struct(*fields), "rank").alias("t")).select(*keys, "t.*")


def useful_tracks(tracks: DataFrame, moods: int, tries: int) -> DataFrame:
    """The tracks that a plan of ``moods`` moods can come to, with their ``rank`` in the mood, ``names`` and place ``again`` among equal names.

    A taken name only blocks tracks of its own title, and a plan takes at most two tracks
    per mood; so behind 2 * moods titles and ``tries`` more there is always a free
    track, and of tracks with the same title and artists only the first ``tries`` are ever tried.
    """
    named = F.filter(F.coalesce("artists", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")
    artists = F.array_sort(F.array_distinct(F.transform(named, lambda a: F.lower(F.trim(a)))))
    order = [F.desc(F.coalesce("downloads", F.lit(0))), "ord"]
    named = tracks.withColumns({"__title": F.lower(F.trim(F.coalesce("title", F.lit("")))), "__artists": artists})
    same = Window.partitionBy("mood", "__title", "__artists").orderBy(*order)
    named = named.withColumn("__again", F.row_number().over(same)).filter(F.col("__again") <= max(tries, 1))
    # titles in the order of their first track
    first = named.groupBy("mood", "__title").agg(F.min_by(F.struct(
        (-F.coalesce("downloads", F.lit(0))).alias("d"), "ord"), F.struct((-F.coalesce("downloads", F.lit(0))).alias("d"), "ord")).alias("at"))
    by_title = Window.partitionBy("mood").orderBy("at", "__title")
    titles = first.withColumn("__n", F.row_number().over(by_title)).filter(F.col("__n") <= 2 * moods + tries + 1)
    kept = named.join(titles.select("mood", "__title"), ["mood", "__title"], "left_semi")
    names = F.transform("__artists", lambda a: F.concat(a, F.lit("\u0001"), F.col("__title")))
    return kept.select("*", F.row_number().over(Window.partitionBy("mood").orderBy(*order)).alias("rank"), names.alias("names")).drop(
        "__title", "__artists").withColumnRenamed("__again", "again")


def distinct_assignment(plan: DataFrame, tracks: DataFrame, keys: Sequence[str], tries: int = 6) -> DataFrame:
    """T5: one track per distinct mood of a plan, never the same track or content twice.

    plan: (keys, ord, mood); tracks: (mood, track_id, title, artists, md5, downloads,
    ord). First every mood in plan order takes its best track of which no (artist,
    title) was taken by an earlier mood; then a mood whose content hash was seen tries
    up to ``tries`` further tracks; failing that it stays empty. A missing title counts as empty, and
    a track without artists takes no name and is never blocked by one.

    What a plan gets depends on its moods in order alone. So every distinct list of moods is folded once,
    over the tracks that a plan with so many moods can come to, and its plans join it. The fold keeps ranks, not tracks.
    """
    keys = list(keys)
    first = plan.filter(F.coalesce("mood", F.lit("")) != "").groupBy(*keys, "mood").agg(F.min("ord").alias("ord"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "mood"))), lambda m: m["mood"])
    plans = cut_lineage(first.groupBy(*keys).agg(in_order.alias("__moods")))
    lists = plans.select("__moods").distinct()
    ranked = useful_tracks(tracks, plans.agg(F.max(F.size("__moods"))).first()[0] or 0, tries)
    offers = ranked.groupBy("mood").agg(F.array_sort(F.collect_list(F.struct("rank", "track_id", "names", "md5", "again"))).alias("cands"))
    # of equal names the first one is free if any is
    offers = offers.withColumn("heads", F.transform(F.filter("cands", lambda t: t["again"] == 1), lambda t: F.struct(t["rank"], t["names"])))
    slots = lists.select("__moods", F.posexplode("__moods").alias("nth", "mood")).join(offers, "mood", "left").groupBy("__moods").agg(
        F.array_sort(F.collect_list(F.struct("nth", "cands", "heads"))).alias("__slots"))
    names, none = F.array().cast("array<string>"), F.lit(None).cast("int")
    free = lambda offered, used: F.filter(offered, lambda t: ~F.exists(t["names"], lambda n: F.array_contains(used, n)))
    at = lambda slot, rank: F.get(slot["cands"], rank - 1)
    more = lambda have, new: F.when(new.isNull(), have).otherwise(F.concat(have, new))

    def fold(st: Column, slot: Column) -> Column:
        pick = F.get(free(slot["heads"], st["used"]), F.lit(0))
        return F.struct(more(st["used"], pick["names"]).alias("used"), F.concat(st["ranks"], F.array(pick["rank"])).alias("ranks"))

    def settle(st: Column, x: Column) -> Column:
        slot, pick = x["slot"], at(x["slot"], x["rank"])
        known = F.coalesce(F.array_contains(st["seen"], pick["md5"]), F.lit(False))
        others = F.filter(F.slice(free(slot["cands"], st["used"]), 1, tries), lambda t: ~F.coalesce(F.array_contains(st["seen"], t["md5"]), F.lit(False)))
        rank = F.when(x["rank"].isNull(), none).when(known, F.get(others, F.lit(0))["rank"]).otherwise(x["rank"])
        new = at(slot, rank)
        return F.struct(
            more(st["seen"], F.when(new["md5"].isNotNull(), F.array(new["md5"]))).alias("seen"), more(st["used"], new["names"]).alias("used"),
            F.concat(st["ranks"], F.array(rank)).alias("ranks"))

    ranks = F.array().cast("array<int>")
    chosen = slots.withColumn("__first", F.aggregate("__slots", F.struct(names.alias("used"), ranks.alias("ranks")), fold))
    start = F.struct(names.alias("seen"), F.col("__first.used").alias("used"), ranks.alias("ranks"))
    pairs = F.zip_with("__slots", "__first.ranks", lambda slot, rank: F.struct(slot.alias("slot"), rank.alias("rank")))
    settled = chosen.withColumn("__ranks", F.aggregate(pairs, start, settle, lambda st: st["ranks"]))
    took = F.zip_with("__slots", "__ranks", lambda slot, rank: at(slot, rank)["track_id"])
    once = cut_lineage(settled.select("__moods", took.alias("__took")))
    done = plans.join(once, "__moods").select(*keys, F.explode(F.arrays_zip(F.col("__moods").alias("mood"), F.col("__took").alias("track_id"))).alias("t"))
    return done.select(*keys, "t.mood", "t.track_id")


def attribution_list(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Credit text per group: every (track, artist) once, in plan order.

    plan: (keys, ord, mood, track, artist, url, obtained).
    """
    rows = plan.filter((F.coalesce("track", F.lit("")) != "") & F.col("obtained"))
    once = rows.groupBy(*keys, "track", "artist").agg(F.min_by("url", "ord").alias("url"), F.min("ord").alias("ord"))
    line = F.concat(
        F.lit("Music track: "), F.col("track"), F.lit(" by "), F.coalesce("artist", F.lit("Unknown")), F.lit("\nSource: "), F.coalesce("url", F.lit("")))
    return once.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("credits"))


# -- manifests, rules, sets -----------------------------------------------------


def asset_manifest(files: DataFrame, expected: Mapping[str, Sequence[str]], keys: Sequence[str], path: str = "path") -> DataFrame:
    """The file of each expected deliverable, null when missing.

    ``expected`` maps a label to path patterns in order of preference; within a
    pattern the smallest path wins.
    """
    rules = [(label, i, pattern) for label, patterns in expected.items() for i, pattern in enumerate(patterns)]
    hits = F.array_compact(F.array(*[
        F.when(F.col(path).rlike(p), F.struct(F.lit(label).alias("label"), F.lit(i).alias("i"))) for label, i, p in rules]))
    found = files.select(*keys, F.col(path).alias("path"), F.explode(hits).alias("h")).groupBy(*keys, F.col("h.label").alias("label")).agg(
        F.min(F.struct(F.col("h.i").alias("i"), "path")).alias("f"))
    wanted = files.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in expected])).alias("label"))
    return wanted.join(found, [*keys, "label"], "left").select(*keys, "label", F.col("f.path").alias("path"))


def _faults(*rules: tuple[Column, str, str]) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind).alias("type"), F.lit(sev).alias("severity"))) for cond, kind, sev in rules]))


def short_checks(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F8 for short videos: one row per broken rule, all rules in one pass.

    metrics: (keys, w, h, dur, lufs, peak, bar_hits, luma, frac, sharp, silent_tail).
    """
    c = F.col
    ratio = F.abs(c("w") / F.when(c("h") != 0, c("h")) - 9 / 16)
    bad_first = (c("luma") < 12) | (c("frac") < 0.04)
    rules = _faults(
        (ratio > 0.01, "bad_aspect", "high"),
        ((c("h") < 1920) | (c("w") < 1080), "low_resolution", "high"),
        (c("dur") < 15, "too_short", "medium"),
        (c("dur") > 80, "too_long", "medium"),
        ((c("dur") <= 80) & (c("dur") > 60), "over_sweet_spot", "low"),
        (F.abs(c("lufs") + 14) > 1.5, "loudness", "medium"),
        (c("peak") > -1, "true_peak", "medium"),
        (c("bar_hits") >= 3, "letterbox", "high"),
        (bad_first, "bad_first_frame", "high"),
        (~bad_first & (c("sharp") < 1.0), "blurry_first_frame", "medium"),
        (c("silent_tail"), "dead_ending", "medium"),
    )
    broken = F.coalesce(c("w"), F.lit(0)) * F.coalesce(c("h"), F.lit(0)) == 0
    found = F.when(broken, _faults((F.lit(True), "unreadable_file", "high"))).otherwise(rules)
    return metrics.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def thumb_checks(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F8 for thumbnails. metrics: (keys, readable, w, h, bytes, format, sharp, palette, contrast)."""
    c = F.col
    rules = _faults(
        ((c("w") < 1280) | (c("h") < 720), "low_resolution", "high"),
        (F.abs(c("w") / c("h") - 16 / 9) > 0.02, "bad_aspect", "high"),
        (c("bytes") > 2 * 1024 * 1024, "file_too_big", "high"),
        (~c("format").isin("JPEG", "PNG"), "bad_format", "high"),
        (c("sharp") < 2.0, "soft_image", "medium"),
        (c("palette") > 0.85, "ui_palette", "low"),
        (c("contrast") < 28, "low_contrast", "low"),
    )
    found = F.when(~c("readable"), _faults((F.lit(True), "unreadable_file", "high"))).otherwise(rules)
    return metrics.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def distinct_in_order(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """U4: each value once, at its first position."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias(order))


def content_dedup(rows: DataFrame, keys: Sequence[str], content: str, order: str) -> DataFrame:
    """Of rows with equal content the earliest, found by hash with a partial minimum.

    Only the hash, the order and the row travel; a mass of copies folds map-side.
    """
    keys = list(keys)
    first = rows.groupBy(*keys, F.md5(content).alias("__h")).agg(F.min(order).alias(order))
    return rows.withColumn("__h", F.md5(content)).join(first, [*keys, "__h", order], "left_semi").drop("__h")
