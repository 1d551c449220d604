"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A sketch has three sub-tables of cells; a digest falls into one cell of each and adds to
its count, its xor of digests and its xor of check hashes. Subtracting the sketches of
two versions cancels what they share. Peeling takes the cells left with one digest,
notes it, and removes it from its other cells, sub-table after sub-table, so a digest is
never noted twice in one step. The printed fingerprints are subtracted first; what they
do not settle gets a sketch of its size, and what that does not empty four times the cells.

All of it is DataFrame operations. Texts are shuffled once, by document; the exploded
cells stay in the partition of their document through every step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage, text_of

LEAST_ID = -(1 << 63)


@dataclass(frozen=True)
class Sketch:
    """base_cells, base_steps: per sub-table of the printed fingerprint, and steps of peeling it. cells, share: least cells per
    sub-table of a larger sketch, and cells per paragraph of both versions (half as many for the edited text, of which two
    thirds are shared). growth: of a retry. steps: of peeling. spread: partitions of texts against
    those of a shuffle, as the cells of a text take several times its memory. long, run: a longer paragraph is cut to runs of so many words."""

    base_cells: int = 4
    base_steps: int = 6
    cells: int = 32
    share: float = 2 / 3
    growth: int = 4
    steps: int = 15
    long: int = 200
    spread: int = 4
    run: int = 12


def paragraphs(text: Column, sketch: Sketch) -> Column:
    """Lines, cut after sentence ends; long ones without such an end are cut to runs of words."""
    parts = F.split(text, r"\n+|(?<=[.!?])\s+")
    runs = F.lit(r"(?:\S+\s*){1,%d}" % sketch.run)
    cut = F.transform(parts, lambda p: F.when(
        F.length(p) > sketch.long, F.regexp_extract_all(p, runs, F.lit(0))).otherwise(F.array(p)))
    return F.filter(F.flatten(cut), lambda p: p != "")


def digests(text: Column, sketch: Sketch) -> Column:
    """The distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(paragraphs(text, sketch), lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def cell_of(digest: Column, sub: int | Column, cells: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(sub) if isinstance(sub, int) else sub), cells).cast("int")


def base_cells(digests_: Column, sketch: Sketch) -> Column:
    """The base sketch: per cell, sub-table after sub-table, its count ``n``, xor of digests ``key`` and xor of checks ``chk``."""
    zero = F.lit(0).cast("bigint")

    def cell(sub: int, at: int) -> Column:
        inside = F.filter(digests_, lambda d: cell_of(d, sub, F.lit(sketch.base_cells)) == at)
        return F.struct(
            F.size(inside).alias("n"), F.aggregate(inside, zero, lambda a, d: a.bitwiseXOR(d)).alias("key"),
            F.aggregate(inside, zero, lambda a, d: a.bitwiseXOR(check(d))).alias("chk"))

    return F.array(*[cell(sub, at) for sub in range(3) for at in range(sketch.base_cells)])


def printed(cells: Column) -> Column:
    """A base sketch as text: the cells' numbers in hex."""
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(
        F.lpad(F.hex(c.n), 8, "0"), F.lpad(F.hex(c.key), 16, "0"), F.lpad(F.hex(c.chk), 16, "0"))), ""))


def without(cell: Column, other: Column) -> Column:
    """One cell less another."""
    return F.struct(
        (cell.n - other.n).alias("n"), cell.key.bitwiseXOR(other.key).alias("key"), cell.chk.bitwiseXOR(other.chk).alias("chk"))


def settled(cells: Column, other: Column, sketch: Sketch) -> Column:
    """Number of differing digests of two base sketches: subtracted and peeled, null if they do not empty."""
    base = sketch.base_cells
    sub_of = lambda i: F.floor(i / base).cast("int")

    def peel(state: Column, step: Column) -> Column:
        taken = F.filter(state.cells, lambda c, i: (
            (sub_of(i) == step % 3) & (F.abs(c.n) == 1) & (c.chk == check(c.key))
            & (cell_of(c.key, step % 3, F.lit(base)) == i % base)))
        left = F.transform(state.cells, lambda c, i: F.aggregate(
            F.filter(taken, lambda t: cell_of(t.key, sub_of(i), F.lit(base)) == i % base), c, without))
        return F.struct(left.alias("cells"), (state.noted + F.size(taken)).alias("noted"))

    start = F.struct(F.zip_with(cells, other, without).alias("cells"), F.lit(0).alias("noted"))
    empty = lambda c: (c.n == 0) & (c.key == 0) & (c.chk == 0)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(sketch.base_steps - 1)), start, peel,
        lambda end: F.when(F.forall(end.cells, empty), end.noted))


def previous_ids(ids: DataFrame) -> DataFrame:
    """(k, before) for distinct ids ``k``: the largest smaller id, null for the smallest.

    Ids are ordered in blocks of 1024 neighbouring values; the block before is found in
    the same way among the blocks, until few enough are left for one task.
    """

    def step(level: DataFrame) -> DataFrame:
        if level.count() <= 20_000:
            return level.select("k", F.lag("top").over(Window.orderBy("k")).alias("before"))
        block = F.shiftright("k", 10)
        inside = level.withColumn("block", block).withColumn(
            "inner", F.lag("top").over(Window.partitionBy("block").orderBy("k")))
        blocks = cut_lineage(level.groupBy(block.alias("k")).agg(F.max("top").alias("top")))
        return inside.join(step(blocks).select(F.col("k").alias("block"), "before"), "block").select(
            "k", F.coalesce("inner", "before").alias("before"))

    return step(ids.select("k", F.col("k").alias("top")))


def neighbours(docs: DataFrame) -> DataFrame:
    """(k, next_k, need, rows, next_h): the next id in descending order, after the last the first; how many of the next text's
    code points are needed, how many rows the id has, and which of the rows of the next id stands for it."""
    ids = cut_lineage(docs.groupBy("k").agg(
        F.max(F.floor(F.length("text") / 3)).cast("int").alias("need"), F.min(F.xxhash64("text")).alias("h"),
        F.count(F.lit(1)).alias("rows")))
    top = ids.agg(F.max("k")).first()[0]
    order = previous_ids(ids.select("k")).select("k", F.coalesce("before", F.lit(top)).alias("next_k"))
    return cut_lineage(ids.join(order, "k").select("k", "need", "rows", "next_k").join(
        ids.select(F.col("k").alias("next_k"), F.col("h").alias("next_h")), "next_k"))


def edited_versions(docs: DataFrame, chain: DataFrame, sketch: Sketch) -> DataFrame:
    """k, h, copies, n_chars, edited and the digests of the text, the edited text and the next one, for the ids of ``chain``.

    docs: k, text. Rows of one id with the same text become one row with its number of copies.
    """
    unique = docs.withColumn("h", F.xxhash64("text"))
    if chain.filter("rows > 1").isEmpty():
        # everything is dealt by k alone from here on (hence the hints), so only the senders' short pieces are shuffled again
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        unique = unique.repartition(partitions * sketch.spread, "k").withColumn("copies", F.lit(1).cast("bigint"))
    else:
        # rows of one id are dealt by their texts first; what then meets the id's one sender is a join that splits skewed ids
        unique = unique.groupBy("k", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    sent = (
        unique.select("k", "h", "text", "copies")
        .join(chain.select(F.col("next_k").alias("k"), "next_h", "need", F.col("k").alias("to")).hint("merge"), "k")
        .filter(F.col("h").bitwiseXOR(F.col("next_h")) == 0)
        .select(F.col("to").alias("k"), F.expr("left(text, need)").alias("tail"), digests(F.col("text"), sketch).alias("next"))
    )
    third = F.floor(F.col("n_chars") / 3).cast("int")
    return (
        unique.join(sent.hint("merge"), "k").withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("third", third)
        .withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - third), left(tail, third))"))
        .withColumn("own", digests(F.col("text"), sketch)).withColumn("changed", digests(F.col("edited"), sketch))
        .select("k", "h", "copies", "n_chars", "edited", "own", "changed", "next")
    )


def differences(versions: DataFrame, sketch: Sketch, times: int) -> DataFrame:
    """k, h, pair, differing (null if the sketch did not empty). pair 0: edited text, 1: next document.

    versions: k, h and the digests own, changed, next, dealt by k. The printed fingerprints
    are subtracted first; only pairs that they do not settle get a sketch of their own size.
    times: cells against the first attempt.

    A cell is one row under its ``slot``: pair, sub-table, binary logarithm of the cells and
    place, packed. Sub-table 3 has one cell, the number of digests noted so far.
    """

    def power(other: str, share: float) -> Column:
        wanted = F.greatest(F.lit(float(sketch.cells)), (F.size("own") + F.size(other)) * F.lit(share))
        return F.ceil(F.log2(wanted * times)).cast("bigint")

    def slot(pair: Column, sub: int, log2: Column, at: Column) -> Column:
        return F.shiftleft(pair * 4 + sub, 40) + F.shiftleft(log2, 32) + at

    cells = lambda log2: F.pow(F.lit(2.0), log2).cast("bigint")
    place = lambda key, sub, log2: F.pmod(F.xxhash64(key, F.lit(sub)), cells(log2))
    entry = lambda pair, sign: lambda d: F.struct(
        F.lit(pair).cast("bigint").alias("pair"), F.lit(sign).alias("sign"), d.alias("key"))

    def side(pair: int, other: str) -> Column:
        base = F.col(f"base{pair}")
        start = F.struct(F.lit(pair).cast("bigint").alias("pair"), F.coalesce(base, F.lit(0)).alias("sign"), F.lit(None).cast("bigint").alias("key"))
        open_ = F.concat(F.transform("own", entry(pair, 1)), F.transform(other, entry(pair, -1)))
        return F.concat(F.array(start), F.when(base.isNull(), open_).otherwise(F.slice(open_, 1, 0)))

    first = [base_cells(F.col(c), sketch) for c in ("own", "changed", "next")]
    known = versions.select("k", "h", "own", "changed", "next", F.array(*first).alias("p")).select(
        "k", "h", "own", "changed", "next",
        *[settled(F.col("p")[0], F.col("p")[i + 1], sketch).alias(f"base{i}") for i in (0, 1)])
    rows = known.select(
        "k", "h", power("changed", sketch.share / 2).alias("c0"), power("next", sketch.share).alias("c1"),
        F.explode(F.concat(side(0, "changed"), side(1, "next"))).alias("e"),
    ).select("k", "h", "e.*", F.when(F.col("e.pair") == 0, F.col("c0")).otherwise(F.col("c1")).alias("log2"))
    cell = lambda slot_, n, key, chk: F.struct(
        slot_.alias("slot"), n.cast("int").alias("n"), key.alias("key"), chk.alias("chk"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1)
    key, pair, log2 = F.col("key"), F.col("pair"), F.col("log2")
    state = rows.select("k", "h", F.explode(F.when(
        key.isNull(), F.array(cell(slot(pair, 3, zero, zero), F.col("sign"), zero, zero)),
    ).otherwise(F.array(*[
        cell(slot(pair, s, log2, place(key, s, log2)), F.col("sign"), key, check(key)) for s in range(3)]))).alias("c")).select(
        "k", "h", "c.*")
    pair = F.shiftright("slot", 42)
    sub = F.shiftright("slot", 40).bitwiseAND(F.lit(3).cast("bigint"))
    log2 = F.shiftright("slot", 32).bitwiseAND(F.lit(255).cast("bigint"))
    at = F.col("slot").bitwiseAND(F.lit((1 << 32) - 1))

    def folded(df: DataFrame) -> DataFrame:
        return (
            df.groupBy("k", "h", "slot")
            .agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
            .filter((sub == 3) | (F.col("n") != 0) | (key != 0) | (F.col("chk") != 0))
        )

    state = folded(state)
    for step in range(sketch.steps):
        now = step % 3
        pure = (sub == now) & (F.abs("n") == 1) & (F.col("chk") == check(key)) & (at == place(key, now, log2))
        taken = [cell(slot(pair, s, log2, place(key, s, log2)), -F.col("n"), key, F.col("chk")) for s in range(3) if s != now]
        same = F.struct("slot", "n", "key", "chk")
        state = folded(state.select("k", "h", F.explode(F.when(
            pure, F.array(cell(slot(pair, 3, zero, zero), one, zero, zero), *taken),
        ).otherwise(F.array(same))).alias("c")).select("k", "h", "c.*"))
    return state.groupBy("k", "h", pair.cast("int").alias("pair")).agg(
        F.sum(F.when(sub == 3, F.col("n"))).alias("noted"),
        F.count(F.when(sub < 3, 1)).alias("left"),
    ).select("k", "h", "pair", F.when(F.col("left") == 0, F.col("noted")).alias("differing"))


def likeness(own: Column, other: Column, differing: Column) -> Column:
    """Shared paragraphs against all paragraphs of both; two texts without any are alike."""
    return F.when(own + other == 0, F.lit(1.0)).otherwise((own + other - differing) / (own + other + differing).cast("double"))


def fingerprint_edits(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is the text whose last third (floor of code points / 3) is replaced by
    as many first code points of the next document, in descending order of doc_id, after
    the last the first. Null texts count as empty; a null id counts as the smallest; rows
    with equal ids have the same next document, of whose rows the one with the least hash
    stands for it. A text is the set of its distinct paragraphs; texts without any are
    alike (1.0). Other columns are ignored; an empty table gives no rows.
    """
    kept = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST_ID)).alias("k"), text_of().alias("text"))
    chain = neighbours(kept)
    found, times = None, 1
    todo = chain
    while True:
        versions = edited_versions(kept if found is None else _needed(kept, todo), todo, sketch)
        apart = differences(versions.select("k", "h", "own", "changed", "next"), sketch, times)
        by_pair = apart.groupBy(F.col("k").alias("k2"), F.col("h").alias("h2")).agg(
            F.max(F.when(F.col("pair") == 0, F.col("differing"))).alias("d0"),
            F.max(F.when(F.col("pair") == 1, F.col("differing"))).alias("d1"))
        facts = versions.select(
            "k", "h", "copies", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
            F.unhex(printed(base_cells(F.col("own"), sketch))).alias("print"),
            F.unhex(printed(base_cells(F.col("changed"), sketch))).alias("print2"),
            F.size("own").alias("n_own"), F.size("changed").alias("n_changed"), F.size("next").alias("n_next"))
        got = cut_lineage(facts.join(
            by_pair, (F.col("k") == F.col("k2")) & (F.col("h").bitwiseXOR(F.col("h2")) == 0)).drop("k2", "h2"))
        open_ = F.col("d0").isNull() | F.col("d1").isNull()
        done = got.filter(~open_)
        found = done if found is None else found.unionByName(done)
        left = cut_lineage(got.filter(open_).select("k").distinct())
        if left.isEmpty():
            break
        # only what is still open is looked at again, with more cells
        found = found.join(left, "k", "left_anti")
        todo = cut_lineage(todo.join(left, "k"))
        times *= sketch.growth
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.when(F.col("k") != LEAST_ID, F.col("k")).alias("doc_id"), "n_chars", text("sha").alias("edited_sha256"),
        text("print").alias("fingerprint"), text("print2").alias("edited_fingerprint"),
        likeness(F.col("n_own"), F.col("n_changed"), F.col("d0")).alias("near_edited"),
        likeness(F.col("n_own"), F.col("n_next"), F.col("d1")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def _needed(docs: DataFrame, chain: DataFrame) -> DataFrame:
    """The rows of the ids in ``chain`` and of their next ids."""
    ids = chain.select("k").unionByName(chain.select(F.col("next_k").alias("k"))).distinct()
    return docs.join(ids, "k", "left_semi")
