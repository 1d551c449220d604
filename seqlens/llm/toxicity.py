"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows are split by a hash of their id: one part finds a lexicon (words and word
beginnings that are far more frequent in toxic texts), one fits the trees, one fits the
calibration. No part sees what another one fitted on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage

#: Second person in four languages.
SECOND_PERSON = frozenset((
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "tu", "te", "toi", "ton",
    "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros",
))
_PLAIN = str.maketrans("013457@$!|", "oieastasil")
_HIDERS = str.maketrans("", "", "*._-~'’")
_PUNCTUATION = frozenset("!?.,;:\"'()[]{}<>*#$%&|@_-/\\~^+=")


@dataclass(frozen=True)
class Toxic:
    """most_rows: labelled rows that the fit reads at most, chosen by hash. folds, held_out: rows whose crc32(doc_id) mod
    folds is held_out are never learnt from. support, odds: of a lexicon term. near: words between a term and a second person."""

    most_rows: int = 20_000
    folds: int = 5
    held_out: int = 0
    support: int = 4
    odds: float = 2.5
    most_terms: int = 5_000
    near: int = 5
    trees: int = 20
    depth: int = 3
    seed: int = 42


FEATURES = (
    "term density", "weight density", "highest weight", "distinct weights", "terms near a second person", "second person rate",
    "capitals rate", "capital words rate", "punctuation rate", "exclamation rate", "obfuscation rate", "obfuscated terms rate",
)


def bare(word: str) -> str:
    return word.strip("!?.,;:\"'()[]{}<>*#$%&|«»¿¡").lower()


def plain(word: str) -> str:
    """A word without the digits and signs that hide letters."""
    return word.translate(_HIDERS).translate(_PLAIN)


def terms_of(word: str) -> list[str]:
    """The word and its beginnings of four to six letters, which carry an ending mark."""
    form = plain(bare(word))
    return [form, *(form[:n] + "-" for n in (4, 5, 6) if len(form) > n)] if form else []


def hidden(word: str) -> bool:
    """Letters with digits or signs between them."""
    inner = bare(word)
    return len(inner) > 2 and inner[0].isalpha() and any(c.isdigit() or c in "*@$!_|" for c in inner[1:-1]) and "@" != inner[0]


class Measure(dict):
    """Word to the number of its row in ``table``; rows are few, words are many."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.known, self.table = lexicon, {}, np.zeros((1024, 10))

    def __missing__(self, word: str) -> int:
        plainly = word.islower() and word.isalpha()  # nothing to strip, to count or to uncover
        core = word if plainly else bare(word)
        get, form = self.lexicon.get, core if plainly else plain(core)
        weight = max(get(form, 0.0), *(get(form[:n] + "-", 0.0) for n in (4, 5, 6) if len(form) > n), 0.0)
        weight = round(weight, 1)
        hide = not plainly and hidden(word)
        row = (
            weight, float(weight > 0), float(core in SECOND_PERSON), 0.0 if plainly else float(sum(map(str.isupper, word))),
            float(not plainly and len(word) > 1 and word.isupper()), 0.0 if plainly else float(sum(c in _PUNCTUATION for c in word)),
            float(word.count("!")), float(hide), float(hide and weight > 0), float(len(word)))
        at = self.known.get(row)
        if at is None:
            at = self.known[row] = len(self.known)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = row
        if len(self) >= 150_000:  # only a memory of what was worked out before
            self.clear()
        self[word] = at
        return at


def features_of(text: str, measure: Measure, near: int) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    at = np.fromiter(map(measure.__getitem__, words), np.int64, len(words))
    p = measure.table[at]
    n, sums = len(words), p.sum(axis=0)
    chars = max(1.0, sums[9])
    hits, second = np.flatnonzero(p[:, 1]), np.flatnonzero(p[:, 2])
    close = 0
    if len(hits) and len(second):
        right = np.searchsorted(second, hits)
        gap = np.minimum(
            np.abs(second[np.minimum(right, len(second) - 1)] - hits), np.abs(second[np.maximum(right - 1, 0)] - hits))
        close = int((gap <= near).sum())
    return [
        100 * sums[1] / n, 100 * sums[0] / n, float(p[:, 0].max()), float(len(set(p[hits, 0].tolist()))), 100 * close / n,
        100 * sums[2] / n, sums[3] / chars, sums[4] / n, sums[5] / chars, sums[6] / n, sums[7] / n, log1p(sums[8])]


def with_features(rows: DataFrame, lexicon: dict[str, float], toxic: Toxic) -> DataFrame:
    """``rows`` (whose last column is the text) with the dense features instead of the text. A null text counts as empty."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(lexicon)
        for batch in batches:
            found = [features_of(t.as_py() or "", measure, toxic.near) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*kept, "dense"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{schema}, dense array<double>")


def fold(toxic: Toxic, doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % toxic.folds


def sampled_labels(labels: DataFrame, toxic: Toxic) -> DataFrame:
    """doc_id, toxic, part (0: lexicon, 1: trees, 2: calibration) of at most about ``most_rows`` rows that may be learnt from.

    Several labels of one id count as their largest; null ids and labels are left out.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(toxic) != toxic.held_out))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    n = usable.count()
    share = min(1.0, toxic.most_rows / max(1, n))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(toxic.seed)), F.lit(1_000_000))
    part = F.pmod(F.xxhash64("doc_id", F.lit(toxic.seed + 1)), F.lit(10))
    return cut_lineage(usable.filter(spread < int(share * 1_000_000)).withColumn(
        "part", F.when(part < 5, 0).when(part < 8, 1).otherwise(2)))


def learnt_lexicon(train: DataFrame, toxic: Toxic) -> dict[str, float]:
    """Terms of the lexicon's part with the log odds of their documents being toxic.

    train: text, toxic. Counts are made per task and summed; what comes to the driver are
    the terms of ``support`` or more toxic documents of the bounded sample.
    """
    rows = train.select("text", "toxic")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1):
        return {}

    def count(wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for text in batch.column(0):
                    terms = {t for w in set((text.as_py() or "").split()) for t in terms_of(w)}
                    seen.update(terms if wanted is None else terms & wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        return run

    def counted(label: int, wanted: frozenset[str] | None) -> dict[str, int]:
        found = rows.filter(F.col("toxic") == label).select("text").mapInArrow(count(wanted), "term string, n long")
        summed = found.groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in summed.filter(F.col("n") >= (toxic.support if label else 1)).collect()}

    bad = counted(1, None)
    good = counted(0, frozenset(bad)) if totals.get(0) else {}
    odds = {
        t: log((n + 0.5) / (totals[1] + 1)) - log((good.get(t, 0) + 0.5) / (totals.get(0, 0) + 1)) for t, n in bad.items()}
    kept = sorted((t for t in odds if odds[t] >= toxic.odds), key=lambda t: (-odds[t], t))[:toxic.most_terms]
    return {t: odds[t] for t in kept}


def scored(docs: DataFrame, labels: DataFrame, toxic: Toxic = Toxic()) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    labels: doc_id, toxic (0 or 1). Null and empty texts get a score too; a null id is held
    out; rows with equal ids or texts are scored alike by their text alone; if the labels
    have one class or none, the score is that class's share (0 without labels). Other
    columns go through; an empty table gives no rows.
    """
    sample = sampled_labels(labels, toxic)
    held = fold(toxic) == toxic.held_out
    # at most about most_rows rows, so they are sent to the documents
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    lexicon = learnt_lexicon(train.filter("part = 0"), toxic)
    fit = cut_lineage(with_features(train.filter("part > 0").select("toxic", "part", "text"), lexicon, toxic).select(
        F.col("toxic").cast("double").alias("label"), "part", array_to_vector("dense").alias("features")))
    classes = {(r["part"], r["label"]): r["n"] for r in fit.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (classes.get((1, 0.0)) and classes.get((1, 1.0))):
        bad = sum(n for (_, y), n in classes.items() if y)
        share = bad / max(1, sum(classes.values()))
        return docs.withColumns({
            "held_out": held, "score": F.lit(float(share)), "predicted": F.lit(int(share >= 0.5))})
    trees = GBTClassifier(maxIter=toxic.trees, maxDepth=toxic.depth, stepSize=0.3, seed=toxic.seed).fit(fit.filter("part = 1"))
    chance = vector_to_array("probability")[1]
    level = None
    if classes.get((2, 0.0)) and classes.get((2, 1.0)):
        level = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="level").fit(
            trees.transform(fit.filter("part = 2")).select("label", chance.alias("chance")))
    # the document's own columns travel in one struct, so their names cannot clash with the models'
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), held.alias("held"), "text")
    judged = trees.transform(with_features(whole, lexicon, toxic).withColumn("features", array_to_vector("dense")))
    judged = judged.select("row", "held", chance.alias("chance"))
    judged = judged.withColumn("level", F.col("chance")) if level is None else level.transform(judged)
    # the calibrated level has steps; a trace of the trees' own score keeps their order within a step
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.998 * F.col("level") + 0.002 * F.col("chance")))
    return judged.select("row", "held", score.alias("score")).select("row.*", F.struct("held", "score").alias("__found")).withColumns({
        "held_out": F.col("__found.held"), "score": F.col("__found.score"),
        "predicted": (F.col("__found.score") >= 0.5).cast("int")}).drop("__found")
