"""Quality scores from weak labels.

Overlapping heuristic labellers vote good, bad or nothing. Expectation-maximisation over the
counts of vote patterns (at most three to the power of the labellers) estimates how
often each is right about good texts and about each fault. The posterior labels of a bounded sample of documents train a linear scorer over
hashed features, which then scores every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage
from seqlens.llm.measures import measured

GOOD, BAD, NOTHING = 1, 0, 2


@dataclass(frozen=True)
class Weak:
    """most_rows: documents the scorer is trained on at most, chosen by hash. bits: of the hashed feature space."""

    most_rows: int = 12_000
    bits: int = 13
    rounds: int = 60
    iterations: int = 25
    penalty: float = 0.001
    seed: int = 42


def labellers() -> dict[str, Column]:
    """Votes from the measures of a text."""

    def vote(value: Column, good: float, bad: float) -> Column:
        low = value <= good if good < bad else value >= good
        high = value >= bad if good < bad else value <= bad
        return F.when(high, BAD).when(low, GOOD).otherwise(NOTHING)

    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": vote(per("n_symbols", "n_words"), 0.02, 0.2),
        "capitals": vote(per("n_upper", "word_chars"), 0.08, 0.3),
        "exclamations": vote(per("n_exclaim", "n_words"), 0.02, 0.2),
        "repeats": vote(per("n_repeat_words", "n_words"), 0.05, 0.3),
        "lines": vote(per("n_dup_lines", "n_lines"), 0.02, 0.3),
        "variety": vote(per("n_distinct", "n_words"), 0.35, 0.12),
        "length": vote(F.col("n_words").cast("double"), 20, 2),
    }


def settle(patterns: list[tuple[tuple[int, ...], int]], rounds: int) -> dict[tuple[int, ...], float]:
    """Posterior chance of good for each vote pattern, by expectation-maximisation over counted patterns.

    Each labeller looks at another fault, so a text is good or has one labeller's fault in
    the main: one hidden class for good and one per labeller. For every class and labeller the chance of
    each vote is estimated; a labeller that also calls good texts bad loses weight by it.
    """
    votes = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), -1)
    n = np.array([c for _, c in patterns], np.float64)
    faults = (votes == BAD).astype(np.float64)
    belief = np.concatenate([faults.sum(axis=1, keepdims=True) == 0, faults], axis=1) + 0.02
    belief /= belief.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = belief * n[:, None]
        logs = np.tile(np.log((weight.sum(axis=0) + 1) / (n.sum() + belief.shape[1])), (len(n), 1))
        for j in range(votes.shape[1]):
            chance = np.stack([weight[votes[:, j] == v].sum(axis=0) for v in (BAD, GOOD)]) + 0.1
            voted = votes[:, j] != NOTHING  # no vote tells nothing
            logs[voted] += np.log(chance / chance.sum(axis=0))[votes[voted, j]]
        belief = np.exp(logs - logs.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
    return {p: float(b) for (p, _), b in zip(patterns, belief[:, 0], strict=True)}


def shape(word: bytes) -> str:
    """Classes of a word's characters, runs folded: Aa for Word, A! for LOUD!!"""
    out = ""
    for c in word.decode(errors="replace"):
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(k):
            out += k
    return out[:8]


class Hashed(dict):
    """Word to its feature numbers: the word itself and its shape."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= 150_000:  # only a memory of what was worked out before
            self.clear()
        found = self[word] = (zlib.crc32(b"w" + word) & self.mask, zlib.crc32(b"s" + shape(word).encode()) & self.mask)
        return found


def hashed_features(text: str, memory: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values): square roots of shares of words, shapes and repeated neighbours."""
    words = text.encode().split()
    if not words:
        return np.array([0]), np.array([1.0])
    pairs = np.array([memory[w] for w in words], np.int64)
    counts = np.bincount(pairs.ravel(), minlength=memory.mask + 1).astype(np.float64)
    counts[zlib.crc32(b"same") & memory.mask] += sum(a == b for a, b in pairwise(words))
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / len(words))


def scored(docs: DataFrame, weak: Weak = Weak()) -> DataFrame:
    """doc_id, score (0 to 1, chance of good) and kept (score >= 0.5) of every document.

    A null text counts as empty; an empty text has one feature of its own. Rows with equal ids stay separate rows and are scored
    by their text; other columns are ignored; an empty table gives no rows. If all weak labels
    agree, the score is the posterior itself.
    """
    voters = labellers()
    ballot = F.concat(*[v.cast("string") for v in voters.values()])
    stats = cut_lineage(measured(docs, ["doc_id"]).select("doc_id", ballot.alias("votes")))
    # at most three to the power of the labellers
    counted = [(tuple(map(int, r["votes"])), r["n"]) for r in stats.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()]
    believed = settle(counted, weak.rounds) if counted else {}
    n = sum(c for _, c in counted)
    posterior = F.create_map(*[F.lit(x) for p, b in believed.items() for x in ("".join(map(str, p)), b)])
    return _trained(docs, stats, posterior, n, weak) if believed else stats.select(
        "doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("kept"))


def _trained(docs: DataFrame, stats: DataFrame, posterior: Column, n: int, weak: Weak) -> DataFrame:
    voters = labellers()
    share = int(min(1.0, weak.most_rows / n) * 1_000_000)
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(weak.seed)), F.lit(1_000_000)) < share
    width = 1 << weak.bits

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Hashed(weak.bits)
        for batch in batches:
            found = [hashed_features(t.as_py() or "", memory) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(1, batch.num_columns)]
                + [pa.array([x.tolist() for x, _ in found], pa.list_(pa.int32())), pa.array([y.tolist() for _, y in found], pa.list_(pa.float64()))],
                ["votes", "at", "value"])

    ballot = F.concat(*[v.cast("string") for v in voters.values()])
    sample = measured(docs.filter(chosen).select("doc_id", "text", F.col("text").alias("body")), ["doc_id", "body"])
    rows = sample.select("body", ballot.alias("votes")).mapInArrow(features, "votes string, at array<int>, value array<double>")
    vector = F.udf(lambda at, value: SparseVector(width, at, value), VectorUDT())
    train = cut_lineage(rows.select(posterior[F.col("votes")].alias("p"), vector("at", "value").alias("features")))
    both = train.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("t")).select("features", "t.*").filter("weight > 0.001")
    labels = {r["label"] for r in both.select("label").distinct().collect()}
    if len(labels) < 2:
        return stats.select("doc_id", posterior[F.col("votes")].alias("score")).withColumn("kept", F.col("score") >= 0.5)
    fitted = LogisticRegression(
        maxIter=weak.iterations, regParam=weak.penalty, weightCol="weight", standardization=False).fit(both)
    weights, offset = fitted.coefficients.toArray(), float(fitted.intercept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Hashed(weak.bits)
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(1)):
                at, value = hashed_features(t.as_py() or "", memory)
                scores[i] = 1 / (1 + np.exp(-np.clip(weights[at] @ value + offset, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").withColumn("kept", F.col("score") >= 0.5)
