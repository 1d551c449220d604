"""Quality rules whose cutoffs are chosen under a limit on false rejection.

Every rule has a fixed ladder of cutoffs from lenient to strict. For each stratum
(language) and rule the good documents of a labelled holdout beyond a cutoff are
counted. An exact binomial test says whether the rule would reject fewer than its share
of good documents; the ladder is climbed while it does (a fixed sequence needs no
correction of its own), and the level of a test is divided among strata and rules.
With chance ``1 - delta`` every stratum then loses at most ``alpha`` of its good documents
to the chosen rules together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import cut_lineage, small
from seqlens.llm.measures import measured


@dataclass(frozen=True)
class Risk:
    """alpha: good documents of a stratum that may be rejected. delta: chance to exceed it anywhere. folds, tested:
    labelled rows whose crc32(doc_id) mod folds is tested stay out of the choice."""

    alpha: float = 0.05
    delta: float = 0.05
    folds: int = 5
    tested: int = 0
    least_words: int = 50
    repeat_share: int = 50


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """What each rule measures and its ladder of cutoffs; a document is rejected above the cutoff."""
    return {
        "symbols per word": (_share("n_symbols", "n_words"), (3.0, 2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
        "capitals share": (_share("n_upper", "word_chars"), (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
        "exclamations per word": (_share("n_exclaim", "n_words"), (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05)),
        "repeated words share": (_share("n_repeat_words", "n_words"), (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
        "repeated lines share": (_share("n_dup_lines", "n_lines"), (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
        "word length": (_share("word_chars", "n_words"), (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of chance p, exact but for rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k, dtype=np.float64)
    steps = np.log((n - i) / (i + 1)) + np.log(p) - np.log1p(-p)
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def chosen_cutoffs(holdout: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """lang, cutoffs (map of rule to cutoff): what each stratum's rules may use; a rule without a safe cutoff is missing.

    holdout: lang and the measures of good documents. lang null is a stratum of its own.
    """
    named = rules()
    counted = holdout.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum((value > cut).cast("bigint")).alias(f"c{r}_{i}")
        for r, (value, ladder) in enumerate(named.values()) for i, cut in enumerate(ladder)])
    counted = cut_lineage(counted)
    tests = max(1, counted.count()) * len(named)
    level, share = risk.delta / tests, risk.alpha / len(named)

    @F.pandas_udf("double")
    def p_value(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_cdf(int(a), int(b), share) if b * share >= a else 1.0 for a, b in zip(k, n, strict=True)])

    ladder = counted.select("lang", "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cutoff"), F.col(f"c{r}_{i}").alias("k"))
        for r, (name, (_, cuts)) in enumerate(named.items()) for i, cut in enumerate(cuts)])).alias("t")).select("lang", "n", "t.*")
    so_far = Window.partitionBy("lang", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    safe = (
        ladder.withColumn("safe", (p_value("k", "n") <= level).cast("int"))
        .withColumn("climbed", F.min("safe").over(so_far)).filter("climbed = 1")
        .groupBy("lang", "rule").agg(F.max_by("cutoff", "step").alias("cutoff"))
    )
    return safe.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judged(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules per document.

    labels: doc_id, quality (1 good). Null texts have no words and fail the base rule; null
    ids have no label; several labels of one id count as their least; rows with equal ids
    stay separate rows; other columns are ignored; without labels only the base rule
    rejects; an empty table gives no rows.
    """
    stats = cut_lineage(measured(docs, ["doc_id", "lang"]))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % risk.folds
    good = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id"))
    holdout = stats.filter(fold != risk.tested).join(good, "doc_id", "left_semi")
    base = (F.col("n_words") < risk.least_words) | (100 * F.col("n_repeat_words") > risk.repeat_share * F.col("n_words"))
    cutoffs = cut_lineage(chosen_cutoffs(holdout.filter(~base), risk))
    n = cutoffs.count()
    cutoffs = cutoffs.select(F.col("lang").alias("__lang"), "cutoffs")
    failed = F.filter(F.array(*[
        F.when(value > F.col("cutoffs")[name], F.lit(name)) for name, (value, _) in rules().items()]), lambda x: x.isNotNull())
    return (
        stats.join(small(cutoffs, n, 10_000), F.col("lang").eqNullSafe(F.col("__lang")), "left")
        .withColumn("base_failed", base).withColumn("failed_rules", F.coalesce(failed, F.array().cast("array<string>")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
    )
