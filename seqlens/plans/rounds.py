"""Bounded rounds over all groups at once: each round is one Spark job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.session import cut_lineage


def _contracted(batch: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The pairs (keys, u, v) of a batch sorted by keys as pairs of every id with the smallest it reaches within the batch.

    ``open`` tells the first and the last group of the batch, which may go on outside of it.
    """
    group = (batch[keys] != batch[keys].shift()).any(axis=1).cumsum().to_numpy() - 1
    ids, rank = np.unique(np.concatenate([batch["u"].to_numpy(), batch["v"].to_numpy()]), return_inverse=True)
    nodes, code = np.unique(np.tile(group, 2) * len(ids) + rank, return_inverse=True)
    u, v = code[:len(batch)], code[len(batch):]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        least = np.minimum(root[u], root[v])
        for end in (root[u], root[v], u, v):
            np.minimum.at(low, end, least)
        low = low[low]
        if (low == root).all():
            break
        root = low
    held = nodes // len(ids)
    out = batch[keys].iloc[np.searchsorted(group, held)].reset_index(drop=True)
    out = out.assign(u=ids[nodes % len(ids)], v=ids[nodes[root] % len(ids)], open=(held == 0) | (held == group[-1]))
    return out[root != np.arange(len(nodes))]


def _within_batches(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` contracted where they lie: sorted by keys over range partitions, so a large group spreads over tasks and batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _contracted(batch, keys)

    placed = pairs.repartitionByRange(*keys, "u").sortWithinPartitions(*keys)
    return cut_lineage(placed.mapInPandas(run, pairs.withColumn("open", F.lit(True)).schema))


def connected_components(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """(keys, id, root): smallest id reachable from each node, per group.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): the
    number of rounds grows with the logarithm of the component size, and every
    node's neighbours are only aggregated with ``min``, never collected. It is done when
    a round leaves the set of pairs, known by its size and hash, as it was. There are never more
    pairs than at first, so with ``rows_per_task`` the tables of a round have as many partitions as the first pairs ask for.

    Pairs of groups (``keys``) are contracted within batches of sorted rows first. A group that lies inside one batch is done
    then; the rounds go on with those that may be cut.
    """
    keys = list(keys)
    pairs = (
        edges.select(*keys, F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v"))
        .filter("u <> v")
    )
    done = None
    if keys:
        local = _within_batches(cut_lineage(pairs), keys)
        done, pairs = local.filter("NOT open").drop("open"), local.filter("open").drop("open")
    pairs = cut_lineage(pairs.distinct())
    tasks = pairs.count() // rows_per_task + 1 if rows_per_task else None
    if tasks:
        pairs = pairs.coalesce(tasks)
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(low, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.filter("u <> v").distinct()
        large = cut_lineage(large.coalesce(tasks) if tasks else large)
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        hooked = large.join(low, [*keys, "u"])
        small = (
            hooked.select(*keys, F.col("u").alias("u"), F.col("m").alias("v"))
            .unionByName(hooked.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        small = cut_lineage(small.coalesce(tasks) if tasks else small)
        pairs = small
        mark = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, "u", "v")).alias("x")).first()
        if mark == seen:
            break
        seen = mark
    roots = pairs.groupBy(*keys, F.col("u").alias("id")).agg(F.min("v").alias("root"))
    if done is not None:
        roots = roots.unionByName(done.select(*keys, F.col("u").alias("id"), F.col("v").alias("root")))
    return nodes.join(roots, [*keys, "id"], "left").withColumn("root", F.coalesce("root", "id"))
