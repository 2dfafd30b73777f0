"""Bounded samples of labelled rows for the classifiers, and small helpers that both use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(store: Store, docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text and y of at most `most` training rows of each label, the labels' counts).

    Training rows are those that aren't held out.  Of each label those with the smallest
    hash of the id are taken; an id with several labels counts with the largest.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    own = store.table("labels", own.withColumn("h", F.xxhash64("id", F.lit(17))))
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in sorted(counts):
        some = own.where(F.col("y") == y).orderBy("h", "id").limit(most).select("id", "y")
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        picked = own.select("id", "y")
    # at most 2 * most rows of two numbers
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("text", "y")
    return store.table("sample", found.dropDuplicates(["text", "y"])), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def row_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give each label its share of all training rows; they average 1."""
    total = max(1, sum(counts.values()))
    w = np.ones(len(y))
    for k, n in counts.items():
        own = y == k
        if own.any():
            w[own] = n / total / own.sum()
    return w * len(y) / max(w.sum(), 1e-12)
