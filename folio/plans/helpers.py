"""Blocked pair search for the query catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.runtime import ship

BLOCK = 1500


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, left, right in zip(pdf["doc_key"], pdf["l"], pdf["r"]):
            ai, a = np.array([x["slot_id"] for x in left]), np.array([x["vec"] for x in left], np.float64)
            bi, b = np.array([x["slot_id"] for x in right]), np.array([x["vec"] for x in right], np.float64)
            an, bn = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
            s = np.round((a @ b.T) / np.maximum(np.outer(an, bn), 1e-300), 8)
            s[ai[:, None] == bi[None, :]] = -2
            top = s.max()
            i, j = np.nonzero(s == top)
            if top > -2:
                rows.append((key, *min((min(ai[x], bi[y]), max(ai[x], bi[y])) for x, y in zip(i, j)), float(top)))
        yield pd.DataFrame(rows, columns=["doc_key", "a", "b", "s"])


def closest_pairs(slots: DataFrame) -> DataFrame:
    """doc_key, a, b, score of each document's closest pair. Slots are hashed into blocks; pairs of blocks meet in one
    row of at most some thousand vectors, however many slots a document has."""
    ship(slots.sparkSession)
    block = slots.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_key")))
    k = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    block = block.withColumn("block", F.pmod(F.hash("slot_id"), k)).groupBy("doc_key", "block").agg(F.collect_list(F.struct("slot_id", "vec")).alias("m"))
    left, right = block.select("doc_key", F.col("block").alias("x"), F.col("m").alias("l")), block.select("doc_key", F.col("block").alias("y"), F.col("m").alias("r"))
    best = left.join(right, "doc_key").where("x <= y").select("doc_key", "l", "r").mapInPandas(_best, "doc_key string, a long, b long, s double")
    w = Window.partitionBy("doc_key").orderBy(F.desc("s"), "a", "b")
    return best.withColumn("k", F.row_number().over(w)).where("k = 1").select("doc_key", "a", "b", F.round("s", 6).alias("score"))
