"""Vector columns: cosine, blocked scoring of many items against a bounded set of queries, softmax weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.runtime import ship

#: Query vectors go to the workers while their matrix has at most this many numbers (64 MB of doubles).
MAX_QUERY_CELLS = 8_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0.0 where a norm is 0; null where a side is null or the lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(x, y) / norms)


def _scorer(ids: np.ndarray, unit: np.ndarray, carry: list[str], relative: float | None):
    def within(s: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Scores that can be within ``relative`` of a query's best: those within it of the best here, itself included."""
        own = items[:, None] == ids[None, :]
        top = np.where(own, -np.inf, s).max(axis=0)
        return ~own & (s >= np.where(top > 0, top * relative, top) - 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), max(1, 2_000_000 // max(1, len(ids)))):
                part = pdf.iloc[at : at + max(1, 2_000_000 // max(1, len(ids)))]
                ok = np.array([v is not None and len(v) == unit.shape[1] for v in part["vec"]], bool)
                part = part[ok]
                if not len(part):
                    continue
                m = np.vstack([np.asarray(v, np.float64) for v in part["vec"]])
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                s = np.where(norm > 0, (m / np.where(norm > 0, norm, 1)) @ unit.T, 0.0)
                items = part["item_id"].to_numpy()
                keep = np.ones(s.shape, bool) if relative is None else within(s, items)
                i, q = np.nonzero(keep)
                yield pd.DataFrame({"query_id": ids[q], "item_id": items[i], "score": np.round(s[i, q], 10), **{c: part[c].to_numpy()[i] for c in carry}})

    return run


def score_all(items: DataFrame, queries: DataFrame, relative: float | None = None) -> DataFrame:
    """(query_id, item_id, score) for every query and item, the score rounded to 10 digits. items: item_id, vec and
    columns that are carried along; queries: query_id, vec. relative: leaves out what can't be within that share of the
    query's best score, and the query itself, before anything is shuffled. The queries' matrix goes to the workers if it is within MAX_QUERY_CELLS; beyond that it
    is cut into blocks of queries that are scored one block a pass over the items."""
    spark = items.sparkSession
    ship(spark)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    cells = (size["n"] or 0) * (size["d"] or 0)
    blocks = max(1, -(-cells // MAX_QUERY_CELLS))
    carry = [c for c in items.columns if c not in ("item_id", "vec")]
    schema = "query_id long, item_id long, score double" + "".join(f", {c} {items.schema[c].dataType.simpleString()}" for c in carry)
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).where("vec is not null").collect()
        ids = np.array([r["query_id"] for r in rows], np.int64)
        if not rows:
            continue
        m = np.array([r["vec"] for r in rows], np.float64).reshape(len(rows), -1)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        one = items.select("item_id", "vec", *carry).mapInPandas(_scorer(ids, unit, carry, relative), schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def softmax(score: Column, over: list[str], temperature: float) -> Column:
    """Max-shifted softmax of a score within the groups ``over``."""
    w = Window.partitionBy(*over)
    e = F.exp((score - F.max(score).over(w)) / F.lit(temperature))
    return e / F.sum(e).over(w)
