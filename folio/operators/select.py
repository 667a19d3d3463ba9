"""Selection over scored rows (group, item, score): ranks, cut-offs, budgets, fusion and neighbour padding.

Ties always go to the lower item. Every function takes the column names of the group and adds or filters rows; ranks
are written with ``row_number`` so that group limits reach below the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from folio.functions.vector import softmax
from folio.runtime import ship


def ranked(df: DataFrame, group: list[str], score: str = "score", item: str = "item_id") -> DataFrame:
    """Adds ``rank`` from 1 by score, best first."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(item))
    return df.withColumn("rank", F.row_number().over(w))


def top_k(df: DataFrame, group: list[str], k: int, score: str = "score", item: str = "item_id") -> DataFrame:
    return ranked(df, group, score, item).where(F.col("rank") <= k)


def adaptive_k(df: DataFrame, group: list[str], relative: float = 0.85, cap: int = 40, score: str = "score", item: str = "item_id") -> DataFrame:
    """Items within ``relative`` of the best score, at most ``cap``; only the best where that isn't positive."""
    return adaptive_flag(df, group, relative, cap, score, item).where("kept").drop("kept")


def adaptive_flag(df: DataFrame, group: list[str], relative: float = 0.85, cap: int = 40, score: str = "score", item: str = "item_id") -> DataFrame:
    """Adds ``rank`` and ``kept``, whether ``adaptive_k`` takes the item."""
    top = F.max(score).over(Window.partitionBy(*group))
    out = ranked(df.withColumn("_top", top), group, score, item)
    return out.withColumn("kept", (F.col("rank") <= cap) & ((F.col("rank") == 1) | ((F.col("_top") > 0) & (F.col(score) >= F.col("_top") * relative)))).drop("_top")


def threshold_or_top(df: DataFrame, group: list[str], tau: float, k: int, score: str = "score", item: str = "item_id") -> DataFrame:
    """First k items with score >= tau; the best item alone where none reaches it."""
    return ranked(df, group, score, item).where(((F.col("rank") <= k) & (F.col(score) >= tau)) | ((F.col("rank") == 1) & (F.col(score) < tau)))


def ratio_budget(df: DataFrame, group: list[str], ratio: float | Column, score: str = "score", item: str = "item_id") -> DataFrame:
    """Adds ``kept``: the best max(1, ceil(ratio * n)) items. -Infinity ranks last but can fill what is left."""
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return ranked(df.withColumn("_n", n), group, score, item).withColumn("kept", F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.round(ratio * F.col("_n"), 9)))).drop("_n")


def pad(df: DataFrame, group: list[str], window: int, item: str = "item_id", kept: str = "kept") -> DataFrame:
    """Adds ``padded``: kept items and their ``window`` neighbours within the group."""
    w = Window.partitionBy(*group).orderBy(item).rowsBetween(-window, window)
    return df.withColumn("padded", F.max(F.col(kept).cast("int")).over(w) == 1)


def nucleus(df: DataFrame, group: list[str], temperature: float = 0.5, top_p: float = 0.8, score: str = "score", item: str = "item_id") -> DataFrame:
    """Items in order of softmax mass until ``top_p`` is reached; the item that crosses is included. Adds ``weight``."""
    out = df.withColumn("weight", softmax(F.col(score), group, temperature))
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(item)).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("_cum", F.sum("weight").over(w)).where(F.round(F.col("_cum") - F.col("weight"), 12) < top_p).drop("_cum")


def weighted_budget(df: DataFrame, group: list[str], total: int, temperature: float = 0.5, least: float = 0.05, score: str = "score") -> DataFrame:
    """Adds ``budget``: ``total`` split by softmax weights; weights below ``least`` of the best count 0."""
    w = Window.partitionBy(*group)
    out = df.withColumn("_w", softmax(F.col(score), group, temperature))
    out = out.withColumn("_w", F.when(F.col("_w") < F.max("_w").over(w) * least, F.lit(0.0)).otherwise(F.col("_w")))
    return out.withColumn("budget", F.bround(F.round(F.col("_w") / F.sum("_w").over(w) * total, 9)).cast("long")).drop("_w")


def fill_budget(df: DataFrame, group: list[str], budget: Column, n_words: str = "n_words", item: str = "item_id") -> DataFrame:
    """Adds ``take``: words taken of each member in order - whole members while they fit, the first that doesn't is
    cut to what remains, then nothing."""
    w = Window.partitionBy(*group).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(n_words).over(w) - F.col(n_words)
    return df.withColumn("_before", before).withColumn("take", F.greatest(F.lit(0), F.least(F.col(n_words), budget - F.col("_before"))).cast("long")).drop("_before")


def reciprocal_rank_fusion(rankings: DataFrame, group: list[str], k: int = 60, item: str = "item_id", rank: str = "rank") -> DataFrame:
    """Sum of 1 / (k + rank) over rankings, rank from 1."""
    return rankings.groupBy(*group, item).agg(F.sum(1.0 / (F.lit(float(k)) + F.col(rank))).alias("fused"))


def fused_ranks(df: DataFrame, ranks: list[Column], k: int = 60) -> DataFrame:
    """As ``reciprocal_rank_fusion`` where every item has all ranks, on the row itself: adds ``fused``."""
    return df.withColumn("fused", sum((1.0 / (F.lit(float(k)) + r) for r in ranks[1:]), 1.0 / (F.lit(float(k)) + ranks[0])))


def minmax(score: Column, group: list[str]) -> Column:
    """Score scaled to [0, 1] within the group; -Infinity gives 0, a flat group 0.5."""
    w = Window.partitionBy(*group)
    finite = F.when(score > F.lit(float("-inf")), score)
    lo, hi = F.min(finite).over(w), F.max(finite).over(w)
    return F.when(finite.isNull(), F.lit(0.0)).when(hi - lo < 1e-9, F.lit(0.5)).otherwise((finite - lo) / (hi - lo))


def density_ratio(df: DataFrame, group: list[str], spread: str, base: float = 0.3, range_: float = 0.3, low: float = 0.15, high: float = 0.8) -> DataFrame:
    """Adds ``ratio``: base moved by the row's cumulative rank of ``spread`` in its group, clamped; base alone for one row."""
    w = Window.partitionBy(*group)
    rank = F.cume_dist().over(w.orderBy(spread))
    n = F.count(F.lit(1)).over(w)
    moved = F.greatest(F.lit(low), F.least(F.lit(high), base + range_ * (0.5 - rank) * 2))
    return df.withColumn("ratio", F.when(n <= 1, F.lit(base)).otherwise(moved))


def lookup_window(targets: Column, highest: Column, window: int = 2, cap: int = 20) -> Column:
    """Targets in order with their neighbours; stops at the first target that would take the union beyond ``cap``."""
    zero = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(False).alias("stopped"))

    def step(acc, t):
        near = F.sequence(F.greatest(F.lit(0).cast("long"), t - window), F.least(highest, t + window))
        union = F.array_union(acc["kept"], near)
        over = acc["stopped"] | (F.size(union) > cap)
        return F.struct(F.when(over, acc["kept"]).otherwise(union).alias("kept"), over.alias("stopped"))

    return F.aggregate(F.filter(targets, lambda t: (t >= 0) & (t <= highest)), zero, step, lambda acc: F.slice(F.array_sort(acc["kept"]), 1, cap))


def greedy_band(values: Column, low: int, high: int) -> Column:
    """Walk over array<struct<id, n>> in order: takes what keeps the sum within ``high``, stops once it is at ``low``."""
    zero = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, v):
        fits = (acc["n"] < low) & (acc["n"] + v["n"] <= high)
        return F.when(fits, F.struct(F.concat(acc["ids"], F.array(v["id"])).alias("ids"), (acc["n"] + v["n"]).alias("n"))).otherwise(acc)

    return F.aggregate(values, zero, step)


def mmr(items: Column, budget: Column, weight: float = 0.7) -> Column:
    """Maximal marginal relevance over array<struct<idx, score, words>>: indices in order of choice. Scores scaled to
    [0, 1] beforehand; each step takes the best of ``weight * score - (1 - weight) * highest Jaccard`` with the words
    of what is chosen; the first index wins ties. Quadratic in the group: use it on windows of bounded size."""

    def jaccard(a, b):
        union = F.size(F.array_union(a, b))
        return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))

    zero = F.array().cast("array<struct<idx:bigint,score:double,words:array<string>>>")

    def step(chosen, _):
        gain = F.transform(
            F.filter(items, lambda i: ~F.exists(chosen, lambda c: c["idx"] == i["idx"])),
            lambda i: F.struct(
                F.round(weight * i["score"] - (1 - weight) * F.aggregate(chosen, F.lit(0.0), lambda m, c: F.greatest(m, jaccard(i["words"], c["words"]))), 10).alias("gain"),
                (-i["idx"]).alias("order"), i.alias("item"),
            ),
        )
        best = F.array_max(F.transform(gain, lambda g: F.struct(g["gain"], g["order"], g["item"].alias("item"))))
        return F.concat(chosen, F.when(best.isNotNull(), F.array(best["item"])).otherwise(zero))

    return F.transform(F.aggregate(F.sequence(F.lit(1), F.greatest(budget, F.lit(1))), zero, step), lambda c: c["idx"])


def _mmr(scores: np.ndarray, words: list, budget: int, weight: float) -> list[int]:
    """As ``mmr``, with a running highest Jaccard: a step counts the words it shares with what it has just chosen."""
    n = len(scores)
    own = [set(w) for w in words]
    size = np.array([len(w) for w in own], np.float64)
    holders: dict[str, list[int]] = {}
    for i, w in enumerate(own):
        for x in w:
            holders.setdefault(x, []).append(i)
    where = {x: np.array(at) for x, at in holders.items()}
    highest, open_, out = np.zeros(n), np.ones(n, bool), []
    for _ in range(min(budget, n)):
        best = int(np.argmax(np.where(open_, np.round(weight * scores - (1 - weight) * highest, 10), -np.inf)))
        out.append(best)
        open_[best] = False
        shared = np.zeros(n)
        for x in own[best]:
            shared[where[x]] += 1
        union = size + size[best] - shared
        highest = np.maximum(highest, np.where(union > 0, shared / np.maximum(union, 1), 0.0))
    return out


def mmr_share(df: DataFrame, group: list[str], ratio: float, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over all items of a row. df: group, scores array<double>, words array<array<string>>.
    Gives group and ``chosen``, the places of max(1, ceil(ratio * n)) items in order of choice. Scores are scaled to
    [0, 1] in the row, 0.5 where they are flat; the first place wins ties. Work is items times the budget."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chosen = []
            for scores, words in zip(pdf["scores"], pdf["words"]):
                s = np.asarray(scores, np.float64)
                lo, hi = s.min(), s.max()
                s = np.full(len(s), 0.5) if hi - lo < 1e-9 else (s - lo) / (hi - lo)
                chosen.append(_mmr(s, list(words), max(1, math.ceil(round(ratio * len(s), 9))), weight))
            yield pdf[group].assign(chosen=chosen)

    out = StructType([*(df.schema[g] for g in group), *_parse_datatype_string("chosen array<long>").fields])
    return df.where(F.size("scores") > 0).select(*group, "scores", "words").mapInPandas(run, out)
