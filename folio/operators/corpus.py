"""Corpus building and its checks: answer positions and counts, leaks, packing, interleaving, samples, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import find, ngrams, occurrences, word_count
from folio.operators.fold import ordered_fold


def aligned(context: Column, answer: Column, position: Column) -> Column:
    """Whether the answer stands at its position in the context."""
    return F.substring(context, (position + 1).cast("int"), F.length(answer)) == answer


def rare_enough(text: Column, answer: Column, most: int = 3) -> Column:
    """Whether the answer occurs once to ``most`` times, overlaps not counted."""
    return occurrences(text, answer).between(1, most)


def first_variant(text: Column, variants: Column) -> Column:
    """struct<answer, pos> of the first variant that the text holds, null if none."""
    held = F.filter(variants, lambda v: (F.length(v) > 0) & F.contains(text, v))
    return F.when(F.size(held) > 0, F.struct(held[0].alias("answer"), find(text, held[0]).alias("pos")))


def even_stride(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows at an even stride: those at floor(i * n / most) of the order. Row numbers come from range
    buckets, not from one global window."""
    n = df.count()
    if n <= most:
        return df
    numbered = with_row_number(df, order)
    i = F.floor((F.col("_rn") * most + most - 1 + n - most) / n)  # the i whose stride could end here
    hit = F.exists(F.array(i - 1, i, i + 1), lambda x: (x >= 0) & (x < most) & (F.floor(x * n / F.lit(most)) == F.col("_rn")))
    return numbered.where(hit).drop("_rn")


def with_row_number(df: DataFrame, order: list[str], name: str = "_rn") -> DataFrame:
    """0-based global row number: counts per range partition first, then numbers within."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    base = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    base = base.withColumn("_base", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")  # a row a partition
    return ranged.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before: sums per range partition first, then within."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ranged = ranged.withColumn("_in", F.coalesce(own, F.lit(0)))
    base = ranged.groupBy("_part").agg(F.sum(value).alias("_m"))
    base = base.withColumn("_base", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")  # a row a partition
    return ranged.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")


def concat_offsets(df: DataFrame, group: list[str], order: str, text: str, separator: int) -> DataFrame:
    """Adds ``offset``: where each text begins if the group's texts are joined by a separator of that length."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.length(text) + separator).over(w), F.lit(0)).cast("long"))


def interleave(df: DataFrame, group: str, order: str) -> DataFrame:
    """Round robin over the groups, groups in order of first appearance: adds ``round`` and ``turn``."""
    first = df.groupBy(group).agg(F.min(order).alias("turn"))
    return df.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).join(first, group)


def first_of_each(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")


class _Pack:
    """Sequential packing into bins of ``low`` to ``high``: a bin closes once it has ``low``; what would burst it is left out."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.bin, self.n = low, high, 0, 0

    def row(self, r) -> list[tuple]:
        n = int(r.n_words)
        if self.n + n > self.high:
            return []
        self.n += n
        out = [(int(r.pos), self.bin, self.n)]
        if self.n >= self.low:
            self.bin, self.n = self.bin + 1, 0
        return out

    def finish(self) -> list[tuple]:
        return []


def pack(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """df: key, pos, n_words. Gives key, pos, bin, filled."""
    return ordered_fold(df, [key], ["pos"], lambda: _Pack(low, high), "pos long, bin long, filled long")


class _Band:
    """Greedy walk to a word band: takes what keeps the sum within ``high``, stops once it is at ``low``."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.n, self.ids = low, high, 0, []

    def row(self, r) -> list[tuple]:
        n = int(r.n_words)
        if self.n < self.low and self.n + n <= self.high:
            self.n += n
            self.ids.append(int(r.pos))
        return []

    def finish(self) -> list[tuple]:
        return [(self.ids, self.n)]


def band(df: DataFrame, key: str, order: list[str], low: int, high: int) -> DataFrame:
    """One selection for the whole of each key, walked in the given order. df: key, pos, n_words. Gives key, ids, n_words."""
    return ordered_fold(df, [key], order, lambda: _Band(low, high), "ids array<long>, n_words long")


class _Deal:
    """Deals rows to n bins in turn; a bin that can't take a row passes it on."""

    def __init__(self, n: int, low: int, high: int):
        self.fill, self.low, self.high, self.at = [0] * n, low, high, 0

    def row(self, r) -> list[tuple]:
        n = len(self.fill)
        for step in range(n):
            b = (self.at + step) % n
            if self.fill[b] < self.low and self.fill[b] + int(r.n_words) <= self.high:
                self.fill[b] += int(r.n_words)
                self.at = (b + 1) % n
                return [(int(r.pos), b)]
        return []

    def finish(self) -> list[tuple]:
        return []


def deal(df: DataFrame, key: str, n: int, low: int, high: int) -> DataFrame:
    """Round-robin dealing with a capacity band: key, pos, bin; bins below ``low`` are dropped."""
    out = ordered_fold(df, [key], ["pos"], lambda: _Deal(n, low, high), "pos long, bin long").join(df.select(key, "pos", "n_words"), [key, "pos"])
    full = out.groupBy(key, "bin").agg(F.sum("n_words").alias("_n")).where(F.col("_n") >= low)
    return out.join(full.select(key, "bin"), [key, "bin"], "left_semi").select(key, "pos", "bin")


def bisect_fraction(df: DataFrame, group: str, score: str, label: str, target: float, steps: int = 8, low: float = 0.01, high: float = 1.0) -> DataFrame:
    """Per group the share of best rows to keep so that the positive rate among them comes near the target, by
    bisection. One pass: counts of kept and positive rows at every grid point the bisection can reach."""
    grid = df.sparkSession.range(1, 2**steps).select((F.lit(low) + F.col("id") * ((high - low) / 2**steps)).alias("fraction"), F.col("id").alias("k"))
    ranked = df.withColumn("_p", F.percent_rank().over(Window.partitionBy(group).orderBy(F.col(score).desc())))
    ranked = ranked.withColumn("_k", F.greatest(F.lit(1), F.ceil((F.col("_p") - low) / ((high - low) / 2**steps))).cast("long"))
    counts = ranked.groupBy(group, "_k").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    cum = counts.join(F.broadcast(grid), F.col("_k") <= F.col("k")).groupBy(group, "k", "fraction").agg((F.sum("pos") / F.sum("n")).alias("rate"))
    w = Window.partitionBy(group).orderBy(F.abs(F.col("rate") - target), "k")
    return cum.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(group, "fraction", "rate")


def balanced(df: DataFrame, group: str, label: str, key: str, rate: float) -> DataFrame:
    """All positives of each group and as many negatives, in the order of a hash of their key, as make positives the
    share ``rate``; all rows of a group that has more positives already."""
    w = Window.partitionBy(group)
    out = df.withColumn("_pos", F.sum(label).over(w)).withColumn("_r", F.row_number().over(Window.partitionBy(group, label).orderBy(F.md5(F.col(key).cast("string")), key)))
    return out.where((F.col(label) == 1) | (F.col("_r") <= F.floor(F.col("_pos") * F.lit((1 - rate) / rate)))).drop("_pos", "_r")


def bounded_words(df: DataFrame, text: str, least: int) -> DataFrame:
    """Rows of at least ``least`` words."""
    return df.where(word_count(F.col(text)) >= least)


def leak_free(candidates: DataFrame, held_out: DataFrame, key: str, text: str, passage: str, k: int = 24, sparse: int = 16) -> DataFrame:
    """Candidates that hold no held-out passage verbatim; null texts hold none.

    Passages and candidates meet in equal k-grams, of which only those with a hash divisible by ``sparse`` are spelled
    out. A passage without such a k-gram, or one shorter than k, is looked up by its first gram of at most k characters
    among all grams of that length. Every meeting is checked on the texts."""
    cand = candidates.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"))
    items = held_out.where(F.length(passage) > 0).select(F.col(passage).alias("_p")).distinct()

    def grams(c: Column, size: int, rare: bool) -> Column:
        # slices of the array of characters: a substring is looked for from the text's start each time
        all_ = ngrams(F.split(c, ""), size, "")
        return F.filter(all_, lambda g: F.pmod(F.xxhash64(g), F.lit(sparse)) == 0) if rare else all_

    items = items.withColumn("_g", F.get(grams(F.col("_p"), k, True), F.lit(0)))
    dense = items.where("_g is null").withColumn("_g", F.substring("_p", 1, k))
    sizes = [r[0] for r in dense.select(F.length("_g").alias("n")).distinct().collect()]  # at most k numbers

    def meet(probes: DataFrame, size: int, rare: bool) -> DataFrame:
        held = cand.select(key, F.explode(F.array_distinct(grams(F.col("_t"), size, rare))).alias("_g"))
        return held.join(probes, "_g").join(cand, key).where(F.contains("_t", "_p")).select(key)

    hit = meet(items.where("_g is not null"), k, True)
    for n in sizes:
        hit = hit.unionByName(meet(dense.where(F.length("_g") == n), n, False))
    return candidates.join(hit.distinct(), key, "left_anti")


def greedy_oracle(sents: Column, reference: Column, most: int = 3, gain: float = 0.01) -> Column:
    """Greedy extract: up to ``most`` sentence indices that raise the mean of unigram and bigram F against the
    reference by ``gain`` each. array<struct<idx, words>> in, array of idx out."""

    def grams(w, n):
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))))

    def f1(a, b):
        hit = F.size(F.array_intersect(a, b)).cast("double")
        return F.when(hit == 0, F.lit(0.0)).otherwise(2 * hit / (F.size(a) + F.size(b)))

    def score(w):
        return (f1(grams(w, 1), grams(reference, 1)) + f1(grams(w, 2), grams(reference, 2))) / 2

    zero = F.struct(F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("words"), F.lit(0.0).alias("score"))

    def step(acc, _):
        rest = F.filter(sents, lambda s: ~F.array_contains(acc["ids"], s["idx"]))
        tried = F.transform(rest, lambda s: F.struct(F.round(score(F.concat(acc["words"], s["words"])), 10).alias("score"), (-s["idx"]).alias("order"), s["words"].alias("words")))
        best = F.array_max(tried)
        better = best.isNotNull() & (best["score"] - acc["score"] >= gain)
        return F.when(better, F.struct(F.concat(acc["ids"], F.array(-best["order"])).alias("ids"), F.concat(acc["words"], best["words"]).alias("words"), best["score"].alias("score"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step, lambda acc: acc["ids"])
