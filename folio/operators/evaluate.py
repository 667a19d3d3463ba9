"""Evaluation analytics: accuracy tables, paired outcomes, retention curves, rank and confusion reports, span reports.

Ratios over nothing are 0 where a report says so; accuracies over nothing are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import answer_form, token_f1


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Mean, number of hits and rows of a boolean per group; null outcomes are left out of the mean."""
    c = F.col(correct).cast("double")
    return df.groupBy(*by).agg(F.avg(c).alias("accuracy"), F.sum(F.col(correct).cast("long")).alias("n_correct"), F.count(F.lit(1)).alias("n"))


def cost_score(df: DataFrame, by: list[str], penalty: float = 0.05) -> DataFrame:
    """Accuracy, average tokens, lookup rate and accuracy less a charge per 10,000 tokens, best first."""
    out = df.groupBy(*by).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("total_tokens").alias("avg_tokens"), F.avg(F.col("lookup_used").cast("double")).alias("lookup_rate"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("score", F.col("accuracy") - penalty * F.col("avg_tokens") / 10000.0)


def paired(df: DataFrame, unit: str, variant: str, correct: str = "correct") -> DataFrame:
    """For every ordered pair of variants a < b over units that have them all: lost, gained, net, n."""
    one = df.where(F.col(correct).isNotNull() & F.col(variant).isNotNull()).groupBy(unit, variant).agg(F.max(F.col(correct).cast("int")).alias("c"))
    n_variants = one.agg(F.countDistinct(variant).alias("k"))
    full = one.groupBy(unit).agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n_variants), "k", "left_semi").select(unit)
    one = one.join(full, unit, "left_semi")
    a = one.select(unit, F.col(variant).alias("a"), F.col("c").alias("ca"))
    b = one.select(unit, F.col(variant).alias("b"), F.col("c").alias("cb"))
    lost, gained = F.sum(((F.col("ca") == 1) & (F.col("cb") == 0)).cast("long")), F.sum(((F.col("ca") == 0) & (F.col("cb") == 1)).cast("long"))
    return a.join(b, unit).where("a < b").groupBy("a", "b").agg(lost.alias("lost"), gained.alias("gained"), (gained - lost).alias("net"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1, accuracy, accuracy of predicting nothing, positive rate; 0 on 0/0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    s = lambda c: F.sum(c.cast("long"))
    out = df.agg(s(y & p).alias("tp"), s(~y & p).alias("fp"), s(y & ~p).alias("fn"), s(~y & ~p).alias("tn"), F.count(F.lit(1)).alias("n"))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    out = out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).withColumn("accuracy", ratio(tp + tn, n)).withColumn("all_zero_accuracy", ratio(tn + fp, n)).withColumn("positive_rate", ratio(tp + fn, n))


def ranking_report(df: DataFrame, group: str, k: int, label: str = "label", score: str = "score", item: str = "item_id") -> DataFrame:
    """Per group with positives: precision@k, recall@k, its ceiling, chance precision, average precision."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item))
    r = df.withColumn("_r", F.row_number().over(w)).withColumn("_hits", F.sum(label).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.sum(F.when(F.col("_r") <= k, F.col(label)).otherwise(0))
    out = r.groupBy(group).agg(top.alias("_top"), F.sum(label).alias("n_pos"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(label) == 1, F.col("_hits") / F.col("_r")).otherwise(0.0)).alias("_ap"))
    out = out.where("n_pos > 0")
    return out.select(group, (F.col("_top") / F.lit(float(k))).alias("precision_at_k"), (F.col("_top") / F.col("n_pos")).alias("recall_at_k"), F.least(F.lit(1.0), F.col("n_pos") / F.lit(float(k))).alias("ceiling"), (F.col("n_pos") / F.col("n")).alias("chance"), (F.col("_ap") / F.col("n_pos")).alias("average_precision"))


def retention_by_age(probes: DataFrame, states: DataFrame, key: str = "key", max_age: int | None = None) -> DataFrame:
    """probes: key, source, answer; states: key, pos, text. Pooled hits per age = pos - source >= 0."""
    j = probes.join(states, key).where(F.col("pos") >= F.col("source")).withColumn("age", F.col("pos") - F.col("source"))
    if max_age is not None:
        j = j.where(F.col("age") <= max_age)
    hit = token_f1(F.col("answer"), F.col("text")) >= 0.6
    return j.groupBy("age").agg(F.sum(hit.cast("long")).alias("n_correct"), F.count(F.lit(1)).alias("n_probes")).withColumn("accuracy", ratio(F.col("n_correct"), F.col("n_probes")))


def answer_recovery(answer: Column, state: Column) -> tuple[Column, Column]:
    """(normalised containment, token F1) of an answer in a state; an answer without content counts as contained."""
    a, s = answer_form(answer), answer_form(state)
    return F.when((F.length(a) == 0) | F.contains(s, a), 1.0).otherwise(0.0), token_f1(answer, state)


def span_report(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and spans of a memory replay: how often the memory fired, how far back it reached, 0 on nothing."""
    by = by or []
    live = F.col("pool_size") > 0
    fired = live & (F.col("action") == "revise")
    span = F.transform(F.col("retrieved"), lambda x: F.col("pos") - x)
    r = records.withColumn("_spans", span)
    n_ret = F.size("retrieved")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"), s(live.cast("long")).alias("n_live"), s(fired.cast("long")).alias("n_fired"), s((live & (F.col("action") == "insert")).cast("long")).alias("n_inserted"),
        s(F.col("fallback").cast("long")).alias("n_fallback"), s(F.col("failed").cast("long")).alias("n_failed"), s(n_ret).alias("n_retrieved"),
        s(total(F.col("_spans"))).alias("span_total"), F.coalesce(F.max(F.array_max("_spans")), F.lit(0)).cast("long").alias("max_span"),
        s(total(F.col("thread_spans"))).alias("thread_span_total"), F.coalesce(F.max(F.array_max("thread_spans")), F.lit(0)).cast("long").alias("max_thread_span"),
        F.coalesce(F.max("memory_size"), F.lit(0)).alias("memory_size"), F.coalesce(F.max("pool_size"), F.lit(0)).alias("max_pool"),
    )
    c = F.col
    return out.withColumn("fired_share", ratio(c("n_fired"), c("n_live"))).withColumn("insert_share", ratio(c("n_inserted"), c("n_live"))).withColumn("fallback_share", ratio(c("n_fallback"), c("n_live"))).withColumn("mean_span", ratio(c("span_total"), c("n_retrieved"))).withColumn("mean_thread_span", ratio(c("thread_span_total"), c("n_retrieved")))


def seams(kept: DataFrame, group: list[str], item: str = "item_id") -> DataFrame:
    """Gaps between consecutive kept items: before, after, gap_size."""
    nxt = F.lead(item).over(Window.partitionBy(*group).orderBy(item))
    out = kept.withColumn("after", nxt).where((F.col("after") - F.col(item)) > 1)
    return out.select(*group, F.col(item).alias("before"), "after", (F.col("after") - F.col(item) - 1).alias("gap_size"))


#: Fixed values of the rational approximation of the complementary error function (error below 1.5e-7).
ERFC_P, ERFC_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_p(z: Column) -> Column:
    """Chance of a normal deviate at least as far from 0 as z."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERFC_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = (poly + a) * t
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def mann_whitney(df: DataFrame, value: str, group: str, first) -> DataFrame:
    """U of the first group, with tie-corrected normal approximation (z, two-sided p). One row. Equal values are counted
    first, so that the ranks are running sums over distinct values, in ranges and not in one task."""
    from folio.operators.corpus import running_sum

    is_a = (F.col(group) == first).cast("long")
    v = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(is_a).alias("a"), F.count(F.lit(1)).alias("n"))
    r = running_sum(v, ["v"], "n", "before").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    t = r.agg(F.sum(F.col("a") * F.col("rank")).alias("ra"), F.sum("a").alias("na"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    na, n = F.col("na").cast("double"), F.col("n").cast("double")
    nb = n - na
    u = F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), F.abs(u - na * nb / 2) - 0.5) / sd
    return t.select(u.alias("u"), F.col("na").alias("n_first"), (F.col("n") - F.col("na")).alias("n_rest"), z.alias("z"), two_sided_p(z).alias("p"))


def degeneration(rows: DataFrame) -> DataFrame:
    """Checks over a tau sweep (tau, insert_share): monotone share, low end at most 0.2, high end at least 0.8."""
    nxt = F.lead("insert_share").over(Window.orderBy("tau"))  # a row a tau
    mono = rows.withColumn("_n", nxt).agg(F.coalesce(F.bool_and((F.col("_n") >= F.col("insert_share") - 1e-9) | F.col("_n").isNull()), F.lit(True)).alias("monotone"), (F.min_by("insert_share", "tau") <= 0.2).alias("low_end"), (F.max_by("insert_share", "tau") >= 0.8).alias("high_end"))
    return mono.withColumn("passed", F.col("monotone") & F.col("low_end") & F.col("high_end"))


def recommend_tau(rows: DataFrame) -> DataFrame:
    """The tau with the best answer F1 (then the smaller memory) among those that insert a share between 0.2 and 0.8."""
    return rows.where((F.col("insert_share") > 0.2) & (F.col("insert_share") < 0.8)).orderBy(F.desc("answer_f1"), "memory_size", "tau").limit(1)
