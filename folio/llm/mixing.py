"""A training mix with target token shares, as a time-varying curriculum (problem 8).

Every source s has a target share w_s and may be repeated at most r_s times. Its token demand is ``w_s * total``,
capped at ``r_s`` times what it holds; what capped sources can't give goes to the others in proportion, over and
over, until it is placed or all are capped. The schedule starts nearer to the sources' natural shares and ends
beyond the targets, linearly, so that its integral is the demand:

    d_s(t) = D_s * (a_s t + (1 - a_s) t^2),   0 <= t <= 1

Within a source the documents stand in the order of a hash. A copy whose tokens begin at ``c`` of the source's
sequence gets the position t with d_s(t) = c - the demand inverted in closed form - and the mix is the documents
range-sorted by position. The running sums go over hash buckets first, so that no source is summed in one task.

Defined cases: documents without tokens, and documents of null or unlisted sources, take no part (target 0);
sources of the target without documents have share 0; several spellings of a source are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.tokens import slice_name, token_counts
from folio.runtime import cut, read

BUCKETS = 256
TILT = 0.5


def demands(targets: list[dict], held: dict[str, int], total: float) -> dict[str, float]:
    """Tokens demanded of each source: shares of ``total`` under the caps, the rest spread over those with room."""
    cap = {t["source"]: held.get(t["source"], 0) * max(0, t["max_repeats"]) for t in targets}
    weight = {t["source"]: max(0.0, t["target_share"] or 0.0) for t in targets}
    out: dict[str, float] = {}
    left = float(min(total, sum(c for s, c in cap.items() if weight[s] > 0)))
    open_ = {s for s in cap if weight[s] > 0}
    while open_ and left > 1e-9:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if cap[s] <= left * weight[s] / whole}
        if not full:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in full:
            out[s] = float(cap[s])
        left -= sum(cap[s] for s in full)
        open_ -= full
    return {s: out.get(s, 0.0) for s in cap}


def plan(counts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per target source: share, cap, tokens held, demand, and the schedule's start a_s. The targets are a
    small table; sums by source are what comes to the driver. total: tokens of the mix, by default what the listed
    sources hold."""
    spark = counts.sparkSession
    rows = [r.asDict() for r in targets.where("source is not null").groupBy(slice_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()]
    names = spark.createDataFrame([(r["source"],) for r in rows], "source string")
    held = {r["source"]: r["n"] for r in counts.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    whole = sum(held.values())
    need = demands(rows, held, total if total is not None else whole)
    placed = sum(need.values()) or 1.0
    out = []
    for r in rows:
        s, share = r["source"], need[r["source"]] / placed
        natural = held.get(s, 0) / whole if whole else 0.0
        a = 1.0 + TILT * (natural / share - 1.0) if share else 1.0
        out.append((s, float(r["target_share"]), int(r["max_repeats"]), int(held.get(s, 0)), float(need[s]), float(min(1.8, max(0.2, a)))))
    return spark.createDataFrame(out, "source string, target_share double, max_repeats int, held long, demand double, start double")


def mix(counts: DataFrame, plan_: DataFrame) -> DataFrame:
    """The mix: source, doc_id, repeat (from 0), n_tokens and position in [0, 1), sorted by position. counts: doc_id, source, n_tokens."""
    docs = counts.select("doc_id", "source", "n_tokens").where("n_tokens > 0").join(F.broadcast(plan_), "source").withColumn("h", F.xxhash64("doc_id"))
    docs = docs.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS)).cast("int"))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))  # at most BUCKETS rows a source
    before = sums.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).select("source", "bucket", "base")
    inner = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id")) - F.col("n_tokens")
    placed = docs.join(F.broadcast(before), ["source", "bucket"]).withColumn("c", F.col("base") + inner)
    copies = F.least(F.col("max_repeats").cast("long"), F.ceil((F.col("demand") - F.col("c")) / F.col("held")))
    out = placed.where(F.col("c") < F.col("demand")).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    at = (F.col("c") + F.col("repeat") * F.col("held")) / F.col("demand")
    a, b = F.col("start"), 1 - F.col("start")
    flat = F.abs(b) < 1e-9
    inverse = F.when(flat, at).otherwise((F.sqrt(a * a + 4 * b * at) - a) / F.when(flat, F.lit(1.0)).otherwise(2 * b))
    return out.select("source", "doc_id", "repeat", "n_tokens", (inverse + F.lit(0.0)).alias("position")).orderBy("position", "source", "doc_id", "repeat")


def shares(mixed: DataFrame, plan_: DataFrame) -> DataFrame:
    """What the mix holds of each source against its target."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_copies"), (F.max("repeat") + 1).alias("repeats"))
    whole = used.agg(F.sum("used").alias("whole"))
    out = plan_.join(used, "source", "left").crossJoin(F.broadcast(whole))  # one row beside the small target table
    return out.select(
        "source", "target_share", "max_repeats", F.col("held").alias("held_tokens"), F.coalesce("used", F.lit(0)).alias("used_tokens"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        F.coalesce("repeats", F.lit(0)).cast("long").alias("repeats"), F.round(F.coalesce(F.col("used") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"),
        (F.coalesce(F.col("used") / F.col("whole"), F.lit(0.0)) >= F.col("target_share") - 0.005).alias("reached"),
    )


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text").where("doc_id is not null")
    counts = token_counts(docs, ["doc_id", "source"]).select("doc_id", slice_name(F.col("source")).alias("source"), "n_tokens")
    return cut(counts), read(spark, sf_dir, "mix_target", "source", "target_share", "max_repeats")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mix in training order."""
    counts, targets = _counts(spark, sf_dir)
    return mix(counts, plan(counts, targets))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the mix actually reached."""
    counts, targets = _counts(spark, sf_dir)
    p = plan(counts, targets)
    return shares(mix(counts, p), p)
