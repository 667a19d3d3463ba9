"""Long exact spans shared between records, by seeds and collinear chaining (problem 4).

A record owns one or more text fields. A character is shared if it lies in ``length`` consecutive characters that
also stand, exactly so, in another record.

* **Copies.** Equal texts are one text with its list of owners. A text that two records own is shared as a whole.
* **Seeds.** Winnowed k-mers, with k and window such that every span of ``length`` characters holds a common seed.
* **Chains.** Seeds that stand in few texts are joined; for every pair of texts the ordered matches are chained
  by score minus gap costs with a Fenwick tree of prefix maxima, chain after chain until no match is left, and each
  chain is aligned: its matches are extended as far as the texts agree. Exact runs of ``length`` and more give
  the shared characters; a chain with all its gaps is a fuzzy passage.
* **Hot seeds.** A seed in more than ``SEED_CAP`` texts makes quadratic pairs. For the exact spans each window of
  ``length`` characters around such a seed is matched with one representative instead, the least or, where that is of
  the same record, the greatest record that has an equal hash. These matches, linear in number, are chained and aligned
  on the texts like all others, so equal hashes of different windows do no harm and every shared window lies in an
  aligned run. The fuzzy report names pairs of texts, so there every seed is joined, however hot.
* **Fuzzy seeds.** The fuzzy chains have shorter seeds of their own: ``FUZZY_SEED`` characters, one at least in every
  exact run of ``FUZZY_RUN``. A passage with an edit at least every ``FUZZY_SEED`` characters has none.

Defined cases: null and empty texts and texts shorter than ``length`` share nothing; a passage that recurs only
within one record (also across its fields) is not shared; repeated rows of one key are one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.textkeys import codes, grams, winnow
from folio.runtime import cut, read, ship

LENGTH, SEED, SEED_CAP = 160, 80, 24
FUZZY_RUN, FUZZY_SEED = 64, 40


class Fenwick:
    """Prefix maxima of (score, item)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Best of the positions below i."""
        out = (float("-inf"), -1)
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def chains(matches: list[tuple[int, int]], k: int, gap: float = 0.05) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of seed matches, best first; together they hold every match."""
    left = sorted(set(matches))
    out = []
    while left:
        ranks = {q: r for r, q in enumerate(sorted({q for _, q in left}))}
        tree, score, before = Fenwick(len(ranks)), [0.0] * len(left), [-1] * len(left)
        i = 0
        while i < len(left):
            j = i
            while j < len(left) and left[j][0] == left[i][0]:  # matches of one position can't follow each other
                p, q = left[j]
                best, prev = tree.upto(ranks[q])
                score[j] = k
                if prev >= 0 and best - gap * (p + q) > 0:
                    score[j] += best - gap * (p + q)
                    before[j] = prev
                j += 1
            for x in range(i, j):
                p, q = left[x]
                tree.put(ranks[q], (score[x] + gap * (p + q), x))
            i = j
        at = max(range(len(left)), key=lambda x: (score[x], -x))
        chain = []
        while at >= 0:
            chain.append(at)
            at = before[at]
        used = set(chain)
        out.append([left[x] for x in reversed(chain)])
        left = [m for x, m in enumerate(left) if x not in used]
    return out


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Maximal exact runs (start in a, start in b, length) through the matches of a chain."""
    runs: list[tuple[int, int, int]] = []
    done: dict[int, int] = {}
    for p, q in chain:
        if done.get(p - q, -1) >= p + k:
            continue
        n = min(len(a) - p, len(b) - q)
        diff = np.flatnonzero(a[p : p + n] != b[q : q + n])
        right = int(diff[0]) if len(diff) else n
        if right < k:
            continue  # equal hashes of different strings
        m = min(p, q)
        diff = np.flatnonzero(a[p - m : p][::-1] != b[q - m : q][::-1])
        back = int(diff[0]) if len(diff) else m
        runs.append((p - back, q - back, back + right))
        done[p - q] = p + right
    return runs


def _seeds(k: int, w: int, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, hs, ps = [], [], []
            for tid, text in zip(pdf["tid"], pdf["text"]):
                if len(text) < length:
                    continue
                h = grams(codes(text), k)
                at = winnow(h, w)
                ids += [tid] * len(at)
                hs.append(h[at].view(np.int64))
                ps.append(at)
            if ids:
                yield pd.DataFrame({"tid": ids, "h": np.concatenate(hs), "pos": np.concatenate(ps).astype(np.int32)})

    return run


PAIRED = "tid binary, span_start long, span_end long, other binary, kind string"


def _aligned(k: int, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = codes(r.a_text), codes(r.b_text)
                for chain in chains([(m["p"], m["q"]) for m in r.matches], k):
                    runs = align(a, b, chain, k)
                    for p, q, n in runs:
                        if n >= length:
                            rows.append((r.a, p, p + n, r.b, "exact"))
                            rows.append((r.b, q, q + n, r.a, "exact"))
                    if runs:
                        lo, hi = min(x[0] for x in runs), max(x[0] + x[2] for x in runs)
                        lo2, hi2 = min(x[1] for x in runs), max(x[1] + x[2] for x in runs)
                        rows.append((r.a, lo, hi, r.b, "chain"))
                        rows.append((r.b, lo2, hi2, r.a, "chain"))
            yield pd.DataFrame(rows, columns=["tid", "span_start", "span_end", "other", "kind"]).astype({"span_start": np.int64, "span_end": np.int64})

    return run


def _windows(k: int, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, ss, h1 = [], [], []
            for tid, text, at in zip(pdf["tid"], pdf["text"], pdf["at"]):
                c = codes(text)
                starts = np.unique(np.concatenate([np.arange(max(0, p + k - length), min(p, len(c) - length) + 1) for p in at]))
                g = grams(c, length)[starts]
                ids += [tid] * len(starts)
                ss.append(starts)
                h1.append(g.view(np.int64))
            if ids:
                yield pd.DataFrame({"tid": ids, "s": np.concatenate(ss).astype(np.int64), "g": np.concatenate(h1)})

    return run


SALT = 8


def _meet(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``keyed``, one row a key, of which each has SALT copies: a hot key's rows go to SALT tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("tid"), F.lit(SALT)).cast("int"))
    return salted.join(keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [key, "_salt"]).drop("_salt")


def _to_representatives(texts: DataFrame, hot: DataFrame, length: int, k: int) -> DataFrame:
    """Matches of windows around hot seeds with windows of another record: one for each run and partner, as a, b, matches."""
    at = hot.groupBy("tid").agg(F.collect_set("pos").alias("at"))
    wins = at.join(texts, "tid").select("tid", "text", "at").mapInPandas(_windows(k, length), "tid binary, s long, g long")
    wins = wins.join(texts.select("tid", "r_min", "r_max"), "tid")
    ends = wins.groupBy("g").agg(F.min(F.struct("r_min", "tid", "s")).alias("lo"), F.max(F.struct("r_max", "tid", "s")).alias("hi")).where("lo.r_min <> hi.r_max")
    met = _meet(wins.where("r_min = r_max"), ends, "g")  # a text of several records is shared as a whole
    other = F.when(F.col("lo.r_min") != F.col("r_min"), F.struct("lo.tid", "lo.s")).otherwise(F.struct("hi.tid", "hi.s"))
    met = met.select(F.col("tid").alias("a"), F.col("s").alias("p"), other.alias("o")).select("a", "p", F.col("o.tid").alias("b"), F.col("o.s").alias("q"))
    # windows of one diagonal that begin within ``length`` characters lie in one run
    runs = met.groupBy("a", "b", F.expr("p - q").alias("diagonal"), F.floor(F.col("p") / length).alias("block")).agg(F.min(F.struct("p", "q")).alias("m"))
    return runs.groupBy("a", "b").agg(F.collect_list(F.struct(F.col("m.p").cast("int").alias("p"), F.col("m.q").cast("int").alias("q"))).alias("matches"))


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for tid, spans in zip(pdf["tid"], pdf["spans"]):
            a = b = None
            for s in sorted((x["s"], x["e"]) for x in spans):
                if b is not None and s[0] <= b:
                    b = max(b, s[1])
                    continue
                if b is not None:
                    rows.append((tid, a, b))
                a, b = s
            rows.append((tid, a, b))
        yield pd.DataFrame(rows, columns=["tid", "span_start", "span_end"]).astype({"span_start": np.int64, "span_end": np.int64})


def _owners(fields: DataFrame, length: int) -> DataFrame:
    """field_name, record_id, record, text, tid of every text that is long enough; equal texts have one tid."""
    one = fields.where("text is not null and text <> ''").groupBy("field_name", "record_id", "record").agg(F.max("text").alias("text")).where(F.length("text") >= length)
    return one.withColumn("tid", F.unhex(F.md5("text")))


def _parts(fields: DataFrame, length: int, run: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(owners, texts, seeds that recur: one at least in every shared run of ``run`` characters). fields: field_name,
    record_id, record, text."""
    ship(fields.sparkSession)
    owners = cut(_owners(fields, length))
    texts = cut(owners.groupBy("tid").agg(F.first("text").alias("text"), F.min("record").alias("r_min"), F.max("record").alias("r_max")))
    owners = owners.select("tid", "field_name", "record_id")
    seeds = texts.select("tid", "text").mapInPandas(_seeds(k, run - k + 1, length), "tid binary, h long, pos int")
    seeds = cut(seeds.join(texts.select("tid", "r_min", "r_max"), "tid"))
    counts = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("r_min").alias("lo"), F.max("r_max").alias("hi")).where("n > 1 and lo <> hi").select("h", "n")
    return owners, texts, cut(_meet(seeds, counts, "h"))


def _paired(texts: DataFrame, common: DataFrame, length: int, k: int) -> DataFrame:
    """Aligned chains of every two texts that have one of the given seeds in common."""
    side = lambda a, p: common.select("h", F.col("tid").alias(a), F.col("pos").alias(p), F.col("r_min").alias(f"{a}_lo"), F.col("r_max").alias(f"{a}_hi"))
    pairs = side("a", "p").join(side("b", "q"), "h").where("a < b and not (a_lo = a_hi and b_lo = b_hi and a_lo = b_lo)")
    pairs = pairs.groupBy("a", "b").agg(F.collect_list(F.struct("p", "q")).alias("matches"))
    return _on_texts(texts, pairs, length, k)


def _on_texts(texts: DataFrame, pairs: DataFrame, length: int, k: int) -> DataFrame:
    """Matches (a, b, matches of k characters) chained and aligned on the texts."""
    text = lambda a: texts.select(F.col("tid").alias(a), F.col("text").alias(f"{a}_text"))
    return pairs.join(text("a"), "a").join(text("b"), "b").mapInPandas(_aligned(k, length), PAIRED)


def shared_spans(fields: DataFrame, length: int = LENGTH, k: int = SEED) -> DataFrame:
    """Maximal runs of shared characters: field_name, record_id, span_start, span_end."""
    owners, texts, common = _parts(fields, length, length, k)
    found = _paired(texts, common.where(F.col("n") <= SEED_CAP), length, k)
    found = found.unionByName(_on_texts(texts, _to_representatives(texts, common.where(F.col("n") > SEED_CAP), length, k), length, length))
    whole = texts.where("r_min <> r_max").select("tid", F.lit(0).cast("long").alias("s"), F.length("text").cast("long").alias("e"))
    spans = found.where("kind = 'exact'").select("tid", F.col("span_start").alias("s"), F.col("span_end").alias("e")).unionByName(whole)
    runs = spans.groupBy("tid").agg(F.collect_set(F.struct("s", "e")).alias("spans")).mapInPandas(_merged, "tid binary, span_start long, span_end long")
    return owners.join(runs, "tid").select("field_name", "record_id", "span_start", "span_end")


def fuzzy_passages(fields: DataFrame, length: int = LENGTH, run: int = FUZZY_RUN, k: int = FUZZY_SEED) -> DataFrame:
    """Chains between texts, gaps included, of at least ``length`` characters: one row per chain, text and partner text,
    each named by its least owner; ``copies`` has the others."""
    owners, texts, common = _parts(fields, length, run, k)
    found = _paired(texts, common, length, k)
    name = owners.groupBy("tid").agg(F.min(F.struct("field_name", "record_id")).alias("o"))
    other = name.select(F.col("tid").alias("other"), F.col("o").alias("p"))
    out = found.where((F.col("kind") == "chain") & (F.col("span_end") - F.col("span_start") >= length)).join(name, "tid").join(other, "other")
    return out.select(F.col("o.field_name").alias("field_name"), F.col("o.record_id").alias("record_id"), "span_start", "span_end", F.col("p.field_name").alias("other_field"), F.col("p.record_id").alias("other_id"))


def copies(fields: DataFrame, length: int = LENGTH) -> DataFrame:
    """Owners of a text that isn't named by them, with the least owner of the equal text, which is."""
    owners = _owners(fields, length).select("tid", "field_name", "record_id")
    name = owners.groupBy("tid").agg(F.min(F.struct("field_name", "record_id")).alias("o"))
    out = owners.join(name, "tid").select("field_name", "record_id", F.col("o.field_name").alias("least_field"), F.col("o.record_id").alias("least_id"))
    return out.where("field_name <> least_field or record_id <> least_id")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "teacher_gists_anticollapse_wiki20_pilot", "gist_id", "text", "original_text")
    h = read(spark, sf_dir, "hit", "hit_id", "text")
    row = lambda df, name, key, col, tag: df.where(F.col(key).isNotNull()).select(F.lit(name).alias("field_name"), F.col(key).alias("record_id"), F.concat(F.lit(tag), F.col(key).cast("string")).alias("record"), F.col(col).alias("text"))
    return row(g, "gist_text", "gist_id", "text", "g").unionByName(row(g, "gist_original", "gist_id", "original_text", "g")).unionByName(row(h, "hit_text", "hit_id", "text", "h"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal run of characters that another record shares."""
    return shared_spans(_fields(spark, sf_dir))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record is shared elsewhere."""
    fields = _fields(spark, sf_dir)
    size = fields.groupBy("field_name", "record_id").agg(F.max(F.length("text")).cast("long").alias("n_chars"))
    runs = shared_spans(fields).groupBy("field_name", "record_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("n_runs"))
    return runs.join(size, ["field_name", "record_id"]).withColumn("shared_part", F.round(F.col("shared_chars") / F.col("n_chars"), 6))


def p4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages: chained matches with their gaps."""
    return fuzzy_passages(_fields(spark, sf_dir))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts equal as a whole: each owner that p4_passages doesn't name, with the one it names instead."""
    return copies(_fields(spark, sf_dir))
