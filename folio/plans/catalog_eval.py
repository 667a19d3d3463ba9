"""Queries of evaluation analytics over the threshold sweep, plus joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import evaluate as E
from folio.operators.rangejoin import as_of, first_interval, label_intervals
from folio.plans.registry import query
from folio.runtime import read
from folio.sources import files

QA = "qa_stage2_adaptive_threshold_sweep_ratio0chk"
#: One row per result, genre in one spelling.
QA_SQL = f"""qa AS (SELECT result_id, max(threshold) AS threshold, coalesce(lower(trim(max(genre))), 'unknown') AS genre, max(question_id) AS question_id, max(CAST(correct AS INT)) = 1 AS correct, max(prediction) AS prediction,
 max(CAST(lookup_used AS INT)) = 1 AS lookup_used, max(elapsed_seconds) AS elapsed_seconds, max(total_tokens) AS total_tokens, max(prompt_tokens) AS prompt_tokens, max(run_at) AS run_at FROM {QA} GROUP BY result_id)"""


def qa(spark, d):
    cols = ("result_id", "threshold", "genre", "question_id", "correct", "prediction", "lookup_used", "elapsed_seconds", "total_tokens", "prompt_tokens", "run_at")
    m = read(spark, d, QA, *cols).groupBy("result_id").agg(*[F.max(c).alias(c) for c in cols[1:]])
    return m.withColumn("genre", F.coalesce(F.lower(F.trim("genre")), F.lit("unknown")))


def rounded(df, *names):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in (names or df.columns)])


@query("a01_accuracy", f"WITH {QA_SQL} SELECT genre, threshold, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, CAST(sum(CAST(correct AS BIGINT)) AS BIGINT) AS n_correct, CAST(count(*) AS BIGINT) AS n FROM qa GROUP BY genre, threshold")
def _(spark, d):
    return rounded(E.accuracy(qa(spark, d), ["genre", "threshold"]))


@query("a02_cost_score", f"WITH {QA_SQL} SELECT threshold, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(total_tokens), 6) AS avg_tokens, round(avg(CAST(lookup_used AS DOUBLE)), 6) AS lookup_rate, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(correct AS DOUBLE)) - 0.05 * avg(total_tokens) / 10000.0, 6) AS score FROM qa GROUP BY threshold")
def _(spark, d):
    return rounded(E.cost_score(qa(spark, d), ["threshold"]))


@query("a03_pivot", f"WITH {QA_SQL} SELECT genre, round(avg(CASE WHEN threshold = 0.75 THEN CAST(correct AS DOUBLE) END), 6) AS t075, round(avg(CASE WHEN threshold = 0.85 THEN CAST(correct AS DOUBLE) END), 6) AS t085, round(avg(CASE WHEN threshold = 0.9 THEN CAST(correct AS DOUBLE) END), 6) AS t090 FROM qa GROUP BY genre")
def _(spark, d):
    p = qa(spark, d).withColumn("c", F.col("correct").cast("double")).groupBy("genre").pivot("threshold", [0.75, 0.85, 0.9]).agg(F.avg("c"))
    return rounded(p.toDF("genre", "t075", "t085", "t090"))


@query("a04_pooled", f"WITH {QA_SQL} SELECT coalesce(genre, 'POOLED') AS genre, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM qa GROUP BY ROLLUP (genre)")
def _(spark, d):
    r = qa(spark, d).rollup("genre").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return rounded(r.withColumn("genre", F.coalesce("genre", F.lit("POOLED"))))


@query("a05_complete_groups", f"WITH {QA_SQL} SELECT question_id, CAST(count(*) AS BIGINT) AS n, bool_and(prediction IS NOT NULL) AS complete FROM qa WHERE question_id IS NOT NULL GROUP BY question_id HAVING count(*) >= 2")
def _(spark, d):
    return qa(spark, d).where("question_id is not null").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction").isNotNull()).alias("complete")).where("n >= 2")


@query("a06_distinct", f"WITH {QA_SQL} SELECT genre, CAST(count(DISTINCT question_id) AS BIGINT) AS n_questions, CAST(count(DISTINCT threshold) AS BIGINT) AS n_thresholds FROM qa GROUP BY genre")
def _(spark, d):
    return qa(spark, d).groupBy("genre").agg(F.countDistinct("question_id").alias("n_questions"), F.countDistinct("threshold").alias("n_thresholds"))


@query("a07_value_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return read(spark, d, "events", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a08_per_token", f"WITH {QA_SQL} SELECT genre, round(avg(CAST(correct AS DOUBLE)) / (avg(total_tokens) / 10000.0), 6) AS per_10k, round(10000.0 / avg(total_tokens), 6) AS inverse FROM qa GROUP BY genre")
def _(spark, d):
    a = qa(spark, d).groupBy("genre").agg(F.avg(F.col("correct").cast("double")).alias("a"), F.avg("total_tokens").alias("t"))
    return rounded(a.select("genre", (F.col("a") / (F.col("t") / 10000.0)).alias("per_10k"), (10000.0 / F.col("t")).alias("inverse")))


@query("a09_spread", f"WITH {QA_SQL} SELECT genre, min(elapsed_seconds) AS lo, max(elapsed_seconds) AS hi, round(avg(elapsed_seconds), 6) AS mean, round(median(elapsed_seconds), 6) AS mid, round(stddev_pop(elapsed_seconds), 6) AS sd FROM qa GROUP BY genre")
def _(spark, d):
    e = "elapsed_seconds"
    return rounded(qa(spark, d).groupBy("genre").agg(F.min(e).alias("lo"), F.max(e).alias("hi"), F.avg(e).alias("mean"), F.median(e).alias("mid"), F.stddev_pop(e).alias("sd")))


@query("a10_nearest_rank", "WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL) SELECT lang, max(CASE WHEN i = CAST(floor(0.5 * (n - 1)) AS BIGINT) THEN n_chars END) AS p50, max(CASE WHEN i = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN n_chars END) AS p95 FROM s GROUP BY lang")
def _(spark, d):
    w = Window.partitionBy("lang")
    s = read(spark, d, "documents", "doc_id", "lang", "n_chars").where("lang is not null").withColumn("i", F.row_number().over(w.orderBy("n_chars", "doc_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = lambda q: F.max(F.when(F.col("i") == F.floor(F.lit(q) * (F.col("n") - 1)), F.col("n_chars")))
    return s.groupBy("lang").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("a11_share_below", "SELECT doc_key, round(avg(CASE WHEN s < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT hit_id, max(doc_key) AS doc_key, max(score) AS s FROM hit GROUP BY hit_id) WHERE s IS NOT NULL GROUP BY doc_key")
def _(spark, d):
    h = read(spark, d, "hit", "hit_id", "doc_key", "score").groupBy("hit_id").agg(F.max("doc_key").alias("doc_key"), F.max("score").alias("s")).where("s is not null")
    return h.groupBy("doc_key").agg(F.round(F.avg((F.col("s") < 0.5).cast("double")), 6).alias("share"))


@query("a12_ordered_list", "SELECT doc_id, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY para_idx) AS lengths FROM (SELECT doc_id, para_idx, max(text) AS text FROM paragraph GROUP BY ALL) GROUP BY doc_id")
def _(spark, d):
    p = read(spark, d, "paragraph", "doc_id", "para_idx", "text").groupBy("doc_id", "para_idx").agg(F.length(F.max("text")).alias("n"))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "n"))), lambda x: x["n"].cast("string")), ",").alias("lengths"))


@query("a13_first_occurrence", "SELECT doc_slug, min(doc_id) AS first_id, CAST(dense_rank() OVER (ORDER BY min(doc_id)) AS BIGINT) AS place FROM documents GROUP BY doc_slug")
def _(spark, d):
    g = read(spark, d, "documents", "doc_id", "doc_slug").groupBy("doc_slug").agg(F.min("doc_id").alias("first_id"))
    from folio.operators.corpus import with_row_number

    return with_row_number(g, ["first_id"], "place").select("doc_slug", "first_id", (F.col("place") + 1).cast("long").alias("place"))


@query("a15_probe_accuracy", "WITH p AS (SELECT pair_id, max(chunk_position) AS pos, CASE WHEN contains(max(target_text), left(max(chunk_text), 10)) THEN 1.0 ELSE 0.0 END AS acc FROM stage2_pair GROUP BY pair_id HAVING max(target_text) IS NOT NULL AND max(chunk_text) IS NOT NULL) SELECT CAST(pos AS BIGINT) AS pos, round(avg(acc), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY pos")
def _(spark, d):
    p = read(spark, d, "stage2_pair", "pair_id", "chunk_position", "target_text", "chunk_text").groupBy("pair_id").agg(F.max("chunk_position").alias("pos"), F.max("target_text").alias("t"), F.max("chunk_text").alias("c"))
    p = p.where("t is not null and c is not null").withColumn("acc", F.contains("t", F.substring("c", 1, 10)).cast("double"))
    return rounded(p.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.avg("acc").alias("accuracy"), F.count(F.lit(1)).alias("n")))


_CONF = "c AS (SELECT result_id, CASE WHEN max(CAST(correct AS INT)) = 1 THEN 1 ELSE 0 END AS y, CASE WHEN max(CAST(lookup_used AS INT)) = 1 THEN 1 ELSE 0 END AS p FROM qa_stage2_adaptive_threshold_sweep_ratio0chk GROUP BY result_id), k AS (SELECT CAST(sum(y*p) AS BIGINT) AS tp, CAST(sum((1-y)*p) AS BIGINT) AS fp, CAST(sum(y*(1-p)) AS BIGINT) AS fn, CAST(sum((1-y)*(1-p)) AS BIGINT) AS tn, CAST(count(*) AS BIGINT) AS n FROM c)"


@query("a17_confusion", f"WITH {_CONF} SELECT tp, fp, fn, tn, n, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1, round((tp + tn) / n, 6) AS accuracy, round((tn + fp) / n, 6) AS all_zero_accuracy, round((tp + fn) / n, 6) AS positive_rate FROM k")
def _(spark, d):
    q = qa(spark, d).select(F.coalesce(F.col("correct").cast("int"), F.lit(0)).alias("label"), F.coalesce(F.col("lookup_used").cast("int"), F.lit(0)).alias("predicted"))
    return rounded(E.confusion(q))


@query("a18_ranking_report", """WITH h AS (SELECT hit_id, max(doc_key) AS doc_key, max(score) AS score, CASE WHEN max(chunk_idx) % 5 = 0 THEN 1 ELSE 0 END AS label FROM hit GROUP BY hit_id HAVING max(score) IS NOT NULL AND max(doc_key) IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY score DESC, hit_id) AS r, sum(label) OVER (PARTITION BY doc_key ORDER BY score DESC, hit_id ROWS UNBOUNDED PRECEDING) AS hits FROM h),
g AS (SELECT doc_key, sum(CASE WHEN r <= 5 THEN label ELSE 0 END) AS top, sum(label) AS pos, count(*) AS n, sum(CASE WHEN label = 1 THEN hits / r ELSE 0 END) AS ap FROM r GROUP BY doc_key HAVING sum(label) > 0)
SELECT doc_key, round(top / 5, 6) AS precision_at_k, round(top / pos, 6) AS recall_at_k, round(least(1.0, pos / 5), 6) AS ceiling, round(pos / n, 6) AS chance, round(ap / pos, 6) AS average_precision FROM g""")
def _(spark, d):
    h = read(spark, d, "hit", "hit_id", "doc_key", "score", "chunk_idx").groupBy("hit_id").agg(F.max("doc_key").alias("doc_key"), F.max("score").alias("score"), F.max("chunk_idx").alias("c")).where("score is not null and doc_key is not null")
    return rounded(E.ranking_report(h.withColumn("label", (F.col("c") % 5 == 0).cast("int")), "doc_key", 5, item="hit_id"))


@query("a20_paired_transitions", f"""WITH {QA_SQL}, o AS (SELECT question_id, threshold, max(CAST(correct AS INT)) AS c FROM qa WHERE correct IS NOT NULL AND question_id IS NOT NULL AND threshold IS NOT NULL GROUP BY ALL),
f AS (SELECT question_id FROM o GROUP BY question_id HAVING count(*) = (SELECT count(DISTINCT threshold) FROM o)), k AS (SELECT * FROM o WHERE question_id IN (SELECT question_id FROM f))
SELECT a.threshold AS a, b.threshold AS b, CAST(sum(CASE WHEN a.c = 1 AND b.c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN a.c = 0 AND b.c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS gained, CAST(sum(b.c - a.c) AS BIGINT) AS net, CAST(count(*) AS BIGINT) AS n FROM k a JOIN k b ON a.question_id = b.question_id AND a.threshold < b.threshold GROUP BY a.threshold, b.threshold""")
def _(spark, d):
    return E.paired(qa(spark, d).where("question_id is not null"), "question_id", "threshold")


@query("a21_fixed_cohort", f"WITH {QA_SQL} SELECT threshold, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM qa WHERE question_id IN (SELECT question_id FROM qa WHERE threshold = 0.75 AND correct) AND threshold >= 0.75 GROUP BY threshold")
def _(spark, d):
    q = qa(spark, d)
    base = q.where("threshold = 0.75 and correct").select("question_id").distinct()
    k = q.join(base, "question_id", "left_semi").where("threshold >= 0.75")
    return rounded(k.groupBy("threshold").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")))


_BIN = "CASE WHEN {0} <= 0.2 THEN 10 WHEN {0} <= 0.4 THEN 30 WHEN {0} <= 0.6 THEN 50 WHEN {0} <= 0.8 THEN 70 ELSE 90 END"


@query("a22_binned_accuracy", f"WITH {QA_SQL}, b AS (SELECT {_BIN.format('least(1.0, elapsed_seconds / 20.0)')} AS bin, correct FROM qa WHERE elapsed_seconds IS NOT NULL) SELECT CAST(bin AS BIGINT) AS bin, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bin")
def _(spark, d):
    q = qa(spark, d).where("elapsed_seconds is not null").withColumn("x", F.least(F.lit(1.0), F.col("elapsed_seconds") / 20.0))
    q = q.withColumn("bin", F.expr(_BIN.format("x")).cast("long"))
    return rounded(q.groupBy("bin").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")))


@query("a23_evidence_fraction", "SELECT p.doc_id, p.para_idx, round(p.char_offset / nullif(d.n_chars, 0), 6) AS fraction FROM (SELECT DISTINCT doc_id, para_idx, char_offset FROM paragraph) p JOIN documents d USING (doc_id)")
def _(spark, d):
    p = read(spark, d, "paragraph", "doc_id", "para_idx", "char_offset").distinct()
    return p.join(read(spark, d, "documents", "doc_id", "n_chars"), "doc_id").select("doc_id", "para_idx", F.round(F.try_divide(F.col("char_offset").cast("double"), F.col("n_chars")), 6).alias("fraction"))


@query("a25_recovered", f"WITH {QA_SQL}, w AS (SELECT question_id, max(CASE WHEN threshold = 0.75 THEN CAST(correct AS INT) END) AS a, max(CASE WHEN threshold = 0.9 THEN CAST(correct AS INT) END) AS b FROM qa WHERE question_id IS NOT NULL GROUP BY question_id) SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS recovered, CAST(sum(CASE WHEN a = 0 AND b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS still_wrong FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    at = lambda t: F.max(F.when(F.col("threshold") == t, F.col("correct").cast("int")))
    w = qa(spark, d).where("question_id is not null").groupBy("question_id").agg(at(0.75).alias("a"), at(0.9).alias("b")).where("a is not null and b is not null")
    s = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return w.agg(F.count(F.lit(1)).alias("n"), s((F.col("a") == 0) & (F.col("b") == 1)).alias("recovered"), s((F.col("a") == 0) & (F.col("b") == 0)).alias("still_wrong"))


@query("a30_memory_stats", "WITH m AS (SELECT slot_id, max(doc_key) AS doc_key, max(revisions) AS r, max(merges) AS g, max(origin_indices) AS o FROM memory_slot GROUP BY slot_id) SELECT doc_key, CAST(count(*) AS BIGINT) AS n_slots, CAST(sum(r) AS BIGINT) AS revisions, CAST(sum(g) AS BIGINT) AS merges, round(avg(coalesce(len(o), 0)), 6) AS mean_origins FROM m GROUP BY doc_key")
def _(spark, d):
    m = read(spark, d, "memory_slot", "slot_id", "doc_key", "revisions", "merges", "origin_indices").groupBy("slot_id").agg(*[F.max(c).alias(c) for c in ("doc_key", "revisions", "merges", "origin_indices")])
    n = F.when(F.col("origin_indices").isNotNull(), F.size("origin_indices")).otherwise(0)
    return rounded(m.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n_slots"), F.sum("revisions").alias("revisions"), F.sum("merges").alias("merges"), F.avg(n).alias("mean_origins")))


# --- joins ---------------------------------------------------------------------------------------------------


@query("j01_inner", "SELECT o_orderkey, c_name, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_name")
def _(spark, d):
    n = read(spark, d, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))  # before the join
    o = read(spark, d, "orders", "o_orderkey", "o_custkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.join(read(spark, d, "customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n")


@query("j02_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return read(spark, d, "customer", "c_custkey").join(read(spark, d, "orders", F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("j03_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM paragraph)")
def _(spark, d):
    return read(spark, d, "documents", "doc_id").join(read(spark, d, "paragraph", "doc_id"), "doc_id", "left_anti")


_CH = "c AS (SELECT doc_id, chunk_idx, max(char_start) AS s, max(char_end) AS e FROM chunk GROUP BY ALL), p AS (SELECT doc_id, para_idx, max(char_offset) AS pos FROM paragraph GROUP BY ALL)"


def _points(spark, d):
    p = read(spark, d, "paragraph", "doc_id", "para_idx", "char_offset").groupBy("doc_id", "para_idx").agg(F.max("char_offset").alias("pos"))
    c = read(spark, d, "chunk", "doc_id", "chunk_idx", "char_start", "char_end").groupBy("doc_id", "chunk_idx").agg(F.max("char_start").alias("start"), F.max("char_end").alias("end"))
    return p, c


@query("j04_point_in_interval", f"WITH {_CH} SELECT p.doc_id, p.para_idx, min(c.chunk_idx) AS chunk_idx FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND c.s <= p.pos AND p.pos < c.e GROUP BY p.doc_id, p.para_idx")
def _(spark, d):
    p, c = _points(spark, d)
    return first_interval(p, c, ["doc_id"], ["para_idx"], order="chunk_idx").select("doc_id", "para_idx", "chunk_idx")


@query("j05_label_intervals", f"WITH {_CH} SELECT c.doc_id, c.chunk_idx, CAST(CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.doc_id = c.doc_id AND p.para_idx % 3 = 0 AND c.s <= p.pos AND p.pos < c.e) THEN 1 ELSE 0 END AS BIGINT) AS label FROM c")
def _(spark, d):
    p, c = _points(spark, d)
    return label_intervals(c, p.where("para_idx % 3 = 0"), ["doc_id"], ["chunk_idx"]).select("doc_id", "chunk_idx", "label")


@query("j06_sentence_in_chunk", f"WITH {_CH} SELECT p.doc_id, p.para_idx, CAST(p.pos - c.s AS BIGINT) AS local_pos FROM p JOIN c ON p.doc_id = c.doc_id AND c.s <= p.pos AND p.pos < c.e")
def _(spark, d):
    from folio.operators.rangejoin import point_in_interval

    p, c = _points(spark, d)
    return point_in_interval(p, c, ["doc_id"]).select("doc_id", "para_idx", (F.col("pos") - F.col("start")).alias("local_pos"))


@query("j09_closest_pair", "WITH m AS (SELECT slot_id, max(doc_key) AS k, max(embedding) AS e FROM memory_slot GROUP BY slot_id), p AS (SELECT a.k, a.slot_id AS a, b.slot_id AS b, round(list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])), 8) AS s FROM m a JOIN m b ON a.k = b.k AND a.slot_id < b.slot_id WHERE a.e IS NOT NULL AND b.e IS NOT NULL) SELECT k AS doc_key, a, b, round(s, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, a, b) = 1")
def _(spark, d):
    """Closest pair of slots of each document. Quadratic within a document's slots by definition; the per-row best is
    kept in blocks, so that no list of pairs is held."""
    from folio.plans.helpers import closest_pairs

    m = read(spark, d, "memory_slot", "slot_id", "doc_key", "embedding").groupBy("slot_id").agg(F.max("doc_key").alias("doc_key"), F.max("embedding").alias("vec")).where("vec is not null and doc_key is not null")
    return closest_pairs(m)


@query("j10_left_default", "SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT doc_id, CAST(count(DISTINCT para_idx) AS BIGINT) AS n FROM paragraph GROUP BY doc_id) USING (doc_id)")
def _(spark, d):
    n = read(spark, d, "paragraph", "doc_id", "para_idx").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return read(spark, d, "documents", "doc_id").join(n, "doc_id", "left").fillna(0, ["n"])


@query("j11_zip", "WITH m AS (SELECT slot_id, max(origin_indices) AS o FROM memory_slot GROUP BY slot_id), u AS (SELECT slot_id, unnest(range(len(o))) AS i, o FROM m WHERE len(o) > 0) SELECT slot_id, CAST(i AS BIGINT) AS i, o[i+1] AS v FROM u")
def _(spark, d):
    m = read(spark, d, "memory_slot", "slot_id", "origin_indices").groupBy("slot_id").agg(F.max("origin_indices").alias("o"))
    return m.select("slot_id", F.posexplode("o").alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@query("j13_as_of", "SELECT e.event_id, max_by(q.result_id, q.run_at) AS result_id FROM events e LEFT JOIN (SELECT max(result_id) AS result_id, run_at FROM qa_stage2_adaptive_threshold_sweep_ratio0chk WHERE run_at IS NOT NULL GROUP BY run_at) q ON q.run_at <= e.ts AND date_trunc('day', q.run_at) = date_trunc('day', e.ts) GROUP BY e.event_id")
def _(spark, d):
    """Each event with the latest result of its day."""
    e = read(spark, d, "events", "event_id", "ts").withColumn("day", F.to_date("ts"))
    q = read(spark, d, QA, "result_id", "run_at").where("run_at is not null").groupBy("run_at").agg(F.max("result_id").alias("result_id")).withColumn("day", F.to_date("run_at"))
    return as_of(e, q, ["day"], "ts", "run_at", "result_id").select("event_id", "result_id")


# --- windows and sets ----------------------------------------------------------------------------------------


@query("w01_prefix_sums", "WITH u AS (SELECT doc_id, unit_idx, max(word_count) AS w FROM semantic_unit GROUP BY ALL) SELECT doc_id, unit_idx, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY unit_idx) AS BIGINT) AS cum FROM u")
def _(spark, d):
    u = read(spark, d, "semantic_unit", "doc_id", "unit_idx", "word_count").groupBy("doc_id", "unit_idx").agg(F.max("word_count").alias("w"))
    return u.select("doc_id", "unit_idx", F.sum("w").over(Window.partitionBy("doc_id").orderBy("unit_idx")).alias("cum"))


@query("w02_adjacent", f"WITH {QA_SQL}, a AS (SELECT genre, threshold, round(avg(CAST(correct AS DOUBLE)), 9) AS acc FROM qa WHERE threshold IS NOT NULL GROUP BY ALL) SELECT genre, threshold, lead(acc) OVER (PARTITION BY genre ORDER BY threshold) >= acc - 1e-9 AS rises FROM a")
def _(spark, d):
    a = qa(spark, d).where("threshold is not null").groupBy("genre", "threshold").agg(F.round(F.avg(F.col("correct").cast("double")), 9).alias("acc"))
    return a.select("genre", "threshold", (F.lead("acc").over(Window.partitionBy("genre").orderBy("threshold")) >= F.col("acc") - 1e-9).alias("rises"))


@query("w04_renumber", "SELECT doc_id, para_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY max(char_offset), para_idx) AS BIGINT) AS n FROM paragraph GROUP BY doc_id, para_idx")
def _(spark, d):
    p = read(spark, d, "paragraph", "doc_id", "para_idx", "char_offset").groupBy("doc_id", "para_idx").agg(F.max("char_offset").alias("o"))
    return p.select("doc_id", "para_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "para_idx")).cast("long").alias("n"))


@query("w08_runs", "WITH s AS (SELECT DISTINCT doc_key, chunk_idx FROM hit WHERE chunk_idx IS NOT NULL), g AS (SELECT *, chunk_idx - row_number() OVER (PARTITION BY doc_key ORDER BY chunk_idx) AS g FROM s) SELECT doc_key, min(chunk_idx) AS first, max(chunk_idx) AS last, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY doc_key, g")
def _(spark, d):
    s = read(spark, d, "hit", "doc_key", "chunk_idx").where("chunk_idx is not null").distinct()
    s = s.withColumn("g", F.col("chunk_idx") - F.row_number().over(Window.partitionBy("doc_key").orderBy("chunk_idx")))
    return s.groupBy("doc_key", "g").agg(F.min("chunk_idx").alias("first"), F.max("chunk_idx").alias("last"), F.count(F.lit(1)).alias("n")).drop("g")


@query("u01_union_by_name", "SELECT gist_id AS id, genre, CAST(NULL AS BIGINT) AS slot FROM teacher_gists_anticollapse_wiki20_pilot UNION ALL SELECT hit_id AS id, NULL AS genre, CAST(slot AS BIGINT) AS slot FROM hit")
def _(spark, d):
    g = read(spark, d, "teacher_gists_anticollapse_wiki20_pilot", F.col("gist_id").alias("id"), "genre")
    return g.unionByName(read(spark, d, "hit", F.col("hit_id").alias("id"), F.col("slot").cast("long").alias("slot")), allowMissingColumns=True)


@query("u02_set_algebra", "SELECT 'both' AS kind, doc_key FROM (SELECT doc_key FROM hit INTERSECT SELECT doc_key FROM memory_slot) UNION ALL SELECT 'hit_only' AS kind, doc_key FROM (SELECT doc_key FROM hit EXCEPT SELECT doc_key FROM memory_slot)")
def _(spark, d):
    h, m = read(spark, d, "hit", "doc_key"), read(spark, d, "memory_slot", "doc_key")
    return h.intersect(m).select(F.lit("both").alias("kind"), "doc_key").unionByName(h.subtract(m).select(F.lit("hit_only").alias("kind"), "doc_key"))


@query("u04_first_wins", "SELECT doc_slug, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY doc_slug ORDER BY doc_id) = 1")
def _(spark, d):
    from folio.operators.corpus import first_of_each

    return first_of_each(read(spark, d, "documents", "doc_id", "doc_slug", "source"), ["doc_slug"], "doc_id").select("doc_slug", "doc_id", "source")


@query("u05_replicated", "SELECT e.item_id, t.threshold FROM eval_item e, (SELECT DISTINCT threshold FROM qa_stage2_adaptive_threshold_sweep_ratio0chk WHERE threshold IS NOT NULL) t WHERE length(e.passage) / 300.0 <= t.threshold * 1.2")
def _(spark, d):
    t = read(spark, d, QA, "threshold").where("threshold is not null").groupBy().agg(F.array_sort(F.collect_set("threshold")).alias("ts"))  # a few rungs
    e = read(spark, d, "eval_item", "item_id", "passage").crossJoin(F.broadcast(t))
    return e.select("item_id", "passage", F.explode("ts").alias("threshold")).where(F.length("passage") / 300.0 <= F.col("threshold") * 1.2).select("item_id", "threshold")


@query("s14_todo", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    done = read(spark, d, "lineitem", "l_orderkey", "l_quantity").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.todo(read(spark, d, "orders", "o_orderkey"), done, ["o_orderkey"])


@query("s15_fingerprint", "SELECT item_id, left(sha1(question || passage), 10) AS mark FROM eval_item")
def _(spark, d):
    return read(spark, d, "eval_item", "item_id", "question", "passage").select("item_id", files.fingerprint(F.col("question"), F.col("passage")).alias("mark"))


@query("s06_last_wins", f"SELECT result_id, logged_at FROM {QA} QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY logged_at DESC) = 1")
def _(spark, d):
    return files.last_wins(read(spark, d, QA, "result_id", "logged_at"), ["result_id"], ["logged_at"])


@query("s08_row_slice", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 20 AND i < 80")
def _(spark, d):
    return files.row_slice(read(spark, d, "documents", "doc_id"), ["doc_id"], 20, 80)


@query("r19_sorted_report", f"WITH {QA_SQL} SELECT genre, CAST(count(*) AS BIGINT) AS n FROM qa GROUP BY genre ORDER BY n DESC, genre")
def _(spark, d):
    return qa(spark, d).groupBy("genre").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "genre")


@query("f01_compound_filter", f"WITH {QA_SQL} SELECT result_id FROM qa WHERE threshold >= 0.85 AND genre = 'news' AND total_tokens > 1000")
def _(spark, d):
    return qa(spark, d).where((F.col("threshold") >= 0.85) & (F.col("genre") == "news") & (F.col("total_tokens") > 1000)).select("result_id")


@query("f02_membership", f"WITH {QA_SQL} SELECT result_id FROM qa WHERE genre IN ('novel', 'caselaw')")
def _(spark, d):
    return qa(spark, d).where(F.col("genre").isin("novel", "caselaw")).select("result_id")


@query("f03_drop_nulls", f"SELECT result_id, CAST(count(*) AS BIGINT) AS n FROM {QA} WHERE prediction IS NOT NULL AND prompt_tokens IS NOT NULL GROUP BY result_id")
def _(spark, d):
    return read(spark, d, QA, "result_id", "prediction", "prompt_tokens").na.drop(subset=["prediction", "prompt_tokens"]).groupBy("result_id").agg(F.count(F.lit(1)).alias("n"))


_SCORES = "s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label AS label, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 10) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"


@query("j07_queries_by_items", f"WITH {_SCORES} SELECT query_id, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean FROM s GROUP BY query_id")
def _(spark, d):
    from folio.plans.catalog_vector import scored

    return rounded(scored(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")))


@query("j08_other_items", f"WITH {_SCORES} SELECT query_id, label, max(item_id) AS last_item FROM s WHERE score > 0 GROUP BY query_id, label")
def _(spark, d):
    from folio.plans.catalog_vector import scored

    return scored(spark, d).where("score > 0").groupBy("query_id", "label").agg(F.max("item_id").alias("last_item"))


@query("j12_seams_in_selection", "WITH c AS (SELECT doc_id, chunk_idx FROM chunk GROUP BY ALL HAVING max(length(text)) > 500) SELECT p.doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, para_idx, max(CAST(is_scene_break AS INT)) AS b FROM paragraph GROUP BY ALL) p WHERE b IS NOT NULL AND doc_id IN (SELECT doc_id FROM c) GROUP BY p.doc_id")
def _(spark, d):
    big = read(spark, d, "chunk", "doc_id", "chunk_idx", "text").groupBy("doc_id", "chunk_idx").agg(F.max(F.length("text")).alias("n")).where("n > 500").select("doc_id")
    p = read(spark, d, "paragraph", "doc_id", "para_idx", "is_scene_break").groupBy("doc_id", "para_idx").agg(F.max("is_scene_break").alias("b")).where("b is not null")
    return p.join(big, "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("a19_positive_rate", "WITH h AS (SELECT hit_id, max(score) AS s FROM hit GROUP BY hit_id) SELECT round(sum(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM h WHERE s IS NOT NULL")
def _(spark, d):
    h = read(spark, d, "hit", "hit_id", "score").groupBy("hit_id").agg(F.max("score").alias("s")).where("s is not null")
    return h.agg(F.round(F.avg((F.col("s") >= 0.5).cast("double")), 6).alias("rate"))


_HITS = "h AS (SELECT hit_id, max(doc_key) AS doc_key, max(score) AS score, CASE WHEN max(chunk_idx) % 5 = 0 THEN 1 ELSE 0 END AS label FROM hit GROUP BY hit_id HAVING max(score) IS NOT NULL AND max(doc_key) IS NOT NULL)"


@query("w12_cumulative_hits", f"WITH {_HITS} SELECT hit_id, CAST(sum(label) OVER (PARTITION BY doc_key ORDER BY score DESC, hit_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hits FROM h")
def _(spark, d):
    h = read(spark, d, "hit", "hit_id", "doc_key", "score", "chunk_idx").groupBy("hit_id").agg(F.max("doc_key").alias("doc_key"), F.max("score").alias("score"), F.max("chunk_idx").alias("c")).where("score is not null and doc_key is not null")
    w = Window.partitionBy("doc_key").orderBy(F.desc("score"), "hit_id").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("hit_id", F.sum((F.col("c") % 5 == 0).cast("long")).over(w).alias("hits"))


@query("w11_cumulative_mass", f"WITH {_SCORES}, e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.5) AS e FROM s), m AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS w FROM e) SELECT query_id, item_id, round(sum(w) OVER (PARTITION BY query_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING), 6) AS mass FROM m")
def _(spark, d):
    from folio.functions.vector import softmax
    from folio.plans.catalog_vector import scored

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id").rowsBetween(Window.unboundedPreceding, 0)
    return scored(spark, d).withColumn("w", softmax(F.col("score"), ["query_id"], 0.5)).select("query_id", "item_id", F.round(F.sum("w").over(w), 6).alias("mass"))


@query("s03_written_and_read", "SELECT item_id, question, answer FROM eval_item")
def _(spark, d):
    """Questions written as CSV to the shared folder and read back with their schema."""
    from folio.runtime import shared_folder

    path = shared_folder(spark, "questions")
    files.write_csv(read(spark, d, "eval_item", "item_id", "question", "answer"), path)
    return files.read_csv(spark, path, "item_id long, question string, answer string")


@query("s05_json_round_trip", "SELECT item_id, lang, passage FROM eval_item")
def _(spark, d):
    from folio.runtime import shared_folder

    path = shared_folder(spark, "items")
    files.append_log(read(spark, d, "eval_item", "item_id", "lang", "passage"), path)
    return files.read_log(spark, path, "item_id long, lang string, passage string", "item_id", "passage")
