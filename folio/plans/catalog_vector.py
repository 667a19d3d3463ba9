"""Queries over vectors: scoring, selection, fusion, and the retrieval conditions composed of them.

Queries are the vectors whose id is divisible by 100, items are all others; ``label`` stands for the document a vector
belongs to and ``vec_id`` for its place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import vector as V
from folio.operators import select as R
from folio.operators.evaluate import seams
from folio.plans.registry import query
from folio.runtime import read

COS = "round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 10)"
SCORED = f"scored AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label AS label, {COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"
RANKED = f"{SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM scored)"
ADAPTIVE = f"{RANKED}, adaptive AS (SELECT * FROM ranked WHERE rank <= 40 AND (rank = 1 OR (top > 0 AND score >= top * 0.85)))"


def scored(spark: SparkSession, d: str, relative: float | None = None) -> DataFrame:
    """query_id, item_id, label, score; only what can be within ``relative`` of the query's best score, if that is given."""
    e = read(spark, d, "embeddings", "vec_id", "embedding", "label")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return V.score_all(items, queries, relative).where("query_id <> item_id").select("query_id", "item_id", "label", "score")


def out(df: DataFrame, *cols: str) -> DataFrame:
    """Ids and ranks as BIGINT, scores to six digits."""
    keep = cols or tuple(df.columns)
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in keep])


@query("v01_cosine", f"SELECT a.vec_id, b.vec_id AS next_id, round({COS}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = read(spark, d, "embeddings", "vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", "next_id", F.round(F.round(V.cosine(F.col("embedding"), F.col("other")), 10), 6).alias("score"))


@query("v02_score_all", f"WITH {RANKED} SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM ranked")
def _(spark, d):
    return out(R.ranked(scored(spark, d), ["query_id"]), "query_id", "item_id", "score", "rank")


@query("v03_centroid_score", """WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
v AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY label)
SELECT vec_id, round(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v.c), 9), 6) AS score FROM embeddings JOIN v USING (label)""")
def _(spark, d):
    e = read(spark, d, "embeddings", "vec_id", "embedding", "label")
    x = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return e.join(c, "label").select("vec_id", F.round(F.round(V.cosine(F.col("embedding"), F.col("c")), 9), 6).alias("score"))


@query("v05_softmax", f"WITH {SCORED}, e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.5) AS e FROM scored) SELECT query_id, item_id, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS weight FROM e")
def _(spark, d):
    return out(scored(spark, d).withColumn("weight", V.softmax(F.col("score"), ["query_id"], 0.5)), "query_id", "item_id", "weight")


@query("v06_nearest_in_document", f"WITH p AS (SELECT a.vec_id, b.vec_id AS nearest, {COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id WHERE a.vec_id % 100 = 0) SELECT vec_id, nearest, round(s, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nearest) = 1")
def _(spark, d):
    """Snapping: the most similar earlier item of the same document."""
    e = read(spark, d, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    s = scored(spark, d).join(e, "query_id").where("label = own and item_id < query_id")
    return R.top_k(s, ["query_id"], 1).select(F.col("query_id").alias("vec_id"), F.col("item_id").alias("nearest"), F.round("score", 6).alias("score"))


@query("r01_top_k", f"WITH {RANKED} SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 3")
def _(spark, d):
    return out(R.top_k(scored(spark, d), ["query_id"], 3), "query_id", "item_id", "score", "rank")


@query("r02_related", f"WITH {RANKED} SELECT query_id, item_id, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 2")
def _(spark, d):
    return out(R.top_k(scored(spark, d), ["query_id"], 2), "query_id", "item_id", "rank")


@query("r03_adaptive_k", f"WITH {ADAPTIVE} SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM adaptive")
def _(spark, d):
    return out(R.adaptive_k(scored(spark, d, 0.85), ["query_id"]), "query_id", "item_id", "score", "rank")


@query("c08_rag_adaptive_k", f"WITH {ADAPTIVE} SELECT query_id, item_id, label, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM adaptive")
def _(spark, d):
    """The retrieval baseline: everything scored, adaptive cut-off."""
    return out(R.adaptive_k(scored(spark, d, 0.85), ["query_id"]), "query_id", "item_id", "label", "score", "rank")


_BUDGET = f"{SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, item_id) AS rank, count(*) OVER (PARTITION BY query_id, label) AS n FROM scored), kept AS (SELECT *, rank <= greatest(1, ceil(round(0.3 * n, 9))) AS kept FROM b)"


@query("r04_ratio_budget", f"WITH {_BUDGET} SELECT query_id, item_id, label FROM kept WHERE kept")
def _(spark, d):
    return out(R.ratio_budget(scored(spark, d), ["query_id", "label"], 0.3).where("kept"), "query_id", "item_id", "label")


_PADDED = f"{_BUDGET}, padded AS (SELECT *, max(CAST(kept AS INT)) OVER (PARTITION BY query_id, label ORDER BY item_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS padded FROM kept)"


@query("r05_windowed_budget", f"WITH {_PADDED} SELECT query_id, item_id, label, kept FROM padded WHERE padded")
def _(spark, d):
    return out(R.pad(R.ratio_budget(scored(spark, d), ["query_id", "label"], 0.3), ["query_id", "label"], 1).where("padded"), "query_id", "item_id", "label", "kept")


@query("w07_neighbours", f"WITH {ADAPTIVE}, f AS (SELECT s.*, a.item_id IS NOT NULL AS kept FROM scored s LEFT JOIN adaptive a USING (query_id, item_id)), p AS (SELECT *, max(CAST(kept AS INT)) OVER (PARTITION BY query_id, label ORDER BY item_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM f) SELECT query_id, item_id, kept FROM p WHERE p = 1")
def _(spark, d):
    return out(R.pad(R.adaptive_flag(scored(spark, d), ["query_id"]), ["query_id", "label"], 2).where("padded"), "query_id", "item_id", "kept")


@query("r06_threshold_or_top", f"WITH {RANKED} SELECT query_id, item_id, round(score, 6) AS score FROM ranked WHERE (rank <= 3 AND score >= 0.35) OR (rank = 1 AND score < 0.35)")
def _(spark, d):
    return out(R.threshold_or_top(scored(spark, d), ["query_id"], 0.35, 3), "query_id", "item_id", "score")


_THREADS = f"{SCORED}, t AS (SELECT query_id, label AS item_id, max(score) AS score, count(*) AS n_words FROM scored GROUP BY query_id, label)"


def _threads(spark, d):
    """Documents as threads, scored by their best item."""
    return scored(spark, d).groupBy("query_id", F.col("label").cast("long").alias("item_id")).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_words"))


@query("r07_nucleus", f"WITH {_THREADS}, e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.5) AS e FROM t), w AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS w FROM e), c AS (SELECT *, sum(w) OVER (PARTITION BY query_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING) AS cum FROM w) SELECT query_id, CAST(item_id AS BIGINT) AS item_id, round(w, 6) AS weight FROM c WHERE round(cum - w, 12) < 0.8")
def _(spark, d):
    return out(R.nucleus(_threads(spark, d), ["query_id"]), "query_id", "item_id", "weight")


_WEIGHTED = f"{_THREADS}, e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.5) AS e FROM t), w AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS w FROM e), z AS (SELECT *, CASE WHEN w < max(w) OVER (PARTITION BY query_id) * 0.05 THEN 0 ELSE w END AS z FROM w), budget AS (SELECT *, CAST(round_even(round(z / sum(z) OVER (PARTITION BY query_id) * 250, 9), 0) AS BIGINT) AS budget FROM z)"


@query("r08_weighted_budget", f"WITH {_WEIGHTED} SELECT query_id, CAST(item_id AS BIGINT) AS item_id, budget FROM budget")
def _(spark, d):
    return out(R.weighted_budget(_threads(spark, d), ["query_id"], 250), "query_id", "item_id", "budget")


@query("r09_fill_budget", f"WITH {_WEIGHTED}, m AS (SELECT s.query_id, s.label, s.item_id, CAST(s.item_id % 7 + 1 AS BIGINT) AS n_words, b.budget FROM scored s JOIN budget b ON s.query_id = b.query_id AND s.label = b.item_id), c AS (SELECT *, sum(n_words) OVER (PARTITION BY query_id, label ORDER BY item_id ROWS UNBOUNDED PRECEDING) - n_words AS before FROM m) SELECT query_id, item_id, CAST(greatest(0, least(n_words, budget - before)) AS BIGINT) AS take FROM c WHERE budget - before > 0")
def _(spark, d):
    s = scored(spark, d).withColumn("label", F.col("label").cast("long")).withColumn("n_words", F.col("item_id") % 7 + 1)
    b = R.weighted_budget(_threads(spark, d), ["query_id"], 250).select("query_id", F.col("item_id").alias("label"), "budget")
    return R.fill_budget(s.join(b, ["query_id", "label"]), ["query_id", "label"], F.col("budget")).where("take > 0").select("query_id", "item_id", "take")


@query("r10_rank_fusion", f"WITH {RANKED}, r2 AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_id DESC) AS rank FROM scored), u AS (SELECT query_id, item_id, rank FROM ranked UNION ALL SELECT query_id, item_id, rank FROM r2) SELECT query_id, item_id, round(sum(1.0 / (60 + rank)), 6) AS fused FROM u GROUP BY query_id, item_id")
def _(spark, d):
    other = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("item_id")))
    s = R.ranked(scored(spark, d), ["query_id"]).withColumn("other", other)
    return out(R.fused_ranks(s, [F.col("rank"), F.col("other")]), "query_id", "item_id", "fused")


@query("c16_combined_rank_fusion", f"WITH {RANKED}, r2 AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS rank FROM scored), u AS (SELECT query_id, item_id, rank FROM ranked UNION ALL SELECT query_id, item_id, rank FROM r2), f AS (SELECT query_id, item_id, round(sum(1.0 / (60 + rank)), 9) AS fused FROM u GROUP BY query_id, item_id) SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, item_id) AS BIGINT) AS rank FROM f QUALIFY rank <= 60")
def _(spark, d):
    s = R.ranked(scored(spark, d), ["query_id"]).withColumn("other", F.row_number().over(Window.partitionBy("query_id").orderBy("item_id")))
    fused = R.fused_ranks(s, [F.col("rank"), F.col("other")]).withColumn("fused", F.round("fused", 9)).drop("rank", "other")
    return out(R.top_k(fused, ["query_id"], 60, "fused"), "query_id", "item_id", "rank")


@query("r12_minmax", f"WITH {SCORED}, m AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM scored) SELECT query_id, item_id, round(CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (score - lo) / (hi - lo) END, 6) AS scaled FROM m")
def _(spark, d):
    return out(scored(spark, d).withColumn("scaled", R.minmax(F.col("score"), ["query_id"])), "query_id", "item_id", "scaled")


_FUSE = f"{SCORED}, m AS (SELECT *, (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) AS q, (item_id % 11) / 10.0 AS i FROM scored), f AS (SELECT *, round(0.5 * q + 0.5 * i, 9) AS fused FROM m)"


@query("c23_hybrid_criterion", f"WITH {_FUSE} SELECT query_id, item_id, round(fused, 6) AS fused FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, item_id) <= 60")
def _(spark, d):
    s = scored(spark, d).withColumn("fused", F.round(0.5 * R.minmax(F.col("score"), ["query_id"]) + 0.5 * (F.col("item_id") % 11) / 10.0, 9))
    return out(R.top_k(s, ["query_id"], 60, "fused"), "query_id", "item_id", "fused")


@query("r13_union_of_selections", f"WITH {ADAPTIVE} SELECT query_id, item_id FROM adaptive UNION SELECT query_id, item_id FROM ranked WHERE score >= 0.3")
def _(spark, d):
    return R.adaptive_flag(scored(spark, d), ["query_id"]).where("kept or score >= 0.3").select("query_id", "item_id")


@query("r15_targets_and_adaptive", f"WITH {ADAPTIVE}, u AS (SELECT query_id, item_id FROM adaptive UNION SELECT query_id, item_id FROM scored WHERE abs(item_id - query_id) <= 1) SELECT query_id, item_id FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY item_id) <= 40")
def _(spark, d):
    u = R.adaptive_flag(scored(spark, d), ["query_id"]).where("kept or abs(item_id - query_id) <= 1").select("query_id", "item_id")
    w = Window.partitionBy("query_id").orderBy("item_id")
    return u.withColumn("r", F.row_number().over(w)).where("r <= 40").drop("r")


_RATIO = f"{SCORED}, s AS (SELECT query_id, label, round(stddev_pop(score), 10) AS spread FROM scored GROUP BY query_id, label), ratio AS (SELECT *, greatest(0.15, least(0.8, 0.3 + 0.3 * (0.5 - cume_dist() OVER (PARTITION BY query_id ORDER BY spread)) * 2)) AS ratio FROM s)"


def _ratios(spark, d):
    s = scored(spark, d).groupBy("query_id", "label").agg(F.round(F.stddev_pop("score"), 10).alias("spread"))
    return R.density_ratio(s, ["query_id"], "spread")


@query("r16_density_ratio", f"WITH {_RATIO} SELECT query_id, label, round(ratio, 6) AS ratio FROM ratio")
def _(spark, d):
    return out(_ratios(spark, d), "query_id", "label", "ratio")


@query("w06_percentile_rank", f"WITH {SCORED}, s AS (SELECT query_id, label, round(stddev_pop(score), 10) AS spread FROM scored GROUP BY query_id, label) SELECT query_id, label, round(cume_dist() OVER (PARTITION BY query_id ORDER BY spread), 6) AS p FROM s")
def _(spark, d):
    s = scored(spark, d).groupBy("query_id", "label").agg(F.round(F.stddev_pop("score"), 10).alias("spread"))
    return out(s.withColumn("p", F.cume_dist().over(Window.partitionBy("query_id").orderBy("spread"))), "query_id", "label", "p")


@query("c17_density_adaptive", f"WITH {_RATIO}, b AS (SELECT s.*, r.ratio, row_number() OVER (PARTITION BY s.query_id, s.label ORDER BY score DESC, item_id) AS rank, count(*) OVER (PARTITION BY s.query_id, s.label) AS n FROM scored s JOIN ratio r ON s.query_id = r.query_id AND s.label = r.label) SELECT query_id, item_id FROM b WHERE rank <= greatest(1, ceil(round(ratio * n, 9)))")
def _(spark, d):
    s = scored(spark, d).withColumn("spread", F.round(F.stddev_pop("score").over(Window.partitionBy("query_id", "label")), 10))
    ratios = s.select("query_id", "label", "spread").distinct()  # the same exchange serves both uses of the scores
    s = s.join(R.density_ratio(ratios, ["query_id"], "spread").select("query_id", "label", "ratio"), ["query_id", "label"])
    return R.ratio_budget(s, ["query_id", "label"], F.col("ratio")).where("kept").select("query_id", "item_id")


@query("c12_query_aware", f"WITH {_THREADS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM t), c AS (SELECT query_id, item_id AS label FROM r WHERE rank <= 40 AND (rank = 1 OR (top > 0 AND score >= top * 0.85))), i AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, item_id) AS rank, max(score) OVER (PARTITION BY s.query_id) AS top FROM scored s JOIN c ON s.query_id = c.query_id AND s.label = c.label) SELECT query_id, item_id FROM i WHERE rank <= 60 AND (rank = 1 OR (top > 0 AND score >= top * 0.85))")
def _(spark, d):
    """One scoring pass: an item within the share of the best belongs to a document within it, so the rest is left out."""
    q = Window.partitionBy("query_id")
    s = scored(spark, d, 0.85).withColumn("top", F.max("score").over(q)).withColumn("best", F.max("score").over(Window.partitionBy("query_id", "label")))
    s = s.withColumn("place", F.dense_rank().over(q.orderBy(F.desc("best"), "label"))).where("place <= 40 and (place = 1 or (top > 0 and best >= top * 0.85))")
    return R.adaptive_k(s, ["query_id"], cap=60).select("query_id", "item_id")


@query("c09_select_then_text", f"WITH {ADAPTIVE} SELECT query_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM adaptive GROUP BY query_id")
def _(spark, d):
    """Selected items in source order; the gist and hybrid conditions differ only in the text that is joined to them."""
    a = R.adaptive_k(scored(spark, d, 0.85), ["query_id"])
    return a.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("items"))


@query("c22_query_aware_windowed", f"WITH {ADAPTIVE}, f AS (SELECT s.*, a.item_id IS NOT NULL AS kept FROM scored s LEFT JOIN adaptive a USING (query_id, item_id)), p AS (SELECT *, max(CAST(kept AS INT)) OVER (PARTITION BY query_id, label ORDER BY item_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS p FROM f) SELECT query_id, item_id FROM p WHERE p = 1")
def _(spark, d):
    return R.pad(R.adaptive_flag(scored(spark, d), ["query_id"]), ["query_id", "label"], 1).where("padded").select("query_id", "item_id")


@query("seg09_seam_scores", f"WITH o AS (SELECT vec_id, label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) SELECT label, vec_id, round(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(nxt AS DOUBLE[])), 10), 6) AS seam FROM o")
def _(spark, d):
    from folio.operators.segment import seam_scores

    e = read(spark, d, "embeddings", "vec_id", "embedding", "label")
    return seam_scores(e, "label", "vec_id", "embedding").select("label", "vec_id", F.round("seam", 6).alias("seam"))


@query("w09_seams", f"WITH {_BUDGET}, k AS (SELECT query_id, label, item_id, lead(item_id) OVER (PARTITION BY query_id, label ORDER BY item_id) AS after FROM kept WHERE kept) SELECT query_id, label, item_id AS before, after, CAST(after - item_id - 1 AS BIGINT) AS gap_size FROM k WHERE after - item_id > 1")
def _(spark, d):
    return seams(R.ratio_budget(scored(spark, d), ["query_id", "label"], 0.3).where("kept"), ["query_id", "label"])


_SEV = f"{_BUDGET}, k AS (SELECT query_id, label, item_id AS before, lead(item_id) OVER (PARTITION BY query_id, label ORDER BY item_id) AS after FROM kept WHERE kept), g AS (SELECT * FROM k WHERE after - before > 1), v AS (SELECT g.query_id, g.label, g.before, g.after, 1 - {COS} AS severity FROM g JOIN embeddings a ON a.vec_id = g.before JOIN embeddings b ON b.vec_id = g.after)"


def severities(spark, d):
    g = seams(R.ratio_budget(scored(spark, d), ["query_id", "label"], 0.3).where("kept"), ["query_id", "label"])
    e = read(spark, d, "embeddings", "vec_id", "embedding")
    a, b = e.select(F.col("vec_id").alias("before"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("after"), F.col("embedding").alias("y"))
    return g.join(a, "before").join(b, "after").withColumn("severity", 1 - F.round(V.cosine(F.col("x"), F.col("y")), 10)).drop("x", "y")


@query("v04_seam_severity", f"WITH {_SEV} SELECT query_id, before, after, round(severity, 6) AS severity FROM v")
def _(spark, d):
    return out(severities(spark, d), "query_id", "before", "after", "severity")


@query("r11_mmr")
def _(spark, d):
    """Half of each chunk's sentences by relevance and diversity, in order of choice, out of all its sentences."""
    from folio.functions.text import let, sentences, word_count, words
    from folio.runtime import spread

    c = spread(read(spark, d, "chunk", "doc_id", "chunk_idx", "text").where("text is not null")).groupBy("doc_id", "chunk_idx").agg(F.max("text").alias("text"))
    v = let(sentences(F.col("text")), lambda s: F.struct(F.transform(s, lambda x: word_count(x).cast("double")).alias("scores"), F.transform(s, lambda x: F.array_distinct(words(F.lower(x)))).alias("words")))
    items = c.select("doc_id", "chunk_idx", v.alias("v")).select("doc_id", "chunk_idx", "v.scores", "v.words")
    return R.mmr_share(items, ["doc_id", "chunk_idx"], 0.5).select("doc_id", "chunk_idx", F.array_join(F.col("chosen").cast("array<string>"), ",").alias("chosen"))


@query("t12_maintenance_extract")
def _(spark, d):
    """Chunks reduced to their best sentences in source order, by similarity to the chunk's own vector."""
    from folio.functions.text import sentences
    from folio.operators.connect import embed_texts

    c = read(spark, d, "chunk", "doc_id", "chunk_idx", "text").groupBy("doc_id", "chunk_idx").agg(F.max("text").alias("text")).withColumn("chunk", F.concat_ws("/", "doc_id", "chunk_idx"))
    s = c.select("chunk", "doc_id", "chunk_idx", F.posexplode(sentences(F.col("text"))).alias("idx", "sentence")).withColumn("key", F.concat_ws("/", "chunk", "idx"))
    sv = embed_texts(s, "key", "sentence").withColumnRenamed("vec", "sv")
    cv = embed_texts(c, "chunk", "text").withColumnRenamed("vec", "cv")
    scored_ = s.join(sv, "key").join(cv, "chunk").withColumn("score", F.round(V.cosine(F.col("sv"), F.col("cv")), 10))
    kept = R.pad(R.ratio_budget(scored_, ["chunk"], 0.3, item="idx"), ["chunk"], 1, item="idx").where("padded")
    return kept.groupBy("doc_id", "chunk_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


@query("v07_embedding_memo", "SELECT CAST(count(DISTINCT text) AS BIGINT) AS asked, CAST(count(DISTINCT CASE WHEN length(text) % 2 = 0 THEN text END) AS BIGINT) AS hits FROM hit WHERE text IS NOT NULL")
def _(spark, d):
    from folio.operators.connect import embed_texts, with_memo

    t = read(spark, d, "hit", "text").where("text is not null").distinct().withColumn("input_type", F.lit("passage"))
    half = t.where(F.length("text") % 2 == 0)
    memo = embed_texts(half.withColumn("k", F.col("text")), "k", "text").select(F.col("k").alias("text"), F.lit("passage").alias("input_type"), "vec")
    return with_memo(t, memo)[2]
