"""Queries of the sequential memories. ``label`` of the embeddings stands for a document, ``vec_id`` for the order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import evaluate as E
from folio.operators import memory as M
from folio.operators import select as R
from folio.operators.fold import ordered_fold
from folio.plans.registry import query
from folio.runtime import read

TAUS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35)
#: The eight thresholds of the sweep with answers.
TAUS8 = (0.02, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9)


def rows(spark, d):
    return read(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


@query("m00_streaming_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(spark, d):
    from folio.streaming import replay as S

    out = S.run_to_table(S.windowed_counts(S.file_stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")), "windows", "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


@query("m02_replay")
def _(spark, d):
    r = M.replay(rows(spark, d), 0.2, 0.2)
    return r.withColumn("retrieved", F.array_join(F.col("retrieved").cast("array<string>"), ",")).withColumn("thread_spans", F.array_join(F.col("thread_spans").cast("array<string>"), ","))


@query("m03_decay_replay")
def _(spark, d):
    r = M.replay(rows(spark, d), 0.2, 0.2, decay=0.01)
    return r.select("key", "pos", F.array_join(F.col("retrieved").cast("array<string>"), ",").alias("retrieved"), "action")


@query("m05_capacity_merge")
def _(spark, d):
    """Passages in a memory of two slots; what is merged gets the vector of its joint text."""
    from folio.operators.connect import embed_texts

    p = passages(spark, d).withColumn("k", F.concat_ws("/", "key", "pos"))
    f = M.final_slots(p.join(embed_texts(p, "k", "text"), "k").select("key", "pos", "vec", "text"), 0.8, capacity=2, policy="merge", embed=_embed)
    return f.withColumn("origins", F.array_join(F.col("origins").cast("array<string>"), ","))


@query("m07_capacity_evict")
def _(spark, d):
    f = M.final_slots(rows(spark, d), 0.3, capacity=8, policy="evict")
    return f.withColumn("origins", F.array_join(F.col("origins").cast("array<string>"), ","))


@query("m08_provenance", "WITH m AS (SELECT slot_id, max(origin_indices) AS o FROM memory_slot GROUP BY slot_id) SELECT DISTINCT slot_id, unnest(o) AS origin FROM m")
def _(spark, d):
    m = read(spark, d, "memory_slot", "slot_id", "origin_indices").groupBy("slot_id").agg(F.max("origin_indices").alias("o"))
    return m.select("slot_id", F.explode("o").alias("origin")).distinct()


@query("m09_forget", "WITH m AS (SELECT slot_id, max(origin_indices) AS o, max(created_at) AS c FROM memory_slot GROUP BY slot_id) SELECT slot_id FROM m WHERE o IS NOT NULL AND NOT list_contains(o, c)")
def _(spark, d):
    """Slots left once each slot's own first chunk is forgotten."""
    m = read(spark, d, "memory_slot", "slot_id", "origin_indices", "created_at").groupBy("slot_id").agg(F.max("origin_indices").alias("origins"), F.max("created_at").alias("origin")).where("origins is not null")
    return M.forget(m).select("slot_id")


@query("m10_flat_pool", """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 10) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT query_id, item_id, round(score, 6) AS score FROM r WHERE (rank <= 3 AND score >= 0.15) OR (rank = 1 AND score < 0.15)""")
def _(spark, d):
    from folio.plans.catalog_vector import scored

    own = read(spark, d, "embeddings", F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    s = scored(spark, d).join(own, "query_id").where("label = own and item_id < query_id")
    return R.threshold_or_top(s, ["query_id"], 0.15, 3).select("query_id", "item_id", F.round("score", 6).alias("score"))


@query("m12_context_budget", "WITH h AS (SELECT hit_id, max(doc_key) AS doc_key, max(score) AS score, max(length(text)) AS n FROM hit GROUP BY hit_id HAVING max(score) IS NOT NULL AND max(text) IS NOT NULL AND max(doc_key) IS NOT NULL), c AS (SELECT *, sum(n) OVER (PARTITION BY doc_key ORDER BY score DESC, hit_id ROWS UNBOUNDED PRECEDING) AS cum FROM h) SELECT doc_key, hit_id FROM c WHERE cum <= 2000")
def _(spark, d):
    h = read(spark, d, "hit", "hit_id", "doc_key", "score", "text").groupBy("hit_id").agg(F.max("doc_key").alias("doc_key"), F.max("score").alias("score"), F.max(F.length("text")).alias("n")).where("score is not null and n is not null and doc_key is not null")
    w = Window.partitionBy("doc_key").orderBy(F.desc("score"), "hit_id").rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumn("cum", F.sum("n").over(w)).where("cum <= 2000").select("doc_key", "hit_id")


def passages(spark, d):
    c = read(spark, d, "chunk", "doc_id", "chunk_idx", "text").groupBy("doc_id", "chunk_idx").agg(F.max("text").alias("text"))
    return c.select(F.col("doc_id").alias("key"), F.col("chunk_idx").cast("long").alias("pos"), "text")


def _chat(context, text, attempt):
    """Stub curator: the context's last words and the passage's first sentence; a retry leaves the context out."""
    from folio.operators.connect import lead_chat

    lead = lead_chat([{"role": "user", "content": text}])
    return lead if attempt else " ".join([*(" ".join(context).split()[-12:]), lead])


def _embed(text):
    from folio.operators.connect import hashed_embed

    return hashed_embed([text])[0]


@query("m14_linear_curation")
def _(spark, d):
    return M.curate(passages(spark, d), "linear", _chat, _embed)


@query("m15_threaded_curation")
def _(spark, d):
    return M.curate(passages(spark, d), "threaded", _chat, _embed)


@query("m16_testing_curation")
def _(spark, d):
    p = passages(spark, d).withColumn("answers", F.array(F.regexp_extract("text", r"(\S+ \S+)", 1)))
    return M.curate(p, "testing", _chat, _embed)


@query("m17_anticollapse_curation")
def _(spark, d):
    return M.curate(passages(spark, d), "anticollapse", _chat, _embed)


@query("m13_independent")
def _(spark, d):
    return M.curate(passages(spark, d), "independent", _chat, _embed)


@query("m18_self_rollout")
def _(spark, d):
    """Own summaries rolled on: the previous one stays where a step gives nothing."""
    return M.curate(passages(spark, d), "linear", _keep, _embed)


def _keep(context, text, attempt):
    return None if len(text) % 3 == 0 else (text.split(". ")[0] + " | " + (context[0][:40] if context else ""))


def _has_number(r):
    return "found" if r.text and "19" in r.text else None


@query("c03_chunked_sequential", "WITH c AS (SELECT doc_id AS key, chunk_idx AS pos, max(text) AS text FROM chunk GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS k, count(*) OVER (PARTITION BY key) AS n FROM c), f AS (SELECT key, min(CASE WHEN k <= 4 AND contains(text, '19') THEN k END) AS hit, max(n) AS n FROM r GROUP BY key) SELECT key, CAST(coalesce(hit, least(4, n)) AS BIGINT) AS calls, CASE WHEN hit IS NOT NULL THEN 'found' END AS answer FROM f")
def _(spark, d):
    return M.read_until_answered(passages(spark, d), _has_number).select("key", "calls", "answer")


class Sweep(M.Replay):
    """Replay with the threshold that the key's rows carry."""

    def __init__(self):
        super().__init__(M.Rules(full="grow"))

    def row(self, r):
        if self.rules.read != r.tau:
            self.rules = M.Rules(float(r.tau), float(r.tau), full="grow")
        return super().row(r)


class Answers(Sweep):
    """The sweep with what is left of the passages at the end: an answer (the first two words) is kept if a slot that
    holds its passage's origin still has it."""

    def __init__(self):
        super().__init__()
        self.asked: list[tuple[int, str]] = []
        self.inserted = self.live = 0

    def row(self, r):
        answer = " ".join((r.text or "").split()[:2]).lower()
        if answer:
            self.asked.append((int(r.pos), answer))
        for record in super().row(r):
            self.live += record[3] > 0
            self.inserted += record[3] > 0 and record[7] == "insert"
        return []

    def finish(self):
        text = {o: t.lower() for t, origins in zip(self.slots.texts, self.slots.origins) for o in origins}
        held = [answer in text.get(pos, "") for pos, answer in self.asked]
        late = [h for (pos, _), h in zip(self.asked, held) if pos >= 3]
        share = lambda x: sum(x) / len(x) if x else 0.0
        return [(len(self.asked), self.live, self.inserted, len(self.slots), share(held), share(held[:3]), share(late))]


ANSWERED = "n_probes long, n_live long, n_inserted long, memory_size long, exact double, early double, late double"


def answered(spark, d, taus=TAUS8):
    """Every (document, tau): what a memory that reads and writes at tau, and grows, keeps of the passages' answers."""
    from folio.operators.connect import embed_texts

    p = passages(spark, d).withColumn("k", F.concat_ws("/", "key", "pos"))
    grid = p.join(embed_texts(p, "k", "text"), "k").select("key", "pos", "vec", "text", F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau"))
    return ordered_fold(grid, ["key", "tau"], ["pos"], Answers, ANSWERED).withColumn("insert_share", E.ratio(F.col("n_inserted"), F.col("n_live")))


@query("t09_tau_sweep")
def _(spark, d):
    a = answered(spark, d)
    kinds = dict(a.dtypes)
    return a.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else c for c in a.columns])


@query("r18_recommend_tau")
def _(spark, d):
    """The tau that keeps most answers, then the smaller memory, among those that insert some and not all."""
    s = answered(spark, d).groupBy("tau").agg(F.avg("insert_share").alias("insert_share"), F.avg("exact").alias("answer_f1"), F.avg("memory_size").alias("memory_size"))
    return E.recommend_tau(s).select("tau", F.round("insert_share", 6).alias("insert_share"), F.round("answer_f1", 6).alias("answer_f1"))


def sweep(vectors, taus=TAUS):
    """Span report of every (key, tau): one fold over the cross product with the small grid."""
    grid = vectors.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus])))
    rec = ordered_fold(grid, ["key", "tau"], ["pos"], Sweep, M.RECORDS)
    return E.span_report(rec, ["key", "tau"])


@query("t08_span_report")
def _(spark, d):
    r = E.span_report(M.replay(rows(spark, d), 0.2, 0.2), ["key"])
    kinds = dict(r.dtypes)
    return r.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else c for c in r.columns])


@query("t10_degeneration")
def _(spark, d):
    s = sweep(rows(spark, d)).groupBy("tau").agg(F.avg("insert_share").alias("insert_share"))
    return E.degeneration(s)


def _thread_scores(spark, d):
    """Threads of each document against each query: the score of a thread is that of its anchor."""
    from folio.plans.catalog_vector import scored

    t = M.anchor_clusters(rows(spark, d), 0.2).select(F.col("pos").alias("item_id"), "key", "thread_id", "opened")
    return scored(spark, d).join(t, "item_id").withColumn("thread", F.concat_ws("/", "key", "thread_id"))


@query("c19_threaded_selection")
def _(spark, d):
    s = _thread_scores(spark, d)
    a = R.adaptive_k(s.where("opened").select("query_id", "thread", "score"), ["query_id"], item="thread")
    return s.join(a.select("query_id", "thread"), ["query_id", "thread"], "left_semi").select("query_id", "thread", "item_id")


@query("c20_threaded_weighted")
def _(spark, d):
    s = _thread_scores(spark, d)
    b = R.weighted_budget(s.where("opened").select("query_id", "thread", "score"), ["query_id"], 250).select("query_id", "thread", "budget")
    m = s.withColumn("n_words", F.col("item_id") % 7 + 1).join(b, ["query_id", "thread"])
    return R.fill_budget(m, ["query_id", "thread"], F.col("budget")).where("take > 0").select("query_id", "thread", "item_id", "take")


@query("c21_threaded_nucleus")
def _(spark, d):
    s = _thread_scores(spark, d).where("opened").select("query_id", "thread", "score")
    return R.nucleus(s, ["query_id"], 0.5, 0.3, item="thread").select("query_id", "thread", F.round("weight", 6).alias("weight"))


@query("c24_iterative_retrieval")
def _(spark, d):
    """At most two more rounds: while a query's best hit is below 0.5, the neighbours of its hits are taken in."""
    from folio.plans.catalog_vector import scored

    s = scored(spark, d)
    have = R.adaptive_k(s, ["query_id"]).select("query_id", "item_id", "score")
    for _ in range(2):
        open_ = have.groupBy("query_id").agg(F.max("score").alias("best")).where("best < 0.5").select("query_id")
        near = have.join(open_, "query_id", "left_semi").select("query_id", F.explode(F.array(F.col("item_id") - 1, F.col("item_id") + 1)).alias("item_id")).distinct()
        have = have.unionByName(s.join(near, ["query_id", "item_id"], "left_semi").select("query_id", "item_id", "score")).distinct()
    return have.select("query_id", "item_id", F.round("score", 6).alias("score"))


@query("c27_threshold_sweep", """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 10) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM s), g AS (SELECT unnest([0.75, 0.8, 0.85, 0.9, 0.95, 0.98]::DOUBLE[]) AS threshold)
SELECT threshold, CAST(count(*) AS BIGINT) AS n_selected FROM r, g WHERE rank <= 40 AND (rank = 1 OR (top > 0 AND score >= top * threshold)) GROUP BY threshold""")
def _(spark, d):
    from folio.plans.catalog_vector import scored

    w = Window.partitionBy("query_id")
    r = R.ranked(scored(spark, d, 0.75).withColumn("top", F.max("score").over(w)), ["query_id"]).where("rank <= 40")
    g = r.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.75, 0.8, 0.85, 0.9, 0.95, 0.98)])))
    return g.where("rank = 1 or (top > 0 and score >= top * threshold)").groupBy("threshold").agg(F.count(F.lit(1)).alias("n_selected"))


@query("c04_sequential_states")
def _(spark, d):
    """Early exit over the states of the rolling memory instead of the passages."""
    states = M.curate(passages(spark, d), "threaded", _chat, _embed).select("key", "pos", F.col("state").alias("text"))
    return M.read_until_answered(states, _has_number).select("key", "calls", "answer")


@query("m11_elaborative_records")
def _(spark, d):
    """Audit records of the loop over passages with their hashed word vectors."""
    from folio.operators.connect import embed_texts

    p = passages(spark, d).withColumn("k", F.concat_ws("/", "key", "pos"))
    r = M.replay(p.join(embed_texts(p, "k", "text"), "k").select("key", "pos", "vec", "text"), 0.35, 0.6)
    return r.select("key", "pos", F.array_join(F.col("retrieved").cast("array<string>"), ",").alias("retrieved"), "pool_size", "memory_size", "fallback", "action")


@query("t13_snapped_maintenance")
def _(spark, d):
    """Generated sentences (targets) snapped to the passage: exact ones stay, others become the nearest source sentence."""
    from folio.functions.text import sentences
    from folio.functions.vector import cosine
    from folio.operators.connect import embed_texts

    p = read(spark, d, "stage2_pair", "pair_id", "chunk_text", "target_text").groupBy("pair_id").agg(F.max("chunk_text").alias("c"), F.max("target_text").alias("t")).where("c is not null and t is not null")
    src = p.select("pair_id", F.posexplode(sentences(F.col("c"))).alias("j", "source"))
    gen = p.select("pair_id", F.posexplode(sentences(F.col("t"))).alias("i", "sentence"))
    exact = gen.join(src.select("pair_id", F.col("source").alias("sentence")).distinct(), ["pair_id", "sentence"], "left_semi").withColumn("snapped", F.col("sentence"))
    rest = gen.join(exact.select("pair_id", "i"), ["pair_id", "i"], "left_anti")
    texts = rest.select(F.col("sentence").alias("t")).unionByName(src.select(F.col("source").alias("t"))).distinct().withColumn("k", F.col("t"))
    v = embed_texts(texts, "k", "t")
    j = rest.join(src, "pair_id").join(v.select(F.col("k").alias("sentence"), F.col("vec").alias("x")), "sentence").join(v.select(F.col("k").alias("source"), F.col("vec").alias("y")), "source")
    s = j.withColumn("score", F.round(cosine(F.col("x"), F.col("y")), 10))
    best = R.top_k(s, ["pair_id", "i"], 1, item="j").select("pair_id", "i", "sentence", F.col("source").alias("snapped"))
    return exact.select("pair_id", "i", "sentence", "snapped").unionByName(best).withColumn("i", F.col("i").cast("long"))
