"""Queries of corpus building, prompts and the remaining conditions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import corpus as C
from folio.operators import select as R
from folio.plans.catalog_text import SENTENCES, WORDS, docs
from folio.plans.registry import query
from folio.runtime import read


def sized(spark, d):
    """key (work), pos, n_words of every document."""
    return docs(spark, d, "doc_slug").select(F.col("doc_slug").alias("key"), F.col("doc_id").alias("pos"), T.word_count(F.col("text")).alias("n_words"))


@query("r21_deal")
def _(spark, d):
    return C.deal(sized(spark, d).where("key is not null"), "key", 4, 400, 1200)


@query("r23_bisect_fraction")
def _(spark, d):
    h = read(spark, d, "hit", "hit_id", "doc_key", "score", "chunk_idx").groupBy("hit_id").agg(F.max("doc_key").alias("doc_key"), F.max("score").alias("score"), F.max("chunk_idx").alias("c")).where("score is not null and doc_key is not null")
    return C.bisect_fraction(h.withColumn("label", (F.col("c") % 5 == 0).cast("int")), "doc_key", "score", "label", 0.25).select("doc_key", F.round("fraction", 6).alias("fraction"), F.round("rate", 6).alias("rate"))


@query("r24_greedy_oracle")
def _(spark, d):
    """Up to three sentences of a pair's passage that come nearest to its target."""
    p = read(spark, d, "stage2_pair", "pair_id", "chunk_text", "target_text").groupBy("pair_id").agg(F.max("chunk_text").alias("c"), F.max("target_text").alias("t")).where("c is not null and t is not null")
    s = F.transform(T.sentences(F.col("c")), lambda x, i: F.struct(i.cast("long").alias("idx"), T.words(F.lower(x)).alias("words")))
    return p.select("pair_id", F.array_join(T.let(F.struct(s.alias("s"), T.words(F.lower("t")).alias("r")), lambda v: C.greedy_oracle(v["s"], v["r"])).cast("array<string>"), ",").alias("chosen"))


@query("r17_order_and_trim", f"WITH p AS (SELECT pair_id, {SENTENCES('max(chunk_text)')} AS s FROM stage2_pair GROUP BY pair_id HAVING max(chunk_text) IS NOT NULL) SELECT pair_id, array_to_string(s[1:CAST(ceil(0.5 * len(s)) AS BIGINT)], ' ') AS kept FROM p")
def _(spark, d):
    """Sentences given in reverse, put into source order and trimmed to half."""
    p = read(spark, d, "stage2_pair", "pair_id", "chunk_text").groupBy("pair_id").agg(F.max("chunk_text").alias("c")).where("c is not null")
    s = T.sentences(F.col("c"))
    back = lambda v: F.transform(F.array_sort(F.transform(F.reverse(v), lambda x, i: F.struct((F.size(v) - i).alias("at"), x.alias("x")))), lambda y: y["x"])
    cut = lambda v: F.array_join(F.slice(v, F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(v) * F.lit(0.5)).cast("int"))), " ")
    return p.select("pair_id", T.let(T.let(s, back), cut).alias("kept"))


@query("f10_even_stride", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM n WHERE i IN (SELECT CAST(floor(k * (SELECT count(*) FROM documents) / 50.0) AS BIGINT) FROM range(50) t(k))")
def _(spark, d):
    return C.even_stride(read(spark, d, "documents", "doc_id"), ["doc_id"], 50)


@query("f11_unreliable_dropped", "SELECT pair_id FROM (SELECT pair_id, max(doc_key) AS k, max(chunk_position) AS p FROM stage2_pair GROUP BY pair_id) WHERE (k, p) NOT IN (SELECT doc_key, chunk_position FROM stage2_pair WHERE doc_key IS NOT NULL AND chunk_position IS NOT NULL AND target_text IS NULL)")
def _(spark, d):
    p = read(spark, d, "stage2_pair", "pair_id", "doc_key", "chunk_position", "target_text")
    one = p.groupBy("pair_id").agg(F.max("doc_key").alias("doc_key"), F.max("chunk_position").alias("chunk_position"))
    bad = p.where("target_text is null and doc_key is not null and chunk_position is not null").select("doc_key", "chunk_position").distinct()
    return one.join(bad, ["doc_key", "chunk_position"], "left_anti").select("pair_id")


@query("f12_answerable", f"WITH w AS (SELECT item_id, len({WORDS('passage')}) AS n, len({WORDS('left(passage, instr(passage, answer))')}) AS place FROM eval_item) SELECT item_id, place <= least(n, 10) AS v10, place <= least(n, 20) AS v20, place <= least(n, 40) AS v40 FROM w")
def _(spark, d):
    e = read(spark, d, "eval_item", "item_id", "passage", "answer")
    at = F.size(T.words(F.substring(F.col("passage"), F.lit(1), F.call_function("locate", F.col("answer"), F.col("passage")))))
    n = F.size(T.words(F.col("passage")))
    return e.select("item_id", *[(at <= F.least(n, F.lit(v))).alias(f"v{v}") for v in (10, 20, 40)])


@query("w03_concat_offsets", "SELECT doc_id, doc_slug, CAST(coalesce(sum(length(text) + 7) OVER (PARTITION BY doc_slug ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return C.concat_offsets(docs(spark, d, "doc_slug"), ["doc_slug"], "doc_id", "text", 7).select("doc_id", "doc_slug", F.col("offset").alias("offset_"))


@query("w05_interleave", "WITH r AS (SELECT doc_id, genre, row_number() OVER (PARTITION BY genre ORDER BY doc_id) - 1 AS round FROM documents WHERE genre IS NOT NULL), t AS (SELECT genre, min(doc_id) AS turn FROM documents WHERE genre IS NOT NULL GROUP BY genre) SELECT doc_id, genre, CAST(round AS BIGINT) AS round, turn FROM r JOIN t USING (genre)")
def _(spark, d):
    g = read(spark, d, "documents", "doc_id", "genre").where("genre is not null")
    return C.interleave(g, "genre", "doc_id").select("doc_id", "genre", F.col("round").cast("long").alias("round"), "turn")


@query("t15_pair_builder", "WITH g AS (SELECT doc_key, chunk_idx, max(text) AS text FROM teacher_gists_anticollapse_wiki20_pilot WHERE text IS NOT NULL AND doc_key IS NOT NULL GROUP BY ALL) SELECT doc_key, chunk_idx, coalesce(lag(text) OVER (PARTITION BY doc_key ORDER BY chunk_idx), '') AS previous_summary, text AS target_text FROM g")
def _(spark, d):
    g = read(spark, d, "teacher_gists_anticollapse_wiki20_pilot", "doc_key", "chunk_idx", "text").where("text is not null and doc_key is not null").groupBy("doc_key", "chunk_idx").agg(F.max("text").alias("text"))
    return g.select("doc_key", "chunk_idx", F.coalesce(F.lag("text").over(Window.partitionBy("doc_key").orderBy("chunk_idx")), F.lit("")).alias("previous_summary"), F.col("text").alias("target_text"))


@query("t17_survival", f"WITH c AS (SELECT doc_id, chunk_idx, {SENTENCES('max(text)')} AS s FROM chunk GROUP BY ALL), e AS (SELECT doc_id, chunk_idx, unnest(s) AS sentence, unnest(range(len(s))) AS i, len(s) AS n FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY length(sentence) DESC, i) <= greatest(1, ceil(round(0.5 * n, 9))) AS kept FROM e) SELECT CAST(count(*) AS BIGINT) AS n_evidence, CAST(sum(CASE WHEN kept THEN 1 ELSE 0 END) AS BIGINT) AS n_kept FROM k WHERE regexp_matches(sentence, '(^|[^0-9])1[0-9]{{3}}([^0-9]|$)')")
def _(spark, d):
    """Evidence sentences, those with a year, that a length-scored half of their chunk keeps."""
    c = read(spark, d, "chunk", "doc_id", "chunk_idx", "text").groupBy("doc_id", "chunk_idx").agg(F.max("text").alias("text"))
    s = c.select("doc_id", "chunk_idx", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence")).withColumn("score", F.length("sentence").cast("double"))
    k = R.ratio_budget(s, ["doc_id", "chunk_idx"], 0.5, item="i").where(F.col("sentence").rlike(r"(^|[^0-9])1[0-9]{3}([^0-9]|$)"))
    return k.agg(F.count(F.lit(1)).alias("n_evidence"), F.sum(F.col("kept").cast("long")).alias("n_kept"))


@query("b02_train_corpora")
def _(spark, d):
    """Documents without leaks, dealt to bins within a band."""
    items = read(spark, d, "eval_item", "passage")
    clean = C.leak_free(docs(spark, d, "doc_slug"), items, "doc_id", "text", "passage").where("doc_slug is not null")
    s = clean.select(F.col("doc_slug").alias("key"), F.col("doc_id").alias("pos"), T.word_count(F.col("text")).alias("n_words"))
    return C.deal(s, "key", 3, 300, 900)


@query("b07_probe_windows")
def _(spark, d):
    """Word windows, probe pairs from the injected model's reply, answers found verbatim."""
    from folio.operators.connect import chat_rows

    w = docs(spark, d).select("doc_id", F.posexplode(T.word_windows(F.col("text"), 150)).alias("i", "window")).withColumn("key", F.concat_ws("/", "doc_id", "i"))
    r = chat_rows(w, "key", "window")
    j = w.join(r, "key").withColumn("v", C.first_variant(F.col("window"), F.array("reply")))
    return j.where("v is not null").select("doc_id", F.col("i").cast("long").alias("window_idx"), F.col("v.pos").alias("pos"), F.col("v.answer").alias("answer"))


@query("c01_closed_book", "SELECT item_id, 'Answer the question. Question: ' || question AS prompt FROM eval_item")
def _(spark, d):
    return read(spark, d, "eval_item", "item_id", "question").select("item_id", F.concat(F.lit("Answer the question. Question: "), "question").alias("prompt"))


@query("c02_full_context", "SELECT item_id, 'Context: ' || passage || chr(10) || 'Question: ' || question AS prompt FROM eval_item")
def _(spark, d):
    return read(spark, d, "eval_item", "item_id", "passage", "question").select("item_id", F.concat(F.lit("Context: "), "passage", F.lit("\nQuestion: "), "question").alias("prompt"))


def _gist_scores(spark, d, g=None):
    """Gists scored against the gists whose id is divisible by 100, by hashed word vectors."""
    from folio.functions.vector import score_all
    from folio.operators.connect import embed_texts

    if g is None:
        g = read(spark, d, "teacher_gists_anticollapse_wiki20_pilot", "gist_id", "text").groupBy("gist_id").agg(F.max("text").alias("text")).where("text is not null")
    v = embed_texts(g, "gist_id", "text")
    return score_all(v.select(F.col("gist_id").alias("item_id"), "vec"), v.where("gist_id % 100 = 0").select(F.col("gist_id").alias("query_id"), "vec"), 0.85).where("query_id <> item_id")


@query("c10_gist_embedding")
def _(spark, d):
    a = R.adaptive_k(_gist_scores(spark, d), ["query_id"])
    return a.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("c13_short_gists")
def _(spark, d):
    """Selection by gists of at most 128 words: what was cut off takes no part in it, nor in the text that is shown."""
    g = read(spark, d, "teacher_gists_anticollapse_wiki20_pilot", "gist_id", "text").groupBy("gist_id").agg(T.truncate_words(F.max("text"), 128).alias("text")).where("text is not null")
    a = R.adaptive_k(_gist_scores(spark, d, g), ["query_id"])
    return a.join(g.withColumnRenamed("gist_id", "item_id"), "item_id").select("query_id", "item_id", "text")


@query("c11_gist_select_raw_text")
def _(spark, d):
    a = R.adaptive_k(_gist_scores(spark, d), ["query_id"])
    raw = read(spark, d, "teacher_gists_anticollapse_wiki20_pilot", "gist_id", "original_text").groupBy(F.col("gist_id").alias("item_id")).agg(F.max("original_text").alias("text"))
    return a.join(raw, "item_id").select("query_id", "item_id", "text")


@query("b04_excerpts", "SELECT doc_slug, CAST(count(*) AS BIGINT) AS n_excerpts, CAST(sum(length(text)) + 7 * (count(*) - 1) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL AND lower(trim(genre)) = 'caselaw' GROUP BY doc_slug")
def _(spark, d):
    """Case-law excerpts of a work joined by a separator of seven characters."""
    k = docs(spark, d, "doc_slug", "genre").where(F.lower(F.trim("genre")) == "caselaw")
    return k.groupBy("doc_slug").agg(F.count(F.lit(1)).alias("n_excerpts"), (F.sum(F.length("text")) + 7 * (F.count(F.lit(1)) - 1)).alias("n_chars"))


@query("b05_long_form_corpus")
def _(spark, d):
    """Works long enough, without boilerplate, cut at a paragraph, with answers found verbatim."""
    from folio.operators.segment import paragraphs, truncate_at_paragraph

    t = docs(spark, d, "genre").where(F.lower(F.trim("genre")) == "novel").withColumn("text", T.strip_boilerplate(F.col("text")))
    kept = truncate_at_paragraph(paragraphs(C.bounded_words(t, "text", 120)), 300)
    body = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    v = body.withColumn("v", C.first_variant(F.col("body"), F.regexp_extract_all("body", F.lit(r"(\d{4})"), F.lit(1)))).where("v is not null")
    return v.select("doc_id", F.col("v.answer").alias("answer"), F.col("v.pos").alias("evidence_char_pos"), T.word_index(F.col("body"), F.col("v.pos")).alias("evidence_word_pos"))


@query("b06_statute_corpus")
def _(spark, d):
    """Sections of statutes joined by work; question lines parsed; answers found inside their section, once."""
    s = docs(spark, d, "doc_slug", "genre").where(F.lower(F.trim("genre")) == "statute").where(T.word_count(F.col("text")) >= 30)
    placed = C.concat_offsets(s, ["doc_slug"], "doc_id", "text", 2)
    number = F.regexp_extract("text", r"(\d[\d,.]*\d)", 1)
    reply = F.concat(F.lit("Q: Which figure?\nA: "), number)
    qa = placed.where(number != "").select("doc_slug", "doc_id", "offset", "text", F.explode(T.qa_lines(reply)).alias("p"))
    ok = qa.where(C.rare_enough(F.col("text"), F.col("p.a"), 1))
    return ok.select("doc_slug", "doc_id", F.col("p.a").alias("answer"), (F.col("offset") + T.find(F.col("text"), F.col("p.a"))).alias("evidence_char_pos"))


@query("y10_sql_functions", f"SELECT item_id, CAST(len({WORDS('passage')}) AS BIGINT) AS n_words, CAST(ceil(len({WORDS('passage')}) / 10.0) AS BIGINT) AS n_windows FROM eval_item")
def _(spark, d):
    """The SQL surface: a temporary function and a table function in one statement."""
    from folio.functions.register import register

    register(spark)
    read(spark, d, "eval_item", "item_id", "passage").createOrReplaceTempView("folio_items")
    return spark.sql("SELECT item_id, CAST(size(folio_words(passage)) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_windows FROM folio_items, LATERAL folio_word_windows(passage, 10) GROUP BY item_id, passage")
