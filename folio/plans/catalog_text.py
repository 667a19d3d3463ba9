"""Queries over texts: scalar functions, segmentation, filters and reply parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import segment as S
from folio.plans.registry import query
from folio.runtime import read, spread

W = T.WS
WORDS = lambda c: f"list_filter(string_split_regex({c}, '{W}+'), lambda w: w <> '')"
COLLAPSE = lambda c: f"trim(regexp_replace({c}, '{W}+', ' ', 'g'))"
ANSWER = lambda c: f"list_aggregate(list_filter({WORDS(f'''translate(lower({c}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')''')}, lambda w: w NOT IN ('a','an','the')), 'string_agg', ' ')"
REPLY = lambda c: f"""lower(regexp_replace({c}, '[\\x{{0009}}-\\x{{000D}}\\x{{0020}}.,!?''"()\\[\\]{{}}]', '', 'g'))"""
NGRAMS = lambda w, n: f"(CASE WHEN len({w}) < {n} THEN []::VARCHAR[] ELSE list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i+{n}-1], ' ')) END)"
SENTENCES = lambda c: f"""list_filter(list_transform(string_split(regexp_replace({c}, '([.!?…。！？।][”"’''»)]*){W}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {COLLAPSE('s')}), lambda s: s <> '')"""


def docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(read(spark, d, "documents", "doc_id", "text", *more).where("text is not null"))


@query("x01_word_count", f"SELECT doc_id, CAST(len({WORDS('text')}) AS BIGINT) AS n_words FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("x02_collapse", f"SELECT doc_id, {COLLAPSE('text')} AS text FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.collapse(F.col("text")).alias("text"))


@query("x03_word_index", f"SELECT p.doc_id, p.para_idx, CAST(len({WORDS('left(d.text, CAST(p.char_offset AS INTEGER))')}) + 1 AS BIGINT) AS word_pos FROM (SELECT DISTINCT doc_id, para_idx, char_offset FROM paragraph) p JOIN documents d USING (doc_id)")
def _(spark, d):
    p = read(spark, d, "paragraph", "doc_id", "para_idx", "char_offset").distinct()
    return p.join(docs(spark, d), "doc_id").select("doc_id", "para_idx", T.word_index(F.col("text"), F.col("char_offset")).alias("word_pos"))


@query("x04_find", "SELECT item_id, CAST(instr(passage, answer) - 1 AS BIGINT) AS pos FROM eval_item")
def _(spark, d):
    return read(spark, d, "eval_item").select("item_id", T.find(F.col("passage"), F.col("answer")).alias("pos"))


@query("x05_answer_form", f"SELECT item_id, coalesce({ANSWER('passage')}, '') AS form FROM eval_item")
def _(spark, d):
    return read(spark, d, "eval_item").select("item_id", T.answer_form(F.col("passage")).alias("form"))


@query("x06_reply_form", f"SELECT result_id, {REPLY('max(prediction)')} AS form FROM qa_stage2_adaptive_threshold_sweep_ratio0chk GROUP BY result_id")
def _(spark, d):
    q = read(spark, d, "qa_stage2_adaptive_threshold_sweep_ratio0chk", "result_id", "prediction").groupBy("result_id").agg(F.max("prediction").alias("p"))
    return q.select("result_id", T.reply_form(F.col("p")).alias("form"))


@query("x07_answer_correct", f"SELECT item_id, coalesce(length({REPLY('answer')}) > 0 AND contains({REPLY('passage')}, {REPLY('answer')}), false) AS ok FROM eval_item")
def _(spark, d):
    return read(spark, d, "eval_item").select("item_id", T.answer_correct(F.col("passage"), F.col("answer")).alias("ok"))


@query("x08_ngrams", f"WITH g AS (SELECT doc_id, {NGRAMS(WORDS('text'), 3)} AS g FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(g) AS BIGINT) AS n, CAST(len(list_distinct(g)) AS BIGINT) AS n_distinct, g[1] AS first FROM g")
def _(spark, d):
    n = lambda c: F.size(c).cast("long")
    one = T.let(T.ngrams(T.words(F.col("text")), 3), lambda g: F.struct(n(g).alias("n"), n(F.array_distinct(g)).alias("n_distinct"), F.get(g, F.lit(0)).alias("first")))
    return docs(spark, d).select("doc_id", one.alias("g")).select("doc_id", "g.*")


_STOP = ",".join(f"'{w}'" for w in T.STOPLIST)
_CONTENT = lambda c: f"list_filter(regexp_extract_all(lower({c}), '([a-z'']+)', 1), lambda w: w NOT IN ({_STOP}))"


_LATIN = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '([a-z'']+)', 1))"


@query("x09_content_overlap", f"WITH o AS (SELECT item_id, {_CONTENT('question')} AS a, {_LATIN('passage')} AS b FROM eval_item) SELECT item_id, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_filter(a, lambda w: list_contains(b, w)))::DOUBLE / len(a) END, 6) AS overlap FROM o")
def _(spark, d):
    return read(spark, d, "eval_item").select("item_id", F.round(T.content_overlap(F.col("question"), F.col("passage")), 6).alias("overlap"))


@query("x10_templates", "SELECT item_id, 'generate question: answer: ' || answer || ' context: ' || passage AS prompt FROM eval_item")
def _(spark, d):
    return read(spark, d, "eval_item").select("item_id", F.concat(F.lit("generate question: answer: "), "answer", F.lit(" context: "), "passage").alias("prompt"))


@query("x11_elaborative_prompt", "SELECT pair_id, 'current passage: ' || max(chunk_text) || CASE WHEN coalesce(max(previous_summary), '') = '' THEN '' ELSE ' related context: ' || max(previous_summary) END AS prompt FROM stage2_pair GROUP BY pair_id")
def _(spark, d):
    p = read(spark, d, "stage2_pair", "pair_id", "chunk_text", "previous_summary").groupBy("pair_id").agg(F.max("chunk_text").alias("c"), F.max("previous_summary").alias("s"))
    more = F.when(F.coalesce("s", F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" related context: "), "s"))
    return p.select("pair_id", F.concat(F.lit("current passage: "), "c", more).alias("prompt"))


@query("x12_context_block", "SELECT doc_id, string_agg('[chunk ' || chunk_idx || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_idx) AS block FROM (SELECT doc_id, chunk_idx, max(text) AS text FROM chunk GROUP BY ALL) GROUP BY doc_id")
def _(spark, d):
    c = read(spark, d, "chunk", "doc_id", "chunk_idx", "text").groupBy("doc_id", "chunk_idx").agg(F.max("text").alias("text"))
    return c.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("chunk_idx").alias("idx"), "text")).alias("parts")).select("doc_id", T.context_block(F.col("parts")).alias("block"))


@query("x13_round_half_even", "SELECT result_id, CAST(round_even(max(elapsed_seconds), 0) AS DOUBLE) AS r FROM qa_stage2_adaptive_threshold_sweep_ratio0chk GROUP BY result_id")
def _(spark, d):
    q = read(spark, d, "qa_stage2_adaptive_threshold_sweep_ratio0chk", "result_id", "elapsed_seconds")
    return q.groupBy("result_id").agg(F.bround(F.max("elapsed_seconds"), 0).cast("double").alias("r"))


@query("x14_clamped_ratio", "SELECT doc_id, greatest(1, least(40, CAST(ceil(n_chars * 0.01) AS BIGINT))) AS n FROM documents")
def _(spark, d):
    return read(spark, d, "documents", "doc_id", "n_chars").select("doc_id", F.greatest(F.lit(1), F.least(F.lit(40), F.ceil(F.col("n_chars") * F.lit(0.01)).cast("long"))).cast("long").alias("n"))


@query("x15_decay", "SELECT slot_id, round(exp(-0.05 * (max(last_touched_at) - max(created_at))), 6) AS w FROM memory_slot GROUP BY slot_id")
def _(spark, d):
    m = read(spark, d, "memory_slot", "slot_id", "created_at", "last_touched_at").groupBy("slot_id").agg(F.max("created_at").alias("a"), F.max("last_touched_at").alias("b"))
    return m.select("slot_id", F.round(F.exp(F.lit(-0.05) * (F.col("b") - F.col("a"))), 6).alias("w"))


@query("x16_sigmoid", "SELECT hit_id, round(1 / (1 + exp(-max(score))), 6) AS p FROM hit GROUP BY hit_id")
def _(spark, d):
    return read(spark, d, "hit", "hit_id", "score").groupBy("hit_id").agg(F.round(1 / (1 + F.exp(-F.max("score"))), 6).alias("p"))


@query("x17_path_suffix", "SELECT doc_id, regexp_replace(doc_slug || '.csv', '\\.([^.]*)$', '_ratio.\\1') AS path FROM documents")
def _(spark, d):
    return read(spark, d, "documents", "doc_id", "doc_slug").select("doc_id", F.regexp_replace(F.concat("doc_slug", F.lit(".csv")), r"\.([^.]*)$", "_ratio.$1").alias("path"))


@query("x18_numbered_options", "SELECT item_id, '1) ' || question || chr(10) || '2) ' || answer AS options FROM eval_item")
def _(spark, d):
    return read(spark, d, "eval_item").select("item_id", T.numbered_options(F.array("question", "answer")).alias("options"))


_F1 = lambda a, s: f"(CASE WHEN len({a}) < 1 OR len({s}) < 1 OR len(list_filter({a}, lambda w: list_contains({s}, w))) = 0 THEN 0.0 ELSE 2.0 * (len(list_filter({a}, lambda w: list_contains({s}, w)))::DOUBLE / len({s})) * (len(list_filter({a}, lambda w: list_contains({s}, w)))::DOUBLE / len({a})) / ((len(list_filter({a}, lambda w: list_contains({s}, w)))::DOUBLE / len({a})) + (len(list_filter({a}, lambda w: list_contains({s}, w)))::DOUBLE / len({s}))) END)"
_TOK = lambda c: WORDS(f"coalesce({ANSWER(c)}, '')")
_PAIRS = "(SELECT pair_id, max(target_text) AS t, max(chunk_text) AS c FROM stage2_pair GROUP BY pair_id HAVING max(target_text) IS NOT NULL AND max(chunk_text) IS NOT NULL)"


def _pairs(spark, d):
    p = read(spark, d, "stage2_pair", "pair_id", "target_text", "chunk_text").groupBy("pair_id").agg(F.max("target_text").alias("t"), F.max("chunk_text").alias("c"))
    return p.where("t is not null and c is not null")


@query("t01_token_f1", f"WITH k AS (SELECT pair_id, {_TOK('t')} AS a, list_distinct({_TOK('c')}) AS s FROM {_PAIRS}) SELECT pair_id, round({_F1('a', 's')}, 6) AS f1 FROM k")
def _(spark, d):
    return _pairs(spark, d).select("pair_id", F.round(T.token_f1(F.col("t"), F.col("c")), 6).alias("f1"))


@query("t02_supported", f"WITH k AS (SELECT pair_id, {_TOK('t')} AS a, list_distinct({_TOK('c')}) AS s FROM {_PAIRS}) SELECT pair_id, {_F1('a', 's')} >= 0.6 AS ok FROM k")
def _(spark, d):
    return _pairs(spark, d).select("pair_id", T.supported(F.col("t"), F.col("c")).alias("ok"))


@query("t03_novel_ratio", f"WITH g AS (SELECT pair_id, list_distinct({NGRAMS(WORDS('lower(t)'), 3)}) AS g, list_distinct({NGRAMS(WORDS('lower(c)'), 3)}) AS s FROM {_PAIRS}) SELECT pair_id, round(CASE WHEN len(g) < 1 THEN 0.0 ELSE len(list_filter(g, lambda x: NOT list_contains(s, x)))::DOUBLE / len(g) END, 6) AS novel FROM g")
def _(spark, d):
    return _pairs(spark, d).select("pair_id", F.round(T.novel_ratio(F.col("t"), F.col("c")), 6).alias("novel"))


@query("t04_seam_report", f"""WITH g AS (SELECT pair_id, {SENTENCES('t')} AS k, {SENTENCES('c')} AS src, {NGRAMS(WORDS('lower(t)'), 3)} AS g, {NGRAMS(WORDS('lower(c)'), 3)} AS s FROM {_PAIRS})
SELECT pair_id, CAST(len(list_filter(k, lambda x: NOT list_contains(src, x))) AS BIGINT) AS not_verbatim, CAST(len(list_filter(g, lambda x: NOT list_contains(s, x))) AS BIGINT) AS novel_total, CAST(greatest(0, len(k) - 1) AS BIGINT) AS seams FROM g""")
def _(spark, d):
    g = _pairs(spark, d).select("pair_id", T.sentences(F.col("t")).alias("k"), T.sentences(F.col("c")).alias("src"), T.ngrams(T.words(F.lower("t")), 3).alias("g"), T.ngrams(T.words(F.lower("c")), 3).alias("s"))
    n = lambda c: F.size(c).cast("long")
    report = lambda p: F.struct(n(F.filter(p["k"], lambda x: ~F.array_contains(p["src"], x))).alias("not_verbatim"), n(F.filter(p["g"], lambda x: ~F.array_contains(p["s"], x))).alias("novel_total"), F.greatest(F.lit(0), F.size(p["k"]) - 1).cast("long").alias("seams"))
    return g.select("pair_id", T.let(F.struct("k", "src", "g", "s"), report).alias("r")).select("pair_id", "r.*")


@query("t05_collapse_score", f"WITH k AS (SELECT pair_id, {_TOK('c')} AS a, list_distinct({_TOK('t')}) AS s FROM {_PAIRS}) SELECT pair_id, round({_F1('a', 's')}, 6) AS collapse FROM k")
def _(spark, d):
    return _pairs(spark, d).select("pair_id", F.round(T.token_f1(F.col("c"), F.col("t")), 6).alias("collapse"))


@query("t06_answer_recovery", f"SELECT item_id, CASE WHEN coalesce({ANSWER('answer')}, '') = '' OR contains(coalesce({ANSWER('passage')}, ''), {ANSWER('answer')}) THEN 1.0 ELSE 0.0 END::DOUBLE AS em FROM eval_item")
def _(spark, d):
    from folio.operators.evaluate import answer_recovery

    return read(spark, d, "eval_item").select("item_id", answer_recovery(F.col("answer"), F.col("passage"))[0].cast("double").alias("em"))


_BLANK = S.BLANK
_PARAS = f"""b AS (SELECT doc_id, unnest(range(len(string_split_regex(text, '{_BLANK}')))) AS i, string_split_regex(text, '{_BLANK}') AS bs, regexp_extract_all(text, '{_BLANK}', 1) AS gs FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, i, bs[i+1] AS block, CAST(coalesce(sum(length(bs[i+1]) + coalesce(length(gs[i+1]), 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre FROM b),
p AS (SELECT doc_id, i, {COLLAPSE('block')} AS text, pre + length(block) - length(regexp_replace(block, '^{W}+', '')) AS char_offset FROM o),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_idx, text, char_offset FROM p WHERE text <> '')"""


@query("seg01_paragraphs", f"WITH {_PARAS} SELECT doc_id, CAST(para_idx AS BIGINT) AS para_idx, text, CAST(char_offset AS BIGINT) AS char_offset FROM paras")
def _(spark, d):
    return S.paragraphs(docs(spark, d)).drop("is_scene_break")


@query("seg03_structural_break", f"""SELECT doc_id, para_idx, regexp_matches(text, '{T.BREAK_MARKS}') OR (len({WORDS('text')}) <= 12 AND (regexp_matches(text, '{T.HEADING}') OR regexp_matches(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '^\\p{{Lu}}+$'))) AS is_break
FROM (SELECT doc_id, para_idx, max(text) AS text FROM paragraph GROUP BY ALL)""")
def _(spark, d):
    p = read(spark, d, "paragraph", "doc_id", "para_idx", "text").groupBy("doc_id", "para_idx").agg(F.max("text").alias("text"))
    return p.select("doc_id", "para_idx", T.is_structural_break(F.col("text")).alias("is_break"))


_SENT = f"(SELECT doc_id, unnest(range(len({SENTENCES('text')}))) AS i, {SENTENCES('text')} AS s FROM documents WHERE text IS NOT NULL)"


@query("seg04_sentences", f"SELECT doc_id, CAST(i AS BIGINT) AS sent_idx, s[i+1] AS sentence FROM {_SENT}")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence")).withColumn("sent_idx", F.col("sent_idx").cast("long"))


def _sentence_units(spark, d):
    paras = S.paragraphs(docs(spark, d))
    rows = S.sentence_rows(paras, ["doc_id", "para_idx"])
    rows = rows.withColumn("pos", F.shiftleft("para_idx", 32) + F.col("sent_idx"))  # no paragraph has 2**32 sentences
    return rows.withColumn("n_words", T.word_count(F.col("sentence")))


@query("seg10_paginate_semantic")
def _(spark, d):
    """Chunks of the stored units, cut at the weakest seam between hashed word vectors."""
    from folio.operators.connect import embed_texts

    u = read(spark, d, "semantic_unit", "doc_id", "unit_idx", "items", "is_scene_break").groupBy("doc_id", "unit_idx").agg(F.max("items.sentence").alias("s"), F.max("is_scene_break").alias("is_scene_break"))
    u = u.where("s is not null").select("doc_id", F.col("unit_idx").cast("long").alias("pos"), F.array_join("s", " ").alias("text"), F.coalesce("is_scene_break", F.lit(False)).alias("is_scene_break"))
    u = u.withColumn("key", F.concat_ws("/", "doc_id", "pos"))
    units = u.join(embed_texts(u, "key", "text"), "key").withColumn("n_words", T.word_count(F.col("text")))
    return S.paginate_semantic(S.seam_scores(units, "doc_id").select("doc_id", "pos", "n_words", "is_scene_break", "seam"))


@query("seg14_word_windows", f"WITH w AS (SELECT doc_id, {WORDS('text')} AS w FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 120.0) AS BIGINT))) AS k FROM w) SELECT doc_id, CAST(k AS BIGINT) AS window_idx, array_to_string(w[k*120+1:k*120+120], ' ') AS words FROM k")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.word_windows(F.col("text"), 120)).alias("window_idx", "words")).withColumn("window_idx", F.col("window_idx").cast("long"))


@query("seg15_truncate_words", f"WITH w AS (SELECT doc_id, {WORDS('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(w[1:15], ' ') || CASE WHEN len(w) > 15 THEN '...' ELSE '' END AS head FROM w")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.truncate_words(F.col("text"), 15, "...").alias("head"))


@query("seg16_truncate_at_paragraph", f"WITH {_PARAS}, c AS (SELECT *, sum(len({WORDS('text')})) OVER (PARTITION BY doc_id ORDER BY para_idx) AS cum FROM paras), s AS (SELECT *, min(CASE WHEN cum > 150 AND para_idx > 0 THEN para_idx END) OVER (PARTITION BY doc_id) AS stop FROM c) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_paras, CAST(max(char_offset + length(text)) AS BIGINT) AS n_chars FROM s WHERE stop IS NULL OR para_idx < stop GROUP BY doc_id")
def _(spark, d):
    kept = S.truncate_at_paragraph(S.paragraphs(docs(spark, d)), 150)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paras"), F.max(F.col("char_offset") + F.length("text")).cast("long").alias("n_chars"))


@query("seg17_strip_boilerplate", f"SELECT doc_id, regexp_replace(text, '^{W}+|{W}+$', '', 'g') AS body FROM (SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM documents WHERE text IS NOT NULL)")
def _(spark, d):
    """Marks are put around each text first, so that there is something to strip."""
    t = F.regexp_replace("text", "[\\n\\r]", " ")
    return docs(spark, d).select("doc_id", T.strip_boilerplate(F.concat(F.lit("licence\n*** START OF BOOK ***\n"), t, F.lit("\n*** END OF BOOK ***\nmore"))).alias("body"))


@query("seg02_html_paragraphs")
def _(spark, d):
    """Paragraphs of the texts as simple pages."""
    html = F.concat(F.lit("<html><script>var a = '<p>no</p>';</script><p>"), F.regexp_replace("text", BLANK_HTML, "<p>"), F.lit("</html>"))
    return S.html_paragraphs(docs(spark, d).select("doc_id", html.alias("html")), "doc_id")


BLANK_HTML = S.BLANK


@query("f04_min_words", f"SELECT doc_id, CAST(len({WORDS('text')}) AS BIGINT) AS n_words FROM documents WHERE len({WORDS('text')}) >= 200")
def _(spark, d):
    from folio.operators.corpus import bounded_words

    return bounded_words(docs(spark, d), "text", 200).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("f05_aligned", "SELECT p.doc_id, p.para_idx, substring(d.text, CAST(p.char_offset + 1 AS BIGINT), length(p.text)) = p.text AS ok FROM (SELECT doc_id, para_idx, max(text) AS text, max(char_offset) AS char_offset FROM paragraph GROUP BY ALL) p JOIN documents d USING (doc_id)")
def _(spark, d):
    from folio.operators.corpus import aligned

    p = read(spark, d, "paragraph", "doc_id", "para_idx", "text", "char_offset").groupBy("doc_id", "para_idx").agg(F.max("text").alias("p"), F.max("char_offset").alias("o"))
    return p.join(docs(spark, d), "doc_id").select("doc_id", "para_idx", aligned(F.col("text"), F.col("p"), F.col("o")).alias("ok"))


@query("f06_occurrences", "SELECT item_id, CAST((length(passage) - length(replace(passage, answer, ''))) / length(answer) AS BIGINT) AS n, CAST((length(passage) - length(replace(passage, answer, ''))) / length(answer) AS BIGINT) BETWEEN 1 AND 3 AS ok FROM eval_item WHERE length(answer) > 0")
def _(spark, d):
    from folio.operators.corpus import rare_enough

    e = read(spark, d, "eval_item", "item_id", "passage", "answer").where(F.length("answer") > 0)
    return e.select("item_id", T.occurrences(F.col("passage"), F.col("answer")).alias("n"), rare_enough(F.col("passage"), F.col("answer")).alias("ok"))


@query("f07_leak_free", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM eval_item e WHERE contains(d.text, e.passage))")
def _(spark, d):
    from folio.operators.corpus import leak_free

    return leak_free(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "eval_item", "passage"), "doc_id", "text", "passage").select("doc_id")


@query("f08_disjoint", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT doc_id FROM paragraph INTERSECT SELECT DISTINCT doc_id FROM documents)")
def _(spark, d):
    return read(spark, d, "paragraph", "doc_id").intersect(read(spark, d, "documents", "doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("f09_first_variant", "SELECT item_id, answer AS found, CAST(instr(passage, answer) - 1 AS BIGINT) AS pos FROM eval_item WHERE length(answer) > 0 AND contains(passage, answer)")
def _(spark, d):
    from folio.operators.corpus import first_variant

    e = read(spark, d, "eval_item", "item_id", "passage", "answer")
    v = e.select("item_id", first_variant(F.col("passage"), F.array(F.concat(F.lit("\u0001"), "answer"), "answer")).alias("v")).where("v is not null")
    return v.select("item_id", F.col("v.answer").alias("found"), F.col("v.pos").alias("pos"))


@query("f14_lookup_targets", "WITH r AS (SELECT slot_id, 'I need LOOKUP: ' || array_to_string(list_transform(max(origin_indices), lambda x: coalesce(x, -1)), ', ') AS reply FROM memory_slot GROUP BY slot_id HAVING max(origin_indices) IS NOT NULL), n AS (SELECT slot_id, list_filter(list_transform(regexp_extract_all(regexp_extract(reply, '(?i)LOOKUP:?\\s*([\\d,\\s]+)', 1), '(\\d+)', 1), lambda x: CAST(x AS BIGINT)), lambda x: x BETWEEN 0 AND 1000) AS t FROM r) SELECT slot_id, CASE WHEN len(t) > 0 THEN array_to_string(t, ',') END AS targets FROM n")
def _(spark, d):
    m = read(spark, d, "memory_slot", "slot_id", "origin_indices").groupBy("slot_id").agg(F.max("origin_indices").alias("o")).where("o is not null")
    reply = F.concat(F.lit("I need LOOKUP: "), F.array_join(F.transform("o", lambda x: F.coalesce(x, F.lit(-1)).cast("string")), ", "))
    return m.select("slot_id", F.array_join(T.lookup_targets(reply, F.lit(1000)).cast("array<string>"), ",").alias("targets"))


@query("f15_option_number", "SELECT result_id, CAST(nullif(regexp_extract(max(prediction), '([1-5])', 1), '') AS BIGINT) AS option FROM qa_stage2_adaptive_threshold_sweep_ratio0chk GROUP BY result_id")
def _(spark, d):
    q = read(spark, d, "qa_stage2_adaptive_threshold_sweep_ratio0chk", "result_id", "prediction").groupBy("result_id").agg(F.max("prediction").alias("p"))
    return q.select("result_id", T.option_number(F.col("p")).alias("option"))


@query("f16_json_pairs", "SELECT item_id, question AS q, answer AS a FROM eval_item WHERE question IS NOT NULL AND answer IS NOT NULL")
def _(spark, d):
    """Replies that hold the pairs as JSON among other words, one of them incomplete."""
    e = read(spark, d, "eval_item", "item_id", "question", "answer")
    reply = F.concat(F.lit("Here you are: "), F.to_json(F.array(F.struct("question", "answer"), F.struct(F.col("question"), F.lit(None).cast("string").alias("answer")))), F.lit(" done"))
    return e.select("item_id", F.explode(T.json_pairs(reply)).alias("p")).select("item_id", F.col("p.question").alias("q"), F.col("p.answer").alias("a"))


@query("f17_qa_lines", "SELECT item_id, question AS q, answer AS a FROM eval_item")
def _(spark, d):
    e = read(spark, d, "eval_item", "item_id", "question", "answer")
    reply = F.concat(F.lit("Sure.\nQ: "), "question", F.lit("\nA: "), "answer", F.lit("\n"))
    return e.select("item_id", F.explode(T.qa_lines(reply)).alias("p")).select("item_id", "p.q", "p.a")


@query("f13_min_sentences", f"SELECT doc_id, CAST(len({SENTENCES('text')}) AS BIGINT) AS n FROM documents WHERE len({SENTENCES('text')}) >= 2")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n")).where("n >= 2")
