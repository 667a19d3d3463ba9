"""Queries of whole conditions - lookup, structural map, budgeted extraction, seam exposure - and of sequential operators,
each with SQL that reaches the same result another way (recursion instead of folds, closed forms instead of parsing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import vector as V
from folio.operators import corpus as C
from folio.operators import evaluate as E
from folio.operators import memory as M
from folio.operators import segment as S
from folio.operators import select as R
from folio.plans.catalog_text import _TOK, NGRAMS, SENTENCES, WORDS, _F1, docs
from folio.plans.catalog_vector import _BUDGET, COS, out, severities
from folio.plans.registry import query
from folio.runtime import read, shuffle_parts

PIECES = lambda c: f"len(regexp_extract_all({c}, '{T.PIECE}'))"
GENRE = lambda c: f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"
CHUNKS = "c AS (SELECT doc_id, chunk_idx, max(text) AS text FROM chunk GROUP BY doc_id, chunk_idx)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row a chunk, a document's chunks together: later windows over it need no other exchange, and texts that are few
    but costly stay spread."""
    return read(spark, d, "chunk", "doc_id", "chunk_idx", "text").repartition(shuffle_parts(spark), "doc_id").groupBy("doc_id", "chunk_idx").agg(F.max("text").alias("text"))


def genre(c: str) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


# --- budgets that depend on the document ----------------------------------------------------------------------

BUDGET = 200
_RATIO = f"{CHUNKS}, r AS (SELECT doc_id, coalesce(least(1.0, {BUDGET}.0 / nullif(sum({PIECES('text')}), 0)), 1.0) AS ratio FROM c GROUP BY doc_id)"


def with_ratio(c: DataFrame, budget: int = BUDGET, tokens=T.token_count) -> DataFrame:
    """Adds ``ratio``: what share of its document's tokens a budget allows, at most 1, and 1 for a document without any."""
    n = F.sum(tokens(F.col("text"))).over(Window.partitionBy("doc_id"))
    return c.withColumn("ratio", F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(float(budget)), n)), F.lit(1.0)))


@query("t11_dependent_ratio", f"WITH {_RATIO} SELECT doc_id, round(ratio, 6) AS ratio FROM r")
def _(spark, d):
    return with_ratio(chunks(spark, d)).groupBy("doc_id").agg(F.round(F.first("ratio"), 6).alias("ratio"))


_SENT_BUDGET = f"""{_RATIO}, l AS (SELECT doc_id, chunk_idx, {SENTENCES('text')} AS s FROM c), e AS (SELECT doc_id, chunk_idx, unnest(s) AS sentence, unnest(range(len(s))) AS i, len(s) AS n FROM l),
b AS (SELECT e.*, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY len(list_distinct({WORDS('lower(sentence)')})) DESC, i) <= greatest(1, ceil(round(ratio * n, 9))) AS kept FROM e JOIN r USING (doc_id)),
p AS (SELECT *, max(CAST(kept AS INT)) OVER (PARTITION BY doc_id, chunk_idx ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS padded FROM b)"""


def budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every chunk with ``kept``, within the document's ratio by a score (here distinct words), and ``padded``,
    kept or next to it."""
    s = with_ratio(chunks(spark, d)).select("doc_id", "chunk_idx", "ratio", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    s = s.withColumn("score", F.size(F.array_distinct(T.words(F.lower("sentence")))).cast("double"))
    return R.pad(R.ratio_budget(s, ["doc_id", "chunk_idx"], F.col("ratio"), item="i"), ["doc_id", "chunk_idx"], 1, item="i")


def rejoined(s: DataFrame) -> DataFrame:
    return s.groupBy("doc_id", "chunk_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


@query("c15_dependent_ratio", f"WITH {_SENT_BUDGET} SELECT doc_id, chunk_idx, string_agg(sentence, ' ' ORDER BY i) AS text FROM p WHERE kept GROUP BY doc_id, chunk_idx")
def _(spark, d):
    return rejoined(budgeted(spark, d).where("kept"))


@query("c18_final_selection", f"WITH {_SENT_BUDGET} SELECT doc_id, chunk_idx, string_agg(sentence, ' ' ORDER BY i) AS text FROM p LEFT JOIN documents USING (doc_id) WHERE CASE WHEN {GENRE('genre')} IN ('novel', 'caselaw') THEN padded ELSE kept END GROUP BY doc_id, chunk_idx")
def _(spark, d):
    """The dependent ratio, with a neighbour on each side for two genres."""
    g = read(spark, d, "documents", "doc_id", genre("genre").alias("genre"))
    wide = F.coalesce(F.col("genre").isin("novel", "caselaw"), F.lit(False))
    return rejoined(budgeted(spark, d).join(g, "doc_id", "left").where(F.when(wide, F.col("padded")).otherwise(F.col("kept"))))


# --- lookups --------------------------------------------------------------------------------------------------
# A label's vectors, without the queries, are a document's chunks; a query asks about its own label. The model's reply names
# two of them.

_LOOK = f"""ch AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE vec_id % 100 <> 0),
sc AS (SELECT a.vec_id AS key, b.idx, b.n, {COS} AS score FROM embeddings a JOIN ch b USING (label) WHERE a.vec_id % 100 = 0),
tg AS (SELECT key, max(n) - 1 AS hi, [key % max(n), (key * 7 + 3) % max(n)]::BIGINT[] AS t FROM sc GROUP BY key)"""


def _FOLD(lists: str) -> str:  # noqa: N802
    """Targets of a CTE (key, t, hi) with their neighbours, by recursion."""
    return f"""l AS (SELECT key, hi, list_filter(t, lambda x: x BETWEEN 0 AND hi) AS t FROM {lists}), rec AS (SELECT key, t, hi, 0 AS k, []::BIGINT[] AS kept, false AS stopped FROM l UNION ALL
SELECT key, t, hi, k + 1, CASE WHEN stopped OR len(u) > 20 THEN kept ELSE u END, stopped OR len(u) > 20 FROM (SELECT *, list_distinct(list_concat(kept, range(greatest(0, t[k + 1] - 2), least(hi, t[k + 1] + 2) + 1))) AS u FROM rec WHERE k < len(t)))"""


_KEPT = "array_to_string(list_sort(kept)[1:20], ',')"


def look_base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks: label, idx, n, vec), (scores: key, idx, score), (targets: key, label, hi, t)."""
    e = read(spark, d, "embeddings", "vec_id", "embedding", "label")
    w = Window.partitionBy("label")
    ch = e.where("vec_id % 100 <> 0").select("label", (F.row_number().over(w.orderBy("vec_id")) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(w).alias("n"), F.col("embedding").alias("vec"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("q"))
    sc = q.join(ch, "label").select("key", "label", "idx", "n", F.round(V.cosine(F.col("q"), F.col("vec")), 10).alias("score"))
    reply = F.concat(F.lit("LOOKUP: "), (F.col("key") % F.col("n")).cast("string"), F.lit(", "), ((F.col("key") * 7 + 3) % F.col("n")).cast("string"))
    tg = q.join(ch.select("label", "n").distinct(), "label").select("key", "label", (F.col("n") - 1).alias("hi"), T.lookup_targets(reply, F.col("n") - 1).alias("t"))
    return ch, sc.select("key", "idx", "score"), tg


def best(df: DataFrame, group: list[str], k: int) -> DataFrame:
    """group and ``items``: indices of the k best, in order."""
    top = R.top_k(df, group, k, item="idx")
    return top.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "idx"))), lambda x: x["idx"]).alias("items"))


def windows(lists: DataFrame, t: Column) -> DataFrame:
    return lists.select("key", F.array_join(R.lookup_window(t, F.col("hi")).cast("array<string>"), ",").alias("chunks"))


@query("r14_lookup_window", f"WITH RECURSIVE tg AS (SELECT slot_id AS key, 20000 AS hi, list_transform(list_filter(max(origin_indices), lambda x: x IS NOT NULL), lambda x: CAST(x AS BIGINT)) AS t FROM memory_slot GROUP BY slot_id HAVING max(origin_indices) IS NOT NULL), {_FOLD('tg')} SELECT key AS slot_id, {_KEPT} AS kept FROM rec WHERE k = len(t)")
def _(spark, d):
    m = read(spark, d, "memory_slot", "slot_id", "origin_indices").groupBy("slot_id").agg(F.max("origin_indices").alias("o")).where("o is not null")
    t = F.transform(F.filter("o", lambda x: x.isNotNull()), lambda x: x.cast("long"))
    return m.select("slot_id", F.array_join(R.lookup_window(t, F.lit(20000).cast("long")).cast("array<string>"), ",").alias("kept"))


@query("c05_lookup", f"WITH RECURSIVE {_LOOK}, {_FOLD('tg')} SELECT key, {_KEPT} AS chunks FROM rec WHERE k = len(t)")
def _(spark, d):
    """The chunks that the reply names, with their neighbours."""
    _, _, tg = look_base(spark, d)
    return windows(tg, F.col("t"))


@query("c06_lookup_retrieval", f"""WITH RECURSIVE {_LOOK}, top3 AS (SELECT key, list(idx ORDER BY score DESC, idx)[1:3] AS items FROM sc GROUP BY key),
tn AS (SELECT key, unnest(t) AS target, generate_subscripts(t, 1) AS place FROM tg), own AS (SELECT vec_id AS key, label FROM embeddings),
rl AS (SELECT tn.key, tn.place, list(b.idx ORDER BY {COS} DESC, b.idx)[1:2] AS items FROM tn JOIN own USING (key) JOIN ch a ON a.label = own.label AND a.idx = tn.target JOIN ch b ON b.label = own.label AND b.idx <> a.idx GROUP BY tn.key, tn.place),
rel AS (SELECT key, flatten(list(items ORDER BY place)) AS items FROM rl GROUP BY key),
al AS (SELECT tg.key, hi, list_concat(list_concat(t, top3.items), coalesce(rel.items, [])) AS t FROM tg JOIN top3 USING (key) LEFT JOIN rel USING (key)), {_FOLD('al')} SELECT key, {_KEPT} AS chunks FROM rec WHERE k = len(t)""")
def _(spark, d):
    """Targets, the question's three best chunks, and two related ones of each target, in this order."""
    ch, sc, tg = look_base(spark, d)
    one = tg.select("key", "label", F.posexplode("t").alias("place", "target"))
    of = ch.select("label", F.col("idx").alias("target"), F.col("vec").alias("tv"))
    pairs = one.join(of, ["label", "target"]).join(ch.select("label", "idx", "vec"), "label").where("idx <> target")
    related = best(pairs.withColumn("score", F.round(V.cosine(F.col("tv"), F.col("vec")), 10)), ["key", "place"], 2)
    related = related.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "items"))), lambda x: x["items"])).alias("related"))
    a = tg.join(best(sc, ["key"], 3), "key").join(related, "key", "left")
    return windows(a, F.concat("t", "items", F.coalesce("related", F.array().cast("array<bigint>"))))


@query("c07_lookup_adaptive", f"""WITH {_LOOK}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, idx) AS rank, max(score) OVER (PARTITION BY key) AS top FROM sc),
u AS (SELECT key, idx FROM r WHERE rank <= 40 AND (rank = 1 OR (top > 0 AND score >= top * 0.85)) UNION SELECT tg.key, x.idx FROM (SELECT key, hi, unnest(t) AS t FROM tg) tg, LATERAL (SELECT unnest(range(greatest(0, tg.t - 1), least(tg.hi, tg.t + 1) + 1)) AS idx) x)
SELECT key, array_to_string(list(idx ORDER BY idx)[1:40], ',') AS chunks FROM u GROUP BY key""")
def _(spark, d):
    """Adaptive selection by the question, and the targets with one neighbour on each side; the first forty."""
    _, sc, tg = look_base(spark, d)
    chosen = R.adaptive_k(sc, ["key"], item="idx").groupBy("key").agg(F.collect_set("idx").alias("items"))
    near = F.flatten(F.transform("t", lambda x: F.sequence(F.greatest(F.lit(0).cast("long"), x - 1), F.least(F.col("hi"), x + 1))))
    a = tg.join(chosen, "key", "left")
    union = F.array_union(F.coalesce("items", F.array().cast("array<bigint>")), near)
    return a.select("key", F.array_join(F.slice(F.array_sort(union), 1, 40).cast("array<string>"), ",").alias("chunks"))


# --- the structural map ---------------------------------------------------------------------------------------

_LABELS = f"""{CHUNKS}, w AS (SELECT *, {WORDS('text')} AS w FROM c), m AS (SELECT doc_id, chunk_idx, text, CASE WHEN chunk_idx % 4 = 0 AND len(w) > 1 THEN array_to_string(w[2:3], ' ') WHEN chunk_idx % 2 = 0 AND len(w) > 0 THEN array_to_string(w[1:2], ' ') ELSE array_to_string(w[1:6], ' ') END AS label FROM w)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their labels from a document's reply. The stub model has a line ``[i]: ...`` for every second chunk and,
    further down, another one ``i. ...`` for every fourth, which wins; chunks without a line get their first six words."""
    c = chunks(spark, d)
    words = T.words(F.col("text"))
    line = F.when((F.col("chunk_idx") % 2 == 0) & (F.size(words) > 0), F.concat(F.lit("["), F.col("chunk_idx").cast("string"), F.lit("]: "), F.array_join(F.slice(words, 1, 2), " ")))
    more = F.when((F.col("chunk_idx") % 4 == 0) & (F.size(words) > 1), F.concat(F.lit(" "), F.col("chunk_idx").cast("string"), F.lit(". "), F.array_join(F.slice(words, 2, 2), " ")))
    listed = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("chunk_idx", x.alias("x"))))), lambda y: y["x"]), "\n")
    reply = c.groupBy("doc_id").agg(F.concat(F.lit("Here is the list\n"), listed(line), F.lit("\n"), listed(more)).alias("reply"))
    lines = reply.select("doc_id", F.posexplode(T.label_lines(F.col("reply"))).alias("place", "l"))
    last = lines.groupBy("doc_id", F.col("l.idx").cast("int").alias("chunk_idx")).agg(F.max_by("l.label", "place").alias("label"))
    return c.join(last, ["doc_id", "chunk_idx"], "left").withColumn("label", F.coalesce("label", T.truncate_words(F.col("text"), 6)))


@query("f18_label_lines", f"WITH {_LABELS} SELECT doc_id, chunk_idx, label FROM m")
def _(spark, d):
    return labelled(spark, d).select("doc_id", "chunk_idx", "label")


@query("c14_structural_map", f"""WITH {_LABELS}, q AS (SELECT doc_id, list_distinct(({WORDS('lower(arg_max(text, chunk_idx))')})[1:12]) AS q FROM m GROUP BY doc_id),
t AS (SELECT m.*, q FROM m JOIN q USING (doc_id) WHERE len(list_intersect({WORDS('lower(label)')}, q)) > 0), e AS (SELECT doc_id, chunk_idx, q, unnest({SENTENCES('text')}) AS sentence, unnest(range(len({SENTENCES('text')}))) AS i FROM t),
s AS (SELECT *, round(len(list_intersect(list_distinct({WORDS('lower(sentence)')}), q)) / len(list_distinct({WORDS('lower(sentence)')}))::DOUBLE, 10) AS score FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_idx, i) AS rank, max(score) OVER (PARTITION BY doc_id) AS top FROM s)
SELECT doc_id, chunk_idx, CAST(i AS BIGINT) AS sent_idx, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 60 AND (rank = 1 OR (top > 0 AND score >= top * 0.85))""")
def _(spark, d):
    """Labels, then the chunks whose label the question touches (as the reply's LOOKUP line), then their best sentences. The
    question is made of the first twelve words of a document's last chunk."""
    m = labelled(spark, d)
    q = m.groupBy("doc_id").agg(F.max("chunk_idx").cast("long").alias("hi"), F.array_distinct(F.slice(T.words(F.lower(F.max_by("text", "chunk_idx"))), 1, 12)).alias("q"))
    m = m.join(q, "doc_id")
    named = m.where(F.arrays_overlap(T.words(F.lower("label")), F.col("q"))).groupBy("doc_id").agg(F.concat(F.lit("LOOKUP: "), F.array_join(F.collect_list(F.col("chunk_idx").cast("string")), ", ")).alias("reply"))
    t = m.join(named, "doc_id").where(F.array_contains(T.lookup_targets(F.col("reply"), F.col("hi")), F.col("chunk_idx").cast("long")))
    s = t.select("doc_id", "chunk_idx", "q", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    words = F.array_distinct(T.words(F.lower("sentence")))
    share = T.let(F.struct(words.alias("w"), F.col("q").alias("q")), lambda p: F.size(F.array_intersect(p["w"], p["q"])) / F.size(p["w"]).cast("double"))
    s = s.withColumn("score", F.round(share, 10)).withColumn("at", F.struct("chunk_idx", "i"))
    kept = R.adaptive_k(s, ["doc_id"], cap=60, item="at")
    return kept.select("doc_id", "chunk_idx", F.col("i").cast("long").alias("sent_idx"), F.col("rank").cast("long").alias("rank"))


@query("c25_map_and_context", f"WITH {CHUNKS}, w AS (SELECT doc_id, chunk_idx, text, {WORDS('text')} AS w FROM c) SELECT doc_id, string_agg('[' || chunk_idx || '] ' || array_to_string(w[1:15], ' ') || CASE WHEN len(w) > 15 THEN '...' ELSE '' END, chr(10) ORDER BY chunk_idx) || chr(10) || chr(10) || string_agg('[chunk ' || chunk_idx || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_idx) AS prompt FROM w GROUP BY doc_id")
def _(spark, d):
    """The map of all chunks before the whole text."""
    c = chunks(spark, d)
    line = F.concat(F.lit("["), F.col("chunk_idx").cast("string"), F.lit("] "), T.truncate_words(F.col("text"), 15, "..."))
    g = c.select("doc_id", "chunk_idx", "text", line.alias("line")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_idx").alias("idx"), "text", "line"))).alias("parts"))
    return g.select("doc_id", F.concat(F.array_join(F.transform("parts", lambda x: x["line"]), "\n"), F.lit("\n\n"), T.context_block(F.col("parts"))).alias("prompt"))


# --- segmentation ---------------------------------------------------------------------------------------------

_BARE = "regexp_replace(sentence, '([A-Za-z0-9])[''’]', '\\1', 'g')"
_COUNT = lambda p: f"(length({_BARE}) - length(regexp_replace({_BARE}, '{p}', '', 'g')))"
_BREAK = f"(regexp_matches(text, '{T.BREAK_MARKS}') OR (len({WORDS('text')}) <= 12 AND (regexp_matches(text, '{T.HEADING}') OR regexp_matches(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '^\\p{{Lu}}+$'))))"
#: Paragraphs, their sentences, and the groups that quotations hold together, by recursion over a paragraph's sentences.
_GROUPS = f"""pa AS (SELECT doc_id, para_idx, text, o, coalesce(b, {_BREAK}) AS brk FROM (SELECT doc_id, para_idx, max(text) AS text, max(char_offset) AS o, bool_or(is_scene_break) AS b FROM paragraph GROUP BY doc_id, para_idx)),
sl AS (SELECT doc_id, para_idx, o, text, brk, CASE WHEN brk THEN [text] ELSE {SENTENCES('text')} END AS s FROM pa),
se AS (SELECT doc_id, para_idx, o, text, brk, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM sl),
sq AS (SELECT *, {_COUNT('[“‘]')} - {_COUNT('[”’]')} AS curly, {_COUNT(chr(34))} % 2 AS odd, len({WORDS('sentence')}) AS w FROM se),
rec AS (SELECT doc_id, para_idx, i, 0 AS g, greatest(0, curly) AS depth, odd AS straight FROM sq WHERE i = 0 UNION ALL
 SELECT q.doc_id, q.para_idx, q.i, CASE WHEN rec.depth = 0 AND rec.straight = 0 THEN rec.g + 1 ELSE rec.g END, greatest(0, rec.depth + q.curly), (rec.straight + q.odd) % 2 FROM rec JOIN sq q ON q.doc_id = rec.doc_id AND q.para_idx = rec.para_idx AND q.i = rec.i + 1),
gr AS (SELECT sq.*, rec.g, sum(sq.w) OVER (PARTITION BY doc_id, para_idx, g) AS gw, count(*) OVER (PARTITION BY doc_id, para_idx, g) AS gn FROM sq JOIN rec USING (doc_id, para_idx, i)),
un AS (SELECT doc_id, para_idx, CASE WHEN gn > 1 AND gw > 120 THEN i ELSE min(i) OVER (PARTITION BY doc_id, para_idx, g) END AS u, i, sentence, w, brk, o, text FROM gr)"""


def para_rows(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "paragraph", "doc_id", "para_idx", "text", "char_offset", "is_scene_break").repartition(shuffle_parts(spark), "doc_id").groupBy("doc_id", "para_idx").agg(F.max("text").alias("text"), F.max("char_offset").alias("char_offset"), F.max("is_scene_break").alias("is_scene_break"))
    return p.withColumn("is_scene_break", F.coalesce("is_scene_break", T.is_structural_break(F.col("text"))))


@query("seg08_semantic_units", f"""WITH RECURSIVE {_GROUPS}, k AS (SELECT doc_id, para_idx, u, count(*) AS n_items, sum(w) AS word_count, bool_or(brk) AS brk, string_agg(sentence, ' ' ORDER BY i) AS text, min(o) AS o, arg_min(sentence, i) AS head, any_value(text) AS whole FROM un GROUP BY doc_id, para_idx, u)
SELECT doc_id, CAST(row_number() OVER w - 1 AS BIGINT) AS unit_idx, para_idx AS paragraph_index, CAST(sum(n_items) OVER w - n_items AS BIGINT) AS sentence_start, CAST(sum(n_items) OVER w - 1 AS BIGINT) AS sentence_end, CAST(n_items AS BIGINT) AS n_items, CAST(word_count AS BIGINT) AS word_count, brk AS is_scene_break, text FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx, u)""")
def _(spark, d):
    return S.semantic_units(para_rows(spark, d)).drop("char_offset")


@query("seg06_dialogue_groups", f"WITH RECURSIVE {_GROUPS} SELECT doc_id, para_idx, CAST(row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY u) - 1 AS BIGINT) AS group_idx, CAST(min(i) AS BIGINT) AS first_sent, CAST(max(i) AS BIGINT) AS last_sent, CAST(sum(w) AS BIGINT) AS n_words FROM un GROUP BY doc_id, para_idx, u")
def _(spark, d):
    return S.dialogue_groups(S.sentence_rows(para_rows(spark, d), ["doc_id", "para_idx"]), ["doc_id", "para_idx"])


@query("seg07_paginate_words", f"""WITH RECURSIVE {_GROUPS}, k AS (SELECT doc_id, para_idx, u, sum(w) AS n, bool_or(brk) AS brk FROM un GROUP BY doc_id, para_idx, u), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, u) - 1 AS pos FROM k),
pg AS (SELECT doc_id, pos, 0 AS chunk_idx, n AS held, brk FROM o WHERE pos = 0 UNION ALL SELECT o.doc_id, o.pos, CASE WHEN x THEN pg.chunk_idx + 1 ELSE pg.chunk_idx END, CASE WHEN x THEN o.n ELSE pg.held + o.n END, o.brk FROM (SELECT *, true AS one FROM pg) pg JOIN o ON o.doc_id = pg.doc_id AND o.pos = pg.pos + 1, LATERAL (SELECT pg.brk OR (pg.held >= 100 AND pg.held + o.n > 300) AS x) y)
SELECT pg.doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos, CAST(sum(n) AS BIGINT) AS n_words FROM pg JOIN o USING (doc_id, pos) GROUP BY pg.doc_id, chunk_idx""")
def _(spark, d):
    """Pages of the built units by their words."""
    u = S.semantic_units(para_rows(spark, d)).select("doc_id", F.col("unit_idx").alias("pos"), F.col("word_count").alias("n_words"), "is_scene_break")
    return S.paginate_words(u)


@query("seg05_sentence_spans", f"""WITH RECURSIVE pa AS (SELECT doc_id, para_idx, max(text) AS text FROM paragraph GROUP BY doc_id, para_idx), sl AS (SELECT *, {SENTENCES('text')} AS s FROM pa),
rec AS (SELECT doc_id, para_idx, text, s, 0 AS k, 0 AS done, -1 AS found FROM sl UNION ALL SELECT doc_id, para_idx, text, s, k + 1, CASE WHEN f > 0 THEN done + f - 1 + length(s[k + 1]) ELSE done END, CASE WHEN f > 0 THEN done + f - 1 ELSE -1 END FROM (SELECT *, instr(substring(text, done + 1), s[k + 1]) AS f FROM rec WHERE k < len(s)))
SELECT doc_id, para_idx, CAST(found AS BIGINT) AS start, CAST(found + length(s[k]) AS BIGINT) AS "end", s[k] AS sentence FROM rec WHERE k > 0 AND found >= 0""")
def _(spark, d):
    """Spans by forward search, on paragraphs, whose white space is normal."""
    p = read(spark, d, "paragraph", "doc_id", "para_idx", "text").groupBy("doc_id", "para_idx").agg(F.max("text").alias("text"))
    return p.select("doc_id", "para_idx", F.explode(T.sentence_spans(F.col("text"))).alias("s")).select("doc_id", "para_idx", "s.start", "s.end", "s.sentence")


@query("seg13_word_spans", f"""WITH g AS (SELECT doc_id, length(text) AS n, string_split_regex(text, '{T.WS}+') AS w, regexp_extract_all(text, '{T.WS}+') AS gap FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(len(w))) AS i, gap FROM g), p AS (SELECT doc_id, n, w, i, sum(length(w) + coalesce(length(gap[i + 1]), 0)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - coalesce(length(gap[i + 1]), 0) AS pos0 FROM x),
f AS (SELECT doc_id, n, pos0, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM p WHERE w <> ''), s AS (SELECT doc_id, n, k // 200 AS window_idx, min(pos0) AS start, count(*) AS n_words FROM f GROUP BY doc_id, n, k // 200)
SELECT doc_id, CAST(window_idx AS BIGINT) AS window_idx, CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY window_idx), n) AS BIGINT) AS "end", CAST(n_words AS BIGINT) AS n_words FROM s""")
def _(spark, d):
    return S.word_spans(docs(spark, d), 200)


@query("seg18_chunk_runs", """WITH c AS (SELECT DISTINCT doc_id, chunk_idx FROM chunk), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM c), r AS (SELECT *, unnest([0, 1, 2]) AS run, greatest(2, (n - 2) // 2) AS stride FROM p WHERE n >= 2)
SELECT doc_id, CAST(run AS BIGINT) AS run, chunk_idx, CAST(pos - run * stride AS BIGINT) AS place FROM r WHERE pos >= run * stride AND pos < run * stride + 2 AND run * stride + 2 <= n""")
def _(spark, d):
    return S.chunk_runs(read(spark, d, "chunk", "doc_id", "chunk_idx").distinct(), "doc_id", "chunk_idx", 3, 2)


# --- analytics ------------------------------------------------------------------------------------------------

_SEV = f"{_BUDGET}, k AS (SELECT query_id, label, item_id AS before, lead(item_id) OVER (PARTITION BY query_id, label ORDER BY item_id) AS after FROM kept WHERE kept), g AS (SELECT * FROM k WHERE after - before > 1), v AS (SELECT g.query_id, 1 - {COS} AS severity FROM g JOIN embeddings a ON a.vec_id = g.before JOIN embeddings b ON b.vec_id = g.after)"


@query("a24_severity_exposure", f"WITH {_SEV}, q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, CAST(count(severity) AS BIGINT) AS n_seams, round(coalesce(sum(severity), 0), 6) AS total, round(coalesce(avg(severity), 0), 6) AS mean, round(coalesce(max(severity), 0), 6) AS highest FROM q LEFT JOIN v USING (query_id) GROUP BY query_id")
def _(spark, d):
    """Seam exposure of questions, zeros where a question has no seams. Every second question here was asked of nothing."""
    s = severities(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_seams"), F.sum("severity").alias("total"), F.avg("severity").alias("mean"), F.max("severity").alias("highest"))
    q = read(spark, d, "embeddings", F.col("vec_id").alias("query_id")).where("query_id % 50 = 0")
    return out(q.join(s, "query_id", "left").fillna(0, ["n_seams"]).fillna(0.0, ["total", "mean", "highest"]))


_ERFC = f"((((({E.ERFC_A[4]} * t + {E.ERFC_A[3]}) * t + {E.ERFC_A[2]}) * t + {E.ERFC_A[1]}) * t + {E.ERFC_A[0]}) * t * exp(-x * x))"


@query("a26_mann_whitney", f"""WITH qa AS (SELECT result_id, bool_or(correct) AS g, max(elapsed_seconds) AS v FROM qa_stage2_adaptive_threshold_sweep_ratio0chk GROUP BY result_id), f AS (SELECT * FROM qa WHERE v IS NOT NULL AND g IS NOT NULL), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM f),
t AS (SELECT CAST(sum(CASE WHEN g THEN r ELSE 0 END) AS DOUBLE) AS ra, CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) AS DOUBLE) AS na, CAST(count(*) AS DOUBLE) AS n FROM r), ti AS (SELECT CAST(sum(m * m * m - m) AS DOUBLE) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS m FROM f GROUP BY v)),
u AS (SELECT *, ra - na * (na + 1) / 2 AS u, sqrt(na * (n - na) / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM t, ti), z AS (SELECT *, greatest(0, abs(u - na * (n - na) / 2) - 0.5) / sd AS z FROM u), e AS (SELECT *, z / sqrt(2.0) AS x, 1 / (1 + {E.ERFC_P} * z / sqrt(2.0)) AS t FROM z)
SELECT round(u, 6) AS u, CAST(na AS BIGINT) AS n_first, CAST(n - na AS BIGINT) AS n_rest, round(z, 6) AS z, round(least(1.0, {_ERFC}), 6) AS p FROM e""")
def _(spark, d):
    """Whether right and wrong answers differ in the time they took."""
    from folio.plans.catalog_eval import qa

    u = E.mann_whitney(qa(spark, d), "elapsed_seconds", "correct", True)
    r = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return u.select(r("u"), F.col("n_first").cast("long").alias("n_first"), F.col("n_rest").cast("long").alias("n_rest"), r("z"), r("p"))


_MEANS = f"{_SEV}, m AS (SELECT query_id, round(avg(severity), 9) AS severity FROM v GROUP BY query_id), o AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS place, count(*) OVER () AS n FROM m)"


_OUTCOMES = f"""WITH {_MEANS}, qa AS (SELECT result_id, bool_or(correct) AS correct FROM qa_stage2_adaptive_threshold_sweep_ratio0chk GROUP BY result_id), q AS (SELECT correct, (row_number() OVER (ORDER BY result_id) - 1) % (SELECT max(n) FROM o) AS place FROM qa WHERE correct IS NOT NULL),
f AS (SELECT correct AS g, severity AS v FROM q JOIN o USING (place))"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """correct and severity: the sweep's outcomes joined to seam exposure. The tables own no common key, so the results are
    dealt in order to all queries that have seams."""
    from folio.plans import catalog_eval, catalog_vector
    from folio.runtime import cut

    s = cut(catalog_vector.severities(spark, d).groupBy("query_id").agg(F.round(F.avg("severity"), 9).alias("severity")))
    s = C.with_row_number(s, ["query_id"], "place").select("place", "severity")
    q = C.with_row_number(catalog_eval.qa(spark, d).where("correct is not null").select("result_id", "correct"), ["result_id"], "place")
    q = q.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("n_queries")))).withColumn("place", F.col("place") % F.col("n_queries"))  # one row
    return q.join(s, "place").select("correct", "severity")


@query("c26_seam_outcomes", f"{_OUTCOMES} SELECT g AS correct, round(avg(v), 6) AS mean_severity, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY g")
def _(spark, d):
    """Mean severity of right and wrong answers."""
    return outcomes(spark, d).groupBy("correct").agg(F.round(F.avg("severity"), 6).alias("mean_severity"), F.count(F.lit(1)).alias("n"))


@query("c26_seam_test", f"""{_OUTCOMES}, r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM f), t AS (SELECT CAST(sum(CASE WHEN g THEN r ELSE 0 END) AS DOUBLE) AS ra, CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) AS DOUBLE) AS na, CAST(count(*) AS DOUBLE) AS n FROM r),
ti AS (SELECT CAST(sum(m * m * m - m) AS DOUBLE) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS m FROM f GROUP BY v)), z AS (SELECT greatest(0, abs(ra - na * (na + 1) / 2 - na * (n - na) / 2) - 0.5) / sqrt(na * (n - na) / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM t, ti), e AS (SELECT z, z / sqrt(2.0) AS x, 1 / (1 + {E.ERFC_P} * z / sqrt(2.0)) AS t FROM z)
SELECT round(z, 6) AS z, round(least(1.0, {_ERFC}), 6) AS p FROM e""")
def _(spark, d):
    """The chance of as great a difference between the severities of right and wrong answers."""
    return E.mann_whitney(outcomes(spark, d), "severity", "correct", True).select(F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


_PAIR = "p AS (SELECT pair_id, max(conditioning) AS c, max(chunk_position) AS pos, max(target_text) AS t, max(previous_summary) AS s, max(chunk_text) AS k FROM stage2_pair GROUP BY pair_id)"


def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "stage2_pair", "pair_id", "conditioning", "chunk_position", "target_text", "previous_summary", "chunk_text").groupBy("pair_id")
    return p.agg(F.max("conditioning").alias("c"), F.max("chunk_position").alias("pos"), F.max("target_text").alias("t"), F.max("previous_summary").alias("s"), F.max("chunk_text").alias("k"))


@query("a27_collapse_stats", f"""WITH {_PAIR}, g AS (SELECT lower(trim(c)) AS variant, list_distinct({NGRAMS(WORDS('lower(t)'), 3)}) AS g, list_distinct({NGRAMS(WORDS('lower(s)'), 3)}) AS s FROM p WHERE t IS NOT NULL AND coalesce(s, '') <> ''),
v AS (SELECT variant, CASE WHEN len(g) < 1 THEN 0.0 ELSE len(list_filter(g, lambda x: NOT list_contains(s, x)))::DOUBLE / len(g) END AS novel FROM g)
SELECT variant, CAST(count(*) AS BIGINT) AS n, round(avg(novel), 6) AS mean, round(median(novel), 6) AS mid, round(avg(CASE WHEN novel < 0.2 THEN 1.0 ELSE 0.0 END), 6) AS collapse_rate FROM v GROUP BY variant""")
def _(spark, d):
    """Novelty of states against their context by variant, over rows with context: mean, median, share that collapsed."""
    v = pair_rows(spark, d).where("t is not null and coalesce(s, '') <> ''").select(F.lower(F.trim("c")).alias("variant"), T.novel_ratio(F.col("t"), F.col("s")).alias("novel"))
    return out(v.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("novel").alias("mean"), F.median("novel").alias("mid"), F.avg((F.col("novel") < 0.2).cast("double")).alias("collapse_rate")))


_YEAR = r"(^|[^0-9])1[0-9]{3}([^0-9]|$)"


@query("a28_survival_sets", f"""WITH {CHUNKS}, l AS (SELECT doc_id, chunk_idx, coalesce({GENRE('genre')}, 'unknown') AS genre, {SENTENCES('c.text')} AS s FROM c LEFT JOIN documents USING (doc_id)), e AS (SELECT doc_id, chunk_idx, genre, unnest(s) AS sentence, unnest(range(len(s))) AS i, len(s) AS n FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY length(sentence) DESC, i) AS rank FROM e), x AS (SELECT *, unnest([0.3, 0.5]) AS ratio FROM r)
SELECT coalesce(genre, 'POOLED') AS genre, CAST(ratio AS DOUBLE) AS ratio, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN rank <= greatest(1, ceil(round(ratio * n, 9))) THEN 1.0 ELSE 0.0 END), 6) AS survival FROM x WHERE regexp_matches(sentence, '{_YEAR}') GROUP BY GROUPING SETS ((genre, ratio), (ratio))""")
def _(spark, d):
    """Share of the evidence sentences (those with a year) that a length-scored budget keeps, by genre and ratio, and pooled."""
    g = read(spark, d, "documents", "doc_id", F.coalesce(genre("genre"), F.lit("unknown")).alias("genre"))
    s = chunks(spark, d).join(g, "doc_id", "left").fillna("unknown", ["genre"]).select("doc_id", "chunk_idx", "genre", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    s = R.ranked(s.withColumn("score", F.length("sentence").cast("double")), ["doc_id", "chunk_idx"], item="i").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "chunk_idx")))
    x = s.where(F.col("sentence").rlike(_YEAR)).withColumn("ratio", F.explode(F.array(F.lit(0.3), F.lit(0.5))))
    x = x.withColumn("kept", (F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.round(F.col("ratio") * F.col("n"), 9)))).cast("double"))
    a = x.groupingSets([[F.col("genre"), F.col("ratio")], [F.col("ratio")]], "genre", "ratio").agg(F.count(F.lit(1)).alias("n"), F.avg("kept").alias("survival"))
    return out(a.withColumn("genre", F.coalesce("genre", F.lit("POOLED"))))


@query("a29_growth", f"WITH {_PAIR} SELECT CAST(pos AS BIGINT) AS pos, CAST(count(*) AS BIGINT) AS n, round(avg(len({WORDS('t')})), 6) AS mean_state, round(avg(len({WORDS('k')})), 6) AS mean_passage FROM p WHERE t IS NOT NULL AND k IS NOT NULL GROUP BY pos")
def _(spark, d):
    """Words of states and of their passages by position."""
    p = pair_rows(spark, d).where("t is not null and k is not null").groupBy(F.col("pos").cast("long").alias("pos"))
    return out(p.agg(F.count(F.lit(1)).alias("n"), F.avg(T.word_count(F.col("t"))).alias("mean_state"), F.avg(T.word_count(F.col("k"))).alias("mean_passage")))


@query("a16_retention_by_age", f"""WITH q AS (SELECT pair_id, max(doc_key) AS key, max(chunk_position) AS pos, max(chunk_text) AS c, max(target_text) AS t FROM stage2_pair GROUP BY pair_id HAVING max(doc_key) IS NOT NULL),
pr AS (SELECT key, pos AS source, max(regexp_extract(c, '([^\\s]+ [^\\s]+)', 1)) AS answer FROM q WHERE c IS NOT NULL GROUP BY key, pos), st AS (SELECT key, pos, max(t) AS text FROM q WHERE t IS NOT NULL GROUP BY key, pos),
k AS (SELECT st.pos - pr.source AS age, {_TOK('answer')} AS a, list_distinct({_TOK('text')}) AS s FROM pr JOIN st ON pr.key = st.key AND st.pos >= pr.source), h AS (SELECT age, {_F1('a', 's')} >= 0.6 AS hit FROM k)
SELECT age, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS n_correct, CAST(count(*) AS BIGINT) AS n_probes, round(avg(CAST(hit AS INT)), 6) AS accuracy FROM h GROUP BY age""")
def _(spark, d):
    """Answers of a document's items, probed in every later state of its pairs, however old."""
    p = read(spark, d, "stage2_pair", "pair_id", "doc_key", "chunk_position", "chunk_text", "target_text").groupBy("pair_id").agg(*[F.max(c).alias(c) for c in ("doc_key", "chunk_position", "chunk_text", "target_text")]).where("doc_key is not null")
    probes = p.where("chunk_text is not null").select(F.col("doc_key").alias("key"), F.col("chunk_position").alias("source"), F.regexp_extract("chunk_text", r"([^\s]+ [^\s]+)", 1).alias("answer"))
    states = p.where("target_text is not null").groupBy(F.col("doc_key").alias("key"), F.col("chunk_position").alias("pos")).agg(F.max("target_text").alias("text"))
    return out(E.retention_by_age(probes.groupBy("key", "source").agg(F.max("answer").alias("answer")), states))


@query("u03_left_over", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS place FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(spark, d):
    """What a selection leaves of its pool, in the pool's order."""
    used = read(spark, d, "orders", F.col("o_custkey").alias("c_custkey"), "o_totalprice").where("o_totalprice > 200000").select("c_custkey").distinct()
    left = read(spark, d, "customer", "c_custkey").join(used, "c_custkey", "left_anti")
    return C.with_row_number(left, ["c_custkey"], "place").select("c_custkey", (F.col("place") + 1).cast("long").alias("place"))


@query("t16_positive_rate", """WITH h AS (SELECT hit_id, max(doc_key) AS k, CASE WHEN max(chunk_idx) % 5 = 0 THEN 1 ELSE 0 END AS y FROM hit GROUP BY hit_id HAVING max(doc_key) IS NOT NULL), n AS (SELECT *, sum(y) OVER (PARTITION BY k) AS pos, row_number() OVER (PARTITION BY k, y ORDER BY md5(CAST(hit_id AS VARCHAR)), hit_id) AS r FROM h),
b AS (SELECT * FROM n WHERE y = 1 OR r <= 3 * pos) SELECT k AS doc_key, round(avg(y), 6) AS rate, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_positive FROM b GROUP BY k""")
def _(spark, d):
    """Examples balanced to one positive in four: all positives, and negatives in the order of a hash; documents without
    positives have nothing to balance against."""
    h = read(spark, d, "hit", "hit_id", "doc_key", "chunk_idx").groupBy("hit_id").agg(F.max("doc_key").alias("doc_key"), F.max("chunk_idx").alias("c")).where("doc_key is not null")
    h = h.withColumn("y", F.coalesce((F.col("c") % 5 == 0).cast("int"), F.lit(0)))
    b = C.balanced(h, "doc_key", "y", "hit_id", 0.25)
    return b.groupBy("doc_key").agg(F.round(F.avg("y"), 6).alias("rate"), F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_positive"))


# --- sequential operators held against recursion ----------------------------------------------------------------

_SIZED = f"s AS (SELECT doc_slug AS key, doc_id AS pos, len({WORDS('text')}) AS n FROM documents WHERE text IS NOT NULL AND doc_slug IS NOT NULL)"


def sized(spark: SparkSession, d: str) -> DataFrame:
    """key (work), pos, n_words of every document of a work."""
    return docs(spark, d, "doc_slug").select(F.col("doc_slug").alias("key"), F.col("doc_id").alias("pos"), T.word_count(F.col("text")).alias("n_words")).where("key is not null")


@query("r20_greedy_band", f"WITH RECURSIVE {_SIZED}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, pos) AS k FROM s), rec AS (SELECT key, 0 AS k, 0 AS held, []::BIGINT[] AS ids FROM (SELECT DISTINCT key FROM o) UNION ALL SELECT o.key, o.k, CASE WHEN held < 500 AND held + n <= 900 THEN held + n ELSE held END, CASE WHEN held < 500 AND held + n <= 900 THEN list_append(ids, pos) ELSE ids END FROM rec JOIN o ON o.key = rec.key AND o.k = rec.k + 1) SELECT key, array_to_string(ids, ',') AS ids, CAST(held AS BIGINT) AS n_words FROM rec QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1")
def _(spark, d):
    """One selection of 500 to 900 words for each whole work, its longest documents first."""
    s = sized(spark, d).withColumn("o", -F.col("n_words"))
    return C.band(s, "key", ["o", "pos"], 500, 900).select("key", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n_words")


@query("r22_pack", f"WITH RECURSIVE {_SIZED}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS k FROM s), rec AS (SELECT key, 0 AS k, 0 AS bin, 0 AS held, false AS put, 0 AS filled, NULL::BIGINT AS pos FROM (SELECT DISTINCT key FROM o) UNION ALL SELECT o.key, o.k, CASE WHEN held >= 400 THEN bin + 1 ELSE bin END, CASE WHEN h + n <= 1200 THEN h + n ELSE h END, h + n <= 1200, h + n, o.pos FROM rec JOIN o ON o.key = rec.key AND o.k = rec.k + 1, LATERAL (SELECT CASE WHEN held >= 400 THEN 0 ELSE held END AS h) x) SELECT key, pos, CAST(bin AS BIGINT) AS bin, CAST(filled AS BIGINT) AS filled FROM rec WHERE put")
def _(spark, d):
    return C.pack(sized(spark, d), "key", 400, 1200)


_ANCHORS = """v AS (SELECT CAST(label AS BIGINT) AS key, vec_id AS pos, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings WHERE embedding IS NOT NULL),
rec AS (SELECT key, 0 AS k, []::DOUBLE[][] AS anchors, NULL::BIGINT AS pos, 0 AS thread_id, false AS opened, 0.0::DOUBLE AS score FROM (SELECT DISTINCT key FROM v) UNION ALL
 SELECT v.key, v.k, CASE WHEN o THEN list_append(anchors, v.e) ELSE anchors END, v.pos, CASE WHEN o THEN len(anchors) ELSE list_position(sims, top) - 1 END, o, CASE WHEN o THEN 1.0 ELSE top END FROM rec JOIN v ON v.key = rec.key AND v.k = rec.k + 1, LATERAL (SELECT list_transform(rec.anchors, lambda a: round(coalesce(list_cosine_similarity(a, v.e), 0), 10)) AS sims) x, LATERAL (SELECT list_max(x.sims) AS top) y, LATERAL (SELECT y.top IS NULL OR y.top < 0.2 AS o) z)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


@query("m01_anchor_clusters", f"WITH RECURSIVE {_ANCHORS} SELECT key, pos, CAST(thread_id AS BIGINT) AS thread_id, opened, round(score, 6) AS score FROM rec WHERE k > 0")
def _(spark, d):
    return out(M.anchor_clusters(rows(spark, d), 0.2))


@query("m01_streaming_threads", f"WITH RECURSIVE {_ANCHORS} SELECT key, pos, CAST(thread_id AS BIGINT) AS thread_id, opened FROM rec WHERE k > 0")
def _(spark, d):
    """The same threads from a file stream."""
    from folio.streaming import replay as P

    st = P.file_stream(spark, f"{d}/embeddings.parquet").select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return P.run_to_table(P.stream_threads(st, 0.2), "threads")


@query("s10_links", "SELECT '/' || coalesce(source, 'none') AS url, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(spark, d):
    """Distinct link targets of pages made of the documents, with the first page that has them."""
    page = F.concat(F.lit("<a href='/"), F.coalesce("source", F.lit("none")), F.lit("'>x</a><a class=k href=\"#top\">[y]</a>"))
    return S.links(read(spark, d, "documents", "doc_id", "source").select("doc_id", page.alias("html")), "doc_id", "html", "^/")


# --- corpora --------------------------------------------------------------------------------------------------

_ANS = "regexp_extract(text, '([0-9]{4})', 1)"


@query("b01_eval_corpus", f"""WITH RECURSIVE q AS (SELECT doc_slug AS key, doc_id AS pos, text, len({WORDS('text')}) AS n, len(regexp_extract_all(text, '[0-9]{{4}}')) AS years FROM documents WHERE text IS NOT NULL AND doc_slug IS NOT NULL), f AS (SELECT *, round(years / n::DOUBLE, 9) AS density FROM q WHERE n >= 50 AND years > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY density DESC, pos) AS k FROM f), rec AS (SELECT key, 0 AS k, 0 AS held, []::BIGINT[] AS ids FROM (SELECT DISTINCT key FROM o) UNION ALL SELECT o.key, o.k, CASE WHEN held < 1000 AND held + n <= 2000 THEN held + n ELSE held END, CASE WHEN held < 1000 AND held + n <= 2000 THEN list_append(ids, pos) ELSE ids END FROM rec JOIN o ON o.key = rec.key AND o.k = rec.k + 1),
c AS (SELECT key, unnest(ids) AS pos FROM (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1)), p AS (SELECT key, pos, text, {_ANS} AS answer, coalesce(sum(length(text) + 2) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM c JOIN f USING (key, pos)),
k AS (SELECT *, o + instr(text, answer) - 1 AS evidence FROM p WHERE (length(text) - length(replace(text, answer, ''))) / length(answer) BETWEEN 1 AND 3)
SELECT key AS doc_slug, CAST(row_number() OVER (PARTITION BY key ORDER BY evidence) AS BIGINT) AS question_id, answer, CAST(evidence AS BIGINT) AS evidence, pos AS doc_id FROM k""")
def _(spark, d):
    """Texts grouped by work, long enough, chosen densest in answers first up to a word band, joined in order with offsets,
    and their answers checked - rare, at their place - and renumbered."""
    q = docs(spark, d, "doc_slug").where("doc_slug is not null").select(F.col("doc_slug").alias("key"), F.col("doc_id").alias("pos"), "text", T.word_count(F.col("text")).alias("n_words"), F.size(F.regexp_extract_all("text", F.lit("([0-9]{4})"), F.lit(1))).alias("years"))
    f = q.where("n_words >= 50 and years > 0").withColumn("o", -F.round(F.col("years") / F.col("n_words"), 9))
    chosen = C.band(f.select("key", "pos", "n_words", "o"), "key", ["o", "pos"], 1000, 2000).select("key", F.explode("ids").alias("pos"))
    placed = C.concat_offsets(f.join(chosen, ["key", "pos"], "left_semi"), ["key"], "pos", "text", 2).withColumn("answer", F.regexp_extract("text", "([0-9]{4})", 1))
    placed = placed.where(C.rare_enough(F.col("text"), F.col("answer"))).withColumn("evidence", F.col("offset") + T.find(F.col("text"), F.col("answer")))
    n = F.row_number().over(Window.partitionBy("key").orderBy("evidence"))
    return placed.select(F.col("key").alias("doc_slug"), n.cast("long").alias("question_id"), "answer", "evidence", F.col("pos").alias("doc_id"))


@query("b03_partition", f"""WITH RECURSIVE t AS (SELECT doc_slug, lower(trim(min(genre))) AS key, sum(len({WORDS('text')})) AS n FROM documents WHERE doc_slug IS NOT NULL AND text IS NOT NULL GROUP BY doc_slug), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(doc_slug), doc_slug) AS k FROM t WHERE key IS NOT NULL),
rec AS (SELECT key, 0 AS k, 0 AS bin, 0::HUGEINT AS held, false AS put, NULL::VARCHAR AS doc_slug FROM (SELECT DISTINCT key FROM o) UNION ALL SELECT o.key, o.k, CASE WHEN held >= 1500 THEN bin + 1 ELSE bin END, CASE WHEN h + n <= 6000 THEN h + n ELSE h END, h + n <= 6000, o.doc_slug FROM rec JOIN o ON o.key = rec.key AND o.k = rec.k + 1, LATERAL (SELECT CASE WHEN held >= 1500 THEN 0 ELSE held END AS h) x)
SELECT key AS genre, doc_slug, CAST(bin AS BIGINT) AS bin, CASE WHEN bin % 5 = 0 THEN 'eval' ELSE 'train' END AS split FROM rec WHERE put""")
def _(spark, d):
    """Titles of a genre in the order of a hash, packed one after the other into corpora; every fifth one is for evaluation."""
    t = docs(spark, d, "doc_slug", "genre").where("doc_slug is not null").groupBy("doc_slug").agg(F.lower(F.trim(F.min("genre"))).alias("key"), F.sum(T.word_count(F.col("text"))).alias("n_words")).where("key is not null")
    t = t.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(F.md5("doc_slug"), "doc_slug")).cast("long"))
    b = C.pack(t.select("key", "pos", "n_words"), "key", 1500, 6000)
    return t.join(b, ["key", "pos"]).select(F.col("key").alias("genre"), "doc_slug", "bin", F.when(F.col("bin") % 5 == 0, "eval").otherwise("train").alias("split"))


@query("b08_length_ladder", f"""WITH w AS (SELECT doc_id, text, len({WORDS('text')}) AS n, instr(text, nullif({_ANS}, '')) AS at_ FROM documents WHERE text IS NOT NULL), e AS (SELECT *, len({WORDS('left(text, CAST(at_ - 1 AS INTEGER))')}) + 1 AS place, unnest([100, 200, 400, 800]) AS v FROM w)
SELECT doc_id, CAST(v AS BIGINT) AS rung, CAST(least(n, v) AS BIGINT) AS n_words, n >= v AS full_, coalesce(place <= least(n, v), false) AS answerable FROM e""")
def _(spark, d):
    """Rungs of growing length over each text, and whether its answer (the first year) still lies within."""
    a = F.nullif(F.regexp_extract("text", "([0-9]{4})", 1), F.lit(""))
    w = docs(spark, d).withColumn("place", T.word_index(F.col("text"), T.find(F.col("text"), a))).select("doc_id", "place", T.word_count(F.col("text")).alias("n"), F.explode(F.array(*[F.lit(v) for v in (100, 200, 400, 800)])).alias("v"))
    held = F.least("n", "v")
    return w.select("doc_id", F.col("v").cast("long").alias("rung"), held.cast("long").alias("n_words"), (F.col("n") >= F.col("v")).alias("full_"), F.coalesce(F.col("place") <= held, F.lit(False)).alias("answerable"))


@query("b09_pair_prep", f"""WITH p AS (SELECT pair_id, {WORDS('max(input_text)')} AS i, max(target_text) AS t FROM stage2_pair GROUP BY pair_id HAVING max(input_text) IS NOT NULL AND max(target_text) IS NOT NULL), s AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR)), pair_id) - 1 AS place, count(*) OVER () AS n FROM p)
SELECT pair_id, 'summarize: ' || array_to_string(i[1:40], ' ') AS source_text, t AS target_text, CASE WHEN place * 10 < n THEN 'dev' ELSE 'train' END AS split FROM s""")
def _(spark, d):
    """Pairs as prompts, shuffled by a hash of their key, the first tenth for development."""
    p = read(spark, d, "stage2_pair", "pair_id", "input_text", "target_text").groupBy("pair_id").agg(F.max("input_text").alias("i"), F.max("target_text").alias("t")).where("i is not null and t is not null")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    s = C.with_row_number(p.withColumn("o", F.md5(F.col("pair_id").cast("string"))), ["o", "pair_id"], "place").crossJoin(F.broadcast(n))  # one row
    return s.select("pair_id", F.concat(F.lit("summarize: "), T.truncate_words(F.col("i"), 40)).alias("source_text"), F.col("t").alias("target_text"), F.when(F.col("place") * 10 < F.col("n"), "dev").otherwise("train").alias("split"))


_NOVEL = lambda w: f"(CASE WHEN len({w}) < 3 THEN 0.0 ELSE len(list_filter(list_distinct({NGRAMS(w, 3)}), lambda x: NOT list_contains(sg, x)))::DOUBLE / len(list_distinct({NGRAMS(w, 3)})) END)"
#: Variants of the loop that makes states: what each adds to the plain one.
VARIANTS = {"baseline": (), "no_context_on_collapse": ("fallback",), "instruction": ("instruction",), "both": ("fallback", "instruction")}


@query("c28_collapse_ablation", f"""WITH {_PAIR}, g AS (SELECT pair_id, {WORDS('lower(t)')} AS t, {WORDS('lower(s)')} AS s, {WORDS('lower(k)')} AS k FROM p WHERE t IS NOT NULL AND k IS NOT NULL AND coalesce(s, '') <> ''),
b AS (SELECT pair_id, list_concat(s[-12:], k[1:8]) AS base, list_concat(['update:'], list_concat(s[-12:], k[1:8])) AS instr, k[1:8] AS alone, s FROM g), n AS (SELECT *, {NGRAMS('s', 3)} AS sg FROM b), v AS (SELECT 'baseline' AS variant, base AS o, sg FROM n UNION ALL SELECT 'no_context_on_collapse', CASE WHEN {{nov}} < 0.5 THEN alone ELSE base END, sg FROM n UNION ALL SELECT 'instruction', instr, sg FROM n UNION ALL SELECT 'both', CASE WHEN {{novi}} < 0.5 THEN alone ELSE instr END, sg FROM n),
r AS (SELECT variant, {{novo}} AS novel FROM v) SELECT variant, CAST(count(*) AS BIGINT) AS n, round(avg(novel), 6) AS mean, round(avg(CASE WHEN novel < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS collapse_rate FROM r GROUP BY variant""".replace("{nov}", _NOVEL("base")).replace("{novi}", _NOVEL("instr")).replace("{novo}", _NOVEL("o")))
def _(spark, d):
    """Collapse of states against their context in four variants of the stub curator, who copies the context's last twelve
    words before the passage's first eight: plain, without context where the state collapsed, with an instruction, both."""
    p = pair_rows(spark, d).where("t is not null and k is not null and coalesce(s, '') <> ''")
    s, k = T.words(F.lower("s")), F.slice(T.words(F.lower("k")), 1, 8)
    base = F.concat(T.let(s, lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - 11), 12)), k)
    instr = F.concat(F.array(F.lit("update:")), base)
    grams = lambda w: F.array_distinct(T.ngrams(w, 3))
    p = p.select(base.alias("base"), instr.alias("instr"), k.alias("alone"), grams(s).alias("sg"))
    novel = lambda w: T.let(F.struct(grams(w).alias("g"), F.col("sg").alias("s")), lambda x: F.when(F.size(x["g"]) < 1, F.lit(0.0)).otherwise(F.size(F.array_except(x["g"], x["s"])) / F.size(x["g"]).cast("double")))

    def state(adds: tuple) -> Column:
        plain = F.col("instr") if "instruction" in adds else F.col("base")
        return F.when(novel(plain) < 0.5, F.col("alone")).otherwise(plain) if "fallback" in adds else plain

    v = p.select("sg", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), state(a).alias("o")) for n, a in VARIANTS.items()])).alias("v")).select("sg", "v.variant", "v.o")
    return out(v.withColumn("novel", novel(F.col("o"))).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("novel").alias("mean"), F.avg((F.col("novel") < 0.5).cast("double")).alias("collapse_rate")))
