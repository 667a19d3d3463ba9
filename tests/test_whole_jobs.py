"""Queries do the whole job: no part of a work, a curve or a chunk is judged by itself."""

import random

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import select as R
from folio.plans import load

QUERIES, _ = load()


def test_r20_one_band_a_work(spark, tmp_path):
    rows = [(i, "w", " ".join(["word"] * 200)) for i in (1, 500, 1500, 2500, 3500)] + [(9000, "v", "a few words")]
    spark.createDataFrame(rows, "doc_id long, doc_slug string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.key, r.ids, r.n_words) for r in QUERIES["r20_greedy_band"](spark, str(tmp_path)).collect()}
    assert got == {("w", "1,500,1500", 600), ("v", "9000", 3)}


def test_a16_every_age(spark, tmp_path):
    rows = [(i, "d", i, f"fact {i} stands", f"fact {i} stands and fact 0 stands") for i in range(21)]
    spark.createDataFrame(rows, "pair_id long, doc_key string, chunk_position long, chunk_text string, target_text string").write.parquet(f"{tmp_path}/stage2_pair.parquet")
    got = {r.age: r.n_probes for r in QUERIES["a16_retention_by_age"](spark, str(tmp_path)).collect()}
    assert got == {age: 21 - age for age in range(21)}


def test_r11_share_of_all_sentences(spark, tmp_path):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice("abcdefghijkl") * 3 for _ in range(rng.randint(2, 9))).capitalize() + "."
    texts = [" ".join(sentence() for _ in range(n)) for n in (1, 3, 7, 130)]
    rows = [(1, i, t) for i, t in enumerate(texts)] + [(2, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_idx long, text string")
    df.write.parquet(f"{tmp_path}/chunk.parquet")
    got = {r.chunk_idx: [int(x) for x in r.chosen.split(",")] for r in QUERIES["r11_mmr"](spark, str(tmp_path)).collect()}
    assert [len(got[i]) for i in range(4)] == [1, 2, 4, 65] and len(set(got[3])) == 65
    s = df.where("text is not null").select("chunk_idx", F.posexplode(T.sentences(F.col("text"))).alias("idx", "s"))
    s = s.withColumn("score", R.minmax(T.word_count(F.col("s")).cast("double"), ["chunk_idx"]))
    items = s.groupBy("chunk_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), "score", F.array_distinct(T.words(F.lower("s"))).alias("words")))).alias("v"))
    want = items.where("chunk_idx < 3").select("chunk_idx", R.mmr(F.col("v"), F.ceil(F.size("v") * 0.5).cast("int")).alias("m"))
    assert {r.chunk_idx: r.m for r in want.collect()} == {i: got[i] for i in range(3)}


def test_c26_every_query_has_outcomes(spark, monkeypatch):
    from folio.plans import catalog_eval, catalog_vector

    s = [(v, float(i)) for i, v in enumerate((0, 100, 200, 300, 400, 500, 1000))]
    q = [(i, i % 7 == 6) for i in range(700)] + [(701, None)]
    monkeypatch.setattr(catalog_vector, "severities", lambda *_: spark.createDataFrame(s, "query_id long, severity double"))
    monkeypatch.setattr(catalog_eval, "qa", lambda *_: spark.createDataFrame(q, "result_id long, correct boolean"))
    got = {tuple(r) for r in QUERIES["c26_seam_outcomes"](spark, "").collect()}
    assert got == {(True, 6.0, 100), (False, 2.5, 600)}
