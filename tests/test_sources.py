"""Files, injection points, streams and the SQL surface."""

import pytest
from pyspark.sql import functions as F

from folio.operators import connect as K
from folio.sources import files
from folio.streaming import replay as S


def test_csv_with_mark_and_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿question_id,question,answer\n1,"a ""quoted""\nline",x\n00950a_0,b,y\n', encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "q.csv"), "question_id string, question string, answer string").collect()
    assert [tuple(r) for r in rows] == [("1", 'a "quoted"\nline', "x"), ("00950a_0", "b", "y")]
    df = spark.createDataFrame([("1", 'a "q"\nl', "x")], "question_id string, question string, answer string")
    files.write_csv(df, str(tmp_path / "out"), ["answer", "question"], one_file=True)
    back = files.read_csv(spark, str(tmp_path / "out"), "answer string, question string").collect()
    assert [tuple(r) for r in back] == [("x", 'a "q"\nl')]


def test_log_last_wins_and_texts(spark, tmp_path):
    one = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("m", 1, "only")], "key string, n int, v string")
    files.append_log(one, str(tmp_path / "log"))
    files.append_log(one.limit(0), str(tmp_path / "log"))
    got = {r.key: r.v for r in files.read_log(spark, str(tmp_path / "log"), "key string, n int, v string", "key", "n").collect()}
    assert got == {"k": "new", "m": "only"}
    (tmp_path / "t.txt").write_text("﻿one\ntwo", encoding="utf-8")
    assert files.read_texts(spark, str(tmp_path / "t.txt")).first().text == "one\ntwo"
    (tmp_path / "m.json").write_text('{"corpus":\n "c", "n": 3}')
    assert tuple(files.read_json(spark, str(tmp_path / "m.json"), "corpus string, n int").first()) == ("c", 3)


def test_resume(spark, tmp_path):
    want = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, q int")
    done = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 9, None), ("b", 1, "failed")], "g string, q int, error string")
    assert files.todo(want, done, ["g", "q"]).count() == 0
    ok = files.still_valid(done, want, ["g", "q"], ["g"], 1, "error")
    assert sorted((r.g, r.q) for r in ok.collect()) == [("a", 1), ("a", 2)]
    files.replace_partitions(ok, str(tmp_path / "p"), ["g"])
    files.replace_partitions(done.where("g = 'b'"), str(tmp_path / "p"), ["g"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    assert files.to_markdown(ok.select("g").distinct()) == "| g |\n|---|\n| a |"
    with pytest.raises(ValueError):
        files.to_markdown(spark.range(5), limit=3)


def test_embedding_memo_and_failures(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, None), (4, "")], "id long, t string")
    v = {r.id: r.vec for r in K.embed_texts(df, "id", "t").collect()}
    assert v[1] == v[2] and v[3] is None and sum(v[4]) == 0

    def broken(texts, kind):
        raise OSError("down")

    assert all(r.vec is None for r in K.embed_texts(df, "id", "t", broken).collect())
    with pytest.raises(Exception, match="down"):
        K.embed_texts(df, "id", "t", broken, on_error="raise").collect()
    ask = spark.createDataFrame([("a", "passage"), ("a", "passage"), ("b", "query")], "text string, input_type string")
    memo = spark.createDataFrame([("a", "passage", [1.0])], "text string, input_type string, vec array<double>")
    out, new, counts = K.with_memo(ask, memo)
    assert out.count() == 2 and new.count() == 1 and tuple(counts.first()) == (2, 1)
    with pytest.raises(ValueError):
        K.hashed_embed(["x"], "other")


def test_retry_rate_and_order():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert K.retrying(flaky, 3, "linear", 1, slept.append)() == "ok" and slept == [1, 2]
    with pytest.raises(K.ServiceError):
        K.retrying(lambda: 1 / 0, 2, "none")()
    now = [0.0]
    limiter = K.RateLimiter(2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limiter.acquire()
    assert now[0] == 1.0
    with pytest.raises(ValueError):
        K.RateLimiter(0)
    assert K.restore_order([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]) == [[1], [2]]


def test_chat_and_scores(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None)], "id long, p string")
    assert {r.id: r.reply for r in K.chat_rows(df, "id", "p").collect()} == {1: "One.", 2: None}
    s = spark.createDataFrame([("a", 0), ("b", 600)], "sentence string, tokens_before long")
    got = {r.sentence: r.score for r in K.score_sentences(s, lambda ts: [1.0] * len(ts)).collect()}
    assert got == {"a": 1.0, "b": float("-inf")}


def test_stream_equals_batch(spark, tmp_path):
    from folio.operators.memory import anchor_clusters

    rows = [(i % 3, i, [float((i * 7) % 5), float(i % 4), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, pos long, vec array<double>")
    df.where("pos < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = S.run_to_table(S.stream_threads(stream, 0.9), "t").select("key", "pos", "thread_id").collect()
    want = anchor_clusters(df.where("pos < 30"), 0.9).select("key", "pos", "thread_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sql_surface(spark):
    from folio.functions.register import register

    register(spark)
    assert spark.sql("SELECT folio_cosine(array(0D, 0D), array(1D, 2D)), size(folio_words(' a  b ')), folio_collapse(' a  b ')").first()[:] == (0.0, 2, "a b")
    got = spark.sql("SELECT * FROM folio_html_paragraphs('<p>a<p>b c')").collect()
    assert [tuple(r) for r in got] == [(0, "a", 0), (1, "b c", 3)]
    assert spark.range(1).select(F.lit(1)).count() == 1
