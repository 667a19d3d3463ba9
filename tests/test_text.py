"""Text functions against plain-Python statements of what they compute."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import text as T


def col(spark, values, f, *more):
    names = ["a", "b"][: 1 + len(more)]
    rows = list(zip(values, *more))
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + schema)
    return [r[0] for r in df.select(f(*[F.col(n) for n in names]).alias("x"), "i").orderBy("i").select("x").collect()]


def test_words_and_index(spark):
    texts = ["a  b\nc", "", "  ", None, "one two", "日本 語"]
    got = col(spark, texts, T.word_count)
    assert got == [3, 0, 0, None, 2, 2]
    df = spark.createDataFrame([("ab cd ef", 4)], "t string, p int")
    assert df.select(T.word_index(F.col("t"), F.col("p"))).first()[0] == len("ab c".split()) + 1


def test_token_f1_can_exceed_one(spark):
    assert col(spark, ["new new york"], T.token_f1, ["new york city visit"])[0] > 0
    got = col(spark, ["new new york", "", None, "the"], T.token_f1, ["new york", "x", "x", "x"])
    assert abs(got[0] - 1.2) < 1e-9 and got[1] == 0.0 and got[3] == 0.0


def test_novel_ratio_short_is_zero(spark):
    assert col(spark, ["a b", "a b c d"], T.novel_ratio, ["x", "a b c x"]) == [0.0, 0.5]


def test_headings_and_breaks(spark):
    got = col(spark, ["* * *", "CHAPTER ONE", "A plain sentence follows here.", "※", "## Notes", "日本語", "IV. Mine"], T.is_structural_break)
    assert got == [True, True, False, True, True, False, True]


def test_sentences_keep_quotes(spark):
    got = col(spark, ["He left. “Why?” she asked. Then... nothing", "no end", ""], T.sentences)
    assert got[0] == ["He left.", "“Why?”", "she asked.", "Then...", "nothing"] and got[1] == ["no end"] and got[2] == []


def test_spans_match_source(spark):
    text = "One. Two two. One. Three"
    for s in col(spark, [text], T.sentence_spans)[0]:
        assert text[s.start : s.end] == s.sentence


def test_reply_parsing(spark):
    df = spark.createDataFrame([("please LOOKUP: 3, 99, 5", "pick 4 now", 'x [{"question":"q","answer":"a"},{"question":"q"}] y')], "a string, b string, c string")
    r = df.select(T.lookup_targets(F.col("a"), F.lit(10)), T.option_number(F.col("b")), T.json_pairs(F.col("c"))).first()
    assert r[0] == [3, 5] and r[1] == 4 and [tuple(p) for p in r[2]] == [("q", "a")]
    assert df.select(T.lookup_targets(F.lit("nothing"), F.lit(3))).first()[0] is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab c.\n", max_size=30), min_size=1, max_size=20))
def test_normal_forms(spark, texts):
    assert col(spark, texts, T.collapse) == [" ".join(t.split()) for t in texts]
    assert col(spark, texts, lambda c: T.ngrams(T.words(c), 2)) == [[" ".join(w[i : i + 2]) for i in range(len(w) - 1)] for w in (t.split() for t in texts)]


def test_strip_boilerplate(spark):
    got = col(spark, ["x\n*** START OF\nbody here\n*** END OF", "plain "], T.strip_boilerplate)
    assert got == ["body here", "plain"]


def test_answer_form(spark):
    assert col(spark, ["The cat, an owl!"], T.answer_form) == [re.sub(r"\s+", " ", "cat owl")]
