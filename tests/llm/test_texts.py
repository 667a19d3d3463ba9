"""Sentences, pieces, tokens, pairs, mixes and residue: fixed cases, invariants and edge cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folio.llm import mixing, pairs, residue, sentences, splitting, tokens

MODEL = sentences.fit([])


def cut(text, flag=False, model=MODEL):
    return [text[a:b] for a, b in sentences.split(text, flag, model)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Birquol met H. B. Zhatuas at 6 p.m.", "“We counted 7,533 crates. Then it flooded,” he said.", "See id. at 12; cf. Foo v. Bar, No. 13."],
        ["At 3 a.m. Klupre restored the ridge.", "“Run!” cried Gen. Kour, and the kiln fell.", "“Is it still so, Kour?”", "Kour left…", "Nobody stayed."],
        ["Nach Abs. 14 und § 32 gilt es, d. h. nicht z. B. heute.", "Am 3. Dezember kam er.", "„Wer hat das geprüft?“, fragte Ze.", "Die Länge 237 m.", "Etwa Nr. 8.", "Wurde es?"],
        ["« Qui a acheté la digue ? » demanda Flun à Kif.", "Selon l’art. 6 et le no 9, p. ex. selon M. Forki, oui.", "Pourquoi ?"],
        ["—¿Quién ha sido? —preguntó G. P. Zaethi.", "¡El faro costó 51,78 millones!", "Según la pág. 8, aprox. el 3,5 %.", "Sra. Hathosk vino."],
    ],
)
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts


def test_unspaced_scripts():
    zh = ["恩卡西问：“条约在哪里？”", "“水渠已经关闭了。”罗帕罗说，“明天去。”", "1873年高约78.7米！"]
    assert cut("".join(zh)) == zh
    ja = ["「果樹園はない。急ごう」とルヴェは言った。", "なぜ古いのか？"]
    assert cut("".join(ja)) == ja
    hi = ["“क्या सड़क पहुँची?” लजामो ने पूछा।", "डॉ. बेगा आए।"]
    assert cut(" ".join(hi)) == hi
    th = ["สะพานหินสูงราว 766.711 เมตรและเก่าแก่มาก", "ชาวบุรีเล่าว่าเคยปิด"]
    assert cut(" ".join(th)) == th


def test_missing_space_heading_marks_and_blank():
    assert cut("It holds 38,792 entries.Its glacier passed on.") == ["It holds 38,792 entries.", "Its glacier passed on."]
    assert cut("§ 9. Of the gate", True) == ["§ 9. Of the gate"] == cut("§ 9. Of the gate", None)
    assert cut("* * *", None) == [] == cut("", False) == cut(None, False) == cut("  ", None)
    long = "One two three. " * 20000
    assert len(cut(long)) == 20000


def test_trained_model_agrees_with_held_out(spark):
    rows = [r[0] for r in duckdb.sql("select distinct text from '/root/testdata/sf0.01/paragraph.parquet' order by 1").fetchall()]
    half = sentences.fit(rows[::2])
    got: list = []
    for t in rows[1::2]:
        if not sentences.is_break(t):
            sentences.walk(t, half, got)
    assert len(got) > 500 and sum(half.decide(f) == y for f, y in got) / len(got) > 0.995


def test_sentences_of_all_kinds(spark):
    p = [(1, 0, "A first one. And more.", 0, False), (1, 0, "A first one. And more.", 0, False), (1, 1, "***", 24, None), (1, 2, "Last one here.", 29, None), (2, 0, None, 0, None)]
    c = [(1, 0, "A first one. And more.", [0], None, None), (1, 1, "*** Last one here.", None, 24, 43), (3, 0, None, None, 0, 5)]
    u = [(1, 0, [("A first", 0, 0), ("one. And more.", 0, 8)], None), (1, 1, None, None)]
    df = sentences.sentences(
        spark,
        spark.createDataFrame(p, "doc_id long, para_idx int, text string, char_offset long, is_scene_break boolean").withColumn("parts", F.lit(1)),
        spark.createDataFrame(c, "doc_id long, chunk_idx int, text string, paragraph_indices array<int>, char_start long, char_end long"),
        spark.createDataFrame(u, "doc_id long, unit_idx int, items array<struct<sentence:string,para:int,off:bigint>>, is_scene_break boolean"),
    )
    got = sorted(tuple(r) for r in df.collect())
    two = [(0, 12), (13, 22)]
    assert got == sorted([(k, 1, 0, a, b) for k in ("paragraph", "chunk", "unit") for a, b in two] + [("paragraph", 1, 2, 0, 14)])


def test_pieces_cover_and_fit():
    rng = random.Random(4)
    for n in (1501, 4000, 9000):
        paras = []
        while sum(map(len, paras)) < n:
            paras.append(" ".join("Word " + "x" * rng.randint(1, 60) + "." for _ in range(rng.randint(1, 12))))
        text = " ".join(paras)
        kind, got = splitting.pieces(text, [{"text": p, "is_scene_break": False} for p in paras], MODEL)
        assert kind == "paragraph" and got[0][0] == 0 and got[-1][1] == len(text)
        assert all(b - a <= 1500 for a, b, _ in got)
        assert all(x[1] - y[0] == 150 or y[0] == 0 for x, y in zip(got, got[1:]))


def test_piece_kinds_and_hard_cut():
    assert splitting.pieces("x" * 5000, [], MODEL)[0] == "none"
    kind, got = splitting.pieces("x" * 5000, [], MODEL)
    assert all(b - a <= 1500 for a, b, _ in got) and got[-1][1] == 5000
    assert splitting.pieces("A bee sings. " * 400, [], MODEL)[0] == "sentence"
    p = [{"text": "***", "is_scene_break": None}, {"text": "A bee sings. " * 300, "is_scene_break": False}]
    assert splitting.pieces("*** " + "A bee sings. " * 300, p, MODEL)[0] == "scene"


def test_split_only_oversized(spark):
    c = [(1, 0, "All done. " * 200, [0], None, None), (1, 0, "All done. " * 200, [0], None, None), (1, 1, "small", [1], None, None), (2, 0, None, [0], 0, 1)]
    chunks = spark.createDataFrame(c, "doc_id long, chunk_idx int, text string, paragraph_indices array<int>, char_start long, char_end long")
    paras = spark.createDataFrame([], "doc_id long, para_idx int, text string, char_offset long, is_scene_break boolean")
    got = splitting.split_oversized(spark, chunks, paras).collect()
    assert {(r.doc_id, r.chunk_idx, r.boundary) for r in got} == {(1, 0, "sentence")}


def test_longest_match_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        vocab = list({"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))})
        m, s = tokens.LongestMatch(vocab), "".join(rng.choice("abéd") for _ in range(20))
        i = n = 0
        while i < len(s):
            size = max((len(p) for p in vocab if s.startswith(p, i)), default=0)
            n += 1 if size else len(s[i].encode())
            i += size or 1
        assert m.unit(s) == n


def test_slices_and_log(spark):
    d = spark.createDataFrame([(1, "one two", " Wiki-Dump", "en_GB", "WIKI"), (2, None, None, None, None), (3, "", "wiki_dump", "eng", "wiki")], "doc_id long, text string, source string, lang string, genre string")
    c = spark.createDataFrame([(1, 0, "one"), (1, 0, "one"), (9, 0, "x")], "doc_id long, chunk_idx int, text string")
    got = {(r.field_name, r.source, r.lang, r.genre): r.n_docs for r in tokens.budget(d, c).collect()}
    assert got[("document", "wiki_dump", "en", "wiki")] == 2 and got[("document", "all", "all", "all")] == 3 and got[("chunk", "unknown", "unknown", "unknown")] == 1
    log = spark.createDataFrame([(1, "Wiki", 10, 2, 12), (1, "Wiki", 10, 2, 12), (2, "wiki ", -1, 2, 22), (3, None, None, None, None), (4, "wiki", 45_000_000, 2, 40)], "result_id long, genre string, prompt_tokens long, completion_tokens long, total_tokens long")
    r = {x.genre: x for x in tokens.logged_prompts(log).collect()}
    assert (r["wiki"].prompt_tokens, r["wiki"].n_calls, r["wiki"].n_mended) == (10 + 20 + 38, 3, 2) and r["unknown"].n_failed == 1


def test_mix_reaches_targets(spark):
    counts = spark.createDataFrame([(i, "a" if i < 800 else "b" if i < 1000 else "c", 10 + i % 7) for i in range(1010)] + [(5000, None, 9), (5001, "d", 0)], "doc_id long, source string, n_tokens long").withColumn("start", F.lit(0))
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.2, 2), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    p = mixing.plan(counts, targets)
    m = mixing.mix(counts, p).collect()
    assert [r.position for r in m] == sorted(r.position for r in m) and 0 <= m[0].position and m[-1].position < 1
    assert len({(r.doc_id, r.repeat) for r in m}) == len(m)
    s = {r.source: r for r in mixing.shares(mixing.mix(counts, p), p).collect()}
    assert s["c"].used_tokens == 2 * s["c"].held_tokens and s["c"].repeats == 2 and not s["c"].reached
    assert abs(s["a"].actual_share - s["b"].actual_share) < 0.01 and s["gone"].used_tokens == 0
    assert mixing.demands([{"source": "a", "target_share": 1.0, "max_repeats": 1}], {}, 10) == {"a": 0.0}
    empty = counts.limit(0)
    assert mixing.mix(empty, mixing.plan(empty, targets)).count() == 0


EN = "The vote was 2 to 27. We hold that the gate was northern."


@pytest.mark.parametrize(
    ("target", "want"),
    [
        (None, "empty"), ("", "empty"), (" \n​", "empty"), ("N/A", "empty"), ("Summary:", "empty"), ("(none)", "empty"), ("…", "empty"), ('""', "empty"),
        ("I’m sorry, but I cannot summarise this passage.", "refusal"), ("Lo siento, no puedo resumir este fragmento.", "refusal"), ("很遗憾，我无法总结这段文字。", "refusal"),
        (EN.upper(), "copy"), ("Summary: " + EN, "copy"), ("the  kiln was closed by the board", "copy"),
        ("Selon l’art. 6, la halle reste solide et la digue est humide.", "language"), ("为什么要检查石桥？", "language"),
        ("The kiln near the town was,", "truncated"), ("“Leave the pier. Take the mill", "truncated"), ("The case of Foo v.", "truncated"), ("It was sold by the ...", "truncated"), ("It was sold because…", "truncated"),
        ("“I cannot help you with the causeway,” Gragaend had told the council of the town.", None), ("The motto reads “Selon l’art. 19, la bibliothèque reste oblique”.", None), ("The kiln closed at 3 p.m.", None),
    ],
)
def test_defects(target, want):
    assert pairs.defect(target, "Summary so far: The kiln was closed by the board.\n\nNew passage: " + EN, "The kiln was closed, by the board.", EN, False, False) == want
    if want != "copy":
        assert pairs.defect(target, "Summary so far: (start)\n\nNew passage: " + EN, None, None, False, False) == want


def test_defective_pairs(spark):
    body = "A long enough sentence stands here and then it goes on"
    rows = [(1, "x", body + " and ends well.", "", EN), (2, "x", body + "…", "", EN), (2, "x", body + "…", "", EN), (3, None, None, None, None), (None, "x", "y", "z", "w")]
    df = spark.createDataFrame(rows, "pair_id long, input_text string, target_text string, previous_summary string, chunk_text string").withColumn("t", F.lit(1))
    assert {(r.pair_id, r.defect) for r in pairs.defective_pairs(df).collect()} == {(2, "truncated"), (3, "empty")}
    assert pairs.defective_pairs(df.limit(0)).count() == 0


def test_prefixes_across_partitions(spark):
    texts = [f"{'abc'[i % 3]}{i // 3:04d} and so on" for i in range(300)]
    short = [t[:9] for t in texts[::7]]
    df = spark.createDataFrame([(t,) for t in {*texts, *short}], "t string")
    assert {r.t for r in pairs.shortened_texts(df).collect()} == {s for s in short if any(t != s and t.startswith(s) for t in {*texts, *short})}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dear {{title}}, the inn was sold.", True), ("Filed: TODO: case_no and so on", True), ("By <%= byline %> today", True), ("It #PLACE# was", True), ("a [Your name here] b", True),
        ("The manual explains that a field such as “{{title}}” is filled in by the clerk.", False), ("A letter that still read “Dear [NAME]” was entered.", False),
        ("The set {k, n} costs $433.57 or 4%, see Art. 2 [reserved]. “[T]he ridge”", False),
        ("Menu  Search\n\n404 – we could not find /a/12.\n\nRef: 12ab34", True), ("Readers were told to enable JavaScript in 1849, he recalled.", False),
        ("The fair was unavailable for maintenance until March 4, he said.", False), ("请启用JavaScript后再查看本页。", True), ("blah blah blah blah blah blah blah", True),
        ("Lorem dolor amet ipsum. Quam arcu morbi dolor amet lorem porta.", True), ("Printers set lorem ipsum as a trial page, he noted.", False), ("* * * * * * * *", False),
    ],
)
def test_residue(text, want):
    assert any(r != "soft" for r, _ in residue.judge(text)) == want


@pytest.mark.parametrize(
    "text",
    [
        "Internal Server Error", "We are experiencing high traffic. Please try again in a few minutes.", "HTTP 410: this page is gone", "408 error", "You have reached your free article limit",
        "Sorry, we couldn't find that page", "The document /a/b has been deleted", "Insert your text here", "ไม่พบหน้า", "Dolor amet quam arcu morbi porta tellus viverra.",
        "He walked on. " * 400 + "\nand so it went. Internal\nserver error",
    ],
)
def test_residue_without_words_of_the_strict_list(text):
    assert any(r in ("firm", "filler") for r, _ in residue.judge(text))


def test_long_soft_messages_count(spark):
    rows = [(i, f"s{i % 3}", "Browser session: " + "the archive of the town hall " * 10 + f"is closed, try again after {i} minutes") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in residue.residue(df).collect()} == set(range(6))


def test_soft_messages_need_recurrence(spark):
    rows = [(i, f"s{i % 3}", f"Please wait; try again after {i} minutes") for i in range(6)] + [(20, "s1", "Please try again, said the clerk of Bell town"), (21, None, None), (22, None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("h", F.lit(0))
    assert {r.doc_id for r in residue.residue(df).collect()} == set()  # no trigger word of the strict list
    df = df.withColumn("text", F.regexp_replace("text", "^Please wait;", "Browser session;"))
    assert {r.doc_id for r in residue.residue(df).collect()} == set(range(6))
    assert residue.residue(df.limit(0)).count() == 0
