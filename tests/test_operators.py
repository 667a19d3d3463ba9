"""Selection, range joins, segmentation, memories and evaluation on small cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import vector as V
from folio.operators import corpus as C
from folio.operators import evaluate as E
from folio.operators import memory as M
from folio.operators import segment as S
from folio.operators import select as R
from folio.operators.rangejoin import as_of, first_interval, label_intervals


def scores(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "g long, item_id long, score double")


def ids(df, c="item_id"):
    return sorted(r[c] for r in df.collect())


def test_cosine_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_blocked_scores_match_expression(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>")
    q = df.where("item_id < 5").select(F.col("item_id").alias("query_id"), "vec")
    one = {(r.query_id, r.item_id): r.score for r in V.score_all(df, q).collect()}
    monkeypatch.setattr(V, "MAX_QUERY_CELLS", 10)
    many = {(r.query_id, r.item_id): r.score for r in V.score_all(df, q).collect()}
    assert one == many and len(one) == 200
    a, b = np.array(rows[2][1]), np.array(rows[7][1])
    assert abs(one[(2, 7)] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9


def test_adaptive_k(spark):
    assert ids(R.adaptive_k(scores(spark, [1.0, 0.9, 0.84, 0.2]), ["g"])) == [0, 1]
    assert ids(R.adaptive_k(scores(spark, [-0.1, -0.2]), ["g"])) == [0]
    assert ids(R.adaptive_k(scores(spark, [1.0] * 6), ["g"], cap=3)) == [0, 1, 2]


def test_budget_rounds_up_and_infinity_fills(spark):
    df = R.ratio_budget(scores(spark, [0.1, float("-inf"), 0.5]), ["g"], 0.5)
    assert ids(df.where("kept")) == [0, 2]
    assert ids(R.ratio_budget(scores(spark, [0.1, float("-inf")]), ["g"], 1.0).where("kept")) == [0, 1]
    assert ids(R.ratio_budget(scores(spark, [0.3, 0.2]), ["g"], 0.01).where("kept")) == [0]


def test_padding_clamps(spark):
    df = R.pad(R.ratio_budget(scores(spark, [0.9, 0.1, 0.1, 0.1]), ["g"], 0.25), ["g"], 1)
    assert ids(df.where("padded")) == [0, 1]


def test_nucleus_includes_crossing(spark):
    df = R.nucleus(scores(spark, [1.0, 1.0, 1.0, 1.0]), ["g"], 0.5, 0.5)
    assert ids(df) == [0, 1]


def test_weighted_budget_and_fill(spark):
    b = R.weighted_budget(scores(spark, [1.0, 1.0, -9.0]), ["g"], 100)
    assert {r.item_id: r.budget for r in b.collect()} == {0: 50, 1: 50, 2: 0}
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 5)], "g long, item_id long, n_words long")
    assert [r.take for r in R.fill_budget(df, ["g"], F.lit(7)).orderBy("item_id").collect()] == [5, 2, 0]


def test_lookup_window_stops(spark):
    df = spark.createDataFrame([([5, 20, 6],)], "t array<bigint>")
    assert df.select(R.lookup_window(F.col("t"), F.lit(30).cast("long"), 2, 8)).first()[0] == [3, 4, 5, 6, 7]


def test_mmr_prefers_diversity(spark):
    items = [(0, 1.0, ["a", "b"]), (1, 0.95, ["a", "b"]), (2, 0.6, ["c"])]
    df = spark.createDataFrame([(items,)], "i array<struct<idx:bigint,score:double,words:array<string>>>")
    assert df.select(R.mmr(F.col("i"), F.lit(2))).first()[0] == [0, 2]


def test_range_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    iv = [("d", i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 30000, 60), rng.integers(0, 9000, 60)))]
    pt = [("d", i, int(x)) for i, x in enumerate(rng.integers(0, 40000, 200))]
    points, intervals = spark.createDataFrame(pt, "k string, p long, pos long"), spark.createDataFrame(iv, "k string, idx long, start long, end long")
    got = {r.p: r.idx for r in first_interval(points, intervals, ["k"], ["p"]).collect()}
    assert got == {p: min((i for _, i, a, b in iv if a <= x < b), default=None) for _, p, x in pt}
    lab = {r.idx: r.label for r in label_intervals(intervals, points, ["k"], ["idx"]).collect()}
    assert lab == {i: int(any(a <= x < b for _, _, x in pt)) for _, i, a, b in iv}


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 1)], "k long, t long")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y")], "k long, rt long, v string")
    assert {r.t: r.v for r in as_of(left, right, ["k"], "t", "rt", "v").collect()} == {5: "y", 1: None}


def test_paragraph_offsets(spark):
    text = "  First  one\nline\n\n\n \nSecond.\n\n"
    rows = S.paragraphs(spark.createDataFrame([(1, text), (2, None), (3, " \n\n ")], "doc_id long, text string")).collect()
    assert [(r.para_idx, r.text, r.char_offset) for r in rows] == [(0, "First one line", 2), (1, "Second.", text.index("Second"))]


def test_html(spark):
    assert S.html_texts("<p>a<br>b<p> <p>c &amp; d</p><script>'<p>x</p>'</script><div>e</div>") == ["a b", "c & d"]


def test_dialogue_groups(spark):
    s = ["“Come.", "Now,” he said.", "It’s late.", "“Open"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(s)], "d long, sent_idx long, sentence string")
    assert [(r.first_sent, r.last_sent) for r in S.dialogue_groups(df, ["d"]).orderBy("group_idx").collect()] == [(0, 1), (2, 2), (3, 3)]
    tight = S.dialogue_groups(df, ["d"], max_words=2).orderBy("group_idx").collect()
    assert [(r.first_sent, r.last_sent) for r in tight] == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_semantic_pagination(spark):
    rows = [(1, i, 40, False, s) for i, s in enumerate([0.9, 0.1, 0.8, 0.7, None])]
    df = spark.createDataFrame(rows, "doc_id long, pos long, n_words long, is_scene_break boolean, seam double")
    got = [(r.first_pos, r.last_pos) for r in S.paginate_semantic(df, low=60, high=120).orderBy("chunk_idx").collect()]
    assert got == [(0, 1), (2, 4)]
    brk = spark.createDataFrame([(1, 0, 40, True, 0.5), (1, 1, 40, False, None)], "doc_id long, pos long, n_words long, is_scene_break boolean, seam double")
    assert S.paginate_semantic(brk, low=60, high=120).count() == 2
    with pytest.raises(RuntimeError):
        S.paginate(df, "doc_id", 60, 120, "raise", have_vectors=False)
    assert S.paginate(df, "doc_id", 60, 120, have_vectors=False).count() == 2


#: The drift over topics and the sweep's expected shares and sizes.
TOPICS = [3, 0, 2, 1, 0, 3, 3, 2, 1, 3, 0, 1, 2, 2, 3, 1, 2, 0, 1, 3, 2, 1, 0, 2]


def drift_rows():
    out = []
    for i, t in enumerate(TOPICS):
        v = [0.0] * 8
        v[2 * t], v[2 * t + 1] = math.cos(i * 0.18), math.sin(i * 0.18)
        out.append((0, i, v))
    return out


@pytest.mark.parametrize(("tau", "share", "slots"), [(0.3, 0.1304, 4), (0.5, 0.2174, 6), (0.65, 0.5217, 13), (0.8, 0.6087, 15), (0.9, 0.913, 22)])
def test_drift_sweep(spark, tau, share, slots):
    df = spark.createDataFrame(drift_rows(), "key long, pos long, vec array<double>")
    r = E.span_report(M.replay(df, tau, tau)).first()
    assert round(r.insert_share, 4) == share and r.memory_size == slots


def test_anchor_stays(spark):
    v = [(0, 0, [1.0, 0.0]), (0, 1, [0.8, 0.6]), (0, 2, [0.28, 0.96]), (0, 3, None)]
    df = spark.createDataFrame(v, "key long, pos long, vec array<double>")
    assert [r.thread_id for r in M.anchor_clusters(df, 0.7).orderBy("pos").collect()] == [0, 0, 1]


def test_memory_policies():
    with pytest.raises(ValueError):
        M.Rules(room=0)
    with pytest.raises(ValueError):
        M.Rules(room=2, full="drop")
    for full in ("merge", "evict"):
        rules, slots = M.Rules(0.5, 0.5, room=2, full=full, embed=lambda t: [1.0] * 6), M.Slots()
        for i in range(6):
            v = np.zeros(6)
            v[i] = 1
            M.put(slots, f"t{i}.", v, i, M.look(slots, v, i, rules), rules)
        assert len(slots) <= 2
    assert slots.keep(~slots.holding(5)) == 1 and all(5 not in o for o in slots.origins)


def two_slots():
    slots = M.Slots()
    slots.add("a.", np.array([1.0, 0.0]), [0, 2], (0, 3, 1, 0))
    slots.add("b.", np.array([0.9, 0.1]), [1], (1, 1, 0, 0))
    return slots


def test_merge_provenance():
    slots = two_slots()
    M.fit(slots, M.Rules(room=2, embed=lambda t: [1.0, 1.0]))
    assert slots.rows() == [(0, 0, 2, [0, 1, 2], 0, 3, 1, 1)] and slots.texts == ["a. b."]


@pytest.mark.parametrize("embed", [None, lambda t: None])
def test_no_vector_for_the_joint_text_evicts(embed):
    slots = two_slots()
    M.fit(slots, M.Rules(room=2, embed=embed))
    assert slots.texts == ["a."] and slots.rows()[0][7] == 0


def test_eviction_order():
    slots = M.Slots()
    for i, (used, revised) in enumerate([(3, 0), (1, 2), (1, 1), (1, 1)]):
        slots.add(str(i), np.eye(4)[i], [i], (i, used, revised, 0))
    M.drop_least_useful(slots)
    assert slots.texts == ["0", "1", "3"]


def test_look_falls_back_and_fades():
    slots = two_slots()
    q = np.array([0.0, 1.0])
    sight = M.look(slots, q, 9, M.Rules(read=0.5))
    assert sight.fell_back and sight.taken.tolist() == [1] and slots.counts.rows[1, M.USED] == 9
    assert not len(M.look(slots, q, 9, M.Rules(read=0.5), fallback=False).taken)
    s = M.look(two_slots(), np.array([1.0, 0.0]), 5, M.Rules(fade=0.1)).scores
    assert np.allclose(s, [math.exp(-0.2), 0.9 * math.exp(-0.4)])


def test_paired_and_confusion(spark):
    df = spark.createDataFrame([("q", 1, True), ("q", 2, False), ("r", 1, False), ("r", 2, True), ("s", 1, True)], "u string, v int, correct boolean")
    r = E.paired(df, "u", "v").first()
    assert (r.lost, r.gained, r.net, r.n) == (1, 1, 0, 2)
    c = E.confusion(spark.createDataFrame([], "label int, predicted int")).first()
    assert c.precision == 0.0 and c.f1 == 0.0


def test_mann_whitney_small(spark):
    a, b = [1.0, 2.0, 2.0, 70.0], [2.0, 3.0, 130.0]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "v double, g boolean")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert E.mann_whitney(df, "v", "g", True).first().u == u


def test_row_numbers_and_stride(spark):
    df = spark.range(0, 1000).withColumn("k", F.col("id") * 7 % 1000)
    got = {r.k: r._rn for r in C.with_row_number(df, ["k"]).collect()}
    assert got == {i: i for i in range(1000)}
    assert ids(C.even_stride(df, ["k"], 30), "k") == [int(i * 1000 / 30) for i in range(30)]


def test_leak_free(spark):
    docs = spark.createDataFrame([(1, "x" * 5 + "the held out passage is in here somewhere"), (2, "nothing of the kind"), (3, None), (4, "日本語の短い文")], "doc_id long, text string")
    held = spark.createDataFrame([("the held out passage is in here",), ("短い文",), ("",), (None,)], "passage string")
    assert ids(C.leak_free(docs, held, "doc_id", "text", "passage"), "doc_id") == [2, 3]


def test_pack_and_deal(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([50, 60, 300, 40, 100])], "key string, pos long, n_words long")
    assert [(r.pos, r.bin) for r in C.pack(df, "key", 100, 150).orderBy("pos").collect()] == [(0, 0), (1, 0), (3, 1), (4, 1)]
    assert C.deal(df, "key", 2, 90, 160).count() == 4


def test_semantic_units_of_paragraphs(spark):
    p = [(1, 0, "It rained. “Come. Now,” he said. It’s late.", 10, False), (1, 1, "***", 60, True), (1, 2, "End here.", 70, False)]
    df = spark.createDataFrame(p, "doc_id long, para_idx int, text string, char_offset long, is_scene_break boolean")
    got = [(r.unit_idx, r.paragraph_index, r.sentence_start, r.sentence_end, r.n_items, r.word_count, r.char_offset, r.text) for r in S.semantic_units(df).orderBy("unit_idx").collect()]
    assert got == [(0, 0, 0, 0, 1, 2, 10, "It rained."), (1, 0, 1, 2, 2, 4, 21, "“Come. Now,” he said."), (2, 0, 3, 3, 1, 2, 43, "It’s late."), (3, 1, 4, 4, 1, 1, 60, "***"), (4, 2, 5, 5, 1, 2, 70, "End here.")]
    tight = S.semantic_units(df, max_words=3)
    assert [r.text for r in tight.orderBy("unit_idx").collect()][1:3] == ["“Come.", "Now,” he said."]


def test_word_spans_reach_the_next_window(spark):
    df = spark.createDataFrame([(1, "  a bb\n\nccc  d "), (2, " \n"), (3, None), (4, "")], "doc_id long, text string")
    assert [tuple(r) for r in S.word_spans(df, 2).collect()] == [(1, 0, 2, 8, 2), (1, 1, 8, 15, 2)]


def test_pruned_scores_keep_all_that_a_cut_off_can_take(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(300)] + [(900, [0.0] * 4, 0)]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>, label int").repartition(5)
    q = df.where("item_id < 6").select(F.col("item_id").alias("query_id"), "vec")
    whole = V.score_all(df, q).where("query_id <> item_id")
    pruned = V.score_all(df, q, 0.85)
    pick = lambda s: {(r.query_id, r.item_id, r.label) for r in R.adaptive_k(s, ["query_id"]).collect()}
    assert pick(whole) == pick(pruned) and pruned.count() < whole.count()


def test_running_sums_and_two_sided_p(spark):
    df = spark.createDataFrame([(float(i % 50), i) for i in range(200)], "v double, n long").groupBy("v").agg(F.sum("n").alias("n"))
    got = {r.v: r.before for r in C.running_sum(df, ["v"], "n", "before").collect()}
    sums = {float(v): sum(i for i in range(200) if i % 50 == v) for v in range(50)}
    assert got == {v: sum(s for w, s in sums.items() if w < v) for v in sums}
    z = spark.createDataFrame([(x,) for x in (0.0, 0.5, -1.96, 4.0)], "z double").select("z", E.two_sided_p(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-6 for r in z)


def test_balanced(spark):
    df = spark.createDataFrame([("a", i, int(i < 2)) for i in range(20)] + [("b", i, 0) for i in range(5)], "g string, k long, y int")
    got = C.balanced(df, "g", "y", "k", 0.25).collect()
    assert sum(r.y for r in got) == 2 and len(got) == 8 and {r.g for r in got} == {"a"}


def test_label_lines(spark):
    from folio.functions import text as T

    df = spark.createDataFrame([("Sure:\n[0]: The gate\n 2. A ford \nno label\n0. The mill\n[3]:",)], "t string")
    assert [tuple(x) for x in df.select(T.label_lines(F.col("t"))).first()[0]] == [(0, "The gate"), (2, "A ford"), (0, "The mill")]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from folio import runtime

    spark = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master))
    assert runtime.shared_base(spark("spark://x:7077", "hdfs://x/y")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        runtime.shared_base(spark("spark://x:7077", None))
    assert runtime.shared_base(spark("local[4]", None))


def test_released_folders_are_gone(spark):
    from folio import runtime

    path = runtime.shared_folder(spark, "t")
    spark.range(3).write.parquet(path)
    assert runtime.release(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()
