"""Near duplicates, shared spans and leaks against brute force, with the defined edge cases."""

import itertools
import random
import re
import unicodedata
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import leakage, neardup, sharedspans, textkeys

VOCAB = [f"w{i}" for i in range(400)]


def gist_rows(n=160, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
            rng.shuffle(words)
        else:
            words = [rng.choice(VOCAB) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words)))
    return rows


def words(t):
    return frozenset(re.findall(r"\w+", (t or "").lower()))


def brute(rows):
    sets = {i: words(t) for i, t in rows if words(t)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("leaf", [4096, 8])
def test_pairs_match_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    rows = gist_rows()
    rows += [(900, None), (901, ""), (902, " .,"), (3, rows[3][1]), (903, rows[3][1]), (904, rows[3][1].upper())]
    gists = spark.createDataFrame(rows, "id long, text string").withColumn("klass", F.lit("clash"))
    slots = [(i, "d1" if i % 3 else "d2", [i // 4, i // 4 + 1, i // 4 + 2, 7, None, 7]) for i in range(60)] + [(70, None, [1]), (71, "d1", None), (72, "d1", [])]
    sets = neardup.record_sets(spark, gists, spark.createDataFrame(slots, "id long, grp string, numbers array<int>"))
    got = {(r.record_kind, r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(sets).collect()}
    by = {i: (g, {x for x in v if x is not None}) for i, g, v in slots if g and v and any(x is not None for x in v)}
    want = {("slot", a, b) for a, b in itertools.combinations(sorted(by), 2) if by[a][0] == by[b][0] and 10 * len(by[a][1] & by[b][1]) >= 7 * len(by[a][1] | by[b][1])}
    want |= {("gist", a, b) for a, b in brute({i: t for i, t in rows if i != 3 or t}.items())}
    assert got == want


def test_groups_count_links(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h i k"), (4, "z"), (5, None)]
    sets = neardup.record_sets(spark, spark.createDataFrame(rows, "id long, text string"), None)
    got = {r.record_id: (r.group_id, r.n_links) for r in neardup.near_duplicate_groups(sets).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}


def test_no_records(spark):
    sets = neardup.record_sets(spark, spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "id long, grp string, numbers array<int>"))
    assert neardup.near_duplicate_pairs(sets).count() == 0 and neardup.near_duplicate_groups(sets).count() == 0


def test_fingerprint_bounds_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = np.unique(rng.integers(0, 90, 40)), np.unique(rng.integers(0, 90, 40))
        fa, fb = (np.frombuffer(neardup.fingerprint(x, 256), np.uint64) for x in (a, b))
        assert np.bitwise_count(fa ^ fb).sum() <= len(np.setxor1d(a, b))
    assert neardup.radius(np.array([10]), Fraction(7, 10))[0] == 4


def test_winnowing_picks_rightmost_minimum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, w = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        h = textkeys.mix(rng.integers(0, 6, n).astype(np.uint64))
        want = {n - 1 - int(np.argmin(h[::-1]))} if n <= w else {i + w - 1 - int(np.argmin(h[i : i + w][::-1])) for i in range(n - w + 1)}
        assert set(textkeys.winnow(h, w).tolist()) == want


def test_equal_grams_have_equal_hashes():
    v = textkeys.codes("abcabcabc日本abc")
    h = textkeys.grams(v, 3)
    assert h[0] == h[3] == h[6] == h[11] and len(set(h.tolist())) > 3


def span_brute(recs, length):
    own = {}
    for _, _, rec, t in recs:
        for s in range(len(t or "") - length + 1):
            g = t[s : s + length]
            own[g] = rec if own.get(g, rec) == rec else "*"
    out = set()
    for f, i, _, t in recs:
        a = b = None
        for s in range(len(t or "") - length + 1):
            if own[t[s : s + length]] == "*":
                if b is not None and s <= b:
                    b = s + length
                else:
                    if b is not None:
                        out.add((f, i, a, b))
                    a, b = s, s + length
        if b is not None:
            out.add((f, i, a, b))
    return out


@pytest.mark.parametrize("cap", [24, 2])
def test_shared_spans_match_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(sharedspans, "SEED_CAP", cap)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcd 日") for _ in range(n))
    common = [text(n) for n in (40, 41, 60, 90, 39)]
    recs = []
    for i in range(60):
        t = text(rng.randint(0, 80)) + rng.choice(common) + text(rng.randint(0, 50)) + (rng.choice(common) if i % 3 else "")
        recs.append(("x" if i % 2 else "y", i // 2, f"r{i // 2}", t))
    recs += [("x", 90, "r90", recs[0][3]), ("x", 91, "r91", None), ("x", 92, "r92", ""), ("x", 93, "r93", "short"), ("x", 94, "r94", "p" * 300), ("x", 95, "r95", text(30) + "p" * 50)]
    recs += [("x", 96, "r96", "q" * 100 + text(20) + "q" * 100)]
    df = spark.createDataFrame(recs + recs[:5], "field_name string, record_id long, record string, text string")
    got = {tuple(r) for r in sharedspans.shared_spans(df, 40, 20).collect()}
    assert got == span_brute(recs, 40)


def test_chains_and_alignment():
    m = [(0, 0), (10, 10), (20, 35), (5, 90)]
    best = sharedspans.chains(m, 10)
    assert sorted(x for c in best for x in c) == sorted(m) and best[0] == [(0, 0), (10, 10), (20, 35)]
    a, b = textkeys.codes("..hello world!"), textkeys.codes("hello world?")
    assert sharedspans.align(a, b, [(4, 2)], 5) == [(2, 0, 11)]


def test_no_spans(spark):
    df = spark.createDataFrame([], "field_name string, record_id long, record string, text string")
    assert sharedspans.shared_spans(df).count() == 0 and sharedspans.fuzzy_passages(df).count() == 0


def test_fuzzy_passages_of_hot_seeds_and_close_edits(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(240)
    hot = [("x", i, f"r{i}", text(30) + passage[:120] + text(3) + passage[120:] + text(20)) for i in range(sharedspans.SEED_CAP + 4)]
    plain = text(240)
    edited = "".join("#" if i % 70 == 69 else c for i, c in enumerate(plain))
    recs = [*hot, ("y", 0, "s0", plain), ("y", 1, "s1", edited), ("z", 0, "q0", edited)]
    df = spark.createDataFrame(recs, "field_name string, record_id long, record string, text string")
    got = [(r.field_name, r.record_id, r.other_field, r.other_id) for r in sharedspans.fuzzy_passages(df).collect()]
    n = len(hot)
    assert set(got) == {("x", i, "x", j) for i in range(n) for j in range(n) if i != j} | {("y", 0, "y", 1), ("y", 1, "y", 0)}
    assert [tuple(r) for r in sharedspans.copies(df).collect()] == [("z", 0, "y", 1)]


def leak_docs():
    passage = "Ärger mit dem Café: Der alte Müller zählte 1,234 Schritte, dann noch 16, und blieb am Brunnen stehen. Danach ging er heim."
    ja = "「果樹園はルコフ市にない。急ごう」とルヴェ・モブブは言った。古い地図は港の倉庫で見つかったという。"
    ws = passage.split()
    docs = [
        (1, "x " + passage.upper() + " y"), (2, unicodedata.normalize("NFD", passage)), (3, " ".join(ws[:12])), (4, "_".join(ws[:15])), (5, None), (6, " "),
        (7, "前" + ja.replace("。", "\n") + "後"), (8, ja[:30]), (9, "unrelated text " * 2000), (10, "\n".join(ws[4:19])),
    ]
    items = [(1, "de", passage), (2, "de", passage), (3, "ja", ja), (4, "en", None), (5, None, "too short"), (6, None, ja)]
    return docs, items


@pytest.mark.parametrize("bound", [leakage.MAX_PROBE, 0])
def test_leaks(spark, bound):
    docs, items = leak_docs()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pid", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, lang string, passage string").withColumn("text", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, i, bound).collect()}
    assert got == {(x, y) for x in (1, 2, 4, 10) for y in (1, 2)} | {(7, 3), (7, 6)}


def test_leaks_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, lang string, passage string")
    assert leakage.leaked_items(d, i).count() == 0


def test_windows_of_hot_seeds_are_chained_to_representatives(spark, monkeypatch):
    """One seed in all texts, of which three share a longer part with one other text each."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core = text(20)
    recs = [("x", i, f"r{i}", text(30) + core + text(30)) for i in range(8)]
    recs += [("x", 20 + i, f"r{20 + i}", text(9) + recs[i][3][15:65] + text(9)) for i in range(3)]
    df = spark.createDataFrame(recs, "field_name string, record_id long, record string, text string")
    monkeypatch.setattr(sharedspans, "SEED_CAP", 2)
    assert {tuple(r) for r in sharedspans.shared_spans(df, 40, 20).collect()} == span_brute(recs, 40) != set()
