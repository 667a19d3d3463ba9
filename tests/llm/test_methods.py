"""What the named methods contribute: with the method off the result is another one, and a worse one."""

import duckdb
import pytest

from folio.llm import pairs, residue, sentences, splitting


def table(sf, name, columns, key):
    return duckdb.sql(f"select {columns} from '/root/testdata/{sf}/{name}.parquet' group by {key} order by {key}").fetchall()


def test_the_fit_cuts_what_the_seeds_miss():
    """Held-out joins of two units, where a sentence ends for certain: the fit on other units cuts them. Fits
    on two halves of the documents agree with each other and not with the seeds alone."""
    units = table("sf0.01", "semantic_unit", "doc_id, unit_idx, array_to_string(list_transform(any_value(items), lambda x: x.sentence), ' '), bool_or(is_scene_break)", "doc_id, unit_idx")
    own = {(d, i): t for d, i, t, apart in units if t and not apart and not sentences.is_break(t)}
    pairs_ = [(k, t, own[k[0], k[1] + 1]) for k, t in own.items() if (k[0], k[1] + 1) in own]
    train, held = [x for x in pairs_ if x[0][0] % 2], [x for x in pairs_ if not x[0][0] % 2]
    fitted, seeds = sentences.fit([t for _, t, _ in train], [u for _, _, u in train]), sentences.fit([])

    def missed(m):
        joins = [sentences._joined(t, u) for _, t, u in held if t.rstrip()[-1] in ".!?…。！？।"]
        return sum(at not in {a for a, _ in sentences.walk(whole, m)} for whole, at in joins) / len(joins)

    assert missed(fitted) <= missed(seeds) < 0.002
    texts = [t for _, _, t in table("sf0.01", "paragraph", "doc_id, para_idx, max(text)", "doc_id, para_idx") if t and not sentences.is_break(t)]
    other = sentences.fit([t for _, t, _ in held], [u for _, _, u in held])  # on the other half: what can be learned is learned twice
    differ = lambda a, b: sum(sentences.walk(t, a) != sentences.walk(t, b) for t in texts)
    assert 5 * differ(fitted, other) < differ(fitted, seeds) > 10


def test_a_few_units_are_enough_to_begin_with():
    model = sentences.fit(["The pier was shut.", "It rained. Mr. Gale left.", "He saw No. 7."], ["It rained.", "He saw No. 7.", None])
    assert [t for t in ("Mr. Gale left. It rained.",) if len(sentences.walk(t, model)) == 2]


@pytest.fixture(scope="module")
def forms(spark):
    """Forty sound pairs of one kind, and some that break off."""
    name = lambda i: "Br" + "aeiou"[i % 5] + "lmnrstvw"[i // 5] + "en"
    rows = [(i, "x", f"The kiln at {name(i)}ham was closed by {name(i)}. Then {name(i)} left for {name(39 - i)}…", "", f"The mill at {name(i)}ham was closed by {name(i)}.") for i in range(40)]
    rows += [
        (100, "x", "The kiln at Quarhaven was closed by", "", "The mill was closed by the mayor."),
        (101, "x", "The kiln at Quarhaven was closed by the…", "", "The mill was closed by the mayor."),
        (102, "x", "Then Orpwell left for Lindmere…", "", "The mill was closed by the mayor."),
        (103, "x", "The kiln at Quarhaven was closed by Orpwell. Then Orpwell left for Lindmere…", "", "The mill was closed by the mayor."),
    ]
    rows += [(200 + i, "x", f"Then {name(i)} left for {name(i + 1)}… The kiln at {name(i)}ham was closed by {name(i)}.", "", "The mill was closed by the mayor.") for i in range(10)]
    return spark.createDataFrame(rows, "pair_id long, input_text string, target_text string, previous_summary string, chunk_text string")


def test_neighbours_tell_cut_from_whole(forms):
    said = {r.pair_id: r for r in pairs.neighbours(forms).collect()}
    assert said[100].shortened and not said[100].whole
    assert said[101].astray and not said[101].whole
    assert said[102].whole and said[103].whole
    found = {r.pair_id: r.defect for r in pairs.defective_pairs(forms).collect()}
    assert found == {100: "truncated", 101: "truncated"}


def test_without_neighbours_an_ellipsis_is_open(forms):
    assert pairs.defect("The kiln at Quarhaven was closed by Orpwell…", "x", "", "The mill was closed by the mayor.", False, False) is None
    assert pairs.defect("The kiln at Quarhaven was closed by Orpwell…", "x", "", "The mill was closed by the mayor.", False, False, astray=True) == "truncated"
    assert pairs.defect("The kiln was closed by the", "x", "", "The mill was closed by the mayor.", False, False, whole=True) is None


def test_no_bound_on_refusals_brackets_and_prefixes(spark):
    assert pairs.defect("I’m sorry, but I cannot summarise this passage. " + "It is too long. " * 80, "x", "", "The mill was closed by the mayor.", False, False) == "refusal"
    assert pairs.cut_off("It was (" + "a long aside, " * 40 + "and it ended.")
    df = spark.createDataFrame([("ab",), ("abc",), ("b",)], "t string")
    assert {r.t for r in pairs.shortened_texts(df).collect()} == {"ab"}


def test_length_limits_are_relative(spark):
    for times in (1, 10):
        n = [(100,)] * (40 * times) + [(k,) for k in range(50, 250) for _ in range(times)]
        assert [r.n for r in pairs.limits(spark.createDataFrame(n, "n int")).collect()] == [100]


def test_kind_of_boundary_comes_from_the_merging():
    segments = [(0, 0), (400, 1), (800, 2), (1200, 1), (1600, 3), (1900, 1)]
    left, strongest = splitting.merge(segments, 2300, 1500, 150)
    assert strongest == 3 and left[0][0] == 0 and left[-1][1] == 2300
    assert splitting.merge([(0, 0), (500, 2)], 900, 1500, 150) == ([(0, 900, 0)], 2)
    assert splitting.merge([(0, 0)], 900, 1500, 150) == ([(0, 900, 0)], 0)


def test_recurrence_decides_messages_within_lines(spark):
    """A firm phrase inside a line is a message where it recurs over documents and sources, and a sentence where it doesn't."""
    said = "The clerk read it out. Service unavailable, code {}. Then he sat down."
    rows = [(i, f"s{i % 3}", said.format(i)) for i in range(6)] + [(20, "s1", "He nodded. Too many requests had come, he said."), (21, "s1", "Gateway time-out at noon\nHe nodded.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id: r.classes for r in residue.residue(df).collect()}
    assert found == {i: "recurring" for i in range(6)} | {21: "single"}
    few = df.where("doc_id >= 4")
    assert {r.doc_id for r in residue.residue(few).collect()} == {21}


def test_filler_and_slots_recur_by_their_normal_form():
    assert residue.plain_filler("Lorem ipsum dolor sit.") == residue.plain_filler("Amet quam arcu lorem!")
    assert residue.plain_filler("text, text, text text") == "<filler> text"
    many = "Dear {{name}}, " + "x " * 50 + "on {{date}}"
    assert [s for r, s in residue.judge(many) if r == "slot"] == ["{{name}}", "{{date}}"]
