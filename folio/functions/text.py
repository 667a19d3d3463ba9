"""Column functions over texts: words, offsets, normal forms, n-grams, overlap metrics and reply parsing.

All are built from JVM expressions. Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out because engines differ on the shorthand.
WS = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The marks and patterns of structural breaks, and the words that carry no content.
BREAK_MARKS = r"^[*※•○●◇◆\-·~ \t\n\r]+$"
HEADING = r"(?i)^(#{1,6}\s|(section|article|chapter)\s+\d|§\s*\d|[ivxlcdm]{1,6}\.\s|\d+(\.\d+)*\.?\s|\([a-z0-9]{1,4}\)\s)"
STOPLIST = (
    "a an the and or but if of to in on at for with by from as is are was were be been it its this that he she they them his her their has have had will would can could not no"
).split()


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda over an expression would compute it at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, "^" + WS + "+|" + WS + "+$", "")


def words(text: Column) -> Column:
    """Words between runs of white space; no empty strings."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


#: A run of letters, figures and combining marks, or any other single sign that is no white space.
PIECE = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"


def token_count(text: Column) -> Column:
    """Tokens of the default tokenizer: words and single signs. Another count can be passed wherever this one is used."""
    return F.size(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))).cast("long")


def label_lines(reply: Column) -> Column:
    """array<struct<idx, label>> of the lines ``[i]: label`` or ``i. label`` of a reply, in order."""
    pattern = r"^\s*\[?(\d+)\]?\s*[:.]\s*(.+)"
    lines = F.transform(F.split(reply, "\n"), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("idx"), strip(F.regexp_extract(x, pattern, 2)).alias("label")))
    return F.transform(F.filter(lines, lambda x: (x["idx"] != "") & (x["label"] != "")), lambda x: F.struct(x["idx"].cast("long").alias("idx"), x["label"].alias("label")))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def word_index(text: Column, position: Column) -> Column:
    """1-based index of the word at a 0-based character position."""
    return (F.size(words(F.substring(text, F.lit(1), position.cast("int")))) + 1).cast("long")


def find(text: Column, part: Column, start: Column | int = 0) -> Column:
    """0-based position of ``part`` at or after ``start``, -1 if absent."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.call_function("locate", part, text, (start + 1).cast("int")).cast("long") - 1


def answer_form(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(text), ASCII_PUNCTUATION, "")
    return F.array_join(F.filter(words(bare), lambda w: ~w.isin("a", "an", "the")), " ")


def reply_form(text: Column) -> Column:
    """Lower case without white space and the marks ``.,!?'"()[]{}``."""
    return F.lower(F.regexp_replace(text, r"[\x{0009}-\x{000D}\x{0020}.,!?'\"()\[\]{}]", ""))


def answer_correct(prediction: Column, reference: Column) -> Column:
    """Whether the reference, if it has any content, is contained in the prediction; false for null."""
    ref, pred = reply_form(reference), reply_form(prediction)
    return F.coalesce((F.length(ref) > 0) & F.contains(pred, ref), F.lit(False))


def ngrams(tokens: Column, n: int, joiner: str = " ") -> Column:
    """All runs of n tokens, joined, in order; empty if there are fewer."""
    return let(
        tokens,
        lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0))), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), joiner))
        ),
    )


def content_words(text: Column) -> Column:
    """Latin words of a text without the stoplist."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1)), lambda w: ~w.isin(*STOPLIST))


def content_overlap(summary: Column, document: Column) -> Column:
    """Share of the summary's content words that stand in the document; 1.0 if it has none."""
    latin = F.regexp_extract_all(F.lower(document), F.lit("([a-z']+)"), F.lit(1))
    share = lambda p: F.when(F.size(p["a"]) == 0, F.lit(1.0)).otherwise(F.size(F.filter(p["a"], lambda w: F.array_contains(p["b"], w))) / F.size(p["a"]).cast("double"))
    return let(F.struct(content_words(summary).alias("a"), F.array_distinct(latin).alias("b")), share)


def token_f1(answer: Column, summary: Column) -> Column:
    """F1 of answer tokens (with multiplicity) against the summary's distinct tokens. Repeats in the answer can take
    it above 1; 0 if either side is empty."""

    def score(p):
        a, s = p["a"], p["s"]
        return let(F.size(F.filter(a, lambda w: F.array_contains(s, w))).cast("double"), lambda hit: f1(hit, F.size(a), F.size(s)))

    def f1(hit, na, ns):
        recall, precision = hit / na, hit / ns
        return F.when((na < 1) | (ns < 1) | (hit == 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))

    return let(F.struct(words(answer_form(answer)).alias("a"), F.array_distinct(words(answer_form(summary))).alias("s")), score)


def supported(answer: Column, summary: Column, threshold: float = 0.6) -> Column:
    return token_f1(answer, summary) >= threshold


def novel_ratio(generated: Column, source: Column, n: int = 3) -> Column:
    """Share of the distinct n-grams of ``generated`` that ``source`` lacks; 0 if it is shorter than n words."""
    g = F.array_distinct(ngrams(words(F.lower(generated)), n))
    s = F.array_distinct(ngrams(words(F.lower(source)), n))
    share = lambda p: F.when(F.size(p["g"]) < 1, F.lit(0.0)).otherwise(F.size(F.array_except(p["g"], p["s"])) / F.size(p["g"]).cast("double"))
    return let(F.struct(g.alias("g"), s.alias("s")), share)


def is_heading(text: Column) -> Column:
    """At most twelve words, and a heading pattern or all letters upper case with at least one letter."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    shouted = letters.rlike(r"^\p{Lu}+$")
    few = F.size(F.filter(F.split(text, WS + "+", 14), lambda w: w != "")) <= 12  # no more than that is split off
    return few & (text.rlike(HEADING) | shouted)


def is_structural_break(text: Column) -> Column:
    """Mere break marks, or a heading."""
    return text.rlike(BREAK_MARKS) | is_heading(text)


def sentences(text: Column) -> Column:
    """Rule splitter: an end mark with its closing quotes, followed by white space. A text without one is one sentence."""
    marked = F.regexp_replace(text, "([.!?…。！？।][”\"’'»)]*)" + WS + "+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), collapse), lambda s: s != "")


def sentence_spans(text: Column) -> Column:
    """array<struct<start, end, sentence>> by forward search; a sentence that can't be found is left out."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,sentence:string>>").alias("out"))

    def step(acc, s):
        i = F.call_function("locate", s, text, (acc["at"] + 1).cast("int")).cast("long") - 1
        end = i + F.length(s)
        item = F.struct(i.alias("start"), end.alias("end"), s.alias("sentence"))
        return F.when(i < 0, acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out")))

    return F.aggregate(sentences(text), zero, step, lambda acc: acc["out"])


def word_windows(text: Column, size: int) -> Column:
    """The text as windows of ``size`` words, white space normalised."""

    def cut(w):
        n = F.ceil(F.size(w) / F.lit(size)).cast("int")
        return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.array_join(F.slice(w, k * size + 1, F.lit(size)), " ")))

    return let(words(text), cut)


def truncate_words(text: Column, n: int, suffix: str = "") -> Column:
    """First n words; the suffix is added where words were cut."""

    def cut(w):
        head = F.array_join(F.slice(w, 1, n), " ")
        return F.when(F.size(w) > n, F.concat(head, F.lit(suffix))).otherwise(head)

    return let(words(text), cut)


def strip_boilerplate(text: Column, start: str = "*** START", end: str = "*** END") -> Column:
    """What stands between the line with the start mark and the end mark; the trimmed text if either is missing."""
    a, b = F.instr(text, start), F.instr(text, end)
    body = F.substring(text, a, F.greatest(b - a, F.lit(0)))
    line = F.instr(body, "\n")
    return F.when((a > 0) & (b > a), strip(F.when(line > 0, F.substring(body, line + 1, F.length(body))).otherwise(F.lit("")))).otherwise(strip(text))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def lookup_targets(reply: Column, highest: Column) -> Column:
    """Chunk numbers a reply asks for (``LOOKUP: 1, 4``), those from 0 to ``highest``; null if there are none."""
    listed = F.regexp_extract(reply, r"(?i)LOOKUP:?\s*([\d,\s]+)", 1)
    numbers = F.transform(F.regexp_extract_all(listed, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    kept = F.filter(numbers, lambda x: x.isNotNull() & (x >= 0) & (x <= highest))
    return F.when(F.size(kept) > 0, kept)


def option_number(reply: Column) -> Column:
    """First digit from 1 to 5, null if none."""
    d = F.regexp_extract(reply, "([1-5])", 1)
    return F.when(d != "", d.cast("long"))


def json_pairs(reply: Column) -> Column:
    """Question and answer objects of the widest ``[...]`` in a reply; objects that lack either are left out."""
    body = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(body, "array<struct<question:string,answer:string>>")
    return F.filter(F.coalesce(parsed, F.array().cast("array<struct<question:string,answer:string>>")), lambda p: p["question"].isNotNull() & p["answer"].isNotNull())


def qa_lines(reply: Column) -> Column:
    """array<struct<q, a>> of ``Q: ...`` lines each followed by an ``A: ...`` line."""
    pattern = F.lit(r"(?m)^Q:\s*(.+)\n+A:\s*(.+)$")
    return F.transform(F.arrays_zip(F.regexp_extract_all(reply, pattern, F.lit(1)).alias("q"), F.regexp_extract_all(reply, pattern, F.lit(2)).alias("a")), lambda p: F.struct(p["q"].alias("q"), p["a"].alias("a")))


def numbered_options(options: Column) -> Column:
    """Options as lines ``1) ...``."""
    return F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(") "), o)), "\n")


def context_block(parts: Column) -> Column:
    """array<struct<idx, text>> as blocks ``[chunk i]`` in order of i, with blank lines between."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(F.lit("[chunk "), p["idx"].cast("string"), F.lit("]\n"), p["text"])), "\n\n")
