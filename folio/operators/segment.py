"""From raw text and HTML to paragraphs, sentences, dialogue groups, semantic units and bounded chunks.

Offsets count code points, 0-based and half-open. Paragraph offsets refer to the original text; HTML paragraphs
stand as if joined by blank lines. Null and blank texts give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import WS, collapse, is_structural_break, let, sentences, word_count
from folio.operators.fold import ordered_fold
from folio.runtime import ship

BLANK = r"(\n[\x{0009}-\x{000D}\x{0020}]*\n+)"


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, para_idx, text (collapsed), char_offset, is_scene_break for blocks between blank lines. All on the document's
    own row, by a fold over the lengths of its blocks: nothing is shuffled."""

    def placed(p: Column) -> Column:
        sizes = F.transform(p["blocks"], lambda b, i: (F.length(b) + F.coalesce(F.length(F.get(p["gaps"], i)), F.lit(0))).cast("long"))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return let(
            F.aggregate(sizes, zero, step, lambda acc: acc["out"]),
            lambda starts: F.transform(p["blocks"], lambda b, i: F.struct(b.alias("block"), (F.get(starts, i) + F.length(b) - F.length(F.regexp_replace(b, "^" + WS + "+", ""))).alias("char_offset"))),
        )

    t = F.col(text)
    parts = F.struct(F.split(t, BLANK).alias("blocks"), F.regexp_extract_all(t, F.lit(BLANK), F.lit(1)).alias("gaps"))
    kept = F.filter(let(parts, placed), lambda x: x["block"].rlike("[^" + WS[1:]))
    rows = docs.where(t.isNotNull()).select(key, F.posexplode(kept).alias("_i", "_p"))
    rows = rows.select(key, F.col("_i").cast("long").alias("para_idx"), collapse(F.col("_p.block")).alias("text"), F.col("_p.char_offset").alias("char_offset"))
    return rows.withColumn("is_scene_break", is_structural_break(F.col("text")))


class _P(HTMLParser):
    """Texts of <p> in document order; a block start closes an open one; script and style are no text."""

    BLOCKS = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "hr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.cur: list[str] | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.BLOCKS:
            self.close_p()
            if tag == "p":
                self.cur = []
        elif tag == "br" and self.cur is not None:
            self.cur.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "p" or tag in self.BLOCKS:
            self.close_p()

    def handle_data(self, data):
        if self.cur is not None and not self.skip:
            self.cur.append(data)

    def close_p(self):
        if self.cur is not None:
            t = " ".join(" ".join(self.cur).split())
            if t:
                self.out.append(t)
        self.cur = None


def html_texts(html: str | None) -> list[str]:
    p = _P()
    p.feed(html or "")
    p.close()
    p.close_p()
    return p.out


def _html(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, html in zip(pdf[key], pdf["html"]):
                at = 0
                for i, t in enumerate(html_texts(html)):
                    rows.append((k, i, t, at))
                    at += len(t) + 2
            yield pd.DataFrame(rows, columns=[key, "para_idx", "text", "char_offset"])

    return run


def html_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, para_idx, text, char_offset (virtual) of the <p> elements."""
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).alias("html")).mapInPandas(_html(key), f"{key} {kind}, para_idx long, text string, char_offset long")


def links(pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str = ".") -> DataFrame:
    """Distinct link targets of the pages that match a pattern, with the first page that has them."""
    href = F.explode(F.regexp_extract_all(F.col(html), F.lit("(?i)<a\\s[^>]*href=[\"']([^\"'#]+)"), F.lit(1)))
    return pages.select(key, href.alias("url")).where(F.col("url").rlike(pattern)).groupBy("url").agg(F.min(key).alias(key))


def sentence_rows(paras: DataFrame, key: list[str]) -> DataFrame:
    """key.., sent_idx, sentence; a scene break is one sentence."""
    one = F.when(F.col("is_scene_break"), F.array("text")).otherwise(sentences(F.col("text")))
    return paras.select(*key, "is_scene_break", F.posexplode(one).alias("sent_idx", "sentence"))


def quote_depths(sentence: Column) -> tuple[Column, Column]:
    """(curly openers minus closers, straight quotes) of a sentence, apostrophes left out."""
    bare = F.regexp_replace(sentence, "([A-Za-z0-9])['’]", "$1")
    count = lambda p: (F.length(bare) - F.length(F.regexp_replace(bare, p, ""))).cast("long")
    return count("[“‘]") - count("[”’]"), count("\"")


class _Groups:
    """Joins sentences while a quotation is open; a group of several beyond max_words falls apart again."""

    def __init__(self, max_words: int):
        self.max, self.depth, self.straight = max_words, 0, False
        self.hold: list[tuple[int, int]] = []
        self.n = 0

    def flush(self) -> list[tuple]:
        if not self.hold:
            return []
        total = sum(w for _, w in self.hold)
        if len(self.hold) > 1 and total > self.max:
            out = [(self.n + i, s, s, w) for i, (s, w) in enumerate(self.hold)]
        else:
            out = [(self.n, self.hold[0][0], self.hold[-1][0], total)]
        self.n += len(out)
        self.hold = []
        return out

    def row(self, r) -> list[tuple]:
        self.hold.append((int(r.sent_idx), int(r.n_words)))
        self.depth = max(0, self.depth + int(r.curly))
        if int(r.straight) % 2:
            self.straight = not self.straight
        return self.flush() if self.depth == 0 and not self.straight else []

    def finish(self) -> list[tuple]:
        return self.flush()


def dialogue_groups(sents: DataFrame, key: list[str], max_words: int = 120) -> DataFrame:
    """key.., group_idx, first_sent, last_sent, n_words."""
    curly, straight = quote_depths(F.col("sentence"))
    rows = sents.select(*key, F.col("sent_idx").cast("long").alias("sent_idx"), curly.alias("curly"), straight.alias("straight"), word_count(F.col("sentence")).alias("n_words"))
    return ordered_fold(rows, key, ["sent_idx"], lambda: _Groups(max_words), "group_idx long, first_sent long, last_sent long, n_words long")


def semantic_units(paras: DataFrame, max_words: int = 120, key: str = "doc_id") -> DataFrame:
    """Units - sentences, or sentences that one quotation holds together - of paragraphs (key, para_idx, text, char_offset,
    is_scene_break): key, unit_idx, paragraph_index, sentence_start and sentence_end (counted over the document),
    n_items, word_count, is_scene_break, char_offset (of its first sentence), text. A sentence that forward search can't
    find again stands where the search had come to."""
    one = F.when(F.col("is_scene_break"), F.array("text")).otherwise(sentences(F.col("text")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,sentence:string>>").alias("out"))

    def step(acc, s):
        i = F.call_function("locate", s, F.col("text"), (acc["at"] + 1).cast("int")).cast("long") - 1
        start = F.when(i < 0, acc["at"]).otherwise(i)
        return F.struct(F.when(i < 0, acc["at"]).otherwise(i + F.length(s)).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), s.alias("sentence")))).alias("out"))

    sents = paras.select(key, "para_idx", "is_scene_break", "char_offset", F.posexplode(F.aggregate(one, zero, step, lambda acc: acc["out"])).alias("sent_idx", "s"))
    sents = sents.select(key, "para_idx", "is_scene_break", F.col("sent_idx").cast("long").alias("sent_idx"), (F.col("char_offset") + F.col("s.start")).alias("at"), F.col("s.sentence").alias("sentence"))
    groups = dialogue_groups(sents, [key, "para_idx"], max_words).withColumn("sent_idx", F.explode(F.sequence("first_sent", "last_sent")))
    lines = groups.join(sents, [key, "para_idx", "sent_idx"])
    units = lines.groupBy(key, "para_idx", "group_idx").agg(
        F.count(F.lit(1)).alias("n_items"), F.first("n_words").alias("word_count"), F.first("is_scene_break").alias("is_scene_break"), F.min("at").alias("char_offset"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]), " ").alias("text"),
    )
    w = Window.partitionBy(key).orderBy("para_idx", "group_idx")
    end = F.sum("n_items").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    units = units.withColumn("unit_idx", (F.row_number().over(w) - 1).cast("long")).withColumn("sentence_end", end)
    return units.select(key, "unit_idx", F.col("para_idx").alias("paragraph_index"), (F.col("sentence_end") - F.col("n_items") + 1).alias("sentence_start"), "sentence_end", "n_items", "word_count", "is_scene_break", "char_offset", "text")


class _Pages:
    """Pagination by word counts: flush when at least ``low`` words are held and the next unit would go beyond
    ``high``; a scene break closes its chunk."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.n, self.first, self.last, self.words = 0, None, None, 0

    def flush(self) -> list[tuple]:
        if self.first is None:
            return []
        out = [(self.n, self.first, self.last, self.words)]
        self.n, self.first, self.words = self.n + 1, None, 0
        return out

    def row(self, r) -> list[tuple]:
        n, out = int(r.n_words), []
        if self.words >= self.low and self.words + n > self.high:
            out = self.flush()
        if self.first is None:
            self.first = int(r.pos)
        self.last, self.words = int(r.pos), self.words + n
        return out + (self.flush() if r.is_scene_break else [])

    def finish(self) -> list[tuple]:
        return self.flush()


def paginate_words(units: DataFrame, key: str = "doc_id", low: int = 100, high: int = 300) -> DataFrame:
    """units: key, pos, n_words, is_scene_break. Gives key, chunk_idx, first_pos, last_pos, n_words."""
    units = units.select(key, "pos", "n_words", "is_scene_break")
    return ordered_fold(units, [key], ["pos"], lambda: _Pages(low, high), "chunk_idx long, first_pos long, last_pos long, n_words long")


class _Seams:
    """Greedy pagination at the weakest seam. Holds at most the units of one chunk and the seam behind each."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.units: list[tuple[int, int, bool, float | None]] = []
        self.n = 0

    def cut(self, upto: int) -> tuple:
        part, self.units = self.units[: upto + 1], self.units[upto + 1 :]
        out = (self.n, part[0][0], part[-1][0], sum(u[1] for u in part))
        self.n += 1
        return out

    def drain(self, last: bool) -> list[tuple]:
        out = []
        while self.units:
            total, end, broken, over = 0, -1, False, False
            for i, (_, n, brk, _) in enumerate(self.units):
                if i and total + n > self.high:
                    over = True
                    break
                total, end = total + n, i
                if brk:
                    broken = True
                    break
            if broken:
                out.append(self.cut(end))
                continue
            if not over:
                if not last:
                    return out
                out.append(self.cut(len(self.units) - 1))
                continue
            run, best, at = 0, None, end
            for i in range(end + 1):
                run += self.units[i][1]
                seam = self.units[i][3]
                if run >= self.low and seam is not None and (best is None or seam < best):
                    best, at = seam, i
            out.append(self.cut(at))
        return out

    def row(self, r) -> list[tuple]:
        seam = None if r.seam is None or r.seam != r.seam else float(r.seam)
        self.units.append((int(r.pos), int(r.n_words), bool(r.is_scene_break), seam))
        return self.drain(False)

    def finish(self) -> list[tuple]:
        return self.drain(True)


def paginate_semantic(units: DataFrame, key: str = "doc_id", low: int = 100, high: int = 300) -> DataFrame:
    """units: key, pos, n_words, is_scene_break, seam (to the next unit). Gives key, chunk_idx, first_pos, last_pos, n_words."""
    units = units.select(key, "pos", "n_words", "is_scene_break", "seam")
    return ordered_fold(units, [key], ["pos"], lambda: _Seams(low, high), "chunk_idx long, first_pos long, last_pos long, n_words long")


def paginate(units: DataFrame, key: str, low: int, high: int, on_error: str = "pass_through", have_vectors: bool = True) -> DataFrame:
    """Semantic pagination, or the fallback where vectors could not be had: by word counts, or an error."""
    if on_error not in ("pass_through", "raise"):
        raise ValueError(f"unknown policy {on_error!r}")
    if have_vectors:
        return paginate_semantic(units, key, low, high)
    if on_error == "raise":
        raise RuntimeError("embedding failed")
    return paginate_words(units, key, low, high)


def seam_scores(units: DataFrame, key: str, order: str = "pos", vec: str = "vec") -> DataFrame:
    """Adds ``seam``: similarity of a unit to the next one of its key, null at the end."""
    from folio.functions.vector import cosine

    return units.withColumn("seam", F.round(cosine(F.col(vec), F.lead(vec).over(Window.partitionBy(key).orderBy(order))), 10))


def word_spans(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` words with their exact source span, up to the next window's first word or the text's end: key,
    window_idx, start, end, n_words. In Arrow batches: the same as JVM expressions took four times as long on sf0.1."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    word = re.compile(r"\S+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf["_t"]):
                starts = [m.start() for m in word.finditer(t)]
                ends = [*starts[size::size], len(t)]
                rows += [(k, i, starts[i * size], end, min(size, len(starts) - i * size)) for i, end in enumerate(ends) if i * size < len(starts)]
            yield pd.DataFrame(rows, columns=[key, "window_idx", "start", "end", "n_words"])

    return docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t")).mapInPandas(run, f"{key} {kind}, window_idx long, start long, end long, n_words long")


def truncate_at_paragraph(paras: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Paragraphs up to the last boundary within n words; the first is always kept."""
    cum = F.sum(word_count(F.col("text"))).over(Window.partitionBy(key).orderBy("para_idx"))
    stop = F.min(F.when((F.col("_cum") > n) & (F.col("para_idx") > 0), F.col("para_idx"))).over(Window.partitionBy(key))
    return paras.withColumn("_cum", cum).withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("para_idx") < F.col("_stop"))).drop("_cum", "_stop")


def chunk_runs(chunks: DataFrame, key: str, order: str, n_docs: int, length: int) -> DataFrame:
    """``n_docs`` runs of ``length`` consecutive chunks at an even stride: key, run, order and its place in the run."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    pos = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    stride = F.greatest(F.lit(length), F.floor((F.col("_n") - length) / max(1, n_docs - 1)))
    out = chunks.withColumn("_n", n).withColumn("_pos", pos).where(F.col("_n") >= length).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_docs - 1).cast("long"))))
    start = F.col("run") * stride
    return out.where((F.col("_pos") >= start) & (F.col("_pos") < start + length) & (start + length <= F.col("_n"))).select(key, "run", order, (F.col("_pos") - start).cast("long").alias("place"))
