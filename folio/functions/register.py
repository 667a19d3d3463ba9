"""SQL surface: temporary functions and table functions over the same definitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folio.functions.text import WS
from folio.runtime import ship


@udtf(returnType="para_idx long, text string, char_offset long")
class HtmlParagraphs:
    """Paragraphs of an HTML page with virtual offsets."""

    def eval(self, html: str) -> Iterator[tuple]:
        from folio.operators.segment import html_texts

        at = 0
        for i, t in enumerate(html_texts(html)):
            yield i, t, at
            at += len(t) + 2


@udtf(returnType="window_idx long, start long, `end` long")
class WordWindows:
    """Windows of a number of words with their source spans."""

    def eval(self, text: str, size: int) -> Iterator[tuple]:
        import re

        starts = [m.start() for m in re.finditer(r"\S+", text or "")]
        for i in range(0, len(starts), max(1, size)):
            yield i // size, starts[i], starts[i + size] if i + size < len(starts) else len(text)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL: folio_cosine, folio_words, folio_collapse, folio_html_paragraphs, folio_word_windows."""
    ship(spark)
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (acc, x) -> acc + x)"
    norms = f"sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION folio_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN {norms} = 0 THEN 0D ELSE {dot.format('a', 'b')} / ({norms}) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION folio_words(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(t, r'{WS}+'), w -> w <> '')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION folio_collapse(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, r'{WS}+', ' '))")
    spark.udtf.register("folio_html_paragraphs", HtmlParagraphs)
    spark.udtf.register("folio_word_windows", WordWindows)
