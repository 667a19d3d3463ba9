"""Token budgets by longest-match subword counts (problem 2), in time linear in the text.

A vocabulary becomes a trie with failure links. Every node knows how many tokens are emitted when the walk fails
there (precomputed) and at which node it goes on, so no character is read twice. A character that no piece covers
counts as its UTF-8 bytes, as byte-fallback tokenizers have it. The count is exact for longest-match segmentation of
the vocabulary, units being a word with the space before it; for a BPE vocabulary it is an estimate of the merges'
count (README gives the measured deviation). Counts of units are remembered, so recurring words cost one lookup.

Defined cases: null and empty texts have 0 tokens; null ``source``, ``lang`` or ``genre`` form the slice 'unknown';
repeated chunks count once; chunks without a document fall under 'unknown'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.runtime import read, ship, spread

SPACE = "▁"
UNIT = re.compile(r" ?\S+| +(?= )|\s")
TOKENIZER = "piece_bpe_32k.model"
#: Spellings of languages beside the two-letter code.
LANGUAGES = {
    "eng": "en", "english": "en", "ger": "de", "deu": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es",
    "zho": "zh", "chi": "zh", "chinese": "zh", "jp": "ja", "jpn": "ja", "japanese": "ja", "hin": "hi", "hindi": "hi", "tha": "th", "thai": "th",
}


def pieces_of(path: str | None = None) -> list[str]:
    """The ordinary pieces of a sentencepiece model; the path is a parameter, by default the public 32k vocabulary."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class LongestMatch:
    """Trie with failure links: ``goto[v]`` by character, ``fail[v]`` where the walk goes on, ``emit[v]`` tokens emitted then."""

    def __init__(self, pieces: list[str]):
        self.goto: list[dict[str, int]] = [{}]
        depth, final, order = [0], [False], [(0, 0, "")]
        for piece in pieces:
            v = 0
            for c in piece:
                nxt = self.goto[v].get(c)
                if nxt is None:
                    nxt = self.goto[v][c] = len(self.goto)
                    self.goto.append({})
                    depth.append(depth[v] + 1)
                    final.append(False)
                    order.append((nxt, v, c))
                v = nxt
            if piece:
                final[v] = True
        n = len(self.goto)
        self.fail, self.emit = [0] * n, [0] * n
        order.sort(key=lambda x: depth[x[0]])
        for v, parent, c in order[1:]:
            if final[v]:
                self.emit[v] = 1
            elif parent == 0:
                self.emit[v] = len(c.encode("utf-8", "surrogatepass"))
            else:  # the parent's string fails first; then c is read from where that leads
                total, z = self.emit[parent], self.fail[parent]
                while c not in self.goto[z] and z:
                    total += self.emit[z]
                    z = self.fail[z]
                if c in self.goto[z]:
                    self.emit[v], self.fail[v] = total, self.goto[z][c]
                else:
                    self.emit[v], self.fail[v] = total + len(c.encode("utf-8", "surrogatepass")), 0
        self.memo: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Tokens of one unit (spaces already replaced)."""
        goto, fail, emit = self.goto, self.fail, self.emit
        v = total = 0
        for c in text:
            nxt = goto[v].get(c)
            while nxt is None and v:
                total += emit[v]
                v = fail[v]
                nxt = goto[v].get(c)
            if nxt is None:
                total += len(c.encode("utf-8", "surrogatepass"))
            else:
                v = nxt
        while v:
            total += emit[v]
            v = fail[v]
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        memo, total = self.memo, 0
        for u in UNIT.findall(text if text[0] == " " else " " + text):
            n = memo.get(u)
            if n is None:
                n = self.unit(u.replace(" ", SPACE))
                if len(u) <= 24:
                    if len(memo) > 1_000_000:
                        memo.clear()
                    memo[u] = n
            total += n
        return total


_READY: dict[int, LongestMatch] = {}


def _machine(pieces: list[str]) -> LongestMatch:
    key = xxhash.xxh64_intdigest("\0".join(pieces))
    if key not in _READY:
        _READY[key] = LongestMatch(pieces)
    return _READY[key]


def _counter(pieces, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _machine(pieces.value)
        for pdf in batches:
            out = pdf[keys].copy()
            out["n_tokens"] = np.fromiter((m.count(t) for t in pdf["text"]), np.int64, len(pdf))
            yield out

    return run


def token_counts(df: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """The key columns and ``n_tokens`` of column ``text`` under a longest-match vocabulary."""
    spark = df.sparkSession
    ship(spark)
    pieces = spark.sparkContext.broadcast(pieces_of(path))  # a vocabulary: tens of thousands of short strings
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", n_tokens long"
    return spread(df.select(*keys, "text")).mapInPandas(_counter(pieces, keys), schema)


def slice_name(c: Column) -> Column:
    """One spelling: no case, no outer blanks, words joined by underscores, 'unknown' for null and blank."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s_.-]+", "_"), "^_+|_+$", "")
    return F.when(c.isNull() | (out == ""), F.lit("unknown")).otherwise(out)


def language_code(c: Column) -> Column:
    """Two-letter code: region and script suffixes dropped, longer codes and names mapped."""
    base = F.split(slice_name(c), "_").getItem(0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[base], base)


def labelled_counts(documents: DataFrame, chunks: DataFrame, path: str | None = None) -> DataFrame:
    """field_name, source, lang, genre, n_tokens of every document and chunk."""
    labels = ["doc_id", "source", "lang", "genre"]
    d = token_counts(documents.select(*labels, "text"), labels, path)
    named = lambda df, name: df.select(F.lit(name).alias("field_name"), slice_name(F.col("source")).alias("source"), language_code(F.col("lang")).alias("lang"), slice_name(F.col("genre")).alias("genre"), "n_tokens")
    one = chunks.groupBy("doc_id", "chunk_idx").agg(F.max("text").alias("text"))
    c = token_counts(one, ["doc_id"], path).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    c = c.join(documents.select(*labels), "doc_id", "left")
    return named(d, "document").unionByName(named(c, "chunk"))


def budget(documents: DataFrame, chunks: DataFrame, path: str | None = None) -> DataFrame:
    """Total tokens by source, language and genre, with subtotals ('all') for each of them and for everything."""
    sets = labelled_counts(documents, chunks, path).groupBy("field_name", "source", "lang", "genre").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    cells = F.array(*[F.struct(*[(F.lit("all") if k in drop else F.col(k)).alias(k) for k in ("source", "lang", "genre")]) for drop in ((), ("lang", "genre"), ("source", "genre"), ("source", "lang"), ("source", "lang", "genre"))])
    long = sets.select("field_name", "n_tokens", "n_docs", F.explode(cells).alias("s"))
    return long.groupBy("field_name", F.col("s.source").alias("source"), F.col("s.lang").alias("lang"), F.col("s.genre").alias("genre")).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"))


def logged_prompts(sweep: DataFrame) -> DataFrame:
    """Prompt tokens logged per genre. Of impossible figures (null, not positive, or at odds with the total) those
    that total and completion give are mended; the rest, failed calls, are left out and counted."""
    one = sweep.groupBy("result_id").agg(*[F.max(c).alias(c) for c in ("genre", "prompt_tokens", "completion_tokens", "total_tokens")])
    p, c, t = F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens")
    good = (p > 0) & (c >= 0) & (p + c == t)
    mended = (t > c) & (c >= 0) & (t < 1_000_000)
    figure = F.when(good, p).when(mended, t - c)
    return one.groupBy(slice_name(F.col("genre")).alias("genre")).agg(F.sum(figure).alias("prompt_tokens"), F.count(figure).alias("n_calls"), F.count(F.when(~F.coalesce(good, F.lit(False)) & mended, 1)).alias("n_mended"), F.count(F.when(figure.isNull(), 1)).alias("n_failed"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "genre"), read(spark, sf_dir, "chunk", "doc_id", "chunk_idx", "text")


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and chunk with its source, language and genre in one spelling."""
    documents, chunks = _inputs(spark, sf_dir)
    labels = ["doc_id", "source", "lang", "genre"]
    slices = [slice_name(F.col("source")).alias("source"), language_code(F.col("lang")).alias("lang"), slice_name(F.col("genre")).alias("genre")]
    d = token_counts(documents.select(*labels, "text"), labels).select("doc_id", F.lit(None).cast("int").alias("chunk_idx"), *slices, "n_tokens")
    one = chunks.groupBy("doc_id", "chunk_idx").agg(F.max("text").alias("text"))
    c = token_counts(one, ["doc_id", "chunk_idx"]).join(documents.select(*labels), "doc_id", "left").select("doc_id", "chunk_idx", *slices, "n_tokens")
    return d.unionByName(c)


def p2_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents and chunks by source, language and genre."""
    return budget(*_inputs(spark, sf_dir))


def p2_against_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per genre set against the prompt tokens that the threshold sweep logged."""
    cols = ("result_id", "genre", "prompt_tokens", "completion_tokens", "total_tokens")
    log = logged_prompts(read(spark, sf_dir, "qa_stage2_adaptive_threshold_sweep_ratio0chk", *cols))
    own = labelled_counts(*_inputs(spark, sf_dir)).groupBy("genre").agg(F.sum(F.when(F.col("field_name") == "document", F.col("n_tokens"))).alias("document_tokens"), F.sum(F.when(F.col("field_name") == "chunk", F.col("n_tokens"))).alias("chunk_tokens"))
    return own.join(log, "genre", "full").withColumn("prompt_share", F.round(F.col("prompt_tokens") / (F.col("n_calls") * F.col("document_tokens")), 9))
