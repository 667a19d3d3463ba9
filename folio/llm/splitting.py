"""Oversized chunks cut at natural boundaries by agglomerative merging (problem 6).

The atoms of a chunk are its sentences; a sentence that doesn't fit alone is cut at spaces, and where it has
none, at the limit. Adjacent atoms are held in a heap by the strength of the boundary between them (0 inside a
sentence, 1 sentence, 2 paragraph, 3 scene break) and their joint size; the weakest boundary merges first, as long
as the joint size plus the overlap fits. A chunk's kind is that of the strongest boundary which the merging met. What remains are the pieces: each starts ``overlap`` characters before its
own text (the first at 0), none is longer than ``limit``, and together they cover the whole text.

Defined cases: chunks of at most ``limit`` characters and null texts make no piece; paragraphs that can't be found
in the text are left out of the boundaries; repeated rows of one key are one chunk.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.sentences import Model, chunk_paragraphs, is_break, split, train
from folio.runtime import read, ship

LIMIT, OVERLAP = 1500, 150
KINDS = ("none", "sentence", "paragraph", "scene")


def paragraphs_in(text: str, paras: list[str]) -> list[int]:
    """Start of each paragraph in the text, looked up in order; those that can't be found are left out."""
    at, out = 0, []
    for p in paras:
        i = text.find(p, at) if p else -1
        if i >= 0:
            out.append(i)
            at = i + len(p)
    return out


def atoms(text: str, starts: list[tuple[int, int]], model: Model, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, strength of the boundary before it) of each atom; atoms cover the text. starts: (offset, strength, is a break)."""
    marks: dict[int, int] = {0: 0}
    bounds = sorted({0, *(s[0] for s in starts), len(text)})
    strength = {s[0]: s[1] for s in starts}
    heads = {s[0] for s in starts if len(s) > 2 and s[2]}
    for a, b in zip(bounds, bounds[1:]):
        marks[a] = max(marks.get(a, 0), strength.get(a, 0))
        for x, _ in split(text[a:b], a in heads, model):
            if x:
                marks.setdefault(a + x, 1)
    fits = limit - overlap
    order = sorted(marks)
    for a, b in zip(order, [*order[1:], len(text)]):
        while b - a > fits:
            cut = text.rfind(" ", a + 1, a + fits)
            a = cut + 1 if cut > a else a + fits
            marks.setdefault(a, 0)
    return sorted(marks.items())


def merge(segments: list[tuple[int, int]], total: int, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], int]:
    """(start, end, strength of the boundary before) of the merged pieces, without their overlap; and the strength of the
    strongest boundary that was to be had: of the cuts that are left, or of a boundary that was merged away where all
    that is left is weaker (a heading just before the end of a long paragraph, say)."""
    n = len(segments)
    start = [s for s, _ in segments]
    end = [*start[1:], total]
    force = [f for _, f in segments]
    prev, nxt, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    version = [0] * n
    strongest = 0
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if i >= 0 and j >= 0:
            size = end[j] - start[i]
            if size + (overlap if start[i] else 0) <= limit:
                heapq.heappush(heap, (force[j], size, start[i], i, version[i] + version[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, size, _, i, v = heapq.heappop(heap)
        j = nxt[i] if alive[i] else -1
        if not alive[i] or j < 0 or version[i] + version[j] != v or end[j] - start[i] != size:
            continue
        end[i], nxt[i], alive[j] = end[j], nxt[j], False
        strongest = max(strongest, force[j])
        if nxt[i] >= 0:
            prev[nxt[i]] = i
        version[i] += 1
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    left = [(start[i], end[i], force[i]) for i in range(n) if alive[i]]
    return left, max([strongest, *(f for _, _, f in left[1:])])


def pieces(text: str, paras: list[dict], model: Model, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, str]]]:
    """The kind of the strongest boundary that the merging met, and the pieces (start with overlap, end, kind of the cut before)."""
    breaks = [bool(p["is_scene_break"]) if p["is_scene_break"] is not None else is_break(p["text"]) for p in paras]
    at, starts = 0, []
    for k, (p, b) in enumerate(zip(paras, breaks)):
        i = text.find(p["text"], at) if p["text"] else -1
        if i >= 0:
            starts.append((i, 3 if b or (k and breaks[k - 1]) else 2, b))
            at = i + len(p["text"])
    segs = atoms(text, starts, model, limit, overlap)
    done, strongest = merge(segs, len(text), limit, overlap)
    return KINDS[strongest], [(max(0, a - overlap), b, KINDS[f]) for a, b, f in done]


PIECES = "doc_id long, chunk_idx long, boundary string, piece_idx long, piece_start long, piece_end long, cut string"


def _cut(model: Model, limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, idx, text, paras in zip(pdf["doc_id"], pdf["chunk_idx"], pdf["text"], pdf["paras"]):
                kind, cuts = pieces(text, [] if paras is None else list(paras), model, limit, overlap)
                rows += [(doc, idx, kind, k, a, b, c) for k, (a, b, c) in enumerate(cuts)]
            out = pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "boundary", "piece_idx", "piece_start", "piece_end", "cut"])
            yield out.astype({c: np.int64 for c in ("doc_id", "chunk_idx", "piece_idx", "piece_start", "piece_end")})

    return run


def split_oversized(spark: SparkSession, chunks: DataFrame, paragraphs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, units: DataFrame | None = None) -> DataFrame:
    """Pieces of every chunk of more than ``limit`` characters. units: what the sentence model is fitted on."""
    ship(spark)
    model = train(units)
    return chunk_paragraphs(chunks, paragraphs, limit).select("doc_id", "chunk_idx", "text", "paras").mapInPandas(_cut(model, limit, overlap), PIECES)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(
        spark,
        read(spark, sf_dir, "chunk", "doc_id", "chunk_idx", "text", "paragraph_indices", "char_start", "char_end"),
        read(spark, sf_dir, "paragraph", "doc_id", "para_idx", "text", "is_scene_break", "char_offset"),
        units=read(spark, sf_dir, "semantic_unit", "doc_id", "unit_idx", "items", "is_scene_break"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized chunk with the best kind of boundary it offers."""
    return _split(spark, sf_dir).where("piece_idx = 0").select("doc_id", "chunk_idx", "boundary")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized chunks with their offsets and the kind of each cut."""
    return _split(spark, sf_dir)
