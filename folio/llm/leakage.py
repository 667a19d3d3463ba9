"""Held-out passages inside training documents, by winnowing (problem 7).

A passage leaks into a document if the document holds at least ``WORDS`` consecutive words of it, or, for passages
in scripts without spaces (zh, ja, th), at least ``CHARS`` consecutive letters, digits and combining marks. Case,
punctuation, underscores, white space and the encoding of accents don't count.

Both sides are turned into sequences of word hashes (or characters), hashed in k-grams, and winnowed with a window
such that k + window - 1 is the length asked for: every span of that length shares a fingerprint. Fingerprints of
documents and passages are joined, and every hit is extended on the sequences to its full run, which also settles
hash collisions. The passages' fingerprints go to the workers while there are at most ``MAX_PROBE`` of them; beyond
that both sides are shuffled and joined.

Defined cases: null and blank texts or passages leak nothing; passages below the length can't leak; several items on
one passage are all reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.textkeys import codes, grams, window_picks
from folio.runtime import read, ship, spread

WORDS, CHARS = 14, 40
K = {"w": 8, "c": 24}
NEED = {"w": WORDS, "c": CHARS}
MAX_PROBE = 1_000_000
UNSPACED = ("zh", "ja", "th")


def _mark_ranges() -> str:
    """The combining marks as ranges of a character class."""
    out, start, last = [], None, None
    for o in range(0x300, 0x20000):
        if unicodedata.category(chr(o))[0] == "M":
            if last != o - 1:
                if start is not None:
                    out.append(f"{chr(start)}-{chr(last)}")
                start = o
            last = o
    out.append(f"{chr(start)}-{chr(last)}")
    return "".join(out)


WORD = re.compile(f"[\\w{_mark_ranges()}]+")
UNSPACED_CHAR = re.compile("[฀-๿぀-ヿ㐀-鿿豈-﫿]")


def fold(text: str) -> str:
    """Canonical spelling: composed accents, no case, no underscores."""
    if text.isascii():
        return text.lower().replace("_", " ")
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    text = text.casefold()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("_", " ")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_values(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def sequences(text: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Word hashes, and the letters and digits as code points where the text has an unspaced script."""
    if not text:
        return np.empty(0, np.uint64), None
    words = WORD.findall(fold(text))
    chars = codes("".join(words)).astype(np.uint64) if UNSPACED_CHAR.search(text) else None
    return word_values(words), chars


def picks(values: list[np.ndarray], k: int, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed fingerprints of many sequences at once: (sequence, position in it, hash)."""
    sizes = np.array([len(v) for v in values])
    total = int(sizes.sum())
    if total < need:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(len(values)), sizes)
    h = grams(flat, k)
    at = window_picks(h, need - k + 1)
    inside = owner[: len(at)] == owner[need - 1 : need - 1 + len(at)]  # windows within one sequence
    at = np.unique(at[inside])
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return owner[at], at - base[owner[at]], h[at]


def run_length(a: np.ndarray, p: int, b: np.ndarray, q: int) -> int:
    """Length of the common run of a and b through a[p], b[q]."""
    n = min(len(a) - p, len(b) - q)
    diff = np.flatnonzero(a[p : p + n] != b[q : q + n])
    right = int(diff[0]) if len(diff) else n
    m = min(p, q)
    diff = np.flatnonzero(a[p - m : p][::-1] != b[q - m : q][::-1])
    return right + (int(diff[0]) if len(diff) else m)


def leaks(doc: np.ndarray, hits: list[tuple[int, int, int]], passages: dict[int, np.ndarray], need: int) -> dict[int, int]:
    """Longest common run with each passage, where it reaches ``need``. hits: (position, passage, position in it)."""
    out: dict[int, int] = {}
    seen: set[tuple[int, int]] = set()
    for p, pid, q in hits:
        if (pid, p - q) in seen and out.get(pid, 0) >= need:
            continue
        seen.add((pid, p - q))
        n = run_length(doc, p, passages[pid], q)
        if n >= need:
            out[pid] = max(out.get(pid, 0), n)
    return out


def _values(mode: str, text: str | None) -> np.ndarray:
    w, c = sequences(text)
    return w if mode == "w" else (c if c is not None else np.empty(0, np.uint64))


class Probe:
    """The passages' fingerprints, sorted, with the passages' sequences."""

    def __init__(self, passages: list[tuple[int, str, str]]):
        self.seq: dict[str, dict[int, np.ndarray]] = {"w": {}, "c": {}}
        self.table: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for pid, mode, text in passages:
            self.seq[mode][pid] = _values(mode, text)
        for mode, seqs in self.seq.items():
            ids = np.array(list(seqs), np.int64)
            own, pos, h = picks(list(seqs.values()), K[mode], NEED[mode]) if len(ids) else (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
            order = np.argsort(h, kind="stable")
            self.table[mode] = (h[order], ids[own[order]] if len(own) else own, pos[order])

    def find(self, mode: str, values: list[np.ndarray]) -> dict[int, dict[int, int]]:
        keys, pids, qs = self.table[mode]
        if not len(keys):
            return {}
        own, pos, h = picks(values, K[mode], NEED[mode])
        lo = np.searchsorted(keys, h, "left")
        hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h)
        grouped: dict[int, list] = {}
        for i in hit:
            j = lo[i]
            while j < len(keys) and keys[j] == h[i]:
                grouped.setdefault(int(own[i]), []).append((int(pos[i]), int(pids[j]), int(qs[j])))
                j += 1
        return {d: found for d, hits in grouped.items() if (found := leaks(values[d], hits, self.seq[mode], NEED[mode]))}


LEAKS = "doc_id long, pid long, n_shared long"


def _probing(probe: Probe):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            ids = pdf["doc_id"].to_numpy()
            pairs = [sequences(t) for t in pdf["text"]]
            for mode, values in (("w", [p[0] for p in pairs]), ("c", [p[1] for p in pairs])):
                keep = [i for i, v in enumerate(values) if v is not None and len(v) >= NEED[mode]]
                for d, found in probe.find(mode, [values[i] for i in keep]).items():
                    rows += [(ids[keep[d]], pid, n) for pid, n in found.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "pid", "n_shared"]).astype(np.int64)

    return run


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids = pdf["id"].to_numpy()
        for mode in ("w", "c"):
            mine = pdf["mode"].isin([mode, "both"]).to_numpy()
            own, pos, h = picks([_values(mode, t) for t in pdf["text"][mine]], K[mode], NEED[mode]) if mine.any() else ([], [], np.empty(0, np.uint64))
            if len(own):
                yield pd.DataFrame({"id": ids[mine][own], "mode": mode, "h": h.view(np.int64), "pos": pos})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            a, b = _values(r.mode, r.text), _values(r.mode, r.passage)
            got = leaks(a, [(m["p"], 0, m["q"]) for m in r.hits], {0: b}, NEED[r.mode])
            rows += [(r.doc_id, r.pid, n) for n in got.values()]
        yield pd.DataFrame(rows, columns=["doc_id", "pid", "n_shared"]).astype(np.int64)


def passages_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages: pid, mode, passage; items: pid, item_id)."""
    lang = F.lower(F.trim("lang"))
    own = items.where("passage is not null and item_id is not null").select("item_id", "passage", F.when(lang.rlike("^(zh|ja|th|zho|jpn|tha|chi)\\b"), "c").otherwise(F.when(F.col("lang").isNull() & F.col("passage").rlike("[\\u0e00-\\u0e7f\\u3040-\\u30ff\\u3400-\\u9fff]"), "c").otherwise("w")).alias("mode"))
    keyed = own.withColumn("pid", F.xxhash64("mode", "passage"))
    return keyed.groupBy("pid").agg(F.first("mode").alias("mode"), F.first("passage").alias("passage")), keyed.select("pid", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, max_probe: int = MAX_PROBE) -> DataFrame:
    """doc_id, item_id and the longest shared run for every leak."""
    spark = documents.sparkSession
    ship(spark)
    passages, owners = passages_of(items)
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    size = passages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("passage")).alias("chars")).first()
    if (size["chars"] or 0) <= 4 * max_probe:  # a passage has fewer fingerprints than characters
        rows = [(r["pid"], r["mode"], r["passage"]) for r in passages.collect()]
        found = docs.mapInPandas(_probing(Probe(rows)), LEAKS)
    else:
        schema = "id long, mode string, h long, pos long"
        d = docs.select(F.col("doc_id").alias("id"), F.lit("both").alias("mode"), "text").mapInPandas(_prints, schema)
        t = passages.select(F.col("pid").alias("id"), "mode", F.col("passage").alias("text")).mapInPandas(_prints, schema)
        hits = d.select(F.col("id").alias("doc_id"), "mode", "h", F.col("pos").alias("p")).join(t.select(F.col("id").alias("pid"), "mode", "h", F.col("pos").alias("q")), ["mode", "h"])
        hits = hits.groupBy("doc_id", "pid", "mode").agg(F.collect_set(F.struct("p", "q")).alias("hits"))
        found = hits.join(docs, "doc_id").join(passages.select("pid", "passage"), "pid").mapInPandas(_verified, LEAKS)
    return found.join(owners, "pid").groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a held-out passage, in whole or in part, with the items it leaks."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    items = read(spark, sf_dir, "eval_item", "item_id", "lang", "passage")
    return leaked_items(docs, items).select("doc_id", "item_id")
