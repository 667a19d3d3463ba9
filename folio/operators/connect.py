"""Injection points for models and services: embedding, chat and scoring functions with retries, rate limits, batches
and a memo. The defaults are deterministic and need no service."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.runtime import ship

Embed = Callable[[list[str], str], list[list[float]]]
Chat = Callable[[list[dict]], str]


class ServiceError(RuntimeError):
    """A service call that failed for good."""


def hashed_embed(texts: list[str], input_type: str = "passage", dimensions: int = 64) -> list[list[float]]:
    """Unit vectors of hashed word counts; the zero vector for a text without words."""
    if input_type not in ("passage", "query"):
        raise ValueError(f"unknown input type {input_type!r}")
    out = []
    for t in texts:
        v = np.zeros(dimensions)
        for w in (t or "").lower().split():
            v[int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % dimensions] += 1
        n = float(np.sqrt((v * v).sum()))
        out.append((v / n if n else v).tolist())
    return out


def lead_chat(messages: list[dict]) -> str:
    """Stub model: the first sentence of the last message."""
    import re

    parts = re.split(r"(?<=[.!?…])\s+", messages[-1]["content"].strip())
    return parts[0] if parts else ""


def retrying(call: Callable, attempts: int = 3, wait: str = "exponential", base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Calls again on failure; wait: 'none', 'linear' or 'exponential' (with jitter)."""

    def run(*args, **kwargs):
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as e:
                if k == attempts - 1:
                    raise ServiceError(f"gave up after {attempts} attempts") from e
                if wait == "linear":
                    sleep(base * (k + 1))
                elif wait == "exponential":
                    sleep(base * 2**k * (1 + random.random() / 4))

    return run


class RateLimiter:
    """At most ``per_second / share`` calls a second in this worker; share: the number of workers that call."""

    def __init__(self, per_second: float, share: int = 1, clock=time.monotonic, sleep=time.sleep):
        if per_second <= 0:
            raise ValueError("per_second must be positive")
        self.gap, self.clock, self.sleep, self.next = share / per_second, clock, sleep, None

    def acquire(self) -> None:
        now = self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


def restore_order(items: list[dict]) -> list[list[float]]:
    """Vectors of a service reply in the order of the request, whatever order they came in."""
    return [x["embedding"] for x in sorted(items, key=lambda x: x["index"])]


def embed_texts(df: DataFrame, key: str, text: str, embed: Embed = hashed_embed, input_type: str = "passage", batch: int = 16, on_error: str = "null") -> DataFrame:
    """key, vec; distinct texts are embedded once, in batches. A failed batch gives null vectors, or raises."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ts, out = pdf["t"].tolist(), []
            for i in range(0, len(ts), batch):
                part = ts[i : i + batch]
                try:
                    out += embed(part, input_type)
                except Exception:
                    if on_error == "raise":
                        raise
                    out += [None] * len(part)
            yield pd.DataFrame({"t": ts, "vec": out})

    one = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct().mapInPandas(run, "t string, vec array<double>")
    return df.select(key, F.col(text).alias("t")).join(one, "t", "left").select(key, "vec")


def with_memo(wanted: DataFrame, memo: DataFrame, embed: Embed = hashed_embed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all vectors, new vectors, hit counts) for distinct (text, input_type); only what the memo lacks is embedded."""
    ask = wanted.select("text", "input_type").distinct()
    misses = ask.join(memo, ["text", "input_type"], "left_anti")
    new = None
    for kind in ("passage", "query"):
        part = misses.where(F.col("input_type") == kind)
        vecs = embed_texts(part.withColumn("k", F.col("text")), "k", "text", embed, kind).select(F.col("k").alias("text"), F.lit(kind).alias("input_type"), "vec")
        new = vecs if new is None else new.unionByName(vecs)
    counts = ask.join(memo.select("text", "input_type", F.lit(1).alias("hit")), ["text", "input_type"], "left").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("hits"))
    held = memo.join(ask, ["text", "input_type"], "left_semi")
    return held.unionByName(new), new, counts


def chat_rows(df: DataFrame, key: str, prompt: str, chat: Chat = lead_chat) -> DataFrame:
    """key, reply; null where the call failed or the prompt is null."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf["p"]:
                try:
                    out.append(None if p is None else chat([{"role": "user", "content": p}]))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({key: pdf[key], "reply": out})

    return df.select(key, F.col(prompt).alias("p")).mapInPandas(run, f"{key} {kind}, reply string")


def score_sentences(df: DataFrame, score: Callable[[list[str]], list[float]], text: str = "sentence", max_tokens: int = 512) -> DataFrame:
    """Adds ``score``; sentences that begin beyond ``max_tokens`` words of their group get -Infinity upstream of it."""
    ship(df.sparkSession)
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.array(score([t or "" for t in pdf[text]]), float)
            if "tokens_before" in pdf:
                s = np.where(pdf["tokens_before"] >= max_tokens, -np.inf, s)
            yield pdf.assign(score=s)

    return df.mapInPandas(run, schema)
