"""Structured Streaming surfaces: keyed anchor threads as rows arrive, and windowed counts with late data."""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.runtime import shared_folder, ship


def _threads(tau: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        anchors: list[np.ndarray] = pickle.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("pos")  # one micro-batch of one key
        out = []
        for pos, vec in zip(rows["pos"], rows["vec"]):
            if vec is None:
                continue
            v = np.asarray(vec, np.float64)
            n = np.sqrt(v @ v)
            v = v / n if n > 0 else v
            s = np.round(np.vstack(anchors) @ v, 10) if anchors else np.array([])
            at = int(np.argmax(s)) if len(s) else -1
            if at < 0 or s[at] < tau:
                anchors.append(v)
                at = len(anchors) - 1
                out.append((key[0], int(pos), at, True))
            else:
                out.append((key[0], int(pos), at, False))
        state.update((pickle.dumps(anchors),))
        yield pd.DataFrame(out, columns=["key", "pos", "thread_id", "opened"])

    return step


def stream_threads(stream: DataFrame, tau: float = 0.35) -> DataFrame:
    """Anchor clustering on a stream of (key, pos, vec); a thread's state is its anchors. Positions of a key must not
    go back between micro-batches."""
    ship(stream.sparkSession)
    kind = stream.schema["key"].dataType.simpleString()
    return stream.groupBy("key").applyInPandasWithState(_threads(tau), f"key {kind}, pos long, thread_id long, opened boolean", "anchors binary", "append", "NoTimeout")


def windowed_counts(stream: DataFrame, at: str = "ts", by: str = "event_type", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; rows later than the watermark are dropped once their window has closed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives the result as a batch table in the shared folder."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{folder}/out")


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file source over a parquet table, which may be one file or a folder of them."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if os.path.isdir(path) else os.path.dirname(path) + "/" + os.path.basename(path) + "*")
