"""Session plumbing shared by every operator: table reads, code shipping and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Operators hand module-level functions to ``mapInPandas``; those are pickled by reference, so each
    executor must be able to import the package even when it has no shared source tree.
    """
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app in _SHIPPED:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="folio-code-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "folio_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for base, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(base, f)
                        z.write(full, os.path.join("folio", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, pruned to the given columns (all if none are given)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors see: the one the cluster names in ``spark.checkpoint.dir``. Only a local session,
    as in tests, gets one of its own, which goes when the program ends; elsewhere it is an error to name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    with _LOCK:
        if "base" not in _LOCAL:
            _LOCAL["base"] = tempfile.mkdtemp(prefix="folio-shared-")
            atexit.register(shutil.rmtree, _LOCAL["base"], True)
    return _LOCAL["base"]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage. Never ``localCheckpoint``: executors may be lost.
    Spark removes the files with the DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; ``release`` removes it."""
    path = f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Removes the folders that ``shared_folder`` made so far, once their tables have been read; how many."""
    n = 0
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def shuffle_parts(spark: SparkSession, least: int = 12) -> int:
    """The session's shuffle width, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer partitions than those: a table in one small file is one partition,
    however costly its rows are. Tables of many files pass through without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
