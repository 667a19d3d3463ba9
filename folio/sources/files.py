"""File sources and sinks: whole texts, CSV with byte-order marks, JSON and JSON-lines logs, resumable outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header, quoted line breaks and doubled quotes; a byte-order mark before the first name is no part of it."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', quote='"', enforceSchema=True)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False) -> None:
    """CSV with header in the given column order; one file only on request, for small reports."""
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def read_log(spark: SparkSession, path: str, schema: StructType | str, key: str, order: str) -> DataFrame:
    """JSON lines, the last one of a key wins by ``order``."""
    rows = spark.read.json(path, schema=schema)
    return last_wins(rows, [key], [order])


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def to_markdown(df: DataFrame, limit: int = 1000) -> str:
    """Small report as a table; refuses more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return head + "".join("\n| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)


def fingerprint(*parts: Column) -> Column:
    """First ten hex digits of the SHA-1 of joined columns, to tell stale results."""
    return F.substring(F.sha1(F.concat(*parts)), 1, 10)


def todo(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is not done yet; null keys count as undone."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def still_valid(done: DataFrame, wanted: DataFrame, key: list[str], group: list[str], expected: int, error: str | None = None) -> DataFrame:
    """Results of complete groups only: keys still wanted, at least ``expected`` rows in the group, none with an error."""
    kept = done.join(wanted.select(*key).distinct(), key, "left_semi")
    bad = F.lit(0) if error is None else F.max(F.col(error).isNotNull().cast("int"))
    full = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), bad.alias("_bad")).where((F.col("_n") >= expected) & (F.col("_bad") == 0))
    return kept.join(full.select(*group), group, "left_semi")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def row_slice(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows start..stop-1 of an order, as a dataset slice."""
    from folio.operators.corpus import with_row_number

    return with_row_number(df, order).where((F.col("_rn") >= start) & (F.col("_rn") < stop)).drop("_rn")
