"""Hashes and sizes of files and data, and what follows from equal or different ones."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source_hash, file_size) of all files below a folder, SHA-256 of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("source_hash"), F.col("length").alias("file_size"))


def file_sizes(rows: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with ``file_size`` from a listing (path, file_size), -1 where the file is not in it."""
    return rows.drop("file_size").join(files.select(F.col("path").alias(path), "file_size"), path, "left").withColumn("file_size", F.coalesce("file_size", F.lit(-1).cast("bigint")))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows that share their non-null ``key`` with another row: counts are aggregated first, then joined back."""
    many = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return df.join(many, key)


def mismatches(a: DataFrame, b: DataFrame, on: str, key: str) -> DataFrame:
    """(on, a_key, b_key) of rows present on both sides whose ``key`` differs, nulls counting as values."""
    j = a.select(on, F.col(key).alias("a_key")).join(b.select(on, F.col(key).alias("b_key")), on)
    return j.where(~F.col("a_key").eqNullSafe(F.col("b_key")))


def block_starts(n: Column, fs: Column, seconds: float = 5.0) -> Column:
    """Start and length of the head, middle and tail blocks that stand for a signal of ``n`` samples.

    Blocks have ``seconds`` or a quarter of the signal, whichever is shorter, at least one sample; a signal
    shorter than three blocks is one block.
    """
    size = F.least(F.floor(fs * seconds), F.greatest(F.lit(1).cast("bigint"), F.floor(n / 4)))
    part = lambda a, k: F.struct(a.cast("bigint").alias("start"), k.cast("bigint").alias("length"))
    return F.when(n < 3 * size, F.array(part(F.lit(0), n))).otherwise(F.array(part(F.lit(0), size), part(F.floor((n - size) / 2), size), part(n - size, size)))


def data_hash(df: DataFrame, keys: list[str], fs: str, decimals: int = 6) -> DataFrame:
    """(keys, data_hash) of recordings of rows (keys, ch_name, fs, samples).

    The three blocks are cut on the JVM side first, so that a task receives only them; channels count
    in order of their names, values are rounded. Absent and NaN samples count as such and differ from
    each other and from any number. A recording that cannot be hashed has null.
    """
    n = F.size("samples").cast("bigint")
    cut = F.flatten(F.transform(block_starts(n, F.col(fs)), lambda b: F.slice(F.col("samples"), (b["start"] + 1).cast("int"), b["length"].cast("int"))))
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", data_hash string"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            rows = pdf.sort_values("ch_name")
            x = np.array([np.asarray(v, float) for v in rows["samples"]])
            absent = np.array([np.asarray(v, bool) for v in rows["absent"]])
            x = np.where(np.isnan(x), np.nan, np.round(x, decimals))
            digest = hashlib.sha256(np.ascontiguousarray(x).tobytes() + (absent.tobytes() if absent.any() else b"")).hexdigest()
        except (ValueError, TypeError):
            digest = None
        return pd.DataFrame([(*key, digest)], columns=[*keys, "data_hash"])

    held = df.select(*keys, "ch_name", cut.alias("samples")).withColumn("absent", F.transform("samples", lambda v: v.isNull()))
    return held.groupBy(*keys).applyInPandas(run, schema)


