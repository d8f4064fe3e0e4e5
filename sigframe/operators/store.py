"""The epoch store: a star schema of parquet tables, its reader, exports and the cutting into parts.

Tables: epochs (fact), sources, channels, channel_masks, event_labels. A store is written beside
its place and renamed when it is complete, with a marker that the reader asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("epochs", "sources", "channels", "channel_masks", "event_labels")
MARKER = "_COMPLETE"


def normal_path(path: Column) -> Column:
    """A path with forward slashes, no doubled ones, no ``/./`` and no slash at the end."""
    p = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(/\.)+(/|$)", "/"), "(.)/$", "$1")


def source_uid(path: Column, name: Column) -> Column:
    """SHA-256 of the normal path, or of ``unresolved:<name>`` where there is no path."""
    return F.sha2(F.when(F.length(F.trim(path)) > 0, normal_path(path)).otherwise(F.concat(F.lit("unresolved:"), F.coalesce(name, F.lit("")))), 256)


def coded(df: DataFrame, value: str, order: str, code: str) -> DataFrame:
    """(value, code): distinct values numbered from 0 in order of first use."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    return first.select(value, (F.row_number().over(Window.orderBy("_first", value)) - 1).cast("int").alias(code))


def epoch_indices(df: DataFrame, source: str, order: str, out: str = "source_epoch_index", width: int = 100_000) -> DataFrame:
    """``df`` with the running number of each epoch within its source, from 0, by the whole number ``order``.

    Numbers are given within stretches of ``width`` order values and moved by the count of all
    earlier stretches, so that a source with any share of the rows spreads over tasks.
    """
    stretched = df.withColumn("_stretch", F.expr(f"`{order}` div {width}"))
    counts = stretched.groupBy(source, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(source).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(source, "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(source, "_stretch").orderBy(order)
    numbered = stretched.withColumn("_r", F.row_number().over(within) - 1)
    return numbered.join(offsets, [source, "_stretch"]).withColumn(out, (F.col("_before") + F.col("_r")).cast("int")).drop("_stretch", "_r", "_before")


def valid_epochs(df: DataFrame, data: str = "epoch_data") -> Column:
    """True for rank-3 data that a store accepts: not empty, all finite, not all zero, channels of one length."""
    d = F.col(data)
    bad = F.exists(d, lambda c: c.isNull() | F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    some = F.exists(d, lambda c: F.exists(c, lambda x: x != 0))
    even = F.size(F.array_distinct(F.transform(d, F.size))) == 1
    return F.coalesce(d.isNotNull() & (F.size(d) > 0) & ~bad & some & even, F.lit(False))


def window(data: Column, channels: list[int], start: int, length: int) -> Column:
    """Samples ``start`` .. ``start + length`` of the given channels, in the order asked for."""
    return F.transform(F.array(*[F.lit(c) for c in channels]), lambda c: F.slice(F.get(data, c), start + 1, length))


def greedy_parts(sizes: DataFrame, key: str, size: str, limit: int, lanes: int = 1) -> DataFrame:
    """(key, size, part): consecutive items by ``key`` filled into parts of at most ``limit``; a larger item has its own.

    Filling in order is sequential, so each lane is one sorted stream of which only the running sum is held; the sort
    spills. With several ``lanes`` (column ``lane``) items are dealt by a hash of their key and parts never cross a lane.
    Null sizes count as 0; repeated keys are items of their own.
    """
    kind = sizes.schema[key].dataType.simpleString()
    lane = F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int") if lanes > 1 else F.lit(0)
    items = sizes.select(lane.alias("lane"), F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("s"))
    ordered = items.repartitionByRange(lanes, "lane").sortWithinPartitions("lane", "k", "s")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, part = None, 0, -1
        for pdf in batches:
            parts = []
            for at, s in zip(pdf["lane"].tolist(), pdf["s"].tolist(), strict=True):
                if at != current:
                    current, used, part = at, 0, -1
                if part < 0 or used + s > limit:
                    used, part = 0, part + 1
                used += s
                parts.append(part)
            yield pdf.assign(part=parts).astype({"part": "int32"})

    out = ordered.mapInPandas(fill, f"lane int, k {kind}, s bigint, part int").withColumnsRenamed({"k": key, "s": size})
    return out.drop("lane") if lanes == 1 else out


def check_epochs(epochs: DataFrame, data: str = "epoch_data") -> None:
    """ValueError for samples that are absent or not finite, for a source whose epochs of one event are zero throughout, and for differing shapes.

    One aggregation over the epochs, with map-side combination; the message names a source.
    """
    d = F.col(data)
    bad = d.isNull() | F.exists(d, lambda c: c.isNull() | F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    some = F.coalesce(F.exists(d, lambda c: F.exists(c, lambda x: x != 0)), F.lit(False))
    shape = F.concat_ws("x", F.size(d).cast("string"), F.array_join(F.array_sort(F.array_distinct(F.transform(d, lambda c: F.size(c).cast("string")))), "/"))
    groups = epochs.groupBy("source_id", "event_code").agg(F.max(F.coalesce(bad, F.lit(True))).alias("bad"), F.max(some).alias("some"), F.min(shape).alias("lo"), F.max(shape).alias("hi"))
    found = groups.agg(
        F.min(F.when(F.col("bad"), F.col("source_id"))).alias("bad"), F.min(F.when(~F.col("bad") & ~F.col("some"), F.col("source_id"))).alias("zero"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"),
    ).first()
    if found["bad"] is not None:
        raise ValueError(f"Non-finite samples in source {found['bad']}")
    if found["zero"] is not None:
        raise ValueError(f"All-zero epochs in source {found['zero']}")
    if found["n"] and (found["lo"] != found["hi"] or "/" in found["lo"]):
        raise ValueError(f"Epoch shapes differ: {found['lo']} and {found['hi']}")


def write_store(tables: dict[str, DataFrame], folder: str, *, overwrite: bool = False, validate: bool = True) -> None:
    """Write all tables of a store and publish them at once; tables beyond those of a store are written beside them.

    FileExistsError if the folder is there and not to be overwritten, ValueError for a missing table and, unless ``validate`` is False, for
    epochs that ``check_epochs`` refuses, RuntimeError for epochs without rows. After an error nothing is left at the place.
    """
    spark = next(iter(tables.values())).sparkSession
    missing = set(TABLES) - set(tables)
    if missing:
        raise ValueError(f"missing tables: {sorted(missing)}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path) and not overwrite:
        raise FileExistsError(folder)
    building = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "._building")
    fs.delete(building, True)
    try:
        for name in (*TABLES, *sorted(set(tables) - set(TABLES))):
            tables[name].write.parquet(f"{building.toString()}/{name}")
        written = spark.read.parquet(f"{building.toString()}/epochs")
        if written.isEmpty():
            raise RuntimeError("no epochs to save")
        if validate:
            check_epochs(written)
    except Exception:
        fs.delete(building, True)
        raise
    fs.create(jvm.org.apache.hadoop.fs.Path(building, MARKER)).close()
    if fs.exists(path):
        fs.delete(path, True)
    fs.rename(building, path)


class EpochStore:
    """Reader of a store; ValueError if it is not complete."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder, MARKER)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise ValueError(f"{folder} is not a complete store")
        self.tables = {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES}

    def read_epochs(self, epochs: list[int], channels: list[str], start: int = 0, stop: int | None = None) -> DataFrame:
        """(epoch_id, data) of the given epochs, channels in the order asked for; KeyError for an unknown channel."""
        at = {r["name"]: r["ordinal"] for r in self.tables["channels"].collect()}
        unknown = [c for c in channels if c not in at]
        if unknown:
            raise KeyError(unknown[0])
        rows = self.tables["epochs"].where(F.col("epoch_id").isin(*epochs))
        length = (stop if stop is not None else 2**31 - 1 - start) - start
        return rows.select("epoch_id", window(F.col("epoch_data"), [at[c] for c in channels], start, length).alias("data"))

    def source_of(self, epoch_id: int) -> DataFrame:
        """The source row of an epoch."""
        one = self.tables["epochs"].where(F.col("epoch_id") == epoch_id).select("source_id")
        return self.tables["sources"].join(one, "source_id", "left_semi")


def denormalised(epochs: DataFrame, sources: DataFrame, labels: DataFrame) -> DataFrame:
    """Epochs with the path and name of their source and the name of their event beside them."""
    s = sources.select("source_id", F.coalesce("file_path", F.concat(F.lit("unresolved:"), F.col("name"))).alias("source"))
    names = labels.select(F.col("code").alias("event_code"), F.col("name").alias("event_name"))
    return epochs.join(s, "source_id", "left").join(names, "event_code", "left")


def wide_export(epochs: DataFrame, rec: str, data: str, channels: list[str], marker: str | None = None, value=lambda x: x) -> DataFrame:
    """One row (rec, sample, a column per channel, marker) per sample of each row's ``data``, an array of samples for each channel.

    The channels are zipped within their row, so nothing is shuffled; ``marker`` is a column whose value stands at the first sample. Shorter
    channels are filled with null; rows of null or empty data give none. ``value`` is applied to each sample.
    """
    parts = [F.get(data, F.lit(i)).alias(f"_{i}") for i in range(len(channels))]
    zipped = F.posexplode(F.arrays_zip(*[F.col(f"_{i}") for i in range(len(channels))])).alias("sample", "_z")
    keep = [rec, *([marker] if marker else [])]
    long = epochs.select(*keep, *[F.coalesce(p, F.array().cast(epochs.schema[data].dataType.elementType)).alias(f"_{i}") for i, p in enumerate(parts)]).select(*keep, zipped)
    out = [F.col(rec), F.col("sample").cast("bigint").alias("sample"), *[value(F.col("_z")[f"_{i}"]).alias(c) for i, c in enumerate(channels)]]
    return long.select(*out, *([F.when(F.col("sample") == 0, F.col(marker)).alias("marker")] if marker else []))
