"""From signals to stored epochs: windows by segment, event and long event, their data, the tables of a store, exports by recording.

Signals are rows (rec_id, ch, block, start, samples): blocks of each channel of a recording, ``start`` counting its samples. Windows are rows
(rec_id, start, length, name). No recording has to fit in a task: a window takes from each block the samples that lie in it.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.operators import store
from sigframe.operators.events import long_event_segments, segment_starts


def blocks_of(samples: DataFrame, size: int, rec: str = "rec_id", order: str = "sample", value: str = "value", ch: int = 0) -> DataFrame:
    """Signals of one channel from rows of samples numbered from 0."""
    b = samples.select(F.col(rec).alias("rec_id"), F.expr(f"`{order}` div {size}").cast("int").alias("block"), F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")).alias("x"))
    one = b.groupBy("rec_id", "block").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return one.select("rec_id", F.lit(ch).alias("ch"), "block", (F.col("block").cast("bigint") * size).alias("start"), F.col("x.v").alias("samples"))


def segment_windows(recordings: DataFrame, seconds: float, overlap: float) -> DataFrame:
    """Windows of ``seconds`` with the share ``overlap``, over recordings (rec_id, n_samples, sfreq); a recording without a rate has none."""
    if seconds is None or overlap is None or seconds <= 0 or not 0 <= overlap < 1:
        raise ValueError("segments need a positive length and an overlap within [0, 1)")
    width = F.round(F.col("sfreq") * seconds).cast("bigint")
    step = F.round(F.col("sfreq") * seconds * (1 - overlap)).cast("bigint")
    rows = recordings.select("rec_id", F.col("n_samples").cast("bigint").alias("_n"), width.alias("length"), step.alias("_s")).where("length > 0 and _s > 0 and _n >= length")
    return rows.select("rec_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - F.col("length"), F.col("_s"))).alias("start"), "length", F.lit("Segment").alias("name"))


def event_windows(events: DataFrame, before: int, after: int, names: list[str] | None = None, repeated: str = "keep") -> DataFrame:
    """Windows from ``before`` samples before to ``after`` after each event (rec_id, sample, name).

    ``repeated`` tells what becomes of several events at one sample: 'keep' all, 'drop' all but the first name, 'merge' their names by ``/``,
    'error' for a ValueError.
    """
    e = events.select("rec_id", F.col("sample").cast("bigint").alias("sample"), "name").where("sample is not null and name is not null")
    e = e if names is None else e.where(F.col("name").isin(*names))
    if repeated == "error":
        if not e.groupBy("rec_id", "sample").count().where("count > 1").isEmpty():
            raise ValueError("several events at one sample")
    elif repeated == "drop":
        e = e.groupBy("rec_id", "sample").agg(F.min("name").alias("name"))
    elif repeated == "merge":
        e = e.groupBy("rec_id", "sample").agg(F.array_join(F.array_sort(F.collect_set("name")), "/").alias("name"))
    elif repeated != "keep":
        raise ValueError(repeated)
    return e.select("rec_id", (F.col("sample") - before).alias("start"), F.lit(before + after + 1).cast("bigint").alias("length"), "name")


def long_event_windows(annotations: DataFrame, width: int, overlap: float) -> DataFrame:
    """Windows of ``width`` samples within annotations (rec_id, first, length, description)."""
    segment_starts(F.lit(1), width, overlap)
    w = long_event_segments(annotations, width, overlap)
    return w.select("rec_id", F.col("start").cast("bigint").alias("start"), F.lit(width).cast("bigint").alias("length"), F.col("description").alias("name"))


def windows_for(kind: str, **parameters) -> DataFrame:
    """Windows by 'segment', 'event' or 'long_event', with the parameters of the function for it."""
    if kind == "long_event" and parameters.get("overlap") is None:
        raise ValueError("long events need an overlap")
    makers = {"segment": segment_windows, "event": event_windows, "long_event": long_event_windows}
    if kind not in makers:
        raise ValueError(kind)
    return makers[kind](**parameters)


def cut_epochs(signals: DataFrame, windows: DataFrame, size: int, *, baseline: tuple[int, int] | None = None) -> DataFrame:
    """(rec_id, start, name, epoch_data): the samples of each window, a row of floats per channel in order of ``ch``.

    ``size`` is the number of samples of a block. Windows that a recording does not wholly hold, in all its channels, are left out; windows that occur twice
    give two epochs. With ``baseline`` (first, last sample of the window, both included) its mean is taken from each channel.
    """
    w = windows.withColumn("_w", F.monotonically_increasing_id()).where("start >= 0 and length > 0")
    spread = w.withColumn("block", F.explode(F.sequence(F.expr(f"int(start div {size})"), F.expr(f"int((start + length - 1) div {size})"))))
    s = signals.select("rec_id", "ch", "block", F.col("start").alias("_b"), F.col("samples").alias("_x"))
    first = F.greatest(F.col("start") - F.col("_b"), F.lit(0)).cast("int")
    last = F.least(F.col("start") + F.col("length") - F.col("_b"), F.size("_x").cast("bigint")).cast("int")
    piece = spread.join(s, ["rec_id", "block"]).select("_w", "rec_id", "start", "length", "name", "ch", "_b", F.when(last > first, F.slice("_x", first + 1, last - first)).otherwise(F.array().cast("array<double>")).alias("_x"))
    parts = F.sort_array(F.collect_list(F.struct("_b", "_x")))
    one = piece.groupBy("_w", "rec_id", "start", "length", "name", "ch").agg(F.flatten(F.transform(parts, lambda p: p["_x"])).alias("_x"))
    if baseline is not None:
        mean = F.aggregate(F.slice("_x", baseline[0] + 1, baseline[1] - baseline[0] + 1), F.lit(0.0), lambda a, x: a + x) / (baseline[1] - baseline[0] + 1)
        one = one.withColumn("_m", mean).withColumn("_x", F.transform("_x", lambda x: x - F.col("_m")))
    whole = one.groupBy("_w", "rec_id", "start", "length", "name").agg(F.sort_array(F.collect_list(F.struct("ch", "_x"))).alias("_c"), F.min(F.size("_x")).alias("_n"), F.count(F.lit(1)).alias("_k"))
    channels = signals.select("rec_id", "ch").distinct().groupBy("rec_id").agg(F.count(F.lit(1)).alias("_all"))
    held = whole.where("_n = length").join(channels, "rec_id").where("_k = _all")
    return held.select("rec_id", "start", "name", F.transform("_c", lambda c: c["_x"].cast("array<float>")).alias("epoch_data"))


def store_tables(epochs: DataFrame, recordings: DataFrame, channels: DataFrame, version: str = "2.3", *, drop_invalid: bool = False) -> dict[str, DataFrame]:
    """The tables of a store from epochs (rec_id, start, name, epoch_data) and recordings (rec_id, file_path, name, sfreq, mask, info).

    Sources are numbered in order of their uid, epochs in order of source, start and name, labels in order of their first epoch. ``channels`` is
    (ordinal, name, type). Columns ``meta`` and ``misc`` of epochs are kept. ``version`` '2' (and 2.0, 2.1) gives in addition the flat table ``epochs_flat``, with a
    FutureWarning; any other but '2.3' is a ValueError. With ``drop_invalid`` epochs that ``store.valid_epochs`` refuses are left out.
    """
    if drop_invalid:
        epochs = epochs.where(store.valid_epochs(epochs))
    version = str(version).lower().lstrip("v")
    if version in ("2", "2.0", "2.1"):
        warnings.warn("version 2 of the store is kept for old readers only", FutureWarning, stacklevel=2)
    elif version not in ("2.3", "23"):
        raise ValueError(f"unknown version {version!r}")
    used = epochs.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_epochs"))
    r = recordings.join(used, "rec_id").withColumn("uid", store.source_uid(F.col("file_path"), F.col("name")))
    in_order = Window.orderBy("uid", "rec_id")
    numbered = r.withColumn("source_id", (F.row_number().over(in_order) - 1).cast("int")).withColumn("_before", F.coalesce(F.sum("n_epochs").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    masks = store.coded(numbered.select("mask", "source_id"), "mask", "source_id", "mask_id")
    sources = numbered.join(masks.withColumnRenamed("mask_id", "channel_mask_id"), "mask", "left")
    e = epochs.join(numbered.select("rec_id", "source_id", "_before"), "rec_id")
    within = Window.partitionBy("source_id").orderBy("start", "name")
    e = e.withColumn("source_epoch_index", (F.row_number().over(within) - 1).cast("int")).withColumn("epoch_id", (F.col("_before") + F.col("source_epoch_index")).cast("bigint"))
    labels = store.coded(e.select("name", "epoch_id"), "name", "epoch_id", "code")
    empty = {"meta": "map<string,string>", "misc": "map<string,float>"}
    e = e.join(labels, "name").withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in e.columns})
    tables = {
        "epochs": e.select("epoch_id", "source_id", "source_epoch_index", F.col("start").alias("source_start_sample"), F.col("code").alias("event_code"), "epoch_data", "meta", "misc"),
        "sources": sources.select("source_id", "uid", "name", "file_path", "sfreq", "n_epochs", "channel_mask_id", "info"),
        "channels": channels.select("ordinal", "name", "type"),
        "channel_masks": masks.select("mask_id", "mask"),
        "event_labels": labels.select("code", "name"),
    }
    if version.startswith("2") and version not in ("2.3", "23"):
        tables["epochs_flat"] = store.denormalised(tables["epochs"], tables["sources"], tables["event_labels"])
    return tables


def export_npy(epochs: DataFrame, folder: str, name: str = "epoch_id", data: str = "epoch_data") -> DataFrame:
    """Write each epoch as ``<name>.npy`` of float32 (channels, samples) below ``folder`` and return (name, path, shape).

    Tasks write the epochs they hold, nothing is moved; a task that runs twice writes the same files. ``folder`` is a path or address that all executors
    reach. Epochs of null data or ragged channels give no file and a null path. The files are written when the result is read.
    """
    kind = epochs.schema[name].dataType.simpleString()

    def run(batches):
        import io

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for pdf in batches:
            out = []
            for key, d in pdf.itertuples(index=False):
                rows = None if d is None else [np.asarray(c, "float32") if c is not None else None for c in d]
                if not rows or any(c is None or len(c) != len(rows[0]) for c in rows):
                    out.append((key, None, None))
                    continue
                buffer = io.BytesIO()
                np.save(buffer, np.stack(rows))
                path = f"{root.rstrip('/')}/{key}.npy"
                with where.open_output_stream(path) as f:
                    f.write(buffer.getvalue())
                out.append((key, path, f"({len(rows)}, {len(rows[0])})"))
            yield pd.DataFrame(out, columns=["name", "path", "shape"])

    return epochs.select(name, data).mapInPandas(run, f"name {kind}, path string, shape string").withColumnRenamed("name", name)


def export_recordings(wide: DataFrame, catalogue: DataFrame, folder: str, kind: str = "csv", *, overwrite: bool = False) -> DataFrame:
    """Write each recording of ``wide`` (rec_id, sample, columns) to a folder of its own and return its new catalogue.

    The folder is called by the stem of the path; recordings of the same stem, and those that are there already, get a counter ``(1)``, ``(2)``, ...
    FileNotFoundError if ``folder`` does not exist. ``kind`` is csv or parquet. Recordings are written in order of their samples by
    range-partitioned tasks, so that a recording of any length may be several files of its folder. Recordings
    without samples are left out of the new catalogue, whose ``path`` and ``file_type`` are the new ones.
    """
    if kind not in ("csv", "parquet"):
        raise ValueError(kind)
    spark = wide.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        raise FileNotFoundError(folder)
    there = [] if overwrite else [s.getPath().getName().removeprefix("file=") for s in fs.listStatus(place) if s.isDirectory()]
    stem = F.coalesce(F.nullif(F.regexp_extract(F.translate("path", "\\", "/"), r"([^/]+?)(?:\.[A-Za-z0-9]+)?/*$", 1), F.lit("")), F.lit("recording"))
    plain = F.regexp_replace(stem, r"[^\w.-]+", "_")
    taken = spark.createDataFrame([(n,) for n in there], "file string").select(F.regexp_replace("file", r"\(\d+\)$", "").alias("_stem"), F.coalesce(F.regexp_extract("file", r"\((\d+)\)$", 1).try_cast("int"), F.lit(0)).alias("_c"))
    last = taken.groupBy("_stem").agg((F.max("_c") + 1).alias("_from"))
    held = catalogue.join(wide.select("rec_id").distinct(), "rec_id", "left_semi").withColumn("_stem", plain)
    counted = held.withColumn("_i", F.row_number().over(Window.partitionBy("_stem").orderBy("rec_id")) - 1).join(last, "_stem", "left")
    counter = F.col("_i") + F.coalesce("_from", F.lit(0))
    named = counted.withColumn("file", F.when(counter == 0, F.col("_stem")).otherwise(F.concat("_stem", F.lit("("), counter.cast("string"), F.lit(")")))).drop("_stem", "_i", "_from")
    rows = wide.join(named.select("rec_id", "file"), "rec_id").drop("rec_id")
    rows.repartitionByRange("file", "sample").sortWithinPartitions("file", "sample").write.mode("append").partitionBy("file").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(folder)
    new = F.concat(F.lit(folder.rstrip("/") + "/file="), F.col("file"))
    return named.withColumns({"path": new, "file_type": F.lit("csvData" if kind == "csv" else "parquet")}).drop("file")
