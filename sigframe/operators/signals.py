"""Operators on blocks of samples: arrays handled by higher-order functions, filters and spectra by NumPy kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions import dsp


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def array_mean(a: Column) -> Column:
    """Mean of an array of samples, null for an empty one."""
    return F.try_divide(array_sum(a), F.size(a))


def array_std(a: Column) -> Column:
    """Population standard deviation of an array of samples."""
    m = array_mean(a)
    return F.sqrt(F.try_divide(F.aggregate(a, F.struct(F.lit(0.0).alias("s"), m.alias("m")), lambda s, x: F.struct((s["s"] + (x - s["m"]) * (x - s["m"])).alias("s"), s["m"].alias("m")), lambda s: s["s"]), F.size(a)))


def zscore(df: DataFrame, by: list[str], value: str, out: str, skip: Column | None = None) -> DataFrame:
    """``df`` with the standard score of ``value`` within ``by``; constant groups give 0, skipped rows stay as they are.

    Moments are pre-aggregated per group and joined back, so a group may hold any share of the rows. A group
    counts as constant if its deviation is not above the rounding error of its largest value.
    """
    kept = df if skip is None else df.where(~skip)
    stats = kept.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.max(F.abs(F.col(value))).alias("_a"))
    flat = F.col("_s") <= F.lit(float(np.finfo(float).eps)) * F.greatest(F.lit(1.0), F.col("_a"))
    score = F.when(flat, 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))
    if skip is not None:
        score = F.when(skip, F.col(value)).otherwise(score)
    return df.join(stats, by, "left").withColumn(out, score).drop("_m", "_s", "_a")


def require_finite(df: DataFrame, channel: str, value: str) -> DataFrame:
    """``df`` as it is; ValueError that names the first channel with a value that is absent, NaN or infinite. One aggregation."""
    bad = F.col(value).isNull() | F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf"))
    first = df.where(bad).agg(F.min(channel)).first()[0]
    if first is not None:
        raise ValueError(f"Non-finite samples in channel {first!r}")
    return df


def require_same_channels(df: DataFrame, domain: str, rec: str, channel: str) -> DataFrame:
    """``df`` as it is; ValueError that names a domain whose recordings differ in their channels. Works on distinct channels alone."""
    sets = df.select(domain, rec, channel).distinct().groupBy(domain, rec).agg(F.array_join(F.array_sort(F.collect_list(F.col(channel).cast("string"))), "\x1f").alias("_c"))
    mixed = sets.groupBy(domain).agg(F.min("_c").alias("_a"), F.max("_c").alias("_b")).where("_a <> _b").agg(F.min(F.coalesce(F.col(domain).cast("string"), F.lit("null")))).first()[0]
    if mixed is not None:
        raise ValueError(f"recordings of domain {mixed!r} differ in their channels")
    return df


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, std): count, mean and population standard deviation per group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def domain_moments(stats: DataFrame, domain: str, keys: list[str]) -> DataFrame:
    """Unweighted means of the recordings' means and deviations per domain."""
    return stats.groupBy(domain, *keys).agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.count(F.lit(1)).alias("recordings"))


def infer_unit(mean_abs: Column) -> Column:
    """Unit of samples by their mean magnitude: above 1 uV, above 0.001 mV, else V."""
    return F.when(mean_abs > 1, "uV").when(mean_abs > 0.001, "mV").otherwise("V")


def unit_factor(unit: Column, target: str) -> Column:
    """The factor from ``unit`` to ``target``, null for an unknown unit."""
    scale = {"V": 1.0, "mV": 1e-3, "uV": 1e-6, "nV": 1e-9}
    out = F.lit(None).cast("double")
    for u, s in scale.items():
        out = F.when(unit == u, F.lit(s / scale[target])).otherwise(out)
    return out


def nearest_resample(samples: Column, n_new: int) -> Column:
    """``n_new`` samples by nearest neighbour on an even grid over the array, ties to the even index."""
    step = (F.size(samples) - 1) / F.lit(float(max(n_new - 1, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n_new - 1)), lambda i: F.element_at(samples, (F.rint(i * step) + 1).cast("int")))


def mapped_rows(df: DataFrame, samples: str, fn, element: str = "double", sfreq: str | None = None) -> DataFrame:
    """``df`` with ``fn(matrix of equally long rows)`` applied to the arrays of ``samples`` by Arrow batches.

    Rows are grouped by length within a batch; null and empty arrays stay as they are. With ``sfreq``, a column of
    rates, rows are grouped by rate too and ``fn(matrix, rate)`` is called; rows without a positive rate become
    null, as do those for which it returns None.
    """

    def grouped(s: pd.Series, rate: pd.Series | None) -> pd.Series:
        out: list = [None] * len(s)
        groups: dict[tuple, list[int]] = {}
        for i, a in enumerate(s):
            if a is not None and (rate is None or rate.iloc[i] > 0):
                groups.setdefault((len(a), None if rate is None else float(rate.iloc[i])), []).append(i)
        for (n, fs), rows in groups.items():
            x = np.array([np.asarray(s.iloc[i], dtype=float) for i in rows]) if n else np.zeros((len(rows), 0))
            y = x if not n else fn(x) if fs is None else fn(x, fs)
            for i, v in zip(rows, [None] * len(rows) if y is None else y, strict=True):
                out[i] = v
        return pd.Series(out)

    @F.pandas_udf(f"array<{element}>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield grouped(s, None)

    @F.pandas_udf(f"array<{element}>")
    def run_rated(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, rate in it:
            yield grouped(s, rate)

    return df.withColumn(samples, run(F.col(samples)) if sfreq is None else run_rated(F.col(samples), F.col(sfreq).cast("double")))


def fir(df: DataFrame, rec: list[str], order: list[str], value: str, taps: list[float], out: str) -> DataFrame:
    """Centred FIR filter of an odd number of taps over rows of a recording; rows without full surroundings are null."""
    if len(taps) % 2 == 0:
        raise ValueError("an odd number of taps")
    half = len(taps) // 2
    w = Window.partitionBy(*rec).orderBy(*order)
    total = None
    for k, t in enumerate(taps):
        term = (F.lag(value, half - k) if k <= half else F.lead(value, k - half)).over(w) * F.lit(float(t))
        total = term if total is None else total + term
    return df.withColumn(out, total)


def filter_blocks(df: DataFrame, keys: list[str], kind: str, sfreq: float | str, *, l_freq: float | None = None, h_freq: float | None = None, notch: float | None = None, order: int = 4, reach: int = 1) -> DataFrame:
    """Filtered signals of rows (keys, block, samples), blocks of one channel handled with their neighbours.

    ``kind`` is lowpass, highpass, bandpass (FIR, zero phase), notch, or butter (Butterworth band-pass, forward and
    backward). FIR kinds read half a filter of each neighbouring block, so that the
    result does not depend on the size of the blocks; the Butterworth filter reads both neighbours, in which its
    transients die out. Blocks of a channel are numbered by ``block``; null and empty ones become null.
    ``sfreq`` is a rate or the name of a column of rates; a row whose rate is missing or too low for the band becomes null.
    ``reach`` is the number of neighbouring blocks read on each side; that many have to hold half a filter. With 0 each block is a signal
    of its own, and nothing is shuffled.
    """
    if kind not in ("lowpass", "highpass", "bandpass", "notch", "butter"):
        raise ValueError(kind)
    if kind == "notch" and not notch:
        raise ValueError("notch needs a frequency")
    w = Window.partitionBy(*keys).orderBy("block")
    empty = F.array().cast("array<double>")
    beside = lambda a, b: F.flatten(F.collect_list(F.coalesce("samples", empty)).over(w.rowsBetween(a, b))) if reach else empty
    around = df.withColumns({"_before": beside(-reach, -1), "_after": beside(1, reach)})

    def kernel_of(fs: float):
        h = h_freq if h_freq is None or h_freq < fs / 2 else fs / 2 - 1
        if kind == "butter":
            return lambda b, m, a: dsp.butter_bandpass_filter(np.concatenate([b, m, a], axis=1), l_freq, h, fs, order)[:, b.shape[1] : b.shape[1] + m.shape[1]]
        taps = dsp.firwin(kind, fs, l_freq=l_freq, h_freq=h, notch=notch)
        half = len(taps) // 2
        return lambda b, m, a: [dsp.fir_with_halo(x, y, z, taps, half) for x, y, z in zip(b, m, a, strict=True)]

    def holds(fs: float) -> bool:
        top = max(f for f in (l_freq, notch, 0.0) if f is not None)
        return fs > 0 and top < (fs / 2 if h_freq is None or h_freq < fs / 2 else fs / 2 - 1)

    by_column = isinstance(sfreq, str)

    @F.pandas_udf("array<double>")
    def run(before: pd.Series, mid: pd.Series, after: pd.Series, rate: pd.Series) -> pd.Series:
        out: list = [None] * len(mid)
        groups: dict[tuple, list[int]] = {}
        for i, (b, m, a, fs) in enumerate(zip(before, mid, after, rate, strict=True)):
            if m is not None and len(m) and (holds(fs) or not by_column):
                groups.setdefault((float(fs), len(b), len(m), len(a)), []).append(i)
        for (fs, *shape), rows in groups.items():
            parts = [np.array([np.asarray(s.iloc[i], float) for i in rows]).reshape(len(rows), n) for s, n in zip((before, mid, after), shape, strict=True)]
            for i, v in zip(rows, kernel_of(fs)(*parts), strict=True):
                out[i] = v
        return pd.Series(out)

    fs = F.col(sfreq).cast("double") if by_column else F.lit(float(sfreq))
    return around.withColumn("samples", run("_before", "samples", "_after", fs)).drop("_before", "_after")


def welch(df: DataFrame, samples: str, sfreq: float | str, nperseg: int = 1024, unified: float | None = None) -> DataFrame:
    """``df`` with the power spectral density of ``samples`` (Hann windows, half overlap) in their place.

    ``sfreq`` is a rate or the name of a column of rates. With ``unified``, signals are brought to that rate first and
    all spectra have the bins of ``nperseg`` samples of it, so that bins of different rates can be averaged.
    """
    if not isinstance(sfreq, str):
        return mapped_rows(df, samples, lambda x: dsp.welch(x, sfreq, nperseg)[1])

    def kernel(x: np.ndarray, fs: float) -> np.ndarray:
        if unified is None:
            return dsp.welch(x, fs, nperseg)[1]
        n = max(1, round(x.shape[-1] * unified / fs))
        return dsp.welch(x if n == x.shape[-1] else dsp.resample(x, n), unified, nperseg, nfft=nperseg)[1]

    return mapped_rows(df, samples, kernel, sfreq=sfreq)


#: Samples of recordings that a kernel is given at a time; a longer recording comes alone.
_TOGETHER = 1 << 20


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions of the rows that differ in a key from the row before, the first one included; nulls are alike, and so are NaNs."""
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        new[1:] = False
        for k in keys:
            c = rows[k].combine_chunks()
            a, b = c[:-1], c[1:]
            if pa.types.is_nested(c.type):
                held = c.to_pylist()
                new[1:] |= np.array([x != y for x, y in zip(held, held[1:], strict=False)])
                continue
            differ = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
            if pa.types.is_floating(c.type):
                differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _by_recording(df: DataFrame, keys: list[str], columns: str, kernel) -> DataFrame:
    """(keys, columns): what ``kernel(channels, x)`` gives for the recordings of rows (keys, ch, samples), many at a time.

    ``x`` holds recordings with the same channels and length as (recordings, channels, samples). The kernel yields (positions of recordings,
    their number of rows each, values of the columns in order); samples come as a matrix with a row each. One shuffle; rows of a
    partition are read in order of their recordings, so that a task holds an Arrow batch and the recording at its end.
    """
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + columns
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[c.split()[1]] for c in columns.split(", ")]

    def arrow(v: np.ndarray, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_list(kind):
            return pa.array(v, kind)
        n, width = v.shape
        return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32), np.ascontiguousarray(v).reshape(-1))

    def whole(rows: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Results of the recordings that begin at ``start`` and fill ``rows``."""
        size = np.diff(np.append(start, rows.num_rows))
        held = rows["samples"].combine_chunks()
        length = pc.fill_null(pc.list_value_length(held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (length != np.repeat(length[start], size)).any() or (length < 0).any():
            raise ValueError("channels of a recording differ in their length")
        flat = held.flatten().to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum(length)])
        ch = rows["ch"].to_numpy()
        groups: dict[tuple, list[int]] = {}
        for i, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
            groups.setdefault((length[a], ch[a : a + n].tobytes()), []).append(i)
        for (n, _), which in groups.items():
            first, c = start[which], int(size[which[0]])
            some = max(1, _TOGETHER // max(1, int(n) * c))
            for i in range(0, len(first), some):
                at = first[i : i + some]
                x = flat[begin[at][:, None] + np.arange(c * n)].reshape(len(at), c, n).astype(float, copy=False)
                for found, each, values in kernel(ch[at[0] : at[0] + c].tolist(), x):
                    row = pa.array(np.repeat(at[found], each))
                    yield pa.RecordBatch.from_arrays([*(rows[k].combine_chunks().take(row) for k in keys), *map(arrow, values, kinds)], [*keys, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if b.num_rows == 0 or (len(held) > 1 and len(_starts(pa.Table.from_batches([held[0].slice(0, 1), b.slice(0, 1), b.slice(b.num_rows - 1)]), keys)) == 1):
                continue  # the recording goes on
            rows = pa.Table.from_batches(held)
            start = _starts(rows, keys)
            yield from whole(rows.slice(0, start[-1]), start[:-1]) if len(start) > 1 else ()
            held = rows.slice(start[-1]).to_batches()
        if sum(b.num_rows for b in held):
            rows = pa.Table.from_batches(held)
            yield from whole(rows, _starts(rows, keys))

    return df.select(*keys, "ch", "samples").repartition(*keys).sortWithinPartitions(*keys, "ch").mapInArrow(run, schema)


def ica(df: DataFrame, keys: list[str], n_components: int | None = None, seed: int = 0) -> DataFrame:
    """Independent components of each recording of rows (keys, ch, samples): (keys, component, samples).

    A recording's channels by samples matrix is the unit of the method and has to fit in one task; recordings are
    bounded by their length, not by the size of the collection. Short ones are handled many at a time, with the same result.
    """

    def kernel(ch: list, x: np.ndarray) -> Iterator[tuple]:
        for at, s in dsp.fast_ica_many(x, n_components, seed):
            yield at, s.shape[1], (np.tile(np.arange(s.shape[1]), len(at)), s.reshape(-1, x.shape[2]))

    return _by_recording(df, keys, "component int, samples array<double>", kernel)


def resample(df: DataFrame, samples: str, sfreq: str, target: float) -> DataFrame:
    """``df`` with ``samples`` at the rate ``target`` by the Fourier method, from the rates of the column ``sfreq``.

    A row has round(length * target / rate) samples then, one at least; rows of one length and rate are handled together. Rows
    without a positive rate become null, null and empty arrays stay as they are. The operator adds no shuffle.
    """
    if not target > 0:
        raise ValueError("a positive rate")

    def kernel(x: np.ndarray, fs: float) -> np.ndarray:
        n = max(1, round(x.shape[-1] * target / fs))
        return x if n == x.shape[-1] else dsp.resample(x, n)

    return mapped_rows(df, samples, kernel, sfreq=sfreq)


def dominant_frequency(df: DataFrame, samples: str, sfreq: str, out: str = "frequency") -> DataFrame:
    """``df`` with the frequency of the largest Fourier amplitude of ``samples`` without their mean, 0 for constant signals.

    Null, empty and unrated signals have none. The operator adds no shuffle.
    """

    def kernel(x: np.ndarray, fs: float) -> np.ndarray:
        flat = np.ptp(x, axis=1) == 0
        return np.where(flat, 0.0, dsp.dominant_frequency(x, fs))[:, None]

    return mapped_rows(df.withColumn(out, F.col(samples).cast("array<double>")), out, kernel, sfreq=sfreq).withColumn(out, F.get(out, F.lit(0)))


def _artefacts(x: np.ndarray, s: np.ndarray, like: list[int], limit: float, kurtosis: float) -> np.ndarray:
    """Components of each recording that go with one of the channels at ``like``, or whose excess kurtosis is beyond ``kurtosis``."""
    bad = dsp.excess_kurtosis(s) > kurtosis
    for c in like:
        d = (x[:, c] - x[:, c].mean(axis=1, keepdims=True))[:, :, None]
        r = np.abs(s @ d)[:, :, 0] / np.maximum(np.linalg.norm(s, axis=2) * np.linalg.norm(d, axis=1), 1e-300)
        bad |= (r > limit) & d.any(axis=1)
    return bad


def ica_apply(df: DataFrame, keys: list[str], *, like: list[int] | None = None, limit: float = 0.7, kurtosis: float = float("inf"), n_components: int | None = None, seed: int = 0, deviation: bool = False) -> DataFrame:
    """Signals (keys, ch, samples, removed) of each recording without its artefact components.

    Components that correlate by more than ``limit`` with one of the channels ``like`` (eyes, heart, muscles), or whose excess kurtosis is above
    ``kurtosis``, are taken out of every other channel; ``removed`` is their number. A recording has to fit in one task, as for ``ica``.
    With ``deviation``, the column std, the standard deviation of the cleaned signal, stands in the place of samples.
    """

    def kernel(ch: list, x: np.ndarray) -> Iterator[tuple]:
        marks = [ch.index(c) for c in like or [] if c in ch]
        for at, s in dsp.fast_ica_many(x, n_components, seed):
            y = x[at]
            bad = _artefacts(y, s, marks, limit, kurtosis)
            some = np.flatnonzero(bad.any(axis=1))
            out = s[some] * bad[some, :, None]
            clean = y.copy()
            clean[some] -= dsp.mixing(y[some], out) @ out
            clean[:, marks] = y[:, marks]
            left = clean.std(axis=2).ravel() if deviation else clean.reshape(-1, x.shape[2])
            yield at, len(ch), (np.tile(ch, len(at)), left, np.repeat(bad.sum(axis=1), len(ch)))

    return _by_recording(df, keys, f"ch int, {'std double' if deviation else 'samples array<double>'}, removed int", kernel)


def ica_quality(df: DataFrame, keys: list[str], types: dict[int, str], *, limit: float = 0.7, seed: int = 0) -> DataFrame:
    """(keys, score, n_eog, n_emg, n_ecg): the share of components that are no artefacts, and how many go with channels of each type.

    ``types`` gives the type of a channel by its number. Recordings of constant channels have no components and a null score.
    """

    def kernel(ch: list, x: np.ndarray) -> Iterator[tuple]:
        kinds = [types.get(c) for c in ch]
        for at, s in dsp.fast_ica_many(x, None, seed):
            found = [_artefacts(x[at], s, [i for i, k in enumerate(kinds) if k == t], limit, float("inf")) for t in ("eog", "emg", "ecg")]
            score = 1 - np.any(found, axis=0).mean(axis=1) if s.shape[1] else [None] * len(at)
            yield at, 1, (score, *(f.sum(axis=1) for f in found))

    return _by_recording(df, keys, "score double, n_eog int, n_emg int, n_ecg int", kernel)


def recording_correlation(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, a, b, r): Pearson correlation of every pair of channel columns within each recording, null where one is constant.

    Pairs with an absent or non-finite value are left out, for that pair alone. One aggregation with map-side combination.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = fine(a) & fine(b)
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"_{i}"))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def channel_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of channel columns in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
