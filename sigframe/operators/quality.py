"""Quality scores of signals from amplitudes, symmetry and band contents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions import dsp
from sigframe.operators.signals import mapped_rows


def amplitude_score(samples: Column) -> Column:
    """Percent of the samples within [-1000, 1000] that lie in [-100, 110), null if none is within."""
    within = F.size(F.filter(samples, lambda x: (x >= -1000) & (x <= 1000)))
    fine = F.size(F.filter(samples, lambda x: (x >= -100) & (x < 110)))
    return F.try_divide(100.0 * fine, within)


def energy_score(samples: Column) -> Column:
    """Percent of the summed magnitude that samples above 1 % of the largest magnitude hold."""
    top = F.aggregate(samples, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x).cast("double")))
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + F.abs(x).cast("double"))
    high = F.aggregate(samples, F.struct(F.lit(0.0).alias("s"), (top * 0.01).alias("t")), lambda s, x: F.struct((s["s"] + F.when(F.abs(x) > s["t"], F.abs(x).cast("double")).otherwise(0.0)).alias("s"), s["t"].alias("t")), lambda s: s["s"])
    return F.try_divide(100.0 * high, total)


def share_below(samples: Column, limit: float, magnitude: bool) -> Column:
    """Percent of the samples at most ``limit``, by magnitude or by value."""
    return F.try_divide(100.0 * F.size(F.filter(samples, lambda x: (F.abs(x) if magnitude else x) <= limit)), F.size(samples))


def rank_score(df: DataFrame, group: list[str], value: str, tie: str, cuts: int = 200) -> DataFrame:
    """``df`` with 1 for the upper half by ``value`` within the group, 0.5 for the next quarter, 0 for the rest.

    Equal values are ranked by ``tie``. Each group is cut into about ``cuts`` stretches of its values, which are ranked on their own and moved
    by the count of all higher ones. So a group with any share of the rows spreads over tasks, unless its
    values are all alike. Null values come last, null groups are one group.
    """
    v = F.col(value).cast("double")
    points = df.groupBy(*group).agg(F.percentile_approx(v, F.array(*[F.lit(i / cuts) for i in range(1, cuts)]), 10_000).alias("_p"), F.count(F.lit(1)).alias("_n"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    points = points.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_n", F.array_distinct(F.coalesce("_p", F.array().cast("array<double>"))).alias("_p"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    placed = df.join(points, on).withColumn("_s", F.when(v.isNull(), F.lit(-1)).otherwise(F.size(F.filter("_p", lambda p: p < v)))).drop("_p", *[f"_g{i}" for i in range(len(group))])
    counts = placed.groupBy(*group, "_s").agg(F.count(F.lit(1)).alias("_k"))
    higher = Window.partitionBy(*group).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_s").alias("_t"), F.coalesce(F.sum("_k").over(higher), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_s").orderBy(F.col(value).desc_nulls_last(), tie)
    ranked = placed.join(counts, on & (F.col("_s") == F.col("_t"))).withColumn("_r", F.col("_before") + F.row_number().over(within))
    score = F.when(F.col("_r") <= F.ceil(F.col("_n") * 0.5), 1.0).when(F.col("_r") <= F.ceil(F.col("_n") * 0.75), 0.5).otherwise(0.0)
    return ranked.select(*df.columns, score.alias("score"))


def band(df: DataFrame, samples: str, out: str, low: float, high: float, sfreq: float | str) -> DataFrame:
    """``df`` with ``out``: the samples after a zero-phase Butterworth band-pass, null where a column of rates has none or one too low."""
    if not isinstance(sfreq, str):
        return mapped_rows(df.withColumn(out, F.col(samples)), out, lambda x: dsp.butter_bandpass_filter(x, low, high, sfreq))
    return mapped_rows(df.withColumn(out, F.col(samples)), out, lambda x, fs: dsp.butter_bandpass_filter(x, low, high, fs) if high < fs / 2 else None, sfreq=sfreq)


def signal_scores(df: DataFrame, samples: str, sfreq: float | str) -> DataFrame:
    """``df`` with ``scores``: amplitude, beta amplitude, beta energy and theta amplitude of each row's signal.

    Beta is 12 to 30 Hz and theta 4 to 8 Hz by a zero-phase Butterworth band-pass; ``sfreq`` is a rate or the name
    of a column of rates. Scores of a band that the rate does not hold are null.
    """
    both = band(band(df, samples, "_beta", 12, 30, sfreq), samples, "_theta", 4, 8, sfreq)
    known = lambda c, score: F.when(F.col(c).isNotNull(), score)
    parts = F.array(amplitude_score(F.col(samples)), known("_beta", share_below(F.col("_beta"), 20, True)), known("_beta", energy_score(F.col("_beta"))), known("_theta", share_below(F.col("_theta"), 30, False)))
    return both.withColumn("scores", parts).drop("_beta", "_theta")


def signal_score(df: DataFrame, keys: list[str], name: str, side: str, samples: str, sfreq: float | str) -> DataFrame:
    """(keys, score, channels) of recordings of rows (keys, name, side, samples): the mean of their scores.

    The four scores of ``signal_scores`` are means over the channels. Where ``side`` (as ``hemisphere`` gives it) is
    known for all channels, two come in addition: the rank of the largest alpha amplitudes (8 to 12 Hz) over the midline channels and
    the symmetry of the dominant alpha frequencies of left and right channels, paired in order of ``name``. A score
    that is not defined (no midline channel, no band at the rate, no two differing frequencies for the correlation)
    is left out of the mean.
    """
    scored = band(signal_scores(df, samples, sfreq), samples, "_alpha", 8, 12, sfreq)
    fs = F.col(sfreq).cast("double") if isinstance(sfreq, str) else F.lit(float(sfreq))
    scored = scored.withColumns({"_name": F.col(name), "_side": F.col(side), "_fs": fs})
    dominant = mapped_rows(scored, "_alpha", lambda x, r: dsp.dominant_frequency(x, r)[:, None], sfreq="_fs")
    row = F.struct("_name", "_side", F.get("_alpha", F.lit(0)).alias("_freq"))
    one = dominant.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("c"), *[F.avg(F.get("scores", F.lit(i))).alias(f"s{i}") for i in range(4)])

    @F.pandas_udf("double")
    def mean(four: pd.Series, sides: pd.Series, freqs: pd.Series) -> pd.Series:
        out = []
        for f, *rest in zip(four, sides, freqs, strict=True):
            known = [v for v in np.asarray(f, float) if not np.isnan(v)] + _further(*rest)
            out.append(float(np.mean(known)) if known else None)
        return pd.Series(out, dtype=object)

    score = mean(F.array("s0", "s1", "s2", "s3"), F.col("c._side"), F.col("c._freq"))
    return one.select(*keys, score.alias("score"), F.size("c").alias("channels"))


def _further(sides, freqs) -> list[float]:
    """Alpha rank and symmetry of a recording's channels, those of them that are defined.

    The ranks 1, 0.5 and 0 go to fixed shares of the midline channels, so that their mean depends on the number only.
    """
    sides, freqs = np.asarray(sides, object), np.asarray(freqs, float)
    if any(s is None or s == "other" for s in sides) or np.isnan(freqs).any():
        return []
    out = []
    if n := int((sides == "midline").sum()):
        out.append(100 * (int(n * 0.5) + 0.5 * (int(n * 0.75) - int(n * 0.5))) / n)
    left, right = freqs[sides == "left"], freqs[sides == "right"]
    if len(left) == len(right) and len(left) > 1 and np.std(left) > 0 and np.std(right) > 0:
        out.append(float(100 * abs(np.corrcoef(left, right)[0, 1])))
    return out


def symmetry_score(left: np.ndarray, right: np.ndarray, sfreq: float) -> float:
    """100 times the magnitude of the correlation of the dominant frequencies of paired channels, 0 where undefined."""
    a, b = dsp.dominant_frequency(left, sfreq), dsp.dominant_frequency(right, sfreq)
    n = min(len(a), len(b))
    if n < 2 or np.std(a[:n]) == 0 or np.std(b[:n]) == 0:
        return 0.0
    return float(100 * abs(np.corrcoef(a[:n], b[:n])[0, 1]))
