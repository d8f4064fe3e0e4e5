"""Implausible readings in measurements, relative to what is normal for their source.

Method: a robust autoregression per source and channel, with iterative tests for additive outliers and
level shifts on its residuals; stuck runs and violations of physical limits are
told apart. Sampling rates are held against the rates their study normally records at.

The samples pass twice through Arrow batches of NumPy work. The first pass leaves a few
numbers per epoch and channel, from which Spark aggregates the model of each source with
map-side combination; the second pass tests the samples against that model. No group of
rows is ever gathered in one task, so a source may hold any share of the rows. Spikes are what the tests on the residuals find, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.functions.naming import known_studies, study_key
from sigframe.functions.skew import join_unique
from sigframe.session import written

#: Robust standard scores: an additive outlier's, a level shift's.
OUTLIER, SHIFT = 10.0, 10.0
#: Physical limit of a reading where none is given: scalp potentials stay within a millivolt while their robust spread is about 16 uV. As gain and unit of a
#: source are its own, the limit is kept in its own spreads: 1000 / 16.
IMPOSSIBLE = 60.0
#: A run is stuck if a source repeats itself as long by chance at fewer than so many of all samples; whatever number of samples it has.
CHANCE = 5e-9
#: Up to so many sources their models are broadcast; beyond, they are joined by key.
BROADCAST_SOURCES = 50_000
_MAD = 1.4826


# ------------------------------------------------------------------------------ Arrow helpers
class Rows:
    """Channel rows of a batch of nested lists: the epoch's place in the batch, the channel, the samples."""

    def __init__(self, nested: pa.Array):
        if isinstance(nested, pa.ChunkedArray):
            nested = nested.combine_chunks()
        outer = np.asarray(nested.value_lengths().fill_null(0), dtype=np.int64)
        inner = nested.flatten()
        self.epoch = np.repeat(np.arange(len(outer)), outer)
        first = np.repeat(np.cumsum(outer) - outer, outer)
        self.channel = np.arange(len(self.epoch)) - first
        self.length = np.asarray(inner.value_lengths().fill_null(0), dtype=np.int64)
        flat = inner.flatten()
        self.start = np.cumsum(self.length) - self.length
        self.absent = np.asarray(flat.is_null())
        self.flat = np.asarray(flat.fill_null(0.0), dtype=np.float64)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, samples, absent) for each length of row: rows of equal length as a matrix."""
        for n in np.unique(self.length):
            rows = np.flatnonzero(self.length == n)
            at = self.start[rows][:, None] + np.arange(n)
            yield rows, self.flat[at], self.absent[at]


def _runs(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Length of the run of equal, present, finite neighbours that each sample is part of."""
    n, t = x.shape
    same = np.zeros((n, t), dtype=bool)
    same[:, 1:] = (x[:, 1:] == x[:, :-1]) & ok[:, 1:] & ok[:, :-1]
    at = np.arange(t)
    begin = np.maximum.accumulate(np.where(same, 0, at), axis=1)
    last = np.zeros((n, t), dtype=bool)
    last[:, :-1] = ~same[:, 1:]
    last[:, -1:] = True
    end = np.minimum.accumulate(np.where(last, at, t)[:, ::-1], axis=1)[:, ::-1]
    return end - begin + 1


def _median(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Row medians over ``ok`` samples, NaN for rows without any."""
    n = ok.sum(axis=1)
    s = np.sort(np.where(ok, x, np.inf), axis=1)
    r = np.arange(len(x))
    lo, hi = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, x.shape[1] - 1)
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, (s[r, lo] + s[r, hi]) / 2, np.nan)


#: Runs from this length on are left out of the estimates of what is normal.
LONG_RUN = 8
_FEATURES = "{key} int, channel int, med double, mad double, g0 double, g1 double, g2 double, equal long, pairs long, step double"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, source = Rows(batch.column(1)), batch.column(0)
        for which, x, absent in rows.blocks():
            if not x.shape[1]:
                continue
            ok = ~absent & np.isfinite(x)
            ok &= _runs(x, ok) < LONG_RUN
            med = _median(x, ok)
            dev = np.where(ok, x - med[:, None], 0.0)
            mad = _MAD * _median(np.abs(dev), ok)
            keep = ok.sum(axis=1) >= 3
            if not keep.any():
                continue
            scale = np.where(mad > 0, mad, 1.0)[:, None]
            y = np.clip(dev / scale, -2.5, 2.5)
            pair = ok[:, 1:] & ok[:, :-1]
            pair2 = ok[:, 2:] & ok[:, :-2]
            n0, n1, n2 = (np.maximum(a.sum(axis=1), 1) for a in (ok, pair, pair2))
            g0 = (y * y).sum(axis=1) / n0
            g1 = (y[:, 1:] * y[:, :-1] * pair).sum(axis=1) / n1
            g2 = (y[:, 2:] * y[:, :-2] * pair2).sum(axis=1) / n2
            diff = np.abs(np.diff(x, axis=1, prepend=x[:, :1]))
            seen = np.zeros_like(ok)
            seen[:, 1:] = pair
            equal = (seen & (diff == 0)).sum(axis=1)
            step = np.where(seen & (diff > 0), diff, np.inf).min(axis=1)
            w = which[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    source.take(pa.array(rows.epoch[w])).cast(pa.int32()),
                    pa.array(rows.channel[w].astype(np.int32)),
                    *(pa.array(a[keep]) for a in (med, mad, g0, g1, g2)),
                    *(pa.array(a[keep].astype(np.int64)) for a in (equal, seen.sum(axis=1))),
                    pa.array(np.where(np.isfinite(step), step, np.nan)[keep], from_pandas=True),
                ],
                names=["source_id", "channel", "med", "mad", "g0", "g1", "g2", "equal", "pairs", "step"],
            )


def source_models(epochs: DataFrame) -> DataFrame:
    """(source_id, channel, level, scale, drift, phi1, phi2, repeat, n): what is normal for a source.

    ``level`` is the median over epochs of the median, ``scale`` the 60th percentile (of two epochs the
    wider one) of the scaled median absolute deviation, ``drift`` is the spread of the epochs' levels, ``phi1`` and ``phi2`` come from
    clipped autocovariances by the Yule-Walker equations, ``repeat`` is the share of
    neighbours that are equal by resolution alone.
    """
    f = epochs.select("source_id", "epoch_data").mapInArrow(_features, _FEATURES.format(key="source_id"))
    a = f.groupBy("source_id", "channel").agg(
        F.percentile_approx("med", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias("q"),
        F.percentile_approx("mad", 0.6, 1000).alias("mad"),
        F.sum("g0").alias("g0"), F.sum("g1").alias("g1"), F.sum("g2").alias("g2"),
        ((F.sum("equal") + 1) / (F.sum("pairs") + 4)).alias("repeat"), F.sum("pairs").alias("n"),
        F.min("step").alias("step"),
    )
    r1, r2 = F.try_divide("g1", "g0"), F.try_divide("g2", "g0")
    det = 1 - r1 * r1
    a = a.withColumns({"p1": F.when(det > 0.05, r1 * (1 - r2) / det), "p2": F.when(det > 0.05, (r2 - r1 * r1) / det)})
    steady = (F.abs("p2") < 0.98) & (F.abs("p1") < 1 - F.col("p2"))
    return a.select(
        "source_id", "channel", F.col("q")[1].alias("level"),
        F.greatest(F.col("mad"), F.coalesce("step", F.lit(0.0))).alias("scale"),
        ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("drift"),
        F.coalesce(F.when(steady, F.col("p1")), F.lit(0.0)).alias("phi1"),
        F.coalesce(F.when(steady, F.col("p2")), F.lit(0.0)).alias("phi2"), "repeat", "n",
    )


def outlier_scores(x: np.ndarray, ok: np.ndarray, phi: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples found as additive outliers and as level shifts, by iteration until none is left.

    ``x`` are rows of centred samples, ``phi`` (rows, 2) the autoregression, ``sigma`` the spread of its
    residuals. In each round the largest statistic of every row above its bound
    is taken as found and its effect removed, so a row takes as many rounds as it has outliers.
    """
    n, t = x.shape
    y = np.where(ok, x, 0.0)
    spikes, shifts = np.zeros((n, t), bool), np.zeros((n, t), bool)
    active = np.arange(n)
    while len(active):
        z, p1, p2, s = y[active], phi[active, :1], phi[active, 1:], sigma[active][:, None]
        e = z.copy()
        e[:, 1:] -= p1 * z[:, :-1]
        e[:, 2:] -= p2 * z[:, :-2]
        e = np.clip(e / s, -1e6, 1e6)
        ahead1, ahead2 = np.zeros_like(e), np.zeros_like(e)
        ahead1[:, :-1], ahead2[:, :-2] = e[:, 1:], e[:, 2:]
        left = np.arange(t)[::-1]
        norm = 1 + np.where(left >= 1, p1 * p1, 0.0) + np.where(left >= 2, p2 * p2, 0.0)
        ao = (e - p1 * ahead1 - p2 * ahead2) / np.sqrt(norm)
        c = 1 - p1 - p2
        tail = np.cumsum(ahead2[:, ::-1], axis=1)[:, ::-1]
        num = e + (1 - p1) * ahead1 + c * tail
        den = 1 + np.where(left >= 1, (1 - p1) ** 2, 0.0) + c * c * np.maximum(left - 1, 0)
        ls = num / np.sqrt(den)
        fresh = ok[active] & ~spikes[active]
        ao = np.where(fresh, np.abs(ao), 0.0)
        ls = np.where(fresh & (left >= 4) & ~shifts[active], np.abs(ls), 0.0)
        at_ao, at_ls = ao.argmax(axis=1), ls.argmax(axis=1)
        r = np.arange(len(active))
        top_ao, top_ls = ao[r, at_ao], ls[r, at_ls]
        is_ao = (top_ao > OUTLIER) & (top_ao >= top_ls)
        is_ls = (top_ls > SHIFT) & ~is_ao
        for k in np.flatnonzero(is_ao):
            row, j = active[k], at_ao[k]
            spikes[row, j] = True
            near = [y[row, i] for i in (j - 1, j + 1) if 0 <= i < t and ok[row, i] and not spikes[row, i]]
            y[row, j] = float(np.mean(near)) if near else 0.0
        for k in np.flatnonzero(is_ls):
            row, j = active[k], at_ls[k]
            shifts[row, j] = True
            y[row, j:] -= (num[k, j] / den[k, j]) * sigma[row]
        active = active[is_ao | is_ls]
    return spikes, shifts


_FLAGS = "epoch_id long, source_id int, ch int, n_spike int, n_stuck int, n_impossible int, n_shift int"


def _tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = Rows(batch.column(2))
        models = Rows(batch.column(3))  # a list of numbers per channel
        ids, source = batch.column(0), batch.column(1)
        width = 9
        table = np.full((len(batch), int(models.channel.max(initial=-1)) + 1, width), np.nan)
        for which, m, absent in models.blocks():
            if m.shape[1] == width:
                table[models.epoch[which], models.channel[which]] = np.where(absent, np.nan, m)
        out = [[] for _ in range(6)]
        for which, x, absent in rows.blocks():
            ep, ch = rows.epoch[which], rows.channel[which]
            known = ch < table.shape[1]
            p = np.full((len(which), width), np.nan)
            p[known] = table[ep[known], ch[known]]
            level, scale, drift, p1, p2, repeat, low, high, mask = (p[:, k] for k in range(width))
            live = mask != 0  # unknown masks count as present
            if not x.shape[1] or not live.any():
                continue
            which, x, absent, ep, ch = which[live], x[live], absent[live], ep[live], ch[live]
            level, scale, drift, p1, p2, repeat, low, high = (a[live] for a in (level, scale, drift, p1, p2, repeat, low, high))
            finite = np.isfinite(x)
            ok = finite & ~absent
            spread = np.hypot(scale, np.nan_to_num(drift))[:, None]
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                dev = np.abs(np.where(ok, x, 0.0) - level[:, None]) / spread
            dev = np.where(ok & (spread > 0), dev, 0.0)
            given = np.isfinite(low) | np.isfinite(high)
            with np.errstate(invalid="ignore"):
                beyond = np.where(given[:, None], (x < low[:, None]) | (x > high[:, None]), dev > IMPOSSIBLE)
            impossible = (~finite & ~absent) | (ok & beyond)
            run = _runs(x, ok & ~impossible)
            bound = 1 + np.log(CHANCE) / np.log(np.clip(np.nan_to_num(repeat, nan=0.25), 1e-3, 0.999))
            stuck = ok & ~impossible & (run >= np.maximum(bound, 5.0)[:, None])
            clean = ok & ~impossible & ~stuck
            # only rows with a sample or a step beyond half the bound can hold an outlier
            sigma = scale * np.sqrt(np.clip(1 - p1 * p1 * (1 + p2) / np.maximum(1 - p2, 1e-3) - p2 * p2, 0.02, 1.0))
            own = _median(x, clean)
            z = np.where(clean, x - own[:, None], 0.0)
            test = np.flatnonzero((np.abs(z).max(axis=1) > 0.4 * OUTLIER * sigma) & (sigma > 0) & np.isfinite(own))
            spike, shift = np.zeros_like(clean), np.zeros_like(clean)
            if len(test):
                a, b = outlier_scores(z[test], clean[test], np.stack([p1[test], p2[test]], axis=1), sigma[test])
                spike[test] = a
                shift[test] = b
            counts = [m.sum(axis=1) for m in (spike, stuck, impossible, shift)]
            hit = np.flatnonzero(sum(counts) > 0)
            for k, v in enumerate([ep[hit], ch[hit], *(c[hit] for c in counts)]):
                out[k].append(v)
        if out[0]:
            ep, ch, *counts = (np.concatenate(v) for v in out)
            at = pa.array(ep)
            yield pa.RecordBatch.from_arrays(
                [ids.take(at).cast(pa.int64()), source.take(at).cast(pa.int32()), *(pa.array(v.astype(np.int32)) for v in (ch, *counts))],
                names=["epoch_id", "source_id", "ch", "n_spike", "n_stuck", "n_impossible", "n_shift"],
            )


def flag_epochs(epochs: DataFrame, sources: DataFrame, channel_masks: DataFrame, models: DataFrame | None = None, limits: DataFrame | None = None, *, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """One row per channel of an epoch that holds implausible samples, with their numbers by type.

    Columns: epoch_id, source_id, ch, n_spike, n_stuck, n_impossible, n_shift. NaN and infinite samples are
    impossible, null samples and nested nulls are no samples. Channels that the source's mask marks 0 give no row; a
    source without a mask or not in ``sources`` has all channels; of repeated sources and masks the least mask counts. Epochs with a null
    source_id form a source of their own, empty epochs give no row, repeated epochs count each, and
    epochs may differ in length and number of channels. An empty table gives an empty result.

    ``limits`` (source_id, channel, low, high) are physical limits where they are known, in the unit of the source; either may be null.
    Channels without any are held to ``IMPOSSIBLE``.

    The models of up to ``broadcast_sources`` sources are broadcast, so that no sample is moved; beyond, they are
    joined by key, those of hot sources on the map side (``join_unique``).
    """
    e = epochs.select(F.coalesce("source_id", F.lit(-1)).cast("int").alias("source_id"), F.col("epoch_id").cast("long").alias("epoch_id"), "epoch_data")
    m = source_models(e) if models is None else models
    masks = sources.select(F.col("source_id").cast("int").alias("source_id"), F.col("channel_mask_id").alias("mask_id"))
    masks = masks.join(channel_masks.groupBy("mask_id").agg(F.min("mask").alias("mask")), "mask_id", "left").groupBy("source_id").agg(F.min("mask").alias("mask"))
    m = m.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    if limits is not None:
        bounds = limits.groupBy(F.col("source_id").cast("int").alias("source_id"), F.col("channel").cast("int").alias("channel")).agg(F.max("low").alias("low"), F.min("high").alias("high"))
        m = m.drop("low", "high").join(bounds, ["source_id", "channel"], "left")
    row = F.array(*[F.col(c).cast("double") for c in ("level", "scale", "drift", "phi1", "phi2", "repeat", "low", "high")])
    by_source = m.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", row.alias("m")))).alias("by"), (F.max("channel") + 1).alias("top"))
    both = by_source.join(masks, "source_id", "full").withColumn("top", F.greatest(F.coalesce("top", F.lit(1)), F.coalesce(F.size("mask"), F.lit(1)), F.lit(1)))
    unknown = F.array_repeat(F.lit(None).cast("double"), 8)
    model = F.transform(
        F.sequence(F.lit(0), F.col("top") - 1),
        lambda i: F.concat(F.coalesce(F.try_element_at("by", i), unknown), F.array(F.get("mask", i).cast("double"))),
    )
    per_source = written(both.select("source_id", model.alias("model")), "source-models")
    if per_source.count() <= broadcast_sources:
        joined = e.join(F.broadcast(per_source), "source_id", "left")
    else:
        joined = join_unique(e, per_source, "source_id", "left")
    return joined.select("epoch_id", "source_id", "epoch_data", "model").mapInArrow(_tests, _FLAGS)


# ------------------------------------------------------------------------------ sampling rates
#: A rate is normal for a study from this share of its recordings on; beyond this factor from all of them it is implausible.
NORMAL_SHARE, FACTOR = 0.04, 3.0


def rate_hz(text: Column) -> Column:
    """A sampling rate as written, in Hz: decimal commas, exponents, Hz and kHz; null where it is no number."""
    t = F.regexp_replace(F.lower(F.trim(text)), ",", ".")
    number = F.regexp_replace(t, r"\s*k?hz$", "").try_cast("double")
    v = F.when(t.rlike("khz$"), number * 1000).otherwise(number)
    return F.when(~F.isnan(v), F.round(v, 6))


def flag_rates(locator: DataFrame, studies: DataFrame) -> DataFrame:
    """(loc_id, rate) of recordings whose stated rate is impossible or far from their study's normal ones.

    Missing, 'nan' and unreadable rates are no cases. A recording of no known study is held
    against the normal rates of all studies. The rates per study are pre-aggregated counts;
    the table of normal rates has at most 1 / NORMAL_SHARE rows per study.
    """
    rows = locator.select(
        F.col("loc_id").cast("long").alias("loc_id"),
        F.coalesce(study_key(F.col("file_path"), F.col("domain_tag"), known_studies(studies)), F.lit("?")).alias("study"),
        rate_hz(F.col("sampling_rate")).alias("rate"),
    ).where("rate is not null")
    usable = rows.where("rate > 0 and study <> '?'")
    counts = usable.groupBy("study", "rate").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("study").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    normal = counts.join(total, "study").where((F.col("n") == F.col("most")) | (F.col("n") >= F.greatest(F.lit(2.0), NORMAL_SHARE * F.col("total"))))
    known = normal.groupBy("study").agg(F.collect_set("rate").alias("normal"))
    anywhere = normal.agg(F.coalesce(F.collect_set("rate"), F.array().cast("array<double>")).alias("normal")).select(F.lit("?").alias("study"), "normal")
    held = rows.join(F.broadcast(known.unionByName(anywhere)), "study", "left")
    near = F.exists("normal", lambda r: (F.col("rate") <= r * FACTOR) & (F.col("rate") * FACTOR >= r))
    return held.where((F.col("rate") <= 0) | (F.col("rate") > 1e6) | (F.coalesce(F.size("normal"), F.lit(0)) > 0) & ~near).select("loc_id", "rate")


def implausible(epochs: DataFrame, sources: DataFrame, channel_masks: DataFrame, locator: DataFrame, studies: DataFrame) -> DataFrame:
    """(field, row_id, ch) of all implausible readings: channels of epochs, and sampling rates with ch -1."""
    a = flag_epochs(epochs, sources, channel_masks).where("n_spike + n_stuck + n_impossible > 0")
    a = a.select(F.lit("epoch_data").alias("field"), F.col("epoch_id").alias("row_id"), "ch")
    b = flag_rates(locator, studies).select(F.lit("sampling_rate").alias("field"), F.col("loc_id").alias("row_id"), F.lit(-1).alias("ch"))
    return a.unionByName(b)
