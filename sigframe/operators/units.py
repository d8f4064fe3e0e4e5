"""Quantities recorded in different units.

Method: a hidden Markov model per device with the unit as hidden state. A device's entries form one sequence in order of
time; Viterbi decodes the units from the jumps of the log values against a smooth underlying level. The level is the
device's own: of each kind of channel it is found from all values of the device, month by month, as the path on which values and told units
agree best. What files tell about units (a dictionary, the channel's own text, the description) is evidence with a weight, so that a
wrong statement loses against the numbers, earlier or later.

Viterbi runs over whole devices, however many tasks hold them: each block of a sequence is first reduced to the best score from every
unit before it to every unit at its end, a device's few small tables are chained, and every block is then decoded between the units that the chain
gives for its ends. That is the same as one pass over the whole sequence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.functions.naming import known_studies, study_key
from sigframe.operators.packed_fields import let, packed_values
from sigframe.operators.reference_match import BROADCAST_ENTRIES, channel_matcher
from sigframe.session import written

#: How a unit is written (lower case, whole text).
SPELLINGS = {
    "uV": r"[uµμ]v|1e-0?6 ?v|micro-?volts?",
    "mV": r"mv|1e-0?3 ?v|milli-?volts?",
    "V": r"v|volts?",
    "nV": r"nv|1e-0?9 ?v|nano-?volts?",
    "LSB": r"lsb|counts?|adu|adc(?: counts?)?",
    "degC": r"deg ?c|° ?c|c|celsius",
    "degF": r"deg ?f|° ?f|f|fahrenheit",
    "K": r"k|kelvin",
    "uS": r"[uµμ]s|micro-?siemens",
    "S": r"s|siemens",
    "nS": r"ns|nano-?siemens",
}
#: Power of ten of each unit in its quantity's common unit. LSB has the step of the description.
DECADES = {"uV": 0.0, "mV": 3.0, "V": 6.0, "nV": -3.0, "uS": 0.0, "S": 6.0, "nS": -3.0}
STATES = {"voltage": ("uV", "mV", "V", "nV", "LSB"), "temperature": ("degC", "degF", "K"), "conductance": ("uS", "S", "nS")}
#: Kinds of channels with the quantity they record and what their level usually is (log10 of the standard deviation in uV, of the mean in uS, degC):
#: the weak prior of the level.
KINDS = {"eeg": ("voltage", 1.2), "bipolar": ("voltage", 1.2), "eog": ("voltage", 1.65), "emg": ("voltage", 1.35), "ecg": ("voltage", 2.4), "temperature": ("temperature", 34.0), "gsr": ("conductance", 0.7)}
_KIND, _QUANTITY = list(KINDS), list(STATES)
_OF_KIND = np.array([_QUANTITY.index(q) for q, _ in KINDS.values()])
#: Emission: spread of log10 values (of degrees) around the level, and the most an implausible value can cost.
SPREAD, SPREAD_DEGREES, WORST = 0.3, 6.0, 40.0
#: Log odds of a told unit being right, by source, and of staying in the same unit within and between recordings.
TOLD, STAY, STAY_BETWEEN = 2.5, 4.0, 2.0
#: Levels: the grid and the spread of the prior in decades (degrees), what a step of the grid from one month to the next costs, and an unusual unit.
GRID, GRID_DEGREES = np.round(np.arange(-5.0, 8.01, 0.1), 1), np.arange(-40.0, 120.1, 1.0)
PRIOR, PRIOR_DEGREES, DRIFT, UNUSUAL = 1.0, 12.0, 1.0, 0.7

_KEY = r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')"""
_ENTRY = _KEY + r"""\s*:\s*[(\[{]([^)\]}]*)[)\]}]"""
_PAIR = _KEY + r"""\s*:\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')"""
_NUMBER = r"(?<![\w.])[-+]?(?:nan|null|none|inf(?:inity)?|(?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)(?![\w.])"
#: Phrases of descriptions that state the unit of the potentials, the temperature or the conductance.
_SAYS = r"(?i)(?:amplitudes are stored in|signal values:|einheit der kanäle:|exported in|unit=|valeurs en|all potentials given as|physical dimension|stored as|units?:)\s*(1e-\d+ v|adc counts?|[a-zµμ]+)"
_LSB = r"(?i)(?:1\s*(?:lsb|count|adu)\s*=\s*|lsb_uv\s*=\s*|resolution\s+)([0-9.]+(?:e[-+]?\d+)?)"


def _unescaped(value: Column) -> Column:
    def plain(v: Column) -> Column:
        decoded = F.from_json(F.concat(F.lit('["'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"]')), "array<string>")[0]
        return F.when(v.contains("\\u"), F.coalesce(decoded, v)).when(v.contains("\\"), F.regexp_replace(v, r"\\(['\"\\])", "$1")).otherwise(v)

    return let(value, plain)


#: Parts of an entry are put apart by this character.
_PART = "\x1f"


def moments(text: Column) -> Column:
    """``array<struct<key, mean, std>>`` of a dictionary of (mean, std) as text, in any of its notations.

    Takes tuples, lists, objects with ``mean`` and ``std``, and wrapped numbers such as
    ``np.float64(1.5)``; nan, null and missing numbers come out as null. Text that is no
    such dictionary gives an empty array.
    """
    s = F.regexp_replace(text, r"np\.float\d*\(([^()]*)\)", "$1")
    found = F.regexp_extract_all(s, F.lit(_ENTRY), F.lit(0))

    def number(x: Column) -> Column:
        return let(F.trim(x).try_cast("double"), lambda v: F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v))

    def parsed(key: Column, body: Column, nums: Column) -> Column:
        at_mean, at_std = F.instr(body, "mean"), F.instr(body, "std")
        mean_at = F.when((at_std > 0) & (at_mean == 0), -1).when((at_std > 0) & (at_std < at_mean), 1).otherwise(0)
        std_at = F.when((at_mean > 0) & (at_std == 0), -1).when((at_std > 0) & ((at_mean == 0) | (at_std < at_mean)), 0).otherwise(1)
        pick = lambda i: F.when(i >= 0, F.get(nums, i))
        return F.struct(_unescaped(key).alias("key"), number(pick(mean_at)).alias("mean"), number(pick(std_at)).alias("std"))

    def entry(e: Column) -> Column:
        parts = F.split(F.regexp_replace(e, _ENTRY, "$1$2" + _PART + "$3"), _PART, 2)
        return let(parts, lambda p: let(F.lower(F.get(p, F.lit(1))), lambda body: parsed(F.get(p, F.lit(0)), body, F.regexp_extract_all(body, F.lit(_NUMBER), F.lit(0)))))

    return F.coalesce(F.transform(found, entry), F.array().cast("array<struct<key:string,mean:double,std:double>>"))


def unit_pairs(text: Column) -> Column:
    """``array<struct<key, unit>>`` of a dictionary of units as text, units as written.

    A text that is no dictionary states one unit for all channels, under the key ``*``.
    """
    pairs = F.regexp_extract_all(text, F.lit(_PAIR), F.lit(0))

    def pair(e: Column) -> Column:
        parts = F.split(F.regexp_replace(e, _PAIR, "$1$2" + _PART + "$3$4"), _PART, 2)
        return let(parts, lambda p: F.struct(_unescaped(F.get(p, F.lit(0))).alias("key"), _unescaped(F.get(p, F.lit(1))).alias("unit")))

    whole = F.array(F.struct(F.lit("*").alias("key"), text.alias("unit")))
    empty = F.array().cast("array<struct<key:string,unit:string>>")
    return F.coalesce(F.when(F.ltrim(text).startswith("{"), F.transform(pairs, pair)).otherwise(F.when(text.isNotNull(), whole)), empty)


_TAILS = [re.compile(r) for r in (r"[(\[]\s*([^)\]]*?)\s*[)\]]$", r"\sin\s+(\S+)$", r"_([^_\s]+)$")]
_CODES = {code: re.compile(pattern) for code, pattern in SPELLINGS.items()}


def unit_in_name(key: str) -> str | None:
    """The unit at the end of a channel's text, as in ``F3 [uV]``, ``F3 in uV`` or ``F3_uV``.

    >>> unit_in_name("Temp skin (°F)"), unit_in_name("EOG left")
    ('degF', None)
    """
    m = next((m for tail in _TAILS if (m := tail.search(key))), None)
    return written_unit(m[1]) if m else None


@lru_cache(100_000)
def written_unit(text: str | None) -> str | None:
    """The unit code that ``text`` writes, else None.

    >>> written_unit("1e-6 V"), written_unit("ADC counts."), written_unit("n/a")
    ('uV', 'LSB', None)
    """
    t = (text or "").strip().rstrip(".").lower()
    return next((code for code, p in _CODES.items() if p.fullmatch(t)), None)


_RAW = ("mean_std", "channel_names", "number_of_channels", "infer_unit", "description")


def by_device(locator: DataFrame, studies: DataFrame) -> DataFrame:
    """Recordings with numbers, raw, ordered by (device, time, id) over range partitions.

    The device is the study, whose amplifier is one. Only raw text is moved, and parsed after it: range
    partitioning reads its input twice, the first time for the bounds.
    """
    device = F.coalesce(study_key(F.col("file_path"), F.col("domain_tag"), known_studies(studies)), F.lit("?"))
    rows = locator.where(F.col("mean_std").isNotNull()).select(F.col("loc_id").cast("long").alias("loc_id"), device.alias("device"), F.col("meas_date").alias("at"), *_RAW)
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(n, "device", "at", "loc_id").sortWithinPartitions("device", "at", "loc_id")


def unit_evidence(rows: DataFrame) -> DataFrame:
    """One row per entry with numbers, in the order of ``rows``: what it is, and what is told about its unit."""
    lsb = F.regexp_extract("description", _LSB, 1).try_cast("double")
    base = rows.select(
        "loc_id", "device", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("month"),
        F.filter(moments(F.col("mean_std")), lambda e: (e["key"] != "all_eeg") & e["mean"].isNotNull() & e["std"].isNotNull()).alias("m"),
        packed_values(F.col("channel_names"), F.col("number_of_channels").try_cast("int")).alias("slots"),
        unit_pairs(F.col("infer_unit")).alias("told"),
        F.regexp_extract("description", _SAYS, 1).alias("says"),
        F.regexp_extract("description", r"(?i)temperature in ([^\s.]+)", 1).alias("temp"),
        F.regexp_extract("description", r"(?i)conductance in ([^\s.]+)", 1).alias("cond"),
        F.when(lsb > 0, lsb).alias("lsb"),
    )

    def entry(e: Column) -> Column:
        unit = lambda key: F.get(F.filter("told", lambda t: t["key"] == key), F.lit(0))["unit"]
        place = F.array_position("slots", e["key"])
        return F.struct(e["key"].alias("key"), e["mean"].alias("mean"), e["std"].alias("std"), F.when(place > 0, (place - 1).cast("int")).alias("ch_pos"), F.coalesce(unit(e["key"]), unit(F.lit("*"))).alias("unit"))

    e = base.select("loc_id", "device", "month", "says", "temp", "cond", "lsb", F.posexplode(F.transform("m", entry)).alias("i", "e"))
    return e.select("loc_id", "device", "month", "i", "e.key", "e.mean", "e.std", "e.ch_pos", "e.unit", "says", "temp", "cond", "lsb")


_LISTS = {"loc_id": pa.int64(), "ch_pos": pa.int32(), "key": pa.string(), "kind": pa.int8(), "mean": pa.float64(), "std": pa.float64(), "lsb": pa.float64(), "start": pa.bool_()}
#: What each source tells: the place of the unit among the states of the entry's quantity, -1 for nothing.
_SOURCES = ("by_file", "by_name", "by_text")
_BLOCK = "device string, month string, part int, block int, loc_id array<long>, ch_pos array<int>, key array<string>, kind array<tinyint>, mean array<double>, std array<double>, lsb array<double>, start array<boolean>, " + ", ".join(f"{c} array<tinyint>" for c in _SOURCES)


def _blocks(kinds_of: Callable[[], tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbouring entries of one device and month as one row; a batch of entries bounds its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        matcher, kinds = kinds_of()
        kind_of: dict[str, tuple[int, str | None]] = {}

        def places(units: pd.Series, quantity: np.ndarray) -> np.ndarray:
            out = np.full(len(units), -1, np.int8)
            coded = units.map({u: written_unit(u) for u in units.unique()})
            for q, states in enumerate(STATES.values()):
                here = quantity == q
                out[here] = coded[here].map({u: i for i, u in enumerate(states)}).fillna(-1).astype(np.int8)
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            d = batch.to_pandas()
            for k in d["key"].unique():
                if k not in kind_of:
                    kind = kinds.get(matcher.match(k)[0], "eeg")
                    kind_of[k] = (_KIND.index(kind) if kind in KINDS else 0, unit_in_name(k))
            kind = d["key"].map({k: kind_of[k][0] for k in d["key"].unique()}).to_numpy(np.int8)
            quantity = _OF_KIND[kind]
            named = d["key"].map({k: kind_of[k][1] for k in d["key"].unique()})
            text = d["says"].where(quantity == 0, d["temp"].where(quantity == 1, d["cond"]))
            new = (d["device"].ne(d["device"].shift()) | d["month"].ne(d["month"].shift())).to_numpy()
            first = np.flatnonzero(new)
            offsets = pa.array(np.append(first, len(d)).astype(np.int32))
            values = {c: batch.column(c) for c in ("loc_id", "ch_pos", "key", "mean", "std", "lsb")}
            values |= {"kind": pa.array(kind), "start": pa.array(d["i"].to_numpy() == 0)}
            told = [pa.array(places(u, quantity)) for u in (d["unit"], named, text)]
            lists = [pa.ListArray.from_arrays(offsets, values[c].cast(t)) for c, t in _LISTS.items()] + [pa.ListArray.from_arrays(offsets, t) for t in told]
            at = pa.array(first)
            head = [batch.column("device").take(at), batch.column("month").take(at), pa.array(np.full(len(first), part, np.int32)), pa.array(np.arange(block, block + len(first), dtype=np.int32))]
            block += len(first)
            yield pa.RecordBatch.from_arrays([*head, *lists], names=["device", "month", "part", "block", *_LISTS, *_SOURCES])
            if len(kind_of) > 500_000:
                kind_of.clear()

    return run


# ------------------------------------------------------------------------------ the level
def _steps(quantity: str, lsb: np.ndarray) -> np.ndarray:
    """Power of ten of each unit in the common one, a row per entry; NaN where the converter step is not known."""
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.log10(lsb)
    return np.stack([own if u == "LSB" else np.full(len(lsb), DECADES[u]) for u in STATES[quantity]], axis=1)


def in_common(quantity: str, mean: np.ndarray, std: np.ndarray, lsb: np.ndarray) -> np.ndarray:
    """What the level is held against, if the entry were in each unit of its quantity: (entries, units), NaN where that says nothing."""
    if quantity == "temperature":
        return np.stack([mean, (mean - 32) / 1.8, mean - 273.15], axis=1)
    value = std if quantity == "voltage" else np.abs(mean)
    with np.errstate(divide="ignore", invalid="ignore"):
        lg = np.where(value > 0, np.log10(value), np.nan)
    return lg[:, None] + _steps(quantity, lsb)


def _told(places: np.ndarray, n: int) -> np.ndarray:
    """Weight of what the sources tell (sources, entries) for each of ``n`` units."""
    return TOLD * (places[:, :, None] == np.arange(n)).sum(axis=0)


class _Entries:
    """The entries of a batch of blocks, flat, with the block that each belongs to."""

    def __init__(self, batch: pa.RecordBatch):
        self.length = np.asarray(batch.column("kind").value_lengths().fill_null(0), np.int64)
        self.block = np.repeat(np.arange(batch.num_rows), self.length)
        flat = lambda c: batch.column(c).flatten()
        self.kind = np.asarray(flat("kind"), np.int64)
        self.quantity = _OF_KIND[self.kind]
        self.mean, self.std = np.asarray(flat("mean"), np.float64), np.asarray(flat("std"), np.float64)
        self.lsb = flat("lsb").to_numpy(zero_copy_only=False).astype(np.float64)
        self.start = np.asarray(flat("start"), bool)
        self.told = np.stack([np.asarray(flat(c), np.int64) for c in _SOURCES])

    def weight(self) -> np.ndarray:
        """1 over the number of entries of the same recording and quantity."""
        new = self.start.copy()
        new[np.cumsum(self.length)[self.length > 0] - self.length[self.length > 0]] = True
        _, of, count = np.unique(np.cumsum(new) * len(_QUANTITY) + self.quantity, return_inverse=True, return_counts=True)
        return 1.0 / count[of]


_HISTOGRAM = "device string, month string, kind int, told int, bin int, lsb_bin int, n double"


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of entries by rounded value and by what is told, for each device, month and kind; a recording weighs 1 for each quantity."""
    for batch in batches:
        e = _Entries(batch)
        quantity = e.quantity
        x = np.where(quantity == 1, e.mean, np.nan)
        for q in (0, 2):
            here = quantity == q
            x[here] = in_common(_QUANTITY[q], e.mean[here], e.std[here], e.lsb[here])[:, 0] * 10
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log10(e.lsb) * 10
        ok = np.isfinite(x)
        told = (e.told[0] + 1) * 36 + (e.told[1] + 1) * 6 + e.told[2] + 1
        d = pd.DataFrame({
            "n": e.weight()[ok], "at": e.block[ok], "kind": e.kind[ok], "told": told[ok], "bin": np.clip(np.round(x[ok]), -2e9, 2e9).astype(np.int64),
            "lsb_bin": np.where(np.isfinite(step[ok]) & (quantity[ok] == 0), np.round(np.nan_to_num(step[ok])), -9999).astype(np.int64),
        })
        g = d.groupby(["at", "kind", "told", "bin", "lsb_bin"], sort=False, as_index=False)["n"].sum()
        at = pa.array(g["at"].to_numpy())
        columns = [pa.array(g[c].to_numpy().astype(np.int32)) for c in ("kind", "told", "bin", "lsb_bin")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("device").take(at), batch.column("month").take(at), *columns, pa.array(g["n"].to_numpy())],
            names=["device", "month", "kind", "told", "bin", "lsb_bin", "n"],
        )


def smooth_level(support: np.ndarray, grid: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The path over a grid of levels with the highest support (months, levels), where every step of the grid between months costs ``DRIFT``."""
    step = DRIFT * np.abs(np.arange(len(grid))[:, None] - np.arange(len(grid)))
    total, back = prior + support[0], []
    for s in support[1:]:
        moved = total[:, None] - step
        back.append(moved.argmax(axis=0))
        total = moved.max(axis=0) + s
    path = [int(total.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return grid[path[::-1]]


def _levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """The level of every kind in every month of one device, from its histogram."""
    months = sorted(pdf["month"].unique())
    level = np.tile([start for _, start in KINDS.values()], (len(months), 1)).astype(float)
    for kind, d in pdf.groupby("kind"):
        quantity, start = KINDS[_KIND[kind]]
        degrees = quantity == "temperature"
        grid, spread, wide = (GRID_DEGREES, SPREAD_DEGREES, PRIOR_DEGREES) if degrees else (GRID, SPREAD, PRIOR)
        bins, lsb = d["bin"].to_numpy(float), np.where(d["lsb_bin"] == -9999, np.nan, 10.0 ** (d["lsb_bin"].to_numpy(float) / 10))
        value = bins if degrees else 10.0 ** np.clip(bins / 10, -300, 300)
        x = in_common(quantity, value, value, lsb)
        told = d["told"].to_numpy()
        weight = _told(np.stack([told // 36 - 1, told // 6 % 6 - 1, told % 6 - 1]), x.shape[1])
        unusual = np.where(np.arange(x.shape[1]) == 0, 0.0, UNUSUAL)
        best = np.full((len(d), len(grid)), -np.inf)
        for u in range(x.shape[1]):
            z = (x[:, u, None] - grid) / spread
            fit = np.where(np.isnan(z), -1e6, -np.minimum(0.5 * z * z, WORST)) + weight[:, u, None] - unusual[u]
            best = np.logaddexp(best, fit)
        here = np.searchsorted(months, d["month"])
        support = np.zeros((len(months), len(grid)))
        np.add.at(support, here, best * d["n"].to_numpy()[:, None])
        level[:, kind] = smooth_level(support, grid, -0.5 * ((grid - start) / wide) ** 2)
    return pd.DataFrame({"device": pdf["device"].iloc[0], "month": months, "levels": list(level)})


def device_levels(blocks: DataFrame) -> DataFrame:
    """(device, month, levels): the smooth level of every kind of channel, in the order of ``KINDS``.

    Only counts by rounded value are moved; a device has at most some thousand for each month.
    """
    counts = blocks.mapInArrow(_histogram, _HISTOGRAM).groupBy("device", "month", "kind", "told", "bin", "lsb_bin").agg(F.sum("n").alias("n"))
    return counts.groupBy("device").applyInPandas(_levels, "device string, month string, levels array<double>")


# ------------------------------------------------------------------------------ Viterbi
class Sequences:
    """The entries of one quantity of a batch of blocks as padded sequences: emissions (blocks, time, units), and what each step costs."""

    def __init__(self, e: _Entries, levels: np.ndarray, q: int):
        name = _QUANTITY[q]
        n = len(STATES[name])
        self.rows = np.flatnonzero(e.quantity == q)
        block = e.block[self.rows]
        self.blocks, self.of, count = np.unique(block, return_inverse=True, return_counts=True)
        self.time = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        self.length = count
        x = in_common(name, e.mean[self.rows], e.std[self.rows], e.lsb[self.rows])
        z = (x - levels[block, e.kind[self.rows]][:, None]) / (SPREAD_DEGREES if name == "temperature" else SPREAD)
        cost = np.where(np.isnan(z), 1e6, np.minimum(0.5 * z * z, WORST))
        cost[np.isnan(x[:, 0])] = 0.0  # a constant channel says nothing
        top = int(count.max(initial=0))
        self.emission = np.zeros((len(self.blocks), top, n))
        self.emission[self.of, self.time] = _told(e.told[:, self.rows], n) - cost
        self.stay = np.full((len(self.blocks), top), STAY)
        self.stay[self.of, self.time] = np.where(e.start[self.rows], STAY_BETWEEN, STAY)
        self.live = np.arange(top) < count[:, None]

    def reduced(self) -> np.ndarray:
        """Best score from each unit before a block to each unit at its end: (blocks, units, units)."""
        n = self.emission.shape[2]
        m = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)[None].repeat(len(self.blocks), axis=0)
        for t in range(self.emission.shape[1]):
            moved = np.maximum(m, m.max(axis=2, keepdims=True) - self.stay[:, t, None, None]) + self.emission[:, t, None, :]
            m = np.where(self.live[:, t, None, None], moved, m)
        return m

    def decoded(self, before: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The unit of every entry (in the order of ``rows``), given the units before the blocks (-1 for none) and at their ends."""
        k, top, n = self.emission.shape
        score = np.where((np.arange(n) == before[:, None]) | (before[:, None] < 0), 0.0, -np.inf)
        back = np.zeros((top, k, n), np.int8)
        at = np.arange(n)
        for t in range(top):
            best = score.argmax(axis=1)
            jump = score.max(axis=1) - self.stay[:, t]
            stays = score >= jump[:, None]
            back[t] = np.where(self.live[:, t, None], np.where(stays, at, best[:, None]), at)
            score = np.where(self.live[:, t, None], np.where(stays, score, jump[:, None]) + self.emission[:, t], score)
        path = np.zeros((k, top), np.int8)
        state = np.where(end < 0, score.argmax(axis=1), end)
        rows = np.arange(k)
        for t in range(top - 1, -1, -1):
            path[:, t] = state
            state = back[t, rows, state]
        return path[self.of, self.time]


def _parts(batch: pa.RecordBatch, size: int = 64) -> Iterator[pa.RecordBatch]:
    """Blocks of similar length together, a few at a time, so that little is padded."""
    length = np.asarray(batch.column("kind").value_lengths().fill_null(0))
    order = np.argsort(length, kind="stable")
    for i in range(0, len(order), size):
        yield batch.take(pa.array(order[i : i + size]))


def _level_rows(batch: pa.RecordBatch) -> np.ndarray:
    start = [s for _, s in KINDS.values()]
    return np.array([start if v is None else v for v in batch.column("levels").to_pylist()], float).reshape(batch.num_rows, len(KINDS))


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _parts(whole):
            e, levels = _Entries(batch), _level_rows(batch)
            for q in range(len(_QUANTITY)):
                s = Sequences(e, levels, q)
                if len(s.blocks):
                    at = pa.array(s.blocks)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(at) for c in ("device", "part", "block")), pa.array(np.full(len(s.blocks), q, np.int8)), pa.array([m.ravel().tolist() for m in s.reduced()], pa.list_(pa.float64()))],
                        names=["device", "part", "block", "q", "best"],
                    )


def chain(best: list[np.ndarray]) -> list[tuple[int, int]]:
    """(unit before, unit at the end) of each block of a sequence from its reduced blocks; -1 before the first."""
    n = best[0].shape[0]
    score = [np.zeros(n)]
    for m in best:
        s = (score[-1][:, None] + m).max(axis=0)
        score.append(s - s.max())
    state, out = int(score[-1].argmax()), []
    for k in range(len(best) - 1, -1, -1):
        before = int((score[k] + best[k][:, state]).argmax())
        out.append((before if k else -1, state))
        state = before
    return out[::-1]


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["part", "block"])
    n = len(STATES[_QUANTITY[pdf["q"].iloc[0]]])
    ends = chain([np.asarray(b, float).reshape(n, n) for b in pdf["best"]])
    return pd.DataFrame({"part": pdf["part"].to_numpy(), "block": pdf["block"].to_numpy(), "q": pdf["q"].to_numpy(), "before": [a for a, _ in ends], "end": [b for _, b in ends]})


_DECODED = "loc_id long, ch_pos int, key string, quantity string, unit string, mean double, std double, lsb double"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _parts(whole):
            e, levels = _Entries(batch), _level_rows(batch)
            unit = np.full(len(e.kind), "", object)
            ends = {c: np.array([[-1] * 3 if v is None else v for v in batch.column(c).to_pylist()], np.int64).reshape(-1, 3) for c in ("before", "end")}
            for q, name in enumerate(_QUANTITY):
                s = Sequences(e, levels, q)
                if len(s.blocks):
                    unit[s.rows] = np.array(STATES[name], object)[s.decoded(ends["before"][s.blocks, q], ends["end"][s.blocks, q])]
            quantity = np.array(_QUANTITY, object)[e.quantity]
            flat = {c: batch.column(c).flatten() for c in ("loc_id", "ch_pos", "key", "mean", "std", "lsb")}
            yield pa.RecordBatch.from_arrays(
                [flat["loc_id"], flat["ch_pos"], flat["key"], pa.array(quantity, pa.string()), pa.array(unit, pa.string()), flat["mean"], flat["std"], flat["lsb"]],
                names=["loc_id", "ch_pos", "key", "quantity", "unit", "mean", "std", "lsb"],
            )


def decode_units(locator: DataFrame, studies: DataFrame, electrodes: DataFrame) -> DataFrame:
    """The unit that each (mean, std) entry of each recording is really in.

    Columns: loc_id, ch_pos (null if the key is no channel of the file; the first slot if a channel is
    repeated), key, quantity, unit, mean, std, lsb. The recordings are range-partitioned by (device, time,
    id) and sorted, so that a device of any size spreads over tasks; its sequence is decoded as a whole all the same. Tables of blocks, levels
    and ends of blocks are written once to the shared folder.

    Entries without numbers, ``all_eeg``, null or unreadable dictionaries give no row.
    A constant channel (std 0) takes the unit of its neighbours and of what is told.
    Repeated rows are decoded each. An empty table gives an empty result.
    """
    rows = electrodes.select("electrode_id", "name", "former_name", "label", "kind").limit(BROADCAST_ENTRIES + 1).collect()
    if len(rows) > BROADCAST_ENTRIES:
        raise ValueError("reference list too large to broadcast")
    names = sorted(((r[0], r[1], r[2], r[3]) for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1]))
    kinds = {r[0]: r[4] for r in rows}
    cut = _blocks(lambda: (channel_matcher(names), kinds))
    blocks = written(unit_evidence(by_device(locator, studies)).mapInArrow(cut, _BLOCK), "unit-blocks")
    levels = written(device_levels(blocks), "unit-levels")
    placed = blocks.join(levels, ["device", "month"], "left")
    reduced = placed.mapInArrow(_reduce, "device string, part int, block int, q tinyint, best array<double>")
    ends = reduced.groupBy("device", "q").applyInPandas(_chained, "part int, block int, q tinyint, before int, end int")
    by_block = ends.groupBy("part", "block").agg(*[F.array(*[F.coalesce(F.max(F.when(F.col("q") == q, F.col(c))), F.lit(-1)) for q in range(3)]).alias(c) for c in ("before", "end")])
    return placed.join(written(by_block, "unit-ends"), ["part", "block"], "left").mapInArrow(_decode, _DECODED)


def to_common(decoded: DataFrame) -> DataFrame:
    """Decoded entries with ``mean_common`` and ``std_common`` in the common unit of their quantity."""
    u = F.col("unit")
    factor = F.when(u == "LSB", F.col("lsb"))
    for code, d in DECADES.items():
        factor = F.when(u == code, F.lit(10.0**d)).otherwise(factor)
    factor = F.when(u == "degF", F.lit(1 / 1.8)).when(u.isin("degC", "K"), F.lit(1.0)).otherwise(factor)
    shift = F.when(u == "degF", F.lit(-32 / 1.8)).when(u == "K", F.lit(-273.15)).otherwise(F.lit(0.0))
    return decoded.withColumns({"mean_common": F.col("mean") * factor + shift, "std_common": F.col("std") * factor})


def uncommon_units(locator: DataFrame, studies: DataFrame, electrodes: DataFrame, unit_codes: DataFrame) -> DataFrame:
    """(loc_id, ch_pos, unit) of the entries that are not in the common unit of their quantity."""
    common = unit_codes.where("is_common").select(F.col("unit_code").alias("unit"))
    return decode_units(locator, studies, electrodes).where("ch_pos is not null").join(common, "unit", "left_anti").select("loc_id", "ch_pos", "unit")
