"""Readers of recordings: CSV with an inferred rate, EDF and BDF, BrainVision, WFDB and MAT.

Spark lists the files without their content; each task opens those it is dealt, so no bytes are shuffled. Headers and signals are separate
reads: of EDF, BDF, BrainVision and WFDB a catalogue reads the header and asks for the size of the data file; CSV and MAT have no
header that tells their size, and are read whole. A file is the unit of work.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigframe.sources.matfile import find_recording

HEADER = "path string, file_type string, n_channels int, n_samples long, sfreq double, duration_s double, channels array<string>, error string"
SIGNAL = "path string, ch int, ch_name string, sfreq double, block int, start long, samples array<double>"


def infer_rate(df: DataFrame, rec: str, order: list[str], time: str) -> DataFrame:
    """(rec, n, step, sfreq) of recordings whose ``time`` (seconds) rises throughout by less than 0.1 on average.

    Recordings of one row, with a falling time or a step of 0 have no rate.
    """
    w = Window.partitionBy(rec).orderBy(*order)
    steps = df.withColumn("_d", F.col(time) - F.lag(time).over(w))
    a = steps.groupBy(rec).agg(
        F.count(F.lit(1)).alias("n"), F.min("_d").alias("_low"), F.try_divide(F.max(time) - F.min(time), F.count(F.lit(1)) - 1).alias("step")
    )
    ok = (F.col("_low") >= 0) & (F.col("step") > 0) & (F.col("step") < 0.1)
    return a.select(rec, "n", "step", F.when(ok, F.rint(1 / F.col("step"))).alias("sfreq"))


# ------------------------------------------------------------------------------ parsers
def parse_edf(data: bytes, signals: bool = True) -> dict:
    """Channels, rates and, if asked for, physical signals of an EDF or BDF file; ``:`` and ``.`` in its times are alike.

    ``rates`` holds the rate of each channel, ``sfreq`` and ``n_samples`` are those of the fastest. BDF samples have three bytes.
    """
    n = int(data[252:256])
    width = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32)
    fields, at = [], 256
    for w in width:
        fields.append([data[at + i * w : at + (i + 1) * w].decode("latin-1").strip() for i in range(n)])
        at += w * n
    bdf = data[:1] == b"\xff"
    records, seconds = int(data[236:244]), float(data[244:252])
    per = [int(x) for x in fields[8]]
    live = [i for i in range(n) if fields[0][i] not in ("EDF Annotations", "BDF Annotations")]
    top = max((per[i] for i in live), default=0)
    rates = [per[i] / seconds if seconds else None for i in live]
    out = {"channels": [fields[0][i] for i in live], "rates": rates, "sfreq": top / seconds if live and seconds else None, "n_samples": top * records}
    if signals:
        body = data[int(data[184:192]) :]
        size = 3 if bdf else 2
        records = min(records, len(body) // (size * sum(per))) if records >= 0 and sum(per) else len(body) // max(size * sum(per), 1)
        raw = np.frombuffer(body, np.uint8)[: size * sum(per) * records].reshape(-1, size).astype(np.int32)
        raw = raw[:, 0] | raw[:, 1] << 8 | (raw[:, 2] << 16 if bdf else 0)
        half = 1 << (8 * size - 1)
        raw = np.where(raw >= half, raw - 2 * half, raw).reshape(records, -1)
        offset = np.cumsum([0, *per])
        out["signals"] = []
        for i in live:
            lo, hi, dlo, dhi = (float(fields[k][i]) for k in (3, 4, 5, 6))
            out["signals"].append((raw[:, offset[i] : offset[i + 1]].ravel() - dlo) * (hi - lo) / (dhi - dlo) + lo)
    return out


#: Units of a resolution in microvolts; other units are left as they are.
_TO_UV = {"V": 1e6, "mV": 1e3, "uV": 1.0, "µV": 1.0, "μV": 1.0, "nV": 1e-3}
_WIDTH = {"INT_16": "<i2", "IEEE_FLOAT_32": "<f4", "INT_32": "<i4"}


def parse_vhdr(text: str) -> dict:
    """Channels, rate, data file and coding of a BrainVision header."""
    get = lambda k, d=None: (m[1].strip() if (m := re.search(rf"(?mi)^{k}=(.*)$", text)) else d)
    rows = re.findall(r"(?m)^Ch(\d+)=([^,\r\n]*),([^,\r\n]*),([^,\r\n]*)(?:,([^,\r\n]*))?", text)
    interval = float(get("SamplingInterval", "0"))
    return {
        "channels": [r[1].replace("\\1", ",") for r in rows], "resolution": [float(r[3] or 1) * _TO_UV.get(r[4].strip(), 1.0) for r in rows], "sfreq": 1e6 / interval if interval else None,
        "data_file": get("DataFile"), "binary": get("BinaryFormat", "INT_16"), "orientation": get("DataOrientation", "MULTIPLEXED"),
    }


def parse_brainvision(text: str, data: bytes) -> dict:
    """Header and signals of a BrainVision recording."""
    h = parse_vhdr(text)
    kind = _WIDTH[h["binary"].upper()]
    n = len(h["channels"])
    x = np.frombuffer(data, kind)[: len(data) // np.dtype(kind).itemsize // n * n]
    x = x.reshape(-1, n).T if h["orientation"].upper() == "MULTIPLEXED" else x.reshape(n, -1)
    return h | {"n_samples": x.shape[1], "signals": [x[i] * h["resolution"][i] for i in range(n)]}


def parse_hea(text: str) -> dict:
    """Channels, rate, length, coding and gains of a WFDB header."""
    lines = [s for s in text.splitlines() if s.strip() and not s.startswith("#")]
    first = lines[0].split()
    n = int(first[1])
    fs = float(first[2].split("/")[0].split("(")[0]) if len(first) > 2 else 250.0
    names, gains, zeros, fmt = [], [], [], []
    for s in lines[1 : n + 1]:
        p = s.split()
        g = re.match(r"([\d.eE+-]+)(?:\(([-\d]+)\))?", p[2]) if len(p) > 2 else None
        gains.append(float(g[1]) if g and float(g[1]) else 200.0)
        zeros.append(float(g[2]) if g and g[2] else float(p[4]) if len(p) > 4 else 0.0)
        fmt.append(int(re.match(r"\d+", p[1])[0]))
        names.append(" ".join(p[8:]) or f"ch{len(names)}")
    seen: dict[str, int] = {}
    for i, x in enumerate(names):
        k = seen.get(x, 0)
        seen[x] = k + 1
        names[i] = f"{x}_{k}" if k else x
    return {"channels": names, "sfreq": fs, "n_samples": int(first[3]) if len(first) > 3 else 0, "format": fmt, "gain": gains, "zero": zeros, "data_file": lines[1].split()[0] if n else None}


def parse_wfdb(text: str, data: bytes) -> dict:
    """Header and signals of a WFDB recording in format 16 or 212."""
    h = parse_hea(text)
    n = len(h["channels"])
    if len(set(h["format"])) > 1:
        raise ValueError(f"channels of different formats {sorted(set(h['format']))} are not read")
    if h["format"][0] == 16:
        x = np.frombuffer(data, "<i2").astype(float)
    elif h["format"][0] == 212:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = np.stack([b[:, 0] | ((b[:, 1] & 15) << 8), b[:, 2] | ((b[:, 1] >> 4) << 8)], axis=1).ravel()
        x = np.where(x > 2047, x - 4096, x).astype(float)
    else:
        raise ValueError(f"format {h['format'][0]} is not read")
    x = x[: len(x) // n * n].reshape(-1, n).T[:, : h["n_samples"] or None]
    return h | {"n_samples": x.shape[1], "signals": [(x[i] - h["zero"][i]) / h["gain"][i] for i in range(n)]}


def parse_csv(data: bytes) -> dict:
    """Numeric columns of a CSV file as channels, the rate from its time column; a header of digits is data."""
    text = data.decode("utf-8", "replace")
    head = text.split("\n", 1)[0].split(",")[0].strip().strip('"')
    df = pd.read_csv(io.StringIO(text), header=None if head.isdigit() else 0)
    if head.isdigit():
        df.columns = [str(i + 1) for i in range(df.shape[1])]
    times, rates = [], set()
    for c in df.columns:
        x = df[c]
        if x.dtype == object:
            if x.astype(str).str.contains(":").all():
                t = pd.to_datetime(x, errors="coerce", format="mixed")
                if t.notna().all() and len(t) > 1:
                    step = (t.iloc[-1] - t.iloc[0]).total_seconds() / (len(t) - 1)
                    times.append(c)
                    rates.add(round(1 / step, 6) if step else None)
        elif len(x) > 1 and x.is_monotonic_increasing and 0 < (x.iloc[-1] - x.iloc[0]) / (len(x) - 1) < 0.1:
            times.append(c)
            rates.add(round((len(x) - 1) / (x.iloc[-1] - x.iloc[0]), 6))
    names = [c for c in df.columns if c not in set(times) and pd.api.types.is_numeric_dtype(df[c])]
    rate = rates.pop() if len(rates) == 1 else None
    return {"channels": [str(c) for c in names], "sfreq": float(round(rate)) if rate else None, "n_samples": len(df), "signals": [df[c].to_numpy(float) for c in names]}


# ------------------------------------------------------------------------------ files
_MAIN = ("edf", "bdf", "rec", "csv", "txt", "vhdr", "hea", "mat")


class _File:
    """A file of any file system that the executors reach, opened by its path as Spark lists it."""

    def __init__(self, path: str):
        from pyarrow import fs

        if re.match(r"file:/|/", path):
            self.fs, self.path = fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
        else:
            self.fs, self.path = fs.FileSystem.from_uri(path)

    def read(self, first: int | None = None) -> bytes:
        with self.fs.open_input_stream(self.path) as f:
            return f.read() if first is None else f.read(first)

    def beside(self, *names: str | None) -> _File | None:
        """The first of ``names`` that is a file of the same folder."""
        folder = self.path.rpartition("/")[0]
        for name in names:
            if name:
                other = object.__new__(_File)
                other.fs, other.path = self.fs, f"{folder}/{name}"
                if other.size() is not None:
                    return other
        return None

    def size(self) -> int | None:
        return self.fs.get_file_info(self.path).size


def _data_of(main: _File, stated: str | None, ending: str) -> _File:
    """The data file that a header states, else the one with the header's stem."""
    stem = main.path.rpartition("/")[2].rpartition(".")[0]
    side = main.beside(stated, f"{stem}.{ending}")
    if side is None:
        raise FileNotFoundError(f"no data file {stated or ''} or {stem}.{ending}")
    return side


def _parsed(path: str, signals: bool) -> tuple[str, dict]:
    f, ext = _File(path), path.rpartition(".")[2].lower()
    if ext in ("edf", "bdf", "rec"):
        return "standard_data", parse_edf(f.read() if signals else f.read(256 + 256 * int(f.read(256)[252:256])), signals)
    if ext == "mat":
        h = find_recording(f.read())
        return h.pop("file_type"), h
    if ext in ("csv", "txt"):
        return "csvData", parse_csv(f.read())
    text = f.read().decode("latin-1")
    h, kind = (parse_vhdr(text), "standard_data") if ext == "vhdr" else (parse_hea(text), "wfdbData")
    side = _data_of(f, h["data_file"], "eeg" if ext == "vhdr" else "dat")
    if signals:
        return kind, parse_brainvision(text, side.read()) if ext == "vhdr" else parse_wfdb(text, side.read())
    n = len(h["channels"])
    if ext == "vhdr":
        h["n_samples"] = side.size() // (np.dtype(_WIDTH[h["binary"].upper()]).itemsize * n) if n else 0
    elif not h["n_samples"] and n:
        h["n_samples"] = int(side.size() / (1.5 if h["format"][0] == 212 else 2)) // n
    return kind, h


# ------------------------------------------------------------------------------ Spark
def _listed(spark: SparkSession, folder: str, least_bytes: int = 0) -> DataFrame:
    """Paths of recordings below ``folder``, without any content; CSV, TXT and MAT files of at most ``least_bytes`` are no recordings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", "length").where(ext.isin(*_MAIN) & (~ext.isin("csv", "txt", "mat") | (F.col("length") > least_bytes))).select("path")


def read_headers(spark: SparkSession, folder: str, least_bytes: int = 0) -> DataFrame:
    """One row per recording below ``folder``; a file that cannot be read has type ``unknown`` and the error.

    The catalogue's rate and length are those of the fastest channel. CSV, TXT and MAT files of at most ``least_bytes`` are passed over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    kind, h = _parsed(path, False)
                    fs, n = h["sfreq"], h["n_samples"]
                    length = None if not fs else ((n - 1) / fs if kind == "standard_data" else n / fs)
                    out.append((path, kind, len(h["channels"]), n, fs, length, h["channels"], None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, "unknown", None, None, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=["path", "file_type", "n_channels", "n_samples", "sfreq", "duration_s", "channels", "error"])
            yield frame.astype({"n_channels": "Int32", "n_samples": "Int64", "sfreq": "float64", "duration_s": "float64"})

    return _listed(spark, folder, least_bytes).mapInPandas(run, HEADER)


def read_signals(spark: SparkSession, folder: str, block: int = 8192, *, errors: str = "skip", least_bytes: int = 0) -> DataFrame:
    """Signals of all readable recordings in blocks of ``block`` samples, each channel at its own rate.

    An unreadable file gives no row (``read_headers`` names it with its error); with ``errors='raise'`` it ends the job.
    """
    if errors not in ("skip", "raise"):
        raise ValueError(errors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                try:
                    _, h = _parsed(path, True)
                except Exception:  # noqa: BLE001
                    if errors == "raise":
                        raise
                    continue
                # epochs of a MAT file follow one another
                signals = h["signals"] if "signals" in h else list(np.concatenate(list(h["epochs"]), axis=1))
                rates = h.get("rates") or [h["sfreq"]] * len(signals)
                for c, (name, x, fs) in enumerate(zip(h["channels"], signals, rates, strict=True)):
                    starts = range(0, len(x), block)
                    yield pd.DataFrame({
                        "path": path, "ch": c, "ch_name": name, "sfreq": fs, "block": [s // block for s in starts], "start": list(starts),
                        "samples": [x[s : s + block] for s in starts],
                    })

    return _listed(spark, folder, least_bytes).mapInPandas(run, SIGNAL)
