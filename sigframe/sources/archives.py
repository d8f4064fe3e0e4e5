"""Files within archives and annotations beside recordings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = "archive string, member string, length long, content binary, error string"
ANNOTATION = "path string, onset double, duration double, description string"


def zip_members(spark: SparkSession, folder: str, *, content: bool = True) -> DataFrame:
    """One row per file within the zip archives below ``folder``; nothing is extracted beside them.

    A member whose file already lies beside its archive is left out, as that file is the one that counts. An archive
    that cannot be read gives one row with the error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder)
    rows = files.select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                out.append((path, i.filename, i.file_size, z.read(i) if content else None, None))
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                    out = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["archive", "member", "length", "content", "error"]).astype({"length": "Int64"})

    members = rows.mapInPandas(run, MEMBER)
    beside = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("_beside"))
    place = F.concat(F.regexp_replace("archive", "[^/]*$", ""), F.col("member"))
    return members.join(beside, place == F.col("_beside"), "left_anti")


def parse_vmrk(text: str, sfreq: float) -> list[tuple[float, float, str]]:
    """(onset, duration, description) of the markers of a BrainVision marker file; new segments are none."""
    out = []
    for kind, description, position, points in re.findall(r"(?m)^Mk\d+=([^,\r\n]*),([^,\r\n]*),(\d+),(\d+)", text):
        if kind != "New Segment":
            out.append(((int(position) - 1) / sfreq, int(points) / sfreq, f"{kind}/{description.strip()}".replace("\\1", ",")))
    return out


def parse_edf_annotations(data: bytes) -> list[tuple[float, float, str]]:
    """(onset, duration, description) of the annotation signals of an EDF+ file."""
    n = int(data[252:256])
    labels = [data[256 + i * 16 : 272 + i * 16].decode("latin-1").strip() for i in range(n)]
    per = [int(data[256 + n * 216 + i * 8 : 264 + n * 216 + i * 8]) for i in range(n)]
    records = int(data[236:244])
    raw = np.frombuffer(data[int(data[184:192]) :], "<i2")[: sum(per) * records].reshape(records, -1)
    out = []
    at = np.cumsum([0, *per])
    for i, label in enumerate(labels):
        if label != "EDF Annotations":
            continue
        for block in raw[:, at[i] : at[i + 1]]:
            for tal in block.tobytes().split(b"\x00"):
                m = re.match(rb"([+-]\d+(?:\.\d*)?)(?:\x15(\d+(?:\.\d*)?))?\x14(.*)", tal, re.DOTALL)
                if m:
                    out += [(float(m[1]), float(m[2] or 0), t.decode("utf-8", "replace")) for t in m[3].split(b"\x14") if t]
    return out


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(path, onset, duration, description) of EDF+ files and of BrainVision headers with a marker file of the same stem.

    Files without annotations and files that cannot be read give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    f = files.select("path", "content", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "").alias("stem"))
    marks = f.where("ext = 'vmrk'").select("stem", F.lit("vhdr").alias("ext"), F.col("content").alias("side"))
    rows = f.where("ext in ('edf', 'rec', 'vhdr')").join(marks, ["stem", "ext"], "left").select("path", "ext", "content", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    if r.ext == "vhdr":
                        interval = re.search(r"(?mi)^SamplingInterval=(\S+)", r.content.decode("latin-1"))
                        found = parse_vmrk(r.side.decode("utf-8", "replace"), 1e6 / float(interval[1])) if r.side and interval else []
                    else:
                        found = parse_edf_annotations(r.content)
                except (ValueError, IndexError, TypeError):
                    found = []
                out += [(r.path, *x) for x in sorted(found)]
            yield pd.DataFrame(out, columns=["path", "onset", "duration", "description"])

    return rows.mapInPandas(run, ANNOTATION)
