"""The catalogue of recordings: scan, validation, filters, edits and reports.

A catalogue is a DataFrame with one row per file: rec_id, path, domain, file_type, n_channels, n_samples,
sfreq, duration_s, channels (array of texts, typed ``type:name`` or plain), status. Every operator is a
lazy projection, filter or aggregation; extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOT_SPECIFIED = "not_specified"
COMPLETED, UNAVAILABLE = "Completed", "Unavailable"


def scan(spark: SparkSession, folder: str, domain: str = NOT_SPECIFIED, pattern: str = "*") -> DataFrame:
    """One row (path, domain, file_type, file_size, modified) per regular file below ``folder``, by path.

    The content column is never read, so that a listing costs no data transfer.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = {"csv": "csvData", "txt": "csvData", "hea": "wfdbData", "edf": "standard_data", "bdf": "standard_data", "fif": "standard_data", "vhdr": "standard_data", "set": "standard_data"}
    kind = F.lit("unknown")
    for e, k in known.items():
        kind = F.when(ext == e, k).otherwise(kind)
    return files.select("path", F.lit(domain).alias("domain"), kind.alias("file_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")).orderBy("path")


def clean_rate(rate: Column) -> Column:
    """The number left of a sampling rate without all characters but digits, ``.eE+-``; null if that is none."""
    return F.regexp_replace(rate, r"[^0-9.eE+\-]", "").try_cast("double")


def shape_of(text: Column) -> tuple[Column, Column]:
    """(channels, samples) of a shape such as ``(25, 687000)``, null where it is none."""
    m = r"^\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*$"
    return F.nullif(F.regexp_extract(text, m, 1), F.lit("")).try_cast("bigint"), F.nullif(F.regexp_extract(text, m, 2), F.lit("")).try_cast("bigint")


def from_locator(locator: DataFrame) -> DataFrame:
    """Typed catalogue of a locator whose values are all text."""
    n_ch, n_samples = shape_of(F.col("data_shape"))
    domain = F.when(F.length(F.trim("domain_tag")) > 0, F.trim("domain_tag")).otherwise(NOT_SPECIFIED)
    return locator.select(
        F.col("loc_id").cast("bigint").alias("rec_id"),
        F.col("file_path").alias("path"),
        F.coalesce(domain, F.lit(NOT_SPECIFIED)).alias("domain"),
        "file_type",
        n_ch.alias("shape_channels"),
        n_samples.alias("n_samples"),
        F.col("number_of_channels").try_cast("int").alias("n_channels"),
        clean_rate(F.col("sampling_rate")).alias("sfreq"),
        F.when(~F.isnan(F.col("duration").try_cast("double")), F.col("duration").try_cast("double")).alias("duration_s"),
        F.initcap(F.trim("completeness_check")).alias("status"),
        F.col("channel_names").alias("channel_text"),
        "description", "source_hash", "file_size",
    )


def sample_filter(
    df: DataFrame, *, channels: tuple | None = None, rate: tuple | None = None, duration: tuple | None = None,
    status: str | None = None, domain: str | None = None, file_type: str | None = None,
) -> DataFrame:
    """Rows within all given inclusive ranges and equal to all given values; the status ignores case and blanks.

    A null value is in no range. Without conditions all rows stay. Filters reach the scan.
    """
    for name, bounds in (("n_channels", channels), ("sfreq", rate), ("duration_s", duration)):
        if bounds is not None:
            df = df.where(F.col(name).between(*bounds))
    if status is not None:
        df = df.where(F.lower(F.trim("status")) == status.strip().lower())
    for name, value in (("domain", domain), ("file_type", file_type)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def set_metadata(df: DataFrame, name: str, values: DataFrame, key: str = "rec_id") -> DataFrame:
    """``df`` with column ``name`` taken from ``values`` (key, name); ValueError if the keys are not the same.

    Keys take the place of positions, which a distributed table does not have.
    """
    n = df.select(key).exceptAll(values.select(key)).limit(1).count() + values.select(key).exceptAll(df.select(key)).limit(1).count()
    if n:
        raise ValueError("values and rows do not correspond")
    return df.drop(name).join(values.select(key, name), key)


def replace_prefix(path: Column, old: str, new: str) -> Column:
    """``path`` with the prefix ``old`` replaced by ``new``; other paths as they are."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1_000_000))).otherwise(path)


def auto_domain(sfreq: Column, channels: Column) -> Column:
    """``domain-{rate}Hz-{n}-{hash}`` of the rate and the sorted channels; null for a null rate or no channels."""
    digest = F.substring(F.sha1(F.concat_ws(",", F.array_sort(channels))), 1, 4)
    return F.when(F.size(channels) > 0, F.concat(F.lit("domain-"), F.floor(sfreq).cast("string"), F.lit("Hz-"), F.size(channels).cast("string"), F.lit("-"), digest))


def check(df: DataFrame) -> DataFrame:
    """``df`` with ``errors`` (array of codes) and the ``status`` that follows from them.

    A missing or odd shape, file type, path or duration, channel counts that differ, a duration
    that is a second or more from samples / rate, missing or repeated channel names are errors.
    """
    names = F.col("channels")
    rules = [
        ("shape", F.col("shape_channels").isNull() | F.col("n_samples").isNull()),
        ("file_type", F.col("file_type").isNull() | F.trim("file_type").isin("", "unidentified")),
        ("path", F.col("path").isNull() | (F.trim("path") == "")),
        ("channel_count", ~(F.coalesce(F.col("shape_channels") == F.col("n_channels"), F.lit(False)) & F.coalesce(F.size(names) == F.col("n_channels"), F.lit(False)))),
        ("duration", ~F.coalesce((F.col("sfreq") > 0) & (F.abs(F.try_divide(F.col("n_samples").cast("double"), "sfreq") - F.col("duration_s")) < 1), F.lit(False))),
        ("names", names.isNull() | (F.size(names) == 0)),
        ("repeated", F.coalesce(F.size(F.array_distinct(names)) < F.size(names), F.lit(False))),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]))
    return df.withColumn("errors", errors).withColumn("status", F.when(F.size("errors") == 0, COMPLETED).otherwise(UNAVAILABLE))


def channel_consistency(df: DataFrame) -> DataFrame:
    """One row: the numbers of channels of the available rows and whether there is only one."""
    live = df.where(F.lower("status") != UNAVAILABLE.lower()).where("n_channels is not null")
    return live.agg(F.countDistinct("n_channels").alias("kinds"), F.min("n_channels").alias("least"), F.max("n_channels").alias("most")).withColumn("consistent", F.col("kinds") <= 1)


def union(*catalogues: DataFrame) -> DataFrame:
    """All rows of all catalogues; a column that one lacks is null there."""
    if not catalogues:
        raise ValueError("nothing to unite")
    out = catalogues[0]
    for c in catalogues[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def group_by_domain(df: DataFrame, domains: list[str]) -> dict[str, DataFrame]:
    """A lazy catalogue per domain; ValueError without a column ``domain``."""
    if "domain" not in df.columns:
        raise ValueError("no column domain")
    return {d: df.where(F.col("domain") == d) for d in domains}


def domain_sample(df: DataFrame, n: int, key: str = "path") -> DataFrame:
    """Up to ``n`` rows of each domain, the same on every run: those with the smallest hash of ``key``.

    ``max_by``-like selection by a bounded heap per task: rows are ranked within (domain, bucket) first and the
    winners of the buckets again within the domain, so that a domain of any size spreads over tasks.
    """
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    salted = df.withColumn("_h", h).withColumn("_b", F.substring("_h", -1, 1))
    first = Window.partitionBy("domain", "_b").orderBy("_h", F.col(key))
    then = Window.partitionBy("domain").orderBy("_h", F.col(key))
    few = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    return few.withColumn("_r", F.row_number().over(then)).where(F.col("_r") <= n).drop("_h", "_b", "_r")


def share_report(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Rows and percent of each value per domain and overall (domain null), by two levels of grouping.

    One pass with map-side combination; percents come from the level's total and are rounded half up to 2 places.
    """
    counted = df.select("domain", value.cast("string").alias(name)).groupBy("domain", name).agg(F.count(F.lit(1)).alias("n"))
    overall = counted.groupBy(name).agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("domain"), name, "n")
    both = counted.unionByName(overall)
    total = both.groupBy("domain").agg(F.sum("n").alias("total"))
    held = both.join(total, both["domain"].eqNullSafe(total["domain"])).drop(total["domain"])
    return held.select("domain", name, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def diagnostics(df: DataFrame) -> DataFrame:
    """Per domain: rows, rows whose channels all have a type, untyped or unknown channels, incomplete files."""
    typed = F.col("channels").isNotNull() & (F.size("channels") > 0) & F.forall("channels", lambda c: F.instr(c, ":") > 0)
    odd = F.size(F.filter(F.coalesce("channels", F.array().cast("array<string>")), lambda c: (F.instr(c, ":") == 0) | F.lower(c).startswith("bio:") | F.lower(c).startswith("unknown:")))
    return df.groupBy("domain").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.when(typed, 1).otherwise(0)).alias("typed"),
        F.sum(odd.cast("bigint")).alias("unknown_channels"),
        F.sum(F.when(F.coalesce(F.col("status") != COMPLETED, F.lit(True)), 1).otherwise(0)).alias("incomplete"),
    )


def nyquist_clamp(h_freq: Column, sfreq: Column, auto: bool = True) -> Column:
    """``h_freq``, or half the rate less 1 Hz where it reaches the Nyquist frequency (null there without ``auto``)."""
    return F.when(h_freq < sfreq / 2, h_freq).when(F.lit(auto), sfreq / 2 - 1)
