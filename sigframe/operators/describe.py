"""What descriptions say about recordings: JSON attributes, candidates for rates and channels, small text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_text(text: Column) -> Column:
    """The JSON in a text: the fenced block marked json, else from the first ``{`` to the last ``}``; null if it does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.regexp_replace(F.when(F.length(F.trim(fenced)) > 0, fenced).otherwise(braces), r"^\s+|\s+$", "")
    return F.when(F.try_parse_json(found).isNotNull(), found)


def source_attributes(json: Column, keys: list[str], aliases: dict[str, str] | None = None) -> list[Column]:
    """One column per key of a flat JSON object, ``unknown`` where it is missing; ``aliases`` are other spellings of keys."""
    parsed = F.from_json(json, "map<string,string>")
    out = []
    for k in keys:
        spellings = [k, *[a for a, b in (aliases or {}).items() if b == k]]
        out.append(F.coalesce(*[F.try_element_at(parsed, F.lit(s)) for s in spellings], F.lit("unknown")).alias(k))
    return out


def metadata_candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field, value, uses): sampling rates and channel counts that a text states, most used first by the caller."""
    rates = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.][0-9]+)?) ?Hz"), F.lit(1))
    channels = F.regexp_extract_all(text, F.lit(r"([0-9]+) (?:channels|Kanäle|canales|voies)"), F.lit(1))
    both = F.concat(F.transform(rates, lambda v: F.struct(F.lit("sampling_rate").alias("field"), v.alias("value"))), F.transform(channels, lambda v: F.struct(F.lit("channels").alias("field"), v.alias("value"))))
    return docs.select(key, F.explode(both).alias("x")).groupBy(key, "x.field", "x.value").agg(F.count(F.lit(1)).alias("uses"))


def small_text_files(spark: SparkSession, folder: str, limit: int = 3 * 1024 * 1024) -> DataFrame:
    """(path, text) of txt, md, csv and readme-like files below ``limit`` bytes; larger files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") < limit)
    wanted = F.lower("path").rlike(r"(\.(txt|md|csv|tsv|json)|readme[^/]*)$")
    return files.where(wanted).select("path", F.decode("content", "utf-8").alias("text"))


def safe_divide(n: Column, d: Column) -> Column:
    """n / d, null for a zero or missing d."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def serialisable(value: object) -> object:
    """``value`` with times as ISO text, arrays as lists and bytes as text, in lists and dictionaries as well; others as they are.

    >>> serialisable({"a": [b"x", None]})
    {'a': ['x', None]}
    """
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "tolist"):
        return value.tolist()
    if isinstance(value, bytes):
        return value.decode("utf-8")
    if isinstance(value, dict):
        return {str(k): serialisable(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [serialisable(v) for v in value]
    return value
