"""Events, runs and epochs of recordings, as windows, sequences and range conditions.

A recording is a set of rows (rec_id, sample, value); annotations are (rec_id, onset, duration, description).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_index(df: DataFrame, rec: str, order: list[str], out: str = "sample") -> DataFrame:
    """``df`` with the position of each row in its recording, from 0."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(rec).orderBy(*order)) - 1).cast("bigint"))


def codes_by_first_use(df: DataFrame, label: str, order: str, out: str = "code") -> DataFrame:
    """(label, code): labels numbered from 0 in order of their first use. Labels are few; uses are pre-aggregated."""
    first = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("_first"))
    return first.select(label, (F.row_number().over(Window.orderBy("_first", label)) - 1).cast("int").alias(out))


def from_annotations(annotations: DataFrame, text: str = "description") -> DataFrame:
    """Annotations that do not begin with ``bad`` or ``edge`` in any case."""
    return annotations.where(~F.lower(F.col(text)).rlike("^(bad|edge)"))


def changes(df: DataFrame, rec: str, order: list[str], code: str) -> DataFrame:
    """Rows whose code differs from the one before in the recording, with ``previous``; first rows are none."""
    w = Window.partitionBy(rec).orderBy(*order)
    return df.withColumn("previous", F.lag(code).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(code)))


def extract(annotations: DataFrame | None, stim: DataFrame | None, method: str = "auto") -> DataFrame:
    """Events (rec_id, sample, name) from annotations (rec_id, sample, description) or from a track of codes (rec_id, sample, code).

    'annotations' and 'stim' take one of them. 'auto' takes a recording's annotations where it has usable ones, else the changes of its track
    to a code other than 0, named ``event_<code>``. ValueError for another method or for the table it needs.
    """
    if method not in ("auto", "annotations", "stim"):
        raise ValueError(method)
    a = None if annotations is None or method == "stim" else from_annotations(annotations).select("rec_id", F.col("sample").cast("bigint").alias("sample"), F.col("description").alias("name"))
    b = None
    if stim is not None and method != "annotations":
        moved = changes(stim, "rec_id", ["sample"], "code").where("code <> 0")
        b = moved.select("rec_id", F.col("sample").cast("bigint").alias("sample"), F.concat(F.lit("event_"), F.col("code").cast("string")).alias("name"))
    if a is None or b is None:
        found = b if a is None else a
        if found is None:
            raise ValueError(f"nothing to extract events from by {method}")
        return found
    return a.unionByName(b.join(a.select("rec_id").distinct(), "rec_id", "left_anti"))


def runs(df: DataFrame, rec: str, order: list[str], code: str) -> DataFrame:
    """(rec, run, code, first, last, length): stretches of equal codes, by gaps and islands."""
    w = Window.partitionBy(rec).orderBy(*order)
    fresh = F.when(F.lag(code).over(w).eqNullSafe(F.col(code)), 0).otherwise(1)
    marked = df.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_new", fresh)
    numbered = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(rec, "run", code).agg(
        F.min("_pos").cast("bigint").alias("first"), F.max("_pos").cast("bigint").alias("last"), F.count(F.lit(1)).alias("length")
    )


def segment_starts(n: Column, width: int, overlap: float) -> Column:
    """Starts of the windows of ``width`` samples that tile ``n`` samples; ValueError for bad parameters."""
    if width <= 0 or not 0 <= overlap < 1:
        raise ValueError("width must be positive and overlap within [0, 1)")
    step = round(width * (1 - overlap))
    if step <= 0:
        raise ValueError("overlap leaves no step")
    return F.when(n >= width, F.sequence(F.lit(0).cast("bigint"), n - width, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def sliding_segments(samples: DataFrame, width: int, overlap: float) -> DataFrame:
    """(rec_id, start, n, mean, std) of every window over (rec_id, sample, value).

    Every sample is dealt to the windows that hold it by arithmetic on its index, so that one
    aggregation with map-side combination does it and no recording has to fit in a task.
    """
    segment_starts(F.lit(1), width, overlap)
    step = round(width * (1 - overlap))
    length = samples.groupBy("rec_id").agg((F.max("sample") + 1).alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("sample") - width + 1) / step)).cast("bigint")
    last = F.floor(F.col("sample") / step).cast("bigint")
    dealt = samples.select("rec_id", "value", F.explode(F.sequence(first, last)).alias("_k"))
    stats = dealt.groupBy("rec_id", "_k").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.join(length, "rec_id").where(F.col("_k") * step + width <= F.col("_n")).select("rec_id", (F.col("_k") * step).alias("start"), "n", "mean", "std")


def event_epochs(samples: DataFrame, rec: str, order: list[str], value: str, before: int, after: int) -> DataFrame:
    """Rows with ``epoch``, the values from ``before`` samples before to ``after`` after them; incomplete epochs are left out."""
    w = Window.partitionBy(rec).orderBy(*order).rowsBetween(-before, after)
    return samples.withColumn("epoch", F.collect_list(value).over(w)).where(F.size("epoch") == before + after + 1)


def long_event_segments(annotations: DataFrame, width: int, overlap: float) -> DataFrame:
    """Windows of ``width`` samples within annotations (rec_id, first, length, description) at least that long."""
    step = round(width * (1 - overlap))
    if width <= 0 or step <= 0:
        raise ValueError("bad geometry")
    fit = annotations.where(F.col("length") >= width)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - width) / step))).alias("k")
    return fit.select("rec_id", "description", "first", k).select("rec_id", "description", (F.col("first") + F.col("k") * step).alias("start"), "k")


def drop_bad(epochs: DataFrame, bad: DataFrame) -> DataFrame:
    """Epochs (rec_id, start, stop) that overlap no bad interval (rec_id, first, last) of their recording, ends included."""
    b = bad.select(F.col("rec_id").alias("_r"), F.col("first").alias("_f"), F.col("last").alias("_l"))
    return epochs.join(b, (F.col("rec_id") == F.col("_r")) & (F.col("start") <= F.col("_l")) & (F.col("stop") >= F.col("_f")), "left_anti")


def last_before(df: DataFrame, rec: str, order: list[str], is_event: Column, value: str, out: str) -> DataFrame:
    """``df`` with the ``value`` of the last row up to and including it that is an event, null before the first."""
    w = Window.partitionBy(rec).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(is_event, F.col(value)), ignorenulls=True).over(w))


def event_counts(events: DataFrame, rec: str, name: str) -> DataFrame:
    """(rec, name, n): events of each name per recording."""
    return events.groupBy(rec, name).agg(F.count(F.lit(1)).alias("n"))
