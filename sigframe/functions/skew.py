"""Joins that a hot key does not slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with no more rows than this is never hot.
HOT_ROWS = 100_000
#: Beyond, a key is hot if it holds more than one in so many rows; so there are fewer hot keys than this.
HOT_SHARE = 1000


def join_unique(big: DataFrame, small: DataFrame, key: str, how: str = "inner", *, rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``big`` joined with ``small`` on ``key``, where ``small`` has at most one row per key.

    Rows of hot keys meet their match on the map side: fewer than ``HOT_SHARE`` rows of ``small`` can belong to
    keys that hold more than one in ``HOT_SHARE`` of all rows, and only those are broadcast. All other rows are shuffled by key as
    usual. Rows of ``big`` with a null key are never shuffled; a left join keeps them with nulls. ``how`` is
    'inner' or 'left'. ``rows`` is the number of rows of ``big`` if it is known; ``big`` is read more than once.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    n = big.count() if rows is None else rows
    added = [c for c in small.columns if c != key]
    order = [*big.columns, *added]
    filled = big.where(F.col(key).isNotNull())
    if n <= hot_rows:
        joined = filled.join(small, key, how).select(*order)
    else:
        hot = filled.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(hot_rows, n // HOT_SHARE)).select(key)
        marked = filled.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
        few = small.join(F.broadcast(hot), key, "left_semi")
        joined = marked.where("_hot").drop("_hot").join(F.broadcast(few), key, how).select(*order)
        joined = joined.unionByName(marked.where("_hot is null").drop("_hot").join(small, key, how).select(*order))
    if how == "inner":
        return joined
    types = {f.name: f.dataType for f in small.schema}
    return joined.unionByName(big.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in added]))
