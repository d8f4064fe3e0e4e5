"""Event streams: windows with watermarks, sessions and a stateful run detector."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """``df`` with ``ts`` as a timestamp that carries a watermark of ``delay``."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Count, sum and mean of ``value`` per window (tumbling, or sliding by ``slide``) and keys; works on streams and tables."""
    w = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean"
    )


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str]) -> DataFrame:
    """Sessions of events of equal keys with no pause of ``gap`` or longer."""
    return df.groupBy(F.session_window(F.col(ts), gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n"
    )


def code_changes(df: DataFrame, key: str, ts: str, code: str) -> DataFrame:
    """(key, ts, previous, code) whenever the code of a key changes, with the last code as state of the stream."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, ts timestamp, previous string, code string"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(batches), ignore_index=True).sort_values(ts, kind="stable")
        for t, c in zip(rows[ts], rows[code], strict=True):
            if last is not None and c != last:
                out.append((k[0], t, last, c))
            last = c
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ts", "previous", "code"])

    return df.groupBy(key).applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.NoTimeout)
