"""Filling fixed-capacity containers with items of varying length.

Method: large-item matching. Items above a third of the capacity go at most two to a bin,
the largest first, each with the largest other one that still fits; smaller items then
best-fit the remaining gaps, larger ones first. An item is split only if it alone exceeds
the capacity: into full bins and a remainder, which is packed like any other item.

Items are dealt to shards of a bounded number of items by a hash of their id and each shard is packed by
one task from sizes alone. A shard leaves at most a few bins unfilled, whatever the number of shards.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.session import written

#: Items of a shard, on average.
SHARD_ITEMS = 100_000


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, bins numbered from 0; sizes lie within 1..capacity.

    >>> pack([70, 60, 40, 30, 20, 10], 100)
    [0, 1, 1, 0, 2, 2]
    """
    waiting: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), reverse=True):
        waiting.setdefault(sizes[i], []).append(i)
    bins = [0] * len(sizes)
    gaps: dict[int, list[int]] = {}
    gap_bits = 0  # bit g is set while a bin with a gap of g is open
    n_bins = 0

    def opened(b: int, gap: int) -> None:
        nonlocal gap_bits
        if gap:
            gaps.setdefault(gap, []).append(b)
            gap_bits |= 1 << gap

    third = capacity / 3
    large = sorted((s for s in waiting if s > third), reverse=True)
    size_bits = sum(1 << s for s in large)

    def take(size: int) -> int:
        nonlocal size_bits
        i = waiting[size].pop()
        if not waiting[size]:
            size_bits &= ~(1 << size)
        return i

    for s in large:
        while waiting[s]:
            bins[take(s)] = n_bins
            gap = capacity - s
            fitting = size_bits & ((1 << (gap + 1)) - 1)
            if fitting:
                other = fitting.bit_length() - 1
                bins[take(other)] = n_bins
                gap -= other
            opened(n_bins, gap)
            n_bins += 1
    for s in sorted((s for s in waiting if s <= third), reverse=True):
        for i in reversed(waiting[s]):
            fitting = gap_bits >> s
            if fitting:
                gap = s + (fitting & -fitting).bit_length() - 1
                b = gaps[gap].pop()
                if not gaps[gap]:
                    gap_bits &= ~(1 << gap)
            else:
                b, gap = n_bins, capacity
                n_bins += 1
            bins[i] = b
            opened(b, gap - s)
    return bins


_PIECES = "shard long, bin long, id long, part int, token_start long, n_tokens long"


def pack_items(items: DataFrame, item_id: str, size: str, capacity: int, *, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Pieces of items in bins: (bin_id, ``item_id``, part, token_start, n_tokens).

    ``part`` counts the pieces of an item from 0; only an item above ``capacity`` has more than
    one. Items of null, zero or negative size or null id give no piece. Repeated items are packed each.
    An empty table gives an empty result; ValueError for a capacity below 1.
    """
    if capacity is None or capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = items.select(F.col(item_id).cast("long").alias("id"), F.col(size).cast("long").alias("n")).where("n > 0 and id is not null")
    sized = written(sized, "packing-sizes")  # sizes are costly to find, and needed for the number of shards
    shards = max(1, math.ceil(sized.count() / shard_items))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id"], ascending=[False, True], kind="stable")
        rows: list[tuple] = []
        rest: list[tuple[int, int, int, int]] = []
        full = 0
        for i, n in zip(pdf["id"].tolist(), pdf["n"].tolist(), strict=True):
            whole = n // capacity if n > capacity else 0
            for part in range(whole):
                rows.append((key[0], full, i, part, part * capacity, capacity))
                full += 1
            if n - whole * capacity:
                rest.append((i, whole, whole * capacity, n - whole * capacity))
        for b, (i, part, start, n) in zip(pack([r[3] for r in rest], capacity), rest, strict=True):
            rows.append((key[0], full + b, i, part, start, n))
        return pd.DataFrame(rows, columns=["shard", "bin", "id", "part", "token_start", "n_tokens"])

    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    pieces = dealt.groupBy("shard").applyInPandas(solve, _PIECES)
    bin_id = F.concat_ws("-", F.col("shard").cast("string"), F.col("bin").cast("string"))
    return pieces.select(bin_id.alias("bin_id"), F.col("id").alias(item_id), "part", "token_start", "n_tokens")


def packing_report(pieces: DataFrame, capacity: int) -> DataFrame:
    """One row: bins, pieces, tokens, unused room and the share of room used."""
    per_bin = pieces.groupBy("bin_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"))
    return per_bin.agg(
        F.count(F.lit(1)).alias("bins"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.lit(capacity) - F.col("t")), F.lit(0)).alias("unused"),
        F.max("t").alias("fullest"),
    ).withColumn("fill", F.try_divide("tokens", F.col("tokens") + F.col("unused")))


def oversized(pieces: DataFrame, item_id: str) -> DataFrame:
    """Ids of the items that had to be split."""
    return pieces.where("part = 1").select(item_id)
