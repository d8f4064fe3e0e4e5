"""Mixing sources to target weights.

Method: Sainte-Laguë apportionment. The total size is cut into blocks of equal size, which go to sources
by the highest quotients share / (2 k + 1), found in closed form; a source that cannot supply another block, even
repeated as often as it may be, forfeits it, so that the other sources keep their target. The blocks
of a source are apportioned again among its shards, which gives every shard an integer quota before the texts of the
shard are drawn in a seeded order.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.session import written

#: Blocks of the total size at least, and for each shard.
BLOCKS, BLOCKS_PER_SHARD = 10_000, 1000
SHARD_TEXTS = 100_000


def _whole(weights: dict) -> dict:
    """The positive weights as whole numbers in the same proportions."""
    exact = {k: w if isinstance(w, int) else Fraction(w) for k, w in weights.items() if w and w > 0}
    scale = math.lcm(*(f.denominator for f in exact.values())) if exact else 1
    return {k: int(f * scale) for k, f in exact.items()}


def sainte_lague(weights: dict, seats: int, most: dict | None = None) -> tuple[dict, dict]:
    """(seats won, seats forfeited) by weight; ties go to the smaller name.

    The seats with the highest quotients are those above one divisor. Rounding every weight over the mean one
    comes within half a seat per name of it; the few that are then missing or too many are settled one by one. So the work depends on
    the number of names alone, never on that of the seats.

    >>> sainte_lague({"a": 53.0, "b": 24.0, "c": 23.0}, 7)[0]
    {'a': 3, 'b': 2, 'c': 2}
    """
    live = _whole(weights)
    total = sum(live.values())
    got = dict.fromkeys(weights, 0)
    if live and seats > 0:
        for k, w in live.items():
            got[k] = (2 * w * seats + total) // (2 * total)
        spare = seats - sum(got.values())
        names = {k: i for i, k in enumerate(sorted(live))}
        if spare > 0:
            heap = [(Fraction(2 * got[k] + 1, w), names[k], k) for k, w in live.items()]
            heapq.heapify(heap)
            for _ in range(spare):
                _, i, k = heap[0]
                got[k] += 1
                heapq.heapreplace(heap, (Fraction(2 * got[k] + 1, live[k]), i, k))
        elif spare < 0:
            heap = [(-Fraction(2 * got[k] - 1, w), -names[k], k) for k, w in live.items() if got[k]]
            heapq.heapify(heap)
            for _ in range(-spare):
                _, i, k = heap[0]
                got[k] -= 1
                heapq.heapreplace(heap, (-Fraction(2 * got[k] - 1, live[k]), i, k)) if got[k] else heapq.heappop(heap)
    won = {k: n if most is None or most.get(k) is None else min(n, math.floor(most[k])) for k, n in got.items()}
    return won, {k: n - won[k] for k, n in got.items()}


class Mix:
    """Sizes per source, quotas and the drawn texts of a mix.

    ``sized`` has (doc_id, source, n_tokens); ``targets`` (source, target_share, max_repeats) is a
    small table, at most ``MAX_SOURCES`` rows, else ValueError. Texts of null or unknown source, and of null or
    zero size, are in no draw; those with a source and a text count for the total size, whether their source
    has a target or not. Repeated rows are texts of their own. Sources without texts, or
    with a null or zero share, get no quota and are reported as they are. Of repeated targets, the largest share counts.
    """

    MAX_SOURCES = 10_000

    def __init__(self, sized: DataFrame, targets: DataFrame, *, blocks: int = BLOCKS, seed: int = 0, shard_texts: int = SHARD_TEXTS):
        keep = sized.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n_tokens").cast("long").alias("n_tokens"))
        self.sized = written(keep.where("source is not null and n_tokens > 0"), "mix-sizes")
        rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("r")).limit(self.MAX_SOURCES + 1).collect()
        if len(rows) > self.MAX_SOURCES:
            raise ValueError("too many sources")
        self.share = {r["source"]: float(r["s"] or 0.0) for r in rows}
        self.repeats = {r["source"]: int(r["r"] or 0) for r in rows}
        self.seed, self.spark = seed, sized.sparkSession
        names = self.sized.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
        size = self.sized.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
        self.total = int(size[0] or 0)
        n_shards = max(1, math.ceil(int(size[1]) / shard_texts))
        self.block = max(1, self.total // max(blocks, BLOCKS_PER_SHARD * n_shards))
        self.seats = self.total // self.block
        #: texts of the mixed sources, with their shard
        self.texts = names.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_shards)))
        self.shards = self.texts.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
        held = {r["source"]: int(r["t"]) for r in self.shards.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
        self.held = {s: held.get(s, 0) for s in self.share}
        self.most = {s: self.repeats[s] * self.held[s] for s in self.share}
        self.won, self.lost = sainte_lague(self.share, self.seats, {s: m // self.block for s, m in self.most.items()})

    def short(self) -> list[str]:
        """Sources below their target share of the total size even with every text used as often as it may be.

        These are sources that forfeit seats. As seats are whole blocks, one that comes within ``margin`` seats of forfeiting
        any may be short too: apportionment gives a source its share of the seats but for half a seat for each source. Among
        both the exact sizes decide.
        """
        margin = len(self.share) / 2 + 2
        close = [s for s in self.share if self.lost[s] > 0 or self.most[s] < (self.won[s] + margin) * self.block]
        return sorted(s for s in close if self.most[s] < self.share[s] * self.total)

    def quotas(self) -> DataFrame:
        """(source, shard, tokens, quota): tokens to draw from each shard.

        A source's blocks are apportioned among its shards by the same method, by their tokens; one task per source handles
        the table of its shards, a row for each ``shard_texts`` texts. A source with a shortfall gives all it may.
        """
        goals, repeats, block, short = dict(self.won), dict(self.repeats), self.block, set(self.short())

        def apportion(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            tokens = dict(zip(pdf["shard"].tolist(), pdf["tokens"].tolist(), strict=True))
            if key[0] in short:
                quota = {k: repeats[key[0]] * t for k, t in tokens.items()}
            else:
                quota = {k: n * block for k, n in sainte_lague(tokens, goals[key[0]])[0].items()}
            return pd.DataFrame([(key[0], k, t, quota[k]) for k, t in tokens.items()], columns=["source", "shard", "tokens", "quota"])

        return self.shards.groupBy("source").applyInPandas(apportion, "source string, shard long, tokens long, quota long")

    def draws(self) -> DataFrame:
        """(doc_id, source, n_tokens, uses): every drawn text with the number of its uses.

        A quota is filled by whole passes over the shard and one partial pass in seeded order, cut where
        the next text would lead further from the quota. No text is used more than max_repeats times.
        """
        order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(self.seed + 1)), "doc_id", "n_tokens")
        t = self.texts.join(self.quotas(), ["source", "shard"])
        whole = F.floor(F.col("quota") / F.col("tokens"))
        rest = F.col("quota") - whole * F.col("tokens")
        upto = F.sum("n_tokens").over(order)
        partial = F.when(upto - F.col("n_tokens") / 2 <= rest, 1).otherwise(0)
        cap = self.spark.createDataFrame(sorted(self.repeats.items()), "source string, cap int")
        t = t.select("doc_id", "source", "n_tokens", (whole + partial).alias("uses")).join(F.broadcast(cap), "source")
        return t.select("doc_id", "source", "n_tokens", F.least("uses", "cap").cast("int").alias("uses")).where("uses > 0")

    def report(self) -> DataFrame:
        """One row per target source: texts and tokens held, target and reached tokens and shares, and the shortfall."""
        drawn = self.draws().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("reached"), F.max("uses").alias("uses"))
        rows = [(s, self.held[s], self.share[s], self.repeats[s], self.won[s], self.lost[s], s in set(self.short())) for s in sorted(self.share)]
        base = self.spark.createDataFrame(rows, "source string, held_tokens long, target_share double, max_repeats int, blocks long, forfeited long, short boolean")
        out = base.join(F.broadcast(drawn), "source", "left").withColumns({"reached": F.coalesce("reached", F.lit(0)), "uses": F.coalesce("uses", F.lit(0))})
        every = Window.partitionBy(F.lit(1))
        return out.withColumn("reached_share", F.try_divide(F.col("reached").cast("double"), F.sum("reached").over(every))).withColumn(
            "share_of_total", F.try_divide(F.col("reached").cast("double"), F.lit(float(self.total)))
        )

    def found(self) -> DataFrame:
        """(source): the sources with a shortfall."""
        return self.spark.createDataFrame([(s,) for s in self.short()], "source string")
