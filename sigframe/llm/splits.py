"""Splits that keep related records together.

Method: Hash-to-Min connected components (each node exchanges its neighbour
cluster with the cluster's minimum until nothing changes) over the graph of the keys that
records carry, then weighted rendezvous hashing of each component to one split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sigframe.functions.naming import NULL_WORDS, known_studies, participant_key, path_text
from sigframe.functions.skew import HOT_ROWS, join_unique
from sigframe.session import discard, written, written_at


def record_keys(locator: DataFrame, sources: DataFrame, studies: DataFrame) -> DataFrame:
    """One row (rec_table, rec_id, person, keys) per recording and per source.

    ``person`` is the participant key, null where there is none. ``keys`` are all keys that tie
    records together: the participant, the content hash and the path itself. A null or null-like path, hash or
    tag gives no key; repeated rows stay.
    """
    names = known_studies(studies)

    def rows(df: DataFrame, kind: str, key: str, tag: Column, hashed: Column) -> DataFrame:
        person = participant_key(F.col("file_path"), tag, names)
        path = path_text(F.col("file_path"))
        return df.select(
            F.lit(kind).alias("rec_table"),
            F.col(key).cast("long").alias("rec_id"),
            person.alias("person"),
            F.array_compact(F.array(F.concat(F.lit("a:"), person), hashed, F.concat(F.lit("u:"), path))).alias("keys"),
        )

    digest = F.lower(F.trim("source_hash"))
    a = rows(locator, "locator", "loc_id", F.col("domain_tag"), F.when(~digest.isin(*NULL_WORDS), F.concat(F.lit("h:"), digest)))
    b = rows(sources, "sources", "source_id", F.lit(None).cast("string"), F.lit(None).cast("string"))
    return a.unionByName(b)


def hash_to_min(edges: DataFrame, src: str = "a", dst: str = "b", *, max_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Connected components of ``edges``: one row (node, component) per node.

    The component is its smallest node. Clusters are kept as rows (v, u), never as arrays, so
    that a component of any size stays distributed; the minimum of a hub's cluster
    is a pre-aggregated ``min``, and the rows of a hub meet it on the map side (``join_unique``). Every round is one job: it
    is written once to the shared folder, which cuts the lineage and survives the loss of an executor, and the rows and their hash are
    observed while they are written. Two rounds with the same ones end it; the round before is discarded.

    Null ends give no edge, self-loops give a node of its own, repeated edges count once, an
    empty input gives an empty result. RuntimeError if ``max_rounds`` do not suffice.
    """
    e = edges.select(F.col(src).alias("v"), F.col(dst).alias("u")).where("v is not null and u is not null")
    both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))

    def settled(rows: DataFrame) -> tuple[DataFrame, str, tuple]:
        seen = Observation()
        counted = rows.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h"))
        table, path = written_at(counted, "hash-to-min")
        return table, path, (int(seen.get["n"] or 0), seen.get["h"])

    clusters, path, now = settled(both.unionByName(both.select("v", F.col("v").alias("u"))))
    for _ in range(max_rounds):
        least = clusters.groupBy("v").agg(F.min("u").alias("m"))
        state = join_unique(clusters, least, "v", rows=now[0], hot_rows=hot_rows)
        to_min = state.select(F.col("m").alias("v"), "u")
        to_members = state.select(F.col("u").alias("v"), F.col("m").alias("u"))
        clusters, fresh, then = settled(to_min.unionByName(to_members))
        discard(clusters.sparkSession, path)
        if then == now:
            return clusters.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
        path, now = fresh, then
    raise RuntimeError("components did not settle")


def components(records: DataFrame, keys: str = "keys") -> DataFrame:
    """(node, component) of every key: the keys of one record are tied to its first one."""
    k = F.col(keys)
    ties = records.where(F.size(k) > 0).select(F.get(k, F.lit(0)).alias("a"), F.explode(k).alias("b")).distinct()
    return hash_to_min(ties)


def rendezvous(component: Column, targets: list[tuple[str, float]]) -> Column:
    """The split of a component by weighted rendezvous hashing.

    Each split draws ``-weight / ln(u)`` with u from a hash of component and split, and the
    highest draw wins. So a component keeps its split when another split is added or
    its share changes, except for the share that has to move. Splits without a positive weight are left out.
    """
    live = [(s, float(w)) for s, w in targets if s is not None and w is not None and w > 0]
    if not live:
        raise ValueError("no split has a positive proportion")
    draws = [
        F.struct(
            (-F.lit(w) / F.ln((F.conv(F.substring(F.md5(F.concat(component, F.lit("|" + s))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12))).alias("d"),
            F.lit(s).alias("s"),
        )
        for s, w in sorted(live)
    ]
    return F.array_max(F.array(*draws))["s"]


def assign_splits(records: DataFrame, targets: DataFrame, node_components: DataFrame | None = None) -> DataFrame:
    """Records (rec_table, rec_id, keys) with their ``component`` and ``split_name``.

    All records that share a key, directly or through other records, get one split. A record without
    any key is a component of its own. Repeated rows are kept and get the same split;
    ``targets`` is a small table (split_name, proportion).
    """
    rows = [(r[0], r[1]) for r in targets.select("split_name", "proportion").limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("at most 1,000 splits")
    records = written(records, "record-keys")
    found = components(records) if node_components is None else node_components
    keyed = records.withColumn("node", F.get("keys", F.lit(0)))
    alone = F.concat(F.lit("r:"), F.col("rec_table"), F.lit(":"), F.col("rec_id").cast("string"))
    return (
        join_unique(keyed, found, "node", "left")
        .withColumn("component", F.coalesce("component", alone))
        .select("rec_table", "rec_id", "component", rendezvous(F.col("component"), rows).alias("split_name"))
    )


def related_records(records: DataFrame, node_components: DataFrame | None = None) -> DataFrame:
    """Records of a participant that has an earlier locator record: (first_loc_id, rec_table, rec_id).

    A participant's records are those of one component that name a participant. ``first_loc_id`` is the
    smallest ``loc_id`` among them. That record itself gives no row; sources of participants
    without a locator record give none; nor do records without a participant.
    """
    records = written(records, "record-keys")  # read twice, and costly to parse
    found = components(records) if node_components is None else node_components
    named = records.where("person is not null").select("rec_table", "rec_id", F.get("keys", F.lit(0)).alias("node"))
    per_node = named.groupBy("node").agg(F.min(F.when(F.col("rec_table") == "locator", F.col("rec_id"))).alias("lo"))
    placed = per_node.join(found, "node")
    first = placed.groupBy("component").agg(F.min("lo").alias("first_loc_id")).where("first_loc_id is not null")
    by_node = placed.join(first, "component").select("node", "first_loc_id")
    return (
        join_unique(named, by_node, "node")
        .where("rec_table = 'sources' or rec_id > first_loc_id")
        .select("first_loc_id", "rec_table", "rec_id")
    )
