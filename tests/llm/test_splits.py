import random

import pytest
from pyspark.sql import functions as F

from sigframe.llm.splits import assign_splits, components, hash_to_min, record_keys, related_records

LOC = "loc_id long, file_path string, domain_tag string, source_hash string, split_name string"


def _find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "loops"])
def test_components_against_union_find(spark, kind):
    rng = random.Random(1)
    edges = {
        "random": [(f"{rng.randint(0, 150):03d}", f"{rng.randint(0, 150):03d}") for _ in range(120)],
        "chain": [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)],
        "star": [("500", f"{i:03d}") for i in range(300)],
        "loops": [("a", "a"), ("b", "c"), ("b", "c"), ("c", "b")],
    }[kind]
    got = {r.node: r.component for r in hash_to_min(spark.createDataFrame(edges + [(None, "x"), ("y", None)], "a string, b string")).collect()}
    assert got == _find(edges)
    assert hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_hub_and_its_records_spread(spark):
    """A component that holds most rows goes the way of hot keys, with the same result."""
    edges = [("000", f"{i:03d}") for i in range(400)] + [(f"x{i}", f"x{i + 1}") for i in range(0, 60, 2)]
    got = {r.node: r.component for r in hash_to_min(spark.createDataFrame(edges, "a string, b string"), hot_rows=50).collect()}
    assert got == _find(edges)


def _tables(spark):
    loc = [
        (1, "/data/demo-study/flat/0007_1_rest.set", "demo-study", "h1", "x"), (2, "E:\\lab\\Demo_Study\\subject_7\\rec3.csv", None, None, "x"), (3, "file:///d/DEMO-STUDY/Participant%2007/session%201/a.hea", "", "nan", "x"),
        (4, None, "demo-study", "h1", "x"), (5, "/data/other-study/sub-7/x.fif", "other-study", "h2", "x"), (6, "/odd/path.fif", "demo study v1.1", None, "x"), (7, "nan", None, None, "x"),
        (8, "/data/demo-study/S070/S070R01.edf", "demo-study", "h3", "x"), (8, "/data/demo-study/S070/S070R01.edf", "demo-study", "h3", "x"),
    ]
    src = [(0, "/scratch/demoStudy/derivatives/SUB-00007/x.fif"), (1, None), (2, "/raw/demo-study/20230101/P070b_rest.vhdr"), (3, "/raw/demo-study/export/rest-1__vp99.mat")]
    s = [(1, "demo-study"), (2, "other-study")]
    return (spark.createDataFrame(loc, LOC), spark.createDataFrame(src, "source_id int, file_path string"), spark.createDataFrame(s, "study_id int, domain_tag string"))


def test_related_records(spark):
    rec = record_keys(*_tables(spark))
    got = sorted(map(tuple, related_records(rec).collect()))
    assert got == [(1, "locator", 2), (1, "locator", 3), (1, "sources", 0), (8, "sources", 2)]


def test_splits_keep_participants_together(spark):
    loc, src, studies = _tables(spark)
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2), ("none", 0.0), (None, 0.5)], "split_name string, proportion double")
    rec = record_keys(loc, src, studies)
    got = assign_splits(rec, targets).collect()
    assert len(got) == 13 and {r.split_name for r in got} <= {"train", "test"}
    by = {(r.rec_table, r.rec_id): r.split_name for r in got}
    assert len({by["locator", i] for i in (1, 2, 3, 4)} | {by["sources", 0]}) == 1  # 4 has the same content hash
    with pytest.raises(ValueError):
        assign_splits(rec, targets.where("proportion = 0"))
    assert assign_splits(record_keys(loc.limit(0), src.limit(0), studies), targets).count() == 0


def test_proportions_and_stability(spark):
    loc = spark.range(3000).select(F.col("id").alias("loc_id"), F.concat(F.lit("/d/demo-study/subject_"), (F.col("id") / 3).cast("int").cast("string"), F.lit("/a.csv")).alias("file_path"), F.lit(None).cast("string").alias("domain_tag"), F.lit(None).cast("string").alias("source_hash"))
    src = spark.createDataFrame([], "source_id int, file_path string")
    studies = spark.createDataFrame([(1, "demo-study")], "study_id int, domain_tag string")
    rec = record_keys(loc, src, studies)
    t = [("a", 0.8), ("b", 0.1), ("c", 0.1)]
    nodes = components(rec)
    one = {r.rec_id: r.split_name for r in assign_splits(rec, spark.createDataFrame(t, "split_name string, proportion double"), nodes).collect()}
    two = {r.rec_id: r.split_name for r in assign_splits(rec, spark.createDataFrame([*t, ("d", 0.1)], "split_name string, proportion double"), nodes).collect()}
    assert sum(v == "a" for v in one.values()) / 3000 == pytest.approx(0.8, abs=0.04)
    assert all(one[k] == two[k] or two[k] == "d" for k in one)  # a new split only takes
