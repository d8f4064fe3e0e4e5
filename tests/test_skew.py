import pytest
from pyspark.sql import functions as F

from sigframe.functions.skew import join_unique
from sigframe.session import written_at


@pytest.mark.parametrize("hot_rows", [5, 100_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_unique_equals_a_plain_join(spark, how, hot_rows):
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 40}", i) for i in range(600)]
    big = spark.createDataFrame(rows, "k string, i int").withColumn("x", F.col("i") * 2)
    small = spark.createDataFrame([("hot", 1.5), *[(f"k{j}", float(j)) for j in range(0, 40, 2)]], "k string, v double")
    got = join_unique(big, small, "k", how, hot_rows=hot_rows)
    assert got.columns == ["k", "i", "x", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    assert join_unique(big.limit(0), small, "k", how, hot_rows=hot_rows).count() == 0
    assert join_unique(big, small.limit(0), "k", how, hot_rows=hot_rows).count() == (0 if how == "inner" else 600)


def test_hot_keys_are_joined_without_a_shuffle_of_their_rows(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"), "id")
    small = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plan = join_unique(big, small, "k", hot_rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and plan.count("BroadcastHashJoin") >= 2
    with pytest.raises(ValueError):
        join_unique(big, small, "k", "full")


def test_scratch_tables_are_marked_for_deletion(spark):
    df, path = written_at(spark.range(3).toDF("id"), "scratch-test")
    assert df.count() == 3
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.cancelDeleteOnExit(place)
    assert fs.deleteOnExit(place)
