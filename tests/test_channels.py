from pyspark.sql import functions as F

from sigframe.operators import channels


def test_a_row_at_a_time_and_by_distinct_entries_the_same(spark):
    rows = [(1, "Fz, EEG FP1-REF,ecg:II"), (2, "fz,Fz"), (3, None), (4, ""), (5, "hbo:S1_D1, mag:MEG 0111"), (6, "EOG left,,EMG chin")]
    df = spark.createDataFrame(rows, "k int, n string").withColumn("extra", F.lit(1))
    for style in ("typed", "plain"):
        one = sorted((r.k, r.n) for r in df.select("k", channels.format_channels(F.col("n"), ["Fz", "Fp1"], style).alias("n")).collect())
        assert sorted((r.k, r.n) for r in channels.format_catalogue(df, "k", "n", ["Fz", "Fp1"], style).collect()) == one
    assert channels.format_catalogue(df.limit(0), "k", "n", ["Fz"]).count() == 0


def test_types_of_prefixes(spark):
    """A few by hand; the query ``channel_type_prefixes`` holds all of them against SQL."""
    want = {"hbo:S1": "hbo", "fnirs_od:S1": "fnirs_od", "mag:M1": "mag", "ref_meg:R": "ref_meg", "eyetrack:x": "eyegaze", "fnirs:a": "fnirs_cw_amplitude", "REF:x": "bio", "EEGDual:T8-P8": "eeg", "x:": None, "Cz": None}
    df = spark.createDataFrame([(k,) for k in want], "n string")
    assert {r.n: r.t for r in df.select("n", channels.channel_type(F.col("n")).alias("t")).collect()} == want
