import pytest
from pyspark.sql import functions as F

from sigframe.operators.packed_fields import packed_values, split_packed

CASES = [
    ("Fz, Cz, Pz", ["Fz", "Cz", "Pz"]),
    ("['Fz', 'C z']", ["Fz", "C z"]),
    ('["EOG, left","A1"]', ["EOG, left", "A1"]),
    ("('Fp1.', 'EOG; upper')", ["Fp1.", "EOG; upper"]),
    ("{a,\"b c\",d}", ["a", "b c", "d"]),
    ("Fz | Cz;Pz, O1", ["Fz", "Cz", "Pz", "O1"]),
    ("Fz\tCz\nPz", ["Fz", "Cz", "Pz"]),
    ("Fz，Cz、Pz", ["Fz", "Cz", "Pz"]),
    ("A'1, 'B 1', \"A'2\"", ["A'1", "B 1", "A'2"]),
    ('Fz "EOG left" Cz', ["Fz", "EOG left", "Cz"]),
    ('"Fz" "Cz"', ["Fz", "Cz"]),
    ("F1 F2 F3 F4 F5 F6", ["F1", "F2", "F3", "F4", "F5", "F6"]),
    ("EMG leg left in uV", ["EMG leg left in uV"]),
    ("EOG left", ["EOG left"]),
    ('["Fp1 (\\u00b5V)"]', ["Fp1 (µV)"]),
    ("Fz, , Cz,", ["Fz", "", "Cz", ""]),
    ("F3 [uV], F4 [uV]", ["F3 [uV]", "F4 [uV]"]),
    ('"a ""q"" b", c', ['a "q" b', "c"]),
    ("Fz, 'Cz, Pz", ["Fz", "Cz", "Pz"]),
    ("", []), (" nan ", []), (None, []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, f string")
    got = {r.i: r.v for r in df.select("i", packed_values(F.col("f")).alias("v")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]


def test_positions_extra_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "a,,b", "x"), (1, "a,,b", "x"), (2, None, "y")], "id int, f string, pos string")
    got = sorted(map(tuple, split_packed(df, "f", ["id"]).collect()))
    assert got == [(1, 0, "a"), (1, 0, "a"), (1, 2, "b"), (1, 2, "b")]
    assert split_packed(df.limit(0), "f", ["id"]).count() == 0


def test_count_hint_and_long_fields(spark):
    words = "one two three four five six"
    df = spark.createDataFrame([(words, 1), (words, None), (", ".join(["'x y'"] * 20_000), None)], "f string, n int")
    got = [len(r.v) for r in df.select(packed_values(F.col("f"), F.col("n")).alias("v")).collect()]
    assert got == [1, 6, 20_000]


@pytest.mark.parametrize("sep", [",", ";", "|", "\t"])
def test_round_trip(spark, sep):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(200):
        values = ["".join(rng.choice("ab c,;|") for _ in range(rng.randint(1, 6))).strip(" ") or "z" for _ in range(rng.randint(2, 7))]
        values = [v.strip() or "z" for v in values]
        rows.append((i, sep.join(f'"{v}"' for v in values), values))
    df = spark.createDataFrame([r[:2] for r in rows], "i int, f string")
    got = {r.i: r.v for r in df.select("i", packed_values(F.col("f")).alias("v")).collect()}
    assert all(got[i] == v for i, _, v in rows)


@pytest.mark.parametrize(("field", "hint", "want"), [
    ("F3 F4 C3 C4 Cz", 5, 5), ("F3 F4 C3 C4 Cz", 4, 1), ("F3 F4", 2, 2), ("F3 F4 C3 C4 Cz Pz", 6, 6), ("F3 F4 C3 C4 Cz Pz", None, 6), ("ECG EMG Fp1-F7", 3, 3),
    ("EOG left", 2, 1), ("ECG II", 2, 1), ("F 10", 2, 1), ("STI 014", 2, 1), ("EMG leg left", 3, 1),
])
def test_short_blank_lists_follow_the_told_number(spark, field, hint, want):
    df = spark.createDataFrame([(field, hint)], "f string, n int")
    assert len(df.select(packed_values(F.col("f"), F.col("n")).alias("v")).first().v) == want
