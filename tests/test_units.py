import random

from sigframe.operators import units


def _locator(spark, rows):
    schema = "loc_id long, file_path string, domain_tag string, meas_date timestamp, mean_std string, channel_names string, number_of_channels string, infer_unit string, description string, extra string"
    full = [(i, "/data/demo-study/flat/0001_1_x.set", "demo-study", None, *r, "x") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def _tables(spark):
    e = spark.createDataFrame([(1, "F3", "eeg", None, None), (2, "F4", "eeg", None, None), (3, "Temp skin", "temperature", None, None), (4, "GSR palm", "gsr", None, None), (5, "ECG", "ecg", None, None)], "electrode_id int, name string, kind string, former_name string, label string")
    s = spark.createDataFrame([(1, "demo-study")], "study_id int, domain_tag string")
    c = spark.createDataFrame([("uV", True), ("mV", False), ("V", False), ("nV", False), ("LSB", False), ("degC", True), ("degF", False), ("K", False), ("uS", True), ("S", False), ("nS", False)], "unit_code string, is_common boolean")
    return s, e, c


def test_decoding(spark):
    rows = [
        ("{'all_eeg': (0.1, 15), 'F3': (0.1, 14.2), 'F4': (np.float64(0.2), np.float64(1.7e+01))}", "F3, F4", "2", None, None),  # uV, not told
        ('{"F3": [1e-07, 1.5e-05], "F4": [NaN, NaN]}', "F3, F4", "2", None, None),  # V
        ("{'F3': (0.0, 15.1)}", "F3", "1", "V", None),  # told wrongly
        ('{"F3":{"mean":null,"std":null},"F4":{"std":0.015,"mean":0.001}}', "F3, F4", "2", None, None),  # mV, keys in either order
        ("{'F3': (2.0, 300.0)}", "F3", "1", None, "Amplitudes are stored in ADC counts. 1 LSB = 0.05 uV"),
        ("{'Temp skin': (98.1, 0.4), 'GSR palm': (5e-06, 1e-06)}", "GSR palm; Temp skin", "2", None, None),
        (None, "F3", "1", None, None), ("", "F3", "1", None, None), ("{broken", "F3", "1", None, None),
        ("{'Q9': (1.0, 1.5e-05)}", "F3", "1", None, None),  # key that is no channel of the file
    ]
    s, e, c = _tables(spark)
    loc = _locator(spark, rows)
    got = {(r.loc_id, r.key): (r.ch_pos, r.unit) for r in units.decode_units(loc, s, e).collect()}
    assert got == {
        (0, "F3"): (0, "uV"), (0, "F4"): (1, "uV"), (1, "F3"): (0, "V"), (2, "F3"): (0, "uV"), (3, "F4"): (1, "mV"), (4, "F3"): (0, "LSB"),
        (5, "Temp skin"): (1, "degF"), (5, "GSR palm"): (0, "S"), (9, "Q9"): (None, "V"),
    }
    found = {tuple(r) for r in units.uncommon_units(loc, s, e, c).collect()}
    assert found == {(1, 0, "V"), (3, 1, "mV"), (4, 0, "LSB"), (5, 1, "degF"), (5, 0, "S")}
    assert units.decode_units(loc.limit(0), s, e).count() == 0


def _files(values, told, start=0):
    return [(f"{{'F3': (0.1, {v!r}), 'F4': (0.1, {v * 1.1!r})}}", "F3,F4", "2", t, None) for v, t in zip(values, told, strict=True)]


def _units(spark, rows, at=None):
    from datetime import datetime, timedelta

    s, e, _ = _tables(spark)
    loc = _locator(spark, rows)
    if at is not None:
        times = spark.createDataFrame([(i, datetime(2020, 1, 1) + timedelta(days=d)) for i, d in enumerate(at)], "loc_id long, t timestamp")
        loc = loc.drop("meas_date").join(times, "loc_id").withColumnRenamed("t", "meas_date")
    return {(r.loc_id, r.key): r.unit for r in units.decode_units(loc, s, e).collect()}


def test_a_device_far_from_the_usual_level(spark):
    """Levels two decades off are learnt from what the device's files tell, and untold files follow them."""
    for scale in (100, 0.01):
        values = [15.0 * scale * (1 + 0.01 * i) for i in range(12)]
        told = ["uV", None, "uV", "uV", None, "uV"] * 2
        values[7], told[7] = values[7] / 1000, "mV"
        values[10] = values[10] / 1000  # mV and not told
        got = _units(spark, _files(values, told))
        assert got == {(i, k): "mV" if i in (7, 10) else "uV" for i in range(12) for k in ("F3", "F4")}


def test_a_wrong_statement_loses_against_later_files(spark):
    values = [15.0 + i for i in range(9)]
    got = _units(spark, _files(values, ["mV", *[None, "uV"] * 4]), at=range(9))
    assert set(got.values()) == {"uV"}
    # also where the wrong one is told thrice, in a month of its own
    row = ("{'F3 [mV]': (0.1, 15.0)}", "F3 [mV]", "1", "{'F3 [mV]': 'mV'}", "Amplitudes are stored in millivolts.")
    got = _units(spark, [row, *_files(values, ["uV"] * 9)], at=[0, *range(40, 49)])
    assert got[0, "F3 [mV]"] == "uV"


def test_a_level_that_drifts(spark):
    """The level moves by a decade and a half over the months; a jump by three decades is another unit."""
    values = [10.0 * 10 ** (i / 40) for i in range(60)]
    for i in (20, 41):
        values[i] *= 1000
    got = _units(spark, _files(values, [None] * 60), at=[i * 30 for i in range(60)])
    assert {i for (i, _), u in got.items() if u != "uV"} == {20, 41} and got[41, "F3"] == "nV"


def test_chained_blocks_are_one_viterbi():
    """Reduced blocks, chained and decoded, against the best of all paths over the whole sequence."""
    import itertools

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    fields = {"kind": pa.int8(), "mean": pa.float64(), "std": pa.float64(), "lsb": pa.float64(), "start": pa.bool_()} | dict.fromkeys(units._SOURCES, pa.int8())
    for _ in range(25):
        n = 6
        d = {
            "kind": np.full(n, 5), "mean": rng.choice([36.0, 97.0, 309.0, 60.0, 150.0], n), "std": np.ones(n), "lsb": np.full(n, np.nan), "start": rng.random(n) < 0.5,
            **{c: rng.integers(-1, 3, n) for c in units._SOURCES},
        }
        cuts = [0, *sorted(rng.choice(np.arange(1, n), 2, replace=False)), n]

        def batch(bounds, d=d):
            off = pa.array(np.array(bounds, np.int32))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(off, pa.array(d[c], t)) for c, t in fields.items()], names=list(fields))

        levels = np.tile([s for _, s in units.KINDS.values()], (len(cuts) - 1, 1))
        parts = units.Sequences(units._Entries(batch(cuts)), levels, 1)
        ends = units.chain(list(parts.reduced()))
        got = parts.decoded(np.array([a for a, _ in ends]), np.array([b for _, b in ends]))
        whole = units.Sequences(units._Entries(batch([0, n])), levels[:1], 1)
        e, stay = whole.emission[0], whole.stay[0]

        def total(path, e=e, stay=stay, n=n):
            return sum(e[t, u] for t, u in enumerate(path)) - sum(stay[t] for t in range(1, n) if path[t] != path[t - 1])

        best = max(map(total, itertools.product(range(3), repeat=n)))
        assert abs(total(got) - best) < 1e-9 and abs(total(whole.decoded(np.array([-1]), np.array([-1]))) - best) < 1e-9


def test_common_units(spark):
    df = spark.createDataFrame([("mV", 0.001, 0.015, None), ("degF", 98.6, 1.8, None), ("K", 310.15, 1.0, None), ("LSB", 2.0, 300.0, 0.05)], "unit string, mean double, std double, lsb double")
    got = [(round(r.mean_common, 6), round(r.std_common, 6)) for r in units.to_common(df).collect()]
    assert got == [(1.0, 15.0), (37.0, 1.0), (37.0, 1.0), (0.1, 15.0)]


def test_same_for_any_partitioning(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(120):
        scale = 10 ** rng.choice([0, -3, -6, 3])
        rows.append((f"{{'F3': (0.1, {rng.uniform(10, 25) * scale:.6g}), 'F4': (0.1, {rng.uniform(10, 25) * scale:.6g})}}", "F3,F4", "2", rng.choice([None, "uV", "V"]), None))
    s, e, _ = _tables(spark)
    loc = _locator(spark, rows)
    answers = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        answers.append(sorted((r.loc_id, r.key, r.unit) for r in units.decode_units(loc, s, e).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert answers[0] == answers[1]


def test_written_units():
    assert [units.written_unit(x) for x in ("µV", "μV", "1e-3 V", "Volts", "counts.", "°F", "n/a", "", None)] == ["uV", "uV", "mV", "V", "LSB", "degF", None, None, None]
