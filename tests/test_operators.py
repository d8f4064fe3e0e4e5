"""Recording operators beyond what the queries show: errors, edge cases, closed forms, round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.dataset import Dataset
from sigframe.functions import dsp
from sigframe.operators import batch, catalog, channels, describe, events, hashing, quality, signals, store
from sigframe.sources import timeseries


# ------------------------------------------------------------------------------ catalogue
def test_filter_set_metadata_and_union(spark):
    df = spark.createDataFrame([(1, "a", 8, 250.0, " COMPLETED "), (2, "b", 16, None, "Unavailable")], "rec_id int, domain string, n_channels int, sfreq double, status string")
    assert [r.rec_id for r in catalog.sample_filter(df, rate=(250, 250), status="completed").collect()] == [1]
    assert catalog.sample_filter(df).count() == 2 and catalog.sample_filter(df, channels=(1, 2)).count() == 0
    with pytest.raises(ValueError):
        catalog.set_metadata(df, "x", spark.createDataFrame([(1, 5)], "rec_id int, x int"))
    u = catalog.union(df, spark.createDataFrame([(3, "z")], "rec_id int, more string"))
    assert u.count() == 3 and "more" in u.columns
    with pytest.raises(ValueError):
        catalog.group_by_domain(df.drop("domain"), ["a"])
    assert catalog.channel_consistency(df).first().consistent


def test_check_finds_every_error(spark):
    ok = dict(rec_id=1, path="/a.edf", file_type="standard_data", shape_channels=2, n_samples=1000, n_channels=2, sfreq=250.0, duration_s=4.0, channels=["Fz", "Cz"])
    bad = [{}, {"shape_channels": None}, {"file_type": "unidentified"}, {"path": " "}, {"n_channels": 3}, {"duration_s": 9.0}, {"sfreq": None}, {"channels": ["Fz", "Fz"]}]
    schema = "rec_id int, path string, file_type string, shape_channels int, n_samples int, n_channels int, sfreq double, duration_s double, channels array<string>"
    df = spark.createDataFrame([tuple((ok | b | {"rec_id": i}).values()) for i, b in enumerate(bad)], schema)
    got = {r.rec_id: r.errors for r in catalog.check(df).collect()}
    assert got == {0: [], 1: ["shape", "channel_count"], 2: ["file_type"], 3: ["path"], 4: ["channel_count"], 5: ["duration"], 6: ["duration"], 7: ["repeated"]}


# fixed values: the channel texts and what they are to become
def test_channel_formatting(spark):
    cases = {
        "Dual:T8-P8": "eeg:T8-P8", "Dual:Fp1-F7, EEGDual:F7-T7": "eeg:Fp1-F7, eeg:F7-T7", "Fz, Cz, Pz": "eeg:Fz, eeg:Cz, eeg:Pz", "seeg:LA1, seeg:LA2": "seeg:LA1, seeg:LA2",
        "EEG F4-M1, EMG chin, ECG": "eeg:F4-M1, emg:chin, ecg:ECG", "misc:score": "misc:score", "CFC1": "bio:CFC1", "foo:bar": "bio:bar", "Fz, fz": "Fz, fz", "trigger marker": "stim:trigger marker",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r.n: r.f for r in df.select("n", channels.format_channels(F.col("n"), ["Fz", "Cz", "Pz", "T8", "FCC1"]).alias("f")).collect()}
    assert got == cases | {"CFC1": "eeg:FCC1"}
    assert df.limit(1).select(channels.format_channels(F.lit("Fz, Cz"), ["Fz", "Cz"], "plain").alias("f")).first().f == "Fz, Cz"


def test_align_policies(spark):
    s = spark.createDataFrame([(1, "c3", 1.0), (1, "X", 2.0), (2, "X", 3.0)], "rec_id int, ch_name string, value double")
    order = spark.createDataFrame([(0, "C4"), (1, "C3")], "ordinal int, ch_name string")
    assert [(r.rec_id, r.ch_name) for r in channels.align(s, order).collect()] == [(1, "C3")]
    assert sorted((r.ordinal, r.value, r.present) for r in channels.align(s, order, missing="zero").collect()) == [(0, 0.0, False), (1, 1.0, True)]
    with pytest.raises(ValueError):
        channels.align(s, order, missing="other")


# ------------------------------------------------------------------------------ events and signals
@pytest.mark.parametrize(("n", "width", "overlap"), [(1200, 200, 0.0), (1200, 200, 0.5), (10, 3, 0.34), (5, 5, 0.6), (4, 5, 0.0)])
def test_segments_tile(spark, n, width, overlap):
    step = round(width * (1 - overlap))
    want = list(range(0, n - width + 1, step))
    got = spark.range(1).select(events.segment_starts(F.lit(n).cast("bigint"), width, overlap).alias("s")).first().s
    assert got == want and len(got) == max(0, (n - width) // step + 1)
    df = spark.range(n).select(F.lit(1).alias("rec_id"), F.col("id").alias("sample"), F.col("id").cast("double").alias("value"))
    seg = {r.start: r for r in events.sliding_segments(df, width, overlap).collect()}
    assert sorted(seg) == want and all(r.n == width and r.mean == pytest.approx(s + (width - 1) / 2) for s, r in seg.items())


def test_segment_parameters():
    for bad in ((0, 0.0), (5, 1.0), (5, -0.1), (2, 0.9)):
        with pytest.raises(ValueError):
            events.segment_starts(F.lit(10), *bad)


# fixed values: four samples of four channels and their scores
def test_zscore_fixture(spark):
    rows = [("varying", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("constant", 7.0)] * 4 + [("label", v) for v in (2.0, 4.0)] + [("none", None)]
    df = spark.createDataFrame(rows, "ch string, value double")
    got = signals.zscore(df, ["ch"], "value", "z", F.col("ch") == "label").groupBy("ch").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).collect()
    got = {r.ch: (r.m, r.s) for r in got}
    assert got["varying"] == pytest.approx((0, 1), abs=1e-12) and got["constant"] == (0, 0) and got["label"] == (3, 1) and got["none"] == (None, None)


def test_dsp_closed_forms():
    fs = 250.0
    t = np.arange(0, 20, 1 / fs)
    ten, sixty = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 60 * t)
    mid = slice(1000, -1000)
    for kind, kw in (("lowpass", {"h_freq": 40}), ("bandpass", {"l_freq": 1, "h_freq": 40}), ("notch", {"notch": 60})):
        taps = dsp.firwin(kind, fs, **kw)
        assert np.abs(dsp.fir_with_halo([], ten + sixty, [], taps, len(taps) // 2) - ten)[mid].max() < 2e-3
    assert np.abs(dsp.butter_bandpass_filter(ten + sixty, 8, 12, fs) - ten)[mid].max() < 1e-6
    assert np.abs(dsp.resample(ten + sixty, len(t) // 2) - (ten + sixty)[::2]).max() < 1e-9
    f, p = dsp.welch(sixty, fs, 500)
    assert f[p[0].argmax()] == pytest.approx(60, abs=0.5) and p.sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.02)
    s = np.stack([np.sin(2 * np.pi * 3 * t), np.sign(np.sin(2 * np.pi * 7 * t))])
    c = dsp.fast_ica(np.array([[1, 0.5], [0.3, 1]]) @ s)
    assert np.sort(np.abs(np.corrcoef(np.vstack([c, s]))[:2, 2:]).max(axis=0)) == pytest.approx([1, 1], abs=0.01)
    assert dsp.fast_ica(np.zeros((3, 50))).shape == (0, 50)
    assert quality.symmetry_score(np.stack([ten, sixty]), np.stack([ten, sixty]), fs) == pytest.approx(100)


def test_filter_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=6000)
    answers = []
    for size in (2000, 3000):
        rows = [(1, b, [float(v) for v in x[b * size : (b + 1) * size]]) for b in range(6000 // size)]
        out = signals.filter_blocks(spark.createDataFrame(rows, "rec int, block int, samples array<double>"), ["rec"], "lowpass", 250.0, h_freq=30)
        answers.append(np.concatenate([r.samples for r in out.orderBy("block").collect()]))
    assert np.abs(answers[0] - answers[1]).max() < 1e-12 and len(answers[0]) == 6000
    one = spark.createDataFrame([(1, b, [float(v) for v in x[b * 2000 : (b + 1) * 2000]]) for b in range(3)] + [(2, 0, None), (3, 0, [])], "rec int, block int, samples array<double>")
    out = signals.filter_blocks(one, ["rec"], "butter", 250.0, l_freq=8, h_freq=30).orderBy("rec", "block").collect()
    assert np.abs(np.concatenate([r.samples for r in out[:3]]) - dsp.butter_bandpass_filter(x, 8, 30, 250.0)).max() < 1e-6
    assert out[3].samples is None and out[4].samples is None
    with pytest.raises(ValueError):
        signals.filter_blocks(None, ["rec"], "notch", 250.0)


def test_nearest_resample(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)],)], "s array<double>")
    got = df.select(signals.nearest_resample(F.col("s"), 4).alias("r")).first().r
    assert got == [float(i) for i in np.round(np.linspace(0, 9, 4))]


def test_drop_bad_and_runs(spark):
    ep = spark.createDataFrame([(1, 0, 9), (1, 10, 19), (2, 0, 9)], "rec_id int, start int, stop int")
    bad = spark.createDataFrame([(1, 9, 9)], "rec_id int, first int, last int")
    assert sorted((r.rec_id, r.start) for r in events.drop_bad(ep, bad).collect()) == [(1, 10), (2, 0)]
    ann = spark.createDataFrame([(1, 0, 10, "x"), (1, 50, 3, "y")], "rec_id int, first int, length int, description string")
    assert sorted(r.start for r in events.long_event_segments(ann, 4, 0.5).collect()) == [0, 2, 4, 6]


# ------------------------------------------------------------------------------ store, hashes, batch
def test_store_round_trip(spark, root, tmp_path):
    tables = {n: spark.read.parquet(f"{root}/{n}.parquet") for n in store.TABLES}
    folder = str(tmp_path / "s")
    with pytest.raises(ValueError):
        store.EpochStore(spark, folder)
    store.write_store(tables, folder, validate=False)
    with pytest.raises(FileExistsError):
        store.write_store(tables, folder)
    with pytest.raises(ValueError):
        store.write_store({"epochs": tables["epochs"]}, str(tmp_path / "t"))
    with pytest.raises(RuntimeError):
        store.write_store(tables | {"epochs": tables["epochs"].limit(0)}, str(tmp_path / "u"), validate=False)
    reader = store.EpochStore(spark, folder)
    first = tables["epochs"].orderBy("epoch_id").first()
    got = reader.read_epochs([first.epoch_id], ["P4", "C3"], 16, 20).first().data
    assert np.array_equal(np.array(got, float), np.array([first.epoch_data[3][16:20], first.epoch_data[0][16:20]], float), equal_nan=True)
    with pytest.raises(KeyError):
        reader.read_epochs([1], ["Q1"])
    assert reader.source_of(first.epoch_id).first().source_id == first.source_id


def test_valid_epochs(spark):
    rows = [([[1.0, 2.0]],), ([[0.0, 0.0]],), ([[float("nan"), 1.0]],), ([[1.0], [1.0, 2.0]],), ([],), (None,), ([[1.0, None]],)]
    df = spark.createDataFrame(rows, "epoch_data array<array<float>>")
    assert [r.v for r in df.select(store.valid_epochs(df).alias("v")).collect()] == [True] + [False] * 6


def test_greedy_parts(spark):
    rng = np.random.default_rng(3)
    sizes = [(i, int(rng.integers(1, 120))) for i in range(200)]
    got = store.greedy_parts(spark.createDataFrame(sizes, "k long, s long"), "k", "s", 100).orderBy("k").collect()
    totals: dict = {}
    for r in got:
        totals.setdefault(r.part, []).append(r.s)
    assert all(sum(v) <= 100 or len(v) == 1 for v in totals.values()) and len(got) == 200
    assert [r.part for r in got] == sorted(r.part for r in got)


def test_data_hash_ignores_channel_order(spark):
    def rows(order):
        return [(1, n, 10.0, [float(i) if n == "a" else float(-i) for i in range(500)]) for n in order]

    schema = "rec int, ch_name string, fs double, samples array<double>"
    a, b = (hashing.data_hash(spark.createDataFrame(rows(o), schema), ["rec"], "fs").first().data_hash for o in ("ab", "ba"))
    assert a == b and len(a) == 64


def test_batch_contract(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "id int, v int")
    with pytest.raises(ValueError):
        batch.batch_process(df, F.lit(True), len, result="other")
    got = batch.batch_process(df, F.col("v").isNotNull(), lambda r: 10 // int(r["v"]), returns="int", on_error="skip")
    assert sorted((r.id, r.result, (r._error or "")[:17]) for r in got.collect()) == [(1, 5, ""), (2, None, "ZeroDivisionError"), (3, None, "")]
    with pytest.raises(Exception, match="ZeroDivision"):
        batch.batch_process(df, F.lit(True), lambda r: 1 // 0, returns="int").collect()
    assert batch.batch_process(df, F.col("id") == 1, lambda r: 7, returns="int", patch=False).count() == 1
    assert batch.Pipeline([lambda d: d.where("id > 1"), lambda d: d.select("id")]).forward(df).count() == 2


def test_kernel(spark, tmp_path):
    (tmp_path / "k.py").write_text("import pandas as pd\nclass K:\n    def apply(self, rec, ann):\n        return pd.DataFrame({'rec_id': rec.rec_id, 'n': len(ann)})\nKERNEL = K()\n")
    kernel = batch.load_kernel(str(tmp_path / "k"))
    with pytest.raises(FileNotFoundError):
        batch.load_kernel(str(tmp_path / "none.py"))
    with pytest.raises(TypeError):
        batch.load_kernel("json")
    rec = spark.createDataFrame([(1, "Completed"), (2, "Unavailable"), (3, None)], "rec_id int, status string")
    ann = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "rec_id int, description string")
    import sys

    sys.path.insert(0, str(tmp_path))
    local = type("K", (), {"apply": staticmethod(lambda r, a: __import__("pandas").DataFrame({"rec_id": r.rec_id, "n": len(a)}))})
    assert hasattr(kernel, "apply")
    assert sorted(map(tuple, batch.apply_kernel(rec, ann, local, "rec_id int, n int").collect())) == [(1, 2), (3, 0)]


def test_json_and_small_files(spark, tmp_path):
    (tmp_path / "readme").write_text("hello")
    (tmp_path / "a.bin").write_text("no")
    assert [r.text for r in describe.small_text_files(spark, str(tmp_path)).collect()] == ["hello"]
    df = spark.createDataFrame([("x {\"a\": 1} y",), ("```json\n[1]\n```",), ("{broken",), (None,)], "t string")
    assert [r.j for r in df.select(describe.json_text(F.col("t")).alias("j")).collect()] == ['{"a": 1}', "[1]", None, None]


# ------------------------------------------------------------------------------ files
def _edf(path, data, fs):
    n, length = len(data), len(data[0]) // fs
    pad = lambda s, w: str(s).ljust(w).encode()
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.20", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(length, 8) + pad(1, 8) + pad(n, 4)
    for w, v in ((16, [f"ch{i}" for i in range(n)]), (80, [""] * n), (8, ["uV"] * n), (8, [-3276.8] * n), (8, [3276.7] * n), (8, [-32768] * n), (8, [32767] * n), (80, [""] * n), (8, [fs] * n), (32, [""] * n)):
        head += b"".join(pad(x, w) for x in v)
    raw = np.round(np.array(data) * 10).astype("<i2").reshape(n, length, fs).transpose(1, 0, 2).ravel()
    path.write_bytes(head + raw.tobytes())


def test_readers(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(2, 1000)) * 50, 1)
    _edf(tmp_path / "a.edf", x, 100)
    (tmp_path / "b.vhdr").write_text("Brain Vision Data Exchange Header File\n[Common]\nDataFile=old.eeg\nDataOrientation=MULTIPLEXED\nSamplingInterval=4000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=Fz,,0.1,uV\nCh2=Cz,,0.1,uV\n")
    (tmp_path / "b.eeg").write_bytes(np.round(x.T * 10).astype("<i2").tobytes())
    (tmp_path / "c.hea").write_text("c 2 360 1000\nc.dat 16 10(0)/uV 16 0 0 0 0 ECG\nc.dat 16 10(0)/uV 16 0 0 0 0 ECG\n")
    (tmp_path / "c.dat").write_bytes(np.round(x.T * 10).astype("<i2").tobytes())
    (tmp_path / "d.csv").write_text("time,Fz\n" + "\n".join(f"{i / 200},{v}" for i, v in enumerate(x[0])))
    (tmp_path / "e.hea").write_text("e 1 100 10\ne.dat 16 200 16 0 0 0 0 X\n")
    got = {r.path.rpartition("/")[2]: r for r in timeseries.read_headers(spark, str(tmp_path)).collect()}
    assert {k: (r.file_type, r.n_channels, r.n_samples, r.sfreq) for k, r in got.items()} == {
        "a.edf": ("standard_data", 2, 1000, 100.0), "b.vhdr": ("standard_data", 2, 1000, 250.0), "c.hea": ("wfdbData", 2, 1000, 360.0), "d.csv": ("csvData", 1, 1000, 200.0), "e.hea": ("unknown", None, None, None),
    }
    assert got["c.hea"].channels == ["ECG", "ECG_1"] and got["a.edf"].duration_s == pytest.approx(9.99) and "FileNotFound" in got["e.hea"].error
    sig = timeseries.read_signals(spark, str(tmp_path), block=300)
    for name, rows in (("a.edf", x), ("b.vhdr", x), ("c.hea", x), ("d.csv", x[:1])):
        for ch, want in enumerate(rows):
            parts = sig.where(F.col("path").endswith(name) & (F.col("ch") == ch)).orderBy("block").collect()
            assert np.abs(np.concatenate([p.samples for p in parts]) - want).max() < 1e-6
    ds = Dataset.from_folder(spark, str(tmp_path), "demo")
    assert ds.filter(status="completed").recordings.count() == 4
    assert ds.signals(500).select("path").distinct().count() == 4
    assert ds.union(ds).recordings.count() == 10
    ds.auto_domain().save(str(tmp_path / "out"))
    assert Dataset.from_csv(spark, str(tmp_path / "out")).recordings.count() == 5
    assert catalog.scan(spark, str(tmp_path), pattern="*.edf").count() == 1


def test_wfdb_212():
    values = np.array([[1, -2], [2047, -2048], [-1, 0], [5, 7]])
    b = []
    for a, c in values:
        a, c = int(a) & 0xFFF, int(c) & 0xFFF
        b += [a & 255, (a >> 8) | ((c >> 8) << 4), c & 255]
    got = timeseries.parse_wfdb("r 2 100 4\nr.dat 212 1(0) 12 0 0 0 0 A\nr.dat 212 1(0) 12 0 0 0 0 B\n", bytes(b))
    assert np.array_equal(np.array(got["signals"]).T, values)


# ------------------------------------------------------------------------------ streams
def test_streaming(spark, root, tmp_path):
    from sigframe.streaming import windows

    schema = spark.read.parquet(f"{root}/events.parquet").schema
    folder = tmp_path / "in"
    spark.read.parquet(f"{root}/events.parquet").write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    timed = windows.with_event_time(stream, "ts", "1 hour")
    q = windows.tumbling(timed, "ts", "1 day", ["event_type"], "value").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch_form = windows.tumbling(spark.read.parquet(f"{root}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"], "value")
    cols = ["start", "event_type", "n"]
    assert sorted(map(tuple, spark.table("win").select(*cols).collect())) == sorted(map(tuple, batch_form.select(*cols).collect()))
    changed = windows.code_changes(timed.select("user_id", "ts", F.col("event_type").alias("code")), "user_id", "ts", "code")
    q = changed.writeStream.format("memory").queryName("chg").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    e = spark.read.parquet(f"{root}/events.parquet")
    assert spark.table("chg").count() == events.changes(e, "user_id", ["ts", "event_id"], "event_type").count()


def test_greedy_lanes(spark):
    rows = [(i, (i * 37) % 90 + 1) for i in range(300)] + [(300, None), (301, 500)]
    got = store.greedy_parts(spark.createDataFrame(rows, "k long, s long"), "k", "s", 100, lanes=4).collect()
    totals: dict = {}
    for r in got:
        totals.setdefault((r.lane, r.part), []).append(r.s)
    assert len(got) == 302 and all(sum(v) <= 100 or max(v) > 100 for v in totals.values())


def test_resample_operator(spark):
    t = np.arange(200) / 200
    x = np.sin(2 * np.pi * 5 * t) + 3
    df = spark.createDataFrame([(1, 200.0, x.tolist()), (2, 50.0, x[:50].tolist()), (3, None, [1.0]), (4, 200.0, None), (5, 200.0, [])], "id int, fs double, s array<double>")
    got = {r.id: r.s for r in signals.resample(df, "s", "fs", 100.0).collect()}
    u = np.arange(100) / 100
    assert got[1] == pytest.approx(list(np.sin(2 * np.pi * 5 * u) + 3), abs=1e-9) and len(got[2]) == 100
    assert got[3] is None and got[4] is None and got[5] == []
    with pytest.raises(ValueError):
        signals.resample(df, "s", "fs", 0)


def test_filters_read_as_far_as_told(spark):
    x = np.random.default_rng(2).normal(size=240)
    taps = dsp.firwin("bandpass", 20.0, l_freq=2, h_freq=6)
    assert 16 < len(taps) // 2 <= 48
    whole = dsp.fir_with_halo([], x, [], taps, len(taps) // 2)
    df = spark.createDataFrame([(1, b, x[b * 16 : (b + 1) * 16].tolist()) for b in range(15)], "rec int, block int, samples array<double>")
    out = signals.filter_blocks(df, ["rec"], "bandpass", 20.0, l_freq=2, h_freq=6, reach=3).orderBy("block").collect()
    assert np.concatenate([r.samples for r in out]) == pytest.approx(whole, abs=1e-12)
    alone = signals.filter_blocks(df, ["rec"], "bandpass", 20.0, l_freq=2, h_freq=6, reach=0)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_ica_takes_artefacts_out(spark):
    rng = np.random.default_rng(3)
    wave, noise = np.sin(np.arange(2000) / 7), rng.uniform(-1, 1, 2000)
    blink = np.where(np.arange(2000) % 400 < 12, 30.0, 0.0)
    x = np.stack([wave + 0.4 * noise + blink, 0.5 * wave - noise + 0.6 * blink, blink])
    df = spark.createDataFrame([("r", c, v.tolist()) for c, v in enumerate(x)], "rec string, ch int, samples array<double>")
    for how in ({"like": [2]}, {"kurtosis": 10.0}):
        got = {r.ch: r for r in signals.ica_apply(df, ["rec"], **how).collect()}
        assert got[0].removed == 1
        for c, w in ((0, wave + 0.4 * noise), (1, 0.5 * wave - noise)):
            assert abs(np.corrcoef(got[c].samples, w)[0, 1]) > 0.98
    same = {r.ch: r for r in signals.ica_apply(df, ["rec"]).collect()}
    assert same[0].removed == 0 and same[0].samples == pytest.approx(list(x[0]))
    q = signals.ica_quality(df, ["rec"], {2: "eog"}).first()
    assert (q.n_eog, q.n_emg, q.n_ecg) == (1, 0, 0) and q.score == pytest.approx(2 / 3)
    flat = spark.createDataFrame([("f", 0, [0.0] * 50), ("f", 1, [0.0] * 50)], "rec string, ch int, samples array<double>")
    assert signals.ica_quality(flat, ["rec"], {}).first().score is None and signals.ica_apply(flat, ["rec"], like=[1]).count() == 2


def test_ica_of_many_recordings_is_that_of_each(spark):
    """Side by side, every recording gets the bits it gets alone, whatever its rank, keys and place among the batches."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4, 64)) ** 3
    x[3, 2], x[4, 1:], x[5] = x[3, 0], x[4, :1], 0
    keys = [(None if i == 7 else f"r{i % 45}", float("nan") if i == 8 else float(i // 45)) for i in range(90)]
    rows = [(*k, c, v[c].tolist()) for k, v in zip(keys, x, strict=True) for c in range(4)] + [("long", 0.0, c, rng.normal(size=3000).tolist()) for c in range(2)]
    df = spark.createDataFrame(rows, "a string, b double, ch int, samples array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    name = lambda r: (r.a, "nan" if r.b != r.b else r.b)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got, clean, dev = ({(*name(r), r[2]): r for r in o.collect()} for o in (signals.ica(df, ["a", "b"]), *(signals.ica_apply(df, ["a", "b"], kurtosis=5.0, deviation=d) for d in (False, True))))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    many = {int(i): v for at, s in dsp.fast_ica_many(x) for i, v in zip(at, s, strict=True)}
    for i, (a, b) in enumerate(keys):
        alone, k = dsp.fast_ica(x[i]), (a, "nan" if b != b else b)
        assert np.array_equal(many[i], alone) and len(alone) == {3: 3, 4: 1, 5: 0}.get(i, 4)
        assert [got[*k, c].samples for c in range(len(alone))] == alone.tolist() and (*k, len(alone)) not in got
        assert alone @ alone.T / 64 == pytest.approx(np.eye(len(alone)), abs=1e-8)
        removed = int((dsp.excess_kurtosis(alone) > 5).sum()) if len(alone) else 0
        assert [clean[*k, c].removed for c in range(4)] == [removed] * 4 and removed <= len(alone)
        assert [dev[*k, c].std for c in range(4)] == pytest.approx([float(np.std(clean[*k, c].samples)) for c in range(4)])
    assert len(got["long", 0.0, 1].samples) == 3000 and any(r.removed for r in clean.values())


def test_orthogonal_factors_and_tanh():
    rng = np.random.default_rng(6)
    for k in (1, 2, 4, 7, 9):
        w = rng.normal(size=(300, k, k))
        w[0], w[1] = np.eye(k) * 1e-200, w[1] * np.logspace(0, -9, k)[:, None]
        u, _, v = np.linalg.svd(w)
        assert dsp._orthogonal(w)[2:] == pytest.approx((u @ v)[2:], abs=1e-10) and dsp._orthogonal(w)[:2] == pytest.approx((u @ v)[:2], abs=1e-5)
    x = np.concatenate([rng.normal(size=70000) * 4, [0.0, 1e9, -1e9, 19.999, -20.0]])
    assert dsp._tanh(x * dsp._GRID) == pytest.approx(np.tanh(x), abs=1e-15, rel=0)


def test_rank_score_of_a_hot_group(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else None if i % 7 == 0 else "b", float(rng.integers(0, 60)) if i % 11 else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {r.i: r.score for r in quality.rank_score(df, ["g"], "v", "i", cuts=9).collect()}
    assert len(got) == 900
    for g in ("hot", "b", None):
        one = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        for k, r in enumerate(one, 1):
            assert got[r[2]] == (1.0 if k <= math.ceil(len(one) * 0.5) else 0.5 if k <= math.ceil(len(one) * 0.75) else 0.0)


def test_serialisable_and_logged(caplog):
    from datetime import date

    from sigframe.operators import describe

    assert describe.serialisable({"a": np.arange(2), "b": [date(2020, 1, 2), b"x"], 1: None}) == {"a": [0, 1], "b": ["2020-01-02", "x"], "1": None}
    with caplog.at_level("INFO"):
        assert batch.logged(lambda row, k=1: row["x"] + k)({"x": 2}, k=3) == 5
    assert "row {'x': 2}" in caplog.text


def test_extract_events(spark):
    ann = spark.createDataFrame([("a", 5, "go"), ("a", 9, "BAD_x"), ("b", 3, "edge boundary")], "rec_id string, sample long, description string")
    stim = spark.createDataFrame([(r, i, c) for r in "abc" for i, c in enumerate([0, 0, 2, 2, 0, 7])], "rec_id string, sample long, code int")
    of = lambda *a: sorted((r.rec_id, r.sample, r["name"]) for r in events.extract(*a).collect())
    track = lambda r: [(r, 2, "event_2"), (r, 5, "event_7")]
    assert of(ann, stim) == [("a", 5, "go"), *track("b"), *track("c")]
    assert of(ann, stim, "annotations") == [("a", 5, "go")] and of(ann, stim, "stim") == [*track("a"), *track("b"), *track("c")]
    assert of(None, stim) == of(ann, stim, "stim")
    for bad in ((ann, stim, "other"), (None, stim, "annotations"), (None, None)):
        with pytest.raises(ValueError):
            events.extract(*bad)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf"), None])
def test_non_finite_samples_name_their_channel(spark, bad):
    rows = [("varying", v) for v in (1.0, 2.0, bad, 4.0)] + [("constant", 7.0)] * 4
    df = spark.createDataFrame(rows, "ch string, v double")
    with pytest.raises(ValueError, match="varying"):
        signals.require_finite(df, "ch", "v")
    assert signals.require_finite(df.where("ch = 'constant'"), "ch", "v").count() == 4


def test_domains_of_differing_channels(spark):
    df = spark.createDataFrame([("d", 1, "Fz"), ("d", 1, "Cz"), ("d", 2, "Cz"), ("d", 2, "Fz"), ("d", 2, "Fz"), ("e", 3, "Oz")], "domain string, rec int, ch string")
    assert signals.require_same_channels(df, "domain", "rec", "ch").count() == 6
    with pytest.raises(ValueError, match="'d'"):
        signals.require_same_channels(df.where("not (rec = 2 and ch = 'Cz')"), "domain", "rec", "ch")


def test_dominant_frequency_operator(spark):
    t = np.arange(100) / 100
    rows = [(1, 100.0, np.sin(2 * np.pi * 7 * t).tolist()), (2, 50.0, (5 + np.sin(2 * np.pi * 7 * t)).tolist()), (3, 100.0, [2.0] * 10), (4, None, [1.0, 2.0]), (5, 100.0, []), (6, 100.0, None)]
    df = spark.createDataFrame(rows, "id int, fs double, s array<double>")
    got = {r.id: r.frequency for r in signals.dominant_frequency(df, "s", "fs").collect()}
    assert got[1] == pytest.approx(7) and got[2] == pytest.approx(3.5) and got[3] == 0 and got[4] is None and got[5] is None and got[6] is None
