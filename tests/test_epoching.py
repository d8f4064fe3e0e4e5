"""Windows, epochs and stores against NumPy, on the fixtures of SURVEY 5."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.operators import epoching, store

CHANNELS = [(0, "C3", "eeg"), (1, "C4", "eeg"), (2, "P3", "eeg"), (3, "P4", "eeg")]


def _signals(spark, data, size, rec="r"):
    rows = [(rec, c, b, b * size, [float(v) for v in x[b * size : (b + 1) * size]]) for c, x in enumerate(data) for b in range(math.ceil(len(x) / size))]
    return spark.createDataFrame(rows, "rec_id string, ch int, block int, start long, samples array<double>")


def _recordings(spark, rows):
    return spark.createDataFrame(rows, "rec_id string, file_path string, name string, sfreq double, mask array<tinyint>, info map<string,string>")


def test_segments_into_a_store(spark, tmp_path):
    """Two channels of 1,200 samples at 200 Hz, segments of one second: six epochs."""
    x = np.random.default_rng(7).normal(size=(2, 1200)).astype("float32")
    rec = spark.createDataFrame([("r", 1200, 200.0), ("short", 100, 200.0), ("norate", 1200, None)], "rec_id string, n_samples long, sfreq double")
    windows = epoching.windows_for("segment", recordings=rec, seconds=1.0, overlap=0.0)
    epochs = epoching.cut_epochs(_signals(spark, x, 130), windows, 130)
    tables = epoching.store_tables(epochs, _recordings(spark, [("r", "/raw/pilot.edf", "pilot", 200.0, [1, 1], {"age": "31", "sex": "F", "site": "pilot-site"})]), spark.createDataFrame(CHANNELS[:2], "ordinal int, name string, type string"))
    store.write_store(tables, str(tmp_path / "s"))
    t = store.EpochStore(spark, str(tmp_path / "s")).tables
    rows = t["epochs"].orderBy("epoch_id").collect()
    assert [r.source_start_sample for r in rows] == [0, 200, 400, 600, 800, 1000] and [r.source_epoch_index for r in rows] == list(range(6))
    assert all(np.array_equal(np.array(r.epoch_data, "float32"), x[:, i * 200 : (i + 1) * 200]) for i, r in enumerate(rows))
    assert t["sources"].first().info["site"] == "pilot-site" and t["sources"].first().n_epochs == 6


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_windows_do_not_depend_on_blocks(spark, size):
    x = np.arange(600, dtype=float).reshape(2, 300)
    w = spark.createDataFrame([("r", s, n, "e") for s, n in [(0, 300), (5, 20), (5, 20), (293, 7), (294, 7), (-1, 5), (63, 2)]] + [("other", 0, 5, "e")], "rec_id string, start long, length long, name string")
    got = sorted((r.start, np.array(r.epoch_data).tolist()) for r in epoching.cut_epochs(_signals(spark, x, size), w, size).collect())
    assert got == sorted((s, x[:, s : s + n].tolist()) for s, n in [(0, 300), (5, 20), (5, 20), (293, 7), (63, 2)])
    based = epoching.cut_epochs(_signals(spark, x, size), w.where("start = 5"), size, baseline=(0, 4)).first().epoch_data
    assert based[0][:3] == [-2.0, -1.0, 0.0]


def test_event_windows(spark):
    e = spark.createDataFrame([("r", 10, "b"), ("r", 10, "a"), ("r", 30, "c"), ("r", None, "a"), ("r", 5, None)], "rec_id string, sample long, name string")
    of = lambda **k: sorted((r.start, r.length, r["name"]) for r in epoching.event_windows(e, 2, 5, **k).collect())
    assert of() == [(8, 8, "a"), (8, 8, "b"), (28, 8, "c")] and of(names=["c"]) == [(28, 8, "c")]
    assert of(repeated="drop") == [(8, 8, "a"), (28, 8, "c")] and of(repeated="merge") == [(8, 8, "a/b"), (28, 8, "c")]
    with pytest.raises(ValueError, match="several"):
        of(repeated="error")
    long = spark.createDataFrame([("r", 100, 25, "task"), ("r", 0, 9, "short")], "rec_id string, first long, length long, description string")
    assert sorted(r.start for r in epoching.windows_for("long_event", annotations=long, width=10, overlap=0.5).collect()) == [100, 105, 110, 115]
    for bad in ({"kind": "long_event", "annotations": long, "width": 10, "overlap": None}, {"kind": "other"}, {"kind": "segment", "recordings": e, "seconds": 0.0, "overlap": 0.0}):
        with pytest.raises(ValueError):
            epoching.windows_for(**bad)


def test_sources_labels_and_versions(spark, tmp_path):
    """Three blocks of two sources with equal names, a score that one block lacks, and two labels."""
    rng = np.random.default_rng(42)
    data = rng.normal(size=(6, 4, 24)).astype("float32")
    rows = [(r, s, n, data[i].tolist(), {"score": float(np.float32(sc))} if sc is not None else None, {"run": run}) for i, (r, s, n, sc, run) in enumerate(
        [("a", 0, "left", 0.1, "1"), ("a", 800, "left", 0.2, "1"), ("a", 1600, "left", 0.3, "1"), ("a", 2400, "right", None, "2"), ("a", 3200, "right", None, "2"), ("b", 0, "left", 0.8, "1")])]
    e = spark.createDataFrame(rows, "rec_id string, start long, name string, epoch_data array<array<float>>, misc map<string,float>, meta map<string,string>")
    rec = _recordings(spark, [("a", "/raw/site-a/recording.edf", "recording", 200.0, [1, 1, 1, 0], {"age": "21"}), ("b", "/raw/site-b/recording.edf", "recording", 200.0, [1, 1, 1, 1], {"age": "29"}), ("unused", "/x", "x", 1.0, None, None)])
    ch = spark.createDataFrame(CHANNELS, "ordinal int, name string, type string")
    t = epoching.store_tables(e, rec, ch)
    src = {r.file_path: r for r in t["sources"].collect()}
    assert len(src) == 2 and len({r.uid for r in src.values()}) == 2 and src["/raw/site-a/recording.edf"].n_epochs == 5
    got = {(r.source_id, r.source_start_sample): r for r in t["epochs"].collect()}
    a, b = src["/raw/site-a/recording.edf"].source_id, src["/raw/site-b/recording.edf"].source_id
    assert [got[a, s].source_epoch_index for s in (0, 800, 1600, 2400, 3200)] == [0, 1, 2, 3, 4] and got[b, 0].source_epoch_index == 0
    assert got[a, 2400].misc is None and got[b, 0].misc["score"] == pytest.approx(0.8) and got[a, 0].meta["run"] == "1"
    assert sorted(r["name"] for r in t["event_labels"].collect()) == ["left", "right"] and t["channel_masks"].count() == 2
    assert sorted(r.epoch_id for r in got.values()) == list(range(6))
    store.write_store(t, str(tmp_path / "v"))
    one = store.EpochStore(spark, str(tmp_path / "v")).read_epochs([got[a, 0].epoch_id], ["P4", "C3"], 8, 16).first().data
    assert np.array_equal(np.array(one, "float32"), data[0][[3, 0], 8:16])
    with pytest.warns(FutureWarning):
        flat = epoching.store_tables(e, rec, ch, version="v2")["epochs_flat"]
    assert {r.source for r in flat.collect()} == set(src)
    with pytest.raises(ValueError, match="version"):
        epoching.store_tables(e, rec, ch, version="v9")


@pytest.mark.parametrize(("change", "message"), [("nan", "Non-finite"), ("null", "Non-finite"), ("zero", "All-zero"), ("shape", "shapes")])
def test_a_store_refuses_bad_epochs(spark, tmp_path, change, message):
    good = [[1.0] * 8, [2.0] * 8]
    bad = {"nan": [[math.nan] + [1.0] * 7, [2.0] * 8], "null": [[None] + [1.0] * 7, [2.0] * 8], "zero": [[0.0] * 8] * 2, "shape": [[1.0] * 7] * 2}[change]
    rows = [("a", 0, "x", good), ("b", 0, "x", bad)]
    e = spark.createDataFrame(rows, "rec_id string, start long, name string, epoch_data array<array<float>>")
    rec = _recordings(spark, [(r, f"/{r}", r, 1.0, [1, 1], None) for r in "ab"])
    tables = epoching.store_tables(e, rec, spark.createDataFrame(CHANNELS[:2], "ordinal int, name string, type string"))
    with pytest.raises(ValueError, match=message):
        store.write_store(tables, str(tmp_path / "s"))
    assert os.listdir(tmp_path) == []
    store.write_store(tables, str(tmp_path / "s"), validate=False)
    assert store.EpochStore(spark, str(tmp_path / "s")).tables["epochs"].count() == 2
    kept = epoching.store_tables(e, rec, spark.createDataFrame(CHANNELS[:2], "ordinal int, name string, type string"), drop_invalid=True)
    assert kept["epochs"].count() == (2 if change == "shape" else 1)


def test_export_by_recording(spark, tmp_path):
    wide = spark.createDataFrame([(r, s, float(s), None if s else "go") for r in (1, 2, 3) for s in range(50)], "rec_id int, sample long, C3 double, marker string")
    cat = spark.createDataFrame([(1, "/a/x.edf", "d", "edf"), (2, "/b/x.edf", "d", "edf"), (3, None, "d", "edf"), (4, "/c/empty.edf", "d", "edf")], "rec_id int, path string, domain string, file_type string")
    with pytest.raises(FileNotFoundError):
        epoching.export_recordings(wide, cat, str(tmp_path / "absent"))
    (tmp_path / "out").mkdir()
    new = {r.rec_id: r for r in epoching.export_recordings(wide, cat, str(tmp_path / "out")).collect()}
    names = {i: r.path.rsplit("=", 1)[1] for i, r in new.items()}
    assert names == {1: "x", 2: "x(1)", 3: "recording"} and new[1].file_type == "csvData"
    back = spark.read.option("header", True).csv(new[2].path)
    assert back.count() == 50 and back.where("marker = 'go'").count() == 1
    again = {r.rec_id: r.path.rsplit("=", 1)[1] for r in epoching.export_recordings(wide, cat, str(tmp_path / "out"), "parquet").collect()}
    assert again[1] == "x(2)" and again[2] == "x(3)" and again[3] == "recording(1)"
    with pytest.raises(ValueError):
        epoching.export_recordings(wide, cat, str(tmp_path / "out"), "fif")


def test_wide_export_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0]], "e"), (2, None, "e"), (3, [], None)], "id int, d array<array<float>>, ev string")
    out = store.wide_export(df, "id", "d", ["a", "b"], "ev")
    assert sorted(map(tuple, out.collect())) == [(1, 0, 1.0, 3.0, "e"), (1, 1, 2.0, None, None)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_export_npy(spark, tmp_path):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, None), (3, [[1.0], [1.0, 2.0]]), (4, [])], "epoch_id long, epoch_data array<array<float>>")
    got = {r.epoch_id: (r.path, r.shape) for r in epoching.export_npy(df, str(tmp_path / "npy")).collect()}
    assert got[1] == (str(tmp_path / "npy" / "1.npy"), "(2, 2)") and got[2] == got[3] == got[4] == (None, None)
    assert np.array_equal(np.load(got[1][0]), np.array([[1, 2], [3, 4]], "float32")) and os.listdir(tmp_path / "npy") == ["1.npy"]
