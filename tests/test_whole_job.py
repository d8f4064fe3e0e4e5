"""Queries over planted tables whose results are recounted by brute force."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from sigframe.functions import dsp
from sigframe.operators import quality

QUERIES = entry.queries()
EPOCHS = "epoch_id bigint, source_id int, epoch_data array<array<float>>"


def _epochs(spark, folder, rows):
    spark.createDataFrame(rows, EPOCHS).coalesce(1).write.parquet(f"{folder}/epochs.parquet")


@pytest.fixture(scope="module")
def extreme(spark, tmp_path_factory):
    """Two sources, one wholly beyond 1e6, the other with a few such samples, absent ones and non-finite ones."""
    folder = str(tmp_path_factory.mktemp("extreme"))
    rng = np.random.default_rng(3)
    wave = lambda scale: [[float(np.float32(v)) for v in ch] for ch in rng.normal(size=(4, 64)) * scale]
    mixed = wave(10)
    mixed[0][5], mixed[1][6], mixed[2][7] = 4194304.0, float(np.float32(-3e38)), 1e6
    mixed[3][8], mixed[3][9], mixed[3][10] = None, math.nan, math.inf
    rows = [(1, 0, mixed), (2, 1, [[v + 2e7 for v in ch] for ch in wave(4e6)])]
    _epochs(spark, folder, rows)
    spark.createDataFrame([(0, {"site": "a"}), (1, {"site": "a"})], "source_id int, info map<string,string>").coalesce(1).write.parquet(f"{folder}/sources.parquet")
    finite = {(s, c): np.array([np.float32(v) for v in ch if v is not None and math.isfinite(v)], float) for _, s, d in rows for c, ch in enumerate(d)}
    return folder, finite


def test_moments_hold_every_finite_sample(spark, extreme):
    folder, finite = extreme
    got = {(r.source_id, r.ch): r for r in QUERIES["mean_std_channel"](spark, folder).collect()}
    assert got.keys() == finite.keys()
    for k, x in finite.items():
        assert got[k].n == len(x)
        assert (got[k].mean, got[k].std) == (pytest.approx(x.mean(), rel=1e-9, abs=1e-6), pytest.approx(x.std(), rel=1e-9, abs=1e-6))
    per = {r.source_id: r for r in QUERIES["mean_std_recording"](spark, folder).collect()}
    assert {s: r.n for s, r in per.items()} == {0: 253, 1: 256}
    domain = {r.ch: r for r in QUERIES["mean_std_domain"](spark, folder).collect()}
    for c in range(4):
        assert domain[c].recordings == 2
        assert domain[c]["mean"] == pytest.approx((finite[0, c].mean() + finite[1, c].mean()) / 2, rel=1e-9, abs=1e-6)
    assert QUERIES["domain_mean_std_join"](spark, folder).count() == 8


def test_scores_and_units_hold_every_finite_sample(spark, extreme):
    folder, finite = extreme
    got = {(r.source_id, r.ch): r for r in QUERIES["normalize_channel"](spark, folder).collect()}
    for k, x in finite.items():
        z = (x - x.mean()) / x.std()
        assert (got[k].n, got[k].highest, got[k].lowest) == (len(x), pytest.approx(z.max(), abs=2e-5), pytest.approx(z.min(), abs=2e-5))
    assert {r.source_id: r.n for r in QUERIES["normalize_sample"](spark, folder).collect()} == {0: 253, 1: 256}
    assert sum(r.n for r in QUERIES["zscore_constant_safe"](spark, folder).collect()) == 509
    assert QUERIES["infer_units"](spark, folder).count() == 8


def test_data_hash_tells_true_samples_apart(spark, tmp_path):
    base = [[float(i) for i in range(64)] for _ in range(4)]
    rows = [(0, 0, base), (1, 0, base)]
    for k, v in enumerate([0.0, None, math.nan, math.inf, -math.inf, 1e6, 4194304.0]):
        other = [list(ch) for ch in base]
        other[2][3] = v
        rows.append((k + 2, 0, other))
    _epochs(spark, str(tmp_path), rows)
    got = {r.epoch_id: r.data_hash for r in QUERIES["data_hash"](spark, str(tmp_path)).collect()}
    assert got[0] == got[1] and None not in got.values()
    assert len(set(got.values())) == 8


def test_components_of_other_channels_outlast_an_extreme_one():
    x = np.random.default_rng(5).normal(size=(4, 64))
    x[1, 7] = 3e38
    assert len(dsp.fast_ica(x)) == 4


def _unrest(s):
    """1 - cos of the rotation that would make the contrast of components stationary, to first order."""
    g = np.tanh(s)
    m = g @ s.T / s.shape[1]
    own = np.diag(m) - (1 - (g * g).mean(axis=1))
    m = np.where(own < 0, -1, 1)[:, None] * m
    return (((m - m.T) / (abs(own)[:, None] + abs(own))) ** 2).sum(axis=1).max() / 2


def test_components_of_every_recording_converge():
    """Short recordings of noise, of which plain updates leave two in five going round in circles."""
    x = np.random.default_rng(7).normal(size=(400, 4, 64))
    ((at, s),) = dsp.fast_ica_many(x)
    assert at.tolist() == list(range(400)) and max(map(_unrest, s)) < 2e-4
    moved = dsp.fast_ica_many(x * (1 + 1e-15 * np.sign(x[::-1])))[0][1]  # nor does the outcome hang on the last bits
    assert np.mean(np.abs(moved - s).max(axis=(1, 2)) > 1e-3) < 0.05


def test_components_are_given_with_their_samples(spark, tmp_path):
    rng = np.random.default_rng(9)
    data = {i: np.float32(rng.normal(size=(4, 64)) * 10).astype(float) for i in range(30)}
    data[4][2], data[5][:], data[6][1, 3] = data[4][0], 0, 3e30
    _epochs(spark, str(tmp_path), [(i, 0, x.tolist()) for i, x in data.items()])
    got = {}
    for r in QUERIES["ica_components"](spark, str(tmp_path)).orderBy("epoch_id", "component").collect():
        assert r.n == len(r.samples) == 64 and r.component == len(got.setdefault(r.epoch_id, []))
        got[r.epoch_id].append(r.samples)
    assert {i: len(s) for i, s in got.items()} == {i: 3 if i == 4 else 4 for i in data if i != 5}
    for i, s in got.items():
        s, x = np.array(s), (data[i] - data[i].mean(axis=1, keepdims=True)) / data[i].std(axis=1, keepdims=True)
        assert s @ s.T / 64 == pytest.approx(np.eye(len(s)), abs=1e-8) and _unrest(s) < 2e-4
        assert dsp.mixing(x, s) @ s == pytest.approx(x, abs=1e-8)  # the channels are wholly made of them


@pytest.fixture(scope="module")
def two_rates(spark, tmp_path_factory):
    """The same 10 Hz wave recorded at 128 and at 256 Hz, and a source without rate."""
    folder = str(tmp_path_factory.mktemp("rates"))
    wave = lambda fs: [[float(np.float32((c + 1) * 5 * math.sin(2 * math.pi * 10 * i / fs))) for i in range(64)] for c in range(4)]
    rows = [(1, 0, wave(128)), (2, 1, wave(256)), (3, 2, wave(128))]
    _epochs(spark, folder, rows)
    spark.createDataFrame([(0, 128.0), (1, 256.0), (2, None)], "source_id int, sfreq double").coalesce(1).write.parquet(f"{folder}/sources.parquet")
    spark.createDataFrame([(i, n, "eeg") for i, n in enumerate(["C3", "C4", "P3", "P4"])], "ordinal int, name string, type string").coalesce(1).write.parquet(f"{folder}/channels.parquet")
    return folder, {e: (np.array(d, np.float32).astype(float), {1: 128.0, 2: 256.0, 3: None}[e]) for e, _, d in rows}


def test_spectra_are_at_the_rate_of_each_source(spark, two_rates):
    folder, data = two_rates
    got = {(r.epoch_id, r.ch): r for r in QUERIES["psd_bands"](spark, folder).collect()}
    assert len(got) == 12
    for (e, c), r in got.items():
        x, fs = data[e]
        if fs is None:
            assert r.alpha is None
            continue
        assert r.alpha > max(r.theta, r.beta)
        f, p = dsp.welch(x[c], fs, 64, nfft=2048)
        assert r.alpha == pytest.approx(p[0, (f >= 8) & (f < 13)].mean())
    mean = {(r.ch, r.bin): r for r in QUERIES["psd_mean"](spark, folder).collect()}
    assert {b for _, b in mean} == set(range(33)) and {r.n for r in mean.values()} == {2}
    for c in range(4):
        want = (dsp.welch(data[1][0][c], 128.0, 64)[1][0] + dsp.welch(dsp.resample(data[2][0][c], 32), 128.0, 64, nfft=64)[1][0]) / 2
        assert [mean[c, b].density for b in range(33)] == pytest.approx(list(want))
        assert max(range(33), key=lambda b: mean[c, b].density) == 5


def test_band_pass_is_at_the_rate_of_each_source(spark, two_rates):
    folder, data = two_rates
    for r in QUERIES["butterworth_filter"](spark, folder).collect():
        x, fs = data[r.epoch_id]
        want = None if fs is None else pytest.approx(dsp.butter_bandpass_filter(x[r.ch], 8, 13, fs).std(), abs=2e-6)
        assert r["std"] == want


def test_quality_counts_symmetry_where_all_channels_are_classified(spark, tmp_path):
    rng = np.random.default_rng(11)
    data = np.float32(np.cumsum(rng.normal(size=(4, 64)) * 20, axis=1)).astype(float)
    _epochs(spark, str(tmp_path), [(1, 0, data.tolist())])
    spark.createDataFrame([(0, 128.0)], "source_id int, sfreq double").coalesce(1).write.parquet(f"{tmp_path}/sources.parquet")
    x, fs = data, 128.0
    beta, theta, alpha = (dsp.butter_bandpass_filter(x, a, b, fs) for a, b in ((12, 30), (4, 8), (8, 12)))
    high = np.where(np.abs(beta) > 0.01 * np.abs(beta).max(axis=1, keepdims=True), np.abs(beta), 0).sum(axis=1) / np.abs(beta).sum(axis=1)
    within = ((x >= -1000) & (x <= 1000)).sum(axis=1)
    four = [np.mean(100 * ((x >= -100) & (x < 110)).sum(axis=1) / within), 100 * np.mean(np.abs(beta) <= 20), 100 * high.mean(), 100 * np.mean(theta <= 30)]
    freq = dsp.dominant_frequency(alpha, fs)
    for names, more in (
        (["C3", "C4", "P3", "P4"], [quality.symmetry_score(alpha[[0, 2]], alpha[[1, 3]], fs)] if freq[0] != freq[2] and freq[1] != freq[3] else []),
        (["C3", "C4", "Cz", "Pz"], [50.0]),
        (["C3", "C4", "X1", "P4"], []),
    ):
        spark.createDataFrame([(i, n, "eeg") for i, n in enumerate(names)], "ordinal int, name string, type string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/channels.parquet")
        got = QUERIES["quality_shady"](spark, str(tmp_path)).first()
        assert got.channels == 4 and got.score == pytest.approx(np.mean(four + more), abs=1e-3)


def test_report_rate_counts_every_recording(spark, root):
    total = spark.read.parquet(f"{root}/locator.parquet").count()
    rows = QUERIES["report_rate"](spark, root).where("domain is null").collect()
    assert sum(r.n for r in rows) == total
    assert any(r.rate is None for r in rows)
    assert all(r.percent == pytest.approx(100 * r.n / total, abs=0.0051) for r in rows)
