import math

import numpy as np
from pyspark.sql import functions as F

from sigframe.operators import spikes

EPOCHS = "epoch_id long, source_id int, epoch_data array<array<float>>, mask string"


def _sources(spark, masks):
    s = spark.createDataFrame([(i, m) for i, m in masks.items()], "source_id int, channel_mask_id int")
    m = spark.createDataFrame([(0, [1, 1]), (1, [1, 0])], "mask_id int, mask array<tinyint>")
    return s, m


def _noise(rng, n=64, scale=10.0):
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = 0.8 * x[t - 1] + rng.normal()
    return np.round(x * scale * 0.6 * 4) / 4


def test_planted_cases(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for e in range(240):
        d = [_noise(rng), _noise(rng, scale=1000.0)]
        kind = e % 12
        if kind == 1:
            d[0][20] += 160
            want[(e, 0)] = "n_spike"
        elif kind == 2:
            d[1][10:40] = d[1][10]
            want[(e, 1)] = "n_stuck"
        elif kind == 3:
            d[0][5] = 3e38
            want[(e, 0)] = "n_impossible"
        elif kind == 4:
            d[1][63] = math.nan
            want[(e, 1)] = "n_impossible"
        elif kind == 5:
            d[0][0] = -math.inf
            want[(e, 0)] = "n_impossible"
        x = [[None if (kind == 6 and i == 3) else float(v) for i, v in enumerate(c)] for c in d]
        rows.append((e, e % 3, x, "extra"))
    df = spark.createDataFrame(rows, EPOCHS)
    s, m = _sources(spark, {0: 0, 1: 0, 2: 0})
    got = {(r.epoch_id, r.ch): r for r in spikes.flag_epochs(df, s, m).where("n_spike + n_stuck + n_impossible > 0").collect()}
    assert set(got) == set(want)
    assert all(got[k][v] > 0 for k, v in want.items())


def test_spikes_that_only_the_autoregression_finds(spark):
    """Within the usual range of a slow wave, but far from its neighbours; without the autoregression they are not found."""
    rng = np.random.default_rng(15)
    rows, planted = [], {7, 19, 33, 58}
    for e in range(60):
        x = np.zeros(96)
        x[0] = rng.normal() * 30
        for t in range(1, 96):
            x[t] = 0.995 * x[t - 1] + rng.normal() * 3
        if e in planted:
            x[50] += -45 if x[50] > 0 else 45  # back towards the middle
        rows.append((e, 1, [x.tolist()], "x"))
    df = spark.createDataFrame(rows, EPOCHS)
    s, m = _sources(spark, {1: 0})
    models = spikes.source_models(df)
    found = lambda model: {r.epoch_id for r in spikes.flag_epochs(df, s, m, model).where("n_spike > 0").collect()}
    assert found(models) == planted
    assert not found(models.withColumns({"phi1": F.lit(0.0), "phi2": F.lit(0.0)})) & planted


def test_broadcast_or_not_the_same(spark):
    rng = np.random.default_rng(16)
    rows = [(e, e % 4, [(_noise(rng) + (200 * (np.arange(64) == 9) if e % 5 == 0 else 0)).tolist()], "x") for e in range(80)]
    df = spark.createDataFrame(rows, EPOCHS)
    s, m = _sources(spark, {0: 0, 1: 0, 2: 0})
    a, b = (sorted(map(tuple, spikes.flag_epochs(df, s, m, broadcast_sources=n).collect())) for n in (100, 0))
    assert a == b and len(a) == 16


def test_stuck_runs_do_not_depend_on_the_number_of_epochs(spark):
    rng = np.random.default_rng(17)
    held = _noise(rng)
    held[20:30] = held[20]
    few = [(0, 0, [held.tolist()], "x"), *((i, 0, [_noise(rng).tolist()], "x") for i in range(1, 12))]
    s, m = _sources(spark, {0: 0})
    model = spikes.source_models(spark.createDataFrame(few, EPOCHS)).withColumn("n", F.col("n") * 10**9)
    assert [r.epoch_id for r in spikes.flag_epochs(spark.createDataFrame(few, EPOCHS), s, m, model).where("n_stuck > 0").collect()] == [0]


def test_given_physical_limits(spark):
    rng = np.random.default_rng(18)
    rows = [(e, e % 2, [_noise(rng).tolist(), _noise(rng).tolist()], "x") for e in range(20)]
    rows[4][2][0][10] = 75.0
    df = spark.createDataFrame(rows, EPOCHS)
    s, m = _sources(spark, {0: 0, 1: 0})
    limits = spark.createDataFrame([(0, 0, -70.0, 70.0), (1, 1, None, 1e9)], "source_id int, channel int, low double, high double")
    got = {(r.epoch_id, r.ch): r.n_impossible for r in spikes.flag_epochs(df, s, m, limits=limits).collect() if r.n_impossible}
    assert got[4, 0] == 1 and all(abs(np.array(rows[e][2][c])).max() > 70 for e, c in got)


def test_masks_nulls_and_shapes(spark):
    rng = np.random.default_rng(6)
    flat = [0.0] * 64
    rows = [(i, 7, [_noise(rng).tolist(), flat], "x") for i in range(6)]
    rows += [(100, 8, [flat, _noise(rng).tolist()], "x"), (101, 9, None, "x"), (102, 9, [], "x"), (103, 9, [[], None], "x"), (104, None, [_noise(rng, 10).tolist()], "x"), (5, 7, rows[5][2], "x")]
    df = spark.createDataFrame(rows, EPOCHS)
    s, m = _sources(spark, {7: 1, 8: 0})
    got = {(r.epoch_id, r.ch, r.n_stuck) for r in spikes.flag_epochs(df, s, m).collect()}
    assert got == {(100, 0, 64)}  # the masked channel of source 7 is no case, the dead one of source 8 is
    assert spikes.flag_epochs(df, s.unionByName(s), m.unionByName(m)).count() == 1  # repeated dimension rows add nothing
    assert spikes.flag_epochs(df.limit(0), s, m).count() == 0


def test_outliers_and_level_shifts():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3, 64))
    x[0, 30] += 40
    x[1, 30:] += 30
    ao, ls = spikes.outlier_scores(x, np.ones_like(x, bool), np.zeros((3, 2)), np.ones(3))
    assert ao[0].nonzero()[0].tolist() == [30] and not ls[0].any()
    assert ls[1].nonzero()[0].tolist() == [30] and not ao[1].any()
    assert not ao[2].any() and not ls[2].any()


def test_runs_against_brute_force():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, size=(20, 30)).astype(float)
    ok = rng.random((20, 30)) > 0.1
    got = spikes._runs(x, ok)
    for r in range(20):
        for t in range(30):
            a = b = t
            while a > 0 and ok[r, a] and ok[r, a - 1] and x[r, a] == x[r, a - 1]:
                a -= 1
            while b < 29 and ok[r, b] and ok[r, b + 1] and x[r, b] == x[r, b + 1]:
                b += 1
            assert got[r, t] == b - a + 1


def test_rates(spark):
    rates = ["256.0"] * 20 + ["512,0"] * 4 + ["0.256 kHz", "2.560e+02", "25600", "-256.0", "0", "nan", None, "1e+09Hz", "fast", "2.56"]
    loc = spark.createDataFrame([(i, "/x/demo-study/S001/S001R01.edf", "demo study", r) for i, r in enumerate(rates)], "loc_id long, file_path string, domain_tag string, sampling_rate string")
    s = spark.createDataFrame([("demo-study",)], "domain_tag string")
    got = {r.loc_id for r in spikes.flag_rates(loc, s).collect()}
    assert {rates[i] for i in got} == {"25600", "-256.0", "0", "1e+09Hz", "2.56"}
    other = loc.selectExpr("loc_id", "cast(null as string) as file_path", "'not_specified' as domain_tag", "'20000' as sampling_rate").limit(1)
    assert spikes.flag_rates(loc.unionByName(other), s).count() == 6
    assert spikes.flag_rates(loc.limit(0), s).count() == 0
