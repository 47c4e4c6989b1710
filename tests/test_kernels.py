"""Kernels against closed forms and slow definitions."""

import math

import numpy as np
import pandas as pd
import pytest

from motionloom.operators import kernels as K
from motionloom.operators import stats
from motionloom.sources import frames


def test_filter():
    b, a = K.butterworth(4, 6, 50)
    at = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 50)) / np.polyval(a, np.exp(2j * np.pi * f / 50)))
    assert at(0) == pytest.approx(1) and at(6) == pytest.approx(math.sqrt(0.5))
    assert np.allclose(K.zero_phase(np.full(60, 3.0), 6, 50), 3)
    x = np.cumsum(np.random.default_rng(0).normal(size=(900, 2)), axis=0)
    y, z = K.zero_phase(x, 6, 50), K.zero_phase(x[::-1], 6, 50)[::-1]
    assert np.allclose(y[300:600], z[300:600], atol=1e-6)
    short = np.arange(15.0)
    assert (K.zero_phase(short, 6, 50) == short).all()
    x[5, 0] = np.nan
    assert np.isnan(K.zero_phase(x, 6, 50)[5, 0]) and np.array_equal(K.zero_phase(x, 6, 50)[6:, 0], x[6:, 0])


def test_sparc_by_explicit_sums():
    v, fs = np.abs(np.sin(np.arange(100) / 9)), 50.0
    n = int(2 ** math.ceil(math.log2(100)) + 4)
    assert n == 132
    m = [abs(sum(x * complex(math.cos(2 * math.pi * k * i / n), -math.sin(2 * math.pi * k * i / n)) for i, x in enumerate(v))) for k in range(n)]
    m, f = [x / max(m) for x in m], [k * fs / n for k in range(n)]
    keep = [k for k in range(n) if f[k] <= 10]
    up = [k for k in keep if m[k] >= 0.05]
    r = range(up[0], up[-1])
    want = -sum(math.hypot((f[k + 1] - f[k]) / (f[up[-1]] - f[up[0]]), m[k + 1] - m[k]) for k in r)
    assert K.sparc(v, fs) == pytest.approx(want, rel=1e-9)
    assert K.sparc(np.zeros(50), fs) is None


def test_peaks_and_strokes():
    assert K.peaks(np.array([0, 1, 0, 2, 2, 2, 0, 1, 0.0]), 1).tolist() == [1, 4, 7]
    assert K.peaks(np.array([0, 1, 0, 3, 0, 2, 0.0]), 3).tolist() == [3]
    v = np.abs(np.sin(np.arange(200) * np.pi / 50))
    assert [z - a for a, z in K.strokes(v, 50.0)][:2] == [50, 50]
    t = np.arange(60) / 50
    assert K.log_jerk(t * (1.2 - t), 50) == pytest.approx(-math.log((60 / 50) ** 3 * (58 * 4 / 50) / max(t * (1.2 - t)) ** 2))


def test_tails():
    assert stats.f_tail(4.0, 1, 1e7) == pytest.approx(0.0455003, abs=1e-5)
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_tail(0.0, 20) == pytest.approx(1)
    assert stats.t_tail(0.9999999, 5) < 1e-6


def test_mutual_information_matches_definition():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 120)
    x = y * 1.5 + rng.normal(size=120)
    h = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    s = x / x.std()
    m = []
    for i in range(120):
        d = np.sort(np.abs(s[(y == y[i]) & (np.arange(120) != i)] - s[i]))[2]
        m.append(h(int((np.abs(s - s[i]) < d).sum())))
    want = h(120) + h(3) - np.mean([h(int((y == y[i]).sum())) for i in range(120)]) - np.mean(m)
    assert K.mutual_information(x, y) == pytest.approx(want, abs=0.02)
    assert K.mutual_information(rng.normal(size=200), np.zeros(200)) == pytest.approx(0, abs=0.05)


@pytest.mark.parametrize("kind", ["gru", "lstm"])
def test_recurrent_gradients(kind):
    rng = np.random.default_rng(0)
    net = K.Recurrent(3, 2, kind, hidden=4, layers=2, dropout=0.0)
    x, lens = K.padded([rng.normal(size=(n, 3)) for n in (6, 4)])
    y, w = np.array([0, 1]), np.array([1.0, 2.0])
    _, g = net.gradients(x, lens, y, w)
    for k in g:
        i = tuple(rng.integers(0, n) for n in net.p[k].shape)
        was = net.p[k][i]
        loss = []
        for d in (1e-5, -1e-5):
            net.p[k][i] = was + d
            loss.append(net.gradients(x, lens, y, w)[0])
        net.p[k][i] = was
        assert g[k][i] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_gap_fill_is_pandas(spark):
    from motionloom.operators import windows as W

    v = [None, None, 1.0, None, None, None, 3.0, *[None] * 12, 8.0, *[None] * 7]
    got = W.gap_filled(spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k int, i int, v double"), ["k"], "i", "v").orderBy("i").toPandas()["filled"]
    pd.testing.assert_series_equal(got, pd.Series(v, dtype=float).interpolate(limit=5, limit_direction="both"), check_names=False)


def test_guards(spark):
    from motionloom.operators import joins, learn

    one = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError):
        joins.many_to_one(one, one, ["k"])
    with pytest.raises(ValueError):
        learn.require_one_label(one, "k", "v")
    with pytest.raises(ValueError):
        joins.require_disjoint(one, one, "rows")
    with pytest.raises(ValueError):
        learn.clipped_splits(one, "v", 5)
    with pytest.raises(ValueError):
        joins.merged_block_features(spark.createDataFrame([("p", "c", 1)], "participant_id string, condition string, block int"), {"one": one})


def test_trial_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "P001_play_2_clean.csv").write_text(" time_s ,Hip Angles (deg),Hip Angles (deg),Annotations,(x)\n0.0,1,2,n,1\n0.02,bad,3,n,1\n")
    (tmp_path / "odd.csv").write_text("time_s,Hip Angles (deg)\n0.0,1\n")
    df = frames.read_trials(spark, str(tmp_path))
    good, bad = frames.trial_keys(df)
    rows = good.orderBy("time_s").collect()
    assert [(r["participant_id"], r["condition"], r["block"], r["Hip Angles (deg)"], r["Hip Angles (deg).1"]) for r in rows] == [("P001", "play", 2, 1.0, 2.0), ("P001", "play", 2, None, 3.0)]
    assert bad.count() == 1 and frames.signal_columns(good) == ["Hip Angles (deg)", "Hip Angles (deg).1"]
    with pytest.raises(ValueError):
        frames.require_other_folder("file:///a/", "/a")


def test_mutual_information_in_slices(spark):
    """A feature over many small tasks has the estimate of one task, also with a rare class and values of more rows than a slice."""
    from motionloom.operators import features as FE

    rng = np.random.default_rng(0)
    n = 3000
    y = rng.choice(4, n, p=[0.6, 0.3, 0.099, 0.001])
    cols = {"cont": y * 1.5 + rng.normal(size=n), "tied": np.round(y * 2 + rng.normal(size=n)), "gone": np.full(n, np.nan)}
    long = spark.createDataFrame([(f, float(v), str(c)) for f, x in cols.items() for v, c in zip(x, y, strict=True)], "feature string, value double, y string")
    want = {f: K.mutual_information(cols[f], y.astype(str)) for f in ("cont", "tied")}
    for rows in (200, 1 << 17):
        got = {r[0]: r[1] for r in FE.mutual_information(long, "y", rows=rows).collect()}
        assert got["cont"] == pytest.approx(want["cont"], abs=1e-9)
        assert got["tied"] == pytest.approx(want["tied"], abs=0.05)
        assert got["gone"] is None
