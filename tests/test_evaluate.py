"""Feature choice, skill/duration evaluation and the report bundle."""

import numpy as np
import pytest

from motionloom.operators import evaluate, stats


def test_feature_choice(spark):
    names = ["ROM_LWrist_X", "ROM_rate_LWrist_X", "ROM_Spine4Angles_Y", "LDJ_stroke_mean_LWrist", "PCA12a_PM1_rms", "PCA12a_PM4_rms", "PCA12a_PM6_rms", "ROM_LWrist_X_z", "QC_n", "Age", "a_valid_frames"]
    df = spark.createDataFrame([], ", ".join(f"{n} double" for n in names) + ", file string")
    base = ["LDJ_stroke_mean_LWrist", "ROM_LWrist_X"]
    assert evaluate.model_features(df, "baseline") == base
    assert evaluate.model_features(df, "shared_pca") == evaluate.model_features(df, "instrument_specific") == [*base[:1], "PCA12a_PM1_rms", base[1]]
    assert evaluate.model_features(df, "instrument_specific", "clarinet") == [base[0], "PCA12a_PM1_rms", "PCA12a_PM4_rms", base[1]]
    assert evaluate.model_features(df, "instrument_specific", "violin") == [base[0], "PCA12a_PM1_rms", "PCA12a_PM6_rms", base[1]]
    assert evaluate.diagnostic_features(df, "z_only") == ["ROM_LWrist_X_z"] and "ROM_LWrist_X_z" not in evaluate.diagnostic_features(df)
    assert len(evaluate.diagnostic_features(df, "all")) == 8
    with pytest.raises(ValueError):
        evaluate.model_features(df, "other")


def test_skill_duration_by_definition(spark):
    rng = np.random.default_rng(4)
    n = 60
    d, g = rng.normal(50, 9, n), rng.integers(0, 3, n)
    x = 1e6 + 2 * d + g + rng.normal(size=n)
    rows = [("violin", str(g[i]), float(d[i]), "f", float(x[i])) for i in range(n)] + [("violin", "lonely", 40.0, "f", 1e6), ("violin", None, 1.0, "f", 1.0), ("violin", "0", 1.0, "f", None)] + [("few", str(i % 2), float(i), "f", float(i)) for i in range(9)]
    got = evaluate.skill_duration_tails(evaluate.skill_duration(spark.createDataFrame(rows, "i string, g string, d double, feature string, value double"), ["i"], "g", "d")).collect()
    assert [r["i"] for r in got] == ["violin"] and got[0]["n_participants"] == n + 1
    all_x, all_d = np.append(x, 1e6), np.append(d, 40.0)
    slope, cut = np.polyfit(all_d, all_x, 1)

    def f(v):
        groups = [v[g == k] for k in range(3)]
        between = sum(len(q) * (q.mean() - v.mean()) ** 2 for q in groups)
        within = sum(((q - q.mean()) ** 2).sum() for q in groups)
        return (between / 2) / (within / (n - 3)), between / (between + within)

    assert got[0]["duration_r"] == pytest.approx(np.corrcoef(all_x, all_d)[0, 1], rel=1e-6)
    assert (got[0]["raw_f"], got[0]["raw_eta_squared"]) == pytest.approx(f(x), rel=1e-5)
    assert got[0]["residual_f"] == pytest.approx(f(x - cut - slope * d)[0], rel=1e-4)
    assert got[0]["residual_p"] == pytest.approx(stats.f_tail(got[0]["residual_f"], 2, n - 3))


def test_bundle_scopes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(i % 3 + rng.normal()), 1.0, str(i % 3), "ab"[i % 2]) for i in range(60)]
    tables = evaluate.bundle(spark.createDataFrame(rows, "id long, x double, still double, y string, inst string"), ["id"], ["x", "still"], "y", "inst", ["a", "b"])
    s = {r["scope"]: r for r in evaluate.bundle_summary(tables).collect()}
    assert set(s) == {"overall", "a", "b"} and len(tables) == 10
    assert all(r["n_features"] == 2 and r["n_near_zero_variance"] == 1 and r["n_high_missing"] == 0 for r in s.values())
    first = tables["ranking"].where("rank = 1").collect()
    assert {(r["scope"], r["feature"]) for r in first} == {(k, "x") for k in s}


def test_machines_reach_the_least_loss(spark):
    """Hinge, weights and an unbound bias: no weight and bias of a grid has less loss, and passes are few."""
    from motionloom.operators import learn

    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 240)
    x = y + rng.normal(size=240)
    weight = np.where(y == 1, 1.0, 0.8)
    rows = spark.createDataFrame([([float(a)], int(b), float(c)) for a, b, c in zip(x, y, weight, strict=True)], "x array<double>, y int, _w double").coalesce(2).persist()
    got = learn.machines(rows, 1, [(0, 1), (1, 2)], 0.3)
    here = learn.machines(rows, 1, [(0, 1), (1, 2)], 0.3, few=True)
    assert all(np.allclose(got[p], here[p], atol=1e-9) for p in got)
    for (a, b), w in got.items():
        at = (y == a) | (y == b)
        sign = np.where(y[at] == b, 1, -1)
        loss = lambda v, z, at=at, sign=sign: 0.5 * v * v + 0.3 * (weight[at] * np.maximum(0, 1 - sign * (x[at] * v + z))).sum()
        least = min(loss(v, z) for v in np.linspace(0, 4, 201) for z in np.linspace(-8, 4, 301))
        assert abs(w[0]) > 0.1 and loss(*w) <= least * 1.001


def test_bundle_features_are_counted_in_slices(spark, monkeypatch):
    """No task of the report's mutual information holds a whole feature, and its estimate is that of one task."""
    from motionloom.operators import features as FE
    from motionloom.operators import kernels as K

    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 900)
    x = y + rng.normal(size=900)
    long = spark.createDataFrame([("f", float(a), str(b)) for a, b in zip(x, y, strict=True)], "feature string, value double, label string")
    whole = FE.mutual_information
    monkeypatch.setattr(FE, "mutual_information", lambda df, label: whole(df, label, rows=200))
    got = evaluate.discriminative(long, "label").first()["mutual_info"]
    assert abs(got - K.mutual_information(x, y)) < 1e-9


def test_mutual_information_keeps_nothing_in_memory(spark, monkeypatch):
    """The tables that are read again lie on the executors' disks, so that the bundle's scopes don't fill their heaps."""
    from motionloom.operators import features

    kept, plain = [], type(spark.range(1)).persist

    def persist(self, *level):
        out = plain(self, *level)
        kept.append(out.storageLevel)
        return out

    monkeypatch.setattr(type(spark.range(1)), "persist", persist)
    rows = [("f", float(i % 7), "ab"[i % 2]) for i in range(40)]
    got = features.mutual_information(spark.createDataFrame(rows, "feature string, value double, y string"), "y").collect()
    assert len(got) == 1 and len(kept) == 2 and all(s.useDisk and not s.useMemory for s in kept)
