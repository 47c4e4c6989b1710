"""All stages of a study, end to end, on generated trials."""

import json

import numpy as np
import pandas as pd
import pytest

from motionloom.plans import stages
from motionloom.sources import frames

FRAMES = 130


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    """Eight participants, two instruments, two classes; two blocks of each condition; a gap, a short trial, an odd name."""
    base = tmp_path_factory.mktemp("study")
    raw = base / "raw"
    raw.mkdir()
    rng = np.random.default_rng(0)
    t = np.arange(FRAMES) / 50
    for k in range(8):
        skilled = k % 2
        for condition in ("play", "mime", "imagine"):
            for block in (1, 2):
                cols = {" time_s ": t}
                for i, name in enumerate([*stages.CURATED, "Spine4Angles_X (deg)"]):
                    cols[name] = (10 + 5 * skilled) * np.sin(t * (1 + i % 7) + rng.uniform(0, 6)) + rng.normal(0, 0.3, FRAMES)
                for i, name in enumerate(stages.CHANNELS):
                    cols[name] = 200 * np.sin(t * (3 + 2 * skilled) + i) + rng.normal(0, 1, FRAMES)
                df = pd.DataFrame(cols | {"Annotations": "x", "(empty)": 1})
                if (k, condition, block) == (0, "play", 1):
                    df.loc[10:12, stages.CHANNELS[0]] = np.nan
                    df.loc[40:80, stages.CURATED[0]] = np.nan
                if (k, condition, block) == (1, "mime", 2):
                    df = df.iloc[:9]
                df.to_csv(raw / f"P{k:03d}_{condition}_{block}.csv", index=False)
    (raw / "notes_play_x.csv").write_text("time_s,Odd Angles (deg)\n0,1\n")
    pd.DataFrame({"ID": [f" p{k:03d}" for k in range(9)], "Instrument": [["Violin", "Clarinet"][k // 4 % 2] for k in range(9)], "Skill Level": [["Novice", "Expert"][k % 2] for k in range(9)], "Num Level": 1, "Age": 30, "Sex": "x", "Total": 19}).to_csv(base / "people.csv", index=False)
    cfg = {
        "paths": {"raw_mocap_dir": "raw", "preprocessed_dir": "pre", "features_dir": "feat", "analysis_dir": "ana", "metadata_file": "people.csv", "training_results_dir": "tr", "training_results_grouped_dir": "trg", "training_results_rnn_dir": "rnn", "unified_pca_eval_dir": "pca"},
        "preprocessing": {"gap_limit_frames": 5},
        "feature_extraction": {"conditions": "play,mime", "include_instrument_specific_pca": True},
        "cross_validation": {"n_splits": 2},
        "unified_pca": {"conditions": ["play", "mime"]},
        "diagnostics": {"per_instrument": False},
        "classical_models": {"tasks": ["2class"], "modes": ["pooled", "separate"], "configs": ["shared_pca"], "models": ["logreg"]},
        "rnn": {"tasks": ["2class"], "protocols": ["participant"], "epochs": 2, "hidden_dim": 8, "num_layers": 1},
    }
    path = base / "study.json"
    path.write_text(json.dumps(cfg))
    return stages.load_config(str(path))


def read(spark, cfg, folder, name):
    return spark.read.parquet(f"{cfg['paths'][folder]}/{name}")


def test_all_stages(spark, study):
    assert stages.run(spark, study, dry=True) == stages.ORDER and stages.run(spark, study, dry=True, skip_rnn=True) == stages.ORDER[:-1]
    assert stages.run(spark, study) == stages.ORDER
    get = lambda folder, name: read(spark, study, folder, name).toPandas()

    log = get("preprocessed_dir", "preprocessing_summary").set_index("file")
    assert len(log) == 32 and set(log["condition"]) == {"play", "mime"} and (log["n_columns"] == 53 + 1 + 18 + 1).all()
    gap = log.loc["P000_play_1.csv"]
    assert (gap["nan_before_interp"], gap["nan_after_interp"], gap["status"]) == (44, 31, "warning")
    assert any(w.startswith("filtering_skipped_trial_too_short") for w in log.loc["P001_mime_2.csv", "warnings"]) and not log.loc["P001_mime_2.csv", "filtered"]
    assert log.loc["P002_play_1.csv", "cutoff_hz_range_used"] == "[2.0, 6.0, 8.0, 9.0]" and {"dropped_annotations_column", "dropped_placeholder_cols:1"} <= set(log.loc["P002_play_1.csv", "warnings"])
    assert len(get("preprocessed_dir", "rejected_files")) == 1

    skipped = get("unified_pca_eval_dir", "skipped_blocks")
    assert [(r.participant_id, r.reason) for r in skipped.itertuples()] == [("P001", "fewer than 10 valid frames")]
    assert get("unified_pca_eval_dir", "shared_pm_summary")["n_blocks"].tolist() == [31]
    usage = get("unified_pca_eval_dir", "shared_pm_usage_by_block")
    assert len(usage) == 31 and usage["PCA12a_PM1_rms"].notna().all()
    assert len(get("unified_pca_eval_dir", "unified_pca_participant_features")) == 16
    assert set(get("unified_pca_eval_dir", "joint_angle_variability_by_block")["family"]) == set(stages.JOINTS)

    f = get("features_dir", "trial_features")
    assert len(f) == 32 and (f["status"] == "ok").all()
    v, c = f["instrument"] == "violin", f["instrument"] == "clarinet"
    assert f.loc[c, "LDJ_stroke_mean_LWrist"].notna().any() and f.loc[v, "LDJ_stroke_mean_LWrist"].isna().all()
    assert f.loc[v, "SPARC_window_bow_elbow_all_median"].notna().any() and f.loc[c, "SPARC_window_bow_elbow_all_median"].isna().all()
    assert f.loc[v, "PCA12a_PM4_rms"].isna().all() and f.loc[c, "PCA12a_PM6_rms"].isna().all() and f.loc[v, "PCA12a_PM6_rms"].notna().any()
    z = f.groupby("instrument")["ROM_HeadAngles_X_z"]
    assert np.allclose(z.mean(), 0) and np.allclose(z.std(ddof=0), 1)
    assert len(get("features_dir", "unmatched_pca_rows")) == 2 and len(get("features_dir", "cv_features")) == 16
    m = get("features_dir", "trial_features_with_skill")
    assert m["has_metadata"].all() and set(m["Skill Level"]) == {"Novice", "Expert"}
    assert get("features_dir", "unmatched_participants")["participant_id"].tolist() == ["P008"]

    rank = get("analysis_dir", "ranking")
    assert set(rank["scope"]) == {"overall"} and not rank["feature"].str.endswith("_z").any() and sorted(rank["rank"]) == list(range(1, len(rank) + 1))
    matrix = get("analysis_dir", "feature_correlations")
    assert len(matrix) == len(rank) == len(matrix.columns) - 1 and len(get("analysis_dir", "summary")) == 1

    for folder, names in (("training_results_dir", {"pooled_shared_pca", "violin_shared_pca", "clarinet_shared_pca"}), ("training_results_grouped_dir", {"pooled_shared_pca_grouped", "violin_shared_pca_grouped", "clarinet_shared_pca_grouped"})):
        s, folds, p = (get(folder, n) for n in ("experiment_summary", "fold_metrics", "predictions"))
        assert set(s["run_name"]) == names and (s["n_splits"] == 2).all() and len(folds) == 6
        assert np.allclose(folds["train_test_gap"], folds["train_balanced_accuracy"] - folds["balanced_accuracy"])
        assert (folds["n_features_after_correlation_pruning"] >= folds["n_features_final"]).all()
        pooled = p[p["run_name"].str.startswith("pooled") & (p["part"] == "test")]
        assert len(pooled) == 32 and s["balanced_accuracy_mean"].min() > 0.7
        assert not pooled["features"].str.contains("LDJ_stroke_mean_LWrist|PM4|PM6", regex=True).any()
        assert get(folder, "confusion_matrix_total")[["predicted_0", "predicted_1"]].sum().sum() == s["n_trials"].sum()
    both = get("training_results_grouped_dir", "predictions")
    sides = both.groupby(["run_name", "fold", "participant_id"])["part"].nunique()
    assert (sides == 1).all()
    rnn = get("training_results_rnn_dir", "fold_metrics")
    assert len(rnn) == 2 and rnn["test_balanced_accuracy"].between(0, 1).all() and (rnn["n_val"] > 0).all()


def test_single_file_and_failures(spark, study, tmp_path):
    cfg = study | {"paths": study["paths"] | {"preprocessed_dir": str(tmp_path / "one")}}
    one = stages.preprocess(spark, cfg, study["paths"]["raw_mocap_dir"] + "/P003_play_2.csv").collect()
    assert [r["file"] for r in one] == ["P003_play_2.csv"]
    with pytest.raises(ValueError):
        stages.run(spark, study, only=["other"])
    with pytest.raises(RuntimeError, match="resume with --only merge_skill_labels,"):
        stages.run(spark, study | {"paths": study["paths"] | {"features_dir": str(tmp_path / "none")}}, only=["merge_skill_labels"])
    with pytest.raises(ValueError):
        path = tmp_path / "bad.json"
        path.write_text("{}")
        stages.load_config(str(path))
    assert frames.cutoff("LWristPositions_X (mm)", frames.cutoff_map(None)) == 9.0 and frames.cutoff("Other", frames.CUTOFFS) == 6.0
