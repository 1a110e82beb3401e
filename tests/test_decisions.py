"""Truth tables with values on every threshold, and registry behaviour."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensorspark.operators.decide import (
    DEPLOY_DECISIONS,
    audit_defaults,
    dec_audit_row,
    dec_deploy,
    dec_deploy_class,
    dec_effective_metrics,
    dec_fallback_improvement,
    dec_retrain,
    dec_severity,
)
from sensorspark.operators.evaluate import (
    evl_classification,
    evl_double,
    evl_min_samples,
    evl_overfit_gap,
    evl_regression,
)
from sensorspark.operators.registry import (
    promotion_events,
    reg_append,
    reg_champions,
    reg_promote,
    reg_promote_guard,
    reg_select_best,
    reg_select_legacy,
)
from sensorspark.schema import AUDIT

RETRAIN = [
    # r2, rmse, drift, share, force -> decision
    (0.80, 10.0, False, 0.0, True, "force"),
    (0.4499, 10.0, False, 0.0, False, "reactive"),
    (0.45, 90.0, False, 0.0, False, "ok"),
    (0.45, 90.01, False, 0.0, False, "reactive"),
    (0.54, 10.0, True, 0.5, False, "proactive"),
    (0.55, 10.0, True, 0.5, False, "wait"),
    (0.54, 10.0, True, 0.49, False, "wait"),
    (0.54, 10.0, True, 0.3, False, "wait"),
    (0.54, 10.0, True, 0.29, False, "ok"),
    (0.54, 10.0, False, 0.9, False, "ok"),
    (0.54, 10.0, True, None, False, "ok"),
]


def test_retrain(frame):
    df = frame(RETRAIN, "r2 double, rmse double, drift_detected boolean, drift_share double, force boolean, want string")
    for r in dec_retrain(df).collect():
        assert r.decision == r.want, r
        assert r.branch == ("fine_tune_model" if r.want in ("force", "reactive", "proactive") else "end_monitoring")
    assert dec_retrain(frame([(0.5, 1.0)], "r2 double, rmse double")).first().decision == "ok"


def test_failed_drift_counts_as_none(frame):
    df = frame([(0.5, 1.0, True, 0.9, "error")], "r2 double, rmse double, drift_detected boolean, drift_share double, drift_status string")
    assert dec_retrain(df).first().decision == "ok"


DEPLOY = [
    # regression, r2_baseline, r2_current, champion current, champion baseline -> decision
    (True, 0.5, 0.8, 0.7, 0.5, "deploy_both_fail_baseline"),
    (True, 0.5, 0.7, 0.7, 0.5, "skip_both_fail_baseline"),
    (True, 0.5, 0.8, 0.7, 0.6, "reject_baseline_regression"),
    (True, 0.5, 0.8, 0.7, None, "reject_baseline_regression"),
    (False, 0.7, 0.8, 0.7, 0.5, "deploy"),
    (False, 0.7, 0.7, 0.7, 0.5, "skip_no_improvement"),
    (False, 0.7, 0.8, 0.0, 0.5, "skip_no_improvement"),
    (False, 0.7, 0.8, None, None, "skip_no_improvement"),
]
DEPLOY_SCHEMA = "baseline_regression boolean, r2_baseline double, r2_current double, champion_r2_current double, champion_r2_baseline double, want string"


def test_deploy(frame):
    out = dec_deploy_class(dec_deploy(frame(DEPLOY, DEPLOY_SCHEMA))).collect()
    assert [r.deployment_decision for r in out] == [r.want for r in out]
    assert {r.deployment_decision for r in out} == set(DEPLOY_DECISIONS)
    assert [r.deployment_class for r in out] == ["deploy", "skip", "reject", "reject", "deploy", "skip", "skip", "skip"]


def test_zero_is_a_value_when_asked(frame):
    out = dec_deploy(frame(DEPLOY, DEPLOY_SCHEMA), zero_is_missing=False).collect()
    assert out[6].deployment_decision == "deploy"


def test_fallback_improvement(frame):
    rows = [(0.5, 0.7, False), (None, 0.7, False), (0.0, 0.7, False), (0.5, None, False), (0.5, 0.7, True)]
    df = dec_fallback_improvement(frame(rows, "champion_r2_current double, new_r2 double, double_evaluation_enabled boolean"))
    got = [r.model_improvement if r.model_improvement is None else round(r.model_improvement, 9) for r in df.collect()]
    assert got == [0.2, 0.0, 0.0, 0.0, None]


def test_severity_and_effective_metrics(frame):
    assert [r.severity for r in dec_severity(frame([(0.449,), (0.45,)], "r2 double")).collect()] == ["CRITICAL", "WARNING"]
    rows = [(1.0, 0.1, 2.0, 0.2), (1.0, 0.1, None, 0.2), (1.0, 0.1, 2.0, None)]
    got = dec_effective_metrics(frame(rows, "rmse double, r2 double, new_champion_rmse double, new_champion_r2 double"))
    assert [(r.rmse, r.r2) for r in got.collect()] == [(2.0, 0.2), (1.0, 0.1), (1.0, 0.1)]


def test_audit_defaults(frame):
    row = audit_defaults(frame([(0.0, None)], "rmse double, r2 double")).first()
    assert (row.rmse, row.r2, row.deployment_decision, row.fine_tune_triggered) == (999.0, 0.0, "not_triggered", False)
    assert row.r2_baseline is None and len(row) == len(AUDIT.fields) == 18


def test_audit_row_without_training(frame):
    validation = frame([("c", 10.0, 0.8)], "cycle_id string, rmse double, r2 double")
    drift = frame([("c", True, 0.4)], "cycle_id string, drift_detected boolean, drift_share double")
    row = dec_audit_row({"validation": validation, "drift": drift}).first()
    assert (row.cycle_id, row.rmse, row.drift_detected, row.drift_share, row.fine_tune_triggered) == ("c", 10.0, True, 0.4, False)


def test_regression_metrics(frame):
    df = frame([("a", 3.0, 2.5), ("a", 5.0, 5.5), ("a", 7.0, 7.0), ("c", 4.0, 4.0), ("c", 4.0, 4.0), ("d", 4.0, 5.0), ("d", 4.0, 4.0), ("e", None, 1.0), ("e", 1.0, None)],
               "g string, count double, prediction double")
    m = {r.g: r for r in evl_regression(df, by=["g"]).collect()}
    assert m["a"].n == 3 and round(m["a"].r2, 9) == 0.9375 and round(m["a"].mae, 9) == round(1 / 3, 9)
    assert m["c"].r2 == 1.0 and m["d"].r2 == 0.0 and "e" not in m
    assert evl_regression(df.limit(0)).first().n == 0


def test_weighted_regression_equals_copies(frame):
    rows = [(3.0, 2.5, 2), (5.0, 6.0, 1), (9.0, 7.0, 3)]
    w = evl_regression(frame(rows, "count double, prediction double, n_rows int"), weight="n_rows").first()
    c = evl_regression(frame([r[:2] for r in rows for _ in range(r[2])], "count double, prediction double")).first()
    assert w.n == c.n == 6 and all(abs(w[k] - c[k]) < 1e-12 for k in ("rmse", "mae", "r2"))


def test_min_samples(frame):
    df = frame([(9, 5.0, 0.9), (10, 5.0, 0.9)], "n int, rmse double, r2 double")
    flagged = evl_min_samples(df)
    assert [(r.rmse, r.r2, r.too_few) for r in flagged.collect()] == [(5.0, 0.9, True), (5.0, 0.9, False)]
    assert [r.decision for r in dec_retrain(flagged).collect()] == ["reactive", "ok"]


def test_weighted_regression_far_from_zero(frame):
    rows = [(1e9 + i * 0.01, 1e9 + i * 0.01 + (0.25 if i % 2 else -0.25) * 0.1, 1) for i in range(200)]
    df = frame(rows, "count double, prediction double, n_rows int")
    assert abs(evl_regression(df, weight="n_rows").first().r2 - evl_regression(df).first().r2) < 1e-6


def test_double_evaluation(frame):
    good = frame([(float(i), float(i)) for i in range(10)], "count double, prediction double")
    bad = frame([(float(i), 5.0) for i in range(10)], "count double, prediction double")
    out = evl_double(bad, good).first()
    assert out.baseline_regression and out.r2_current == 1.0 and out.test_baseline_size == 10
    off = evl_double(bad, good, test_mode=True).first()
    assert not off.baseline_regression and off.r2_baseline == 0.0 and off.test_baseline_size == 0
    gap = evl_overfit_gap(frame([(0.85, 0.5), (0.85, 0.49)], "r2_train double, r2_current double"))
    assert [r.possible_overfit for r in gap.collect()] == [False, True]


def test_classification_without_positives(frame):
    row = evl_classification(frame([(0, 0), (0, 0)], "affluence int, prediction int")).first()
    assert (row.tn, row.accuracy, row.precision, row.recall, row.f1_score) == (2, 1.0, 0.0, 0.0, 0.0)


REG = "run_id string, model_type string, env string, test_mode boolean, rmse double, r2 double, f1_score double, seq int, is_champion boolean"
PROMO = "run_id string, model_type string, env string, test_mode boolean, promoted_at timestamp_ntz"
ROWS = [
    ("a", "rf", "prod", False, 30.0, 0.8, None, 0, False),
    ("b", "rf", "prod", False, 20.0, 0.9, None, 1, False),
    ("c", "rf", "dev", False, 10.0, 0.95, None, 2, False),
    ("d", "nn", "dev", True, 40.0, None, 0.5, 3, False),
    ("e", "nn", "dev", True, 40.0, 0.7, None, 4, False),
    ("f", "rf", "prod", False, 20.0, 0.9, None, 5, False),
]
SCOPE = {"model_type": "rf", "env": "prod", "test_mode": False}


@pytest.fixture
def registry(frame):
    return frame(ROWS, REG), frame([], PROMO)


def best(df):
    return {r.model_type: r.run_id for r in df.collect()}


def test_best_without_champions(registry):
    reg, none = registry
    # rf in scope: b and f tie, the first stays. nn has nothing in scope: the best of all.
    assert best(reg_select_best(reg, none, "rmse")) == {"rf": "b", "nn": "d"}
    assert best(reg_select_best(reg, none, "r2")) == {"rf": "b", "nn": "e"}
    assert best(reg_select_best(reg, none, "f1_score"))["nn"] == "d"
    assert best(reg_select_best(reg, none, "rmse", env="dev"))["rf"] == "c"
    with pytest.raises(ValueError):
        reg_select_best(reg, none, "mae")


def test_promotion(registry):
    reg, none = registry
    first, demoted = reg_promote(reg, none, "a", SCOPE, "2024-01-01 00:00:00")
    assert demoted is None and best(reg_select_best(reg, first)) == {"rf": "a", "nn": "d"}
    second, demoted = reg_promote(reg, first, "b", SCOPE, "2024-01-02 00:00:00")
    assert demoted == "a"
    assert [r.run_id for r in reg_champions(reg, second).collect()] == ["b"]
    again, demoted = reg_promote(reg, second, "b", SCOPE, "2024-01-03 00:00:00")
    assert demoted is None and reg_champions(reg, again).count() == 1
    # A champion of any scope wins everywhere; with several the first registered does.
    dev, _ = reg_promote(reg, again, "c", {**SCOPE, "env": "dev"}, "2024-01-04 00:00:00")
    assert best(reg_select_best(reg, dev))["rf"] == "b"
    assert reg_champions(reg, dev).count() == 2
    with pytest.raises(ValueError):
        reg_promote(reg, dev, "a", {**SCOPE, "env": "dev"}, "2024-01-05 00:00:00")


def test_requests_for_unknown_runs_are_dropped(registry, frame):
    reg, none = registry
    wanted = frame([("zz", "rf", "prod", False, "2024-01-01 00:00:00")], PROMO)
    assert promotion_events(reg, none, wanted).count() == 0


def test_legacy_selection(registry):
    reg, _ = registry
    assert best(reg_select_legacy(reg, "rmse", "prod", False)) == {"rf": "b"}
    with pytest.raises(ValueError):
        reg_select_legacy(reg, "rmse", "prod", True, "rf")


def test_append_keeps_missing_metrics_null(registry, frame):
    reg, _ = registry
    row = frame([("g", "rf", "prod", False, 0.99, 6)], "run_id string, model_type string, env string, test_mode boolean, r2 double, seq int")
    got = reg_append(reg, row).where("run_id = 'g'").first()
    assert got.rmse is None and got.r2 == 0.99 and got.is_champion is False and reg_append(reg, row).count() == 7


def test_guard(registry, frame):
    reg, _ = registry
    rows = [(r, d, "2024-01-01 00:00:00") for r, d in zip("abcdez", [*DEPLOY_DECISIONS, "deploy"])]
    out = reg_promote_guard(frame(rows, "run_id string, deployment_decision string, decided_at timestamp_ntz"), reg)
    assert {r.run_id for r in out.select(F.col("run_id")).collect()} == {"a", "d"}
