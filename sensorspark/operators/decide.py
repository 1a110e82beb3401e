"""Retraining and deployment decisions: one row per model or segment in, the same row with its
decision out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.schema import AUDIT

# Default thresholds and the names decisions are stored under.
R2_CRITICAL = 0.45
R2_WARNING = 0.55
RMSE_MAX = 90.0
DRIFT_CRITICAL = 0.5
DRIFT_WARNING = 0.3
R2_FLOOR = 0.60
RETRAIN_BRANCH = "fine_tune_model"
STOP_BRANCH = "end_monitoring"
DEPLOY_DECISIONS = [
    "deploy_both_fail_baseline",
    "skip_both_fail_baseline",
    "reject_baseline_regression",
    "deploy",
    "skip_no_improvement",
]
AUDIT_DEFAULTS = {
    "drift_detected": False,
    "rmse": 999.0,
    "r2": 0.0,
    "fine_tune_triggered": False,
    "fine_tune_success": False,
    "model_improvement": 0.0,
    "error_message": "",
    "double_evaluation_enabled": False,
    "baseline_regression": False,
    "deployment_decision": "not_triggered",
    "model_uri": "",
    "run_id": "",
}


def _optional(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def dec_retrain(
    df: DataFrame,
    r2_critical: float = R2_CRITICAL,
    r2_warning: float = R2_WARNING,
    rmse_max: float = RMSE_MAX,
    drift_critical: float = DRIFT_CRITICAL,
    drift_warning: float = DRIFT_WARNING,
) -> DataFrame:
    """``decision`` (force, reactive, proactive, wait, ok) and the ``branch`` it leads to.

    Reads ``r2``, ``rmse`` and, where present, ``too_few`` (metrics that cannot be relied on, as good
    as bad ones), ``force``, ``drift_detected``, ``drift_share`` and ``drift_status``; a failed drift
    run counts as no drift."""
    r2, rmse = F.col("r2"), F.col("rmse")
    drift = _optional(df, "drift_detected", False) & (_optional(df, "drift_status", "ok") == "ok")
    share = _optional(df, "drift_share", 0.0)
    decision = (
        F.when(_optional(df, "force", False), "force")
        .when(_optional(df, "too_few", False) | (r2 < r2_critical) | (rmse > rmse_max), "reactive")
        .when(drift & (share >= drift_critical) & (r2 < r2_warning), "proactive")
        .when(drift & (share >= drift_warning), "wait")
        .otherwise("ok")
    )
    return df.withColumn("decision", decision).withColumn(
        "branch",
        F.when(F.col("decision").isin("force", "reactive", "proactive"), RETRAIN_BRANCH).otherwise(
            STOP_BRANCH
        ),
    )


def dec_deploy(df: DataFrame, r2_floor: float = R2_FLOOR, zero_is_missing: bool = True) -> DataFrame:
    """``deployment_decision`` from challenger and champion on both test sets.

    Reads ``baseline_regression``, ``r2_baseline``, ``r2_current``, ``champion_r2_current`` and
    ``champion_r2_baseline``. A champion R² of exactly 0 on current data counts as missing (no
    improvement) unless ``zero_is_missing`` is off."""
    champion = F.col("champion_r2_current")
    missing = champion.isNull() | (champion == 0) if zero_is_missing else champion.isNull()
    better = F.col("improvement_current") > 0
    fails = F.coalesce(F.col("baseline_regression"), F.lit(False))
    champion_fails = F.coalesce(F.col("champion_r2_baseline") < r2_floor, F.lit(False))
    return df.withColumns(
        {
            "improvement_current": F.when(missing, 0.0).otherwise(F.col("r2_current") - champion),
            "improvement_baseline": F.col("r2_baseline") - F.col("champion_r2_baseline"),
        }
    ).withColumn(
        "deployment_decision",
        F.when(fails & champion_fails & better, "deploy_both_fail_baseline")
        .when(fails & champion_fails, "skip_both_fail_baseline")
        .when(fails, "reject_baseline_regression")
        .when(better, "deploy")
        .otherwise("skip_no_improvement"),
    )


def dec_fallback_improvement(df: DataFrame) -> DataFrame:
    """Without double evaluation only the improvement is kept: new R² minus current R² (0 when
    there is no current R²), and no decision."""
    current = F.col("champion_r2_current")
    new = F.coalesce(F.col("new_r2"), current)
    off = ~F.coalesce(F.col("double_evaluation_enabled"), F.lit(False))
    gain = F.when(current.isNull() | (current == 0), 0.0).otherwise(new - current)
    return df.withColumn("model_improvement", F.when(off, gain))


def dec_deploy_class(df: DataFrame, col: str = "deployment_decision", out: str = "deployment_class") -> DataFrame:
    """deploy, skip or reject."""
    d = F.col(col)
    return df.withColumn(
        out, F.when(d.contains("deploy"), "deploy").when(d.contains("skip"), "skip").otherwise("reject")
    )


def dec_severity(df: DataFrame, r2_critical: float = R2_CRITICAL, out: str = "severity") -> DataFrame:
    return df.withColumn(out, F.when(F.col("r2") < r2_critical, "CRITICAL").otherwise("WARNING"))


def dec_effective_metrics(df: DataFrame) -> DataFrame:
    """Metrics of the new champion when both are there, else of the old one."""
    new = F.col("new_champion_rmse").isNotNull() & F.col("new_champion_r2").isNotNull()
    return df.withColumns(
        {
            "rmse": F.when(new, F.col("new_champion_rmse")).otherwise(F.col("rmse")),
            "r2": F.when(new, F.col("new_champion_r2")).otherwise(F.col("r2")),
        }
    )


def audit_columns(df: DataFrame) -> list[Column]:
    """The audit columns, typed, with defaults for what is missing. An RMSE of 0 is a missing one."""
    out = []
    for f in AUDIT.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        if f.name == "rmse":
            c = F.when(c != 0, c)
        if f.name in AUDIT_DEFAULTS:
            c = F.coalesce(c, F.lit(AUDIT_DEFAULTS[f.name]).cast(f.dataType))
        out.append(c.alias(f.name))
    return out


def audit_defaults(df: DataFrame) -> DataFrame:
    return df.select(*audit_columns(df))


def dec_audit_row(stages: Mapping[str, DataFrame], key: str = "cycle_id") -> DataFrame:
    """One audit record per monitoring cycle from the tables of its stages.

    ``validation`` (r2, rmse, env, timestamp) names the cycles; ``drift`` (drift_detected,
    drift_share), ``training`` (fine_tune_success, metrics, decision) and ``new_champion``
    (new_champion_rmse, new_champion_r2) exist for some of them, with at most one row per cycle.
    The cycle id stays beside the audit columns, and so does ``drift_share``."""
    out = stages["validation"]
    for name in ("drift", "training", "new_champion"):
        if name in stages:
            out = out.join(stages[name], key, "left")
    if "new_champion" in stages:
        out = dec_effective_metrics(out)
    trained = F.col("fine_tune_success").isNotNull() if "training" in stages else F.lit(False)
    out = out.withColumn("fine_tune_triggered", trained)
    share = ["drift_share"] if "drift_share" in out.columns else []
    return out.select(key, *audit_columns(out), *share)
