"""The model registry as tables: ``registry`` (one row per trained model) and ``promotions`` (one
row per promotion). Nothing is updated in place; the champion of a scope is its last promotion.

A scope is (model_type, env, test_mode). ``seq`` is the order of registration.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.columns import ts_of

SCOPE = ["model_type", "env", "test_mode"]

# Metrics a model can be chosen by. True: smaller is better.
METRIC_ASCENDING = {"rmse": True, "r2": False, "f1_score": False, "accuracy": False}
MISSING_AS = {"f1_score": -1.0, "accuracy": -1.0}


def reg_append(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """The registry with new entries after the old ones. Metrics an entry lacks stay null; entries
    start as non-champions."""
    new = entry.withColumn("is_champion", F.lit(False))
    return registry.unionByName(new, allowMissingColumns=True)


def champion_ids(promotions: DataFrame) -> DataFrame:
    """The last promoted run of each scope."""
    last = F.max_by("run_id", F.struct("promoted_at", "run_id")).alias("run_id")
    return promotions.groupBy(*SCOPE).agg(last, F.max("promoted_at").alias("promoted_at"))


def promotion_events(registry: DataFrame, promotions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (run_id, scope, promoted_at) that name a run of their scope, with the run that is
    demoted (null when there was none). One request per scope: the latest."""
    keys = ["run_id", *SCOPE]
    known = requests.join(registry.select(*keys).distinct(), keys, "left_semi")
    latest = champion_ids(known)
    before = champion_ids(promotions).select(*SCOPE, F.col("run_id").alias("previous"))
    changed = F.when(F.col("previous") != F.col("run_id"), F.col("previous"))
    return latest.join(before, SCOPE, "left").select(
        *keys, "promoted_at", changed.alias("demoted_run_id")
    )


def reg_promote(
    registry: DataFrame,
    promotions: DataFrame,
    run_id: str | int,
    scope: dict[str, object],
    ts: Column | datetime | str,
) -> tuple[DataFrame, str | int | None]:
    """Promote one run within its scope. Returns the promotions with the new event, and the run it
    demotes. A run that is not in the scope is an error."""
    wanted = F.lit(True)
    for c in SCOPE:
        wanted = wanted & (F.col(c) == F.lit(scope[c]))
    here = registry.where(wanted & (F.col("run_id") == F.lit(run_id)))
    request = here.select("run_id", *SCOPE).limit(1).withColumn("promoted_at", ts_of(ts))
    events = promotion_events(registry, promotions, request)
    found = events.first()
    if found is None:
        raise ValueError(f"run_id={run_id} not found for {scope}")
    return promotions.unionByName(events.drop("demoted_run_id")), found["demoted_run_id"]


def reg_champions(registry: DataFrame, promotions: DataFrame) -> DataFrame:
    """Registry rows of the current champions."""
    return registry.drop("is_champion").join(
        champion_ids(promotions), ["run_id", *SCOPE]
    )


def with_champion_flag(registry: DataFrame, promotions: DataFrame) -> DataFrame:
    now = champion_ids(promotions).select("run_id", *SCOPE, F.lit(True).alias("__c"))
    return (
        registry.drop("is_champion")
        .join(now, ["run_id", *SCOPE], "left")
        .withColumn("is_champion", F.coalesce("__c", F.lit(False)))
        .drop("__c")
    )


def _metric_rank(metric: str) -> Column:
    """A number that is smaller for better models; a missing value is worst."""
    if metric not in METRIC_ASCENDING:
        raise ValueError(f"unsupported metric: {metric}")
    v = F.col(metric)
    if metric in MISSING_AS:
        v = F.coalesce(v, F.lit(MISSING_AS[metric]))
    return F.coalesce(v if METRIC_ASCENDING[metric] else -v, F.lit(float("inf")))


def _best(df: DataFrame, order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c != "model_type"]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy("model_type").agg(row).select("model_type", *[F.col(f"r.{c}") for c in rest])


def reg_select_best(
    registry: DataFrame,
    promotions: DataFrame,
    metric: str = "rmse",
    env: str = "prod",
    test_mode: bool = False,
) -> DataFrame:
    """The model to serve per model type: its first champion in any scope; without one the best by
    metric in the asked scope; without that the best of all. Ties keep the first registered."""
    flagged = with_champion_flag(registry, promotions)
    champion = F.col("is_champion")
    in_scope = (F.col("env") == env) & (F.col("test_mode") == F.lit(test_mode))
    order = [
        F.when(champion, 0).otherwise(1),
        F.when(champion | in_scope, 0).otherwise(1),
        F.when(champion, F.lit(0.0)).otherwise(_metric_rank(metric)),
        F.col("seq"),
    ]
    return _best(flagged, order)


def reg_select_legacy(
    registry: DataFrame,
    metric: str,
    env: str,
    test_mode: bool,
    model_type: str | None = None,
) -> DataFrame:
    """The best model strictly within the asked scope, champions ignored. Asking for one model
    type that has none is an error."""
    rows = registry.where((F.col("env") == env) & (F.col("test_mode") == F.lit(test_mode)))
    if model_type is not None:
        rows = rows.where(F.col("model_type") == model_type)
        if rows.limit(1).count() == 0:
            raise ValueError(f"no model for type={model_type}, env={env}, test_mode={test_mode}")
    return _best(rows, [_metric_rank(metric), F.col("seq")])


def reg_promote_guard(decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """Promotion requests of the decisions that contain "deploy" and whose run is registered."""
    wanted = decisions.where(F.col("deployment_decision").contains("deploy"))
    keys = ["run_id", *SCOPE]
    runs = registry.select(*keys).distinct()
    return wanted.select("run_id", F.col("decided_at").alias("promoted_at"), "deployment_decision").join(
        runs, "run_id"
    ).select(*keys, "promoted_at", "deployment_decision")
