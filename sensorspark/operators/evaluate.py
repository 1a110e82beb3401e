"""Model evaluation: one row per group, from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.columns import divide
from sensorspark.functions.moments import weighted_moments
from sensorspark.operators.stats import cumulated_sides, rank_columns

# The gates used by decisions.
MIN_SAMPLES = 10
R2_FLOOR = 0.60
OVERFIT_LIMIT = 0.35


def evl_regression(
    df: DataFrame,
    y: str = "count",
    pred: str = "prediction",
    by: Sequence[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Rows, RMSE, MAE and R² (1 - SSE/SST) per group. With constant actual values R² is 1 for
    perfect predictions and 0 otherwise. Rows without an actual or a prediction do not count;
    ``weight`` is a column with the number of rows a row stands for."""
    by = list(by or [])
    rows = df.dropna(subset=[y, pred])
    a, e = F.col(y).cast("double"), F.col(y).cast("double") - F.col(pred).cast("double")
    if weight is None:
        sums = rows.groupBy(*by).agg(
            F.count(a).alias("n"),
            F.sum(e * e).alias("sse"),
            F.sum(F.abs(e)).alias("sae"),
            (F.var_pop(a) * F.count(a)).alias("sst"),
            (F.min(a) == F.max(a)).alias("constant"),
        )
    else:
        moments = weighted_moments(rows, a, F.col(weight), by, {"sse": e * e, "sae": F.abs(e)})
        sums = moments.select(
            *by, F.col("n").cast("bigint").alias("n"), "sse", "sae", F.col("dev2").alias("sst"),
            (F.col("low") == F.col("high")).alias("constant"),
        )
    n, sse = F.col("n"), F.col("sse")
    r2 = F.when(F.col("constant"), F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(
        1.0 - divide(sse, F.col("sst"))
    )
    return sums.select(
        *by,
        "n",
        F.sqrt(divide(sse, n)).alias("rmse"),
        divide(F.col("sae"), n).alias("mae"),
        r2.alias("r2"),
    )


def evl_min_samples(metrics: DataFrame, n: int = MIN_SAMPLES) -> DataFrame:
    """Adds ``too_few`` for groups with fewer than ``n`` rows; the metrics stay as they are, and
    decisions read the flag."""
    return metrics.withColumn("too_few", F.col("n") < n)


def evl_classification(
    df: DataFrame, y: str = "affluence", pred: str = "prediction", by: Sequence[str] | None = None
) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 of class 1; undefined ratios are 0."""
    by = list(by or [])
    t, p = F.col(y) == 1, F.col(pred) == 1

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        df.dropna(subset=[y, pred])
        .groupBy(*by)
        .agg(
            count(t & p).alias("tp"),
            count(~t & p).alias("fp"),
            count(t & ~p).alias("fn"),
            count(~t & ~p).alias("tn"),
        )
        .withColumns(
            {
                "accuracy": ratio(tp + tn, tp + fp + fn + tn),
                "precision": ratio(tp, tp + fp),
                "recall": ratio(tp, tp + fn),
                "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
            }
        )
    )


def roc_points(
    df: DataFrame, y: str = "affluence", score: str = "score", by: Sequence[str] | None = None
) -> DataFrame:
    """False and true positive rate at each distinct score taken as threshold (score >= x)."""
    by = list(by or [])
    sides = df.dropna(subset=[y, score]).select(
        *by, F.col(score).cast("double").alias("x"), F.col(y).cast("int").alias("side")
    )
    cum = cumulated_sides(sides, by)
    tp = F.col("cum_a_total") - F.col("cum_a") + F.col("n_a")
    fp = F.col("cum_b_total") - F.col("cum_b") + F.col("n_b")
    return cum.select(
        *by,
        F.col("x").alias("threshold"),
        divide(fp, F.col("cum_b_total")).alias("fpr"),
        divide(tp, F.col("cum_a_total")).alias("tpr"),
    )


def evl_roc_auc(
    df: DataFrame, y: str = "affluence", score: str = "score", by: Sequence[str] | None = None
) -> DataFrame:
    """AUC from mid-ranks: the share of (positive, negative) pairs in the right order, ties half."""
    by = list(by or [])
    sides = df.dropna(subset=[y, score]).select(
        *by, F.col(score).cast("double").alias("x"), F.col(y).cast("int").alias("side")
    )
    ranks = rank_columns()
    return (
        cumulated_sides(sides, by)
        .groupBy(*by)
        .agg(*[ranks[c].alias(c) for c in ("n_a", "n_b", "u")])
        .select(
            *by,
            F.col("n_a").alias("positives"),
            F.col("n_b").alias("negatives"),
            divide(F.col("u"), F.col("n_a").cast("double") * F.col("n_b")).alias("auc"),
        )
    )


def evl_double(
    baseline: DataFrame,
    current: DataFrame,
    r2_floor: float = R2_FLOOR,
    test_mode: bool = False,
    y: str = "count",
    pred: str = "prediction",
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Metrics on the fixed and on the fresh test set side by side, with the regression flag
    (baseline R² below the floor). Test mode leaves the fixed set out: zeros and no regression."""
    by = list(by or [])
    rows = current.select(*by, y, pred, F.lit("current").alias("eval_set"))
    if not test_mode:
        rows = rows.unionByName(baseline.select(*by, y, pred, F.lit("baseline").alias("eval_set")))
    m = evl_regression(rows, y, pred, [*by, "eval_set"])

    def of(side: str, col: str) -> Column:
        return F.max(F.when(F.col("eval_set") == side, F.col(col)))

    out = m.groupBy(*by).agg(
        *[
            (F.lit(0.0) if test_mode and s == "baseline" else of(s, c)).alias(f"{c}_{s}")
            for s in ("baseline", "current")
            for c in ("rmse", "r2", "mae")
        ],
        (F.lit(0).cast("bigint") if test_mode else F.coalesce(of("baseline", "n"), F.lit(0))).alias(
            "test_baseline_size"
        ),
        F.coalesce(of("current", "n"), F.lit(0)).alias("test_current_size"),
    )
    flag = F.lit(False) if test_mode else F.coalesce(F.col("r2_baseline") < r2_floor, F.lit(False))
    return out.withColumn("baseline_regression", flag)


def evl_champion_baseline(model, test: DataFrame, y: str = "count") -> DataFrame:
    """A fitted model on the fixed test set."""
    return evl_regression(model.transform(test), y, "prediction")


def evl_overfit_gap(
    metrics: DataFrame, limit: float = OVERFIT_LIMIT, train: str = "r2_train", current: str = "r2_current"
) -> DataFrame:
    """Train R² minus current R², flagged above the limit."""
    return metrics.withColumn("r2_gap", F.col(train) - F.col(current)).withColumn(
        "possible_overfit", F.col("r2_gap") > limit
    )
