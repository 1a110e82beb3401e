"""Features, models and scoring. Fitted models have no SQL form; their queries give what must hold for
any model that learned, on counts that follow from the sensor and the hour."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    BASE,
    CUR,
    R,
    RT,
    SCORED,
    baseline,
    current,
    local_sql,
    profile_scored,
    query,
    readings,
    typed_readings,
    with_,
)
from sensorspark.operators.clean import prj_calendar_parts
from sensorspark.operators.evaluate import (
    evl_champion_baseline,
    evl_classification,
)
from sensorspark.operators.encode import ml_target_encode
from sensorspark.operators.features import (
    ml_assemble,
    ml_clean_pipeline,
    ml_cyclical_features,
    ml_label_encode,
    ml_one_hot,
    ml_standardize,
    vector_total,
    vector_width,
)
from sensorspark.operators.models import (
    ABLATION_MARGIN,
    ml_ablation,
    ml_baselines,
    ml_batch_score,
    ml_cross_validate,
    ml_embedding_regressor,
    ml_feature_importance,
    ml_rf_classifier,
    ml_rf_regressor,
    ml_save_load,
    ml_train_window,
    spread,
)
from sensorspark.operators.split import spl_label_stratified
from sensorspark.session import scratch_path

CYCLE = f"""SELECT sensor_id, reading_ts, count, row_key, CAST(day(lt) AS INTEGER) AS day, CAST(year(lt) AS INTEGER) AS year,
    CAST(isodow(lt) - 1 AS INTEGER) AS weekday, sin(2 * pi() * hour(lt) / 24) AS hour_sin, cos(2 * pi() * hour(lt) / 24) AS hour_cos,
    sin(2 * pi() * month(lt) / 12) AS month_sin, cos(2 * pi() * month(lt) / 12) AS month_cos,
    CASE year(lt) WHEN 2024 THEN 0 WHEN 2025 THEN 1 END AS year_idx
    FROM (SELECT *, {local_sql('reading_ts')} AS lt FROM r)"""
WAVES = ["hour_sin", "hour_cos", "month_sin", "month_cos"]


@query("ml_cyclical_features", with_(R, CYCLE), rounds=WAVES)
def cyclical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml_cyclical_features(prj_calendar_parts(readings(spark, sf_dir)))


@query("ml_clean_pipeline", with_(R, CYCLE.replace("CAST(isodow(lt) - 1 AS INTEGER)", "CAST(isodow(lt) - 1 AS TINYINT)")), rounds=WAVES)
def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return ml_clean_pipeline().fit(r).transform(r)


@query(
    "ml_label_encode",
    with_(
        R,
        """SELECT row_key, CAST(dense_rank() OVER (ORDER BY CAST(sensor_id AS VARCHAR)) - 1 AS INTEGER) AS sensor_idx FROM r""",
    ),
)
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml_label_encode(readings(spark, sf_dir)).select("row_key", "sensor_idx")


KINDS = ["click", "error", "purchase", "signup", "view"]
UNSEEN = "CASE WHEN reading_ts >= TIMESTAMP '2024-01-22' AND row_key % 10 = 0 THEN 'new' ELSE source END"


@query(
    "ml_one_hot",
    with_(RT, "SELECT row_key, " + ", ".join(f"CASE WHEN {UNSEEN} = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_{k}" for k in KINDS) + " FROM rt"),
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on early readings; a kind that only appears later is all zeros."""
    rt = typed_readings(spark, sf_dir)
    late = rt.withColumn("source", F.expr(UNSEEN))
    vec = vector_to_array("source_vec")
    return ml_one_hot(late, ["source"], fit_on=baseline(rt)).select(
        "row_key", *[vec[i].alias(f"is_{k}") for i, k in enumerate(KINDS)]
    )




ENCODED = """tf AS (SELECT *, reading_ts >= TIMESTAMP '2024-01-22' AS late, ('0x' || substr(md5(CAST(row_key AS VARCHAR) || 'fold'), 1, 8))::BIGINT % 5 AS fold FROM r),
    ts AS (SELECT sensor_id, fold, count(*) AS n, sum(count) AS s FROM tf WHERE NOT late GROUP BY ALL),
    ta AS (SELECT sensor_id, sum(n) AS n, sum(s) AS s FROM ts GROUP BY 1),
    tm AS (SELECT avg(count) AS prior FROM tf WHERE NOT late)"""


@query(
    "ml_target_encode",
    with_(
        R,
        ENCODED,
        """SELECT row_key, CASE WHEN late THEN (coalesce(a.s, 0) + 10 * prior) / (coalesce(a.n, 0) + 10)
          ELSE (a.s - f.s + 10 * prior) / (a.n - f.n + 10) END AS sensor_mean
        FROM tf LEFT JOIN ta a USING (sensor_id) LEFT JOIN ts f ON f.sensor_id = tf.sensor_id AND f.fold = tf.fold, tm""",
    ),
    rounds=["sensor_mean"],
)
def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early readings out of fold, later ones by all early readings."""
    r = readings(spark, sf_dir)
    early = baseline(r)
    parts = [ml_target_encode(early, keyCols=["row_key"]), ml_target_encode(current(r), fit_on=early, keyCols=["row_key"])]
    return parts[0].unionByName(parts[1]).select("row_key", "sensor_mean")


@query(
    "ml_standardize",
    with_(
        R,
        f"f AS ({CYCLE})",
        "SELECT row_key, "
        + ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-12 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}_z" for c in ("day", "hour_sin", "hour_cos"))
        + " FROM f",
    ),
    rounds=["day_z", "hour_sin_z", "hour_cos_z"],
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ml_cyclical_features(prj_calendar_parts(readings(spark, sf_dir)))
    cols = ["day", "hour_sin", "hour_cos"]
    return ml_standardize(f, cols).select("row_key", *[f"{c}_z" for c in cols])


NUMBERS = ("day", "year_idx", "hour_sin", "hour_cos", "month_sin", "month_cos")
FLAT = "(max({c}) OVER () - min({c}) OVER () < 1e-12)"


@query(
    "ml_assemble",
    with_(
        R,
        f"f AS ({CYCLE})",
        "SELECT row_key, (SELECT CAST(count(DISTINCT weekday) + count(DISTINCT sensor_id) + 6 AS INTEGER) FROM f) AS width, 2 + "
        + " + ".join(f"CASE WHEN {FLAT.format(c=c)} THEN 0 ELSE ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () END" for c in NUMBERS)
        + " AS total FROM f",
    ),
    rounds=["total"],
)
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths and totals from the stored entries of the vectors: a sparse one is never laid out in full."""
    return ml_assemble(readings(spark, sf_dir)).select(
        "row_key",
        vector_width("features").alias("width"),
        vector_total("features").alias("total"),
    )


@query(
    "ml_assemble_target",
    with_(R, f"f AS ({CYCLE})", "SELECT row_key, (SELECT CAST(count(DISTINCT weekday) + 7 AS INTEGER) FROM f) AS width FROM f"),
)
def assemble_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width does not follow the sensors."""
    return ml_assemble(readings(spark, sf_dir), sensor_as="target").select("row_key", F.size(vector_to_array("features")).alias("width"))


def patterned(df: DataFrame) -> DataFrame:
    """Readings whose count follows from the sensor and the hour, so that a model which learns must
    do better than the mean."""
    return df.withColumn("count", (F.col("sensor_id") % 7 * 10 + F.hour("reading_ts")).cast("double"))


def facts(predicted: DataFrame, *by: str) -> DataFrame:
    """What must hold for a model that learned: rows scored, and an error below the mean's."""
    error = F.col("count") - F.col("prediction")
    return predicted.groupBy(*by).agg(
        F.count("prediction").alias("n_rows"), (F.avg(error * error) < F.var_pop("count")).alias("beats_mean")
    )


CUR_FACTS = with_(R, CUR, "SELECT count(*) AS n_rows, true AS beats_mean FROM cur")


def fitted(spark: SparkSession, sf_dir: str, **options) -> PipelineModel:
    """The forest at the library's own size, fitted anew by every query on its tables as they are."""
    return ml_rf_regressor(**options).fit(spread(patterned(baseline(readings(spark, sf_dir)))))


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterned(current(readings(spark, sf_dir)))


@query("ml_rf_regressor", CUR_FACTS)
def rf_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(fitted(spark, sf_dir).transform(fresh(spark, sf_dir)))


@query("ml_rf_regressor_category", CUR_FACTS)
def rf_regressor_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor as one categorical feature, with a bin for every sensor."""
    r = readings(spark, sf_dir)
    bins = max(32, r.select("sensor_id").distinct().count() + 2)
    forest = ml_rf_regressor(sensor_as="category", maxBins=bins)
    return facts(forest.fit(spread(patterned(baseline(r)))).transform(fresh(spark, sf_dir)))


@query(
    "ml_rf_classifier",
    with_(
        R,
        """b AS (SELECT row_key, CASE WHEN hour(reading_ts) >= 12 THEN 1 ELSE 0 END AS affluence FROM r)""",
        """k AS (SELECT *, row_number() OVER (PARTITION BY affluence ORDER BY md5(CAST(row_key AS VARCHAR) || '42')) AS i,
           count(*) OVER (PARTITION BY affluence) AS n FROM b)""",
        """SELECT count(*) AS n_rows, true AS beats_majority FROM k
        WHERE i <= CASE WHEN n < 2 THEN 0 ELSE greatest(1, round(n * 0.2::DOUBLE)) END""",
    ),
)
def rf_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy hours are those of the afternoon."""
    labelled = readings(spark, sf_dir).withColumn("affluence", F.when(F.hour("reading_ts") >= 12, 1.0).otherwise(0.0))
    train, test = spl_label_stratified(labelled, key="row_key")
    m = evl_classification(ml_rf_classifier().fit(spread(train)).transform(test))
    n, busy = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.col("tp") + F.col("fn")
    return m.select(n.alias("n_rows"), (F.col("accuracy") > F.greatest(busy, n - busy) / n).alias("beats_majority"))


@query("ml_embedding_regressor", CUR_FACTS)
def embedding_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = ml_embedding_regressor().fit(spread(patterned(baseline(readings(spark, sf_dir)))))
    return facts(model.transform(fresh(spark, sf_dir)))


HELD = "substr(md5(CAST(row_key AS VARCHAR)), 1, 4) >= 'cccd'"


@query(
    "ml_train_window",
    with_(
        R,
        BASE,
        CUR,
        "w AS (SELECT count(*) > 0 AS slid FROM cur)",
        f"""SELECT slid, (SELECT count(*) FROM base) + CASE WHEN slid THEN (SELECT count(*) FROM cur WHERE NOT {HELD}) ELSE 0 END AS n_train,
        (SELECT count(*) FROM cur WHERE {HELD} OR NOT slid) AS n_rows, true AS beats_mean FROM w""",
    ),
)
def train_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = patterned(readings(spark, sf_dir))
    result = ml_train_window(baseline(r), current(r), ml_rf_regressor(), key=["row_key"])
    # The split has counted the current rows.
    n = baseline(r).agg(F.count(F.lit(1)) + F.lit(result.n_current)).scalar()
    return facts(result.model.transform(result.test_current)).select(F.lit(result.sliding_window).alias("slid"), n.alias("n_train"), "n_rows", "beats_mean")


@query(
    "ml_batch_score",
    with_(
        R,
        CUR,
        """SELECT sensor_id, reading_ts, (sensor_id % 7 * 10 + hour(reading_ts))::DOUBLE AS count, 'rf' AS model_type, 'v1' AS model_version,
        TIMESTAMP '2024-02-01 06:00:00' AS prediction_ts, CAST(reading_ts AS DATE) AS pred_date, true AS scored FROM cur""",
    ),
)
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = {"model_type": "rf", "model_version": "v1"}
    out = ml_batch_score(fitted(spark, sf_dir), fresh(spark, sf_dir), tags, "2024-02-01 06:00:00")
    return out.withColumn("scored", F.col("prediction").isNotNull()).drop("prediction")


@query("ml_profile_score", with_(*SCORED, "SELECT * FROM p"), rounds=["prediction"])
def profile_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_scored(spark, sf_dir)


@query(
    "ml_feature_importance",
    with_(
        R,
        BASE,
        f"f AS ({CYCLE.replace('FROM r)', 'FROM base)')})",
        """SELECT count(DISTINCT weekday) + count(DISTINCT sensor_id) + 6 AS n_features, true AS sums_to_one, true AS in_order FROM f""",
    ),
)
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the forest, most important first, with a column for each sensor."""
    top = ml_feature_importance(fitted(spark, sf_dir, sensor_as="one_hot"), readings(spark, sf_dir), k=1 << 30)
    w = F.sort_array(F.collect_list(F.struct("position", "importance")))
    falls = F.forall(F.arrays_zip(F.slice(w, 1, F.size(w) - 1).alias("a"), F.slice(w, 2, F.size(w)).alias("b")), lambda p: p["a"]["importance"] >= p["b"]["importance"])
    return top.agg(F.count(F.lit(1)).alias("n_features"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"), falls.alias("in_order"))


@query("ml_ablation", "SELECT true AS learns, true AS gains_more_than_the_margin, 'keep' AS advice")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count depends on the sensor, so leaving it out must cost."""
    out = ml_ablation(
        patterned(readings(spark, sf_dir)), ml_rf_regressor(), ml_rf_regressor(with_sensor=False), key=["row_key"]
    )
    return out.select((F.col("r2_with_feature") > 0).alias("learns"), (F.col("r2_gain") > ABLATION_MARGIN).alias("gains_more_than_the_margin"), "advice")


@query("ml_cross_validate", "SELECT 'r2' AS metric, 3::INTEGER AS folds, true AS learns, true AS spread_known")
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ml_cross_validate(patterned(readings(spark, sf_dir)), ml_rf_regressor(), key="row_key")
    return out.select("metric", "folds", (F.col("mean") > 0).alias("learns"), (F.col("std") >= 0).alias("spread_known"))


@query(
    "ml_baselines",
    with_(R, f"SELECT model, count(*) AS n, true AS beats_mean FROM r, (VALUES ('linear'), ('boosted_trees')) AS t(model) WHERE {HELD} GROUP BY model"),
)
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml_baselines(patterned(readings(spark, sf_dir)), key=["row_key"]).select("model", "n", (F.col("r2") > 0).alias("beats_mean"))


@query("ml_save_load", with_(R, CUR, "SELECT count(*) AS n_rows, 0::BIGINT AS different FROM cur"))
def save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose prediction differs between a model and its reloaded copy, and all readings."""
    model = fitted(spark, sf_dir)
    again = ml_save_load(model, scratch_path(spark, "model"))
    rows = fresh(spark, sf_dir)
    a = model.transform(rows).select("row_key", F.col("prediction").alias("a"))
    b = again.transform(rows).select("row_key", F.col("prediction").alias("b"))
    return a.join(b, "row_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("different")
    )


@query("evl_champion_baseline", with_(R, CUR, "SELECT count(*) AS n, true AS beats_mean FROM cur"))
def champion_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evl_champion_baseline(fitted(spark, sf_dir), fresh(spark, sf_dir))
    return out.select("n", (F.col("r2") > 0).alias("beats_mean"))
