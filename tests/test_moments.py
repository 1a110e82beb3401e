from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.functions.moments import weighted_moments
from sensorspark.functions.ordering import salted_join
from sensorspark.operators.evaluate import evl_regression
from sensorspark.operators.stats import stat_paired_t


def test_weighted_moments_far_from_zero(spark, frame):
    rng = np.random.default_rng(1)
    rows = [(g, 1e9 + float(v), int(w)) for g, v, w in zip(["a", "b"] * 150, rng.normal(size=300), rng.integers(1, 6, 300))]
    rows += [("a", None, 3), ("b", 5.0, None), ("b", 7.0, 0), ("c", 2.0, 4)]
    df = frame(rows, "g string, x double, w long")
    got = {r["g"]: r for r in weighted_moments(df, F.col("x"), F.col("w"), ["g"], {"s": F.col("x") * 0 + 2}).collect()}
    for g in "abc":
        x = np.repeat([r[1] for r in rows if r[0] == g and r[1] is not None and r[2]], [r[2] for r in rows if r[0] == g and r[1] is not None and r[2]])
        assert got[g]["n"] == len(x) and got[g]["s"] == 2 * len(x)
        assert got[g]["mean"] == pytest.approx(x.mean(), rel=1e-15) and got[g]["dev2"] == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-6, abs=1e-9)
        assert (got[g]["low"], got[g]["high"]) == (x.min(), x.max())
    none = weighted_moments(df.limit(0), F.col("x"), F.col("w")).first()
    assert none["n"] == 0 and none["mean"] is None


def test_weighted_regression_and_paired_t_equal_repeated_rows(frame):
    rows = [(float(i % 7), float(i % 5) + 0.25, 1 + i % 4) for i in range(60)] + [(None, 1.0, 2), (3.0, None, 5)]
    df = frame(rows, "count double, prediction double, w long")
    long = df.withColumn("w", F.explode(F.sequence(F.lit(1), F.col("w"))))
    for a, b in zip(evl_regression(df, weight="w").first(), evl_regression(long).first(), strict=True):
        assert a == pytest.approx(b, rel=1e-12)
    for a, b in zip(stat_paired_t(df, "count", "prediction", "w").first(), stat_paired_t(long, "count", "prediction").first(), strict=True):
        assert a == pytest.approx(b, rel=1e-12)
    assert evl_regression(df.limit(0), weight="w").first()["n"] == 0


def keyed(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"),
        (F.col("id") % 2).alias("v"),
    )
    small = spark.range(800).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("x")).union(spark.createDataFrame([("hot", -1)], "k string, x long"))
    return rows, small


def test_keyed_join_by_measured_size(spark):
    """Broadcast while the stored side is small, else hot keys alone in parts."""
    rows, small = keyed(spark)
    want = sorted(map(str, rows.join(small, "k", "left").collect()))
    by_broadcast, by_parts = salted_join(rows, small, ["k"]), salted_join(rows, small, ["k"], most_bytes=0)
    for out in (by_broadcast, by_parts):
        assert sorted(map(str, out.select("k", "v", "x").collect())) == want
    plain = by_broadcast._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plain and "Exchange hashpartitioning" not in plain
    parts = by_parts._jdf.queryExecution().optimizedPlan().toString()
    assert parts.count("Generate") == 1 and "__salt" in parts


def test_a_hot_key_meets_in_many_parts(spark):
    rows, small = keyed(spark)
    out = salted_join(rows.repartition(40), small, ["k"], most_bytes=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        hot = salted_join(rows.repartition(40), small, ["k"], most_bytes=0).where("k = 'hot'")
        sizes = [r["n"] for r in hot.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) >= 20 and max(sizes) < 0.2 * sum(sizes) and out.count() == 20_000
    assert math.isclose(sum(sizes), 6667)
