"""Ordered scans against plain numpy, including groups that hold most of the rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorspark.functions.columns import micros
from sensorspark.functions.ordering import (
    hash_cut,
    hash_order,
    quantiles,
    ranked_values,
    running,
    split_points,
    top_k_per_group,
    value_counts,
    with_bucket,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold most rows."""
    rng = np.random.default_rng(7)
    n = 5000
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 20, n)),
            "v": np.where(rng.random(n) < 0.4, 5.0, np.round(rng.exponential(30, n), 1)),
            "id": np.arange(n),
        }
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("p", [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0])
def test_quantiles(skewed, p):
    pdf, df = skewed
    got = {r.g: r.q for r in quantiles(df, ["g"], "v", {"q": p}).collect()}
    want = pdf.groupby("g").v.quantile(p)
    assert got.keys() == set(want.index)
    assert all(abs(got[g] - want[g]) < 1e-9 for g in want.index)


def test_quantiles_without_group_and_with_bad_points(skewed):
    pdf, df = skewed
    for points in ([], [1e9], [5.0], None):
        assert abs(quantiles(df, [], "v", {"q": 0.3}, points).first().q - pdf.v.quantile(0.3)) < 1e-9


def test_quantiles_of_nothing(frame):
    empty = frame([], "g int, v double")
    assert quantiles(empty, ["g"], "v", {"q": 0.5}).count() == 0
    assert quantiles(empty, [], "v", {"q": 0.5}).first().q is None
    nulls = frame([(1, None), (1, 3.0)], "g int, v double")
    assert quantiles(nulls, ["g"], "v", {"q": 0.5}).first().q == 3.0


def test_null_values_keep_their_rows(frame):
    df = frame([(1, None), (1, None), (1, 3.0), (2, None)], "g int, v double")
    got = {(r.g, r.x): (r.n, r.cum, r.cum_total) for r in ranked_values(df, ["g"], "v", nulls=True).collect()}
    assert got == {(1, None): (2, 0, 1), (1, 3.0): (1, 1, 1), (2, None): (1, 0, 0)}


def test_running_values(skewed):
    pdf, df = skewed
    counts = with_bucket(value_counts(df, ["g"], "v"), "x", split_points(df, "v", 16))
    out = running(
        counts,
        ["g"],
        "x",
        measures={
            "s": ("sum", F.col("n")),
            "hi": ("max", F.col("n")),
            "lo": ("min", F.col("n")),
            "prev": ("previous", F.col("x")),
        },
    ).toPandas()
    want = pdf.groupby(["g", "v"]).size().rename("n").reset_index()
    by = want.groupby("g").n
    want["s"], want["hi"], want["lo"] = by.cumsum(), by.cummax(), by.cummin()
    want["prev"] = want.groupby("g").v.shift()
    want["s_total"] = by.transform("sum")
    out = out.sort_values(["g", "x"]).reset_index(drop=True)
    for c in ("s", "hi", "lo", "s_total", "prev"):
        assert np.array_equal(out[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True), c


def test_buckets_are_bounded(skewed):
    """Whatever the values, no bucket has more distinct values than rows of its share."""
    pdf, df = skewed
    counts = with_bucket(value_counts(df, [], "v"), "x", split_points(df, "v", 32))
    worst = counts.groupBy("order_bucket").count().agg(F.max("count")).first()[0]
    assert worst <= len(pdf) // 8


def test_hash_cut(skewed):
    pdf, df = skewed
    hashed = df.withColumn("h", hash_order("id", 42))
    cuts = {r.g: r.cut for r in hash_cut(hashed, ["g"], "h", lambda n: F.floor(n * 0.2)).collect()}
    pdf = pdf.assign(h=[hashlib.md5(f"{i}42".encode()).hexdigest() for i in pdf.id])
    for g, part in pdf.groupby("g"):
        quota = int(len(part) * 0.2)
        want = sorted(part.h)[quota - 1] if quota else None
        assert cuts.get(g) == want


def test_copies_of_a_key_stay_together(frame):
    df = frame([(1, 7)] * 50 + [(1, i) for i in range(100, 150)], "g int, id int")
    hashed = df.withColumn("h", hash_order("id", 1))
    cut = hash_cut(hashed, ["g"], "h", lambda n: F.floor(n * 0.5)).first().cut
    assert hashed.where((F.col("h") <= cut) & (F.col("id") == 7)).count() in (0, 50)
    assert hashed.where(F.col("h") <= cut).count() >= 50


def test_top_k(skewed):
    pdf, df = skewed
    got = top_k_per_group(df.repartition(5), ["g"], [F.desc("v"), F.col("id")], 3).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("g").head(3)
    assert set(got.id) == set(want.id)


def test_top_k_of_copies(frame):
    df = frame([(1, 1)] * 100, "g int, v int").repartition(4)
    assert top_k_per_group(df, ["g"], [F.col("v")], 10).count() == 10


def test_wall_times_do_not_depend_on_the_session_zone(spark, frame):
    times = ["1969-12-31 23:59:59.5", "2024-03-31 02:30:00.000001", "2024-03-31 03:00:00", "2024-10-27 02:30:00"]
    df = frame([(t,) for t in times], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        got = [r[0] for r in df.select(micros(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [pd.Timestamp(t).value // 1000 for t in times]
