"""Statistics against numpy on the raw samples, tails against published table values."""

from __future__ import annotations

import random

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorspark.functions.tails import _chi_square_upper, _normal_two_sided, _student_two_sided
from sensorspark.operators.drift import (
    categorical_drift,
    drf_column_drift,
    drf_dataset_drift,
    drf_schema_drift,
    numeric_drift,
)
from sensorspark.operators.evaluate import evl_roc_auc, roc_points
from sensorspark.operators.joins import jn_source_match, match_rate
from sensorspark.operators.profile import agg_describe, agg_key_distribution, agg_outliers_iqr
from sensorspark.operators.stats import (
    match_paired_t,
    stat_ks_2samp,
    stat_mannwhitney,
    stat_match_quality,
    stat_paired_t,
    stat_quality_score,
)


def test_tails():
    assert math.isclose(_normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    for t, df, p in ((2.0, 10, 0.0733880), (12.7062, 1, 0.05), (2.228139, 10, 0.05), (1.959964, 1e7, 0.05), (0.0, 5, 1.0)):
        assert math.isclose(_student_two_sided(t, df), p, rel_tol=1e-4)
    for x, df, p in ((3.841459, 1, 0.05), (18.307038, 10, 0.05), (0.0, 3, 1.0), (124.342113, 100, 0.05)):
        assert math.isclose(_chi_square_upper(x, df), p, rel_tol=1e-5)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(3)
    a = np.concatenate([np.zeros(400), np.round(rng.normal(50, 20, 600), 0)])  # a third of copies
    b = np.round(rng.normal(45, 25, 700), 0)
    return a, b, *(spark.createDataFrame(pd.DataFrame({"v": x})) for x in (a, b))


def test_ks(samples):
    a, b, da, db = samples
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    got = stat_ks_2samp(da, db, "v").first()
    assert math.isclose(got.statistic, want, rel_tol=1e-12) and (got.n_a, got.n_b) == (1000, 700)
    lam = math.sqrt(1000 * 700 / 1700) * want
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 100))
    assert math.isclose(got.p_value, min(1, max(0, p)), abs_tol=1e-9) and not got.passed


def test_same_sample_never_differs(samples):
    _, _, da, _ = samples
    ks, mw = stat_ks_2samp(da, da, "v").first(), stat_mannwhitney(da, da, "v").first()
    assert (ks.statistic, ks.p_value, ks.passed) == (0.0, 1.0, True)
    assert mw.u == 1000 * 1000 / 2 and mw.p_value == 1.0 and mw.passed


def test_mann_whitney(samples):
    a, b, da, db = samples
    u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    _, ties = np.unique(np.concatenate([a, b]), return_counts=True)
    n = 1700
    s = math.sqrt(1000 * 700 / 12 * (n + 1 - (ties.astype(float) ** 3 - ties).sum() / (n * (n - 1))))
    z = (max(u, 700000 - u) - 350000 - 0.5) / s
    got = stat_mannwhitney(da, db, "v").first()
    assert got.u == u and math.isclose(got.z, z, rel_tol=1e-12)
    assert math.isclose(got.p_value, math.erfc(z / math.sqrt(2)), rel_tol=1e-9)


def test_paired_t(frame):
    rows = [(1.0, 2.0), (2.0, 2.5), (3.0, 2.0), (4.0, 6.0), (5.0, 5.5)]
    got = stat_paired_t(frame(rows, "count_a double, count_b double")).first()
    d = np.array([a - b for a, b in rows])
    t = d.mean() / (d.std(ddof=1) / math.sqrt(5))
    assert math.isclose(got.t, t) and math.isclose(got.mean_difference, d.mean())
    assert math.isclose(got.p_value, _student_two_sided(t, 4), rel_tol=1e-9)


def test_weights_stand_for_rows(frame):
    one = frame([(1.0, 2.0, 3), (4.0, 2.0, 2)], "count_a double, count_b double, w int")
    many = frame([(1.0, 2.0)] * 3 + [(4.0, 2.0)] * 2, "count_a double, count_b double")
    a, b = stat_paired_t(one, weight="w").first(), stat_paired_t(many).first()
    assert a.n_pairs == b.n_pairs == 5 and math.isclose(a.t, b.t)


def test_matches_equal_all_pairs(spark):
    """Sums and ranks give what the pairs would; one key holds a third of both sides."""
    rng = np.random.default_rng(11)

    def side(n):
        key = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 30, n).astype(str))
        hour = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.where(key == "hot", 0, rng.integers(0, 3, n)), "h")
        return pd.DataFrame({"sensor_key": key, "date_hour": hour, "count": rng.integers(1, 40, n).astype(float)})

    pa, pb = side(600), side(500)
    da, db = spark.createDataFrame(pa), spark.createDataFrame(pb)
    pairs = pa.merge(pb, on=["sensor_key", "date_hour"], suffixes=("_a", "_b"))
    d = pairs.count_a - pairs.count_b
    m = jn_source_match(da, db)
    q = stat_match_quality(da, db).first()
    assert m.agg(F.sum("pairs")).first()[0] == len(pairs) == q.n_pairs
    assert math.isclose(q.mae, d.abs().mean(), rel_tol=1e-9)
    assert math.isclose(q.mape, (d.abs() / pairs.count_a * 100).mean(), rel_tol=1e-9)
    assert math.isclose(q.pearson_r, pairs.count_a.corr(pairs.count_b), rel_tol=1e-6)
    t = match_paired_t(m).first()
    assert math.isclose(t.t, d.mean() / (d.std() / math.sqrt(len(d))), rel_tol=1e-9)
    r = match_rate(m, da, db).first()
    assert math.isclose(r.match_rate, len(pairs) / 500 * 100)


def test_no_match(frame):
    a = frame([("x", "2024-01-01 00:00:00", 1.0)], "sensor_key string, date_hour timestamp_ntz, count double")
    b = frame([("y", "2024-01-01 00:00:00", 1.0)], "sensor_key string, date_hour timestamp_ntz, count double")
    q = stat_match_quality(a, b).first()
    assert (q.n_pairs, q.pearson_r, q.mae, q.mape) == (0, None, None, None)
    assert match_rate(jn_source_match(a, b), a, b).first().match_rate == 0


@pytest.mark.parametrize(
    "passed, want", [(4, "trustworthy"), (3, "trustworthy"), (2, "investigate"), (1, "not_recommended")]
)
def test_quality_score(frame, passed, want):
    checks = frame([("c", 0.0, i < passed) for i in range(4)], "check string, score double, passed boolean")
    assert stat_quality_score(checks).first().recommendation == want


def test_drift_of_a_set_against_itself(samples):
    _, _, da, _ = samples
    df = da.withColumn("kind", (F.col("v") % 5).cast("string"))
    n = numeric_drift(df, df, ["v"]).first()
    c = categorical_drift(df, df, ["kind"]).first()
    assert (n.ks, n.ks_p, n.wasserstein) == (0, 1, 0)
    assert abs(c.chi_square) < 1e-9 and c.jensen_shannon < 1e-7 and abs(c.psi) < 1e-12 and c.chi_square_p == 1
    out = drf_dataset_drift(drf_column_drift(df, df)).first()
    assert not out.drift_detected and out.drifted_features == [] and out.total_features == 2


def test_drift_methods(samples):
    a, b, da, db = samples
    grid = np.unique(np.concatenate([a, b]))
    gaps = np.abs([(a <= x).mean() - (b <= x).mean() for x in grid[:-1]])
    got = numeric_drift(da, db, ["v"]).first()
    assert math.isclose(got.wasserstein, (gaps * np.diff(grid)).sum() / a.std(), rel_tol=1e-9)
    for method, name in (("p_value", "ks"), ("distance", "wasserstein")):
        row = drf_column_drift(da, db, method=method).first()
        assert row.method == name and row.drifted
    raised = drf_column_drift(da, db, method="distance", thresholds={"wasserstein": 99.0}).first()
    assert not raised.drifted
    with pytest.raises(ValueError):
        drf_column_drift(da, db, method="other")


def test_new_category_is_seen(frame):
    a = frame([("x",)] * 30, "k string")
    b = frame([("x",)] * 15 + [("y",)] * 15, "k string")
    row = categorical_drift(a, b, ["k"]).first()
    assert row.chi_square_p < 0.001 and row.jensen_shannon > 0.1 and row.psi > 1


def test_no_common_column(frame):
    out = drf_schema_drift(frame([(1,), (2,)], "a int"), frame([(1,)], "b int")).first()
    assert (out.drift_share, out.drift_detected, out.schema_drift) == (1.0, True, True)
    assert (out.reference_size, out.current_size, out.total_features) == (2, 1, 0)


def test_auc(frame):
    rows = [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, None), (0, 0.8)]
    df = frame(rows, "affluence int, score double")
    pos, neg = [0.9, 0.4], [0.4, 0.1, 0.8]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 6
    assert math.isclose(evl_roc_auc(df).first().auc, want)
    pts = {r.threshold: (round(r.fpr, 6), r.tpr) for r in roc_points(df).collect()}
    assert pts[0.9] == (0.0, 0.5) and pts[0.1] == (1.0, 1.0)
    assert evl_roc_auc(df.where("affluence = 1")).first().auc is None


def test_describe_and_outliers(frame):
    values = [1.0] * 500 + [float(i) for i in range(1, 101)] + [1000.0, None]
    df = frame([(v,) for v in values], "v double")
    s = pd.Series(values).dropna()
    d = agg_describe(df, "v").first()
    want = s.describe()
    for got, name in ((d.n_rows, "count"), (d.mean, "mean"), (d["std"], "std"), (d.q25, "25%"), (d.q50, "50%"), (d.q75, "75%"), (d["max"], "max")):
        assert math.isclose(got, want[name], rel_tol=1e-9), name
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    out = ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
    assert agg_outliers_iqr(df, "v").first().outliers == out
    one = agg_describe(frame([(5.0,)], "v double"), "v").first()
    assert one["std"] is None and one.q50 == 5.0


def test_key_distribution(frame):
    rows = [("hot",)] * 5000 + [("a",)] * 3 + [("b",)] * 3 + [("c",)] * 12
    d = agg_key_distribution(frame(rows, "sensor_id string")).first()
    assert (d.n_keys, d.min_rows, d.max_rows, d.median_rows, d.rare_keys) == (4, 3, 5000, 7.5, 2)


def test_spreads_far_from_zero(frame):
    """Values near 1e9 give what they give near 0."""
    rng = random.Random(1)
    a = [(i, rng.gauss(0, 0.03)) for i in range(3000)]
    b = [(i, x + 0.02 + rng.gauss(0, 0.001)) for i, x in a]

    def at(offset, rows):
        return frame([(str(i % 500), "2024-01-01 00:00:00", x + offset) for i, x in rows], "sensor_key string, date_hour timestamp_ntz, count double")

    near = [numeric_drift(at(o, a), at(o, b), ["count"]).first().wasserstein for o in (0.0, 1e9)]
    assert abs(near[0] - near[1]) < 1e-3 and 0.5 < near[0] < 0.9
    quality = [stat_match_quality(at(o, a), at(o, b)).first() for o in (0.0, 1e9)]
    assert abs(quality[0].pearson_r - quality[1].pearson_r) < 1e-3 and abs(quality[0].mae - quality[1].mae) < 1e-5
    paired = [match_paired_t(jn_source_match(at(o, a), at(o, b))).first() for o in (0.0, 1e9)]
    assert abs(paired[0].t / paired[1].t - 1) < 1e-3
    d = frame([(x + 1e9, 0.0) for _, x in a], "count_a double, count_b double")
    t = stat_paired_t(d).first()
    mean = sum(x for x, in [(r.count_a,) for r in d.collect()]) / 3000
    sd = math.sqrt(sum((r.count_a - mean) ** 2 for r in d.collect()) / 2999)
    assert abs(t.t / (mean / (sd / math.sqrt(3000))) - 1) < 1e-3
