"""Sources, sinks, joins, sets, splits and rankings on small edge cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sensorspark.operators.combine import (
    set_concat_align,
    set_key_overlap,
    set_quarter_merge,
    set_schema_diff,
    set_schema_gate,
)
from sensorspark.operators.joins import (
    jn_dedup_merge,
    jn_pred_actual,
    jn_unknown_anti,
    jn_unknown_fallback,
    unknown_summary,
)
from sensorspark.operators.profile import (
    agg_continuity_gap,
    agg_freshness_check,
    agg_ingest_check,
    agg_kv_pivot,
    agg_latest_row,
    agg_null_dup_profile,
    agg_prediction_check,
)
from sensorspark.operators.ranking import win_group_threshold, win_peak_per_sensor
from sensorspark.operators.split import (
    spl_holdout,
    spl_random_sample,
    spl_stratified,
    spl_stratified_sample,
    spl_temporal,
    spl_verify_iso,
)
from sensorspark.sources.files import (
    src_csv_readings,
    src_csv_sep_detect,
    src_json_pages,
    src_registry_json,
    src_wildcard_partitions,
)
from sensorspark.sources.sinks import (
    snk_append_partitioned,
    snk_csv_split,
    snk_replace_day,
)
from sensorspark.sources.tables import src_daily_union, src_unified_view, src_warehouse_window

READ = "sensor_id string, reading_ts timestamp_ntz, count double"


def text(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_csv_spellings_and_separators(spark, tmp_path):
    a = text(tmp_path, "a.csv", "Nom du compteur;Comptage horaire;Date et heure de comptage\nA;1.5;x\nB;;y\nC;n/a;z\n")
    b = text(tmp_path, "b.csv", "nom_du_compteur,comptage_horaire,date\nA,2,x\n")
    for path, n in ((a, 1), (b, 1)):
        df = src_csv_readings(spark, path, sep=None)
        assert df.count() == n and dict(df.dtypes)["count"] == "double"
    assert src_csv_sep_detect(spark, a).sensor == "Nom du compteur"
    layout = src_csv_sep_detect(spark, b)
    assert (layout.sep, layout.value, layout.ts) == (",", "comptage_horaire", "date")
    # Read with the wrong separator there is no target column.
    with pytest.raises(ValueError):
        src_csv_readings(spark, b, sep=";", preserve_target=False)
    assert "count" not in src_csv_readings(spark, b, sep=";").columns


def test_pages(spark, frame):
    rec = {"date": "2024-01-01T00:00:00", "sum_counts": 3, "id_compteur": "1", "nom_compteur": "A", "coordinates": {"lat": 1.0, "lon": 2.0}}
    pages = [{"total_count": 2, "results": [rec, {**rec, "coordinates": None}]}, {"total_count": 1, "results": [{"fields": {**rec, "id_compteur": "2"}}]}, {"results": []}]
    df = frame([(json.dumps(p),) for p in pages] + [("broken",)], "body string")
    got = src_json_pages(df, "body").orderBy("id_compteur").collect()
    assert [r.id_compteur for r in got] == ["1", "1", "2"] and got[2].coordinates.lat == 1.0
    assert src_json_pages(df, "body", max_records=2).count() == 2


def test_registry_file(spark, tmp_path):
    entry = {"run_id": "a", "model_type": "rf", "env": "prod", "test_mode": False, "rmse": 1.0, "model_uri": "u"}
    many = text(tmp_path, "many.json", json.dumps([entry, {**entry, "run_id": "b", "r2": 0.5}], indent=2))
    rows = src_registry_json(spark, many).orderBy("seq").collect()
    assert [(r.seq, r.run_id, r.r2) for r in rows] == [(0, "a", None), (1, "b", 0.5)]
    apart = text(tmp_path, "lines.json", "\n".join([json.dumps({**entry, "run_id": r}) for r in ("x", "y")] + ["no json", ""]))
    assert [r.run_id for r in src_registry_json(spark, apart, lines=True).orderBy("seq").collect()] == ["x", "y"]
    assert src_registry_json(spark, text(tmp_path, "one.json", json.dumps(entry))).first().run_id == "a"
    for bad in ("invalid json{{{", "", "[]"):
        assert src_registry_json(spark, text(tmp_path, "bad.json", bad)).count() == 0


def days(frame):
    rows = [(s, f"2024-01-{d:02d} 0{h}:00:00", float(d)) for s in "ab" for d in (1, 2, 4) for h in range(3)]
    return frame(rows, READ).withColumn("reading_date", F.to_date("reading_ts"))


def test_append_and_pruning(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    df = days(frame)
    snk_append_partitioned(df.where("sensor_id = 'a'"), path)
    snk_append_partitioned(df.where("sensor_id = 'b'"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 18
    recent = src_warehouse_window(stored, "2024-01-04 02:00:00", "24 HOURS")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reading_date" in plan and "GreaterThanOrEqual(reading_ts" in plan
    assert recent.count() == 6
    with pytest.raises(ValueError):
        src_warehouse_window(stored, "2024-01-04", "1 DAY", limit=3)


def test_replacing_a_day_is_repeatable(spark, frame, tmp_path):
    path = str(tmp_path / "p")
    df = days(frame).withColumnRenamed("reading_date", "pred_date")
    snk_replace_day(df, path)
    changed = df.where("pred_date = DATE'2024-01-02'").withColumn("count", F.lit(-1.0))
    for _ in range(2):
        snk_replace_day(changed, path)
        stored = spark.read.parquet(path)
        assert stored.count() == 18 and stored.where("count = -1").count() == 6
    assert src_wildcard_partitions(spark, path, "2024-01-02").count() == 12


def test_csv_split_keeps_the_old_one(spark, frame, tmp_path):
    df = days(frame).drop("reading_date")
    for split in ("1", "2"):
        snk_csv_split(df.limit(3), df.limit(2), str(tmp_path / "s"), split)
    assert spark.read.csv(str(tmp_path / "s" / "split_id=1" / "train"), header=True, sep=";").count() == 3
    with pytest.raises(Exception):
        snk_csv_split(df, df, str(tmp_path / "s"), "1")


def test_daily_union_skips_missing_days(frame):
    every = src_daily_union(days(frame), "2024-01-05 00:00:00", days_back=3)
    assert every.count() == days(frame).where("reading_date >= '2024-01-02' and reading_date < '2024-01-05'").count()
    got = src_daily_union(days(frame), "2024-01-05 00:00:00", days_back=3, limit_per_day=2)
    assert [(str(r.reading_date), r["count(1)"]) for r in got.groupBy("reading_date").agg(F.expr("count(1)")).orderBy("reading_date").collect()] == [("2024-01-02", 2), ("2024-01-04", 2)]


def test_unified_view_takes_each_time_once(frame):
    df = days(frame)
    assert src_unified_view(df, df, "2024-01-02 01:00:00").count() == df.count()


PRED = "sensor_id string, reading_ts timestamp_ntz, prediction double, model_version string, prediction_ts timestamp_ntz"


def test_overlapping_predictions(frame):
    t = "2024-01-02 00:00:00"
    pred = frame([("a", t, 1.0, "v1", "2024-01-02 06:00:00"), ("a", t, 2.0, "v2", "2024-01-03 06:00:00"), ("b", t, 5.0, "v1", "2024-01-03 06:00:00"), ("a", "2023-01-01 00:00:00", 1.0, "v1", t)], PRED)
    actual = frame([("a", t, 3.0)] * 4 + [("b", t, None)], READ)
    every = jn_pred_actual(pred, actual, "2024-01-03 00:00:00").collect()
    assert sorted((r.prediction, r.n_rows) for r in every) == [(1.0, 4), (2.0, 4)]
    latest = jn_pred_actual(pred, actual, "2024-01-03 00:00:00", latest_only=True).collect()
    assert [(r.prediction, r.n_rows) for r in latest] == [(2.0, 4)]
    one = jn_pred_actual(pred, actual, "2024-01-03 00:00:00", model_version="v1").collect()
    assert [r.prediction for r in one] == [1.0]


def test_copies_never_become_pairs(frame):
    t = "2024-01-02 00:00:00"
    pred = frame([("a", t, 1.0, "v1", t)] * 300, PRED)
    out = jn_pred_actual(pred, frame([("a", t, 3.0)] * 300, READ), t)
    assert out.count() == 1 and out.first().n_rows == 90000


def test_unknown_sensors(frame):
    df = frame([(s, "2024-01-01 00:00:00", 1.0) for s in "aabxxy"], READ)
    known = frame([("b",), ("a",), ("a",)], "sensor_id string")
    assert {r.sensor_id: r.n_rows for r in jn_unknown_anti(df, known).collect()} == {"x": 2, "y": 1}
    assert unknown_summary(df, known).first() == (3, 2, 0.5)
    filled = jn_unknown_fallback(df, known)
    assert {r.sensor_id for r in filled.collect()} == {"a", "b"} and filled.where("was_unknown").count() == 3


def test_merge_inserts_new_keys_once(frame):
    t = "2024-01-0{} 00:00:00"
    new = frame([("a", t.format(1), 9.0), ("a", t.format(2), 5.0), ("a", t.format(2), 4.0), ("b", t.format(1), None)], READ)
    old = frame([("a", t.format(1), 1.0)], READ)
    got = {(r.sensor_id, str(r.reading_ts)[8:10]): r["count"] for r in jn_dedup_merge(new, old).collect()}
    assert got == {("a", "02"): 4.0, ("b", "01"): None}
    merged = set_quarter_merge(old, new)
    assert merged.count() == 3 and merged.where("sensor_id = 'a'").agg(F.min("count")).first()[0] == 1.0
    assert jn_dedup_merge(new, old.unionAll(jn_dedup_merge(new, old))).count() == 0


def test_schemas(frame):
    a, b = frame([(1, 2, 3, 4, 5)], "a int, b int, c int, d int, e int"), frame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert set_schema_gate(a, b) and not set_schema_gate(a, b.drop("d"))
    diff = {r.column: (r.in_a, r.in_b, r.critical) for r in set_schema_diff(a, b, ["e"]).collect()}
    assert diff["e"] == (True, False, True) and diff["a"] == (True, True, False)
    assert set_concat_align(a, b).where("e IS NULL").count() == 1


def test_overlap_of_nothing(frame):
    a = frame([], "sensor_id string")
    assert set_key_overlap(a, a).first() == (0, 0, 0, 0, 0, None)


def test_checks(frame):
    df = days(frame).withColumn("ingestion_ts", F.lit("2024-01-04 02:00:00").cast("timestamp_ntz"))
    def state(expected, now="2024-01-04 02:04:00"):
        return agg_ingest_check(df, now, expected).first().status
    assert [state(18), state(20), state(21), state(18, "2024-01-04 03:00:00")] == ["ok", "ok", "warning", "failed"]
    assert agg_freshness_check(df, "2024-03-01 00:00:00").first().status == "failed"
    pred = frame([(-1.0, "2024-01-01 00:00:00")], "prediction double, prediction_ts timestamp_ntz")
    row = agg_prediction_check(pred, 2).first()
    assert row.count_mismatch and row.has_negative and not row.no_rows
    assert agg_prediction_check(pred.limit(0), 0).first().no_rows


@pytest.mark.parametrize(
    "start, want, days_apart", [("2024-01-05 12:00:00", "overlap", -1), ("2024-01-06 10:00:00", "contiguous", 0), ("2024-01-08 00:00:00", "gap", 2)]
)
def test_continuity(frame, start, want, days_apart):
    a, b = frame([("a", "2024-01-06 00:00:00", 1.0)], READ), frame([("a", start, 1.0)], READ)
    row = agg_continuity_gap(a, b, "2024-01-20 00:00:00").first()
    assert (row.continuity, row.gap_days, row.freshness) == (want, days_apart, "stale")


def test_profiles_of_copies(frame):
    df = frame([(1, None)] * 5 + [(2, 3)], "a int, b int")
    row = agg_null_dup_profile(df).first()
    assert (row.column, row.duplicate_rows) == ("b", 4) and abs(row.null_pct - 500 / 6) < 1e-9


def test_latest_and_pivot(frame):
    df = frame([("r", "k", 1.0, "2024-01-01 00:00:00"), ("r", "k", 2.0, "2024-01-02 00:00:00")], "run_id string, key string, value double, ts timestamp_ntz")
    assert agg_latest_row(df, "ts").first().value == 2.0
    assert agg_kv_pivot(df, ["k", "absent"]).first() == ("r", 2.0, None)


def test_peaks_take_the_first_time(frame):
    t = "2024-01-0{} 00:00:00"
    df = frame([("a", t.format(d), v) for d, v in ((3, 5.0), (2, 5.0), (1, 4.0))], READ)
    assert str(win_peak_per_sensor(df).first().peak_ts) == "2024-01-02 00:00:00"


def test_threshold_is_strict_and_can_be_fitted_elsewhere(frame):
    df = frame([("a", "2024-01-01 00:00:00", v) for v in (1.0, 2.0, 3.0)] + [("b", "2024-01-01 00:00:00", 9.0)], READ)
    for stat in ("mean", "median"):
        got = {r["count"]: r.affluence for r in win_group_threshold(df, stat).collect()}
        assert got == {1.0: 0, 2.0: 0, 3.0: 1, 9.0: 0}
    fitted = win_group_threshold(df, fit_on=df.where("count = 1"))
    assert fitted.agg(F.sum("affluence")).first()[0] == 2  # b has no threshold


def hot(frame):
    """One sensor has most rows, one has a single row."""
    rows = [("hot", i) for i in range(900)] + [("s", i) for i in range(900, 910)] + [("t", 910)]
    return frame(rows, "sensor_id string, id int")


def test_stratified_split(frame):
    df = hot(frame)
    train, test = spl_stratified(df, key="id")
    assert train.count() + test.count() == 911 and train.join(test, "id").count() == 0
    sizes = {r.sensor_id: r.n for r in test.groupBy("sensor_id").agg(F.expr("count(1) AS n")).collect()}
    assert sizes == {"hot": 180, "s": 2}
    verdict = spl_verify_iso(train, test).first()
    assert (verdict.verdict, verdict.single_row_orphans) == ("ACCEPTABLE", 1)
    assert spl_verify_iso(train, train).first().verdict == "PERFECT"
    assert spl_verify_iso(test, train).first().verdict == "FAIL"
    again = spl_stratified(df.repartition(7), key="id")[1]
    assert again.exceptAll(test).count() == 0


def test_samples(frame):
    df = hot(frame)
    s = spl_stratified_sample(df, n=100, key="id")
    assert s.count() == 100 and s.select("sensor_id").distinct().count() == 3
    assert spl_stratified_sample(df, n=5000, key="id").count() == 911
    assert spl_random_sample(df, 50, key="id").select("id").distinct().count() == 50
    assert spl_random_sample(df, 5000, key="id").count() == 911


def test_holdout_keeps_every_row(frame):
    for n in (0, 1, 50, 1000):
        split = spl_holdout(frame([(i,) for i in range(n)], "id int"), key="id")
        assert (split.train.count(), split.test.count()) == (split.n_train, split.n_test)
        assert split.n_train + split.n_test == n
    assert 150 < split.n_test < 250


def test_temporal_split_keeps_equal_times_together(frame):
    rows = [("a", f"2024-01-01 0{min(i, 5)}:00:00", 1.0) for i in range(10)]
    train, test = spl_temporal(frame(rows, READ))
    assert (train.count(), test.count()) == (5, 5)
