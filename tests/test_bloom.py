from __future__ import annotations

from sensorspark.functions.bloom import bloom_prefilter, bloom_words


def test_no_key_is_lost_and_few_others_pass(spark, frame):
    keys = spark.range(0, 20_000, 2).selectExpr("id AS a", "CAST(id AS string) AS b")
    rows = spark.range(0, 200_000).selectExpr("id AS a", "CAST(id AS string) AS b", "id % 7 AS x")
    kept = bloom_prefilter(rows, keys, ["a", "b"])
    assert kept.join(keys, ["a", "b"], "left_semi").count() == 10_000
    assert kept.count() < 10_000 + 190
    nulls = frame([(None, "x"), (3, None)], "a long, b string")
    assert bloom_prefilter(nulls, nulls, ["a", "b"]).count() == 2


def test_size_does_not_follow_the_keys(spark):
    for n in (0, 1000):
        assert len(bloom_words(spark.range(n), ["id"], bits=12).first()["words"]) == 64
    assert bloom_prefilter(spark.range(50), spark.range(0), ["id"]).count() == 0


def test_rows_stay_in_place(spark):
    kept = bloom_prefilter(spark.range(1000).repartition(3), spark.range(10), ["id"], bits=12)
    text = kept._jdf.queryExecution().optimizedPlan().toString()
    assert text.split("Subquery")[0].count("Join") == 0 or "scalar-subquery" in text
    assert kept.rdd.getNumPartitions() == 3
