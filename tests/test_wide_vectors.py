"""Vectors far wider than what they store."""

from pyspark.ml.linalg import Vectors

from catalog import learning


def test_widths_and_totals_come_from_stored_entries(spark, monkeypatch):
    """Laid out, the first vector is 8 GB."""
    vectors = [Vectors.sparse(1 << 30, [3, 1 << 29], [2.0, -0.5]), Vectors.dense([1.0, 2.0]), Vectors.sparse(5, [], []), None]
    df = spark.createDataFrame(list(enumerate(vectors)), ["row_key", "features"])
    monkeypatch.setattr(learning, "readings", lambda *_: df)
    monkeypatch.setattr(learning, "ml_assemble", lambda rows: rows)
    got = [(r.width, r.total) for r in learning.assemble(spark, "").orderBy("row_key").collect()]
    assert got == [(1 << 30, 1.5), (2, 3.0), (5, 0.0), (None, None)]
