from __future__ import annotations

from unittest import mock

from catalog import learning


def test_every_query_fits_its_own_forest(monkeypatch):
    regressor = mock.Mock()
    for name in ("readings", "baseline", "patterned", "spread"):
        monkeypatch.setattr(learning, name, lambda *a: None)
    monkeypatch.setattr(learning, "ml_rf_regressor", regressor)
    spark = mock.Mock()
    learning.fitted(spark, "here")
    learning.fitted(spark, "here")
    assert regressor.return_value.fit.call_count == 2
