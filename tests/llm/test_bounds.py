from __future__ import annotations

from sensorspark.llm import decontaminate, quality


def test_items_without_an_id_contaminate(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(None, " ".join(words[:20])), (None, " ".join(words[20:])), (7, " ".join(words[10:30])), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(words)), (2, "b " + " ".join(words[:20])), (3, "other text")], "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["items"], r["distance"]) for r in decontaminate.flagged(docs, bench).collect()}
    assert got == {1: (True, [7, None, None], 0), 2: (True, [None], 0), 3: (False, [], None)}
    assert [r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()] == [3]


def test_windows_are_searched_as_the_pool_fills(monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontaminate, "POOL", 8)
    monkeypatch.setattr(decontaminate, "MEETINGS", 16)
    items = decontaminate.prepare([(i, " ".join(f"a{i + j}" for j in range(20))) for i in range(50)], 0.2, 0.97)
    words = np.concatenate([items.words[i] for i in (3, 9, 30)])
    pool = decontaminate._Windows(items)
    pool.add(words, np.array([0, 20, 40, 60]), np.arange(3))
    assert pool.size < 8
    found = [np.concatenate(x) for x in zip(*pool.close(), strict=True)]
    assert {(0, 3), (1, 9), (2, 30)} <= set(zip(found[0].tolist(), found[1].tolist(), strict=True))


def test_an_id_gives_the_quality_sample_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(1, None), (2, "good words"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, quality.Settings()).collect()
    assert sorted((r["y"], len(r["ids"]) > 0) for r in rows) == [(0, False), (0, True), (1, True)]
