from __future__ import annotations

import collections

import pytest

from sensorspark.llm import mixing, quality


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows without an id, rows that agree in id and text, and one id for several texts."""
    rows = [(None, "a b c d e f g h i j", "x", i) for i in range(200)]
    rows += [(7, "same text of six words here", "x", i) for i in range(150)]
    rows += [(8, f"text number {i} " + "w " * (i % 5), "y", i) for i in range(120)]
    rows += [(i, f"doc {i} " + "word " * (i % 9), ["x", "y", "z", None][i % 4], i) for i in range(100, 400)]
    rows += [(None, None, None, 0)] * 30 + [(9, "", "z", 0)] * 20
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mark int").repartition(7)


def test_every_row_draws_for_itself(repeated):
    plan = mixing.mix_sources(repeated).collect()
    assert len(plan) == repeated.count()
    draws = collections.defaultdict(list)
    for r in plan:
        draws[r["source"], r["doc_id"], r["size"]].append(r["sample_key"])
    assert all(len(set(d)) == len(d) for d in draws.values())
    taken, target = collections.Counter(), {}
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    again = mixing.mix_sources(repeated.repartition(3)).collect()
    key = lambda r: (str(r["source"]), r["doc_id"] or -1, r["sample_key"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, plan))


def test_documents_meet_their_own_decision(repeated):
    """Null and repeated ids meet their source's target to within a document."""
    plan = mixing.mix_sources(repeated)
    target = {r["source"]: r["target"] for r in plan.select("source", "target").distinct().collect()}
    words, copies = collections.Counter(), collections.Counter()
    for r in mixing.mixed_documents(repeated).collect():
        words[r["source"]] += len((r["text"] or "").split())
        copies[r["doc_id"], r["source"], r["text"], r["mark"]] += 1
    largest = 10
    assert all(abs(words[s] - t) <= largest for s, t in target.items())
    # Rows of one id and text are taken a whole number of times each, at most one apart.
    times = [copies[None, "x", "a b c d e f g h i j", i] for i in range(200)]
    assert max(times) - min(times) <= 1


def test_part_of_equal_rows_is_drawn(spark):
    """A budget that fits half of the equal rows takes half of them."""
    rows = [(None, "one two three four five", "a")] * 400 + [(i, "w " * 50, "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter(r["source"] for r in mixing.mixed_documents(docs, weights=(1, 6)).collect())
    assert abs(got["a"] * 5 - 1000) <= 5


def test_unlabelled_weigh_between_good_and_bad(spark):
    docs = spark.createDataFrame([(i, "w", "a") for i in range(30)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (0, 0)], "doc_id long, quality int")
    weights = {r["doc_id"]: r["weight"] for r in mixing.mix_sources(docs, mixing.label_weights(labels)).collect()}
    assert (weights[0], weights[1], weights[2], weights[3]) == (1.0, 0.25, 0.5, 0.5)


def test_a_null_id_is_held_out(spark):
    ids = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long")
    assert {r["doc_id"]: r["held_out"] for r in ids.select("doc_id", (~quality.learns()).alias("held_out")).collect()}[None] is True
