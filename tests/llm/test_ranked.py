from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sensorspark.llm import ranked


def brute(docs, items, k=10):
    """The contract, plainly: sorted (item_id, rank, doc_id, score)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, split(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, t in held:
            tf, m = Counter(t), 0
            if t:
                m = 100 - 90 + (90 * len(t) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in set(split(text)) if tf[w])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    b = spark.createDataFrame([(i, t, 0.0) for i, t in items], "item_id long, text string, doc_id double")
    return sorted((tuple(r) for r in ranked.search(d, b, **options).collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"{'W' if i % 9 == 0 else 'w'}{i}" + ("é" if i % 5 == 0 else "") for i in range(900)]
    pick = lambda k: [words[min(int(rng.paretovariate(0.7)) - 1, 899)] for _ in range(k)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(pick(rng.choice([1, 5, 30, 200])))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(None, docs[3][1]), (5, docs[3][1]), (5, docs[3][1]), (None, None), (7, ""), (8, "-- ,, !"), (9, "w1 " * 700), (10, "W1İ ÀB"), (11, " ".join(words))]
    items = [(i, " ".join(pick(rng.choice([1, 3, 20])))) for i in range(25)]
    items += [(3, "w1 w2"), (3, "w1 w2"), (None, "w3 W4"), (50, None), (51, ""), (52, "absent words"), (53, docs[3][1]), (54, "w899 w898é w897"), (55, "àb ÀB")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_chars": 300, "first": 2}, {"k": 3, "first": 1}])
def test_equals_brute_force(spark, options):
    docs, items = corpus(1)
    assert found(spark, docs, items, **options) == brute(docs, items, options.get("k", 10))


def test_empty_tables(spark):
    docs, items = corpus(2, 20)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None), (2, "..")], items) == []


def test_bounds_are_never_below_scores():
    docs, items = corpus(3)
    texts = [t for _, t in docs if t and ranked.terms(t)]
    doc, words, tf, n = ranked.hashed(pa.array(texts))
    rows = ranked.sketches(doc, words, tf, len(texts))
    block = ranked.Items([t for _, t in items if t])
    vocabulary = {int(h) for h in block.words.view(np.int64)}
    df = Counter(int(h) for h in words.view(np.int64) if int(h) in vocabulary)
    block.weigh(df, len(texts), int(n.sum()))
    bounds = block.bounds(rows, n)
    scores = np.array([block.score(t, list(range(len(block.sets)))) for t in texts])
    assert (bounds >= scores).all()
    # The bounds are of use: close to the scores on the whole.
    assert bounds.sum() < 1.35 * scores.sum()
    assert [len(r) for r in rows] == [max(16, 1 << math.ceil(math.log2(8 * len(set(ranked.terms(t)))))) for t in texts]


def test_terms_are_counted_as_they_are_split():
    texts = ["A b-B é,É 9z_9Z", None, "", "x" * 300 + " X", "İ i"]
    doc, words, tf, n = ranked.hashed(pa.array(texts, pa.string()))
    assert n.tolist() == [len(ranked.terms(t)) for t in texts]
    counts = defaultdict(list)
    for d, c in zip(doc.tolist(), tf.tolist(), strict=True):
        counts[d].append(c)
    assert {d: sorted(c) for d, c in counts.items()} == {i: sorted(Counter(ranked.terms(t)).values()) for i, t in enumerate(texts) if ranked.terms(t)}


def test_every_text_is_shuffled_only_as_a_sketch(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(4)], "doc_id long, text string")
    made = spark.createDataFrame([], ranked._INDEX)
    text = ranked._by_text(made, 10)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in text
    assert len(found(spark, [tuple(r) for r in docs.collect()], [(1, "a")])) == 4
