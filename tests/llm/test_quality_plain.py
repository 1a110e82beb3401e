"""The quality classifier's features, mean, softmax and descent against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sensorspark.llm import quality
from sensorspark.llm.common import SPACE

U64, U32 = (1 << 64) - 1, (1 << 32) - 1


def mixed(x, salt):
    x = (x + salt * 0xD1B54A32D192ED03) & U64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & U64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & U64
    return x ^ (x >> 31)


def word_hash(word):
    return mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word.encode())) & U64, 1)


def gram_hash(gram):
    h = len(gram)
    for c in gram:
        x = (ord(c) * 0x9E3779B1) & U32
        h = (h * 0x85EBCA77 + (x ^ (x >> 15))) & U32
    return ((h ^ (h >> 15)) * 0xC2B2AE3D) & U32


def plain_ids(text, bits, sizes):
    """Buckets of a text's words, pairs of words and n-grams that hold no white space but at their ends."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c not in SPACE:
            word += c
        elif word:
            words.append(word)
            word = ""
    hashes = [word_hash(w) for w in words]
    out = [h >> (64 - bits) for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        out.append(0 if a == b else mixed((a * 0x9E3779B97F4A7C15 + b) & U64, 7) >> (64 - bits))
    padded = f"\n{text}\n"
    for n in sizes:
        for i in range(len(padded) - n + 1):
            if not any(c in SPACE for c in padded[i + 1 : i + n - 1]):
                out.append(gram_hash(padded[i : i + n]) >> (32 - bits))
    return sorted(out)


def texts():
    rng = random.Random(2)
    out = ["", None, " \n\t", "a", "ab", "one two", "two  two\ttwo", "é ßü 漢字 かな 😀", "x\x0by\fz\r\nw", "no break", "tail "]
    for _ in range(30):
        out.append(" ".join("".join(rng.choice("abcé漢😀") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 40))))
    return out + out[:6]


def test_features_are_the_plain_ones(monkeypatch):
    monkeypatch.setattr(quality, "_PIECE", 64)  # texts go through in several pieces
    col = pa.array(texts())
    runs = list(quality.feature_ids(col, 12, (3, 4)))
    for i, text in enumerate(texts()):
        got = sorted(int(x) for ids, at in runs for x in ids[at[i] : at[i + 1]])
        assert got == plain_ids(text, 12, (3, 4)), text


def test_score_is_the_sigmoid_of_the_mean(spark):
    rng = np.random.default_rng(3)
    model = quality.Model(10, (3, 4), rng.normal(0, 3, 1 << 10).astype(np.float32), 0.25)
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", quality.score(F.col("text"), model).alias("p")).collect()}
    for i, text in rows:
        ids = plain_ids(text, 10, (3, 4))
        mean = sum(float(model.value[x]) for x in ids) / max(1, len(ids))
        assert math.isclose(got[i], 1 / (1 + math.exp(-(mean + 0.25))), abs_tol=1e-9), text


def test_descent_follows_the_numeric_gradient(spark):
    """An epoch in one part: after each document, every parameter has moved by the rate times the
    derivative of the loss, taken from differences."""
    s = quality.Settings(bits=5, dim=2, chars=(3,), parts=1, epochs=1, rate=0.5)
    samples = {1: ("good words here", 1), 2: ("bad bad noise", 0), 3: ("words that are good", 1)}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in samples.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in samples.items()], "doc_id long, quality int")
    got = quality.train(docs, labels, s)
    turns = {r["doc_id"]: r["turn"] for r in docs.select("doc_id", (F.xxhash64("doc_id", F.lit(s.seed)) / F.lit(float(1 << 64)) + 0.5).alias("turn")).collect()}
    by_turn = sorted(samples, key=turns.get)
    size = 1 << s.bits
    vectors = np.random.default_rng(s.seed).uniform(-1 / s.dim, 1 / s.dim, (size, s.dim)).astype(np.float32).astype(float)
    at = np.concatenate([vectors.ravel(), np.zeros((s.dim + 1) * 2)])

    def loss(p, text, y):
        e, w = p[: size * s.dim].reshape(size, s.dim), p[size * s.dim :].reshape(s.dim + 1, 2)
        ids = plain_ids(text, s.bits, s.chars)
        z = sum(e[x] for x in ids) / len(ids) @ w[:-1] + w[-1]
        return math.log(sum(math.exp(v) for v in z)) - z[y]

    # The bias learns at a tenth of the rate.
    rates = np.concatenate([np.ones(len(at) - 2), [0.1, 0.1]])
    for step, i in enumerate(np.random.default_rng(s.seed * 1000).permutation(len(by_turn))):
        text, y = samples[by_turn[i]]
        slope = np.zeros(len(at))
        for j in range(len(at)):
            move = np.zeros(len(at))
            move[j] = 1e-5
            slope[j] = (loss(at + move, text, y) - loss(at - move, text, y)) / 2e-5
        at = at - s.rate * (1 - step / len(by_turn)) * rates * slope
    e, w = at[: size * s.dim].reshape(size, s.dim), at[size * s.dim :].reshape(s.dim + 1, 2)
    assert np.abs(w[:-1]).max() > 1e-3
    np.testing.assert_allclose(got.value, e @ (w[:-1, 1] - w[:-1, 0]), atol=1e-5)
    assert math.isclose(got.bias, w[-1, 1] - w[-1, 0], abs_tol=1e-5)
