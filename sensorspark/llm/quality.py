"""Quality classifier: supervised subword embeddings.

A text is the mean of the learned vectors of its hashed words, word pairs and character n-grams; a
softmax over that mean gives the classes. Vectors and softmax are trained by numpy stochastic
gradient descent: each epoch, a few tasks pass over their share of a bounded sample of labelled
documents, and their parameters are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import SPACE, forget, mix, small_batches, text_buffer, text_slices, via_table, word_hashes

_GAP = np.zeros(1 << 8, dtype=bool)
_GAP[[ord(c) for c in SPACE]] = True
_PIECE = 1 << 18


@dataclass(frozen=True)
class Settings:
    bits: int = 16  # 2**bits vectors
    dim: int = 8
    chars: tuple[int, ...] = (3, 4)
    #: Labelled documents of each class in the sample, about. The bound on what is fitted.
    rows_per_class: int = 1500
    parts: int = 4
    epochs: int = 12
    rate: float = 4.0
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """A bucket's vector times the difference of the softmax weights, and the difference of biases:
    all that scoring needs."""

    bits: int
    chars: tuple[int, ...]
    value: np.ndarray
    bias: float


def _word_ids(col: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    words, at = word_hashes(col, lower=False)
    shift = np.uint64(64 - bits)
    yield words >> shift, at
    if len(words) > 1:
        pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:], 7) >> shift
        # A word followed by itself: one vector for all such pairs.
        pairs[words[:-1] == words[1:]] = 0
        # The last word of a text begins no pair.
        last = np.unique(at[1:][at[1:] > at[:-1]] - 1)
        keep = np.ones(len(pairs), dtype=bool)
        keep[last[last < len(pairs)]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        yield pairs[keep], kept[np.minimum(at, len(pairs))]


def _char_ids(col: pa.Array, n_chars: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams of code points inside words; a white space may be the first or the last of them. The
    bytes go through in pieces that end at a white space."""
    raw, offsets = text_buffer(pc.binary_join_element_wise(pc.fill_null(col, "").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
    gap = _GAP[raw]
    a = 0
    while a < len(raw):
        b = min(a + _PIECE, len(raw) - 1)
        while not gap[b]:
            b += 1
        lead = raw[a - 1 : a] if a else np.array([10], np.uint8)
        piece = np.concatenate([lead, raw[a : b + 1]])
        points = np.frombuffer(piece.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        blank = np.zeros(len(points), dtype=bool)
        blank[points < 33] = _GAP[points[points < 33]]
        chars = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
        bounds = chars[np.clip(offsets - a + 1, 0, len(piece))]
        hashed = points * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        for n in n_chars:
            m = len(points) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint32)
            for j in range(n):
                h = h * np.uint32(0x85EBCA77) + hashed[j : j + m]
            inner = np.zeros(m, dtype=bool)
            for j in range(1, n - 1):
                inner |= blank[j : j + m]
            start = np.flatnonzero(~inner)
            h = h[start]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE3D)
            yield h >> np.uint32(32 - bits), np.searchsorted(start + 1, bounds)
        a = b + 1


def feature_ids(col: pa.Array, bits: int, n_chars: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of bucket numbers with the place where each text's begin (one more at the end)."""
    yield from _word_ids(col, bits)
    yield from _char_ids(col, n_chars, bits)


def _sparse(col: pa.Array, s: Settings) -> list[tuple[bytes, bytes]]:
    """Bucket numbers and their shares of each text."""
    runs = list(feature_ids(col, s.bits, s.chars))
    out = []
    for i in range(len(col)):
        ids = np.concatenate([r[at[i] : at[i + 1]].astype(np.uint32) for r, at in runs])
        found, n = np.unique(ids, return_counts=True)
        out.append((found.tobytes(), (n / max(1, len(ids))).astype(np.float32).tobytes()))
    return out


def labelled(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """The sample: ``part, turn, y, ids, shares``. Each class gives about ``rows_per_class``
    documents, chosen by a hash of their ids against a threshold; all of them, if there are fewer. Of
    rows that share an id, the one with the smallest hash of its text stands for it."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y")).where("__id is not null and y in (0, 1)")
    known = known.groupBy("__id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    turn = F.xxhash64("__id", F.lit(s.seed)) / F.lit(float(1 << 64)) + 0.5
    share = F.when(F.col("y") == 1, min(1.0, s.rows_per_class / max(1, sizes.get(1, 0)))).otherwise(min(1.0, s.rows_per_class / max(1, sizes.get(0, 0))))
    sample = known.withColumn("turn", turn).where(F.col("turn") < share)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                rows = batch.slice(a, b - a)
                found = _sparse(rows.column(0), s)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(1), rows.column(2), pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())],
                    ["y", "turn", "ids", "shares"],
                )

    # The sample has a bound, so it goes to the documents and not they to it.
    found = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("__id", "text", "y", "turn")
    # One row of an id, so that the sample is bounded in rows as well.
    first = F.min(F.struct(F.col("text").isNull(), F.xxhash64("text"), "text").alias("x"))["text"]
    rows = found.groupBy("__id", "y", "turn").agg(first.alias("text")).select("text", "y", "turn").mapInArrow(sparse, "y int, turn double, ids binary, shares binary")
    return via_table(rows.withColumn("part", F.pmod(F.xxhash64("turn"), F.lit(s.parts)).cast("int")), "quality-sample")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on the documents that ``labels`` (``doc_id, quality`` 0 or 1) names; other labels and
    null ids are passed over. Without a label of both classes every score is the share of good ones
    (0.5 without labels). The sample is reweighted to the classes' shares among the labels."""
    s = settings
    sample = labelled(docs, labels, s)
    found = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("quality").count().collect()
    all_known = {r["quality"]: r["count"] for r in known}
    size = 1 << s.bits
    if len(found) < 2:
        p = (all_known.get(1, 0) + 1e-3) / (sum(all_known.values()) + 2e-3)
        return Model(s.bits, s.chars, np.zeros(size, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (size, s.dim)).astype(np.float32)
    soft = np.zeros((s.dim + 1, 2), dtype=np.float32)

    def epoch(vectors: np.ndarray, soft: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        def one(rows: pd.DataFrame) -> pd.DataFrame:
            e, w = vectors.copy(), soft.copy()
            rows = rows.sort_values(["turn", "y"], kind="stable")
            order = np.random.default_rng(s.seed * 1000 + k).permutation(len(rows))
            ids = [np.frombuffer(x, np.uint32) for x in rows["ids"]]
            shares = [np.frombuffer(x, np.float32) for x in rows["shares"]]
            y = rows["y"].to_numpy()
            for step, i in enumerate(order):
                rate = s.rate * (1 - (k + step / len(order)) / s.epochs)
                h = shares[i] @ e[ids[i]]
                z = h @ w[:-1] + w[-1]
                z = np.exp(z - z.max())
                g = z / z.sum()
                g[y[i]] -= 1
                back = w[:-1] @ g
                w[:-1] -= rate * np.outer(h, g)
                w[-1] -= 0.1 * rate * g
                e[ids[i]] -= (rate * shares[i])[:, None] * back[None, :]
            return pd.DataFrame({"n": [len(rows)], "e": [(e - vectors).astype(np.float32).tobytes()], "w": [w.astype(np.float32).tobytes()]})

        got = sample.groupBy("part").applyInPandas(one, "n long, e binary, w binary").collect()
        # Vectors move by the sum of what the parts moved them, as rare features meet few parts.
        e = vectors + sum(np.frombuffer(r["e"], np.float32).reshape(vectors.shape) for r in got) / np.sqrt(len(got)).astype(np.float32)
        w = sum(r["n"] * np.frombuffer(r["w"], np.float32).reshape(soft.shape) for r in got) / sum(r["n"] for r in got)
        return e.astype(np.float32), w.astype(np.float32)

    for k in range(s.epochs):
        vectors, soft = epoch(vectors, soft, k)
    forget(sample)
    value = vectors @ (soft[:-1, 1] - soft[:-1, 0])
    # From the sample's class shares to those of the labels.
    prior = np.log(all_known[1] / all_known[0]) - np.log(found[1] / found[0])
    return Model(s.bits, s.chars, value.astype(np.float32), float(soft[-1, 1] - soft[-1, 0] + prior))


def score(text: Column, model: Model) -> Column:
    """The probability of class 1, 0 to 1; the bias alone decides on null and empty texts."""

    def scores(col: pa.Array) -> pa.Array:
        out = []
        for a, b in text_slices(col):
            total, n = np.zeros(b - a), np.zeros(b - a)
            for ids, at in feature_ids(col.slice(a, b - a), model.bits, model.chars):
                sums = np.concatenate([[0.0], np.cumsum(model.value[ids], dtype=np.float64)])
                total += sums[at[1:]] - sums[at[:-1]]
                n += at[1:] - at[:-1]
            out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -500, 500))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    # Arrow UDFs read their kind from the annotations.
    scores.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(scores, "double")(text)


def learns(doc_id: str = "doc_id") -> Column:
    """Labels may be learned from: the id's remainder is not that of the held-out fold. A null id counts
    as the empty text, whose remainder is 0: held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) != 0


THRESHOLD = 0.3


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``quality_score`` (double; one that is there is replaced) to every row of ``docs``, trained on the labels outside the
    held-out fold. Rows are neither dropped nor joined: repeated and null ids have their own scores;
    only the text is read. An empty table gives an empty result."""
    return docs.withColumn("quality_score", score(F.col("text"), train(docs, labels.where(learns()), settings)))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns and no other."""
    return docs.where(score(F.col("text"), train(docs, labels.where(learns()), settings)) >= threshold)
