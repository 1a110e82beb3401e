"""Shared pieces: written tables, word hashing over Arrow buffers, ranks over range partitions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorspark.session import forget, scratch_path, via_table

#: ASCII white space, the separator of words in every operator.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACE]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_uri(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one as a URI, for files that tasks write themselves."""
    path = scratch_path(spark, label)
    return path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hold Arrow batches to so many rows and 16 MB, so that batches of long texts fit a Python
    worker. Settings that the session names itself stay."""
    for key, value in (("maxRecordsPerBatch", str(rows)), ("maxBytesPerBatch", str(16 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more at the end). Nulls are
    empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, _SLICE + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def word_hashes(col: pa.Array, lower: bool = True, strip: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, in order, and the place of each text's first word
    (one more at the end). Bytes in ``strip`` separate words as well.

    The work goes through the bytes in slices that end between words, so memory follows the slice,
    not the longest text."""
    if lower:
        col = pc.utf8_lower(col)
    raw, offsets = text_buffer(col)
    gap = _IS_SPACE.copy()
    gap[list(strip)] = True
    hashes, starts = [], []
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    at = 0
    while at < len(raw):
        end = min(at + _SLICE, len(raw))
        while end < len(raw) and not (gap[raw[end]] or first[end]):
            end += 1
        piece = raw[at:end]
        inside = ~gap[piece]
        cut = first[at:end]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | cut[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = _powers_to(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s], 1))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begin = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(begin, offsets)


def text_slices(col: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > size:
            yield begin, i
            begin, held = i, 0
        held += int(n)
    if begin < len(lengths):
        yield begin, len(lengths)


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The distinct shingles of ``k`` words of each text, sorted. A text of 1 to k-1 words is one
    shingle; a text without words has none."""
    n = len(words)
    # Another multiplier for each place in the shingle.
    factors = [np.uint64(f) for f in (pow(_BASE, 2 * j + 3, 1 << 64) for j in range(k))]
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        rolled[: max(0, n - j)] += words[j:] * factors[j]
    rolled = mix(rolled, 2)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for j in range(b - a):
                    short += words[a + j] * factors[j]
            out.append(mix(np.array([short], dtype=np.uint64), 3))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 8192) -> Iterator[pa.Table]:
    """From batches sorted by their first ``keys`` columns: tables of about ``rows`` rows in which
    every group is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        values = [table.column(i).to_numpy() for i in range(keys)]
        other = np.flatnonzero(np.any([v != v[-1] for v in values], axis=0))
        begin = int(other[-1]) + 1 if len(other) else 0
        if begin:
            yield table.slice(0, begin)
        held = table.slice(begin).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_numbers(table: pa.Table, keys: int) -> np.ndarray:
    """0, 1, ... for the runs of equal values in the first ``keys`` columns."""
    values = [table.column(i).to_numpy() for i in range(keys)]
    new = np.any([v[1:] != v[:-1] for v in values], axis=0)
    return np.concatenate([[0], np.cumsum(new)])


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each of 0 .. n-1's connected component, given pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def ranked(df: DataFrame, order: Sequence[Column], label: str, parts: int | None = None) -> DataFrame:
    """The rows in a total order, written as a table with their place: ``__part`` and ``__pos``.

    Rows are dealt by ranges of the order and sorted inside each part; the written table fixes
    both, so later passes and repeated tasks see the same places."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return via_table(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        label,
    )


def before(rows: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """For each part of ``ranked`` rows and each key: what the earlier parts hold of the key. One
    row for each part and key that it holds: as many as parts and keys together, at most."""
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return totals.select(*by, "__part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, root``: the smallest node of each connected component, for nodes that have an edge
    ``a, b``. Rounds of large-star and small-star, each a group-wise minimum and a join back.

    Every round is written as a table, and the tables of the round before go. A hub's edges meet its
    minimum in a join of two tables, which adaptive execution can split; no component is gathered."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = via_table(e.distinct(), label)
    while True:
        # Large-star: neighbours larger than a node go to the smallest of it and its neighbours.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = via_table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = via_table(large.where("a != b").distinct(), label)
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        down = via_table(large.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("n")), label)
        done = [e, low]
        if down.where("n > 1").limit(1).count() == 0:
            e, done = large, [*done, down]
        else:
            new = large.join(down.drop("n"), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
            done += [large, down]
            e = via_table(new.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a != b").distinct(), label)
        forget(*done)
        down = e.groupBy("a").agg(F.count("b").alias("n"))
        # Done when every node has one edge and no root is the child of another.
        roots = e.select(F.col("b").alias("a")).distinct()
        if down.where("n > 1").limit(1).count() == 0 and e.join(roots, "a", "left_semi").limit(1).count() == 0:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))


__all__ = [
    "SPACE", "WORD", "before", "components", "forget", "group_numbers", "labels_of", "mix", "ranked", "shared_uri", "shingle_sets", "small_batches",
    "table", "text_buffer", "text_slices", "via_table", "whole_groups", "word_hashes",
]
