"""Sharding along a Hilbert curve over several metadata dimensions.

Dimensions are quantised to a few bits each, the cell's place on the curve orders the rows, and the
order is cut into runs. Rows near each other in all dimensions share a run, so the minima and maxima
of a shard's files prune on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorspark.llm.common import before, ranked

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows x dimensions, each below 2**bits): Gray-code
    transform of the axes from the highest bit down, then their bits interleaved."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def level(value: Column, bits: int = BITS) -> Column:
    """A number on a half-octave scale: equal at every input size, null and negatives are 0."""
    half = F.floor(F.log2(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1) * 2)
    return F.least(half, F.lit((1 << bits) - 1)).cast("int")


def bin_of(value: Column, bits: int = BITS) -> Column:
    """A name by its hash: equal names meet, null is a name of its own."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit("\u0000"))), F.lit(1 << bits)).cast("int")


def curve(dimensions: Sequence[Column], bits: int = BITS) -> Column:
    """The column of curve places for quantised dimensions."""

    @F.pandas_udf("long")
    def place(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    return place(F.struct(*[c.alias(f"d{i}") for i, c in enumerate(dimensions)]))


def shard(
    rows: DataFrame,
    dimensions: Sequence[Column],
    size: Column,
    ties: Sequence[Column],
    shards: int = 8,
    law: str = "rows",
    bits: int = BITS,
) -> DataFrame:
    """Adds ``curve`` (place on the curve), ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless
    from 0 in each shard); columns of these names that are there are replaced.

    Rows are ordered by curve place and ``ties``; the order is cut into runs of equal row counts, at
    most one apart (``law="rows"``), or of nearly equal sizes (``law="bytes"``: a row goes to the run
    in which its middle byte falls). A cell that holds many rows is cut like any other run, so no
    cell is gathered. Rows that agree in everything, ties too, are interchangeable. Empty input gives
    an empty result.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    rows = rows.drop("curve", "shard", "slot")
    keyed = rows.select("*", curve(dimensions, bits).alias("curve"), size.cast("bigint").alias("__size"))
    placed = ranked(keyed, [F.col("curve"), *ties], "shards")
    counted = before(placed, [], {"__rows": F.lit(1), "__bytes": F.col("__size")}).withColumnRenamed("__part", "__p")
    total = placed.agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum("__size"), F.lit(0)).alias("__all")).first()
    # One row for each part: as many as the session's shuffle partitions, at most.
    out = placed.join(F.broadcast(counted), F.col("__part") == F.col("__p"))
    rank = F.col("__rows") + F.col("__pos")
    if law == "rows":
        # Run k begins at ceil(k * n / shards): floor(rank * shards / n) inverts that.
        n = max(1, total["__n"])
        out = out.withColumn("__run", F.expr(f"(__rows + __pos) * {shards} div {n}"))
        run, first = F.col("__run"), F.expr(f"(__run * {n} + {shards - 1}) div {shards}")
        return out.select(*[F.col(f"`{c}`") for c in rows.columns], "curve", run.cast("int").alias("shard"), (rank - first).cast("bigint").alias("slot"))
    inside = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("__bytes") + F.coalesce(F.sum("__size").over(inside), F.lit(0)) + F.col("__size") / 2
    run = F.least(F.floor(middle * shards / F.lit(max(1, total["__all"]))), F.lit(shards - 1)).cast("int")
    out = out.withColumn("shard", run).withColumn("__rank", rank)
    firsts = out.groupBy("shard").agg(F.min("__rank").alias("__first"))  # one row a shard
    return out.join(F.broadcast(firsts), "shard").select(
        *[F.col(f"`{c}`") for c in rows.columns], "curve", "shard", (F.col("__rank") - F.col("__first")).alias("slot")
    )


def document_dimensions(bits: int = BITS) -> list[Column]:
    """Language, source and length of a document."""
    return [bin_of(F.col("lang"), bits), bin_of(F.col("source"), bits), level(F.length(F.coalesce("text", F.lit(""))), bits)]
