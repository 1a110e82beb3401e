"""A Bloom filter of a key set as plain expressions: exact joins shuffle only rows that may match.

The filter is one array of 64-bit words of a fixed size, whatever the number of keys: tasks fold their
keys to words, words meet in a ``bit_or`` that combines before the shuffle, and the array reaches the
probing tasks as a scalar subquery. Too many keys make it let more rows pass, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^23 bits are 1 MB; at four places a key, 600,000 keys let about one foreign row in a thousand pass.
BITS, PLACES = 23, 4


def _places(keys: list[Column], bits: int, places: int) -> list[Column]:
    return [F.xxhash64(F.lit(i), *keys).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(places)]


def bloom_words(keys: DataFrame, on: list[str], bits: int = BITS, places: int = PLACES) -> DataFrame:
    """One row with ``words``: an array of 2^bits / 64 longs. Null keys count as values; no keys give
    words of 0."""
    at = keys.select(F.explode(F.array(*_places([F.col(c) for c in on], bits, places))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    words = at.groupBy(F.shiftright("h", 6).alias("id")).agg(F.bit_or(bit).alias("w"))
    every = keys.sparkSession.range(0, (1 << bits) // 64, 1, 1)
    dense = every.join(words, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("x"))
    return dense.select(F.transform("x", lambda x: x["w"]).alias("words"))


def may_contain(words: Column, keys: list[Column], bits: int = BITS, places: int = PLACES) -> Column:
    """Whether the key may be in the filter: true for every key of it, false for nearly all others."""
    found = F.lit(True)
    for h in _places(keys, bits, places):
        word = F.get(words, F.shiftright(h, 6).cast("int"))
        found &= F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1
    return found


def bloom_prefilter(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS, places: int = PLACES) -> DataFrame:
    """The rows whose key may be among ``keys``, in place and without a shuffle; an exact join on the
    same columns is to follow."""
    return rows.where(may_contain(bloom_words(keys, on, bits, places).scalar(), [F.col(c) for c in on], bits, places))
