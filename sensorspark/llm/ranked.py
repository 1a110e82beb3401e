"""Ranked lexical search over hashed max-sketches.

The index holds a sketch for every distinct text: a small byte array to whose hashed places the
occurrences of its terms are folded as coordinatewise maxima. A term's value is at most the smallest
of its places, so the items' weights give an upper bound of every document's score from its sketch
alone. A block of items meets all sketches at once. The highest bounds of each item are scored
exactly first, which gives the item a threshold; then every document whose bound still reaches the
threshold is scored, and nothing below can be among the best.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorspark.functions.bloom import bloom_prefilter
from sensorspark.llm.common import forget, mix, small_batches, text_slices, via_table, word_hashes

#: A term is a maximal run of ASCII letters and digits and of all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAPS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LOWER = {c: c + 32 for c in range(65, 91)}

#: Places a term folds into, and a sketch's places for each distinct term (rounded up to a power of 2).
PLACES, ROOM = 2, 8
#: The largest count that a place holds; from there on it stands for all terms of the document.
MOST = 255
#: Items scored together, about, by their characters: what a task holds of the items is bounded.
BLOCK_CHARS = 1 << 16
#: The best bounds of each item that are scored first.
FIRST = 32


def terms(text: str | None) -> list[str]:
    return re.findall(TERM, (text or "").translate(_LOWER))


def hashed(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct terms of every text: its row, the term's 64-bit hash and the occurrences; and
    the number of terms of each row."""
    words, at = word_hashes(pc.ascii_lower(col), lower=False, strip=GAPS)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], words[first], np.diff(np.append(first, len(words))), n


def places(words: np.ndarray) -> list[np.ndarray]:
    return [mix(words, 11 + j) for j in range(PLACES)]


def sketches(doc: np.ndarray, words: np.ndarray, tf: np.ndarray, rows: int) -> list[bytes]:
    """The max-sketch of each row: at every place the largest count of the terms that fold there."""
    distinct = np.bincount(doc, minlength=rows)
    size = np.left_shift(1, np.maximum(4, np.ceil(np.log2(np.maximum(distinct, 1) * ROOM)).astype(np.int64)))
    begin = np.concatenate([[0], np.cumsum(size)])
    held, code = np.zeros(begin[-1], np.uint8), np.minimum(tf, MOST).astype(np.uint8)
    for h in places(words):
        np.maximum.at(held, begin[doc] + (h & (size[doc] - 1).astype(np.uint64)).astype(np.int64), code)
    return [held[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """``m`` of documents of ``n`` terms: 100 - 90 + (90 n N) div L, beyond 64 bits in Python numbers."""
    if len(n) and 90 * int(n.max()) * n_docs < 1 << 62:
        return 10 + (90 * n.astype(np.int64) * n_docs) // total
    return np.array([10 + (90 * int(x) * n_docs) // total for x in n], dtype=np.int64)


class Items:
    """A block of items: their distinct terms, which the items are made of, and the terms' weights."""

    def __init__(self, texts: list[str], n_docs: int = 0, total: int = 1):
        self.sets = [sorted(set(terms(t))) for t in texts]
        self.names = sorted({w for s in self.sets for w in s})
        self.words = word_hashes(pa.array(self.names, pa.string()), lower=False, strip=GAPS)[0]
        self.n_docs, self.total = n_docs, total

    def weigh(self, df: dict[int, int], n_docs: int, total: int) -> None:
        """Weights from the documents that hold each term; terms of no document drop out."""
        self.n_docs, self.total = n_docs, total
        of = {name: (weight(n_docs, df[int(h)]) if int(h) in df else 0) for name, h in zip(self.names, self.words.view(np.int64), strict=True)}
        kept = [i for i, name in enumerate(self.names) if of[name] > 0]
        self.names, self.words = [self.names[i] for i in kept], self.words[kept]
        self.weights = np.array([of[name] for name in self.names], dtype=np.int64)
        number = {name: i for i, name in enumerate(self.names)}
        self.parts = [np.array([number[w] for w in s if w in number], dtype=np.int64) for s in self.sets]

    @cached_property
    def matrix(self) -> np.ndarray:
        """Terms x items, made by the task that uses it."""
        out = np.zeros((len(self.names), len(self.sets)))
        for i, part in enumerate(self.parts):
            out[part, i] = self.weights[part]
        return out

    @cached_property
    def at(self) -> list[np.ndarray]:
        return places(self.words)

    def bounds(self, rows: list[bytes], n: np.ndarray) -> np.ndarray:
        """No document's score for an item is above its bound (documents x items). The products are
        whole numbers; the margin covers what doubles round in sums beyond 2^53."""
        out = np.zeros((len(rows), len(self.sets)))
        size = np.array([len(r) for r in rows])
        m = length_part(n, self.n_docs, self.total)
        for s in np.unique(size):
            of = np.flatnonzero(size == s)
            held = np.frombuffer(b"".join(rows[i] for i in of), np.uint8).reshape(len(of), s)
            code = held[:, (self.at[0] & np.uint64(s - 1)).astype(np.int64)]
            for h in self.at[1:]:
                code = np.minimum(code, held[:, (h & np.uint64(s - 1)).astype(np.int64)])
            doc, term = np.nonzero(code)
            tf = code[doc, term].astype(np.int64)
            tf = np.where(tf == MOST, n[of][doc], tf)
            value = np.zeros(code.shape)
            value[doc, term] = impact(tf, m[of][doc])
            out[of] = value @ self.matrix
        return out * (1 + 1e-9)

    def score(self, text: str, wanted: list[int]) -> list[int]:
        """The exact scores of a text for some items, from its terms themselves."""
        found = terms(text)
        count = Counter(found)
        tf = np.array([count.get(name, 0) for name in self.names], dtype=np.int64)
        worth = self.weights * impact(tf, length_part(np.array([len(found)]), self.n_docs, self.total))
        return [int(worth[self.parts[i]].sum()) for i in wanted]


_INDEX = "digest binary, doc_id long, n long, sketch binary, term long, df long"


def _indexed(docs: DataFrame, words: np.ndarray, with_sketches: bool) -> DataFrame:
    """Rows with ``digest, doc_id, n, sketch`` for texts with a term, and ``term, df`` from each task
    for the given terms that its documents hold."""
    vocabulary = np.sort(words)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column("text")):
                part = batch.slice(a, b - a)
                doc, found, tf, n = hashed(part.column("text"))
                if len(vocabulary) and len(found):
                    at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
                    df += np.bincount(at[vocabulary[at] == found], minlength=len(vocabulary))
                if with_sketches:
                    some = pa.array(n > 0)
                    made = pa.array([s for s, k in zip(sketches(doc, found, tf, len(n)), n, strict=True) if k], pa.binary())
                    kept, none = part.filter(some), pa.nulls(len(made), pa.int64())
                    yield pa.RecordBatch.from_arrays([kept.column("digest"), kept.column("doc_id"), pa.array(n[n > 0]), made, none, none], names)
        held = np.flatnonzero(df)
        none = pa.nulls(len(held))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(vocabulary[held].view(np.int64)), pa.array(df[held])], names
        )

    names = ["digest", "doc_id", "n", "sketch", "term", "df"]
    return docs.mapInArrow(build, _INDEX)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = BLOCK_CHARS, first: int = FIRST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents with a score above 0 of
    each item (``item_id, text``), equal scores by ascending ``doc_id``, null last.

    - Null and empty texts have no terms: such documents don't count, such items have no rows. Items
      that agree in id and text are one; several texts of one id are items of their own.
    - Equal texts are indexed once, with their ``k`` smallest ids, so a frequent text is searched and
      scored once. Every row is a document, repeated ids and rows too.
    - Items go through in blocks of about ``block_chars`` characters, each over all sketches. Document
      counts of terms are taken by 64-bit hash over all documents; scores come from the terms' letters.
    - Other columns take no part; empty tables give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out, index = [], None
    for k_block in range(blocks):
        held = [(r["item_id"], r["text"]) for r in asked.where(block_of == k_block).collect()]
        block = Items([t for _, t in held])
        if index is None:
            made = via_table(_indexed(rows, block.words, True), "ranked-index")
            whole = made.where("digest is not null").agg(F.count("n").alias("docs"), F.sum("n").alias("terms")).first()
            n_docs, total = whole["docs"], whole["terms"] or 1
            index = via_table(_by_text(made.where("digest is not null"), k), "ranked-texts")
            counted = made.where("term is not null")
        else:
            counted = _indexed(rows, block.words, False)
        df = {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        block.weigh(df, n_docs, total)
        if k_block == 0:
            forget(made)
        if block.names:
            out.append(_best(rows, index, block, [i for i, _ in held], k, first))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = out[0]
    for more in out[1:]:
        best = best.union(more)
    return best


def _by_text(made: DataFrame, k: int) -> DataFrame:
    """One row a distinct text with its ``k`` smallest ids; the limit is taken before rows of a text
    meet, and the rest reuses that exchange."""
    order = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last())
    few = made.select("digest", "doc_id", "n", "sketch").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"])
    return few.groupBy("digest").agg(ids.alias("ids"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))


def _best(rows: DataFrame, index: DataFrame, block: Items, names: list[int | None], k: int, first: int) -> DataFrame:
    spark = rows.sparkSession
    n_items = len(block.sets)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's ``first`` highest bounds of each item."""
        bound, digest = np.zeros((0, n_items)), np.zeros((0, n_items), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = block.bounds(batch.column("sketch").to_pylist(), batch.column("n").to_numpy())
            own = np.array(batch.column("digest").to_pylist(), dtype=object)
            if len(bound) == first:
                better = (new > bound.min(axis=0)).any(axis=1)
                new, own = new[better], own[better]
            bound = np.vstack([bound, new])
            digest = np.vstack([digest, np.repeat(own[:, None], n_items, axis=1)])
            if len(bound) > first:
                keep = np.argpartition(-bound, first - 1, axis=0)[:first]
                bound, digest = np.take_along_axis(bound, keep, 0), np.take_along_axis(digest, keep, 0)
        row, item = np.nonzero(bound > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(digest[row, item].tolist(), pa.binary()), pa.array(bound[row, item])], ["item", "digest", "bound"])

    def reaching(batches: Iterator[pa.RecordBatch], least: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Every document and item whose bound reaches the item's threshold."""
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = block.bounds(batch.column("sketch").to_pylist(), batch.column("n").to_numpy())
            doc, item = np.nonzero((bound >= least) & (bound > 0))
            digest = batch.column("digest").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), digest, pa.array(bound[doc, item])], ["item", "digest", "bound"])

    def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = batch.column("items").to_pylist(), batch.column("text").to_pylist()
            row = pa.array(np.repeat(np.arange(len(items)), [len(i) for i in items]))
            score = [s for text, wanted in zip(texts, items, strict=True) for s in block.score(text, wanted)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for wanted in items for i in wanted], pa.int32()), batch.column("digest").take(row), batch.column("ids").take(row), pa.array(score, pa.int64())],
                ["item", "digest", "ids", "score"],
            )

    lists = index.select("digest", "ids", F.col("ids")[0].alias("doc_id"))
    bounded = "item int, digest binary, bound double"

    def exact(candidates: DataFrame) -> DataFrame:
        """``item, rank, doc_id, score`` of the k best of each item among candidates, scored from the
        texts. The filter lets through the texts that are wanted, of copies that of the smallest id."""
        wanted = via_table(candidates.groupBy("digest").agg(F.collect_list("item").alias("items")).join(lists, "digest"), "ranked-wanted")
        some = bloom_prefilter(rows, wanted, ["digest", "doc_id"])
        some = some.withColumnsRenamed({"digest": "own", "doc_id": "own_id"})
        scored = some.join(wanted, (F.col("own") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("doc_id"))).select("digest", "ids", "items", "text").mapInArrow(rescored, "item int, digest binary, ids array<long>, score long")
        # A document among the best has a text among the k first by score and smallest id. The limits
        # apply before rows of an item meet.
        item, id_ = Window.partitionBy("item"), F.col("doc_id").asc_nulls_last()
        few = scored.where("score > 0").withColumn("doc_id", F.col("ids")[0])
        few = few.withColumn("r", F.dense_rank().over(item.orderBy(F.desc("score"), id_, "digest"))).where(F.col("r") <= k).dropDuplicates(["item", "digest"])
        every = few.select("item", "score", F.explode("ids").alias("doc_id"))
        return every.withColumn("rank", F.row_number().over(item.orderBy(F.desc("score"), id_))).where(F.col("rank") <= k)

    top = index.select("digest", "n", "sketch").mapInArrow(highest, bounded)
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "digest")
    top = top.withColumn("r", F.row_number().over(order)).where(F.col("r") <= first)
    # One number for each item of the block.
    least = np.zeros(n_items)
    for r in exact(top).groupBy("item").agg(F.count("rank").alias("n"), F.min("score").alias("low")).where(F.col("n") == k).collect():
        least[r["item"]] = r["low"]
    candidates = index.select("digest", "n", "sketch").mapInArrow(lambda batches: reaching(batches, least), bounded)
    id_of = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return exact(candidates).join(id_of, "item").select("item_id", "rank", "doc_id", "score")
