"""Chosen-path similarity join over word shingles.

Documents are sets of hashed word shingles. Each set is embedded as ``TOKENS`` minhash tokens. In a
run, a node of the recursion passes each of its sets on to the children of the tokens that the
node's random function chooses, about 1/threshold of them a set, so similar sets share a child at
every level with constant probability. Small nodes are compared by brute force; larger ones are
split further. Runs are repeated until the target recall is reached. Pairs that the tokens call
close form clusters; inside clusters every pair is verified on the whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import (
    components, group_numbers, labels_of, mix, shingle_sets, small_batches, text_slices, via_table, whole_groups, word_hashes,
)

SHINGLE = 5
TOKENS = 128
#: A node of at most so many sets is compared by brute force; also the rows that are compared at once.
LIMIT = 256
#: A larger group is dealt to so many blocks, each row to a meeting with each of them, until a block
#: has ``MOST`` rows or its sets ``MOST_BYTES``; from there on blocks follow the group's size.
BLOCKS, MOST, MOST_BYTES = 16, 8192, 16 << 20
DEPTH = 3
#: Chance that a pair at the threshold is missed by the token estimate.
SKETCH_LOSS = 1e-5

_ODD = [(2 * int(x) + 1) & 0xFFFFFFFF for x in np.random.default_rng(11).integers(0, 1 << 31, TOKENS)]
_ADD = [int(x) for x in np.random.default_rng(12).integers(0, 1 << 32, TOKENS)]


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with that probability: it shares one chosen
    token a level on average, so it survives a level with the chance 1 - exp(-survival so far)."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def closest_tokens(threshold: float) -> int:
    """The fewest equal tokens at which a pair at the threshold is still looked at: the estimate is
    binomial, so this loses ``SKETCH_LOSS`` of such pairs."""
    total, k = 0.0, 0
    while True:
        total += math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k)
        if total > SKETCH_LOSS:
            return k
        k += 1


def _tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Minhash tokens (rows x TOKENS); zeros for empty sets."""
    out = np.zeros((len(sets), TOKENS), dtype=np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        x = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        buf = np.empty_like(x)
        for j in range(TOKENS):
            np.multiply(x, np.uint32(_ODD[j]), out=buf)
            np.add(buf, np.uint32(_ADD[j]), out=buf)
            out[some, j] = np.minimum.reduceat(buf, at)
    return out


def set_numbers(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit number of each set, whatever the order; 0 for the empty set."""
    return np.array([mix(np.add.reduce(mix(s, 5), keepdims=True), 8)[0] if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, row_id, text_key, text`` -> ``doc_id, row_id, text_key, node, n_shingles, tokens``: the number of
    every row's shingle set, its size and its tokens."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(3), 1 << 18):
                rows = batch.slice(a, b - a)
                sets = shingle_sets(*word_hashes(rows.column(3)), SHINGLE)
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[:3], pa.array(set_numbers(sets)), pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([t.tobytes() for t in _tokens(sets)], pa.binary()),
                    ],
                    ["doc_id", "row_id", "text_key", "node", "n_shingles", "tokens"],
                )

    return docs.select("doc_id", "row_id", "text_key", "text").mapInArrow(
        signed, "doc_id long, row_id long, text_key long, node long, n_shingles long, tokens binary"
    )


def _low_bytes(tokens: Column) -> Column:
    def low(col: pa.Array) -> pa.Array:
        found = np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, TOKENS)
        return pa.array([x.tobytes() for x in (found ^ (found >> 13)).astype(np.uint8)], pa.binary())

    low.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(low, "binary")(tokens)


def _children(paths: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the nodes that the rows' nodes pass them to."""
    rows, nodes = [], []
    bound = np.uint64(min(1.0, 1 / (threshold * TOKENS)) * (2**64 - 1))
    with np.errstate(over="ignore"):
        for j in range(TOKENS):
            child = mix(paths * np.uint64(0xA0761D6478BD642F) + tokens[:, j].astype(np.uint64), 100 + j)
            chosen = np.flatnonzero(mix(child, 9) < bound)
            rows.append(chosen)
            nodes.append(child[chosen])
    return np.concatenate(rows), np.concatenate(nodes)


def _descend(rows: DataFrame, threshold: float, runs: int) -> DataFrame:
    """``node, path, tokens`` -> the same, one level down. Level 0 has the path null: its runs' roots."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS)
            if batch.column(1).null_count:
                found = [_children(np.full(len(tokens), mix(np.array([r], np.uint64), 77)[0]), tokens, threshold) for r in range(runs)]
                at, path = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            else:
                at, path = _children(batch.column(1).to_numpy().view(np.uint64), tokens, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(path.view(np.int64))], ["node", "path"])

    return rows.select("node", "path", "tokens").mapInArrow(down, "node long, path long")


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of ``block_pairs``: whether a row is of its meeting's second block, and whether two blocks
    meet. A block may be empty, so the rows' own blocks alone don't tell."""
    left, right, own = (rows.column(name).to_numpy() for name in ("left", "right", "own"))
    return own != left, left != right


class _Parts:
    """Connected parts of the rows of some groups (numbered 0, 1, ...), as links come in.

    Where a group is a meeting of two blocks (``two``; ``side`` tells them apart), what each block
    connects is left to the block's own meeting: ``part`` is what the links inside blocks connect,
    ``whole`` what all do, and only edges that join parts are given."""

    def __init__(self, side: np.ndarray, two: np.ndarray):
        self.side, self.two = side, two
        self.part, self.whole = np.arange(len(side)), np.arange(len(side))

    def _inside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.two[a] & (self.side[a] == self.side[b])

    def open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows would still connect something."""
        return np.where(self._inside(a, b), self.part[a] != self.part[b], self.whole[a] != self.whole[b])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        inside = self._inside(a, b)
        self.part, self.whole = _merged(self.part, a[inside], b[inside]), _merged(self.whole, a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A tree of each connected part, without what the blocks' own meetings give."""
        place = np.arange(len(self.part))
        tops = np.flatnonzero((self.part == place) & (self.whole != place))
        return tops, self.whole[tops]


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = label[a], label[b]
    new = x != y
    return labels_of(len(label), x[new], y[new])[label] if new.any() else label


def block_count(n: Column, n_bytes: Column | None = None) -> Column:
    """Blocks of a group of ``n`` rows: up to ``BLOCKS`` of ``LIMIT`` rows; in larger groups the blocks
    grow, and so a row meets no more of them, up to the rows and bytes that a task may hold."""
    few = F.least(F.ceil(n / F.lit(LIMIT)), F.lit(BLOCKS))
    size = F.ceil(n / F.lit(MOST)) if n_bytes is None else F.greatest(F.ceil(n / F.lit(MOST)), F.least(n, F.ceil(n_bytes / F.lit(MOST_BYTES))))
    return F.greatest(few, size, F.lit(1)).cast("int")


def block_pairs(rows: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """Adds ``left``, ``right`` and ``own``: rows of a group are dealt to its blocks by a hash of their
    node, and every row goes to its block's meetings with all blocks of the group, its own included.
    A group of one block meets once. ``sizes``: ``group, blocks``, one row a group."""
    placed = rows.join(sizes.select(group, F.col("blocks").alias("__blocks")), group)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("__blocks")).cast("int"))
    placed = placed.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return placed.withColumns({"left": F.least("own", "__with"), "right": F.greatest("own", "__with")}).drop("__blocks", "__with")


def candidate_edges(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``a, b``: edges that connect all sets which meet in a node of some run and whose tokens are
    close. ``sets``: ``node, tokens``, different sets."""
    runs, least = runs_for(recall), closest_tokens(threshold)
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = sets.select("node", F.lit(None).cast("long").alias("path"), "tokens")
    # A byte of each token: unequal tokens seem equal now and then, equal ones never unequal.
    sketches = sets.select("node", _low_bytes(F.col("tokens")).alias("sketch"))
    edges = None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 3):
            group, node = group_numbers(rows, 3), rows.column("node").to_numpy()
            side, two = _sides(rows)
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
            parts = _Parts(side, two)
            for step in range(1, len(node)):
                i = np.flatnonzero(group[step:] == group[:-step])
                if not len(i):
                    break
                # What is connected already needs no comparison.
                i = i[parts.open(i, i + step)]
                for k in range(0, len(i), 65536):
                    j = i[k : k + 65536]
                    close = j[(sketch[j] == sketch[j + step]).sum(axis=1) >= least]
                    if len(close):
                        parts.link(close, close + step)
            a, b = parts.edges()
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    for depth in range(1, DEPTH + 1):
        paths = via_table(_descend(level, threshold, runs), "jaccard-paths")
        sizes = via_table(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-nodes")
        small = sizes if depth == DEPTH else sizes.where(F.col("n") <= LIMIT)
        met = block_pairs(paths, "path", small.withColumn("blocks", block_count(F.col("n")))).join(sketches, "node")
        met = met.select("path", "left", "right", "own", "node", "sketch").repartition(n, "path", "left", "right")
        found = met.sortWithinPartitions("path", "left", "right", "own", "node").mapInArrow(compare, "a long, b long")
        edges = found if edges is None else edges.union(found)
        big = sizes.where(F.col("n") > LIMIT).select("path")
        if depth == DEPTH or big.limit(1).count() == 0:
            break
        level = paths.join(big, "path").join(sets, "node").select("node", "path", "tokens")
    return edges


def verified(clusters: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison inside clusters. ``clusters``: ``node, row_id, root, n_copies, n_shingles``, ``docs``:
    ``row_id, text``. Gives rows ``node, links, null`` (partners met in one pair of blocks, each with
    its copies) and ``node, 0, other``: edges that connect what is linked."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = block_count(F.count(F.lit(1)), F.sum("n_shingles") * 8)
    sizes = via_table(clusters.groupBy("root").agg(blocks.alias("blocks")), "jaccard-sizes")
    # Members are a share of all documents: their list is not to be broadcast at some size.
    texts = docs.join(clusters.hint("merge"), "row_id").select("node", "root", "n_copies", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(3), 1 << 18):
                rows = batch.slice(a, b - a)
                sets = shingle_sets(*word_hashes(rows.column(3)), SHINGLE)
                # Of rows that share an id, the one whose set it is.
                own = set_numbers(sets) == rows.column(0).to_numpy()
                made = pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "root", "n_copies", "shingles"])
                yield made.filter(pa.array(own))

    sets = texts.mapInArrow(shingled, "node long, root long, n_copies long, shingles binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 3, 256):
            group = group_numbers(rows, 3)
            ends = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]])) + 1
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                yield from _verify(rows.slice(begin, end - begin), threshold)

    met = block_pairs(sets, "root", sizes).select("root", "left", "right", "own", "node", "n_copies", "shingles").repartition(n, "root", "left", "right")
    found = met.sortWithinPartitions("root", "left", "right", "own", "node").mapInArrow(compare, "node long, links long, other long")
    return via_table(found, "jaccard-links")


def _verify(rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """One meeting: ``LIMIT`` rows are compared with ``LIMIT`` rows at once, in products of 0/1 matrices
    over the shingles that both have."""
    node = rows.column("node").to_numpy()
    once = np.concatenate([[True], node[1:] != node[:-1]])  # repeated rows
    rows, node = rows.filter(pa.array(once)), node[once]
    side, meeting = _sides(rows)
    copies = rows.column("n_copies").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    n, size = len(node), np.array([len(s) for s in sets])
    # Rows come by side, so a strip that ends where the side changes is of one block.
    cuts = np.unique(np.concatenate([np.arange(0, n, LIMIT), np.flatnonzero(side[1:] != side[:-1]) + 1, [n]]))
    strips = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        values, number, count = np.unique(np.concatenate(sets[a:b]), return_inverse=True, return_counts=True)
        strips.append((int(a), int(b), values, number, count, np.repeat(np.arange(b - a), size[a:b])))
    parts, links = _Parts(side, meeting), np.zeros(n, dtype=np.int64)
    two = bool(meeting.any())
    for i, first in enumerate(strips):
        for second in strips[i:]:
            (a, b), (c, d) = first[:2], second[:2]
            # Pairs inside a block are counted by the block's own meeting; here they only connect.
            counted = not two or side[a] != side[c]
            if not counted and (parts.part[a:b] == parts.part[a]).all() and (parts.part[c:d] == parts.part[a]).all():
                continue
            common = _common(first, second)
            linked = common >= threshold * (size[a:b, None] + size[None, c:d] - common) - 1e-9
            if a == c:
                np.fill_diagonal(linked, False)
            if counted:
                links[a:b] += linked @ copies[c:d]
                if a != c:
                    links[c:d] += linked.T @ copies[a:b]
            x, y = np.nonzero(linked)
            new = parts.open(x + a, y + c)
            parts.link(x[new] + a, y[new] + c)
    x, y = parts.edges()
    some = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some], pa.int64()), pa.nulls(len(some), pa.int64())], ["node", "links", "other"])
    yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(np.zeros(len(x), np.int64)), pa.array(node[y])], ["node", "links", "other"])


def _common(first: tuple, second: tuple) -> np.ndarray:
    """Numbers of shingles that rows of two strips share; its diagonal is of no use where they are one."""
    a, b, values, number, count, owner = first
    c, d, others, other_number, _, other_owner = second
    if a == c:  # a shingle of one row is shared with no other
        mine = theirs = np.flatnonzero(count > 1)
    else:
        _, mine, theirs = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    out = np.zeros((b - a, d - c))
    for at in range(0, len(mine), 4096):
        held = []
        for rows, n, sought, all_numbers, owners in ((b - a, len(values), mine, number, owner), (d - c, len(others), theirs, other_number, other_owner)):
            column = np.full(n, -1)
            part = sought[at : at + 4096]
            column[part] = np.arange(len(part))
            column = column[all_numbers]
            has = column >= 0
            matrix = np.zeros((rows, len(part)), dtype=np.float32)
            matrix[owners[has], column[has]] = 1
            held.append(matrix)
        out += held[0] @ held[1].T
    return out


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, text_key: bool = False) -> DataFrame:
    """``doc_id, class_id, set_id, n_copies, n_links``: one row for every row of ``docs``; with
    ``text_key`` also the text's hash under that name, and ``class_number``, null without partners.

    - Words are lower-cased and separated by ASCII white space. A text of one to four words is one
      shingle. Null, empty and blank texts have no shingle and link to nothing.
    - ``set_id``: the smallest id of the rows with the same shingle set, ``n_copies`` their number.
    - ``n_links``: other rows of Jaccard similarity ``threshold`` or more, copies included.
    - ``class_id``: the smallest id that links lead to; its own id for a row without links.

    Copies collapse to one set before sets are compared, so no pair of copies is made. Links inside
    a cluster are counted by pairs of blocks and never listed. Sets are told apart by 64 bits.
    Repeated ids are rows of their own and may be in different classes; null ids take part, and a
    class of null ids only has the class null. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    docs = docs.withColumn("row_id", F.coalesce("doc_id", "text_key"))
    signed = via_table(signatures(docs), "jaccard-rows")
    copies = signed.where("node != 0").groupBy("node").agg(F.min("doc_id").alias("set_id"), F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n_copies"), F.max("n_shingles").alias("n_shingles"))
    copies = via_table(copies, "jaccard-copies")
    # The row of the set's smallest id carries its tokens.
    sets = signed.select("row_id", "node", "tokens").join(copies.select("row_id", "node"), ["row_id", "node"])
    sets = via_table(sets.select("node", "tokens").dropDuplicates(["node"]), "jaccard-sets")
    clusters = components(candidate_edges(sets, threshold, recall), "jaccard-clusters")
    clusters = via_table(clusters.join(copies.select("node", "row_id", "n_copies", "n_shingles"), "node"), "jaccard-members")
    found = verified(clusters, docs.select("row_id", "text"), threshold)
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "jaccard-classes")
    linked = via_table(copies.join(classes, "node").join(links, "node").select("node", "root", "set_id", "links"), "jaccard-linked")
    lowest = linked.groupBy("root").agg(F.min("set_id").alias("class_id"))
    decided = copies.join(linked.select("node", "root", "links"), "node", "left").join(lowest, "root", "left")
    decided = decided.where("n_copies > 1 or links > 0").select(
        "node", "set_id", "n_copies", F.coalesce("class_id", "set_id").alias("class_id"), F.coalesce("root", "node").alias("class_number"),
        (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
    )
    out = signed.select("doc_id", "text_key", "node").join(via_table(decided, "jaccard-decided"), "node", "left")
    alone = F.col("n_copies").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        *(["text_key", "class_number"] if text_key else []),
    )


def representatives(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99) -> DataFrame:
    """One row of every class, all columns: that of the class's smallest id, null after all others;
    of several such rows the one whose text has the smallest hash, once. Rows without a shingle stay."""
    key = F.xxhash64("text")
    found = jaccard_join(docs, threshold, recall, text_key=True)
    # Classes of more than one row are few beside all rows: who leaves is decided on narrow rows.
    shared = found.where("n_copies > 1 or n_links > 0")
    best = shared.groupBy("class_number").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    best = via_table(best, "jaccard-best")
    leaving = shared.join(best, "class_number").where(
        ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_key").eqNullSafe(F.col("best.text_key")))
    )
    staying = via_table(best.select("best.doc_id", "best.text_key"), "jaccard-staying")
    leaving = leaving.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & key.eqNullSafe(F.col("__key"))
    kept = docs.join(via_table(leaving, "jaccard-leaving").hint("merge"), same, "left_anti")
    # Repeated rows of one id and text that stay: one of them.
    again = docs.groupBy(F.col("doc_id").cast("long").alias("__id"), key.alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    again = again.join(staying, again["__id"].eqNullSafe(staying["doc_id"]) & (again["__key"] == staying["text_key"])).select("__id", "__key")
    again = via_table(again, "jaccard-again")
    if again.limit(1).count() == 0:
        return kept
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").union(once)
