"""A forest of regression trees whose work follows what rows store, not how wide their vectors are.

Spark's forest holds a histogram of all features and bins for every node: with a column or a bin for each
sensor that is sensors times nodes. Here rows are reduced once to the bins of their numbers and the places
of their 1s (cells), equal ones counted; they lie as files in the shared folder. A task grows one tree: it
draws its bag while it reads, merges equal cells, and looks only at bins that a node's rows have. Where a
node has more cells than a task may hold, its histogram is summed up file by file, without holding rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.ml.linalg import SparseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.ordering import running, with_bucket
from sensorspark.operators.encode import TableModel
from sensorspark.session import forget, via_table

#: Cells that a task grows a tree on at a time; nodes of more are split by sums over the files.
MOST_CELLS = 3 << 18
#: Distinct values of a number, sampled or not, that come to the driver to place its thresholds.
MOST_VALUES = 100_000
#: Cells whose predictions a worker keeps.
KEPT = 1 << 18
_BLOCK = 1 << 17
_TREE = "tree int, feature array<int>, cut array<int>, child array<int>, value array<double>, worth array<double>, members array<int>, sizes array<int>, bits binary"


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of everything that vectors (``unwrap_udt``) store."""
    values, places = vectors.field("values"), vectors.field("indices")
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(values), 0))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    sparse = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(places), 0)) > 0
    at[sparse[row]] = np.asarray(places.flatten())
    return row, at, np.asarray(values.flatten())


@dataclass
class Layout:
    """Which entries of a vector are numbers or labels (``dense``; ``arity`` 0: a number) and how numbers are
    cut. All other entries are 0 or 1: a row keeps the places of its 1s, counted from 1."""

    width: int
    dense: list[int]
    arity: list[int]
    thresholds: list[list[float]] = field(default_factory=list)

    def __post_init__(self):
        self._place = np.full(self.width, -1, np.int32)
        self._place[self.dense] = np.arange(len(self.dense))
        self._cuts = [np.array(t, float) for t in self.thresholds]

    def numbers(self, vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dense entries as a matrix; row and place of the 1s."""
        row, at, value = entries(vectors)
        place = self._place[at]
        x = np.zeros((len(vectors), len(self.dense)))
        x[row[place >= 0], place[place >= 0]] = value[place >= 0]
        one = (place < 0) & (value != 0)
        return x, row[one], at[one] + 1

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.int32)
        for j, (arity, cuts) in enumerate(zip(self.arity, self._cuts)):
            out[:, j] = x[:, j] if arity else np.searchsorted(cuts, x[:, j])
            if arity and ((out[:, j] < 0) | (out[:, j] >= arity)).any():
                raise ValueError(f"feature {self.dense[j]} has a label outside of 0 to {arity - 1}")
        return out

    def cells(self, vectors: pa.StructArray) -> np.ndarray:
        x, row, one = self.numbers(vectors)
        return with_ones(self.bins(x), np.bincount(row, minlength=len(x)), one)

    @property
    def sizes(self) -> list[int]:
        """How many bins each dense entry has."""
        return [a or len(t) + 1 for a, t in zip(self.arity, self.thresholds)]

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """Cells as single values, equal where they are."""
        base = [*self.sizes, *[self.width + 1] * (cells.shape[1] - len(self.dense))]
        if np.prod([float(b) for b in base]) < 2.0**62:
            key = np.zeros(len(cells), np.int64)
            for j, b in enumerate(base):
                key = key * b + cells[:, j]
            return key
        return np.ascontiguousarray(cells).view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()


def with_ones(bins: np.ndarray, n: np.ndarray, ones: np.ndarray, most: int | None = None) -> np.ndarray:
    """Bins, and beside them the ``n`` places of each row's 1s, filled up with 0."""
    d, most = bins.shape[1], int(n.max(initial=0)) if most is None else most
    out = np.zeros((len(bins), d + most), np.int32)
    out[:, :d] = bins
    row = np.repeat(np.arange(len(n)), n)
    out[row, d + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = ones
    return out


def thresholds(values: np.ndarray, counts: np.ndarray, most: int) -> list[float]:
    """Up to ``most`` cuts between distinct values, so that rows between two cuts are about as many."""
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= most:
        return between.tolist()
    stride = counts.sum() / (most + 1)
    sums, target, out = np.cumsum(counts), stride, []
    for i in range(len(between)):
        if abs(sums[i] - target) < abs(sums[i + 1] - target):
            out.append(float(between[i]))
            target += stride
    return out[:most]


# Growing a tree


class Sets:
    """Sets of labels by number: large ones as bits, small ones as sorted keys (set * stride + label)."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, bits: np.ndarray, stride: int):
        """``sizes``: labels of each set in ``members``; -1 where it is the next in ``bits``."""
        self.stride, self.bits, large = stride, bits, sizes < 0
        self.keys = np.repeat(np.arange(len(sizes), dtype=np.int64), np.where(large, 0, sizes)) * stride + members
        self.start = np.where(large, (np.cumsum(large) - 1) * self.bytes_of(stride), -1)

    @staticmethod
    def bytes_of(stride: int) -> int:
        return (stride + 7) // 8

    @staticmethod
    def stored(sets: Sequence[np.ndarray], stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        large = [len(s) * 32 > stride for s in sets]
        bits = np.zeros((sum(large), Sets.bytes_of(stride) * 8), bool)
        for row, s in zip(bits, (s for s, x in zip(sets, large) if x)):
            row[s] = True
        sizes = np.array([-1 if x else len(s) for s, x in zip(sets, large)], np.int32)
        small = [s for s, x in zip(sets, large) if not x]
        return np.concatenate([np.zeros(0, np.int32), *small]).astype(np.int32), sizes, np.packbits(bits, axis=1, bitorder="little").ravel()

    def has(self, of: np.ndarray, label: np.ndarray) -> np.ndarray:
        out, start = np.zeros(len(of), bool), self.start[of]
        large = start >= 0
        k = label[large]
        out[large] = (self.bits[start[large] + (k >> 3)] >> (k & 7).astype(np.uint8)) & 1
        if len(self.keys) and not large.all():
            wanted = of[~large].astype(np.int64) * self.stride + label[~large]
            out[~large] = self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted
        return out


class Tree:
    """Nodes as arrays. ``feature``: -1 in a leaf, a dense entry, or (number of dense entries) + the place of
    a 1. Rows go to ``child`` or, where their bin is above ``cut`` or they have the 1, to the node after it.
    ``cut`` of a label is the number of its set in ``members``: those labels go to ``child``."""

    def __init__(self, layout: Layout):
        self.d, self.arity = len(layout.dense), np.array([*layout.arity, 0], np.int64)
        self.stride = int(self.arity.max(initial=0)) + 1
        self.feature, self.cut, self.child, self.value, self.worth = (np.zeros(0, t) for t in (np.int32, np.int32, np.int32, float, float))
        self.sets: list[np.ndarray] = []
        self._known: Sets | None = None

    def add(self, value: np.ndarray) -> int:
        first, more = len(self.feature), len(value)
        self.feature = np.concatenate([self.feature, np.full(more, -1, np.int32)])
        self.cut, self.child = (np.concatenate([a, np.zeros(more, np.int32)]) for a in (self.cut, self.child))
        self.value, self.worth = np.concatenate([self.value, value]), np.concatenate([self.worth, np.zeros(more)])
        return first

    def right(self, cells: np.ndarray, feature: np.ndarray, cut: np.ndarray, sets: Sets) -> np.ndarray:
        """Whether each row of cells goes right at a node."""
        out = np.zeros(len(cells), bool)
        one = feature >= self.d
        if self.d:
            at = np.flatnonzero(~one)
            f = feature[at]
            b = cells[at, f]
            out[at] = b > cut[at]
            label = self.arity[f] > 0
            if label.any():
                out[at[label]] = ~sets.has(cut[at[label]], b[label])
        at = np.flatnonzero(one)
        if len(at):
            wanted = feature[at] - self.d
            for j in range(self.d, cells.shape[1]):
                out[at] |= cells[at, j] == wanted
        return out

    def known(self) -> Sets:
        if self._known is None:
            self._known = Sets(*Sets.stored(self.sets, self.stride), self.stride)
        return self._known

    def leaves(self, cells: np.ndarray) -> np.ndarray:
        """The node at which each cell ends."""
        at, live, sets = np.zeros(len(cells), np.int32), np.arange(len(cells)), self.known()
        while len(live):
            live = live[self.feature[at[live]] >= 0]
            node = at[live]
            at[live] = self.child[node] + self.right(cells[live], self.feature[node], self.cut[node], sets)
        return at

    def split(self, ids: np.ndarray, best: Splits) -> np.ndarray:
        """Give two children to each node with a split; numbers of the left ones."""
        of, w, s = best.feature, best.w, best.s
        first = self.add(np.column_stack([best.left_s / best.left_w, (s - best.left_s) / (w - best.left_w)]).ravel())
        left = first + 2 * np.arange(len(ids), dtype=np.int32)
        cut = best.cut.copy()
        labels = np.flatnonzero((of < self.d) & (self.arity[np.minimum(of, self.d)] > 0))
        for i in labels:
            self.sets.append(best.members(i))
            cut[i] = len(self.sets) - 1
        self._known = None
        self.feature[ids], self.cut[ids], self.child[ids], self.worth[ids] = of, cut, left, best.gain
        return left


class Splits:
    """The best split of each of some nodes, among those offered so far. Sums are held against a node's own
    mean, so that a node of equal labels has no gain but rounding."""

    def __init__(self, w: np.ndarray, s: np.ndarray, least: float, floor: np.ndarray):
        m = len(w)
        self.w, self.s, self.least, self.floor = w, s, least, floor
        self.feature, self.cut = np.full(m, -1, np.int32), np.zeros(m, np.int32)
        self.gain, self.left_w, self.left_s = np.zeros(m), np.zeros(m), np.zeros(m)
        self.place = np.zeros((m, 2), np.int64)
        self.orders: dict[int, np.ndarray] = {}

    def _keep(self, node, gain, feature, cut, left_w, left_s, starts, place=None) -> None:
        """Take what is better than before; ``starts``: where each node's candidates begin."""
        top = np.maximum.reduceat(gain, starts)
        seg = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(gain))))
        hit = np.flatnonzero(gain == top[seg])
        hit = hit[np.unique(seg[hit], return_index=True)[1]]
        at = node[hit]
        good = (gain[hit] > self.gain[at]) & (gain[hit] > self.floor[at])
        hit, at = hit[good], at[good]
        self.feature[at], self.cut[at], self.gain[at] = np.broadcast_to(feature, gain.shape)[hit], cut[hit], gain[hit]
        self.left_w[at], self.left_s[at] = left_w[hit], left_s[hit]
        if place is not None:
            self.place[at, 0], self.place[at, 1] = starts[seg[hit]], hit

    def offer_dense(self, feature: int, labels: bool, node: np.ndarray, b: np.ndarray, pw: np.ndarray, ps: np.ndarray) -> None:
        """Weights and sums of a dense entry's bins, in order of nodes and bins; labels go by their means."""
        if not len(node):
            return
        if labels:
            order = np.lexsort((ps / pw, node))
            node, b, pw, ps = node[order], b[order], pw[order], ps[order]
            self.orders[feature] = b
        d = ps - pw * (self.s / self.w)[node]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        n = np.diff(np.append(starts, len(node)))
        cw, cd, cs = (np.cumsum(x) for x in (pw, d, ps))
        lw, ld, ls = (c - np.repeat((c - x)[starts], n) for c, x in ((cw, pw), (cd, d), (cs, ps)))
        rw = self.w[node] - lw
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((lw >= self.least) & (rw >= self.least), ld * ld * (1 / lw + 1 / rw), -1.0)
        self._keep(node, gain, feature, b, lw, ls, starts, node if labels else None)

    def offer_ones(self, first: int, node: np.ndarray, one: np.ndarray, pw: np.ndarray, ps: np.ndarray) -> None:
        """Weights and sums of the rows that have a 1 at a place, in order of nodes."""
        if not len(node):
            return
        d = ps - pw * (self.s / self.w)[node]
        rest = self.w[node] - pw
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((pw >= self.least) & (rest >= self.least), d * d * (1 / pw + 1 / rest), -1.0)
        self._keep(node, gain, first + one, np.zeros(len(node), np.int32), rest, self.s[node] - ps, np.flatnonzero(np.append(True, node[1:] != node[:-1])))

    def members(self, i: int) -> np.ndarray:
        a, b = self.place[i]
        return np.sort(self.orders[int(self.feature[i])][a : b + 1]).astype(np.int32)

    def only(self, which: np.ndarray) -> Splits:
        out = Splits(self.w[which], self.s[which], self.least, self.floor[which])
        for name in ("feature", "cut", "gain", "left_w", "left_s", "place"):
            setattr(out, name, getattr(self, name)[which])
        out.orders = self.orders
        return out


def summed(node: np.ndarray, b: np.ndarray, size: int, m: int, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights and sums of each node and bin that occur, in order."""
    key = node.astype(np.int64) * size + b
    if m * size <= 4 * len(key) + 65_536:
        pw = np.bincount(key, w, m * size)
        at = np.flatnonzero(pw)
        pw, ps = pw[at], np.bincount(key, s, m * size)[at]
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        at, pw, ps = key[starts], np.add.reduceat(w[order], starts), np.add.reduceat(s[order], starts)
    return at // size, at % size, pw, ps


def joined(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Blocks as one, column by column, so that little is held twice."""
    columns = [list(x) for x in zip(*parts)]
    parts.clear()
    out = []
    for column in columns:
        out.append(np.concatenate(column))
        column.clear()
    return out


@dataclass
class Grower:
    """One tree of a forest. ``read`` gives its bag anew each time: blocks of cells, weights, and sums of labels."""

    layout: Layout
    ones: int  # places for 1s beside the dense entries
    max_depth: int
    least: float
    least_gain: float
    noise: float
    most: int

    def splits(self, w: np.ndarray, s: np.ndarray) -> Splits:
        return Splits(w, s, self.least, np.maximum(self.noise, np.nextafter(self.least_gain, -1)) * w if self.least_gain else self.noise * w)

    def merged(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells, w, s = joined(parts)
        _, first, same = np.unique(self.layout.keys(cells), return_index=True, return_inverse=True)
        return cells[first], np.bincount(same, w, len(first)), np.bincount(same, s, len(first))

    def held(self, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """All cells with their sums, or nothing if they are more than a task may hold."""
        parts, n = [], 0
        for block in blocks:
            parts.append(block)
            n += len(block[1])
            if n > self.most + self.most // 2:
                parts = [self.merged(parts)]
                n = len(parts[0][1])
                if n > self.most:
                    return None
        if not n:
            return np.zeros((0, len(self.layout.dense) + self.ones), np.int32), np.zeros(0), np.zeros(0)
        out = self.merged(parts)
        return out if len(out[1]) <= self.most else None

    def grow(self, read) -> Tree:
        tree = Tree(self.layout)
        found = self.held(read())
        if found is not None:
            tree.add(np.array([found[2].sum() / found[1].sum() if len(found[1]) else 0.0]))
            rows = [*found, np.zeros(len(found[1]), np.int32)]
            del found
            self.below(tree, rows, np.zeros(1, np.int64), np.zeros(1, np.int64))
            return tree
        tree.add(np.zeros(1))
        large, depth, small = np.zeros(1, np.int64), 0, []  # small: (node, its depth, its rows)
        while len(large) and depth < self.max_depth:
            best, rows = self.by_sums(tree, read, large)
            if depth == 0:
                tree.value[0] = best.s[0] / best.w[0]
                share = rows / best.w[0]  # rows are in proportion to their weights, about
            best = best.only(which := np.flatnonzero(best.feature >= 0))
            left = tree.split(large[which], best)
            depth += 1
            children = np.column_stack([left, left + 1]).ravel().astype(np.int64)
            n = share * np.column_stack([best.left_w, best.w - best.left_w]).ravel()
            small += [(c, depth, k) for c, k in zip(children, n) if k <= self.most]
            large = children[n > self.most]
        while small:
            group, n = [], 0
            while small and (not group or n + small[-1][2] <= self.most):
                group.append(small.pop())
                n += group[-1][2]
            ids, depths = (np.array(x, np.int64) for x in list(zip(*group))[:2])
            order = np.argsort(ids)
            ids, depths = ids[order], depths[order]
            rows = joined([(*block, at) for block, at in self.at(tree, read, ids)])
            self.below(tree, rows, ids, depths)
        return tree

    def at(self, tree: Tree, read, ids: np.ndarray) -> Iterator[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]:
        """Blocks of rows that end at the given leaves (in order), and at which of them."""
        for cells, w, s in read():
            leaf = tree.leaves(cells)
            place = np.minimum(np.searchsorted(ids, leaf), len(ids) - 1)
            mine = np.flatnonzero(ids[place] == leaf)
            yield (cells[mine], w[mine], s[mine]), place[mine].astype(np.int32)

    def by_sums(self, tree: Tree, read, ids: np.ndarray) -> tuple[Splits, int]:
        """Best splits of leaves whose rows are not held, and how many rows they have."""
        m, d = len(ids), len(self.layout.dense)
        sizes = [*self.layout.sizes, *([self.layout.width + 1] if self.ones else [])]
        sums = [np.zeros((2, m * size)) for size in sizes]
        w0, s0, n = np.zeros(m), np.zeros(m), 0
        for (cells, w, s), place in self.at(tree, read, ids):
            n += len(w)
            w0 += np.bincount(place, w, m)
            s0 += np.bincount(place, s, m)
            for j in range(cells.shape[1]):
                k = min(j, d)
                rows = slice(None) if j < d else np.flatnonzero(cells[:, j])
                key = place[rows].astype(np.int64) * sizes[k] + cells[rows, j]
                sums[k][0] += np.bincount(key, w[rows], m * sizes[k])
                sums[k][1] += np.bincount(key, s[rows], m * sizes[k])
        best = self.splits(w0, s0)
        for k, size in enumerate(sizes):
            at = np.flatnonzero(sums[k][0])
            pairs = at // size, at % size, sums[k][0][at], sums[k][1][at]
            best.offer_dense(k, self.layout.arity[k] > 0, *pairs) if k < d else best.offer_ones(d, *pairs)
        return best, n

    def below(self, tree: Tree, rows: list[np.ndarray], ids: np.ndarray, depth: np.ndarray) -> None:
        """Grow all that lies below some leaves from their rows (emptied here, so that one copy is held): cells,
        weights, sums, and each row's place in ``ids``."""
        cells, w, s, at = rows
        rows.clear()
        d, sizes = len(self.layout.dense), self.layout.sizes
        while True:
            # One cell cannot be split.
            open_ = (np.bincount(at, minlength=len(ids)) > 1) & (depth < self.max_depth)
            if not open_.any():
                return
            cells, w, s, at = self.kept(open_, cells, w, s, at)
            ids, depth = ids[open_], depth[open_]
            m = len(ids)
            best = self.splits(np.bincount(at, w, m), np.bincount(at, s, m))
            for j in range(d):
                best.offer_dense(j, self.layout.arity[j] > 0, *summed(at, cells[:, j], sizes[j], m, w, s))
            if cells.shape[1] > d:
                size, pairs = self.layout.width + 1, []
                for j in range(d, cells.shape[1]):
                    row = np.flatnonzero(cells[:, j])
                    pairs.append(summed(at[row], cells[row, j], size, m, w[row], s[row]))
                node, one, pw, ps = (np.concatenate(x) for x in zip(*pairs))
                best.offer_ones(d, *summed(node, one, size, m, pw, ps))
            which = best.feature >= 0
            if not which.any():
                return
            cells, w, s, at = self.kept(which, cells, w, s, at)
            ids, depth, best = ids[which], depth[which], best.only(np.flatnonzero(which))
            first = len(tree.sets)
            left = tree.split(ids, best)
            sets = Sets(*Sets.stored(tree.sets[first:], tree.stride), tree.stride)
            node = ids[at]
            at = 2 * at + tree.right(cells, tree.feature[node], tree.cut[node] - first * (tree.arity[np.minimum(tree.feature[node], d)] > 0), sets)
            ids, depth = np.column_stack([left, left + 1]).ravel().astype(np.int64), np.repeat(depth + 1, 2)

    @staticmethod
    def kept(which: np.ndarray, cells: np.ndarray, w: np.ndarray, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        if which.all():
            return cells, w, s, at
        rows = np.flatnonzero(which[at])
        return cells[rows], w[rows], s[rows], (np.cumsum(which, dtype=np.int32) - 1)[at[rows]]


@dataclass
class Bag:
    """What a tree reads: cells in files, with weights drawn anew from the same numbers each time."""

    uri: str
    dense: int
    ones: int
    mean: float
    rate: float
    bootstrap: bool
    seed: int

    def files(self) -> tuple[pa.fs.FileSystem, list[str]]:
        system, path = pa.fs.FileSystem.from_uri(self.uri)
        found = system.get_file_info(pa.fs.FileSelector(path))
        return system, sorted(f.path for f in found if f.base_name.startswith("part-") and f.size)

    def __call__(self, tree: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        system, paths = self.files()
        for i, path in enumerate(paths):
            with system.open_input_file(path) as f:
                for j, batch in enumerate(pq.ParquetFile(f).iter_batches(_BLOCK)):
                    yield from self.block(batch, np.random.default_rng([self.seed, tree, i, j]))

    def block(self, batch: pa.RecordBatch, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, y = np.asarray(batch["n"]), np.asarray(batch["y"])
        if self.bootstrap:
            w = rng.poisson(n * self.rate)
        else:
            w = n if self.rate >= 1 else rng.binomial(n, self.rate)
        rows = np.flatnonzero(w)
        if not len(rows):
            return
        taken = batch.take(pa.array(rows))
        w = w[rows].astype(float)
        bins = np.column_stack([np.zeros((len(rows), 0), np.int32), *[np.asarray(taken[f"b{j}"]) for j in range(self.dense)]])
        ones = taken["ones"]
        cells = with_ones(bins, np.asarray(pa.compute.list_value_length(ones)), np.asarray(ones.flatten()), self.ones)
        # Rows lie in order, so equal cells are neighbours.
        new = np.append(True, (cells[1:] != cells[:-1]).any(axis=1))
        starts = np.flatnonzero(new)
        yield cells[starts], np.add.reduceat(w, starts), np.add.reduceat(w * (y[rows] - self.mean), starts)


# The forest


class SparseForestRegressor(RandomForestRegressor):
    """Spark's random forest of regression trees by another road: the same parameters, bags (Poisson, a draw
    for each row and tree), thresholds (quantiles of a sample) and gains (variance, every feature in each split),
    and the same errors for null labels and too few bins. Feature subsets, row weights and leaf columns are left
    to Spark's own."""

    def _fit(self, dataset: DataFrame):
        get = self.getOrDefault
        if get("featureSubsetStrategy") != "all" or self.isSet("weightCol") or get("leafCol") or get("impurity") != "variance" or get("minWeightFractionPerNode"):
            return super()._fit(dataset)
        label = get("labelCol")
        # Three jobs read them: the stages before make the vectors once.
        stored = via_table(dataset.select(F.unwrap_udt(get("featuresCol")).alias("v"), F.col(label).cast("double").alias("y")), "forest-rows")
        y = F.col("y")
        bad = y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
        rows = stored.select(
            F.coalesce("v", F.raise_error(F.lit("Vectors MUST NOT be Null")).cast(stored.schema["v"].dataType)).alias("v"),
            F.when(bad, F.raise_error(F.lit(f"Labels MUST NOT be Null, NaN or Infinity: {label}")).cast("double")).otherwise(y).alias("y"),
        )
        n, mean, var = rows.agg(F.count("y"), F.avg("y"), F.var_pop("y")).first()
        if not n:
            raise ValueError("a forest needs at least one row")
        layout = self._layout(dataset, rows, n)
        cells = self._cells(rows, layout)
        forget(stored)
        ones = cells.agg(F.max(F.size("ones"))).first()[0]
        uri = cells._stored_at if re.match(r"[a-z][a-z0-9+.-]*:", cells._stored_at) else f"file://{cells._stored_at}"
        bag = Bag(uri, len(layout.dense), ones, mean, get("subsamplingRate"), get("bootstrap"), abs(get("seed")))
        grower = Grower(layout, ones, get("maxDepth"), float(get("minInstancesPerNode")), get("minInfoGain"), 1e-12 * var + 1e-28 * mean * mean, MOST_CELLS)

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch["id"].to_pylist():
                    tree = grower.grow(lambda t=t: bag(t))
                    members, sizes, bits = Sets.stored(tree.sets, tree.stride)
                    columns = [[t], *[[x] for x in (tree.feature, tree.cut, tree.child, tree.value + bag.mean, tree.worth, members, sizes)], [bits.tobytes()]]
                    types = [pa.int32(), *[pa.list_(x) for x in (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32())], pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=[c.split()[0] for c in _TREE.split(", ")])

        trees = get("numTrees")
        table = via_table(dataset.sparkSession.range(0, trees, 1, trees).mapInArrow(grow, _TREE), "forest")
        forget(cells)
        model = SparseForestModel(table, [layout.width, layout.dense, layout.arity, layout.thresholds])
        model._set(featuresCol=get("featuresCol"), predictionCol=get("predictionCol"))
        return model

    def _layout(self, dataset: DataFrame, rows: DataFrame, n: int) -> Layout:
        """Numbers and labels by the column's metadata; thresholds as Spark places them, from a sample."""
        get = self.getOrDefault
        attrs = dataset.schema[get("featuresCol")].metadata.get("ml_attr", {})
        groups = attrs.get("attrs", {})
        width = attrs.get("num_attrs") or sum(map(len, groups.values())) or rows.select(F.coalesce("v.size", F.size("v.values"))).first()[0]
        arity = {a["idx"]: a.get("num_vals") or len(a.get("vals", ())) for a in groups.get("nominal", ())}
        for idx, size in arity.items():
            if not size or size > get("maxBins"):
                raise ValueError(f"maxBins ({get('maxBins')}) must be at least the number of values of each categorical feature; feature {idx} has {size or 'an unknown number'}")
        binary = {a["idx"] for a in groups.get("binary", ())}
        dense = [i for i in range(width) if i not in binary]
        start = Layout(width, dense, [arity.get(i, 0) for i in dense])
        most = min(get("maxBins"), n) - 1
        fraction = min(1.0, max(get("maxBins") ** 2, 10_000) / n)
        sampled = rows if fraction == 1 else rows.sample(False, fraction, abs(get("seed")))
        numbers = [j for j, i in enumerate(dense) if i not in arity]

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, _, _ = start.numbers(batch["v"])
                if not np.isfinite(x).all():
                    raise ValueError("Vectors MUST NOT be NaN or Infinity")
                for j in numbers:
                    v, k = np.unique(x[:, j] + 0.0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j, np.int32)), pa.array(v), pa.array(k)], names=["f", "v", "k"])

        counted = via_table(sampled.select("v").mapInArrow(values, "f int, v double, k bigint").groupBy("f", "v").agg(F.sum("k").alias("k")), "forest-values")
        distinct = dict(counted.groupBy("f").count().collect())
        few = counted.where(F.col("f").isin([j for j, k in distinct.items() if k <= MOST_VALUES])).toPandas()
        cuts: list[list[float]] = [[] for _ in dense]
        for j, of in few.groupby("f"):
            cuts[j] = thresholds(of["v"].to_numpy(), of["k"].to_numpy(), most)
        for j in (j for j, k in distinct.items() if k > MOST_VALUES):
            cuts[j] = self._far_thresholds(counted.where(F.col("f") == j).select("v", "k"), most)
        forget(counted)
        return Layout(width, dense, start.arity, cuts)

    @staticmethod
    def _far_thresholds(counted: DataFrame, most: int) -> list[float]:
        """Thresholds among more values than the driver takes: the last value of each stride of rows."""
        sums = via_table(running(with_bucket(counted, "v"), [], "v", measures={"__to": ("sum", F.col("k"))}), "forest-ranks")
        total = sums.agg(F.max("__to")).first()[0]
        part = F.floor((F.col("__to") - 1) * (most + 1) / F.lit(total))
        ends = [r[0] for r in sums.groupBy(part.alias("p")).agg(F.max("v").alias("v")).orderBy("v").select("v").collect()]
        forget(sums)
        return ends[:-1]

    @staticmethod
    def _cells(rows: DataFrame, layout: Layout) -> DataFrame:
        names = [f"b{j}" for j in range(len(layout.dense))]

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, row, one = layout.numbers(batch["v"])
                if not np.isfinite(x).all():
                    raise ValueError("Vectors MUST NOT be NaN or Infinity")
                offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(x)))).astype(np.int32)
                ones = pa.ListArray.from_arrays(pa.array(offsets), pa.array(one.astype(np.int32)))
                bins = layout.bins(x)
                yield pa.RecordBatch.from_arrays([*[pa.array(bins[:, j]) for j in range(bins.shape[1])], ones, batch["y"]], names=[*names, "ones", "y"])

        schema = ", ".join([*[f"{c} int" for c in names], "ones array<int>", "y double"])
        keys = [*names, "ones", "y"]
        counted = rows.mapInArrow(cells, schema).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return via_table(counted.sortWithinPartitions(*keys), "forest-cells")


class Forest:
    """All trees in a worker, for scoring."""

    def __init__(self, layout: Layout, trees: Sequence[dict[str, np.ndarray]]):
        self.layout, self.trees = layout, []
        for t in trees:
            tree = Tree(layout)
            for name in ("feature", "cut", "child", "value"):
                setattr(tree, name, t[name])
            tree._known = Sets(t["members"], t["sizes"], t["bits"], tree.stride)
            self.trees.append(tree)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def mean(self, cells: np.ndarray) -> np.ndarray:
        total = np.zeros(len(cells))
        for tree in self.trees:
            total += tree.value[tree.leaves(cells)]
        return total / len(self.trees)

    def predict(self, vectors: pa.StructArray) -> np.ndarray:
        """Equal cells are scored once; some are kept for later batches."""
        cells = self.layout.cells(vectors)
        keys, first, same = np.unique(self.layout.keys(cells), return_index=True, return_inverse=True)
        if keys.dtype.kind == "V":
            return self.mean(cells[first])[same]
        held, known = self.known.get(cells.shape[1], (np.zeros(0, np.int64), np.zeros(0)))
        at = np.minimum(np.searchsorted(held, keys), max(len(held) - 1, 0))
        seen = held[at] == keys if len(held) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys))
        out[seen] = known[at[seen]]
        out[~seen] = self.mean(cells[first[~seen]])
        if not seen.all() and len(held) < KEPT:
            place = np.searchsorted(held, keys[~seen])
            self.known[cells.shape[1]] = np.insert(held, place, keys[~seen]), np.insert(known, place, out[~seen])
        return out[same]


#: Forests that this worker has built, by their table.
_BUILT: dict[str, Forest] = {}


def forest_of(name: str, layout: tuple, trees: Sequence[dict[str, np.ndarray]]) -> Forest:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Forest(Layout(*layout), trees)
    return _BUILT[name]


class SparseForestModel(TableModel):
    """``table``: one row a tree, its nodes as arrays. ``numbers``: the layout of a vector."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction", TypeConverters.toString)

    def __init__(self, table: DataFrame, numbers: Sequence):
        super().__init__(table, numbers)
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._trees: list[dict[str, np.ndarray]] | None = None
        self._sent: Broadcast | None = None

    @property
    def trees(self) -> list[dict[str, np.ndarray]]:
        if self._trees is None:
            rows = self.table.orderBy("tree").toArrow()
            names = [c for c in rows.column_names if c not in ("tree", "bits")]
            self._trees = [{c: np.asarray(rows[c][i].values) for c in names} | {"bits": np.frombuffer(rows["bits"][i].as_py(), np.uint8)} for i in range(len(rows))]
        return self._trees

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def totalNumNodes(self) -> int:
        return sum(len(t["feature"]) for t in self.trees)

    @property
    def numFeatures(self) -> int:
        return self.numbers[0]

    @property
    def featureImportances(self) -> SparseVector:
        """As Spark has them: each tree's gains by feature, times the rows of the node, shares of the tree's
        total; then their shares over all trees."""
        width, dense = self.numbers[0], np.array(self.numbers[1], np.int64)
        total = np.zeros(width)
        for t in self.trees:
            inner = t["feature"] >= 0
            f, d = t["feature"][inner].astype(np.int64), len(dense)
            # Places of 1s are counted from 1.
            place = np.where(f < d, np.append(dense, 0)[np.minimum(f, d)], f - d - 1)
            own = np.bincount(place, t["worth"][inner], width)
            total += own / own.sum() if own.sum() else 0
        total = total / total.sum() if total.sum() else total
        at = np.flatnonzero(total)
        return SparseVector(width, at.tolist(), total[at].tolist())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast((self.uid, tuple(self.numbers), [{k: v for k, v in t.items() if k != "worth"} for t in self.trees]))
        sent = self._sent

        @F.arrow_udf("double")
        def score(vectors: pa.Array) -> pa.Array:
            return pa.array(forest_of(*sent.value).predict(vectors), pa.float64())

        return dataset.withColumn(self.getOrDefault("predictionCol"), score(F.unwrap_udt(F.col(self.getOrDefault("featuresCol")))))
