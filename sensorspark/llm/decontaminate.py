"""Benchmark decontamination by edit distance over item-sized windows of words.

The CGK embedding walks over a word string with random steps, so strings of small edit distance get
embeddings of small Hamming distance. Bit sampling of the embedding is the LSH: windows and items
whose sampled places agree in some repetition are candidates, and every candidate is verified by the
exact edit distance. The repetitions follow from the target recall.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import mix, small_batches, text_slices, via_table, word_hashes

PUNCTUATION = string.punctuation.encode()
#: Sampled places of a repetition.
PLACES = 2
#: Words of items that one pass over the documents carries to the tasks: 16 bytes and little more each.
WORDS_A_PASS = 1 << 20
#: Windows that are embedded together, and bytes of documents that wait for them.
POOL, HELD_BYTES = 1 << 15, 32 << 20
#: Meetings of grams that are turned into windows together, and windows that look for items together.
MEETINGS, SEEKERS = 1 << 15, 1 << 10
_TABLE_BITS = 22


def allowed(words: int, share: float) -> int:
    """Edits within the threshold for an item of so many words."""
    return int(math.floor(share * words + 1e-9))


def _steps(seed: int, n: int) -> np.ndarray:
    """An odd multiplier for each step of a walk: the top bit of word x multiplier is the step."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def embedded_places(words: np.ndarray, repetition: int) -> np.ndarray:
    """The sampled places of the CGK embedding of rows of words (rows x W, 0 is padding) as one
    64-bit key a row. The walk is 3 W long; places and steps depend on W and the repetition only."""
    n, w = words.shape
    seed = 1000 * repetition + w
    places = sorted(np.random.default_rng(seed).integers(0, 3 * w, PLACES).tolist())
    steps = _steps(seed + 1, places[-1] + 1)
    flat = np.concatenate([words, np.zeros((n, 1), dtype=np.uint64)], axis=1).ravel()
    at = np.arange(n) * (w + 1)
    key = np.full(n, w, dtype=np.uint64)
    for j, step in enumerate(steps):
        now = flat[at]
        for _ in range(places.count(j)):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + now, 4)
        at += ((now * step) >> np.uint64(63)).astype(np.int64)
    return key


def edit_distances(a: np.ndarray, lengths: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distance of each row of ``a`` (its first ``lengths`` words) to the same row of ``b``."""
    n, w = b.shape
    place = np.arange(w + 1)
    row = np.broadcast_to(place, (n, w + 1)).copy()
    out = np.where(lengths == 0, w, 0)
    for i in range(a.shape[1]):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (b != a[:, i : i + 1]))
        row = np.minimum.accumulate(new - place, axis=1) + place
        done = lengths == i + 1
        out[done] = row[done, w]
    return out


def repetitions(words: int, share: float, recall: float, trials: int = 300, most: int = 64) -> int:
    """Repetitions after which windows at the threshold have collided in ``recall`` of the trials:
    random strings with the allowed number of random edits."""
    rng = np.random.default_rng(words)
    k = allowed(words, share)
    item = rng.integers(1, 1 << 63, (trials, words), dtype=np.uint64)
    other = np.zeros_like(item)
    for t in range(trials):
        text = item[t].tolist()
        for _ in range(k):
            at, kind = int(rng.integers(0, len(text))), int(rng.integers(0, 3))
            if kind == 0:
                text[at] = int(rng.integers(1, 1 << 62))
            elif kind == 1:
                text.insert(at, int(rng.integers(1, 1 << 62)))
            elif len(text) > 1:
                del text[at]
        other[t, : min(words, len(text))] = text[:words]
    met = np.zeros(trials, dtype=bool)
    for r in range(most):
        met |= embedded_places(item, r) == embedded_places(other, r)
        if met.mean() >= recall:
            return r + 1
    return most


@dataclass
class Items:
    """A pass's items, ready for look-ups. ``ids`` are numbers of ``names``; a null name has a number for
    each of its texts. ``grams``: for each gram length its hashes in order, and
    the items and places that have them."""

    share: float
    names: list[int | None]
    ids: np.ndarray
    lengths: np.ndarray
    words: list[np.ndarray]
    vocabulary: np.ndarray
    repeats: dict[int, int]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def _gram_hashes(words: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(words) - q + 1)
    out = np.full(n, q, dtype=np.uint64)
    for j in range(q):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n], 6)
    return out


def _table(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return table


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]


def prepare(items: list[tuple[int | None, str]], share: float, recall: float) -> Items:
    """Words and grams of the items. By the pigeonhole principle a window within k edits of W words
    keeps floor((W - k) / (k + 1)) words in a row of the item, and it begins at most k words from
    where these say. Only such windows are embedded; no window within the threshold is lost."""
    words, at = word_hashes(pa.array([t for _, t in items], pa.string()), strip=PUNCTUATION)
    own = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    kept = [i for i, w in enumerate(own) if len(w)]
    own = [own[i] for i in kept]
    lengths = np.array([len(w) for w in own], dtype=np.int64)
    names = sorted({items[i][0] for i in kept} - {None})
    number = {name: n for n, name in enumerate(names)}
    ids = []
    for i in kept:
        ids.append(number.get(items[i][0], len(names)))
        if items[i][0] is None:
            names.append(None)
    out = Items(share, names, np.array(ids, dtype=np.int64), lengths, own, np.unique(words), {int(w): repetitions(int(w), share, recall) for w in np.unique(lengths)})
    found: dict[int, list] = {}
    for i, w in enumerate(own):
        k = allowed(len(w), share)
        q = max(1, min(4, (len(w) - k) // (k + 1)))
        g = _gram_hashes(w, q)
        found.setdefault(q, []).append((g, np.full(len(g), i), np.arange(len(g))))
    for q, parts in found.items():
        g, item, place = (np.concatenate([p[c] for p in parts]) for c in range(3))
        order = np.argsort(g, kind="stable")
        every, first = np.unique(g[order], return_index=True)
        out.grams[q] = (every, np.append(first, len(g)), item[order], place[order])
    return out


class _Windows:
    """Windows of one pass, pooled by item length until there are enough to embed together."""

    def __init__(self, items: Items):
        self.items, self.held, self.size, self.found = items, {}, 0, []
        self.vocabulary = _table(items.vocabulary)
        self.tables = {q: _table(g[0]) for q, g in items.grams.items()}

    def add(self, words: np.ndarray, at: np.ndarray, docs: np.ndarray) -> None:
        """The windows of texts (their words, where each begins, and their numbers) that may be
        within the threshold of an item."""
        items = self.items
        known = np.concatenate([[0], np.cumsum(_marked(self.vocabulary, words))])
        for q, (every, first, item, place) in items.grams.items():
            grams = _gram_hashes(words, q)
            p = np.flatnonzero(_marked(self.tables[q], grams))
            g = np.searchsorted(every, grams[p])
            hit = every[np.minimum(g, len(every) - 1)] == grams[p]
            p, g = p[hit], g[hit]
            stops = np.cumsum(first[g + 1] - first[g])
            for a in range(0, int(stops[-1]) if len(stops) else 0, MEETINGS):
                met = np.arange(a, min(a + MEETINGS, int(stops[-1])))
                source = np.searchsorted(stops, met, side="right")
                k = first[g[source] + 1] - (stops[source] - met)
                begin, end = p[source] - place[k], item[k]
                for w in np.unique(items.lengths[end]):
                    mine = items.lengths[end] == w
                    off = np.arange(-allowed(w, items.share), allowed(w, items.share) + 1)
                    doc = np.searchsorted(at, p[source][mine], side="right") - 1
                    s = (begin[mine][:, None] + off).ravel()
                    d = np.repeat(doc, len(off))
                    # A window that a text's edge cuts is shorter.
                    stop = np.minimum(s + w, at[d + 1])
                    s = np.maximum(s, at[d])
                    keep = stop - s >= w - allowed(w, items.share)
                    s, stop, d = s[keep], stop[keep], d[keep]
                    keep = known[stop] - known[s] >= w - allowed(w, items.share)
                    s, stop, d = np.unique(np.stack([s[keep], stop[keep], d[keep]]), axis=1)
                    for i in range(0, len(s), POOL):
                        self._hold(int(w), words, at, docs, s[i : i + POOL], stop[i : i + POOL], d[i : i + POOL])

    def _hold(self, w: int, words: np.ndarray, at: np.ndarray, docs: np.ndarray, s: np.ndarray, stop: np.ndarray, d: np.ndarray) -> None:
        place = s[:, None] + np.arange(w)
        rows = np.where(place < stop[:, None], words[np.minimum(place, len(words) - 1)], np.uint64(0))
        self.held.setdefault(w, []).append((rows, stop - s, docs[d], s - at[d]))
        self.size += len(s)
        if self.size >= POOL:
            self._flush()

    def _flush(self) -> None:
        for w, parts in self.held.items():
            rows, lengths, docs, start = (np.concatenate([p[c] for p in parts]) for c in range(4))
            mine = np.flatnonzero(self.items.lengths == w)
            texts = np.stack([self.items.words[i] for i in mine])
            keys, sought = [], []
            for r in range(self.items.repeats[w]):
                own = embedded_places(texts, r)
                order = np.argsort(own, kind="stable")
                sought.append((own[order], order))
                keys.append(embedded_places(rows, r))
            for i in range(0, len(rows), SEEKERS):
                pairs = [np.zeros(0, np.int64)]
                for key, (own, order) in zip(keys, sought, strict=True):
                    part = key[i : i + SEEKERS]
                    low, high = np.searchsorted(own, part), np.searchsorted(own, part, side="right")
                    n = high - low
                    x = np.repeat(np.arange(len(part)), n)
                    y = order[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + low[x]]
                    pairs.append(x * len(mine) + y)
                    if sum(map(len, pairs)) > POOL:
                        pairs = [np.unique(np.concatenate(pairs))]
                a, b = np.divmod(np.unique(np.concatenate(pairs)), len(mine))
                for j in range(0, len(a), POOL):
                    x, y = a[j : j + POOL] + i, b[j : j + POOL]
                    distance = edit_distances(rows[x], lengths[x], texts[y])
                    near = distance <= allowed(w, self.items.share)
                    x, y = x[near], y[near]
                    self.found.append((docs[x], self.items.ids[mine[y]], start[x], lengths[x], distance[near]))
        self.held, self.size = {}, 0

    def close(self) -> list[tuple[np.ndarray, ...]]:
        """Document numbers, items' numbers, first words, lengths and distances of what is within the
        threshold, and an empty pool."""
        self._flush()
        out, self.found = self.found, []
        return out


WINDOWS = "array<struct<item_id: bigint, first_word: bigint, n_words: bigint, distance: bigint>>"
_WINDOW = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first_word", "n_words", "distance")]))


def with_windows(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.97, out: str = "windows") -> DataFrame:
    """Adds ``windows``, by item: for each item the document's window of smallest distance (then the
    first), where it is within ``share`` of the item's words. A column of that name is replaced.

    Words are lower-cased and separated by ASCII white space and punctuation; a window has as many
    words as the item, fewer only at a text's edges. Null and empty texts and items match nothing;
    items of one id are one item with several texts; each text without an id is an item of its own, null
    in the list. Every row is searched by itself, so ids may
    repeat or be null. Empty tables give empty results.

    Rows pass through the tasks that search them; nothing is joined or shuffled. The items go to the
    tasks ``WORDS_A_PASS`` words at a time, each time through a written table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    n_chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-n_chars // (2 * WORDS_A_PASS)))
    rows = docs.drop(out).withColumn(out, F.array().cast(WINDOWS))
    text, last = rows.columns.index("text"), len(rows.columns) - 1
    for k in range(passes):
        items = prepare([tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(passes)) == k).collect()], share, recall)

        def search(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            pool, held, n, size = _Windows(items), [], 0, 0

            def close() -> Iterator[pa.RecordBatch]:
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for found in pool.close():
                    for doc, item, first, length, distance in zip(*(x.tolist() for x in found), strict=True):
                        got = (distance, first, length)
                        best[doc, item] = min(got, best.get((doc, item), got))
                by: dict[int, list[dict]] = {}
                for (doc, item), (distance, first, length) in sorted(best.items()):
                    by.setdefault(doc, []).append({"item_id": items.names[item], "first_word": first, "n_words": length, "distance": distance})
                at = 0
                for batch in held:
                    before = batch.column(last).to_pylist()
                    windows = pa.array([b + by.get(at + i, []) for i, b in enumerate(before)], _WINDOW)
                    at += batch.num_rows
                    yield pa.RecordBatch.from_arrays([*batch.columns[:last], windows], batch.schema.names)

            for batch in batches:
                for a, b in text_slices(batch.column(text)):
                    words, at = word_hashes(batch.column(text).slice(a, b - a), strip=PUNCTUATION)
                    if len(items.ids) and len(words):
                        pool.add(words, at, np.arange(n + a, n + b))
                held.append(batch)
                n, size = n + batch.num_rows, size + batch.nbytes
                if pool.size + sum(len(f[0]) for f in pool.found) >= POOL or size >= HELD_BYTES:
                    yield from close()
                    held, n, size = [], 0, 0
            yield from close()

        rows = rows.mapInArrow(search, rows.schema)
        if k + 1 < passes:
            rows = via_table(rows, "decontaminate-pass")
    return rows


def flagged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, contaminated, items, distance``: one row for every row of ``docs``; the matched
    items' ids in order (as many as the benchmark has, at most) and the smallest distance."""
    found = with_windows(docs.select("doc_id", "text"), benchmark, **options)
    items = F.array_sort(F.transform("windows", lambda w: w["item_id"]))
    return found.select("doc_id", (F.size("windows") > 0).alias("contaminated"), items.alias("items"), F.array_min(F.transform("windows", lambda w: w["distance"])).alias("distance"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a contaminated window, all their columns."""
    found = with_windows(docs, benchmark, out="__windows", **options)
    return found.where(F.size("__windows") == 0).drop("__windows")
