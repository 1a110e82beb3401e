"""Line dedup with a sharded minimal perfect hash.

Lines are counted once by hash. The repeated ones are dealt to shards by their hash, and each shard
becomes a minimal perfect hash with a fingerprint, a count and the last document of every line in
flat arrays. Documents then look their lines up in the arrays; lines are not joined to documents.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import SPACE, forget, mix, shared_uri, small_batches, via_table

_STRIP = SPACE.encode()
#: Keys of a shard, about: an array of 24 bytes a key.
SHARD_KEYS = 1 << 17
#: Bytes of shards that a worker keeps.
KEPT_BYTES = 128 << 20
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(_STRIP).lower()


def _long(key: bytes, least: int) -> bool:
    """At least so many code points."""
    return len(key) >= 4 * least or (len(key) >= least and (key.isascii() or len(key.decode()) >= least))


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n-1 without gaps.

    Level by level every key picks a bit of an array twice the keys' number; keys alone on their bit
    are settled, the others go to the next level. A key's number is the count of set bits before its
    own, over all levels."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.ranks = levels, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, ranks, held = [], [], 0
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two lines of one shard have the same 64-bit key")
        while len(keys):
            slots = max(64, 2 * len(keys) + 63 & ~63)
            at = mix(keys, len(levels) + 11) % np.uint64(slots)
            alone = np.bincount(at.astype(np.int64), minlength=slots) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            # Set bits before each word of 64.
            per_word = alone.reshape(-1, 64).sum(axis=1)
            ranks.append((np.cumsum(per_word) - per_word + held).astype(np.int64))
            held += int(per_word.sum())
            keys = keys[~alone[at]]
        return cls(levels, ranks)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no level has a bit for it. Keys that were not built in
        may get any number; the fingerprint tells."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            slots = np.uint64(len(bits) * 8)
            at = (mix(keys[left], k + 11) % slots).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            word, bit = at[hit] >> 6, (at[hit] & 63).astype(np.uint64)
            words = bits.view(np.uint64)[word]
            before = np.bitwise_count(words & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = rank[word] + before
            left = left[~hit]
        return out


def _pack(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> bytes:
    table = PerfectHash.build(keys)
    at = table.find(keys)
    arrays = {"prints": np.empty_like(prints), "counts": np.empty(len(keys), np.uint32), "last": np.empty_like(last)}
    arrays["prints"][at], arrays["last"][at] = prints, last
    arrays["counts"][at] = np.minimum(counts, np.iinfo(np.uint32).max)
    for k, (bits, rank) in enumerate(zip(table.levels, table.ranks, strict=True)):
        arrays |= {f"bits{k}": bits, f"rank{k}": rank}
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    with np.load(io.BytesIO(data)) as held:
        arrays = {k: held[k] for k in held.files}
    n = sum(k.startswith("bits") for k in arrays)
    return PerfectHash([arrays[f"bits{k}"] for k in range(n)], [arrays[f"rank{k}"] for k in range(n)]), arrays


class _Shards:
    """Shards by number, read from the shared folder when first asked for, the latest kept."""

    def __init__(self, folder: str):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.kept: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = 0

    def get(self, number: int) -> tuple[PerfectHash, dict[str, np.ndarray]] | None:
        if number not in self.kept:
            name = f"{self.path}/{number}.npz"
            data = None
            if self.fs.get_file_info(name).type == pafs.FileType.File:
                with self.fs.open_input_stream(name) as f:
                    data = f.read()
            self.kept[number] = (data and _unpack(data), len(data or b""))
            self.bytes += len(data or b"")
            while self.bytes > KEPT_BYTES and len(self.kept) > 1:
                self.bytes -= self.kept.popitem(last=False)[1][1]
        self.kept.move_to_end(number)
        return self.kept[number][0] or None


_open: dict[str, _Shards] = {}


def _shards(folder: str) -> _Shards:
    """One cache for each worker, kept between tasks."""
    if folder not in _open:
        _open.clear()
        _open[folder] = _Shards(folder)
    return _open[folder]


def line_counts(docs: DataFrame, least_chars: int) -> DataFrame:
    """``h1, h2, n_docs, last_id``: a 128-bit hash of each long key, the number of documents that
    hold it, and the largest id among them."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                raw = text.as_buffer() if text.is_valid else b""
                found = {_hash(k) for k in map(line_key, bytes(raw).split(b"\n")) if _long(k, least_chars)}
                digests += found
                ids += [NO_ID if doc_id is None else doc_id] * len(found)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    rows = docs.select("doc_id", "text").mapInArrow(hashed, "h1 long, h2 long, doc_id long")
    return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_id"))


def build_shards(counts: DataFrame, folder: str, shards: int) -> DataFrame:
    """Writes a file for each shard that has keys; ``shard, keys``. A repeated task writes the same
    file again under another name and renames it, so readers see whole files only."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fs, path = pafs.FileSystem.from_uri(folder)
        data = _pack(
            rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy(), rows["n_docs"].to_numpy(), rows["last_id"].to_numpy()
        )
        fs.create_dir(path, recursive=True)
        part = f"{path}/.{key[0]}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(data)
        if fs.get_file_info(f"{path}/{key[0]}.npz").type == pafs.FileType.File:
            fs.delete_file(part)  # another attempt was first, with the same keys
        else:
            fs.move(part, f"{path}/{key[0]}.npz")
        return pd.DataFrame({"shard": [key[0]], "keys": [len(rows)]})

    number = F.pmod(F.shiftrightunsigned("h2", 20), F.lit(shards)).cast("int")
    return counts.withColumn("shard", number).groupBy("shard").applyInPandas(build, "shard int, keys long")


def dedup_lines(docs: DataFrame, min_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """``doc_id, kept, n_lines, n_dropped``: every text without its repeated lines.

    A text is split at line feeds (null and empty: one empty line). A line's key is ``line_key``.
    Keys of at least ``least_chars`` code points that are found in ``min_docs`` documents or more
    lose all their lines except in the largest id that holds them; other lines stay, joined by line
    feeds (none left: empty). Rows count as documents of their own, so with repeated ids every row
    of the largest id keeps its lines; null is the smallest id. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = line_counts(docs, least_chars).where(F.col("n_docs") >= min_docs)
    counts = via_table(counts, "lines-counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    folder = shared_uri(spark, "lines-shards")
    build_shards(counts, folder, shards).agg(F.sum("keys")).collect()
    forget(counts)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _shards(folder)
        for batch in batches:
            ids = [NO_ID if x is None else x for x in batch.column(0).to_pylist()]
            texts = [bytes(t.as_buffer()) if t.is_valid else b"" for t in batch.column(1).cast(pa.large_binary())]
            lines = [t.split(b"\n") for t in texts]
            where, digests = [], []
            for i, own in enumerate(lines):
                for j, line in enumerate(own):
                    key = line_key(line)
                    if _long(key, least_chars):
                        where.append((i, j))
                        digests.append(_hash(key))
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            owner = np.array([ids[i] for i, _ in where], dtype=np.int64)
            drop = np.zeros(len(where), dtype=bool)
            number = (h[:, 1].view(np.uint64) if len(h) else np.zeros(0, np.uint64)) >> np.uint64(20)
            number = number % np.uint64(shards)
            # Shard by shard, so that each is read once for a batch.
            for k in np.unique(number):
                mine = np.flatnonzero(number == k)
                found = held.get(int(k))
                if found is None:
                    continue
                table, arrays = found
                at = table.find(np.ascontiguousarray(h[mine, 0]).view(np.uint64))
                hit = at >= 0
                hit[hit] = arrays["prints"][at[hit]] == h[mine[hit], 1]
                drop[mine[hit]] = (arrays["counts"][at[hit]] >= min_docs) & (arrays["last"][at[hit]] != owner[mine[hit]])
            gone: dict[int, set[int]] = {}
            for x in np.flatnonzero(drop):
                gone.setdefault(where[x][0], set()).add(where[x][1])
            kept = [
                texts[i] if i not in gone else b"\n".join(line for j, line in enumerate(own) if j not in gone[i])
                for i, own in enumerate(lines)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([k.decode() for k in kept], pa.string()),
                    pa.array([len(own) for own in lines], pa.int64()),
                    pa.array([len(gone.get(i, ())) for i in range(len(lines))], pa.int64()),
                ],
                ["doc_id", "kept", "n_lines", "n_dropped"],
            )

    return docs.select("doc_id", "text").mapInArrow(cleaned, "doc_id long, kept string, n_lines long, n_dropped long")
