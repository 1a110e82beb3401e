"""WARC archives with a two-level capture index.

Archives are gzip members, one a record. The capture index is sorted by reversed-host URL keys and
kept in compressed blocks; each index file has a sparse directory of its blocks, and a short list
has the first key of each index file. A look-up is three binary searches and two range reads.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.llm.common import forget, shared_uri, small_batches, via_table

#: Payloads of at least so many bytes are written once.
LEAST_BYTES = 100
BLOCK_LINES = 512
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: ``http://www.a.example/x?y`` -> ``example,a)/x?y``."""
    text = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", (url or "").strip()).lower()
    rest = text.partition("://")[2] or text
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:cut].rpartition("@")[2], rest[cut:].partition("#")[0] or "/"
    name, _, port = host.partition(":")
    name = re.sub(r"^www\d*\.", "", name)
    return ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + path


@F.pandas_udf(T.StringType())
def capture_key(url: pd.Series, page_id: pd.Series) -> pd.Series:
    """The URL key and the page's id: captures of one URL sort together."""
    ids = page_id.astype("Int64")
    return pd.Series([f"{url_key(u)} {'' if pd.isna(i) else i}" for u, i in zip(url, ids, strict=True)])


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload a page of smaller id has.

    The smallest ids of repeated payloads come from a combining aggregate. Only narrow rows meet
    them, in a join of a scan and a table that adaptive execution may split."""
    html = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= LEAST_BYTES).drop("n")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = via_table(first, "warc-payloads")
    return narrow.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit carries the HTTP head only; its digest and length are those of the
    full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or ""),
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.insert(2, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(2, f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the records, a file for each task; ``key, page_id, file, at, length`` of every one. A
    repeated task writes a file of another name; only the captures of the task that counted remain."""
    # A broken or split page id never meets another payload: both are in the key.
    back = revisits(pages).withColumnsRenamed({"page_id": "__id", "digest": "__digest"}).withColumn("revisit", F.lit(True))
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    rows = rows.join(back, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to", "revisit", capture_key("url", "page_id").alias("key"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            begins, lengths = [], []
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                data = _gzip(_record(page_id, url, html.encode(), refers_to, bool(revisit), date))
                out.write(data)
                begins.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(5), batch.column(0), pa.array([name] * len(begins)), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64())],
                ["key", "page_id", "file", "at", "length"],
            )
        if out is not None:
            out.close()

    return via_table(rows.mapInArrow(write, "key string, page_id long, file string, at long, length long"), "warc-captures")


@dataclass(frozen=True)
class CaptureIndex:
    """Where the archives and index files are, and the first key of every index file in order: as
    many entries as the index has files."""

    folder: str
    first_keys: tuple[str, ...]
    files: tuple[str, ...]


def write_index(captures: DataFrame, folder: str) -> CaptureIndex:
    """Sorts captures by key into index files of compressed blocks; each file ends with its block
    directory. Rows stream through the task that writes a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz"
        directory: list[tuple[str, int, int]] = []
        lines: list[str] = []
        out, at = None, 0

        def flush() -> int:
            data = _gzip("\n".join(lines).encode(), 6)
            directory.append((lines[0].partition("\t")[0], at, len(data)))
            out.write(data)
            lines.clear()
            return at + len(data)

        for batch in batches:
            if batch.num_rows and out is None:
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                lines.append("\t".join(map(str, row)))
                if len(lines) == BLOCK_LINES:
                    at = flush()
        if out is None:
            return
        if lines:
            at = flush()
        out.write(_gzip(json.dumps(directory).encode(), 6))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name]), pa.array([at])], ["first", "file", "at"])

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "file", "at"]
    rows = captures.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "file", "at", "length")
    made = via_table(rows.mapInArrow(write, "first string, file string, at long"), "warc-index")
    files = sorted(tuple(r) for r in made.collect())
    forget(made)
    return CaptureIndex(folder, tuple(f[0] for f in files), tuple(f"{f[1]}:{f[2]}" for f in files))


class _Reader:
    """Look-ups in key order: the current directory and block stay at hand, archives stay open."""

    def __init__(self, index: CaptureIndex):
        self.index = index
        self.fs, self.path = pafs.FileSystem.from_uri(index.folder)
        self.opened: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.held: tuple[str, list] = ("", [])
        self.block: tuple[tuple[str, int], list[str], list[str]] = (("", -1), [], [])

    def _file(self, name: str) -> pa.NativeFile:
        if name not in self.opened:
            self.opened[name] = self.fs.open_input_file(f"{self.path}/{name}")
            if len(self.opened) > 64:
                self.opened.popitem(last=False)[1].close()
        self.opened.move_to_end(name)
        return self.opened[name]

    def _directory(self, file: str) -> list:
        if self.held[0] != file:
            name, at = file.split(":")
            f = self._file(name)
            self.held = (file, json.loads(zlib.decompress(f.read_at(f.size() - int(at), int(at)), 31)))
        return self.held[1]

    def _lines(self, file: str, at: int, length: int) -> tuple[list[str], list[str]]:
        if self.block[0] != (file, at):
            lines = zlib.decompress(self._file(file.split(":")[0]).read_at(length, at), 31).decode().split("\n")
            self.block = ((file, at), [x.partition("\t")[0] for x in lines], lines)
        return self.block[1], self.block[2]

    def captures(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Every capture of the key; equal keys may go on in the next block or file."""
        k = max(0, bisect.bisect_left(self.index.first_keys, key) - 1)
        while k < len(self.index.files) and (not k or self.index.first_keys[k] <= key):
            blocks = self._directory(self.index.files[k])
            b = max(0, bisect.bisect_left(blocks, key, key=lambda x: x[0]) - 1)
            while b < len(blocks) and blocks[b][0] <= key:
                keys, lines = self._lines(self.index.files[k], blocks[b][1], blocks[b][2])
                i = bisect.bisect_left(keys, key)
                while i < len(keys) and keys[i] == key:
                    _, file, at, length = lines[i].split("\t")
                    yield file, int(at), int(length)
                    i += 1
                b += 1
            k += 1

    def record(self, file: str, at: int, length: int) -> dict:
        data = zlib.decompress(self._file(file).read_at(length, at), 31)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        number = lambda text: int(text[len("<urn:page:") : -1]) if len(text) > len("<urn:page:>") else None
        revisit = fields["WARC-Type"] == "revisit"
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"damaged record at {file}:{at}")
        return {
            "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size,
            "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "html": None if revisit else payload.decode(),
        }


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(requests: DataFrame, index: CaptureIndex, with_html: bool = False) -> DataFrame:
    """The archived records of ``key`` requests, each key once; keys that no capture has give none."""
    schema = RECORD + (", html string" if with_html else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = _Reader(index), None
        for batch in batches:
            found, held = [], 0
            for key in batch.column(0).to_pylist():
                if key == last:
                    continue
                last = key
                for capture in reader.captures(key):
                    found.append(reader.record(*capture))
                    held += found[-1]["payload_bytes"] if with_html else 0
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)], names)
                        found, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)], names)

    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.select("key").repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, with_html: bool = False) -> DataFrame:
    """Writes every page as a WARC record with its index below the shared folder, then looks every
    page up in the index and reads its record back.

    The payload is the HTML in UTF-8 (null: empty). Of records with equal payloads of
    ``LEAST_BYTES`` or more, those of the smallest page id are responses, others revisit it; null
    is the largest id. Repeated rows are records of their own. A null URL is an empty one; control
    characters in URLs are percent-encoded. Empty input gives an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    folder = shared_uri(spark, "warc")
    captures = write_archives(pages, folder)
    index = write_index(captures, folder)
    forget(captures)
    return read_records(pages.select(capture_key("url", "page_id").alias("key")), index, with_html)
