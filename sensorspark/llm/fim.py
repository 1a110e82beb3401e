"""Fill-in-middle by secondary sort.

Every document is cut into chunks of code points that go out as pieces keyed by document and by their
place in the output. One exchange deals the pieces by document and sorts them inside its partitions by
document and place (what ``repartitionAndSortWithinPartitions`` does for pair RDDs, here on rows that
stay in the JVM's sorter and may spill). A task then streams its pieces once: it feeds a running digest
and reads the output back, marker by marker, into chunks of the three sections. Those are sorted again,
in place and without another exchange, by document, section and chunk, and stream into the digest of
the restored text. No task holds more than the piece at hand; a text is whole only in its own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import small_batches

#: The markers, and the parts of a hundred that are transformed and of those suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Code points of a piece, and about as many characters in an Arrow batch that a task emits.
CHUNK, BATCH = 1 << 14, 1 << 21

#: Section markers in output order, and the sections' places in the original text.
LAYOUT = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

_PIECE = pa.schema([
    ("key", pa.int64()), ("pos", pa.int64()), ("piece", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
])
_PIECES = "key long, pos long, piece string, doc_id long, n long, form string, prefix_chars long, middle_chars long"
_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def plan(doc_id: int | None, text: str, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, int]:
    """Form of a document and where its prefix and its middle end, from the sha256 of ``1:`` and the
    id (nothing for a null id)."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= transformed:
        return "plain", a, b
    return ("spm" if h4 % 100 < suffix_first else "psm"), a, b


def cut(text: str, form: str, a: int, b: int, chunk: int = CHUNK) -> Iterator[str]:
    """The output in its order, in pieces of ``chunk`` code points of a section and its marker."""
    spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
    for marker, (begin, end) in [("", (0, len(text)))] if form == "plain" else [(m, spans[m]) for m in LAYOUT[form]]:
        yield marker + text[begin : min(begin + chunk, end)]
        for at in range(begin + chunk, end, chunk):
            yield text[at : min(at + chunk, end)]


class Reader:
    """Reads an output back from its pieces, however they were cut, knowing its form only: gives
    (place of the section in the text, piece of the section). A text with a marker of its own is never
    transformed, so the first marker of each kind is the one that was set."""

    def __init__(self, form: str):
        self.markers = list(LAYOUT.get(form, ()))
        self.place, self.held = (0 if form == "plain" else -1), ""

    def read(self, piece: str, last: bool = False) -> Iterator[tuple[int, str]]:
        self.held += piece
        while self.markers and (at := self.held.find(self.markers[0])) >= 0:
            if at:
                yield self.place, self.held[:at]
            marker = self.markers.pop(0)
            self.place, self.held = PLACE[marker], self.held[at + len(marker) :]
        # The start of a marker may stand at the end of a piece.
        keep = 0 if last or not self.markers else len(self.markers[0]) - 1
        ready = self.held[: len(self.held) - keep] if keep else self.held
        if ready:
            yield self.place, ready
            self.held = self.held[len(ready) :]


def pieces(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK) -> DataFrame:
    """``key, pos, piece`` and, on a document's first piece, ``doc_id, n, form, prefix_chars,
    middle_chars``: dealt by document, sorted by document and place in the output.

    Every row is a document of its own: the key is its place in the scan, so repeated rows and
    repeated or null ids stay apart and no key is hot. Null texts are empty; an empty text is one
    empty piece. Other columns of ``docs`` take no part. An empty table gives no pieces."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(c) for c in ("key", "doc_id", "text")), strict=True):
                body = text.as_py() or ""
                form, a, b = plan(doc_id.as_py(), body, transformed, suffix_first)
                whole = (None, None) if form == "plain" else (a, b - a)
                for pos, piece in enumerate(cut(body, form, a, b, chunk)):
                    out.append((key.as_py(), pos, piece, *((doc_id.as_py(), len(body), form, *whole) if pos == 0 else (None,) * 5)))
                    size += len(piece)
                    if size >= BATCH or len(out) >= 4096:
                        yield _batch(out, _PIECE)
                        out, size = [], 0
        if out:
            yield _batch(out, _PIECE)

    return rows.mapInArrow(emit, _PIECES).repartition("key").sortWithinPartitions("key", "pos")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def fill_in_middle(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one row a document with its whole
    transformed text. Rows and edge cases as in ``pieces``."""
    schema = pa.schema([*list(_PIECE)[3:], ("output", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now, parts, head = [], 0, None, [], ()
        for key, pos, piece, *meta in _rows(batches, *_PIECE.names):
            if pos == 0:
                if now is not None:
                    out.append((*head, "".join(parts)))
                    if size >= BATCH:
                        yield _batch(out, schema)
                        out, size = [], 0
                now, parts, head = key, [], meta
            parts.append(piece)
            size += len(piece)
        if now is not None:
            out.append((*head, "".join(parts)))
        if out:
            yield _batch(out, schema)

    return pieces(docs, transformed, suffix_first, chunk).mapInArrow(join, f"{_RESULT}, output string")


def digests(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``: one row a
    document; the second digest is of the text rebuilt from the output's pieces and the form. Rows and
    edge cases as in ``pieces``."""
    read = pa.schema([
        ("key", pa.int64()), ("place", pa.int32()), ("pos", pa.int64()), ("piece", pa.string()), *list(_PIECE)[3:], ("output_sha256", pa.string()),
    ])
    read_schema = f"key long, place int, pos long, piece string, {_RESULT}, output_sha256 string"
    final = pa.schema([*list(_PIECE)[3:], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now, head, digest, reader, count = [], 0, None, (), None, None, 0

        def close() -> None:
            nonlocal count
            for place, part in reader.read("", last=True):
                out.append((now, place, count, part, *(None,) * 6))
                count += 1
            # The document's row sorts before its chunks.
            out.append((now, -1, 0, None, *head, digest.hexdigest()))

        for key, pos, piece, *meta in _rows(batches, *_PIECE.names):
            if pos == 0:
                if now is not None:
                    close()
                now, head, digest, reader, count = key, meta, hashlib.sha256(), Reader(meta[2]), 0
            digest.update(piece.encode())
            for place, part in reader.read(piece):
                out.append((now, place, count, part, *(None,) * 6))
                count += 1
            size += len(piece)
            if size >= BATCH or len(out) >= 4096:
                yield _batch(out, read)
                out, size = [], 0
        if now is not None:
            close()
        if out:
            yield _batch(out, read)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, digest = [], None, None
        for _, place, _, piece, *meta in _rows(batches, *read.names):
            if place < 0:
                if head is not None:
                    out.append((*head, digest.hexdigest()))
                head, digest = meta, hashlib.sha256()
                if len(out) >= 4096:
                    yield _batch(out, final)
                    out = []
            else:
                digest.update(piece.encode())
        if head is not None:
            out.append((*head, digest.hexdigest()))
        if out:
            yield _batch(out, final)

    assembled = pieces(docs, transformed, suffix_first, chunk).mapInArrow(assemble, read_schema)
    return assembled.sortWithinPartitions("key", "place", "pos").mapInArrow(restore, f"{_RESULT}, output_sha256 string, restored_sha256 string")
