"""Cutting diffs and logs into runs of lines that belong together, a text at a time and without a window.

A text is passed over once for its headers, which are few; the ends of hunks come from running counts
of line kinds. What comes out are pieces of at most PIECE bytes with all that its lines share, so a
text of millions of lines leaves its task as pieces that Spark can deal to all cores.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PIECE = 1 << 20

_MARK = re.compile(rb"^(?:diff --git |@@ -|\+\+\+ |index )", re.M)
_HUNK = re.compile(rb"@@ -[0-9]+(?:,([0-9]+))? \+[0-9]+(?:,([0-9]+))? @@")
_OPEN = re.compile(rb"diff --git a/.* b/(.*)", re.S)
_BLOB = re.compile(rb"index [0-9a-f]+\.\.([0-9a-f]{40,64})(?: |\Z)")
_COMMIT = re.compile(rb"^commit ([0-9a-f]{40,64}) ?([^\n]*)$", re.M)
_KEPT = re.compile(rb"^(?!(?:\+\+\+|---)(?: |$))[+-].*$", re.M)

Cut = Callable[[bytes], Iterator[tuple]]


class _Lines:
    """Where lines start and end, and how many of each kind come before a line."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        buf = np.frombuffer(data, np.uint8)
        self.end = np.r_[np.flatnonzero(buf == 10), len(data)]
        self.start = np.r_[0, self.end[:-1] + 1]
        first = np.where(self.end > self.start, buf[np.minimum(self.start, max(len(data) - 1, 0))] if len(data) else 0, 32)  # an empty line is a context line
        self.added = first == 43
        both = first == 32
        self.new, self.old = (np.r_[0, np.cumsum(kind | both, dtype=np.int64)] for kind in (self.added, first == 45))

    def text(self, line: int) -> bytes:
        return self.data[self.start[line] : self.end[line]]

    def hunk_end(self, line: int, old: int, new: int) -> int:
        """The first line after a hunk that begins at `line` and has so many old and new lines."""
        return int(max(np.searchsorted(self.new, self.new[line] + new), np.searchsorted(self.old, self.old[line] + old)))


def cut_diff(data: bytes) -> Iterator[tuple[str | None, str | None, int, str]]:
    """(path, blob, number of the first, lines joined by line feeds) of the added lines of a unified diff."""
    lines = _Lines(data)
    path, blob, at, end, n = None, None, 0, 0, 0
    held: list[bytes] = []
    size, place = 0, (None, None)

    def piece() -> tuple:
        return (*place, n - len(held) + 1, b"\n".join(held).decode("utf-8", "replace"))

    def hunks() -> Iterator[tuple[int, int, str | None, str | None]]:
        """(first line, end, path, blob) of each hunk."""
        nonlocal path, blob, at, end
        for mark in _MARK.finditer(data):
            line = int(np.searchsorted(lines.start, mark.start()))
            text = lines.text(line)
            if text.startswith(b"diff --git "):
                yield at, min(end, line), path, blob
                found = _OPEN.match(text)
                path, blob, at, end = found[1].decode("utf-8", "replace") if found else "", None, line, line
            elif found := _HUNK.match(text):
                yield at, min(end, line), path, blob
                at = line + 1
                end = lines.hunk_end(at, *(1 if g is None else int(g) for g in found.groups()))
            elif line < end:
                continue
            elif text.startswith(b"+++ "):
                yield at, end, path, blob
                at, path = end, re.sub(rb"^b/|\t.*", b"", text[4:]).decode("utf-8", "replace")
            elif text.startswith(b"index "):
                yield at, end, path, blob
                at, blob = end, (m[1].decode() if (m := _BLOB.match(text)) else None)
        yield at, min(end, len(lines.start)), path, blob

    for first, stop, path_, blob_ in hunks():
        if stop <= first or path_ == "/dev/null":
            continue
        if held and place != (path_, blob_):
            yield piece()
            held, size = [], 0
        place = (path_, blob_)
        for line in (np.flatnonzero(lines.added[first:stop]) + first).tolist():
            held.append(data[lines.start[line] + 1 : lines.end[line]])
            n += 1
            size += len(held[-1]) + 1
            if size >= PIECE:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


def cut_log(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(sha, summary, lines with their signs joined by line feeds) of the added and removed lines of a log."""
    marks = [*_COMMIT.finditer(data)]
    for mark, after in zip(marks, [*marks[1:], None], strict=False):
        held, size = [], 0
        for line in _KEPT.finditer(data, mark.end(), after.start() if after else len(data)):
            held.append(line[0])
            size += len(line[0]) + 1
            if size >= PIECE:
                yield mark[1].decode(), mark[2].decode("utf-8", "replace"), b"\n".join(held).decode("utf-8", "replace")
                held, size = [], 0
        if held:
            yield mark[1].decode(), mark[2].decode("utf-8", "replace"), b"\n".join(held).decode("utf-8", "replace")


def cut_texts(df: DataFrame, cut: Cut, schema: str) -> DataFrame:
    """The columns of df without its text, once for each piece of the text, and what `cut` says of the piece. Null texts give none."""
    keep = [f for f in df.schema.fields if f.name != "text"]
    out = StructType([*keep, *StructType.fromDDL(schema).fields])
    place, names = df.columns.index("text"), [f.name for f in out.fields]
    others = [i for i in range(len(df.columns)) if i != place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made, size = [], [], 0
            for i, text in enumerate(batch.column(place)):
                for found in cut(text.as_buffer().to_pybytes()) if text.is_valid else ():
                    rows.append(i)
                    made.append(found)
                    size += len(found[-1])
                    if size >= 8 * PIECE:
                        yield pieces(batch, rows, made)
                        rows, made, size = [], [], 0
            if rows:
                yield pieces(batch, rows, made)

    def pieces(batch: pa.RecordBatch, rows: list[int], made: list[tuple]) -> pa.RecordBatch:
        held = [batch.column(i).take(pa.array(rows, pa.int64())) for i in others]
        return pa.RecordBatch.from_arrays([*held, *(pa.array(c) for c in zip(*made, strict=True))], names=names)

    return df.mapInArrow(run, out)
