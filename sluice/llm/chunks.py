"""Operator 9: document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where chosen bits of it are zero. Chunking is
normalised: below the usual length more bits must be zero than above it. A fingerprint lists each
chunk's digest and length, so an insertion changes only the chunks around it; likeness weighs shared
digests by their length. The query reports containment: the share of a document's bytes in chunks that
the other has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import arrow_map, materialize, slices, table, values

SHORTEST, USUAL, LONGEST = 16, 48, 192  # bytes
STRICT, LOOSE = np.uint32(0b1111111 << 25), np.uint32(0b1111 << 28)  # top bits: they depend on the most bytes
REACH = 32  # bytes that one hash value depends on
RANGE_CHARS = 12 << 20  # characters of a range of doc_ids, on average
_rng = np.random.Generator(np.random.PCG64(20240601))
GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)  # fixed by its seed: fingerprints compare across runs


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of GEAR[byte] shifted by its distance, by doubling."""
    h, width = GEAR[data], 1
    while width < REACH:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width)) if len(h) > width else h[width:]
        width *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of some bytes; none for no bytes."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (loose[(h[loose] & STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    out, at, s, l = [], 0, 0, 0
    while n - at > SHORTEST:
        low, middle, high = at + SHORTEST, at + USUAL, min(at + LONGEST, n)
        while s < len(strict) and strict[s] < low:
            s += 1
        if s < len(strict) and strict[s] <= middle:
            end = strict[s]
        else:
            while l < len(loose) and loose[l] <= middle:
                l += 1
            end = loose[l] if l < len(loose) and loose[l] < high else high
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunk_set(data: bytes) -> dict[int, int]:
    """Digest to length of the distinct chunks."""
    at, out = 0, {}
    for end in chunk_ends(data):
        out[xxhash.xxh3_64_intdigest(data[at:end])] = end - at
        at = end
    return out


def fingerprint(chunks: dict[int, int]) -> str:
    """digest:length of each distinct chunk in order of digest, comma-joined."""
    return ",".join(f"{d:016x}:{n}" for d, n in sorted(chunks.items()))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes in shared chunks over bytes in all chunks; 1 for two empty sets."""
    shared = sum(a[d] for d in a.keys() & b.keys())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 1.0


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes in chunks that b has; 1 for an empty a."""
    total = sum(a.values())
    return sum(a[d] for d in a.keys() & b.keys()) / total if total else 1.0


def _prints(part: pa.RecordBatch) -> dict:
    texts = [t or "" for t in values(part, "text")]
    sets = [chunk_set(t.encode()) for t in texts]
    signed = [[{"digest": d - (1 << 64) if d >> 63 else d, "length": n} for d, n in sorted(s.items())] for s in sets]
    return {"n_chars": [len(t) for t in texts], "fingerprint": [fingerprint(s) for s in sets], "chunks": signed}


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, chunks (array of digest and length) of every document (doc_id, text).

    A null text counts as empty; the empty text has the empty fingerprint. Repeated rows give equal
    rows, an empty table none. Other columns are not read.
    """
    return arrow_map(docs.select("doc_id", "text"), _prints, "n_chars long, fingerprint string, chunks array<struct<digest:long,length:int>>", keep=["doc_id"])


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many first code points of the following text, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = {
    "doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
    "near_edited": "double", "near_next": "double",
}
STORED = {c: t for c, t in RESULT.items() if not c.endswith("fingerprint")} | {"prints": "string"}  # both fingerprints in one column: what they share takes room once
EDGE = STORED | {"part": "int", "last": "boolean", "text": "string"}  # and the first and last row of a range, for the neighbours across it
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _row(doc_id: int | None, text: str, own: dict[int, int], following: str, chunks: dict[int, int]) -> tuple:
    data = edited(text, following).encode()
    other = chunk_set(data)
    return doc_id, len(text), hashlib.sha256(data).hexdigest(), containment(own, other), containment(own, chunks), f"{fingerprint(own)}|{fingerprint(other)}"


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, t in enumerate(columns.values())], names=list(columns))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range: each row against the one after it; the first and the last row come out as edges."""
    number, kept = TaskContext.get().partitionId(), None
    blank = (None, None, None)
    for part in slices(batches, "text"):
        out = []
        for doc_id, text in zip(values(part, "doc_id"), values(part, "text"), strict=True):
            chunks = chunk_set(text.encode())
            if kept is None:
                out.append((doc_id, *[None] * 5, number, False, text))
            else:
                out.append((*_row(*kept, text, chunks), *blank))
            kept = (doc_id, text, chunks)
        yield _batch(out, EDGE)
    if kept is not None:
        yield _batch([(kept[0], *[None] * 5, number, True, kept[1])], EDGE)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        rows = zip(values(part, "doc_id"), values(part, "text"), values(part, "following"), strict=True)
        yield _batch([_row(i, t, chunk_set(t.encode()), f, chunk_set(f.encode())) for i, t, f in rows], STORED)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint every document (doc_id, text) and its edited text, and compare it with both neighbours.

    The next document is the one with the next smaller doc_id; after the smallest comes the largest.
    Equal doc_ids follow in order of their text's hash; a null doc_id comes last; a null text counts
    as empty. Documents are dealt once, into sorted ranges; only the first and the last row of a
    range meet those of other ranges. One document is its own neighbour. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    order = [F.col("doc_id").desc_nulls_last(), F.col("place").asc()]
    dealt = rows.withColumn("place", F.xxhash64("text")).repartitionByRange(max(1, -(-size // RANGE_CHARS)), *order).sortWithinPartitions(*order)
    found = materialize(dealt.select("doc_id", "text").mapInArrow(_compare, _ddl(EDGE)), "zstd")  # digests in hexadecimal take half the room so
    edges = found.where("part is not null")
    heads = edges.where("not last").select(F.col("part").alias("to"), F.col("text").alias("following"))
    # one number a range: which range comes next, the first after the last
    ring = Window.orderBy("part")
    numbers = edges.where("last").select("part").withColumn("to", F.coalesce(F.lead("part").over(ring), F.min("part").over(Window.partitionBy(F.lit(1)))))
    pairs = edges.where("last").select("part", "doc_id", "text").join(numbers, "part").join(heads, "to").select("doc_id", "text", "following")
    done = found.where("part is null").select(*STORED).unionByName(pairs.mapInArrow(_across, _ddl(STORED)))
    split = {"fingerprint": F.substring_index("prints", "|", 1), "edited_fingerprint": F.substring_index("prints", "|", -1)}
    return done.withColumns(split).select(*RESULT)


def op9_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts and their next documents. Null texts count as empty; rows of one doc_id stand in order of their text's hash; a single document is its own next."""
    return compare_neighbours(table(spark, sf_dir, "documents"))
