"""Operator 13: SimHash near-duplicates through pigeonring filtering.

A fingerprint is parted into DISTANCE + 1 segments laid in a ring. If two fingerprints differ in at
most DISTANCE bits, some segment starts a chain of which every first l segments differ in at most
l * DISTANCE / (DISTANCE + 1) bits, rounded down: none in the first, one in the first two, and so on.
So candidates share a segment exactly and differ in at most one bit of the next: fingerprints are
joined on both segments, once as they are and once with one unset bit of the second set. The rest
of the chain is tested segment by segment, and only what passes gets the full Hamming check. Within
a bucket each fingerprint is reached once, so links come out as a forest, never as all pairs; buckets
that are counted to be large are dealt into tiles of which every two parts meet once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import arrow_map, few, materialize, release, table, values
from sluice.llm.components import components

WORDS, DISTANCE, SEED = 4, 4, 42
PIECE = 1 << 20  # bytes of a text that are split into words at a time
HOT = 1024  # fingerprints of a key beyond which its bucket, and those one bit away, are counted for tiles
TILE = 4096  # fingerprints of one part of a large bucket
SMALL = 12  # buckets up to this size are compared all at once, larger ones by reaching each fingerprint once
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_FIRST = np.uint64(48)  # the number of the first segment stands above this bit of a key


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text cut before white space into parts of about PIECE bytes."""
    at = 0
    while len(data) - at > PIECE:
        found = _BREAK.search(data, at + PIECE)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bits that are set in over half of the hashes of all shingles, repeats included; fewer words are one shingle, no words give 0."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for piece in _pieces((text or "").encode("utf-8", "replace").lower()):
        found = tail + piece.split()
        k = max(len(found) - words + 1, 0)
        tail = found[k:]
        if not k:
            continue
        joined = b" ".join(found)
        end = np.cumsum([len(w) + 1 for w in found]) - 1
        start = np.r_[0, end[:-1] + 1]
        counts, n = counts + _bits([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(start[:k].tolist(), end[words - 1 :].tolist(), strict=True)]), n + k
    if not n and tail:
        counts, n = _bits([xxhash.xxh64_intdigest(b" ".join(tail), seed)]), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _bits(hashes: list[int]) -> np.ndarray:
    """How many hashes have each bit set, the lowest first."""
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and the fingerprint of every text (doc_id, text), as a long of the same bits."""

    def work(part: pa.RecordBatch) -> dict:
        return {"fp": np.array([fingerprint(t, words, seed) for t in values(part, "text")], np.uint64).view(np.int64)}

    return arrow_map(docs.select("doc_id", "text"), work, "fp long", keep=["doc_id"])


@lru_cache(maxsize=16)
def ring(distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest bit and width of each segment, and masks[l - 3][i] of the l segments from the i-th on."""
    m = distance + 1
    edges = np.array([64 * i // m for i in range(m + 1)])
    low, width = edges[:-1], np.diff(edges)
    own = [((1 << int(w)) - 1) << int(b) for b, w in zip(low, width, strict=True)]
    masks = np.array([[sum(own[(i + j) % m] for j in range(length)) for i in range(m)] for length in range(3, m + 1)], np.uint64)
    return low.astype(np.uint64), width.astype(np.uint64), masks


def _segment(fp: np.ndarray, i: int, distance: int) -> np.ndarray:
    low, width, _ = ring(distance)
    return (fp >> low[i]) & np.uint64((1 << int(width[i])) - 1)


def signatures(fp: np.ndarray, distance: int, flips: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, base): keys of two neighbouring segments of each fingerprint, as they are and with an unset bit of the second set."""
    _, width, _ = ring(distance)
    keys, rows, base, every = [], [], [], np.arange(len(fp))
    for i in range(distance + 1):
        after = (i + 1) % (distance + 1)
        second = _segment(fp, after, distance)
        key = np.uint64(i) << _FIRST | _segment(fp, i, distance) << width[after] | second
        keys, rows, base = [*keys, key], [*rows, every], [*base, np.ones(len(fp), bool)]
        for t in range(int(width[after]) if flips else 0):
            unset = np.flatnonzero(second >> np.uint64(t) & np.uint64(1) == 0)
            keys, rows, base = [*keys, key[unset] | np.uint64(1 << t)], [*rows, unset], [*base, np.zeros(len(unset), bool)]
    return np.concatenate(keys).view(np.int64), np.concatenate(rows), np.concatenate(base)


def chained(x: np.ndarray, first: np.ndarray, distance: int) -> np.ndarray:
    """Indexes of the differences x that stay within the budget of every chain from segment `first` on; the last chain is the whole ring."""
    at = np.arange(len(x))
    for budget, mask in enumerate(ring(distance)[2], 2):
        at = at[np.bitwise_count(x[at] & mask[first[at]]) <= budget]
    return at


def forest(fp: np.ndarray, base: np.ndarray, first: int, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a bucket: every fingerprint is compared with those not yet reached, two flipped ones never."""
    left, out = np.argsort(~base, kind="stable"), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            u = todo.pop()
            near = np.flatnonzero(base[left]) if not base[u] else np.arange(len(left))
            hit = near[chained(fp[left[near]] ^ fp[u], np.full(len(near), first), distance)]
            if len(hit):
                found = left[hit]
                out.append((np.full(len(found), fp[u]), fp[found]))
                todo += found.tolist()
                left = np.delete(left, hit)
    return out


def bucket_links(group: np.ndarray, key: np.ndarray, fp: np.ndarray, base: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal `group` of sorted rows."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(group)])
    first, out = (key.view(np.uint64) >> _FIRST).astype(np.int64), [(fp[:0], fp[:0])]
    end = np.repeat(np.where(size <= SMALL, start + size, 0), size)  # 0: rows of large buckets
    for step in range(1, SMALL):
        a = np.flatnonzero(np.arange(len(group)) + step < end)
        a = a[base[a] | base[a + step]]
        a = a[chained(fp[a] ^ fp[a + step], first[a], distance)]
        out.append((fp[a], fp[a + step]))
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        out += forest(fp[s : s + n], base[s : s + n], int(first[s]), distance)
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return a[a != b], b[a != b]


def _numbers(df: DataFrame, work: Callable[..., tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """Apply `work` to batches of integer columns without nulls."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(*(c.to_numpy() for c in batch.columns))], names=names)

    return df.mapInArrow(run, schema)


def _sign(distance: int, flips: bool) -> Callable[..., tuple[np.ndarray, ...]]:
    def work(fp: np.ndarray) -> tuple[np.ndarray, ...]:
        key, row, base = signatures(fp.view(np.uint64), distance, flips)
        return key, fp[row], base

    return work


def _spread(distance: int) -> Callable[..., tuple[np.ndarray, ...]]:
    """(key, n) of every bucket that gets rows from a large key: itself, and those one bit up."""

    def work(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        key = key.view(np.uint64)
        width = ring(distance)[1][((key >> _FIRST).astype(np.int64) + 1) % (distance + 1)]
        keys, rows = [key], [n]
        for t in range(int(width.max(initial=0))):
            at = np.flatnonzero((np.uint64(t) < width) & (key >> np.uint64(t) & np.uint64(1) == 0))
            keys, rows = [*keys, key[at] | np.uint64(1 << t)], [*rows, n[at]]
        return np.concatenate(keys).view(np.int64), np.concatenate(rows)

    return work


def _compare(distance: int):
    """Links of sorted (key, tile, fp, base) rows; the last bucket of a batch waits for its rest, which is bounded by HOT and TILE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            key, tile, fp, base = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(4))
            group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            a, b = bucket_links(group, key, fp.view(np.uint64), base, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])[-1])
            if cut or last != (key[0], tile[0]):
                if held or cut:
                    yield done([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
            last = (key[-1], tile[-1])
        if held:
            yield done(held)

    return run


def hamming_links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` at a distance up to `distance` (2 to 15) that connect all that are so linked."""
    if not 2 <= distance <= 15:
        raise ValueError("distance must be 2 to 15")
    fps = classes.select("fp")
    sign = lambda flips: _numbers(fps, _sign(distance, flips), "key long, fp long, base boolean")
    hot = materialize(sign(False).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    rows = sign(True)
    if hot.isEmpty():
        dealt = rows.select("key", F.lit(0).cast("long").alias("tile"), "fp", "base")
    else:
        wide = _numbers(hot, _spread(distance), "key long, n long").groupBy("key").agg(F.ceil((F.sum("n") + (1 + 64 // (distance + 1)) * HOT) / TILE).alias("parts"))
        wide = materialize(wide)
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.least(own, q) * F.col("parts") + F.greatest(own, q))
        dealt = rows.join(few(wide), "key", "left").select("key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(tiles)).alias("tile"), "fp", "base")
    found = materialize(dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_compare(distance), "a long, b long"))
    release(hot)
    return found


def near_copies(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id of every document (doc_id, text): the smallest doc_id reachable by links of fingerprints.

    A null text counts as empty; texts without words have fingerprint 0 and are linked like others.
    Equal fingerprints are one class. A null doc_id gives no component its id: a component of only
    such rows has a null one. Repeated rows give equal rows, an empty table gives none; other columns
    are not read.
    """
    rows = materialize(fingerprints(docs, words, seed))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("own")))
    member = materialize(components(hamming_links(classes, distance)))
    joined = classes.join(member.withColumnRenamed("node", "fp"), "fp")
    least = materialize(joined.groupBy("component").agg(F.min("own").alias("least")))
    named = materialize(member.join(few(least), "component").select(F.col("node").alias("fp"), "least"))
    named = classes.join(named, "fp", "left").select("fp", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("own")).alias("component_id"))
    return rows.join(few(materialize(named)), "fp", "left").select("doc_id", "fp", "component_id")


def op13_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
