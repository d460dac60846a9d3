"""Operator 8: removal of repeated 200-byte strings, with suffix arrays.

A string of LENGTH bytes is represented by the rightmost of its smallest k-gram hashes, so equal
strings have the same anchor at the same place. Runs of window starts with one anchor form a
context. Anchors that occur once are done; contexts that occur in equal copies are repeated whole.
What is left, different contexts around equal anchors, is dealt by anchor into small groups. Each
group's suffixes are sorted in two stages (those smaller than their successors directly, the
others by scanning the buckets), and adjacent common prefixes of LENGTH bytes mark repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import arrow_map, few, materialize, powers, release, row_check, row_key, scratch, slices, table, values

LENGTH = 200
GRAM = 32
WORK = 1 << 20  # bytes handled at a time
PLACES = 24  # low bits of a sliding minimum hold the place; the upper ones order the k-grams
GROUP_BYTES = 1 << 19  # of contexts sorted together
BROADCAST_ANCHORS = 1_000_000  # more repeated anchors (a long each) than this are joined by a shuffle
NEARBY_BITS = 16  # rows of a table that count as near each other: 2**NEARBY_BITS
WIDEST = 5_000  # an anchor with more different contexts is counted window by window instead
_R = 0xD1342543DE82EF95  # odd multiplier of the rolling hash


class Rolling:
    """Hashes of stretches of a buffer."""

    def __init__(self, buf: np.ndarray) -> None:
        self.p, self.q = powers(_R, 1 << max(20, int(len(buf)).bit_length()))
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.p[: len(buf)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[start]) * self.q[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of `width` values, from prefix and suffix minima of blocks."""
    blocks = -(-len(x) // width)
    y = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    y[: len(x)] = x
    y = y.reshape(blocks, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the window starts of a buffer: anchor hash, context hash, start and end."""
    buf = np.frombuffer(data, np.uint8)
    roll = Rolling(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = roll(at, at + GRAM)
    mask = np.uint64((1 << PLACES) - 1)
    low = _sliding_min((gram & ~mask) | (mask - at.astype(np.uint64)), LENGTH - GRAM + 1)
    anchor = (mask - (low & mask)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    end = last + LENGTH
    return gram[anchor[first]].view(np.int64), roll(first, end).view(np.int64) ^ (end - first), first, end


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of every text, WORK bytes at a time; the strings that start in one part are all in it."""
    for part in slices(batches, "text", size=WORK // 4):
        out: list[tuple[np.ndarray, ...]] = []
        for key, check, text in zip(values(part, "key"), values(part, "check"), values(part, "text"), strict=True):
            data = text.encode()
            for low in range(0, max(len(data) - LENGTH + 1, 0), WORK):
                g, h, start, end = contexts(data[low : low + WORK + LENGTH - 1])
                out.append((np.full(len(g), key, np.int64), np.full(len(g), check, np.int64), g, h, (start + low).astype(np.int32), (end + low).astype(np.int32)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "check", "g", "h", "start", "end"])


def two_stage_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Starts of all suffixes in order of their first `depth` bytes (at least)."""
    n = len(text)
    t = text.astype(np.int16)
    # a suffix is smaller than its successor if the first byte that differs from the one after it is smaller
    step = np.r_[np.sign(t[1:] - t[:-1]), -1].astype(np.int8)
    place = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(place[::-1])[::-1]] > 0
    chosen = _direct_sort(text, np.flatnonzero(smaller), depth)
    # bucket scans: larger suffixes follow from the order of their successors
    edges = np.searchsorted(text[chosen], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~smaller[before]]
            bucket.append(wave)
        own = np.concatenate([*bucket, chosen[edges[c] : edges[c + 1]]])
        waiting[c] = []
        before = own[own > 0] - 1
        before = before[(text[before] > c) & ~smaller[before]]
        if len(before):
            kind = text[before]
            before = before[np.argsort(kind, kind="stable")]
            cut = np.r_[0, np.cumsum(np.bincount(kind, minlength=256))]
            for d in np.unique(kind).tolist():
                waiting[d].append(before[cut[d] : cut[d + 1]])
        out.append(own)
    return np.concatenate(out)


def _direct_sort(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes by their first `depth` bytes, eight bytes a round; groups equal to that depth rest early."""
    n = len(text)
    padded = np.r_[text, np.zeros(depth + 16, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    word = lambda at: np.ascontiguousarray(words[at]).view(">u8").ravel().astype(np.uint64)
    roll = Rolling(padded)
    key = word(starts)
    order = starts[np.argsort(key)]
    key = word(order)
    done = 8
    lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.r_[lead, len(order)])
    lead, size = lead[size > 1], size[size > 1]
    while len(lead) and done < depth:
        # positions of the members of open groups
        group = np.repeat(np.arange(len(lead)), size)
        at = np.repeat(lead - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        member = order[at]
        rest = roll(np.minimum(member + done, n), np.minimum(member + depth, len(padded)))
        equal = np.minimum.reduceat(rest, np.r_[0, np.cumsum(size)[:-1]]) == np.maximum.reduceat(rest, np.r_[0, np.cumsum(size)[:-1]])
        keep = ~equal[group]
        group, at, member = group[keep], at[keep], member[keep]
        if not len(at):
            break
        key = word(member + done)
        by = np.lexsort((key, group))
        member, key = member[by], key[by]
        order[at] = member
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(at)])
        lead, size = at[first][size > 1], size[size > 1]
        done += 8
    return order


def repeated_starts(pieces: list[bytes], depth: int = LENGTH) -> list[np.ndarray]:
    """For each piece, the starts of its strings of `depth` bytes that also start elsewhere in the pieces."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.r_[0, np.cumsum(sizes)]
    inside = np.zeros(len(text) + 1, np.int64)
    room = np.maximum(sizes - depth + 1, 0)
    np.add.at(inside, begin[:-1], 1)
    np.add.at(inside, begin[:-1] + room, -1)
    valid = np.cumsum(inside)[:-1] > 0
    order = two_stage_order(text, depth)
    order = order[valid[order]]
    view = np.lib.stride_tricks.sliding_window_view(text, depth) if len(text) >= depth else np.zeros((0, depth), np.uint8)
    common = np.zeros(max(len(order) - 1, 0), bool)
    for low in range(0, len(common), 10_000):  # adjacent common prefixes, as far as they matter
        a, b = order[low : low + 10_000], order[low + 1 : low + 10_001]
        common[low : low + 10_000] = (view[a[: len(b)]] == view[b]).all(axis=1)
    hit = np.zeros(len(text), bool)
    hit[order[:-1][common]] = True
    hit[order[1:][common]] = True
    return [np.flatnonzero(hit[a:b]) for a, b in zip(begin, begin[1:], strict=False)]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of bytes that strings of `length` bytes from some sorted starts cover, merged where they touch."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return [(int(a), int(b) + length) for a, b in zip(starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]], strict=True)]


def _sort_group(pdf: pd.DataFrame) -> pd.DataFrame:
    found = repeated_starts(pdf["piece"].tolist())
    out = [(key, check, a + at, b + at) for key, check, at, lone, starts in zip(pdf["key"], pdf["check"], pdf["start"], pdf["lone"], found, strict=True) if lone for a, b in runs(starts, LENGTH)]
    return pd.DataFrame(out, columns=["key", "check", "start", "end"])


def _cut_pieces(part: pa.RecordBatch) -> dict:
    out = {c: [] for c in ("row_", "start", "g", "lone", "wide", "piece")}
    for row, (text, wanted) in enumerate(zip(values(part, "text"), values(part, "wanted"), strict=True)):
        data = text.encode()
        for w in wanted:
            for c, v in zip(out, (row, w["start"], w["g"], w["lone"], w["wide"], data[w["start"] : w["end"]]), strict=True):
                out[c].append(v)
    return out


def _windows(part: pa.RecordBatch) -> dict:
    """Digest of every string of LENGTH bytes of some pieces."""
    out = {c: [] for c in ("row_", "start", "digest")}
    for row, (start, piece) in enumerate(zip(values(part, "from"), values(part, "piece"), strict=True)):
        n = len(piece) - LENGTH + 1
        out["row_"] += [row] * n
        out["start"] += range(start, start + n)
        out["digest"] += [hashlib.sha256(piece[i : i + LENGTH]).digest() for i in range(n)]
    return out


def _merge_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of places near each other, those of one document merged where they touch: a passage comes out as one row, not one a context."""
    for batch in batches:
        places = batch.column(batch.schema.get_field_index("places")).flatten()
        key, check, start, end = (places.field(c).to_numpy(zero_copy_only=False) for c in ("key", "check", "start", "end"))
        if not len(key):
            continue
        order = np.lexsort((end, start, check, key))
        key, check, start, end = key[order], check[order], start[order], end[order]
        # places of one document never hold one another, so their ends rise with their starts
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (start[1:] > end[:-1])])
        last = np.r_[first[1:], len(key)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(key[first], pa.int64()), pa.array(check[first], pa.int64()), pa.array(start[first], pa.int32()), pa.array(end[last], pa.int32())], names=["key", "check", "start", "end"])


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """key, check (together 128 bits of doc_id and text), start, end: bytes of each document (doc_id, text) that repeated strings cover.

    Rows of one key may overlap. Texts shorter than LENGTH bytes, empty and null ones have none.
    Repeated rows count as occurrences of their own, and share a key.
    """
    rows = docs.select(row_key().alias("key"), row_check().alias("check"), "text").where(F.octet_length(F.encode("text", "UTF-8")) >= LENGTH)
    found = materialize(rows.mapInArrow(_scan, "key long, check long, g long, h long, start int, end int"))
    anchors = materialize(found.groupBy("g").count().where("count > 1").select("g"))
    # rows of neighbouring documents share a number, which stays with them through the joins
    nearby = F.shiftright(F.monotonically_increasing_id(), NEARBY_BITS).alias("nearby")
    again = materialize(found.select("*", nearby).join(few(anchors, BROADCAST_ANCHORS), "g"))
    release(found)
    one = F.struct("key", "check", "start", "end")
    # copies of a context near each other travel as one row, so a passage that very many documents hold is few rows
    chunks = materialize(again.groupBy("g", "h", "nearby").agg(F.count("*").alias("n"), F.min(one).alias("one"), F.collect_list(one).alias("places")))  # 2**NEARBY_BITS places at most
    kinds = materialize(chunks.groupBy("g", "h").agg(F.sum("n").alias("n"), F.min("one").alias("one")))
    copied = chunks.join(few(kinds.where("n > 1").select("g", "h")), ["g", "h"], "left_semi").select("nearby", "places")
    copied = copied.repartition("nearby").sortWithinPartitions("nearby").mapInArrow(_merge_places, "key long, check long, start int, end int")
    # one of each different context goes to the sort; anchors with very many go window by window
    several = materialize(kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g", (F.col("kinds") > WIDEST).alias("wide")))
    sample = kinds.join(few(several), "g").select("g", "one.*", (F.col("n") == 1).alias("lone"), "wide")
    wanted = materialize(sample.groupBy("key", "check").agg(F.collect_list(F.struct("start", "end", "g", "lone", "wide")).alias("wanted")))  # at most a document's contexts
    texts = rows.join(few(wanted.select("key", "check")), ["key", "check"], "left_semi").dropDuplicates(["key", "check"])
    pieces = materialize(arrow_map(texts.join(wanted.hint("shuffle_hash"), ["key", "check"]), _cut_pieces, "start int, g long, lone boolean, wide boolean, piece binary", keep=["key", "check"]))
    size = sample.where("not wide").agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = pieces.where("not wide").withColumn("group", F.pmod(F.xxhash64("g"), F.lit(groups)))
    sorted_ = dealt.groupBy("group").applyInPandas(_sort_group, "key long, check long, start int, end int")
    windows = arrow_map(pieces.where("wide").select("key", "check", F.col("start").alias("from"), "piece"), _windows, "start int, digest binary", keep=["key", "check"], by="piece")
    twice = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    counted = windows.join(twice, "digest", "left_semi").select("key", "check", "start", (F.col("start") + LENGTH).alias("end"))
    return copied.unionByName(sorted_).unionByName(counted)


def merged(found: list, size: int) -> list[tuple[int, int]]:
    """Disjoint stretches, merged where they touch, in order."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def _apply(docs: DataFrame, finish: Callable[[pa.RecordBatch, str], dict], schema: str, keep: list[str]) -> DataFrame:
    """finish over all documents with their stretches; those without any are not shuffled."""
    key, check, spans = scratch(docs, "key_"), scratch(docs, "check_"), scratch(docs, "spans_")
    found = repeated_stretches(docs).groupBy("key", "check").agg(F.collect_set(F.struct("start", "end")).alias(spans))  # at most a document's stretches
    found = materialize(found.withColumnsRenamed({"key": key, "check": check}))
    keyed, both = docs.withColumns({key: row_key(), check: row_check()}), [key, check]
    keys = few(found.select(*both))
    clean = keyed.join(keys, both, "left_anti").withColumn(spans, F.array().cast("array<struct<start:int,end:int>>"))
    hit = keyed.join(keys, both, "left_semi").join(found.hint("shuffle_hash"), both).select(*clean.columns)
    return arrow_map(clean.unionByName(hit).drop(*both), lambda part: finish(part, spans), schema, keep)


def _kept(text: str | None, spans: list) -> tuple[bytes, int, list[tuple[int, int]]]:
    data = (text or "").encode()
    gone = merged([(s["start"], s["end"]) for s in spans], len(data))
    at, kept = 0, []
    for a, b in gone:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), len(data), gone


def _digests(part: pa.RecordBatch, spans: str) -> dict:
    found = [_kept(t, s) for t, s in zip(values(part, "text"), values(part, spans), strict=True)]
    return {"n_bytes": [n for _, n, _ in found], "n_removed": [n - len(k) for k, n, _ in found], "n_spans": [len(g) for _, _, g in found], "kept_sha256": [hashlib.sha256(k).hexdigest() for k, _, _ in found]}


def _texts(part: pa.RecordBatch, spans: str) -> dict:
    return {"left_": [_kept(t, s)[0].decode("utf-8", "ignore") if t is not None else None for t, s in zip(values(part, "text"), values(part, spans), strict=True)]}


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents without bytes that repeated strings cover; all columns stay.

    A character that a cut would split goes whole. All copies of a repeated row lose their bytes.
    Null texts stay null, empty and short ones as they are; an empty table gives no rows.
    """
    left = scratch(docs, "left_")
    cut = _apply(docs, lambda part, spans: {left: _texts(part, spans)["left_"]}, f"{left} string", [c for c in docs.columns if c.lower() != "text"])
    return cut.withColumnRenamed(left, "text").select(*docs.columns)


DIGESTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents, as digests. Null and empty texts keep nothing and lose nothing; repeated rows lose the bytes they share and give equal rows."""
    return _apply(table(spark, sf_dir, "documents").select("doc_id", "text"), _digests, DIGESTS, ["doc_id"])
