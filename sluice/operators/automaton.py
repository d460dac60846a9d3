"""Which rows may match which of many patterns: one automaton over the literals that a match must hold.

A pattern that cannot match without one of some literals has these as seeds; an Aho-Corasick automaton
over the seeds of all patterns passes over each text once, whatever their number. Patterns without
such literals are joined into one alternation that the engine tests by itself. Only rows that hold a
seed, or meet the alternation, come out, with the keys of the patterns to be tried on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants, _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

MIN_SEED = 3  # characters of a seed
MAX_PATTERNS, MAX_BYTES = 50_000, 16 << 20  # a larger deny list is an error: the list goes to every task
# Escapes that mean the same to both regex engines, or a sign itself; others, and nested classes, give no seeds.
_FOREIGN = re.compile(r"\\[^bBdDwWsS\W_]|\[[^\]]*(?:\[|&&)")


def pattern_key(stem: Column | str, pattern: Column | str) -> Column:
    return F.xxhash64(stem, pattern)


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """Code point to what case-insensitive matching compares: lower case of upper case, where these are single."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1F000):
        if not 0xD800 <= c < 0xE000:
            up = chr(c).upper()
            low = (up if len(up) == 1 else chr(c)).lower()
            out[c] = ord(low[0]) if len(low) == 1 or c == 0x130 else c
    return out


def fold(text: str) -> str:
    """The text as case-insensitive matching compares it, of the same length."""
    if text.isascii():
        return text.lower()
    return _folds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tobytes().decode("utf-32-le")


def seeds(pattern: str) -> frozenset[str]:
    """Folded literals of which every match holds at least one; empty if there are none of MIN_SEED characters."""
    if _FOREIGN.search(pattern):
        return frozenset()
    try:
        return _required(_parser.parse(pattern)) or frozenset()
    except (re.error, OverflowError, RecursionError):
        return frozenset()


def _required(tree) -> frozenset[str] | None:
    best, run = None, ""

    def offer(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and min(map(len, found)) >= MIN_SEED and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in [*tree, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(arg)
            continue
        if op in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):
            continue  # takes no room: what stands around it is adjacent
        offer(frozenset({fold(run)}) if run else None)
        run = ""
        if op is _constants.SUBPATTERN:
            offer(_required(arg[3]))
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and arg[0] > 0:
            offer(_required(arg[2]))
        elif op is _constants.ATOMIC_GROUP:
            offer(_required(arg))
        elif op is _constants.BRANCH:
            parts = [_required(b) for b in arg[1]]
            offer(frozenset().union(*parts) if all(parts) else None)
    return best


@lru_cache(maxsize=4)
def _automaton(pairs: tuple[tuple[str, tuple[int, ...]], ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for seed, keys in pairs:
        out.add_word(seed, keys)
    out.make_automaton()
    return out


def _texts(column: pa.Array) -> tuple[str, np.ndarray]:
    """All texts of a column one after the other, and where each ends, in code points."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")[at[0] : at[-1]]
    try:
        text = bytes(data).decode()
    except UnicodeDecodeError:  # bytes that are no text, text by text
        texts = [bytes(data[a - at[0] : b - at[0]]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        return "".join(texts), np.cumsum([len(t) for t in texts])
    if len(text) == len(data):
        return text, at[1:] - at[0]
    chars = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int32)]
    return text, chars[at[1:] - at[0]]


def with_candidates(df: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """The rows of df whose text `column` may match one of patterns (stem, pattern), with found: the keys of those to try.

    Null texts match nothing. A seed that straddles two texts of a batch only adds a key to try.
    """
    known = patterns.select("stem", "pattern", pattern_key("stem", "pattern").alias("key")).distinct().limit(MAX_PATTERNS + 1).collect()
    if len(known) > MAX_PATTERNS or sum(len(r["pattern"]) for r in known) > MAX_BYTES:
        raise ValueError("the deny list is too large to be sent to every task")
    if len({r["key"] for r in known}) < len(known):
        raise ValueError("two patterns have one key")
    by_seed: dict[str, list[int]] = {}
    loose = []
    for r in known:
        found = seeds(r["pattern"])
        for s in found:
            by_seed.setdefault(s, []).append(r["key"])
        if not found:
            loose.append(r)
    free = "|".join(sorted(f"(?:{r['pattern']})" for r in loose))
    flag = F.coalesce(F.col(column).rlike(f"(?iu){free}"), F.lit(False)) if loose else F.lit(False)
    always = sorted(r["key"] for r in loose)
    if not by_seed:
        return df.where(flag).withColumn("found", F.array(*map(F.lit, always)).cast("array<long>"))
    pairs = tuple(sorted((s, tuple(sorted(k))) for s, k in by_seed.items()))
    place, names = df.columns.index(column), [*df.columns, "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(pairs)
        for batch in batches:
            if not batch.num_rows:
                continue
            text, ends = _texts(batch.column(place))
            keys = {int(r): set(always) for r in np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))}
            hits = list(automaton.iter(fold(text)))
            for row, (_, found) in zip(np.searchsorted(ends, [e for e, _ in hits], side="right").tolist(), hits, strict=True):
                keys.setdefault(row, set()).update(found)
            kept = batch.take(pa.array(sorted(keys), pa.int64()))
            lists = pa.array([sorted(keys[r]) for r in sorted(keys)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], lists], names=names)

    return df.withColumn("loose_", flag).mapInArrow(run, StructType([*df.schema.fields, StructField("found", ArrayType(LongType()))]))
