"""Spans of regular-expression matches as Spark expressions: no Python sees a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"
HITS = "array<struct<start:int,end:int,hit:string,value:string>>"


CHUNK = 256  # running values are taken in two levels of chunks: cost grows with the number of spans, not its square


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _chunks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / CHUNK), F.lit(0)).cast("int")), lambda i: F.slice(values, i * CHUNK + 1, CHUNK))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of some ints the result of `step` (associative, 0 being neutral) over those before it."""

    def scan(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    zero = F.lit(0)
    both = lambda chunks: F.zip_with(chunks, scan(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, b: step(a, b))), zero), scan)
    return F.flatten(let(_chunks(values), both))


def hits(text: Column, pattern: str, guard: str | None = None, group: int = 0) -> Column:
    """Non-overlapping matches from the left: start and end in code points, the match and one of its groups.

    Matches and the stretches between them alternate, so their lengths give the offsets. `guard` is a
    pattern that every text with a useful match satisfies; other texts are not searched twice.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    columns = [gaps.alias("gap"), found.alias("hit")] + ([F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")] if group else [])
    rows = F.filter(F.arrays_zip(*columns), lambda x: x["hit"].isNotNull())

    def place(rows: Column) -> Column:
        before = running(F.transform(rows, lambda x: x["gap"] + F.length(x["hit"])), lambda a, b: a + b)
        one = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), x["value" if group else "hit"].alias("value"))
        return F.zip_with(rows, before, one).cast(HITS)

    return F.when(text.rlike(guard or pattern), let(rows, place)).otherwise(F.array().cast(HITS))


def as_spans(found: Column, kind: str, ord_: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(ord_).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then by the kinds' order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def rewrite(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with fill(span, end of the spans before it) in place of each span; what overlaps an earlier span is not kept."""

    def pieces(part: Column) -> Column:
        """Gaps and fills of a chunk of (span, before): each is cut from the chunk's stretch, not from the whole text."""
        low, last = part[0]["before"], F.element_at(part, -1)
        stretch = F.substring(text, low + 1, F.greatest(last["before"], last["s"]["end"]) - low)
        gap = lambda x, whole: F.substring(whole, x["before"] - low + 1, F.greatest(x["s"]["start"] - x["before"], F.lit(0)))
        return let(stretch, lambda whole: F.array_join(F.transform(part, lambda x: F.concat(gap(x, whole), fill(x["s"], x["before"]))), ""))

    def build(ordered: Column) -> Column:
        before = running(F.transform(ordered, lambda s: s["end"]), F.greatest)
        zipped = F.zip_with(ordered, before, lambda s, b: F.struct(s.alias("s"), b.alias("before")))
        done = F.array_max(F.transform(ordered, lambda s: s["end"]))
        return F.concat(let(let(zipped, _chunks), lambda chunks: F.array_join(F.transform(chunks, pieces), "")), F.substring(text, done + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.array_sort(spans), build))


def redact(text: Column, spans: Column, label: dict[str, str]) -> Column:
    """The text with each span replaced by its kind's label; of overlapping spans the first gives the label."""
    names = F.create_map(*[F.lit(x) for kv in label.items() for x in kv])
    return rewrite(text, spans, lambda s, before: F.when(s["start"] >= before, F.coalesce(F.element_at(names, s["kind"]), F.lit(""))).otherwise(""))


def blank(text: Column, spans: Column) -> Column:
    """The text with spaces in place of its spans: what is left keeps its offsets."""
    return rewrite(text, spans, lambda s, before: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], before), F.lit(0))))
