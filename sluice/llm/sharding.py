"""Operator 10: shards of nearly equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours and stay in one
shard unless a boundary must fall inside their group. The splitters are found by counting exact
bytes below probes: each round divides the open interval of every unsettled splitter into
2**FANOUT_BITS parts and counts the bytes of each part in one aggregation. A splitter settles once a
probe is within the tolerance of its target, or next to it stands one row. A group of equal texts
too large for the tolerance is probed further by doc_id, in the same rounds. Rows are then
exchanged once, to get their slots.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import materialize, scratch, table

SHARDS = 16
TOLERANCE = 0.0005  # of a shard's mean bytes
FANOUT_BITS = 8  # 256 probes an interval and round
SLOT_BINS = 256  # row numbers are dealt per (shard, bin): no task holds a whole shard
LOW = -(1 << 63)


def _parts(intervals: list[tuple[int | None, int, int]]) -> Column:
    """(interval, part) of a row (k, d) in disjoint intervals (group, low, bits): [low, low + 2**bits) of k, or of d inside one k."""
    cases = []
    for i, (group, low, bits) in enumerate(intervals):
        step = max(bits - FANOUT_BITS, 0)
        # low is aligned, so XOR gives the distance from it; flipping the sign bit makes the signed order unsigned
        away = F.col("k" if group is None else "d").bitwiseXOR(F.lit(_signed(low)))
        inside = F.shiftrightunsigned(away, bits) == 0 if bits < 64 else F.lit(True)
        if group is not None:
            inside = (F.col("k") == F.lit(_signed(group))) & inside
        cases.append(F.when(inside, F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(away, step).alias("part"))))
    return F.coalesce(*cases)


def _splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """Boundaries (key, doc key or None): a row is at or above one if its key is larger, or equal with a doc key at or above.

    Each round divides the open interval of every unsettled boundary in one aggregation. Intervals
    are aligned, so those of different boundaries are equal or disjoint. An interval of one key is
    divided by the rows' doc keys; one row cannot be divided.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    state = [{"target": total * i // shards, "at": (None, 0, 64), "below": 0, "best": None} for i in range(1, shards)]
    open_ = state if total else []
    while open_:
        spans = sorted({s["at"] for s in open_}, key=lambda a: (a[0] is not None, a[0] or 0, a[1], a[2]))
        bounds = [F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("d").alias("d0"), F.max("d").alias("d1")]
        counted = rows.select(_parts(spans).alias("p"), "size", "k", "d").where("p is not null").groupBy("p").agg(F.sum("size").alias("n"), *bounds)
        found: dict[int, list] = {}
        for r in counted.collect():  # at most shards * 2**FANOUT_BITS rows
            found.setdefault(r["p"]["i"], []).append(r)
        still = []
        for s in open_:
            group, low, bits = s["at"]
            step, below, chosen = max(bits - FANOUT_BITS, 0), s["below"], None
            for r in sorted(found.get(spans.index(s["at"]), []), key=lambda r: r["p"]["part"]):
                at = low + (r["p"]["part"] << step)
                for edge, value in ((at, below), (at + (1 << step), below + r["n"])):
                    gap = abs(value - s["target"])
                    if s["best"] is None or gap < s["best"][0]:
                        s["best"] = (gap, (edge, None) if group is None else (group, edge))
                if below <= s["target"] < below + r["n"]:
                    chosen = (at, below, r)
                below += r["n"]
            if s["best"][0] <= slack or chosen is None:
                continue
            at, s["below"], r = chosen
            if r["d0"] == r["d1"] and r["k0"] == r["k1"]:
                continue  # one row, or repeats of it, which stay together
            one_key = group is None and r["k0"] == r["k1"]
            s["at"] = (_unsigned(r["k0"]), 0, 64) if one_key else (group, at, step)
            still.append(s)
        open_ = still
    return [s["best"][1] if s["best"] else (1 << 64, None) for s in state]


def _unsigned(signed: int) -> int:
    return signed - LOW


def _signed(unsigned: int) -> int:
    return unsigned + LOW


def _above(k: Column, d: Column, boundary: tuple[int, int | None]) -> Column:
    edge, inner = boundary
    if edge >= 1 << 64:
        return F.lit(False)
    if inner is None:
        return k >= F.lit(_signed(edge))
    if inner >= 1 << 64:
        return k > F.lit(_signed(edge))
    return (k > F.lit(_signed(edge))) | ((k == F.lit(_signed(edge))) & (d >= F.lit(_signed(inner))))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, keep: list[str] | None = None) -> DataFrame:
    """Deal documents (doc_id, text) into shards of nearly equal bytes.

    Returns the columns `keep` (default: all) and size, text_crc32, law, shard, slot, grown_shard.
    Size is the text's UTF-8 bytes plus 1; a null text counts as empty. A null doc_id sorts first in
    its group. Repeated rows with equal doc_id and text share a key and stay in one shard. An empty
    table gives an empty result. Columns of the input named like an added one are replaced.
    """
    keep = docs.columns if keep is None else keep
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in keep if c.lower() not in added]
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    names = {n: scratch(docs, n) for n in ("k_", "d_", "bin_")}
    sized = docs.select(
        *keep,
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias(names["k_"]),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias(names["d_"]),
    )
    probe = sized.select(F.col(names["k_"]).alias("k"), F.col(names["d_"]).alias("d"), "size").persist(StorageLevel.MEMORY_AND_DISK)
    bounds = _splitters(probe, shards, tolerance)
    shard = reduce(lambda a, b: a + b, [_above(F.col("k"), F.col("d"), b).cast("int") for b in bounds], F.lit(0))
    bin_ = F.pmod(F.xxhash64("d", "k", F.lit(1)), F.lit(SLOT_BINS)).cast("int")
    # at most shards * SLOT_BINS rows: running offsets in one small window, then broadcast
    counts = materialize(probe.groupBy(shard.alias("shard"), bin_.alias("bin")).count())
    probe.unpersist()
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("s_"), F.col("bin").alias("b_"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset_"))
    k, d = F.col(names["k_"]), F.col(names["d_"])
    dealt = sized.withColumn("shard", reduce(lambda a, b: a + b, [_above(k, d, b).cast("int") for b in bounds], F.lit(0))).withColumn(names["bin_"], F.pmod(F.xxhash64(d, k, F.lit(1)), F.lit(SLOT_BINS)).cast("int"))
    placed = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("shard", names["bin_"]).orderBy(k, d)))
    joined = placed.join(F.broadcast(offsets), (F.col("shard") == F.col("s_")) & (F.col(names["bin_"]) == F.col("b_")))
    return joined.select(
        *keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("slot") - 1 + F.col("offset_")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by bytes. Null texts count as empty; equal texts are neighbours, repeated rows stay in one shard."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
