"""Operator 12: hard-negative mining with products in a residue number system.

Vectors become integers. Products of anchors and rows are matrix products modulo several small
primes: residues are centred, so sums over at most WIDTH components stay below 2**24 and float32
holds them exactly; Chinese remaindering gives back the exact signed scores. Anchors go out in waves
of bounded size, the rows stream past them where they lie, and a task keeps only the best few rows
of each anchor: a first pass finds the positives, a second one the negatives in each positive's
window of scores. What the tasks kept meets in one small shuffle by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import materialize, release, table

SCALE, LABELS = 256, 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score between which a negative lies
WIDTH = 64  # components multiplied at a time
BLOCK, WAVE = 1024, 16  # anchors of a block (on average), blocks that are sent out at a time
TASK_ROWS = 1 << 21  # rows that one task reads, on average, so that what it keeps is small beside them
TILE = 2048  # rows that meet a block at a time
LIMIT = 1 << 49  # scores stay below
_NONE = np.int64(-(1 << 62))


@lru_cache(maxsize=8)
def moduli(bound: int) -> tuple[int, ...]:
    """Largest primes first, with residues small enough for float32, until their product holds every score from -bound to bound."""
    out, product, p = [], 1, 2 * int((((1 << 24) - 1) / WIDTH) ** 0.5) + 1
    while not out or product <= 2 * bound:
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return tuple(out)


def residues(q: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """Component matrices modulo each prime, centred on zero."""
    return [(r - p * (r > p // 2)).astype(np.float32) for p in primes for r in [q % p]]


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of all rows of two matrices given by their residues, by mixed-radix Chinese remaindering."""
    x, product = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for p, left, right in zip(primes, a, b, strict=True):
        r = np.zeros(x.shape, np.int64)
        for at in range(0, left.shape[1], WIDTH):
            r += (left[:, at : at + WIDTH] @ right[:, at : at + WIDTH].T).astype(np.int64)
        x += product * ((r - x) * pow(product, -1, p) % p)
        product *= p
    return np.where(x > product // 2, x - product, x)


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    size, flat = np.diff(q.offsets.to_numpy()), q.flatten().to_numpy()
    out = np.zeros((len(q), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _best(score: np.ndarray, vec_id: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n of each row, higher scores first, then smaller ids."""
    order = np.lexsort((vec_id, -score), axis=-1)[..., :n]
    return np.take_along_axis(score, order, -1), np.take_along_axis(vec_id, order, -1)


class _Search:
    """The best rows of every anchor of a wave in one task: of its own label, or of other labels within each positive's window."""

    def __init__(self, wave: dict, positives: bool) -> None:
        self.wave, self.positives = wave, positives
        self.blocks = [dict(b, res=residues(b["q"], wave["primes"])) for b in wave["blocks"]]
        for b in self.blocks:
            shape = (len(b["ids"]), wave["n_positives"]) if positives else (*b["scores"].shape, wave["n_negatives"])
            b["best"] = (np.full(shape, _NONE), np.full(shape, _NONE))

    def add(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, labels, q = ids[order], labels[order], q[order]
        for at in range(0, len(ids), TILE):
            part = slice(at, at + TILE)
            res = residues(q[part], self.wave["primes"])
            for b in self.blocks:
                key = scores(b["res"], res, self.wave["primes"]) * TILE + np.arange(TILE - 1, TILE - 1 - len(res[0]), -1)
                same = b["labels"][:, None] == labels[part]
                found = self._same(b, key, same, ids[part]) if self.positives else self._window(b, key, same)
                score, place = found // TILE, TILE - 1 - found % TILE
                real = found != _NONE
                pair = np.where(real, score, _NONE), np.where(real, ids[part][np.where(real, place, 0)], _NONE)
                b["best"] = _best(*(np.concatenate(x, -1) for x in zip(b["best"], pair, strict=True)), b["best"][0].shape[-1])

    def _same(self, b: dict, key: np.ndarray, same: np.ndarray, ids: np.ndarray) -> np.ndarray:
        n = min(self.wave["n_positives"], key.shape[1])
        key = np.where(same & (b["ids"][:, None] != ids), key, _NONE)
        return -np.partition(-key, n - 1, axis=1)[:, :n]

    def _window(self, b: dict, key: np.ndarray, same: np.ndarray) -> np.ndarray:
        key = np.sort(np.where(same, _NONE, key), axis=1)
        low, high = -(-self.wave["low"] * b["scores"] // 100), self.wave["high"] * b["scores"] // 100
        end = np.array([np.searchsorted(k, h, side="right") for k, h in zip(key, high * TILE + TILE - 1, strict=True)]).reshape(high.shape)
        at = end[..., None] - 1 - np.arange(self.wave["n_negatives"])
        found = key[np.arange(len(key))[:, None, None], np.maximum(at, 0)]
        return np.where((at >= 0) & (found >= (low * TILE)[..., None]) & (b["scores"] != _NONE)[..., None], found, _NONE)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(block, slot, place, vec_id, score): place numbers an anchor's positives."""
        for b in self.blocks:
            score, vec_id = b["best"]
            at = np.nonzero(score != _NONE)
            place = at[1] if len(at) == 3 else np.zeros(len(at[0]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[0]), b["block"])), pa.array(at[0]), pa.array(place), pa.array(vec_id[at]), pa.array(score[at])], names=["block", "slot", "place", "vec_id", "score"])


def _search(rows: DataFrame, wave: Broadcast, positives: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(wave.value, positives)
        for batch in batches:
            search.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), wave.value["width"]))
        yield from search.rows()

    found = rows.mapInArrow(run, "block long, slot long, place long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "slot", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= (wave.value["n_positives"] if positives else wave.value["n_negatives"]))


def _pack(found: pa.Table) -> pa.Table:
    """One row of bytes of a block's anchors; the vectors keep their own lengths."""
    q = found["q"].combine_chunks()
    data = {"block": [found["block"][0].as_py()], "ids": [found["vec_id"].to_numpy().tobytes()], "labels": [found["label"].to_numpy().tobytes()], "sizes": [np.diff(q.offsets.to_numpy()).tobytes()], "q": [q.flatten().to_numpy().tobytes()]}
    return pa.table(data, schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "sizes", "q"))]))


def _unpack(row, width: int) -> dict:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    sizes = np.frombuffer(row["sizes"], np.int32)
    q = np.zeros((len(ids), width), np.int64)
    q[np.arange(width) < sizes[:, None]] = np.frombuffer(row["q"], np.int64)
    return {"block": row["block"], "ids": ids, "labels": labels, "q": q}


def integer_rows(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: floor(scale * x) of every component."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """For every row (vec_id, embedding, label) where `anchor` (a condition on vec_id) holds: its positives and each one's hard negatives.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Rows with a null
    id or label, or without a sound vector, take no part. Rows that agree in id, label and integer
    vector count once; rows that share only the id are rows of their own, but never an anchor's
    positive. Equal scores go by the smaller id. Missing components of shorter vectors are zeros. No
    rows, no anchors or no window that holds a row give none. Scores must stay below 2**49, or it is
    an error. Other columns are not read.
    """
    spark = rows.sparkSession
    whole = integer_rows(rows, scale)
    size = whole.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width"), F.max(F.array_max(F.transform("q", F.abs))).alias("top")).first()
    bound = (size["width"] or 0) * (size["top"] or 0) ** 2
    if bound >= LIMIT:
        raise ValueError(f"scores up to {bound} do not fit")
    parts = max(spark.sparkContext.defaultParallelism, -(-size["n"] // TASK_ROWS))
    whole = materialize(whole.distinct().repartition(parts))
    anchors = whole.where(anchor)
    n_blocks = max(1, -(-anchors.count() // BLOCK))
    blocks = materialize(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(n_blocks)).cast("long")).groupBy("block").applyInArrow(_pack, "block long, ids binary, labels binary, sizes binary, q binary"))
    made = []
    for first in range(0, n_blocks, WAVE):
        sent = [_unpack(r, size["width"] or 0) for r in blocks.where(F.col("block").between(first, first + WAVE - 1)).collect()]  # at most about WAVE * BLOCK vectors
        wave = {"primes": moduli(bound), "width": size["width"] or 0, "low": low, "high": high, "n_positives": positives, "n_negatives": negatives, "blocks": sent}
        one = spark.sparkContext.broadcast(wave)
        for b in sent:
            b["scores"], b["others"] = (np.full((len(b["ids"]), positives), _NONE) for _ in range(2))
        by = {b["block"]: b for b in sent}
        for r in _search(whole, one, True).collect():  # at most `positives` an anchor of the wave
            by[r["block"]]["scores"][r["slot"], r["rank"] - 1], by[r["block"]]["others"][r["slot"], r["rank"] - 1] = r["score"], r["vec_id"]
        two = spark.sparkContext.broadcast(wave)
        made.append(materialize(_search(whole, two, False).join(F.broadcast(_named(spark, sent)), ["block", "slot", "place"])))
        one.destroy()
        two.destroy()
    release(whole, blocks)
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _named(spark: SparkSession, sent: list[dict]) -> DataFrame:
    """(block, slot, place) of a wave's positives with their ids and scores."""
    columns = [[], [], [], [], [], []]
    for b in sent:
        slot, place = np.nonzero(b["scores"] != _NONE)
        for c, x in zip(columns, (np.full(len(slot), b["block"]), slot, place, b["ids"][slot], b["others"][slot, place], b["scores"][slot, place]), strict=True):
            c.extend(x.tolist())
    schema = pa.schema([(c, pa.int64()) for c in ("block", "slot", "place", "anchor_id", "positive_id", "positive_score")])
    return spark.createDataFrame(pa.table(columns, schema=schema))


def op12_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of embeddings, a seventh of the labels shifted first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    return hard_negatives(shifted, F.col("vec_id") % 100 == 0)


OP12_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
