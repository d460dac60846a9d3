"""Operator 4: quality classifier, a generalised additive model with pairwise interactions.

Features are counts and ratios of a whole text, cut into bins at quantiles of a bounded labelled
sample. Training boosts cyclically: each round visits every feature in turn and adds a shrunken
shallow tree over its bins to that feature's lookup table. The strongest residual pairs then get
tables of their own, boosted the same way by trees that split one feature and then the other.
Scoring adds table entries, vectorised over a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import arrow_map, scratch, table, values

SAMPLE_ROWS = 12_000  # bound of the labelled sample that the model is fitted on
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
RATE = 0.1
LEAVES = 4
PRIOR = 20.0  # pseudo-rows that pull a leaf towards zero
THRESHOLD = 0.3
FEATURES = [
    "chars", "words", "mean_word", "upper", "digits", "punctuation", "symbols", "bars", "non_ascii", "lines",
    "mean_line", "repeated_lines", "distinct_words", "top_word", "distinct_pairs", "capital_words", "long_words", "word_ends",
]

_KIND = np.zeros(256, np.int8)  # 1 upper, 2 digit, 3 punctuation, 4 symbol, 5 bar, 6 beyond ASCII
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b".,;:!?'\"()-":
    _KIND[_c] = 3
for _c in b"#$%&*+/<=>@[\\]^_`{}~":
    _KIND[_c] = 4
_KIND[ord("|")] = 5
_KIND[128:] = 6


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES per text; null and empty texts give zeros."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "replace")
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        kinds = np.bincount(_KIND, weights=counts, minlength=7) / len(data)
        words = text.split()
        n = max(len(words), 1)
        lines = text.split("\n")
        tally: dict[str, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        pairs = len(set(zip(words, words[1:], strict=False)))
        caps = sum(map(str.isupper, tally))
        lengths = np.fromiter(map(len, tally), np.int32, len(tally)) if tally else np.zeros(1, np.int32)
        tails = len({w[-1] for w in tally})
        out[i] = (
            np.log1p(len(text)), np.log1p(len(words)), len(text) / n, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], np.log1p(len(lines)),
            np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines), len(tally) / n, max(tally.values(), default=0) / n,
            pairs / max(n - 1, 1), caps / max(len(tally), 1), float((lengths > 12).mean()), np.log1p(tails),
        )
    return out


@dataclass
class AdditiveModel:
    """Per-feature cut points and lookup tables, pair tables, and the intercept: a few kilobytes."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cut, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += values[np.searchsorted(cut, x[:, j], side="right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            z += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-z))


def _step(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over ordered bins: splits that gain most, then a Newton value for each leaf."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + PRIOR / 4)
    edges = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = value(a, at) + value(at, b) - value(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(at[k])))
        if best[1] < 0:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + PRIOR / 4)
    return out


def _pair_step(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree of four leaves over a grid: a split of the rows, then one of the columns on either side."""

    def half(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        g, h = np.cumsum(g), np.cumsum(h)
        left, right = g[:-1] ** 2 / (h[:-1] + PRIOR), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + PRIOR)
        k = int((left + right).argmax())
        out = np.full(len(g), (g[-1] - g[k]) / (h[-1] - h[k] + PRIOR))
        out[: k + 1] = g[k] / (h[k] + PRIOR)
        return float(left[k] + right[k]), out

    best = (-1.0, 0, None, None)
    for cut in range(1, len(grad)):
        above, below = half(grad[:cut].sum(0), hess[:cut].sum(0)), half(grad[cut:].sum(0), hess[cut:].sum(0))
        if above[0] + below[0] > best[0]:
            best = (above[0] + below[0], cut, above[1], below[1])
    return best[0], np.vstack([np.tile(best[2], (best[1], 1)), np.tile(best[3], (len(grad) - best[1], 1))])


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost on the sample. Without both classes the model is a constant: the prior, or 0.5 without rows."""
    mean = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(base=float(np.log(mean / (1 - mean))))
    if len(y) == 0 or y.min() == y.max():
        return model
    quantiles = lambda j, n: np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1]))
    model.cuts = [quantiles(j, BINS) for j in range(x.shape[1])]
    model.coarse = [quantiles(j, PAIR_BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = 1 / (1 + np.exp(-z))
            size = len(model.tables[j])
            step = RATE * _step(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), LEAVES)
            model.tables[j] += step
            z += step[b]
    rough = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    p = 1 / (1 + np.exp(-z))
    grid = lambda a, b, v: np.bincount(rough[a] * PAIR_BINS + rough[b], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gains = [(_pair_step(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0], a, b) for a in range(len(rough)) for b in range(a)]
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(ROUNDS // 3):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _pair_step(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1]
            model.pair_tables[k] += step
            z += step[rough[a], rough[b]]
    return model


def _features(part: pa.RecordBatch) -> dict:
    return {"x": list(features(values(part, "text")))}


def _scorer(model: AdditiveModel, name: str) -> Callable[[pa.RecordBatch], dict]:
    return lambda part: {name: model.score(features(values(part, "text")))}


def held_out(doc_id: str = "doc_id"):
    """True for documents that training never sees: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most sample_rows labelled documents outside the held-out fold, those with the smallest hash of doc_id.

    Only the sample's features reach the driver. Of repeated labels the larger counts; null labels and ids are left out.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # sample_rows ids: a proven bound for the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")
    found = arrow_map(rows, _features, "x array<float>", keep=["y"]).orderBy(F.xxhash64("x", "y")).limit(2 * sample_rows).toPandas()
    x = np.array(found["x"].tolist(), np.float32).reshape(len(found), len(FEATURES))
    return fit(x, found["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every document: the chance that a reader marks it good.

    Empty and null texts have zero features and get a score like any other; repeated rows get equal
    scores; an empty table gives no rows.
    """
    return arrow_map(docs.select("doc_id", "text"), _scorer(model, "score"), "score double", keep=["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with the input's columns.

    Null and empty texts have a score like any other; repeated rows stay or go together; without
    usable labels every score is 0.5, so all stay. An empty table gives no rows.
    """
    score = scratch(docs, "score_")
    scored = arrow_map(docs, _scorer(train(docs, labels), score), f"{score} double", keep=docs.columns)
    return scored.where(F.col(score) >= threshold).select(*docs.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
