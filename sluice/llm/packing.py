"""Operator 2: best-fit packing with bound-certified repacking.

Pieces are dealt to groups of about GROUP pieces (more if they are tiny: a group fills FEWEST bins or
more), each packed best-fit decreasing on its own. Dual feasible functions bound a group's bins from
below; a group at its bound is certified. Groups with a gap give up their emptiest bins, certified
ones those with room to spare, at most half of all; what was given up is dealt again, mixed across
groups, and packed anew until one group is left. Everything else is final and carries its group's
number of bins and bound.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm.common import arrow_map, byte_symbols, materialize, table, values

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # fixed value of the tokenizer
GROUP = 4096  # pieces a group, on average
FEWEST = 64  # bins that a group fills at least, on average
CACHE = 200_000  # distinct words a worker remembers before it starts afresh


class WordEncoder:
    """Ids of words as little-endian 32-bit bytes, remembered up to CACHE words.

    Words of printable characters below U+0250 are lower-cased, split and merged piece by piece, the
    end of a piece being a byte that UTF-8 does not use; for these the normal form changes nothing.
    All others go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_symbols()
        special, suffix = {t["content"] for t in spec["added_tokens"]}, spec["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith(suffix) and token != suffix
                ranks[bytes(back[c] for c in (token.removesuffix(suffix) if ends else token)) + b"\xff" * ends] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.seen: dict[str, bytes] = {"": b""}

    def _simple(self, word: str) -> bytes:
        word = word.lower()
        ids: list[int] = []
        for piece in [word] if word.isalpha() else PIECES.findall(word):
            ids += self.merge(piece.encode() + b"\xff")
        return array("I", ids).tobytes()

    def learn(self, words: set[str]) -> None:
        fresh = words - self.seen.keys()
        if len(self.seen) + len(fresh) > CACHE:
            self.seen = {"": b""}
            fresh = words - self.seen.keys()
        odd = [w for w in fresh if not w.isprintable() or max(w) >= "\u0250" or "<|" in w]
        for w in fresh.difference(odd):
            self.seen[w] = self._simple(w)
        self.seen.update(zip(odd, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)), strict=True))


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts. The tokenizer never joins across a blank or a line feed, so words are encoded once and remembered."""
    encoder = load(path)
    split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
    encoder.learn({w for words in split for w in words})
    seen = encoder.seen
    return [np.frombuffer(b"".join([seen[w] for w in words]), "<u4") for words in split]


def cut_pieces(docs: DataFrame, path: str, capacity: int, with_ids: bool) -> DataFrame:
    def work(part: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("row_", "piece", "start", "length", "ids_crc32", "ids")}
        for row, ids in enumerate(encode_texts(values(part, "text"), path)):
            ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
            for n, start in enumerate(range(0, len(ids), capacity)):
                piece = ids[start : start + capacity]
                for c, v in zip(out, (row, n, start, len(piece), zlib.crc32(piece.tobytes()), piece.astype("int32")), strict=True):
                    out[c].append(v)
        return out

    return arrow_map(docs.select("doc_id", "text"), work, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids, keep=["doc_id"])


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and each bin's fill."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has exactly r left
    fill: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        room[r - n].append(b)
        free |= 1 << (r - n)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound that dual feasible functions give: each maps sizes so that no bin can exceed the capacity."""
    if not len(lengths):
        return 0
    size, count = np.unique(lengths, return_counts=True)
    best = int((size * count).sum())
    for k in size[size <= capacity // 2]:  # small items vanish, large ones fill a bin
        best = max(best, int((np.where(size > capacity - k, capacity, np.where(size < k, 0, size)) * count).sum()))
    bound = -(-best // capacity)
    for m in range(1, 31):  # rounding to multiples of 1/m, scaled by m * capacity to stay in integers
        scaled = size * (m + 1)
        mapped = np.where(scaled % capacity == 0, size * m, scaled // capacity * capacity)
        bound = max(bound, -(-int((mapped * count).sum()) // (m * capacity)))
    return bound


def _pack_group(pdf: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "row"])
    lengths = pdf["length"].to_numpy()
    bins, offsets, fill = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    gap = len(fill) - bound
    given = np.zeros(len(fill), bool)
    if not last:
        # the emptiest go: by the gap, and of bins with a fiftieth or more to spare up to a quarter of all; half of all at most
        spare = min(int((fill < capacity - capacity // 50).sum()), len(fill) // 4)
        most = max(8, 2 * gap + 1, spare) if gap else max(1, spare)
        given[np.argsort(fill, kind="stable")[: min(most, len(fill) // 2)]] = True
    return pd.DataFrame({"row": pdf["row"].to_numpy(), "length": lengths, "group": pdf["group"].to_numpy(), "bin": bins, "offset": offsets, "given": given[bins], "bins": len(fill), "bound": bound})


def _packer(capacity: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _pack_group(pdf, capacity, last)


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Sequence and offset of each piece (row, length), with the certificate of the group that placed it.

    Returns row, sequence_id, offset, group_bins and group_bound: the bins that the group's last packing
    took and the fewest that any could take. A full piece is a group of its own. Each round leaves at
    most half of the bins, so rounds grow with the logarithm of the input.
    """
    full = pieces.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("group_bins"), F.lit(1).cast("long").alias("group_bound"))
    done, pool, step = [full], pieces.where(F.col("length") < capacity).select("row", "length"), 0
    while True:
        n, tokens = pool.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = max(1, min(-(-n // group), tokens // (FEWEST * capacity)))
        pack = _packer(capacity, groups == 1)
        dealt = pool.withColumn("group", F.pmod(F.xxhash64("row", F.lit(step)), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInPandas(pack, "row long, length long, group long, bin long, offset long, given boolean, bins long, bound long"))
        sequence = F.shiftleft(F.lit(step + 1).cast("long"), 56) + F.shiftleft(F.col("group"), 24) + F.col("bin")
        done.append(packed.where("not given").select("row", sequence.alias("sequence_id"), "offset", F.col("bins").alias("group_bins"), F.col("bound").alias("group_bound")))
        if groups == 1:
            break
        pool, step = packed.where("given").select("row", "length"), step + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `capacity` tokens, an end id after each document.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, ids if asked for, sequence_id,
    offset, and the certificate group_bins, group_bound. Only documents longer than a sequence are
    cut. A null or empty text is the end id alone, so tables of tiny texts pack by tokens. Repeated
    rows are packed once each; an empty table gives no rows. Other columns are not read.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    pieces = materialize(cut_pieces(docs, path, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()))
    return pieces.join(pack_lengths(pieces, capacity).hint("shuffle_hash"), "row").drop("row")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
