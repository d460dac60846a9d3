"""Operator 3: BPE encoding and decoding, with tree concatenation for long unsplit text.

Most texts are encoded whole, in the task that reads them. Texts that are long or hold a long
unsplit stretch (one that the split pattern leaves in one piece) go another way: they are cut
where the split pattern cannot see across, long stretches are cut further into leaves, and all
units are encoded in parallel. The leaves of a stretch are then joined pairwise in a tree: a window
around each join is encoded anew and grown until its outer tokens are those that both sides had.
Neighbouring tokens of a valid BPE encoding decide its validity, so the joined ids are exact.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import arrow_map, byte_symbols, table, values

TOKENIZER = "byte_bpe_50k.json"
SEGMENT = 65_536  # characters encoded in one call
LEAF = 2_048  # bytes of a leaf of an unsplit stretch
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def load(path: str) -> tuple[tiktoken.Encoding, list[str], regex.Pattern]:
    """The encoder of a byte-level tokenizer file, decimal strings of its ids, and its special tokens as a pattern."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = byte_symbols()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return enc, [str(i) for i in range(enc.n_vocab)], regex.compile("|".join(map(regex.escape, special)) or r"(?!)")


def encode(text: str, enc: tiktoken.Encoding) -> list[int]:
    return enc.encode(text, allowed_special="all") if "<|" in text else enc.encode_ordinary(text)


def join_ids(left: list[int], right: list[int], enc: tiktoken.Encoding) -> list[int]:
    """The encoding of left's text followed by right's, as one unsplit stretch."""
    if not left or not right:
        return left or right
    k = 2
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        window = enc._encode_single_piece(enc.decode_bytes(left[-a:] + right[:b]))
        if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
            return left[: len(left) - a] + window + right[b:]
        k *= 2


def join_tree(leaves: list[list[int]], enc: tiktoken.Encoding) -> list[int]:
    while len(leaves) > 1:
        leaves = [join_ids(leaves[i], leaves[i + 1], enc) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


def cut_segments(text: str, size: int = SEGMENT) -> list[str]:
    """Cut just before white space that follows something else; no piece of the split pattern spans such a place."""
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while at > start and not (text[at] in " \n" and not text[at - 1].isspace()):
            at -= 1
        if at == start:
            at = start + size
            while at < len(text) and not (text[at] in " \n" and not text[at - 1].isspace()):
                at += 1
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def units(text: str, special: regex.Pattern, leaf: int = LEAF) -> list[tuple[int, bytes, bool]]:
    """(unit, bytes, whether a leaf): leaves with the same unit form one unsplit stretch."""
    out: list[tuple[int, bytes, bool]] = []
    for segment in cut_segments(text):
        if not regex.search(rf"\S{{{leaf // 4}}}|\s{{{leaf // 4}}}", segment):
            out.append((len(out), segment.encode(), False))
            continue
        at = 0
        for stop in [*special.finditer(segment), None]:
            end = stop.start() if stop else len(segment)
            for piece in regex.finditer(PATTERN, segment[at:end]):
                data, unit = piece.group().encode(), len(out)
                out += [(unit, data[i : i + leaf], True) for i in range(0, len(data), leaf)]
            if stop:
                out.append((len(out), stop.group().encode(), False))
                at = stop.end()
    return out


def _digest(ids: list[int], enc: tiktoken.Encoding, names: list[str]) -> tuple[int, str, str]:
    decoded = enc.decode_bytes(ids).decode("utf-8", "replace").encode()
    return len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _finish(ids: list[list[int]], enc: tiktoken.Encoding, names: list[str], digest: bool) -> dict:
    if digest:
        n, a, b = zip(*(_digest(x, enc, names) for x in ids), strict=True) if ids else ((), (), ())
        return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
    return {"ids": ids, "decoded": [enc.decode_bytes(x).decode("utf-8", "replace") for x in ids]}


def _encode_whole(path: str, digest: bool) -> Callable[[pa.RecordBatch], dict]:
    def work(part: pa.RecordBatch) -> dict:
        enc, names, _ = load(path)
        return _finish([encode(t, enc) if t else [] for t in values(part, "text")], enc, names, digest)

    return work


def _split(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    _, _, special = load(path)
    for pdf in batches:
        for row, text in zip(pdf["row"], pdf["text"], strict=True):
            found = units(text, special)
            yield pd.DataFrame({"row": row, "unit": [u for u, _, _ in found], "leaf": range(len(found)), "data": [d for _, d, _ in found], "raw": [r for _, _, r in found]})


def _encode_units(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    enc, _, _ = load(path)
    for pdf in batches:
        ids = [enc._encode_single_piece(d) if raw else encode(d.decode(), enc) for d, raw in zip(pdf["data"], pdf["raw"], strict=True)]
        yield pdf[["row", "unit", "leaf"]].assign(ids=ids)


def _join_units(pdf: pd.DataFrame, path: str, digest: bool) -> pd.DataFrame:
    enc, names, _ = load(path)
    pdf = pdf.sort_values("leaf")
    ids: list[int] = []
    for _, leaves in pdf.groupby("unit", sort=True)["ids"]:
        ids += join_tree([list(map(int, x)) for x in leaves], enc)
    return pd.DataFrame({"row": pdf["row"].iloc[:1].to_numpy()} | _finish([ids], enc, names, digest))


def encode_documents(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """Encode and decode the text of every document (doc_id, text).

    Returns doc_id, ids array<int>, decoded string; with digest: doc_id, n_tokens, ids_sha256,
    decoded_sha256. A null text counts as empty and gives no ids. Rows are independent: repeated
    rows give equal rows, an empty table gives none. Other columns are not read.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long_ = (F.length("text") > SEGMENT) | F.col("text").rlike(rf"\S{{{LEAF // 4}}}|\s{{{LEAF // 4}}}")
    whole = arrow_map(rows.where(~long_), _encode_whole(path, digest), out, keep=["doc_id"])
    # identity of a row: its id and text; repeated rows are numbered out by their count
    far = rows.where(long_).groupBy("doc_id", "text").count().withColumn("row", F.struct("doc_id", F.sha2("text", 256).alias("h"), "count"))
    far = far.select(F.to_json("row", {"ignoreNullFields": "false"}).alias("row"), "text")
    cut = far.mapInPandas(partial(_split, path=path), "row string, unit int, leaf int, data binary, raw boolean")
    coded = cut.repartition("row", "leaf").mapInPandas(partial(_encode_units, path=path), "row string, unit int, leaf int, ids array<int>")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return _join_units(pdf, path, digest)

    joined = coded.groupBy("row").applyInPandas(join, f"row string, {out}")
    key = F.from_json("row", "doc_id long, h string, count long")
    names = [c.split()[0] for c in out.split(", ")]
    again = joined.select(key.alias("k"), *names).select(F.col("k.doc_id").alias("doc_id"), *names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("k.count"))).alias("n_"))
    return whole.unionByName(again.drop("n_"))


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document, as digests."""
    return encode_documents(table(spark, sf_dir, "documents"), digest=True)
