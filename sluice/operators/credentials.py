"""Shapes of credentials in whole texts. The shapes are our own reading of public token formats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public formats. PEM headers are put together at run time, so that no file holds one.
_DASH = "-" * 5
SHAPES = {
    "GITHUB_TOKEN": r"\b(?:gh[sopur]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})",
    "JWT": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "PEM_AS_HEX": (_DASH + "BEGIN ").encode().hex(),
    "PEM_HEADER": _DASH + r"BEGIN (?:RSA |EC |OPENSSH |ENCRYPTED |DSA )?PRIVATE KEY" + _DASH,
    "ASSIGNED_HEX": r"(?:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?[0-9a-f]{32,}",
    "AWS_KEY": r"\bAKIA[A-Z0-9]{16}\b",
}
ANY = "|".join(f"(?:{s})" for s in SHAPES.values())


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shapes = {k: re.compile(s, re.I) for k, s in SHAPES.items()}
    for pdf in batches:
        rows = []
        for text_id, text in zip(pdf["text_id"], pdf["text"], strict=True):
            for kind, shape in shapes.items():
                for m in shape.finditer(text):
                    rows.append((text_id, kind, len(text[: m.start()].encode("utf-16-le")) // 2, len(m[0].encode("utf-16-le")) // 2))
        yield pd.DataFrame(rows, columns=["text_id", "kind", "offset", "length"])


def scan_credentials(texts: DataFrame) -> DataFrame:
    """O40. Every credential shape in texts (text_id, text): kind, UTF-16 offset and length, never the value.

    A native match thins the texts; only those that hold a shape reach the Arrow stage.
    """
    return texts.select("text_id", "text").where(F.col("text").rlike(f"(?i){ANY}")).mapInPandas(_find, "text_id string, kind string, offset int, length int")


def summarise(hits: DataFrame) -> DataFrame:
    """O41. Distinct sorted kinds and the count of each text."""
    return hits.groupBy("text_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n"))


NO_PATTERNS = "NO_MARKER_PATTERNS"


def published_audit(files: DataFrame, marker_hits: DataFrame, armed: DataFrame) -> DataFrame:
    """O70. Findings in package contents (package, path, text) by kind: marker hits (package, path) and credential shapes.

    A package without any marker pattern in force (armed lists those that have some) gets an
    informational row, so that its silence is not taken for a clean result; credential shapes are
    looked for in it all the same.
    """
    texts = files.select(F.concat_ws("\x1f", "package", "path").alias("text_id"), "text")
    part = lambda i: F.split("text_id", "\x1f")[i]
    shapes = scan_credentials(texts).select(part(0).alias("package"), part(1).alias("path"), F.col("kind").alias("what"))
    found = marker_hits.select("package", "path", F.lit("MARKER").alias("what")).unionByName(shapes).groupBy("package", "what").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))
    bare = files.select("package").distinct().join(armed.select("package"), "package", "left_anti").select("package", F.lit(NO_PATTERNS).alias("what"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("files"))
    return found.withColumn("informational", F.lit(False)).unionByName(bare.withColumn("informational", F.lit(True)))
