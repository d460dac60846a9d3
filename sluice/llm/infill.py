"""Operator 11: fill-in-middle transformation over an indexable skip list.

A text is a sequence of units (lines, or code points). The bottom lane of the skip list has a link
per unit with its width in code points; every express lane above joins FAN links of the lane below
and carries their unit-width and code-point-width. A cut after a given number of units is found by
descending from the top lane, adding up both widths, in at most FAN steps a lane; the text is then
sliced at the code points reached. The output puts sentinels before prefix, suffix and middle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import arrow_map, table, values

FAN = 16  # links of one lane that a link of the next lane spans
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
SEED, RATE, SPM = 7, 100, 50  # of 100 documents: how many are cut, and how many of those put the suffix first

Lanes = list[tuple[np.ndarray, np.ndarray]]


def unit_widths(text: str, unit: str = "line") -> np.ndarray:
    """Code points of each unit; a line ends with its line feed, the last may have none."""
    if unit == "char":
        return np.ones(len(text), np.int64)
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    starts = np.r_[0, ends[:-1] if len(ends) and ends[-1] == len(data) else ends]
    return np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64) if len(data) else np.zeros(0, np.int64)


def build_lanes(widths: np.ndarray) -> Lanes:
    """(unit-widths, code-point-widths) of every lane, the bottom one first."""
    lanes = [(np.ones(len(widths), np.int64), widths)]
    while len(lanes[-1][0]) > FAN:
        at = np.arange(0, len(lanes[-1][0]), FAN)
        lanes.append(tuple(np.add.reduceat(w, at) for w in lanes[-1]))
    return lanes


def reach(lanes: Lanes, rank: int) -> int:
    """Code points of the first `rank` units."""
    node = units = chars = 0
    for unit_width, char_width in reversed(lanes):
        node *= FAN
        while node < len(unit_width) and units + unit_width[node] <= rank:
            units += int(unit_width[node])
            chars += int(char_width[node])
            node += 1
    return chars


def _transform(unit: str, rate: int, spm: int, sentinels: tuple[str, str, str]) -> Callable[[pa.RecordBatch], dict]:
    p, s, m = sentinels

    def one(text: str, h: list[int]) -> tuple:
        lanes = build_lanes(unit_widths(text, unit))
        n = len(lanes[0][0])
        if not text or any(x in text for x in sentinels) or h[2] % 100 >= rate:
            return n, "plain", None, None, text
        first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = reach(lanes, first), reach(lanes, second)
        if h[3] % 100 < spm:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    def work(part: pa.RecordBatch) -> dict:
        rows = [one(t or "", h) for t, h in zip(values(part, "text"), values(part, "hashes_"), strict=True)]
        return dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), zip(*rows, strict=True) if rows else [()] * 5, strict=True))

    return work


def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned numbers of a document: the first 8-digit groups of the SHA-256 of seed:doc_id (a null id: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS, keep: list[str] | None = None) -> DataFrame:
    """Cut the text of every document (doc_id, text) in three and reorder it for infilling.

    Returns the columns `keep` (default: all but text) and n (units), form, prefix_chars, middle_chars
    and output. form is plain (output is the text, widths are null) for an empty text, one that holds a
    sentinel, and those that the rate leaves out; else spm or psm. A null text counts as empty. Rows
    are independent: repeated rows give equal rows, an empty table gives none. Columns of the input
    named like an added one are replaced.
    """
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [*added, "text"]]
    held = {c: f"k{i}_" for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(c).alias(k) for c, k in held.items()], "text", draws(F.col("doc_id"), seed).alias("hashes_"))
    schema = "n long, form string, prefix_chars long, middle_chars long, output string"
    made = arrow_map(rows, _transform(unit, rate, spm, sentinels), schema, keep=list(held.values()))
    return made.select(*[F.col(k).alias(c) for c, k in held.items()], *added)


def restore(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle was given, from its output and form alone."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_skip_list_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and digests of every document, with its text rebuilt from the output."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore("output", "form"), 256).alias("restored_sha256"))


_UNITS = "regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+')"
_CUT = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, {_UNITS} AS u, len({_UNITS}) AS n, {", ".join(f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, t, {_CUT("1", "a")} AS p, {_CUT("a + 1", "b")} AS m, {_CUT("b + 1", "n")} AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
