"""Operator 1: secret scans with a battery of randomness tests.

Base spans come from three patterns. Beyond them, tokens of FLOOR and more encoding characters are
tested for randomness in the encoding they are inferred to use (one that fits none is cut at its odd
characters first, and its parts are tested; numbers alone are left to the base kind hex, since random
digits are no less likely as an ordinary number): chi-squared uniformity over its
alphabet, runs above and below its middle, and serial correlation, joined by Fisher's method. A
token that looks random is reported if it is also unlikely as ordinary text: the likelihood ratio
of the uniform law to the corpus's own letter frequencies bounds its p-value, and a weighted
Benjamini-Hochberg procedure over all tokens, with weights that grow with length, keeps false
discoveries below FDR. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import materialize, table
from sluice.llm.spans import SPANS, as_spans, blank, chars, hits, joined

TOKENS = "array<struct<start:int,end:int,body:string>>"
KEYS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LONG = KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
FLOOR = 12  # shorter tokens are not tested; README has the recall by length
TOKEN = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{FLOOR},}}+={{0,2}}"
ORDINARY = "(?<![A-Za-z])[A-Za-z]{12,}+"  # words whose letters give the corpus's frequencies
# inferred encodings in order: name, shape, alphabet (fixed values of the encodings)
_D, _L, _U = string.digits, string.ascii_lowercase, string.ascii_uppercase
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", _D + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _D + "ABCDEF"),
    ("upper", "^[A-Z]+$", _U),
    ("lower", "^[a-z]+$", _L),
    ("letters", "^[A-Za-z]+$", _U + _L),
    ("base32", "^[A-Z2-7]+$", _U + "234567"),
    ("base36", "^[0-9a-z]+$", _D + _L),
    ("BASE36", "^[0-9A-Z]+$", _D + _U),
    ("base62", "^[0-9A-Za-z]+$", _D + _L + _U),
    ("base64", "^[0-9A-Za-z+/]+$", _U + _L + _D + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", _U + _L + _D + "-_"),
]
FDR = 0.01
RANDOM_ENOUGH = 0.001  # the battery rejects tokens below this
SHARES = {"lower": 0.70, "upper": 0.05, "digit": 0.20, "other": 0.05}  # of symbols in ordinary identifiers
CAPITALS = SHARES | {"lower": SHARES["upper"], "upper": SHARES["lower"]}  # and in words of capitals
FINEST = 5000  # p-values are compared in hundredths of -log10, up to this


def _tail(z: Column) -> Column:
    """Upper tail of the normal law, for either sign."""
    a = F.abs(z)
    q = 0.5 * F.exp(-0.717 * a - 0.416 * a * a)
    return F.when(z >= 0, q).otherwise(1 - q)


def _alphabet(body: Column) -> Column:
    return F.coalesce(*[F.when(body.rlike(s), F.lit(a)) for _, s, a in ENCODINGS])


def _cut(tokens: Column, odd: str) -> Column:
    """Tokens (start, end, body) without an encoding, cut at odd characters; the last part keeps the end with its padding."""

    def parts(t: Column) -> Column:
        empty = F.struct(t["start"].alias("at"), F.array().cast(TOKENS).alias("out"))
        pieces = F.split(t["body"], odd, -1)
        one = lambda acc, x: F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end"), x.alias("body")))
        cut = F.aggregate(pieces, empty, lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], one(acc, x)).alias("out")), lambda acc: acc["out"])
        last = t["start"] + F.length(t["body"])
        return F.transform(cut, lambda x: F.struct(x["start"].alias("start"), F.when(x["end"] == last, t["end"]).otherwise(x["end"]).alias("end"), x["body"].alias("body")))

    return F.flatten(F.transform(tokens, lambda t: F.when(_alphabet(t["body"]).isNull(), parts(t)).otherwise(F.array(t))))


def _battery(tokens: Column) -> Column:
    """Tokens in a known encoding: span, length, alphabet size, sorted symbols, and Fisher's joint p-value of randomness."""
    body = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.regexp_replace(t["hit"], "=+$", "").alias("body")))
    body = _cut(_cut(body.cast(TOKENS), "/"), "[+_-]")
    body = F.filter(body, lambda t: (F.length(t["body"]) >= FLOOR) & t["body"].rlike("[A-Za-z]"))
    known = F.transform(body, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), chars(t["body"]).alias("chars"), _alphabet(t["body"]).alias("alphabet")))
    indexed = F.transform(known, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), F.array_join(F.array_sort(t["chars"]), "").alias("symbols"),
        F.length(t["alphabet"]).cast("double").alias("k"), F.size(t["chars"]).cast("double").alias("n"),
        F.transform(t["chars"], lambda c: F.position(c, t["alphabet"]).cast("double")).alias("idx"),
    ))

    def walk(t: Column) -> Column:
        middle = (t["k"] + 1) / 2
        zero = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("product"))
        return F.aggregate(t["idx"], zero, lambda acc, v: F.struct(
            v.alias("last"),
            (acc["turns"] + F.when((acc["last"] > middle) != (v > middle), 1.0).otherwise(0.0)).alias("turns"),
            (acc["product"] + F.coalesce((acc["last"] - middle) * (v - middle), F.lit(0.0))).alias("product"),
        ))

    def squares(t: Column) -> Column:
        return F.aggregate(F.array_distinct(t["idx"]), F.lit(0.0), lambda acc, v: acc + F.pow(F.size(F.filter(t["idx"], lambda x: x == v)).cast("double"), F.lit(2.0)))

    counted = F.transform(indexed, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["symbols"].alias("symbols"), t["k"].alias("k"), t["n"].alias("n"), squares(t).alias("sq"), walk(t).alias("walk")))

    def scored(t: Column) -> Column:
        df = t["k"] - 1
        chi2 = F.greatest(t["k"] / t["n"] * t["sq"] - t["n"], F.lit(1e-9))
        z_chi = (F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        z_runs = (t["walk"]["turns"] - (t["n"] - 1) / 2) / F.sqrt((t["n"] - 1) / 4)
        z_serial = t["walk"]["product"] / ((t["k"] * t["k"] - 1) / 12) / F.sqrt(t["n"] - 1)
        logs = F.log(_tail(z_chi)) + F.log(2 * _tail(F.abs(z_runs))) + F.log(2 * _tail(F.abs(z_serial)))
        half = -logs  # half of Fisher's statistic, six degrees of freedom
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["symbols"].alias("symbols"), t["k"].alias("k"), t["n"].alias("n"), (F.exp(-half) * (1 + half + half * half / 2)).alias("p_random"))

    return F.transform(counted, scored)


def _frequencies(scanned: DataFrame) -> list[dict[str, float]]:
    """Log of the chance of each symbol in ordinary text and in words of capitals, from the letters of all ordinary words: 26 sums reach the driver."""
    sums = scanned.agg(*[F.coalesce(F.sum(F.col("letters")[i]), F.lit(0)).alias(c) for i, c in enumerate(_L)]).first()
    total = sum(sums[c] for c in _L) + 26
    f = {c: (sums[c] + 1) / total for c in _L}

    def logs(shares: dict[str, float]) -> dict[str, float]:
        q = {c: shares["lower"] * f[c] for c in _L} | {c.upper(): shares["upper"] * f[c] for c in _L}
        q |= {c: shares["digit"] / 10 for c in _D} | {c: shares["other"] / 4 for c in "+/-_"}
        return {c: math.log(v) for c, v in q.items()}

    return [logs(SHARES), logs(CAPITALS)]


def _threshold(tokens: DataFrame) -> int:
    """Weighted Benjamini-Hochberg: the smallest level, in hundredths of -log10 p, at which false discoveries stay below FDR."""
    mean = tokens.agg(F.avg("weight"), F.count("*")).first()
    if not mean[1]:
        return FINEST + 1
    level = F.least(F.greatest(F.floor(100 * (F.col("evidence") + F.log10(F.col("weight") / mean[0]))), F.lit(0)), F.lit(FINEST))
    counts = {r["level"]: r["count"] for r in tokens.groupBy(level.cast("int").alias("level")).count().collect()}  # at most FINEST + 1 rows
    reached, best = 0, FINEST + 1
    for lv in range(FINEST, -1, -1):
        reached += counts.get(lv, 0)
        if reached and mean[1] * 10 ** (-lv / 100) / reached <= FDR:
            best = lv
    return best


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each document (doc_id, text): doc_id, base and extra (arrays of start, ord, end, kind).

    Offsets are in code points. A null text counts as empty and has no spans. Extra spans (kind random)
    never overlap base spans. Rows are independent apart from the corpus statistics; an empty table
    gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    t = F.col("text")
    assign = F.filter(hits(t, ASSIGN, ASSIGN_LONG, group=1), lambda x: F.length(x["value"]) >= 12)
    base = F.concat(as_spans(assign, "assign", 0), as_spans(hits(t, ACCESS), "access", 1), as_spans(hits(t, HEX), "hex", 2))
    words = F.lower(F.array_join(F.regexp_extract_all(t, F.lit(ORDINARY), F.lit(0)), ""))
    # tokens are searched for in what the base spans leave, so that none is held against each span
    found = rows.select("doc_id", "text", base.alias("base"), words.alias("words")).select("doc_id", "base", hits(blank(t, F.col("base")), TOKEN).alias("tokens"), "words")
    letters = F.array(*[(F.length("words") - F.length(F.translate("words", c, ""))).cast("long") for c in _L])
    # what is stored holds no token: its symbols are sorted
    scanned = materialize(found.select("doc_id", "base", _battery(F.col("tokens")).alias("tokens"), letters.alias("letters")))
    ordinary, capitals = (F.create_map(*[F.lit(x) for kv in logs.items() for x in kv]) for logs in _frequencies(scanned))

    def against(x: Column, law: Column) -> Column:
        return F.aggregate(chars(x["symbols"]), F.lit(0.0), lambda acc, c: acc - F.log(x["k"]) - F.element_at(law, c))

    def evidence(x: Column) -> Column:
        """-log10 of the bound on the chance that ordinary text gives such symbols; without a digit they may be a word of capitals."""
        per = against(x, ordinary)
        per = F.when(x["symbols"].rlike("[A-Z]") & ~x["symbols"].rlike("[0-9]"), F.least(per, against(x, capitals))).otherwise(per)
        return F.greatest(per / math.log(10), F.lit(0.0))

    weighed = F.transform("tokens", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["p_random"].alias("p_random"), F.log2(x["n"]).alias("weight"), evidence(x).alias("evidence")))
    scored = scanned.select("doc_id", "base", weighed.alias("tokens"))
    flat = scored.select(F.explode("tokens").alias("t")).select("t.*")
    level = _threshold(flat)
    mean = flat.agg(F.avg("weight")).first()[0] or 1.0
    kept = F.filter("tokens", lambda x: (x["p_random"] >= RANDOM_ENOUGH) & (F.floor(100 * (x["evidence"] + F.log10(x["weight"] / mean))) >= level))
    return scored.select("doc_id", "base", as_spans(kept, "random", 3).cast(SPANS).alias("extra"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"))
