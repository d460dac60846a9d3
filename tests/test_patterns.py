"""Linted patterns against their SQL where the given tables have no such texts, and the operator's own reasons."""

import duckdb
import pytest

from sluice.operators import patterns
from sluice.plans import queries_a

TEXTS = [
    ("digits", "4111 - 34."), ("digits", "Word here"), ("empty", ""), ("null", None), (None, "Word here."), ("_own", "Word there"), ("_always", "A word"), ("", "Word"),
    ("dotted", "İstanbul x"), ("sigma", "ΑΣ y"), ("sigma", "ασα"), *((f"{c}{n}", c * n) for c in "xü" for n in (32, 62, 66)),
]
LONG = [(f"{c}{n}", c * n) for c in "xü" for n in (2043, 2044, 2045, 2047, 2048, 2049)]


@pytest.mark.parametrize("texts", [TEXTS, LONG], ids=["odd", "long"])
def test_lint_matches_sql(spark, tmp_path, texts):
    """Words that are missing, empty or long, and sources of any name or none."""
    spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = queries_a.QUERIES["o21_lint_patterns"](spark, str(tmp_path))
    want = con.sql(queries_a.SQL["o21_lint_patterns"]).select(*df.columns).fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert len(want) == 3 * len({s for s, _ in texts})


def test_merged_case_is_the_registered_one(spark, tmp_path):
    """Words are lowered as the markers they are compared with."""
    spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(["x", "İstanbul", "ΑΣ"])], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["pos"]: (r["pattern"], r["outcome"]) for r in queries_a.QUERIES["o24_merge_markers"](spark, str(tmp_path)).collect()}
    assert got == {0: ("x", "unknown"), 1: ("istanbul", "duplicate"), 2: ("ασ", "duplicate")}


@pytest.mark.parametrize(
    "stem, given, reasons",
    [
        ("a", ["", " ", "a(b", "(a+)+", r"(a)\1", "ab"], ["empty", "empty", "does not compile", "nested repetition", "back reference", None]),
        ("b", ["x" * 2049, "(" + "x" * 2043 + "+)+", "(" + r"\x" * 1021 + "+)+", "(" + r"a\+" * 600 + ")+", r"(a\\+)+"], ["too long", "nested repetition", "does not compile", None, "nested repetition"]),
        (None, ["ab", "x" * 131060], [None, "too long"]),
        (None, ["ab", "x" * 131061], ["set too large", "too long"]),
    ],
)
def test_lint_reasons(spark, stem, given, reasons):
    df = spark.createDataFrame([(stem, p) for p in given], "stem string, pattern string")
    got = {r["pattern"]: (r["stem"], r["reason"]) for r in patterns.lint_patterns(df).collect()}
    assert got == {p: (stem, reason) for p, reason in zip(given, reasons, strict=True)}
