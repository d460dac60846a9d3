"""Suggested markers against their SQL where the given tables have no such texts."""

import duckdb
import pytest

from sluice.plans import queries_b

WORDS = ["straße", "ﬁn", "ŉa", "ΑΣΑΣ", "ʰΣ", "Σ", "ΐΣ", "ᾳΣa", "İX", "Kelvin", "ǰ", "ﬓ", "ẞ", "ɤƛ", "Muller", "a"]
TEXTS = [None, "", "12 - 34", " \n", *WORDS, *(f"1 {w}, x {v}.\n" for w in WORDS for v in ("ß", "ΟΔΟΣ", "ab"))]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Every text as every kind of token, below zero too, at low and high confidence, in every language."""
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, text, lang) for k, text in enumerate(TEXTS) for n, lang in enumerate(("de", "es", "fr", "en")) for i in range(100 + 66 * (4 * k + n), 118 + 66 * (4 * k + n))]
    rows += [(-i, text, "en") for i, text in enumerate(TEXTS, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d, rows


def compare(spark, d, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    df = queries_b.QUERIES[name](spark, d)
    want = con.sql(queries_b.SQL[name]).select(*df.columns).fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_synthesize_markers(spark, odd):
    """Case by Unicode's full mapping: ß becomes SS, which is a ticket prefix."""
    d, rows = odd
    got = compare(spark, d, "o85_synthesize_markers")
    text = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    assert {r[3] for r in got if r[2] == "ticket-prefix" and text[r[0]] == "straße"} == {r"\bSTRASSE-[0-9]+\b"}


def test_filter_existing(spark, odd):
    """Tokens are compared in that case too, and a missing token among the registered ones hides nothing."""
    d, rows = odd
    got = compare(spark, d, "o87_filter_existing")
    lang = {i: x for i, _, x in rows}
    assert {"fr", "en"} <= {lang[i] for i, _ in got} and "de" not in {lang[i] for i, token in got if token is not None}


def test_accept_markers(spark, odd):
    """Own names count in any case by the same mapping, and a missing one hides nothing."""
    d, rows = odd
    got = compare(spark, d, "o89_accept_markers")
    lang = {i: x for i, _, x in rows}
    assert "en" in {lang[i] for i, *_ in got} and "fr" not in {lang[i] for i, token, _ in got if token is not None}
