"""Inputs of the operators, derived from the driver's tables, in Spark and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-01"
GLOBS = ["tests/**", "**/*.spec.*"]
MARKERS = [
    ("_always", 0, "licen[sc]e"),
    ("_always", 1, "eranea"),
    ("_private_infra", 0, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("alpha", 0, "hathis"),
    ("alpha", 1, "thatthe"),
    ("beta", 0, "queaux"),
    ("gamma", 0, "keitung"),
    ("gamma", 1, "ciónes"),
]

REPO_COLUMNS = {  # name: (Spark, DuckDB)
    "class": ("CASE n % 4 WHEN 0 THEN 'public-eligible' WHEN 1 THEN 'private-strict' WHEN 2 THEN 'customer-coupled' ELSE 'scratch' END",) * 2,
    "class_explicit": ("n % 5 <> 0",) * 2,
    "engagements": ("CASE n % 3 WHEN 0 THEN array('alpha') WHEN 1 THEN array('beta', 'gamma') ELSE cast(array() AS array<string>) END", "CASE n % 3 WHEN 0 THEN ['alpha'] WHEN 1 THEN ['beta', 'gamma'] ELSE CAST([] AS VARCHAR[]) END"),
    "visibility": ("CASE WHEN n % 5 = 0 THEN 'public' ELSE 'private' END",) * 2,
    "remote_url": (
        "CASE n % 5 WHEN 0 THEN 'git@github.com-work:Org' || (n % 6) || '/' || repo || '.git' WHEN 1 THEN 'https://github.com/org' || (n % 6) || '/' || repo WHEN 2 THEN 'https://git.corp.example/alpha/' || repo || '.git' WHEN 3 THEN NULL ELSE 'ssh://git@github.com/beta-co/' || repo || '.git' END",
    ) * 2,
    "public": ("(n % 4 = 0) OR (n % 5 = 0)",) * 2,
    "exempt_paths": ("CASE WHEN n % 2 = 0 THEN NULL ELSE array('docs/**', ' docs/** ', 'tests/**') END", "CASE WHEN n % 2 = 0 THEN NULL ELSE ['docs/**', ' docs/** ', 'tests/**'] END"),
    "name": ("'Name ' || n",) * 2,
    "ended": ("CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 'open' WHEN 2 THEN '2023-01-01' ELSE '2024-03-01' END",) * 2,
}
PATH = "(CASE WHEN doc_id % 7 = 0 THEN 'tests/fixtures/' WHEN doc_id % 11 = 0 THEN 'docs/' ELSE 'src/' END) || doc_id || '.txt'"

REPOS_SQL = (
    "repos0 AS (SELECT DISTINCT source AS repo, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n FROM documents),\n"
    "repos AS (SELECT repo, n, " + ", ".join(f"{q} AS {c}" for c, (_, q) in REPO_COLUMNS.items()) + " FROM repos0)"
)
FILES_SQL = f"files AS (SELECT source AS repo, {PATH} AS path, sha256(text) AS blob, text, doc_id FROM documents)"
LINES_SQL = FILES_SQL + ",\nlines AS (SELECT repo, path, blob, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files)"
MARKERS_SQL = "markers(stem, ord, pattern) AS (VALUES " + ", ".join(f"('{s}', {o}, '{p}')" for s, o, p in MARKERS) + ")"
ORDER_SQL = "CASE stem WHEN '_always' THEN 0 WHEN '_private_infra' THEN 1 ELSE 2 END"
SCOPED_SQL = (
    REPOS_SQL + ",\n" + MARKERS_SQL + ",\nscoped AS (SELECT repo, stem, ord, pattern, " + ORDER_SQL + " AS o FROM repos, markers WHERE stem = '_always' OR (stem = '_private_infra' AND public)"
    " OR (stem NOT IN ('_always', '_private_infra') AND NOT (class IN ('customer-coupled', 'scratch') AND list_contains(engagements, stem)))),\n"
    "sets AS (SELECT repo, string_agg('(?:' || pattern || ')', '|' ORDER BY o, stem, ord) AS combined, coalesce(string_agg('(?:' || pattern || ')', '|' ORDER BY o, stem, ord) FILTER (stem <> '_always'), '') AS strict,"
    " coalesce(string_agg('(?:' || pattern || ')', '|' ORDER BY o, stem, ord) FILTER (stem = '_always'), '') AS exemptible FROM scoped GROUP BY repo)"
)
PREVIEW_SQL = "CASE WHEN length({0}) < 4 THEN '[redacted]' ELSE substr({0}, 1, 3) || '***' || length({0}) END"
ID_SQL = "{0} || '/' || substr(sha256({1}), 1, 12)"


def hits_sql(exempt: str, lines: str = "lines") -> str:
    """CTEs up to hits: the first match of each line and the pattern it is attributed to."""
    return f"""{SCOPED_SQL},
{LINES_SQL},
chosen AS (SELECT l.*, {exempt} AS path_exempt, CASE WHEN {exempt} THEN s.strict ELSE s.combined END AS re FROM {lines} l JOIN sets s USING (repo)),
matched AS (SELECT *, regexp_extract(line, '(?i)' || re) AS m FROM chosen WHERE re <> '' AND NOT regexp_matches(line, '(?i)leak-scan:\\s*allow\\b')),
texts AS (SELECT DISTINCT repo, m FROM matched WHERE m <> ''),
named AS (SELECT repo, m, arg_min(stem, k) AS engagement, arg_min({ID_SQL.format('stem', 'pattern')}, k) AS pattern_id FROM (SELECT t.repo, t.m, s.stem, s.pattern, (s.o, s.stem, s.ord) AS k FROM texts t JOIN scoped s ON s.repo = t.repo AND regexp_matches(t.m, '(?i)' || s.pattern)) GROUP BY repo, m),
hits AS (SELECT h.repo, h.path, h.blob, h.doc_id, h.line_no, strpos(h.line, h.m) AS "column", {PREVIEW_SQL.format('h.m')} AS preview, n.engagement, n.pattern_id, h.path_exempt FROM matched h LEFT JOIN named n ON n.repo = h.repo AND n.m = h.m WHERE h.m <> '')"""


EXEMPT_SQL = "regexp_matches(path, '^tests/.*$|^(?:[^/]+/)*[^/]*\\.spec\\.[^/]*$')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a file too small to be split gives each core a part (a large table has more parts already)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages", "conversations", "embeddings") and df.rdd.getNumPartitions() < cores else df


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "documents").selectExpr("source AS repo").distinct().selectExpr("repo", "try_cast(regexp_extract(repo, '([0-9]+)$', 1) AS int) AS n")
    return base.selectExpr("repo", "n", *[f"{q} AS {c}" for c, (q, _) in REPO_COLUMNS.items()])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("source AS repo", f"{PATH} AS path", "sha2(text, 256) AS blob", "text", "doc_id")


def markers(spark: SparkSession) -> DataFrame:
    """The deny list of the scanning queries, in the form that a registry gives."""
    return spark.createDataFrame(MARKERS, "stem string, ord int, pattern string")


WORDS = r"[\p{L}]+"
TERMS_SQL = (
    REPOS_SQL + ",\nwords AS (SELECT source AS repo, lower(regexp_extract(text, '[\\p{L}]+')) AS first_word, lower(regexp_extract(text, '([\\p{L}]+)[^\\p{L}]*$', 1)) AS last_word FROM documents),\n"
    "terms AS (SELECT repo, min(first_word) AS a, max(first_word) AS b, min(last_word) AS c FROM words GROUP BY repo),\n"
    "own AS (SELECT repo AS id, 0 AS ord, a AS pattern FROM terms UNION ALL SELECT repo, 1, b FROM terms UNION ALL SELECT repo, 2, c || '.*' || a FROM terms),\n"
    "engagements AS (SELECT repo AS id, name, ended, engagements AS unused, TRY_CAST(ended AS DATE) IS NULL OR TRY_CAST(ended AS DATE) > DATE '2023-06-01' AS active FROM repos),\n"
    "all_markers AS (SELECT id AS stem, ord, pattern FROM own UNION ALL SELECT stem, ord, pattern FROM (VALUES ('_always', 0, 'licen[sc]e'), ('_private_infra', 0, 'corp\\.example')) v(stem, ord, pattern)),\n"
    "rendered AS (SELECT * FROM all_markers WHERE stem IN ('_always', '_private_infra') OR stem IN (SELECT id FROM engagements WHERE active))"
)


def engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository as an engagement of its own."""
    return repos(spark, sf_dir).selectExpr("repo AS id", "name", "ended", "array(repo) AS repos")


def low(text: str) -> str:
    """Lower case one character to one, as the SQL has it: no dot of its own after İ's i, no other sigma at an end."""
    return f"lower(translate({text}, 'İΣ', 'iσ'))"


def own_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers (id, ord, pattern): the first and last first words, and the first last word, of each repository's documents."""
    first, last = low(r"regexp_extract(text, '[\\p{L}]+', 0)"), low(r"regexp_extract(text, '([\\p{L}]+)[^\\p{L}]*$', 1)")
    w = read(spark, sf_dir, "documents").selectExpr("source AS id", f"{first} AS f", f"{last} AS l")
    t = w.groupBy("id").agg(F.min("f").alias("a"), F.max("f").alias("b"), F.min("l").alias("c"))
    return t.selectExpr("id", "inline(array(named_struct('ord', 0, 'pattern', a), named_struct('ord', 1, 'pattern', b), named_struct('ord', 2, 'pattern', c || '.*' || a)))")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """own_terms, and the markers of no repository."""
    fixed = spark.createDataFrame([("_always", 0, "licen[sc]e"), ("_private_infra", 0, r"corp\.example")], "id string, ord int, pattern string")
    return own_terms(spark, sf_dir).unionByName(fixed)
