"""Sweeps over a corpus that report each hit once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import strip
from sluice.operators.joins import few

MAX_NEW = 1000
ORG = r"(?i)\borg:(\S+)"  # in any case, wherever a word begins: one pattern for the rule, the filter and the phrase


def validate_queries(queries: DataFrame) -> DataFrame:
    """O53. Queries (pos, name, query, …) with the first rule they break, or null. A name of blanks is a name; either quote joins words."""
    place = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    q = F.col("query")
    rest = strip(F.regexp_replace(q, rf"(?s)\A(.*?){ORG}", "$1"))  # without the first filter
    issue = (
        F.when(F.coalesce("name", F.lit("")) == "", "empty name")
        .when(place > 1, "duplicate name")
        .when(F.coalesce(q, F.lit("")) == "", "empty query")
        .when(~q.rlike(ORG), "no org filter")
        .when(~q.rlike("[\"']") & rest.rlike(r"\s"), "bare words")
    )
    return queries.withColumn("issue", issue)


def phrase(query: Column | str) -> Column:
    """What a query looks for: its quoted phrase, or what is left without the filter."""
    query = F.col(query) if isinstance(query, str) else query
    quoted = F.coalesce(F.nullif(F.regexp_extract(query, '"([^"]+)"', 1), F.lit("")), F.regexp_extract(query, "'([^']+)'", 1))
    return F.lower(F.when(quoted != "", quoted).otherwise(strip(F.regexp_replace(query, ORG, " "))))


def sweep(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """O54. Lines (org, repo, path, line_no, line) that hold a query's phrase, without excluded orgs and repos."""
    q = queries.select("name", phrase("query").alias("phrase"), F.lower(F.regexp_extract("query", ORG, 1)).alias("org"), "exclude_org", "exclude_repo")
    pairs = corpus.join(few(q), "org").where(F.contains(F.lower("line"), F.col("phrase")))
    inside = ~F.coalesce(F.array_contains("exclude_org", F.col("org")), F.lit(False)) & ~F.coalesce(F.array_contains("exclude_repo", F.col("repo")), F.lit(False))
    return pairs.where(inside).select("name", "org", "repo", "path", "line_no")


def hit_key(name: str = "name", repo: str = "repo", path: str = "path", line: str = "line_no") -> Column:
    """O55."""
    return F.concat_ws("|", F.lit("v1"), name, repo, path, F.coalesce(F.col(line).cast("string"), F.lit("")))


def new_hits(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """O55. Candidates not seen before, once each."""
    return candidates.withColumn("hit_key", hit_key()).join(seen.select("hit_key"), "hit_key", "left_anti").dropDuplicates(["hit_key"])


def cap_per_query(hits: DataFrame, cap: int = MAX_NEW) -> DataFrame:
    """O56. The first `cap` new hits of each query in order of key, and whether there were more."""
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("hit_key")))
    more = hits.groupBy("name").agg((F.count("*") > cap).alias("truncated"))
    return ranked.where(F.col("place") <= cap).join(more, "name")


def _kept(days: int, as_of: str) -> Column:
    if days < 0:
        raise ValueError("days must not be negative")
    return F.col("first_seen").isNull() | (F.col("first_seen") >= F.date_sub(F.to_date(F.lit(as_of)), days))


def prune_seen(seen: DataFrame, days: int, as_of: str) -> DataFrame:
    """O58. Entries as old as `days` at most, and undated ones."""
    kept = _kept(days, as_of)
    return seen.where(kept)


def prune_counts(seen: DataFrame, days: int, as_of: str) -> DataFrame:
    """O58. How many entries stay and how many go: one row (kept, pruned)."""
    kept = F.count_if(_kept(days, as_of))
    return seen.agg(kept.alias("kept"), (F.count("*") - kept).alias("pruned"))


def sweep_summary(queries: DataFrame, candidates: DataFrame, fresh: DataFrame, status: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """O59. Per query: its hits, new ones and status; then the run as a whole. Queries without hits stay.

    status (name, ok, throttled) tells how each query went; a query not listed went well. degraded: a
    query failed. total_new: new hits of all queries. runs (run, started) are the runs before this
    one; previous_run is when the latest of them began, null for the first.
    """
    total = candidates.groupBy("name").agg(F.count("*").alias("total"))
    new = fresh.groupBy("name").agg(F.count("*").alias("new"), F.max("truncated").alias("truncated"))
    rows = queries.select("name").join(total, "name", "left").join(new, "name", "left").join(status, "name", "left")
    ok, added = F.coalesce("ok", F.lit(True)), F.coalesce("new", F.lit(0))
    throttled = F.coalesce("throttled", F.lit(False)) if "throttled" in status.columns else F.lit(False)
    before = runs.agg(F.max_by("started", "run").alias("at")).first()["at"] if runs is not None else None  # one value
    whole = Window.partitionBy()  # a row a query: tens
    return rows.select(
        "name", ok.alias("ok"), throttled.alias("throttled"), F.coalesce("total", F.lit(0)).alias("total"), added.alias("new"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
        F.max(~ok).over(whole).alias("degraded"), F.sum(added).over(whole).alias("total_new"), F.lit(before).cast("timestamp").alias("previous_run"),
    )
