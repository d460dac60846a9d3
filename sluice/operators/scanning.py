"""Scanning lines, files, diffs and histories for deny-set patterns."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import pattern_id, path_matches, redact
from sluice.operators.automaton import pattern_key, with_candidates
from sluice.operators.patterns import ALWAYS, assemble_deny_sets
from sluice.sources.files import explode_lines, parse_diffs

ALLOW = r"(?i)leak-scan:\s*allow\b"

def _matches(text: Column, pattern: Column) -> Column:
    return F.rlike(text, F.concat(F.lit("(?iu)"), pattern))


def allowed_by_comment(line: Column | str, token: str = ALLOW) -> Column:
    """O34. Whether a line carries the allow token."""
    return (F.col(line) if isinstance(line, str) else line).rlike(token)


def choose_regex(lines: DataFrame, globs: list[str]) -> DataFrame:
    """O30. Whether a line's path (null: unknown) is exempt, decided before any match."""
    return lines.withColumn("path_exempt", path_matches("path", globs) if "path" in lines.columns else F.lit(False))


def _candidates(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (repo, found, …) with `candidates`: the patterns (stem, pattern) of the repo's set to try, in the set's order."""
    own = F.filter("patterns", lambda p: F.array_contains("found", pattern_key(p["stem"], p["pattern"])))
    return rows.join(sets.select("repo", "patterns"), "repo").withColumn("candidates", own).drop("patterns", "found")


def scan_lines(lines: DataFrame, deny_sets: DataFrame, globs: list[str] | None = None, allow_token: str | None = ALLOW) -> DataFrame:
    """O29, O30, O34. First match of each line (repo, path, line_no, line) in its repo's deny set (repo, patterns).

    One automaton over the patterns of all sets picks the lines worth trying and the patterns to try
    on each; only those lines meet their repo's set, by a join that needs no broadcast. A line's match
    starts where the first of its patterns does, and is that of the first such pattern in the set's
    order. Always patterns are not tried on exempt paths. Returns the columns of lines, path_exempt,
    match, column and the candidates of the line (stem, pattern), for suppress_known and attribute.
    """
    out = lines.columns
    tried = _candidates(with_candidates(lines, "line", deny_sets.select(F.inline("patterns"))), deny_sets)
    rows = choose_regex(tried.where(F.size("candidates") > 0), globs or [])
    if allow_token:
        rows = rows.where(~allowed_by_comment("line", allow_token))
    place = lambda p, i: F.struct(F.regexp_instr("line", F.concat(F.lit("(?iu)"), p["pattern"])).alias("at"), i.alias("i"))
    usable = rows.withColumn("usable", F.filter("candidates", lambda p: ~(F.col("path_exempt") & (p["stem"] == ALWAYS))))
    first = usable.withColumn("first", F.array_min(F.filter(F.transform("usable", place), lambda x: x["at"] > 0))).where("first is not null")
    regex = F.concat(F.lit("(?iu)"), F.col("usable")[F.col("first.i")]["pattern"])
    hit = first.withColumn("match", F.call_function("regexp_extract", F.col("line"), regex, F.lit(0))).where("match <> ''")
    return hit.select(*out, "path_exempt", "match", F.col("first.at").alias("column"), "candidates")


def attribute(hits: DataFrame, scoped: DataFrame) -> DataFrame:
    """O32. Stem and id of the first pattern, in the set's order, that matches the matched text; null where none does.

    Hits of scan_lines carry the patterns that their line can match; others (repo, match) get their
    repo's whole set from scoped. Either way hits are read once.
    """
    if "candidates" not in hits.columns:
        hits = hits.join(assemble_deny_sets(scoped).select("repo", F.col("patterns").alias("candidates")), "repo", "left")
    named = hits.withColumn("named_", F.get(F.filter("candidates", lambda p: _matches(F.col("match"), p["pattern"])), F.lit(0)))
    return named.withColumn("engagement", F.col("named_.stem")).withColumn("pattern_id", pattern_id("named_.stem", "named_.pattern")).drop("named_", "candidates")


# Values that documents use in place of secrets.
PLACEHOLDER = r"AKIA[A-Z0-9]*EXAMPLE\z|(?:REDACTED|CHANGEME|XXXXXXXX)\z|\AYOUR-[A-Z0-9-]+-HERE\z"


def is_placeholder(match: Column | str) -> Column:
    """O33. Whether a matched text is a documented placeholder as a whole or at its end."""
    return (F.col(match) if isinstance(match, str) else match).rlike(f"(?i){PLACEHOLDER}")


@lru_cache(maxsize=64)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I)


def _resume(line: pd.Series, regex: pd.Series, always: pd.Series) -> pd.DataFrame:
    """The first match that is no placeholder of the always patterns, and how many such came before it."""
    known, out = _compiled(PLACEHOLDER.replace(r"\z", r"\Z")), []
    for text, pattern, own in zip(line, regex, always, strict=True):
        at, hidden, found = 0, 0, None
        while pattern and (m := _compiled(pattern).search(text, at)) and m[0]:
            if not (own and _compiled(own).search(m[0]) and known.search(m[0])):
                found = m
                break
            hidden, at = hidden + 1, m.start() + 1
        column = len(text[: found.start()].encode("utf-16-le")) // 2 + 1 if found else None
        out.append((found[0] if found else None, column, hidden))
    return pd.DataFrame(out, columns=["match", "column", "suppressed"]).astype({"column": "Int32"})


def suppress_known(hits: DataFrame, deny_sets: DataFrame) -> DataFrame:
    """O33. Hits (repo, line, match, column, path_exempt, …) without documented placeholders of the always patterns.

    Where the first match is a placeholder (rare) the search goes on one character later on the same
    line, with the patterns that the line can match (of scan_lines, or its repo's set), in an Arrow
    stage that other rows pass as nulls. suppressed counts the placeholders; a line of which nothing
    else is left has a null match. Hits are read once.
    """
    if "candidates" not in hits.columns:
        hits = hits.join(deny_sets.select("repo", F.col("patterns").alias("candidates")), "repo")
    rare = F.coalesce(is_placeholder("match"), F.lit(False))
    joined = lambda keep: F.array_join(F.transform(F.filter("candidates", keep), lambda p: F.concat(F.lit("(?:"), p["pattern"], F.lit(")"))), "|")
    regex, own = joined(lambda p: ~(F.col("path_exempt") & (p["stem"] == ALWAYS))), joined(lambda p: p["stem"] == ALWAYS)
    again = F.pandas_udf(_resume, "match string, column int, suppressed int")(F.when(F.col("rare_"), F.col("line")), F.when(F.col("rare_"), regex), F.when(F.col("rare_"), own))
    told = hits.withColumn("rare_", rare).withColumn("again_", again)
    return told.withColumns({c: F.when(F.col("rare_"), F.col(f"again_.{c}")).otherwise(F.col(c)) for c in ("match", "column")}).withColumn("suppressed", F.col("again_.suppressed")).drop("rare_", "again_")


def scan_files_in_detail(files: DataFrame, deny_sets: DataFrame, scoped: DataFrame, globs: list[str] | None = None, allow_token: str | None = ALLOW) -> tuple[DataFrame, DataFrame]:
    """O33, O35. Hits of files, and the placeholders left out per repo and path (suppressed). sort_files gives the files that were skipped."""
    lines = explode_lines(files.select("repo", "path", "blob", "text"))
    found = suppress_known(scan_lines(lines, deny_sets, globs, allow_token), deny_sets)
    hidden = found.where("suppressed > 0").groupBy("repo", "path").agg(F.sum("suppressed").alias("suppressed"))
    return _report(found.where("match is not null"), scoped), hidden


def scan_files(files: DataFrame, deny_sets: DataFrame, scoped: DataFrame, globs: list[str] | None = None, allow_token: str | None = ALLOW) -> DataFrame:
    """O35. Hits of files (repo, path, blob, text): place, preview, blob, engagement and pattern id; documented placeholders are none."""
    return scan_files_in_detail(files, deny_sets, scoped, globs, allow_token)[0]


def _report(hits: DataFrame, scoped: DataFrame) -> DataFrame:
    return attribute(hits, scoped).select("repo", "path", "line_no", "column", redact("match").alias("preview"), "blob", "engagement", "pattern_id", "path_exempt")


def scan_diffs(diffs: DataFrame, deny_sets: DataFrame, scoped: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """O36. Hits in the added lines of diffs (diff_id, repo, text)."""
    added = parse_diffs(diffs.select("diff_id", "repo", "text"), ["diff_id", "repo"])
    lines = added.select("repo", "diff_id", "path", "blob", F.col("virtual_line").alias("line_no"), F.col("content").alias("line"))
    hits = suppress_known(scan_lines(lines, deny_sets, globs), deny_sets).where("match is not null")
    return attribute(hits, scoped).select("repo", "diff_id", "path", "blob", "line_no", "column", redact("match").alias("preview"), "engagement", "pattern_id")


def _every(rows: DataFrame, column: str, scoped: DataFrame) -> DataFrame:
    """rows (repo, column, …) once for each pattern of its repo that matches, with stem and pattern."""
    tried = with_candidates(rows, column, scoped).select(*rows.columns, F.explode("found").alias("key"))
    own = scoped.select("repo", "stem", "pattern", pattern_key("stem", "pattern").alias("key")).distinct()
    return tried.join(own, ["repo", "key"]).where(_matches(F.col(column), F.col("pattern"))).drop("key")


def match_all(texts: DataFrame, scoped: DataFrame) -> DataFrame:
    """O38. Every pattern of the repo that matches a text (repo, text_id, text)."""
    return _every(texts.select("repo", "text_id", "text"), "text", scoped).select("repo", "text_id", "stem", pattern_id("stem", "pattern").alias("pattern_id"))


def scan_history(commit_lines: DataFrame, scoped: DataFrame) -> DataFrame:
    """O37. Distinct (pattern, commit) over added and removed lines."""
    pairs = _every(commit_lines.select("repo", "sha", "summary", "content"), "content", scoped)
    return pairs.select("repo", "sha", "summary", "stem", pattern_id("stem", "pattern").alias("pattern_id"), redact("pattern").alias("pattern")).distinct()


ACCOUNT_HOSTS = [  # Fixed values: host names that hold an account id
    r"[A-Za-z0-9][A-Za-z0-9-]*-[0-9]{12}\.d\.codeartifact\.[A-Za-z0-9-]+\.amazonaws\.com",
    r"[0-9]{12}\.dkr\.ecr\.[A-Za-z0-9-]+\.amazonaws\.com",
]
RUNS = ["0123456789", "1234567890", "9876543210", "0987654321"]


def scan_account_ids(lines: DataFrame) -> DataFrame:
    """O42. Twelve-digit account ids per line (…, line), without repeated digits and counting runs."""
    ids = lines.withColumn("account", F.explode(F.regexp_extract_all("line", F.lit(r"(?<![A-Za-z0-9_])[0-9]{12}(?![A-Za-z0-9_])"), F.lit(0))))
    counting = "|".join(re.escape((r * 2)[i : i + 12]) for r in RUNS for i in range(9))
    return ids.where(~F.col("account").rlike(r"^(\d)\1{11}$") & ~F.col("account").rlike(f"^(?:{counting})$"))


def text_hygiene(lines: DataFrame) -> DataFrame:
    """O42. Lines (…, line) that hold an account id, a registry host with one, or a raw NUL: the columns of lines without the line, kind and n.

    Hosts whose id is all zeros are documented placeholders. What was found is never told.
    """
    host = F.regexp_extract_all("line", F.lit(rf"(?i)(?<![A-Za-z0-9-])(?:{'|'.join(ACCOUNT_HOSTS)})"), F.lit(0))
    real = F.size(F.filter(host, lambda h: ~h.rlike(r"(?<![0-9])0{12}(?![0-9])")))
    nul = F.length("line") - F.length(F.replace("line", F.lit("\x00"), F.lit("")))
    keep = [c for c in lines.columns if c != "line"]
    ids = scan_account_ids(lines).groupBy(*keep).agg(F.count("*").cast("int").alias("n")).withColumn("kind", F.lit("account-id"))
    kinds = F.inline(F.array(F.struct(F.lit("registry-host").alias("kind"), real.alias("n")), F.struct(F.lit("nul").alias("kind"), nul.alias("n"))))
    return lines.select(*keep, kinds).where("n > 0").unionByName(ids)


REDACTED = "<redacted>"


def redact_stems(stems: Column | str) -> Column:
    """O43. Stems with all but the always stem hidden; their number and places stay."""
    return F.transform(stems, lambda s: F.when(s == ALWAYS, s).otherwise(F.lit(REDACTED)))


def redact_attribution(hits: DataFrame) -> DataFrame:
    """O43. Hits without the names of engagements: only the always stem stays, other pattern ids lose theirs."""
    always = F.col("engagement") == ALWAYS
    return hits.withColumn("pattern_id", F.when(always, F.col("pattern_id")).when(F.col("pattern_id").isNotNull(), F.lit(REDACTED))).withColumn("engagement", F.when(always, F.col("engagement")))


def attribution_summary(hits: DataFrame) -> DataFrame:
    """O43. Hits by what may be told of them, and how many distinct engagements stand behind each line."""
    known = hits.withColumn("who", F.when(F.col("engagement") != ALWAYS, F.col("engagement")))
    return redact_attribution(known).groupBy("engagement", "pattern_id").agg(F.count("*").alias("hits"), F.count_distinct("who").alias("engagements"))


# Folders that hold fixtures, and folders that are not searched for them.
FIXTURE_DIRS = ["fixtures", "fixture", "__fixtures__", "test-fixtures", "testdata"]
UNSEARCHED_DIRS = [".git", "node_modules"]
FIXTURE_DEPTH = 4  # folders that may stand above a fixture folder


def in_fixture(path: Column | str = "path") -> Column:
    """O69. Whether a path lies, at any depth, below a fixture folder that is itself found near the root."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    near = F.slice(folders, 1, FIXTURE_DEPTH + 1)
    place = lambda names: F.coalesce(F.nullif(F.array_min(F.transform(F.array(*map(F.lit, names)), lambda n: F.nullif(F.array_position(near, n), F.lit(0)))), F.lit(0)), F.lit(1 << 30))
    return (place(FIXTURE_DIRS) < (1 << 30)) & (place(FIXTURE_DIRS) < place(UNSEARCHED_DIRS))


def fixture_audit(files: DataFrame, deny_sets: DataFrame, scoped: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """O69. Hits in files of fixture folders, with the whole deny set; always hits in exempt paths are informational."""
    hits = scan_files(files.where(in_fixture("path")), deny_sets, scoped, None, None)
    return hits.withColumn("informational", F.coalesce(path_matches("path", globs or []) & (F.col("engagement") == ALWAYS), F.lit(False)))
