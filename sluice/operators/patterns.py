"""Deny sets: which patterns apply to which repository."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import EXEMPT_GLOBS, escape_regex, pattern_id, redact
from sluice.operators.joins import few

ALWAYS, INFRA = "_always", "_private_infra"
MIN_ID = 4
MAX_PATTERN, MAX_COMBINED = 2048, 128 << 10
OPEN_CLASSES = ["customer-coupled", "scratch"]  # classes whose own engagements are allowed


def active(as_of: str, months: int = 12) -> Column:
    """O11. No end, an unparsable end, or an end after as_of less the retention."""
    end = F.try_to_date("ended")
    return end.isNull() | (end > F.add_months(F.to_date(F.lit(as_of)), -months))


def active_engagements(engagements: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """O11."""
    return engagements.where(active(as_of, months))


def render_patterns(engagements: DataFrame, markers: DataFrame, as_of: str) -> DataFrame:
    """O12. Patterns (stem, ord, pattern) of the always list, the private hosts and every active engagement."""
    live = active_engagements(engagements, as_of).select(F.col("id").alias("stem"))
    rows = markers.select(F.col("id").alias("stem"), "ord", "pattern")
    return rows.where(F.col("stem").isin(ALWAYS, INFRA)).unionByName(rows.join(live, "stem", "left_semi"))


def stem_counts(patterns: DataFrame, engagements: DataFrame, as_of: str) -> DataFrame:
    """O12. Patterns per stem; the always stem and active engagements count even without any, stale ones are marked removed."""
    live = active_engagements(engagements, as_of).select(F.col("id").alias("stem"))
    always = live.sparkSession.createDataFrame([(ALWAYS,)], "stem string")
    stems = live.unionByName(always).withColumn("removed", F.lit(False))
    stale = engagements.select(F.col("id").alias("stem")).join(live, "stem", "left_anti").withColumn("removed", F.lit(True))
    infra = patterns.where(F.col("stem") == INFRA).select("stem").distinct().withColumn("removed", F.lit(False))
    n = patterns.groupBy("stem").agg(F.count("*").alias("n"))
    return stems.unionByName(stale).unionByName(infra).join(n, "stem", "left").select("stem", F.coalesce("n", F.lit(0)).alias("n_patterns"), "removed")


def flat_union(patterns: DataFrame) -> DataFrame:
    """O13. One numbered list: the always patterns, then the engagements'; private hosts left out."""
    order = Window.orderBy(F.when(F.col("stem") == ALWAYS, 0).otherwise(1), "stem", "ord")
    return patterns.where(F.col("stem") != INFRA).select((F.row_number().over(order) - 1).alias("n"), "stem", "pattern")


def scope_deny_set(repos: DataFrame, patterns: DataFrame) -> DataFrame:
    """O14. Per repo (repo, class, engagements, public): its patterns; open classes leave out their own engagements'."""
    pairs = repos.select("repo", "class", "engagements", "public").crossJoin(few(patterns))  # each repo against the whole deny list, which lint bounds
    own = F.col("class").isin(OPEN_CLASSES) & F.array_contains("engagements", F.col("stem"))
    inside = (F.col("stem") == ALWAYS) | ((F.col("stem") == INFRA) & F.col("public")) | (~F.col("stem").isin(ALWAYS, INFRA) & ~F.coalesce(own, F.lit(False)))
    return pairs.where(inside).select("repo", "stem", "ord", "pattern")


def auto_block_ids(scoped: DataFrame, reserved: tuple[str, ...] = (ALWAYS, INFRA)) -> DataFrame:
    """O15. Each stem in scope, escaped, as a pattern of its own, if long enough, not reserved and not there already."""
    stems = scoped.select("repo", "stem").distinct().where(~F.col("stem").isin(*reserved)).where(F.length("stem") >= MIN_ID)
    made = stems.select("repo", "stem", F.lit(1 << 20).alias("ord"), escape_regex("stem").alias("pattern"))
    return scoped.unionByName(made.join(scoped.select("repo", "pattern"), ["repo", "pattern"], "left_anti").select(*scoped.columns))


def stem_order() -> Column:
    return F.when(F.col("stem") == ALWAYS, 0).when(F.col("stem") == INFRA, 1).otherwise(2)


def assemble_deny_sets(scoped: DataFrame) -> DataFrame:
    """O16. Per repo the ordered patterns, and the combined, strict and exemptible alternations."""
    one = F.struct(stem_order().alias("o"), "stem", "ord", "pattern")
    joined = lambda keep: F.array_join(F.transform(keep, lambda p: F.concat(F.lit("(?:"), p["pattern"], F.lit(")"))), "|")
    sets = scoped.groupBy("repo").agg(F.array_sort(F.collect_list(one)).alias("patterns"))  # patterns of one repo: bounded by lint
    return sets.select(
        "repo",
        joined(F.col("patterns")).alias("combined"),
        joined(F.filter("patterns", lambda p: p["stem"] != ALWAYS)).alias("strict"),
        joined(F.filter("patterns", lambda p: p["stem"] == ALWAYS)).alias("exemptible"),
        F.transform("patterns", lambda p: F.struct(p["stem"].alias("stem"), p["pattern"].alias("pattern"))).alias("patterns"),
    )


def fingerprint(repos: DataFrame, by: tuple[str, ...] = ("class", "engagements", "public", "exempt")) -> DataFrame:
    """O17. Equal inputs share one set: class, sorted engagements, public flag and exempt list decide."""
    key = F.to_json(F.struct(*[F.array_sort(c).alias(c) if c == "engagements" else F.col(c) for c in by]), {"ignoreNullFields": "false"})
    return repos.withColumn("set_id", F.sha2(key, 256))


def deny_sets(repos: DataFrame, patterns: DataFrame) -> DataFrame:
    """O14, O16, O17. What assemble_deny_sets makes of scope_deny_set, with each distinct set put together once.

    Repos of one class, engagements and public flag share a set; only such scopes meet the patterns,
    however many repos there are, and repos get their set by its id.
    """
    keyed = fingerprint(repos.select("repo", "class", "engagements", "public"), ("class", "engagements", "public"))
    scopes = keyed.drop("repo").dropDuplicates(["set_id"]).withColumnRenamed("set_id", "repo")
    sets = assemble_deny_sets(scope_deny_set(scopes, patterns)).withColumnRenamed("repo", "set_id")
    return keyed.select("repo", "set_id").join(sets, "set_id").drop("set_id")


def resolve_exempt_paths(repos: DataFrame, registry_list: list[str] | None) -> DataFrame:
    """O18. The registry's globs, or the built-in ones if it names none, and the repo's own; trimmed, first occurrence kept."""
    base = F.array(*[F.lit(g) for g in (EXEMPT_GLOBS if registry_list is None else registry_list)]).cast("array<string>")
    own = F.coalesce("exempt_paths", F.array().cast("array<string>"))
    clean = F.array_distinct(F.filter(F.transform(F.concat(base, own), lambda g: F.trim(g)), lambda g: g != ""))
    return repos.withColumn("exempt", clean)


def lint_patterns(patterns: DataFrame) -> DataFrame:
    """O21. Patterns (stem, pattern) with a reason where they are refused.

    The distinct patterns that are not too long (hundreds by the combined limit) are compiled once on
    the driver by the engine's own matcher, since one bad pattern would stop a job.
    """
    java = patterns.sparkSession.sparkContext._jvm.java.util.regex.Pattern
    bad = []
    for row in patterns.select("pattern").where(F.length("pattern") <= MAX_PATTERN).distinct().collect():
        try:
            java.compile(f"(?iu){row['pattern']}")
        except Exception:
            bad.append(row["pattern"])
    size = F.sum(F.octet_length("pattern") + 5).over(Window.partitionBy("stem"))
    reason = (
        F.when(F.trim("pattern") == "", "empty")
        .when(F.length("pattern") > MAX_PATTERN, "too long")
        .when(F.col("pattern").isin(bad) if bad else F.lit(False), "does not compile")
        .when(F.col("pattern").rlike(r"\([^()\\]*(?:\\.[^()\\]*)*[+*]\)[+*{]"), "nested repetition")  # no step of the group per character: a long pattern would overflow the stack
        .when(F.col("pattern").rlike(r"\\[1-9]"), "back reference")
        .when(F.col("size") > MAX_COMBINED, "set too large")
    )
    return patterns.withColumn("size", size).withColumn("reason", reason).drop("size")


def require_min_patterns(scoped: DataFrame, repos: DataFrame, floor: int) -> DataFrame:
    """O22. Patterns per repo; fewer than the floor is an error, never clean."""
    n = repos.select("repo").join(scoped.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left").select("repo", F.coalesce("n", F.lit(0)).alias("n_patterns"))
    return n.withColumn("ok", F.when(F.col("n_patterns") >= floor, True).otherwise(F.raise_error(F.concat(F.lit("deny set below the floor: "), "repo")).cast("boolean")))


def scope_warnings(repos: DataFrame) -> DataFrame:
    """O23. Engagements set on a class that ignores them."""
    return repos.where(~F.col("class").isin(OPEN_CLASSES) & (F.size("engagements") > 0)).select("repo", "class", F.array_join("engagements", ",").alias("ignored"))


def merge_markers(patterns: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """O24. New markers (pos, stem, pattern) with the outcome: added, duplicate (also within the batch), or unknown stem."""
    place = F.row_number().over(Window.partitionBy("stem", "pattern").orderBy("pos"))
    there = patterns.select("stem", "pattern").distinct().withColumn("there", F.lit(True))
    ids = known.select("stem").distinct().withColumn("is_known", F.lit(True))
    tagged = new.withColumn("place", place).join(there, ["stem", "pattern"], "left").join(ids, "stem", "left")
    outcome = F.when(F.col("is_known").isNull(), "unknown").when(F.col("there").isNotNull() | (F.col("place") > 1), "duplicate").otherwise("added")
    return tagged.select("pos", "stem", "pattern", outcome.alias("outcome"))


def validate_registry(engagements: DataFrame, orgs: DataFrame, hosts: DataFrame) -> DataFrame:
    """O25. Issues (rule, subject): repeated or shared orgs, reserved ids, bad shapes."""
    personal = orgs.where("id is null")
    owned = orgs.where("id is not null")
    issue = lambda df, rule, subject: df.select(F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    parts = [
        issue(personal.groupBy("org").count().where("count > 1"), "duplicate personal org", "org"),
        issue(owned.groupBy("org").agg(F.count_distinct("id").alias("n")).where("n > 1"), "org in two engagements", "org"),
        issue(personal.select("org").distinct().join(owned.select("org").distinct(), "org", "left_semi"), "personal and customer org", "org"),
        issue(engagements.where("startswith(id, '_')"), "reserved id", "id"),
        issue(orgs.select("org").distinct().where(~F.col("org").rlike("^[a-z0-9](?:[a-z0-9-]{0,38})$")), "org shape", "org"),
        issue(hosts.where(~F.col("host").rlike(r"^[a-z0-9.-]+(:[0-9]+)?$")), "host shape", "host"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def literal_seeds(patterns: DataFrame, cap: int) -> DataFrame:
    """O26. Distinct literal runs of four and more characters, the first `cap` in order, and how many are left."""
    runs = patterns.select(F.explode(F.split("pattern", r"[\\^$()\[\]{}?+*|.]+")).alias("seed")).where(F.length("seed") >= 4).distinct()
    order = Window.orderBy("seed")  # seeds of a pattern list: bounded by its combined limit
    ranked = runs.withColumn("place", F.row_number().over(order)).withColumn("rest", F.greatest(F.count("*").over(Window.partitionBy()) - cap, F.lit(0)))
    return ranked.where(F.col("place") <= cap).select("place", "seed", "rest")


def pattern_catalog(engagements: DataFrame, patterns: DataFrame, as_of: str) -> DataFrame:
    """O27. Every pattern with its index, id and preview; engagements without any appear once, inert."""
    index = F.row_number().over(Window.partitionBy("stem").orderBy("ord")) - 1
    listed = patterns.select("stem", index.alias("n"), pattern_id("stem", "pattern").alias("pattern_id"), redact("pattern").alias("preview"))
    stems = engagements.select(F.col("id").alias("stem"), active(as_of).alias("active"))
    return stems.join(listed, "stem", "full_outer").select("stem", "active", "n", "pattern_id", "preview", F.col("n").isNull().alias("inert"))


def resolve_engagement(queries: DataFrame, engagements: DataFrame) -> DataFrame:
    """O28. Per query the engagement with that id, else that name, else the only one that contains it; else the candidates."""
    q = F.lower("query")
    rank = F.when(F.lower("id") == q, 1).when(F.lower("name") == q, 2).when(F.contains(F.lower("id"), q) | F.contains(F.lower("name"), q), 3)
    pairs = queries.join(few(engagements.select("id", "name")), rank.isNotNull(), "left").withColumn("rank", rank)
    best = pairs.withColumn("best", F.min("rank").over(Window.partitionBy("query"))).where("rank is null or rank = best")
    found = best.groupBy("query").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("rank").alias("rank"))
    return found.select("query", F.when(F.size("ids") == 1, F.col("ids")[0]).alias("id"), F.when(F.size("ids") > 1, F.array_join("ids", ",")).alias("candidates"), "rank")
