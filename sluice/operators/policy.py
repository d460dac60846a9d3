"""Waivers, repository classes, boundaries and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import parse_remote
from sluice.operators.joins import few
from sluice.operators.patterns import ALWAYS, scope_warnings

CLASSES = ["public-eligible", "private-strict", "customer-coupled", "scratch"]
DEFAULT_CLASS = "private-strict"


def expired(as_of: str) -> Column:
    """O62. Past the day of expiry; that day itself still counts."""
    return F.coalesce(F.try_to_date("expires") < F.to_date(F.lit(as_of)), F.lit(False))


def apply_waivers(hits: DataFrame, waivers: DataFrame, as_of: str) -> DataFrame:
    """O62. Hits with waived, reason and approver of the first live waiver of their pattern id and blob."""
    live = waivers.where(~expired(as_of)).where(F.col("pattern").startswith(f"{ALWAYS}/"))
    first = live.groupBy(F.col("pattern").alias("pattern_id"), "blob").agg(F.min(F.struct("date", "reason", "approver")).alias("w"))
    return hits.join(first, ["pattern_id", "blob"], "left").withColumn("waived", F.col("w").isNotNull()).withColumn("reason", F.col("w.reason")).withColumn("approver", F.col("w.approver")).drop("w")


def validate_waivers(waivers: DataFrame, as_of: str) -> DataFrame:
    """O63. Waivers with the first rule of shape they break, and whether they have expired."""
    issue = (
        F.when(~F.coalesce(F.col("pattern").rlike("^[^/]+/[0-9a-f]{12}$"), F.lit(False)), "pattern")
        .when(~F.coalesce(F.col("blob").rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$"), F.lit(False)), "blob")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "reason")
        .when(F.trim(F.coalesce("approver", F.lit(""))) == "", "approver")
        .when(F.try_to_date("date").isNull(), "date")
        .when(F.col("expires").isNotNull() & F.try_to_date("expires").isNull(), "expires")
    )
    return waivers.withColumn("issue", issue).withColumn("expired", expired(as_of))


def classify_repos(repos: DataFrame, personal: DataFrame, owned: DataFrame, rules: DataFrame, inert: DataFrame) -> DataFrame:
    """O65. Class of unclassified repos (repo, class_explicit, class, remote_url): personal org, engagement org, then the first rule.

    personal (org), owned (org, id), rules (pos, pattern, class): small. inert: ids without markers.
    """
    r = repos.withColumn("remote", parse_remote("remote_url")).withColumn("org", F.col("remote.org"))
    r = r.join(personal.select("org", F.lit(True).alias("mine")).distinct(), "org", "left").join(owned.groupBy("org").agg(F.min("id").alias("id")), "org", "left")
    fits = F.rlike("remote_url", F.concat(F.lit("(?iu)"), F.col("pattern")))
    by_rule = r.select("repo", "remote_url").join(few(rules.select("pos", "pattern", F.col("class").alias("rule_class"))), fits).groupBy("repo").agg(F.min_by("rule_class", "pos").alias("rule_class"))
    r = r.join(by_rule, "repo", "left").join(inert.select("id", F.lit(True).alias("inert")).distinct(), "id", "left")
    found = F.when(F.col("mine"), "public-eligible").when(F.col("id").isNotNull(), "customer-coupled").otherwise(F.col("rule_class"))
    status = F.when(F.col("class_explicit"), "already-classified").when(F.col("remote_url").isNull(), "skipped").when(F.col("mine") | F.col("id").isNotNull(), "applied").when(F.col("rule_class").isNotNull(), "needs-confirmation").otherwise("skipped")
    reason = F.when(status == "skipped", F.when(F.col("remote_url").isNull(), "no remote").otherwise("no match"))
    return r.select("repo", status.alias("status"), F.when(F.col("class_explicit"), F.col("class")).otherwise(found).alias("class"), F.when(status == "applied", F.col("id")).alias("engagement"), reason.alias("reason"), F.coalesce((status == "applied") & F.col("inert"), F.lit(False)).alias("inert_engagement"))


def effective_config(config: DataFrame, override: DataFrame) -> DataFrame:
    """O66. Class and engagements of a repo: its own setting if valid, else the override's, else the default."""
    o = override.select("repo", F.col("class").alias("o_class"), F.col("engagements").alias("o_engagements"))
    pick = F.coalesce(F.when(F.col("class").isin(CLASSES), F.col("class")), F.when(F.col("o_class").isin(CLASSES), F.col("o_class")))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    both = config.join(o, "repo", "left")
    return both.select("repo", F.coalesce(pick, F.lit(DEFAULT_CLASS)).alias("class"), pick.isNotNull().alias("class_explicit"), F.coalesce(some("engagements"), some("o_engagements"), F.array().cast("array<string>")).alias("engagements"))


def public_facing() -> Column:
    """O67."""
    return (F.col("class") == "public-eligible") | (F.col("visibility") == "public")


def repo_checks(repos: DataFrame) -> DataFrame:
    """O67. Findings (check, repo, message) on visibility, remotes and missing engagements."""
    c, v, u = F.col("class"), F.col("visibility"), F.col("remote_url")
    rules = {
        "visibility": F.when((v == "public") & (c != "public-eligible"), "public but not public-eligible"),
        "remote": F.when((c == "scratch") & u.isNotNull(), "scratch with a remote").when((c == "customer-coupled") & u.isNull(), "coupled without a remote").when((c == "customer-coupled") & (F.size("engagements") > 0) & ~F.exists("engagements", lambda e: F.contains(F.lower(u), F.lower(e))), "remote does not name the engagement"),
        "engagement": F.when((c == "customer-coupled") & (F.size("engagements") == 0), "coupled without engagement"),
    }
    parts = [repos.select(F.lit(k).alias("check"), "repo", m.alias("message")).where("message is not null") for k, m in rules.items()]
    return reduce(DataFrame.unionByName, parts)


BLOCKING_UNLESS_SCRATCH = ["markers", "egress"]  # checks whose findings only advise on a scratch repo


def plan_checks(repos: DataFrame, names: list[str], armed: DataFrame) -> DataFrame:
    """O68. Which checks of each repo (repo, class, visibility, remote_url, public) run: (repo, check, skip_reason, advisory).

    A check without anything to hold a repo against is skipped and says why: markers without a deny
    set (armed lists the repos that have one), visibility that is unknown, egress of a repo that does
    not face the public, and all checks of a folder that is no repository (is_repo, if there is such
    a column). Markers and egress only advise on scratch repos.
    """
    is_repo = F.coalesce("is_repo", F.lit(True)) if "is_repo" in repos.columns else F.lit(True)
    rows = repos.join(armed.select("repo", F.lit(True).alias("armed")).distinct(), "repo", "left").withColumn("check", F.explode(F.array(*map(F.lit, names))))
    check = F.col("check")
    reason = (
        F.when(~is_repo, "not a repository")
        .when((check == "markers") & F.col("armed").isNull(), "empty deny set")
        .when((check == "visibility") & (F.coalesce("visibility", F.lit("unknown")) == "unknown"), "visibility not known")
        .when((check == "egress") & ~F.coalesce("public", F.lit(False)), "not public-facing")
    )
    return rows.select("repo", "check", reason.alias("skip_reason"), (check.isin(BLOCKING_UNLESS_SCRATCH) & (F.col("class") == "scratch")).alias("advisory"))


def audit_verdict(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """O68. Per (repo, check), per repo and in all: findings (repo, check, informational), what ran, was skipped and failed, and ok.

    checks (repo, check, skip_reason, advisory) lists what there is; one with a reason did not run.
    A check fails by a finding that is not informational; an advisory one has such findings counted
    as advised and does not fail. The reason is told for each check.
    """
    n = findings.groupBy("repo", "check").agg(F.count("*").alias("found"), F.count_if("informational").alias("informational"))
    rows = checks.join(n, ["repo", "check"], "left").na.fill(0, ["found", "informational"])
    ran = F.col("skip_reason").isNull()
    hit = ran & (F.col("found") > F.col("informational"))
    failed = F.count_if(hit & ~F.col("advisory"))
    return rows.rollup("repo", "check").agg(
        F.sum("found").alias("found"), F.sum("informational").alias("informational"), F.count_if(ran).alias("run"), F.count_if(~ran).alias("skipped"),
        F.when(F.grouping("check") == 0, F.max("skip_reason")).alias("skip_reason"), F.count_if(hit & F.col("advisory")).alias("advised"), failed.alias("failed"), (failed == 0).alias("ok"),
    )


def trust_boundaries(repos: DataFrame, owned: DataFrame, personal: DataFrame) -> DataFrame:
    """O71. Orgs a repo belongs to: its engagements', the personal ones if public-eligible, else its remote's."""
    pairs = repos.select("repo", F.explode("engagements").alias("id")).join(owned, "id").select("repo", "org")
    mine = repos.where("class = 'public-eligible'").select("repo", F.lit("mine").alias("of")).join(few(personal.select(F.lit("mine").alias("of"), "org").distinct()), "of").select("repo", "org")
    orgs = pairs.unionByName(mine).groupBy("repo").agg(F.array_sort(F.collect_set("org")).alias("orgs"))
    remote = F.when(parse_remote("remote_url").isNotNull(), F.array(parse_remote("remote_url")["org"])).otherwise(F.array().cast("array<string>"))
    return repos.join(orgs, "repo", "left").select("repo", "class", F.coalesce("orgs", remote).alias("orgs"), F.col("orgs").isNull().alias("from_remote"))


def overlapping(boundaries: DataFrame) -> DataFrame:
    """O71. Pairs of repos with an org in common; a repo without orgs overlaps none."""
    one = boundaries.select("repo", F.explode("orgs").alias("org"))
    return one.join(one.select(F.col("repo").alias("other"), "org"), "org").where("repo < other").groupBy("repo", "other").agg(F.count_distinct("org").alias("shared"))


def repo_status(repos: DataFrame, scoped: DataFrame, engagements: DataFrame, active: Column) -> DataFrame:
    """O90. Per repo: allowed ids with name and state, denying stems, pattern counts, whether it faces the public, and warnings."""
    e = engagements.select("id", "name", active.alias("active"))
    ids = repos.select("repo", F.explode_outer("engagements").alias("id")).join(e, "id", "left")
    label = F.concat_ws(":", "id", F.coalesce("name", "id"), F.when(F.coalesce("active", F.lit(False)), "active").otherwise("inactive"))
    allowed = ids.where("id is not null").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("allowed"))
    denied = scoped.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("stem")), ",").alias("denying"), F.count("*").alias("n_patterns"), F.count_if(F.col("stem") == ALWAYS).alias("n_always"))
    ignored = scope_warnings(repos).select("repo", F.concat(F.lit("class "), "class", F.lit(" ignores "), "ignored").alias("warnings"))
    return repos.join(allowed, "repo", "left").join(denied, "repo", "left").join(ignored, "repo", "left").select("repo", "class", public_facing().alias("public"), F.coalesce("allowed", F.lit("")).alias("allowed"), F.coalesce("denying", F.lit("")).alias("denying"), F.coalesce("n_patterns", F.lit(0)).alias("n_patterns"), F.coalesce("n_always", F.lit(0)).alias("n_always"), F.coalesce("warnings", F.lit("")).alias("warnings"))


def unarmed_engagements(engagements: DataFrame, markers: DataFrame, active: Column) -> DataFrame:
    """O90. Active engagements (id, name) without a marker (id): nothing is denied on their behalf."""
    return engagements.where(active).select("id", "name").join(markers.select("id").distinct(), "id", "left_anti")
