"""Reachability over commit graphs."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """Write and read again in the shared folder: lineage ends, and lost executors lose nothing."""
    path = f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct()


def contract_runs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of commits with one parent and one child, and the links between them.

    runs (node, head, pos): a commit belongs to the run of its only child if it is that child's only
    parent; pos is its distance from the run's head, which itself is not listed. links (head, next):
    the parents of a run's last commit, all of them heads. Each round follows the pointers of the
    round before three deep, so a run of any length takes rounds by the logarithm of it. Commits of a
    ring, which no history has, stay alone.
    """
    step = _cut(_edges(edges))
    only = lambda a, b: step.groupBy(a).agg(F.count("*").alias("n"), F.min(b).alias(b)).where("n = 1").drop("n")
    near = only("parent", "child").join(only("child", "parent").select("child"), "child", "left_semi")
    runs = _cut(near.select(F.col("parent").alias("node"), F.col("child").alias("head"), F.lit(1).cast("long").alias("pos")))
    left, reached = runs.count(), 1
    while left:
        by = lambda c: runs.select(F.col("node").alias(c), F.col("head").alias(f"{c}_head"), F.col("pos").alias(f"{c}_pos"))  # noqa: E731, B023
        two = runs.join(by("b"), F.col("head") == F.col("b"), "left")
        three = two.join(by("c"), F.col("b_head") == F.col("c"), "left")
        pos = F.col("pos") + F.coalesce("b_pos", F.lit(0)) + F.coalesce("c_pos", F.lit(0))
        runs = _cut(three.select("node", F.coalesce("c_head", "b_head", "head").alias("head"), pos.alias("pos")))
        open_ = runs.join(runs.select(F.col("node").alias("head")), "head", "left_semi")
        left = open_.count()
        reached *= 3
        if left and reached > 3 * step.count():
            runs = _cut(runs.join(open_.select("node"), "node", "left_anti"))
            break
    ends = step.join(runs.select(F.col("node").alias("parent")), "parent", "left_anti")
    links = ends.join(runs.select(F.col("node").alias("child"), "head"), "child", "left").select(F.coalesce("head", "child").alias("head"), F.col("parent").alias("next"))
    return runs, _cut(links.distinct())


def _closure(links: DataFrame, front: DataFrame, hops: int) -> DataFrame:
    """(tip, head): the rows of front and all that links (head, next) lead to.

    A frontier moves along the links, `hops` generations between two cuts of the lineage; heads
    already reached are dropped by an anti join, so merges add no paths. Fronts are kept as they were
    written; two are joined into one only where the older is no larger than twice the newer, so a row
    is written anew a logarithmic number of times.
    """
    front = _cut(front.distinct())
    step = links.select(F.col("head").alias("from"), "next")
    parts = [(front.count(), front)]
    seen = front
    while not front.isEmpty():
        reached, last = None, front
        for _ in range(hops):
            last = last.join(step, last["head"] == step["from"]).select("tip", F.col("next").alias("head")).distinct()
            reached = last if reached is None else reached.unionByName(last)
        front = _cut(reached.distinct().join(seen, ["tip", "head"], "left_anti"))
        size, part = front.count(), front
        while parts and size and parts[-1][0] <= 2 * size:
            older, rows = parts.pop()
            size, part = size + older, _cut(rows.unionByName(part))
        if size:
            parts.append((size, part))
        seen = reduce(DataFrame.unionByName, [rows for _, rows in parts])
    return seen


def reachable_commits(edges: DataFrame, tips: DataFrame, hops: int = 4, contracted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """O72. (tip, sha): every ancestor of each tip (tip, sha), itself included; edges (child, parent).

    Runs of commits are contracted first, so the rounds follow the merges, not the generations: a
    tip reaches what is left of its own run, then whole runs, which are put back at the end. Several
    commits of one tip count together. No tips give no rows, null commits none. `contracted` is what
    contract_runs made of the same edges, if it is there already.
    """
    runs, links = contracted or contract_runs(edges)
    wanted = tips.select("tip", "sha").where("sha is not null").distinct()
    starts = _cut(wanted.join(runs.withColumnRenamed("node", "sha"), "sha", "left").select("tip", F.coalesce("head", "sha").alias("head"), F.coalesce("pos", F.lit(0).cast("long")).alias("least")))
    whole = _closure(links, starts.select("tip", "head").join(links, "head").select("tip", F.col("next").alias("head")), hops)
    reached = starts.unionByName(whole.withColumn("least", F.lit(0).cast("long"))).groupBy("tip", "head").agg(F.min("least").alias("least"))
    inside = reached.join(runs, "head").where("pos >= least").select("tip", F.col("node").alias("sha"))
    return reached.where("least = 0").select("tip", F.col("head").alias("sha")).unionByName(inside)


def already_public(hits: DataFrame, repos: DataFrame, reachable: DataFrame) -> DataFrame:
    """O73. History hits (repo, sha, …): in public-facing repos those reachable from a remote warn, all others block."""
    known = reachable.select("repo", "sha").distinct().withColumn("known", F.lit(True))
    flagged = hits.join(repos.select("repo", "public"), "repo").join(known, ["repo", "sha"], "left")
    public = F.col("public") & F.coalesce("known", F.lit(False))
    return flagged.withColumn("already_public", public).withColumn("action", F.when(public, "warn").otherwise("block")).drop("known")


ZERO = "^0+$"


def route_pushes(pushes: DataFrame) -> DataFrame:
    """O74. What a push row (local_sha, remote_sha) needs: nothing, a plan for a new ref, or its plain range."""
    return pushes.withColumn("route", F.when(F.col("local_sha").rlike(ZERO), "skip").when(F.col("remote_sha").rlike(ZERO), "new-ref").otherwise("range"))


def new_ref_plan(edges: DataFrame, news: DataFrame, remotes: DataFrame, force: bool = False) -> DataFrame:
    """O74. Per new ref (ref, sha): how much of its history to scan, from what remotes (name, sha) already have.

    nothing-new, incremental (one boundary commit), widened (several: from a common ancestor of all
    that is no ancestor of another such), or full-history; force always scans all.
    """
    runs = contract_runs(edges)  # once for all four questions
    new_reach = reachable_commits(edges, news.select(F.col("ref").alias("tip"), "sha"), contracted=runs)
    known = reachable_commits(edges, remotes.select(F.lit("remote").alias("tip"), "sha"), contracted=runs).select("sha")
    fresh = _cut(new_reach.join(known, "sha", "left_anti"))
    n_new = fresh.groupBy("tip").agg(F.count("*").alias("n_new"))
    border = fresh.join(edges, fresh["sha"] == edges["child"]).select("tip", F.col("parent").alias("sha")).join(known, "sha", "left_semi").distinct()
    border = _cut(border)
    n_border = border.groupBy("tip").agg(F.count("*").alias("n_border"), F.min("sha").alias("only"))
    wide = border.join(n_border.where("n_border > 1").select("tip", "n_border"), "tip")
    up = reachable_commits(edges, wide.select(F.concat_ws("\x1f", "tip", "sha").alias("tip"), "sha"), contracted=runs)
    common = up.select(F.substring_index("tip", "\x1f", 1).alias("ref"), "sha", F.col("tip").alias("start")).groupBy("ref", "sha").agg(F.count_distinct("start").alias("n"))
    common = _cut(common.join(n_border.select(F.col("tip").alias("ref"), "n_border"), "ref").where("n = n_border").select("ref", "sha"))
    below = reachable_commits(edges, common.select(F.concat_ws("\x1f", "ref", "sha").alias("tip"), "sha"), contracted=runs)
    inner = below.where(F.substring_index("tip", "\x1f", -1) != F.col("sha")).select(F.substring_index("tip", "\x1f", 1).alias("ref"), "sha").distinct()
    base = common.join(inner, ["ref", "sha"], "left_anti").groupBy("ref").agg(F.min("sha").alias("merge_base"))
    rows = news.select("ref").join(n_new.withColumnRenamed("tip", "ref"), "ref", "left").join(n_border.withColumnRenamed("tip", "ref"), "ref", "left").join(base, "ref", "left")
    n, b = F.coalesce("n_new", F.lit(0)), F.coalesce("n_border", F.lit(0))
    mode = F.when(F.lit(force), "full-history").when(n == 0, "nothing-new").when(b == 1, "incremental").when((b > 1) & F.col("merge_base").isNotNull(), "widened").otherwise("full-history")
    return rows.select("ref", mode.alias("mode"), F.when(mode == "incremental", F.col("only")).when(mode == "widened", F.col("merge_base")).alias("base"), n.alias("n_new"), b.alias("n_border"))
