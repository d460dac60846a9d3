"""Reading text trees, marker files, diffs, histories, audit logs and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sluice.functions.text import strip
from sluice.sources.patches import cut_diff, cut_log, cut_texts

MAX_BYTES = 1 << 20
SNIFF = 8192


def explode_lines(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """O1. Lines of files (…, text): line_no from 1 and line; only line feeds part lines."""
    keep = [c for c in files.columns if c != "text"] if keep is None else keep
    return files.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_no"), "line")


def sort_files(raw: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """O2. Split (path, length, content) into texts and skipped files with their reason."""
    reason = (
        F.when(F.col("content").isNull(), "unreadable")
        .when(F.col("length") > max_bytes, "too-large")
        .when(F.contains(F.substring("content", 1, SNIFF), F.lit(b"\x00")), "binary")
    )
    tagged = raw.withColumn("reason", reason)
    files = tagged.where("reason is null").drop("reason", "length").withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")
    return files, tagged.where("reason is not null").select("path", "reason", F.col("length").alias("bytes"))


def load_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """O2. Texts and skipped files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    return sort_files(raw, max_bytes)


def parse_diffs(diffs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """O3. Added lines of unified diffs (diff_id, text): the columns `keep`, path, blob, virtual_line and content.

    The path comes from the new side's header, or from the stanza's opening line; a deleted file has
    no added lines. Headers count only outside a hunk, whose length its own header gives; a new stanza
    or hunk ends one that is cut short. Quoted paths stay quoted. virtual_line runs over the whole
    diff. A diff is cut in the task that reads it, and its pieces are dealt to all cores before they
    become lines: one shuffle of the added text, none by diff.
    """
    keep = keep or ["diff_id"]
    pieces = cut_texts(diffs.select(*keep, "text"), cut_diff, "path string, blob string, first long, lines string")
    lines = pieces.hint("rebalance").select(*keep, "path", "blob", "first", F.posexplode(F.split("lines", "\n", -1)).alias("at", "content"))
    return lines.select(*keep, "path", "blob", (F.col("first") + F.col("at")).alias("virtual_line"), "content")


def changed_files(changes: DataFrame, files: DataFrame, names: str) -> DataFrame:
    """O4. Texts at the tip (repo, path, rev) of added, copied, modified and renamed files whose name a host branch reads."""
    wanted = changes.where(F.col("status").isin("A", "C", "M", "R")).where(F.substring_index("path", "/", -1).rlike(names)).select("repo", "path", "rev").distinct()
    return files.join(wanted, ["repo", "path", "rev"], "left_semi")


def parse_history(logs: DataFrame) -> DataFrame:
    """O5. Added and removed lines of logs (log_id, repo, text), one marker line `commit <sha> <summary>` per commit.

    Lines before the first marker, and the names of both sides of a file, are left out. As with diffs,
    a log is cut where it is read and dealt out in pieces.
    """
    pieces = cut_texts(logs.select("log_id", "repo", "text"), cut_log, "sha string, summary string, lines string")
    kept = pieces.hint("rebalance").select("log_id", "repo", "sha", "summary", F.explode(F.split("lines", "\n", -1)).alias("line"))
    return kept.select("log_id", "repo", "sha", "summary", F.substring("line", 1, 1).alias("sign"), F.substring("line", 2, 1 << 30).alias("content"))


def parse_markers(files: DataFrame) -> DataFrame:
    """O6. Patterns of marker files (stem, text): blank lines and lines that start with ; are left out."""
    lines = explode_lines(files, ["stem"])
    return lines.select("stem", (F.col("line_no") - 1).alias("ord"), strip("line").alias("pattern")).where("pattern <> '' and not startswith(pattern, ';')")


def load_markers(spark: SparkSession, root: str) -> DataFrame:
    """O6. Patterns of all *.txt files of a folder; the file's name is the stem."""
    raw = spark.read.option("wholetext", "true").text(f"{root.rstrip('/')}/*.txt").select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("stem"), F.col("value").alias("text"))
    return parse_markers(raw)


def registry_tables(registry: DataFrame) -> dict[str, DataFrame]:
    """O7. The dimension tables of one nested registry row. A missing exempt list stays null, an empty one empty."""
    e = registry.select(F.posexplode("engagements").alias("place", "e")).select("place", "e.*")
    flat = lambda c: registry.select(F.posexplode(c).alias("ord", "value"))
    return {
        "engagements": e.select("place", "id", "name", "started", "ended", "reposActive"),
        "markers": e.select("id", F.posexplode("markers").alias("ord", "pattern")).unionByName(flat("always_block").select(F.lit("_always").alias("id"), "ord", F.col("value").alias("pattern"))),
        "orgs": e.select("id", F.explode("githubOrgs").alias("org")).withColumn("org", F.lower("org")).unionByName(flat("personalOrgs").select(F.lit(None).cast("string").alias("id"), F.lower("value").alias("org"))),
        "infra": flat("privateInfra").select(F.lit("_private_infra").alias("id"), "ord", F.col("value").alias("pattern")),
        "allowed_hosts": flat("publicRegistries").select(F.lower("value").alias("host")),
        "exempt": registry.select("alwaysBlockExemptPaths"),
    }


def write_audit(records: DataFrame, path: str) -> None:
    """O8. Append records (ts, action, actor, …) as JSON lines, a folder per day."""
    records.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def stream_audit(records: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """O8. The same folders from a stream of records; with its checkpoint a restarted stream repeats none. Start it with a trigger.

    Each batch appends files to the folders of its days, which take the place of rotation by size.
    read_audit reads what finished batches wrote.
    """
    dated = records.withColumn("day", F.to_date("ts"))
    return dated.writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_audit(spark: SparkSession, path: str, schema: str, tail: int | None = None) -> DataFrame:
    """O8. Records, malformed lines as rows with _corrupt_record; the last `tail` by time."""
    found = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return found.orderBy(F.desc_nulls_last("ts")).limit(tail) if tail else found


def write_profiles(profiles: DataFrame, path: str) -> None:
    """O9. Reference vectors, one folder an engagement."""
    profiles.write.mode("overwrite").partitionBy("engagement_id").parquet(path)


def check_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O9. Usable vectors, and the others with what is wrong; neither stops the run."""
    error = (
        F.when(F.col("vec").isNull() | (F.size("vec") == 0), "no vector")
        .when(F.exists("vec", lambda v: v.isNull() | F.isnan(v)), "not a number")
        .when(F.col("threshold").isNull() | ~F.col("threshold").between(0, 1), "threshold")
    )
    tagged = profiles.withColumn("error", error)
    return tagged.where("error is null").drop("error"), tagged.where("error is not null")


def load_seen(spark: SparkSession, path: str) -> DataFrame:
    """O10. Seen keys; a missing or empty store is an empty table, entries without a date keep null."""
    schema = "hit_key string, first_seen date"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def save_seen(seen: DataFrame, root: str, version: int) -> str:
    """O10. A new version's folder; the old one stays until it is dropped."""
    path = f"{root.rstrip('/')}/v{version}"
    seen.write.mode("overwrite").parquet(path)
    return path


def save_run(summary: DataFrame, root: str, run: int, started: str) -> None:
    """O59. Write the summary of a sweep as run number `run`; a run written before is replaced."""
    summary.withColumn("started", F.to_timestamp(F.lit(started))).write.mode("overwrite").parquet(f"{root.rstrip('/')}/run={run}")


def load_runs(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """O59. Summaries of earlier runs with their run numbers, those before `before` if it is given; none for a missing folder."""
    whole = f"{schema}, started timestamp, run int"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], whole)
    runs = spark.read.schema(whole).option("basePath", root).parquet(f"{root.rstrip('/')}/run=*")
    return runs if before is None else runs.where(F.col("run") < before)


def normalise_seen(entries: DataFrame) -> DataFrame:
    """O10. Older entries (hit_key, value) without a parsable date have none."""
    return entries.select("hit_key", F.try_to_date("value").alias("first_seen"))
