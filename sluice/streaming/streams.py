"""Streams: hits once each, credentials in tool output, and the gate on writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.credentials import scan_credentials
from sluice.operators.joins import few
from sluice.operators.sweep import hit_key

TOOL = "tool_name string, tool_response struct<stdout:string,stderr:string,output:string,content:string,result:string>, tool_result_text string"
SHELL = ["bash", "Bash", "shell"]
OVERRIDE = r"(?:^|/)\.leak-scan\.ya?ml$"


def stream_new_hits(stream: DataFrame, ttl: str) -> DataFrame:
    """O57. Each hit (ts, name, repo, path, line_no) once within ttl; state is dropped after it. Works on batches too."""
    keyed = stream.withColumn("hit_key", hit_key())
    if not stream.isStreaming:
        return keyed.dropDuplicates(["hit_key"])
    return keyed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["hit_key"])


def stream_seen(stream: DataFrame, days: int, late: str = "1 hour") -> DataFrame:
    """O58. The seen store as keyed state with expiry: (hit_key, what, at) of a stream of hits (hit_key, ts).

    what is new where a key is not in the state, at its earliest time, and pruned, at the same time,
    once the watermark passes that time by more than `days`; after that the key may be new again.
    One state row a key, dropped with it, so the state holds the keys of `days` only.
    """
    if days < 0:
        raise ValueError("days must not be negative")
    life = pd.Timedelta(days=days)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first = pd.Timestamp(state.get[0], unit="us")
            state.remove()
            yield pd.DataFrame({"hit_key": [key[0]], "what": ["pruned"], "at": [first]})
            return
        first = min(b["ts"].min() for b in batches)
        if not state.exists:
            state.update((first.value // 1000,))
            state.setTimeoutTimestamp(max((first + life).value // 1_000_000, state.getCurrentWatermarkMs()) + 1)
            yield pd.DataFrame({"hit_key": [key[0]], "what": ["new"], "at": [first]})

    keyed = stream.select("hit_key", "ts").withWatermark("ts", late).groupBy("hit_key")
    return keyed.applyInPandasWithState(step, "hit_key string, what string, at timestamp", "first long", "append", GroupStateTimeout.EventTimeTimeout)


def tool_texts(events: DataFrame) -> DataFrame:
    """O60. Text of shell-tool events (event_id, ts, json): all output fields that are not empty joined, of any length.

    An event that names no tool counts as the shell's; one without any output has an empty text.
    """
    e = events.withColumn("e", F.from_json("json", TOOL)).where(F.col("e").isNotNull() & (F.col("e.tool_name").isNull() | F.col("e.tool_name").isin(SHELL)))
    fields = F.array(*[f"e.tool_response.{c}" for c in ("stdout", "stderr", "output", "content", "result")], "e.tool_result_text")
    return e.select("event_id", "ts", F.concat_ws("\n", F.filter(fields, lambda x: x != "")).alias("text"))


def credential_counts(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """O60. Events with each credential kind in tumbling windows. The shapes are matched natively, so it streams without Python."""
    from sluice.operators.credentials import SHAPES

    texts = tool_texts(events)
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?i){s}"), F.lit(k)) for k, s in SHAPES.items()]))
    found = texts.withWatermark("ts", late).select("ts", F.explode(kinds).alias("kind"))
    return found.groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def tool_output_hits(events: DataFrame) -> DataFrame:
    """O60. Kind, offset and length of every credential in shell output."""
    return scan_credentials(tool_texts(events).select(F.col("event_id").cast("string").alias("text_id"), "text"))


def gate(path: Column, dest: Column, same: Column, dest_orgs: Column, source_orgs: Column) -> Column:
    """O61. What happens to a write: scan, scan-warn or refuse."""
    none = lambda o: F.coalesce(F.size(o), F.lit(0)) <= 0
    return (
        F.when(path.rlike(OVERRIDE), "refuse")
        .when(dest.isNull() | same, "scan")
        .when(none(dest_orgs), "scan-warn")
        .when(none(source_orgs), "scan")
        .when(F.arrays_overlap(dest_orgs, source_orgs), "scan")
        .otherwise("refuse")
    )


def write_gate(events: DataFrame, boundaries: DataFrame) -> DataFrame:
    """O61. Verdict of each write (event_id, file_path, dest_repo, launcher_repo) against the boundaries (repo, orgs) of both repos; stateless."""
    d = boundaries.select(F.col("repo").alias("dest_repo"), F.col("orgs").alias("dest_orgs"), F.lit(True).alias("tree"))
    s = boundaries.select(F.col("repo").alias("launcher_repo"), F.col("orgs").alias("source_orgs"))
    both = events.join(few(d), "dest_repo", "left").join(few(s), "launcher_repo", "left")
    tree = F.when(F.col("tree"), F.col("dest_repo"))
    return both.select("event_id", "file_path", "dest_repo", "launcher_repo", gate(F.col("file_path"), tree, F.col("dest_repo") == F.col("launcher_repo"), F.col("dest_orgs"), F.col("source_orgs")).alias("verdict"))
