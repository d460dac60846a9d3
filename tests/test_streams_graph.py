"""Streams against their batch forms, and commit graphs against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import graph, sweep
from sluice.plans import queries_b
from sluice.sources import files
from sluice.streaming import streams


def stream_of(spark, df, folder):
    df.write.mode("overwrite").json(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(folder)


def run(df, path, checkpoint, mode="append"):
    q = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_new_hits_once(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(t + datetime.timedelta(minutes=i), "q", "r", f"p{i % 3}", 1) for i in range(9)]
    hits = spark.createDataFrame(rows, "ts timestamp, name string, repo string, path string, line_no int").repartition(3)
    live = stream_of(spark, hits, str(tmp_path / "in"))
    for _ in range(2):  # a replay with the same checkpoint adds nothing
        run(streams.stream_new_hits(live, "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["hit_key"] for r in spark.read.json(str(tmp_path / "out")).collect()) == sorted(r["hit_key"] for r in streams.stream_new_hits(hits, "1 day").collect())


def test_long_tool_output_counts(spark):
    key = "ghp" + "_" + "a1B2" * 9
    # the length depends on a row, so that the 9 MB text is made in the task and is no constant of the plan
    event = f"to_json(named_struct('tool_name', 'bash', 'tool_response', named_struct('stdout', concat(repeat('line of output ', cast(600000 + id AS int)), '{key}')))) AS json"
    events = spark.range(1).selectExpr("id AS event_id", "timestamp '2024-01-01' AS ts", event)
    assert streams.tool_texts(events).selectExpr("octet_length(text) AS n").first()["n"] > 8 << 20
    assert [r["n"] for r in streams.credential_counts(events).collect()] == [1]


def test_tool_output_windows(spark, data, tmp_path):
    events = queries_b.tool_events(spark, data)
    batch = {(str(r["start"]), r["kind"], r["n"]) for r in streams.credential_counts(events).collect()}
    live = stream_of(spark, events.repartition(1), str(tmp_path / "in"))
    q = streams.credential_counts(live).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r["start"]), r["kind"], r["n"]) for r in spark.sql("select * from counts").collect()} == batch


def test_write_gate(spark):
    b = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", []), ("d", ["x", "y"])], "repo string, orgs array<string>")
    rows = [(1, "f", "a", "b", "refuse"), (2, "f", "a", "a", "scan"), (3, "f", "c", "a", "scan-warn"), (4, "f", "a", "c", "scan"), (5, "f", "a", "d", "scan"), (6, "f", "no", "a", "scan"), (7, "x/.leak-scan.yml", "a", "a", "refuse")]
    e = spark.createDataFrame(rows, "event_id int, file_path string, dest_repo string, launcher_repo string, want string")
    got = {r["event_id"]: r["verdict"] for r in streams.write_gate(e, b).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_reachability(spark):
    # 1 - 2 - 3 - 5 - 6, 2 - 4 - 5
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (5, 3), (5, 4), (6, 5)], "child long, parent long")
    tips = spark.createDataFrame([("a", 6), ("b", 4), ("c", 9)], "tip string, sha long")
    got = {}
    for r in graph.reachable_commits(edges, tips, hops=2).collect():
        got.setdefault(r["tip"], set()).add(r["sha"])
    assert got == {"a": {1, 2, 3, 4, 5, 6}, "b": {1, 2, 4}, "c": {9}}


def test_reachability_over_many_fronts(spark):
    # a line of commits with side branches: fronts of one and two rows, kept apart and joined in turn
    pairs = [(n, n - 1) for n in range(1, 10)] + [(9, 20), (20, 5), (30, 29)]
    tips = [("a", 9), ("b", 4), ("d", None)]
    want = set()
    for tip, sha in tips:
        todo = [] if sha is None else [sha]
        while todo:
            at = todo.pop()
            if (tip, at) not in want:
                want.add((tip, at))
                todo += [p for c, p in pairs if c == at]
    found = graph.reachable_commits(spark.createDataFrame(pairs, "child long, parent long"), spark.createDataFrame(tips, "tip string, sha long"), hops=2).collect()
    assert sorted(map(tuple, found)) == sorted(want)
    none = spark.createDataFrame([], "tip string, sha long")
    assert graph.reachable_commits(spark.createDataFrame(pairs, "child long, parent long"), none).collect() == []


def ancestors(pairs, sha):
    out, todo = set(), [sha]
    while todo:
        if (at := todo.pop()) not in out:
            out.add(at)
            todo += [p for c, p in pairs if c == at]
    return out


def history(rng, n):
    """Edges (child, parent) of a graph with long runs, branches and merges; a larger number is younger."""
    pairs = []
    for v in range(2, n):
        pairs.append((v, v - 1 if rng.random() < 0.8 else rng.randrange(1, v)))
        if rng.random() < 0.15:
            pairs.append((v, rng.randrange(1, v)))
    return pairs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reachability_at_random(spark, seed):
    rng = random.Random(seed)
    pairs = history(rng, 60)
    tips = [(rng.choice("abcde"), rng.randrange(1, 60)) for _ in range(8)] + [("z", None), ("y", 999)]
    want = {(t, a) for t, sha in tips if sha is not None for a in ancestors(pairs, sha)}
    rows = pairs + pairs[:5] + [(7, 7), (None, 3), (3, None)]
    got = graph.reachable_commits(spark.createDataFrame(rows, "child long, parent long"), spark.createDataFrame(tips, "tip string, sha long"), hops=2).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """100,000 commits in a line: rounds by the logarithm, also from the middle of the line."""
    cuts, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: cuts.append(1) or cut(df))
    edges = spark.range(1, 100_000).selectExpr("id AS child", "id - 1 AS parent")
    tips = spark.createDataFrame([("top", 99_999), ("mid", 40_000), ("mid", 30_000)], "tip string, sha long")
    got = {r["tip"]: (r["n"], r["low"], r["high"]) for r in graph.reachable_commits(edges, tips).groupBy("tip").agg(F.count("*").alias("n"), F.min("sha").alias("low"), F.max("sha").alias("high")).collect()}
    assert got == {"top": (100_000, 0, 99_999), "mid": (40_001, 0, 40_000)}
    assert len(cuts) < 20


def test_ring_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (4, 3)], "child long, parent long")
    got = graph.reachable_commits(edges, spark.createDataFrame([("a", 5), ("b", 2)], "tip string, sha long")).collect()
    assert sorted(map(tuple, got)) == [("a", x) for x in range(1, 6)] + [("b", x) for x in range(1, 4)]


@pytest.mark.parametrize("seed", [4, 5])
def test_new_ref_plan_against_loop(spark, seed):
    """Modes, bases and counts of new refs over a random history."""
    rng = random.Random(seed)
    pairs = history(rng, 40)
    news, remotes = [(f"n{i}", rng.randrange(1, 40)) for i in range(8)], [(f"r{i}", rng.randrange(1, 25)) for i in range(3)]
    known = set().union(*(ancestors(pairs, s) for _, s in remotes))
    want = {}
    for ref, sha in news:
        fresh = ancestors(pairs, sha) - known
        border = {p for c, p in pairs if c in fresh and p in known}
        common = set.intersection(*(ancestors(pairs, b) for b in border)) if border else set()
        best = {c for c in common if not any(c != d and c in ancestors(pairs, d) for d in common)}
        if not fresh:
            want[ref] = ("nothing-new", None, 0, 0)
        elif len(border) == 1:
            want[ref] = ("incremental", min(border), len(fresh), 1)
        else:
            want[ref] = ("widened", min(best), len(fresh), len(border)) if len(border) > 1 and best else ("full-history", None, len(fresh), len(border))
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graph.new_ref_plan(table(pairs, "child long, parent long"), table(news, "ref string, sha long"), table(remotes, "name string, sha long")).collect()
    assert {r["ref"]: (r["mode"], r["base"], r["n_new"], r["n_border"]) for r in got} == want


def test_new_ref_plan(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (5, 3), (5, 4), (6, 3), (8, 7)], "child long, parent long")
    refs = lambda rows: spark.createDataFrame(rows, "ref string, sha long")
    remotes = spark.createDataFrame([("o/a", 3), ("o/b", 4)], "name string, sha long")
    got = {r["ref"]: (r["mode"], r["base"]) for r in graph.new_ref_plan(edges, refs([("merge", 5), ("one", 6), ("old", 2), ("apart", 8)]), remotes).collect()}
    assert got == {"merge": ("widened", 2), "one": ("incremental", 3), "old": ("nothing-new", None), "apart": ("full-history", None)}


def test_push_routes(spark):
    rows = spark.createDataFrame([("0" * 40, "a"), ("a", "0" * 40), ("a", "b")], "local_sha string, remote_sha string")
    assert [r["route"] for r in graph.route_pushes(rows).collect()] == ["skip", "new-ref", "range"]


def test_prune_needs_days(spark):
    with pytest.raises(ValueError):
        sweep.prune_seen(None, -1, "2024-01-01")


def test_seen_state_expires_as_the_batch_prunes(spark, tmp_path):
    """A key is new once, pruned when its days are over, and new again after that."""
    day = lambda n, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=h)
    rng = random.Random(17)
    first = [(f"k{i}", day(rng.randrange(20), rng.randrange(24))) for i in range(40)]
    again = [(k, t + datetime.timedelta(hours=2)) for k, t in first[:10]]
    parts = [first + again, [("late", day(60))], [("k0", day(61)), ("last", day(61))]]
    folder = str(tmp_path / "in")
    schema = "hit_key string, ts timestamp"
    for rows in parts:  # one batch each, so that the watermark passes between them
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        live = spark.readStream.schema(schema).json(folder)
        run(streams.stream_seen(live, 10), str(tmp_path / "out"), str(tmp_path / "cp"))
    told = [(r["hit_key"], r["what"], r["at"]) for r in spark.read.schema("hit_key string, what string, at timestamp").json(str(tmp_path / "out")).collect()]
    want = {k: min(t for n, t in first + again if n == k) for k, _ in first}
    assert {(k, t) for k, w, t in told if w == "pruned"} == set(want.items())
    assert sorted(k for k, w, _ in told if w == "new") == sorted([*want, "late", "k0", "last"])
    seen = spark.createDataFrame([(k, t.date()) for k, t in want.items()] + [("late", day(60).date()), ("odd", None)], "hit_key string, first_seen date")
    counts = sweep.prune_counts(seen, 10, "2024-03-02").first()
    assert counts["pruned"] == sum(w == "pruned" for _, w, _ in told) and counts["kept"] == 2
    assert sweep.prune_seen(seen, 10, "2024-03-02").count() == counts["kept"]


def test_audit_stream_is_written_once(spark, tmp_path):
    """Stopped and started again, with new files between: every record once, in the folder of its day."""
    schema = "ts timestamp, action string, actor string"
    record = lambda i: (datetime.datetime(2024, 1, 1 + i % 3), f"a{i % 2}", f"u{i}")
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (range(5), range(5, 9), range(0)):
        spark.createDataFrame([record(i) for i in part], schema).coalesce(1).write.mode("append").json(source)
        for _ in range(2):
            q = files.stream_audit(spark.readStream.schema(schema).json(source), out, cp).trigger(availableNow=True).start()
            q.awaitTermination(120)
    got = files.read_audit(spark, out, schema)
    assert sorted((r["action"], r["actor"]) for r in got.where("_corrupt_record is null").collect()) == sorted(record(i)[1:] for i in range(9))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("day=")) == ["day=2024-01-01", "day=2024-01-02", "day=2024-01-03"]
    assert [r["actor"] for r in files.read_audit(spark, out, schema, tail=1).collect()] in (["u2"], ["u5"], ["u8"])


def test_runs_are_kept(spark, tmp_path):
    root = str(tmp_path / "runs")
    assert files.load_runs(spark, root, "name string").count() == 0
    q = spark.createDataFrame([("a",), ("b",)], "name string")
    none = spark.createDataFrame([], "name string, truncated boolean")
    status = spark.createDataFrame([("b", False, True)], "name string, ok boolean, throttled boolean")
    first = sweep.sweep_summary(q, none, none, status, files.load_runs(spark, root, "name string"))
    assert [(r["name"], r["ok"], r["throttled"], r["degraded"], r["total_new"], r["previous_run"]) for r in first.orderBy("name").collect()] == [("a", True, False, True, 0, None), ("b", False, True, True, 0, None)]
    for run_no, at in ((1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"), (2, "2024-01-03 00:00:00")):
        files.save_run(q, root, run_no, at)
    for before, at in ((3, "2024-01-03"), (2, "2024-01-01")):
        runs = files.load_runs(spark, root, "name string", before)
        assert {str(r["previous_run"])[:10] for r in sweep.sweep_summary(q, none, none, status, runs).collect()} == {at}
