"""Query rules, tool output, prose caps and names against the cases that decide them."""

import random
import re

from sluice.operators import credentials, policy, scanning, suggest, sweep
from sluice.streaming import streams


def test_query_rules(spark):
    rows = [
        ("a", "org:acme 'two words'", None), ("b", 'ORG:acme "two words"', None), (" ", "org:acme one", None), ("", "org:acme one", "empty name"), ("a", "org:acme", "duplicate name"),
        ("c", "", "empty query"), ("d", "two words", "no org filter"), ("e", "org:acme two words", "bare words"), ("f", "word org:acme", None), ("g", "platform-org:acme x", "bare words"),
    ]
    df = spark.createDataFrame([(i, n, q) for i, (n, q, _) in enumerate(rows)], "pos int, name string, query string")
    got = {r["pos"]: r["issue"] for r in sweep.validate_queries(df).collect()}
    assert got == {i: issue for i, (_, _, issue) in enumerate(rows)}


def test_tool_output_without_a_name(spark):
    rows = [
        ('{"tool_response": {"stdout": "a", "stderr": "", "result": "b"}}', "a\nb"), ('{"tool_name": "Bash", "tool_result_text": "c"}', "c"), ('{"tool_name": "editor", "tool_result_text": "d"}', None),
        ('{"tool_name": "bash", "tool_response": {"stdout": ""}}', ""), ("nonsense", ""),
    ]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(rows)], "event_id int, json string").selectExpr("event_id", "current_timestamp() AS ts", "json")
    got = {r["event_id"]: r["text"] for r in streams.tool_texts(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(rows) if t is not None}


def plain_prose(files):
    """Projection, the cap of a file and the repository's cap, one file after the other."""

    def cut(text, limit):
        data = text.encode()
        if len(data) <= limit:
            return text
        short = data[:limit].decode("utf-8", "ignore")
        return short.rsplit("\n", 1)[0] + "\n... [truncated]"

    out, used = {}, 0
    for path, text in files:
        if path == "LICENSE":
            text = "\n".join(x for x in text.split("\n") if "copyright" in x.lower())
        text = cut(text, suggest.FILE_CAP)
        size = len(text.encode())
        if used + size > suggest.REPO_CAP:
            if used < suggest.REPO_CAP:
                out[path] = cut(text, suggest.REPO_CAP - used)
            break
        used += size
        if text.strip():
            out[path] = text
    return out


def test_prose_caps(spark, monkeypatch):
    monkeypatch.setattr(suggest, "FILE_CAP", 60)
    monkeypatch.setattr(suggest, "REPO_CAP", 230)
    line = "wörter und zeilen\n"
    files = [("README.md", line * 3), ("CODEOWNERS", line * 5), ("LICENSE", "text\nCopyright us\nmore"), *[(f"docs/d{i}.md", line * 4 if i != 1 else " \n ") for i in range(6)]]
    df = spark.createDataFrame([("r", p, t) for p, t in files] + [("s", "LICENSE", "nothing of the kind")], "repo string, path string, text string")
    got = {(r["repo"], r["path"]): r["text"] for r in suggest.select_prose(df).collect()}
    assert got == {("r", p): t for p, t in plain_prose(files).items()}


def test_names_keep_their_case(spark):
    tokens = spark.createDataFrame([("React",), ("react",)], "token string")
    names = spark.createDataFrame([("react",)], "name string")
    assert [r["token"] for r in suggest.filter_dependencies(tokens, names).collect()] == ["React"]
    commits = spark.createDataFrame([("r", 1, "me@Corp.example"), ("r", 2, "a@b@c"), ("r", 3, "none")], "repo string, pos int, email string")
    assert {r["domain"] for r in suggest.author_domains(commits).collect()} == {"corp.example", "b@c"}


def test_prose_names(spark):
    paths = {"README.adoc": "readme", "sub/README-zh.md": "readme", "LICENSE-MIT": "license", "docs/a.md": "doc", "docs/deep/a.md": None, "a.md": "doc", "src/a.md": None, "CODEOWNERS": "codeowners", "package.json": "package", "sub/package.json": None, "node_modules/README": None, "my-token.md": None}
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("kind", suggest.prose_kind())
    assert {r["path"]: r["kind"] for r in df.collect()} == paths


def test_text_hygiene(spark):
    real, zero = "4829" + "13047716", "0" * 12
    lines = [f"id {real} and {real}", f"https://{real}.dkr.ecr.eu-west-1.amazonaws.com/x", f"acme-{real}.d.codeartifact.eu-central-1.AMAZONAWS.com", f"acme-{zero}.d.codeartifact.eu-central-1.amazonaws.com", "a\x00b\x00", "123456789012", f"{real}1", "", None]
    got = scanning.text_hygiene(spark.createDataFrame(list(enumerate(lines)), "n_line int, line string"))
    assert got.columns == ["n_line", "kind", "n"]
    assert sorted(map(tuple, got.collect())) == [(0, "account-id", 2), (1, "account-id", 1), (1, "registry-host", 1), (2, "account-id", 1), (2, "registry-host", 1), (4, "nul", 2)]


def test_attribution_counts_who_is_hidden(spark):
    hits = spark.createDataFrame([("_always", "_always/1"), ("a", "a/1"), ("a", "a/2"), ("b", "b/1"), (None, None)], "engagement string, pattern_id string")
    assert {(r["engagement"], r["pattern_id"], r["hits"], r["engagements"]) for r in scanning.attribution_summary(hits).collect()} == {("_always", "_always/1", 1, 0), (None, "<redacted>", 3, 2), (None, None, 1, 0)}
    stems = spark.createDataFrame([(["a", "_always", "b"],)], "stems array<string>").select(scanning.redact_stems("stems").alias("s")).first()["s"]
    assert stems == ["<redacted>", "_always", "<redacted>"]


def test_audit_verdict(spark):
    repos = spark.createDataFrame([("open", "public-eligible", "public", True, True), ("play", "scratch", "unknown", True, True), ("dir", "scratch", "public", True, False), ("bare", "private-strict", "private", False, True)], "repo string, class string, visibility string, public boolean, is_repo boolean")
    checks = policy.plan_checks(repos, ["markers", "visibility", "egress"], repos.where("repo <> 'bare'"))
    found = [("open", "markers", True), ("open", "egress", False), ("play", "markers", False), ("dir", "markers", False)]
    got = {(r["repo"], r["check"]): r for r in policy.audit_verdict(spark.createDataFrame(found, "repo string, check string, informational boolean"), checks).collect()}
    told = {k: (r["skip_reason"], r["advised"], r["failed"], r["ok"]) for k, r in got.items()}
    assert told["open", "markers"] == (None, 0, 0, True) and told["open", "egress"] == (None, 0, 1, False)
    assert told["play", "markers"] == (None, 1, 0, True) and told["play", "visibility"] == ("visibility not known", 0, 0, True)
    assert told["dir", "markers"] == ("not a repository", 0, 0, True) and told["bare", "markers"] == ("empty deny set", 0, 0, True)
    assert told["bare", "egress"] == ("not public-facing", 0, 0, True)
    assert told["open", None] == (None, 0, 1, False) and told["play", None] == (None, 1, 0, True)
    assert (got[None, None]["run"], got[None, None]["skipped"], got[None, None]["failed"]) == (6, 6, 1)


def test_published_audit_says_where_nothing_was_asked(spark):
    key = "ghp" + "_" + "a1B2" * 9
    rows = spark.createDataFrame([("p", "a", key), ("q", "b", "clean"), ("q", "c", key), ("r", "d", "clean")], "package string, path string, text string")
    hits = spark.createDataFrame([("p", "a")], "package string, path string")
    got = credentials.published_audit(rows, hits, spark.createDataFrame([("p",)], "package string")).collect()
    assert {tuple(r) for r in got} == {("p", "MARKER", 1, 1, False), ("p", "GITHUB_TOKEN", 1, 1, False), ("q", "GITHUB_TOKEN", 1, 1, False), ("q", "NO_MARKER_PATTERNS", 0, 0, True), ("r", "NO_MARKER_PATTERNS", 0, 0, True)}


def test_credentials_against_loop(spark):
    """Kinds, UTF-16 offsets and lengths of every shape in whole texts."""
    rng = random.Random(31)
    parts = ["ghp_" + "a1B2" * 9, "ghs_" + "x" * 300, "github_pat_" + "A_1" * 8, "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "-_" * 5, "-" * 5 + "BEGIN EC PRIVATE KEY" + "-" * 5, "AKIA" + "B2" * 8, "token = '" + "0f" * 20, "é", "😀", " ", "\n", "x", "password: " + "ab" * 15]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(300)]
    got = credentials.scan_credentials(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "text_id string, text string")).collect()
    wide = lambda s: len(s.encode("utf-16-le")) // 2
    want = {(str(i), k, wide(t[: m.start()]), wide(m[0])) for i, t in enumerate(texts) for k, shape in credentials.SHAPES.items() for m in re.finditer(shape, t, re.I)}
    assert len(got) == len(want) > 300 and {tuple(r) for r in got} == want
