"""Scanning against a plain loop, and the cases that decide between patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions.text import pattern_id
from sluice.operators import automaton, credentials, patterns, policy, scanning
from sluice.plans import queries_a, queries_b
from sluice.sources import patches
from sluice.sources.files import explode_lines, parse_diffs, parse_history, sort_files

PEM = "-" * 5 + "BEGIN RSA PRIVATE KEY" + "-" * 5
RULES = [("_always", 0, "-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("_always", 1, "AKIA[A-Z0-9]{16}"), ("customer-z", 0, "zed-corp"), ("customer-z", 1, "zed")]


def setup(spark):
    repos = spark.createDataFrame([("r", "private-strict", [], False)], "repo string, class string, engagements array<string>, public boolean")
    scoped = patterns.scope_deny_set(repos, spark.createDataFrame(RULES, "stem string, ord int, pattern string"))
    return scoped, patterns.assemble_deny_sets(scoped)


def files(spark, *rows):
    return spark.createDataFrame([("r", p, "b" * 40, t) for p, t in rows], "repo string, path string, blob string, text string")


def test_exempt_path_still_reports_customers(spark):
    scoped, sets = setup(spark)
    got = scanning.scan_files(files(spark, ("test/fixtures/k.pem", f"{PEM} zed-corp\n{PEM}")), sets, scoped, ["**/fixtures/**"]).collect()
    assert [(r["line_no"], r["engagement"]) for r in got] == [(1, "customer-z")]
    assert len(scanning.scan_files(files(spark, ("src/k.pem", f"{PEM} zed-corp\n{PEM}")), sets, scoped, ["**/fixtures/**"]).collect()) == 2


def test_allow_comment(spark):
    scoped, sets = setup(spark)
    text = "zed // leak-scan: allow reason\nzed // leak-scan: allowed\nzed"
    assert sorted(r["line_no"] for r in scanning.scan_files(files(spark, ("a", text)), sets, scoped).collect()) == [2, 3]


def test_suppression_resumes(spark):
    scoped, sets = setup(spark)
    line = "AKIA" + "A" * 9 + "EXAMPLE zed-corp"
    hits = scanning.scan_lines(explode_lines(files(spark, ("a", line))), sets)
    got = scanning.suppress_known(hits, sets).collect()
    assert [(r["match"], r["suppressed"]) for r in got] == [("zed-corp", 1)]


def test_against_loop(spark):
    rng = random.Random(11)
    words = ["zed", "ZED-corp", "AKIA" + "B" * 16, "plain", PEM, "x", "é😀"]
    texts = [("f%d" % i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(5))) for i in range(60)]
    scoped, sets = setup(spark)
    got = {(r["path"], r["line_no"], r["column"], r["engagement"]) for r in scanning.scan_files(files(spark, *texts), sets, scoped).collect()}
    whole = re.compile("|".join(f"(?:{p})" for _, _, p in RULES), re.I)
    want = set()
    for path, text in texts:
        for n, line in enumerate(text.split("\n"), 1):
            if m := whole.search(line):
                column = len(line[: m.start()].encode("utf-16-le")) // 2 + 1
                want.add((path, n, column, next(s for s, _, p in RULES if re.search(p, m[0], re.I))))
    assert got == want


def test_bytes_that_are_no_text(spark):
    """Invalid UTF-8 in one text hides nothing in it or in others."""
    scoped, sets = setup(spark)
    rows = spark.createDataFrame([("r", p, "b" * 40, t) for p, t in [("a", b"\xff\xfe zed\nx"), ("b", "é zed-corp".encode()), ("c", b"\x80\x80\nzed"), ("d", b"")]], "repo string, path string, blob string, raw binary")
    texts = rows.coalesce(1).select("repo", "path", "blob", F.col("raw").cast("string").alias("text"))
    assert sorted((r["path"], r["line_no"]) for r in scanning.scan_files(texts, sets, scoped).collect()) == [("a", 1), ("b", 1), ("c", 2)]
    assert [r[3] for r in patches.cut_diff(b"diff --git a/x b/x\n@@ -0,0 +1 @@\n+\xffzed")] == ["\ufffdzed"]


def test_sets_by_scope(spark):
    """Putting each distinct set together once gives every repo what it gets by itself."""
    rng = random.Random(18)
    repos = [(f"r{i}", rng.choice(["scratch", "customer-coupled", "private-strict", None]), rng.choice([["a"], ["a", "b"], ["b", "a"], [], None]), rng.choice([True, False, None])) for i in range(60)]
    df = spark.createDataFrame(repos, "repo string, class string, engagements array<string>, public boolean")
    rules = spark.createDataFrame([*RULES, ("a", 0, "aa"), ("b", 0, "bb"), ("_private_infra", 0, "host")], "stem string, ord int, pattern string")
    want = patterns.assemble_deny_sets(patterns.scope_deny_set(df, rules))
    got = patterns.deny_sets(df, rules)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_many_sets_and_patterns(spark):
    """A set of its own for every repo, seeds that overlap, letters that fold, patterns without seeds."""
    rng = random.Random(13)
    words = ["alpha", "alphabet", "betamax", "MAX", "straße", "ΣΊΣΥΦΟΣ", "kelvin", "ſecret", "10.20.30.40", "éclair", "abc", "zz9"]
    rules = [("_always", 0, "alpha"), ("_always", 1, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), ("a", 0, "alphabet"), ("a", 1, "(?:betamax|max)"), ("b", 0, "sísyphos|σίσυφος"), ("b", 1, "KELVIN"), ("c", 0, "SECRET"), ("c", 1, r"\bzz\d"), ("d", 0, "ab?c"), ("d", 1, "Éclair(?= alpha)")]
    repos = [(f"r{i}", "scratch", [x for j, x in enumerate("abcd") if i >> j & 1], False) for i in range(16)]
    scoped = patterns.scope_deny_set(spark.createDataFrame(repos, "repo string, class string, engagements array<string>, public boolean"), spark.createDataFrame(rules, "stem string, ord int, pattern string"))
    rows = [(f"r{i % 16}", f"p{i}", "b" * 40, "\n".join(" ".join(rng.choice([*words, "\u212aelvin", "plain"]) for _ in range(rng.randrange(4))) for _ in range(4))) for i in range(160)]
    got = scanning.scan_files(spark.createDataFrame(rows, "repo string, path string, blob string, text string").repartition(3), patterns.assemble_deny_sets(scoped), scoped)
    want, every = set(), set()
    for repo, path, _, text in rows:
        own = [r for r in rules if r[0] not in repos[int(repo[1:])][2]]
        for n, line in enumerate(text.split("\n"), 1):
            found = [(m.start(), k) for k, r in enumerate(own) if (m := re.search(r[2], line, re.I))]
            every |= {(repo, f"{path}:{n}", own[k][0], own[k][2]) for _, k in found}
            if found:
                matched = re.search(own[min(found)[1]][2], line, re.I)[0]
                want.add((repo, path, n, min(found)[0] + 1, next((r[0] for r in own if re.search(r[2], matched, re.I)), None)))
    assert {(r["repo"], r["path"], r["line_no"], r["column"], r["engagement"]) for r in got.collect()} == want
    lines = explode_lines(spark.createDataFrame(rows, "repo string, path string, blob string, text string")).selectExpr("repo", "concat(path, ':', line_no) AS text_id", "line AS text")
    ids = spark.createDataFrame([r[::2] for r in rules], "stem string, pattern string").withColumn("pattern_id", pattern_id("stem", "pattern"))
    assert {tuple(r) for r in scanning.match_all(lines, scoped).join(ids, ["stem", "pattern_id"]).select("repo", "text_id", "stem", "pattern").collect()} == every


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("licen[sc]e", ["licen"]), ("abc|defg", ["abc", "defg"]), ("abc|d", []), ("(?:abc|xyz)?q+", []), (r"\bAcme\b", ["acme"]), ("a(?:bcd)+e", ["bcd"]), ("(abc)(?!def)ghij", ["ghij"]), ("[a-z&&[^b]]foobar", []), (r"\v{2}abc", []), ("x{0}abc", ["abc"]), ("(unclosed", []), ("foo.*barbaz", ["barbaz"]), ("Σίσ", ["σίσ"])],
)
def test_seeds(pattern, want):
    assert sorted(automaton.seeds(pattern)) == want


def test_seeds_are_required():
    """A text that matches holds a seed, whatever the letters' case."""
    rng = random.Random(14)
    parts = ["abc", "xyz", "k", "s", ".", "[ab]", "(?:foo|bar)", "(?:qux)?", "d{2}", r"\d", "(?=a)", "ß", "İ"]
    for _ in range(400):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        found = automaton.seeds(pattern)
        for _ in range(30):
            text = "".join(rng.choice(["abc", "ABC", "xyz", "k", "S", "f", "foo", "BAR", "qux", "dd", "7", "ß", "İ", "\u212a", "ſ"]) for _ in range(8))
            if found and re.search(pattern, text, re.I):
                assert any(s in automaton.fold(text) for s in found), (pattern, text)
            assert len(automaton.fold(text)) == len(text)


def test_deny_list_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(automaton, "MAX_PATTERNS", 1)
    scoped, sets = setup(spark)
    with pytest.raises(ValueError, match="too large"):
        scanning.scan_files(files(spark, ("a", "zed")), sets, scoped)


def test_hits_are_read_once(spark, data):
    """Placeholders and attribution add no scan of the documents."""
    for name, most in (("o29_scan_lines", 3), ("o35_scan_files", 3), ("o36_scan_diffs", 3), ("o32_attribute", 3), ("o69_fixture_audit", 3)):
        plan = (queries_a.QUERIES | queries_b.QUERIES)[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("FileScan parquet") <= most, name


def plain_diff(text):
    """(path, blob, virtual_line, content) of a diff, line by line."""
    out, path, blob, old, new, n = [], None, None, 0, 0, 0
    for line in text.split("\n"):
        hunk = re.match(r"@@ -[0-9]+(?:,([0-9]+))? \+[0-9]+(?:,([0-9]+))? @@", line)
        if line.startswith("diff --git "):
            path, blob, old, new = (m[1] if (m := re.match("diff --git a/.* b/(.*)", line)) else ""), None, 0, 0
        elif hunk:
            old, new = (1 if g is None else int(g) for g in hunk.groups())
        elif old > 0 or new > 0:
            if line[:1] == "+" and path != "/dev/null":
                n += 1
                out.append((path, blob, n, line[1:]))
            both = line[:1] in ("", " ")
            old, new = old - (line[:1] == "-" or both), new - (line[:1] == "+" or both)
        elif line.startswith("+++ "):
            path = re.sub(r"^b/|\t.*", "", line[4:])
        elif line.startswith("index "):
            blob = m[1] if (m := re.match(r"index [0-9a-f]+\.\.([0-9a-f]{40,64})(?: |$)", line)) else None
    return out


@pytest.mark.parametrize("piece", [1 << 20, 12])
def test_diffs_against_loop(spark, monkeypatch, piece):
    monkeypatch.setattr(patches, "PIECE", piece)
    rng = random.Random(15)
    parts = ["diff --git a/x b/x", "diff --git odd", "--- a/x", "+++ b/y\tdate", "+++ /dev/null", "+++ b/z", f"index {'0' * 40}..{'a' * 40} 100644", "index 12..34", "@@ -1,2 +1,3 @@", "@@ -1 +1 @@ f", "@@ -0,0 +1,4 @@", "@@ odd", "+add", "+", "-del", " ctx", "", "\\ No newline", "+++ é", "+ü😀", "other"]
    for _ in range(400):
        text = "\n".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        got = [(p, b, first + i, line) for p, b, first, lines in patches.cut_diff(text.encode()) for i, line in enumerate(lines.split("\n"))]
        assert got == plain_diff(text), text


def test_long_diff(spark, monkeypatch):
    """One hunk of 300,000 lines comes out in pieces, numbered through."""
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1,300000 @@\n" + "\n".join(f"+line {i}" for i in range(300_000))
    rows = spark.createDataFrame([("d", "r", text), ("e", "r", None), ("f", "r", "")], "diff_id string, repo string, text string")
    assert len(list(patches.cut_diff(text.encode()))) > 3
    got = parse_diffs(rows, ["diff_id", "repo"]).agg(F.count("*"), F.sum("virtual_line"), F.count_if(F.col("content") == F.concat(F.lit("line "), F.col("virtual_line") - 1)), F.min("repo")).first()
    assert tuple(got) == (300_000, 300_000 * 300_001 // 2, 300_000, "r")


@pytest.mark.parametrize("piece", [1 << 20, 12])
def test_logs_against_loop(monkeypatch, piece):
    monkeypatch.setattr(patches, "PIECE", piece)
    rng = random.Random(16)
    parts = [f"commit {'a' * 40} first é", f"commit {'b' * 64}", "commit short", "+one", "-two", " same", "--- a/f", "+++ b/f", "---", "+++", "---x", "+", "", "é"]
    for _ in range(300):
        text, want, at = "\n".join(rng.choice(parts) for _ in range(rng.randrange(20))), [], None
        for line in text.split("\n"):
            if m := re.match("commit ([0-9a-f]{40,64}) ?(.*)$", line):
                at = m.groups()
            elif at and line[:1] in ("+", "-") and not re.match(r"(\+\+\+|---)( |$)", line):
                want.append((*at, line))
        assert [(s, t, x) for s, t, lines in patches.cut_log(text.encode()) for x in lines.split("\n")] == want


def test_diff_headers_inside_hunks(spark):
    blob = "c" * 40
    text = f"diff --git a/x b/x\nindex {'0' * 40}..{blob} 100644\n--- a/x\n+++ b/x\n@@ -1,1 +1,3 @@\n keep\n+++ b/fake\n+two\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-old\n\\ No newline at end of file\ndiff --git a/y b/z\nrename from y\nrename to z\n--- a/y\n+++ b/z\n@@ -4,0 +5 @@ f\n+last"
    got = [tuple(r) for r in parse_diffs(spark.createDataFrame([("d", text)], "diff_id string, text string")).orderBy("virtual_line").collect()]
    assert got == [("d", "x", blob, 1, "++ b/fake"), ("d", "x", blob, 2, "two"), ("d", "z", None, 3, "last")]


def test_history(spark):
    text = f"commit {'a' * 40} first\n--- a/f\n+++ b/f\n+one\n-two\n same\ncommit {'b' * 40} second\n+three"
    got = [tuple(r) for r in parse_history(spark.createDataFrame([(1, "r", text)], "log_id long, repo string, text string")).select("sha", "summary", "sign", "content").collect()]
    assert sorted(got) == [("a" * 40, "first", "+", "one"), ("a" * 40, "first", "-", "two"), ("b" * 40, "second", "+", "three")]


def test_skipped_files(spark):
    rows = [("a", 3, b"abc"), ("b", 4, b"a\x00bc"), ("c", 1 << 21, b"x"), ("d", 0, None)]
    texts, skipped = sort_files(spark.createDataFrame(rows, "path string, length long, content binary"))
    assert [r["path"] for r in texts.collect()] == ["a"]
    assert {r["path"]: r["reason"] for r in skipped.collect()} == {"b": "binary", "c": "too-large", "d": "unreadable"}


def test_credentials(spark):
    token, jwt = "ghp_" + "a1" * 18, "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10
    rows = [("1", f"😀 {token} {PEM}"), ("2", jwt), ("3", "nothing"), ("4", ("-" * 5 + "BEGIN ").encode().hex())]
    hits = credentials.scan_credentials(spark.createDataFrame(rows, "text_id string, text string"))
    got = {r["text_id"]: (r["kinds"], r["n"]) for r in credentials.summarise(hits).collect()}
    assert got == {"1": ("GITHUB_TOKEN,PEM_HEADER", 2), "2": ("JWT", 1), "4": ("PEM_AS_HEX", 1)}
    first = hits.where("kind = 'GITHUB_TOKEN'").first()
    assert (first["offset"], first["length"]) == (3, len(token))
    assert token not in str(hits.collect())


def test_account_ids(spark):
    rows = spark.createDataFrame([("111111111111",), ("123456789012",), ("482913047716",), ("4829130477161",)], "line string")
    assert [r["account"] for r in scanning.scan_account_ids(rows).collect()] == ["482913047716"]


@pytest.mark.parametrize(("as_of", "blob", "waived"), [("2024-05-01", "b" * 40, True), ("2024-05-02", "b" * 40, False), ("2024-05-01", None, False)])
def test_waivers(spark, as_of, blob, waived):
    hits = spark.createDataFrame([("_always/aaaaaaaaaaaa", blob)], "pattern_id string, blob string")
    w = spark.createDataFrame([("_always/aaaaaaaaaaaa", "b" * 40, "why", "me", "2024-01-01", "2024-05-01")], "pattern string, blob string, reason string, approver string, date string, expires string")
    assert policy.apply_waivers(hits, w, as_of).first()["waived"] is waived


def test_floor(spark):
    scoped, _ = setup(spark)
    repos = scoped.select("repo").distinct()
    assert patterns.require_min_patterns(scoped, repos, 4).first()["ok"]
    with pytest.raises(Exception, match="below the floor"):
        patterns.require_min_patterns(scoped, repos, 5).collect()


def test_empty_inputs(spark):
    scoped, sets = setup(spark)
    none = files(spark, ("a", "x")).where(F.lit(False))
    assert scanning.scan_files(none, sets, scoped).collect() == []
    assert parse_diffs(spark.createDataFrame([], "diff_id string, text string")).collect() == []


def test_placeholders_against_loop(spark):
    """Placeholders of always patterns are passed over wherever they stand; the next match of the line counts."""
    rng = random.Random(12)
    example = "AKIA" + "Q" * 9 + "EXAMPLE"
    words = [example, example, "AKIA" + "B" * 16, "zed-corp", "plain", "x"]
    texts = [("%s/f%d" % ("fixtures" if i % 3 == 0 else "src", i), "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(4))) for i in range(60)]
    scoped, sets = setup(spark)
    hits, hidden = scanning.scan_files_in_detail(files(spark, *texts), sets, scoped, ["**/fixtures/**"])
    got = {(r["path"], r["line_no"], r["column"], r["engagement"]) for r in hits.collect()}
    want, left_out = set(), {}
    for path, text in texts:
        rules = [r for r in RULES if not (path.startswith("fixtures/") and r[0] == "_always")]
        whole = re.compile("|".join(f"(?:{p})" for _, _, p in rules), re.I)
        for n, line in enumerate(text.split("\n"), 1):
            at = 0
            while m := whole.search(line, at):
                stem = next(s for s, _, p in RULES if re.search(p, m[0], re.I))
                if stem == "_always" and m[0].endswith("EXAMPLE"):
                    left_out[path] = left_out.get(path, 0) + 1
                    at = m.start() + 1
                    continue
                want.add((path, n, m.start() + 1, stem))
                break
    assert got == want and left_out
    assert {r["path"]: r["suppressed"] for r in hidden.collect()} == left_out
    one = spark.createDataFrame([("d", "r", f"diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+{example} zed-corp")], "diff_id string, repo string, text string")
    assert [r["engagement"] for r in scanning.scan_diffs(one, sets, scoped).collect()] == ["customer-z"]


def test_fixture_folders(spark):
    paths = ["fixtures/a", "a/b/c/d/testdata/e/f/g/h/i", "a/b/c/d/e/fixture/x", "test-fixtures/deep/er", "samples/a", "Fixtures/a", "node_modules/fixtures/a", "fixtures/node_modules/a", "a/fixtures", "x/__fixtures__/y"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"] for r in df.where(scanning.in_fixture("path")).collect()}
    assert got == {"fixtures/a", "a/b/c/d/testdata/e/f/g/h/i", "test-fixtures/deep/er", "fixtures/node_modules/a", "x/__fixtures__/y"}
    scoped, sets = setup(spark)
    hits = scanning.fixture_audit(files(spark, ("fixtures/k", f"{PEM}\nzed"), ("src/k", PEM)), sets, scoped, ["fixtures/**"]).collect()
    assert {(r["line_no"], r["engagement"], r["informational"]) for r in hits} == {(1, "_always", True), (2, "customer-z", False)}
