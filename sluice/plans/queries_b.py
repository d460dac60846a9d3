"""Queries O44 to O90 over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import host_allowed, host_of, host_to_marker, parse_remote, truncate_utf8
from sluice.operators import credentials, egress, graph, policy, scanning, semantic, suggest, sweep
from sluice.operators.patterns import active, scope_deny_set
from sluice.plans import queries_a as A
from sluice.plans import tables as T
from sluice.plans.tables import AS_OF, read
from sluice.sources.files import load_runs, save_run
from sluice.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
long = A.long


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#]*)', 1))"
ALLOWED = ["therha.example.com"]
URLS_SQL = "urls AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://User:tok@') WHEN 1 THEN replace(url, '.example.', '.EXAMPLE.') WHEN 2 THEN url ELSE 'https://npm.pkg.github.com/p' || page_id END AS url FROM pages)"


def urls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").selectExpr("page_id", "CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://User:tok@') WHEN 1 THEN replace(url, '.example.', '.EXAMPLE.') WHEN 2 THEN url ELSE 'https://npm.pkg.github.com/p' || page_id END AS url")


@query("o44_hosts", f"WITH {URLS_SQL}, h AS (SELECT page_id, {HOST_SQL} AS host FROM urls) SELECT page_id, host, host IN ('therha.example.com') OR host LIKE '%.github.com' AS allowed FROM h")
def o44(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("page_id", host_of("url").alias("host")).withColumn("allowed", host_allowed("host", ALLOWED))


LOCKS = {  # kind: (file name, text with {u} for the page's URL and {i} for its id, package, line, value)
    "npm-lock": ("package-lock.json", '{{"packages": {{"node_modules/p{i}": {{"resolved": "{u}"}}, "x": {{"resolved": "https://registry.npmjs.org/x"}}}}, "dependencies": {{"a": {{"resolved": "https://registry.npmjs.org/a", "dependencies": {{"b": {{"resolved": "{u}"}}}}}}}}}}'),
    "yarn-lock": ("yarn.lock", '# yarn\\np{i}@1:\\n  version "1"\\n  resolved "{u}"\\nq{i}@2:\\n  resolution: "{u}"\\n'),
    "pnpm-lock": ("pnpm-lock.yaml", "packages:\\n  p{i}:\\n    resolution:\\n      tarball: \\'{u}\\'\\n"),
    "npmrc": (".npmrc", "; c\\n@s:registry={u}\\n//registry.npmjs.org/:_authToken=x\\n"),
    "cargo-lock": ("Cargo.lock", '[[package]]\\nname = "c{i}"\\nsource = "registry+{u}"\\n'),
    "poetry-lock": ("poetry.lock", '[[package]]\\nname = "y{i}"\\n[package.source]\\nurl = "{u}"\\n'),
    "pipfile": ("Pipfile.lock", '{{"_meta": {{"sources": [{{"name": "s{i}", "url": "{u}"}}]}}}}'),
    "requirements": ("requirements-dev.txt", "# r\\nflask\\n--extra-index-url {u}\\n"),
}


def locks(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """A lock file of each kind for every page, with the page's URL as a registry, out of one read."""
    files = []
    for k in kinds:
        name, text = LOCKS[k]
        parts = text.replace("{{", "\x01").replace("}}", "\x02").replace("{u}", "' || url || '").replace("{i}", "' || page_id || '").replace("\x01", "{").replace("\x02", "}")
        files.append(f"named_struct('path', 'p' || page_id || '/{name}', 'text', '{parts}')")
    return read(spark, d, "pages").selectExpr("'src' || (page_id % 20) AS repo", f"inline(array({', '.join(files)}))")


def locks_sql(*kinds: str) -> str:
    rows = {
        "npm-lock": [("package-lock.json", "'node_modules/p' || page_id", "NULL", "url"), ("package-lock.json", "'a > b'", "NULL", "url")],
        "yarn-lock": [("yarn.lock", "NULL", "4", "split_part(url, '#', 1)"), ("yarn.lock", "NULL", "6", "split_part(url, '#', 1)")],
        "pnpm-lock": [("pnpm-lock.yaml", "'packages > p' || page_id || ' > resolution'", "NULL", "url")],
        "npmrc": [(".npmrc", "NULL", "2", "'@s:registry=' || url")],
        "cargo-lock": [("Cargo.lock", "'c' || page_id", "3", "'registry+' || url")],
        "poetry-lock": [("poetry.lock", "'y' || page_id", "4", "url")],
        "pipfile": [("Pipfile.lock", "'s' || page_id", "NULL", "url")],
        "requirements": [("requirements-dev.txt", "NULL", "3", "'--extra-index-url ' || url")],
    }
    one = [f"SELECT 'src' || (page_id % 20) AS repo, 'p' || page_id || '/{n}' AS path, '{k}' AS kind, {HOST_SQL} AS host, CAST({p} AS VARCHAR) AS pkg, CAST({ln} AS BIGINT) AS line, {v} AS value FROM pages" for k in kinds for n, p, ln, v in rows[k]]
    return f"SELECT * FROM ({' UNION ALL '.join(one)}) WHERE host <> 'therha.example.com'"


def shown(df: DataFrame) -> DataFrame:
    return df.select("repo", "path", "kind", "host", "pkg", *long("line"), "value")


@query("o45_egress_findings", f"WITH {T.REPOS_SQL}, f AS ({locks_sql(*LOCKS)}) SELECT f.* FROM f JOIN repos r USING (repo) WHERE r.public")
def o45(spark: SparkSession, d: str) -> DataFrame:
    return shown(egress.egress_findings(locks(spark, d, *LOCKS), T.repos(spark, d), ALLOWED))


@query("o46_npm_lock", locks_sql("npm-lock"))
def o46(spark: SparkSession, d: str) -> DataFrame:
    return shown(egress.npm_lock(locks(spark, d, "npm-lock"), ALLOWED))


@query("o47_line_locks", locks_sql("yarn-lock", "npmrc", "requirements"))
def o47(spark: SparkSession, d: str) -> DataFrame:
    parts = [egress.yarn_lock(locks(spark, d, "yarn-lock"), ALLOWED), egress.npmrc(locks(spark, d, "npmrc"), ALLOWED), egress.requirements(locks(spark, d, "requirements"), ALLOWED)]
    return shown(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("o48_toml_locks", locks_sql("cargo-lock", "poetry-lock"))
def o48(spark: SparkSession, d: str) -> DataFrame:
    return shown(egress.toml_lock(locks(spark, d, "cargo-lock"), "cargo-lock", ALLOWED).unionByName(egress.toml_lock(locks(spark, d, "poetry-lock"), "poetry-lock", ALLOWED)))


@query("o49_pipfile", locks_sql("pipfile"))
def o49(spark: SparkSession, d: str) -> DataFrame:
    return shown(egress.pipfile(locks(spark, d, "pipfile"), ALLOWED))


@query("o50_pnpm_lock", locks_sql("pnpm-lock"))
def o50(spark: SparkSession, d: str) -> DataFrame:
    return shown(egress.pnpm_lock(locks(spark, d, "pnpm-lock"), ALLOWED))


KIND = "CASE page_id % 6 WHEN 0 THEN 'npmrc' WHEN 1 THEN 'pip' WHEN 2 THEN 'docker' WHEN 3 THEN 'maven' WHEN 4 THEN 'cargo' ELSE 'yarnrc' END"


SECOND = "'m' || (page_id % 50) || '.corp.example'"  # a second host on one line of pip, a credential store, another scope


@query(
    "o51_harvest_env_hosts",
    f"""WITH own AS (SELECT 's' || page_id AS source, {KIND} AS kind, page_id % 3 AS priority, {HOST_SQL} AS host, page_id FROM pages),
rows AS (SELECT source, kind, priority, host FROM own UNION ALL SELECT source, kind, priority, {SECOND} FROM own WHERE kind IN ('pip', 'docker', 'yarnrc')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority, source) AS n, count(*) OVER (PARTITION BY host) AS seen FROM rows)
SELECT host, source, kind, host <> 'therha.example.com' AS private, seen FROM ranked WHERE n = 1""",
)
def o51(spark: SparkSession, d: str) -> DataFrame:
    text = (
        "CASE page_id % 6 WHEN 0 THEN '# c\\nregistry=' || url WHEN 1 THEN '[global]\\nextra-index-url = ' || url || ' https://' || m || '/simple'"
        " WHEN 2 THEN '{\"auths\": {\"' || url || '\": {\"auth\": \"x\"}}, \"credsStore\": \"' || m || '\"}' WHEN 3 THEN '<mirror><url> ' || url || ' </url></mirror>' WHEN 4 THEN '[r]\\nindex = \"sparse+' || url || '\"'"
        " ELSE 'npmRegistryServer: \"' || url || '\"\\nnpmScopes:\\n  s:\\n    npmRegistryServer: \"https://' || m || '\"' END"
    )
    pages = read(spark, d, "pages").selectExpr("page_id", "url", f"{SECOND} AS m")
    configs = pages.selectExpr("'s' || page_id AS source", f"{KIND} AS kind", "page_id % 3 AS priority", f"{text} AS text")
    return egress.harvest_env_hosts(configs, ALLOWED).select("host", "source", "kind", "private", "seen")


@query("o52_host_to_marker", f"WITH h AS (SELECT DISTINCT {HOST_SQL} AS host FROM pages UNION SELECT DISTINCT 'h' || (page_id % 9) || '.io' FROM pages) SELECT host, CASE WHEN length(host) >= 6 THEN replace(host, '.', '\\.') END AS marker FROM h")
def o52(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    hosts = p.select(host_of("url").alias("host")).union(p.selectExpr("'h' || (page_id % 9) || '.io'")).distinct()
    return hosts.select("host", host_to_marker("host").alias("marker"))


ASKED = r"SELECT doc_id AS pos, CASE WHEN doc_id % 20 = 0 THEN '' WHEN doc_id = 10 THEN ' ' WHEN doc_id % 10 = 1 THEN 'dup' ELSE 'q' || doc_id END AS name, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN source WHEN 2 THEN 'org:acme two ' || lang WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'ORG:acme \"two ' || lang || '\"' ELSE 'org:acme \"two ' || lang || '\"' END ELSE 'org:acme ' || lang END AS query FROM documents"


@query(
    "o53_validate_queries",
    f"""WITH asked AS ({ASKED.replace(chr(92) + '"', '"')}), p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS place FROM asked)
SELECT pos, CASE WHEN name = '' THEN 'empty name' WHEN place > 1 THEN 'duplicate name' WHEN query = '' THEN 'empty query' WHEN lower(query) NOT LIKE 'org:%' THEN 'no org filter' WHEN query LIKE 'org:acme two%' THEN 'bare words' END AS issue FROM p""",
)
def o53(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.sql(ASKED.replace("FROM documents", "FROM {documents}"), documents=read(spark, d, "documents"))
    return sweep.validate_queries(asked).select("pos", "issue")


SEARCHES = [("licence", 'org:org1 "license"', ["org9"], ["src7"]), ("eranea", "ORG:org2 eranea", [], []), ("ndble", 'org:org0 "ndble"', [], ["src0"]), ("other", "org:org4 ndble", ["org4"], []), ("none", "org:org3 nowheretobefound", [], [])]


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "name string, query string, exclude_org array<string>, exclude_repo array<string>")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return A.lines(spark, d).selectExpr("'org' || (cast(regexp_extract(repo, '([0-9]+)$', 1) AS int) % 6) AS org", "repo", "path", "line_no", "line")


CANDIDATES_SQL = f"""{T.LINES_SQL}, searches(name, phrase, org, xorg, xrepo) AS (VALUES ('licence', 'license', 'org1', 'org9', 'src7'), ('eranea', 'eranea', 'org2', '', ''), ('ndble', 'ndble', 'org0', '', 'src0'), ('other', 'ndble', 'org4', 'org4', ''), ('none', 'nowheretobefound', 'org3', '', '')),
corpus AS (SELECT 'org' || (CAST(regexp_extract(repo, '([0-9]+)$', 1) AS INTEGER) % 6) AS org, * FROM lines),
candidates AS (SELECT s.name, c.org, c.repo, c.path, c.line_no, 'v1|' || s.name || '|' || c.repo || '|' || c.path || '|' || c.line_no AS hit_key FROM corpus c JOIN searches s ON s.org = c.org AND contains(lower(c.line), s.phrase) WHERE c.org <> s.xorg AND c.repo <> s.xrepo),
old AS (SELECT hit_key FROM candidates WHERE line_no = 1), fresh AS (SELECT DISTINCT * FROM candidates WHERE hit_key NOT IN (SELECT hit_key FROM old)),
capped AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY encode(hit_key)) AS place, count(*) OVER (PARTITION BY name) > 40 AS truncated FROM fresh)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return sweep.sweep(corpus(spark, d), searches(spark))


def fresh(spark: SparkSession, d: str) -> DataFrame:
    """New hits, where hits on first lines have been seen before."""
    c = candidates(spark, d)
    return sweep.new_hits(c, c.where("line_no = 1").select(sweep.hit_key().alias("hit_key")))


@query("o54_sweep", f"WITH {CANDIDATES_SQL} SELECT name, org, repo, path, CAST(line_no AS BIGINT) AS line_no FROM candidates")
def o54(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("name", "org", "repo", "path", *long("line_no"))


@query("o55_new_hits", f"WITH {CANDIDATES_SQL} SELECT name, hit_key FROM fresh")
def o55(spark: SparkSession, d: str) -> DataFrame:
    return fresh(spark, d).select("name", "hit_key")


@query("o56_cap_per_query", f"WITH {CANDIDATES_SQL} SELECT name, hit_key, place, truncated FROM capped WHERE place <= 40")
def o56(spark: SparkSession, d: str) -> DataFrame:
    return sweep.cap_per_query(fresh(spark, d), 40).select("name", "hit_key", *long("place"), "truncated")


@query("o57_stream_new_hits", "SELECT event_type AS name, count(DISTINCT (user_id, props)) AS hits FROM events GROUP BY 1")
def o57(spark: SparkSession, d: str) -> DataFrame:
    """The batch form; tests run the stream and compare."""
    e = read(spark, d, "events").selectExpr("ts", "event_type AS name", "'u' || user_id AS repo", "props AS path", "cast(null AS int) AS line_no")
    return streams.stream_new_hits(e, "30 days").groupBy("name").agg(F.count("*").alias("hits"))


@query("o58_prune_seen", f"WITH {A.SEEN_SQL} SELECT hit_key, CAST(first_seen AS VARCHAR) AS first_seen FROM seen WHERE first_seen IS NULL OR first_seen >= DATE '2024-06-01' - 60")
def o58(spark: SparkSession, d: str) -> DataFrame:
    from sluice.sources.files import normalise_seen

    return sweep.prune_seen(normalise_seen(A.seen(spark, d)), 60, AS_OF).select("hit_key", F.col("first_seen").cast("string").alias("first_seen"))


@query("o58_prune_counts", f"WITH {A.SEEN_SQL} SELECT count(*) FILTER (first_seen IS NULL OR first_seen >= DATE '2024-06-01' - 60) AS kept, count(*) FILTER (first_seen < DATE '2024-06-01' - 60) AS pruned FROM seen")
def o58b(spark: SparkSession, d: str) -> DataFrame:
    from sluice.sources.files import normalise_seen

    return sweep.prune_counts(normalise_seen(A.seen(spark, d)), 60, AS_OF)


@query(
    "o59_sweep_summary",
    f"""WITH {CANDIDATES_SQL} SELECT s.name, s.name <> 'other' AS ok, s.name = 'ndble' AS throttled, (SELECT count(*) FROM candidates c WHERE c.name = s.name) AS total, (SELECT count(*) FROM capped c WHERE c.name = s.name AND place <= 40) AS new, coalesce((SELECT bool_or(truncated) FROM capped c WHERE c.name = s.name), false) AS truncated, true AS degraded, (SELECT CAST(count(*) AS BIGINT) FROM capped WHERE place <= 40) AS total_new, TIMESTAMP '2024-05-02 06:00:00' AS previous_run FROM searches s""",
)
def o59(spark: SparkSession, d: str) -> DataFrame:
    q = searches(spark)
    status = q.select("name", (F.col("name") != "other").alias("ok"), (F.col("name") == "ndble").alias("throttled"))
    found, capped, root = candidates(spark, d), sweep.cap_per_query(fresh(spark, d), 40), f"{A.shared_root(spark)}/runs-{uuid.uuid4().hex}"
    for run, began in enumerate(["2024-05-01 06:00:00", "2024-05-02 06:00:00"], 1):  # two earlier runs, kept as they were
        save_run(sweep.sweep_summary(q, found, capped, status).select("name", "new"), root, run, began)
    last = sweep.sweep_summary(q, found, capped, status, load_runs(spark, root, "name string, new long", before=3))
    return last.withColumn("previous_run", F.col("previous_run").cast("timestamp_ntz"))


def tool_events(spark: SparkSession, d: str) -> DataFrame:
    """Documents as output of a shell, a minute apart; every fifth comes from another tool."""
    return read(spark, d, "documents").selectExpr("doc_id AS event_id", "timestamp_micros(1704067200000000 + doc_id * 60000000) AS ts", "to_json(named_struct('tool_name', CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'editor' ELSE 'bash' END, 'tool_response', named_struct('stdout', text, 'stderr', cast(null AS string)), 'tool_result_text', 'done')) AS json")


KINDS_SQL = " UNION ALL ".join(f"SELECT ts, '{k}' AS kind FROM t WHERE regexp_matches(text, '(?i){s}')" for k, s in credentials.SHAPES.items()).replace("[\\x22']", "[\\x22\\x27]")


@query("o60_stream_tool_output", f"WITH t AS (SELECT make_timestamp(1704067200000000 + doc_id * 60000000) AS ts, text || chr(10) || 'done' AS text FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 <> 0), k AS ({KINDS_SQL}) SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, kind, count(*) AS n FROM k GROUP BY ALL")
def o60(spark: SparkSession, d: str) -> DataFrame:
    """The batch form; tests run the stream and compare."""
    return streams.credential_counts(tool_events(spark, d)).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")


REMOTE_SQL = "lower(nullif(regexp_extract(remote_url, 'github\\.com(?:-[A-Za-z0-9_.-]+)?[:/]([^/:]+)/([^/]+?)(?:\\.git)?/?$', {0}), ''))"
OWNED = [("beta", "beta-co"), ("alpha", "org2"), ("gamma", "org5")]
PERSONAL = ["org0", "org1"]
BOUNDARY_SQL = f"""owned(id, org) AS (VALUES ('beta', 'beta-co'), ('alpha', 'org2'), ('gamma', 'org5')),
orgs AS (SELECT repo, o.org FROM repos r JOIN owned o ON list_contains(r.engagements, o.id) UNION SELECT repo, unnest(['org0', 'org1']) FROM repos WHERE class = 'public-eligible'),
boundaries AS (SELECT r.repo, r.class, coalesce((SELECT list(org ORDER BY org) FROM orgs o WHERE o.repo = r.repo), CASE WHEN {REMOTE_SQL.format(1)} IS NULL THEN [] ELSE [{REMOTE_SQL.format(1)}] END) AS orgs, NOT EXISTS (SELECT 1 FROM orgs o WHERE o.repo = r.repo) AS from_remote FROM repos r)"""


def owned(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OWNED, "id string, org string")


def personal(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o,) for o in PERSONAL], "org string")


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    return policy.trust_boundaries(T.repos(spark, d), owned(spark), personal(spark))


@query(
    "o61_write_gate",
    f"""WITH {T.REPOS_SQL}, {BOUNDARY_SQL}, e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'a/.leak-scan.yml' ELSE 'src/' || event_id END AS f, 'src' || (event_id % 25) AS dest, 'src' || (user_id % 20) AS src FROM events)
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'refuse' WHEN d.repo IS NULL OR dest = src THEN 'scan' WHEN len(d.orgs) = 0 THEN 'scan-warn' WHEN coalesce(len(s.orgs), 0) = 0 THEN 'scan' WHEN list_has_any(d.orgs, s.orgs) THEN 'scan' ELSE 'refuse' END AS verdict FROM e LEFT JOIN boundaries d ON d.repo = dest LEFT JOIN boundaries s ON s.repo = src""",
)
def o61(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 9 = 0 THEN 'a/.leak-scan.yml' ELSE 'src/' || event_id END AS file_path", "'src' || (event_id % 25) AS dest_repo", "'src' || (user_id % 20) AS launcher_repo")
    return streams.write_gate(e, boundaries(spark, d)).select("event_id", "verdict")


EXPIRES = "CASE WHEN substr(blob, 1, 1) < '8' THEN '2024-06-01' WHEN substr(blob, 1, 1) < 'c' THEN NULL ELSE '2024-05-31' END"
WAIVERS_SQL = f"waivers AS (SELECT DISTINCT pattern_id AS pattern, blob, 'seen in ' || substr(blob, 1, 4) AS reason, CASE WHEN substr(blob, 2, 1) < '2' THEN '' ELSE 'me' END AS approver, CASE WHEN substr(blob, 2, 1) > 'd' THEN 'soon' ELSE '2024-01-01' END AS date, {EXPIRES} AS expires FROM hits WHERE pattern_id IS NOT NULL)"


def waivers(hits: DataFrame) -> DataFrame:
    """A waiver for each pattern and blob that was hit."""
    return hits.where("pattern_id is not null").selectExpr("pattern_id AS pattern", "blob", "'seen in ' || substr(blob, 1, 4) AS reason", "CASE WHEN substr(blob, 2, 1) < '2' THEN '' ELSE 'me' END AS approver", "CASE WHEN substr(blob, 2, 1) > 'd' THEN 'soon' ELSE '2024-01-01' END AS date", f"{EXPIRES} AS expires").distinct()


@query("o62_apply_waivers", f"WITH {T.hits_sql(T.EXEMPT_SQL)}, {WAIVERS_SQL} SELECT h.repo, h.path, CAST(h.line_no AS BIGINT) AS line_no, h.pattern_id, w.pattern IS NOT NULL AS waived, w.reason FROM hits h LEFT JOIN waivers w ON w.pattern = h.pattern_id AND w.blob = h.blob AND h.engagement = '_always' AND (w.expires IS NULL OR w.expires >= '2024-06-01')")
def o62(spark: SparkSession, d: str) -> DataFrame:
    hits = A.file_hits(spark, d)
    return policy.apply_waivers(hits, waivers(hits), AS_OF).select("repo", "path", *long("line_no"), "pattern_id", "waived", "reason")


@query("o63_validate_waivers", f"WITH {T.hits_sql(T.EXEMPT_SQL)}, {WAIVERS_SQL} SELECT pattern, blob, CASE WHEN approver = '' THEN 'approver' WHEN date = 'soon' THEN 'date' END AS issue, coalesce(expires < '2024-06-01', false) AS expired FROM waivers")
def o63(spark: SparkSession, d: str) -> DataFrame:
    return policy.validate_waivers(waivers(A.file_hits(spark, d)), AS_OF).select("pattern", "blob", "issue", "expired")


@query("o64_parse_remote", f"WITH {T.REPOS_SQL} SELECT repo, {REMOTE_SQL.format(1)} AS org, {REMOTE_SQL.format(2)} AS name FROM repos")
def o64(spark: SparkSession, d: str) -> DataFrame:
    return T.repos(spark, d).select("repo", parse_remote("remote_url").alias("r")).select("repo", "r.org", F.col("r.repo").alias("name"))


RULES = [(1, "corp\\.EXAMPLE", "private-strict"), (2, "org[0-9]/src1", "scratch"), (3, "git", "customer-coupled")]


@query(
    "o65_classify_repos",
    f"""WITH {T.REPOS_SQL}, {BOUNDARY_SQL}, r AS (SELECT *, {REMOTE_SQL.format(1)} AS org FROM repos), m AS (SELECT r.*, o.id, CASE WHEN regexp_matches(remote_url, '(?i)corp\\.example') THEN 'private-strict' WHEN regexp_matches(remote_url, '(?i)org[0-9]/src1') THEN 'scratch' WHEN regexp_matches(remote_url, '(?i)git') THEN 'customer-coupled' END AS rule FROM r LEFT JOIN owned o ON o.org = r.org),
s AS (SELECT *, CASE WHEN class_explicit THEN 'already-classified' WHEN remote_url IS NULL THEN 'skipped' WHEN org IN ('org0', 'org1') OR id IS NOT NULL THEN 'applied' WHEN rule IS NOT NULL THEN 'needs-confirmation' ELSE 'skipped' END AS status FROM m)
SELECT repo, status, CASE WHEN class_explicit THEN class WHEN org IN ('org0', 'org1') THEN 'public-eligible' WHEN id IS NOT NULL THEN 'customer-coupled' ELSE rule END AS class, CASE WHEN status = 'applied' THEN id END AS engagement, CASE WHEN status = 'skipped' THEN CASE WHEN remote_url IS NULL THEN 'no remote' ELSE 'no match' END END AS reason, coalesce(status = 'applied' AND id = 'gamma', false) AS inert_engagement FROM s""",
)
def o65(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "pos int, pattern string, class string")
    return policy.classify_repos(T.repos(spark, d), personal(spark), owned(spark), rules, spark.createDataFrame([("gamma",)], "id string"))


@query("o66_effective_config", f"WITH {T.REPOS_SQL} SELECT repo, CASE WHEN n % 4 = 1 THEN CASE WHEN n % 5 = 0 THEN 'private-strict' ELSE 'scratch' END ELSE class END AS class, NOT (n % 4 = 1 AND n % 5 = 0) AS class_explicit, array_to_string(CASE WHEN len(engagements) > 0 THEN engagements ELSE ['delta'] END, ',') AS engagements FROM repos")
def o66(spark: SparkSession, d: str) -> DataFrame:
    r = T.repos(spark, d)
    config = r.selectExpr("repo", "CASE WHEN n % 4 = 1 THEN 'nonsense' ELSE class END AS class", "engagements")
    override = r.selectExpr("repo", "CASE WHEN n % 5 = 0 THEN 'wrong' ELSE 'scratch' END AS class", "array('delta') AS engagements")
    return policy.effective_config(config, override).withColumn("engagements", F.array_join("engagements", ","))


CHECKS_SQL = """checks AS (SELECT 'visibility' AS "check", repo, 'public but not public-eligible' AS message FROM repos WHERE visibility = 'public' AND class <> 'public-eligible'
UNION ALL SELECT 'remote', repo, m FROM (SELECT repo, CASE WHEN class = 'scratch' AND remote_url IS NOT NULL THEN 'scratch with a remote' WHEN class = 'customer-coupled' AND remote_url IS NULL THEN 'coupled without a remote' WHEN class = 'customer-coupled' AND len(engagements) > 0 AND len(list_filter(engagements, lambda e: contains(lower(remote_url), e))) = 0 THEN 'remote does not name the engagement' END AS m FROM repos) WHERE m IS NOT NULL
UNION ALL SELECT 'engagement', repo, 'coupled without engagement' FROM repos WHERE class = 'customer-coupled' AND len(engagements) = 0)"""


@query("o67_repo_checks", f'WITH {T.REPOS_SQL}, {CHECKS_SQL} SELECT "check", repo, message FROM checks')
def o67(spark: SparkSession, d: str) -> DataFrame:
    return policy.repo_checks(T.repos(spark, d))


@query(
    "o68_audit_verdict",
    f"""WITH {T.hits_sql(T.EXEMPT_SQL)}, {CHECKS_SQL}, findings AS (SELECT repo, 'markers' AS "check", path_exempt AND engagement = '_always' AS informational FROM hits UNION ALL SELECT repo, "check", false FROM checks UNION ALL SELECT f.repo, 'egress', false FROM ({locks_sql("cargo-lock")}) f WHERE f.repo IN (SELECT repo FROM repos WHERE public)),
kinds AS (SELECT unnest(['markers', 'visibility', 'remote', 'engagement', 'egress']) AS "check"), ran AS (SELECT repo, "check", CASE WHEN n % 9 = 8 THEN 'not a repository' WHEN "check" = 'markers' AND n % 6 = 5 THEN 'empty deny set' WHEN "check" = 'visibility' AND n % 7 = 1 THEN 'visibility not known' WHEN "check" = 'egress' AND NOT public THEN 'not public-facing' END AS reason, class = 'scratch' AND "check" IN ('markers', 'egress') AS advisory FROM repos, kinds),
rows AS (SELECT r.repo, r."check", r.reason, r.advisory, count(f."check") AS found, count(*) FILTER (coalesce(f.informational, false)) AS informational FROM ran r LEFT JOIN findings f ON f.repo = r.repo AND f."check" = r."check" GROUP BY ALL)
SELECT repo, "check", CAST(sum(found) AS BIGINT) AS found, CAST(sum(informational) AS BIGINT) AS informational, count(*) FILTER (reason IS NULL) AS run, count(*) FILTER (reason IS NOT NULL) AS skipped, CASE WHEN GROUPING("check") = 0 THEN max(reason) END AS skip_reason,
count(*) FILTER (reason IS NULL AND found > informational AND advisory) AS advised, count(*) FILTER (reason IS NULL AND found > informational AND NOT advisory) AS failed, count(*) FILTER (reason IS NULL AND found > informational AND NOT advisory) = 0 AS ok FROM rows GROUP BY ROLLUP (repo, "check")""",
)
def o68(spark: SparkSession, d: str) -> DataFrame:
    r = T.repos(spark, d)
    hits = A.file_hits(spark, d).select("repo", F.lit("markers").alias("check"), F.coalesce(F.col("path_exempt") & (F.col("engagement") == "_always"), F.lit(False)).alias("informational"))
    private = egress.egress_findings(locks(spark, d, "cargo-lock"), r, ALLOWED).select("repo", F.lit("egress").alias("check"))
    findings = hits.unionByName(policy.repo_checks(r).select("repo", "check").unionByName(private).withColumn("informational", F.lit(False)))
    asked = r.withColumn("is_repo", F.expr("n % 9 <> 8")).withColumn("visibility", F.expr("CASE WHEN n % 7 = 1 THEN 'unknown' ELSE visibility END"))
    return policy.audit_verdict(findings, policy.plan_checks(asked, ["markers", "visibility", "remote", "engagement", "egress"], r.where("n % 6 <> 5")))


@query("o69_fixture_audit", f"WITH {T.hits_sql('false')} SELECT repo, path, CAST(line_no AS BIGINT) AS line_no, preview, engagement, engagement = '_always' AS informational FROM hits WHERE path LIKE 'tests/fixtures/%'")
def o69(spark: SparkSession, d: str) -> DataFrame:
    return scanning.fixture_audit(T.files(spark, d), A.deny_sets(spark, d), A.scoped(spark, d), A.GLOBS).select("repo", "path", *long("line_no"), "preview", "engagement", "informational")


SHAPES_SQL = " UNION ALL ".join(f"SELECT repo, path, '{k}' AS what, len(regexp_extract_all(text, '(?i){s}')) AS n FROM files" for k, s in credentials.SHAPES.items()).replace("[\\x22']", "[\\x22\\x27]")


@query("o70_published_audit", f"WITH {T.hits_sql('false')}, f AS (SELECT repo, path, 'MARKER' AS what, 1 AS n FROM hits UNION ALL SELECT * FROM ({SHAPES_SQL}) WHERE n > 0) SELECT repo AS package, what, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT path) AS files, false AS informational FROM f WHERE what <> 'MARKER' OR repo NOT LIKE '%7' GROUP BY ALL UNION ALL SELECT DISTINCT repo, 'NO_MARKER_PATTERNS', 0, 0, true FROM files WHERE repo LIKE '%7'")
def o70(spark: SparkSession, d: str) -> DataFrame:
    sets = A.deny_sets(spark, d).where("repo NOT LIKE '%7'")  # packages without any pattern in force
    hits = scanning.scan_lines(A.lines(spark, d), sets).select(F.col("repo").alias("package"), "path")
    return credentials.published_audit(T.files(spark, d).select(F.col("repo").alias("package"), "path", "text"), hits, sets.select(F.col("repo").alias("package")))


@query("o71_trust_boundaries", f"WITH {T.REPOS_SQL}, {BOUNDARY_SQL} SELECT a.repo, b.repo AS other, CAST(len(list_intersect(a.orgs, b.orgs)) AS BIGINT) AS shared FROM boundaries a JOIN boundaries b ON a.repo < b.repo AND list_has_any(a.orgs, b.orgs)")
def o71(spark: SparkSession, d: str) -> DataFrame:
    return policy.overlapping(boundaries(spark, d))


EDGES_SQL = "edges AS (SELECT CAST(o_orderkey AS BIGINT) AS child, CAST(o_orderkey // 4 AS BIGINT) AS parent FROM orders WHERE o_orderkey > 0 UNION SELECT o_orderkey, (o_orderkey * 3) // 11 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey > 0), tops AS (SELECT max(o_orderkey) AS top FROM orders)"
REACH_SQL = "WITH RECURSIVE {0}, reach AS ({1} UNION SELECT r.tip, e.parent FROM reach r JOIN edges e ON e.child = r.sha)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A commit graph from order keys: one parent each, every fifth a second one."""
    o = read(spark, d, "orders").select("o_orderkey").where("o_orderkey > 0")
    one = o.selectExpr("o_orderkey AS child", "o_orderkey div 4 AS parent")
    return one.unionByName(o.where("o_orderkey % 5 = 0").selectExpr("o_orderkey AS child", "(o_orderkey * 3) div 11 AS parent")).distinct()


def tips(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """Named refs at the newest commits."""
    top = read(spark, d, "orders").agg(F.max("o_orderkey").alias("top"))
    return top.select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "tip"), "top").select("tip", (F.col("top") - F.col("i") * 5).alias("sha"))


@query("o72_reachable_commits", REACH_SQL.format(EDGES_SQL, "SELECT tip, top - 5 * i AS sha FROM tops, (VALUES ('main', 0), ('dev', 1), ('old', 2)) v(tip, i)") + " SELECT tip, sha FROM reach")
def o72(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable_commits(edges(spark, d), tips(spark, d, ["main", "dev", "old"]))


@query("o73_already_public", f"WITH {A.HISTORY_HITS_SQL}, known AS (SELECT DISTINCT source AS repo, sha256(CAST(doc_id AS VARCHAR)) AS sha FROM documents WHERE length(text) % 2 = 0) SELECT h.repo, h.sha, h.pattern_id, r.public AND k.sha IS NOT NULL AS already_public, CASE WHEN r.public AND k.sha IS NOT NULL THEN 'warn' ELSE 'block' END AS action FROM history_hits h JOIN repos r USING (repo) LEFT JOIN known k ON k.repo = h.repo AND k.sha = h.sha")
def o73(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "documents").where("length(text) % 2 = 0").selectExpr("source AS repo", "sha2(cast(doc_id AS string), 256) AS sha")
    return graph.already_public(A.history_hits(spark, d), T.repos(spark, d), known).select("repo", "sha", "pattern_id", "already_public", "action")


@query("o74_new_ref_plan")
def o74(spark: SparkSession, d: str) -> DataFrame:
    news = tips(spark, d, ["a", "b", "c"]).withColumnRenamed("tip", "ref").unionByName(tips(spark, d, ["r"]).select(F.lit("same").alias("ref"), (F.col("sha") - 20).alias("sha")))
    remotes = tips(spark, d, ["x"]).select(F.lit("origin").alias("name"), (F.col("sha") - 20).alias("sha"))
    return graph.new_ref_plan(edges(spark, d), news, remotes)


REFS = "vec_id % 100 = 0"  # queries are the rows whose id is divisible by 100, against all rows


@query("o75_cosine", f"SELECT q.vec_id AS query_id, count(*) AS n, round(max(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS best, round(avg(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS mean FROM embeddings q, embeddings e WHERE q.{REFS} AND q.vec_id <> e.vec_id GROUP BY q.vec_id")
def o75(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return semantic.cosine_summary(e, e.where(REFS)).select(F.col("vec_id").alias("query_id"), "n", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"))


@query("o76_semantic_hits", f"WITH p AS (SELECT 'e' || label AS engagement_id, embedding AS ref FROM embeddings WHERE {REFS}), s AS (SELECT vec_id, engagement_id, max(list_cosine_similarity(embedding::DOUBLE[], ref::DOUBLE[])) AS c FROM embeddings, p GROUP BY ALL) SELECT vec_id, engagement_id, round(c, 6) AS similarity FROM s WHERE c >= 0.3")
def o76(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    profiles = e.where(REFS).select(F.concat(F.lit("e"), "label").alias("engagement_id"), F.lit(0.3).alias("threshold"), F.col("embedding").alias("vec"))
    return semantic.semantic_hits(e.select("vec_id", F.col("embedding").alias("vec")), profiles).withColumn("similarity", F.round("similarity", 6))


ENDS = "CASE WHEN n % 4 = 3 THEN '2024-03-01' END"


@query(
    "o77_build_profiles",
    f"""WITH {T.REPOS_SQL}, {T.FILES_SQL}, e AS (SELECT repo AS id, {ENDS} AS ended, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN 'nowhere' ELSE repo END AS r FROM repos)
SELECT e.id, f.path, sha256(f.text) AS sha256, CAST(strlen(f.text) AS BIGINT) AS bytes, NULL AS reason FROM e JOIN files f ON f.repo = e.r WHERE ended IS NULL AND trim(f.text) <> ''
UNION ALL SELECT id, NULL, NULL, NULL, CASE WHEN ended IS NOT NULL THEN 'ended' WHEN r IS NULL THEN 'no repos' ELSE 'no prose' END FROM e WHERE ended IS NOT NULL OR r IS NULL OR r = 'nowhere'""",
)
def o77(spark: SparkSession, d: str) -> DataFrame:
    e = T.repos(spark, d).selectExpr("repo AS id", f"{ENDS} AS ended", "CASE WHEN n % 5 = 0 THEN cast(array() AS array<string>) WHEN n % 5 = 1 THEN array('nowhere') ELSE array('nowhere', repo, 'src0') END AS repos")
    manifest, skipped = semantic.build_profiles(T.files(spark, d).select("repo", "path", "text"), e, AS_OF)
    left = manifest.select(F.col("engagement_id").alias("id"), "path", "sha256", *long("bytes"), F.lit(None).cast("string").alias("reason"))
    return left.unionByName(skipped.selectExpr("id", "cast(null AS string) AS path", "cast(null AS string) AS sha256", "cast(null AS bigint) AS bytes", "reason"))


@query("o78_manifest_diff", f"WITH {T.FILES_SQL}, o AS (SELECT path, blob AS s FROM files JOIN documents USING (doc_id) WHERE lang <> 'de'), n AS (SELECT path, CASE WHEN length(documents.text) % 7 = 0 THEN sha256(documents.text || 'x') ELSE blob END AS s FROM files JOIN documents USING (doc_id) WHERE lang <> 'fr') SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' ELSE 'changed' END AS change, o.s AS old_sha, n.s AS new_sha FROM o FULL JOIN n ON o.path = n.path WHERE o.s IS DISTINCT FROM n.s")
def o78(spark: SparkSession, d: str) -> DataFrame:
    """Between two snapshots the French documents went, the German ones came, and some texts grew."""
    f = read(spark, d, "documents").selectExpr("lang", f"{T.PATH} AS path", "text")
    old = f.where("lang <> 'de'").selectExpr("path", "sha2(text, 256) AS sha256")
    return semantic.manifest_diff(old, f.where("lang <> 'fr'").selectExpr("path", "sha2(CASE WHEN length(text) % 7 = 0 THEN text || 'x' ELSE text END, 256) AS sha256"))


@query("o79_profile_age", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE round((epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts)) / 86.4e9, 6) END AS age_days FROM events")
def o79(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 50 = 0 THEN 'never' ELSE cast(ts AS string) END AS created_at")
    return semantic.profile_age_days(p, AS_OF).select("event_id", F.round("age_days", 6).alias("age_days"))


@query("o80_truncate_utf8", "SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE left(text, list_max(list_filter(range(0, 1001), lambda k: strlen(left(text, k)) <= 1000))) END AS short FROM documents")
def o80(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", truncate_utf8("text", 1000).alias("short"))


NAMED = "CASE doc_id % 10 WHEN 0 THEN 'README.md' WHEN 1 THEN 'docs/d' || doc_id || '.md' WHEN 2 THEN 'CODEOWNERS' WHEN 3 THEN 'LICENSE' WHEN 4 THEN 'package.json' WHEN 5 THEN 'src/secrets.md' WHEN 6 THEN 'node_modules/README.md' WHEN 7 THEN 'n' || doc_id || '.md' WHEN 8 THEN 'a/b/c/d/e/README.md' ELSE 'src/main.c' END"


@query("o81_select_prose")
def o81(spark: SparkSession, d: str) -> DataFrame:
    f = T.files(spark, d).selectExpr("repo", f"'v' || doc_id || '/' || {NAMED} AS p", f"{NAMED} AS n", "text", "doc_id").selectExpr("repo || '/' || doc_id % 50 AS repo", "n AS path", "text")
    return suggest.select_prose(f).select("repo", "path", "kind", "bytes")


@query("o82_project_prose", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)copyright|author|©|\\(c\\)')), chr(10)) AS license, '{\"name\":\"' || source || '\",\"author\":\"' || lang || '\"}' AS package FROM documents")
def o82(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    rows = docs.selectExpr("doc_id", "text", "'license' AS kind").unionByName(docs.selectExpr("doc_id", "'{\"name\": \"' || source || '\", \"scripts\": {}, \"author\": \"' || lang || '\"}' AS text", "'package' AS kind"))
    return suggest.project_prose(rows).groupBy("doc_id").pivot("kind", ["license", "package"]).agg(F.first("text"))


MAILS_SQL = "mails AS (SELECT source AS repo, doc_id AS pos, lower(regexp_extract(text, '[\\p{L}]+')) || '.example' AS domain FROM documents), firsts AS (SELECT repo, domain, min(pos) AS pos FROM mails GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY pos, domain) AS place FROM firsts)"


@query("o83_author_domains", f"WITH {MAILS_SQL} SELECT repo, domain, place FROM ranked WHERE place <= 8")
def o83(spark: SparkSession, d: str) -> DataFrame:
    commits = read(spark, d, "documents").selectExpr("source AS repo", "doc_id AS pos", r"'u' || doc_id || '@' || regexp_extract(text, '[\\p{L}]+', 0) || '.Example' AS email")
    return suggest.author_domains(commits).select("repo", "domain", *long("place"))


RESPONSE = "CASE doc_id % 7 WHEN 0 THEN 'nonsense' WHEN 1 THEN '{\"tokenz\": []}' WHEN 2 THEN '{\"tokens\": [{\"token\": \"' || lang || '\", \"kind\": \"animal\", \"confidence\": 0.5}]}' WHEN 3 THEN '{\"tokens\": [{\"token\": \"' || lang || '\", \"kind\": \"other\", \"confidence\": 1.5}]}' ELSE '{\"tokens\": [{\"token\": \"' || source || '\", \"kind\": \"company\", \"confidence\": 0.9}, {\"token\": \"' || lang || '\", \"kind\": \"other\", \"confidence\": 0.25}]}' END"


@query("o84_parse_token_responses", "SELECT doc_id AS response_id, NULL AS token, NULL AS confidence, CASE doc_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN 'no tokens' ELSE 'bad entry' END AS reason FROM documents WHERE doc_id % 7 < 4 UNION ALL SELECT doc_id, source, 0.9::DOUBLE, NULL FROM documents WHERE doc_id % 7 >= 4 UNION ALL SELECT doc_id, lang, 0.25::DOUBLE, NULL FROM documents WHERE doc_id % 7 >= 4")
def o84(spark: SparkSession, d: str) -> DataFrame:
    parsed = suggest.parse_token_responses(read(spark, d, "documents").selectExpr("doc_id AS response_id", f"{RESPONSE} AS json"))
    good = suggest.tokens_of(parsed).select("response_id", "token", "confidence", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(parsed.where("reason is not null").selectExpr("response_id", "cast(null AS string) AS token", "cast(null AS double) AS confidence", "reason"))


KIND_OF = "CASE doc_id % 6 WHEN 0 THEN 'company' WHEN 1 THEN 'codename' WHEN 2 THEN 'domain' WHEN 3 THEN 'ticket-prefix' WHEN 4 THEN 'account-id' ELSE 'other' END"
W1, W2 = r"regexp_extract(text, '[\\p{L}]+', 0)", r"regexp_extract(text, '([\\p{L}]+)[^\\p{L}]*$', 1)"
TOKEN_OF = f"CASE doc_id % 6 WHEN 0 THEN lower({W1}) || '-' || lower({W2}) WHEN 1 THEN lower({W1}) || '_' || lower({W2}) WHEN 2 THEN lower({W1}) || '.Example.com' WHEN 3 THEN upper({W1}) WHEN 4 THEN cast(doc_id * 1009 AS string) ELSE {W1} || '+' END"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """A token of some kind from every document's first and last words."""
    return read(spark, d, "documents").selectExpr("doc_id", f"{TOKEN_OF} AS token", f"{KIND_OF} AS kind", "(doc_id % 11) / 10.0D AS confidence", "lang")


SQL1, SQL2 = "regexp_extract(text, '[\\p{L}]+')", "regexp_extract(text, '([\\p{L}]+)[^\\p{L}]*$', 1)"
# DuckDB maps one character to one; Unicode's full mapping, which Spark has, writes ß as SS and ends words on ς.
FULL_UPPER = {chr(c): chr(c).upper() for c in range(0x80, 0xFB18) if len(chr(c).upper()) > 1} | {"\u019b": "\ua7dc", "\u0264": "\ua7cb"}
UPPER_SQL = "array_to_string(list_transform(regexp_extract_all({0}, '.'), lambda c: coalesce(MAP {{" + ", ".join(f"'{c}': '{u}'" for c, u in FULL_UPPER.items()) + "}}[c], upper(c))), '')"
CASED, SKIPPED = "[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]", "[\\p{{Lm}}\\p{{Mn}}]*"
LOWER_SQL = f"array_to_string(list_transform(regexp_extract_all({{0}}, '.'), lambda c, i: CASE WHEN c = 'İ' THEN 'i\u0307' WHEN c = 'Σ' AND regexp_matches(left({{0}}, i - 1), '{CASED}{SKIPPED}$') AND NOT regexp_matches(substr({{0}}, i + 1), '^{SKIPPED}{CASED}') THEN 'ς' ELSE lower(c) END), '')"
TOKENS_SQL = f"""ends AS (SELECT doc_id, lang, {SQL1} AS w1, {SQL2} AS w2 FROM documents),
lows AS (SELECT *, {LOWER_SQL.format('w1')} AS a, {LOWER_SQL.format('w2')} AS b FROM ends),
tokens AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN a || '-' || b WHEN 1 THEN a || '_' || b WHEN 2 THEN a || '.Example.com' WHEN 3 THEN {UPPER_SQL.format('w1')} WHEN 4 THEN CAST(doc_id * 1009 AS VARCHAR) ELSE w1 || '+' END AS token, {KIND_OF} AS kind, (doc_id % 11) / 10.0::DOUBLE AS confidence, lang, a, b FROM lows),
bodies AS (SELECT *, CASE kind WHEN 'domain' THEN a || '\\.example\\.com' WHEN 'other' THEN a || '\\+' ELSE a || CASE WHEN a <> '' AND b <> '' THEN '[-_ ]?' ELSE '' END || b END AS body FROM tokens),
made AS (SELECT doc_id, token, kind, confidence, lang, CASE WHEN kind = 'ticket-prefix' THEN CASE WHEN regexp_full_match(token, '[A-Z][A-Z0-9]+') THEN '\\b' || token || '-[0-9]+\\b' END WHEN kind = 'account-id' THEN CASE WHEN regexp_full_match(token, '[0-9]{{6,16}}') THEN '\\b' || token || '\\b' END WHEN regexp_matches(token, '[^\\x00-\\x7f]') THEN '(?<!\\p{{L}})' || body || '(?!\\p{{L}})' ELSE '\\b' || body || '\\b' END AS pattern FROM bodies)"""


@query("o85_synthesize_markers", f"WITH {TOKENS_SQL} SELECT doc_id, token, kind, pattern FROM made")
def o85(spark: SparkSession, d: str) -> DataFrame:
    return suggest.synthesize(tokens(spark, d)).select("doc_id", "token", "kind", "pattern")


@query("o86_filter_dictionary", f"WITH words AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS w FROM benchmark), t AS (SELECT doc_id, {SQL1} AS token FROM documents) SELECT doc_id, token FROM t WHERE lower(token) NOT IN (SELECT w FROM words)")
def o86(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return suggest.filter_dictionary(read(spark, d, "documents").selectExpr("doc_id", f"{W1} AS token"), words)


@query("o87_filter_existing", f"WITH {TOKENS_SQL}, have AS (SELECT token AS p FROM made WHERE lang = 'de' UNION SELECT pattern FROM made WHERE lang = 'es' AND pattern IS NOT NULL) SELECT doc_id, token FROM made WHERE NOT EXISTS (SELECT 1 FROM have WHERE p = token) AND NOT EXISTS (SELECT 1 FROM have WHERE p = pattern)")
def o87(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    have = t.where("lang = 'de'").select(F.col("token").alias("pattern")).unionByName(suggest.synthesize(t.where("lang = 'es'")).select("pattern"))
    return suggest.filter_existing(t, have).select("doc_id", "token")


MANIFEST = f"CASE doc_id % 4 WHEN 0 THEN '{{\"dependencies\": {{\"@s/' || {W1} || '\": \"1\"}}, \"devDependencies\": {{\"dev-' || {W1} || '\": \"2\"}}}}' WHEN 1 THEN '[package]\\nname = \"x\"\\n[dependencies]\\nc' || doc_id || ' = \"1\"\\n# no\\n[features]\\nf = []' WHEN 2 THEN 'module m\\nrequire (\\n\\tgh.example/o/g' || doc_id || ' v1.2.3\\n)' ELSE '[project]\\nname = \"y\"\\n[tool.poetry.dependencies]\\npython = \"^3\"\\np.y_' || doc_id || ' = \"1\"' END"


@query("o88_dependency_names", f"WITH w AS (SELECT source AS repo, doc_id, {SQL1} AS w FROM documents) SELECT DISTINCT repo, unnest(CASE doc_id % 4 WHEN 0 THEN ['@s/' || w, w, 'dev-' || w] WHEN 1 THEN ['c' || doc_id] WHEN 2 THEN ['gh.example/o/g' || doc_id, 'g' || doc_id] ELSE ['p.y_' || doc_id, 'p-y-' || doc_id, 'p_y_' || doc_id] END) AS name FROM w")
def o88(spark: SparkSession, d: str) -> DataFrame:
    names = "doc_id || CASE doc_id % 4 WHEN 0 THEN '/package.json' WHEN 1 THEN '/Cargo.toml' WHEN 2 THEN '/go.mod' ELSE '/pyproject.toml' END"
    return suggest.dependency_names(read(spark, d, "documents").selectExpr("source AS repo", f"{names} AS path", f"{MANIFEST} AS text")).select("repo", "name")


@query("o89_accept_markers", f"WITH {TOKENS_SQL}, own AS (SELECT DISTINCT {LOWER_SQL.format('token')} AS w FROM made WHERE lang = 'fr') SELECT doc_id, token, pattern FROM made WHERE confidence >= 0.6 AND NOT EXISTS (SELECT 1 FROM own WHERE w = {LOWER_SQL.format('token')})")
def o89(spark: SparkSession, d: str) -> DataFrame:
    t = suggest.synthesize(tokens(spark, d))
    return suggest.accept_markers(t, 0.6, t.where("lang = 'fr'").select(F.col("token").alias("identity"))).select("doc_id", "token", "pattern")


@query(
    "o90_repo_status",
    f"""WITH {T.SCOPED_SQL}, e(id, name, active) AS (VALUES ('alpha', 'Alpha Ltd', true), ('beta', 'Beta Co', false))
SELECT r.repo, r.class, r.public, coalesce((SELECT string_agg(u || ':' || coalesce(e.name, u) || ':' || CASE WHEN e.active THEN 'active' ELSE 'inactive' END, ',' ORDER BY u) FROM (SELECT unnest(r.engagements) AS u) x LEFT JOIN e ON e.id = u), '') AS allowed,
coalesce((SELECT string_agg(DISTINCT stem, ',' ORDER BY stem) FROM scoped s WHERE s.repo = r.repo), '') AS denying, (SELECT count(*) FROM scoped s WHERE s.repo = r.repo) AS n_patterns, (SELECT count(*) FROM scoped s WHERE s.repo = r.repo AND stem = '_always') AS n_always, CASE WHEN r.class NOT IN ('customer-coupled', 'scratch') AND len(r.engagements) > 0 THEN 'class ' || r.class || ' ignores ' || array_to_string(r.engagements, ',') ELSE '' END AS warnings FROM repos r""",
)
def o90(spark: SparkSession, d: str) -> DataFrame:
    e = spark.createDataFrame([("alpha", "Alpha Ltd", None), ("beta", "Beta Co", "2020-01-01")], "id string, name string, ended string")
    return policy.repo_status(T.repos(spark, d), scope_deny_set(T.repos(spark, d), T.markers(spark)), e, active(AS_OF))


@query("o90_unarmed_engagements", f"WITH {T.TERMS_SQL}, marked AS (SELECT DISTINCT stem FROM all_markers WHERE stem NOT LIKE '%3') SELECT id, name FROM engagements WHERE active AND id NOT IN (SELECT stem FROM marked)")
def o90b(spark: SparkSession, d: str) -> DataFrame:
    """Active engagements of which the registry holds no marker."""
    return policy.unarmed_engagements(T.engagements(spark, d), T.terms(spark, d).where("id NOT LIKE '%3'"), active(AS_OF))
