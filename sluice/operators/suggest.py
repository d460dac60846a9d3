"""Suggesting markers from prose and extracted tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import strip, synthesize_marker, truncate_lines
from sluice.operators.joins import few
from sluice.sources.files import explode_lines

FILE_CAP, REPO_CAP, MAX_FILES, MAX_DOCS, MAX_DEPTH = 16 << 10, 128 << 10, 200, 10, 4
KINDS = ["company", "codename", "person-name", "domain", "ticket-prefix", "account-id", "other"]
# Names that never count as prose.
SKIP_DIRS = ["node_modules", "dist", "build", "coverage", "target", ".next", ".git", ".ssh", ".aws", ".gnupg", "vendor", "third_party", "third-party"]
SKIP_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", ".npmrc", ".netrc", ".env*", "id_*", "*.pem", "*.key", "*.p12", "*.pfx", "*.age", "*secret*", "*token*", "*credentials*"]
SKIP_NAMES = "^(?:" + "|".join(n.replace(".", r"\.").replace("*", ".*") for n in SKIP_FILES) + ")$"


def prose_kind(path: Column | str = "path") -> Column:
    """O81. Which kind of prose a path is, or null."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.lower(F.substring_index(path, "/", -1))
    folder = F.concat(F.lit("/"), F.lower(path))
    skipped = name.rlike(SKIP_NAMES) | folder.rlike("/(?:" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + ")/") | (F.size(F.split(path, "/")) > MAX_DEPTH + 1)
    kind = (
        F.when(name.startswith("readme"), "readme")
        .when(name == "codeowners", "codeowners")
        .when(name.rlike("^licen[sc]e"), "license")
        .when(F.lower(path) == "package.json", "package")
        .when(path.rlike(r"(?i)^(?:docs/)?[^/]+\.md$"), "doc")
    )
    return F.when(~skipped, kind)


def select_prose(files: DataFrame) -> DataFrame:
    """O81, O82. Prose files (repo, path, text), projected by kind, within the caps on files, documents, bytes of a file and of a repo.

    The file that crosses a repo's cap is cut to what is left of it; later ones, and blank ones, are left out.
    """
    kinds = ["readme", "package", "codeowners", "license", "doc"]
    rows = files.withColumn("kind", prose_kind()).where("kind is not null").withColumn("rank", F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")))
    docs = Window.partitionBy("repo", "kind").orderBy("path")
    rows = rows.withColumn("of_kind", F.row_number().over(docs)).where(f"kind <> 'doc' or of_kind <= {MAX_DOCS}")
    order = Window.partitionBy("repo").orderBy("rank", "path")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_FILES)
    rows = project_prose(rows).where((F.col("kind") != "license") | (strip("text") != ""))
    rows = rows.withColumn("text", truncate_lines("text", FILE_CAP)).withColumn("bytes", F.octet_length("text"))
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = (F.lit(REPO_CAP) - F.col("before")).cast("int")
    cut = rows.withColumn("before", before).where(F.col("before") < REPO_CAP).withColumn("text", F.when(F.col("bytes") > left, truncate_lines("text", left)).otherwise(F.col("text")))
    return cut.where(strip("text") != "").select("repo", "path", "kind", "place", F.octet_length("text").alias("bytes"), "text")


def project_prose(files: DataFrame) -> DataFrame:
    """O82. package.json as five keys, a license as its lines on authors, other texts as they are."""
    keys = "name string, description string, repository string, author string, homepage string"
    small = F.to_json(F.from_json("text", keys))
    lines = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"(?i)copyright|author|©|\(c\)")), "\n")
    return files.withColumn("text", F.when(F.col("kind") == "package", F.coalesce(small, "text")).when(F.col("kind") == "license", lines).otherwise(F.col("text")))


def author_domains(commits: DataFrame, n: int = 8) -> DataFrame:
    """O83. The first n distinct mail domains of each repo's commits (repo, pos, email), lower-case."""
    d = commits.select("repo", "pos", F.lower(strip(F.regexp_extract("email", r"(?s)\A[^@]*@(.*)\z", 1))).alias("domain")).where("domain <> ''")
    first = d.groupBy("repo", "domain").agg(F.min("pos").alias("pos"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("pos", "domain"))).where(F.col("place") <= n)


TOKENS = "tokens array<struct<token:string,kind:string,confidence:double>>"


def parse_token_responses(responses: DataFrame) -> DataFrame:
    """O84. Responses (response_id, json) with their tokens, or the reason why one is dropped; one bad entry drops all."""
    parsed = responses.withColumn("tokens", F.from_json("json", TOKENS)["tokens"])
    ok = lambda t: F.coalesce(F.length(t["token"]).between(1, 100) & t["kind"].isin(KINDS) & t["confidence"].between(0, 1), F.lit(False))
    reason = F.when(F.try_parse_json("json").isNull(), "not json").when(F.col("tokens").isNull(), "no tokens").when(~F.forall("tokens", ok), "bad entry")
    return parsed.withColumn("reason", reason)


def tokens_of(parsed: DataFrame) -> DataFrame:
    """O84. The tokens of the responses that were kept."""
    return parsed.where("reason is null").select("response_id", F.explode("tokens").alias("t")).select("response_id", "t.*")


def synthesize(tokens: DataFrame) -> DataFrame:
    """O85."""
    return tokens.withColumn("pattern", synthesize_marker("token", "kind"))


def filter_dictionary(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """O86. Tokens that are no dictionary words (word)."""
    return tokens.withColumn("low", F.lower("token")).join(words.select(F.lower("word").alias("low")).distinct(), "low", "left_anti").drop("low")


def filter_existing(tokens: DataFrame, patterns: DataFrame) -> DataFrame:
    """O87. Tokens neither registered as they are nor by the pattern they give."""
    p = patterns.select("pattern").distinct()
    return synthesize(tokens).join(p.withColumnRenamed("pattern", "token"), "token", "left_anti").join(p, "pattern", "left_anti").select(*tokens.columns)


def dependency_names(manifests: DataFrame) -> DataFrame:
    """O88. Dependencies named in manifests (repo, path, text): full, short and normalised forms."""
    name = F.substring_index("path", "/", -1)
    pkg = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.array_union(F.coalesce(F.map_keys(pkg["dependencies"]), F.array()), F.coalesce(F.map_keys(pkg["devDependencies"]), F.array()))
    npm = manifests.where(name == "package.json").select("repo", F.explode(keys).alias("dep"))
    lines = explode_lines(manifests.where(name.isin("Cargo.toml", "go.mod", "pyproject.toml")), ["repo", "path"]).withColumn("line", F.trim("line"))
    up = Window.partitionBy("repo", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").startswith("["), F.lower(F.regexp_replace("line", r"\s", "")))
    inside = lines.withColumn("section", F.last(head, ignorenulls=True).over(up)).where("line <> '' and not startswith(line, '#') and not startswith(line, '[')")
    of = lambda n: inside.where(name == n)
    cargo = of("Cargo.toml").where(F.col("section").isin("[dependencies]", "[dev-dependencies]", "[build-dependencies]")).select("repo", F.regexp_extract("line", r"^([a-zA-Z0-9_-]+)\s*=", 1).alias("dep"))
    go = explode_lines(manifests.where(name == "go.mod"), ["repo"]).select("repo", F.regexp_extract("line", r"^(?:\s*require)?\s*(\w[\w./-]*)[ \t]+v[0-9]", 1).alias("dep"))
    sections = ["[tool.poetry.dependencies]", "[tool.poetry.dev-dependencies]", "[project.dependencies]", "[dependency-groups.dev]", "[project.optional-dependencies.dev]"]
    py = of("pyproject.toml").where(F.col("section").isin(sections)).select("repo", F.regexp_extract("line", r"""^(?:["'](?=[\w.-])|(?=[\w.-]+\s*=))([\w.-]+)""", 1).alias("dep")).where("dep <> 'python'")
    forms = lambda df, *fs: df.where("dep <> ''").select("repo", F.explode(F.array(F.col("dep"), *fs)).alias("name"))
    short = F.substring_index("dep", "/", -1)
    parts = [forms(npm, short), forms(cargo), forms(go, short), forms(py, F.regexp_replace("dep", "[-_.]+", "-"), F.regexp_replace("dep", "[-_.]+", "_"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def filter_dependencies(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """O88. Tokens that name no dependency, letter case and all."""
    return tokens.join(names.select(F.col("name").alias("token")).distinct(), "token", "left_anti").select(*tokens.columns)


def accept_markers(candidates: DataFrame, threshold: float, identities: DataFrame) -> DataFrame:
    """O89. Candidates sure enough that are not the user's own names (identity)."""
    own = identities.select(F.lower("identity").alias("low")).distinct()
    return candidates.where(F.col("confidence") >= threshold).withColumn("low", F.lower("token")).join(few(own), "low", "left_anti").drop("low")
