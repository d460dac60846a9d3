"""Operator 7: personal data, with information-theoretic sanitisation of the words that give it away.

Base spans come from four patterns. Each found value is a protected entity. Terms are the words of a
text outside its values, wherever they stand. They are counted with the entities of whole texts: a
term discloses an entity as far as the entity's chance given the term, n(term, entity) / n(term) over
distinct texts, exceeds its chance at large. Terms above the threshold are generalised wherever they
stand, in texts without the entity too; those that nearly determine one are removed. All of it is
DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import materialize, row_id, scratch, table
from sluice.llm.spans import SPANS, as_spans, blank, chars, hits, joined, let, redact, running

# The start conditions keep long runs linear; \G admits a match that begins where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
WORD = r"[\p{L}][\p{L}\p{N}'-]{2,}+"
SUPPORT = 3  # distinct texts that must show the pair
DISCLOSES = 0.5  # chance of the entity given the term from which a term is generalised
DETERMINES = 0.9  # and from which it is removed
INFORMATION = 3.0  # bits by which the term must raise the entity's chance
BROADCAST_TERMS = 100_000  # more candidate terms than this are joined by a shuffle
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "general": "<TERM>", "remove": ""}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of x pass Luhn's check."""
    reverse = F.transform(chars(F.reverse(_digits(x))), lambda c, i: F.when(i % 2 == 1, F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])[c.cast("int")]).otherwise(c.cast("int")))
    return F.aggregate(reverse, F.lit(0), lambda acc, v: acc + v) % 10 == 0


def _small(part: Column) -> Column:
    """At most 255, for digits of any number."""
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def base_hits(t: Column) -> dict[str, Column]:
    """Matches that pass their kind's test, by kind."""
    ips = F.filter(hits(t, IP), lambda x: F.forall(F.split(x["hit"], r"\."), _small))
    cards = F.filter(hits(t, CARD), lambda x: (F.length(_digits(x["hit"])) <= 19) & _luhn(x["hit"]))
    phones = F.filter(hits(t, PHONE), lambda x: F.length(_digits(x["hit"])).between(9, 15))
    return {"email": hits(t, EMAIL), "ip": ips, "card": cards, "phone": phones}


def _entity(kind: str) -> Callable[[Column], Column]:
    """Key of a found value: equal for spellings of the same value."""
    same = F.lower if kind == "email" else _digits if kind in ("card", "phone") else lambda x: x
    return lambda e: F.xxhash64(F.lit(kind), same(e["hit"]))


def _words(bare: Column) -> Column:
    return F.regexp_extract_all(bare, F.lit(WORD), F.lit(0))


def _places(bare: Column, remove: Column, general: Column) -> Column:
    """Spans of every word that is among the terms; offsets are running sums over all words, so cost grows with their number."""
    gaps = F.transform(F.split(bare, WORD, -1), lambda g: F.length(g))

    def place(rows: Column) -> Column:
        before = running(F.transform(rows, lambda x: x["gap"] + F.length(x["hit"])), lambda a, b: a + b)
        kind = lambda x: F.when(F.array_contains(remove, F.lower(x["hit"])), "remove").when(F.array_contains(general, F.lower(x["hit"])), "general")
        marked = F.zip_with(rows, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["hit"])).alias("end"), kind(x).alias("kind")))
        span = lambda s: F.struct(s["start"].cast("int").alias("start"), F.when(s["kind"] == "remove", 5).otherwise(4).alias("ord"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))
        return F.transform(F.filter(marked, lambda s: s["kind"].isNotNull()), span)

    rows = F.filter(F.arrays_zip(gaps.alias("gap"), _words(bare).alias("hit")), lambda x: x["hit"].isNotNull())
    return let(rows, place).cast(SPANS)


def _disclosing(texts: DataFrame) -> DataFrame:
    """Terms of distinct texts (copy, entities, words in one string) that disclose an entity: term, determines.

    With n_pair at most n_entity, an entity in fewer than SUPPORT texts, or in too many for INFORMATION
    bits, has no such term, and a term in more than n_entity / DISCLOSES texts does not disclose it.
    So pairs are made only where they can pass; none that passes is lost.
    """
    n_texts = texts.count()
    held = texts.select("copy", F.explode("entities").alias("entity"))
    n_entity = held.groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") >= SUPPORT) & (F.log2(n_texts / F.col("n_entity")) >= INFORMATION))
    held = materialize(held.join(n_entity, "entity"))
    most = held.agg(F.max("n_entity")).first()[0] or 0
    words = texts.select(_term())
    n_term = materialize(words.groupBy("term").agg(F.count("*").alias("n_term")).where((F.col("term") != "") & F.col("n_term").between(SUPPORT, int(most / DISCLOSES))))
    n_terms = n_term.count()
    live = held.groupBy("copy").agg(F.collect_list(F.struct("entity", "n_entity")).alias("held"))
    known = texts.select("copy", "words").join(live, "copy").select("held", _term()).join(_few(n_term, n_terms), "term")
    may = F.filter("held", lambda e: e["n_entity"] >= DISCLOSES * F.col("n_term"))
    pairs = known.select("term", "n_term", F.explode(may).alias("e")).groupBy("term", "n_term", "e").agg(F.count("*").alias("n_pair")).where(F.col("n_pair") >= SUPPORT)
    chance = F.col("n_pair") / F.col("n_term")
    bits = F.log2(chance * n_texts / F.col("e.n_entity"))
    return pairs.where((chance >= DISCLOSES) & (bits >= INFORMATION)).groupBy("term").agg(F.max(chance >= DETERMINES).alias("determines"))


def _term() -> Column:
    return F.explode(F.split("words", " ")).alias("term")


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_TERMS else df


def find_private(docs: DataFrame) -> DataFrame:
    """Spans of personal data and of disclosing terms in each document (doc_id, text).

    Returns doc_id, key (128 bits of id and text), base and extra: arrays of start, ord, end, kind, offsets
    in code points. Extra spans (kinds general and remove) never overlap base spans and stand at every
    occurrence of a disclosing term. A null text counts as empty and has no spans. Repeated rows and
    copies count as one text in the statistics and get equal spans. An empty table gives no rows.
    Other columns are not read.
    """
    t = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"key": row_id(), "copy": F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))})
    # the matches become columns first, so that each is searched for once
    found = rows.select("doc_id", "key", "copy", "text", *[c.alias(k) for k, c in base_hits(t).items()])
    base = F.concat(*[as_spans(F.col(k), k, i) for i, k in enumerate(KINDS)]).alias("base")
    entities = F.array_distinct(F.concat(*[F.transform(k, _entity(k)) for k in KINDS]))
    scanned = materialize(found.select("doc_id", "key", base))

    # a word holds no space: in one string the words of a text move in fewer bytes than as an array
    words = F.array_join(F.array_distinct(F.transform(_words(blank(t, F.col("base"))), lambda w: F.lower(w))), " ")
    texts = found.select("copy", "text", base, entities.alias("entities")).select("copy", "base", "entities", words.alias("words"))
    texts = materialize(texts.groupBy("copy").agg(*[F.first(c).alias(c) for c in ("base", "entities", "words")]))
    terms = materialize(_disclosing(texts))
    n_terms = terms.count()
    nothing = scanned.select("doc_id", "key", "base", F.array().cast(SPANS).alias("extra"))
    if not n_terms:
        return nothing
    told = texts.select("copy", _term()).join(_few(terms, n_terms), "term")
    of = lambda sure: F.collect_list(F.when(F.col("determines") == sure, F.col("term")))
    told = materialize(told.groupBy("copy").agg(of(True).alias("remove"), of(False).alias("general")).join(texts.select("copy", "base"), "copy"))
    marked = rows.select("key", "copy", "text").join(_few(told, told.count()), "copy").select("key", blank(t, F.col("base")).alias("bare"), "remove", "general")
    extra = marked.select("key", _places(F.col("bare"), F.col("remove"), F.col("general")).alias("extra")).groupBy("key").agg(F.first("extra").alias("extra"))
    return scanned.select("doc_id", "key", "base").join(extra, "key", "left").select("doc_id", "key", "base", F.coalesce("extra", F.array().cast(SPANS)).alias("extra"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by labels and disclosing terms generalised or removed; all columns stay.

    Texts without spans, null ones included, stay as they are.
    """
    base, extra, key = (scratch(docs, c) for c in ("base_", "extra_", "key_"))
    found = find_private(docs).where((F.size("base") > 0) | (F.size("extra") > 0)).groupBy("key").agg(F.first("base").alias(base), F.first("extra").alias(extra)).withColumnRenamed("key", key)
    found = found.select(F.col(key).alias(f"{key}_"), base, extra)
    hashed = docs.withColumn(key, row_id())
    spans = F.concat(F.coalesce(F.col(base), F.array().cast(SPANS)), F.coalesce(F.col(extra), F.array().cast(SPANS)))
    both = hashed.join(found, F.col(key) == F.col(f"{key}_"), "left").withColumn("text", redact(F.col("text"), spans, LABELS))
    return both.select(*docs.columns)


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_private(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"))
