"""Operator 6: Jaccard join on word shingles, rare first.

Texts become sets of hashed three-word shingles; equal sets form one class. The shingles of all
classes are counted exactly: blocks of texts send their distinct shingles to hash ranges, each range
adds them up, and what occurs in two or more classes goes back to the blocks that hold it. A class's
shingles are then ordered rarest first, and of the prefix that a partner at the threshold must share
only shingles with a second class become rows. Candidates pass a length, a positional and a suffix
filter and are verified on their whole sets, once per pair. Buckets of a prefix shingle give all
pairs while they are small, else those with two leaders; what stays apart in a bucket after that is
compared in blocks, so no bucket is expanded into pairs. Nothing here is broadcast or held in memory
that grows with the input: every table is joined by key, and only counted small ones are broadcast.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import arrow_map, few, materialize, powers, release, row_digest, scratch, slices, table, values
from sluice.llm.components import components

WORDS = 3
PERCENT = 90  # two sets link when 100 * intersection >= PERCENT * union
BLOCK = 1 << 19  # shingles of a block of texts, of a counted range, and of a chunk compared with one leader
TILE = 64  # shingles that a block sends to a range, on average, at least: blocks and ranges grow with the root of the input
GRID = 1 << 18  # shingles of one side of a block comparison
SMALL = 8  # in buckets up to this size every member is a leader, in larger ones two are
WORK = 1 << 18  # bytes hashed at a time
SECOND = 1 << 40  # salt of the hash that tells apart sets which share the first one
_R = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0d]")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts one after the other, and the number of words of each."""
    buf = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    stops = np.cumsum([len(d) + 1 for d in data])
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[buf]]))
    start, end = edge[::2], edge[1::2]
    p, q = powers(_R, 1 << max(19, int(len(buf)).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)])]
    word = _mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
    return word, np.diff(np.searchsorted(start, np.r_[0, stops]))


def _pieces(text: bytes) -> list[bytes]:
    """A text cut at white space into parts of about WORK bytes."""
    out, at = [], 0
    while len(text) - at > WORK:
        found = _BREAK.search(text, at + WORK)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words give one shingle, no words none."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        for piece in _pieces((t or "").encode("utf-8", "replace").lower()):
            parts.append(piece)
            owner.append(i)
    hashes, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and (end == at or held + len(parts[end]) < WORK):
            held += len(parts[end]) + 1
            end += 1
        word, n = _word_hashes(parts[at:end])
        hashes.append(word)
        np.add.at(counts, owner[at:end], n)
        at = end
    word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    h = word
    for k in range(1, words):
        h = h[:-1] if len(h) else h
        h = _mix(h * np.uint64(_R) + word[k : k + len(h)])
    out, first = [], np.r_[0, np.cumsum(counts)]
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        elif b > a:  # the whole sequence, kept apart from shingles by its length
            x = np.array([b - a], np.uint64)
            for w in word[a:b]:
                x = _mix(x * np.uint64(_R) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_key(h: np.ndarray, salt: int = 0) -> int:
    """Signed 64-bit hash of a whole set."""
    x = np.arange(1 + salt, len(h) + 1 + salt, dtype=np.uint64) * np.uint64(_R)
    return int(_mix(np.array([(_mix(h ^ x)).sum(dtype=np.uint64)]))[0].astype(np.int64))


def suffix_histogram(h: np.ndarray) -> np.ndarray:
    """Shingles in each sixteenth of the hash range: differences bound the symmetric difference from below."""
    return np.bincount((h >> np.uint64(60)).astype(np.int64), minlength=16).astype(np.int32)


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles of which a partner at the threshold must share one."""
    return n - (-(-percent * n // 100)) + 1


def _six(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, six bytes each: enough to count by, any order of shingles is exact."""
    return np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _members(words: int) -> Callable[[pa.RecordBatch], dict]:
    def work(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(values(part, "text"), words)
        return {"n": [len(s) for s in sets], "node": [_set_key(s) for s in sets], "check": [_set_key(s, SECOND) for s in sets]}

    return work


def _whole_sets(words: int) -> Callable[[pa.RecordBatch], dict]:
    def work(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(values(part, "text"), words)
        return {"bins": [suffix_histogram(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    return work


def _to_ranges(words: int, ranges: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        """The distinct shingles of a block, in how many of its sets each is, by hash range."""
        sets = shingle_sets(pdf.drop_duplicates("key")["text"].tolist(), words)
        h, n = np.unique(np.concatenate(sets) >> np.uint64(16) << np.uint64(16), return_counts=True)
        place = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        cut = [slice(a, b) for a, b in zip(first, np.r_[first[1:], len(h)], strict=True)]
        return pd.DataFrame({
            "range": place[first].astype(np.int64), "block": pdf["block"].iloc[0],
            "tokens": [_six(h[c]) for c in cut], "counts": [zlib.compress(n[c].astype("<u4").tobytes(), 1) for c in cut],
        })

    return send


def _count_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of one range's shingles; those of two or more classes go back to their blocks, with the total's level."""
    tokens = [_from_six(t) for t in pdf["tokens"]]
    counts = np.concatenate([np.frombuffer(zlib.decompress(c), "<u4") for c in pdf["counts"]])
    _, place = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(place, counts)
    level = np.where(total > 1, np.minimum(8 * np.log2(np.maximum(total, 1)), 255), 0).astype(np.uint8)[place]  # eighths of a doubling
    cut = np.r_[0, np.cumsum([len(t) for t in tokens])]
    keep = level > 0
    out = [(b, _six(t[keep[x:y]] << np.uint64(16)), level[x:y][keep[x:y]].tobytes()) for b, t, x, y in zip(pdf["block"], tokens, cut, cut[1:], strict=False)]
    return pd.DataFrame([r for r in out if r[2]], columns=["block", "tokens", "levels"])


def _prefixes(words: int, percent: int, shared_nodes: frozenset[int]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Prefix rows of a block: shingles of one class only come first and give no rows."""
        if not len(known) or not len(docs):
            return pd.DataFrame({"token": [], "node": [], "n": [], "pos": []}).astype({"token": "int64", "node": "int64", "n": "int32", "pos": "int32"})
        tokens, levels = np.concatenate([_from_six(t) for t in known["tokens"]]), np.concatenate([np.frombuffer(v, np.uint8) for v in known["levels"]])
        tokens, at = np.unique(tokens, return_index=True)
        levels = levels[at]
        sets = shingle_sets(docs.drop_duplicates("key")["text"].tolist(), words)
        h, n, node = np.concatenate(sets), np.array([len(s) for s in sets]), np.array([_set_key(s, SECOND) if k in shared_nodes else k for s in sets for k in [_set_key(s)]])
        owner = np.repeat(np.arange(len(n)), n)
        short = h >> np.uint64(16)
        place = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
        level = np.where(tokens[place] == short, levels[place], 0)
        order = np.lexsort((h, level, owner))  # owners are in order already: only the ranks within each change
        pos = np.arange(len(h)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        use = (level[order] > 0) & (pos < prefix_length(n, percent)[owner])
        own = owner[use]
        return pd.DataFrame({"token": h[order][use].view(np.int64), "node": node[own], "n": n[own].astype(np.int32), "pos": pos[use].astype(np.int32)})

    return run


def _buckets(prefixes: DataFrame, percent: int) -> DataFrame:
    """Rows (bucket, m, node, n, pos) of prefix shingles that several classes share, in buckets of like sizes.

    Sizes that fit differ by the threshold at most, so with size classes of that ratio they fall into
    one class or two neighbours; a bucket holds a shingle's rows of a class and of the next one.
    """
    width = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    size = F.floor(F.log(F.col("n").cast("double")) / width)
    dealt = prefixes.distinct().withColumn("size", F.explode(F.array(size, size - 1))).select(F.xxhash64("token", "size").alias("bucket"), "node", "n", "pos")
    dealt = materialize(dealt)
    m = dealt.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    out = materialize(dealt.join(m, "bucket"))
    release(dealt)
    return out


def _fits(x: Column, y: Column, percent: int) -> Column:
    """Length filter and positional filter on two rows that share a shingle at known places."""
    reach = F.least(x["pos"], y["pos"]) + F.least(x["n"] - x["pos"], y["n"] - y["pos"])  # the most that can be common
    return (x["node"] != y["node"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & ((100 + percent) * reach >= percent * (x["n"] + y["n"]))


def _candidates(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that fit, a being a leader of a bucket: every member of small buckets, two of larger ones."""
    me = F.struct("node", "n", "pos")
    ends = lambda x, y: F.struct(x["node"].alias("a"), y["node"].alias("b"))
    small = buckets.where(F.col("m") <= SMALL).groupBy("bucket").agg(F.collect_list(me).alias("rows"))  # at most SMALL each
    small = small.select(F.explode(F.flatten(F.transform("rows", lambda x: F.transform(F.filter("rows", lambda y: (x["node"] < y["node"]) & _fits(x, y, percent)), lambda y: ends(x, y))))).alias("p")).select("p.*")
    large = buckets.where(F.col("m") > SMALL)
    leaders = large.groupBy("bucket").agg(F.min_by(me, F.xxhash64("node")).alias("one"), F.max_by(me, F.xxhash64("node")).alias("two"))
    led = large.withColumn("me", me).join(few(materialize(leaders)), "bucket")
    led = led.select(F.explode(F.filter(F.array("one", "two"), lambda x: _fits(x, F.col("me"), percent))).alias("x"), "me").select(ends(F.col("x"), F.col("me")).alias("p")).select("p.*")
    return small.unionByName(led).distinct()


def _verify(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (a, salt): the leader's set first (b null), then those to compare with it. One set is held."""
        leader, own = None, np.zeros(0, np.uint64)
        for part in slices(batches, "shingles"):
            a, b = [], []
            for x, salt, y, data in zip(values(part, "a"), values(part, "salt"), values(part, "b"), part.column(part.schema.get_field_index("shingles")), strict=True):
                other = np.frombuffer(data.as_buffer(), np.uint64)
                if y is None:
                    leader, own = (x, salt), other.copy()
                    continue
                if leader != (x, salt):
                    raise ValueError("a set to compare came without its leader")
                common = len(own) + len(other) - len(np.union1d(own, other))
                if 100 * common >= percent * (len(own) + len(other) - common):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _linked(pairs: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a leader, b) that link. A leader's set is sent once per chunk of partners, a partner's once per pair."""
    sized = classes.select(F.col("node").alias("a"), F.col("n").cast("long").alias("n"))
    chunks = pairs.groupBy("a").agg(F.count("*").alias("m")).join(sized, "a").select("a", F.ceil(F.col("m") * F.col("n") / BLOCK).alias("chunks"))
    dealt = materialize(pairs.join(few(materialize(chunks)), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("salt")))
    lead = dealt.select("a", "salt").distinct().withColumn("node", F.col("a")).withColumn("b", F.lit(None).cast("long"))
    both = dealt.select("a", "salt", F.col("b").alias("node"), "b").unionByName(lead.select("a", "salt", "node", "b"))
    sent = sets.select("node", "shingles").join(few(both), "node").select("a", "salt", "b", "shingles")
    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_verify(percent), "a long, b long")


def _compare_block(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between classes of different components in one block; only as many as join components.

        The block is kept by shingle: the lists of a set's shingles give its intersections with all
        later sets at once, so sets that share little cost little.
        """
        pdf = pdf.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        n = np.array([len(s) for s in sets])
        _, label = np.unique(pdf["component"], return_inverse=True)
        node = pdf["node"].to_numpy()
        _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)[np.argsort(shingle, kind="stable")]  # by shingle, ascending within each
        end = np.cumsum(np.bincount(shingle))
        head = np.r_[0, end[:-1]]  # of each shingle, the first set not yet compared
        first = np.r_[0, np.cumsum(n)]
        out = []
        for i in range(len(sets) - 1):
            mine = shingle[first[i] : first[i + 1]]
            head[mine] += 1  # i itself
            if (label[i + 1 :] == label[i]).all():
                continue
            met = np.concatenate([owner[x:y] for x, y in zip(head[mine].tolist(), end[mine].tolist(), strict=True)])
            common = np.bincount(met, minlength=len(n))
            linked = np.flatnonzero((100 * common >= percent * (n[i] + n - common)) & (common > 0) & (label != label[i]))
            if len(linked):
                joined, at = np.unique(label[linked], return_index=True)
                out += [(node[i], node[j]) for j in linked[at]]
                label[np.isin(label, joined)] = label[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _blocks(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups (g, node, component) that cover every pair of classes of one large bucket and two components.

    Buckets of one group of near copies differ little, so classes that they chain together are one
    unit if they hold at most GRID shingles; other buckets are units of their own. A unit is cut
    into parts of about GRID shingles, and every two parts meet in one group.
    """
    large = buckets.where(F.col("m") > SMALL).select("bucket", "node", "n").distinct()
    marked = large.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    apart = marked.groupBy("bucket").agg(F.sum(F.col("n").cast("long")).alias("size"), F.min("node").alias("head"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    left = materialize(marked.join(apart.select("bucket", "size", "head"), "bucket"))
    chained = components(left.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())
    size_of = left.select("node", "n").distinct()
    clusters = chained.join(size_of, "node").groupBy("component").agg(F.sum(F.col("n").cast("long")).alias("all")).where(F.col("all") <= GRID)
    whole = materialize(chained.join(clusters, "component").select("node", F.col("component").alias("cluster"), "all"))
    placed = left.join(few(whole), "node", "left")
    unit = F.when(F.col("cluster").isNotNull(), F.xxhash64(F.lit("cluster"), "cluster")).otherwise(F.col("bucket"))
    units = placed.select(unit.alias("unit"), F.ceil(F.coalesce("all", "size") / GRID).cast("int").alias("parts"), "node", "component").distinct()
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("unit", F.least(own, other), F.greatest(own, other))))
    return materialize(units.select(pair.alias("g"), "node", "component"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Classes of documents (doc_id, text) that chains of links join: key, doc_id, n_shingles, component_id, kept.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. component_id
    is the smallest doc_id reachable; a row is known by its doc_id and text (key), so one doc_id on
    different texts keeps each text's links. kept marks one document of each component, of the
    smallest doc_id and, where texts share it, the smallest key. Documents without words or text have no shingles and
    stand alone. Repeated rows and copies fall into one class; rows with a null doc_id link others
    too, and a component of such rows only has a null component_id. An empty table gives no rows.
    Other columns are not read.
    """
    rows = docs.select("doc_id", "text", row_digest().alias("key"))
    members = materialize(arrow_map(rows, _members(words), "n int, node long, check long", keep=["doc_id", "key"]))
    two = members.where("n > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
    shared_nodes = frozenset(r["node"] for r in two.select("node").collect())  # chance alone: a dozen at 2 * 10**10 documents
    members = members.withColumn("node", F.when(F.col("node").isin(list(shared_nodes)), F.col("check")).otherwise(F.col("node")) if shared_nodes else F.col("node")).drop("check")
    classes = materialize(members.where("n > 0").groupBy("node").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("first"), F.min("key").alias("key"), F.max("n").alias("n")))
    spare = materialize(members.where("n > 0").join(classes.select("node", F.col("key").alias("rep")), "node").where("key <> rep").select("key").distinct())
    total = classes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    size = max(BLOCK, math.isqrt(TILE * total))
    blocks = max(1, -(-total // size))
    # one shuffle of the texts serves both the counting and the prefixes
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    texts = rows.join(few(spare), "key", "left_anti").where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(block, "key", "text").groupBy("block")
    shared = texts.applyInPandas(_to_ranges(words, blocks), "range long, block long, tokens binary, counts binary").groupBy("range").applyInPandas(_count_range, "block long, tokens binary, levels binary")
    prefixes = materialize(texts.cogroup(shared.groupBy("block")).applyInPandas(_prefixes(words, percent, shared_nodes), "token long, node long, n int, pos int"))
    buckets = _buckets(prefixes, percent)
    release(prefixes, spare)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Whole sets of some classes; a repeated row repeats its set."""
        keys = materialize(nodes.distinct().join(classes, "node").select("key", "node"))
        return materialize(arrow_map(rows.join(few(keys), "key").select("node", "text"), _whole_sets(words), "bins array<int>, shingles binary", keep=["node"]))

    pairs = materialize(_candidates(buckets, percent))
    sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    bins = lambda c: sets.select(F.col("node").alias(c), F.col("bins").alias(f"bins_{c}"))
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, v: acc + v)
    both = F.aggregate("bins_a", F.lit(0), lambda acc, v: acc + v) + F.aggregate("bins_b", F.lit(0), lambda acc, v: acc + v)
    close = pairs.join(bins("a"), "a").join(bins("b"), "b").where((percent + 100) * (both - apart).cast("long") >= 2 * percent * both.cast("long"))
    close = materialize(close.select("a", "b").distinct())
    first = materialize(_linked(close, sets, classes, percent))
    release(sets, pairs, close)
    groups = _blocks(buckets, components(first))
    rest = sets_of(groups.select("node"))
    second = materialize(rest.select("node", "shingles").join(few(groups), "node").groupBy("g").applyInPandas(_compare_block(percent), "a long, b long"))
    release(rest, buckets, groups)
    final = components(first.unionByName(second))
    named = final.join(classes, "node").groupBy("component").agg(F.min("first").alias("least"))
    of_node = classes.join(final, "node", "left").join(named, "component", "left").select("node", F.coalesce("least", "first").alias("best"))
    placed = members.where("n > 0").join(of_node, "node").select("key", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), (F.col("key") == F.col("best.key")).alias("kept"))
    alone = members.where("n = 0").select("key", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return placed.unionByName(alone)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. All columns stay.

    Rows that repeat that document (equal doc_id and text) stay repeated; documents without words,
    null texts among them, all stay. An empty table gives no rows.
    """
    key = scratch(docs, "key_")
    gone = materialize(near_duplicates(docs, words, percent).where("not kept").select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, row_digest()).join(few(gone), key, "left_anti").select(*docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key", "kept")
