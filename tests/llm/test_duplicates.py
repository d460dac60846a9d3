"""N-gram join, suffix dedup and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.llm import components, ngrams, suffixes
from sluice.llm.common import materialize
from tests.llm import edge


def brute_components(rows, words=3, percent=90):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= percent * (len(a) + len(sets[j]) - o):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(members[find(i)])) for i in range(len(rows))}


def near_copies(n, seed):
    """A base text, copies with a few edits each, and texts that share one passage."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(200)] = f"e{i}x{rng.randrange(99)}"
        out.append(" ".join(t))
    return out + [" ".join([*base[:60], *(f"o{i}y{j}" for j in range(rng.randrange(40, 300)))]) for i in range(20)]


@pytest.mark.parametrize(("small", "block", "grid"), [(8, 1 << 19, 1 << 18), (2, 900, 700)])
def test_near_duplicates(spark, monkeypatch, small, block, grid):
    monkeypatch.setattr(ngrams, "SMALL", small)
    monkeypatch.setattr(ngrams, "BLOCK", block)
    monkeypatch.setattr(ngrams, "GRID", grid)
    rows = list(enumerate(near_copies(60, 3) + ["a b c", "A  b\tc", "a b", "", "x", None, "a b c d"]))
    got = ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    assert len(got) == len(rows)


def test_one_id_on_two_texts(spark):
    """Links go by row, not by id: (5, w) must not hide (5, u), which links 9."""
    w = " ".join(f"w{i}" for i in range(300))
    u = " ".join(f"u{i}" for i in range(300))
    rows = [(1, w), (5, w), (5, u), (9, u.replace("u7 ", "v7 ")), (None, u), (12, " ".join(f"x{i}" for i in range(300)))]
    got = ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == sorted([("1", 1), ("5", 1), ("5", 5), ("9", 5), ("None", 5), ("12", 12)])
    kept = ngrams.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 5, 12]


@pytest.mark.parametrize("work", [ngrams.WORK, 50])
def test_shingle_sets_of_long_texts(monkeypatch, work):
    """A text cut into pieces has the shingles of the whole."""
    monkeypatch.setattr(ngrams, "WORK", work)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Ab", "c", "dé", "x" * 70]) for _ in range(rng.randrange(90))) for _ in range(40)]
    got = ngrams.shingle_sets(texts)
    for text, found in zip(texts, got, strict=True):
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        assert len(found) == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()))


def test_near_duplicates_edges(spark):
    docs = edge.table(spark)
    got = ngrams.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    kept = ngrams.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 11").count() == 0
    assert ngrams.near_duplicates(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_block_comparison(seed):
    """The links of a block join the same components as all linking pairs do, each link is one, and none is spare."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    sets = []
    for _ in range(120):
        s = base.copy()
        k = int(rng.integers(0, 6))
        s[rng.choice(40, k, replace=False)] = rng.integers(0, 1 << 62, k, dtype=np.uint64)
        sets.append(np.unique(s[: int(rng.integers(1, 41))]))
    start = [int(c) for c in rng.integers(0, 60, len(sets))]
    rows = [(i * 7 % 120, c, s.tobytes()) for i, (c, s) in enumerate(zip(start, sets, strict=True))]
    got = ngrams._compare_block(90)(pd.DataFrame([*rows, *rows[:9]], columns=["node", "component", "shingles"]))
    held = {i * 7 % 120: set(s.tolist()) for i, s in enumerate(sets)}
    alike = lambda a, b: 100 * len(held[a] & held[b]) >= 90 * len(held[a] | held[b])

    def labels(links):
        label = {i * 7 % 120: c for i, c in enumerate(start)}
        for a, b in links:
            old = label[b]
            label = {k: label[a] if v == old else v for k, v in label.items()}
        return {frozenset(k for k in label if label[k] == v) for v in label.values()}

    links = list(zip(got["a"].tolist(), got["b"].tolist(), strict=True))
    assert all(alike(a, b) for a, b in links)
    want = labels([(a, b) for a in held for b in held if a < b and alike(a, b)])
    assert labels(links) == want
    assert len(links) == len(labels([])) - len(want)


def test_components_of_stars(spark):
    """Links that are stars already need no round; no links give no rows."""
    stars = spark.createDataFrame([(5, 1), (1, 9), (4, 2), (4, 2)], "a long, b long")
    assert components._unfinished(stars.selectExpr("greatest(a, b) u", "least(a, b) v").distinct()) == 0
    assert {tuple(r) for r in components.components(stars).collect()} == {(1, 1), (5, 1), (9, 1), (2, 2), (4, 2)}
    assert components.components(stars.where("a = 0")).collect() == []
    assert components._unfinished(spark.createDataFrame([(3, 2), (2, 1)], "u long, v long")) == 1
    assert components._unfinished(spark.createDataFrame([(3, 2), (3, 1)], "u long, v long")) == 1


def test_components_at_random(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    label = list(range(300))
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: label[n] for a, b in links if a != b for n in (a, b)}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), *[(100 + i, 101 + i) for i in range(40)]]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{100 + i: 100 for i in range(41)}}


def test_two_stage_order():
    rng = random.Random(3)
    for _ in range(150):
        t = bytes(rng.choice(b"ab") if rng.random() < 0.9 else rng.randrange(256) for _ in range(rng.randint(1, 300)))
        order = suffixes.two_stage_order(np.frombuffer(t, np.uint8), 64).tolist()
        assert sorted(order) == list(range(len(t)))
        assert all(t[a : a + 64] <= t[b : b + 64] for a, b in zip(order, order[1:], strict=False))


def brute_kept(texts, n=suffixes.LENGTH):
    data = [(t or "").encode() for t in texts]
    count = defaultdict(int)
    for d in data:
        for i in range(len(d) - n + 1):
            count[d[i : i + n]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if count[d[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("widest", [5000, 1])
def test_suffix_dedup(spark, monkeypatch, widest):
    monkeypatch.setattr(suffixes, "WIDEST", widest)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, other = say(80), say(120)
    texts = [say(60) + passage + say(30), passage, say(20) + passage[:230] + say(40), other, other, say(50) + passage[37:] + other[:300], "a" * 450, "ab" * 210, say(10), "", None, passage + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = suffixes._apply(docs, suffixes._digests, suffixes.DIGESTS, ["doc_id"]).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out}
    assert got == dict(enumerate(brute_kept(texts)))


def test_suffix_edges(spark):
    docs = edge.table(spark)
    kept = suffixes.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert suffixes.drop_repeats(edge.empty(spark)).count() == 0


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, data))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == before


def test_near_duplicate_stage(spark):
    """The stage at its own setting: five words, 80 %, one document of each group by brute force."""
    texts = near_copies(40, 5) + ["a b c d e", "a b c d e", "", None, "a b c d"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    want = brute_components(rows, 5, 80)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(i for i, _ in rows if want[i][1] == i)
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_passage_and_private_stages(spark):
    """Texts that the stages leave, against plain versions."""
    passage = "".join(f"passage {i} of many; " for i in range(20))
    texts = ["first " + passage + "end é", passage + " tail", "alone", "", None, "mail me@x.example or 10.0.0.1 now", "call +1 (555) 123-4567 é"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    count = defaultdict(int)
    for t in texts:
        d = (t or "").encode()
        for i in range(len(d) - suffixes.LENGTH + 1):
            count[d[i : i + suffixes.LENGTH]] += 1
    for i, t in enumerate(texts):
        d = (t or "").encode()
        gone = {j for k in range(len(d) - suffixes.LENGTH + 1) if count[d[k : k + suffixes.LENGTH]] > 1 for j in range(k, k + suffixes.LENGTH)}
        left = bytes(b for j, b in enumerate(d) if j not in gone).decode("utf-8", "ignore")
        assert got[i] == ((left, len(left)) if t is not None else (None, None))
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.private_data(spark, docs, "").collect()}
    assert clean[5] == "mail <EMAIL> or <IP> now" and clean[6] == "call <PHONE> é" and [clean[i] for i in range(5)] == texts[:5]


def test_passages_are_known_by_both_hashes(spark, monkeypatch):
    """Rows that share the first hash keep their own bytes and lose their own repeats."""
    rng = random.Random(41)
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    texts = ["".join(rng.choice("uvwxyz ") for _ in range(rng.randrange(200, 500))) for _ in range(24)]
    texts = [t[:90] + passage + t[90:] if i % 3 == 0 else t for i, t in enumerate(texts)] + [passage, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: r["text"] for r in suffixes.drop_repeats(docs).collect()}
    assert len({len(want[i]) for i in (1, 2, 4)}) == 3 and all(want[i] == texts[i] for i in (1, 2, 4)) and want[24] == ""
    monkeypatch.setattr(suffixes, "row_key", lambda: F.pmod(F.xxhash64("text"), F.lit(2)))
    assert {r["doc_id"]: r["text"] for r in suffixes.drop_repeats(docs).collect()} == want


def test_sets_that_share_a_hash_stay_apart(spark, monkeypatch):
    """With the first hash of a set narrowed to two bits the classes are the same."""
    first = ngrams._set_key
    monkeypatch.setattr(ngrams, "_set_key", lambda h, salt=0: first(h, salt) if salt else first(h) % 4)
    rows = list(enumerate(near_copies(40, 5) + ["a b c", "A  b\tc", "a b", "", "x", None, "a b c d"]))
    got = ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_pipeline_edges(spark, data):
    """Nulls, empty and long texts, repeats, ids beyond a double and clashing columns go through all stages; so does an empty table."""
    docs = edge.table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, data))
        assert kept.columns == docs.columns, name
        assert {str(r[0]) for r in kept.select("doc_id").collect()} <= set(edge.ids()), name
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert sorted(str(r[0]) for r in packed.where("piece = 0").select("doc_id").collect()) == sorted(str(r[0]) for r in docs.select("doc_id").collect())
    none = edge.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        none = materialize(stage(spark, none, data))
        assert none.count() == 0
