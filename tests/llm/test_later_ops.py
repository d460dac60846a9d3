"""Infilling, hard negatives and SimHash against plain versions and SQL."""

import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import infill, negatives, simhash
from tests.llm import edge


@pytest.mark.parametrize(("name", "sql", "tables"), [("op11_skip_list_infill", infill.OP11_SQL, ["documents"]), ("op12_residue_negatives", negatives.OP12_SQL, ["embeddings"])])
def test_against_sql(spark, data, name, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = getattr(infill if "11" in name else negatives, name)(spark, data)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 300, 5000])
def test_lanes_reach_every_rank(n):
    rng = random.Random(n)
    widths = np.array([rng.randrange(1, 9) for _ in range(n)], np.int64)
    lanes = infill.build_lanes(widths)
    assert len(lanes[-1][0]) <= infill.FAN and all(lane[0].sum() == n for lane in lanes)
    for rank in {*range(0, n + 1, 7), n}:
        assert infill.reach(lanes, rank) == widths[:rank].sum()


def test_unit_widths():
    for text in ("", "\n", "a", "é字\n\n😀x\ny", "\n\n", "end\n"):
        assert infill.unit_widths(text).tolist() == [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]
        assert infill.unit_widths(text, "char").tolist() == [1] * len(text)


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("line", 40, 0), ("char", 100, 100)])
def test_infill_against_loop(spark, unit, rate, spm):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "é", "😀", "\n", "<", "<P", "S>", "word ", "\r\n"]) for _ in range(rng.randrange(30))) for _ in range(150)] + [None, "", "x <M> y", "\n" * 2000, "line\n" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("N", F.lit("clash")).withColumn("hashes_", F.lit(1))
    made = infill.fill_in_middle(rows, unit, rate, spm).withColumn("again", infill.restore("output", "form"))
    assert made.columns == ["doc_id", "hashes_", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    for r in made.collect():
        t = texts[r["doc_id"]] or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
        h = [int(hashlib.sha256(b"7:%d" % r["doc_id"]).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        plain = not t or any(x in t for x in infill.SENTINELS) or h[2] % 100 >= rate
        form = "plain" if plain else "spm" if h[3] % 100 < spm else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"], r["again"]) == (len(units), form, out, t)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if plain else (len(p), len(m)))


def test_infill_edges(spark):
    made = infill.fill_in_middle(edge.table(spark)).withColumn("again", infill.restore("output", "form")).collect()
    assert sorted(str(r["doc_id"]) for r in made) == edge.ids()
    assert sorted(r["again"] for r in made) == sorted(r[1] or "" for r in edge.rows())
    assert infill.fill_in_middle(edge.empty(spark)).collect() == []


@pytest.mark.parametrize("bound", [0, 1, 1000, 1 << 30, negatives.LIMIT - 1])
def test_residue_products(bound):
    rng = np.random.default_rng(3)
    top = int(math.isqrt(bound // 70)) if bound else 0
    a, b = rng.integers(-top, top + 1, (9, 70)), rng.integers(-top, top + 1, (13, 70))
    a[0], b[0], b[1] = top, top, -top
    primes = negatives.moduli(bound)
    assert math.prod(primes) > 2 * bound and all(negatives.WIDTH * (p // 2) ** 2 < 1 << 24 for p in primes)
    assert (negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes) == a @ b.T).all()


def brute_negatives(rows, positives, count, low, high):
    rows = list({(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, lab, v in rows:
        if i % 5:
            continue
        told = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, k) for j, k, w in rows)
        for s, j, _ in [x for x in told if x[2] == lab and x[1] != i][:positives]:
            window = [(t, n) for t, n, k in told if k != lab and low * -s <= 100 * -t <= high * -s][:count]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "wave", "tile"), [(1024, 16, 2048), (4, 2, 16)])
def test_negatives_against_loop(spark, monkeypatch, block, wave, tile):
    for name, x in (("BLOCK", block), ("WAVE", wave), ("TILE", tile)):
        monkeypatch.setattr(negatives, name, x)
    rng = random.Random(2)
    rows = [(i, [rng.choice([rng.gauss(0.2, 1), 0.5]) for _ in range(rng.choice([5, 5, 5, 3, 0]))], rng.randrange(3)) for i in range(120)]
    rows += [(200 + i, [0.5] * 5, i % 2) for i in range(60)]  # equal vectors: ties go by the id
    rows += [rows[3], rows[3], (10, [1.0], 1), (10, [1.0, 2.0], 1), (None, [1.0], 1), (501, None, 1), (505, [1.0], None), (510, [1.0, None], 1), (515, [float("nan")], 1), (520, [float("inf")], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("Q", F.lit("x")).repartition(3)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    got = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, 3, 4)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 3, 4, 30, 90)


def test_negatives_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none = F.col("vec_id") % 5 == 0
    assert negatives.hard_negatives(spark.createDataFrame([], schema), none).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 0)], schema), none).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(5, [], 0), (6, [], 1)], schema), none).collect() == []
    with pytest.raises(ValueError, match="do not fit"):
        negatives.hard_negatives(spark.createDataFrame([(5, [1e9], 0)], schema), none)


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def hamming_classes(fps, distance):
    """Fingerprint to the smallest one that links reach."""
    near, out = defaultdict(set), {}
    for a in fps:
        near[a] = {b for b in fps if (a ^ b).bit_count() <= distance}
    for f in sorted(fps):
        todo = [f] if f not in out else []
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = f
                todo += near[x]
    return out


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_fingerprints(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(6)
    for text in [None, "", " \n\t", "one", "A b", "a b c d", *(" \v".join(rng.choice(["É", "Word", "x1", "字字", "A" * 50]) for _ in range(rng.randrange(200))) for _ in range(30))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_shingle_hash_is_the_engine_s(spark):
    text = "four words of Text"
    row = spark.createDataFrame([(text.lower(),)], "s string").select(F.xxhash64("s")).first()[0]
    assert simhash.fingerprint(text) == row % (1 << 64)


@pytest.mark.parametrize("distance", [2, 3, 4, 7])
@pytest.mark.parametrize(("hot", "tile", "small"), [(1024, 4096, 12), (3, 8, 2), (6, 5, 40)])
def test_links_connect_what_is_near(spark, monkeypatch, distance, hot, tile, small):
    for name, x in (("HOT", hot), ("TILE", tile), ("SMALL", small)):
        monkeypatch.setattr(simhash, name, x)
    rng = random.Random(distance)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = {*base, *(flip(rng.choice(base), rng.randrange(distance + 3)) for _ in range(250))}
    fps |= {flip(base[0], distance) for _ in range(60)}  # one dense group
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.hamming_links(spark.createDataFrame(signed, "fp long").repartition(3), distance).collect()
    assert all(0 < ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= distance for r in links)
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for r in links:
        a, b = sorted((find(r["a"] % (1 << 64)), find(r["b"] % (1 << 64))))
        root[b] = a
    assert {f: find(f) for f in fps} == hamming_classes(fps, distance)


def test_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(250)]
    texts = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 250, 5)] + [" ".join(rng.choice(base) for _ in range(9)) for _ in range(60)] + ["", None, " ", "x", "X", "a b c d"]
    got = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    classes = hamming_classes(set(fps.values()), 4)
    least = {}
    for i, f in fps.items():
        least[classes[f]] = min(i, least.get(classes[f], i))
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in got} == {i: (f, least[classes[f]]) for i, f in fps.items()}


def test_near_copies_edges(spark):
    got = simhash.near_copies(edge.table(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == edge.ids()
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.near_copies(edge.empty(spark)).collect() == []
    with pytest.raises(ValueError, match="2 to 15"):
        simhash.hamming_links(spark.createDataFrame([], "fp long"), 1)
