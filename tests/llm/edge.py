"""A table with the awkward cases: nulls, empty and long texts, ties, repeats, extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, key string, node long, start int"


def rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "öse", "字字", "x1", "Omega,"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_ = "a" * 9000 + " " + say(4000)
    passage = " ".join(f"passage{i}" for i in range(60))
    base = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \n\t", "one", "two words", say(300), say(300), long_, long_, base, base.replace("w7 ", "w7x "), base, passage + say(50), say(40) + passage, "b" * 250, "ab" * 300]
    out = [(i, t, None if i % 3 else "en", "s", len(t) if t else None, i, 1, "k", 5, 2) for i, t in enumerate(texts)]
    out.append((None, "no id here", "en", "s", 1, 1, 1, "k", 5, 2))
    out += [((1 << 60) + i, f"a text of its own {i} " * 9, None, None, (1 << 60) + 1, 1, 1, "k", 5, 2) for i in (1, 2, 3)]  # ids that a double cannot hold
    return [*out, out[9], out[5]]  # repeated rows


def ids():
    """Every row's id, as sorted text."""
    return sorted(str(r[0]) for r in rows())


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(2)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
