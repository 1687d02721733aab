import random

import xxhash
from pyspark.sql import Row

from tessera.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    if not grams:
        return 0
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    out = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return [*out, "", None, " \n ", "one", "One TWO", "É é", "x " * 3000]


def test_fingerprint_is_the_defined_one():
    for t in texts():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_components_match_brute_force(spark):
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts())]
    rows += rows[:5]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, id=7, fp="x") for i, t in rows], "doc_id long, text string, id int, fp string")
    want = plain_components([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows])
    got = simhash.near_duplicates(docs).collect()
    key = lambda x: tuple((-1 if v is None else v) for v in x)
    assert sorted(((r.id, r.fp & (1 << 64) - 1, r.component) for r in got), key=key) == sorted(
        ((i, plain_fingerprint(t), c) for (i, t), c in zip(rows, want)), key=key
    )


def test_dense_anchor_is_compared_in_blocks(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(300):
        x = rng.choice(sorted(prints))
        prints.add(x ^ (1 << rng.randrange(32, 64)) ^ (1 << rng.randrange(32, 64)))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    whole = plain_components(prints, prints)
    for block in (16, 1024):
        edges = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(df, block=block).collect()]
        assert all(bin(u ^ v).count("1") <= 3 for u, v in edges)
        at = {x: i for i, x in enumerate(prints)}
        root = list(range(len(prints)))
        for _ in prints:
            for u, v in edges:
                root[at[u]] = root[at[v]] = min(root[at[u]], root[at[v]])
        assert [prints[i] for i in root] == whole


def test_keep_one(spark):
    docs = spark.createDataFrame(
        [(3, "a b c d"), (1, "a b c d"), (2, "other words in here"), (2, "other words in here"), (None, "lone text of its own"), (None, "lone text of its own")],
        "doc_id long, text string",
    )
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d"), (2, "other words in here"), (None, "lone text of its own")], key=str)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
