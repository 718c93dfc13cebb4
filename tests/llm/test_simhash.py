import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import simhash
from lodestrata.llm.components import components

SCHEMA = "doc_id long, text string, id string, fp string, row_hash int"


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    total = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * total[b] > len(shingles))


def expected(docs):
    fps = {i: brute(t) for i, t in docs}
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {i: (f"{fps[i]:016x}", group[i]) for i in fps}


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(6)]
    out = [" ".join(b) for b in base]
    for b in base[:3]:
        for _ in range(8):
            c = list(b)
            c[rng.randrange(len(c))] = "changed"
            out.append(" ".join(c))
    return [*out, out[0], out[0].upper(), "", "  \n ", None, "one", "ONE", "one two three", "É é"]


def test_equals_brute_force(spark):
    docs = list(enumerate(texts()))
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in docs], SCHEMA)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == expected(docs) and len(got) == len(docs)


def test_pairs_equal_brute_force_at_every_distance(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 40)
    near = [int(np.int64(b) ^ np.int64(sum(1 << int(k) for k in rng.choice(63, d, replace=False)))) for b in base for d in range(7)]
    values = sorted({0, -1, -(2**63), *map(int, base), *near})
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    got = simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert len(got) == len(want) and {(r.u, r.v) for r in got} == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}


def test_odd_rows(spark):
    rows = [(1, "a b c d", None, None, 1), (1, "a b c d", None, None, 1), (None, "a b c d", None, None, 1), (None, "zz yy", None, None, 2), (3, None, None, None, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 1), (1, 1), (1, 1), (3, 3)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 3


def test_drop_keeps_one_of_each_group(spark):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in docs], SCHEMA)
    kept = simhash.drop_near_duplicates(df)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in expected(docs).values()} and simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_long_text_is_read_whole(spark):
    long = " ".join(f"x{i % 977}" for i in range(60_000))
    assert simhash.fingerprint(long) & (2**64 - 1) == brute(long)
    assert spark.range(1).select(simhash.fingerprint_udf(F.lit(long)).alias("f")).first().f == simhash.fingerprint(long)
