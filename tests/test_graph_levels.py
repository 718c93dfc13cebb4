import random

from lodestrata.lineage import Grown
from lodestrata.operators import graph


def brute(nodes, edges):
    deps = {n: {d for m, d in edges if m == n and d in nodes} for n in nodes}
    level, waiting = {}, dict(deps)
    while ready := [n for n, d in waiting.items() if all(x in level for x in d)]:
        for n in ready:
            level[n] = max((level[d] + 1 for d in deps[n]), default=0)
            del waiting[n]
    return {n: level.get(n) for n in nodes}


def levels(spark, nodes, edges):
    got = graph.longest_levels(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(list(edges), "node int, dep int"))
    rows = got.collect()
    assert len(rows) == len(set(nodes))
    return {r.node: r.level for r in rows}


def test_random_graphs_equal_brute_force(spark):
    for seed in (0, 5):
        r = random.Random(seed)
        n = 30
        edges = [(a, b) for a in range(n) for b in range(n) if a != b and r.random() < 0.06 and (seed % 2 or a > b)] + [(3, 99), (98, 3)]
        if seed == 5:
            edges.append((4, 4))
        assert levels(spark, list(range(n)), edges + edges) == brute(set(range(n)), edges)


def test_shapes(spark):
    n = 40
    two_back = [(i, i - k) for i in range(n) for k in (1, 2) if i >= k]
    assert levels(spark, range(n), two_back) == {i: i for i in range(n)}
    mutual = [(i, j) for i in range(n) for j in (i - 1, i + 1)] + [(100, 5), (101, 100), (102, 103)]
    assert levels(spark, [*range(n), 100, 101, 102], mutual) == {**dict.fromkeys([*range(n), 100, 101]), 102: 0}
    circle = [(i, (i + 1) % 7) for i in range(7)] + [(7, 3), (8, 7), (8, 9)]
    assert levels(spark, range(10), circle) == {**dict.fromkeys(range(9)), 9: 0}
    assert levels(spark, [], []) == {}


def test_a_chain_of_100_000(spark):
    n = 100_000
    ids = spark.range(n)
    nodes = ids.selectExpr("concat('c', id) as node")
    edges = ids.where("id > 0").selectExpr("concat('c', id) as node", "concat('c', id - 1) as dep")
    got = graph.longest_levels(nodes, edges)
    assert got.where("node = concat('c', level)").count() == got.count() == n


def test_paths_are_unrolled(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 4), (20, 21), (21, 20), (22, 21)], "node int, before int")
    got = graph.path_steps(tree, spark.createDataFrame([(5,), (1,), (9,), (22,), (5,), (None,)], "node int"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1), (5, 0, 5), (5, 1, 4), (5, 2, 2), (5, 3, 1), (9, 0, 9)]
    chain = spark.range(1, 3001).selectExpr("id as node", "nullif(id - 1, 0) as before")
    long = graph.path_steps(chain, spark.sql("select 3000L as node"))
    assert long.count() == 3000 and long.where("node + step <> 3000").isEmpty()
    assert graph.path_steps(chain.limit(0), chain.select("node").limit(0)).count() == 0


def test_grown_keeps_all_parts(spark):
    g = Grown(spark.range(0, 1))
    for i in range(1, 12):
        g.add(spark.range(i, i + 1))
    assert sorted(r.id for r in g.rows().collect()) == list(range(12)) and len(g.parts) <= 4
