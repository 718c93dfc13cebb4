"""Queries over whole tables against brute force over all rows of the smallest tables."""

from collections import Counter, defaultdict

from lodestrata.plans import version_queries  # noqa: F401
from lodestrata.plans.driver_queries import QUERIES

DIR = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet").collect()


def test_event_states_take_every_event(spark):
    seen = defaultdict(list)
    for e in read(spark, "events"):
        seen[e.user_id] += [(e.event_id, e.event_type)] if e.event_type in ("view", "purchase") else []
    want = {u: (bool(x) and max(x)[1] == "view", len(x)) for u, x in seen.items()}
    assert {r.user_id: (r.affected, r.n_events) for r in QUERIES["event_state_fold"](spark, DIR).collect()} == want


def test_snapshots_cover_every_event(spark):
    sides = ({}, {})
    for e in read(spark, "events"):
        side = sides[e.ts.day >= 16]
        key = (e.user_id % 50, e.event_type)
        side[key] = max(side.get(key, e.value), e.value)
    old, new = sides
    want = {(*k, old.get(k), new.get(k)) for k in old | new if old.get(k) != new.get(k)}
    assert {(r.id, r.key, r.old, r.new) for r in QUERIES["metadata_diff"](spark, DIR).collect()} == want


def test_every_part_is_a_target(spark):
    keys = {p.p_partkey for p in read(spark, "part")}
    want = Counter()
    for k in keys:
        path = [k]
        want[str(k)] += 1
        while path[-1] // 2 >= 1:
            path.append(path[-1] // 2)
            want["/".join(map(str, path))] += 1
    assert Counter(r.path for r in QUERIES["reverse_paths"](spark, DIR).collect()) == want


def test_every_nation_is_a_candidate(spark):
    nations = read(spark, "nation")
    want = {s.s_suppkey: [n.n_name for n in nations if n.n_nationkey % 13 == s.s_nationkey % 13] for s in read(spark, "supplier")}
    got = {r.s_suppkey: (r.n_candidates, r.n_name) for r in QUERIES["unique_candidate"](spark, DIR).collect()}
    assert len(nations) == 25 and got == {s: (len(x), x[0] if len(x) == 1 else None) for s, x in want.items()}
