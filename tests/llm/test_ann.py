import numpy as np
import pytest

from lodestrata.llm import ann

SCHEMA = "vec_id long, embedding array<float>, dim int, code string, qb int"


def brute(rows, every, k):
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    usable = [(i, np.array(np.array(v, np.float32), np.float64)) for i, v in usable]
    out = {}
    for i, q in usable:
        if i % every == 0:
            scored = sorted((-float(v @ q), j) for j, v in usable if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("blocks", [(4096, 16384), (3, 40)])
def test_neighbours_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((200, 24)) * rng.uniform(0.5, 2, (200, 1)))]
    rows += [(300 + i, rows[1][1]) for i in range(30)]  # ties
    rows += [(400, None), (401, []), (402, [0.0] * 24), (403, [float("nan")] * 24), (404, [None] * 24), (None, rows[0][1]), (420, [1.0, 2.0]), (421, [2.0, 1.0]), (405, [float("inf")] * 24)]
    df = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA)
    got = {}
    for r in ann.nearest(df, every=20, k=5, query_block=blocks[0], code_block=blocks[1]).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, 20, 5)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        assert sorted(got[q]) == list(range(1, len(near) + 1))
        hits += sum(got[q][n + 1][0] == j for n, (j, _) in enumerate(near))
        assert [got[q][n + 1][1] for n in range(len(near))] == pytest.approx([s for _, s in near], abs=1e-9)
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_bounds_hold_and_scores_are_unbiased():
    rng = np.random.default_rng(3)
    x, q, centre = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64)), rng.standard_normal(64) * 0.1
    turn = ann.rotation(64)
    estimate, half = ann.bounds(q, *ann.encode(x, centre, turn), centre, turn, 3.0)
    error = estimate - q @ x.T
    assert (np.abs(error) <= half).mean() > 0.99 and abs(error.mean()) < 0.05 * np.abs(error).mean()


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = brute(rows, ann.EVERY, ann.K)
    got = ann.nearest(df).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, j) in found for q, near in want.items() for j, _ in near) >= 0.95 * sum(map(len, want.values()))


def test_empty_and_lone(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, "c", 2)], SCHEMA)
    assert ann.nearest(df).count() == 0 and ann.nearest(df.limit(0)).count() == 0
    repeated = spark.createDataFrame([(0, [1.0, 2.0], 1, "c", 2), (0, [3.0, 1.0], 1, "c", 2), (1, [1.0, 0.0], 1, "c", 2), (1, [1.0, 0.0], 1, "c", 2)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(repeated).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 1, 1.0)]


def test_codes_choose_few_vectors_at_the_stated_recall():
    """Random directions, where no cell can be left out: the codes alone leave less than a tenth of all pairs to rerank."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, ids, turn, centre = x[:100], np.arange(20_000), ann.rotation(64), np.zeros(64)
    least = ann.thresholds(q, ids[:100], x[:8000], ids[:8000], ann.K)
    own = ids[:100, None] == ids[None, :]
    keep = ann.survivors(q, least, *ann.encode(x, centre, turn), centre, turn, own, ann.K, ann.EPSILON)
    products = np.where(own, -np.inf, q @ x.T)
    top = np.argpartition(-products, ann.K, axis=1)[:, : ann.K]
    assert keep.mean() < 0.1 and np.take_along_axis(keep, top, 1).mean() > 0.95
    assert (np.sort(products, axis=1)[:, -ann.K] >= least).all()


def test_cells_far_from_a_query_are_left_out(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((8, 16)) * 10
    rows = [(i, [float(v) for v in centres[i % 8] + rng.standard_normal(16) * 0.05], 1, "c", 2) for i in range(1600)]
    met = spark.sparkContext.accumulator(0)
    search = ann._search
    monkeypatch.setattr(ann, "_search", lambda a, b, *more: (met.add(a.num_rows * b.num_rows), search(a, b, *more))[1])
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), k=5).collect()
    want = brute([r[:2] for r in rows], 20, 5)
    found = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, j) in found for q, near in want.items() for j, _ in near) >= 0.95 * sum(map(len, want.values()))
    assert 0 < met.value < 0.5 * 80 * 1600


def test_short_answers_are_searched_again(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v], 1, "c", 2) for i, v in enumerate(rng.standard_normal((300, 8)))]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), k=5, epsilon=0.0).collect()
    want = brute([r[:2] for r in rows], 20, 5)
    per = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want}
    assert all(len(v) == 5 for v in per.values())
