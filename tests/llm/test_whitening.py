import numpy as np
import pytest

from lodestrata.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in rows], SCHEMA)


def brute(rows, components=4):
    x = np.array([np.floor(256 * np.float32(v).astype(float)) for _, v in rows])
    fit = np.unique(x, axis=0)
    mean = fit.mean(0)
    c = fit - mean
    values, vectors = np.linalg.eigh(c.T @ c / len(fit))
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (x - mean) @ vectors[:, :components] / np.sqrt(values[:components])
    far = ((len(fit) * x.astype(object) - fit.astype(object).sum(0)) ** 2).sum(1)
    return len(fit), white, values[:components] / values.sum(), far


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 7)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(3, rows[3][1]), (None, rows[4][1])]
    bad = [(2000, None), (2001, []), (2002, [1, 2, 3, 4, 5, None]), (2003, [float("nan")] * 6), (2004, [1, 2, 3, 4, 5, float("inf")]), (2005, [1.0, 2.0]), (2006, [3e38] * 6)]
    got = whitening.whitened(frame(spark, rows + bad)).toPandas()
    n, white, shares, far = brute(rows)
    assert len(got) == 4 * len(rows) and set(got.n) == {n} and n == 300 and not set(got.vec_id.dropna()) & {b[0] for b in bad}
    for c in range(4):
        own = got[got.component == c + 1]
        w = own.whitened.to_numpy()
        want = dict(zip((-1 if i is None else i for i, _ in rows), white[:, c], strict=True))
        mine = dict(zip(own.vec_id.fillna(-1).astype(int), w, strict=True))
        sign = np.sign(mine[0] * want[0])
        assert all(mine[i] == pytest.approx(sign * want[i], rel=1e-7, abs=1e-9) for i in want)
        assert own.explained.iloc[0] == pytest.approx(shares[c], rel=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert sorted(got[got.component == 1].deviation.astype(int)) == sorted(int(v) for v in far)


def test_degenerate_tables(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0 and whitening.whitened(frame(spark, [(1, None)])).count() == 0
    one = whitening.whitened(frame(spark, [(1, [1, 2]), (2, [1, 2])])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whitened(frame(spark, [(1, [1, 2, 5]), (2, [2, 2, 5]), (3, [4, 2, 5])])).collect()
    assert {r.component for r in flat} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in flat)
    assert flat[0].explained == pytest.approx(1.0) and flat[0].identity_error < 1e-12


def test_exact_beyond_longs():
    big = np.array([[2**61, -(2**61)], [5, 7]])
    wide = whitening.spread(big, 3, [2**61, 4])
    assert wide.tolist() == [[3 * 2**61 - 2**61, -3 * 2**61 - 4], [15 - 2**61, 17]]
    assert whitening.deviations(wide) == [(2**62) ** 2 + (3 * 2**61 + 4) ** 2, (15 - 2**61) ** 2 + 17**2]
    assert whitening.deviations(np.array([[3, 4], [-1, 0]])) == [25, 1]


def test_sums_are_exact(spark):
    rows = [(i, [float((-1) ** i * 2**52 + 1), 3.0]) for i in range(8)]
    x = whitening.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert whitening.sums(x, 2) == (8, [256 * 8, 768 * 8]) and whitening.sums(x.limit(0), 2) == (0, [0, 0])
