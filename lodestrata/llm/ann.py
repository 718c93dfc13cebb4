"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector belongs to the nearest of a few coarse centres. Its residual from that centre is rotated by a random
orthogonal matrix; its code is the signs, packed eight to a byte, with two scalars: the residual's norm and the inner
product of the residual's direction with its code. The inner product with a query is estimated without bias from
these, with an error bound.

A query's threshold is the 2k-th largest product within a bounded sample, which the k-th of all vectors can't be below.
(1) A query meets only cells whose largest possible product (centre, and radius by Cauchy and Schwarz) reaches its
threshold. (2) Within a cell only vectors whose upper bound from the code reaches the threshold, or the k-th lower
bound of the block, are reranked in double precision. Cells are cut into blocks of bounded size, so no task holds
more than one block of queries and one of vectors, and each block passes on k rows for each query at most. The few
queries left with fewer than k neighbours (their bounds failed) are searched again without thresholds or bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hash_sample

K, EVERY = 20, 20
#: Standard errors in the bound of a code's estimate: one vector in 12 lies above its bound, most of these still above the threshold.
#: On random directions 0.98 of the neighbours are found and under a tenth of all pairs are reranked (see the tests).
EPSILON = 1.4
#: Rows of a block: queries, and coded vectors.
QUERY_BLOCK, CODE_BLOCK = 4096, 16384
#: Vectors of the sample that centres and thresholds are fitted on; centres; rounds of the fit.
SAMPLE, CENTRES, ROUNDS = 20_000, 32, 6


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centres(x: np.ndarray, n: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """``n`` centres at most of vectors ``x`` (rows) by Lloyd's rounds from evenly spaced distinct rows."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.unique(np.linspace(0, len(distinct) - 1, min(n, len(distinct))).astype(int))]
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        centres = np.array([x[own == i].mean(0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def thresholds(queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """The 2k-th largest product of each query within the sample, its own id apart; minus infinity where there are fewer."""
    k *= 2
    if len(sample) <= k:
        return np.full(len(queries), -np.inf)
    out = np.empty(len(queries))
    for at in range(0, len(queries), 256):
        products = queries[at : at + 256] @ sample.T
        products[ids[at : at + 256, None] == sample_ids[None, :]] = -np.inf
        out[at : at + 256] = np.partition(products, len(sample) - k, axis=1)[:, len(sample) - k]
    return out


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, norms and code alignments of vectors ``x`` (rows); ``centre`` is one for all or one for each."""
    u = (x - centre) @ turn.T
    norm = np.linalg.norm(u, axis=1)
    bits = u >= 0
    align = np.abs(u).sum(1) / math.sqrt(x.shape[1])
    align = np.divide(align, norm, out=np.ones_like(norm), where=norm > 0)
    return np.packbits(bits, axis=1), norm, align


def bounds(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, align: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by vectors) and the half widths of their bounds."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = ((queries @ turn.T).astype(np.float32) @ signs.T) * (norm / align / math.sqrt(dim)).astype(np.float32) + (queries @ centre)[:, None]
    spread = norm * np.sqrt(np.maximum(1 - align**2, 0)) / align * epsilon / math.sqrt(max(dim - 1, 1))
    return estimate, np.linalg.norm(queries, axis=1)[:, None] * spread


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def survivors(queries: np.ndarray, least: np.ndarray, codes: np.ndarray, norm: np.ndarray, align: np.ndarray, centre: np.ndarray, turn: np.ndarray, own: np.ndarray, k: int, epsilon: float) -> np.ndarray:
    """Which vectors are reranked for which query: those whose upper bound reaches the query's threshold and the k-th lower bound."""
    if math.isinf(epsilon):
        return ~own
    estimate, half = bounds(queries, codes, norm, align, centre, turn, epsilon)
    estimate[own] = -np.inf
    if codes.shape[0] > k:
        least = np.maximum(least, np.partition(estimate - half, codes.shape[0] - k, axis=1)[:, codes.shape[0] - k])
    return ~own & (estimate + half >= least[:, None] - 1e-6)


def _search(queries: pa.Table, vectors: pa.Table, k: int, centres: dict[int, np.ndarray], seed: int, epsilon: float) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not queries.num_rows or not vectors.num_rows:
        return schema.empty_table()
    dim, cell = queries.column("dim")[0].as_py(), queries.column("cell")[0].as_py()
    centre, turn = centres[dim][cell], rotation(dim, seed)
    x, xi = _matrix(vectors.column("v"), dim), vectors.column("vec_id").to_numpy()
    y, yi, least = _matrix(queries.column("v"), dim), queries.column("vec_id").to_numpy(), queries.column("least").to_numpy()
    codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
    norm, align = vectors.column("norm").to_numpy(), vectors.column("align").to_numpy()
    qs, vs, scores = [], [], []
    for at in range(0, len(y), 128):
        part = slice(at, at + 128)
        keep = survivors(y[part], least[part], codes, norm, align, centre, turn, yi[part, None] == xi[None, :], k, epsilon)
        for i, q in enumerate(y[part]):
            near = np.flatnonzero(keep[i])
            exact = x[near] @ q
            if len(near) > k:
                best = np.flatnonzero(exact >= np.partition(exact, len(near) - k)[len(near) - k])
                near, exact = near[best], exact[best]
            order = np.lexsort((xi[near], -exact))[:k]
            qs.append(np.full(len(order), yi[at + i]))
            vs.append(xi[near][order])
            scores.append(exact[order])
    return pa.Table.from_arrays([pa.array(np.concatenate(qs)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(scores))], schema=schema)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v, dim)`` of the vectors that take part: null vectors and ids, zero vectors and vectors with null or
    non-finite components are left out."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def sample(rows: DataFrame, most: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a bounded sample of ``usable`` rows, by dimension."""
    out = {}
    found = hash_sample(rows, ["vec_id", "v"], most).toArrow()
    dims = found.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = found.filter(pa.array(dims == dim))
        out[int(dim)] = part.column("vec_id").to_numpy(), _matrix(part.column("v"), int(dim))
    return out


def index(rows: DataFrame, centres: dict[int, np.ndarray], seed: int = 7) -> DataFrame:
    """Codes of all ``usable`` rows: ``(vec_id, v, dim, cell, code, norm, align)``. A dimension without centres has the zero centre."""

    def code(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in map(int, np.unique(dims)):
                own = batch.filter(pa.array(dims == dim))
                x, at = _matrix(own.column("v"), dim), centres.get(dim, np.zeros((1, dim)))
                cell = nearest_centre(x, at)
                codes, norm, align = encode(x, at[cell], rotation(dim, seed))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("v"), own.column("dim"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(align)], ["vec_id", "v", "dim", "cell", "code", "norm", "align"])

    return cut(rows.mapInArrow(code, "vec_id long, v array<double>, dim int, cell int, code binary, norm double, align double"))


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7, epsilon: float = EPSILON, query_block: int = QUERY_BLOCK, code_block: int = CODE_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows by inner product of each row whose id is divisible by ``every``.

    Rows with the query's id are not its neighbours. Ties go to the smaller id. A repeated query id is searched
    once, with its least vector; other repeated rows are candidates each. Vectors of another dimension than
    the query's are not compared. ``usable`` says which vectors take part; an empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col)
    known = sample(rows)
    centres = {dim: fit_centres(x) for dim, (_, x) in known.items()}
    codes = index(rows, centres, seed)
    cells = {(r.dim, r.cell): r for r in codes.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("norm").alias("radius")).collect()}  # at most CENTRES a dimension
    for dim in {d for d, _ in cells} - set(centres):
        centres[dim] = np.zeros((1, dim))
    queries = codes.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("m")).select("vec_id", "m.dim", "m.v")
    shared = vectors.sparkSession.sparkContext.broadcast(known)

    def probe(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in map(int, np.unique(dims)):
                own = batch.filter(pa.array(dims == dim))
                y, yi = _matrix(own.column("v"), dim), own.column("vec_id").to_numpy()
                ids, x = shared.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                least = thresholds(y, yi, x, ids, k)
                mine = sorted(c for d, c in cells if d == dim)
                most = y @ centres[dim][mine].T + np.linalg.norm(y, axis=1)[:, None] * np.array([cells[dim, c].radius for c in mine])
                meets = [[c for c, m in zip(mine, row, strict=True) if m >= t - 1e-6] for row, t in zip(most, least, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("dim"), own.column("v"), pa.array(least), pa.array(meets, pa.list_(pa.int32()))], ["vec_id", "dim", "v", "least", "cells"])

    asked = cut(queries.mapInArrow(probe, "vec_id long, dim int, v array<double>, least double, cells array<int>"))
    blocks = F.lit(1)
    for (dim, cell), r in cells.items():
        if (down := -(-r.n // code_block)) > 1:
            blocks = F.when((F.col("dim") == dim) & (F.col("cell") == cell), down).otherwise(blocks)

    def meet(asking: DataFrame, width: float) -> DataFrame:
        across = max(1, -(-asking.count() // query_block))
        left = asking.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int")).withColumn("cell", F.explode("cells")).drop("cells").withColumn("cb", F.explode(F.sequence(F.lit(0), blocks - 1)))
        right = codes.withColumn("cb", F.pmod(F.monotonically_increasing_id(), blocks).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        by = ["dim", "cell", "qb", "cb"]
        found = left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(lambda a, b: _search(a, b, k, centres, seed, width), "query_id long, vec_id long, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = cut(meet(asked, epsilon))
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = cut(asked.where(F.col("least") > float("-inf")).join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return first
    every_cell = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(c).alias("c")) for d, c in cells])
    again = short.withColumn("least", F.lit(float("-inf"))).withColumn("cells", F.transform(F.filter(every_cell, lambda x: x["d"] == F.col("dim")), lambda x: x["c"].cast("int")))
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(meet(again, float("inf")))
