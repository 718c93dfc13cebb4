"""Whitening of embeddings: exactly centred integer vectors, Gram matrix by MLlib, eigenvectors by ``eigh``.

Vectors become integers (floor of 256 times the entry). The fit list is each distinct vector once; its sums are exact,
so a centred row (n times the vector, less the sums, over n) has one rounding. ``RowMatrix.computeGramianMatrix`` adds
up outer products over Spark's tasks; only sums and the Gram matrix, whose sizes are the dimension and its square,
reach the driver. Projections go out as a small array to ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

COMPONENTS, SCALE = 4, 256


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector is neither null nor empty nor holds null or non-finite entries or ones too large for a long."""
    scaled = F.transform(F.col(f"`{vec_col}`").cast("array<double>"), lambda c: c * scale)
    fits = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < 9.2e18), F.lit(False)))
    return rows.select(F.col(f"`{id_col}`").alias("vec_id"), scaled.alias("v")).where((F.size("v") > 0) & fits).select("vec_id", F.transform("v", lambda c: F.floor(c).cast("long")).alias("x"))


def sums(x: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows of ``x`` and the exact sum of each dimension."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(dim, object), 0
        for f in frames:
            if len(f):
                m = np.stack(f["x"].to_numpy())
                low = m & 0xFFFFFFFF  # halves can't overflow in a batch
                total, n = total + low.sum(0).astype(object) + ((m >> 32).sum(0).astype(object) << 32), n + len(m)
        yield pd.DataFrame({"d": [-1, *range(dim)], "s": [str(n), *map(str, total)]})

    found = x.mapInPandas(add, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {r.d: int(r.s) for r in found.collect()}
    return by.get(-1, 0), [by.get(i, 0) for i in range(dim)]


def spread(m: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * m - total`` exactly: longs where they fit, else Python's integers."""
    most = n * int(max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) + max(map(abs, total), default=0)
    return n * m - np.array(total, np.int64) if most < 2**63 else n * m.astype(object) - np.array(total, object)


def deviations(wide: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if wide.dtype != object:
        most = int(np.abs(wide).max(initial=0))
        if most * most * wide.shape[1] < 2**63:
            return (wide * wide).sum(1).tolist()
        wide = wide.astype(object)
    return (wide * wide).sum(1).tolist()


def gramian(rows: DataFrame, col: str) -> np.ndarray:
    """Sum of outer products of the arrays in ``col``."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(col).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit(x: DataFrame, dim: int, components: int) -> dict:
    """``n``, ``sums``, eigenvalues, the matrix that whitens centred rows, shares and ``identity_error`` of the distinct vectors in ``x(x)``."""
    each = cut(x.select("x").distinct())
    n, total = sums(each, dim)

    def centre(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"c": list((spread(np.stack(f["x"].to_numpy()), n, total) / n).astype(float))})

    centred = each.mapInPandas(centre, "c array<double>")
    values, vectors = np.linalg.eigh(gramian(centred, "c") / n)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    trace, kept = float(values.sum()), [i for i in range(min(components, dim)) if values[i] > dim * np.finfo(float).eps * max(values[0], 0)]
    matrix = vectors[:, kept] / np.sqrt(values[kept])
    out = {"n": n, "sums": total, "values": values, "matrix": matrix, "kept": len(kept), "shares": [float(v / trace) if trace > 0 else None for v in values[:components]], "identity_error": None}
    if kept:

        def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield pd.DataFrame({"w": list(np.stack(f["c"].to_numpy()) @ matrix)})

        white = centred.mapInPandas(project, "w array<double>")
        mean = np.array(white.agg(*(F.avg(F.col("w")[i]) for i in range(len(kept)))).first())
        shifted = white.select(F.zip_with("w", F.array(*(F.lit(float(v)) for v in mean)), lambda a, b: a - b).alias("w"))
        out["identity_error"] = float(np.abs(gramian(shifted, "w") / n - np.eye(len(kept))).max())
    return out


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each vector and component up to ``components`` (at most the dimension): ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, null beyond 38 digits. Left out are rows whose vector is
    null, empty, holds null or non-finite entries, or isn't of the most frequent length (of equally frequent ones the
    longest). Repeated rows keep their rows and count once in the fit; null ids are kept. A component whose eigenvalue is
    zero up to rounding (fewer distinct vectors than components, constant dimensions) has null ``whitened``; ``explained`` is
    null if all vectors are equal. Components of equal eigenvalues come in any rotation. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    x = integer_vectors(rows, id_col, vec_col, scale)
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], SCHEMA)
    dim = lengths.d
    x = x.where(F.size("x") == dim)
    f = fit(x, dim, components)
    n, total, matrix, kept = f["n"], f["sums"], spark.sparkContext.broadcast(f["matrix"]), f["kept"]
    shares, error, number = f["shares"], f["identity_error"], min(components, dim)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            if len(part):
                wide = spread(np.stack(part["x"].to_numpy()), n, total)
                white = (wide / n).astype(float) @ matrix.value
                far = [str(d) if d < 10**38 else None for d in deviations(wide)]
                ids = part["vec_id"]
                for c in range(number):
                    yield pd.DataFrame({"vec_id": ids, "component": c + 1, "n": n, "deviation": far, "whitened": white[:, c] if c < kept else None, "explained": shares[c], "identity_error": error})

    out = x.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(project, "vec_id string, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return out.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whitened(rows: DataFrame) -> DataFrame:
    """``whiten`` with ``deviation`` as a long, null where it doesn't fit."""
    return whiten(rows).withColumn("deviation", F.col("deviation").try_cast("long"))
