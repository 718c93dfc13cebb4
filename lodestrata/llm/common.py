"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.lineage import cut, shared_folder  # noqa: F401

#: Keys of rows to take out are broadcast up to this number (two longs each), else joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Rows and bytes of an Arrow batch of whole texts. Spark's own bound (10,000 rows) holds tens of MB a task, several times over: in the JVM's
#: direct buffers, which it keeps, and in the worker.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 2_000_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python in small Arrow batches in what is run (not only planned) within; the session's settings come back after it."""
    before = {k: spark.conf.get(k, None) for k in BATCH_CONF}
    for k, v in BATCH_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def counted_side(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` marked for broadcast if they are ``most`` at most; they must be cheap to read twice (see ``cut``)."""
    return F.broadcast(rows) if rows.count() <= most else rows


def without(docs: DataFrame, gone: DataFrame, id_col: str, row_hash, most: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` without the rows whose id and ``row_hash`` (a column over ``docs``) are in ``gone(i, h)``; null ids match null ids.

    Only keys move: the rows themselves are filtered where they are read, unless ``gone`` has more than ``most`` keys.
    """
    i, h = fresh(docs, "gone_i"), fresh(docs, "gone_h")
    side = counted_side(cut(gone.select(F.col("i").alias(i), F.col("h").alias(h)).distinct()), most)
    return docs.join(side, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (row_hash == F.col(h)), "left_anti")


def hash_sample(df: DataFrame, by: list[str], most: int, bits: int = 12) -> DataFrame:
    """All rows of ``df`` if they are ``most`` at most, else those of the lowest hashes of the columns ``by``: 1 to ``most`` rows.

    Histograms of the hash's leading bits find the bound; where one bucket decides it and holds too much, the next bits part
    that bucket, so the sample never comes out empty. Where more than ``most`` rows share the lowest hash (equal in ``by``),
    ``most`` of these are taken. The choice depends on the values alone.
    """
    h = F.shiftrightunsigned(F.xxhash64(*by), 1)
    low, width, held, first = 0, 63, 0, True
    while width > 0:
        step = min(bits, width)
        inside = df if first else df.where((h >= low) & (h <= low + (1 << width) - 1))
        bucket = F.shiftright(h - F.lit(low), width - step)
        sizes = dict(inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())
        if first and sum(sizes.values()) <= most:
            return df
        end = next(b for b in sorted(sizes) if (held := held + sizes[b]) > most)
        held -= sizes[end]
        low, width, first = low + (end << (width - step)), width - step, False
        if 2 * held >= most:
            break
    return df.where(h < low) if held else df.where(h == low).limit(most)
