"""Comparison of snapshots and inventories by keys and multisets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def occurrences(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """``occurrence``: the place (from 1) of a row among rows of equal key."""
    return df.withColumn("occurrence", F.row_number().over(W.partitionBy(*key).orderBy(*order)))


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``key`` in one snapshot only, with ``change`` added or removed; nulls are equal. One shuffle of either side."""
    both = old.select(*key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    sides = both.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n")).where("o <> n")
    return sides.select(*key, F.when(F.col("n") == 1, "added").otherwise("removed").alias("change"))


def multiset_compare(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Counts of each key on either side: ``n_left``, ``n_right``, ``matched``, ``left_only``, ``right_only``."""
    both = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = both.groupBy(key).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    return n.select(*key, "n_left", "n_right", F.least("n_left", "n_right").alias("matched"), F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0)).alias("left_only"), F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0)).alias("right_only"))


def input_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, status)`` of two ``(path, digest)`` tables: added, removed or modified; unchanged paths are left out."""
    o, n = old.select("path", F.col("digest").alias("old")), new.select("path", F.col("digest").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return o.join(n, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def map_diff(old: DataFrame, new: DataFrame, id_col: str, map_col: str) -> DataFrame:
    """Entries of a map column that were added, removed or changed, by id."""
    o = old.select(id_col, F.explode(map_col).alias("key", "old"))
    n = new.select(id_col, F.explode(map_col).alias("key", "new"))
    change = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "added").when(F.col("new").isNull() & F.col("old").isNotNull(), "removed").otherwise("changed")
    return o.join(n, [id_col, "key"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(id_col, "key", "old", "new", change.alias("change"))


def ordered_digest(df: DataFrame, group: list[str], order: list[str], line: Column, separator: str) -> DataFrame:
    """``digest``: SHA-256 of each group's lines in order (``order``, then the line), joined by ``separator``; null lines are left out.

    Groups are read as sorted rows and hashed as they come, so a group can be larger than a row or a task's memory;
    the hash needs its text in order, so a group is one task's work. ``group`` holds no fractions.
    """
    n = len(group)
    lines = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))
    keys = [f"g{i}" for i in range(n)]
    rows = lines.repartition(*keys).sortWithinPartitions(*keys, *[f"o{i}" for i in range(len(order))], "line").select(*keys, "line")
    cut = separator.encode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, empty, kinds = None, hashlib.sha256(), True, None

        def done(found):
            columns = [pa.array([k[i] for k, _ in found], kinds[i]) for i in range(n)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in found], pa.string())], [*keys, "digest"])

        for batch in batches:
            kinds, found = batch.schema.types, []
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        found.append((now, hashed.hexdigest()))
                    now, hashed, empty = key, hashlib.sha256(), True
                if text is not None:
                    hashed.update(text.encode() if empty else cut + text.encode())
                    empty = False
            if found:
                yield done(found)
        if now is not None:
            yield done([(now, hashed.hexdigest())])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(read, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "digest string"]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, group, strict=True)], "digest")


def first_distinct(df: DataFrame, group: str, value: str, most: int, name: str) -> DataFrame:
    """``(group, name)``: the ``most`` least distinct non-null values of each group in order. A task passes on ``most`` values of a
    group at most, before and after the rows are dealt by value, so no group is gathered."""
    some = df.select(group, value).where(F.col(value).isNotNull()).distinct()
    place = F.row_number().over(W.partitionBy(group).orderBy(value))
    return some.withColumn("place_", place).where(F.col("place_") <= most).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias(name))


def state_digest(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """SHA-256 of each group's rows in order, a row's columns joined by ``|``, rows by newline. Null: empty text."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return ordered_digest(df, group, order, line, "\n")


def comparable(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, reason)`` of snapshots ``(id, revision, repository_key, selection_key)`` by id: null where a comparison means something, else why it doesn't.

    Snapshots compare only if they are of the same repository and selection, analysed by the same revision.
    """
    o, n = old.alias("o"), new.alias("n")
    differ = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    reason = F.when(F.col("o.id").isNull(), "no-old-snapshot").when(F.col("n.id").isNull(), "no-new-snapshot").when(differ("repository_key"), "other-repository").when(differ("selection_key"), "other-selection").when(differ("revision"), "other-revision")
    return o.join(n, F.col("o.id") == F.col("n.id"), "full").select(F.coalesce("o.id", "n.id").alias("id"), reason.alias("reason"))
