"""Cutting lineage in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The cluster's shared checkpoint folder: the session's ``spark.checkpoint.dir``, or the one set on the context.

    Only a session on one machine (master ``local``) gets a temporary folder where none is set; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder, without lineage: lost executors cost no earlier work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again, for rounds that join their own results.

    ``checkpoint()`` keeps the plan's estimate of its size, which squares with each join of a result with itself: after
    twenty rounds planning takes minutes over a number of millions of digits. A file's size is what it is. Rows of each value of ``by``, which has few, lie apart: a condition on it reads only these.
    """
    at = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def merged(df: DataFrame) -> DataFrame:
    """``df`` whose joins, and those of what is selected, filtered or grouped from it, are merges unless the other side is marked for broadcast.

    For written rows that are many for their bytes: Spark takes them for as small as their packed files, or as the table they were made from, and would
    send millions of them through the driver to each task.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over the shuffle partitions, or over all cores if these are more: rows of one small file that stand for
    much work, such as texts to parse, would else be one task. The number is fixed, so that adaptive execution doesn't join the parts again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


class Grown:
    """Rows that grow by parts: a part is written again only when parts of its size have piled up, so n parts cost n log n rows, not n squared."""

    def __init__(self, first: DataFrame):
        self.parts = [(0, first)]

    def add(self, part: DataFrame) -> None:
        size = 0
        while self.parts and self.parts[-1][0] == size:
            part, size = written(self.parts.pop()[1].union(part)), size + 1
        self.parts.append((size, part))

    def rows(self) -> DataFrame:
        out = self.parts[0][1]
        for _, part in self.parts[1:]:
            out = out.union(part)
        return out
