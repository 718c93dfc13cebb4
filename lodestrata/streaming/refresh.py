"""Continuous index refresh: changed files arrive as a stream, each batch replaces their rows.

An extension: batch ``plans.store.refresh`` is the reference form. The state is the published version, so
a batch that is run again after a failure gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.plans import store


def refresh_stream(spark: SparkSession, changes: DataFrame, root: str, parse, relation: str, checkpoint: str) -> StreamingQuery:
    """``changes(path, sequence, digest, text)`` streams in, null ``text``: removed; ``relation`` and ``files`` at ``root`` follow it.

    Of several changes of a path in one batch the one with the highest ``sequence`` counts, removals like others.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        own = batch.groupBy("path").agg(F.max_by(F.struct("digest", "text"), "sequence").alias("s")).select("path", "s.*")
        base = store.current(batch.sparkSession, root)
        live = own.where("text is not null")
        rows, files = parse(live), live.select("path", "digest")
        if base:
            rows = store.load(batch.sparkSession, root, relation, base).join(own.select("path"), "path", "left_anti").unionByName(rows)
            files = store.load(batch.sparkSession, root, "files", base).join(own.select("path"), "path", "left_anti").unionByName(files)
        store.publish(batch.sparkSession, root, {relation: rows, "files": files}, base)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type with a watermark; works on batch tables too."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
