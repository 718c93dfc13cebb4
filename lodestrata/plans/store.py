"""Versioned Parquet relations: a version is written beside the others, then a new generation's file names it.

Readers follow the pointer, so they see a whole version or the one before. A writer passes the version it
started from; if the pointer has moved on, the new version is not published.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.lineage import cut
from lodestrata.operators.compare import first_distinct, input_changes


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _generations(spark: SparkSession, root: str) -> list[tuple[int, bool]]:
    """Generations in order: files of ``pointer`` named by a number, and whether they hold a version's name."""
    fs, folder = _files(spark, f"{root}/pointer")
    if not fs.exists(folder):
        return []
    return sorted((int(s.getPath().getName()), s.getLen() > 0) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())


def current(spark: SparkSession, root: str) -> str | None:
    """The published version's name: the one that the highest generation holds; generations without a name never were published."""
    found = [n for n, named in _generations(spark, root) if named]
    return spark.read.text(f"{root}/pointer/{found[-1]}").first()[0] if found else None


def _claim(spark: SparkSession, root: str, generation: int, version: str) -> None:
    """Names ``version`` in a file of its own, then moves that to the generation's place unless something is there."""
    fs, own = _files(spark, f"{root}/pointer/.{version}")
    out = fs.create(own, False)
    out.writeBytes(version)
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    keep = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    keep[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        context = hadoop.FileContext.getFileContext(own.toUri() if own.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(own), fs.makeQualified(_files(spark, f"{root}/pointer/{generation}")[1]), keep)
    except Exception as e:
        fs.delete(own, False)
        raise RuntimeError("another version was published; start again from it") from e


def publish(spark: SparkSession, root: str, relations: dict[str, DataFrame], base: str | None) -> str:
    """Writes ``relations`` as a new version on top of ``base`` and names it; raises if another was published meanwhile.

    A generation's file appears with its content in one move that doesn't replace another: of two writers on the same base one gets
    the place, the other raises and takes its files away. A writer that dies at any moment leaves either nothing published or
    the whole version; what it leaves beside that is never read, and an empty generation of older writers is passed over.
    """
    version = uuid.uuid4().hex
    fs, folder = _files(spark, f"{root}/{version}")
    try:
        for name, df in relations.items():
            df.write.parquet(f"{root}/{version}/{name}")
        found = _generations(spark, root)
        if current(spark, root) != base:
            raise RuntimeError("another version was published; start again from it")
        _claim(spark, root, found[-1][0] + 1 if found else 1, version)
    except BaseException:
        fs.delete(folder, True)
        raise
    return version


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` put in: rows of a key replace those that had it. Repeated keys of ``rows`` must not differ."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.distinct())


def load(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    version = version or current(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published at {root}")
    return spark.read.parquet(f"{root}/{version}/{name}")


def refresh(old_rows: DataFrame, old_files: DataFrame, files: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """Evidence rows and file state after a change: only added and modified files are parsed, removed ones lose their rows.

    ``files(path, digest, text)``; ``parse(files)`` gives rows with ``path``, of the columns of ``old_rows``.
    """
    changes = cut(input_changes(old_files, files))
    stale = changes.select("path")
    again = files.join(changes.where("status <> 'removed'").select("path"), "path", "left_semi")
    return old_rows.join(stale, "path", "left_anti").unionByName(parse(again)), files.select("path", "digest")


def staleness(old_files: DataFrame, files: DataFrame) -> DataFrame:
    """Number of changed paths by status with the first 20."""
    changes = input_changes(old_files, files)
    counts = changes.groupBy("status").agg(F.count("*").alias("n"))
    first = first_distinct(changes, "status", "path", 20, "first_paths")
    return counts.join(first, "status", "left").select("status", "n", F.coalesce("first_paths", F.array().cast("array<string>")).alias("first_paths"))
