"""Repository files as a table, and the helpers that parsers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no sources of a project.
EXCLUDED = (".git", ".hg", ".svn", ".tox", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", "target", ".gradle", ".idea")
MAX_BYTES = 8 * 1024 * 1024


def excluded(path: Column, names: list[str] | tuple[str, ...] = EXCLUDED) -> Column:
    """One-segment names match any segment of a relative path, longer ones its start."""
    single = [n for n in names if "/" not in n]
    hit = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, single))) if single else F.lit(False)
    for n in names:
        if "/" in n:
            hit = hit | (path == n) | path.startswith(n.rstrip("/") + "/")
    return hit


def read_files(spark: SparkSession, root: str, glob: str | None = None, skip: list[str] | tuple[str, ...] = EXCLUDED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(path, name, digest, text, problem)`` of the files under ``root``; paths are relative to it.

    The name filter prunes the listing; a file over ``max_bytes`` is never read: it keeps its row with ``problem``, no text, and a digest
    of its length and time. (Folders in ``skip`` are listed, and read unless too large: the listing takes no path filter.)
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.substring_index(F.col("path"), base + "/", -1), "^/+", "")
    name = F.element_at(F.split("path", "/"), -1)
    # both conditions reach the listing, so content is read of small files alone
    small = reader.load(root).where(F.col("length") <= max_bytes).select(path.alias("path"), "content").where(~excluded(F.col("path"), skip))
    large = reader.load(root).where(F.col("length") > max_bytes).select(path.alias("path"), "length", "modificationTime").where(~excluded(F.col("path"), skip))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    none = F.lit(None).cast("string")
    rows = small.select("path", name.alias("name"), F.sha2("content", 256).alias("digest"), text.alias("text"), none.alias("problem"))
    mark = F.concat_ws(" ", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return rows.unionByName(large.select("path", name.alias("name"), F.sha2(mark, 256).alias("digest"), none.alias("text"), F.lit("file.too-large").alias("problem")))


def folder(path: Column) -> Column:
    """The folder of a relative path; ``.`` at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def numbered_lines(files: DataFrame) -> DataFrame:
    """``(path, line, text)``: the lines of files, from 1."""
    return files.where("text is not null").select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
