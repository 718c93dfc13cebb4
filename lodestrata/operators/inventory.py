"""Inventory roll-up, search, counts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import pypi_name

from .evidence import KEY
from .ranking import ranked


def roll_up(declarations: DataFrame, resolved: DataFrame, usages: DataFrame) -> DataFrame:
    """One row per key over three relations: names from the first that has them, distinct versions, flags.

    ``declarations`` and ``resolved`` carry ``display_name``, ``resolved`` also ``version``, ``usages`` also ``kind``.
    The three are reduced to one tagged union and one aggregation; no relation is joined with another.
    """
    nothing = F.lit(None).cast("string")
    rows = (
        declarations.select(*KEY, F.lit(1).alias("tag"), F.col("display_name"), nothing.alias("version"), nothing.alias("kind"))
        .unionByName(resolved.select(*KEY, F.lit(2).alias("tag"), F.col("display_name"), F.col("version"), nothing.alias("kind")))
        .unionByName(usages.select(*KEY, F.lit(3).alias("tag"), F.col("display_name"), nothing.alias("version"), F.col("kind")))
    )
    versions = F.array_sort(F.collect_set("version"))
    out = rows.groupBy(KEY).agg(
        F.min_by("display_name", "tag").alias("display_name"), versions.alias("versions"), F.bool_or(F.col("tag") == 1).alias("declared"),
        F.bool_or((F.col("tag") == 3) & ~F.coalesce(F.col("kind"), F.lit("")).isin("tool", "command", "configuration")).alias("imported"), F.count_if(F.col("tag") == 3).alias("n_usages"),
    )
    return out.withColumn("resolved_version", F.when(F.size("versions") == 1, F.col("versions")[0]))


def search(inventory: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows with ``needle`` in one of the text columns, without regard to case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.instr(F.lower(F.coalesce(F.col(c), F.lit(""))), needle.lower()) > 0)
    return inventory.where(hit)


#: Pages that end before this place come from a top-k, others from places dealt out by ranges.
NEAR = 4096


def page(df: DataFrame, order: list[str | Column], limit: int, offset: int = 0, near: int = NEAR) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an order with their ``place``, and ``truncated`` if more follow.

    A page near the start is a top-k of at most ``near`` rows; behind that every row gets its place by ranges, so no
    task holds the rows before a deep page.
    """
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000, offset 0 or more")
    if offset + limit < near:
        got = df.orderBy(*order).limit(offset + limit + 1).withColumn("place", F.row_number().over(W.orderBy(*order)))
    else:
        got = ranked(df, order).where((F.col("place") > offset) & (F.col("place") <= offset + limit + 1)).withColumn("place", F.col("place").cast("int"))
    return got.withColumn("truncated", F.max("place").over(W.partitionBy()) > offset + limit).where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def ecosystem_summary(projects: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """Projects and rows of each relation by ecosystem: relations are counted by project as one tagged union, then joined once."""
    rows = None
    for name, df in counts.items():
        own = df.groupBy("project_id").agg(F.count("*").alias("n")).select("project_id", *[(F.col("n") if x == name else F.lit(0).cast("long")).alias(f"n_{x}") for x in counts])
        rows = own if rows is None else rows.unionByName(own)
    per = rows.groupBy("project_id").agg(*[F.sum(f"n_{x}").alias(f"n_{x}") for x in counts])
    out = projects.select("project_id", F.lower("ecosystem").alias("ecosystem")).join(per, "project_id", "left")
    return out.groupBy("ecosystem").agg(F.count("*").alias("n_projects"), *[F.sum(F.coalesce(f"n_{x}", F.lit(0))).alias(f"n_{x}") for x in counts])


def impact(usages: DataFrame) -> DataFrame:
    """Usages by key: number, distinct sorted files, number by scope. Rows shrink to counts by (key, scope, file) first."""
    counts = usages.groupBy(*KEY, "scope", "source_path").agg(F.count("*").alias("n"))
    scopes = counts.groupBy(*KEY, "scope").agg(F.sum("n").alias("n"), F.collect_set("source_path").alias("files"))
    return scopes.groupBy(KEY).agg(
        F.sum("n").alias("n_usages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"), F.array_sort(F.collect_list(F.struct("scope", "n"))).alias("scopes")
    )


def batches(coordinates: DataFrame, size: int = 500, buckets: int = 1024) -> DataFrame:
    """``coordinates(package, version)`` dealt into batches ``(round, part)`` in which a package occurs once, ``size`` at most in each.

    The round of a coordinate is its version's place within its package. Rows of a round are numbered by hash bucket: a running
    sum over the buckets' sizes, a handful of rows, and a row number within the bucket, so no round is sorted in one task.
    """
    rounds = coordinates.distinct().withColumn("round", F.row_number().over(W.partitionBy("package").orderBy("version"))).withColumn("bucket", F.pmod(F.xxhash64("package"), F.lit(buckets)))
    sizes = rounds.groupBy("round", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("round").orderBy("bucket")) - F.col("n")).drop("n")
    placed = rounds.join(before, ["round", "bucket"]).withColumn("at", F.col("before") + F.row_number().over(W.partitionBy("round", "bucket").orderBy("package", "version")) - 1)
    return placed.select("package", "version", "round", F.floor(F.col("at") / size).alias("part"))


def filtered(inventory: DataFrame, ecosystem: str | None = None, package: str | None = None, project: str | None = None) -> DataFrame:
    """Rows of an ecosystem (without regard to case), a package (as its ecosystem compares names) and a project; null: any."""
    out = inventory
    if ecosystem is not None:
        out = out.where(F.lower("ecosystem") == ecosystem.lower())
    if package is not None:
        name = lambda c: F.when(F.lower("ecosystem") == "pypi", pypi_name(c)).when(F.lower("ecosystem") == "npm", F.lower(c)).otherwise(c)
        out = out.where(name(F.col("package")) == name(F.lit(package)))
    if project is not None:
        out = out.where(F.col("project_id").cast("string") == project)
    return out


def explain(inventory: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(request, package)`` with ``outcome`` found, not-found or ambiguous, ``n`` and, if found, the ``project_id`` and ``ecosystem``.

    The inventory is counted by exact package before requests join it: many requests of a package with many candidates aren't multiplied.
    """
    candidates = inventory.groupBy("package").agg(F.count("ecosystem").alias("n"), F.min(F.struct("project_id", "ecosystem")).alias("one"))
    hits = requests.join(candidates, "package", "left")
    per = hits.groupBy("request", "package").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("one").alias("one"))
    outcome = F.when(F.col("n") == 0, "not-found").when(F.col("n") == 1, "found").otherwise("ambiguous")
    only = lambda c: F.when(F.col("n") == 1, F.col(f"one.{c}")).alias(c)
    return per.select("request", "package", outcome.alias("outcome"), "n", only("project_id"), only("ecosystem"))


def with_findings(inventory: DataFrame, findings: DataFrame) -> DataFrame:
    """``inventory`` with ``n_findings``: by qualified key, on PyPI else by name in the same project where the key has none."""
    own = findings.groupBy(KEY).agg(F.count("*").alias("n1"))
    loose = findings.where(F.lower("ecosystem") == "pypi").groupBy("project_id", pypi_name(F.col("package")).alias("loose")).agg(F.count("*").alias("n2"))
    out = inventory.withColumn("loose", F.when(F.lower("ecosystem") == "pypi", pypi_name(F.col("package")))).join(own, KEY, "left").join(loose, ["project_id", "loose"], "left")
    return out.select(*[inventory[c] for c in inventory.columns], F.coalesce("n1", "n2", F.lit(0)).alias("n_findings"))


def shared_page(tables: dict[str, tuple[DataFrame, list[str]]], limit: int, offset: int = 0) -> DataFrame:
    """``(table, place, row, total)``: the same page of several named tables, each in its own order, rows as canonical JSON."""
    out = None
    for name, (df, order) in tables.items():
        own = page(df, order, limit, offset)
        total = df.agg(F.count("*").alias("total"))
        rows = own.select(F.lit(name).alias("table"), "place", F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row")).crossJoin(F.broadcast(total))
        out = rows if out is None else out.unionByName(rows)
    return out


def projects_in_order(projects: DataFrame) -> list[Column]:
    """The order of ``projects(project_id, root)``: by depth of the root (``.`` has none), then path, then id."""
    depth = F.when(F.col("root") == ".", 0).otherwise(F.size(F.split("root", "/")))
    return [depth.asc(), F.col("root").asc(), F.col("project_id").asc()]


def capability_maps(capabilities: DataFrame) -> DataFrame:
    """``(project_id, capabilities)`` of ``capabilities(project_id, name, state)``: a map from name to state; of several states of a name the
    least complete counts (unsupported, partial, complete). Names are a handful, so a project's map is small."""
    rank = F.when(F.col("state") == "unsupported", 0).when(F.col("state") == "partial", 1).otherwise(2)
    worst = capabilities.groupBy("project_id", "name").agg(F.min_by("state", rank).alias("state"))
    return worst.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "state")))).alias("capabilities"))
