"""Binding references to what they mean: first by the full identity, else by a unique weaker one, else not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.specifiers import compiled, holds
from lodestrata.functions.text import pypi_name

IDENTITY = ["project_id", "ecosystem", "package", "version", "instance"]


def bind(edges: DataFrame, nodes: DataFrame, ref: str = "ref") -> DataFrame:
    """``edges`` (with ``IDENTITY`` columns of their target) with ``ref`` of the node they mean and ``how`` they were bound.

    * ``exact``: a node has all five parts, absent ones included;
    * ``unique``: the edge names no instance and exactly one node has its project, ecosystem, package and version;
    * ``unresolved``: none, several, or a version that isn't known. Ecosystems compare in lower case.
    Nodes are reduced to one row by identity and one by the weaker key, so both joins keep the number of edges.
    """
    own = nodes.select(*[F.lower(c).alias(c) if c == "ecosystem" else F.col(c) for c in IDENTITY], F.col(ref).alias("ref_"))
    exact = own.groupBy(*IDENTITY).agg(F.min("ref_").alias("exact_"))
    weak = own.where("version is not null").groupBy(*IDENTITY[:4]).agg(F.count("*").alias("n_"), F.min("ref_").alias("only_"))
    left = edges.withColumn("eco_", F.lower("ecosystem"))
    same = lambda side, cols: [(F.col("eco_") if c == "ecosystem" else left[c]).eqNullSafe(side[c]) for c in cols]
    out = left.join(exact, same(exact, IDENTITY), "left").select(left["*"], "exact_")
    out = out.join(weak, [(F.col("eco_") if c == "ecosystem" else out[c]) == weak[c] for c in IDENTITY[:4]], "left").select(out["*"], "n_", "only_")
    unique = F.col("instance").isNull() & (F.col("n_") == 1)
    found = F.coalesce("exact_", F.when(unique, F.col("only_")))
    how = F.when(F.col("exact_").isNotNull(), "exact").when(unique, "unique").otherwise("unresolved")
    return out.select(*edges.columns, found.alias(ref), how.alias("how"))


def tool_usages(definitions: DataFrame, declarations: DataFrame) -> DataFrame:
    """``definitions(project_id, ecosystem, package, scope)`` of configured tools with ``status``: used (a direct declaration outside
    the build), build-only or unmatched (``config.tool-usage-unmatched``), and ``n_declarations``."""
    d = declarations.where("kind = 'direct'").groupBy("project_id", F.lower("ecosystem").alias("eco"), "package").agg(F.count("*").alias("n"), F.bool_or(F.col("scope") != "build").alias("outside"))
    rows = definitions.withColumn("eco", F.lower("ecosystem")).join(d, ["project_id", "eco", "package"], "left")
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("outside"), "used").otherwise("build-only")
    return rows.select(*definitions.columns, status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_declarations"))


def alias_imports(usages: DataFrame, imports: DataFrame, sources: DataFrame, builtins: list[str]) -> DataFrame:
    """``usages(project_id, reference)`` of ``#`` aliases with ``kind`` and ``target``; other references are ``unmatched``.

    ``imports(project_id, alias, target)`` are exact entries with one text as their target (null: a condition or list).
    A target ``./path`` is ``local`` if ``sources(project_id, path)`` has it, a built-in module is ``builtin``, a bare name
    is its ``package``; patterns, traversals and everything else are ``unknown``.
    """
    entry = imports.groupBy("project_id", F.col("alias").alias("reference")).agg(F.min("target").alias("t"), F.count("*").alias("n_entries"))
    files = sources.select("project_id", F.concat(F.lit("./"), "path").alias("t")).distinct().withColumn("there", F.lit(True))
    rows = usages.join(entry, ["project_id", "reference"], "left").join(files, ["project_id", "t"], "left")
    alias, t = F.col("reference").startswith("#"), F.col("t")
    bad = (F.col("reference") == "#") | F.col("reference").endswith("/") | F.col("reference").contains("*") | t.isNull() | (t == "") | t.rlike(r"[*?#\x00-\x1f]")
    bad = bad | F.exists(F.split(F.regexp_replace(t, r"^\./", ""), "/"), lambda s: F.lower(s).isin("", ".", "..", "node_modules") | s.contains("%") | s.contains("\\"))
    kind = F.when(~alias, "unmatched").when(F.coalesce(bad, F.lit(True)), "unknown").when(t.startswith("./"), F.when(F.col("there"), "local").otherwise("unknown")).when(t.isin(*builtins), "builtin").when(t.rlike(r"^(?:@[a-z0-9_.-]+/)?[a-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*\z") & ~t.rlike(r"^[./]"), "package").otherwise("unknown")
    package = F.when(t.startswith("@"), F.substring_index(t, "/", 2)).otherwise(F.substring_index(t, "/", 1))
    return rows.select(*usages.columns, kind.alias("kind"), F.when(kind == "package", package).when(kind.isin("local", "builtin"), t).alias("target"))


def specifier_holds(version_key: Column, bounds: Column) -> Column:
    """Whether a version key lies in every (operator, key) of ``bounds``; null if a key is missing. Keys are one scheme's, so text order is theirs."""
    test = lambda b: F.when(b["op"] == "==", version_key == b["key"]).when(b["op"] == "!=", version_key != b["key"]).when(b["op"] == "<=", version_key <= b["key"]).when(b["op"] == ">=", version_key >= b["key"]).when(b["op"] == "<", version_key < b["key"]).when(b["op"] == ">", version_key > b["key"])
    return F.when(version_key.isNull() | F.exists(bounds, lambda b: b["key"].isNull()), F.lit(None)).otherwise(F.forall(bounds, test))


def bind_locks(declarations: DataFrame, locks: DataFrame, holds: Column) -> DataFrame:
    """``declarations(declaration, project_id, package, ...)`` with the lock record ``record`` they are bound to.

    Candidates are records of ``locks(record, project_id, package, ...)`` of the same PyPI name whose version ``holds`` (true, false
    or null). ``outcome``: bound where exactly one may hold and it does, none, ambiguous, or unknown where the only one can't be told.
    ``holds`` may use all columns but ``declaration`` and ``record``: it is told once for each pair of different declarations and
    records of a project's package, whose copies are counted, so a package with many of either doesn't multiply them.
    """
    given = [c for c in declarations.columns if c != "declaration"]
    asked = declarations.select(*given).distinct().withColumn("name_", pypi_name(F.col("package")))
    right = locks.withColumn("name_", pypi_name(F.col("package"))).drop("package")
    right = right.groupBy(*[c for c in right.columns if c != "record"]).agg(F.count("*").alias("copies_"), F.min("record").alias("record_"))
    hits = asked.join(right, ["project_id", "name_"]).withColumn("holds_", holds).where(F.coalesce(F.col("holds_"), F.lit(True)))
    kinds = hits.groupBy(*given).agg(F.sum("copies_").alias("n"), F.sum(F.when(F.col("holds_").isNull(), F.col("copies_")).otherwise(0)).alias("n_unknown"), F.min("record_").alias("only"))
    kinds = kinds.withColumnsRenamed({c: f"{c}_of" for c in given})
    found = declarations.join(kinds, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in given])
    per = found.groupBy("declaration").agg(F.sum("n").alias("n"), F.sum("n_unknown").alias("n_unknown"), F.min("only").alias("only"))
    outcome = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").when(F.col("n_unknown") > 0, "unknown").otherwise("bound")
    return declarations.join(per, "declaration", "left").select(*declarations.columns, outcome.alias("outcome"), F.when(outcome == "bound", F.col("only")).alias("record"))


def bind_locks_by_text(declarations: DataFrame, locks: DataFrame) -> DataFrame:
    """``bind_locks`` with texts: ``declarations`` has ``constraint_scheme`` and ``constraint_raw``, ``locks`` has ``version``; prereleases may be bound.

    Each distinct constraint is compiled once and joined to its declarations.
    """
    texts = compiled(declarations.select(F.col("constraint_scheme").alias("scheme"), F.col("constraint_raw").alias("raw"))).select(F.col("scheme").alias("constraint_scheme"), F.col("raw").alias("constraint_raw"), "clauses")
    own = declarations.join(texts, ["constraint_scheme", "constraint_raw"], "left")
    bound = bind_locks(own, locks.withColumnRenamed("version", "version_"), holds(F.col("clauses"), F.col("constraint_scheme"), F.col("version_")))
    return bound.select(*declarations.columns, "outcome", "record")
