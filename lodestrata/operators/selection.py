"""Selections, memberships, metrics and set changes."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.versions import pep440_key

from .evidence import KEY


def third_party(imports: DataFrame, local: DataFrame) -> DataFrame:
    """Imports ``(project_id, reference, ...)`` whose top module is neither in the standard library nor in ``local(project_id, module)``."""
    top = F.substring_index("reference", ".", 1)
    rows = imports.withColumn("module", top).where(~F.col("module").isin(*sorted(sys.stdlib_module_names)))
    return rows.join(local.select("project_id", "module").distinct(), ["project_id", "module"], "left_anti").drop("module")


def glob_pattern(glob: Column) -> Column:
    """A workspace glob as an anchored pattern: ``**`` crosses folders, ``*`` and ``?`` don't."""
    safe = F.regexp_replace(F.regexp_replace(glob, r"/+$", ""), r"([.+^$(){}|\[\]\\])", r"\\$1")
    safe = F.regexp_replace(F.regexp_replace(safe, r"\*\*/", "\u0001"), r"\*\*", "\u0002")
    safe = F.regexp_replace(F.regexp_replace(safe, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(safe, "\u0001", "(?:.*/)?"), "\u0002", ".*"), F.lit("$"))


def workspace_members(folders: DataFrame, globs: DataFrame) -> DataFrame:
    """``(workspace, folder)``: folders under a workspace that one of its globs takes and no ``!`` glob leaves out.

    ``folders(folder)``; ``globs(workspace, glob)``, ``.`` the top. Folders explode to their ancestors, so that a
    workspace meets its own subtree only.
    """
    from .lookup import prefixes

    inside = folders.distinct().select("folder", F.explode(prefixes(F.col("folder"))).alias("workspace")).where("folder <> workspace")
    rest = F.when(F.col("workspace") == ".", F.col("folder")).otherwise(F.expr("substring(folder, length(workspace) + 2)"))
    tagged = globs.select("workspace", F.col("glob").startswith("!").alias("out"), glob_pattern(F.regexp_replace("glob", "^!?(?:\\./)?", "")).alias("pattern"))
    hits = inside.withColumn("rest", rest).join(tagged, "workspace").where(F.expr("rest rlike pattern"))
    return hits.groupBy("workspace", "folder").agg(F.bool_or("out").alias("out")).where("not out").select("workspace", "folder")


def scores(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """True and false positives and negatives and unknowns by comparing ``positive`` (null: unknown) of two tables on ``key``."""
    e, o = expected.select(*key, F.col("positive").alias("e")), observed.select(*key, F.col("positive").alias("o"), F.lit(True).alias("seen"))
    both = e.join(o, key, "full_outer")
    return both.agg(
        F.count_if(F.col("e") & F.col("o")).alias("tp"), F.count_if(~F.coalesce("e", F.lit(False)) & F.col("o")).alias("fp"), F.count_if(F.col("e") & ~F.coalesce("o", F.col("seen").isNotNull() & F.col("o").isNull())).alias("fn"),
        F.count_if(~F.col("e") & ~F.coalesce("o", F.lit(False)) & ~(F.col("seen").isNotNull() & F.col("o").isNull())).alias("tn"), F.count_if(F.col("seen").isNotNull() & F.col("o").isNull()).alias("unknown"),
    )


def membership_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str], old_date: str, new_date: str) -> DataFrame:
    """``(key, change)`` between two dated lists: added, removed, changed or unchanged; nothing unless ``new_date`` is later."""
    o = old.select(key, F.struct(*fields).alias("o"))
    n = new.select(key, F.struct(*fields).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").where(F.lit(new_date) > F.lit(old_date)).select(key, change.alias("change"))


def nested_page(df: DataFrame, lists: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows whose list columns are cut to one page, with ``n_<list>`` totals and ``truncated``."""
    more = F.lit(False)
    out = df
    for c in lists:
        more = more | (F.col(f"n_{c}") > offset + limit)
        out = out.withColumn(f"n_{c}", F.coalesce(F.size(c), F.lit(0))).withColumn(c, F.slice(c, offset + 1, limit))
    return out.withColumn("truncated", more)


#: Bytes that a response may have, and entries of a list that a page may ask for.
RESPONSE_BYTES, MOST_ENTRIES = 256 * 1024, 100
#: Bytes between two entries of a response.
SEPARATOR_BYTES = 2


def byte_pages(responses: DataFrame, entries: DataFrame, by: list[str], limit: int, offset: int = 0, budget: int = RESPONSE_BYTES) -> DataFrame:
    """``(*by, status, page_limit, n_bytes, truncated, next_offset)`` of ``responses(*by, base_bytes)`` whose nested lists are paged to fit ``budget``.

    ``entries(*by, record, list, place, json)`` has a row for each entry of each record's lists, ``place`` from 0. A page takes
    the places ``offset`` to ``offset + page_limit`` of every list; ``page_limit`` is ``limit``, or the first of its halves (down to 1) with which the
    response fits; ``status`` is budget-exceeded where not even 1 does. The bytes of all halves are summed up in one
    aggregation, so no list is gathered or cut more than once (``page_entries``). Null texts count as empty.
    """
    if not 1 <= limit <= MOST_ENTRIES or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST_ENTRIES}, offset 0 or more")
    limits = [limit]
    while limits[-1] > 1:
        limits.append(max(1, limits[-1] // 2))
    size = F.coalesce(F.octet_length("json"), F.lit(0)) + SEPARATOR_BYTES
    inside = lambda k: (F.col("place") >= offset) & (F.col("place") < offset + k)
    sums = entries.groupBy(by).agg(*[F.sum(F.when(inside(k), size)).alias(f"b{k}") for k in limits], F.max("place").alias("last"))
    whole = lambda k: F.col("base_bytes") + F.coalesce(F.col(f"b{k}"), F.lit(0))
    rows = responses.join(sums, by, "left").withColumn("page_limit", F.coalesce(*[F.when(whole(k) <= budget, F.lit(k)) for k in limits]))
    n_bytes = F.coalesce(*[F.when(F.col("page_limit") == k, whole(k)) for k in limits])
    more = F.coalesce(F.col("last") >= offset + F.col("page_limit"), F.col("page_limit").isNull())
    return rows.select(*by, F.when(F.col("page_limit").isNull(), "budget-exceeded").otherwise("ok").alias("status"), "page_limit", n_bytes.alias("n_bytes"), more.alias("truncated"), F.when(more, offset + F.col("page_limit")).alias("next_offset"))


def page_entries(entries: DataFrame, pages: DataFrame, by: list[str], offset: int = 0) -> DataFrame:
    """The rows of ``entries`` that lie on the page that ``byte_pages`` chose for their response."""
    chosen = pages.where("page_limit is not null").select(*by, "page_limit")
    return entries.join(chosen, by).where((F.col("place") >= offset) & (F.col("place") < offset + F.col("page_limit"))).drop("page_limit")


def importer_mismatches(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """``(importer, package, problem)`` where a manifest's constraint and a lock's specifier differ or one lacks the entry."""
    m = manifest.select("importer", "package", F.col("constraint_raw").alias("m"))
    k = lock.select("importer", "package", F.col("specifier").alias("k"))
    problem = F.when(F.col("k").isNull(), "not-locked").when(F.col("m").isNull(), "not-declared").when(F.col("m") != F.col("k"), "specifier-differs")
    return m.join(k, ["importer", "package"], "full_outer").select("importer", "package", problem.alias("problem")).where("problem is not null")


def pep440_conflicts(declarations: DataFrame) -> DataFrame:
    """``(key, n_declarations, conflict)`` of PyPI specifiers by key: true if exact versions differ or the bounds exclude each
    other or an exact version; null if a specifier doesn't parse. Wildcards, ``~=`` and ``!=`` don't exclude."""
    spec = r"^\s*(===|==|>=|<=|~=|!=|>|<)\s*([^\s]+)\s*\z"
    each = declarations.where("trim(constraint_raw) <> ''").select(*KEY, F.explode(F.split("constraint_raw", ",")).alias("s")).distinct()
    each = each.select(*KEY, F.regexp_extract("s", spec, 1).alias("op"), pep440_key(F.regexp_extract("s", spec, 2)).alias("k"), F.regexp_extract("s", spec, 2).endswith(".*").alias("wild"))
    bad = F.bool_or((F.col("op") == "") | (F.col("k").isNull() & ~F.col("wild")))
    of = lambda *ops: F.when(F.col("op").isin(*ops) & ~F.col("wild"), F.col("k"))
    low, high = F.max(F.struct(of(">=", ">").alias("k"), (F.col("op") == ">").alias("open"))), F.min(F.when(of("<=", "<").isNotNull(), F.struct(of("<=", "<").alias("k"), (F.col("op") != "<").alias("closed"))))
    sums = each.groupBy(KEY).agg(bad.alias("bad"), low.alias("low"), high.alias("high"), F.count_distinct(of("==", "===")).alias("n_exact"), F.min(of("==", "===")).alias("exact"))
    lo, hi, closed = F.col("low.k"), F.col("high.k"), F.col("high.closed")
    low_open = F.col("low.open")
    outside = F.coalesce((F.col("exact") < lo) | ((F.col("exact") == lo) & low_open), F.lit(False)) | F.coalesce((F.col("exact") > hi) | ((F.col("exact") == hi) & ~closed), F.lit(False))
    empty = F.coalesce((lo > hi) | ((lo == hi) & (low_open | ~closed)), F.lit(False))
    conflict = F.when(F.col("bad"), F.lit(None).cast("boolean")).otherwise((F.col("n_exact") > 1) | outside | empty)
    counts = declarations.groupBy(KEY).agg(F.count("*").alias("n_declarations"))
    return counts.join(sums.select(*KEY, conflict.alias("conflict"), F.lit(True).alias("seen")), KEY, "left").select(*KEY, "n_declarations", F.when(F.col("seen").isNull(), F.lit(False)).otherwise(F.col("conflict")).alias("conflict"))
