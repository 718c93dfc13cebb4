"""Joins that Spark has no operator for: longest prefix, unique candidate, first match, versions in ranges, typo pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.lineage import merged


def prefixes(path: Column, separator: str = "/") -> Column:
    """A path and its ancestors, ``.`` (the root) included."""
    parts = F.split(path, f"[{separator}]")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator)))


def longest_prefix(rows: DataFrame, path: str, owners: DataFrame, root: str, separator: str = "/") -> DataFrame:
    """``rows`` with the columns of the owner whose ``root`` is the longest whole-segment prefix of ``path``; none: nulls.

    Paths explode to their prefixes, an equi join finds owners, and a maximum keeps the longest: no range join.
    Distinct paths are looked up once. The second join is a merge: rows and owners found may both be many for their estimated size.
    """
    paths = rows.select(path).where(F.col(path).isNotNull()).distinct()
    own = owners.withColumnRenamed(root, "root_")
    hits = paths.select(path, F.explode(prefixes(F.col(path), separator)).alias("root_")).join(own, "root_")
    best = hits.groupBy(path).agg(F.max_by(F.struct("root_", *[c for c in own.columns if c != "root_"]), F.when(F.col("root_") == ".", 0).otherwise(F.length("root_"))).alias("o"))
    return rows.join(merged(best), path, "left").select(rows["*"], F.col("o.root_").alias(root), *[F.col(f"o.{c}") for c in own.columns if c != "root_"])


def unique_match(left: DataFrame, right: DataFrame, on: Column, left_id: list[str], right_id: str) -> DataFrame:
    """``left`` with ``n_candidates`` and ``right_id`` where exactly one row of ``right`` matches: three outcomes, none guessed."""
    hits = left.join(right, on).groupBy(left_id).agg(F.count("*").alias("n_candidates"), F.min(right_id).alias("bound"))
    return left.join(hits, left_id, "left").select(left["*"], F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.when(F.col("n_candidates") == 1, F.col("bound")).alias(right_id))


def first_match(rows: DataFrame, rules: DataFrame, on: Column, row_id: list[str], rule_order: str) -> DataFrame:
    """The first rule (by ``rule_order``) that matches each row; rows without one are left out. ``rules`` is a hand-written list."""
    hits = rows.join(rules, on)
    return hits.groupBy(row_id).agg(F.min_by(F.struct(*rules.columns), rule_order).alias("r")).select(*row_id, "r.*")


def first_rule(rules: list[tuple[int, Column]]) -> Column:
    """The number of the first rule (in list order) whose condition holds in a row, else null: one expression, no join."""
    out = None
    for number, condition in rules:
        out = F.when(condition, number) if out is None else out.when(condition, number)
    return out if out is not None else F.lit(None).cast("int")


def in_ranges(rows: DataFrame, ranges: DataFrame, key: list[str], value: str, how: str = "inner") -> DataFrame:
    """Rows with the ranges of equal key that hold ``value``: ``lo, lo_inclusive, hi, hi_inclusive``, null bounds open.

    The key keeps it a hash join; the interval is its residual condition.
    """
    r, v = ranges.alias("r"), F.col(value)
    low = F.col("lo").isNull() | (v > F.col("lo")) | (F.col("lo_inclusive") & (v == F.col("lo")))
    high = F.col("hi").isNull() | (v < F.col("hi")) | (F.col("hi_inclusive") & (v == F.col("hi")))
    same = [rows[k] == F.col(f"r.{k}") for k in key]
    out = rows.join(r, [*same, low, high], how)
    return out if how in ("left_semi", "left_anti") else out.select(rows["*"], *[F.col(f"r.{c}") for c in ranges.columns if c not in key])


def typo_pairs(names: DataFrame, known: DataFrame) -> DataFrame:
    """``(name, near, mechanism)``: pairs of different names one edit apart, from ``names(name)`` and ``known(near)``.

    Pairs come from equi joins on single-deletion variants (a name, or it without one letter), which any two
    names within one substitution, insertion, deletion or swap share; the pair is then verified.
    """
    def variants(df: DataFrame, col: str) -> DataFrame:
        c = F.col(col)
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return df.where(F.length(c) > 0).select(col, F.explode(F.array_distinct(F.concat(F.array(c), cuts))).alias("variant")).distinct()

    pairs = variants(names.select("name").distinct(), "name").join(variants(known.select("near").distinct(), "near"), "variant").select("name", "near").distinct().where("name <> near")
    la, lb = F.length("name"), F.length("near")
    distance = F.levenshtein("name", "near")
    at = F.expr("filter(sequence(1, length(name)), i -> substring(name, i, 1) <> substring(near, i, 1))")
    swap = (la == lb) & (F.size(at) == 2) & (at[1] == at[0] + 1) & (F.expr("substring(name, 1, 1)").isNotNull()) & (F.substring("name", at[0], F.lit(1)) == F.substring("near", at[1], F.lit(1))) & (F.substring("name", at[1], F.lit(1)) == F.substring("near", at[0], F.lit(1)))
    kind = F.when((distance == 1) & (la == lb), "substitution").when((distance == 1) & (la < lb), "deletion").when(distance == 1, "insertion").when(swap, "transposition")
    return pairs.select("name", "near", kind.alias("mechanism")).where("mechanism is not null")
