"""Severity assertions and identifiers of advisories, kept as they were reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.checks import CVE, identifier_kind

#: Scores that a group of advisories keeps; what goes over is counted.
MOST_SCORES = 4096


def applicability(entries: DataFrame) -> DataFrame:
    """``entries(advisory, field, package, ecosystem, type, score, match)`` with ``applicability`` and ``valid``.

    ``field`` is ``severity`` for a record's own scores and ``affected`` for those of one of its packages; ``match`` tells whether that
    package and version are the ones asked for. A record that has both kinds contradicts the format: nothing of it is certain.
    Scores without a type and a text are not valid; they are kept, and make the advisory's severity incomplete.
    """
    both = entries.groupBy("advisory").agg((F.bool_or(F.col("field") == "severity") & F.bool_or(F.col("field") == "affected")).alias("conflict"))
    valid = F.coalesce((F.col("type") != "") & (F.col("score") != ""), F.lit(False))
    state = F.when(F.col("conflict"), "unknown").when(F.col("field") == "severity", "applicable").when(F.col("match").isNull(), "unknown").when(F.col("match"), "applicable").otherwise("not-applicable")
    return entries.join(both, "advisory").select(*entries.columns, state.alias("applicability"), valid.alias("valid"))


def group_scores(scores: DataFrame, most: int = MOST_SCORES) -> DataFrame:
    """``(root, n_scores, n_kept, n_omitted, status)`` of alias groups from ``scores(root, advisory, type, score, applicability, valid)``.

    Equal (type, score) pairs of a group count once. The ``most`` least ones are kept; status is incomplete where some are
    omitted or not valid, reported where any are kept, else not-provided.
    """
    own = scores.where("applicability = 'applicable' and valid").select("root", "type", "score").distinct()
    placed = own.withColumn("place", F.row_number().over(W.partitionBy("root").orderBy("type", "score")))
    kept = placed.groupBy("root").agg(F.count("*").alias("n_scores"), F.count_if(F.col("place") <= most).alias("n_kept"))
    bad = scores.groupBy("root").agg(F.bool_or(~F.col("valid") | (F.col("applicability") == "unknown")).alias("bad"))
    rows = bad.join(kept, "root", "left").select("root", "bad", F.coalesce("n_scores", F.lit(0)).alias("n_scores"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
    status = F.when(F.col("bad") | (F.col("n_kept") < F.col("n_scores")), "incomplete").when(F.col("n_kept") > 0, "reported").otherwise("not-provided")
    return rows.select("root", "n_scores", "n_kept", (F.col("n_scores") - F.col("n_kept")).alias("n_omitted"), status.alias("status"))


def identifiers(advisories: DataFrame) -> DataFrame:
    """Distinct ``(advisory, type, id, field)`` of CVE and CWE identifiers in ``advisories(advisory, aliases, related, cwes)``, by where they stand."""
    empty = F.array().cast("array<string>")

    def marked(field: str, ids: Column) -> Column:
        return F.transform(F.coalesce(ids, empty), lambda x: F.struct(F.lit(field).alias("field"), x.alias("id")))

    parts = [marked("id", F.array("advisory")), marked("aliases", F.col("aliases")), marked("related", F.col("related")), marked("cwe_ids", F.col("cwes"))]
    rows = advisories.select("advisory", F.explode(F.concat(*parts)).alias("r")).select("advisory", identifier_kind(F.col("r.id")).alias("type"), "r.id", "r.field")
    return rows.where("type is not null").distinct()


def associations(observations: DataFrame) -> DataFrame:
    """``(cve, n_observations, n_advisories, first_issue)`` of ``observations(observation, issue, advisory, id, field)``: CVEs that stand as an id or alias."""
    own = observations.where(F.col("id").rlike(CVE) & F.col("field").isin("id", "aliases"))
    return own.groupBy(F.col("id").alias("cve")).agg(F.count_distinct("observation").alias("n_observations"), F.count_distinct("advisory").alias("n_advisories"), F.min("issue").alias("first_issue"))


def feed_duplicates(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, n_rows, conflicting)`` of keys that a feed lists more than once: equal rows are counted, differing ones conflict."""
    print_of = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), (F.count_distinct(print_of) > 1).alias("conflicting")).where("n_rows > 1")
