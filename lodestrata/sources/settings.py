"""Configuration, policy and record files as small, validated tables."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .manifests import _rows

#: Keys that a repository's configuration may have, and their types.
KEYS = {"exclude": list, "ignored-packages": list, "projects": list, "ecosystems": list, "import-mapping": dict, "tool-usage": list, "local-modules": list}
#: The fields of record files by kind; all must be there.
RECORDS = {
    "runtime": ["component", "version", "observed_at"],
    "component-matches": ["component", "candidate", "confidence"],
    "behavior": ["package", "version", "scripts"],
    "abi": ["library", "symbol", "version"],
}


def configuration(files: DataFrame) -> DataFrame:
    """``(path, key, name, value, problem)`` of configuration files: a ``[tool.x]`` table of pyproject.toml or a file of its own.

    An unknown key or a value of another type is a problem and gives no row; lists give a row for each entry, tables for each name.
    """

    def read(text: str) -> list[tuple]:
        doc = tomllib.loads(text)
        own = doc.get("tool", {}).get("lodestrata", {}) if "tool" in doc or "project" in doc else doc
        if unknown := sorted(set(own) - set(KEYS)):
            raise ValueError(f"unknown keys: {', '.join(unknown)}")
        if wrong := sorted(k for k, v in own.items() if not isinstance(v, KEYS[k])):
            raise ValueError(f"wrong types: {', '.join(wrong)}")
        out: list[tuple] = []
        for key, value in own.items():
            for name, entry in value.items() if isinstance(value, dict) else ((None, x) for x in value):
                out += [(key, k, str(v)) for k, v in entry.items()] if isinstance(entry, dict) else [(key, name, str(entry))]
        return out

    return _rows(files, "key string, name string, value string", ["key", "name", "value"], read)


def policy(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, risk)`` that fail and ``(path, place, risk, package, owner, reason, expires_at, problem)`` of exemptions in policy JSON.

    An exemption needs a risk, a package, an owner, a reason and an ISO date; what lacks one has ``problem`` policy.incomplete.
    """
    exemption = "risk string, package string, owner string, reason string, expires_at string"
    parsed = files.select("path", F.from_json("text", f"fail_on array<string>, exemptions array<struct<{exemption.replace(' string', ':string')}>>").alias("j"))
    fails = parsed.select("path", F.explode("j.fail_on").alias("risk")).distinct()
    rows = parsed.select("path", F.posexplode("j.exemptions").alias("place", "e")).select("path", "place", "e.*").withColumn("expires_at", F.expr("try_to_date(expires_at, 'yyyy-MM-dd')"))
    whole = F.col("expires_at").isNotNull()
    for c in ("risk", "package", "owner", "reason"):
        whole = whole & (F.coalesce(F.trim(c), F.lit("")) != "")
    return fails, rows.withColumn("problem", F.when(~whole, "policy.incomplete"))


def records(files: DataFrame, kind: str) -> DataFrame:
    """``(path, place, <fields>, problem)`` of record files of ``kind`` (a list, or an object with ``records``); a lacking field is ``record.incomplete``."""
    fields = RECORDS[kind]
    entry = "array<struct<" + ", ".join(f"{c}:string" for c in fields) + ">>"
    listed = F.when(F.col("text").rlike(r"^\s*\["), F.from_json("text", entry)).otherwise(F.from_json("text", f"records {entry}")["records"])
    rows = files.select("path", F.posexplode(listed).alias("place", "r")).select("path", "place", "r.*")
    whole = F.lit(True)
    for c in fields:
        whole = whole & F.col(c).isNotNull()
    return rows.withColumn("problem", F.when(~whole, "record.incomplete"))
