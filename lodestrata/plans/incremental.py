"""A scan brought up to date: what a change makes stale is found by joins, and only that is scanned again.

A project is stale if a file of it was added, edited or removed, if a project appeared or vanished at it, below it or above
it, if one of its requirements files includes a changed file through any number of files, or if the configured name of a
module that it uses changed. All other projects keep their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import cut, merged
from lodestrata.operators.compare import input_changes
from lodestrata.operators.lookup import longest_prefix
from lodestrata.sources.files import folder

from .scan import _inclusions, _projects, scan


def file_state(files: DataFrame) -> DataFrame:
    """``(path, digest)`` of ``files(path, text)``."""
    return files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def _owners(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """``(path, project_id)``: the nearest project of each ecosystem at or above each path's folder."""
    rows, out = paths.select("path", folder(F.col("path")).alias("folder")), None
    for eco in ("npm", "pypi", "go", "cargo"):
        roots = projects.where(F.col("ecosystem") == eco).select(F.col("project_id").alias("root"))
        own = longest_prefix(rows, "folder", roots, "root").where("root is not null").select("path", F.col("root").alias("project_id"))
        out = own if out is None else out.union(own)
    return out.distinct()


def stale_projects(old: dict[str, DataFrame], changes: DataFrame, projects: DataFrame, inclusions: DataFrame, remapped: DataFrame) -> DataFrame:
    """``(project_id)`` of what the changed paths, the new ``projects`` and the remapped modules make stale."""
    before, paths = old["projects"], changes.select("path")
    key = ["project_id", "ecosystem"]
    moved = projects.select(key).exceptAll(before.select(key)).union(before.select(key).exceptAll(projects.select(key))).select("project_id").distinct()
    # a place just above a new or lost project: whoever owns that gives or takes files
    above = moved.where("project_id <> '.'").select(F.col("project_id").alias("path"))
    touched = paths.union(above)
    reached = old["inclusions"].select("root", "path").union(inclusions.select("root", "path")).join(paths, "path", "left_semi").select(folder(F.col("root")).alias("project_id"))
    users = old["usages"].where("ecosystem = 'pypi'").select("project_id", F.lower(F.substring_index("reference", ".", 1)).alias("module")).join(remapped, "module", "left_semi").select("project_id")
    return moved.union(_owners(touched, before).select("project_id")).union(_owners(touched, projects).select("project_id")).union(reached).union(users).distinct()


def update(old: dict[str, DataFrame], old_state: DataFrame, files: DataFrame, old_mapping: DataFrame | None = None, mapping: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The relations of ``scan(files, mapping)`` and the new file state, from those of an earlier scan: equal to scanning all again.

    Unchanged projects' files are hashed but not parsed (includes of requirements files are read anew: they say who depends on whom). Joins are merges, as in ``scan``.
    """
    kept_rows = lambda df: merged(cut(df))
    state = kept_rows(file_state(files))
    changes = kept_rows(input_changes(old_state, state))
    projects, inclusions = kept_rows(_projects(files)), kept_rows(_inclusions(files))
    none = files.sparkSession.createDataFrame([], "module string, package string")
    names = lambda m: none if m is None else m.select(F.lower("reference").alias("module"), "package").distinct()
    remapped = names(mapping).exceptAll(names(old_mapping)).union(names(old_mapping).exceptAll(names(mapping))).select("module").distinct()
    stale = kept_rows(stale_projects(old, changes, projects, inclusions, remapped))
    paths = files.select("path")
    mine = _owners(paths, projects).union(_owners(paths, old["projects"])).join(stale, "project_id", "left_semi").select("path")
    included = inclusions.join(stale, folder(F.col("root")) == stale["project_id"], "left_semi").select("path")
    again = kept_rows(mine.union(included).union(changes.select("path")).distinct())
    fresh = scan(files.join(again, "path", "left_semi"), mapping, projects)
    out = {"projects": projects, "inclusions": inclusions}
    for name, rows in old.items():
        if name in out:
            continue
        kept = rows.join(stale, "project_id", "left_anti").join(projects.select("project_id").distinct(), "project_id", "left_semi")
        new = fresh[name].join(stale, "project_id", "left_semi")
        if name == "diagnostics":  # files outside all projects have a row without one
            kept = kept.unionByName(rows.where("project_id is null").join(again, "path", "left_anti").join(paths, "path", "left_semi").select(rows.columns))
            new = new.unionByName(fresh[name].where("project_id is null"))
        out[name] = kept.select(rows.columns).unionByName(new.select(rows.columns))
    return out, state
