"""Import classification and the project's import graph."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..session import frozen
from . import symbols
from .joins import lookup_join, wide_join

KEY = ["project_id", "path"]


def internal_modules(files: DataFrame) -> DataFrame:
    """Names a project can import from itself: first directories and stems of its ``.py`` files."""
    path = F.col("path")
    names = F.array_compact(F.array(paths.top_component(path), paths.stem(path)))
    return (
        files.filter(paths.name(path).rlike(r"(?s).\.py\z"))
        .select("project_id", F.explode(names).alias("namespace")).distinct()
    )


def classified_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Each import with ``internal`` set from the project's own modules.

    The distinct namespaces are classified first, each key once, so that a namespace half the
    project imports is one row there; the answer then goes back to the imports as a lookup.
    """
    known = internal_modules(files).withColumn("internal", F.lit(True))
    answers = frozen(
        wide_join(imports.select("project_id", "namespace").distinct(), known, ["project_id", "namespace"])
        .select("project_id", "namespace", F.coalesce("internal", F.lit(False)).alias("internal"))
    )
    return lookup_join(imports, answers, ["project_id", "namespace"], KEY)


def resolved_edges(imports: DataFrame, files: DataFrame, dialect: str) -> DataFrame:
    """Imports whose target is a module of the project, as (project_id, source, target).

    ``resolved`` compares whole module ids. ``strict`` is the analysis engine's form: it takes
    only modules spelt with a leading dot, which a syntax tree never holds, and so is empty.
    """
    if dialect == "strict":
        imports = imports.filter(F.col("module").startswith("."))
    modules = (
        files.select("project_id", paths.module_id(F.col("path")).alias("module"))
        .distinct().withColumn("_known", F.lit(True))
    )
    wanted = imports.select("project_id", "module").distinct()
    targets = frozen(wide_join(wanted, modules, ["project_id", "module"], "inner"))
    edges = lookup_join(imports.filter("module <> ''"), targets, ["project_id", "module"], KEY, "inner")
    return edges.select("project_id", paths.module_id(F.col("path")).alias("source"),
                        F.col("module").alias("target"))


def dependency_map(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Every file with its sorted distinct top namespaces; files that import nothing stay."""
    namespaces = F.array_sort(F.array_distinct(F.transform(
        symbols.deep_import_set(), lambda m: F.substring_index(m, ".", 1))))
    return _per_file(files, facts, namespaces, "namespaces")


def call_graph(files: DataFrame, facts: DataFrame) -> DataFrame:
    return _per_file(files, facts, symbols.call_target_set(), "calls")


def _per_file(files: DataFrame, facts: DataFrame, column: F.Column, name: str) -> DataFrame:
    found = facts.filter("facts.parse_ok").select(*KEY, column.alias(name))
    return wide_join(files.select(*KEY), found, KEY).withColumn(
        name, F.coalesce(name, F.array().cast("array<string>")))


def import_nodes(files: DataFrame, imports: DataFrame) -> DataFrame:
    internal = files.select(
        "project_id", paths.module_id(F.col("path")).alias("id"), paths.name(F.col("path")).alias("label"),
        F.lit("internal_module").alias("type"))
    external = imports.filter("module <> ''").select("project_id", F.col("module").alias("id")).distinct()
    return internal.unionByName(external.select(
        "project_id", "id", F.col("id").alias("label"), F.lit("external_module").alias("type")))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Internal edges of the strict dialect and one external edge per import occurrence."""
    internal = resolved_edges(imports, files, "strict").withColumn("type", F.lit("internal_import"))
    external = imports.filter((F.col("module") != "") & ~F.col("module").startswith(".")).select(
        "project_id", paths.module_id(F.col("path")).alias("source"), F.col("module").alias("target"),
        F.lit("external_import").alias("type"))
    return internal.unionByName(external)
