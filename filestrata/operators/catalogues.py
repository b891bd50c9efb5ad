"""Project-wide catalogues, kept as flat rows so that no entry gathers its whole list."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, paths, text
from . import symbols

KEY = ["project_id", "path"]


def config_entries(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(project_id, section, value): ``path:key`` per config suffix, variables under ``environment``."""
    path, content = F.col("path"), F.col("content")
    ext = paths.suffix(path)
    keys = (
        files.filter(ext.isin(fixed.KEYED_EXTENSIONS) & (content != ""))
        .select("project_id", "path", ext.alias("section"), F.explode(text.config_keys(content)).alias("key"))
        .select("project_id", "section", F.concat("path", F.lit(":"), "key").alias("value"))
    )
    variables = (
        symbols.values(facts, symbols.env_var_set())
        .select("project_id", F.lit("environment").alias("section"), "value").distinct()
    )
    return keys.unionByName(variables)


def test_map(facts: DataFrame) -> DataFrame:
    """Files with tests and their sorted names."""
    return facts.select(*KEY, symbols.deep_test_set().alias("tests")).filter(F.size("tests") > 0)


def string_postings(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(project_id, string, path): literals of Python files, short lines of the others.

    Strings are distinct per file before they leave it, so the rows need no shuffle.
    """
    literals = symbols.values(facts, symbols.string_set(), "string")
    lines = (
        files.filter((paths.suffix(F.col("path")) != ".py") & F.col("content").isNotNull())
        .select(*KEY, F.explode(text.short_lines(F.col("content"))).alias("string"))
    )
    return literals.unionByName(lines).select("project_id", "string", "path")


def string_index(postings: DataFrame) -> DataFrame:
    """One row per string: in how many files, and the first and last of them."""
    return postings.groupBy("project_id", "string").agg(
        F.count("*").alias("n_files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def ui_catalogue(facts: DataFrame) -> DataFrame:
    return symbols.values(facts, symbols.ui_widget_set(), "widget")


def cli_inventory(facts: DataFrame) -> DataFrame:
    return symbols.values(facts, symbols.cli_command_set(), "command")


def api_index(facts: DataFrame) -> DataFrame:
    columns = ["qualname", "signature", "doc"]
    functions = symbols.functions(facts, "deep").select(*KEY, *columns, F.lit("function").alias("kind"))
    classes = symbols.classes(facts, "deep").select(*KEY, *columns, F.lit("class").alias("kind"))
    return functions.unionByName(classes).withColumnRenamed("path", "module")


def api_modules(facts: DataFrame) -> DataFrame:
    """The index grouped by module: one row per file, which bounds its list."""
    entries = F.concat(
        F.transform("facts.functions", lambda f: F.concat(
            f["qualname"], F.lit(" :: "), symbols.signature(f, "deep"))),
        F.transform("facts.classes", lambda c: F.concat(
            c["qualname"], F.lit(" :: "), symbols.class_signature(c))))
    return facts.select("project_id", F.col("path").alias("module"), entries.alias("entries")).filter(
        F.size("entries") > 0)


def licence_findings(files: DataFrame) -> DataFrame:
    return files.filter(text.has_licence_header(F.col("content"))).select(
        *KEY, F.lit("Possible licence header").alias("note"))


def asset_manifest(files: DataFrame) -> DataFrame:
    """Files of a known MIME type that does not start with ``text``."""
    return (
        files.select(*KEY, paths.mime_type(F.col("path")).alias("mime"), "size_bytes")
        .filter(~F.col("mime").startswith("text"))
    )
