"""File cards: one wide row per file, and the compact rows cut from it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, paths, scores, text
from . import catalogues, graph, symbols
from .joins import wide_join

KEY = ["project_id", "path"]

# The optional parts of a deep report; a part left out is never built.
PARTS = frozenset("""
functions classes api_index dependency_map call_graph cli_inventory config_schema ui_catalogue tests
string_catalogue binary_manifest complexity_panel
""".split())


def _symbol_rows(items: str, signature) -> Column:
    return F.transform(f"facts.{items}", lambda s: F.struct(
        s["qualname"].alias("name"), signature(s).alias("signature"),
        symbols.doc_line(s["doc"], "deep").alias("doc"), s["decorators"].alias("decorators"),
        s["lineno"].alias("lineno")))


def _parsed_columns(parts: frozenset[str]) -> list[Column]:
    columns = [
        symbols.doc_line(F.col("facts.doc"), "deep").alias("docstring"),
        F.col("headings"),
        symbols.deep_import_set().alias("imports"),
        symbols.call_target_set().alias("call_targets"),
        symbols.env_var_set().alias("env_vars"),
        symbols.entrypoint_set().alias("entrypoints"),
    ]
    optional = {
        "functions": lambda: _symbol_rows("functions", lambda f: symbols.signature(f, "deep")).alias("functions"),
        "classes": lambda: _symbol_rows("classes", symbols.class_signature).alias("classes"),
        "cli_inventory": lambda: symbols.cli_command_set().alias("cli_commands"),
        "ui_catalogue": lambda: symbols.ui_widget_set().alias("ui_widgets"),
        "tests": lambda: symbols.deep_test_set().alias("tests"),
        "string_catalogue": lambda: symbols.string_set().alias("literals"),
        "complexity_panel": lambda: symbols.deep_complexity().alias("cyclomatic_complexity"),
    }
    return columns + [build() for part, build in optional.items() if part in parts]


def file_cards(files: DataFrame, facts: DataFrame, parts: frozenset[str] = PARTS) -> DataFrame:
    """One row per file, joined from its text, its facts and the project's module set.

    Parsed columns are NULL for files that are not Python or do not parse. Every file that is not media is read as text, whatever its
    suffix; bytes that are no text become replacement characters.
    """
    path, content = F.col("path"), F.col("content")
    if "content_bytes" in files.columns:
        content = F.coalesce(content, text.unify_newlines(F.make_valid_utf8(F.col("content_bytes").cast("string"))))
    seen = F.when(paths.has_deep_text(path), content)
    parsed = facts.filter("facts.parse_ok").select(*KEY, F.lit(True).alias("parse_ok"), *_parsed_columns(parts))
    cards = files.select(
        *KEY, "size_bytes", "mtime", paths.language(path, "deep").alias("language"),
        text.sloc(seen).alias("sloc"), text.word_markers(seen).alias("todo_count"),
        paths.role_from_content(path, seen).alias("responsibility"),
        F.when(text.has_licence_header(seen), "Possible licence header").alias("licence"),
        (paths.suffix(path) == ".py").alias("_python"),
        *_optional_text_columns(path, seen, parts),
    )
    cards = wide_join(cards, parsed, KEY)
    unparsed = F.col("_python") & F.col("parse_ok").isNull() & F.col("responsibility").isNull()
    cards = cards.withColumn(
        "responsibility", F.when(unparsed, "Unparseable Python file").otherwise(F.col("responsibility")))
    if "string_catalogue" in parts:
        cards = cards.withColumn("strings", F.when(F.col("_python"), F.col("literals"))
                                 .otherwise(F.col("lines_as_strings"))).drop("literals", "lines_as_strings")
    complexity = F.col("cyclomatic_complexity") if "complexity_panel" in parts else F.lit(None).cast("int")
    score = scores.risk_score(complexity, F.col("sloc"), F.col("todo_count"))
    cards = cards.withColumns({"risk_score": score, "complexity": scores.risk_band(score)})
    return symbols.with_empty_lists(wide_join(cards, _sides(files, facts), KEY)).drop("_python")


def _optional_text_columns(path: Column, seen: Column, parts: frozenset[str]) -> list[Column]:
    columns = []
    if "config_schema" in parts:
        keyed = paths.suffix(path).isin(fixed.KEYED_EXTENSIONS)
        columns.append(F.when(keyed, text.config_keys(seen)).alias("config_keys"))
    if "string_catalogue" in parts:
        columns.append(F.array_sort(text.short_lines(seen)).alias("lines_as_strings"))
    if "binary_manifest" in parts:
        mime = paths.mime_type(path)
        columns.append(F.when(~mime.startswith("text"), mime).alias("asset_mime"))
    return columns


def _sides(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Sorted internal and external namespaces of each file; a file's imports bound its row."""
    found = graph.classified_imports(symbols.imports(facts, "deep"), files)
    side = {
        "internal_imports": F.when(F.col("internal"), F.col("namespace")),
        "external_imports": F.when(~F.col("internal"), F.col("namespace")),
    }
    return found.groupBy(*KEY).agg(
        *(F.array_sort(F.collect_set(column)).alias(name) for name, column in side.items()))


def bundle_cards(cards: DataFrame) -> DataFrame:
    """The compact card of every file."""
    band = F.when(F.col("risk_score").isNotNull(), F.col("complexity"))
    return cards.select(
        *KEY, paths.path_hash(F.col("path")).alias("hash"), "language", "sloc", "todo_count",
        "imports",
        band.alias("complexity_band"), "cyclomatic_complexity",
        F.col("functions.signature").alias("functions"), F.col("classes.signature").alias("classes"),
        F.col("docstring").alias("doc"))


def cut_lists(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first entries of each list column, with a flag where more follow."""
    return rows.withColumns({
        **{name: F.slice(name, 1, n) for name, n in limits.items()},
        **{f"{name}_cut": F.size(name) > n for name, n in limits.items()},
    })


def overview(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Files, indexed symbols and assets per project."""
    n_files = files.groupBy("project_id").agg(F.count("*").alias("files_analysed"))
    n_api = facts.groupBy("project_id").agg(F.sum(
        F.coalesce(F.size("facts.functions") + F.size("facts.classes"), F.lit(0))).alias("api_items"))
    n_assets = catalogues.asset_manifest(files).groupBy("project_id").agg(F.count("*").alias("binary_assets"))
    return (
        n_files.join(n_api, "project_id", "left").join(n_assets, "project_id", "left")
        .na.fill(0, ["api_items", "binary_assets"])
    )
