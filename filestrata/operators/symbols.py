"""Symbols, calls, environment reads and other views over parsed facts.

Every function takes the output of ``sources.pyfacts.python_facts``. The dialects are the
analysis engine's (``engine``), the deep report's (``deep``) and the capsule's (``capsule``).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed, paths, scores, text
from .joins import wide_join

KEY = ["project_id", "path"]


def _empty() -> Column:
    return F.array().cast("array<string>")


def _in_walk_order(items: str) -> Column:
    """Breadth-first order: the structs start with their depth and place in the source."""
    return F.array_sort(F.col(f"facts.{items}"))


def parse_status(facts: DataFrame) -> DataFrame:
    return facts.select(*KEY, F.col("facts.parse_ok").alias("parse_ok"),
                        F.coalesce(F.size("facts.imports"), F.lit(0)).alias("n_import_statements"),
                        F.coalesce(F.size("facts.classes"), F.lit(0)).alias("n_classes"),
                        F.coalesce(F.size("facts.functions"), F.lit(0)).alias("n_functions"))


# --- array columns per file ------------------------------------------------------------

def engine_import_list() -> Column:
    """One module per occurrence, breadth first; a relative import without module is ''."""
    return F.flatten(F.transform(
        _in_walk_order("imports"),
        lambda i: F.when(i["module"].isNull(), i["names"]).otherwise(F.array(i["module"]))))


def _dotted_names(imported: Column) -> Column:
    module = imported["module"]
    bare = module.isNull() | (module == "")
    return F.transform(imported["names"], lambda n: F.when(bare, n).otherwise(F.concat(module, F.lit("."), n)))


def deep_import_set() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform("facts.imports", _dotted_names))))


def _joined_args(args: Column) -> Column:
    return F.array_join(args, ", ")


def _slot(args: Column, *slots: str) -> Column:
    return F.filter(args, lambda a: a["slot"].isin(list(slots)))


def _shown(mark: str, note: str | None):
    def show(arg: Column) -> Column:
        plain = F.concat(F.lit(mark), arg["name"])
        if note is None:
            return plain
        return F.when(arg[note].isNull(), plain).otherwise(F.concat(plain, F.lit(": "), arg[note]))

    return show


def signature(function: Column, dialect: str) -> Column:
    """Signature text without defaults.

    ``engine`` leaves out positional-only and keyword-only arguments and marks async functions;
    ``capsule`` adds keyword-only ones without the bare ``*``; ``deep`` shows all with markers.
    """
    args = function["args"]
    noted = {"engine": "note", "capsule": "note", "deep": "note_name"}[dialect]
    plain = F.transform(_slot(args, "plain"), _shown("", noted))
    star = F.transform(_slot(args, "vararg"), _shown("*", noted if dialect == "deep" else None))
    kwonly = F.transform(_slot(args, "kwonly"), _shown("", noted))
    rest = F.transform(_slot(args, "kwarg"), _shown("**", noted if dialect == "deep" else None))
    if dialect == "engine":
        pieces = F.concat(plain, star, rest)
    elif dialect == "capsule":
        pieces = F.concat(plain, star, kwonly, rest)
    else:
        posonly = F.transform(_slot(args, "posonly"), _shown("", noted))
        slash = F.when(F.size(posonly) > 0, F.array(F.lit("/"))).otherwise(_empty())
        bare = F.when((F.size(star) == 0) & (F.size(kwonly) > 0), F.array(F.lit("*"))).otherwise(_empty())
        pieces = F.concat(posonly, slash, plain, star, bare, kwonly, rest)
    shown = F.concat(function["name"], F.lit("("), _joined_args(pieces), F.lit(")"))
    if dialect == "engine":
        return F.concat(F.when(function["is_async"], "async ").otherwise(""), shown)
    return shown


def class_signature(cls: Column) -> Column:
    return F.concat(F.lit("class "), cls["qualname"], F.lit("("), _joined_args(cls["base_names"]), F.lit(")"))


def doc_line(doc: Column, dialect: str) -> Column:
    """``engine``: up to the first line feed; ``deep``: the first non-blank line, stripped."""
    if dialect == "engine":
        return F.when(doc != "", F.substring_index(doc, "\n", 1))
    return text.first_line(doc)


def call_target_set() -> Column:
    targets = F.transform("facts.calls", lambda c: c["target"])
    return F.array_sort(F.array_distinct(F.filter(targets, lambda t: t != "")))


def _ends_with_any(value: Column, endings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.endswith(e) for e in endings])


def cli_command_set() -> Column:
    return F.filter(call_target_set(), lambda t: t.endswith("ArgumentParser"))


def ui_widget_set() -> Column:
    return F.filter(call_target_set(), lambda t: _ends_with_any(t, fixed.UI_CALL_SUFFIXES))


def env_var_set() -> Column:
    """Keys read through getenv, environ.get, environ[...] and string keywords named ``*env*``."""
    reads = F.transform(
        F.filter("facts.calls", lambda c: _ends_with_any(c["target"], ["getenv", "environ.get"])),
        lambda c: c["first_arg"])
    keywords = F.transform(
        F.filter(F.flatten(F.transform("facts.calls", lambda c: c["keywords"])),
                 lambda k: F.contains(F.lower(k["name"]), F.lit("env"))),
        lambda k: k["value"])
    indexed = F.transform(
        F.filter("facts.subscripts", lambda s: s["target"].isin("os.environ", "environ")),
        lambda s: s["key"])
    return F.array_sort(F.array_distinct(F.filter(
        F.concat(reads, keywords, indexed), lambda key: key != "")))


def entrypoint_set() -> Column:
    module = F.when(F.col("facts.main_guard"), F.array(F.concat(F.col("path"), F.lit("::<module>"))))
    owners = F.transform(F.filter("facts.functions", lambda f: f["main_guard"]), lambda f: f["qualname"])
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(module, _empty()), owners)))


def engine_test_list() -> Column:
    in_test_path = F.contains(F.lower("path"), F.lit("test"))
    tests = F.filter(_in_walk_order("functions"), lambda f: f["name"].startswith("test_") | in_test_path)
    return F.transform(tests, lambda f: F.concat(F.col("path"), F.lit("::"), f["name"]))


def deep_test_set() -> Column:
    """The qualified name decides, so a test method only counts under a ``/tests/`` folder."""
    in_tests = F.contains("path", F.lit("/tests/"))
    functions = F.transform(
        F.filter("facts.functions", lambda f: f["qualname"].startswith("test_") | in_tests),
        lambda f: f["qualname"])
    cases = F.transform(
        F.filter("facts.classes", lambda c: F.exists(
            c["base_names"], lambda b: F.contains(b, F.lit("TestCase")))),
        lambda c: c["qualname"])
    return F.array_sort(F.array_distinct(F.concat(functions, cases)))


def string_set(limit: int = 160) -> Column:
    """Stripped one-line literals of up to 200 characters, then those shorter than ``limit``."""
    stripped = F.transform("facts.strings", text.strip)
    return F.array_sort(F.array_distinct(F.filter(stripped, lambda s: (
        F.length(s).between(1, min(200, limit - 1)) & ~F.contains(s, F.lit("\n"))))))


def ui_base_list(windows: bool) -> Column:
    bases = F.flatten(F.transform(_in_walk_order("classes"), lambda c: c["bases"]))
    return F.filter(bases, lambda b: b.isin(fixed.UI_BASES)
                    & (F.lower(b).rlike("window|top") == F.lit(windows)))


def engine_complexity() -> Column:
    """One per function plus its branches; a nested function counts again in its parents."""
    return F.aggregate("facts.functions", F.lit(0), lambda acc, f: acc + 1 + f["branches"])


def deep_complexity() -> Column:
    return F.when(F.col("facts.parse_ok"), F.col("facts.decisions") + 1)


def outline(limit: int) -> Column:
    """Top-level imports and symbols and all calls, each cut to ``limit``."""
    imports = F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.filter("facts.imports", lambda i: i["top"]), _dotted_names))))
    functions = F.transform(
        F.filter("facts.functions", lambda f: f["top"]),
        lambda f: F.struct(
            f["seen"].alias("seen"), F.when(f["is_async"], "async").otherwise("func").alias("kind"),
            signature(f, "capsule").alias("name"), F.lit(None).cast("array<string>").alias("methods")))
    classes = F.transform(
        F.filter("facts.classes", lambda c: c["top"]),
        lambda c: F.struct(c["seen"].alias("seen"), F.lit("class").alias("kind"),
                           c["name"].alias("name"), c["sync_methods"].alias("methods")))
    calls = F.filter(F.transform("facts.calls", lambda c: c["dotted"]), lambda d: d != "")
    return F.struct(
        F.slice(imports, 1, limit).alias("imports"),
        F.slice(F.array_sort(F.concat(functions, classes)), 1, limit).alias("symbols"),
        F.slice(calls, 1, limit).alias("calls"),
    )


# --- exploded tables -------------------------------------------------------------------

def imports(facts: DataFrame, dialect: str) -> DataFrame:
    listed = engine_import_list() if dialect == "engine" else deep_import_set()
    return (
        facts.select(*KEY, F.posexplode(listed).alias("ord", "module"))
        .withColumn("namespace", F.substring_index("module", ".", 1))
    )


def classes(facts: DataFrame, dialect: str) -> DataFrame:
    engine = dialect == "engine"
    c = F.col("c")
    return facts.select(*KEY, F.explode("facts.classes").alias("c")).select(
        *KEY, (c["name"] if engine else c["qualname"]).alias("qualname"),
        class_signature(c).alias("signature"), (c["bases"] if engine else c["base_names"]).alias("bases"),
        c["methods"].alias("methods"), c["decorators"].alias("decorators"),
        doc_line(c["doc"], dialect).alias("doc"), c["lineno"].alias("lineno"))


def functions(facts: DataFrame, dialect: str) -> DataFrame:
    f = F.col("f")
    return facts.select(*KEY, F.explode("facts.functions").alias("f")).select(
        *KEY, (f["name"] if dialect == "engine" else f["qualname"]).alias("qualname"),
        signature(f, dialect).alias("signature"), f["returns"].alias("returns"),
        f["is_async"].alias("is_async"), f["decorators"].alias("decorators"),
        doc_line(f["doc"], "engine" if dialect == "engine" else "deep").alias("doc"),
        f["lineno"].alias("lineno"))


def values(facts: DataFrame, column: Column, name: str = "value") -> DataFrame:
    """One row per element of a set-valued column."""
    return facts.select(*KEY, F.explode(column).alias(name))


def with_empty_lists(rows: DataFrame) -> DataFrame:
    """Empty arrays in place of NULL ones, as files without a parse have them."""
    return rows.withColumns({
        f.name: F.coalesce(f.name, F.array().cast(f.dataType))
        for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType)
    })


def engine_analysis(files: DataFrame, facts: DataFrame) -> DataFrame:
    """The analysis row of every file; fields that need a parse are empty without one."""
    parsed = facts.filter("facts.parse_ok").select(
        *KEY, engine_import_list().alias("imports"),
        F.transform(_in_walk_order("classes"), lambda c: F.struct(
            c["name"].alias("name"), c["bases"].alias("bases"), c["methods"].alias("methods"),
            doc_line(c["doc"], "engine").alias("doc1"), c["lineno"].alias("lineno"))).alias("classes"),
        F.transform(_in_walk_order("functions"), lambda f: F.struct(
            f["name"].alias("name"), signature(f, "engine").alias("signature"),
            f["returns"].alias("returns"), doc_line(f["doc"], "engine").alias("doc1"),
            f["lineno"].alias("lineno"))).alias("functions"),
        engine_test_list().alias("tests"), ui_base_list(True).alias("windows"),
        ui_base_list(False).alias("widgets"), engine_complexity().alias("cyclomatic"), "todo_count")
    rows = files.select(*KEY, "size_bytes", F.coalesce("lines", F.lit(0)).alias("sloc"),
                        paths.language(F.col("path"), "engine").alias("language"))
    path = F.col("path")
    joined = with_empty_lists(wide_join(rows, parsed, KEY))
    return joined.withColumns({
        "cyclomatic": F.coalesce("cyclomatic", F.lit(0)),
        "todo_count": F.coalesce("todo_count", F.lit(0)),
    }).withColumns({
        "hotspot": scores.hotspot(F.col("cyclomatic"), F.col("todo_count")),
        "responsibility": paths.role_from_symbols(
            path, *(F.size(c) for c in ("windows", "classes", "functions", "imports"))),
    })
