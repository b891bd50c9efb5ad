"""Registered queries over parsed sources (A, J2, J3, G9-G21, G25, W2 rows).

The sources are made from ``part``, so the check SQL states the expected answer from the row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths, text
from ..operators import cards, catalogues, graph, symbols
from ..session import frozen
from ..sources.pyfacts import python_facts
from ..sources.tables import document_files, part_sources
from .columns import KEY
from .sql import FILES, LINES, SUFFIX, WS, nonblank_lines

QUERIES = {}
ORACLES = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_facts(part_sources(spark, sf_dir))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = part_sources(spark, sf_dir)
    return files, frozen(python_facts(files))


def _all_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and sources together: every kind of file in one table."""
    files = document_files(spark, sf_dir).unionByName(part_sources(spark, sf_dir))
    return files, frozen(python_facts(files))


def _join(column, name: str):
    return F.array_join(column, "|").alias(name)


PARTS = """parts AS (
  SELECT 'proj' || p_size % 5 AS project_id, 'pkg/m' || p_partkey || '.py' AS path, p_partkey AS k,
    p_size % 4 AS e, p_name, p_type, p_brand, p_partkey % 11 <> 5 AS ok FROM part
)"""
WITH = f"WITH {PARTS}"

_add(
    "a1_parse",
    lambda s, d: symbols.parse_status(_facts(s, d)),
    f"""{WITH} SELECT project_id, path, ok AS parse_ok, CASE WHEN ok THEN 4 ELSE 0 END AS n_import_statements,
        CASE WHEN ok THEN 1 ELSE 0 END AS n_classes, CASE WHEN ok THEN 4 ELSE 0 END AS n_functions FROM parts""",
)
_add(
    "a2_engine_imports",
    lambda s, d: symbols.imports(_facts(s, d), "engine"),
    f"""{WITH} SELECT project_id, path, CAST(o AS INTEGER) AS ord, m AS module, string_split(m, '.')[1] AS namespace FROM (
          SELECT project_id, path, unnest(range(4)) AS o,
            unnest(['os', 'lib' || k % 7 || '.sub', 'pkg', '']) AS m FROM parts WHERE ok)""",
)
_DEEP_IMPORTS = "['helper' || k % 3, 'lib' || k % 7 || '.sub', 'os', 'pkg.m' || k // 2]"
_add(
    "a2_deep_imports",
    lambda s, d: symbols.imports(_facts(s, d), "deep"),
    f"""{WITH} SELECT project_id, path, CAST(o AS INTEGER) AS ord, m AS module, string_split(m, '.')[1] AS namespace FROM (
          SELECT project_id, path, unnest(range(4)) AS o, unnest({_DEEP_IMPORTS}) AS m FROM parts WHERE ok)""",
)
_add(
    "a3_classes",
    lambda s, d: symbols.classes(_facts(s, d), "deep").select(
        *KEY, "qualname", "signature", _join(F.col("bases"), "bases"), _join(F.col("methods"), "methods"),
        "doc", "lineno"),
    f"""{WITH} SELECT project_id, path, 'C' || k AS qualname,
        'class C' || k || '(Base' || k % 4 || ', Frame)' AS signature, 'Base' || k % 4 || '|Frame' AS bases,
        'run|wait' AS methods, 'Class ' || k || '.' AS doc, 11 AS lineno FROM parts WHERE ok""",
)


def _functions_sql(names: str, signatures: str) -> str:
    return f"""{WITH} SELECT project_id, path, unnest({names}) AS qualname, unnest({signatures}) AS signature,
        unnest(['bool', NULL, NULL, NULL]) AS returns, unnest([false, true, false, false]) AS is_async,
        unnest(['', '', '', 'cache.memo(2)']) AS decorators,
        unnest([NULL, NULL, 'Makes ' || p_name || '.', NULL]) AS doc,
        unnest([14, 19, 25, 35 + 2 * e]) AS lineno FROM parts WHERE ok"""


for _dialect, _names, _signatures in (
    ("engine", "['run', 'wait', 'f' || k, 'test_f' || k]",
     "['run(self, a: int)', 'async wait(y: str, *args, **kw)', 'f' || k || '(p: str, q)', 'test_f' || k || '()']"),
    ("deep", "['C' || k || '.run', 'C' || k || '.wait', 'f' || k, 'test_f' || k]",
     "['run(self, a: int, *, flag)', 'wait(self, x, /, y: str, *args, **kw)', 'f' || k || '(p: str, q)',"
     " 'test_f' || k || '()']"),
    ("capsule", "['C' || k || '.run', 'C' || k || '.wait', 'f' || k, 'test_f' || k]",
     "['run(self, a: int, flag)', 'wait(y: str, *args, **kw)', 'f' || k || '(p: str, q)', 'test_f' || k || '()']"),
):
    _add(
        f"a4_{_dialect}_functions",
        lambda s, d, dialect=_dialect: symbols.functions(_facts(s, d), dialect).withColumn(
            "decorators", F.array_join("decorators", "|")),
        _functions_sql(_names, _signatures),
    )
_add(
    "a5_qualified_names",
    lambda s, d: symbols.functions(_facts(s, d), "deep").select(
        *KEY, "qualname", F.explode_outer("decorators").alias("decorator")),
    f"""{WITH} SELECT project_id, path, unnest(['C' || k || '.run', 'C' || k || '.wait', 'f' || k, 'test_f' || k])
        AS qualname, unnest([NULL, NULL, NULL, 'cache.memo(2)']) AS decorator FROM parts WHERE ok""",
)
_add(
    "a6_complexity",
    lambda s, d: _facts(s, d).filter("facts.parse_ok").select(
        *KEY, symbols.engine_complexity().alias("engine"), symbols.deep_complexity().alias("deep")),
    f"{WITH} SELECT project_id, path, 7 + e AS engine, 9 + e AS deep FROM parts WHERE ok",
)
_CALL_SET = """['argparse.ArgumentParser', 'cache.memo', 'f' || k, 'os.getenv', 's.go', 's.lock', 'tk.Button']"""
_add(
    "a7_call_targets",
    lambda s, d: symbols.values(_facts(s, d), symbols.call_target_set(), "target"),
    f"{WITH} SELECT project_id, path, unnest({_CALL_SET}) AS target FROM parts WHERE ok",
)
_add(
    "a8_environment_reads",
    lambda s, d: symbols.values(_facts(s, d), symbols.env_var_set()),
    f"""{WITH} SELECT project_id, path, unnest(['E' || k % 10, 'K' || k, 'V' || k % 5]) AS value
        FROM parts WHERE ok""",
)
_add(
    "a9_cli_parsers",
    lambda s, d: symbols.values(_facts(s, d), symbols.cli_command_set(), "command"),
    f"{WITH} SELECT project_id, path, 'argparse.ArgumentParser' AS command FROM parts WHERE ok",
)
_add(
    "a10_entrypoints",
    lambda s, d: symbols.values(_facts(s, d), symbols.entrypoint_set()),
    f"{WITH} SELECT project_id, path, path || '::<module>' AS value FROM parts WHERE ok",
)
_add(
    "a11_ui_usage",
    lambda s, d: _facts(s, d).filter("facts.parse_ok").select(
        *KEY, _join(symbols.ui_widget_set(), "calls"), _join(symbols.ui_base_list(True), "windows"),
        _join(symbols.ui_base_list(False), "widgets")),
    f"""{WITH} SELECT project_id, path, 'tk.Button' AS calls, '' AS windows, 'Frame' AS widgets
        FROM parts WHERE ok""",
)
_add(
    "a12_tests",
    lambda s, d: _facts(s, d).filter("facts.parse_ok").select(
        *KEY, _join(symbols.engine_test_list(), "engine"), _join(symbols.deep_test_set(), "deep")),
    f"{WITH} SELECT project_id, path, path || '::test_f' || k AS engine, 'test_f' || k AS deep FROM parts WHERE ok",
)
_STRINGS = """['Class ' || k || '.', 'K' || k, 'V' || k % 5, 'Makes ' || p_name || '.', p_name, 'E' || k % 10, 'x',
    p_type, '__main__', p_brand]"""
_add(
    "a13_string_literals",
    lambda s, d: symbols.values(_facts(s, d), symbols.string_set(), "string"),
    f"{WITH} SELECT project_id, path, unnest(list_distinct({_STRINGS})) AS string FROM parts WHERE ok",
)
_add(
    "a14_outline",
    lambda s, d: _outlines(s, d),
    f"""{WITH} SELECT project_id, path, array_to_string({_DEEP_IMPORTS}[:3], '|') AS imports,
        'class C' || k || ' run|func f' || k || '(p: str, q)|func test_f' || k || '()' AS symbols,
        'os.getenv|s.go|s.lock' AS calls FROM parts WHERE ok""",
)


def _outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o")
    shown = F.transform(o["symbols"], lambda x: F.concat_ws(
        " ", x["kind"], x["name"], F.array_join(x["methods"], ",")))
    return _facts(spark, sf_dir).filter("facts.parse_ok").select(*KEY, symbols.outline(3).alias("o")).select(
        *KEY, _join(o["imports"], "imports"), _join(shown, "symbols"), _join(o["calls"], "calls"))


_add(
    "a14_headings_outline",
    lambda s, d: document_files(s, d).filter(
        F.col("content").isNotNull() & (paths.suffix(F.col("path")) != ".py")).select(
        *KEY, _join(text.headings(F.col("content"), 5), "headings")),
    f"""{FILES} SELECT project_id, path, coalesce(array_to_string(list_transform(list_filter({LINES},
          lambda l: starts_with(l, '#'))[:5], lambda l: trim(l, '# ')), '|'), '') AS headings
        FROM files WHERE content IS NOT NULL AND path NOT LIKE '%.py'""",
)
_add(
    "a15_docstrings",
    lambda s, d: _facts(s, d).filter("facts.parse_ok").select(
        *KEY, symbols.doc_line(F.col("facts.doc"), "deep").alias("module_doc"),
        _join(F.filter(F.transform("facts.functions", lambda f: symbols.doc_line(f["doc"], "engine")),
                       lambda x: x.isNotNull()), "function_docs")),
    f"""{WITH} SELECT project_id, path, 'Module ' || k || ' doc.' AS module_doc,
        'Makes ' || p_name || '.' AS function_docs FROM parts WHERE ok""",
)
_add(
    "c4_role_from_symbols",
    lambda s, d: symbols.engine_analysis(*_all_files(s, d)).select(*KEY, "responsibility"),
    f"""{FILES}, {PARTS} SELECT project_id, path, CASE WHEN contains(lower(path), 'test') THEN 'Testing' ELSE 'Core logic' END
          AS responsibility FROM files
        UNION ALL SELECT project_id, path, CASE WHEN ok THEN 'Module integration' ELSE 'Core logic' END FROM parts""",
)

# --- joins and graphs ------------------------------------------------------------------

_NAMESPACES = "['helper' || k % 3, 'lib' || k % 7, 'os', 'pkg']"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, facts = _both(spark, sf_dir)
    return graph.classified_imports(symbols.imports(facts, "deep"), files).select(
        *KEY, "module", "namespace", "internal")


_add(
    "j2_classified_imports", _classified,
    f"""{WITH}, known AS (
          SELECT DISTINCT project_id, unnest(['pkg', 'm' || k]) AS namespace FROM parts
        ), used AS (
          SELECT project_id, path, unnest({_DEEP_IMPORTS}) AS module, unnest({_NAMESPACES}) AS namespace
          FROM parts WHERE ok
        ) SELECT u.*, k.namespace IS NOT NULL AS internal FROM used u
          LEFT JOIN known k ON k.project_id = u.project_id AND k.namespace = u.namespace""",
)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of both dialects; the strict one is empty, as in the analysis engine."""
    files, facts = _both(spark, sf_dir)
    forms = {"strict": "engine", "resolved": "deep"}
    strict, resolved = (
        graph.resolved_edges(symbols.imports(facts, form), files, dialect).withColumn("dialect", F.lit(dialect))
        for dialect, form in forms.items())
    return strict.unionByName(resolved)


_add("j3_resolved_edges", _resolved,
     f"""{WITH} SELECT 'resolved' AS dialect, p.project_id, 'pkg.m' || p.k AS source, 'pkg.m' || q.k AS target
         FROM parts p JOIN parts q ON q.project_id = p.project_id AND q.k = p.k // 2 WHERE p.ok""")
_add(
    "g9_dependency_map",
    lambda s, d: graph.dependency_map(*_both(s, d)).select(*KEY, _join(F.col("namespaces"), "namespaces")),
    f"""{WITH} SELECT project_id, path, CASE WHEN ok THEN array_to_string({_NAMESPACES}, '|') ELSE '' END
        AS namespaces FROM parts""",
)
_add(
    "g10_call_graph",
    lambda s, d: graph.call_graph(*_both(s, d)).select(*KEY, _join(F.col("calls"), "calls")),
    f"""{WITH} SELECT project_id, path, CASE WHEN ok THEN array_to_string({_CALL_SET}, '|') ELSE '' END
        AS calls FROM parts""",
)
_add(
    "g11_config_catalogue",
    lambda s, d: catalogues.config_entries(*_all_files(s, d)),
    f"""{FILES}, {PARTS}, keys AS (
          SELECT project_id, {SUFFIX} AS section, path, unnest(list_distinct(regexp_extract_all(content,
            '["'']([A-Za-z0-9_.-]+)["''][{WS}]*[:=]', 1))) AS key
          FROM files WHERE {SUFFIX} IN ('.json', '.yml')
        ) SELECT project_id, section, path || ':' || key AS value FROM keys
        UNION ALL SELECT DISTINCT project_id, 'environment', v FROM (
          SELECT project_id, unnest(['E' || k % 10, 'K' || k, 'V' || k % 5]) AS v FROM parts WHERE ok)""",
)
_add(
    "g12_test_map",
    lambda s, d: catalogues.test_map(_facts(s, d)).select(*KEY, _join(F.col("tests"), "tests")),
    f"{WITH} SELECT project_id, path, 'test_f' || k AS tests FROM parts WHERE ok",
)
_POSTINGS = f"""postings AS (
          SELECT project_id, unnest(list_distinct({_STRINGS})) AS string, path FROM parts WHERE ok
          UNION ALL
          SELECT project_id, unnest(list_distinct(list_filter({nonblank_lines()}, lambda l: len(l) < 120))), path
          FROM files WHERE content IS NOT NULL AND path NOT LIKE '%.py'
        )"""
_add(
    "g13_string_postings",
    lambda s, d: catalogues.string_postings(*_all_files(s, d)),
    f"{FILES}, {PARTS}, {_POSTINGS} SELECT * FROM postings",
)
_add(
    "g13_string_index",
    lambda s, d: catalogues.string_index(catalogues.string_postings(*_all_files(s, d))),
    f"""{FILES}, {PARTS}, {_POSTINGS} SELECT project_id, string, count(*) AS n_files, min(path) AS first_path,
        max(path) AS last_path FROM postings GROUP BY project_id, string""",
)
_add(
    "g14_ui_catalogue",
    lambda s, d: catalogues.ui_catalogue(_facts(s, d)),
    f"{WITH} SELECT project_id, path, 'tk.Button' AS widget FROM parts WHERE ok",
)
_add(
    "g15_cli_inventory",
    lambda s, d: catalogues.cli_inventory(_facts(s, d)),
    f"{WITH} SELECT project_id, path, 'argparse.ArgumentParser' AS command FROM parts WHERE ok",
)
_API = """[
    {'qualname': 'C' || k || '.run', 'signature': 'run(self, a: int, *, flag)', 'kind': 'function', 'doc': NULL},
    {'qualname': 'C' || k || '.wait', 'signature': 'wait(self, x, /, y: str, *args, **kw)', 'kind': 'function',
     'doc': NULL},
    {'qualname': 'f' || k, 'signature': 'f' || k || '(p: str, q)', 'kind': 'function',
     'doc': 'Makes ' || p_name || '.'},
    {'qualname': 'test_f' || k, 'signature': 'test_f' || k || '()', 'kind': 'function', 'doc': NULL},
    {'qualname': 'C' || k, 'signature': 'class C' || k || '(Base' || k % 4 || ', Frame)', 'kind': 'class',
     'doc': 'Class ' || k || '.'}]"""
_add(
    "g16_api_index",
    lambda s, d: catalogues.api_index(frozen(_facts(s, d))),
    f"""{WITH} SELECT project_id, path AS module, a.qualname AS qualname, a.signature AS signature, a.kind AS kind,
        a.doc AS doc FROM (SELECT project_id, path, unnest({_API}) AS a FROM parts WHERE ok)""",
)
_add(
    "g16_api_modules",
    lambda s, d: catalogues.api_modules(_facts(s, d)).select("project_id", "module", _join(F.col("entries"), "entries")),
    f"""{WITH} SELECT project_id, path AS module, array_to_string(list_transform({_API},
          lambda a: a.qualname || ' :: ' || a.signature), '|') AS entries FROM parts WHERE ok""",
)
_add(
    "g17_licence_findings",
    lambda s, d: catalogues.licence_findings(document_files(s, d)),
    f"""{FILES} SELECT project_id, path, 'Possible licence header' AS note FROM files
        WHERE regexp_matches(lower(array_to_string({LINES}[:20], chr(10))), 'license|copyright')""",
)
_add(
    "g18_asset_manifest",
    lambda s, d: catalogues.asset_manifest(document_files(s, d)),
    f"""{FILES} SELECT project_id, path, CASE {SUFFIX} WHEN '.json' THEN 'application/json' ELSE 'image/png' END
        AS mime, size_bytes FROM files WHERE {SUFFIX} IN ('.json', '.png')""",
)
_CARD = f"""cards AS (
          SELECT project_id, path, 'Python' AS language, CASE WHEN ok THEN 29 ELSE 30 END + 2 * e AS sloc, e AS todo,
            CASE WHEN ok THEN CAST(9 + e AS DOUBLE) + (29 + 2 * e) / 200.0 + e * 0.5 END AS score, * EXCLUDE
            (project_id, path) FROM parts
        )"""
_add(
    "g19_file_cards",
    lambda s, d: _card_columns(cards.file_cards(*_both(s, d))),
    f"""{WITH}, {_CARD} SELECT project_id, path, language, CAST(sloc AS BIGINT) AS sloc,
        CAST(todo AS BIGINT) AS todo_count, 'CLI or entrypoint' AS responsibility,
        CASE WHEN ok THEN 'Module ' || k || ' doc.' END AS docstring,
        CASE WHEN ok THEN array_to_string({_DEEP_IMPORTS}, '|') ELSE '' END AS imports,
        CASE WHEN ok THEN 'pkg' ELSE '' END AS internal_imports,
        CASE WHEN ok THEN array_to_string({_NAMESPACES}[:3], '|') ELSE '' END AS external_imports,
        CASE WHEN ok THEN array_to_string({_CALL_SET}, '|') ELSE '' END AS call_targets,
        CASE WHEN ok THEN array_to_string(['E' || k % 10, 'K' || k, 'V' || k % 5], '|') ELSE '' END AS env_vars,
        CASE WHEN ok THEN 'test_f' || k ELSE '' END AS tests,
        CASE WHEN ok THEN array_to_string(list_sort(list_distinct({_STRINGS})), '|') ELSE '' END AS strings,
        CASE WHEN ok THEN 9 + e END AS cyclomatic_complexity, round(CAST(score AS DOUBLE), 6) AS risk_score,
        CASE WHEN score IS NULL THEN 'not-computed' WHEN score < 5 THEN 'low' WHEN score < 15 THEN 'medium'
          ELSE 'high' END AS complexity FROM cards""",
)


def _card_columns(rows: DataFrame) -> DataFrame:
    lists = ["imports", "internal_imports", "external_imports", "call_targets", "env_vars", "tests", "strings"]
    return rows.select(
        *KEY, "language", "sloc", "todo_count", "responsibility", "docstring", *(_join(F.col(c), c) for c in lists),
        "cyclomatic_complexity", F.round("risk_score", 6).alias("risk_score"), "complexity")


def _bundle_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cards.bundle_cards(cards.file_cards(*_both(spark, sf_dir)))
    return rows.select(*KEY, "hash", "language", "sloc", "todo_count", _join(F.col("imports"), "imports"),
                       "complexity_band", "cyclomatic_complexity", _join(F.col("functions"), "functions"),
                       _join(F.col("classes"), "classes"), "doc")


_add(
    "g20_bundle_cards", _bundle_cards,
    f"""{WITH}, {_CARD} SELECT project_id, path, left(sha256(path), 16) AS hash, language,
        CAST(sloc AS BIGINT) AS sloc, CAST(todo AS BIGINT) AS todo_count,
        CASE WHEN ok THEN array_to_string({_DEEP_IMPORTS}, '|') ELSE '' END AS imports,
        CASE WHEN score < 5 THEN 'low' WHEN score < 15 THEN 'medium' WHEN score >= 15 THEN 'high' END
          AS complexity_band, CASE WHEN ok THEN 9 + e END AS cyclomatic_complexity,
        CASE WHEN ok THEN array_to_string(list_transform({_API}[:4], lambda a: a.signature), '|') ELSE '' END
          AS functions, CASE WHEN ok THEN {_API}[5].signature ELSE '' END AS classes,
        CASE WHEN ok THEN 'Module ' || k || ' doc.' END AS doc FROM cards""",
)


def _graph_part(part: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files, facts = _both(spark, sf_dir)
        imported = symbols.imports(facts, "engine")
        return graph.import_nodes(files, imported) if part == "nodes" else graph.import_edges(imported, files)

    return run


_add("g21_import_nodes", _graph_part("nodes"),
     f"""{WITH} SELECT project_id, 'pkg.m' || k AS id, 'm' || k || '.py' AS label, 'internal_module' AS type
         FROM parts UNION ALL SELECT DISTINCT project_id, m, m, 'external_module' FROM (
           SELECT project_id, unnest(['os', 'lib' || k % 7 || '.sub', 'pkg']) AS m FROM parts WHERE ok)""")
_add("g21_import_edges", _graph_part("edges"),
     f"""{WITH} SELECT project_id, 'pkg.m' || k AS source, unnest(['os', 'lib' || k % 7 || '.sub', 'pkg']) AS target,
         'external_import' AS type FROM parts WHERE ok""")
_add(
    "g25_overview",
    lambda s, d: cards.overview(*_all_files(s, d)),
    f"""{FILES}, {PARTS} SELECT project_id, count(*) AS files_analysed, CAST(sum(api) AS BIGINT) AS api_items,
          CAST(sum(asset) AS BIGINT) AS binary_assets FROM (
          SELECT project_id, 0 AS api, CASE WHEN {SUFFIX} IN ('.json', '.png') THEN 1 ELSE 0 END AS asset FROM files
          UNION ALL SELECT project_id, CASE WHEN ok THEN 5 ELSE 0 END, 0 FROM parts) GROUP BY project_id""",
)


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).filter("facts.parse_ok").select(
        *KEY, symbols.deep_import_set().alias("imports"), symbols.call_target_set().alias("calls"),
        symbols.string_set().alias("strings"))
    cut = cards.cut_lists(rows, {"imports": 12, "calls": 5, "strings": 5})
    return cut.select(*KEY, *(_join(F.col(c), c) for c in ("imports", "calls", "strings")),
                      "imports_cut", "calls_cut", "strings_cut")


_add(
    "w2_cut_lists", _cut,
    f"""{WITH} SELECT project_id, path, array_to_string({_DEEP_IMPORTS}, '|') AS imports,
        array_to_string({_CALL_SET}[:5], '|') AS calls,
        array_to_string(list_sort(list_distinct({_STRINGS}))[:5], '|') AS strings,
        false AS imports_cut, true AS calls_cut, len(list_distinct({_STRINGS})) > 5 AS strings_cut
        FROM parts WHERE ok""",
)
