"""Registered queries over module graphs, budgets, chunks and redactions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import budgets, chunks, churn, cycles, graph, range_tree, redaction, symbols
from ..session import frozen
from ..sources.pyfacts import python_facts
from ..sources.tables import document_files, linked_sources
from .sql import FILES

QUERIES = {}
ORACLES = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


# --- module graphs ---------------------------------------------------------------------


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = linked_sources(spark, sf_dir)
    facts = frozen(python_facts(files))
    return frozen(graph.resolved_edges(symbols.imports(facts, "deep"), files, "resolved"))


_LINKED = """WITH RECURSIVE keys AS (
  SELECT p_partkey AS k, (p_partkey - 1) // 200 AS run, (p_partkey - 1) % 200 AS i, ((p_partkey - 1) % 200) // 10 % 5 AS ring FROM part
), wanted AS (
  SELECT k, run, unnest([CASE WHEN i % 10 < ring THEN k + 1 END, CASE WHEN i % 10 = ring AND ring > 0 THEN k - ring END,
    CASE WHEN i >= 17 AND i % 3 = 0 THEN k - 17 END, CASE WHEN i % 4 = 1 THEN k - i + i // 2 END, CASE WHEN i % 10 = 9 THEN k - i END]) AS t FROM keys
), edges AS (
  SELECT DISTINCT w.run, w.k AS u, w.t AS v FROM wanted w JOIN keys x ON x.k = w.t AND x.run = w.run WHERE w.k <> w.t
), modules AS (SELECT DISTINCT run, k FROM (SELECT run, u AS k FROM edges UNION ALL SELECT run, v FROM edges)
), reach AS (SELECT run, u, v FROM edges UNION SELECT r.run, r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
), mutual AS (SELECT x.run, x.u, y.u AS w FROM reach x JOIN reach y ON x.u = y.v AND x.v = y.u
), cycles AS (SELECT run, u AS k, min('pkg.m' || w) AS cycle, count(DISTINCT w) AS size FROM mutual GROUP BY ALL
), named AS (SELECT m.run, m.k, coalesce(c.cycle, 'pkg.m' || m.k) AS cycle, coalesce(c.size, 1) AS size FROM modules m LEFT JOIN cycles c ON c.k = m.k
), dag AS (SELECT DISTINCT a.cycle AS a, b.cycle AS b FROM edges e JOIN named a ON a.k = e.u JOIN named b ON b.k = e.v WHERE a.cycle <> b.cycle
), depth AS (SELECT DISTINCT cycle AS c, 0 AS d FROM named UNION SELECT g.a, d.d + 1 FROM depth d JOIN dag g ON g.b = d.c)
"""

_add(
    "g21_import_cycles", lambda s, d: cycles.import_cycles(_linked(s, d)),
    f"{_LINKED} SELECT 'graph' || run AS project_id, 'pkg.m' || k AS module, cycle, size AS cycle_size FROM cycles",
)
_add(
    "g21_dependency_layers", lambda s, d: cycles.dependency_layers(_linked(s, d)),
    f"""{_LINKED} SELECT 'graph' || n.run AS project_id, 'pkg.m' || n.k AS module, n.cycle, CAST(n.size AS BIGINT) AS cycle_size,
        CAST(max(d.d) AS BIGINT) AS layer FROM named n JOIN depth d ON d.c = n.cycle GROUP BY ALL""",
)
_add(
    "g21_hubs", lambda s, d: cycles.hubs(_linked(s, d)),
    f"""{_LINKED} SELECT 'graph' || m.run AS project_id, 'pkg.m' || m.k AS module,
        (SELECT count(*) FROM edges e WHERE e.v = m.k) AS fan_in, count(r.u) AS dependents
        FROM modules m LEFT JOIN reach r ON r.v = m.k AND r.u <> m.k GROUP BY m.run, m.k""",
)
_add(
    "g21_degrees", lambda s, d: cycles.degrees(_linked(s, d)),
    f"""{_LINKED} SELECT 'graph' || run AS project_id, 'pkg.m' || k AS module, (SELECT count(*) FROM edges e WHERE e.v = k) AS fan_in,
        (SELECT count(*) FROM edges e WHERE e.u = k) AS fan_out FROM modules""",
)

# --- budgets ---------------------------------------------------------------------------

_FILE_BUDGET, _SIZE_BUDGET = 60, 150_000
_KEPT = f"n <= {_FILE_BUDGET} AND size <= {_SIZE_BUDGET}"
_BUDGETED = f"""{FILES}, summed AS (SELECT project_id, path, size_bytes, count(*) OVER w AS n, sum(size_bytes) OVER w AS size FROM files
    WINDOW w AS (PARTITION BY project_id ORDER BY path ROWS UNBOUNDED PRECEDING))"""

_add(
    "p8_file_budget", lambda s, d: budgets.within_budget(document_files(s, d), _FILE_BUDGET, _SIZE_BUDGET),
    f"""{_BUDGETED} SELECT project_id, path, size_bytes, n - 1 AS n_before, CAST(size - size_bytes AS BIGINT) AS size_before,
        {_KEPT} AS kept FROM summed""",
)
_add(
    "p8_budget_report", lambda s, d: budgets.budget_report(document_files(s, d), _FILE_BUDGET, _SIZE_BUDGET),
    f"""{_BUDGETED} SELECT project_id, count(*) FILTER (WHERE {_KEPT}) AS files_kept, count(*) FILTER (WHERE NOT ({_KEPT})) AS files_left,
        CAST(coalesce(sum(size_bytes) FILTER (WHERE {_KEPT}), 0) AS BIGINT) AS bytes_kept,
        CAST(coalesce(sum(size_bytes) FILTER (WHERE NOT ({_KEPT})), 0) AS BIGINT) AS bytes_left FROM summed GROUP BY project_id""",
)

# --- chunks ----------------------------------------------------------------------------

_CHUNK = 4000


def _chunk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file the digest of its reassembled chunks, and how many are too long, leave a gap or begin inside a line."""
    made = chunks.chunked(document_files(spark, sf_dir), _CHUNK).withColumns({
        "long": (F.length("text") > _CHUNK) & F.substr("text", F.lit(1), F.length("text") - 1).contains("\n"),
        "odd": F.length("text") != F.col("stop") - F.col("start"), "inside": (F.col("chunk") > 0) & (F.col("start") == 0)})
    inside = F.array_sort(F.collect_list(F.struct("chunk", "start", "stop", "text", "long", "odd", "inside")))
    joined = made.groupBy("project_id", "path").agg(inside.alias("c"))
    return joined.select(
        "project_id", "path", F.sha2(F.array_join("c.text", ""), 256).alias("sha256"),
        F.size(F.filter("c", lambda c: c["long"] | c["odd"] | c["inside"])).alias("n_wrong"),
        F.size(F.filter(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), lambda c: ~c["text"].endswith("\n"))).alias("n_inside_lines"))


_add(
    "g20_bundle_chunks", _chunk_facts,
    f"""{FILES} SELECT project_id, path, sha256(content) AS sha256, 0 AS n_wrong, 0 AS n_inside_lines FROM files WHERE content <> ''""",
)

# --- redactions ------------------------------------------------------------------------

_EMAIL = redaction.DEFAULT_RULES[0]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage and some words as literals, and a pattern."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("rule"), F.lit("literal").alias("kind"), F.col("text").alias("value"))
    words = spark.createDataFrame([("todo", "literal", "TODO"), ("licence", "literal", "License: "), _EMAIL], "rule string, kind string, value string")
    return items.unionByName(words)


_SPANS = f"""{FILES}, rules AS (SELECT 'item' || item_id AS rule, text AS value FROM benchmark UNION ALL VALUES ('todo', 'TODO'), ('licence', 'License: ')
), spans AS (
  SELECT project_id, path, rule, (length(content) - length(replace(content, value, ''))) // length(value) AS n,
    length(content) - length(replace(content, value, '')) AS chars FROM files JOIN rules ON contains(content, value)
  UNION ALL SELECT project_id, path, 'email', len(m), list_sum(list_transform(m, lambda x: length(x)))
    FROM (SELECT project_id, path, regexp_extract_all(content, '{_EMAIL[2]}') AS m FROM files) WHERE len(m) > 0)"""

_add(
    "k5_redaction_report", lambda s, d: redaction.redaction_report(document_files(s, d), _rules(s, d)),
    f"""{_SPANS} SELECT project_id, rule, CAST(sum(n) AS BIGINT) AS n_spans, count(DISTINCT path) AS n_files, CAST(sum(chars) AS BIGINT) AS n_chars
        FROM spans GROUP BY project_id, rule""",
)
_add(
    "k5_redacted_files", lambda s, d: redaction.redacted(document_files(s, d), _rules(s, d)).select(
        "project_id", "path", "n_redactions", F.length("content").alias("n_chars")),
    f"""{_SPANS}, hidden AS (SELECT project_id, path, sum(n) AS n, sum(chars) AS chars, sum(n * (length(rule) + 2)) AS put FROM spans GROUP BY ALL)
        SELECT f.project_id, f.path, CAST(coalesce(h.n, 0) AS BIGINT) AS n_redactions,
          CAST(length(content) - coalesce(h.chars, 0) + coalesce(h.put, 0) AS INTEGER) AS n_chars
        FROM files f LEFT JOIN hidden h USING (project_id, path)""",
)

# --- fingerprints over ranges ----------------------------------------------------------

_FANOUT, _LEVELS = 6, 14


def _tree_sql(levels: int) -> str:
    """The tree level by level; a project with one node is done and stays as it is."""
    parts = ["level0 AS (SELECT project_id, path AS first, sha256(path || '::' || size_bytes) AS hash, 0 AS level FROM files)"]
    for k in range(levels):
        parts.append(f"""level{k + 1} AS (SELECT project_id, min(first) AS first,
          CASE WHEN any_value(n) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY first)) END AS hash,
          any_value(level) + CASE WHEN any_value(n) = 1 THEN 0 ELSE 1 END AS level FROM (
            SELECT *, count(*) OVER (PARTITION BY project_id) AS n, coalesce(sum(CAST(CAST('0x' || hash[1:8] AS UBIGINT) % {_FANOUT} = 0 AS INTEGER))
              OVER (PARTITION BY project_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS range FROM level{k})
          GROUP BY project_id, range)""")
    return ", ".join(parts)


_add(
    "g4_fingerprint_tree", lambda s, d: range_tree.tree_fingerprint(document_files(s, d), _FANOUT),
    f"{FILES}, {_tree_sql(_LEVELS)} SELECT project_id, hash AS fingerprint, CAST(level + 1 AS INTEGER) AS levels FROM level{_LEVELS}",
)

# --- churn -----------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and the same with every fifth line of some gone and lines added that were nowhere; others are gone or new."""
    files = document_files(spark, sf_dir)
    n = F.regexp_extract("path", r"/d(\d+)[./][^/]*$", 1).cast("long")
    kept = F.array_join(F.filter(F.split("content", "\n", -1), lambda line, i: i % 5 != 2), "\n")
    edited = F.when(n % 3 == 0, F.concat(F.lit("added first\nadded second\n"), kept)).otherwise(F.col("content"))
    return files.filter(n % 11 != 4), files.filter(n % 11 != 7).withColumn("content", edited)


_CHANGES = f"""{FILES}, numbered AS (SELECT project_id, path, content, CAST(regexp_extract(path, '/d([0-9]+)', 1) AS BIGINT) AS n FROM files),
  edited AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'added first' || chr(10) || 'added second' || chr(10)
    || array_to_string(list_filter(string_split(content, chr(10)), lambda l, i: (i - 1) % 5 <> 2), chr(10)) ELSE content END AS changed FROM numbered),
  counted_lines AS (SELECT *, CASE WHEN coalesce(content, '') = '' THEN 0 ELSE len(string_split(content, chr(10))) - CAST(content[-1:] = chr(10) AS INTEGER) END AS n_old,
    CASE WHEN coalesce(changed, '') = '' THEN 0 ELSE len(string_split(changed, chr(10))) - CAST(changed[-1:] = chr(10) AS INTEGER) END AS n_new FROM edited),
  changes AS (SELECT project_id, path,
    CASE WHEN n % 11 = 4 THEN 'added' WHEN n % 11 = 7 THEN 'removed' WHEN n % 3 = 0 AND content IS NOT NULL THEN 'changed' ELSE 'same' END AS status,
    CASE WHEN n % 11 = 4 THEN n_new WHEN n % 11 = 7 THEN 0 WHEN n % 3 = 0 AND content IS NOT NULL THEN 2 ELSE 0 END AS added,
    CASE WHEN n % 11 = 4 THEN 0 WHEN n % 11 = 7 THEN n_old WHEN n % 3 = 0 AND content IS NOT NULL THEN n_old - (n_new - 2) ELSE 0 END AS removed
    FROM counted_lines)"""

_add(
    "c19_line_changes", lambda s, d: churn.line_changes(*_snapshots(s, d)),
    f"{_CHANGES} SELECT project_id, path, status, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed FROM changes",
)
_add(
    "c19_churn_hotspots", lambda s, d: churn.churn_hotspots(document_files(s, d), churn.line_changes(*_snapshots(s, d))),
    f"""{_CHANGES} SELECT f.project_id, f.path, f.size_bytes, CAST(added + removed AS BIGINT) AS churn,
        CAST(f.size_bytes * (added + removed) AS BIGINT) AS hotspot FROM files f JOIN changes c ON c.project_id = f.project_id AND c.path = f.path""",
)
