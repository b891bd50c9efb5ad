"""Registered totals, roll-ups, dictionaries and hash trees (G, W, O rows) with their check SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, paths, text
from ..operators import dictionary, directories, fingerprint, merkle, numbering, selection, totals
from ..session import frozen
from ..sources.tables import document_files
from .columns import KEY, _SELECTION, _selection
from .sql import FILES, NAME, SUFFIX, WS_CHARS

QUERIES = {}
ORACLES = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_VISIBLE = r"NOT regexp_matches(path, '(^|/)([.]|__pycache__(/|$))')"

_add(
    "g1_project_totals",
    lambda s, d: totals.project_totals(document_files(s, d)),
    f"""{FILES} SELECT project_id, count(*) AS total_files, count(content) AS text_files,
        CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
        CAST(coalesce(sum(lines), 0) AS BIGINT) AS total_lines,
        CAST(coalesce(sum(words), 0) AS BIGINT) AS total_words FROM counted GROUP BY project_id""",
)
_add(
    "g1_engine_totals",
    lambda s, d: totals.engine_totals(selection.visible_files(document_files(s, d))),
    f"""{FILES} SELECT project_id, count(*) AS files, CAST(coalesce(sum(lines), 0) AS BIGINT) AS sloc,
        CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM counted WHERE {_VISIBLE} GROUP BY project_id""",
)
_add(
    "g2_quick_stats",
    lambda s, d: totals.quick_stats(document_files(s, d)),
    f"""{FILES}, dirs AS (
          SELECT DISTINCT project_id, array_to_string(string_split(path, '/')[:n], '/') AS dir
          FROM files, range(1, 9) r(n) WHERE n < len(string_split(path, '/'))
        ), n_dirs AS (
          SELECT project_id, count(*) AS directories FROM dirs
          WHERE NOT regexp_matches(dir, '(^|/)([.]|__pycache__(/|$))') GROUP BY project_id
        ) SELECT f.project_id, count(*) FILTER (WHERE {_VISIBLE}) AS total_files,
          count(*) FILTER (WHERE {_VISIBLE} AND path NOT LIKE '%.png') AS text_files,
          CAST(coalesce(sum(size_bytes) FILTER (WHERE {_VISIBLE}), 0) AS BIGINT) AS total_size,
          count(*) FILTER (WHERE {_VISIBLE}) AS listed_files, any_value(directories) AS directories
        FROM files f JOIN n_dirs USING (project_id) GROUP BY f.project_id""",
)

_CAPSULE_LANGUAGE = f"""CASE {SUFFIX} WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json'
    WHEN '.yml' THEN 'yaml' WHEN '.js' THEN 'javascript' ELSE 'binary' END"""

_add(
    "g3_language_histogram",
    lambda s, d: totals.language_histogram(document_files(s, d)).select("project_id", "language", "n_files"),
    f"""{FILES} SELECT project_id, {_CAPSULE_LANGUAGE} AS language, count(*) AS n_files FROM files GROUP BY ALL""",
)
_add(
    "g3_dominant_language",
    lambda s, d: totals.dominant_language(document_files(s, d)),
    f"""{FILES}, langs AS (
          SELECT project_id, {_CAPSULE_LANGUAGE} AS language, count(*) AS n, min(path) AS first_path
          FROM files GROUP BY ALL
        ) SELECT project_id, CAST(sum(n) AS BIGINT) AS total_files, count(*) AS n_languages,
          first(language ORDER BY n DESC, first_path) AS dominant_language FROM langs GROUP BY project_id""",
)
_add(
    "g4_fingerprint",
    lambda s, d: fingerprint.project_fingerprint(document_files(s, d)),
    f"""{FILES} SELECT project_id, sha256(string_agg(path || '::' || size_bytes, '' ORDER BY path)) AS fingerprint
        FROM files GROUP BY project_id""",
)
_add(
    "g4_capsule_fingerprint",
    lambda s, d: fingerprint.project_fingerprint(
        document_files(s, d).filter(paths.is_capsule_text(F.col("path"))), by_components=True),
    f"""{FILES} SELECT project_id,
        sha256(string_agg(path || '::' || size_bytes, '' ORDER BY string_split(path, '/'))) AS fingerprint
        FROM files WHERE {SUFFIX} IN ('.py', '.md', '.json', '.yml', '.js') GROUP BY project_id""",
)

# --- dictionaries ----------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).filter(F.col("content").isNotNull()).select(
        *KEY, text.normalise_eol(F.col("content")).alias("content"))


def _dictionary_sql(size: int) -> str:
    return f"""{FILES}, texts AS (
          SELECT project_id, path, rtrim(content, {WS_CHARS}) || chr(10) AS content FROM files
          WHERE content IS NOT NULL
        ), hits AS (
          SELECT project_id, path, unnest(w) AS word, unnest(range(len(w))) AS pos
          FROM (SELECT project_id, path, regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{{3,}}') AS w FROM texts)
        ), words AS (
          SELECT project_id, word, count(*) AS n, min((path, pos)) AS first_at FROM hits GROUP BY ALL
        ), dictionary AS (
          SELECT project_id, word, n, CAST(row_number() OVER (
            PARTITION BY project_id ORDER BY n DESC, first_at) AS INTEGER) AS rank
          FROM words QUALIFY rank <= {size}
        )"""


_add(
    "g5_token_dictionary",
    lambda s, d: dictionary.token_dictionary(_texts(s, d), 256),
    f"""{_dictionary_sql(256)} SELECT project_id, rank, chr(167) || rank AS token, word, n FROM dictionary""",
)

_RUNS = r"""runs AS (
          SELECT t.project_id, t.path, unnest(r) AS run, unnest(range(len(r))) AS pos FROM (
            SELECT project_id, path, regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS r FROM texts) t
        ), swapped AS (
          SELECT r.project_id, r.path, pos, run, d.rank FROM runs r
          LEFT JOIN dictionary d ON d.project_id = r.project_id AND d.word = r.run
        )"""


def _substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return dictionary.substitute(texts, dictionary.token_dictionary(texts, 64))


_add(
    "g6_substitution",
    lambda s, d: _substituted(s, d).select(*KEY, "payload"),
    f"""{_dictionary_sql(64)}, {_RUNS}
        SELECT project_id, path, string_agg(CASE WHEN rank IS NULL THEN run ELSE chr(167) || rank END, ''
          ORDER BY pos) AS payload FROM swapped GROUP BY project_id, path""",
)
_add(
    "g7_tokens_used",
    lambda s, d: _substituted(s, d).select(*KEY, F.array_join("tokens_used", "|").alias("tokens")),
    f"""{_dictionary_sql(64)}, {_RUNS}
        SELECT project_id, path, coalesce(string_agg(DISTINCT chr(167) || rank, '|' ORDER BY chr(167) || rank)
          FILTER (WHERE rank IS NOT NULL), '') AS tokens FROM swapped GROUP BY project_id, path""",
)
_add(
    "j4_dictionary_lookup",
    lambda s, d: _lookup_counts(s, d),
    f"""{_dictionary_sql(64)}, {_RUNS}
        SELECT project_id, path, count(*) FILTER (WHERE rank IS NOT NULL) AS n_replaced,
          count(*) AS n_runs FROM swapped GROUP BY project_id, path""",
)


def _lookup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs of each text the dictionary replaces; marks in the text itself are no lookups."""
    runs = text.tokens(F.col("content"))
    return _substituted(spark, sf_dir).select(*KEY, "n_replaced", F.size(runs).cast("long").alias("n_runs"))


_add(
    "o4_top_words",
    lambda s, d: document_files(s, d).select(F.explode(F.regexp_extract_all(
        F.col("content"), F.lit(fixed.CAPSULE_WORD), F.lit(0))).alias("word"))
    .groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100),
    f"""{FILES} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content,
          '[A-Za-z_][A-Za-z0-9_]{{3,}}')) AS word FROM files) GROUP BY word ORDER BY n DESC, word LIMIT 100""",
)
_add(
    "o5_first_strings",
    lambda s, d: document_files(s, d).filter(paths.suffix(F.col("path")) != ".py").select(
        F.explode(text.short_lines(F.col("content"))).alias("string")).distinct().orderBy("string").limit(50),
    rf"""{FILES}, cut AS (SELECT unnest(list_transform(string_split_regex(content,
          '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: trim(l, {WS_CHARS}))) AS string
          FROM files WHERE path NOT LIKE '%.py')
        SELECT DISTINCT string FROM cut WHERE string <> '' AND len(string) < 120 ORDER BY string LIMIT 50""",
)

# --- numbering and hash trees ----------------------------------------------------------


def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capsule sections of the document files with their hash, numbered by kind and path."""
    sections = document_files(spark, sf_dir).filter(paths.is_capsule_text(F.col("path"))).select(
        "project_id", paths.section_kind(F.col("path")).alias("kind"), "path",
        text.content_hash(text.normalise_eol(F.col("content"))).alias("hash"))
    return numbering.number_rows(frozen(sections), ["project_id"], ["kind", "path"])


_SECTIONS = f"""{FILES}, sections AS (
          SELECT project_id, CASE WHEN {SUFFIX} IN ('.json', '.yml') THEN 'config' WHEN {SUFFIX} = '.md' THEN 'docs'
            ELSE 'code' END AS kind, path, sha256(rtrim(content, {WS_CHARS}) || chr(10)) AS hash
          FROM files WHERE {SUFFIX} IN ('.py', '.md', '.json', '.yml', '.js')
        ), numbered AS (
          SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY kind, path) AS number,
            count(*) OVER (PARTITION BY project_id) AS total FROM sections
        )"""

_TREE = f"""{_SECTIONS.replace('WITH stored', 'WITH RECURSIVE stored', 1)}, levels AS (
          SELECT project_id, 0 AS level, number - 1 AS idx, hash, total AS width FROM numbered
          UNION ALL
          SELECT project_id, level + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)),
            max((width + 1) // 2) FROM levels WHERE width > 1 GROUP BY project_id, level, idx // 2
        )"""

_add(
    "w1_section_numbers",
    lambda s, d: numbered_sections(s, d).select(
        "project_id", F.format_string("sec-%04d", "number").alias("section_id"), "kind", "path"),
    f"""{_SECTIONS} SELECT project_id, printf('sec-%04d', CAST(number AS INTEGER)) AS section_id, kind, path
        FROM numbered""",
)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    leaves = numbered_sections(spark, sf_dir).select(
        "project_id", "total", (F.col("number") - 1).alias("idx"), "hash")
    return leaves, merkle.hash_tree(leaves)


_add(
    "g8_hash_tree",
    lambda s, d: _tree(s, d)[1].select("project_id", F.col("level").cast("int").alias("level"), "node_id", "hash"),
    f"""{_TREE} SELECT project_id, level, printf('n-%04d', CAST(row_number() OVER (
          PARTITION BY project_id ORDER BY level, idx) AS INTEGER)) AS node_id, hash FROM levels WHERE level > 0""",
)
_add(
    "g8_tree_root",
    lambda s, d: merkle.tree_root(*_tree(s, d)),
    f"""{_TREE} SELECT project_id, hash AS root FROM levels WHERE width = 1""",
)

# --- directories and sizes -------------------------------------------------------------

_PREFIXES = f"""prefixes AS (
          SELECT project_id, path, size_bytes, array_to_string(string_split(path, '/')[:n], '/') AS dir,
            array_to_string(string_split(path, '/')[:-2], '/') AS own_dir, sel
          FROM (SELECT *, coalesce({_SELECTION}, false) AS sel FROM files) f, range(0, 9) r(n)
          WHERE n < len(string_split(path, '/'))
        )"""

_add(
    "g22_directory_rollup",
    lambda s, d: directories.directory_rollup(document_files(s, d).filter(F.col("content").isNotNull())),
    f"""{FILES}, {_PREFIXES}, tree AS (
          SELECT project_id, dir, CASE WHEN dir <> '' THEN array_to_string(string_split(dir, '/')[:-2], '/') END
            AS parent, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes,
            count(*) FILTER (WHERE own_dir = dir) AS n_direct_files
          FROM prefixes WHERE path NOT LIKE '%.png' GROUP BY project_id, dir
        ) SELECT t.*, (SELECT count(*) FROM tree c WHERE c.project_id = t.project_id AND c.parent = t.dir)
          AS n_subdirs FROM tree t""",
)
_add(
    "g23_selection_rollup",
    lambda s, d: directories.selection_rollup(_selection(s, d)),
    f"""{FILES}, {_PREFIXES} SELECT project_id, dir, CASE WHEN bool_and(sel) THEN 'all' WHEN bool_or(sel) THEN 'mixed'
          ELSE 'none' END AS state FROM prefixes GROUP BY project_id, dir""",
)
_add(
    "g24_estimated_size",
    lambda s, d: totals.estimated_export(selection.selected_files(document_files(s, d), _selection(s, d))),
    f"""{FILES}, sums AS (
          SELECT project_id, count(*) AS n_files,
            CAST(floor(CAST(sum(size_bytes) AS DOUBLE) * CAST(1.1 AS DOUBLE)) AS BIGINT) + 256 * count(*)
            AS estimated_bytes FROM files WHERE {_SELECTION} GROUP BY project_id
        ) SELECT *, CASE WHEN estimated_bytes < 1048576 THEN 'small' WHEN estimated_bytes < 10485760 THEN 'medium'
          ELSE 'large' END AS band FROM sums""",
)
