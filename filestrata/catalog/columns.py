"""Registered filter and scalar-column queries (P, C, O, U rows) with their check SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, paths, scores, text
from ..operators import selection
from ..sources.tables import conversation_files, document_files, page_files
from .sql import FILES, LINES, NAME, SUFFIX, WS, WS_CHARS, nonblank_lines, stripped

KEY = ["project_id", "path"]


def _columns(*columns, present: bool = False):
    """A query that adds columns to the document files, or to those with text only."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = document_files(spark, sf_dir)
        if present:
            files = files.filter(F.col("content").isNotNull())
        return files.select(*KEY, *(c() for c in columns))

    return run


def _sql(columns: str, present: bool = False, source: str = "files") -> str:
    where = " WHERE content IS NOT NULL" if present else ""
    return f"{FILES} SELECT project_id, path, {columns} FROM {source}{where}"


def _joined(column, name: str):
    return F.array_join(column, "|").alias(name)


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection table derived from the files: by size, undecided where the size is odd."""
    size = F.col("size_bytes")
    return document_files(spark, sf_dir).select(
        *KEY, F.when(size % 2 == 0, size % 3 != 0).alias("selected"))


_SELECTION = "CASE WHEN size_bytes % 2 = 0 THEN size_bytes % 3 <> 0 END"

QUERIES = {}
ORACLES = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- files table -----------------------------------------------------------------------

_add(
    "s3_document_files",
    lambda s, d: document_files(s, d).select(
        *KEY, "size_bytes", F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("mtime"), "content",
        "lines", "words", "read_status"),
    f"""{FILES} SELECT project_id, path, size_bytes, printf('2024-01-%02d 09:30', CAST(day AS INTEGER)) AS mtime,
        content, lines, words, read_status FROM counted""",
)
_add(
    "s3_page_files",
    lambda s, d: page_files(s, d).select(*KEY, "size_bytes", "lines", "words", "read_status"),
    rf"""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS project_id,
        CASE WHEN regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) = '' THEN 'index'
          ELSE regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) END || '_' || page_id || '.html' AS path,
        CAST(strlen(html) AS BIGINT) AS size_bytes,
        CAST(len(html) - len(replace(html, chr(10), '')) + 1 AS BIGINT) AS lines,
        CAST(len(regexp_extract_all(html, '[^{WS}]+')) AS BIGINT) AS words, 'ok' AS read_status FROM pages""",
)
_add(
    "s3_conversation_files",
    lambda s, d: conversation_files(s, d).select(*KEY, "size_bytes", "content", "lines", "words"),
    rf"""SELECT CAST(conv_id AS VARCHAR) AS project_id, role || '/' || turn || '.txt' AS path,
        CAST(strlen(text) AS BIGINT) AS size_bytes,
        CASE WHEN {stripped('text')} = '' THEN '' ELSE
          replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS content,
        CASE WHEN {stripped('text')} = '' THEN 0 ELSE
          CAST(len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)))
          AS BIGINT) END AS lines,
        CAST(len(regexp_extract_all(text, '[^{WS}]+')) AS BIGINT) AS words FROM conversations""",
)
_add(
    "s4_raw_bytes",
    lambda s, d: document_files(s, d).filter(paths.is_capsule_text(F.col("path"))).select(
        *KEY, F.octet_length("content_bytes").cast("long").alias("n_bytes"),
        F.hex("content_bytes").alias("bytes_hex")),
    f"""{FILES} SELECT project_id, path, size_bytes AS n_bytes, hex(encode(raw_text)) AS bytes_hex FROM files
        WHERE {SUFFIX} IN ('.py', '.md', '.json', '.yml', '.js')""",
)

# --- predicates ------------------------------------------------------------------------

_add(
    "p1_visible_files",
    lambda s, d: selection.visible_files(document_files(s, d)).select(*KEY),
    f"""{FILES} SELECT project_id, path FROM files
        WHERE len(list_filter(string_split(path, '/'), lambda x: x LIKE '.%'
          OR x IN ('__pycache__', '.git', '.svn', '.hg')
          OR lower(x) IN ('thumbs.db', 'desktop.ini', '.ds_store'))) = 0""",
)
_add(
    "p2_text_files",
    lambda s, d: document_files(s, d).filter(paths.is_text(F.col("path"))).select(*KEY),
    f"""{FILES} SELECT project_id, path FROM files
        WHERE {SUFFIX} IN ('.py', '.md', '.json', '.yml', '.csv', '.js')
          OR ({SUFFIX} = '' AND lower({NAME}) IN ('readme', 'license', 'changelog', 'makefile', 'dockerfile'))""",
)
_add(
    "p3_size_tiers",
    lambda s, d: selection.size_tiers(document_files(s, d), drop_above=8000, read_limit=3000).select(
        *KEY, "content", "lines", "words", "read_status"),
    f"""{FILES} SELECT project_id, path,
        CASE WHEN size_bytes > 3000 AND content IS NOT NULL THEN '' ELSE content END AS content,
        CASE WHEN size_bytes > 3000 THEN NULL ELSE lines END AS lines,
        CASE WHEN size_bytes > 3000 THEN NULL ELSE words END AS words,
        CASE WHEN size_bytes > 3000 AND content IS NOT NULL THEN 'large' ELSE read_status END AS read_status
        FROM counted WHERE size_bytes <= 8000""",
)
_add(
    "p4_glob_filter",
    lambda s, d: document_files(s, d).filter(paths.glob_selected(
        F.col("path"), ["*.py", "**/tests/*.[jm]*", "e?/src/**"], fixed.EXCLUDE_GLOBS + ["*/d*7.py"])).select(*KEY),
    f"""{FILES} SELECT project_id, path FROM files
        WHERE (regexp_full_match(path, '.*[.]py') OR regexp_full_match(path, '.*/tests/.*[.][jm].*')
            OR regexp_full_match(path, 'e./src/.*'))
          AND NOT (path LIKE '%/.venv/%' OR contains(path, '/__pycache__/') OR contains(path, '/.git/')
            OR regexp_full_match(path, '.*/d.*7[.]py'))""",
)
_add(
    "p5_capsule_text_files",
    lambda s, d: document_files(s, d).filter(paths.is_capsule_text(F.col("path"))).select(*KEY),
    f"""{FILES} SELECT project_id, path FROM files WHERE {SUFFIX} IN ('.py', '.md', '.json', '.txt', '.yml',
        '.yaml', '.toml', '.ini', '.cfg', '.css', '.html', '.js', '.ts')""",
)
_add(
    "p6_content_selection",
    lambda s, d: selection.apply_selection(document_files(s, d), _selection(s, d)).select(
        *KEY, "size_bytes", "content"),
    f"""{FILES} SELECT project_id, path, size_bytes,
        CASE WHEN {_SELECTION} THEN content END AS content FROM files""",
)
_add(
    "p7_files_with_content",
    lambda s, d: selection.with_content(selection.size_tiers(document_files(s, d), read_limit=3000), "present")
    .select(*KEY, (F.col("content") != "").alias("filled")),
    f"""{FILES} SELECT project_id, path, size_bytes <= 3000 AS filled FROM files WHERE content IS NOT NULL""",
)
_add(
    "j1_attach_content",
    lambda s, d: selection.attach_content(
        document_files(s, d).select(*KEY, paths.language(F.col("path"), "engine").alias("language")),
        selection.with_content(document_files(s, d), "filled")),
    f"""{FILES} SELECT project_id, path,
        coalesce(map {{'.py': 'python', '.md': 'markdown', '.json': 'json', '.yml': 'yaml', '.js': 'javascript'}}[
          {SUFFIX}], 'unknown') AS language, content, lines, words FROM counted""",
)
_add(
    "j5_selected_files",
    lambda s, d: selection.selected_files(document_files(s, d), _selection(s, d)).select(*KEY, "size_bytes"),
    f"{FILES} SELECT project_id, path, size_bytes FROM files WHERE {_SELECTION}",
)
_add(
    "j5_excluded_files",
    lambda s, d: selection.without_exclusions(
        document_files(s, d), selection.stored_exclusions(_selection(s, d))).select(*KEY, "size_bytes"),
    f"{FILES} SELECT project_id, path, size_bytes FROM files WHERE coalesce({_SELECTION}, false)",
)

# --- path columns ----------------------------------------------------------------------

_add(
    "c1_path_parts",
    _columns(lambda: paths.name(F.col("path")).alias("name"), lambda: paths.suffix(F.col("path")).alias("suffix"),
             lambda: paths.stem(F.col("path")).alias("stem"), lambda: paths.top_component(F.col("path")).alias("top"),
             lambda: paths.parent(F.col("path")).alias("parent")),
    _sql(f"""{NAME} AS name, {SUFFIX} AS suffix,
        CASE WHEN {SUFFIX} = '' THEN {NAME} ELSE left({NAME}, len({NAME}) - len({SUFFIX})) END AS stem,
        string_split(path, '/')[1] AS top, array_to_string(string_split(path, '/')[:-2], '/') AS parent"""),
)
_add(
    "c2_languages",
    _columns(*(lambda dialect=dialect: paths.language(F.col("path"), dialect).alias(dialect)
               for dialect in ("engine", "deep", "capsule", "content"))),
    _sql(f"""CASE {SUFFIX} WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json'
          WHEN '.yml' THEN 'yaml' WHEN '.js' THEN 'javascript' ELSE 'unknown' END AS engine,
        CASE {SUFFIX} WHEN '.py' THEN 'Python' WHEN '.md' THEN 'Markdown' WHEN '.json' THEN 'JSON'
          WHEN '.yml' THEN 'YAML' WHEN '.js' THEN 'JavaScript/TypeScript' WHEN '.png' THEN 'Image'
          WHEN '.csv' THEN 'csv' ELSE 'file' END AS deep,
        CASE {SUFFIX} WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json'
          WHEN '.yml' THEN 'yaml' WHEN '.js' THEN 'javascript' ELSE 'binary' END AS capsule,
        CASE {SUFFIX} WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json'
          WHEN '.yml' THEN 'yaml' WHEN '.js' THEN 'javascript' ELSE 'text' END AS content"""),
)
_add(
    "c3_section_kind",
    _columns(lambda: paths.section_kind(F.col("path")).alias("kind")),
    _sql(f"""CASE WHEN {SUFFIX} IN ('.json', '.yml') THEN 'config' WHEN {SUFFIX} = '.md' THEN 'docs'
          WHEN lower({NAME}) LIKE 'readme%' THEN 'docs' WHEN {SUFFIX} IN ('.py', '.js') THEN 'code'
          WHEN {SUFFIX} = '.csv' THEN 'data' ELSE 'binary' END AS kind"""),
)
_add(
    "c5_role_from_content",
    _columns(lambda: paths.role_from_content(F.col("path"), F.col("content")).alias("role")),
    _sql(f"""CASE WHEN contains(lower(content), 'tkinter') THEN 'GUI layer'
          WHEN contains(lower(content), 'argparse') OR contains(lower(content), 'click') THEN 'CLI or entrypoint'
          WHEN contains(content, 'class ') AND contains(lower({NAME}), 'test') THEN 'Tests'
          WHEN list_contains(string_split(path, '/'), 'config') THEN 'Configuration'
          WHEN contains(lower(content), 'model') AND contains(content, 'class') THEN 'Domain model' END AS role"""),
)
_add(
    "c6_mime_type",
    _columns(lambda: paths.mime_or_default(F.col("path")).alias("mime")),
    _sql(f"""CASE {SUFFIX} WHEN '.py' THEN 'text/x-python' WHEN '.md' THEN 'text/markdown'
          WHEN '.json' THEN 'application/json' WHEN '.csv' THEN 'text/csv' WHEN '.js' THEN 'text/javascript'
          WHEN '.png' THEN 'image/png' ELSE 'application/octet-stream' END AS mime"""),
)

# --- text columns ----------------------------------------------------------------------

_add(
    "c7_line_word_counts",
    _columns(lambda: text.line_count(F.col("content")).alias("n_lines"), lambda: text.word_count(F.col("content")).alias("n_words"),
             present=True),
    _sql(f"""CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_lines,
        CAST(len(list_filter(string_split_regex(content, '[{WS}]+'), lambda w: w <> '')) AS BIGINT) AS n_words""",
         present=True),
)
_add(
    "c8_sloc",
    _columns(lambda: text.sloc(F.col("content")).alias("sloc"), present=True),
    _sql(f"CAST(len({nonblank_lines()}) AS BIGINT) AS sloc", present=True),
)
_add(
    "c9_markers",
    _columns(lambda: text.comment_markers(F.col("content")).alias("comment_markers"),
             lambda: text.word_markers(F.col("content")).alias("word_markers")),
    _sql(rf"""CAST(coalesce(len(regexp_extract_all(content, '(?i)#[{WS}]*(?:TODO|FIXME|XXX)')), 0) AS BIGINT)
          AS comment_markers,
        CAST(coalesce(len(regexp_extract_all(content, '(?i)\b(?:TODO|FIXME|XXX)\b')), 0) AS BIGINT)
          AS word_markers"""),
)
_add(
    "c10_licence_header",
    _columns(lambda: text.has_licence_header(F.col("content")).alias("licensed")),
    _sql(f"""coalesce(regexp_matches(lower(array_to_string({LINES}[:20], chr(10))), 'license|copyright'), false)
        AS licensed"""),
)
_add(
    "c11_normalised_text",
    lambda s, d: document_files(s, d).filter(paths.is_capsule_text(F.col("path"))).select(
        *KEY, text.normalise_eol(F.decode("content_bytes", "UTF-8")).alias("lf"),
        text.normalise_eol(F.decode("content_bytes", "UTF-8"), "KEEP").alias("kept")),
    f"""{FILES} SELECT project_id, path, rtrim(content, {WS_CHARS}) || chr(10) AS lf, content AS kept FROM files
        WHERE {SUFFIX} IN ('.py', '.md', '.json', '.yml', '.js')""",
)
_add(
    "c12_hashes",
    _columns(lambda: text.content_hash(text.normalise_eol(F.col("content"))).alias("sha256"),
             lambda: paths.path_hash(F.col("path")).alias("path_hash")),
    _sql(f"""sha256(rtrim(content, {WS_CHARS}) || chr(10)) AS sha256, left(sha256(path), 16) AS path_hash"""),
)
_add(
    "c13_preview",
    _columns(lambda: text.preview(F.col("content")).alias("preview")),
    f"""{FILES}, cut AS (
          SELECT project_id, path, content, {LINES} AS parts FROM files
        ), trimmed AS (
          SELECT project_id, path, content, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls FROM cut
        ) SELECT project_id, path, CASE WHEN content IS NULL THEN '' WHEN len(ls) <= 10 THEN content
          ELSE array_to_string(ls[:10], chr(10)) || chr(10) || '... (' || (len(ls) - 10) || ' more lines)' END
          AS preview FROM trimmed""",
)
_add(
    "c14_summary",
    _columns(lambda: _joined(text.summary(F.col("content"), paths.name(F.col("path")), 3), "summary"), present=True),
    _sql(f"array_to_string({nonblank_lines()}[:3], '|') AS summary", present=True),
)
_add(
    "c15_headings",
    _columns(lambda: _joined(text.headings(F.col("content"), 10), "raw_start"),
             lambda: _joined(text.headings(F.col("content"), 10, indented=True), "stripped_start"), present=True),
    _sql(f"""array_to_string(list_transform(list_filter({LINES}, lambda l: starts_with(l, '#'))[:10],
          lambda l: trim(l, '# ')), '|') AS raw_start,
        array_to_string(list_transform(list_filter({LINES}, lambda l: starts_with({stripped('l')}, '#'))[:10],
          lambda l: trim(l, '# ')), '|') AS stripped_start""", present=True),
)
_add(
    "c16_risk",
    _columns(
        lambda: F.round(_risk(), 6).alias("score"), lambda: scores.risk_band(_risk()).alias("band")),
    f"""{FILES}, scored AS (SELECT project_id, path, CASE WHEN path LIKE '%.py' THEN
          lines + len({nonblank_lines()}) / 200.0
          + len(regexp_extract_all(content, '(?i)\\b(?:TODO|FIXME|XXX)\\b')) * 0.5 END AS s FROM counted)
        SELECT project_id, path, round(CAST(s AS DOUBLE), 6) AS score, CASE WHEN s IS NULL THEN 'not-computed'
          WHEN s < 5 THEN 'low' WHEN s < 15 THEN 'medium' ELSE 'high' END AS band FROM scored""",
)
_add(
    "c17_hotspot",
    _columns(lambda: F.round(scores.hotspot(F.col("lines"), text.comment_markers(F.col("content"))), 6).alias("hotspot"),
             present=True),
    _sql(rf"""round(least(CAST(lines * 0.1 + len(regexp_extract_all(content, '(?i)#[{WS}]*(?:TODO|FIXME|XXX)')) * 0.2
        AS DOUBLE), 10.0), 6) AS hotspot""", present=True, source="counted"),
)
_add(
    "c18_module_id",
    _columns(lambda: paths.module_id(F.col("path")).alias("module_id")),
    _sql("replace(array_to_string(string_split(path, '/'), '.'), '.py', '') AS module_id"),
)
_add(
    "c21_config_keys",
    lambda s, d: document_files(s, d).filter(
        paths.suffix(F.col("path")).isin(fixed.KEYED_EXTENSIONS) & F.col("content").isNotNull()).select(
        *KEY, _joined(text.config_keys(F.col("content")), "keys")),
    f"""{FILES} SELECT project_id, path, coalesce(array_to_string(list_sort(list_distinct(
          regexp_extract_all(content, '["'']([A-Za-z0-9_.-]+)["''][{WS}]*[:=]', 1))), '|'), '') AS keys
        FROM files WHERE {SUFFIX} IN ('.json', '.yml')""",
)
_add(
    "c22_short_lines",
    lambda s, d: document_files(s, d).filter((paths.suffix(F.col("path")) != ".py") & F.col("content").isNotNull()).select(
        *KEY, _joined(F.array_sort(text.short_lines(F.col("content"))), "strings")),
    f"""{FILES} SELECT project_id, path, coalesce(array_to_string(list_sort(list_distinct(list_filter(
          {nonblank_lines()}, lambda l: len(l) < 120))), '|'), '') AS strings
        FROM files WHERE content IS NOT NULL AND path NOT LIKE '%.py'""",
)


def _risk():
    """A file's score with its line count standing for complexity, for Python names only."""
    complexity = F.when(paths.suffix(F.col("path")) == ".py", F.col("lines"))
    return scores.risk_score(complexity, text.sloc(F.col("content")), text.word_markers(F.col("content")))


# --- orders and sets -------------------------------------------------------------------

def _ordered(*order):
    """Files in a global order; the neighbours in that order are shown so that it is checked."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators.numbering import number_rows

        keyed = document_files(spark, sf_dir).select(*KEY, *(o().alias(f"_o{i}") for i, o in enumerate(order)))
        numbered = number_rows(keyed, [], [*(f"_o{i}" for i in range(len(order))), "project_id"], "place")
        return numbered.select("place", *KEY)

    return run


_add("o1_case_insensitive_order", _ordered(lambda: F.lower(F.col("path")), lambda: F.col("path")),
     f"""{FILES} SELECT row_number() OVER (ORDER BY lower(path), path, project_id) AS place, project_id, path
         FROM files""")
_add("o2_section_order", _ordered(lambda: paths.section_kind(F.col("path")), lambda: F.col("path")),
     f"""{FILES} SELECT row_number() OVER (ORDER BY CASE WHEN {SUFFIX} IN ('.json', '.yml') THEN 'config'
          WHEN {SUFFIX} = '.md' OR {NAME} = 'README' THEN 'docs' WHEN {SUFFIX} IN ('.py', '.js') THEN 'code'
          WHEN {SUFFIX} = '.csv' THEN 'data' ELSE 'binary' END, path, project_id) AS place, project_id, path
         FROM files""")
_add("o3_component_order", _ordered(lambda: paths.components(F.col("path"))),
     f"""{FILES} SELECT row_number() OVER (ORDER BY string_split(path, '/'), project_id) AS place,
         project_id, path FROM files""")
_add(
    "u1_extension_union",
    lambda s, d: document_files(s, d).select(paths.suffix(F.col("path")).alias("ext")).unionByName(
        page_files(s, d).select(paths.suffix(F.col("path")).alias("ext"))).distinct(),
    f"""{FILES} SELECT {SUFFIX} AS ext FROM files UNION SELECT '.html' FROM pages""",
)
_add(
    "u2_distinct_sets",
    lambda s, d: document_files(s, d).filter(F.col("content").isNotNull()).select(
        *KEY, _joined(F.array_sort(F.array_distinct(F.regexp_extract_all(
            F.col("content"), F.lit(fixed.CAPSULE_WORD), F.lit(0)))), "words")),
    f"""{FILES} SELECT project_id, path, coalesce(array_to_string(list_sort(list_distinct(
          regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{{3,}}'))), '|'), '') AS words
        FROM files WHERE content IS NOT NULL""",
)
