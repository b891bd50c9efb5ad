"""Registered sources, sinks, recovery, packing and composed exports (S and K rows)."""
from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import packing, symbols
from ..plans import bundle, capsule, corpus, exports
from ..session import checkpoint_folder
from ..sources import documents, dumps, recovery
from ..sources.listing import list_tree, read_listed
from ..sources.pyfacts import python_facts
from ..sources.tables import document_files, part_sources
from ..sources.tree import read_tree
from .code import PARTS
from .columns import KEY
from .rollups import _SECTIONS, _TREE
from .sql import FILES, LINES, SUFFIX, WS, WS_CHARS, nonblank_lines

QUERIES = {}
ORACLES = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- directory trees -------------------------------------------------------------------


def _tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of the given tables, scanned as a project of files."""
    return read_tree(spark, path=sf_dir, digest="true", content="false").select(*KEY, "size_bytes", "read_status", "sha256")


def _written_tree(spark: SparkSession, sf_dir: str) -> str:
    """Documents written as text files by Spark, a folder each source."""
    folder = f"{checkpoint_folder(spark)}/tree-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select("source", text.unify_newlines(F.col("text")).alias("text")).write.partitionBy("source").text(folder)
    return folder.removeprefix("file:")


def _tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of some folders of a tree, from names and sizes alone."""
    found = list_tree(spark, path=_written_tree(spark, sf_dir)).filter(F.col("path").startswith("source=src1") & (F.col("size_bytes") > 0))
    return found.groupBy(F.regexp_extract("path", r"^source=([^/]+)/", 1).alias("project_id")).agg(
        F.sum("size_bytes").alias("size_bytes"), F.count_if(F.col("read_status") != "listed").alias("n_read"))


def _listed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the files that a listing's filter left."""
    root = _written_tree(spark, sf_dir)
    listing = list_tree(spark, roots=f"t={root}").filter(F.col("path").startswith("source=src2"))
    return read_listed(listing, {"t": root}, with_content=False).groupBy(F.regexp_extract("path", r"^source=([^/]+)/", 1).alias("project_id")).agg(
        F.sum("words").alias("words"), F.sum("size_bytes").alias("size_bytes"))


def _tree_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files by Spark, then read back from the tree and counted."""
    tree = read_tree(spark, path=_written_tree(spark, sf_dir), content="false").filter(F.col("read_status") == "ok")
    source = F.regexp_extract("path", r"^source=([^/]+)/", 1)
    return tree.groupBy(source.alias("project_id")).agg(
        F.sum("words").alias("words"), F.sum("size_bytes").alias("size_bytes"),
        (F.sum("lines") - F.count("*")).alias("line_feeds"))


_BYTES = "CAST(sum(strlen(replace(text, chr(13) || chr(10), chr(10))) + 1) AS BIGINT) AS size_bytes"

_add("s1_tree_scan", _tree_scan, None)
_add(
    "s1_tree_listing", _tree_listing,
    f"SELECT source AS project_id, {_BYTES}, CAST(0 AS BIGINT) AS n_read FROM documents WHERE source LIKE 'src1%' GROUP BY source",
)
_add(
    "s2_listed_read", _listed_read,
    rf"""SELECT source AS project_id, CAST(sum(len(regexp_extract_all(text, '[^{WS}]+'))) AS BIGINT) AS words, {_BYTES}
        FROM documents WHERE source LIKE 'src2%' GROUP BY source""",
)
_add(
    "s2_tree_read", _tree_read,
    rf"""SELECT source AS project_id, CAST(sum(len(regexp_extract_all(text, '[^{WS}]+'))) AS BIGINT) AS words,
        CAST(sum(strlen(replace(text, chr(13) || chr(10), chr(10))) + 1) AS BIGINT) AS size_bytes,
        CAST(sum(len(string_split(replace(text, chr(13), ''), chr(10)))) AS BIGINT) AS line_feeds
        FROM documents GROUP BY source""",
)

# --- dump writers ----------------------------------------------------------------------

_SIZE = """CASE WHEN size_bytes < 1024 THEN format('{:.1f} B', CAST(size_bytes AS DOUBLE))
    WHEN size_bytes < 1048576 THEN format('{:.1f} KB', size_bytes / 1024.0::DOUBLE)
    ELSE format('{:.1f} MB', size_bytes / 1048576.0::DOUBLE) END"""
_STAMP = "printf('2024-01-%02d 09:30', CAST(day AS INTEGER))"
_TOTALS = """totals AS (
          SELECT project_id, count(*) AS nf, count(content) AS nt, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
            CAST(coalesce(sum(lines), 0) AS BIGINT) AS nl, CAST(coalesce(sum(words), 0) AS BIGINT) AS nw
          FROM counted GROUP BY project_id
        )"""
_NL = "chr(10)"
_FENCE_EXT = f"CASE WHEN {SUFFIX} = '' THEN 'text' ELSE substr({SUFFIX}, 2) END"
_MD_BLOCK = f"""'### 📄 `' || path || '`' || {_NL} || {_NL} || '**Size:** ' || {{size}} || ' | **Lines:** ' || lines
    || ' | **Words:** ' || words || ' | **Modified:** ' || {_STAMP} || {_NL} || {_NL} || '```' || {_FENCE_EXT}
    || {_NL} || trim(content, {WS_CHARS}) || {_NL} || '```' || {_NL}"""


def _parts(build):
    return lambda s, d: build(document_files(s, d)).select("project_id", "section", "path", "block")


_add(
    "s6_markdown_dump", _parts(dumps.markdown_dump),
    f"""{FILES}, {_TOTALS} SELECT project_id, 0 AS section, '' AS path,
          '# Project Structure: ' || project_id || {_NL} || {_NL}
          || '⚠️ **Note:** This report includes complete source code content and can be used for project recovery.'
          || {_NL} || {_NL} || '## 📊 Summary' || {_NL} || {_NL} || '- **Total Files:** ' || format('{{:,}}', nf)
          || {_NL} || '- **Text Files:** ' || format('{{:,}}', nt) || {_NL} || '- **Total Size:** ' || {_SIZE} || {_NL}
          || '- **Total Lines:** ' || format('{{:,}}', nl) || {_NL} || '- **Total Words:** ' || format('{{:,}}', nw)
          || {_NL} || {_NL} || '---' || {_NL} || {_NL} || '## 📄 File Contents' || {_NL} AS block FROM totals
        UNION ALL SELECT project_id, 1, path, {_MD_BLOCK.format(size='(' + _SIZE + ')')}
        FROM counted WHERE content IS NOT NULL""",
)
_add(
    "s6_plain_markdown", _parts(dumps.plain_markdown_blocks),
    f"""{FILES} SELECT project_id, 1 AS section, path,
        {_MD_BLOCK.format(size="(size_bytes // 1024) || ' KB'")} AS block
        FROM counted WHERE content IS NOT NULL""",
)
_add(
    "s7_plaintext_dump", _parts(dumps.plaintext_dump),
    f"""{FILES}, {_TOTALS}, cut AS (SELECT *, {LINES} AS parts FROM counted WHERE content IS NOT NULL)
        SELECT project_id, 0 AS section, '' AS path, repeat('=', 60) || {_NL} || 'PROJECT STRUCTURE REPORT' || {_NL}
          || repeat('=', 60) || {_NL} || 'Project: ' || project_id || {_NL} || {_NL} || 'SUMMARY:' || {_NL}
          || '  Total Files: ' || format('{{:,}}', nf) || {_NL} || '  Text Files: ' || format('{{:,}}', nt) || {_NL}
          || '  Total Size: ' || (size_bytes // 1024) || ' KB' || {_NL} || {_NL} || repeat('=', 60) || {_NL}
          || 'FILE CONTENTS' || {_NL} || repeat('=', 60) AS block FROM totals
        UNION ALL SELECT project_id, 1, path, {_NL} || '--- ' || path || ' ---' || {_NL} || 'Size: '
          || (size_bytes // 1024) || ' KB | Lines: ' || lines || ' | Words: ' || words || {_NL} || 'Modified: '
          || {_STAMP} || {_NL} || repeat('-', 40) || {_NL} || array_to_string(list_transform(
            CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END, lambda l: rtrim(l, {WS_CHARS})), {_NL})
        FROM cut""",
)
_LANG = f"""CASE {SUFFIX} WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json'
    WHEN '.yml' THEN 'yaml' WHEN '.js' THEN 'javascript' ELSE 'text' END"""


def _full_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON dump read back field by field, so that the text of the JSON is checked as data."""
    entry = ("path string, size_bytes bigint, lines string, words string, mtime_iso string, language string, "
             "content string, has_content boolean, content_preview string, encoding string")
    parts = dumps.full_json_dump(document_files(spark, sf_dir)).filter("section = 1")
    return parts.select("project_id", F.from_json("block", entry).alias("f")).select("project_id", "f.*")


_PREVIEW = f"""CASE WHEN content IS NULL THEN NULL WHEN len(ls) <= 10 THEN content
    ELSE array_to_string(ls[:10], {_NL}) || {_NL} || '... (' || (len(ls) - 10) || ' more lines)' END"""
_add(
    "s5_full_content_json", _full_json_rows,
    f"""{FILES}, cut AS (SELECT *, {LINES} AS parts FROM counted),
        trimmed AS (SELECT *, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls FROM cut)
        SELECT project_id, path, size_bytes, coalesce(CAST(lines AS VARCHAR), '?') AS lines,
          coalesce(CAST(words AS VARCHAR), '?') AS words, {_STAMP} AS mtime_iso, {_LANG} AS language, content,
          content IS NOT NULL AS has_content, {_PREVIEW} AS content_preview,
          CASE WHEN content IS NOT NULL THEN 'utf-8' END AS encoding FROM trimmed""",
)


def _json_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.full_json_dump(document_files(spark, sf_dir)).filter("section = 0").select("project_id", "block")


_add(
    "s5_json_summary", _json_heads,
    f"""{FILES}, {_TOTALS} SELECT project_id, '{{"format":"full-content-json","format_version":"1.0","root":"'
          || project_id || '","total_files":' || nf || ',"text_files":' || nt || ',"total_size_bytes":' || size_bytes
          || ',"total_lines":' || nl || ',"total_words":' || nw || '}}' AS block FROM totals""",
)


def _plain_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = "path string, size_bytes bigint, mtime_iso string, lines string, words string, content string"
    parts = dumps.plain_json_dump(document_files(spark, sf_dir), include_contents=False).filter("section = 1")
    return parts.select("project_id", F.from_json("block", entry).alias("f")).select("project_id", "f.*")


_add(
    "s5_plain_json", _plain_json,
    f"""{FILES} SELECT project_id, path, size_bytes, {_STAMP} AS mtime_iso,
        coalesce(CAST(lines AS VARCHAR), '?') AS lines, coalesce(CAST(words AS VARCHAR), '?') AS words,
        CAST(NULL AS VARCHAR) AS content FROM counted""",
)


def _analysis(spark: SparkSession, sf_dir: str, documents: bool = False) -> tuple[DataFrame, DataFrame]:
    files = part_sources(spark, sf_dir)
    if documents:
        files = files.unionByName(document_files(spark, sf_dir))
    return files, symbols.engine_analysis(files, python_facts(files))


def _analysis_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, analysis = _analysis(spark, sf_dir)
    entry = ("path string, language string, size_bytes bigint, sloc bigint, imports array<string>, "
             "functions array<struct<name:string,signature:string>>, cyclomatic int, todo_count bigint, "
             "hotspot double, responsibility string, content string")
    f = F.from_json("block", entry).alias("f")
    return dumps.analysis_json(analysis, files).select("project_id", f).select(
        "project_id", "f.path", "f.language", "f.sloc", F.array_join("f.imports", "|").alias("imports"),
        F.array_join("f.functions.signature", "|").alias("functions"), "f.cyclomatic", "f.todo_count",
        F.round("f.hotspot", 6).alias("hotspot"), "f.responsibility",
        (F.octet_length("f.content") - F.col("f.size_bytes")).alias("gap"))


_SOURCE_LINES = "(40 + 2 * e + CASE WHEN ok THEN 1 ELSE 2 END)"
_add(
    "s5_basic_json", _analysis_json,
    f"""WITH {PARTS} SELECT project_id, path, 'python' AS language, CAST({_SOURCE_LINES} AS BIGINT) AS sloc,
        CASE WHEN ok THEN array_to_string(['os', 'lib' || k % 7 || '.sub', 'pkg', ''], '|') ELSE '' END AS imports,
        CASE WHEN ok THEN 'f' || k || '(p: str, q)|test_f' || k || '()|run(self, a: int)|async wait(y: str, *args, **kw)'
          ELSE '' END AS functions, CASE WHEN ok THEN 7 + e ELSE 0 END AS cyclomatic,
        CAST(CASE WHEN ok THEN e ELSE 0 END AS BIGINT) AS todo_count,
        CASE WHEN ok THEN round(CAST((7 + e) * 0.1 + e * 0.2 AS DOUBLE), 6) ELSE 0.0 END AS hotspot,
        CASE WHEN ok THEN 'Module integration' ELSE 'Core logic' END AS responsibility,
        CAST(0 AS BIGINT) AS gap FROM parts""",
)


def _analysis_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, analysis = _analysis(spark, sf_dir)
    size_line = r"(?m)^- \*\*Size:\*\* .*$\n"
    return dumps.analysis_markdown(analysis).select(
        "project_id", "path", F.regexp_replace("block", size_line, "").alias("block"))


_add(
    "s6_analysis_markdown", _analysis_markdown,
    f"""WITH {PARTS}, shown AS (SELECT *, '### 📄 ' || path || {_NL} || {_NL} || '- **Language:** python' || {_NL}
          || '- **Lines:** ' || {_SOURCE_LINES} || {_NL} || '- **Purpose:** '
          || CASE WHEN ok THEN 'Module integration' ELSE 'Core logic' END || {_NL} AS head FROM parts)
        SELECT project_id, path, CASE WHEN NOT ok THEN head ELSE head || {_NL} || array_to_string([
          '**Imports:**', '', '*External:*', '- ``', '- `lib' || k % 7 || '.sub`', '- `os`', '- `pkg`', '',
          '**Classes:**', '', '| Class | Bases | Methods | Description |', '|-------|-------|---------|-------------|',
          '| `C' || k || '` | `Base' || k % 4 || ', Frame` | 2 methods | Class ' || k || '. |', '',
          '**Functions:**', '', '| Function | Returns | Description |', '|----------|---------|-------------|',
          '| `f' || k || '(p: str, q)` | `—` | Makes ' || p_name || '. |', '| `test_f' || k || '()` | `—` | — |',
          '| `run(self, a: int)` | `bool` | — |', '| `async wait(y: str, *args, **kw)` | `—` | — |', '',
          '**Tests:**', '', '- `' || path || '::test_f' || k || '`', '',
          '**Complexity:**', '', '- Cyclomatic complexity: ' || (7 + e)], {_NL})
          || CASE WHEN e > 0 THEN {_NL} || '- TODO items: ' || e ELSE '' END
          || {_NL} || '- Hotspot score: ' || format('{{:.2f}}', CAST((7 + e) * 0.1 + e * 0.2 AS DOUBLE)) || {_NL} END
          || {_NL} || '---' || {_NL} AS block FROM shown""",
)

# --- recovery --------------------------------------------------------------------------


def _dump_documents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Small dump documents of four files each, as (dump_id, file_name, text)."""
    files = document_files(spark, sf_dir).filter(F.col("content").isNotNull())
    number = F.regexp_extract("path", r"/d(\d+)[./][^/]*$", 1).try_cast("long")
    dump_id = F.call_function("div", number, F.lit(4))
    if kind == "json":
        entry = F.struct("path", "content", F.lit(True).alias("has_content"))
        body = files.select(dump_id.alias("dump_id"), entry.alias("entry")).groupBy("dump_id").agg(
            F.to_json(F.struct(F.lit("full-content-json").alias("format"), F.lit("/srv/proj").alias("root"),
                               F.collect_list("entry").alias("files"))).alias("text"))
    else:
        blocks = dumps.markdown_dump if kind == "md" else dumps.html_blocks
        shown = blocks(files).filter("section = 1").select(dump_id.alias("dump_id"), "path", "block")
        title = (F.concat(F.lit("# Project Structure: dump "), F.col("dump_id").cast("string"),
                          F.lit(f"\n\n{recovery.MARKDOWN_MARK}\n"))
                 if kind == "md" else
                 F.concat(F.lit("<!DOCTYPE html>\n<html><title>Project Structure: dump "),
                          F.col("dump_id").cast("string"), F.lit("</title><body>")))
        ordered = F.array_sort(F.collect_list(F.struct("path", "block")))
        body = shown.groupBy("dump_id").agg(ordered.alias("b")).select(
            "dump_id", F.concat_ws("\n", title, F.array_join("b.block", "\n")).alias("text"))
    return body.select("dump_id", F.concat(F.lit("export_"), F.col("dump_id").cast("string"), F.lit("." + kind))
                       .alias("file_name"), "text")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dump per id, in a format chosen by the id; some under a name that hides the format."""
    chosen = F.col("dump_id") % 4
    names = {"md": 0, "html": 1, "json": 2}
    tables = [_dump_documents(spark, sf_dir, kind).filter(chosen == i) for kind, i in names.items()]
    hidden = _dump_documents(spark, sf_dir, "md").filter(chosen == 3).withColumn(
        "file_name", F.replace("file_name", F.lit(".md"), F.lit(".txt")))
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(hidden)


_DUMPED = f"{FILES}, dumped AS (SELECT *, CAST(regexp_extract(path, '/d([0-9]+)', 1) AS BIGINT) // 4 AS dump_id FROM files WHERE content IS NOT NULL)"
_RTRIM = f"rtrim(content, {WS_CHARS}) || chr(10)"

_add(
    "s10_recover_json",
    lambda s, d: recovery.recovered_files(recovery.from_json(_dump_documents(s, d, "json")), "json"),
    f"{_DUMPED} SELECT dump_id, path, content FROM dumped",
)
_add(
    "s11_recover_markdown",
    lambda s, d: recovery.recovered_files(recovery.from_markdown(_dump_documents(s, d, "md"), "strict"), "full"),
    f"{_DUMPED} SELECT dump_id, path, trim(content, {WS_CHARS}) || chr(10) AS content FROM dumped",
)
_add(
    "s11_recover_markdown_lenient",
    lambda s, d: recovery.recovered_files(recovery.from_markdown(_dump_documents(s, d, "md"), "lenient"), "plain"),
    f"{_DUMPED} SELECT dump_id, path, trim(content, {WS_CHARS}) || chr(10) AS content FROM dumped",
)
_add(
    "s12_recover_html",
    lambda s, d: recovery.recovered_files(recovery.from_html(_dump_documents(s, d, "html")), "full"),
    f"{_DUMPED} SELECT dump_id, path, chr(10) || {_RTRIM} AS content FROM dumped",
)
_KIND = """CASE dump_id % 4 WHEN 0 THEN 'full-content-markdown' WHEN 1 THEN 'legacy-html'
    WHEN 2 THEN 'full-content-json' ELSE 'unknown' END"""
_add(
    "s13_detected_format",
    lambda s, d: _mixed(s, d).select(
        "dump_id", "file_name", recovery.detected_format(F.col("file_name"), F.col("text")).alias("format"),
        recovery.looks_like_html(F.col("text")).alias("html")),
    f"""{_DUMPED} SELECT DISTINCT dump_id, 'export_' || dump_id || (['.md', '.html', '.json', '.txt'])[dump_id % 4 + 1]
        AS file_name, {_KIND} AS format, dump_id % 4 = 1 AS html FROM dumped""",
)
_add(
    "s14_project_name",
    lambda s, d: _mixed(s, d).select("dump_id", recovery.project_name(F.col("text")).alias("project")),
    f"""{_DUMPED} SELECT DISTINCT dump_id, CASE dump_id % 4 WHEN 2 THEN 'proj' ELSE 'dump ' || dump_id END AS project
        FROM dumped""",
)
_add(
    "s15_recovered_files",
    lambda s, d: recovery.recovered(_mixed(s, d)),
    f"""{_DUMPED} SELECT dump_id, path, CASE dump_id % 4 WHEN 0 THEN trim(content, {WS_CHARS}) || chr(10)
          WHEN 1 THEN chr(10) || {_RTRIM} ELSE content END AS content FROM dumped WHERE dump_id % 4 < 3""",
)

# --- whole documents out and back ------------------------------------------------------


def _round_trip(form: str):
    return lambda s, d: documents.round_trip(document_files(s, d), form)


_add("s10_round_trip", _round_trip("full-content-json"), f"{FILES} SELECT project_id, path, content FROM files WHERE content <> ''")
_add(
    "s11_round_trip", _round_trip("full-content-markdown"),
    f"{FILES} SELECT project_id, path, trim(content, {WS_CHARS}) || chr(10) AS content FROM files WHERE content IS NOT NULL",
)
_add(
    "s12_round_trip", _round_trip("legacy-html"),
    f"{FILES} SELECT project_id, path, chr(10) || {_RTRIM} AS content FROM files WHERE content IS NOT NULL",
)

# --- bundle, packing, capsule, corpus --------------------------------------------------


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    return bundle.bundle(files, [*bundle.FORMATS, "no-such-format"]).groupBy(
        "project_id", "format", "mime_type", "llm_friendly", "lossless").agg(F.count("*").alias("n_parts"))


_add(
    "s16_bundle", _bundle,
    f"""{FILES}, formats AS (SELECT * FROM (VALUES
          ('llm-tds', 'application/json', true, false), ('basic-json', 'application/json', false, true),
          ('basic-markdown', 'text/markdown', true, true), ('full-content-json', 'application/json', false, true),
          ('full-content-markdown', 'text/markdown', true, true), ('legacy-html', 'text/html', false, true),
          ('lrc-capsule', 'application/json', true, false)) t(format, mime_type, llm_friendly, lossless)
        ), sizes AS (SELECT project_id, format, mime_type, llm_friendly, lossless, CASE
            WHEN format IN ('llm-tds', 'full-content-json') THEN count(*) + 1
            WHEN format LIKE 'basic-%' THEN count(*)
            WHEN format = 'full-content-markdown' THEN count(content) + 1
            WHEN format = 'legacy-html' THEN count(content)
            ELSE count(*) FILTER (WHERE {SUFFIX} IN ('.py', '.md', '.json', '.yml', '.js')
              AND NOT contains(path, '/.git/') AND NOT contains(path, '/__pycache__/')) END AS n_parts
        FROM files, formats GROUP BY project_id, format, mime_type, llm_friendly, lossless)
        SELECT * FROM sizes WHERE n_parts > 0""",
)
_add(
    "k1_packed_files",
    lambda s, d: packing.verified(packing.packed_files(document_files(s, d), "zstd_b64"), "zstd_b64").select(
        *KEY, "sha256", "intact"),
    f"{FILES} SELECT project_id, path, sha256(raw_text) AS sha256, true AS intact FROM files",
)
_add(
    "k1_plain_payloads",
    lambda s, d: packing.packed_files(document_files(s, d), "none").select(*KEY, "size_bytes", "payload"),
    f"""{FILES} SELECT project_id, path, size_bytes,
        to_base64(encode(raw_text)) AS payload FROM files""",
)


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of odd size lose their last byte; the check must report exactly those."""
    payloads = packing.packed_files(document_files(spark, sf_dir), "none")
    data = F.unbase64("payload")
    cut = F.when(F.col("size_bytes") % 2 == 1, F.substring(data, F.lit(1), (F.col("size_bytes") - 1).cast("int"))).otherwise(data)
    return packing.mismatches(payloads.withColumn("payload", F.base64(cut)), "none").select(*KEY, "sha256")


_add(
    "k2_mismatches", _damaged,
    f"{FILES} SELECT project_id, path, sha256(raw_text) AS sha256 FROM files WHERE size_bytes % 2 = 1",
)
_CAPSULE_FILES = _SECTIONS.replace(
    f"WHERE {SUFFIX} IN", f"WHERE NOT contains(path, '/.git/') AND NOT contains(path, '/__pycache__/') AND {SUFFIX} IN")


def _compact_capsule(spark: SparkSession, sf_dir: str) -> capsule.Capsule:
    """The compact preset without its size cut, so that files of any size are sections."""
    return capsule.Capsule(document_files(spark, sf_dir), replace(capsule.CapsuleOptions().compact(), max_file_size=None))


def _capsule_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _compact_capsule(spark, sf_dir)
    return made.sections.join(made.roots, "project_id").join(made.fingerprints, "project_id").select(
        "project_id", "section_id", "kind", "path", "language", "mime", "size_bytes", "sha256", "root", "fingerprint")


_add(
    "k3_capsule_sections", _capsule_sections,
    f"""{_TREE.replace(_SECTIONS.replace('WITH stored', 'WITH RECURSIVE stored', 1),
                       _CAPSULE_FILES.replace('WITH stored', 'WITH RECURSIVE stored', 1))}
        SELECT n.project_id, printf('sec-%04d', CAST(number AS INTEGER)) AS section_id, kind, n.path,
          CASE regexp_extract(n.path, '[.][a-z]+$') WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown'
            WHEN '.json' THEN 'json' WHEN '.yml' THEN 'yaml' ELSE 'javascript' END AS language,
          CASE regexp_extract(n.path, '[.][a-z]+$') WHEN '.py' THEN 'text/x-python' WHEN '.md' THEN 'text/markdown'
            WHEN '.json' THEN 'application/json' WHEN '.yml' THEN 'application/octet-stream' ELSE 'text/javascript' END
            AS mime, f.size_bytes, n.hash AS sha256, r.hash AS root, p.fingerprint
        FROM numbered n JOIN files f ON f.project_id = n.project_id AND f.path = n.path
        JOIN levels r ON r.project_id = n.project_id AND r.width = 1
        JOIN (SELECT m.project_id, sha256(string_agg(m.path || '::' || g.size_bytes, ''
                ORDER BY string_split(m.path, '/'))) AS fingerprint
              FROM numbered m JOIN files g ON g.project_id = m.project_id AND g.path = m.path
              GROUP BY m.project_id) p ON p.project_id = n.project_id""",
)
_add(
    "k3_capsule_summary",
    lambda s, d: _compact_capsule(s, d).summary.select(
        "project_id", "files", "bytes", F.array_join("highlights", "|").alias("highlights")),
    f"""{_CAPSULE_FILES}, joined AS (
          SELECT n.project_id, n.path, f.size_bytes, CASE regexp_extract(n.path, '[.][a-z]+$') WHEN '.py' THEN 'python'
            WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json' WHEN '.yml' THEN 'yaml' ELSE 'javascript' END AS lang
          FROM numbered n JOIN files f ON f.project_id = n.project_id AND f.path = n.path
        ), langs AS (SELECT project_id, lang, count(*) AS n, min(path) AS first_path FROM joined GROUP BY ALL),
        top AS (SELECT project_id, first(lang ORDER BY n DESC, first_path) AS lang, count(*) AS n_langs
          FROM langs GROUP BY project_id)
        SELECT j.project_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes,
          'Captured ' || count(*) || ' files across ' || any_value(n_langs) || ' languages|Dominant language: '
          || any_value(t.lang) AS highlights
        FROM joined j JOIN top t USING (project_id) GROUP BY j.project_id""",
)
_add(
    "k3_capsule_layers",
    lambda s, d: _compact_capsule(s, d).layers.select(
        *KEY, F.array_join("summary", "|").alias("summary"), F.array_join("headings", "|").alias("headings"),
        "outline_codec"),
    f"""{_CAPSULE_FILES} SELECT n.project_id, n.path,
          array_to_string({nonblank_lines('content')}[:2], '|') AS summary,
          CASE WHEN n.path LIKE '%.py' THEN '' ELSE array_to_string(list_transform(list_filter({LINES},
            lambda l: starts_with(l, '#'))[:5], lambda l: trim(l, '# ')), '|') END AS headings,
          'text_norm_v1' AS outline_codec
        FROM numbered n JOIN files f ON f.project_id = n.project_id AND f.path = n.path""",
)
_SEGMENT = """'File: ' || path || ' Language: python Purpose: ' || CASE WHEN NOT ok THEN 'Core logic' ELSE
    'Module integration Import: os Import: lib' || k % 7 || '.sub Import: pkg Import:  Class: C' || k || ' Class ' || k
    || '. Method: run Method: wait Function: f' || k || '(p: str, q) Makes ' || p_name || '. Function: test_f' || k
    || '() Function: run(self, a: int) Function: async wait(y: str, *args, **kw)' END"""
_SEGMENTS = f"""WITH {PARTS}, segments AS (
          SELECT DISTINCT project_id, 0 AS section, '' AS place, '' AS path, 'Project: ' || project_id AS content FROM parts
          UNION ALL SELECT project_id, 1, lower(path), path, {_SEGMENT} FROM parts
        )"""
_add(
    "c23_corpus_segments",
    lambda s, d: corpus.corpus_segments(_analysis(s, d)[1]),
    f"{_SEGMENTS} SELECT * FROM segments",
)
_CORPUS = rf"""{_SEGMENTS}, hits AS (
          SELECT project_id, (section, place, path) AS file, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (
            SELECT project_id, section, place, path,
              regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS w FROM segments)
        ), dictionary AS (
          SELECT project_id, word, CAST(row_number() OVER (PARTITION BY project_id ORDER BY n DESC, first_at) AS INTEGER)
            AS rank FROM (SELECT project_id, word, count(*) AS n, min((file, pos)) AS first_at FROM hits GROUP BY ALL)
          QUALIFY rank <= 256
        ), runs AS (
          SELECT project_id, section, path, unnest(r) AS run, unnest(range(len(r))) AS pos FROM (
            SELECT project_id, section, path, regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS r
            FROM segments)
        )"""
_add(
    "k4_corpus_document",
    lambda s, d: corpus.corpus_document(_analysis(s, d)[1])[1].select("project_id", "section", "path", "payload"),
    f"""{_CORPUS} SELECT r.project_id, section, path, string_agg(CASE WHEN d.rank IS NULL THEN run
          ELSE chr(167) || d.rank END, '' ORDER BY pos) AS payload
        FROM runs r LEFT JOIN dictionary d ON d.project_id = r.project_id AND d.word = r.run
        GROUP BY r.project_id, section, path""",
)
_add(
    "k4_corpus_dictionary",
    lambda s, d: corpus.corpus_document(_analysis(s, d)[1])[0].select("project_id", "rank", "word"),
    f"{_CORPUS} SELECT project_id, rank, word FROM dictionary",
)

# --- compressed exports out and back ---------------------------------------------------


def _written(spark: SparkSession, parts: DataFrame) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/export-{uuid.uuid4().hex}"
    dumps.write_dump(parts, folder)
    return documents.dump_lines(spark, folder)


def _tds_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.tds_texts(_written(spark, exports.tds_document(_analysis(spark, sf_dir)[1])))


_add(
    "s16_tds_decoded", _tds_round_trip,
    f"{_SEGMENTS} SELECT project_id, path, content FROM segments",
)


def _capsule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, exports.capsule_document(_compact_capsule(spark, sf_dir)))


def _capsule_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exports.capsule_sections(_capsule_lines(spark, sf_dir))
    spelt = F.col("data").cast("string").rlike("§[0-9]")
    return found.select(*KEY, "section_id", F.sha2("data", 256).alias("raw_sha256"), "sha256", (F.col("intact") | spelt).alias("decoded"))


_add(
    "k3_capsule_decoded", _capsule_decoded,
    f"""{_CAPSULE_FILES} SELECT n.project_id, n.path, printf('sec-%04d', CAST(number AS INTEGER)) AS section_id, sha256(raw_text) AS raw_sha256,
        n.hash AS sha256, true AS decoded FROM numbered n JOIN files f ON f.project_id = n.project_id AND f.path = n.path""",
)
_add(
    "k3_capsule_tree", lambda s, d: exports.capsule_tree(_capsule_lines(s, d)).select("project_id", "level", F.col("index").alias("idx"), "hash"),
    f"""{_TREE.replace(_SECTIONS.replace('WITH stored', 'WITH RECURSIVE stored', 1),
                       _CAPSULE_FILES.replace('WITH stored', 'WITH RECURSIVE stored', 1))}
        SELECT project_id, CAST(level AS INTEGER) AS level, CAST(idx AS BIGINT) AS idx, hash FROM levels WHERE level > 0""",
)
