"""Dump writers: a project's report as ordered parts.

A report is never one string: it is the rows of a (project_id, section, place, path, block)
table, whose blocks joined by line feeds in that order give the document. ``write_dump`` keeps
that order across as many output files as the data needs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, text
from ..operators import totals
from ..operators.joins import wide_join

ORDER = ["project_id", "section", "place", "path"]


def _counter(name: str) -> Column:
    """A counter as shown: its number, or the status of a file that was not counted."""
    return F.coalesce(F.col(name).cast("string"),
                      F.when(F.col("read_status") == "not_text", "?").otherwise(F.col("read_status")))


def _modified() -> Column:
    return F.coalesce(F.date_format("mtime", "yyyy-MM-dd HH:mm"), F.lit("?"))


def _joined(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _parts(files: DataFrame, block: Column, place: Column | None = None) -> DataFrame:
    path = F.col("path")
    return files.select("project_id", F.lit(1).alias("section"),
                        (F.lower(path) if place is None else place).alias("place"), "path", block.alias("block"))


def _head(sums: DataFrame, block: Column) -> DataFrame:
    return sums.select("project_id", F.lit(0).alias("section"), F.lit("").alias("place"),
                       F.lit("").alias("path"), block.alias("block"))


def _number(name: str) -> Column:
    return F.format_number(F.col(name), 0)


# --- Markdown --------------------------------------------------------------------------

def markdown_block(size: Column) -> Column:
    """A file's heading, facts and fenced content, then an empty line."""
    ext = F.ltrim(paths.suffix(F.col("path")), F.lit("."))
    meta = F.concat(F.lit("**Size:** "), size, F.lit(" | **Lines:** "), _counter("lines"),
                    F.lit(" | **Words:** "), _counter("words"), F.lit(" | **Modified:** "), _modified())
    return _joined(
        F.concat(F.lit("### 📄 `"), "path", F.lit("`")), F.lit(""), meta, F.lit(""),
        F.concat(F.lit("```"), F.when(ext == "", "text").otherwise(ext)),
        text.strip(F.col("content")), F.lit("```"), F.lit(""))


def markdown_dump(files: DataFrame) -> DataFrame:
    note = "⚠️ **Note:** This report includes complete source code content and can be used for project recovery."
    head = _joined(
        F.concat(F.lit("# Project Structure: "), "project_id"), F.lit(""), F.lit(note), F.lit(""),
        F.lit("## 📊 Summary"), F.lit(""),
        F.concat(F.lit("- **Total Files:** "), _number("total_files")),
        F.concat(F.lit("- **Text Files:** "), _number("text_files")),
        F.concat(F.lit("- **Total Size:** "), text.file_size(F.col("total_size_bytes"))),
        F.concat(F.lit("- **Total Lines:** "), _number("total_lines")),
        F.concat(F.lit("- **Total Words:** "), _number("total_words")),
        F.lit("\n---\n"), F.lit("## 📄 File Contents\n"))
    shown = files.filter(F.col("content").isNotNull())
    return _head(totals.project_totals(files), head).unionByName(
        _parts(shown, markdown_block(text.file_size(F.col("size_bytes")))))


def plain_markdown_blocks(files: DataFrame) -> DataFrame:
    """The older Markdown dialect: the same block with the size in whole kilobytes."""
    return _parts(files.filter(F.col("content").isNotNull()), markdown_block(text.kilobytes(F.col("size_bytes"))))


def _bullets(items: Column, render) -> Column:
    return F.array_join(F.transform(items, render), "\n")


def _when_any(items: Column, *lines: Column) -> Column:
    """Lines shown only for a non-empty list; NULL lines leave no trace in the block."""
    return F.when(F.size(items) > 0, _joined(*lines))


def _dash(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("—"))


def analysis_markdown(analysis: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """The analysis as Markdown blocks, with each file's text when ``contents`` is given."""
    rows = analysis if contents is None else wide_join(
        analysis, contents.select("project_id", "path", "content"), ["project_id", "path"])
    imports, classes = F.col("imports"), F.col("classes")
    functions, tests = F.col("functions"), F.col("tests")
    external = F.array_sort(imports)
    class_row = lambda c: F.concat(
        F.lit("| `"), c["name"], F.lit("` | `"), _dash(F.array_join(c["bases"], ", ")), F.lit("` | "),
        F.when(F.size(c["methods"]) > 0, F.concat(F.size(c["methods"]).cast("string"), F.lit(" methods")))
        .otherwise("No methods"), F.lit(" | "), _dash(c["doc1"]), F.lit(" |"))
    function_row = lambda f: F.concat(
        F.lit("| `"), f["signature"], F.lit("` | `"), _dash(f["returns"]), F.lit("` | "), _dash(f["doc1"]),
        F.lit(" |"))
    complexity = F.when(
        (F.col("todo_count") > 0) | (F.col("cyclomatic") > 0),
        _joined(
            F.lit("**Complexity:**"), F.lit(""),
            F.when(F.col("cyclomatic") > 0, F.concat(F.lit("- Cyclomatic complexity: "), "cyclomatic")),
            F.when(F.col("todo_count") > 0, F.concat(F.lit("- TODO items: "), "todo_count")),
            F.when(F.col("hotspot") > 0, F.concat(
                F.lit("- Hotspot score: "), F.format_string("%.2f", F.bround("hotspot", 2)))),
            F.lit("")))
    body = [
        F.concat(F.lit("### 📄 "), "path"), F.lit(""),
        F.concat(F.lit("- **Language:** "), "language"),
        F.concat(F.lit("- **Size:** "), text.file_size(F.col("size_bytes"))),
        F.concat(F.lit("- **Lines:** "), "sloc"),
        F.concat(F.lit("- **Purpose:** "), "responsibility"), F.lit(""),
        _when_any(imports, F.lit("**Imports:**"), F.lit(""), F.lit("*External:*"),
                  _bullets(external, lambda m: F.concat(F.lit("- `"), m, F.lit("`"))), F.lit("")),
        _when_any(classes, F.lit("**Classes:**"), F.lit(""), F.lit("| Class | Bases | Methods | Description |"),
                  F.lit("|-------|-------|---------|-------------|"), _bullets(classes, class_row), F.lit("")),
        _when_any(functions, F.lit("**Functions:**"), F.lit(""), F.lit("| Function | Returns | Description |"),
                  F.lit("|----------|---------|-------------|"), _bullets(functions, function_row), F.lit("")),
        _when_any(tests, F.lit("**Tests:**"), F.lit(""),
                  _bullets(tests, lambda t: F.concat(F.lit("- `"), t, F.lit("`"))), F.lit("")),
        complexity,
    ]
    if contents is not None:
        fenced = _joined(F.lit("**Content:**"), F.lit(""), F.concat(F.lit("```"), "language"), F.col("content"),
                         F.lit("```"), F.lit(""))
        body.append(F.when(~text.is_blank(F.col("content")), fenced))
    body += [F.lit("---"), F.lit("")]
    return _parts(rows, _joined(*body), place=F.col("path"))


# --- plain text ------------------------------------------------------------------------

def plaintext_dump(files: DataFrame) -> DataFrame:
    """Plain-text blocks; every line loses its trailing white space."""
    body = F.regexp_replace(text.unify_breaks(F.col("content")), r"\n\z", "")
    lines = F.transform(F.split(body, "\n"), lambda l: text.rstrip(l))
    shown_lines = F.when(F.col("content") == "", F.lit(None)).otherwise(F.array_join(lines, "\n"))
    block = _joined(
        F.concat(F.lit("\n--- "), "path", F.lit(" ---")),
        F.concat(F.lit("Size: "), text.kilobytes(F.col("size_bytes")), F.lit(" | Lines: "), _counter("lines"),
                 F.lit(" | Words: "), _counter("words")),
        F.concat(F.lit("Modified: "), _modified()), F.lit("-" * 40), shown_lines)
    head = _joined(
        F.lit("=" * 60), F.lit("PROJECT STRUCTURE REPORT"), F.lit("=" * 60),
        F.concat(F.lit("Project: "), "project_id"), F.lit(""), F.lit("SUMMARY:"),
        F.concat(F.lit("  Total Files: "), _number("total_files")),
        F.concat(F.lit("  Text Files: "), _number("text_files")),
        F.concat(F.lit("  Total Size: "), text.kilobytes(F.col("total_size_bytes"))), F.lit(""),
        F.lit("=" * 60), F.lit("FILE CONTENTS"), F.lit("=" * 60))
    return _head(totals.project_totals(files), head).unionByName(
        _parts(files.filter(F.col("content").isNotNull()), block))


# --- HTML ------------------------------------------------------------------------------

def html_escape(value: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(mark), F.lit(entity))
    return value


def html_blocks(files: DataFrame) -> DataFrame:
    """A heading and a preformatted block per file: what the HTML reader takes back."""
    meta = F.concat(F.lit("Size: "), text.file_size(F.col("size_bytes")), F.lit(" | Lines: "), _counter("lines"),
                    F.lit(" | Words: "), _counter("words"))
    block = _joined(
        F.concat(F.lit("<h3>📄 <code>"), html_escape(F.col("path")), F.lit("</code></h3>")),
        F.concat(F.lit('<div class="content-header">'), html_escape(meta), F.lit("</div>")),
        F.lit("<pre><code>"), html_escape(F.col("content")), F.lit("</code></pre>"))
    return _parts(files.filter(F.col("content").isNotNull()), block)


def html_head() -> Column:
    return F.concat(F.lit("<!DOCTYPE html>\n<html>\n<head><title>Project Structure: "), "project_id",
                    F.lit("</title></head>\n<body>"))


# --- JSON ------------------------------------------------------------------------------

def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def full_json_dump(files: DataFrame) -> DataFrame:
    """Head with totals, then one JSON object per file with its whole content."""
    content = F.col("content")
    filled = content != ""
    entry = _json(
        path=F.col("path"), size_bytes=F.col("size_bytes"), lines=_counter("lines"), words=_counter("words"),
        mtime_iso=_modified(), language=paths.language(F.col("path"), "content"), content=content,
        has_content=content.isNotNull(), content_preview=F.when(filled, text.preview(content)),
        encoding=F.when(filled, "utf-8"))
    head = _json(
        format=F.lit("full-content-json"), format_version=F.lit("1.0"), root=F.col("project_id"),
        **{n: F.col(n) for n in ("total_files", "text_files", "total_size_bytes", "total_lines", "total_words")})
    return _head(totals.project_totals(files), head).unionByName(_parts(files, entry))


def plain_json_dump(files: DataFrame, include_contents: bool = True) -> DataFrame:
    entry = _json(
        path=F.col("path"), size_bytes=F.col("size_bytes"), mtime_iso=_modified(), lines=_counter("lines"),
        words=_counter("words"),
        content=F.col("content") if include_contents else F.lit(None).cast("string"))
    head = _json(root=F.col("project_id"), total_files=F.col("total_files"), text_files=F.col("text_files"),
                 total_size_bytes=F.col("total_size_bytes"),
                 total_size_formatted=text.kilobytes(F.col("total_size_bytes")))
    return _head(totals.project_totals(files), head).unionByName(_parts(files, entry))


def analysis_json(analysis: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """The analysis row of every file as JSON, with its text when ``contents`` is given."""
    rows, extra = analysis, []
    if contents is not None:
        rows = wide_join(analysis, contents.select("project_id", "path", "content"), ["project_id", "path"])
        extra = ["content"]
    names = ["path", "language", "size_bytes", "sloc", "imports", "classes", "functions", "tests", "windows",
             "widgets", "cyclomatic", "todo_count", "hotspot", "responsibility", *extra]
    return _parts(rows, F.to_json(F.struct(*names)), place=F.col("path"))


# --- sink ------------------------------------------------------------------------------

def write_dump(parts: DataFrame, folder: str) -> None:
    """Text files per project whose names, read in order, give each document's blocks in order."""
    (
        parts.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
        .select("project_id", "block").write.mode("overwrite").partitionBy("project_id").text(folder)
    )
