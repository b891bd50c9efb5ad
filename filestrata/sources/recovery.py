"""Recovery: dump documents, one per row of (dump_id, file_name, text), back into files."""
from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import paths, text

# The block patterns of the two Markdown dialects, and the marks of each format.
STRICT_BLOCK = r"(?dms)^### [^`]*`([^`]+)`.*?```([\p{L}\p{N}_]+)\n(.*?)^```"
LENIENT_BLOCK = r"(?dms)^### [^`]*`([^`]+)`.*?^\*\*Size:.*?^```([\p{L}\p{N}_]*)\n(.*?)^```"
ANY_PATH_BLOCK = r"(?dms)^### [^`]*`(.+?)`.*?^\*\*Size:.*?^```([\p{L}\p{N}_]*)\n(.*?)^```"
MARKDOWN_MARK = "This report includes complete source code content"
JSON_FORMAT = "full-content-json"
#: Bytes of documents that a task reads at a time, or one document.
HELD_BYTES = 4 << 20

_FILES_IN_JSON = "struct<format:string,files:array<struct<path:string,content:string,has_content:boolean>>>"


def detected_format(file_name: Column, document: Column) -> Column:
    """The dump format by extension and marks; ``unknown`` when they do not agree."""
    ext = paths.suffix(file_name)
    declared = F.get_json_object(document, "$.format")
    return (
        F.when((ext == ".json") & (declared == JSON_FORMAT), JSON_FORMAT)
        .when((ext == ".md") & F.contains(document, F.lit(MARKDOWN_MARK)), "full-content-markdown")
        .when((ext == ".html") & F.contains(document, F.lit("Project Structure:"))
              & F.contains(document, F.lit("<pre><code>")), "legacy-html")
        .otherwise("unknown")
    )


def looks_like_html(document: Column) -> Column:
    doctype = document.rlike(rf"(?i)^[{text.SPACE}]*<!doctype html")
    return doctype | F.contains(F.lower(F.substring(document, 1, 500)), F.lit("<html"))


def project_name(document: Column) -> Column:
    """Markdown title, else HTML title, else the last part of the JSON root, else a default."""
    def found(pattern: str) -> Column:
        return F.nullif(text.strip(F.regexp_extract(document, pattern, 1)), F.lit(""))

    space = f"[{text.SPACE}]*"
    root = F.when(F.contains(document, F.lit('"root":')), F.nullif(
        F.regexp_extract(document, rf'"root"{space}:{space}"([^"]+)"', 1), F.lit("")))
    return F.coalesce(
        found(r"(?dm)^# Project Structure: (.+)$"),
        found(r"(?d)<title>Project Structure: (.+?)</title>"),
        F.nullif(F.substring_index(F.regexp_replace(root, r"/+\z", ""), "/", -1), F.lit("")),
        F.lit("project_root"))


def from_json(dumps: DataFrame, dialect: str = "full") -> DataFrame:
    """Files of JSON dumps: ``full`` wants non-empty content, ``plain`` any content at all."""
    parsed = dumps.select("dump_id", F.from_json("text", _FILES_IN_JSON).alias("doc"))
    if dialect == "full":
        parsed = parsed.filter(F.col("doc.format") == JSON_FORMAT)
    files = parsed.select("dump_id", F.explode("doc.files").alias("f")).select("dump_id", "f.*")
    wanted = F.col("content").isNotNull()
    if dialect == "full":
        wanted = F.coalesce(F.col("has_content"), F.lit(False)) & (F.col("content") != "")
    return files.filter(wanted).select("dump_id", "path", "content")


def from_markdown(dumps: DataFrame, dialect: str = "strict") -> DataFrame:
    """Fenced blocks of Markdown dumps; ``strict`` wants a language and a titled document."""
    if dialect == "strict":
        titled = dumps.filter(F.col("text").rlike(r"(?dm)^# Project Structure: .+$"))
        return titled.select("dump_id", F.explode(_blocks(STRICT_BLOCK)).alias("f")).select("dump_id", "f.*")
    quoted = dumps.select("dump_id", "text", _blocks(LENIENT_BLOCK).alias("found"))
    found = F.when(F.size("found") > 0, F.col("found")).otherwise(_blocks(ANY_PATH_BLOCK))
    return quoted.select("dump_id", F.explode(found).alias("f")).select(
        "dump_id", text.strip(F.col("f.path")).alias("path"), "f.content")


def _blocks(pattern: str) -> Column:
    path, content = (F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) for group in (1, 3))
    return F.arrays_zip(path.alias("path"), content.alias("content"))


_BLOCK_ROWS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType())]))


class _BlockReader(HTMLParser):
    """Collects (path, content): a ``code`` inside ``h3``, then the ``code`` of the next ``pre``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self._open: list[str] = []
        self._text: list[str] = []
        self._path: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("h3", "pre"):
            self._open = [tag]
            if tag == "h3":
                self._path = None
        elif tag == "code" and self._open in (["h3"], ["pre"]):
            self._open.append(tag)
            self._text = []

    def handle_endtag(self, tag):
        if tag == "code" and len(self._open) == 2:
            found, place = "".join(self._text), self._open.pop(0)
            self._open = []
            if place == "h3" and self._path is None:
                self._path = found.strip()
            elif place == "pre" and self._path is not None:
                self.blocks.append((self._path, found))
                self._path = None
        elif tag in ("h3", "pre"):
            self._open = []

    def handle_data(self, data):
        if len(self._open) == 2:
            self._text.append(data)


def _read_html(document: str) -> list[dict]:
    reader = _BlockReader()
    reader.feed(document)
    reader.close()
    return [{"path": path, "content": content} for path, content in reader.blocks]


def from_html(dumps: DataFrame) -> DataFrame:
    """Files of HTML dumps, read by the standard library's tokenizer on the executors."""
    blocks = pa.list_(pa.struct([("path", pa.string()), ("content", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = held = 0
            for i, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                if i > start and held + size > HELD_BYTES:
                    yield slice_read(batch.slice(start, i - start))
                    start, held = i, 0
                held += size
            if batch.num_rows > start:
                yield slice_read(batch.slice(start))

    def slice_read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([_read_html(t.as_py()) for t in batch.column("text")], type=blocks)
        return pa.RecordBatch.from_arrays([batch.column("dump_id"), found], names=["dump_id", "files"])

    titled = dumps.filter(F.col("text").rlike("<title>Project Structure: ([^<]+)</title>"))
    read_blocks = titled.select("dump_id", "text").mapInArrow(
        read, "dump_id bigint, files array<struct<path:string,content:string>>")
    return read_blocks.select("dump_id", F.explode("files").alias("f")).select("dump_id", "f.*")


def safe_path(path: Column) -> Column:
    """Relative and without ``..``: the sink writes nothing outside its folder."""
    return (path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:|(?:^|[/\\])\.\.(?:[/\\]|\z)")


def recovered_files(found: DataFrame, dialect: str) -> DataFrame:
    """Rows ready to write, with the line ends each source leaves.

    ``json`` keeps content as it is; ``full`` drops trailing white space and closes with a line
    feed; ``plain`` drops line feeds at both ends and closes with one.
    """
    content = F.col("content")
    closed = {
        "json": content,
        "full": F.concat(text.rstrip(content), F.lit("\n")),
        "plain": F.concat(F.btrim(content, F.lit("\n")), F.lit("\n")),
    }[dialect]
    return found.filter(safe_path(F.col("path"))).withColumn("content", closed)


def recovered(dumps: DataFrame) -> DataFrame:
    """Files of mixed dumps: each document goes to the reader of its detected format, in one pass over the documents."""
    marked = dumps.withColumn("format", detected_format(F.col("file_name"), F.col("text")))
    document, form = F.col("text"), F.col("format")

    @F.pandas_udf(_BLOCK_ROWS)
    def html_blocks(texts: pd.Series) -> pd.Series:
        return texts.map(_read_html, na_action="ignore")

    # Each reader sees the documents of its own format only.
    entries = F.from_json(F.when(form == JSON_FORMAT, document), _FILES_IN_JSON)["files"]
    from_entries = F.transform(
        F.filter(entries, lambda f: F.coalesce(f["has_content"], F.lit(False)) & (f["content"] != "")),
        lambda f: F.struct(f["path"].alias("path"), f["content"].alias("content")))
    titled = (form == "full-content-markdown") & document.rlike(r"(?dm)^# Project Structure: .+$")
    from_blocks = F.when(titled, _blocks(STRICT_BLOCK))
    in_html = F.when((form == "legacy-html") & document.rlike("<title>Project Structure: ([^<]+)</title>"), document)
    read = marked.select("dump_id", "format", "text", html_blocks(in_html).alias("html"))
    found = F.coalesce(from_entries, from_blocks, F.col("html"))
    files = read.select("dump_id", "format", F.explode(found).alias("f")).select("dump_id", "format", "f.path", "f.content")
    closed = F.when(F.col("format") == JSON_FORMAT, F.col("content")).otherwise(F.concat(text.rstrip(F.col("content")), F.lit("\n")))
    return files.filter(safe_path(F.col("path"))).select("dump_id", "path", closed.alias("content"))
