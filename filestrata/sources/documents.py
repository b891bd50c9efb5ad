"""Dumps as whole documents over many text files, written in order and read back line by line.

A document is a project's ordered parts, joined by line feeds. ``write_dump`` deals it over as many files as it needs, and a reader meets
the lines of one document in many tasks, none of which knows where in the document it starts. How deep a line of JSON lies is a running sum
over the lines before it; whether a line of Markdown or HTML lies in a file's text is the state of a small automaton. Both are
found by ``operators.scans`` over narrow rows; the lines themselves move once, to the files they belong to.

JSON: strings never hold a line feed, so lines cut no string. Elements of the ``files`` array may take one line or several; the brackets of the
array must not share a line with an element. A document that is one line is read by ``recovery.from_json``.
"""
from __future__ import annotations

import html
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text
from ..operators import totals
from ..operators.joins import lookup_join
from ..operators.scans import running_states, running_sums
from ..session import checkpoint_folder, frozen
from . import dumps, recovery

KEY = ["project_id"]
ORDER = ["file", "start", "slot"]

# --- whole documents -------------------------------------------------------------------


def _tail(files: DataFrame, block: str) -> DataFrame:
    return files.select("project_id").distinct().select(
        "project_id", F.lit(2).alias("section"), F.lit("").alias("place"), F.lit("").alias("path"), F.lit(block).alias("block"))


def json_document(files: DataFrame) -> DataFrame:
    """Parts that joined are one JSON document per project: metadata, summary and the ``files`` array, one line each file."""
    parts = dumps.full_json_dump(files).filter("section = 1")
    last = files.groupBy("project_id").agg(F.max(F.struct(F.lower("path").alias("place"), "path")).alias("last"))
    entries = lookup_join(parts, last, ["project_id"], ["path"]).select(
        "project_id", "section", "place", "path",
        F.when(F.struct("place", "path") == F.col("last"), F.col("block")).otherwise(F.concat("block", F.lit(","))).alias("block"))
    names = ["total_files", "text_files", "total_size_bytes", "total_lines", "total_words"]
    metadata = F.to_json(F.struct(F.col("project_id").alias("root"), F.lit(True).alias("include_contents")))
    head = F.concat(
        F.lit('{"format": "full-content-json", "format_version": "1.0",\n"metadata": '), metadata, F.lit(',\n"summary": '),
        F.to_json(F.struct(*names)), F.lit(',\n"files": ['))
    heads = totals.project_totals(files).select(
        "project_id", F.lit(0).alias("section"), F.lit("").alias("place"), F.lit("").alias("path"), head.alias("block"))
    return heads.unionByName(entries).unionByName(_tail(files, "]}"))


def html_document(files: DataFrame) -> DataFrame:
    """The blocks of ``html_blocks`` between the head and the end of one HTML document per project."""
    heads = files.select("project_id").distinct().select(
        "project_id", F.lit(0).alias("section"), F.lit("").alias("place"), F.lit("").alias("path"), dumps.html_head().alias("block"))
    return heads.unionByName(dumps.html_blocks(files)).unionByName(_tail(files, "</body>\n</html>"))


WRITERS = {"full-content-json": json_document, "full-content-markdown": dumps.markdown_dump, "legacy-html": html_document}

# --- reading lines ---------------------------------------------------------------------


def dump_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``project_id, file, start, slot, line``: the lines of what ``write_dump`` wrote, with their order."""
    lines = spark.read.schema("value string, project_id string").option("lineSep", "\n").text(folder)
    return lines.select(
        "project_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("slot"), F.col("value").alias("line"))


def _outside_strings(line: Column) -> Column:
    bare = F.replace(F.replace(line, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    return F.array_join(F.filter(F.split(bare, '"'), lambda part, i: i % 2 == 0), "")


def _count(value: Column, marks: str) -> Column:
    return F.length(value) - F.length(F.translate(value, marks, ""))


def json_files(lines: DataFrame) -> DataFrame:
    """``project_id, path, content, has_content`` of the ``files`` arrays of JSON documents of the full-content format."""
    line = F.trim("line")
    narrow = lines.select(
        *KEY, *ORDER, _outside_strings(F.col("line")).alias("outside"), F.startswith(line, F.lit("{")).alias("opens"),
        F.col("line").rlike(r'"files"\s*:\s*\[\s*\z').alias("of_files"),
        F.col("line").rlike(r'"format"\s*:\s*"full-content-json"').alias("of_format"))
    narrow = narrow.withColumn("depth", _count(F.col("outside"), "{[") - _count(F.col("outside"), "}]")).drop("outside")
    deep = running_sums(narrow, KEY, ORDER, ["depth"]).withColumn("after", F.col("depth_before") + F.col("depth"))
    # Outside an array or object of the document, in its files array, in another one.
    opening = (F.col("depth_before") <= 1) & (F.col("after") >= 2)
    step = (F.when(opening & F.col("of_files"), 1).when(opening, 2)
            .when((F.col("depth_before") >= 2) & (F.col("after") <= 1), 3).otherwise(0))
    placed = running_states(deep.withColumn("step", step), KEY, ORDER, "step", [[0, 1, 2], [1, 1, 2], [2, 1, 2], [0, 0, 0]])
    begins = (F.col("state") == 1) & (F.col("depth_before") == 2) & F.col("opens")
    placed = frozen(running_sums(placed.withColumn("begins", begins.cast("int")), KEY, ORDER, ["begins"]))
    known = placed.filter((F.col("depth_before") <= 1) & F.col("of_format")).select("project_id").distinct()
    inside = placed.filter((F.col("state") == 1) & (F.col("after") >= 2)).join(F.broadcast(known), KEY, "left_semi")
    of_element = inside.select(
        *KEY, *ORDER, (F.col("begins_before") + F.col("begins")).alias("element"),
        ((F.col("begins") == 1) & (F.col("after") == 2)).alias("whole"))
    met = lines.join(of_element, [*KEY, *ORDER])
    several = met.filter("NOT whole").groupBy(*KEY, "element").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "line"))).alias("ls"))
    texts = met.filter("whole").select(*KEY, "line").unionByName(several.select(*KEY, F.array_join("ls.line", "\n").alias("line")))
    entry = "array<struct<path:string,content:string,has_content:boolean>>"
    parsed = F.from_json(F.concat(F.lit("["), F.regexp_replace("line", r",\s*\z", ""), F.lit("]")), entry)
    return texts.select(*KEY, F.explode(parsed).alias("f")).select(*KEY, "f.*")


def _block_files(lines: DataFrame, step: Column, maps: list[list[int]], path: Column, head: Column, piece: Column, closes: Column,
                 newest: bool) -> DataFrame:
    """Files whose text lies in state 2 of an automaton over lines, which a heading with their ``path`` leads to.

    A block begins at a heading outside a text; with ``newest`` every such heading begins one, else only one that no other still waits
    for. ``piece`` is what a line gives to the text, ``closes`` whether it can end one; unended texts are left out.
    """
    narrow = lines.select(*KEY, *ORDER, step.alias("step"), head.alias("head"), closes.alias("closes"))
    placed = running_states(narrow, KEY, ORDER, "step", maps)
    heading = F.col("head") & ((F.col("state") != 2) if newest else (F.col("state") == 0))
    numbered = frozen(running_sums(placed.withColumn("heads", heading.cast("int")), KEY, ORDER, ["heads"]))
    steps = F.array(*[F.array(*map(F.lit, m)) for m in maps])
    after = F.get(F.get(steps, F.col("step")), F.col("state"))
    role = (F.when(F.col("heads") == 1, "head").when((F.col("state") == 2) & (after != 2), "end")
            .when(F.col("state") == 2, "text").when(after == 2, "begin"))
    wanted = numbered.select(*KEY, *ORDER, (F.col("heads_before") + F.col("heads")).alias("block"), role.alias("role")).filter("role IS NOT NULL")
    met = lines.join(wanted, [*KEY, *ORDER]).select(
        *KEY, "block", "role", *ORDER, F.when(F.col("role") == "head", path).otherwise(piece).alias("part"))
    inside = F.array_sort(F.collect_list(F.when(F.col("role") != "head", F.struct(*ORDER, "part"))))
    found = met.groupBy(*KEY, "block").agg(
        F.max(F.when(F.col("role") == "head", F.col("part"))).alias("path"), F.bool_or(F.col("role") == "end").alias("ended"), inside.alias("ls"))
    return found.filter("ended AND path IS NOT NULL").select(
        *KEY, "path", F.array_join(F.array_compact("ls.part"), "\n").alias("content"))


def _titled(lines: DataFrame, pattern: str) -> DataFrame:
    titled = lines.filter(F.col("line").rlike(pattern)).select(*KEY).distinct()
    return lines.join(F.broadcast(titled), KEY, "left_semi")


# The marks of the formats.
_HEADING, _FENCE = r"^### [^`]*`([^`]+)`", r"```[\p{L}\p{N}_]+\z"


def markdown_files(lines: DataFrame) -> DataFrame:
    """``project_id, path, content`` of the fenced blocks of Markdown documents.

    A text ends at the first line that starts with a fence; a heading inside a text is text.
    """
    line = F.col("line")
    head, opens, fence = line.rlike(_HEADING), line.rlike(_FENCE), F.startswith(line, F.lit("```"))
    step = F.when(head & opens, 5).when(head, 1).when(opens & fence, 3).when(opens, 4).when(fence, 2).otherwise(0)
    # From outside, after a heading, inside a text; by class of line.
    maps = [[0, 1, 2], [1, 1, 2], [0, 1, 0], [0, 2, 0], [0, 2, 2], [2, 2, 2]]
    empty = F.lit(None).cast("string")
    found = _block_files(
        _titled(lines, r"^# Project Structure: .+\z"), step, maps, F.regexp_extract("line", _HEADING, 1), head,
        F.when(F.col("role") == "text", line).when(F.col("role") == "end", "").otherwise(empty), fence, newest=False)
    return found


def _unescaped(column: str) -> Column:
    def unescape(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return F.pandas_udf(unescape, T.StringType())(column)


def html_files(lines: DataFrame) -> DataFrame:
    """``project_id, path, content`` of the preformatted blocks of HTML documents, each after a heading with its path.

    Of several headings ahead of a block the last one counts.
    """
    line, begin, end = F.col("line"), F.lit("<pre><code>"), F.lit("</code></pre>")
    path = r"<h3>[^<]*<code>([^<]*)</code>"
    head, opens, closes = line.rlike(path), F.contains(line, begin), F.contains(line, end)
    step = F.when(head, 1).when(opens, 2).when(closes, 3).otherwise(0)
    maps = [[0, 1, 2], [1, 1, 2], [0, 2, 2], [0, 1, 0]]
    found = _block_files(
        _titled(lines, "<title>Project Structure: ([^<]+)</title>"), step, maps, text.strip(F.regexp_extract("line", path, 1)), head,
        F.when(F.col("role") == "begin", F.substring_index(line, "<pre><code>", -1)).when(
            F.col("role") == "end", F.substring_index(line, "</code></pre>", 1)).otherwise(line), closes, newest=True)
    return found.select(*KEY, _unescaped("path").alias("path"), _unescaped("content").alias("content"))


def recovered_lines(lines: DataFrame, form: str) -> DataFrame:
    """Files of documents of one format, ready to write: ``project_id, path, content``."""
    if form == "full-content-json":
        found = json_files(lines).filter(F.coalesce("has_content", F.lit(False)) & (F.col("content") != "")).drop("has_content")
        return recovery.recovered_files(found, "json")
    readers = {"full-content-markdown": markdown_files, "legacy-html": html_files}
    if form not in readers:
        raise ValueError(f"no reader for {form!r}")
    return recovery.recovered_files(readers[form](lines), "full")


def round_trip(files: DataFrame, form: str) -> DataFrame:
    """Files written as documents of a format and read back from them."""
    spark = files.sparkSession
    folder = f"{checkpoint_folder(spark)}/dump-{uuid.uuid4().hex}"
    dumps.write_dump(WRITERS[form](files), folder)
    return recovered_lines(dump_lines(spark, folder), form)
