"""The dictionary-compressed description of a project, as ordered segments."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..operators import dictionary as words
from ..session import frozen

ORDER = ["section", "place", "path"]


def _tagged(tag: str, items: Column) -> Column:
    return F.transform(items, lambda item: F.concat(F.lit(f"{tag}: "), item))


def _one(tag: str, name: str) -> Column:
    return F.array(F.concat(F.lit(f"{tag}: "), name))


def _with_doc(head: Column, doc: Column, *more: Column) -> Column:
    """A line, its doc where there is one, then further lines."""
    documented = F.array_compact(F.array(head, F.nullif(doc, F.lit(""))))
    return F.concat(documented, *more) if more else documented


def corpus_segments(analysis: DataFrame) -> DataFrame:
    """(project_id, section, place, path, content): a head row, then one segment per file.

    Joined by blanks in the order of section, place and path they are the project's document.
    The analysis feeds both kinds of row, so it is frozen: its sources are parsed once.
    """
    analysis = frozen(analysis)
    classes = F.flatten(F.transform("classes", lambda c: _with_doc(
        F.concat(F.lit("Class: "), c["name"]), c["doc1"], _tagged("Method", c["methods"]))))
    functions = F.flatten(F.transform("functions", lambda f: _with_doc(
        F.concat(F.lit("Function: "), f["signature"]), f["doc1"])))
    pieces = F.concat(_one("File", "path"), _one("Language", "language"), _one("Purpose", "responsibility"),
                      _tagged("Import", F.col("imports")), classes, functions)
    segments = analysis.select(
        "project_id", F.lit(1).alias("section"), F.lower("path").alias("place"), "path",
        F.array_join(pieces, " ").alias("content"))
    heads = analysis.select("project_id").distinct().select(
        "project_id", F.lit(0).alias("section"), F.lit("").alias("place"), F.lit("").alias("path"),
        F.concat(F.lit("Project: "), "project_id").alias("content"))
    return heads.unionByName(segments)


def corpus_document(analysis: DataFrame, size: int = 256) -> tuple[DataFrame, DataFrame]:
    """(dictionary, segments with their substituted ``payload``).

    No word reaches over a blank, so substituting segment by segment gives the same text as
    substituting the joined document.
    """
    segments = frozen(corpus_segments(analysis))
    dictionary = frozen(words.token_dictionary(segments, size, fixed.CORPUS_WORD, ORDER))
    return dictionary, words.substitute(segments, dictionary).drop("tokens_used", "n_replaced")
