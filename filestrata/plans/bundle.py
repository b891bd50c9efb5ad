"""Bundles: several export formats of the same projects in one parts table."""
from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import symbols
from ..session import frozen
from ..sources import dumps
from ..sources.pyfacts import python_facts
from . import capsule, corpus

PARTS = ["project_id", "section", "place", "path", "block"]


@dataclass(frozen=True)
class Format:
    """An export format: its parts from the files and their analysis, and what it promises."""

    parts: Callable[[DataFrame, DataFrame], DataFrame]
    mime_type: str
    llm_friendly: bool
    lossless: bool


def _corpus_parts(files: DataFrame, analysis: DataFrame) -> DataFrame:
    _, segments = corpus.corpus_document(analysis)
    return segments.withColumnRenamed("payload", "block")


FORMATS: dict[str, Format] = {
    "llm-tds": Format(_corpus_parts, "application/json", True, False),
    "basic-json": Format(lambda files, a: dumps.analysis_json(a), "application/json", False, True),
    "basic-markdown": Format(lambda files, a: dumps.analysis_markdown(a), "text/markdown", True, True),
    "full-content-json": Format(lambda files, a: dumps.full_json_dump(files), "application/json", False, True),
    "full-content-markdown": Format(lambda files, a: dumps.markdown_dump(files), "text/markdown", True, True),
    "legacy-html": Format(lambda files, a: dumps.html_blocks(files), "text/html", False, True),
    "lrc-capsule": Format(
        lambda files, a: capsule.section_documents(capsule.Capsule(files)), "application/json", True, False),
}


def bundle(files: DataFrame, formats: Iterable[str] = tuple(FORMATS)) -> DataFrame:
    """(project_id, format, section, place, path, block, mime_type, llm_friendly, lossless).

    Unknown format names are skipped. The files are parsed once for all formats.
    """
    analysis = frozen(symbols.engine_analysis(files, python_facts(files)))
    known = [(name, FORMATS[name]) for name in formats if name in FORMATS]
    tables = [
        form.parts(files, analysis).select(*PARTS).withColumns({
            "format": F.lit(name), "mime_type": F.lit(form.mime_type),
            "llm_friendly": F.lit(form.llm_friendly), "lossless": F.lit(form.lossless)})
        for name, form in known
    ]
    if not tables:
        raise ValueError("no known format asked for")
    return reduce(DataFrame.unionByName, tables)
