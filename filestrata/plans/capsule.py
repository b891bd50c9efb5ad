"""The capsule: a project's sections, dictionary, hash tree and payloads as tables."""
from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, paths, text
from ..operators import dictionary as words
from ..operators import fingerprint, merkle, numbering, packing, symbols, totals
from ..session import frozen
from ..sources.pyfacts import python_facts

KEY = ["project_id", "path"]


@dataclass(frozen=True)
class CapsuleOptions:
    include: tuple[str, ...] = tuple(fixed.INCLUDE_GLOBS)
    exclude: tuple[str, ...] = tuple(fixed.EXCLUDE_GLOBS)
    eol: str = "LF"
    dictionary_size: int = 256
    sample_chars: int | None = None  # text per file that feeds the dictionary; None reads it all
    codec: str = "zstd_b64"
    max_file_size: int | None = None  # larger files leave the capsule; None keeps all
    include_binary: bool = False
    summary_lines: int = 3
    outline_items: int = 10

    def compact(self) -> "CapsuleOptions":
        return replace(self, dictionary_size=128, max_file_size=fixed.COMPACT_LIMIT,
                       include_binary=False, summary_lines=2, outline_items=5)


def _valid_text() -> Column:
    return F.make_valid_utf8(F.col("content_bytes").cast("string"))


def included_files(files: DataFrame, options: CapsuleOptions) -> DataFrame:
    """Files that pass the globs, the size limit and the text filter, with their normal text."""
    path, data = F.col("path"), F.col("content_bytes")
    textual = paths.is_capsule_text(path)
    kept = files.filter(
        paths.glob_selected(path, list(options.include), list(options.exclude))
        & data.isNotNull()
        & (F.lit(True) if options.max_file_size is None else F.col("size_bytes") <= options.max_file_size)
        & (F.lit(options.include_binary) | textual))
    return kept.select(
        *KEY, "size_bytes", "content_bytes",
        F.when(textual, text.normalise_eol(_valid_text(), options.eol)).alias("content"))


def numbered_sections(included: DataFrame) -> DataFrame:
    """Section rows without their text, numbered by kind and path; content is hashed once."""
    path = F.col("path")
    rows = included.select(
        "project_id", paths.section_kind(path).alias("kind"), "path",
        paths.language(path, "capsule").alias("language"), "size_bytes",
        F.coalesce(F.sha2("content", 256), F.sha2("content_bytes", 256)).alias("sha256"),
        paths.mime_or_default(path).alias("mime"))
    return numbering.number_rows(frozen(rows), ["project_id"], ["kind", "path"]).withColumn(
        "section_id", F.format_string("sec-%04d", "number"))


def reading_layers(texts: DataFrame, facts: DataFrame, dictionary: DataFrame,
                   options: CapsuleOptions) -> DataFrame:
    """Summary, outline and substituted text per file."""
    path, content = F.col("path"), F.col("content")
    n = options.outline_items
    outlines = facts.filter("facts.parse_ok").select(*KEY, symbols.outline(n).alias("outline"))
    python = paths.suffix(path) == ".py"
    headings = F.when(~python, text.headings(content, n)).otherwise(F.array().cast("array<string>"))
    rows = words.substitute(texts, dictionary).select(
        *KEY, text.summary(content, paths.name(path), options.summary_lines).alias("summary"),
        headings.alias("headings"), "payload", "tokens_used")
    return rows.join(outlines, KEY, "left").withColumn(
        "outline_codec", F.when(F.col("outline").isNull(), "text_norm_v1").otherwise("ast_norm_v1"))


class Capsule:
    """The tables of all projects' capsules, each built when it is first asked for.

    Texts stay in their own table, keyed by path: numbering, hash tree and summary move only
    listing-sized rows, and the payload is packed where its file is read.
    """

    def __init__(self, files: DataFrame, options: CapsuleOptions = CapsuleOptions()) -> None:
        self.options = options
        self.included = included_files(files, options)
        self.texts = self.included.filter(F.col("content").isNotNull()).select(*KEY, "content")

    @cached_property
    def dictionary(self) -> DataFrame:
        return frozen(words.token_dictionary(
            self.texts, self.options.dictionary_size, sample_chars=self.options.sample_chars))

    @cached_property
    def _numbered(self) -> DataFrame:
        return frozen(numbered_sections(self.included))

    @cached_property
    def sections(self) -> DataFrame:
        return self._numbered.drop("number", "total")

    @cached_property
    def payloads(self) -> DataFrame:
        return packing.packed_files(self.included, self.options.codec)

    @cached_property
    def layers(self) -> DataFrame:
        return reading_layers(self.texts, python_facts(self.texts), self.dictionary, self.options)

    @cached_property
    def _leaves(self) -> DataFrame:
        return self._numbered.select("project_id", "total", (F.col("number") - 1).alias("idx"),
                                     F.col("sha256").alias("hash"))

    @cached_property
    def tree(self) -> DataFrame:
        return merkle.hash_tree(self._leaves)

    @cached_property
    def roots(self) -> DataFrame:
        return merkle.tree_root(self._leaves, self.tree)

    @cached_property
    def fingerprints(self) -> DataFrame:
        return fingerprint.project_fingerprint(self.sections, by_components=True)

    @cached_property
    def languages(self) -> DataFrame:
        return totals.language_histogram(self.sections, "capsule").drop("first_path")

    @cached_property
    def summary(self) -> DataFrame:
        return capsule_summary(self.sections)


def capsule_summary(sections: DataFrame) -> DataFrame:
    sizes = sections.groupBy("project_id").agg(F.sum("size_bytes").alias("bytes"))
    top = totals.dominant_language(sections, "capsule")
    captured = F.format_string("Captured %d files across %d languages", "total_files", "n_languages")
    return top.join(sizes, "project_id").select(
        "project_id", F.col("total_files").alias("files"), "bytes",
        F.array(captured, F.concat(F.lit("Dominant language: "), "dominant_language")).alias("highlights"))


def section_documents(capsule: Capsule) -> DataFrame:
    """One JSON object per section, in the parts form of the dump writers."""
    rows = (
        capsule.sections.join(capsule.payloads.select(*KEY, "codec", F.col("payload").alias("packed")), KEY)
        .join(capsule.layers, KEY, "left")
    )
    tool = F.struct("codec", F.col("packed").alias("payload"), F.col("mime").alias("original_mimetype"))
    layers = F.struct(
        F.struct(F.col("summary").alias("lines")).alias("summary"),
        F.struct(F.col("outline_codec").alias("codec"), "outline", "headings").alias("outline"),
        F.struct(F.lit("tds_v1").alias("codec"), "tokens_used", "payload").alias("content"))
    block = F.to_json(F.struct(
        F.col("section_id").alias("id"), "kind", "path", "language", "size_bytes",
        F.concat(F.lit("sha256:"), "sha256").alias("hash"), tool.alias("tool"), layers.alias("llm")))
    return rows.select("project_id", F.lit(1).alias("section"), F.col("kind").alias("place"), "path",
                       block.alias("block"))
