"""Files tables made from stored tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths, text
from ..schemas import FILES
from ..session import spread


def files_table(raw: DataFrame) -> DataFrame:
    """The row contract of every job, from (project_id, path, mtime, raw_text).

    ``content`` has unified newlines; it is NULL for names that are not text and '' for blank
    files, whole at any size. ``content_bytes`` keeps the bytes as stored. Size tiers are a
    filter of their own, ``selection.size_tiers``.
    """
    stored, path = F.col("raw_text"), F.col("path")
    size = F.octet_length(stored).cast("long")
    readable = paths.is_text(path)
    unified = text.unify_newlines(stored)
    rows = raw.select(
        "project_id", "path", size.alias("size_bytes"), F.col("mtime"),
        F.when(readable, F.when(text.is_blank(stored), "").otherwise(unified)).alias("content"),
        F.encode(stored, "UTF-8").alias("content_bytes"),
        F.when(readable, text.line_count(unified)).alias("lines"),
        F.when(readable, text.word_count(unified)).alias("words"),
        F.when(~readable, "not_text").otherwise("ok").alias("read_status"),
    )
    return rows.select(*FILES.names)


def _whole(value: Column, divisor: int) -> Column:
    return F.call_function("div", value, F.lit(divisor))


def _pick(options: list[str], index: Column) -> Column:
    """One of the constants, by index; chr(0) separates them in one folded literal."""
    return F.element_at(F.split(F.lit(chr(0).join(options)), chr(0)), (index % len(options) + 1).cast("int"))


# How document rows become files of a project. Each tail seeds text that prose lacks.
DOCUMENT_DIRS = ["src/core", "tests", ".git/objects", "config", "docs/__pycache__"]
DOCUMENT_NAMES = [".py", ".md", ".json", ".yml", ".csv", ".js", ".png", "/README"]
DOCUMENT_HEADS = ["", "", "", "", "# License: MIT\n", "", ""]
DOCUMENT_TAILS = [
    "",
    "\n# TODO: tidy\n  #fixme later, not TODOS\n",
    "\r\n# Heading One\r\n## Second ##\r\nplain\rlone",
    "\n\"key_a\": 1\n'mode' = 2\n\"key_a\": 3\n",
    "\n// copyright notice placed late\n",
    "\n \t \n\t\nword" + chr(0xA0) + "word" + chr(0x3000) + "x" + chr(0x0B) + "vt" + chr(0x2028) + "ls\nplain § mark, §9 and §12345\n",
    "\nimport os\nclass Model: config argparse tkinter\n",
]


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: the source is the project, language and id make the path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = _whole(F.col("doc_id"), 20)
    path = F.concat_ws(
        "/", F.col("lang"), _pick(DOCUMENT_DIRS, _whole(step, 8)),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), _pick(DOCUMENT_NAMES, step)))
    variant = _whole(step, 3)
    stored = F.concat(_pick(DOCUMENT_HEADS, variant), F.col("text"), _pick(DOCUMENT_TAILS, variant))
    day = (F.col("doc_id") % 28 + 1).cast("int")
    return files_table(docs.select(
        F.col("source").alias("project_id"), path.alias("path"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), day, F.lit(9), F.lit(30), F.lit(0)).alias("mtime"),
        stored.alias("raw_text")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as files: the host is the project."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.col("url")
    path = F.concat(
        F.coalesce(F.nullif(F.regexp_extract(url, r"^https?://[^/]+/([^?#]*)", 1), F.lit("")), F.lit("index")),
        F.lit("_"), F.col("page_id").cast("string"), F.lit(".html"))
    return files_table(pages.select(
        F.regexp_extract(url, r"^https?://([^/?#]+)", 1).alias("project_id"), path.alias("path"),
        F.lit(None).cast("timestamp_ntz").alias("mtime"), F.col("html").alias("raw_text")))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as files: one project per conversation, one file per turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat(F.col("role"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt"))
    return files_table(turns.select(
        F.col("conv_id").cast("string").alias("project_id"), path.alias("path"),
        F.lit(None).cast("timestamp_ntz").alias("mtime"), F.col("text").alias("raw_text")))


def _dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``part`` over all cores: a file of short rows is few splits, and a source made of a row is many times its size."""
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as Python files whose symbols follow from the row, for the parser's jobs."""
    parts = _dealt_parts(spark, sf_dir)
    key = F.col("p_partkey")

    def mod(n: int) -> Column:
        return (key % n).cast("string")

    k, label = key.cast("string"), F.col("p_name")
    extra = (F.col("p_size") % 4).cast("int")
    source = F.concat(
        F.lit('"""Module '), k, F.lit(' doc.\n\nMore text.\n"""\nimport os\nimport lib'), mod(7),
        F.lit(".sub as s\nfrom pkg import m"), F.floor(key / 2).cast("string"),
        F.lit("\nfrom . import helper"), mod(3), F.lit("\n\n\nclass C"), k, F.lit("(Base"), mod(4),
        F.lit(', Frame):\n    """Class '), k,
        F.lit('."""\n\n    def run(self, a: int, *, flag=True) -> bool:\n'
              '        if a and flag or not a:\n            return os.getenv("K'), k,
        F.lit('")\n        return s.go(a, env_name="V'), mod(5),
        F.lit('")\n\n    async def wait(self, x, /, y: str, *args, **kw):\n'
              '        for i in args:\n            with s.lock(i):\n                pass\n\n\ndef f'), k,
        F.lit('(p: str, q=1):\n    """\n    Makes '), label,
        F.lit('.\n    """\n    parser = argparse.ArgumentParser()\n    tk.Button(text="'), label,
        F.lit('")\n'), F.repeat(F.lit("    if q:\n        q += 1  # TODO later\n"), extra),
        F.lit('    return os.environ["E'), mod(10), F.lit('"]\n\n\n@cache.memo(2)\ndef test_f'), k,
        F.lit("():\n    assert f"), k, F.lit('("x") == "'), F.col("p_type"),
        F.lit('"\n\n\nif __name__ == "__main__":\n    f'), k, F.lit('("'), F.col("p_brand"), F.lit('")\n'),
        F.when(key % 11 == 5, "def broken(:\n").otherwise(""),
    )
    path = F.concat(F.lit("pkg/m"), k, F.lit(".py"))
    return files_table(parts.select(
        F.concat(F.lit("proj"), (F.col("p_size") % 5).cast("string")).alias("project_id"),
        path.alias("path"), F.lit(None).cast("timestamp_ntz").alias("mtime"), source.alias("raw_text")))


def linked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as Python files that import each other, with cycles of up to five modules, long chains and a module all lean on.

    Keys come in runs of 200, a project each run; ``i`` is the place in the run.
    """
    parts = _dealt_parts(spark, sf_dir).select(F.col("p_partkey").alias("k"))
    run, i = _whole(F.col("k") - 1, 200), (F.col("k") - 1) % 200
    ring = _whole(i, 10) % 5
    first = F.col("k") - i

    def line(words: str, when: Column, target: Column) -> Column:
        return F.when(when, F.concat(F.lit(words), target.cast("long").cast("string"), F.lit("\n"))).otherwise("")

    source = F.concat(
        F.lit("import os\n"), line("import pkg.m", i % 10 < ring, F.col("k") + 1),
        line("import pkg.m", (i % 10 == ring) & (ring > 0), F.col("k") - ring),
        line("from pkg import m", (i >= 17) & (i % 3 == 0), F.col("k") - 17),
        line("from pkg import m", i % 4 == 1, first + _whole(i, 2)), line("import pkg.m", i % 10 == 9, first),
        F.lit("\n\ndef f():\n    return os\n"))
    return files_table(parts.select(
        F.concat(F.lit("graph"), run.cast("string")).alias("project_id"), F.concat(F.lit("pkg/m"), F.col("k").cast("string"), F.lit(".py")).alias("path"),
        F.lit(None).cast("timestamp_ntz").alias("mtime"), source.alias("raw_text")))
