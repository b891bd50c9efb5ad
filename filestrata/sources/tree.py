"""Directory trees as a Spark data source: ``spark.read.format("file_tree")``.

Options: ``path`` (one project root), or ``roots`` (comma-separated ``project_id=root`` pairs);
``bytes`` = true adds the raw bytes; ``digest`` = true adds a column with their ``sha256``; ``content`` = false leaves texts out, and counts
them; the last two read files of any size piece by piece. ``splits`` is how many directories to aim for per read.
``read_limit`` and ``drop_above`` are sizes in bytes beyond which text is not read, or a file is left
out; neither is set by default. A root that cannot be read is an error.
The plain binary reader is no base for this: it drops names that start with ``_``.
"""
from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed
from ..schemas import FILES

_EXCLUDED = frozenset(fixed.EXCLUDED_NAMES)
_EXCLUDED_ANY_CASE = frozenset(fixed.EXCLUDED_NAMES_ANY_CASE)
_TEXT_EXTENSIONS = frozenset(fixed.TEXT_EXTENSIONS)
_TEXT_NAMES = frozenset(fixed.TEXT_NAMES)
#: Characters or bytes that are read at a time where only counts or a digest are wanted.
PIECE = 1 << 18


def _visible(name: str) -> bool:
    return not (name.startswith(".") or name in _EXCLUDED or name.lower() in _EXCLUDED_ANY_CASE)


def _textual(name: str) -> bool:
    ext = PurePosixPath(name).suffix.lower()
    return ext in _TEXT_EXTENSIONS or (not ext and name.lower() in _TEXT_NAMES)


@dataclass
class Folder(InputPartition):
    """A directory of a project; ``deep`` also takes everything below it."""

    project_id: str
    root: str
    folder: str
    deep: bool


def _entries(folder: str) -> tuple[list[os.DirEntry], list[os.DirEntry]]:
    """Visible real subdirectories and files; links and unreadable folders are left out."""
    dirs, files = [], []
    try:
        with os.scandir(folder) as found:
            for entry in found:
                if _visible(entry.name) and not entry.is_symlink():
                    (dirs if entry.is_dir(follow_symlinks=False) else files).append(entry)
    except OSError:
        pass
    return sorted(dirs, key=lambda e: e.name), sorted(files, key=lambda e: e.name)


def _text_of(file_path: str, size: int, name: str, read_limit: int | None, with_content: bool = True) -> tuple:
    """(content, lines, words, status), reading only text of a readable size; counts alone need no more than a piece of it at a time."""
    if not _textual(name):
        return None, None, None, "not_text"
    if read_limit is not None and size > read_limit:
        return "", None, None, "large"
    try:
        with open(file_path, encoding="utf-8", errors="ignore") as handle:
            if not with_content:
                return None, *_counts(iter(lambda: handle.read(PIECE), "")), "ok"
            content = handle.read()
    except OSError:
        return "", None, None, "denied"
    lines, words = _counts(content[i:i + PIECE] for i in range(0, len(content), PIECE))
    return content if words else "", lines, words, "ok"


def _counts(pieces: Iterator[str]) -> tuple[int, int]:
    """Lines and words of a text that comes in pieces; a blank one has none."""
    lines, words, inside = 1, 0, False
    for piece in pieces:
        lines += piece.count("\n")
        words += len(piece.split()) - (inside and not piece[0].isspace())
        inside = not piece[-1].isspace()
    return (lines, words) if words else (0, 0)


def _digest_of(file_path: str) -> str | None:
    found = hashlib.sha256()
    try:
        with open(file_path, "rb") as handle:
            while piece := handle.read(PIECE):
                found.update(piece)
    except OSError:
        return None
    return found.hexdigest()


def _bytes_of(file_path: str) -> bytes | None:
    try:
        with open(file_path, "rb") as handle:
            return handle.read()
    except OSError:
        return None


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        roots = options.get("roots")
        if roots:
            pairs = (pair.split("=", 1) for pair in roots.split(","))
            self.roots = {project.strip(): root.strip() for project, root in pairs}
        else:
            root = options["path"]
            self.roots = {os.path.basename(os.path.abspath(root)): root}
        self.with_bytes, self.with_digest, self.with_content = (
            options.get(name, default).lower() == "true" for name, default in (("bytes", "false"), ("digest", "false"), ("content", "true")))
        self.splits = int(options.get("splits", "256"))
        self.read_limit, self.drop_above = (
            int(options[name]) if name in options else None for name in ("read_limit", "drop_above"))

    def partitions(self) -> list[InputPartition]:
        """Open directories level by level until there are enough to spread one large project."""
        for root in self.roots.values():
            os.scandir(root).close()  # an unreadable root is an error, not an empty project
        shallow: list[Folder] = []
        level = [Folder(project, root, root, True) for project, root in self.roots.items()]
        while level and len(level) + len(shallow) < self.splits:
            below = [Folder(f.project_id, f.root, d.path, True) for f in level for d in _entries(f.folder)[0]]
            shallow += [Folder(f.project_id, f.root, f.folder, False) for f in level]
            level = below
        return shallow + level

    def read(self, partition: Folder) -> Iterator[tuple]:
        pending = [partition.folder]
        while pending:
            dirs, files = _entries(pending.pop())
            if partition.deep:
                pending.extend(d.path for d in dirs)
            for entry in files:
                row = self._row(partition, entry)
                if row is not None:
                    yield row

    def _row(self, partition: Folder, entry: os.DirEntry) -> tuple | None:
        try:
            stat = entry.stat(follow_symlinks=False)
        except OSError:
            return None
        if self.drop_above is not None and stat.st_size > self.drop_above:
            return None
        content, lines, words, status = _text_of(entry.path, stat.st_size, entry.name, self.read_limit, self.with_content)
        data = _bytes_of(entry.path) if self.with_bytes else None
        return (partition.project_id, os.path.relpath(entry.path, partition.root).replace(os.sep, "/"),
                stat.st_size, datetime.fromtimestamp(int(stat.st_mtime)), content, data, lines, words, status,
                *([_digest_of(entry.path)] if self.with_digest else []))


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self):
        digest = [T.StructField("sha256", T.StringType())] if self.options.get("digest", "false").lower() == "true" else []
        return T.StructType([*FILES.fields, *digest])

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(dict(self.options))


def read_tree(spark: SparkSession, **options: str):
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").options(**options).load()
