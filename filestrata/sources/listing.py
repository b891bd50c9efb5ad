"""Listings of directory trees that open no file: ``spark.read.format("file_listing")``, and reading what was selected from one.

Rows are names, sizes and times. Filters on project, path and size go into the scan: folders that cannot hold a wanted path are not
entered. A folder with very many files is listed by several tasks, each of which looks at its share of them. A folder that
cannot be listed is a row with status ``denied``, its path and no size; a root that cannot is an error. Options: ``path`` or ``roots`` as for
``file_tree``, ``splits`` (folders to aim for) and ``share`` (files of one folder that a task takes).
"""
from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql import datasource as ds

from ..schemas import FILES
from .tree import _bytes_of, _text_of, _visible

LISTING = T.StructType([FILES[c] if c != "size_bytes" else T.StructField(c, T.LongType()) for c in ("project_id", "path", "size_bytes", "mtime", "read_status")])
_ARROW = pa.schema([("project_id", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("mtime", pa.timestamp("us")), ("read_status", pa.string())])
_BATCH = 4096


@dataclass
class Share(ds.InputPartition):
    """Files ``part``, ``part + parts``, ... of a folder; ``deep`` also takes everything below it."""

    project_id: str
    root: str
    folder: str
    deep: bool
    part: int = 0
    parts: int = 1


def _listed(folder: str) -> tuple[list[str], list[str]] | None:
    """Names of visible real subdirectories and files, sorted; None where the folder cannot be listed."""
    dirs, files = [], []
    try:
        with os.scandir(folder) as found:
            for entry in found:
                if _visible(entry.name) and not entry.is_symlink():
                    (dirs if entry.is_dir(follow_symlinks=False) else files).append(entry.name)
    except OSError:
        return None
    return sorted(dirs), sorted(files)


class Wanted:
    """The filters that a scan took over; ``folder`` tells whether wanted paths can lie below it."""

    def __init__(self) -> None:
        self.tests: list[tuple[str, Callable]] = []
        self.prefixes: list[str] = []

    def take(self, given: ds.Filter) -> bool:
        if isinstance(given, ds.IsNotNull):
            test = lambda value: value is not None
            name = given.attribute
        elif isinstance(given, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.In)):
            name, bound = given.attribute, given.value
            compare = {
                ds.EqualTo: lambda value: value == bound, ds.GreaterThan: lambda value: value > bound,
                ds.GreaterThanOrEqual: lambda value: value >= bound, ds.LessThan: lambda value: value < bound,
                ds.LessThanOrEqual: lambda value: value <= bound, ds.StringStartsWith: lambda value: value.startswith(bound),
                ds.In: lambda value: value in bound}[type(given)]
            test = lambda value: value is not None and compare(value)
            if name == ("path",) and isinstance(given, (ds.EqualTo, ds.StringStartsWith)):
                self.prefixes.append(bound)
        else:
            return False
        if name not in (("project_id",), ("path",), ("size_bytes",)):
            return False
        self.tests.append((name[0], test))
        return True

    def row(self, **values) -> bool:
        return all(test(values[name]) for name, test in self.tests if name in values)

    def folder(self, project_id: str, path: str) -> bool:
        below = "" if path in ("", ".") else path + "/"
        return self.row(project_id=project_id) and all(p.startswith(below) or below.startswith(p) for p in self.prefixes)


class ListingReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        roots = options.get("roots")
        pairs = [pair.split("=", 1) for pair in roots.split(",")] if roots else [(os.path.basename(os.path.abspath(options["path"])), options["path"])]
        self.roots = {project.strip(): root.strip() for project, root in pairs}
        self.splits, self.share = int(options.get("splits", "256")), int(options.get("share", "10000"))
        self.wanted: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for given in filters:
            if Wanted().take(given):
                self.wanted.append(given)
            else:
                yield given

    def _filters(self) -> Wanted:
        wanted = Wanted()
        for given in self.wanted:
            wanted.take(given)
        return wanted

    def partitions(self) -> list[ds.InputPartition]:
        """Opens wanted folders level by level until there are enough, and shares out the files of those it opened."""
        wanted, shallow = self._filters(), []
        level = [Share(project, root, root, True) for project, root in self.roots.items() if wanted.folder(project, "")]
        for share in level:
            os.scandir(share.folder).close()  # an unreadable root is an error, not an empty project
        while level and len(level) + len(shallow) < self.splits:
            below = []
            for at in level:
                dirs, files = _listed(at.folder) or ([], [])
                parts = max(1, -(-len(files) // self.share))
                shallow += [Share(at.project_id, at.root, at.folder, False, part, parts) for part in range(parts)]
                below += [Share(at.project_id, at.root, os.path.join(at.folder, d), True) for d in dirs
                          if wanted.folder(at.project_id, os.path.relpath(os.path.join(at.folder, d), at.root))]
            level = below
        return shallow + level

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no root is wanted
            return
        wanted, rows, pending = self._filters(), [], [partition.folder]
        while pending:
            folder = pending.pop()
            place = os.path.relpath(folder, partition.root)
            found = _listed(folder)
            if found is None:
                if partition.part == 0 and wanted.row(project_id=partition.project_id, path=place, size_bytes=None):
                    rows.append((partition.project_id, place, None, None, "denied"))
                continue
            dirs, files = found
            if partition.deep:
                pending += [os.path.join(folder, d) for d in dirs if wanted.folder(partition.project_id, os.path.normpath(os.path.join(place, d)))]
            for name in files[partition.part::partition.parts]:
                row = self._row(partition, os.path.join(folder, name), os.path.normpath(os.path.join(place, name)), wanted)
                if row is not None:
                    rows.append(row)
                if len(rows) >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    def _row(self, partition: Share, file_path: str, path: str, wanted: Wanted) -> tuple | None:
        path = path.replace(os.sep, "/")
        if not wanted.row(project_id=partition.project_id, path=path):
            return None
        try:
            stat = os.stat(file_path, follow_symlinks=False)
        except OSError:
            return None
        if not wanted.row(size_bytes=stat.st_size):
            return None
        return partition.project_id, path, stat.st_size, datetime.fromtimestamp(int(stat.st_mtime)), "listed"


class FileListing(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self):
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


def list_tree(spark: SparkSession, **options: str) -> DataFrame:
    """``project_id, path, size_bytes, mtime, read_status`` of the files of one or more trees."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").options(**options).load()


def read_listed(listing: DataFrame, roots: dict[str, str], with_bytes: bool = False, tasks: int | None = None, with_content: bool = True) -> DataFrame:
    """The files table of the rows of a listing, which other jobs may have filtered; only these are opened.

    Without content, texts of any size are counted piece by piece. Rows are dealt over tasks by hash, so that files of one folder do not stay in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file_path = os.path.join(roots[row["project_id"]], row["path"])
                content, lines, words, status = _text_of(file_path, row["size_bytes"], os.path.basename(file_path), None, with_content)
                data = _bytes_of(file_path) if with_bytes else None
                yield pa.RecordBatch.from_arrays([
                    pa.array([row[c]], _ARROW.field(c).type) for c in ("project_id", "path", "size_bytes", "mtime")] + [
                    pa.array([content], pa.string()), pa.array([data], pa.binary()), pa.array([lines], pa.int64()), pa.array([words], pa.int64()),
                    pa.array([status], pa.string())], FILES.names)

    files = listing.filter("read_status = 'listed'").select("project_id", "path", "size_bytes", "mtime")
    spark = listing.sparkSession
    dealt = files.repartition(tasks or 4 * spark.sparkContext.defaultParallelism, F.xxhash64("project_id", "path"))
    return dealt.mapInArrow(run, FILES)
