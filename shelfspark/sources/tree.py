"""Listing of folder trees as a Spark data source.

Spark's own file index leaves out names with a leading '_' or '.' and empty files, follows links and cuts times to
milliseconds; a catalogue needs all of these as they are.  The tree must be on a mount that every executor has.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("path", root).option("maxDepth", 12).load()

Options: path; maxDepth (segments of the relative path at most, default none); splitDepth (folders at this depth are tasks
of their own, default 1; files above them are one task); skip (comma-separated folder names that aren't entered, any
case); hidden ("false" leaves out folders with a leading '.'); unreadable ("true" gives files whose state can't be read as rows without a size).

Where the roots are rows of a table, listings() does the same in tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from shelfspark.functions import names as N
from shelfspark.sources.shared import written

TREE_SCHEMA = StructType(
    [
        StructField("path", StringType()),
        StructField("rel_path", StringType()),
        StructField("filename", StringType()),
        StructField("size_bytes", LongType()),
        StructField("mtime", DoubleType()),
    ]
)


class Walk:
    """What of a folder is listed and which folders are entered; folders that can't be read count as empty."""

    def __init__(self, max_depth: int | None = None, skip: Iterable[str] = (), hidden: bool = True, unreadable: bool = False):
        self.max_depth, self.hidden, self.unreadable = max_depth, hidden, unreadable
        self.skip = {s.strip().lower() for s in skip if s.strip()}

    def _entries(self, folder: str) -> Iterator[os.DirEntry]:
        """Entries as they come, none held: a folder may have millions."""
        try:
            with os.scandir(folder) as found:
                yield from found
        except OSError:
            return

    def _entered(self, e: os.DirEntry) -> bool:
        return e.is_dir(follow_symlinks=False) and e.name.lower() not in self.skip and (self.hidden or not e.name.startswith("."))

    def _deeper(self, root: str, folder: str) -> bool:
        depth = 0 if folder == root else os.path.relpath(folder, root).count(os.sep) + 1
        return self.max_depth is None or depth + 1 < self.max_depth

    def folders(self, root: str, folder: str) -> list[str]:
        """Folders of a folder that are entered; none below the depth limit."""
        return sorted(e.path for e in self._entries(folder) if self._entered(e)) if self._deeper(root, folder) else []

    def _file(self, e: os.DirEntry, prefix: str) -> tuple | None:
        """A file in the columns of TREE_SCHEMA. A link to a file counts, a link to a folder doesn't."""
        size = mtime = None
        try:
            if e.is_file():
                stat = e.stat()
                size, mtime = stat.st_size, stat.st_mtime
            elif not (self.unreadable and e.is_symlink() and not e.is_dir()):
                return None
        except OSError:
            if not self.unreadable:
                return None
        return e.path, prefix + e.name, e.name, size, mtime

    def files(self, root: str, folder: str, inside: list[str] | None = None) -> Iterator[tuple]:
        """Files of one folder; the folders in it that are entered are added to inside."""
        prefix = "" if folder == root else os.path.relpath(folder, root).replace(os.sep, "/") + "/"
        deeper = inside is not None and self._deeper(root, folder)
        for e in self._entries(folder):
            if deeper and self._entered(e):
                inside.append(e.path)
            row = self._file(e, prefix)
            if row is not None:
                yield row

    def below(self, root: str, folder: str) -> Iterator[tuple]:
        """Files of a folder and of all folders under it, each of which is read once."""
        todo = [folder]
        while todo:
            yield from self.files(root, todo.pop(), todo)


class Subtree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        flag = lambda name, default: str(options.get(name, default)).lower() != "false"
        self.walk = Walk(int(options.get("maxdepth", options.get("maxDepth", 0))) or None, options.get("skip", "").split(","), flag("hidden", "true"), flag("unreadable", "false"))
        self.split_depth = max(1, int(options.get("splitdepth", options.get("splitDepth", 1))))

    def partitions(self) -> list[Subtree]:
        """Only folders down to splitDepth are listed on the driver."""
        level, parts = [self.root], []
        for _ in range(self.split_depth):
            parts += [Subtree(folder, False) for folder in level]
            level = [sub for folder in level for sub in self.walk.folders(self.root, folder)]
        return parts + [Subtree(folder, True) for folder in level]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        rows = self.walk.below(self.root, partition.folder) if partition.deep else self.walk.files(self.root, partition.folder)
        while held := list(islice(rows, 4096)):
            yield _batch(held, _LISTED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], find, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most 4096 of the rows that find gives for each (root, folder)."""
    held: list[tuple] = []
    for batch in batches:
        for root, folder in zip(batch.column("root").to_pylist(), batch.column("folder").to_pylist(), strict=True):
            for row in find(root, folder):
                held.append(row)
                if len(held) == 4096:
                    yield _batch(held, schema)
                    held = []
    if held:
        yield _batch(held, schema)


_FILE = pa.schema([("root", pa.string()), ("path", pa.string()), ("rel_path", pa.string()), ("filename", pa.string()), ("size_bytes", pa.int64()), ("mtime", pa.float64())])
_LISTED = pa.schema(list(_FILE)[1:])
_FOLDER = pa.schema([("root", pa.string()), ("folder", pa.string()), ("deeper", pa.bool_())])


def listings(roots: DataFrame, *, max_depth: int | None = None, skip: Iterable[str] = (), hidden: bool = True, unreadable: bool = False, split_depth: int = 1) -> DataFrame:
    """root and the columns of TREE_SCHEMA of the files below each root (column root, as an absolute path), whichever tree it is in.

    Roots are dealt to tasks, then what lies split_depth folders below them, so a large root isn't one task. Folders that
    are left out are never entered. A root that isn't there has no files.
    """
    walk = Walk(max_depth, skip, hidden, unreadable)
    n = max(1, int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = roots.select("root", F.col("root").alias("folder"), F.lit(True).alias("deeper")).where("root IS NOT NULL").distinct()
    for k in range(split_depth):

        def parts(root: str, folder: str, first: bool = k == 0) -> Iterator[tuple]:
            if first:
                yield root, folder, False
            yield from ((root, sub, False) for sub in walk.folders(root, folder))

        found = level.where("deeper").repartition(n, "folder").mapInArrow(lambda b, f=parts: _rows(b, f, _FOLDER), "root string, folder string, deeper boolean")
        new = found.withColumn("deeper", (F.col("folder") != F.col("root")))
        level = written(level.where("NOT deeper").unionByName(level.where("deeper AND folder <> root").withColumn("deeper", F.lit(False))).unionByName(new), "folders")
    schema = "root string, path string, rel_path string, filename string, size_bytes long, mtime double"
    one = lambda root, folder: ((root, *row) for row in walk.files(root, folder))
    every = lambda root, folder: ((root, *row) for row in walk.below(root, folder))
    shallow = level.where("NOT deeper").repartition(n, "folder").mapInArrow(lambda b: _rows(b, one, _FILE), schema)
    return shallow.unionByName(level.where("deeper").repartition(n, "folder").mapInArrow(lambda b: _rows(b, every, _FILE), schema))


def reachable(roots: DataFrame) -> DataFrame:
    """root of those that are folders now."""
    there = lambda root, folder: ((root,) for _ in range(os.path.isdir(folder)))
    asked = roots.select("root", F.col("root").alias("folder")).where("root IS NOT NULL").distinct()
    return asked.mapInArrow(lambda b: _rows(b, there, pa.schema([("root", pa.string())])), "root string")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> StructType:
        return TREE_SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


def alias_table(systems: DataFrame) -> DataFrame:
    """alias -> system_id; of several systems the one with the greatest ord has it. systems: id, ord, folder_aliases."""
    rows = systems.select("id", "ord", F.explode("folder_aliases").alias("alias")).where("alias IS NOT NULL")
    return rows.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("id", F.struct("ord", "id")).alias("system_id"))


def extension_table(systems: DataFrame) -> DataFrame:
    """Extensions that one system alone has. systems: id, extensions."""
    rows = systems.select("id", F.explode("extensions").alias("e")).select("id", F.lower("e").alias("extension"))
    return rows.groupBy("extension").agg(F.min("id").alias("system_id"), F.max("id").alias("last")).where("system_id = last").drop("last")


def resolve_systems(files: DataFrame, aliases: DataFrame, path: str = "rel_path") -> DataFrame:
    """files with system_id of the nearest folder above whose name is an alias (null if none is).

    Resolved once for each folder and joined back, so files aren't multiplied by their depth.
    """
    own = files.withColumn("_folder", folder_of(F.col(path)))
    segments = own.select("_folder").distinct().select("_folder", F.posexplode(F.split("_folder", "/")).alias("pos", "name"))
    found = segments.join(aliases, F.lower("name") == F.col("alias")).groupBy("_folder").agg(F.max_by("system_id", "pos").alias("system_id"))
    return own.join(found, "_folder", "left").drop("_folder")


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), N.parent(path)).otherwise("")


def accepted(files: DataFrame, systems: DataFrame) -> DataFrame:
    """Files with an extension of their system, or archives; side files never. files: filename, system_id; systems: id, extensions."""
    known = systems.select(F.col("id").alias("system_id"), "extensions")
    ext = N.extension(F.col("filename"))
    listed = files.join(known, "system_id").where(~ext.isin(N.SIDE_EXTENSIONS) & (ext.isin(N.ARCHIVES) | F.array_contains("extensions", ext)))
    return listed.select(*files.columns)


def library_rows(files: DataFrame, root: str) -> DataFrame:
    """Catalogue columns of accepted files; the title is what the name shows, a file with a key has a fuzzy match."""
    f = N.parsed(F.col("filename"))
    shown = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(shown(f["display_title"]), shown(f["clean_name"]), "filename")
    return files.select(*files.columns, F.lit(root).alias("library_root"), *(f[c].alias(c) for c in ("extension", "display_title", "region", "revision", "is_hack", "is_homebrew", "fuzzy_key")), title.alias("title"), F.when(f["fuzzy_key"] != "", "fuzzy").otherwise("unmatched").alias("match_confidence"), F.lit(False).alias("missing"))
