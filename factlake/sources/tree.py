"""Source trees as a Spark data source: folders are pruned before they are listed, small files are packed, odd files give a row."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: Folders that are listed on the driver before the rest of the tree is left to tasks, and the bytes of files that one task reads.
PLANNED_FOLDERS, PACKED_BYTES = 512, 32 << 20


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path below the root, bytes)."""

    files: list[tuple[str, int]]


@dataclass
class Folder(InputPartition):
    """A folder whose subtree one task lists and reads."""

    path: str


class _Wanted:
    """What a scan takes: folders by name, files by pattern, size, and the conditions that reached the scan."""

    def __init__(self, options):
        self.pattern = options.get("pattern", "*")
        self.pruned = frozenset(x for x in options.get("pruned", "").split(",") if x)
        self.most = int(options.get("mostBytes", 1 << 62))
        self.names: set[str] | None = None
        self.prefixes: list[str] = []

    def folder(self, path: str) -> bool:
        if path.rpartition("/")[2] in self.pruned:
            return False
        return all(f"{path}/".startswith(p) or p.startswith(f"{path}/") for p in self.prefixes)

    def file(self, path: str, size: int) -> bool:
        name = path.rpartition("/")[2]
        return fnmatch.fnmatchcase(name, self.pattern) and size < self.most and (self.names is None or name in self.names) and all(path.startswith(p) for p in self.prefixes)


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")
    return fs, base.rstrip("/")


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.wanted = options["path"], _Wanted(options)
        self.packed, self.folders = int(options.get("packedBytes", PACKED_BYTES)), int(options.get("plannedFolders", PLANNED_FOLDERS))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.wanted.names = {f.value} & (self.wanted.names or {f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self.wanted.names = set(f.value) if self.wanted.names is None else self.wanted.names & set(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.wanted.prefixes.append(f.value)
            else:
                yield f

    def _listed(self, fs, base: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders to go on with and files to read of one folder, in order of their names."""
        found = sorted(fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"))), key=lambda x: x.path)
        at = lambda x: x.path[len(base) :].lstrip("/")
        return [at(x) for x in found if x.type == pafs.FileType.Directory and self.wanted.folder(at(x))], [(at(x), x.size) for x in found if x.type == pafs.FileType.File and self.wanted.file(at(x), x.size)]

    def partitions(self) -> list[InputPartition]:
        """Lists level by level while there are few folders; what is below many is listed by the tasks. Files are packed by size."""
        fs, base = _open(self.root)
        level, files = [""], []
        while level and len(level) < self.folders:
            below = []
            for folder in level:
                more, own = self._listed(fs, base, folder)
                below += more
                files += own
            level = below
        out: list[InputPartition] = [Folder(x) for x in level]
        pack, size = [], 0
        for path, n in files:
            if pack and size + n > self.packed:
                out.append(Files(pack))
                pack, size = [], 0
            pack.append((path, n))
            size += n
        return out + [Files(pack)] if pack or not out else out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, base = _open(self.root)
        if isinstance(partition, Files):
            yield from (self._row(fs, base, *x) for x in partition.files)
            return
        level = [partition.path]
        while level:
            folder = level.pop()
            try:
                more, own = self._listed(fs, base, folder)
            except OSError as e:
                yield folder, folder.rpartition("/")[2], None, None, f"{type(e).__name__}: {e}"[:200]
                continue
            level += reversed(more)
            yield from (self._row(fs, base, *x) for x in own)

    @staticmethod
    def _row(fs, base: str, path: str, size: int) -> tuple:
        name = path.rpartition("/")[2]
        try:
            with fs.open_input_stream(f"{base}/{path}") as f:
                return path, name, size, f.read().decode(), None
        except (OSError, UnicodeDecodeError) as e:  # one odd file must not stop the others; its row says why
            return path, name, size, None, f"{type(e).__name__}: {e}"[:200]


class TreeSource(DataSource):
    """spark.read.format("factlake_tree"): path, name, length, content, error of the files below `path`. Options: pattern, pruned (names of
    folders, comma-joined, that are never listed), mostBytes, packedBytes, plannedFolders. Conditions on name and on the beginning
    of path reach the listing."""

    @classmethod
    def name(cls) -> str:
        return "factlake_tree"

    def schema(self) -> str:
        return "path string, name string, length long, content string, error string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def tree(spark: SparkSession, root: str, pattern: str = "*", pruned: tuple[str, ...] = (), most_bytes: int | None = None, **options) -> DataFrame:
    """The files of a tree; see TreeSource."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("factlake_tree").option("pattern", pattern).option("pruned", ",".join(pruned))
    if most_bytes is not None:
        reader = reader.option("mostBytes", most_bytes)
    return reader.options(**options).load(root)
