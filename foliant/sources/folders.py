"""A data source of output folders: root/<folder>/..., a task for each group of folders.

The driver lists the root only; tasks list their folders and read what a state of a run is made of: the first report of each
kind and the compilers' logs. All other files come with name, size and time, and without content, so no PDF or image is opened.
Filters on folder and kind (equal, in) are taken over: other folders aren't listed, other kinds aren't read.

    folders.read(spark, root).where("kind IN ('quality', 'state')")

Options: path; foldersPerTask (64); contents (true). Files that aren't UTF-8 have no content if they are reports, and
replacement characters if they are logs. An absent root gives no rows. Folders are reached by pyarrow's file systems, so
stores that only Spark reads are for artifacts.scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from foliant.operators.operations import LOGS, REPORTS

SCHEMA = "folder string, path string, kind string, modified timestamp, size long, content string"


def kind_of(path: str) -> str:
    """What a file is, by its path below the folder: a report's name, log, or its ending; other below the top."""
    if "/" in path:
        return "other"
    for kind, end in REPORTS.items():
        if path.endswith(end):
            return kind
    return "log" if path.endswith(tuple(LOGS)) else path.rpartition(".")[2].lower() if "." in path else "other"


def store(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?=[^/])", "file:///", path)))


class OutputFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "output_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("foldersPerTask", 64)), self.options.get("contents", "true").lower() == "true")


class _Reader(DataSourceReader):
    def __init__(self, root: str, group: int, contents: bool) -> None:
        self.root, self.group, self.contents, self.only = root, group, contents, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("folder",), ("kind",)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], wanted) & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        at, path = store(self.root)
        if at.get_file_info(path).type != fs.FileType.Directory:
            return []
        there = sorted(f.base_name for f in at.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory)
        there = [f for f in there if not f.startswith((".", "_")) and f in self.only.get("folder", {f})]
        return [InputPartition(there[a : a + self.group]) for a in range(0, len(there), self.group)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        at, root = store(self.root)
        for folder in partition.value if partition else ():  # without partitions Spark makes one of None
            base, seen = f"{root}/{folder}", set()
            files = [f for f in at.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
            for path, f in sorted((f.path[len(base) + 1 :], f) for f in files):
                kind = kind_of(path)
                if kind not in self.only.get("kind", {kind}):
                    continue
                first = kind == "log" or (kind in REPORTS and kind not in seen)
                seen.add(kind)
                yield folder, path, kind, f.mtime, f.size, self._content(at, f.path, kind) if first and self.contents else None

    def _content(self, at, path: str, kind: str) -> str | None:
        with at.open_input_file(path) as f:
            raw = f.read()
        try:
            return raw.decode("utf-8", "replace" if kind == "log" else "strict")
        except UnicodeDecodeError:
            return None


def read(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """folder, path, kind, modified, size, content of all files below root/<folder>/."""
    spark.dataSource.register(OutputFolders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; it concerns such sources only
    return spark.read.format("output_folders").options(**options).load(root)
