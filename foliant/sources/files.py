"""A data sink that writes one file a row: reports as indented JSON, and objects as they are.

Rows are path (below the root) and content: a string that holds JSON, a variant's text say, or binary. Tasks write into folders
of their own below root/_staging-<run>; the commit moves the files of the tasks that Spark counts, and only these, to their
places, a new folder's at once. Rows are best dealt by folder. So nothing shows before the job has succeeded, a failed job leaves nothing, and a task that ran twice leaves one file.
Files that are there already are replaced, one by one. What tasks tell the driver is a folder's name each.

A row without path or content is an error, and so are a path that leaves the root and one that a task gets twice; of one that two
tasks get, one file stays. Folders are reached by pyarrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

from foliant.sources.folders import store


def report_text(content: str, indent: int = 2) -> str:
    """JSON as a report file holds it: indented, with its characters as they are."""
    return json.dumps(json.loads(content), ensure_ascii=False, indent=indent)


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: int


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file_a_row"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        kinds = {f.name: f.dataType for f in schema}
        if kinds.get("path") != StringType() or kinds.get("content") not in (StringType(), BinaryType()):
            raise ValueError("rows are path (string) and content (string or binary)")
        if overwrite:
            raise ValueError("files are replaced one by one: append")
        return _Writer(self.options["path"], int(self.options.get("indent", 2)))


class _Writer(DataSourceWriter):
    def __init__(self, root: str, indent: int) -> None:
        self.root, self.indent, self.run = root.rstrip("/"), indent, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        at, root = store(self.root)
        own, seen = f"{root}/{self.run}/{uuid.uuid4().hex}", set()
        at.create_dir(own, recursive=True)
        for row in iterator:
            path, content = row["path"], row["content"]
            if not path or content is None or path.startswith("/") or ".." in path.split("/") or path in seen:
                raise ValueError(f"no file can be written for path {path!r}")
            seen.add(path)
            if "/" in path:
                at.create_dir(f"{own}/{path.rpartition('/')[0]}", recursive=True)
            with at.open_output_stream(f"{own}/{path}") as out:
                out.write(report_text(content, self.indent).encode() if isinstance(content, str) else bytes(content))
        return _Staged(own, len(seen))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        at, root = store(self.root)
        there = at.get_file_info(fs.FileSelector(root, allow_not_found=True))
        old = {f.base_name for f in there}
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: self._place(at, root, m, old), (m for m in messages if m)))
        self._clear(at, root)

    def _place(self, at, root: str, m: _Staged, old: set[str]) -> None:
        """A folder that root doesn't have is moved as one, so that the driver's moves are as many as folders; else file by file."""
        from pyarrow import fs

        found = [f.path[len(m.folder) + 1 :] for f in at.get_file_info(fs.FileSelector(m.folder, recursive=True)) if f.type == fs.FileType.File]
        if len(found) != m.files:
            raise OSError(f"{len(found)} of {m.files} staged files are there")
        moved = set()
        for top in {f.partition("/")[0] for f in found if "/" in f} - old:
            # Another task's folder may have come there meanwhile, and some stores have no folders to move.
            with suppress(OSError, NotImplementedError):
                at.move(f"{m.folder}/{top}", f"{root}/{top}")
                moved.add(top)
        left = [f for f in found if f.partition("/")[0] not in moved]
        for folder in {f.rpartition("/")[0] for f in left} - {""}:
            at.create_dir(f"{root}/{folder}", recursive=True)
        for f in left:
            at.move(f"{m.folder}/{f}", f"{root}/{f}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*store(self.root))

    def _clear(self, at, root: str) -> None:
        from pyarrow import fs

        if at.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            at.delete_dir(f"{root}/{self.run}")


def write(rows: DataFrame, root: str, indent: int = 2) -> None:
    """Writes path and content of each row to a file below root."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("path", "content").write.format("one_file_a_row").option("indent", indent).mode("append").save(root)
