"""Files of bytes as a data source of Spark: a row is a file, a job's files appear together or not at all.

Tasks open the file system of the path's scheme through Arrow (local and shared folders, HDFS, S3, GCS), write into a staging
folder of their own, and the driver moves finished files to their place when every task has ended. A task that is run
again, or twice at once, leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged."""

    folder: str
    names: list[str]


class Staged(DataSourceArrowWriter):
    """Moves what its tasks have staged when all of them have ended; subclasses say how rows become files."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def files(self, rows: Iterator[pa.RecordBatch], create) -> Iterator[str]:
        """Writes files, each through create(name), and yields their names."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = opened(self.path)
        folder = f"{top}/_staging-{self.job}/{uuid.uuid4().hex}"

        def create(name: str):
            at = f"{folder}/{name}"
            system.create_dir(at.rpartition("/")[0], recursive=True)
            # by default Arrow would compress what a name like x.gz says is compressed
            return system.open_output_stream(at, compression=None)

        return Written(folder, list(self.files(iterator, create)))

    def commit(self, messages: list[Written | None]) -> None:
        system, top = opened(self.path)
        system.create_dir(top, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(top)):
                if not old.base_name.startswith("_staging-"):
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        made = set()
        for message in messages:
            for name in message.names if message else ():
                at = f"{top}/{name}"
                if (parent := at.rpartition("/")[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                system.move(f"{message.folder}/{name}", at)
        self._cleared(system, top)
        system.open_output_stream(f"{top}/_SUCCESS", compression=None).close()

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared(*opened(self.path))

    def _cleared(self, system: fs.FileSystem, top: str) -> None:
        if system.get_file_info(f"{top}/_staging-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/_staging-{self.job}")


class _Bodies(Staged):
    def files(self, rows: Iterator[pa.RecordBatch], create) -> Iterator[str]:
        for batch in rows:
            for name, body in zip(batch.column("name"), batch.column("body"), strict=True):
                with create(name.as_py()) as out:
                    out.write(body.as_buffer() or b"")
                yield name.as_py()


class Files(DataSource):
    """Format ``gridwright_files``: rows of name and body, a file each."""

    @classmethod
    def name(cls) -> str:
        return "gridwright_files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Bodies(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """name, body: each row becomes the file path/name; names must differ. Other columns are left out."""
    files.sparkSession.dataSource.register(Files)
    files.selectExpr("cast(name as string) as name", "cast(body as binary) as body").write.format("gridwright_files").mode(mode).save(path)
