"""Sink that puts whole files into a tier under given names.

Rows are (source, target): the file at ``source`` is copied to ``target`` below the sink's folder, byte for byte, so a
delivered log keeps its name.  Tasks copy into a staging folder of their own and name what they copied in their
commit message; only when all tasks have succeeded does the job's commit move the copies into place.  A failed job leaves
nothing: abort removes its staging folder, and readers never look into it (its name begins with an underscore).
Copying a file again replaces it, so a repeated batch changes nothing.

Files are opened through ``pyarrow.fs`` (local and mounted folders, hdfs, s3, gs); their bytes go in blocks, never as a
whole value."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BLOCK = 8 << 20
STAGING = "_staging"
MOVERS = 16


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file and its path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return pafs.LocalFileSystem(), path


@dataclass
class Copied(WriterCommitMessage):
    staged: list[tuple[str, str]] = field(default_factory=list)  # (staged path, target below the root)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edgelog_named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.staging = f"{STAGING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Copied:
        fs, root = filesystem(self.root)
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # of this attempt of this task
        done = Copied()
        for batch in iterator:
            for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist()):
                if ".." in target.split("/"):
                    raise ValueError(f"target outside the sink's folder: {target}")
                fs.create_dir(own)
                staged = f"{own}/{len(done.staged)}"
                source_fs, path = filesystem(source)
                with source_fs.open_input_stream(path, compression=None) as src, fs.open_output_stream(staged, compression=None) as out:
                    while block := src.read(BLOCK):
                        out.write(block)
                done.staged.append((staged, target))
        return done

    def commit(self, messages: list[Copied | None]) -> None:
        fs, root = filesystem(self.root)
        if self.overwrite:
            for entry in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if not entry.base_name.startswith(("_", ".")):
                    (fs.delete_dir if entry.type == pafs.FileType.Directory else fs.delete_file)(entry.path)
        moves = [m for message in messages if message is not None for m in message.staged]
        for folder in {posixpath.dirname(t) for _, t in moves}:
            fs.create_dir(f"{root}/{folder}")
        with ThreadPoolExecutor(MOVERS) as pool:
            for _ in pool.map(lambda m: fs.move(m[0], f"{root}/{m[1]}"), moves):
                pass
        self._clear(fs, root)

    def abort(self, messages: list[Copied | None]) -> None:
        self._clear(*filesystem(self.root))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


def write_named_files(files: DataFrame, root: str, mode: str = "append", source: str = "path", target: str = "target_key") -> None:
    """Copy every file of ``files`` to its target below ``root``.  The rows are small and the copies aren't, so they are dealt
    over a fixed number of tasks, which adaptive execution doesn't merge."""
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    rows = files.select(F.col(source).alias("source"), F.col(target).alias("target"))
    rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "target").write.format(NamedFiles.name()).mode(mode).save(root)
