"""Files of one ordered stream, written and read by many tasks.

Writing: rows are sorted by (section, id) over all tasks; each task encodes its range to a part file beside the
target, and the commit joins the parts in order, block by block.  A task that is tried again writes its own part
anew, and an aborted write leaves nothing.  Reading: byte ranges of files, a task for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that are copied at once, and bytes of a range that is a task.
COPY, RANGE = 8 << 20, 32 << 20


def file_system(path: str):
    """The path's file system and its name there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    system, name = file_system(path)
    return system.open_input_file(name)


def list_files(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """A file, or the files of a folder with one of the endings, in order of their names; with their sizes."""
    from pyarrow import fs

    system, name = file_system(path)
    one = system.get_file_info(name)
    if one.type == fs.FileType.File:
        return [(path, one.size)]
    found = system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
    start = path.rstrip("/")
    return sorted((start + f.path[len(name.rstrip("/")) :], f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings))


def ranges_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One partition for each row: a range is a task."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def floats(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    """The columns as a matrix of singles; what is null or not finite is 0."""
    table = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names])
    return np.where(np.isfinite(table), table, 0.0).astype("<f4")


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    size: int


class PartWriter(DataSourceArrowWriter):
    """Encodes the rows of each section with ``encode[section](batch)``."""

    def __init__(self, path: str, head: bytes, encode: list[Callable[[pa.RecordBatch], bytes]]):
        self.path, self.head, self.encode = path, head, encode
        self.folder = f"{path}.parts-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        system, folder = file_system(self.folder)
        system.create_dir(folder, recursive=True)
        name, size = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}", 0
        with system.open_output_stream(name) as out:
            for batch in iterator:
                section = batch.column("section").to_numpy(zero_copy_only=False)
                for at in np.split(np.arange(len(section)), np.flatnonzero(np.diff(section)) + 1):
                    if len(at):
                        data = self.encode[int(section[at[0]])](batch.slice(int(at[0]), len(at)))
                        out.write(data)
                        size += len(data)
        return Part(context.partitionId(), name, size)

    def commit(self, messages: list[Part | None]) -> None:
        system, target = file_system(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        with system.open_output_stream(f"{target}.joined") as out:
            out.write(self.head)
            for p in parts:
                with system.open_input_stream(p.name) as part:
                    while block := part.read(COPY):
                        out.write(block)
        system.move(f"{target}.joined", target)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, folder = file_system(self.folder)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class PartFile(DataSource):
    """``df.write.format("voxelmill-file")``: one file of the rows (section, id, ...), already in order."""

    @classmethod
    def name(cls) -> str:
        return "voxelmill-file"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        from . import layouts

        return PartWriter(self.options["path"], bytes.fromhex(self.options["head"]), layouts.SECTIONS[self.options["layout"]])


def write_file(rows: DataFrame, path: str, layout: str, head: bytes) -> None:
    """``rows``: section, id and what the layout's encoders read.  The bytes depend on the rows alone."""
    spark = rows.sparkSession
    spark.dataSource.register(PartFile)
    ordered = rows.repartitionByRange(F.col("section"), F.col("id")).sortWithinPartitions("section", "id")
    ordered.write.format("voxelmill-file").mode("append").option("layout", layout).option("head", head.hex()).save(path)
