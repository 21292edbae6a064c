"""A sink for files whose exact bytes matter, as a Python data source with two-phase commit.

``write_parts`` writes the strings of one column, in partition order, as part files whose
concatenation in name order is the file: an opening text in ``part-00000``, then the partitions,
each string with ``before`` in front of it. Nothing is gathered: every task writes its own part.

Phase one: a task attempt writes a draft of its own into ``<path>._drafts-<run>``, beside the folder, and returns its
name. Phase two, on the driver, once all tasks are done: drafts that were returned get their final names and, last of
all, ``_SUCCESS`` appears. If the job fails the drafts go and the folder is as it was, so no part of a
failed or repeated attempt is ever seen (an attempt that outlives its failed job may leave a draft beside the folder).
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship_package

FORMAT = "wardlake_parts"
DONE = "_SUCCESS"


def open_folder(uri: str):
    """(file system, path) of a folder given as URI or plain path."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


@dataclass
class Draft(WriterCommitMessage):
    part: int
    name: str


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, opening: str, before: str, overwrite: bool):
        self.path, self.opening, self.before, self.overwrite = path, opening, before, overwrite
        self.drafts = f"{path.rstrip('/')}._drafts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext
        task = TaskContext.get()
        system, drafts = open_folder(self.drafts)
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        system.create_dir(drafts, recursive=True)
        with system.open_output_stream(f"{drafts}/{name}") as out:
            for batch in iterator:
                out.write("".join(x for v in batch.column(0).to_pylist() for x in (self.before, v)).encode())
        return Draft(task.partitionId(), name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        drafts = open_folder(self.drafts)[1]
        there = system.get_file_info(fs.FileSelector(folder))
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} is not empty")
        for f in sorted(there, key=lambda f: f.base_name != DONE):      # the mark goes first: what is half replaced is not whole
            (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)
        with system.open_output_stream(f"{folder}/part-00000") as out:
            out.write(self.opening.encode())
        for m in messages:
            if m is not None:
                system.move(f"{drafts}/{m.name}", f"{folder}/part-{m.part + 1:05d}")
        self.abort(messages)
        with system.open_output_stream(f"{folder}/{DONE}"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs
        system, drafts = open_folder(self.drafts)
        if system.get_file_info(drafts).type == fs.FileType.Directory:
            system.delete_dir(drafts)


class Parts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], self.options.get("opening", ""), self.options.get("before", ""), overwrite)


def write_parts(texts: DataFrame, path: str, opening: str = "", before: str = "", mode: str = "overwrite") -> None:
    """Write the one string column of ``texts`` (no NULLs) below ``path``; ``mode``: overwrite, or append for a new folder."""
    spark = texts.sparkSession
    ship_package(spark)
    spark.dataSource.register(Parts)
    texts.write.format(FORMAT).option("path", path).option("opening", opening).option("before", before).mode(mode).save()


#: A record of the CSV export: quoted cells may hold line ends, others may not (a doubled quote ends one quoted run and begins the next).
RECORD = re.compile(rb'(?:"[^"]*"|[^"\r\n]+)*')
#: Bytes of a part that are in memory at a time; more only while a single record is longer.
PIECE = 4 << 20


def csv_pieces(name: str, stream, headed: bool, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The records of one CSV part (``headed``: its first record is the header, which has no separator and may be empty) and
    the bytes each takes, read ``piece`` bytes at a time: a record that a piece cuts waits for the next."""
    kept, place, more, seen = b"", 0, True, not headed
    while more:
        got = stream.read(max(piece, len(kept)))        # a long record doubles what is read, so that it is matched few times
        more = len(got) > 0
        kept += got
        at, values, sizes = 0, [], []
        while at < len(kept) or not (more or seen):
            start = at + 2 if kept.startswith(b"\r\n", at) else at
            end = RECORD.match(kept, start).end()
            if not kept.startswith(b"\r\n", end):
                if more:
                    break
                if end < len(kept):
                    raise ValueError(f"{name}: not a record at {place + end}")
            values.append(kept[start:end])
            sizes.append(end - at)
            at, seen = end, True
        kept, place = kept[at:], place + at
        if values:
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())], names=["value", "file_bytes"])


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(value, file_bytes) of every record of a CSV folder, from the files' bytes: the record's text and the bytes it
    takes in the file with the separator before it. A task reads its parts one after another, each in pieces (``csv_pieces``), so a
    part may be of any size."""
    ship_package(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, place = open_folder(name)
                with system.open_input_stream(place) as stream:
                    yield from csv_pieces(name, stream, name.endswith("part-00000"))

    return spark.read.format("binaryFile").load(f"{path}/part-*").select("path").mapInArrow(split, "value string, file_bytes long")
