"""A connector of our own through Spark's Python data source API: files of length-prefixed records."""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        return [_Part(f) for f in sorted(glob.glob(os.path.join(self.path, "*.records")))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            while size := f.read(8):
                n = struct.unpack("<Q", size)[0]
                body = f.read(n)
                if len(size) < 8 or len(body) < n:
                    raise ValueError(f"{partition.path} ends within a record")
                yield (bytes(body),)


class _Message(WriterCommitMessage):
    def __init__(self, made: str, wanted: str):
        self.made, self.wanted = made, wanted


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> _Message:
        import uuid

        os.makedirs(self.path, exist_ok=True)
        wanted = os.path.join(self.path, f"{uuid.uuid4().hex}.records")
        with open(f"{wanted}.part", "wb") as f:
            for row in iterator:
                f.write(struct.pack("<Q", len(row[0])) + row[0])
        return _Message(f"{wanted}.part", wanted)

    def commit(self, messages: list) -> None:
        """Parts get their names once all tasks have ended, so readers never see half a file."""
        old = glob.glob(os.path.join(self.path, "*.records")) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.made, m.wanted)
        for f in old:
            os.remove(f)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.made):
                os.remove(m.made)


class RecordFiles(DataSource):
    """Records of bytes, each after its length in eight bytes, little-endian. The folder must be mounted on driver and executors."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "record binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make format("records") known to the session."""
    spark.dataSource.register(RecordFiles)
