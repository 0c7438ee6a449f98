"""A connector of our own through Spark's Python data source API: Arrow files listed in a log of commits.

In batches it skips files by the smallest and largest values that the log has of each column;
as a stream, its offsets are numbers of commits, and a stream's writer takes each trigger once.
A commit's files come into view together. A folder takes one writer at a time. Files that a
lost task has left behind are in no commit and so are never read.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

#: Longer strings are kept in no bound.
LONGEST_BOUND = 64


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; a plain path or file: is a folder mounted on driver and executors."""
    if plain := re.match(r"file:/*(/.*)", path):
        path = plain[1]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _plain(value: object) -> object:
    """A value as JSON has it, in the same order; None for what has no bounds."""
    if isinstance(value, dt.datetime):
        return value.isoformat(timespec="microseconds") if value.tzinfo is None else None
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, str):
        return value if len(value) <= LONGEST_BOUND else None
    return value if isinstance(value, (bool, int, float)) else None


class _Bounds:
    """A column's nulls, and its smallest and largest value; ``known`` tells whether these hold. NaN, which Spark puts above all numbers, leaves them unknown."""

    def __init__(self, kind: pa.DataType):
        t = pa.types
        self.known = t.is_integer(kind) or t.is_floating(kind) or t.is_string(kind) or t.is_boolean(kind) or t.is_date32(kind) or (t.is_timestamp(kind) and kind.tz is None)
        self.nulls, self.low, self.high = 0, None, None

    def add(self, column: pa.Array) -> None:
        self.nulls += column.null_count
        if not self.known or column.null_count == len(column):
            return
        if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
            self.known = False
            return
        found = pc.min_max(column).as_py()
        low, high = _plain(found["min"]), _plain(found["max"])
        if low is None or high is None:
            self.known = False
            return
        self.low = low if self.low is None else min(self.low, low)
        self.high = high if self.high is None else max(self.high, high)


def may_hold(file: dict, wanted: D.Filter) -> bool:
    """Whether a file of the log can have rows that pass a filter; true wherever its bounds don't tell."""
    name = wanted.attribute if hasattr(wanted, "attribute") else ()
    bounds = file["bounds"].get(name[0]) if len(name) == 1 else None
    if bounds is None:
        return True
    if isinstance(wanted, D.IsNull):
        return bounds["nulls"] > 0
    if isinstance(wanted, D.IsNotNull):
        return bounds["nulls"] < file["rows"]
    if isinstance(wanted, D.In):
        return any(may_hold(file, D.EqualTo(name, v)) for v in wanted.value)
    if not isinstance(wanted, (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)):
        return True
    if bounds["nulls"] == file["rows"]:
        return False
    low, high, value = bounds["low"], bounds["high"], _plain(wanted.value)
    if not bounds["known"] or type(value) is not type(low) or (isinstance(value, float) and math.isnan(value)):
        return True
    if isinstance(wanted, D.EqualTo):
        return low <= value <= high
    if isinstance(wanted, (D.GreaterThan, D.GreaterThanOrEqual)):
        return high > value or (high == value and isinstance(wanted, D.GreaterThanOrEqual))
    return low < value or (low == value and isinstance(wanted, D.LessThanOrEqual))


class Log:
    """The commits of a folder, numbered from 0."""

    def __init__(self, path: str):
        self.fs, self.root = _opened(path)

    def _at(self, n: int) -> str:
        return f"{self.root}/_log/{n:020d}.json"

    def length(self) -> int:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/_log", allow_not_found=True))
        return max((int(f.base_name[:20]) + 1 for f in found if re.fullmatch(r"\d{20}\.json", f.base_name)), default=0)

    def commit(self, n: int) -> dict:
        with self.fs.open_input_stream(self._at(n)) as f:
            return json.loads(f.read())

    def files(self, start: int, end: int) -> list[dict]:
        return [f for n in range(start, end) for f in self.commit(n)["files"]]

    def current(self) -> list[dict]:
        """The files that make up the table: those since the last commit that replaced it."""
        out, n = [], self.length()
        while n:
            n -= 1
            commit = self.commit(n)
            out[:0] = commit["files"]
            if commit["replaces"]:
                break
        return out

    def schema(self) -> T.StructType:
        if not (n := self.length()):
            raise ValueError(f"{self.root} has no commits")
        return T.StructType.fromJson(self.commit(n - 1)["schema"])

    def last_trigger(self, stream: str) -> int:
        """The last trigger of a stream that is in the log, or -1."""
        for n in reversed(range(self.length())):
            commit = self.commit(n)
            if commit["stream"] == stream:
                return commit["trigger"]
        return -1

    def append(self, files: list[dict], schema: T.StructType, *, replaces: bool = False, stream: str | None = None, trigger: int = -1) -> None:
        n = self.length()
        self.fs.create_dir(f"{self.root}/_log", recursive=True)
        part = f"{self.root}/_log/{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps({"files": files, "schema": schema.jsonValue(), "replaces": replaces, "stream": stream, "trigger": trigger}).encode())
        self.fs.move(part, self._at(n))

    def remove(self, files: Iterable[dict]) -> None:
        for f in files:
            self.fs.delete_file(f"{self.root}/{f['name']}")


class _Part(D.InputPartition):
    def __init__(self, name: str):
        self.name = name


def _parts(files: list[dict]) -> list[_Part]:
    return [_Part(f["name"]) for f in files]


class _Read:
    """Spark doesn't tell such a source which columns a query uses; those of the schema given to the reader are read, and no others."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.columns = path, schema, schema.names

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's own part where there are none
            return
        store, root = _opened(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as f:
            names = pa.ipc.open_file(f).schema.names
            f.seek(0)
            batches = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in self.columns]))
            for i in range(batches.num_record_batches):
                yield batches.get_batch(i).select(self.columns)


class _Reader(_Read, D.DataSourceReader):
    filters: tuple = ()

    def pushFilters(self, filters: list[D.Filter]) -> list[D.Filter]:
        """Filters choose files; their rows are filtered by Spark, so all filters are given back."""
        self.filters = tuple(filters)
        return filters

    def partitions(self) -> list[_Part]:
        return _parts([f for f in Log(self.path).current() if all(may_hold(f, w) for w in self.filters)])


class _StreamReader(_Read, D.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": Log(self.path).length()}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return _parts(Log(self.path).files(start["commits"], end["commits"]))

    def commit(self, end: dict) -> None:
        """The log stays, so nothing is to be done."""


class _Written(D.WriterCommitMessage):
    def __init__(self, file: dict | None):
        self.file = file


def _files(messages: list) -> list[dict]:
    return [m.file for m in messages if m is not None and m.file is not None]


class _Write:
    """One Arrow file for each task that has rows, written batch by batch."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _opened(self.path)
        name, rows, bounds, sink, out = f"{uuid.uuid4().hex}.arrow", 0, {}, None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{name}")
                out = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                bounds = {f.name: _Bounds(f.type) for f in batch.schema}
            out.write_batch(batch)
            rows += batch.num_rows
            for c, b in bounds.items():
                b.add(batch.column(c))
        if out is None:
            return _Written(None)
        out.close()
        sink.close()
        return _Written({"name": name, "rows": rows, "bounds": {c: vars(b) for c, b in bounds.items()}})

    def _same_columns(self, log: Log) -> None:
        if log.length() and [(f.name, f.dataType) for f in log.schema()] != [(f.name, f.dataType) for f in self.schema]:
            raise ValueError(f"the table at {self.path} has other columns: {log.schema().simpleString()}")


class _Writer(_Write, D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        super().__init__(path, schema)
        self.overwrite = overwrite
        if not overwrite:
            self._same_columns(Log(path))

    def commit(self, messages: list) -> None:
        """Older files stay for readers at work and for streams."""
        Log(self.path).append(_files(messages), self.schema, replaces=self.overwrite)

    def abort(self, messages: list) -> None:
        Log(self.path).remove(_files(messages))


class _StreamWriter(_Write, D.DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: T.StructType, stream: str):
        super().__init__(path, schema)
        self.stream = stream
        self._same_columns(Log(path))

    def commit(self, messages: list, batchId: int) -> None:
        """A trigger that the log has already, as after a restart, isn't taken again."""
        log = Log(self.path)
        if batchId <= log.last_trigger(self.stream):
            log.remove(_files(messages))
        else:
            log.append(_files(messages), self.schema, stream=self.stream, trigger=batchId)

    def abort(self, messages: list, batchId: int) -> None:
        Log(self.path).remove(_files(messages))


class CommittedFiles(D.DataSource):
    """Format "commits". Options: path; stream, the name by which a stream's triggers are known in the log, needed where several streams write to one folder."""

    @classmethod
    def name(cls) -> str:
        return "commits"

    def schema(self) -> T.StructType:
        return Log(self.options["path"]).schema()

    def _asked(self, schema: T.StructType) -> tuple[str, T.StructType]:
        kinds = {f.name: f.dataType for f in self.schema()}
        for f in schema:
            if kinds.get(f.name) != f.dataType:
                raise ValueError(f"the table at {self.options['path']} has no column {f.name} of type {f.dataType.simpleString()}")
        return self.options["path"], schema

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(*self._asked(schema))

    def streamReader(self, schema: T.StructType) -> _StreamReader:
        return _StreamReader(*self._asked(schema))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options["path"], schema, self.options.get("stream", ""))


def register(spark: SparkSession) -> None:
    """Make format("commits") known to the session, and let Spark hand filters to sources in Python."""
    spark.dataSource.register(CommittedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
