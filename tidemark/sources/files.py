"""Bars and fact frames as files ``{symbol}.{timeframe}[.{part}].parquet``: a data source with one partition a file.

Filters on symbol and timeframe are pushed into the listing, so other files are never opened; columns that a schema names but a file lacks
fail for bars and are null for frames. Load anew for each query: Spark keeps what filters a loaded frame's last query has pushed. Writing is in two steps: tasks write under a hidden folder and say what they wrote; the commit moves
those files in and takes the older files of the same keys away. Paths are what pyarrow's file systems open. ``session``, ``load`` and ``save`` do the registering.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions.timeframes import MINUTES

KEYS = ("symbol", "timeframe")
BARS = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"
_NAME = re.compile(rf"^(.+)\.({'|'.join(MINUTES)})(?:\.[0-9a-f]+-\d+)?\.parquet$")


@contextlib.contextmanager
def active(session: SparkSession) -> Iterator[None]:
    """Names of data sources are looked up in the active session: ``session``, meanwhile."""
    jvm = session._jvm.org.apache.spark.sql.SparkSession
    before = jvm.getActiveSession()
    jvm.setActiveSession(session._jsparkSession)
    try:
        yield
    finally:
        jvm.setActiveSession(before.get()) if before.isDefined() else jvm.clearActiveSession()


def session(spark: SparkSession) -> SparkSession:
    """A session of its own in which the source is registered and filters are pushed to it."""
    own = spark.newSession()
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    with active(own):
        own.dataSource.register(BarFiles)
    return own


def load(own: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The bars under ``path``, or the fact frames, where their ``schema`` is given, through a ``session``."""
    with active(own):
        reader = own.read.format("bar_files")
        return (reader.schema(schema) if schema else reader).load(path)


def save(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``rows`` of a ``session`` as files; overwrite replaces the keys that they have, append adds files."""
    with active(rows.sparkSession):
        rows.write.format("bar_files").mode(mode).save(path)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _listed(fs: pafs.FileSystem, root: str) -> list[tuple[str, str, str]]:
    """(path, symbol, timeframe) of the files in a folder; other names are passed over."""
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f.path, *m.groups()) for f in found if f.type == pafs.FileType.File and (m := _NAME.match(f.base_name)))


@dataclass
class OneFile(InputPartition):
    path: str
    symbol: str
    timeframe: str


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, strict: bool) -> None:
        self.path, self.schema, self.strict = path, schema, strict
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                these = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], these) & these
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        keep = lambda k, v: k not in self.only or v in self.only[k]
        return [OneFile(p, s, t) for p, s, t in _listed(*_open(self.path)) if keep("symbol", s) and keep("timeframe", t)] or [OneFile("", "", "")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kinds = to_arrow_schema(self.schema)
        with pq.ParquetFile(partition.path, filesystem=_open(self.path)[0]) as file:
            held = file.schema_arrow.names
            wanted = [f.name for f in kinds if f.name not in KEYS]
            if self.strict and (lacking := [c for c in wanted if c not in held]):
                raise ValueError(f"{partition.path} lacks {lacking}")
            for batch in file.iter_batches(columns=[c for c in wanted if c in held]):
                n, own = batch.num_rows, {"symbol": partition.symbol, "timeframe": partition.timeframe}
                columns = [pa.repeat(pa.scalar(own[f.name], f.type), n) if f.name in own else pc.cast(batch.column(f.name), f.type) if f.name in held else pa.nulls(n, f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, replace: bool) -> None:
        self.path, self.run, self.replace = path, uuid.uuid4().hex, replace

    def _waiting(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = _open(self.path)
        return fs, root, f"{root}/_{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file for each key that the task has rows of; a key may have several files, by several tasks."""
        from pyspark import TaskContext

        fs, _, waiting = self._waiting()
        fs.create_dir(waiting, recursive=True)
        task, open_ = TaskContext.get().taskAttemptId(), {}
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                pairs = table.select(KEYS).group_by([*KEYS]).aggregate([])
                for symbol, timeframe in zip(pairs["symbol"].to_pylist(), pairs["timeframe"].to_pylist(), strict=True):
                    if timeframe not in MINUTES or not symbol or "/" in symbol:
                        raise ValueError(f"no file can be named for {symbol}, {timeframe}")
                    some = table.filter((pc.field("symbol") == symbol) & (pc.field("timeframe") == timeframe)).drop_columns([*KEYS])
                    name = f"{symbol}.{timeframe}.{self.run[:8]}-{task}.parquet"
                    if name not in open_:
                        open_[name] = (symbol, timeframe, pq.ParquetWriter(f"{waiting}/{name}", some.schema, filesystem=fs))
                    open_[name][2].write_table(some)
        finally:
            for *_, file in open_.values():
                file.close()
        return Written([(name, s, t) for name, (s, t, _) in open_.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root, waiting = self._waiting()
        new = [f for m in messages if m for f in m.files]
        old = _listed(fs, root)
        for name, *_ in new:
            fs.move(f"{waiting}/{name}", f"{root}/{name}")
        keys = {(s, t) for _, s, t in new}
        for path, s, t in old if self.replace else ():
            if (s, t) in keys:
                fs.delete_file(path)
        if fs.get_file_info(waiting).type == pafs.FileType.Directory:
            fs.delete_dir(waiting)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _, waiting = self._waiting()
        if fs.get_file_info(waiting).type == pafs.FileType.Directory:
            fs.delete_dir(waiting)


class BarFiles(DataSource):
    """``load(path)`` reads bars, or fact frames where a schema with symbol and timeframe is given; mode overwrite replaces the keys that are written, append adds files."""

    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return BARS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, {"open", "high", "low", "close", "volume"} <= {*schema.names})

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)
