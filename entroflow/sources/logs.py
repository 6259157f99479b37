"""Text logs, zipped or plain, with a date in each file's name: a data source that reads and writes them in parallel.

    logs.register(spark)
    spark.read.format("dated_logs").load(folder).where("file_date >= DATE'2024-01-01'")
    df.select("file_date", "line").write.format("dated_logs").mode("append").save(folder)

Reading gives a row a line: file, file_date, member, line_no (from 0, in its member) and line. A file's date is the first
eight digits in its name that are a date; other files have none. Files are listed by name and size alone, those that
conditions on file_date leave out aren't opened, and the rest are dealt to tasks by size. Members of a zip file are streamed
one after another, so neither a file nor a member is ever held whole. A damaged file raises.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT = "dated_logs"
SCHEMA = "file string, file_date date, member string, line_no long, line string"
_ARROW = pa.schema([("file", pa.string()), ("file_date", pa.date32()), ("member", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])
#: Bytes of files that one task reads, unless a single file is larger.
TASK_BYTES = 64 << 20
BATCH_LINES, BATCH_CHARS = 10_000, 4 << 20


def date_of(name: str) -> dt.date | None:
    """The first eight digits of a name that are a date."""
    for digits in re.findall(r"(?=(\d{8}))", name):
        try:
            return dt.datetime.strptime(digits, "%Y%m%d").date()
        except ValueError:
            continue
    return None


def _kept(date: dt.date | None, f: Filter) -> bool:
    if isinstance(f, IsNotNull):
        return date is not None
    if date is None:
        return False
    match f:
        case In():
            return date in f.value
        case EqualTo():
            return date == f.value
        case GreaterThan():
            return date > f.value
        case GreaterThanOrEqual():
            return date >= f.value
        case LessThan():
            return date < f.value
        case _:
            return date <= f.value


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


def dealt(files: Iterable[tuple[str, int]], task_bytes: int) -> list[Files]:
    """Files (name, bytes) in runs of about task_bytes, in order of their names."""
    out, run, size = [], [], 0
    for name, n in sorted(files):
        if run and size + n > task_bytes:
            out.append(Files(tuple(run)))
            run, size = [], 0
        run.append(name)
        size += n
    return [*out, Files(tuple(run))] if run else out


class LogReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes, self.filters = path, task_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on file_date choose files; the others stay with Spark."""
        known = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)
        for f in filters:
            if isinstance(f, known) and f.attribute == ("file_date",):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
        return dealt(((f.path, f.size) for f in found if all(_kept(date_of(f.base_name), c) for c in self.filters)), self.task_bytes)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for name in partition.names if partition else ():
            file = name.rpartition("/")[2]
            if name.endswith(".zip"):
                with fs.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                    for member in z.infolist():
                        if not member.is_dir():
                            with z.open(member) as lines:
                                yield from _batches(file, member.filename, lines)
            else:
                with io.BufferedReader(fs.open_input_stream(name)) as lines:  # decompressed as its suffix says
                    yield from _batches(file, None, lines)


def _batches(file: str, member: str | None, lines: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    date, held, chars, first = date_of(file), [], 0, 0

    def batch() -> pa.RecordBatch:
        n = len(held)
        columns = [[file] * n, [date] * n, [member] * n, range(first, first + n), held]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)

    for raw in lines:
        held.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
        chars += len(raw)
        if len(held) >= BATCH_LINES or chars >= BATCH_CHARS:
            yield batch()
            first, held, chars = first + len(held), [], 0
    if held:
        yield batch()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class LogWriter(DataSourceArrowWriter):
    """A task writes a zip file for each stretch of rows of one date, under a name that readers pass over until the job commits."""

    def __init__(self, path: str, overwrite: bool):
        if overwrite:
            raise ValueError("log folders are only appended to")
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root)
        names, day, stack = [], None, []

        def close():
            while stack:
                stack.pop().close()

        try:
            for b in iterator:
                for date, line in zip(b.column("file_date").to_pylist(), b.column("line").to_pylist()):
                    if not stack or date != day:
                        close()
                        day = date
                        label = f"log_{date:%Y%m%d}" if date else "log_undated"
                        # Hexadecimal digits could look like a date.
                        token = uuid.uuid4().hex.translate(str.maketrans("0123456789", "ghijklmnop"))
                        names.append(f"{label}_{token}.zip")
                        stack.append(fs.open_output_stream(f"{root}/_{names[-1]}", compression=None))
                        stack.append(zipfile.ZipFile(stack[0], "w", zipfile.ZIP_DEFLATED))
                        stack.append(stack[1].open(f"{label}.txt", "w", force_zip64=True))
                    stack[-1].write((line or "").encode() + b"\n")
        finally:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/_{name}")


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with its conditions pushed down to file names."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)


def read_logs(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Lines of the files in a folder, those dated from start to end (inclusive) where given."""
    register(spark)
    df = spark.read.format(FORMAT).load(path)
    if start is not None:
        df = df.where(F.col("file_date") >= F.lit(start))
    return df if end is None else df.where(F.col("file_date") <= F.lit(end))


def write_logs(df: DataFrame, path: str, order: str = "line") -> None:
    """Write lines (file_date, line) as zip files under path; a day with many rows becomes several files.

    Rows are dealt by ranges of (file_date, order) and stay in that order within a file. A null line is an empty one, and a
    line break within a line separates two.
    """
    register(df.sparkSession)
    rows = df.repartitionByRange("file_date", order).sortWithinPartitions("file_date", order).select("file_date", "line")
    rows.write.format(FORMAT).mode("append").save(path)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, length, modified of a folder's files whose name fits the pattern, in no order; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.col("modificationTime").alias("modified"))
