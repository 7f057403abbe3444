"""Data sources that Spark's own readers and writers do not offer.

* ``read_shards`` (S2): numbered CSV shards, some to a partition, with bounded
  retry; shards that are given up come back as a report, not as a failed job.
* ``read_blob_ranges`` (S1): CSV files with line breaks within quotes, read in
  byte ranges, so that one large file is many tasks.
* ``write_numbered_jsonl`` (S10): files ``chunk_{i}.jsonl`` of exactly so many
  rows, in the order of the rows; a task writes under names of its own attempt,
  and the files get their names when all tasks have succeeded.

Files are opened with ``pyarrow.fs`` by the tasks, so any file system that all
executors reach will do.
"""

from __future__ import annotations

import csv
import io
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quarry.functions.text import split_repo_path
from quarry.operators.split import with_row_index
from quarry.session import stored


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def open_stream(uri: str):
    """A binary stream over a whole file."""
    fs, path = file_system(uri)
    return fs.open_input_stream(path)


# --- S2: numbered shards ---------------------------------------------------------------------

SHARD_TASKS = 4  # partitions of shards for each core, at most


@dataclass
class Shards(InputPartition):
    numbers: list[int]


def read_shards(spark: SparkSession, template: str, numbers: list[int], *, attempts: int = 3, delay: float = 2.0,
                opener: Callable = open_stream, repo_path: str = "repo_path") -> tuple[DataFrame, DataFrame]:
    """(repo, path, content of the shards ``template.format(i)``; number,
    uri and error of the shards given up after ``attempts``).

    A shard is read whole before its first row is given out, so a failed
    attempt leaves no rows behind; a task reads several shards, one after the
    other, and holds one at a time. Both results are of one reading, which is
    stored."""
    n_tasks = max(1, min(len(numbers), SHARD_TASKS * spark.sparkContext.defaultParallelism))

    class Reader(DataSourceReader):
        def partitions(self):
            return [Shards(numbers[a::n_tasks]) for a in range(n_tasks)]

        def read(self, partition):
            for number in partition.numbers:
                yield from self._shard(number, template.format(number))

        @staticmethod
        def _shard(number, uri):
            error = None
            for attempt in range(attempts):
                if attempt and delay > 0:
                    time.sleep(delay)
                try:
                    with opener(uri) as f:
                        text = f.read().decode("utf-8")
                    rows = list(csv.DictReader(io.StringIO(text, newline="")))
                    if rows and not {repo_path, "content"} <= rows[0].keys():
                        raise ValueError(f"no columns {repo_path}, content")
                    for row in rows:
                        yield number, uri, row[repo_path], row["content"], None
                    return
                except Exception as e:  # noqa: BLE001 - whatever the store raises is a failed attempt
                    error = f"{type(e).__name__}: {e}"
            yield number, uri, None, None, error

    class ShardSource(DataSource):
        @classmethod
        def name(cls):
            return "quarry_shards"

        def schema(self):
            return "shard int, uri string, repo_path string, content string, error string"

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(ShardSource)
    rows = stored(spark.read.format("quarry_shards").load(), "shards")
    repo, path = split_repo_path(F.col("repo_path"))
    return (rows.filter("error IS NULL").select(repo.alias("repo"), path.alias("path"), "content"),
            rows.filter("error IS NOT NULL").select("shard", "uri", "error"))


# --- S1: one CSV file in many tasks ----------------------------------------------------------

READ_BYTES = 1 << 20
TASK_BYTES = 64 << 20
RANGE_TASKS = 4  # tasks for each core, at most, that ranges are dealt to


def _ranges(spark: SparkSession, paths: list[str], range_bytes: int) -> DataFrame:
    """file, start, stop over all files; the list of files is on the driver, as in any reader."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length"))
    return (files.filter("length > 0")
            .select("file", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
            .select("file", "start", F.least(F.col("start") + range_bytes, "length").alias("stop")))


def _bytes(f, start: int, stop: int) -> Iterator[bytes]:
    while start < stop:
        data = f.read_at(min(READ_BYTES, stop - start), start)
        if not data:
            return
        yield data
        start += len(data)


def read_blob_ranges(spark: SparkSession, path, *, range_bytes: int = 64 << 20, repo_path: str = "repo_path") -> DataFrame:
    """The rows of ``read_blobs`` from the same CSV files (quoted as
    RFC 4180 says), in ranges of ``range_bytes`` of a file. A range is a task
    of its own; many small ranges are dealt to a number of tasks that follows
    the cores and, at ``TASK_BYTES`` each, the size of the files.

    A first pass counts the quotes of every range; the sum of those before a
    range tells whether it begins within quotes, so every task knows by itself
    which line breaks end a record. A range gives the records that begin in it."""
    paths = [path] if isinstance(path, str) else list(path)
    ranges = _ranges(spark, paths, range_bytes)
    n_ranges, size = ranges.agg(F.count("*"), F.sum(F.col("stop") - F.col("start"))).first()
    n = max(1, min(n_ranges, max(RANGE_TASKS * spark.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES)))
    ranges = ranges.repartition(n, "file", "start")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quotes = []
            for r in b.to_pylist():
                fs, p = file_system(r["file"])
                with fs.open_input_file(p) as f:
                    quotes.append(sum(data.count(b'"') for data in _bytes(f, r["start"], r["stop"])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(quotes, pa.int64())], names=[*b.schema.names, "quotes"])

    counted = stored(ranges.mapInArrow(count, "file string, start long, stop long, quotes long"), "csv-ranges")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    marked = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).repartition(n, "file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers: dict[str, list[int]] = {}
        for b in batches:
            for r in b.to_pylist():
                rows: list[list] = []
                header = headers.get(r["file"])
                for record, number in _records(r):
                    if header is None:
                        header = headers[r["file"]] = _header(r["file"], repo_path)
                    if number == 0:
                        continue  # the header itself
                    fields = _fields(record)
                    rows.append([fields[k] if k < len(fields) else None for k in header])
                    if len(rows) >= 1024:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], pa.string()) for i in (0, 1)], names=["repo_path", "content"])

    found = marked.select("file", "start", "stop", "inside").mapInArrow(read, "repo_path string, content string")
    repo, file_path = split_repo_path(F.col("repo_path"))
    return found.select(repo.alias("repo"), file_path.alias("path"), "content")


def _records(r: dict) -> Iterator[tuple[bytes, int]]:
    """(record, its number if it is the file's first, else 1) of the records
    that begin in the range: at 0, or behind a line break outside quotes."""
    fs, p = file_system(r["file"])
    with fs.open_input_file(p) as f:
        size = f.size()
        at = r["start"]
        held = bytearray()
        inside = bool(r["inside"])
        begun = at == 0  # whether ``held`` is the beginning of a record of this range
        if at and not inside and f.read_at(1, at - 1) == b"\n":
            begun = True
        first = at == 0
        origin = at  # where ``held`` begins in the file
        while at < size:
            data = f.read_at(min(READ_BYTES, size - at), at)
            k = 0
            while k < len(data):
                end = data.find(b"\n", k)
                stop = len(data) if end < 0 else end + 1
                inside ^= data.count(b'"', k, stop) % 2 == 1
                if begun:
                    held += data[k:stop]
                if end >= 0 and not inside:
                    if begun:
                        yield bytes(held), 0 if first else 1
                    first = False
                    held.clear()
                    begun = True
                    origin = at + stop
                    if origin >= r["stop"]:
                        return
                k = stop
            at += len(data)
        if begun and held:
            yield bytes(held), 0 if first else 1


def _fields(record: bytes) -> list[str | None]:
    """The fields of a record: a field without quotes that is empty or ``\\N`` is null."""
    text = record.decode("utf-8").removesuffix("\n").removesuffix("\r")
    out: list[str | None] = []
    at, n = 0, len(text)
    while at <= n:
        if at < n and text[at] == '"':
            end = at + 1
            while True:
                end = text.find('"', end)
                if end < 0:
                    end = n
                    break
                if text.startswith('""', end):
                    end += 2
                    continue
                break
            out.append(text[at + 1:end].replace('""', '"'))
            at = end + 2
        else:
            end = text.find(",", at)
            end = n if end < 0 else end
            own = text[at:end]
            out.append(None if own in ("", "\\N") else own)
            at = end + 1
    return out


def _header(file: str, repo_path: str) -> list[int]:
    """The places of the two columns in a file."""
    first = next(_records({"file": file, "start": 0, "stop": 1, "inside": False}))[0]
    names = _fields(first)
    return [names.index(repo_path), names.index("content")]


# --- S10: numbered chunks --------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary name, final name


def write_numbered_jsonl(df: DataFrame, path: str, order: list, rows_per_file: int = 1000) -> None:
    """``path/chunk_{i}.jsonl``, rows i * ``rows_per_file`` up to the next
    chunk's in ``order`` (the last chunk holds what is left). An empty table
    writes no file. If a task fails for good, no chunk appears."""
    base = path.rstrip("/")
    attempt_of_job = uuid.uuid4().hex

    class Writer(DataSourceWriter):
        def write(self, rows):
            fs, root = file_system(base)
            fs.create_dir(root, recursive=True)
            files, out, current = [], None, None
            mark = uuid.uuid4().hex
            try:
                for row in rows:
                    if row.chunk != current:
                        if out is not None:
                            out.close()
                        current = row.chunk
                        final = f"{root}/chunk_{current}.jsonl"
                        files.append((f"{root}/.{attempt_of_job}-{mark}-{current}", final))
                        out = fs.open_output_stream(files[-1][0])
                    out.write(row.value.encode("utf-8") + b"\n")
            finally:
                if out is not None:
                    out.close()
            return Written(files)

        def commit(self, messages):
            fs, _ = file_system(base)
            for m in messages:
                for temporary, final in (m.files if m else ()):
                    fs.move(temporary, final)
            self._drop_rest(fs)

        def abort(self, messages):
            self._drop_rest(file_system(base)[0])

        @staticmethod
        def _drop_rest(fs):
            """Files of this job's attempts that did not become chunks."""
            root = file_system(base)[1]
            for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if info.base_name.startswith(f".{attempt_of_job}-"):
                    fs.delete_file(info.path)

    class Chunks(DataSource):
        @classmethod
        def name(cls):
            return "quarry_chunks"

        def writer(self, schema, overwrite):
            return Writer()

    columns = [F.col(f"`{c}`") for c in df.columns]
    indexed = with_row_index(df.select(F.to_json(F.struct(*columns)).alias("value"), *columns), order, "place")
    chunks = (indexed.select(F.floor(F.col("place") / rows_per_file).cast("long").alias("chunk"), "place", "value")
              .repartitionByRange("chunk").sortWithinPartitions("place").select("chunk", "value"))
    df.sparkSession.dataSource.register(Chunks)
    chunks.write.format("quarry_chunks").mode("append").save()
