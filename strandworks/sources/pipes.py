"""Processes as operators, sources and sinks.

Data goes through a process in pieces: a feeder thread writes its input while the task
reads its outputs, so neither side waits for the other for ever, and a task holds some
pieces only, however large its partition is. A command that ends with another status
than 0 fails its task, with the end of what it said on its error stream; a command that
stops reading early and ends well is fine. Further outputs of a command are pipes, whose
names (``/dev/fd/7``) stand in its arguments for ``{name}``. Nothing is put on disk.

Commands are lists of arguments; nothing goes through a shell unless the list names one.
"""

from __future__ import annotations

import json
import os
import selectors
import subprocess
import threading
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType, StringType, StructType

from strandworks.sources.sink import fill_template

NAME = "strandworks_command"
PIECE = 1 << 20
ROWS = 20_000  # of an output batch
SAID = 4096  # bytes kept of an error stream


class CommandFailed(RuntimeError):
    """A command ended with another status than 0."""


def run(command: list[str], pieces: Iterable[bytes] = (), outputs: tuple[str, ...] = ()) -> Iterator[tuple[str, bytes]]:
    """Feed ``pieces`` to a command; gives ``(output, bytes)`` as they come, of its standard output (``""``) and of ``outputs``."""
    pipes = {name: os.pipe() for name in outputs}
    args = [a if not outputs else _named(a, {n: f"/dev/fd/{w}" for n, (_, w) in pipes.items()}) for a in command]
    try:
        process = subprocess.Popen(args, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, pass_fds=[w for _, w in pipes.values()], bufsize=0)
    except BaseException:
        for ends in pipes.values():
            for fd in ends:
                os.close(fd)
        raise
    for _, w in pipes.values():
        os.close(w)
    failed: list[BaseException] = []

    def feed() -> None:
        try:
            for piece in pieces:
                view = memoryview(piece)
                while view:
                    view = view[process.stdin.write(view) :]
        except BrokenPipeError:
            pass  # it has read enough
        except BaseException as error:  # of the input: the task fails with it
            failed.append(error)
            process.kill()
        finally:
            try:
                process.stdin.close()
            except BrokenPipeError:
                pass

    said: deque[bytes] = deque()
    feeder = threading.Thread(target=feed, daemon=True)
    feeder.start()
    watch = selectors.DefaultSelector()
    for name, source in (("", process.stdout.fileno()), (None, process.stderr.fileno()), *((n, r) for n, (r, _) in pipes.items())):
        watch.register(source, selectors.EVENT_READ, name)
    try:
        while watch.get_map():
            for key, _ in watch.select():
                data = os.read(key.fd, PIECE)
                if not data:
                    watch.unregister(key.fd)
                elif key.data is None:
                    said.append(data[-SAID:])
                    while sum(map(len, said)) - len(said[0]) >= SAID:
                        said.popleft()
                else:
                    yield key.data, data
        status = process.wait()
        feeder.join()
        if failed:
            raise failed[0]
        if status:
            raise CommandFailed(f"{command[0]} ended with {status}: {b''.join(said)[-SAID:].decode(errors='replace').strip()}")
    finally:
        if process.poll() is None:
            process.kill()
            process.wait()
        watch.close()
        process.stdout.close()
        process.stderr.close()
        for r, _ in pipes.values():
            os.close(r)


def _named(text: str, names: dict[str, str]) -> str:
    for name, value in names.items():
        text = text.replace("{" + name + "}", value)
    return text


def lines(found: Iterable[tuple[str, bytes]]) -> Iterator[tuple[str, list[bytes]]]:
    """Whole lines of each output, as they come; a last line need not end."""
    rest: dict[str, list[bytes]] = {}
    for name, data in found:
        held = rest.setdefault(name, [])
        cut = data.rfind(b"\n")
        if cut < 0:
            held.append(data)
            continue
        whole = b"".join([*held, data[:cut]]).split(b"\n")
        held[:] = [data[cut + 1 :]]
        yield name, whole
    for name, held in rest.items():
        last = b"".join(held)
        if last:
            yield name, [last]


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[bytes]:
    """Each record and a line end, some at once; null records are left out."""
    for batch in batches:
        held, size = [], 0
        for x in batch.column(column):
            value = x.as_py()
            if value is not None:
                held.append(value)
                size += len(value)
            if size > PIECE:
                yield "".join(f"{v}\n" for v in held).encode()
                held, size = [], 0
        if held:
            yield "".join(f"{v}\n" for v in held).encode()


def _line_batches(found: Iterable[tuple[str, list[bytes]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for name, whole in found:
        for i in range(0, len(whole), ROWS):
            some = pa.array(whole[i : i + ROWS], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([some] if names == ["line"] else [pa.array([name] * len(some)), some], names)


def pipe_to(df: DataFrame, command: list[str], column: str = "record", outputs: tuple[str, ...] = ()) -> DataFrame:
    """Feed each partition's records to a command; the lines of its outputs come back.

    Rows are ``line``, or with ``outputs`` also ``output`` (empty for the standard
    output). A process runs for each partition, without rows too; order is kept. A
    line break inside a record makes lines of their own.
    """
    names = ["output", "line"] if outputs else ["line"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _line_batches(lines(run(command, _pieces(batches, column), outputs)), names)

    return df.select(F.col(column).cast("string").alias(column)).mapInArrow(go, ", ".join(f"{n} string" for n in names))


def run_commands(df: DataFrame, column: str = "command") -> DataFrame:
    """``df`` with ``status`` and ``said`` (the end of the error stream) of a shell command in each row; rows of a partition run one after another.

    A command that fails does not fail the job: its status tells. A null command has a null status.
    """
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, command in enumerate(batch.column(column).to_pylist()):
                status, said = None, None
                if command is not None:
                    status, said = 0, ""
                    try:
                        for _ in run(["/bin/sh", "-c", command]):
                            pass
                    except CommandFailed as error:
                        status, said = int(str(error).split("ended with ")[1].split(":")[0]), str(error).split(": ", 1)[1]
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([status], pa.int32()), pa.array([said], pa.string())], [*row.schema.names, "status", "said"])

    return df.mapInArrow(go, StructType([*df.schema.fields]).add("status", IntegerType()).add("said", StringType()))


# ---------------------------------------------------------- a source and a sink


@dataclass
class _Part(InputPartition):
    number: int
    of: int


@dataclass
class Fed(WriterCommitMessage):
    partition: int
    rows: int
    size: int


class CommandSource(DataSource):
    """Options: ``command`` (JSON list; ``{FileNum}``, ``{NumFiles}`` and ``{Uniq}`` name the partition) and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "partition int, line_no long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Feeder(dict(self.options))


def _of_part(options: dict[str, str], number: int, of: int) -> list[str]:
    return [fill_template(a, number, of) for a in json.loads(options["command"])]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.options, self.columns = options, columns

    def partitions(self) -> list[_Part]:
        n = int(self.options.get("partitions", 1))
        return [_Part(i, n) for i in range(n)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        at = 0
        for _, whole in lines(run(_of_part(self.options, part.number, part.of))):
            for i in range(0, len(whole), ROWS):
                some = whole[i : i + ROWS]
                made = {"partition": pa.array([part.number] * len(some), pa.int32()), "line_no": pa.array(range(at, at + len(some)), pa.int64()), "line": pa.array(some, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)
                at += len(some)


class _Feeder(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fed:
        number, counts = TaskContext.get().partitionId(), [0, 0]

        def counted() -> Iterator[bytes]:
            for batch in iterator:
                counts[0] += batch.num_rows - batch.column(0).null_count
                for piece in _pieces(iter([batch]), batch.schema.names[0]):
                    counts[1] += len(piece)
                    yield piece

        for _ in run(_of_part(self.options, number, int(self.options["partitions"])), counted()):
            pass  # what it says on its standard output is not wanted
        return Fed(number, *counts)


def read_command(spark: SparkSession, command: list[str], partitions: int = 1) -> DataFrame:
    """``partition, line_no, line``: the lines that a command gives, run once for each partition.

    ``{FileNum}``, ``{NumFiles}`` and ``{Uniq}`` in its arguments name the partition. The
    command runs again where a partition is read again, so it has to say the same.
    """
    spark.dataSource.register(CommandSource)
    return spark.read.format(NAME).option("command", json.dumps(command)).option("partitions", str(partitions)).load()


def write_command(df: DataFrame, command: list[str], column: str = "record", partitions: int | None = None) -> None:
    """Feed each partition's records to a process of its own; a failing one fails the job.

    ``partitions``, if given, deals the rows out anew; names in ``command`` are those of
    :func:`read_command`. A task may run more than once, so a command that keeps what
    it gets should write it under ``{Uniq}`` and replace what is there.
    """
    df.sparkSession.dataSource.register(CommandSource)
    rows = df.select(F.col(column).cast("string").alias("record"))
    n = partitions or rows.rdd.getNumPartitions()
    rows = rows.repartition(n) if partitions else rows
    rows.write.format(NAME).option("command", json.dumps(command)).option("partitions", str(n)).mode("append").save()
