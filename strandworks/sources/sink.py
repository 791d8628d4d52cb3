"""A Spark data source that writes rows to several named files in one pass, and joins parts to one file.

Each task writes the rows it has to a piece for each file that its rows name; no task
owns a file. Pieces lie in a folder of the job. When all tasks are done, the driver's
commit gives the pieces of each file their names, in order of the partitions, by a
template; or they are joined, in the same order, to one file: the sum of the pieces
before is a piece's place, and tasks copy byte ranges to their places. A failed job
removes its folder, so does a job that ends well, and with it what killed attempts of
tasks have left.

Rows are ordered as the DataFrame's partitions are, so a DataFrame that is dealt out by
range and sorted within gives ordered files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from strandworks.sources.scan import open_at

NAME = "strandworks_files"
MOST_OPEN = 64  # files that a task has open; more are closed and go on in a new piece
COPY_BYTES = 64 << 20
MADE = "_made.json"  # in the job's folder: what the commit made, for write_files


def fill_template(template: str, number: int, of: int, key: str = "", second_dim: int = 0) -> str:
    """A part's file name: ``{Key} {FileNum} {NumFiles} {Uniq}`` and, for numbers of two digits of base ``second_dim``, ``{FirstNum} {SecondNum} {UniqFirst} {UniqSecond}``.

    Numbers have six digits and count from 0; ``{Uniq}`` is ``000001of000004``. Without
    ``second_dim`` the names of two digits stay as they are.
    """
    values = {"Key": key, "FileNum": f"{number:06d}", "NumFiles": f"{of:06d}", "Uniq": f"{number:06d}of{of:06d}"}
    if second_dim > 0:
        first_dim = of // second_dim if second_dim > 1 else of
        first, second = divmod(number, second_dim)
        values |= {"FirstNum": f"{first:06d}", "SecondNum": f"{second:06d}", "UniqFirst": f"{first:06d}of{first_dim:06d}", "UniqSecond": f"{second:06d}of{second_dim:06d}"}
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), template)


@dataclass
class Pieces(WriterCommitMessage):
    found: list  # (file, partition, piece, path, bytes, rows)


class FilesSink(DataSource):
    """Options: ``folder`` (a URI), ``job``, ``template``, ``single``, ``second_dim``; columns ``file`` and ``record``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, record string"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.job = options["folder"].rstrip("/"), f"_job-{options['job']}"
        self.template, self.single, self.second_dim = options["template"], options.get("single") == "true", int(options.get("second_dim", 0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pieces:
        context = TaskContext.get()
        store, folder = open_at(f"{self.folder}/{self.job}")
        partition, attempt = context.partitionId(), context.taskAttemptId()
        open_: OrderedDict[str | None, list] = OrderedDict()  # file: stream, entry
        found: list[list] = []

        def stream(key: str | None) -> list:
            if key in open_:
                open_.move_to_end(key)
                return open_[key]
            if len(open_) >= MOST_OPEN:
                open_.popitem(last=False)[1][0].close()
            path = f"{folder}/{partition}-{attempt}-{len(found)}"
            entry = [key, partition, len(found), path, 0, 0]
            found.append(entry)
            open_[key] = [store.open_output_stream(path, compression=None), entry]
            return open_[key]

        try:
            for batch in iterator:
                keys, records = batch.column("file"), batch.column("record")
                for key in pc.unique(keys).to_pylist():
                    mine = records.filter(pc.is_null(keys) if key is None else pc.equal(keys, key))
                    text = "".join([f"{x}\n" for x in mine.to_pylist() if x is not None]).encode()
                    out, entry = stream(key)
                    out.write(text)
                    entry[4] += len(text)
                    entry[5] += len(mine) - mine.null_count
        finally:
            for out, _ in open_.values():
                out.close()
        return Pieces([tuple(x) for x in found])

    def commit(self, messages: list[Pieces | None]) -> None:
        """Pieces to named files; with ``single`` they stay, and :func:`join_parts` works from the list of them."""
        store, folder = open_at(self.folder)
        by_file: dict[str, list] = {}
        for m in messages:
            for key, partition, piece, path, size, rows in m.found if m else []:
                by_file.setdefault(key or "", []).append((partition, piece, path, size, rows))
        store.create_dir(f"{folder}/{self.job}", recursive=True)
        made: dict[str, list] = {key: sorted(found) for key, found in sorted(by_file.items())}
        if not self.single:
            for key, found in made.items():
                for i, (_, _, path, _, _) in enumerate(found):
                    found[i] = f"{folder}/{fill_template(self.template, i, len(found), key, self.second_dim)}"
                    store.move(path, found[i])
        with store.open_output_stream(f"{folder}/{self.job}/{MADE}") as out:
            out.write(json.dumps(made).encode())

    def abort(self, messages: list[Pieces | None]) -> None:
        store, folder = open_at(self.folder)
        if store.get_file_info(f"{folder}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.job}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI with its scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write_files(rows: DataFrame, folder: str, template: str = "{Key}{Uniq}", single: bool = False, second_dim: int = 0) -> list[str]:
    """Write ``record`` (a line, or lines) of each row to the file that its ``file`` names; returns the paths, in order.

    Each file has a part for each partition with rows of it, named by ``template``; with
    ``single`` it is one file, for which numbers are 0 of 1. A null ``file`` is the empty
    name, null records are left out, and without rows nothing is written. A file of the
    same name is replaced, nothing else in the folder changes.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FilesSink)
    uri, job = qualified(spark, folder), uuid.uuid4().hex
    store, name = open_at(uri)
    store.create_dir(f"{name}/_job-{job}", recursive=True)
    plain = rows.select(F.col("file").cast("string").alias("file"), F.col("record").cast("string").alias("record"))
    out = plain.write.format(NAME).option("folder", uri).option("job", job).option("template", template).option("single", str(single).lower()).option("second_dim", str(second_dim))
    try:
        out.mode("append").save()
        with store.open_input_stream(f"{name}/_job-{job}/{MADE}") as source:
            made = json.loads(source.read())
        if not single:
            return [path for found in made.values() for path in found]
        for key, found in made.items():
            target = f"{uri}/{fill_template(template, 0, 1, key, second_dim)}"
            join_parts(spark, [(path, size) for _, _, path, size, _ in found], target)
            made[key] = f"{name}/{fill_template(template, 0, 1, key, second_dim)}"
        return list(made.values())
    finally:
        if store.get_file_info(f"{name}/_job-{job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{name}/_job-{job}")


def _copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of parts to their places in a file that has its full length."""
    for batch in batches:
        done = []
        for source, start, size, target, place in zip(*(batch.column(c).to_pylist() for c in ("source", "start", "size", "target", "place"))):
            out = os.open(target, os.O_WRONLY)
            try:
                with open(source, "rb") as held:
                    held.seek(start)
                    left = size
                    while left:
                        data = held.read(min(left, 4 << 20))
                        if not data:
                            raise OSError(f"{source} is shorter than it was")
                        at = 0
                        while at < len(data):
                            at += os.pwrite(out, data[at:], place + size - left + at)
                        left -= len(data)
                os.fsync(out)
            finally:
                os.close(out)
            done.append(size)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["copied"])


def join_parts(spark: SparkSession, parts: list[tuple[str, int]], target: str, copy_bytes: int = COPY_BYTES) -> None:
    """One file of ``parts`` (paths and sizes) in their order, without a byte of them on the driver.

    In a shared POSIX folder the file gets its length first and tasks write byte ranges at
    their places, some ``copy_bytes`` each; a task that runs again writes the same bytes
    again. On HDFS the store joins blocks itself. It appears under its name when it is
    whole. Object stores have no places to write to: there, keep parts.
    """
    scheme = target.split(":", 1)[0] if ":" in target.split("/", 1)[0] else "file"
    bare = lambda x: re.sub(r"^file:/*", "/", x)
    if scheme == "file":
        final, hidden = bare(target), f"{os.path.dirname(bare(target))}/._{uuid.uuid4().hex}"
        with open(hidden, "wb") as out:
            out.truncate(sum(size for _, size in parts))
        rows, place = [], 0
        for path, size in parts:
            rows += [(bare(path), a, min(copy_bytes, size - a), hidden, place + a) for a in range(0, size, copy_bytes)]
            place += size
        try:
            if rows:
                table = spark.createDataFrame(rows, "source string, start long, size long, target string, place long")
                copied = table.repartition(min(len(rows), 4 * max(1, spark.sparkContext.defaultParallelism))).mapInArrow(_copy, "copied long").agg(F.sum("copied")).first()[0]
                if copied != place:
                    raise OSError(f"{copied} of {place} bytes were copied")
            os.replace(hidden, final)
        except BaseException:
            if os.path.exists(hidden):
                os.remove(hidden)
            raise
    elif scheme == "hdfs":
        jvm = spark._jvm.org.apache.hadoop.fs
        where, hidden = jvm.Path(target), jvm.Path(f"{target}._{uuid.uuid4().hex}")
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        store.create(hidden).close()
        some = [p for p, size in parts if size]
        if some:
            array = spark.sparkContext._gateway.new_array(jvm.Path, len(some))
            for i, p in enumerate(some):
                array[i] = jvm.Path(p)
            store.concat(hidden, array)
        store.delete(where, False)
        store.rename(hidden, where)
    else:
        raise ValueError(f"{scheme}: no file can be joined in this store; keep the parts")

