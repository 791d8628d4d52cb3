"""A Spark data source that scans FASTQ and FASTA files by record-aligned byte ranges.

A partition is a range of a file. It has the records that start in it; a record that
goes on into the next range is read to its end there. A range that begins inside a
record finds the next one: in FASTQ by lines of three records in a row that fit
(``@`` may begin a quality line too), in FASTA by a line that begins with ``>``. Mates
that follow each other are never torn: the second goes with the first.

Columns are pruned by the schema that is asked for. Ranges are read as streams of some
megabytes; a range holds no more than what a chunk and one record need. Compressed files
are one range each.

``spark.read.format("strandworks_reads")`` takes the options ``files`` (JSON, see
:func:`listed`), ``range_bytes``, ``firsts`` (JSON: number of the first record of each
range) and ``mode``: ``read``, or ``count`` for a row of statistics for each range.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "strandworks_reads"
RANGE_BYTES = 64 << 20
MOST_RANGES = 50_000  # ranges grow with the input beyond
CHUNK = 4 << 20
LOOK_BACK = 1 << 16
READ_SCHEMA = "read_id long, file_id int, head string, seq string, qual string"
COUNT_SCHEMA = "range int, file_id int, records long, low int, high int, mates long"
_SUFFIX = (".gz", ".bz2", ".zst", ".lz4", ".bgz")
_STEM = re.compile(rb"^[@>](\S*?)(?:/([12AFBR]))?(?:\s+([12]):[YN]:\S*)?(?:\s.*)?$", re.S)


@dataclass
class Range(InputPartition):
    number: int
    file_id: int
    uri: str
    kind: str
    begin: int
    end: int
    size: int  # of the file
    first: int = 0
    joiner: str = ""  # between the lines of a FASTA record


def uri_for_arrow(uri: str) -> str | None:
    """The URI as Arrow's file systems read it; None for a store that they do not know."""
    scheme = uri.split(":", 1)[0] if ":" in uri else "file"
    if scheme in ("s3a", "s3n"):
        return "s3" + uri[len(scheme) :]
    return uri if scheme in ("file", "hdfs", "s3", "gs", "abfs", "abfss") else None


def open_at(uri: str):
    store, name = fs.FileSystem.from_uri(uri_for_arrow(uri) or uri)
    return store, name


def listed(spark: SparkSession, *paths: str) -> list[dict] | None:
    """Files of each path (a file, folder or pattern) with sizes, by name; None if one is in a store that only Spark reads.

    The kind of a file is its first byte, ``@`` or ``>``; an empty file has none.
    """
    out = []
    for file_id, path in enumerate(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found = store.globStatus(where)
        if not found:
            raise FileNotFoundError(path)
        stack, files = list(found), []
        while stack:
            one = stack.pop()
            name = one.getPath().getName()
            if one.isDirectory():
                stack += list(store.listStatus(one.getPath()))
            elif not name.startswith(("_", ".")) or one.getPath().equals(where):
                files.append((one.getPath().toString(), one.getLen()))
        for uri, size in sorted(files):
            if uri_for_arrow(uri) is None:
                return None
            if size:
                packed = uri.endswith(_SUFFIX)
                store_, name = open_at(uri)
                with store_.open_input_stream(name, compression="detect") as source:
                    kind = source.read(1).decode("latin-1")
                out.append({"file_id": file_id, "uri": uri, "size": size, "kind": kind, "packed": packed})
    return out


def ranges_of(files: list[dict], range_bytes: int) -> list[Range]:
    """Ranges of all files in order; at most some MOST_RANGES."""
    step = max(1, range_bytes, -(-sum(f["size"] for f in files) // MOST_RANGES))
    out: list[Range] = []
    for f in files:
        cuts = [0] if f["packed"] else range(0, f["size"], step)
        for at in cuts:
            end = 1 << 62 if f["packed"] else min(at + step, f["size"])
            out.append(Range(len(out), f["file_id"], f["uri"], f["kind"], at, end, 1 << 62 if f["packed"] else f["size"], 0, f.get("joiner", "")))
    return out


def is_mates(a: bytes | None, b: bytes | None) -> bool:
    """Are these the header lines of the first and the second read of a pair?"""
    if a is None or b is None:
        return False
    x, y = _STEM.match(a.rstrip()), _STEM.match(b.rstrip())
    if not x or not y or x[1] != y[1]:
        return False
    one, two = x[2] or x[3], y[2] or y[3]
    return one in (b"1", b"A", b"F") and two in (b"2", b"B", b"R")


# ---------------------------------------------------------------------- one file


class _Source:
    """A file that is read forward from a place; compressed ones from the start only."""

    def __init__(self, uri: str, packed: bool) -> None:
        store, name = open_at(uri)
        self.packed = packed
        self.file = store.open_input_stream(name, compression="detect") if packed else store.open_input_file(name)

    def chunks(self, at: int, size: int) -> Iterator[bytes]:
        if not self.packed:
            self.file.seek(at)
        while True:
            data = self.file.read(CHUNK)
            if not data:
                return
            yield data


def fastq_start(data: bytes, at_line_start: bool, records: int = 3) -> int | None:
    """Place of the first record in ``data``; None if ``data`` does not tell."""
    p = 0 if at_line_start else data.find(b"\n") + 1
    if not at_line_start and p == 0:
        return None
    while p < len(data):
        q, fits = p, 0
        while fits < records:
            ends = []
            for _ in range(4):
                e = data.find(b"\n", q if not ends else ends[-1] + 1)
                if e < 0:
                    break
                ends.append(e)
            if len(ends) < 4:
                break
            head, seq, plus, qual = (data[a:b].rstrip(b"\r") for a, b in zip([q, *(e + 1 for e in ends)], ends))
            if not head.startswith(b"@") or not plus.startswith(b"+") or len(seq) != len(qual):
                break
            fits, q = fits + 1, ends[-1] + 1
        if fits and (fits == records or len(ends) < 4):  # all, or as many as the data hold
            return p
        e = data.find(b"\n", p)
        if e < 0:
            return None
        p = e + 1
    return None


def _fastq_lines(lines: list[bytes]) -> list[bytes]:
    return [x[:-1] if x.endswith(b"\r") else x for x in lines]


class FastqRange:
    """Records of a range: ``(heads, seqs, quals)`` lists by chunk."""

    def __init__(self, part: Range) -> None:
        self.part, self.packed = part, part.end == 1 << 62

    def _aligned(self, source: _Source) -> tuple[int, bytes | None]:
        """Where the first record of the range starts, and the header of the record before."""
        begin, back = self.part.begin, LOOK_BACK
        if begin == 0:
            return 0, None
        while True:
            at = max(0, begin - back)
            source.file.seek(at)
            data = source.file.read(begin - at + back)
            p = 0 if at == 0 else fastq_start(data, False)
            whole = at + len(data) >= self.part.size
            before = None
            while p is not None and at + p < begin:
                head, q = data[p : data.find(b"\n", p)], p
                for _ in range(4):
                    q = data.find(b"\n", q) + 1
                    if not q:
                        break
                if not q:
                    if whole:
                        return self.part.size, head
                    p = None
                    break
                before, p = head, q
            if p is not None and (before is not None or at == 0):
                return at + p, before
            if whole and at == 0:
                return self.part.size, before
            back *= 4

    def __iter__(self) -> Iterator[tuple[list[bytes], list[bytes], list[bytes]]]:
        source = _Source(self.part.uri, self.packed)
        at, before = (0, None) if self.packed else self._aligned(source)
        rest, number = b"", 0
        first = at > 0
        for data, last in _with_last(source.chunks(at, self.part.size)):
            data = rest + data
            if last and not data.endswith(b"\n"):
                data += b"\n"
            lines = data.split(b"\n")
            whole = (len(lines) - 1) // 4 * 4
            rest = b"\n".join(lines[whole:])
            if last and rest.strip(b"\r\n"):
                raise ValueError(f"broken FASTQ record at the end of {self.part.uri}")
            stop = whole
            if at + len(data) - len(rest) > self.part.end or first:
                # Records that start behind the end are of the next range, but for the second mate of the last one here.
                stop, place, done = 0, at, False
                for i in range(0, whole, 4):
                    skip = first and is_mates(before, lines[i])
                    if place >= self.part.end and (skip or not is_mates(before, lines[i])):
                        done = True
                        break
                    before = lines[i]
                    place += sum(map(len, lines[i : i + 4])) + 4
                    if skip:  # the second mate of the last record of the range before
                        lines[i : i + 4] = [b""] * 4
                    first, stop = False, i + 4
                if stop and not any(lines[:4]):
                    lines, stop = lines[4:], stop - 4
                kept = self._columns(lines[:stop], number)
                number += stop // 4
                if stop:
                    yield kept
                if done:
                    return
            elif whole:
                before = lines[whole - 4]
                yield self._columns(lines[:whole], number)
                number += whole // 4
            at += len(data) - len(rest)

    def _columns(self, lines: list[bytes], number: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
        heads, seqs, pluses, quals = (_fastq_lines(lines[i::4]) for i in range(4))
        for i, (h, s, p, q) in enumerate(zip(heads, seqs, pluses, quals)):
            if h[:1] != b"@" or p[:1] != b"+" or len(s) != len(q):
                raise ValueError(f"broken FASTQ record {number + i} of the range from {self.part.begin} of {self.part.uri}")
        return heads, seqs, quals


def _with_last(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    held = None
    for data in chunks:
        if held is not None:
            yield held, False
        held = data
    if held is not None:
        yield held, True


class FastaRange:
    """Records of a range: ``(heads, bodies, None)`` lists by chunk; the lines of a body are put together by ``joiner``."""

    def __init__(self, part: Range) -> None:
        self.part, self.packed = part, part.end == 1 << 62

    def _before(self, source: _Source) -> bytes | None:
        """Header of the record before the range."""
        begin, back = self.part.begin, LOOK_BACK
        while begin:
            at = max(0, begin - back)
            source.file.seek(at)
            data = source.file.read(begin - at + back)
            p = data.rfind(b"\n>", 0, begin - at)
            p = 0 if p < 0 and at == 0 else p + 1 if p >= 0 else None
            if p is not None:
                return data[p:].split(b"\n", 1)[0]
            back *= 4
        return None

    def _records(self, source: _Source) -> Iterator[tuple[int, bytes, bytes]]:
        """``(place, header, body)`` of the records from the range's begin on."""
        at = max(0, self.part.begin - 1)
        held: list[bytes] = []
        open_, place = False, at  # is a record open; where it, or the text before the first, starts
        tail = b"" if self.part.begin else b"\n"
        offset = at - len(tail)
        for data, last in _with_last(source.chunks(at, self.part.size)):
            data = tail + data
            keep = b"\n" if data.endswith(b"\n") and not last else b""
            pieces = (data[: len(data) - 1] if keep else data).split(b"\n>")
            tail = keep
            for i, piece in enumerate(pieces):
                if i:
                    if open_:
                        yield place, *self._split(held)
                    open_, held, place = True, [], offset - 1
                if open_:
                    held.append(piece)
                offset += len(piece) + (2 if i < len(pieces) - 1 else 0)
        if open_:
            yield place, *self._split(held)

    def _split(self, held: list[bytes]) -> tuple[bytes, bytes]:
        head, _, body = b"".join(held).partition(b"\n")
        lines = [x.rstrip(b"\r") for x in body.split(b"\n")]
        return b">" + head.rstrip(b"\r"), self.part.joiner.encode().join(x for x in lines if x)

    def __iter__(self) -> Iterator[tuple[list[bytes], list[bytes], None]]:
        source = _Source(self.part.uri, self.packed)
        before = None if self.packed else self._before(source)
        heads, bodies, size, first = [], [], 0, self.part.begin > 0
        for place, head, body in self._records(source):
            skip = first and is_mates(before, head)
            if place >= self.part.end and (skip or not is_mates(before, head)):
                break
            first, before = False, head
            if skip:
                continue
            heads.append(head)
            bodies.append(body)
            size += len(head) + len(body)
            if size > CHUNK:
                yield heads, bodies, None
                heads, bodies, size = [], [], 0
        if heads:
            yield heads, bodies, None


def records_of(part: Range) -> Iterator[tuple[list[bytes], list[bytes], list[bytes] | None]]:
    if part.kind not in ("@", ">"):
        raise ValueError(f"{part.uri} is neither FASTQ nor FASTA")
    return iter(FastqRange(part) if part.kind == "@" else FastaRange(part))


# -------------------------------------------------------------------- the source


class ReadsSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COUNT_SCHEMA if self.options.get("mode") == "count" else READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Counter(self.options, schema) if self.options.get("mode") == "count" else _Scanner(self.options, schema)


class _Scanner(DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.options, self.columns = dict(options), schema.names

    def partitions(self) -> list[Range]:
        parts = ranges_of(json.loads(self.options["files"]), int(self.options.get("range_bytes", RANGE_BYTES)))
        for part, first in zip(parts, json.loads(self.options.get("firsts", "[]"))):
            part.first = first
        return parts

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        at = part.first
        for heads, seqs, quals in records_of(part):
            n = len(heads)
            made = {
                "read_id": lambda: pa.array(range(at, at + n), pa.int64()), "file_id": lambda: pa.array([part.file_id] * n, pa.int32()), "head": lambda: pa.array(heads, pa.binary()).cast(pa.string()),
                "seq": lambda: pa.array(seqs, pa.binary()).cast(pa.string()), "qual": lambda: pa.array(quals if quals is not None else [None] * n, pa.binary()).cast(pa.string()),
            }
            yield pa.RecordBatch.from_arrays([made[c]() for c in self.columns], self.columns)
            at += n


class _Counter(_Scanner):
    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        n, low, high, mates, before = 0, 255, 0, 0, None
        for heads, _, quals in records_of(part):
            n += len(heads)
            mates += sum(map(is_mates, [before, *heads[:-1]], heads)) if not mates else 0  # only whether there are any counts
            before = heads[-1]
            some = b"".join(quals) if quals is not None else b""
            if some:
                low, high = min(low, min(some)), max(high, max(some))
        values = [part.number, part.file_id, n, low, high, mates]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], self.columns)


def _reader(spark: SparkSession, files: list[dict], range_bytes: int):
    spark.dataSource.register(ReadsSource)
    return spark.read.format(NAME).option("files", json.dumps(files)).option("range_bytes", str(range_bytes))


def statistics(spark: SparkSession, files: list[dict], range_bytes: int = RANGE_BYTES) -> list:
    """A row for each range, in order: records, least and greatest quality byte, and whether mates follow each other."""
    return sorted(_reader(spark, files, range_bytes).option("mode", "count").load().collect(), key=lambda r: r.range)


def scan(spark: SparkSession, files: list[dict], found: list | None = None, range_bytes: int = RANGE_BYTES, schema: str = READ_SCHEMA, paired_first: bool = False) -> DataFrame:
    """The records of ``files``, numbered through; a narrow plan without an exchange.

    ``found`` are :func:`statistics`; without them a record's number is its range's
    number times 2**32 plus its place there, which needs no pass over the files. With
    ``paired_first`` numbers go through files in which mates follow each other first.
    """
    if found is None:
        firsts = [r.number << 32 for r in ranges_of(files, range_bytes)]
    else:
        paired = {r.file_id for r in found if r.mates}
        order = sorted(range(len(found)), key=lambda i: (found[i].file_id not in paired if paired_first else False, i))
        firsts, at = [0] * len(found), 0
        for i in order:
            firsts[i] = at
            at += found[i].records
    return _reader(spark, files, range_bytes).option("firsts", json.dumps(firsts)).schema(schema).load()
