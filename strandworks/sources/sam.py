"""SAM text and BAM files.

BAM is BGZF: gzip members of at most 64 KiB, each with its compressed size in an
extra field. A file is read in byte ranges: a task looks for the first block of its
range and the first place in it from which records follow each other, and takes the
records that start in blocks of its range. Header and tags are kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.schema import SAM

# Fixed values of the BAM and BGZF formats.
BGZF_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_CIGAR = "MIDNSHP=X"
_SEQ = "=ACMGRSVTWYHKDBN"
_FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def _block_size(raw: bytes, at: int) -> int | None:
    """Bytes of the BGZF block at ``at``; None if there is none, or not enough of it to tell."""
    if raw[at : at + 4] != b"\x1f\x8b\x08\x04" or at + 18 > len(raw):
        return None
    extra = struct.unpack_from("<H", raw, at + 10)[0]
    p = at + 12
    while p + 6 <= min(at + 12 + extra, len(raw)):
        ident, n = raw[p : p + 2], struct.unpack_from("<H", raw, p + 2)[0]
        if ident == b"BC" and n == 2:
            return struct.unpack_from("<H", raw, p + 4)[0] + 1
        p += 4 + n
    return None


def _unpacked(block: bytes) -> bytes:
    extra = struct.unpack_from("<H", block, 10)[0]
    crc, n = struct.unpack_from("<II", block, len(block) - 8)
    out = zlib.decompress(block[12 + extra : -8], -15)
    if zlib.crc32(out) != crc or len(out) != n:
        raise ValueError("damaged BGZF block")
    return out


def bgzf_blocks(raw: bytes) -> Iterator[bytes]:
    """Uncompressed blocks of a BGZF byte string."""
    at = 0
    while at < len(raw):
        size = _block_size(raw, at)
        if size is None or at + size > len(raw):
            raise ValueError("not a BGZF block" if size is None else "damaged BGZF block")
        yield _unpacked(raw[at : at + size])
        at += size


def bgzf(data: bytes, eof: bool = True, block: int = 0xFF00) -> bytes:
    """Bytes as BGZF blocks, with the end marker."""
    out = []
    for a in range(0, len(data), block):
        piece = data[a : a + block]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(piece) + c.flush()
        head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out) + (BGZF_EOF if eof else b"")


def _tags(raw: bytes) -> dict[str, str]:
    out, p = {}, 0
    sizes = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    while p + 3 <= len(raw):
        tag, kind = raw[p : p + 2].decode(), chr(raw[p + 2])
        p += 3
        if kind == "A":
            out[tag], p = f"A:{chr(raw[p])}", p + 1
        elif kind in sizes:
            v = struct.unpack_from("<" + sizes[kind], raw, p)[0]
            out[tag], p = f"{'f' if kind == 'f' else 'i'}:{v}", p + struct.calcsize(sizes[kind])
        elif kind in "ZH":
            end = raw.index(b"\0", p)
            out[tag], p = f"{kind}:{raw[p:end].decode()}", end + 1
        elif kind == "B":
            sub, n = chr(raw[p]), struct.unpack_from("<I", raw, p + 1)[0]
            v = struct.unpack_from(f"<{n}{sizes[sub]}", raw, p + 5)
            out[tag], p = f"B:{sub},{','.join(map(str, v))}", p + 5 + n * struct.calcsize(sizes[sub])
        else:
            raise ValueError("unknown tag type")
    return out


def _header(data: bytes) -> tuple[str, list[tuple[str, int]], int] | None:
    """Header text, references, and where the records begin; None if ``data`` ends before."""
    if data[:4] != b"BAM\1"[: len(data[:4])]:
        raise ValueError("not a BAM file")
    try:
        n = struct.unpack_from("<i", data, 4)[0]
        text, p = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
        count, refs = struct.unpack_from("<i", data, p)[0], []
        p += 4
        for _ in range(count):
            m = struct.unpack_from("<i", data, p)[0]
            refs.append((data[p + 4 : p + 3 + m].decode(), struct.unpack_from("<i", data, p + 4 + m)[0]))
            p += 8 + m
    except struct.error:
        return None
    return (text, refs, p) if p <= len(data) else None


def _record(data: bytes, p: int, names: list[str]) -> tuple[tuple, int] | None:
    """The record at ``p`` in SAM column order and the place behind it; None if ``data`` ends before."""
    if p + 36 > len(data) or p + 4 + (size := struct.unpack_from("<i", data, p)[0]) > len(data):
        return None
    tid, pos, l_name, mapq, _, n_cig, flag, l_seq, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data, p + 4)
    if size < 32 or tid >= len(names) or mtid >= len(names):
        raise ValueError("damaged BAM record")
    q = p + 36
    name, q = data[q : q + l_name - 1].decode(), q + l_name
    ops, q = struct.unpack_from(f"<{n_cig}I", data, q), q + 4 * n_cig
    packed, q = data[q : q + (l_seq + 1) // 2], q + (l_seq + 1) // 2
    seq = "".join(_SEQ[b >> 4] + _SEQ[b & 15] for b in packed)[:l_seq]
    quals, q = data[q : q + l_seq], q + l_seq
    qual = "*" if not l_seq or quals[0] == 255 else "".join(chr(v + 33) for v in quals)
    rname, rnext = (names[tid] if tid >= 0 else "*"), ("*" if mtid < 0 else "=" if mtid == tid else names[mtid])
    cigar = "".join(f"{o >> 4}{_CIGAR[o & 15]}" for o in ops) or "*"
    return (name, flag, rname, pos + 1, mapq, cigar, rnext, mpos + 1, tlen, seq or "*", qual, _tags(data[q : p + 4 + size])), p + 4 + size


def _may_start(data: bytes, p: int, lengths: list[int], chain: int = 4) -> bool:
    """Can ``chain`` records, or as many as ``data`` still holds, follow each other from ``p`` on?"""
    for turn in range(chain):
        if p + 36 > len(data):
            return turn > 0
        size, tid, pos, l_name, _, _, n_cig, _, l_seq, mtid, mpos = struct.unpack_from("<iiiBBHHHiii", data, p)
        if not 32 <= size < 1 << 28 or not -1 <= tid < len(lengths) or not -1 <= mtid < len(lengths) or l_name < 2 or l_seq < 0:
            return False
        if pos < -1 or mpos < -1 or (tid >= 0 and pos > lengths[tid]) or (mtid >= 0 and mpos > lengths[mtid]):
            return False
        if 32 + l_name + 4 * n_cig + (l_seq + 1) // 2 + l_seq > size:
            return False
        name = data[p + 36 : p + 36 + l_name]
        if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
            return False
        if any(c & 15 > 8 for c in data[p + 36 + l_name : p + 36 + l_name + 4 * n_cig : 4]):
            return False
        p += 4 + size
    return True


def bam_records(raw: bytes) -> tuple[str, list[tuple[str, int]], list[tuple]]:
    """Header text, references, and records in SAM column order of a BAM file's bytes."""
    data = b"".join(bgzf_blocks(raw))
    found = _header(data)
    if found is None:
        raise ValueError("damaged BAM header")
    text, refs, p = found
    rows, names = [], [r[0] for r in refs]
    while p < len(data):
        got = _record(data, p, names)
        if got is None:
            raise ValueError("damaged BAM record")
        rows.append(got[0])
        p = got[1]
    return text, refs, rows


class _Blocks:
    """BGZF blocks of a file from a byte on, read some MB at a time: ``(place, content)``."""

    def __init__(self, source, at: int, size: int, step: int = 1 << 22) -> None:
        self.source, self.at, self.size, self.step, self.raw = source, at, size, step, b""

    def _more(self) -> bool:
        new = self.source.read_at(min(self.step, self.size - self.at - len(self.raw)), self.at + len(self.raw)) if self.at + len(self.raw) < self.size else b""
        self.raw += new
        return bool(new)

    def seek_block(self) -> None:
        """Go to the next place at which a block starts that another block, or the end, follows."""
        p = 0
        while True:
            while len(self.raw) < p + (1 << 17) and self._more():
                pass
            p = self.raw.find(b"\x1f\x8b\x08\x04", p)
            if p < 0:
                self.at, self.raw = self.size, b""
                return
            size = _block_size(self.raw, p)
            if size is not None and (self.at + p + size == self.size or _block_size(self.raw, p + size) is not None):
                self.at, self.raw = self.at + p, self.raw[p:]
                return
            p += 1

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.size:
            while len(self.raw) < 1 << 16 and self._more():
                pass
            size = _block_size(self.raw, 0)
            if size is None or size > len(self.raw):
                raise ValueError("damaged BGZF block")
            block, at = self.raw[:size], self.at
            self.at, self.raw = self.at + size, self.raw[size:]
            yield at, _unpacked(block)


def _open(uri: str):
    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def bam_header(uri: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and references of a BAM file, of which only the first blocks are read."""
    with _open(uri) as source:
        data = b""
        for _, content in _Blocks(source, 0, source.size(), 1 << 18):
            data += content
            found = _header(data)
            if found is not None:
                return found[:2]
    raise ValueError("damaged BAM header")


def records_of_range(uri: str, begin: int, end: int, refs: list[tuple[str, int]]) -> Iterator[tuple]:
    """Records that start in BGZF blocks which start in ``[begin, end)``."""
    names, lengths = [r[0] for r in refs], [r[1] for r in refs]
    with _open(uri) as source:
        blocks = _Blocks(source, begin, source.size())
        if begin:
            blocks.seek_block()
        data, p, mine, found = b"", 0, 0, False  # records that start before ``mine`` are of this range
        for at, content in blocks:
            data, mine, p = data[p:] + content, mine - p, 0
            mine = len(data) if at < end else mine
            if not found and not begin:
                head = _header(data)
                if head is None:
                    continue
                p, found = head[2], True
            elif not found:
                if len(data) < 1 << 17 and blocks.at < blocks.size:
                    continue  # some blocks at once, for a chain of records to show
                start = next((i for i in range(mine) if _may_start(data, i, lengths)), None)
                if start is None:
                    if at >= end:
                        return
                    continue
                p, found = start, True
            while p < mine:
                got = _record(data, p, names)
                if got is None:
                    break
                yield got[0]
                p = got[1]
            if p >= mine and blocks.at >= end:
                return
        if found and p < mine:
            raise ValueError("damaged BAM record")


RANGE_BYTES = 32 << 20


def read_bam(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of BAM files in the SAM layout, a task for each range of a file.

    The driver holds names and sizes of files, and the references of each.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    heads = {f.path: bam_header(f.path)[1] for f in files}
    shared = spark.sparkContext.broadcast(heads)
    ranges = [(f.path, a, min(a + range_bytes, f.length)) for f in files for a in range(0, f.length, range_bytes)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 2, pa.string(), pa.string(), *[pa.int32()] * 2, pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            cols[11] = [list(t.items()) for t in cols[11]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*_FIELDS, "tags"])

        for batch in batches:
            for uri, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end"))):
                rows = []
                for row in records_of_range(uri, begin, end, shared.value[uri]):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    listed = spark.createDataFrame(ranges, "path string, begin long, end long")
    return listed.repartition(max(1, len(ranges))).mapInArrow(parse, SAM)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text, headers left out; the scan splits and the columns are pushed into one projection."""
    cells = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c"))
    ints = {"flag", "pos", "mapq", "pnext", "tlen"}
    tags = F.map_from_entries(F.transform(F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(4), F.length(t)))))
    return cells.select(*((F.get("c", F.lit(i)).cast("int") if n in ints else F.get("c", F.lit(i))).alias(n) for i, n in enumerate(_FIELDS)), tags.alias("tags"))


def _is_bam(spark: SparkSession, path: str) -> bool:
    found = spark.read.format("binaryFile").load(path).select("path").first()
    if found is None:
        return False
    with _open(found.path) as source:
        return source.read_at(2, 0) == b"\x1f\x8b"


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """SAM or BAM, told by the gzip magic of the first file."""
    return read_bam(spark, path) if _is_bam(spark, path) else read_sam(spark, path)


def read_header(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and references, in header order, of the first SAM or BAM file; references without a header get none."""
    if _is_bam(spark, path):
        return bam_header(spark.read.format("binaryFile").load(path).select("path").first().path)
    lines = spark.read.text(path).where(F.col("value").startswith("@") & F.col("value").rlike("^@[A-Z]{2}\t")).select(F.monotonically_increasing_id().alias("m"), "value")
    text = [r.value for r in sorted(lines.collect(), key=lambda r: r.m)]
    fields = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in text if line.startswith("@SQ")]
    return "".join(f"{line}\n" for line in text), [(f["SN"], int(f["LN"])) for f in fields]


def sorted_header(header: str) -> str:
    """The header of the same records in coordinate order."""
    lines = header.splitlines()
    rest = lines[1:] if lines and lines[0].startswith("@HD") else lines
    kept = [f for f in lines[0].split("\t")[1:] if not f.startswith("SO:")] if len(rest) < len(lines) else ["VN:1.0"]
    return "".join(f"{x}\n" for x in ["\t".join(["@HD", *kept, "SO:coordinate"]), *rest])


def _tag_bytes(tags: dict[str, str] | list | None) -> bytes:
    """Tags (``{"NM": "i:1"}``) as BAM has them."""
    out = []
    for tag, said in dict(tags or {}).items():
        kind, value = said.split(":", 1)
        key = tag.encode()
        if kind == "i":
            wide = "i" if -(1 << 31) <= int(value) < 1 << 31 else "I"
            out.append(key + wide.encode() + struct.pack("<" + wide, int(value)))
        elif kind == "f":
            out.append(key + b"f" + struct.pack("<f", float(value)))
        elif kind == "A":
            out.append(key + b"A" + value.encode())
        elif kind in "ZH":
            out.append(key + kind.encode() + value.encode() + b"\0")
        elif kind == "B":
            sub, *rest = value.split(",")
            code = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[sub]
            numbers = [float(v) if sub == "f" else int(v) for v in rest]
            out.append(key + b"B" + sub.encode() + struct.pack(f"<I{len(numbers)}{code}", len(numbers), *numbers))
        else:
            raise ValueError("unknown tag type")
    return b"".join(out)


def bam_bytes(header: str, refs: list[tuple[str, int]], rows: list[tuple], first: bool = True, eof: bool = True) -> bytes:
    """A BAM file (or a part of one: without header or end marker) of rows in SAM column order; a twelfth column has the tags."""
    out = []
    if first:
        text = header.encode()
        out.append(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)))
        for name, n in refs:
            out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n))
    tids = {n: i for i, (n, _) in enumerate(refs)}
    import re

    for qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, *more in rows:
        seq = "" if seq in (None, "*") else seq
        ops = [int(n) << 4 | _CIGAR.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "*")]
        nib = [_SEQ.index(c) if c in _SEQ else 15 for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(nib[::2], nib[1::2]))
        q = b"\xff" * len(seq) if qual in (None, "*") else bytes(ord(c) - 33 for c in qual)
        tid = tids.get(rname, -1)
        mtid = tid if rnext == "=" else tids.get(rnext, -1)
        span = sum(o >> 4 for o in ops if _CIGAR[o & 15] in "MDN=X") or 1
        body = struct.pack("<iiBBHHHiiii", tid, (pos or 0) - 1, len(qname) + 1, mapq or 0, _bin((pos or 1) - 1, (pos or 1) - 1 + span), len(ops), flag, len(seq), mtid, (pnext or 0) - 1, tlen or 0)
        body += qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + q + _tag_bytes(more[0] if more else None)
        out.append(struct.pack("<i", len(body)) + body)
    return bgzf(b"".join(out), eof)


def _bin(beg: int, end: int) -> int:
    """Index bin of a range."""
    end -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == end >> shift:
            return base + (beg >> shift)
    return 0
