"""Windows of sequences as numbers, made batch by batch.

A k-mer of up to 31 bases is a BIGINT *code*: a leading one, then two bits a base.
Codes of one k sort as their k-mers do, so the lesser code of both strands is the
canonical one, and rows of codes are hashed, shuffled and compared as numbers. The
work is numpy over whole Arrow batches: packing by doubling (1, 2, 4, ... bases),
no loop runs per read or window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 31  # bases of a code
SEGMENT = 1 << 20  # bases handled at once
HASHED = 1 << 14  # k-mers whose MD5 is made at once, few enough to stay in the processor's cache
TALLIED = 8  # bases of a k-mer at most, for which a task has a counter for each k-mer
LETTERS = "ACGTNX"

_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(b) for b in "ACGT"]] = range(4)
_LETTER = np.full(256, len(LETTERS), np.int8)
_LETTER[[ord(b) for b in LETTERS]] = range(len(LETTERS))
_FLIP = np.array([3, 2, 1, 0, 4, 5, 6], np.int8)


def composed(x: np.ndarray, k: int, join: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]) -> np.ndarray:
    """Value of each window of k elements, put together from windows of 1, 2, 4, ...; ``join(a, b, m, n)`` is of m and then n elements."""
    done, taken, bits, width = None, 0, x, 1
    while True:
        if k & width:
            n = len(x) - taken - width + 1
            done = bits[:n] if done is None else join(done[:n], bits[taken : taken + n], taken, width)
            taken += width
        if taken == k:
            return done
        bits = join(bits[: len(bits) - width], bits[width:], width, width)
        width *= 2


def _text(column: pa.Array, fill: str) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, fill).cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _segments(lengths: np.ndarray, k: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first row, last row, first start, end of starts)``: rows of some ``size`` bases, or a piece of a longer one."""
    row = 0
    while row < len(lengths):
        if lengths[row] > size:
            starts = int(lengths[row]) - k + 1
            for a in range(0, max(starts, 0), size):
                yield row, row + 1, a, min(a + size, starts)
            row += 1
            continue
        held = np.cumsum(lengths[row:])
        n = max(1, min(int(np.searchsorted(held, size, side="right")), int(np.argmax(np.append(lengths[row:] > size, True)))))
        yield row, row + n, 0, -1
        row += n


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_FOUR = np.array([int.from_bytes(bytes(b"ACGT"[x >> 6 - 2 * i & 3] for i in range(4)), "little") for x in range(256)], np.uint32)  # four bases of a byte as text


def md5_start(codes: np.ndarray, k: int) -> np.ndarray:
    """The first 32 bits of the MD5 of the k-mers of codes, which are one block of it; a number, as its hex digits say it."""
    out = np.empty(len(codes), np.uint32)
    for at in range(0, len(codes), HASHED):
        code = codes[at : at + HASHED].astype(np.int64) & np.int64((1 << 2 * k) - 1)
        words: list = [0] * 16
        for i in range(0, k - 3, 4):
            words[i // 4] = _FOUR[code >> np.int64(2 * (k - i - 4)) & 255]
        rest = k % 4  # of the last word, which the end mark follows
        last = _FOUR[(code & np.int64((1 << 2 * rest) - 1)) << np.int64(8 - 2 * rest)] & np.uint32((1 << 8 * rest) - 1) if rest else 0
        words[k // 4] = last | np.uint32(0x80 << 8 * rest)
        words[14] = 8 * k
        a, b, c, d = (np.full(len(code), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            turn, word = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
            f = d ^ b & (c ^ d) if turn == 0 else c ^ d & (b ^ c) if turn == 1 else b ^ c ^ d if turn == 2 else c ^ (b | ~d)
            f += a
            if isinstance(words[word], int):
                f += np.uint32((_SINES[i] + words[word]) % 2**32)
            else:
                f += np.uint32(_SINES[i])
                f += words[word]
            by = _TURNS[turn][i % 4]
            a, d, c, b = d, c, b, b + (f << np.uint32(by) | f >> np.uint32(32 - by))
        out[at : at + HASHED] = (a + np.uint32(0x67452301)).byteswap()
    return out


def windows(reads: DataFrame, k: int, probabilities: np.ndarray | None = None, extensions: bool = False, base: int = 33, segment: int = SEGMENT, sample: int = 1) -> DataFrame:
    """``read_id, pos, code, is_fwd`` of each window without letters other than ACGT.

    With ``probabilities`` (of a base by its Phred value) also ``weight``, their
    product over the window; bases of a read without qualities have 1, bases behind
    the end of a quality string 0. With ``extensions`` ``left, left_q, right, right_q``:
    the neighbours as numbers in LETTERS (X: none), on the canonical strand. With
    ``sample`` windows of one in so many k-mers come, by :func:`md5_start`. Null and
    short sequences give no row.
    """
    if not 0 < k <= LONGEST:
        raise ValueError(f"k-mers of 1 to {LONGEST} bases have codes")
    quals = probabilities is not None or extensions
    kind = next(f.dataType.simpleString() for f in reads.schema.fields if f.name == "read_id")
    schema = f"read_id {kind}, pos int, code long, is_fwd boolean" + (", weight double" if probabilities is not None else "") + (", left byte, left_q int, right byte, right_q int" if extensions else "")
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    chance = np.ones(256) if probabilities is None else np.append(probabilities, np.full(max(0, 256 - len(probabilities)), probabilities[-1]))[:256]
    packed = lambda a, b, m, n: a << np.int64(2 * n) | b
    turned = lambda a, b, m, n: a | b << np.int64(2 * m)
    product = lambda a, b, m, n: a * b

    def made(ids: pa.Array, data: np.ndarray, off: np.ndarray, phred: np.ndarray | None, known: np.ndarray | None, at: int, edges: tuple[int, int]) -> pa.RecordBatch | None:
        """Windows of the rows in ``data``; ``at`` and ``edges`` tell where a piece of a longer row begins and what it holds around."""
        lengths = np.diff(off)
        count = np.maximum(lengths - k + 1 - edges[0] - edges[1], 0)
        total = int(count.sum())
        if not total:
            return None
        codes = _CODE[data]
        row = np.repeat(np.arange(len(count)), count)
        pos = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        start = pos + off[:-1][row] + edges[0]
        bad = np.append(0, np.cumsum(codes > 3))
        fine = bad[start + k] == bad[start]
        row, pos, start = row[fine], pos[fine], start[fine]
        bases = codes.astype(np.int64) & 3
        fwd, rev = composed(bases, k, packed)[start], composed(3 - bases, k, turned)[start]
        is_fwd = fwd <= rev
        codes = np.where(is_fwd, fwd, rev)
        if sample > 1:
            some = md5_start(codes, k) % np.uint32(sample) == 0
            row, pos, start, is_fwd, codes = row[some], pos[some], start[some], is_fwd[some], codes[some]
        cols = [ids.take(pa.array(row)), pa.array((pos + at).astype(np.int32)), pa.array(codes | np.int64(1) << np.int64(2 * k)), pa.array(is_fwd)]
        if probabilities is not None:
            p = np.where(known, chance[np.maximum(phred, 0)] * (phred >= 0), 1.0)
            cols.append(pa.array(composed(p, k, product)[start]))
        if extensions:
            letter = _LETTER[data]
            has = [(pos + at > 0), (start + k < off[1:][row])]
            near = [np.where(ok, letter[np.clip(i, 0, len(data) - 1)], 5).astype(np.int8) for ok, i in zip(has, (start - 1, start + k))]
            q = [np.where(ok, np.maximum(phred[np.clip(i, 0, len(data) - 1)], 0), 0).astype(np.int32) for ok, i in zip(has, (start - 1, start + k))]
            cols += [pa.array(np.where(is_fwd, near[0], _FLIP[near[1]])), pa.array(np.where(is_fwd, q[0], q[1])), pa.array(np.where(is_fwd, near[1], _FLIP[near[0]])), pa.array(np.where(is_fwd, q[1], q[0]))]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = _text(batch.column("seq"), "")
            lengths = np.diff(off)
            phred = known = None
            if quals:
                raw, qoff = _text(batch.column("qual"), "")
                phred, held = np.full(len(data), -1, np.int64), np.minimum(np.diff(qoff), lengths)
                inside = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
                phred[inside + np.repeat(off[:-1], held)] = raw[inside + np.repeat(qoff[:-1], held)].astype(np.int64) - base
                known = np.repeat(batch.column("qual").is_valid().to_numpy(zero_copy_only=False), lengths)
            for a, b, first, last in _segments(lengths, k, segment):
                lo, hi = (int(off[a]), int(off[b])) if last < 0 else (int(off[a]) + max(first - 1, 0), min(int(off[a]) + last + k, int(off[b])))
                edges = (0, 0) if last < 0 else (int(first > 0), int(hi - int(off[a]) - (last + k - 1)))
                cut = off[a : b + 1] - off[a] if last < 0 else np.array([0, hi - lo])
                got = made(batch.column("read_id").slice(a, b - a), data[lo:hi], cut, phred[lo:hi] if quals else None, known[lo:hi] if quals else None, first, edges)
                if got is not None:
                    yield got

    src = reads.where(F.length("seq") >= k)
    return src.select("read_id", "seq", *(["qual"] if quals else [])).mapInArrow(run, schema)


def placed(rows: DataFrame, value: str, bounds: list[int], name: str, names: list[int] | None = None) -> DataFrame:
    """Add ``name``: how many of the sorted ``bounds`` are at most ``value``; with ``names`` the one of the last of them, the first where there is none, 0 without any.

    A binary search for a whole batch; an expression would look at each bound for each row.
    """
    held = np.array(bounds, np.int64)
    said = None if names is None else np.array(names or [0], np.int32)

    @F.arrow_udf("int")
    def place(x: pa.Array) -> pa.Array:
        at = np.searchsorted(held, pc.fill_null(x, -(1 << 63)).to_numpy(zero_copy_only=False), side="right")
        return pa.array((at if said is None else said[np.maximum(at - 1, 0)]).astype(np.int32))

    return rows.withColumn(name, place(F.col(value).cast("long")))


def sizes(reads: DataFrame, k: int) -> DataFrame:
    """``read_id, _n``: how many windows without letters other than ACGT a read has; reads without any have no row."""
    kind = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = _text(batch.column("seq"), "")
            n = np.zeros(batch.num_rows, np.int64)
            for a, b, first, last in _segments(np.diff(off), k, SEGMENT):
                lo, hi = (int(off[a]), int(off[b])) if last < 0 else (int(off[a]) + first, int(off[a]) + last + k - 1)
                bad = np.append(0, np.cumsum(_CODE[data[lo:hi]] > 3))
                whole = np.append(0, np.cumsum(bad[k:] == bad[:-k])) if hi - lo >= k else np.zeros(1, np.int64)
                ends = off[a : b + 1] - lo if last < 0 else np.array([0, hi - lo])
                n[a:b] += whole[np.clip(np.maximum(ends[1:] - k + 1, ends[:-1]), 0, len(whole) - 1)] - whole[np.clip(ends[:-1], 0, len(whole) - 1)]
            some = n > 0
            yield pa.RecordBatch.from_arrays([batch.column("read_id").filter(pa.array(some)), pa.array(n[some])], ["read_id", "_n"])

    src = reads.where("NOT discarded") if "discarded" in reads.columns else reads
    return src.where(F.length("seq") >= k).select("read_id", "seq").mapInArrow(run, f"read_id {kind}, _n long")


def spread(rows: DataFrame) -> DataFrame:
    """``read_id, values`` of ``read_id, size, hits``: an array of ``size`` zeros, with n at pos for each hit (pos, n); hits behind the end are left out."""
    kind = rows.schema["read_id"].dataType.simpleString()

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of some SEGMENT values at once, or one longer row."""
        total, row = np.cumsum(batch.column("size").to_numpy().astype(np.int64)), 0
        while row < batch.num_rows:
            before = total[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(total, before + SEGMENT, side="right")))
            yield batch.slice(row, end - row)
            row = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            size, hits = batch.column("size").to_numpy().astype(np.int64), batch.column("hits")
            first = np.append(0, np.cumsum(size))
            out = np.zeros(first[-1], np.int64)
            held = pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False)
            flat = hits.flatten()
            row = np.repeat(np.arange(len(size)), held)
            pos = flat.field("pos").to_numpy(zero_copy_only=False)
            fits = pos < size[row]
            out[(first[row] + pos)[fits]] = flat.field("n").to_numpy(zero_copy_only=False)[fits]
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(out))], ["read_id", "values"])

    return rows.select("read_id", "size", "hits").mapInArrow(run, f"read_id {kind}, values array<bigint>")


def counts(rows: DataFrame, group: str, k: int) -> DataFrame:
    """``group, code, n``: how often each group's sequences have a canonical k-mer, a row for each group and k-mer of a batch; for short k-mers.

    Null groups are one group. Windows with letters other than ACGT do not count.
    """
    if not 0 < k <= 12:
        raise ValueError("counts by batch are for k-mers of 1 to 12 bases")
    kind = rows.schema[group].dataType.simpleString()
    packed = lambda a, b, m, n: a << np.int64(2 * n) | b
    turned = lambda a, b, m, n: a | b << np.int64(2 * m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = _text(batch.column("seq"), "")
            found = batch.column(group).dictionary_encode(null_encoding="encode")
            of = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a in range(0, len(data), SEGMENT):
                codes = _CODE[data[a : a + SEGMENT + k - 1]]
                if len(codes) < k:
                    continue
                start = np.arange(len(codes) - k + 1)
                row = np.searchsorted(off, start + a, side="right") - 1
                bad = np.append(0, np.cumsum(codes > 3))
                fine = (bad[k:] == bad[:-k]) & (start + a + k <= off[row + 1])
                bases = codes.astype(np.int64) & 3
                code = np.minimum(composed(bases, k, packed), composed(3 - bases, k, turned))[fine]
                some, times = np.unique(of[row[fine]] << np.int64(2 * k) | code, return_counts=True)
                keys, n = np.concatenate([keys, some]), np.concatenate([n, times])
            groups = found.dictionary.take(pa.array(keys >> np.int64(2 * k)))
            yield pa.RecordBatch.from_arrays([groups, pa.array(keys & (1 << 2 * k) - 1 | np.int64(1) << np.int64(2 * k)), pa.array(n)], [group, "code", "n"])

    return rows.select(group, "seq").mapInArrow(run, f"{group} {kind}, code bigint, n bigint")


def tally(reads: DataFrame, k: int) -> DataFrame:
    """``code, n, n_fwd`` of canonical k-mers of up to TALLIED bases: a task counts in a table of all k-mers and sends at most a row for each."""
    if not 0 < k <= TALLIED:
        raise ValueError(f"counters for each k-mer are for 1 to {TALLIED} bases")
    packed = lambda a, b, m, n: a << np.int32(2 * n) | b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 2 * k, np.int64)
        for batch in batches:
            data, off = _text(batch.column("seq"), "")
            for a in range(0, len(data), SEGMENT):
                codes = _CODE[data[a : a + SEGMENT + k - 1]]
                if len(codes) < k:
                    continue
                row = np.searchsorted(off, [a, a + len(codes) - 1], side="right") - 1
                ends = np.clip(off[row[0] : row[1] + 2] - a, 0, len(codes))
                of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                bad = np.append(0, np.cumsum(codes > 3))
                fine = (bad[k:] == bad[:-k]) & (of[: len(of) - k + 1] == of[k - 1 :])
                n += np.bincount(composed((codes & 3).astype(np.int32), k, packed)[fine], minlength=len(n))
        digits = np.arange(1 << 2 * k)[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3
        rev = sum(3 - digits[:, i] << 2 * i for i in range(k))
        own = np.arange(len(n))
        some = (own <= rev) & ((n > 0) | (n[rev] > 0))
        both = n + np.where(own == rev, 0, n[rev])
        yield pa.RecordBatch.from_arrays([pa.array(own[some] | 1 << 2 * k), pa.array(both[some]), pa.array(n[some])], ["code", "n", "n_fwd"])

    src = reads.where("NOT discarded") if "discarded" in reads.columns else reads
    return src.where(F.length("seq") >= k).select("seq").mapInArrow(run, "code bigint, n bigint, n_fwd bigint")
