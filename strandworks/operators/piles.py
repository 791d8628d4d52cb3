"""Sums of bases by position over groups of reads: what is shuffled is reads, not positions.

A read is some 200 bytes, the sums of its positions are some 40 bytes each. Reads are
shuffled by group and summed as a sorted stream, so a task holds the positions of one
group and some reads of it. Of a group with MANY reads in a batch the batch sends sums
instead, so a very large group is not one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.functions.quality import REFERENCE_PHRED, p_table
from strandworks.operators.windows import SEGMENT, _text

BASES = "ACGT"
MANY = 64  # reads of a group in one batch that are sent as sums
OTHER = 4  # a letter other than BASES, or a quality without a letter
_LETTER = np.full(256, OTHER, np.uint8)
_LETTER[[ord(b) for b in BASES]] = range(4)
_SENT = ["grp", "members", "seq", "q", "sums", "of", "best"]
Rows = Iterator[pa.RecordBatch]


def _slices(data: np.ndarray, off: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A binary value for each slice of ``data``, null where not ``valid``; ``off`` counts elements."""
    made = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * data.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return pc.if_else(pa.array(valid), made, None).cast(pa.binary())


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column, one behind the other, and where each begins, in elements; null is empty."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer((column.buffers()[2] or b"")[off[0] : off[-1]], kind), (off - off[0]) // np.dtype(kind).itemsize


def _coded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows to send, of ``grp, seq, q``: letters and qualities as a byte for each place of the read."""
    seq, q = batch.column("seq"), batch.column("q")
    if isinstance(q, pa.ChunkedArray):
        q = q.combine_chunks()
    some = np.logical_and(seq.is_valid().to_numpy(zero_copy_only=False), q.is_valid().to_numpy(zero_copy_only=False))
    raw, off = _text(seq, "")
    if (raw > 127).any():
        raw, off = _text(pc.replace_substring_regex(seq, "[^\\x00-\\x7F]", "N"), "")
    values, had = pc.list_flatten(q), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(q), 0).to_numpy())).astype(np.int64)
    phred = pc.fill_null(values, REFERENCE_PHRED).to_numpy(zero_copy_only=False).astype(np.int64)
    phred = np.where(phred < 0, 0, np.minimum(phred, REFERENCE_PHRED)).astype(np.uint8)  # p is 0 for 0 and below
    bases, given = np.diff(off), np.diff(had)
    size = np.where(some, np.maximum(np.maximum(bases, 1), given), 0)  # an empty text is one letter that says nothing
    to = np.append(0, np.cumsum(size))
    letters, quals = np.full(to[-1], OTHER, np.uint8), np.full(to[-1], REFERENCE_PHRED, np.uint8)
    for out, data, start, count in ((letters, _LETTER[raw], off, bases), (quals, phred, had, given)):
        count = np.where(some, count, 0)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[at + np.repeat(to[:-1], count)] = data[at + np.repeat(start[:-1], count)]
    n, none = batch.num_rows, np.zeros(batch.num_rows, bool)
    blank = lambda kind: _slices(np.zeros(0, kind), np.zeros(n + 1, np.int64), none)
    return pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(np.ones(n, np.int64)), _slices(letters, to, some), _slices(quals, to, some), blank(np.float64), blank(np.int64), blank(np.int16)], _SENT)


def _summed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """One row of sums for each group; ``best`` is quality * 4 + letter of the surest base, -1 without any."""
    coded = rows.column("grp").dictionary_encode()
    of_row, groups = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    members = np.zeros(len(groups), np.int64)
    np.add.at(members, of_row, rows.column("members").to_numpy())
    (letters, off), (quals, _) = _flat(rows.column("seq"), np.uint8), _flat(rows.column("q"), np.uint8)
    (counted, had), (sums, _), (surest, _) = _flat(rows.column("of"), np.int64), _flat(rows.column("sums"), np.float64), _flat(rows.column("best"), np.int16)
    size = np.zeros(len(groups), np.int64)
    np.maximum.at(size, of_row, np.maximum(np.diff(off), np.diff(had)))
    to = np.append(0, np.cumsum(size))
    places = lambda start: np.arange(start[-1]) + np.repeat(to[of_row] - start[:-1], np.diff(start))
    read, done = places(off), places(had)
    p = p_table(0)[quals]
    added = np.empty((to[-1], 4))
    for i in range(4):
        said = np.where(letters == i, p, np.where(letters == OTHER, 0.25, (1 - p) / 3))
        added[:, i] = np.bincount(read, said, to[-1]) + np.bincount(done, sums.reshape(-1, 4)[:, i], to[-1])
    count = np.bincount(read, minlength=to[-1])
    np.add.at(count, done, counted)
    best = np.full(to[-1], -1, np.int16)
    np.maximum.at(best, read, np.where(letters < 4, quals.astype(np.int16) * 4 + letters, -1).astype(np.int16))
    np.maximum.at(best, done, surest)
    none, every = np.zeros(len(groups), bool), np.ones(len(groups), bool)
    blank = _slices(np.zeros(0, np.uint8), np.zeros(len(groups) + 1, np.int64), none)
    return pa.RecordBatch.from_arrays([groups, pa.array(members), blank, blank, _slices(added.ravel(), to * 4, every), _slices(count.astype(np.int64), to, every), _slices(best, to, every)], _SENT)


def _some(batch: pa.RecordBatch, width: np.ndarray) -> Rows:
    """Slices of a batch of some SEGMENT places each."""
    ends, a = np.cumsum(width), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SEGMENT, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _width(batch: pa.RecordBatch, *columns: str) -> np.ndarray:
    length = lambda c: pc.list_value_length(c) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length(c)
    return sum(pc.fill_null(length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in columns)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def sums(reads: DataFrame) -> DataFrame:
    """``grp, members, A, C, G, T, of, sure, letter`` of ``grp, seq, q`` (array of integers): lists with a value for each position.

    Weights of the letters, reads that reach the position, and the probability and number in
    BASES of the surest base there, null without any. Groups of null, and those
    without a read that has sequence and qualities, have no row; ``members`` counts all reads.
    """
    kind = reads.schema["grp"].dataType.simpleString()

    def send(batches: Rows) -> Rows:
        for batch in batches:
            for part in _some(batch, _width(batch, "seq", "q")):
                rows = _coded(part)
                of = rows.column("grp").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                many = np.bincount(of)[of] >= MANY
                if many.any():
                    yield _summed(rows.filter(pa.array(many)))
                if not many.all():
                    yield rows.filter(pa.array(~many))

    def add(batches: Rows) -> Rows:
        held = None
        for batch in batches:
            for part in _some(batch, _width(batch, "seq", "of")):
                done = _summed(part if held is None else _joined([held, part]))
                held = done.slice(done.num_rows - 1)
                if done.num_rows > 1:
                    yield _told(done.slice(0, done.num_rows - 1))
        if held is not None:
            yield _told(held)

    def _told(rows: pa.RecordBatch) -> pa.RecordBatch:
        (added, _), (count, off), (best, _) = _flat(rows.column("sums"), np.float64), _flat(rows.column("of"), np.int64), _flat(rows.column("best"), np.int16)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)
        none = best < 0
        return pa.RecordBatch.from_arrays(
            [rows.column("grp"), rows.column("members"), *(lists(pa.array(np.ascontiguousarray(added.reshape(-1, 4)[:, i]))) for i in range(4)), lists(pa.array(count)),
             lists(pa.array(p_table(0)[np.maximum(best, 0) // 4], mask=none)), lists(pa.array((best % 4).astype(np.int32), mask=none))],
            ["grp", "members", *BASES, "of", "sure", "letter"],
        )

    sent = reads.where("grp IS NOT NULL").select("grp", "seq", "q").mapInArrow(send, f"grp {kind}, members long, seq binary, q binary, sums binary, of binary, best binary")
    table = f"grp {kind}, members long, {', '.join(f'{b} array<double>' for b in BASES)}, of array<bigint>, sure array<double>, letter array<int>"
    return sent.repartition("grp").sortWithinPartitions("grp").mapInArrow(add, table).where(F.size("of") > 0)
