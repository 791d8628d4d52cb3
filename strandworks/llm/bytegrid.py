"""Vectorised word splitting and XXH64 over Arrow string columns.

Everything works on whole Arrow batches: the text bytes of many rows are one
numpy array, and words, shingles and windows are (start, length) pairs into it.
No Python loop runs per row, word or byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)

#: Text bytes handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (nulls as empty) and its n + 1 offsets."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_null(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.int64 if wide else np.int32
    buffers = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buffers[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` text bytes each, or one row."""
    _, off = text_bytes(batch.column(column))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


@dataclass
class Words:
    """Words of many texts, joined by single spaces in ``norm``."""

    norm: np.ndarray  # bytes: each word followed by one space
    start: np.ndarray  # of each word in norm
    length: np.ndarray
    first: np.ndarray  # index of each text's first word; n + 1 values

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of bytes outside ``\\x20\\x09-\\x0D`` within each text."""
    size = len(data)
    if size == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), z, z, np.zeros(len(off), np.int64))
    inside = ~_WHITE[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    length = np.flatnonzero(ends) + 1 - start
    kept = data[inside]
    if lower:
        kept = _LOWER[kept]
    at = np.zeros(len(start), np.int64)
    np.cumsum(length[:-1] + 1, out=at[1:])
    norm = np.full(len(kept) + len(start), 0x20, np.uint8)
    norm[np.arange(len(kept)) + np.repeat(np.arange(len(start)), length)] = kept
    return Words(norm, at, length, np.searchsorted(start, off))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def lanes64(buf: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit value starting at every byte (zeros past the end)."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,)).copy()


def xxh64(win: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the byte ranges of the buffer whose :func:`lanes64` is ``win``."""
    start = start.astype(np.int64)
    length = length.astype(np.int64)
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed64 + P5, np.uint64)
        p, rem = start.copy(), length.copy()
        big = np.flatnonzero(length >= 32)
        if len(big):
            v = [np.full(len(big), s, np.uint64) for s in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            at, left, live = p[big], rem[big], np.arange(len(big))
            while len(live):
                q = at[live]
                for k in range(4):
                    v[k][live] = _mix(v[k][live], win[q + 8 * k])
                at[live] += 32
                left[live] -= 32
                live = live[left[live] >= 32]
            hb = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                hb = (hb ^ _mix(np.zeros(len(big), np.uint64), v[k])) * P1 + P4
            h[big], p[big], rem[big] = hb, at, left
        h += length.astype(np.uint64)
        for _ in range(3):
            live = np.flatnonzero(rem >= 8)
            if not len(live):
                break
            whole = len(live) == len(rem)
            live = slice(None) if whole else live
            x = h[live] ^ _mix(np.uint64(0), win[p[live]])
            h[live] = _rotl(x, 27) * P1 + P4
            p[live] += 8
            rem[live] -= 8
        live = np.flatnonzero(rem >= 4)
        if len(live):
            x = h[live] ^ ((win[p[live]] & np.uint64(0xFFFFFFFF)) * P1)
            h[live] = _rotl(x, 23) * P2 + P3
            p[live] += 4
            rem[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(rem > 0)
            if not len(live):
                break
            x = h[live] ^ ((win[p[live]] & np.uint64(0xFF)) * P5)
            h[live] = _rotl(x, 11) * P1
            p[live] += 1
            rem[live] -= 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
