"""Sorted-string-table files: prefix-compressed blocks, sparse index, Bloom filter, footer.

Layout of a file::

    data block *      entries (varint shared, varint rest, varint value size, key rest, value);
                      every RESTART-th key is whole; then the restart offsets, their count, a CRC-32
    index block       for each data block: its last key, offset and size
    Bloom block       number of probes, then the bits
    footer (56 bytes) index offset and size, Bloom offset and size, entries, id width, magic

Keys are 8-byte big-endian doc_ids with the sign bit flipped, so byte order is
numeric order; the empty key stands for a null doc_id and comes first. Equal keys
may follow each other.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from .bytegrid import splitmix

MAGIC = b"SWSST001"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS_A_KEY = 10
BLOOM_PROBES = 7
_SIGN = 1 << 63


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + _SIGN) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - _SIGN if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    raw = np.array([int.from_bytes(k, "big") if k else 0x5EED for k in keys], np.uint64)
    one, two = splitmix(raw), splitmix(raw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (one[:, None] + np.arange(BLOOM_PROBES, dtype=np.uint64) * two[:, None]) % np.uint64(bits)


class Writer:
    """Streams entries, given in key order, to a binary file object."""

    def __init__(self, out, id_width: int) -> None:
        self.out, self.id_width, self.at = out, id_width, 0
        self.entries, self.keys, self.index = 0, [], []
        self._reset()

    def _reset(self) -> None:
        self.block, self.size, self.restarts, self.in_block, self.last = [], 0, [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must come in order")
        if self.in_block % RESTART == 0:
            self.restarts.append(self.size)
            shared = 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(self.last, key)) if a != b), min(len(self.last), len(key)))
        entry = b"".join((_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value))
        self.block.append(entry)
        self.size += len(entry)
        self.in_block += 1
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.entries += 1
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        body = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self.out.write(body)
        self.index.append((self.last, self.at, len(body)))
        self.at += len(body)
        self._reset()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        bits = max(64, BLOOM_BITS_A_KEY * len(self.keys))
        field = np.zeros(-(-bits // 8) * 8, np.uint8)
        if self.keys:
            field[_probes(self.keys, bits).ravel()] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(field, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.id_width, MAGIC))


class Reader:
    """Reads a table from a seekable binary file object."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, 2) or source.tell()
        self.index_at, self.index_size, bloom_at, bloom_size, self.entries, self.id_width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        raw, at, self.blocks = self._at(self.index_at, self.index_size), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            off, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.blocks.append((key, off, length))
        bloom = self._at(bloom_at, bloom_size)
        self.bloom_bits = struct.unpack_from("<Q", bloom)[0]
        self.bloom = np.frombuffer(bloom, np.uint8, offset=8)

    def _at(self, off: int, size: int) -> bytes:
        self.source.seek(off)
        return self.source.read(size)

    def _block(self, number: int) -> bytes:
        _, off, size = self.blocks[number]
        body = self._at(off, size)
        if zlib.crc32(body[:-4]) != struct.unpack_from("<I", body, size - 4)[0]:
            raise ValueError("damaged block")
        return body

    @staticmethod
    def _entries(body: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end = len(body) - 8 - 4 * struct.unpack_from("<I", body, len(body) - 8)[0]
        key = b""
        while at < end:
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for number in range(len(self.blocks)):
            yield from self._entries(self._block(number))

    def may_contain(self, key: bytes) -> bool:
        p = _probes([key], self.bloom_bits)[0].astype(np.int64)
        return bool((self.bloom[p >> 3] >> (p & 7) & 1).all())

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: Bloom filter, binary search in the index and over the restarts, short scan."""
        if not self.may_contain(key):
            return []
        found = []
        for number in range(bisect.bisect_left([b[0] for b in self.blocks], key), len(self.blocks)):
            body = self._block(number)
            n = struct.unpack_from("<I", body, len(body) - 8)[0]
            starts = struct.unpack_from(f"<{n}I", body, len(body) - 8 - 4 * n)
            firsts = [next(self._entries(body, s))[0] for s in starts] if n <= 2 else None
            if firsts is None:
                lo, hi = 0, n  # the first restart whose key is not below the key
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if next(self._entries(body, starts[mid]))[0] < key else (lo, mid)
                begin = starts[max(0, lo - 1)]
            else:
                begin = starts[max(0, bisect.bisect_left(firsts, key) - 1)]
            for k, v in self._entries(body, begin):
                if k == key:
                    found.append(v)
                elif k > key:
                    return found
        return found
