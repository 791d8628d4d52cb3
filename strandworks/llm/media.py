"""Operator 1, media columns: lossless Baseline JPEG payloads and DC thumbnails.

The encoder writes each 64-byte group of a payload as one 8x8 block of a
greyscale Baseline JPEG. A byte is one quantised coefficient: the 256 values of
Huffman magnitude category 8 (-255..-128 and 128..255) stand for the 256 bytes,
and each block is a restart interval of its own, so the DC predictor never runs
out of range and any block can be decoded alone.

The decoder is a general Baseline one: it parses the markers (SOI, APPn, COM,
DQT, SOF0, DHT, DRI, SOS, RSTn, EOI), builds the Huffman tables from DHT, decodes
interleaved scans of 1 to 4 components with any sampling factors as well as scans
of some components each, and rebuilds the luminance thumbnail from DC terms alone. All restart intervals of all images
of a batch are decoded side by side, one numpy step for each symbol.

Edge cases: a null text is an empty one, whose payload is 64 zero bytes. Long
texts fill a rectangle of blocks (up to 65,535 pixels each way); the blocks
behind the payload hold zeros. Repeated rows get equal values. An empty table
gives an empty result. Media that cannot be read give a row with an error. Columns of the input that are not asked for are ignored,
so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import chunks, text_bytes
from .scratch import keep

# Fixed values of the JPEG format.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE, 0xD0

MAX_BLOCKS_A_SIDE = 65535 // 8
THUMB = 8  # the hash compares neighbours on a THUMB x THUMB grid


# ---------------------------------------------------------------- encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _layout(blocks: int) -> tuple[int, int]:
    """Columns and rows of blocks: nearly square, at least ``blocks`` in all."""
    wide = min(MAX_BLOCKS_A_SIDE, max(1, int(np.ceil(np.sqrt(blocks)))))
    high = -(-blocks // wide)
    if high > MAX_BLOCKS_A_SIDE:
        raise ValueError("a text of over 4 GB does not fit into one JPEG")
    return wide, high


def _header(n_bytes: int, wide: int, high: int) -> bytes:
    one = bytes([1] + [0] * 15)  # one Huffman code, of one bit
    return b"".join([
        bytes([0xFF, SOI]),
        _segment(COM, b"payload" + struct.pack(">Q", n_bytes)),
        _segment(DQT, bytes([0]) + bytes([1] * 64)),
        _segment(SOF0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + bytes([1, 0x11, 0])),
        _segment(DHT, bytes([0x00]) + one + bytes([8])),
        _segment(DHT, bytes([0x10]) + one + bytes([0x08])),
        _segment(DRI, struct.pack(">H", 1)),
        _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode_payloads(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """One JPEG for each of the byte strings ``data[off[i]:off[i + 1]]``."""
    sizes = np.diff(off)
    need = np.maximum(1, -(-sizes // 64))
    shape = [_layout(int(n)) for n in need]
    blocks = np.array([w * h for w, h in shape], np.int64)
    first = np.zeros(len(blocks) + 1, np.int64)
    np.cumsum(blocks, out=first[1:])
    flat = np.zeros(first[-1] * 64, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * 64 - off[:-1], sizes)] = data
    # Each coefficient is the code '0' and the byte: 64 x 9 bits are 72 bytes.
    bits = np.zeros((first[-1], 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(flat).reshape(-1, 64, 8)
    scan = np.empty((first[-1], 74), np.uint8)
    scan[:, :72] = np.packbits(bits.reshape(-1, 576), axis=1)
    del bits
    scan[:, 72] = 0xFF
    scan[:, 73] = RST0 + (np.arange(first[-1]) - np.repeat(first[:-1], blocks)) % 8
    # Stuff a zero behind every data byte 0xFF.
    is_data = np.zeros(74, bool)
    is_data[:72] = True
    stuffed = (scan == 0xFF) & is_data
    shift = np.cumsum(stuffed.ravel()) - stuffed.ravel()
    body = np.zeros(scan.size + int(stuffed.sum()), np.uint8)
    body[np.arange(scan.size) + shift] = scan.ravel()
    ends = np.append(0, first[1:] * 74 + np.append(shift, stuffed.sum())[first[1:] * 74])
    out = []
    for i, (wide, high) in enumerate(shape):
        coded = body[ends[i] : ends[i + 1] - 2].tobytes()  # no marker behind the last interval
        out.append(_header(int(sizes[i]), wide, high) + coded + bytes([0xFF, EOI]))
    return out


# ---------------------------------------------------------------- decoding


@dataclass
class Component:
    ident: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Jpeg:
    """What the markers of one image say, and where its scan lies."""

    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[tuple[int, int], bytes] = field(default_factory=dict)
    restart: int = 0
    scan: list[Component] = field(default_factory=list)
    scan_start: int = 0
    scan_end: int = 0
    comment: bytes = b""


def _scan_end(raw: bytes, at: int) -> int:
    """Where the coded data that begin at ``at`` end: the next marker that is no restart."""
    coded = np.frombuffer(raw, np.uint8)[at:]
    mark = np.flatnonzero(coded[:-1] == 0xFF)
    follow = coded[mark + 1]
    stop = mark[(follow == EOI) | ((follow > 0) & (follow < RST0)) | ((follow > 0xD9) & (follow < 0xFF))]
    return at + (int(stop[0]) if len(stop) else len(coded))


def parse_scans(raw: bytes) -> list[Jpeg]:
    """Walk the segments and give one header for each scan; raises ValueError on what is not Baseline."""
    if raw[:2] != bytes([0xFF, SOI]):
        raise ValueError("no SOI marker")
    out, at, scans = Jpeg(), 2, []
    while True:
        if raw[at : at + 2] == bytes([0xFF, EOI]) and scans:
            raise ValueError("a component has no scan")
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("broken segment")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DQT:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                out.quants[ident] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == SOF0:
            precision, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("not 8-bit samples")
            for i in range(n):
                ident, factors, quant = body[6 + 3 * i : 9 + 3 * i]
                out.parts.append(Component(ident, factors >> 4, factors & 15, quant))
        elif 0xC1 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError("not a Baseline JPEG")
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                out.huffman[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == DRI:
            out.restart = struct.unpack(">H", body)[0]
        elif marker == COM:
            out.comment = body
        elif marker == SOS:
            scan = []
            for i in range(body[0]):
                ident, tables = body[1 + 2 * i : 3 + 2 * i]
                part = next((p for p in out.parts if p.ident == ident), None)
                if part is None:
                    raise ValueError("a scan of an unknown component")
                part.dc, part.ac = tables >> 4, tables & 15
                scan.append(part)
            # Tables may change from scan to scan.
            scans.append(replace(out, scan=scan, scan_start=at, scan_end=_scan_end(raw, at), huffman=dict(out.huffman), quants=dict(out.quants)))
            if {p.ident for s in scans for p in s.scan} == {p.ident for p in out.parts}:
                return scans
            at = scans[-1].scan_end


def huffman_lut(spec: bytes) -> np.ndarray:
    """For each 16-bit window: code length << 8 | symbol; 0 where no code fits."""
    lut = np.zeros(1 << 16, np.uint16)
    code, at = 0, 16
    for bits in range(1, 17):
        for _ in range(spec[bits - 1]):
            lo = code << (16 - bits)
            lut[lo : lo + (1 << (16 - bits))] = bits << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return lut


def _window16(win: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (win[bit >> 3] >> (np.uint32(8) - (bit & 7).astype(np.uint32))) & np.uint32(0xFFFF)


def decode_blocks(raws: list[bytes]) -> tuple[list[Jpeg], list[np.ndarray], list[np.ndarray]]:
    """Quantised coefficients of many images.

    Returns a header for each scan of each image, per scan an int16 array (blocks in
    scan order, 64 in zigzag order), and the index of each block's component in the scan.
    """
    read = [(h, raw) for raw in raws for h in parse_scans(raw)]
    heads, raws = [h for h, _ in read], [raw for _, raw in read]
    luts: dict[bytes, int] = {}
    for h in heads:
        for spec in h.huffman.values():
            luts.setdefault(spec, len(luts))
    table = np.stack([huffman_lut(s) for s in luts]) if luts else np.zeros((1, 1 << 16), np.uint16)

    pieces, lane_at, lane_blocks, lane_image, lane_block0, total, base = [], [], [], [], [], [], 0
    plans = []
    for k, (raw, h) in enumerate(zip(raws, heads)):
        if len(h.scan) == 1:  # a single component is not interleaved
            p = h.scan[0]
            most_a, most_d = max(c.across for c in h.parts), max(c.down for c in h.parts)
            mcus = -(-(-(-h.width * p.across // most_a)) // 8) * -(-(-(-h.height * p.down // most_d)) // 8)
            order = [0]
        else:
            most_a, most_d = max(c.across for c in h.parts), max(c.down for c in h.parts)
            mcus = -(-h.width // (8 * most_a)) * -(-h.height // (8 * most_d))
            order = [i for i, c in enumerate(h.scan) for _ in range(c.across * c.down)]
        plans.append(np.array(order))
        end = h.scan_end - h.scan_start
        coded = np.frombuffer(raw, np.uint8)[h.scan_start : h.scan_end]
        mark = np.flatnonzero(coded[:-1] == 0xFF)
        follow = coded[mark + 1]
        drop = np.zeros(end, bool)
        drop[mark[follow == 0] + 1] = True
        rst = mark[(follow >= RST0) & (follow <= RST0 + 7)]
        drop[rst] = drop[rst + 1] = True
        clean = coded[:end][~drop]
        gone = np.cumsum(drop)
        starts = np.append(0, rst + 2 - gone[np.minimum(rst + 1, end - 1)]) if end else np.zeros(1, np.int64)
        each = h.restart or mcus
        n_lanes = -(-mcus // each)
        if len(starts) < n_lanes:
            raise ValueError("restart markers are missing")
        counts = np.full(n_lanes, each, np.int64)
        counts[-1] = mcus - each * (n_lanes - 1)
        lane_at.append(base + starts[:n_lanes])
        lane_blocks.append(counts * len(order))
        lane_block0.append(sum(total) + np.arange(n_lanes) * each * len(order))
        lane_image.append(np.full(n_lanes, k))
        total.append(mcus * len(order))
        pieces.append(clean)
        base += len(clean)

    buf = np.concatenate([*pieces, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    win = (buf[:-3] << 16) | (buf[1:-2] << 8) | buf[2:-1]  # 24 bits from each byte on
    del buf, pieces
    image = np.concatenate(lane_image)
    bit = np.concatenate(lane_at).astype(np.int64) * 8
    left = np.concatenate(lane_blocks)
    block = np.concatenate(lane_block0)
    coef = np.zeros((sum(total), 64), np.int16)
    step = np.zeros(len(image), np.int64)  # block within the MCU
    width = np.array([len(p) for p in plans])[image]
    longest = max(len(p) for p in plans)
    of_step = np.array([np.pad(p, (0, longest - len(p))) for p in plans])
    most = max(len(h.scan) for h in heads)
    tab = np.zeros((len(heads), most, 2), np.int64)
    for k, h in enumerate(heads):
        for i, c in enumerate(h.scan):
            tab[k, i] = luts[h.huffman[0, c.dc]], luts[h.huffman[1, c.ac]]
    pred = np.zeros((len(image), most), np.int64)
    flat = table.ravel()
    one_table = len(luts) == 1

    def symbols(lut: np.ndarray | None, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, magnitude value, and the bit behind both."""
        w = _window16(win, bits)
        got = table[0][w] if lut is None else flat[lut * 65536 + w]
        if not got.all():
            raise ValueError("a code that the Huffman table lacks")
        bits = bits + (got >> 8)
        symbol = got & 0xFF
        size = (symbol & 15).astype(np.int64)
        extra = _window16(win, bits).astype(np.int64) >> (16 - size)
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        return symbol, value, bits + size

    live = np.flatnonzero(left > 0)
    while len(live):
        part = of_step[image[live], step[live]]
        dc = None if one_table else tab[image[live], part, 0]
        ac = None if one_table else tab[image[live], part, 1]
        _, diff, at = symbols(dc, bit[live])
        pred[live, part] += diff
        coef[block[live], 0] = pred[live, part]
        rows, pos, inner = block[live], np.ones(len(live), np.int64), np.arange(len(live))
        while len(inner):
            symbol, value, then = symbols(None if one_table else ac[inner], at[inner])
            at[inner] = then
            run, size = (symbol >> 4).astype(np.int64), symbol & 15
            where = pos[inner] + run
            if (where > 63)[size > 0].any():
                raise ValueError("a run beyond the block")
            has = size > 0
            if has.all():
                coef[rows[inner], where] = value
            else:
                coef[rows[inner[has]], where[has]] = value[has]
            pos[inner] = np.where(has | (run == 15), where + 1, 64)  # ZRL skips 16, EOB ends
            inner = inner[pos[inner] < 64]
        bit[live] = at
        block[live] += 1
        left[live] -= 1
        step[live] = (step[live] + 1) % width[live]
        live = live[left[live] > 0]

    cut = np.append(0, np.cumsum(total))
    kinds = [np.tile(p, total[k] // len(p)) for k, p in enumerate(plans)]
    return heads, [coef[cut[k] : cut[k + 1]] for k in range(len(heads))], kinds


def thumbnail(head: Jpeg, coef: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """DC-only luminance: one uint8 pixel for each 8x8 block of the first component."""
    y = head.parts[0]
    most_a, most_d = max(c.across for c in head.parts), max(c.down for c in head.parts)
    mean = coef[kinds == head.scan.index(y), 0].astype(np.float64) * head.quants[y.quant][0] / 8 + 128
    wide = -(-(-(-head.width * y.across // most_a)) // 8)
    high = -(-(-(-head.height * y.down // most_d)) // 8)
    if len(head.scan) == 1:
        grid = mean.reshape(high, wide)
    else:  # blocks come MCU by MCU
        mw, mh = -(-head.width // (8 * most_a)), -(-head.height // (8 * most_d))
        grid = mean.reshape(mh, mw, y.down, y.across).transpose(0, 2, 1, 3).reshape(mh * y.down, mw * y.across)
        grid = grid[:high, :wide]
    return np.clip(np.rint(grid), 0, 255).astype(np.uint8)


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: is a cell of the thumbnail darker than its right neighbour?"""
    rows = np.linspace(0, thumb.shape[0], THUMB + 1).astype(int)
    cols = np.linspace(0, thumb.shape[1], THUMB + 2).astype(int)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.cumsum(0, dtype=np.float64).cumsum(1)
    lo_r, lo_c = np.minimum(rows[:-1], thumb.shape[0] - 1), np.minimum(cols[:-1], thumb.shape[1] - 1)
    hi_r, hi_c = np.maximum(rows[1:], lo_r + 1), np.maximum(cols[1:], lo_c + 1)
    box = total[hi_r][:, hi_c] - total[lo_r][:, hi_c] - total[hi_r][:, lo_c] + total[lo_r][:, lo_c]
    cell = box / ((hi_r - lo_r)[:, None] * (hi_c - lo_c)[None, :])
    return int.from_bytes(np.packbits(cell[:, :-1] < cell[:, 1:]).tobytes(), "big")


def payload_of(head: Jpeg, coef: np.ndarray) -> tuple[bytes, int]:
    """The padded payload that :func:`encode_payloads` stored, and its unpadded size."""
    if head.comment[:7] != b"payload":
        raise ValueError("this JPEG holds no payload")
    n = struct.unpack(">Q", head.comment[7:15])[0]
    diff = coef[: max(1, -(-n // 64))]
    sample = np.where(diff < 0, diff + 255, diff).astype(np.uint8)
    return sample.tobytes(), n


# ---------------------------------------------------------------- DataFrames

MEDIA_SCHEMA = "doc_id long, media binary"
FEATURES = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "width": pa.int32(), "height": pa.int32(), "feature": pa.string(), "error": pa.string(),
}
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, width int, height int, feature string, error string"
)
_IMAGES_AT_ONCE = 1 << 20


def encode_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, media)``: each text of ``docs`` as one JPEG; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                media = encode_payloads(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MEDIA_SCHEMA)


def describe(raws: list[bytes]) -> list[tuple]:
    """``(n_bytes, payload, width, height, feature, error)`` of each image; of one that cannot be read only the error."""
    try:
        heads, coefs, kinds = decode_blocks(raws)
    except (ValueError, IndexError, KeyError, struct.error) as broken:
        if len(raws) == 1:
            return [(None, None, None, None, None, str(broken) or type(broken).__name__)]
        return [row for raw in raws for row in describe([raw])]  # the others of the batch are fine
    out = []
    for head, coef, kind in zip(heads, coefs, kinds):
        if head.parts[0] not in head.scan:
            continue  # a scan of colours only
        payload, n_bytes = payload_of(head, coef) if head.comment[:7] == b"payload" else (None, None)
        out.append((n_bytes, payload, head.width, head.height, f"{head.width}x{head.height}:{difference_hash(thumbnail(head, coef, kind)):016x}", None))
    return out


def decode_media(media: DataFrame) -> DataFrame:
    """Read stored JPEG bytes back: payload digests, dimensions, thumbnail hash.

    Images without a payload of :func:`encode_media` have null payload columns; null
    or broken media, and kinds of JPEG other than Baseline, have an ``error`` instead
    of all that is read from the image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, ids, n = batch.column("media").to_pylist(), batch.column("doc_id").to_pylist(), 0
            while n < len(raws):
                m, size = n, 0
                while m < len(raws) and (m == n or size + len(raws[m] or b"") <= _IMAGES_AT_ONCE):
                    size += len(raws[m] or b"")
                    m += 1
                rows = []
                for ident, raw, (n_bytes, payload, width, height, feature, error) in zip(ids[n:m], raws[n:m], describe([r or b"" for r in raws[n:m]])):
                    held = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
                    stored = (None, None) if raw is None else (len(raw), hashlib.sha256(raw).hexdigest())
                    rows.append((ident, n_bytes, *held, *stored, width, height, feature, error))
                n = m
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), FEATURES.values())], list(FEATURES))

    return media.mapInArrow(run, FEATURE_SCHEMA)


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a JPEG media column of a table, read back from it and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode_media(keep(encode_media(docs), "media"))
