import hashlib
import zlib
from collections import Counter

import numpy as np

from strandworks.llm import media


def _bits(values):
    return "".join(values)


def _codes(spec):
    code, at, out = 0, 16, {}
    for bits in range(1, 17):
        for _ in range(spec[bits - 1]):
            out[spec[at]] = format(code, f"0{bits}b")
            code, at = code + 1, at + 1
        code <<= 1
    return out


def slow_jpeg(planes, sampling, width, height, restart=0):
    """A plain Baseline encoder of quantised blocks: planes[c][row][col] are 64 zigzag values."""
    dc = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
    symbols = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
    ac = bytes([0, 0, 0, 2, 4, 0, 0, 0, 156, 0, 0, 0, 0, 0, 0, 0]) + bytes(symbols)
    dcc, acc = _codes(dc), _codes(ac)
    seg = media._segment
    n = len(planes)
    out = bytes([0xFF, media.SOI]) + seg(media.DQT, bytes([0]) + bytes([2] * 64))
    out += seg(media.SOF0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, a << 4 | d, 0]) for c, (a, d) in enumerate(sampling)))
    out += seg(media.DHT, b"\x00" + dc) + seg(media.DHT, b"\x10" + ac)
    if restart:
        out += seg(media.DRI, restart.to_bytes(2, "big"))
    out += seg(media.SOS, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([0, 63, 0]))

    def extra(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    amax, dmax = max(a for a, _ in sampling), max(d for _, d in sampling)
    mw, mh = -(-width // (8 * amax)), -(-height // (8 * dmax))
    data, bits, pred, count = b"", "", [0] * n, 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return b"".join(bytes([int(bits[i : i + 8], 2)]) + (b"\0" if bits[i : i + 8] == "1" * 8 else b"") for i in range(0, len(bits), 8))

    order = []
    for my in range(mh):
        for mx in range(mw):
            for c, (a, d) in enumerate(sampling):
                for y in range(d):
                    for x in range(a):
                        order.append((my * mw + mx, c, planes[c][my * d + y][mx * a + x]))
    for m, c, block in order:
        if restart and m and m % restart == 0 and m != count:
            data += flush(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, pred = "", [0] * n
        count = m
        s, e = extra(int(block[0]) - pred[c])
        pred[c] = int(block[0])
        bits += dcc[s] + e
        run = 0
        last = max((i for i in range(1, 64) if block[i]), default=0)
        for v in block[1 : last + 1]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits += acc[0xF0]
                run -= 16
            s, e = extra(int(v))
            bits += acc[run << 4 | s] + e
            run = 0
        if last < 63:
            bits += acc[0x00]
    return out + data + flush(bits) + bytes([0xFF, media.EOI])


def _planes(rng, rows, cols):
    p = np.zeros((rows, cols, 64), int)
    p[:, :, 0] = rng.integers(-200, 200, (rows, cols))
    for _ in range(rows * cols * 6):
        p[rng.integers(rows), rng.integers(cols), rng.integers(1, 64)] = rng.integers(-300, 300)
    return p


def test_decoder_on_grey_and_colour_images():
    rng = np.random.default_rng(3)
    cases = []
    grey = _planes(rng, 3, 4)
    cases.append((slow_jpeg([grey], [(1, 1)], 30, 20), grey))
    cases.append((slow_jpeg([grey], [(1, 1)], 32, 24, restart=5), grey))
    y, cb, cr = _planes(rng, 4, 4), _planes(rng, 2, 2), _planes(rng, 2, 2)
    cases.append((slow_jpeg([y, cb, cr], [(2, 2), (1, 1), (1, 1)], 32, 32), y))
    cases.append((slow_jpeg([y, cb, cr], [(2, 2), (1, 1), (1, 1)], 27, 30, restart=3), y))
    heads, coefs, kinds = media.decode_blocks([c for c, _ in cases])
    for (_, lum), head, coef, kind in zip(cases, heads, coefs, kinds):
        want = np.clip(np.rint(lum[:, :, 0] * 2 / 8 + 128), 0, 255)
        thumb = media.thumbnail(head, coef, kind)
        assert thumb.shape == (-(-head.height // 8), -(-head.width // 8))
        assert (thumb == want[: thumb.shape[0], : thumb.shape[1]]).all()
        got = sorted(map(tuple, coef[kind == 0]))
        assert got == sorted(map(tuple, lum.reshape(-1, 64)))


def split_scans(raw):
    """The three components of an interleaved 4:4:4 image of :func:`slow_jpeg`, each coded in a scan of its own."""
    heads, coefs, kinds = media.decode_blocks([raw])
    sos = raw.index(bytes([0xFF, media.SOS]))
    out = raw[:sos]
    for c, part in enumerate(heads[0].parts):
        blocks = coefs[0][kinds[0] == c].astype(int)
        rows, cols = -(-heads[0].height // 8), -(-heads[0].width // 8)
        one = slow_jpeg([blocks.reshape(rows, cols, 64)], [(1, 1)], heads[0].width, heads[0].height)
        at = one.index(bytes([0xFF, media.SOS]))
        out += media._segment(media.SOS, bytes([1, part.ident, 0, 0, 63, 0])) + one[at + 10 : -2]
    return out + bytes([0xFF, media.EOI])


def test_foreign_and_broken_images(spark):
    rng = np.random.default_rng(5)
    y, cb, cr = (_planes(rng, 3, 4) for _ in range(3))
    mixed = slow_jpeg([y, cb, cr], [(1, 1)] * 3, 30, 20)
    apart = split_scans(mixed)
    fine = media.encode_payloads(np.frombuffer(b"some bytes", np.uint8), np.array([0, 10]))[0]
    progressive = fine.replace(bytes([0xFF, media.SOF0]), bytes([0xFF, 0xC2]), 1)
    assert len(media.parse_scans(apart)) == 3
    rows = [(1, fine), (2, mixed), (3, apart), (4, b"no image"), (5, None), (6, fine[: len(fine) // 2]), (7, progressive), (8, mixed[:-40]), (9, b""), (None, fine)]
    got = {r.doc_id: r for r in media.decode_media(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)).collect()}
    assert len(got) == len(rows)
    assert got[2].feature == got[3].feature and got[2].error is None and got[2].n_bytes is None and got[2].width == 30
    assert got[1].n_bytes == got[None].n_bytes == 10 and got[1].error is None
    for i in (4, 5, 6, 7, 9):
        assert got[i].error and got[i].feature is None, i
    assert got[5].media_sha256 is None and got[4].media_bytes == 8


def test_every_byte_survives():
    raw = bytes(range(256)) * 5 + b"\xff\xff\x00"
    heads, coefs, _ = media.decode_blocks(media.encode_payloads(np.frombuffer(raw, np.uint8), np.array([0, len(raw), len(raw)])))
    payload, n = media.payload_of(heads[0], coefs[0])
    assert n == len(raw) and payload[:n] == raw and set(payload[n:]) <= {0} and len(payload) % 64 == 0
    assert media.payload_of(heads[1], coefs[1]) == (b"\0" * 64, 0)


def test_media_columns(docs, rows, wide, empty):
    got = media.decode_media(media.encode_media(docs)).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        pay = raw + b"\0" * ((-len(raw) % 64) if raw else 64)
        want[(r[0], len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))] += 1
    assert Counter((g.doc_id, g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) for g in got) == want
    by_payload = {}
    for g in got:
        assert by_payload.setdefault((g.payload_sha256, g.n_bytes), (g.media_sha256, g.feature, g.media_bytes)) == (g.media_sha256, g.feature, g.media_bytes)
    assert media.decode_media(media.encode_media(wide)).count() == len(rows)
    assert media.decode_media(media.encode_media(empty)).count() == 0
