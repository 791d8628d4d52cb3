"""How often weak neighbours of strong k-mers come at each position of a read, from runs of windows.

A k-mer's windows meet in their minimizer's bucket, which gives a row for each k-mer: how
often it comes, and at which positions if it is weak. Strong k-mers are dealt out by their
first bases. A row goes to each bucket where it has a strong neighbour, and most neighbours
have the same first bases, so it is sent some times and not once for each of up to 3k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strandworks.functions import dna
from strandworks.lineage import keep
from strandworks.operators import runs
from strandworks.operators.runs import Rows, _blobs, _spelled, _starts, _whole

FIRST = 5  # bases of a bucket at most
BITS = 22  # of a code that has a bit of its own in the table of strong k-mers
SLOTS = 1 << 25  # bits of the table of longer ones, by hash
AT_ONCE = 1 << 20  # positions that are sorted at once


def _turned(codes: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of codes without the leading one."""
    x = ~codes.astype(np.uint64)
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = x >> np.uint64(bits) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(bits)
    return (x.byteswap() >> np.uint64(64 - 2 * k)).astype(np.int64)


def _around(codes: np.ndarray, k: int) -> np.ndarray:
    """The canonical neighbours of canonical codes, a row of 3k each; one may come twice, or be the k-mer itself."""
    masks = np.array([x << 2 * i for i in range(k) for x in (1, 2, 3)], np.int64)
    back = np.array([x << 2 * (k - 1 - i) for i in range(k) for x in (1, 2, 3)], np.int64)
    return np.minimum(codes[:, None] ^ masks, _turned(codes, k)[:, None] ^ back)


def _slot(codes: np.ndarray, k: int) -> np.ndarray:
    return codes if 2 * k <= BITS else (runs.mixed(codes) % np.uint32(SLOTS)).astype(np.int64)


def _table(lead: DataFrame, k: int) -> np.ndarray:
    """A bit for the slot of each strong k-mer, made in a task; the driver gets its SLOTS / 8 bytes at most."""
    size = (1 << 2 * k if 2 * k <= BITS else SLOTS) + 7 >> 3

    def some(batches: Rows) -> Rows:
        for batch in batches:
            slot = _slot(batch.column("code").to_numpy(), k)
            at, which = np.unique(slot >> 3, return_inverse=True)
            bits = np.zeros(len(at), np.int32)
            np.bitwise_or.at(bits, which, np.int32(1) << (slot & 7).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits)], ["place", "bits"])

    def whole(batches: Rows) -> Rows:
        table = np.zeros(size, np.uint8)
        for batch in batches:
            np.bitwise_or.at(table, batch.column("place").to_numpy(), batch.column("bits").to_numpy().astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["table"])

    places = lead.select("code").mapInArrow(some, "place long, bits int").groupBy("place").agg({"bits": "bit_or"}).toDF("place", "bits")
    made = places.repartition(1).mapInArrow(whole, "table binary").first()
    return np.zeros(size, np.uint8) if made is None else np.frombuffer(made[0], np.uint8)


def _sorted(codes: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a code and a position in order."""
    bits = int(pos.max(initial=0)).bit_length()
    if int(codes.max(initial=0)).bit_length() + bits <= 63:
        both = np.sort(codes << np.int64(bits) | pos)
        return both >> np.int64(bits), both & np.int64((1 << bits) - 1)
    order = np.lexsort((pos, codes))
    return codes[order], pos[order]


def _tallied(codes: np.ndarray, pos: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of a code and a position once, in order, and how often it comes: ``n`` times each, or once."""
    if n is None:
        codes, pos = _sorted(codes, pos)
    else:
        order = np.lexsort((pos, codes))
        codes, pos, n = codes[order], pos[order], n[order]
    at = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (pos[1:] != pos[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[at], pos[at], np.diff(np.append(at, len(codes))) if n is None else np.add.reduceat(n, at) if len(at) else n


def places(reads: DataFrame, k: int, strong: float) -> DataFrame:
    """``code, n, at`` of canonical k-mers, codes without the leading one: ``at`` has the positions of a k-mer's windows, in order, if they are at most ``strong``, else null."""
    rows = runs.pieces(reads, k, placed=True)

    def part(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, codes, _ = runs.unpacked(batches, k)
        pos = np.repeat(_whole(batches, "pos", np.int32).astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return _tallied(codes, pos)

    def work(batches: list[pa.RecordBatch]) -> Rows:
        held, size, found = [], 0, []
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):  # a very frequent minimizer's windows are tallied part by part
            held.append(row)
            size += int(_whole([row], "n", np.uint8).sum())
            if size >= runs.ENOUGH:
                found.append(part(held))
                held, size = [], 0
                if len(found) > 1 and sum(len(f[0]) for f in found[1:]) >= len(found[0][0]):
                    found = [_tallied(*map(np.concatenate, zip(*found)))]
        found += [part(held)] if held else []
        codes, pos, n = found[0] if len(found) == 1 else _tallied(*map(np.concatenate, zip(*found)))
        at = _starts(codes)
        if not len(at):
            return
        times = np.add.reduceat(n, at)
        weak = times <= strong
        inside = np.repeat(weak, np.diff(np.append(at, len(codes))))
        said = _blobs(np.repeat(pos[inside], n[inside]).astype(np.int32), np.cumsum(np.where(weak, times, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(codes[at]), pa.array(times), pc.if_else(pa.array(weak), said, None)], ["code", "n", "at"])

    return runs._by_bucket(rows, work, "code long, n long, at binary")


def _dealt(found: DataFrame, k: int, table: np.ndarray, first: int) -> DataFrame:
    """Rows of packed arrays by bucket: weak k-mers with their positions, ``mark, n, pos``, and strong ones, ``lead, times``, wherever a strong neighbour is; strong ones in their own bucket too."""
    names = ["bucket", "n", "mark", "pos", "deep", "lead", "times"]

    def deal(batches: Rows) -> Rows:
        for batch in batches:
            codes, times, weak = batch.column("code").to_numpy(), batch.column("n").to_numpy(), batch.column("at").is_valid().to_numpy(zero_copy_only=False)
            near = _around(codes, k)
            slot = _slot(near, k)
            hit = (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool) & (near != codes[:, None])
            row, which = np.nonzero(hit)
            shift = np.int64(2 * (k - first))
            own = np.flatnonzero(~weak)
            pairs = np.unique(np.concatenate([near[row, which] >> shift, codes[own] >> shift]) * len(codes) + np.concatenate([row, own]))
            of, row = pairs // max(len(codes), 1), pairs % max(len(codes), 1)
            if not len(of):
                continue
            size, pos = np.where(weak, times, 0), _whole([batch], "at", np.int32)
            begin = np.cumsum(size) - size
            last = np.append(np.flatnonzero(np.diff(of)), len(of) - 1)
            w = weak[row]
            taken = size[row]
            data = pos[np.arange(taken.sum()) + np.repeat(begin[row] - (np.cumsum(taken) - taken), taken)]
            n = times[row][w]
            weaks, leads = np.cumsum(w)[last], np.cumsum(~w)[last]
            deep = n >= 255
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[last].astype(np.int32)), _blobs(np.minimum(n, 255).astype(np.uint8), weaks), _blobs(codes[row][w], weaks), _blobs(data, np.cumsum(taken)[last]),
                 _blobs(n[deep], np.append(0, np.cumsum(deep))[weaks]), _blobs(codes[row][~w], leads), _blobs(times[row][~w], leads)], names,
            )

    def run(batches: Rows) -> Rows:
        yield from runs._gathered(deal(batches), runs.HELD)

    return found.mapInArrow(run, ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in names))


def error_ratios(reads: DataFrame, k: int, strong: float) -> DataFrame:
    """``kmer, pos, ratio`` of k-mers over ``strong``: how often their weak 1-substitution neighbours come at each position of a read.

    The ratio is the upper median of the neighbours' counts at a position, times their
    number, over the k-mer's own count. Strong neighbours correct it: they add to that
    count, and the same over each of theirs is taken off.
    """
    if not 0 < k <= dna.LONGEST:
        raise ValueError(f"k-mers of 1 to {dna.LONGEST} bases have codes")
    first = max(1, min(FIRST, k // 2 - 1))
    found = keep(places(reads, k, strong), "places")
    sent = _dealt(found, k, _table(found.where("at IS NULL"), k), first)

    def work(batches: list[pa.RecordBatch]) -> Rows:
        here = np.unique(np.concatenate([b.column("bucket").to_numpy() for b in batches]))
        n, weak, pos = _whole(batches, "n", np.uint8).astype(np.int64), _whole(batches, "mark", np.int64), _whole(batches, "pos", np.int32).astype(np.int64)
        n[n == 255] = _whole(batches, "deep", np.int64)
        # Several buckets at once may have a k-mer more than once.
        lead, at = np.unique(_whole(batches, "lead", np.int64), return_index=True)
        times = _whole(batches, "times", np.int64)[at]
        weak, at = np.unique(weak, return_index=True)
        begin, n = (np.cumsum(n) - n)[at], n[at]
        pos = pos[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)]
        row, pos, s = _tallied(np.repeat(np.arange(len(weak)), n), pos)
        begin = np.searchsorted(row, np.arange(len(weak) + 1))
        own = np.flatnonzero(np.isin(lead >> np.int64(2 * (k - first)), here))
        for a in range(0, len(own), 1 << 13):
            at = own[a : a + (1 << 13)]
            near = np.sort(_around(lead[at], k), axis=1)
            once = np.append(np.ones((len(at), 1), bool), near[:, 1:] != near[:, :-1], axis=1) & (near != lead[at][:, None])
            of, near = np.nonzero(once)[0], near[once]
            i = np.minimum(np.searchsorted(lead, near), max(len(lead) - 1, 0))
            both = lead[i] == near
            more = np.bincount(of[both], times[i[both]], len(at))
            inverse = np.bincount(of[both], 1 / times[i[both]], len(at))
            if not len(weak):
                continue
            i = np.minimum(np.searchsorted(weak, near), len(weak) - 1)
            of, i = of[weak[i] == near], i[weak[i] == near]
            held = np.cumsum(begin[i + 1] - begin[i])
            low = 0
            while low < len(of):  # whole k-mers of some AT_ONCE positions
                high = int(np.searchsorted(held, (held[low - 1] if low else 0) + AT_ONCE, side="right"))
                high = int(np.searchsorted(of, of[min(high, len(of) - 1)], side="left")) if high < len(of) else len(of)
                high = high if high > low else int(np.searchsorted(of, of[low], side="right"))
                yield _ratios(lead[at], times[at], more, inverse, of[low:high], begin[i[low:high]], begin[i[low:high] + 1], pos, s)
                low = high

    def _ratios(lead: np.ndarray, times: np.ndarray, more: np.ndarray, inverse: np.ndarray, of: np.ndarray, begin: np.ndarray, end: np.ndarray, pos: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        count = end - begin
        taken = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        places, s = int(pos.max(initial=0)) + 1, s[taken]
        group, s = _sorted((np.repeat(of, count) * places) + pos[taken], s)
        at = _starts(group)
        size = np.diff(np.append(at, len(group)))
        mass = (s[at + size // 2] * size).astype(np.float64)
        of, where = group[at] // places, group[at] % places
        ratio = np.where(more[of] == 0, mass / times[of], mass / (times[of] + more[of]) - mass * inverse[of])
        some = np.unique(of)
        text = _spelled(lead[some], k).take(pa.array(np.searchsorted(some, of)))
        return pa.RecordBatch.from_arrays([text, pa.array(where.astype(np.int32)), pa.array(ratio)], ["kmer", "pos", "ratio"])

    return runs._by_bucket(sent, work, "kmer string, pos int, ratio double")
