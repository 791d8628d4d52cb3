"""Operator 2, exact substring dedup behind a count-min prefilter.

A window is ``width`` consecutive words of one document. A word is removed if it
lies in a window whose word sequence also starts elsewhere in the corpus.

1. Sketch. Every window is represented by its anchor: the ``gram``-word gram of
   least hash inside it. Windows with the same words have the same anchor gram at
   the same offset, so a gram occurs as an anchor at least as often as any window
   it represents occurs. Each input partition counts its anchor positions in a
   count-min sketch (``ROWS`` rows, cells saturating at 2); the partition sketches
   are merged slice by slice. The merged sketch therefore never underestimates a
   window's count: estimate 1 proves that a window is unique.
2. Exact pass. Windows estimated repeated send their 128-bit sequence hash to the
   hash bucket that owns it, once for each chunk of text (repeats within a chunk
   are combined first). The bucket groups equal hashes and answers with one bit
   for each hash; the chunk turns the bits into removed word ranges of its texts.
3. The ranges, keyed by text and written as a table, are joined to the documents,
   so that the adaptive join can split a text that very many documents share.

A chunk is named by its task, its turn in the task and its content, so a task that
is run again after a lost executor sends the same names: read ``docs`` from a table
or a checkpoint, whose partitions are the same each time.

The sketch is broadcast; its size is ``ROWS * cells / 8`` bytes, with ``cells``
growing with the input up to ``MAX_CELLS`` (48 MiB in all). Beyond, more windows
pass to the exact pass; the result stays the same.

Edge cases: null or short texts have no windows; repeated rows are copies of each
other, so their windows repeat; overlapping occurrences within one document
count as different starts. Texts of any length are handled whole. An empty table
gives an empty result. Null doc_ids keep their row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import Words, chunks, lanes64, split_words, splitmix, text_bytes, xxh64
from .scratch import keep

WIDTH = 35
GRAM = 16
ROWS = 3
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 27
BYTES_A_CELL = 32  # of text; about one anchor in three cells
SLICE_CELLS = 1 << 18
BUCKET_TEXT_BYTES = 8 << 20
MAX_TASKS = 20_000
CHUNK_BYTES = 2 << 20  # of text whose equal windows are combined before they are sent

# Bases of the two polynomial sequence hashes: odd, so that powers have inverses.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(base, -1, 1 << 64)
        _POWERS[base] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (base, inverse))
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


class Sequences:
    """Hashes of any runs of words of one chunk of texts."""

    def __init__(self, words: Words) -> None:
        self.words = words
        lanes = lanes64(words.norm)
        self.prefix = []
        for base, seed in zip(_BASES, (17, 91)):
            h = xxh64(lanes, words.start, words.length, seed)
            up, down = _powers(base, len(h) + 1)
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[:-1], out=sums[1:])
            self.prefix.append((sums, down))

    def hashes(self, first: np.ndarray, size: int, which: int) -> np.ndarray:
        sums, down = self.prefix[which]
        return splitmix((sums[first + size] - sums[first]) * down[first])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each window, and the text it lies in."""
        n = np.maximum(self.words.counts - width + 1, 0)
        ends = np.cumsum(n)
        text = np.repeat(np.arange(len(n)), n)
        return np.arange(ends[-1] if len(ends) else 0) - (ends - n)[text] + self.words.first[text], text


def anchors(seq: Sequences, starts: np.ndarray, text: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of each window, and the hash of every gram of the chunk.

    The minimum runs over whole hashes, and ties go to the leftmost gram, so equal
    windows have their anchor at the same offset in whatever chunk they lie.
    """
    n_words = len(seq.words.start)
    n = n_words - gram + 1
    if not len(starts) or n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = seq.hashes(np.arange(n), gram, 0)
    span, have, low, where = width - gram + 1, 1, grams, np.arange(n)
    while have < span:  # sliding minimum by doubling
        step = min(have, span - have)
        right = low[step:] < low[: len(low) - step]
        low = np.where(right, low[step:], low[: len(low) - step])
        where = np.where(right, where[step:], where[: len(where) - step])
        have += step
    return where[starts], grams


def _cells(gram_hash: np.ndarray, cells: int) -> list[np.ndarray]:
    mask = np.uint64(cells - 1)
    return [(splitmix(gram_hash + np.uint64(r * 0x5851F42D)) & mask).astype(np.int64) for r in range(ROWS)]


def _prepared(part: pa.RecordBatch, width: int, gram: int):
    seq = Sequences(split_words(*text_bytes(part.column("text"))))
    starts, text = seq.windows(width)
    where, grams = anchors(seq, starts, text, width, gram)
    return seq, starts, text, where, grams


def repeated_sketch(docs: DataFrame, cells: int, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """The merged count-min sketch as bits: is a cell's count 2 or more? Shape (ROWS, cells / 8)."""
    cut = min(cells, SLICE_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros((ROWS, cells // 8), np.uint8), np.zeros((ROWS, cells // 8), np.uint8)  # is the count over 0, over 1?
        for batch in batches:
            for part in chunks(batch, limit=CHUNK_BYTES):
                *_, where, grams = _prepared(part, width, gram)
                if not len(where):
                    continue
                new = np.ones(len(where), bool)
                new[1:] = where[1:] != where[:-1]  # an anchor is shared by neighbouring windows
                for row, cell in enumerate(_cells(grams[where[new]], cells)):
                    cell, n = np.unique(cell, return_counts=True)
                    at, bit = cell >> 3, np.uint8(128) >> (cell & 7).astype(np.uint8)
                    again = (n > 1) | (one[row, at] & bit > 0)
                    np.bitwise_or.at(two[row], at[again], bit[again])
                    np.bitwise_or.at(one[row], at, bit)
        codec = pa.Codec("zstd", 1)
        for k in range(ROWS * cells // cut):
            a, b = (x.ravel()[k * cut // 8 : (k + 1) * cut // 8] for x in (one, two))
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([codec.compress(a.tobytes() + b.tobytes(), asbytes=True)], pa.binary())], ["slice", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, one, two = pa.Codec("zstd"), {}, {}
        for batch in batches:
            for key, raw in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                got = np.frombuffer(codec.decompress(raw.as_py(), cut // 4, asbytes=True), np.uint8)
                a, b = got[: cut // 8], got[cut // 8 :]
                if key in one:
                    two[key] = two[key] | b | (one[key] & a)
                    one[key] = one[key] | a
                else:
                    one[key], two[key] = a, b
        for key, bits in two.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([codec.compress(bits.tobytes(), asbytes=True)], pa.binary())], ["slice", "counts"])

    schema, codec = "slice long, counts binary", pa.Codec("zstd")
    merged = docs.select("text").mapInArrow(count, schema).repartition(F.col("slice")).mapInArrow(merge, schema)
    out = np.zeros((ROWS * cells // cut, cut // 8), np.uint8)
    for row in merged.toLocalIterator():  # at most ROWS * MAX_CELLS / 8 bytes in all
        out[row["slice"]] = np.frombuffer(codec.decompress(row["counts"], cut // 8, asbytes=True), np.uint8)
    return out.reshape(ROWS, cells // 8)


def _estimate_repeated(sketch: np.ndarray, cells: int, gram_hash: np.ndarray) -> np.ndarray:
    ok = np.ones(len(gram_hash), bool)
    for bits, cell in zip(sketch, _cells(gram_hash, cells)):
        ok &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# Rows of both exchanges. Requests: the hashes of one chunk that one bucket owns.
# Chunk rows (bucket -1): what is needed to turn answers into word ranges.
_EXCHANGE = "chunk binary, bucket int, dealt int, body binary, extra binary"


_HASHES = np.dtype([("a", "<u8"), ("b", "<u8")])


def _exchanged(chunk: list[bytes], bucket: list[int], dealt: list[int], body: list[bytes], extra: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.binary()), pa.array(bucket, pa.int32()), pa.array(dealt, pa.int32()), pa.array(body, pa.binary()), pa.array(extra, pa.binary())],
        ["chunk", "bucket", "dealt", "body", "extra"],
    )


def asked_windows(docs: DataFrame, sketch: np.ndarray, cells: int, buckets: int, tasks: int, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows of the first exchange: the hashes of windows estimated repeated, dealt to ``tasks`` tasks by their bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, turn_of = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in chunks(batch, limit=CHUNK_BYTES):
                turn_of += 1
                seq, starts, text, where, grams = _prepared(part, width, gram)
                if not len(where):
                    continue
                maybe = np.flatnonzero(_estimate_repeated(shared.value, cells, grams[where]))
                if not len(maybe):
                    continue
                got = np.empty(len(maybe), _HASHES)
                got["a"], got["b"] = seq.hashes(starts[maybe], width, 0), seq.hashes(starts[maybe], width, 1)
                order = np.lexsort((got["b"], got["a"]))
                put = got[order]
                new = np.ones(len(put), bool)
                new[1:] = put[1:] != put[:-1]
                number = np.empty(len(put), np.int64)
                number[order] = np.cumsum(new) - 1
                put, often = put[new], np.diff(np.append(np.flatnonzero(new), len(put))) > 1
                keys = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")])
                # The same in a rerun of the task: answers that other tasks hold by this name stay valid.
                name = hashlib.blake2b(b"%d:%d:" % (partition, turn_of) + keys.tobytes() + got.tobytes(), digest_size=16).digest()
                used = np.unique(text[maybe])
                local = np.searchsorted(used, text[maybe])
                word = starts[maybe] - seq.words.first[text[maybe]]
                owner = (put["a"] >> np.uint64(40)).astype(np.int64) % buckets
                turn = np.argsort(owner, kind="stable")
                place = np.empty(len(put), np.int64)
                place[turn] = np.arange(len(put))
                plan = np.concatenate([[len(used), len(maybe), len(put)], keys[0, used], keys[1, used], local, word, place[number]]).astype("<i8")
                plan_raw = pa.Codec("zstd", 1).compress(plan.tobytes(), asbytes=True)
                chunk, bucket, dealt, body, extra = [name], [-1], [int.from_bytes(name[:3], "big") % tasks], [plan_raw], [len(plan).to_bytes(8, "little")]
                owners, begin = np.unique(owner[turn], return_index=True)
                for k, a, b in zip(owners.tolist(), begin.tolist(), [*begin[1:].tolist(), len(turn)]):
                    rows_k = turn[a:b]
                    chunk.append(name)
                    bucket.append(k)
                    dealt.append(k % tasks)
                    body.append(put[rows_k].tobytes())
                    extra.append(np.packbits(often[rows_k]).tobytes())
                yield _exchanged(chunk, bucket, dealt, body, extra)

    return docs.select("k1", "k2", "text").mapInArrow(ask, _EXCHANGE)


def removed_ranges(docs: DataFrame, sketch: np.ndarray, cells: int, buckets: int, width: int = WIDTH, gram: int = GRAM, tasks: int = MAX_TASKS) -> DataFrame:
    """``(k1, k2, begin, size)``: removed word ranges (arrays) of each text that has any, by text key.

    With more buckets than ``tasks``, a task answers several buckets, one after the other.
    """
    tasks = min(buckets, tasks)

    def answer_bucket(asked: list[tuple[bytes, int, bytes, bytes]]) -> pa.RecordBatch:
        got = np.concatenate([np.frombuffer(b, _HASHES) for _, _, b, _ in asked])
        sizes = [len(b) // _HASHES.itemsize for _, _, b, _ in asked]
        often = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for n, (_, _, _, x) in zip(sizes, asked)]).astype(bool)
        order = np.argsort(got["a"], kind="stable")
        a = got["a"][order]
        b = got["b"][order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        if ((a[1:] == a[:-1]) & ~same).any():  # equal first halves need the full order
            order = np.lexsort((got["b"], got["a"]))
            a, b = got["a"][order], got["b"][order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = np.zeros(len(got), bool)
        twice[1:] |= same
        twice[:-1] |= same
        flags = often.copy()
        flags[order] |= twice
        cut = np.append(0, np.cumsum(sizes))
        bodies = [np.packbits(flags[cut[i] : cut[i + 1]]).tobytes() for i in range(len(sizes))]
        return _exchanged([c for c, *_ in asked], [k for _, k, _, _ in asked], [0] * len(asked), bodies, [n.to_bytes(8, "little") for n in sizes])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple[bytes, int, bytes, bytes]] = []
        for batch in batches:  # sorted by bucket
            for c, k, b, x in zip(*(batch.column(n).to_pylist() for n in ("chunk", "bucket", "body", "extra"))):
                if k == -1:
                    yield _exchanged([c], [-1], [0], [b], [x])
                    continue
                if asked and asked[0][1] != k:
                    yield answer_bucket(asked)
                    asked = []
                asked.append((c, k, b, x))
        if asked:
            yield answer_bucket(asked)

    def settle(group: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        group.sort(key=lambda g: g[0])
        (_, raw, size), *answers = group
        plan = np.frombuffer(pa.Codec("zstd").decompress(raw, int.from_bytes(size, "little") * 8, asbytes=True), "<i8")
        n_used, n_maybe, n_put = plan[:3]
        k1, k2, local, word, place = np.split(plan[3:], np.cumsum([n_used, n_used, n_maybe, n_maybe]))
        flags = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: int.from_bytes(n, "little")] for _, b, n in answers])
        if len(flags) != n_put:
            raise RuntimeError("answers are missing")
        hit = flags[place].astype(bool)
        local, word = local[hit], word[hit]
        out = []
        for t, a, b in zip(*_spans(local)):
            w = word[a:b]  # ascending: windows come in order within a text
            gap = np.flatnonzero(np.diff(w) > width) + 1
            begin = w[np.append(0, gap)]
            out.append((k1[t], k2[t], begin, w[np.append(gap, len(w)) - 1] + width - begin))
        longs = pa.list_(pa.int64())
        cols = [[o[i] for o in out] for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], longs), pa.array(cols[3], longs)], ["k1", "k2", "begin", "size"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, group = None, []
        for batch in batches:  # sorted by chunk
            for c, k, b, x in zip(*(batch.column(n).to_pylist() for n in ("chunk", "bucket", "body", "extra"))):
                if c != name and group:
                    yield settle(group)
                    group = []
                name = c
                group.append((k, b, x))
        if group:
            yield settle(group)

    asked = asked_windows(docs, sketch, cells, buckets, tasks, width, gram).repartition(tasks, F.col("dealt")).sortWithinPartitions("bucket")
    answered = asked.mapInArrow(answer, _EXCHANGE).repartition(F.col("chunk")).sortWithinPartitions("chunk")
    return answered.mapInArrow(gather, "k1 long, k2 long, begin array<long>, size array<long>")


def _spans(sorted_ids: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    if not len(sorted_ids):
        return [], [], []
    begin = np.append(0, np.flatnonzero(np.diff(sorted_ids)) + 1)
    return sorted_ids[begin].tolist(), begin.tolist(), np.append(begin[1:], len(sorted_ids)).tolist()


def cut_words(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` of documents with ``begin`` and ``size`` arrays; ``kept`` only with ``texts``."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if texts else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split_words(*text_bytes(part.column("text")))
                gone = np.zeros(len(words.start) + 1, np.int64)
                begins, sizes = part.column("begin"), part.column("size")
                some = np.flatnonzero(begins.is_valid().to_numpy(zero_copy_only=False))
                for t in some.tolist():
                    b = words.first[t] + begins[t].values.to_numpy()
                    np.add.at(gone, b, 1)
                    np.add.at(gone, b + sizes[t].values.to_numpy(), -1)
                gone = np.cumsum(gone)[:-1] > 0
                counts = np.append(0, np.cumsum(gone))[words.first]
                kept_words = np.flatnonzero(~gone)
                span = words.length + 1
                kept = words.norm[np.repeat(~gone, span)] if len(span) else words.norm
                edge = np.append(0, np.cumsum(span[kept_words]))[np.searchsorted(kept_words, words.first)]
                raw, digests, pieces = kept.tobytes(), [], []
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    piece = raw[a : max(a, b - 1)]
                    digests.append(hashlib.sha256(piece).hexdigest())
                    if texts:
                        pieces.append(piece)
                made = [part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(np.diff(counts), pa.int64()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays([*made, pa.array(pieces, pa.binary())][: len(names)], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept binary" if texts else "")
    return docs.select("doc_id", "text", "begin", "size").mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, max_cells: int = MAX_CELLS, texts: bool = True) -> DataFrame:
    """Remove the words of windows that start more than once; see :func:`cut_words` for the columns."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")
    )
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max_cells, max(MIN_CELLS, 1 << max(0, (size // BYTES_A_CELL - 1)).bit_length()))
    buckets = max(8, -(-size // BUCKET_TEXT_BYTES))
    sketch = repeated_sketch(keyed, cells, width, gram)
    ranges = removed_ranges(keyed, sketch, cells, buckets, width, gram)
    one = keep(ranges.dropDuplicates(["k1", "k2"]), "removed-ranges", max(1, buckets // 16))  # copies of a text have the same ranges
    return cut_words(keyed.join(one, ["k1", "k2"], "left"), texts)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words kept of every document once repeated 35-word windows are gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 34)))) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
  ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""
