"""Operator 3, SimHash near-duplicates with pigeonring filtering.

Fingerprints are 64 bits: for each bit, the majority over the XXH64 (seed 42) of
all 3-word shingles. Two fingerprints link when they differ in at most 3 bits.

Candidates come from the pigeonring principle. The 64 bits are a ring of 8
segments; if two fingerprints differ in at most 3 bits, some segment starts a
chain whose first l segments differ in at most floor(3 l / 8) bits together, for
every l: 0, 0, 1, 1, 1, 2, 2, 3. So a chain's first two segments are equal, and
of the next three at most one differs. A fingerprint gets 8 starts x 3 choices
of the segment left out = 24 keys of 32 bits; linked pairs share a key, and the
chain budgets are tested on each candidate before its full Hamming distance.

Keys shared by more than ``bucket_cap`` different fingerprints are not paired.
There, each fingerprint is sent to every centre at most 2 flips away in the bits
outside the key; at each centre that has a member at most 1 flip away, all
members link to the least such member. 2 + 1 flips are within 3 bits, and any
pair within 3 bits has such a centre, so components are the same, at a cost in
proportion to the bucket.

Edge cases: null text counts as empty; a text without words has fingerprint
zero, which links like any other; 1 or 2 words form one shingle. Equal
fingerprints collapse to one node before any join, so groups of exact copies
cost nothing. Null doc_ids keep their row; a component's id is its smallest
non-null doc_id. Repeated rows stay repeated. Only ``doc_id`` and ``text`` are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytegrid import chunks, lanes64, split_words, text_bytes, xxh64
from .components import connected
from .scratch import files_for, keep

SEGMENTS = 8
MAX_BITS = 3
BUDGETS = [MAX_BITS * length // SEGMENTS for length in range(1, SEGMENTS + 1)]
BUCKET_CAP = 1024
_GRAMS_AT_ONCE = 1 << 16


def fingerprint_arrow(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Signed 64-bit SimHash of each text of an Arrow string array."""
    data, off = text_bytes(texts)
    words = split_words(data, off, lower=True)
    n = words.counts
    grams = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(grams, out=first[1:])
    doc = np.repeat(np.arange(len(n)), grams)
    begin = np.arange(first[-1]) - first[doc] + words.first[doc]
    last = np.minimum(begin + shingle - 1, words.first[doc + 1] - 1)
    h = xxh64(lanes64(words.norm), words.start[begin], words.start[last] + words.length[last] - words.start[begin], seed)
    sums = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(h), _GRAMS_AT_ONCE):
        bits = np.unpackbits(h[at : at + _GRAMS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        of = doc[at : at + _GRAMS_AT_ONCE]
        starts = np.append(0, np.flatnonzero(np.diff(of)) + 1)
        sums[of[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > grams[:, None], axis=1).reshape(-1, 8).copy().view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, *carry: str, shingle: int = 3) -> DataFrame:
    """``(doc_id, *carry, fp)``; ``carry`` names long columns that go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *carry]
        for batch in batches:
            for part in chunks(batch):
                fp = pa.array(fingerprint_arrow(part.column("text"), shingle))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), fp], [*names, "fp"])

    schema = ", ".join(f"{c} long" for c in ("doc_id", *carry, "fp"))
    picked = docs.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", *carry)), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, schema)


def _keys() -> Column:
    """The 24 pigeonring keys of ``fp``: number of the key above 32 bits of segments."""
    seg = [f"(shiftrightunsigned(fp, {8 * i}) & 255)" for i in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        for out in range(3):
            used = [0, 1, *(2 + k for k in range(3) if k != out)]
            value = " | ".join(f"shiftleft({seg[(start + s) % SEGMENTS]}, {8 * k})" for k, s in enumerate(used))
            keys.append(f"({value} | shiftleft({start * 3 + out}L, 32))")
    return F.expr(f"array({', '.join(keys)})")


def _viable(a: str, b: str, start: str) -> Column:
    """Chain budgets from the segment ``start`` on, the shortest chain first; the last is the Hamming distance."""
    x = f"({a} ^ {b})"
    ring = f"(shiftrightunsigned({x}, 8 * {start}) | IF({start} = 0, 0L, shiftleft({x}, 64 - 8 * {start})))"
    tests = [f"bit_count({ring} & {(1 << 8 * k) - 1}L) <= {BUDGETS[k - 1]}" for k in range(1, SEGMENTS)]
    return F.expr(" AND ".join([*tests, f"bit_count({x}) <= {MAX_BITS}"]))


def _flips() -> Column:
    """Up to two of the 32 bits outside a key, as bit numbers relative to the key's start; -1: none."""
    def at(t: int, out: int) -> int:
        return 8 * [2 + out, 5, 6, 7][t // 8] + t % 8

    some = [(), *((t,) for t in range(32)), *combinations(range(32), 2)]
    every = [F.array(*(F.struct(*(F.lit(at(t[k], out) if k < len(t) else -1).alias(f"p{k}") for k in range(2)), F.lit(len(t)).alias("r")) for t in some)) for out in range(3)]
    return F.when(F.col("out") == 0, every[0]).when(F.col("out") == 1, every[1]).otherwise(every[2])


def _pairs(rows: DataFrame) -> DataFrame:
    a, b = rows.select("key", F.col("fp").alias("u")), rows.select("key", F.col("fp").alias("v"))
    near = a.join(b, "key").where("u < v").withColumn("start", F.expr("cast(shiftright(key, 32) div 3 as int)"))
    return near.where(_viable("u", "v", "start")).select("u", "v")


def _stars(rows: DataFrame) -> DataFrame:
    ids = rows.select("key", "fp", F.expr("cast(shiftright(key, 32) div 3 as int)").alias("start"), F.expr("cast(shiftright(key, 32) % 3 as int)").alias("out"))
    bit = "IF({p} < 0, 0L, shiftleft(1L, cast(({p} + 8 * start) % 64 as int)))"
    sent = ids.select("key", "fp", "start", F.explode(_flips()).alias("f")).select("key", "fp", F.expr(f"fp ^ {bit.format(p='f.p0')} ^ {bit.format(p='f.p1')}").alias("centre"), F.col("f.r").alias("r"))
    hubs = sent.where("r <= 1").groupBy("key", "centre").agg(F.min("fp").alias("hub"))
    return sent.join(hubs, ["key", "centre"]).where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))


def links(fps: DataFrame, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Links ``(u, v)`` between different fingerprints at most 3 bits apart.

    ``fps`` has each fingerprint once, as ``fp``. Buckets over ``bucket_cap`` give
    a spanning subset of their links (the same components), the others all.
    """
    keyed = fps.select("fp", F.explode(_keys()).alias("key"))
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep(keyed.join(size, "key"), "simhash-keys", files_for(fps.count() * 3 * SEGMENTS))
    return _pairs(shared.where(F.col("n") <= bucket_cap)).union(_stars(shared.where(F.col("n") > bucket_cap))).distinct()


def components(docs: DataFrame, *carry: str, bucket_cap: int = BUCKET_CAP) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, *carry, fp)``, and for each fingerprint ``(fp, root)``.

    Fingerprints of a component share ``root``, its least fingerprint.
    """
    rows = keep(fingerprints(docs, *carry), "simhash-fps")
    nodes = keep(rows.groupBy("fp").agg(F.count("*").alias("n")).select("fp"), "simhash-nodes", files_for(rows.count() * 3 * SEGMENTS))
    found = connected(links(nodes, bucket_cap)).withColumnRenamed("node", "fp")
    return rows, nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Ids are summed up by fingerprint before components, so neither a component
    nor a fingerprint with very many documents meets in one task.
    """
    rows, roots = components(docs, bucket_cap=bucket_cap)
    of_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    of_root = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = keep(of_fp.join(of_root, "root").select("fp", "component_id"), "simhash-ids", files_for(rows.count()))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id (then the smallest text hash) of each component, as it was.

    Of rows equal in doc_id and text one stays.
    """
    # The row goes along as one column, so that no name of it meets one of the keys.
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    rows, roots = components(keyed, "k1", "k2")
    of_fp = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("b")).join(roots, "fp")
    best = of_fp.groupBy("root").agg(F.min("b").alias("b")).select("b.k1", "b.k2")
    return keyed.join(best, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by SimHash."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
