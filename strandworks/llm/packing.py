"""Operator 5, packing into optimal length buckets.

A document's length is its number of words. The global histogram of every distinct
length goes to the driver as an Arrow table, where dynamic programming chooses the
bucket boundaries that minimise padding; the last boundary is the longest document.
Its size is bounded by the square root of the corpus: D distinct lengths need
D * D / 2 words at least, so 100 TB of text have some six million at most, and the
tables at hand some thousands. Inside a bucket, documents in hash order form
batches of ``budget // boundary`` documents, so a padded batch never exceeds the
token budget; a document longer than the budget is a batch of its own.

Positions inside a bucket come from counts by (bucket, shard), with shards of
about SHARD_ROWS documents: a bucket with a third of all rows is many shards.

Edge cases: null and empty texts have length 0 and go to the first bucket;
repeated rows are packed each; ties in hash order are rows equal in doc_id and
text; of boundaries with equal padding the lowest are taken; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_ROWS = 20_000
_WORD = "[^ \t-\r]+"


def word_count(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def optimal_boundaries(lengths, counts, buckets: int) -> list[int]:
    """Boundaries (some of ``lengths``, ascending, the last included) of at most ``buckets`` buckets with least padding.

    ``lengths`` are distinct and ascending, ``counts`` the documents of each. The cost
    of one more bucket fulfils the quadrangle inequality, so the best last cut grows
    with the number of lengths: cuts are found for every second, fourth, ... number
    first, and each bounds the search of its neighbours.
    """
    edge, n = np.maximum(np.asarray(lengths, np.int64), 1), np.asarray(counts, np.int64)
    m = len(edge)
    if not m:
        return []
    docs, total = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * np.asarray(lengths, np.int64)))
    edge = np.concatenate([[0], edge])
    best = edge * docs - total  # of one bucket for the first 0, 1, ..., m lengths
    cuts = []
    top = 1 << m.bit_length()
    for _ in range(min(buckets, m) - 1):
        then, cut = best.copy(), np.zeros(m + 2, np.int64)
        step = top
        while step:
            js = np.arange(step, m + 1, 2 * step)
            if len(js):
                low, high = cut[js - step], np.where(js + step <= m, cut[np.minimum(js + step, m)], js)
                high = np.maximum(np.minimum(high, js), low)
                sizes = high - low + 1
                begin = np.cumsum(sizes) - sizes
                i = np.arange(sizes.sum()) + np.repeat(low - begin, sizes)
                j = np.repeat(js, sizes)
                cost = best[i] + edge[j] * (docs[j] - docs[i]) - (total[j] - total[i])
                least = np.minimum.reduceat(cost, begin)
                first = np.where(cost == np.repeat(least, sizes), i, m + 1)
                then[js], cut[js] = least, np.minimum.reduceat(first, begin)
            step //= 2
        cuts.append(cut)
        best = then
    out, j = [], m
    for cut in reversed(cuts):
        if cut[j] < j:  # else a bucket less is as good
            out.append(int(edge[j]))
            j = int(cut[j])
        if not j:
            break
    if j:
        out.append(int(edge[j]))
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``(doc_id, n_tokens, bucket, bucket_len, batch, slot)``, one row for each row of ``docs``."""
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("n_tokens"), F.xxhash64("doc_id", "text").alias("k")), "pack-lengths")
    found = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    lengths, held = (found.column(c).to_numpy() for c in ("n_tokens", "n"))
    limits = optimal_boundaries(lengths, held, buckets) or [1]
    shards = max(1, -(-int(held.sum()) // SHARD_ROWS))
    edges = F.array(*(F.lit(x).cast("long") for x in limits))
    placed = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))).withColumn("shard", F.pmod("k", F.lit(shards)))
    placed = placed.withColumn("bucket_len", F.element_at(edges, F.col("bucket") + 1))
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("k", "doc_id")) - 1
    at = placed.join(before.drop("n"), ["bucket", "shard"]).withColumn("at", F.col("before") + turn)
    held = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    return at.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("at") / held).alias("batch"), F.pmod("at", held).alias("slot"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in padded batches of optimal length buckets."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
