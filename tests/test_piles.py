"""Consensus of groups of reads against plain loops, and what is shuffled for it."""

import math
import random

import pytest

from strandworks.operators import dedup, piles


def plain(rows):
    """Consensus of one group by loops; rows are (seq, q)."""
    p_of = lambda v: 1.0 if v is None or v >= 127 else 0.0 if v < 0 else 1 - 10 ** (-v / 10)
    at = {}
    for seq, q in rows:
        if seq is None or q is None:
            continue
        letters = list(seq) or [""]
        for i in range(max(len(letters), len(q))):
            at.setdefault(i, []).append((letters[i] if i < len(letters) else None, p_of(q[i] if i < len(q) else None)))
    seq = qual = ""
    for _, seen in sorted(at.items()):
        w = {c: round(sum(p if b == c else (1 - p) / 3 if b and b in "ACGT" else 0.25 for b, p in seen), 9) for c in "ACGT"}
        best = max("ACGT", key=lambda c: (w[c], c))
        sure = max(((p, b) for b, p in seen if b and b in "ACGT"), default=None)
        say = sure[0] if sure and sure[1] == best else w[best] / len(seen)
        seq, qual = seq + best, qual + chr(33 + (40 if say >= 0.9999 else min(40, math.floor(-10 * math.log10(1 - say) + 1e-6))))
    return seq, qual


@pytest.mark.parametrize("batch", [10_000, 7])
def test_consensus_is_that_of_plain_loops(spark, batch):
    rnd = random.Random(5)
    odd = [("x", "", []), ("x", "ACGT", [1]), ("x", "AN", [3, 4, 5, None]), ("y", None, [1]), ("z", "AC", None), ("z", "GÄT", [-1, 200, None]), (None, "A", [3]), ("e", "", []), ("n", "NN", [30, 40])]
    rows = odd + [(f"g{rnd.randrange(9) if rnd.random() < 0.1 else 0}", "".join(rnd.choice("ACGTN") for _ in range(rnd.randrange(5, 30))), [rnd.randrange(0, 41) for _ in range(20)]) for _ in range(900)]
    rnd.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.grp: (r.cons_seq, r.cons_qual, r.members) for r in dedup.consensus(spark.createDataFrame(rows, "grp string, seq string, q array<int>").repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = {g for g, s, q in rows if g is not None and s is not None and q is not None}
    assert got == {g: (*plain([r[1:] for r in rows if r[0] == g]), sum(r[0] == g for r in rows)) for g in groups}


def test_rows_are_sent_by_read_or_by_batch(spark):
    """One row for each read at most, and one for each batch of a large group; not one for each position."""
    from pyspark.sql import functions as F

    reads = spark.range(4000, numPartitions=4).select(F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 999).cast("string"))).alias("grp"), F.lit("ACGT" * 25).alias("seq"), F.array_repeat(F.lit(30), 100).alias("q"))
    made = piles.sums(reads)
    assert {(r.grp, r.members) for r in made.where("members > 10").collect()} == {("big", 2000)}
    tree = dedup.consensus(reads)._jdf.queryExecution().executedPlan()
    assert "posexplode" not in tree.toString().lower()
