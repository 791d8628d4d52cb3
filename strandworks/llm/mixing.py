"""Operator 9, mixing sources to target weights by temperature.

With p the token share of each source, weights are p ** a / sum(p ** a). The
exponent a is the larger of two: the one at which the weights' entropy reaches a
target between that of the shares (a = 1) and that of equal weights (a = 0), and
the least at which no source is repeated more than ``max_repeats`` times. Both
are found by repeated 16-section of [0, 1]; each step is one aggregate over the
table of sources, which never leaves the cluster.

A source with weight w gets w * budget tokens: whole passes over its documents,
then part of a pass. In each pass, blocks of documents come in an order hashed
from the pass, and documents in an order hashed within the block. Part of a pass
is the longest prefix of that order within the token budget: prefix sums over
block totals (at most MAX_BLOCKS a source), then over the documents of one block.
So a source with a third of all rows is never in one task.

Edge cases: a null source is a source of its own; null texts have no tokens;
documents of a source without tokens come once; rows equal in doc_id, source and
text share their fate; an empty table gives an empty result. Columns other than
doc_id, text and source go along unread in ``mix`` (names with a leading ``_mx_``
excepted).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import word_count
from .scratch import keep

ENTROPY_GAP = 0.5  # target entropy: this part of the way from the shares' to the highest
MAX_REPEATS = 4.0
BLOCK_DOCS = 1000
MAX_BLOCKS = 10_000
SECTIONS, STEPS = 16, 6
SEED = 42


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a: ln of Z = sum(p ** a), and the entropy of p ** a / Z."""
    power = [F.exp(F.lit(a) * F.col("lnp")) for a in exponents]
    row = shares.agg(*(F.sum(x) for x in power), *(F.sum(x * F.col("lnp")) for x in power)).first()
    n = len(exponents)
    return [(math.log(row[i]), math.log(row[i]) - a * row[n + i] / row[i]) for i, a in enumerate(exponents)]


def exponent(shares: DataFrame, least_ln: float, scale: float, gap: float, max_repeats: float) -> tuple[float, float]:
    """The exponent and ln Z for ``shares`` (column ``lnp``); ``scale``: budget over all tokens."""
    (_, high), (_, low) = _sums(shares, [0.0, 1.0])
    target = low + gap * (high - low)

    def search(fits) -> float:
        """The largest exponent of a fine grid up to which ``fits`` holds; it holds at 0 or nowhere."""
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            grid = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
            ok = [fits(a, *s) for a, s in zip(grid, _sums(shares, grid))]
            k = max((i for i, x in enumerate(ok) if x), default=0)
            lo, hi = grid[k], grid[min(k + 1, SECTIONS)]
        return hi

    by_entropy = search(lambda a, ln_z, h: h >= target)
    too_often = math.log(max_repeats) - math.log(scale) if scale > 0 else math.inf
    by_repeats = search(lambda a, ln_z, h: (a - 1) * least_ln - ln_z > too_often)
    first = _sums(shares, [0.0])[0][0]
    if -least_ln - first <= too_often:
        by_repeats = 0.0
    a = round(max(by_entropy, by_repeats), 6)
    return a, _sums(shares, [a])[0][0]


def copies(docs: DataFrame, budget: int | None = None, gap: float = ENTROPY_GAP, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """How often each document comes: ``(doc_id, source, n_tokens, _mx_k, _mx_l, block, passes)``.

    One row for each row of ``docs``; ``budget`` is in tokens, by default all there are.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("n_tokens"),
        F.xxhash64("doc_id", "source", "text").alias("_mx_k"), F.xxhash64(F.lit(1), "doc_id", "source", "text").alias("_mx_l"),
        F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("name"),
    )
    rows = keep(named, "mix-rows")
    sources = keep(rows.groupBy("name").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources", 8)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    shares = sources.where("tokens > 0").withColumn("lnp", F.log(F.col("tokens") / F.lit(float(total or 1))))
    if total:
        least = shares.agg(F.min("lnp")).first()[0]
        a, ln_z = exponent(shares, least, budget / total, gap, max_repeats)
        repeats = F.least(F.lit(float(max_repeats)), F.exp(F.lit(a - 1) * F.log(F.col("tokens") / F.lit(float(total))) - F.lit(ln_z)) * F.lit(budget / total))
    else:
        repeats = F.lit(1.0)
    repeats = F.round(F.when(F.col("tokens") > 0, repeats).otherwise(1.0), 9)
    plan = sources.select(
        "name", F.floor(repeats).cast("int").alias("whole"), F.floor((repeats - F.floor(repeats)) * F.col("tokens")).cast("long").alias("rest"),
        F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / F.lit(BLOCK_DOCS))).cast("long").alias("blocks"),
    )
    blocked = rows.join(plan, "name").withColumn("block", F.pmod("_mx_k", "blocks"))
    order = F.xxhash64(F.lit(SEED), "whole", "name", "block")
    totals = blocked.groupBy("name", "block").agg(F.sum("n_tokens").alias("t"), F.first("whole").alias("whole"))
    before = totals.withColumn("o", order).withColumn("before", F.sum("t").over(Window.partitionBy("name").orderBy("o", "block")) - F.col("t"))
    in_block = Window.partitionBy("name", "block").orderBy(F.xxhash64(F.lit(SEED), "whole", "_mx_k", "_mx_l")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = blocked.join(before.select("name", "block", "before"), ["name", "block"]).withColumn("end", F.col("before") + F.sum("n_tokens").over(in_block))
    passes = F.col("whole") + F.when((F.col("rest") > 0) & (F.col("end") <= F.col("rest")), 1).otherwise(0)
    return at.select("doc_id", "source", "n_tokens", "_mx_k", "_mx_l", "block", passes.cast("int").alias("passes"))


def schedule(found: DataFrame) -> DataFrame:
    """``(doc_id, source, n_tokens, pass, block, block_order, doc_order)``: one row for each copy of a document.

    Sorting by pass, block_order and doc_order gives the block permutation.
    """
    each = found.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    name = F.coalesce("source", F.lit("\0"))
    return each.select(
        "doc_id", "source", "n_tokens", "pass", "block", F.xxhash64(F.lit(SEED), "pass", name, "block").alias("block_order"),
        F.xxhash64(F.lit(SEED), "pass", "_mx_k", "_mx_l").alias("doc_order"),
    )


def mix(docs: DataFrame, budget: int | None = None, gap: float = ENTROPY_GAP, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``docs`` with each row as often as the mixture wants it, columns unchanged."""
    keys = [F.xxhash64("doc_id", "source", "text").alias("_mx_k"), F.xxhash64(F.lit(1), "doc_id", "source", "text").alias("_mx_l")]
    often = copies(docs, budget, gap, max_repeats).groupBy("_mx_k", "_mx_l").agg(F.max("passes").alias("_mx_n")).where("_mx_n > 0")
    joined = docs.select("*", *keys).join(often, ["_mx_k", "_mx_l"])
    return joined.withColumn("_mx_n", F.explode(F.sequence(F.lit(1), F.col("_mx_n")))).select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """The schedule of all documents under temperature mixing."""
    return schedule(copies(spark.read.parquet(f"{sf_dir}/documents.parquet")))
