"""k-mer frequency vectors, distances, likelihoods and clustering."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandworks.functions import dna, stats
from strandworks.operators import windows


def dimension(spark: SparkSession, k: int) -> DataFrame:
    """``idx, kmer``: the canonical k-mers in order (136 for k = 4), from a range and a base conversion."""
    every = spark.range(4**k).select(dna.unpack("id", k).alias("kmer")).where(dna.canonical("kmer") == F.col("kmer"))
    return every.select(F.col("kmer"), (F.row_number().over(Window.orderBy("kmer")) - 1).alias("idx"))


def canonical_kmers(k: int) -> list[str]:
    """The same list on the driver; its size depends on k alone."""
    swap = str.maketrans("ACGT", "TGCA")
    return [m for m in map("".join, product("ACGT", repeat=k)) if m <= m[::-1].translate(swap)]


def vectors(rows: DataFrame, group: str, k: int = 4) -> DataFrame:
    """``group, total, v``: counts of canonical k-mers of each group's sequences in dimension order.

    Windows are counted batch by batch, so what is shuffled are a batch's groups times
    4**k counts at most; then one aggregate by (group, k-mer), and one by group.
    """
    counts = windows.counts(rows, group, k).groupBy(group, "code").agg(F.sum("n").alias("n")).select(group, dna.kmer_of("code").alias("kmer"), "n")
    maps = counts.groupBy(group).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("kmer", "n"))).alias("m"))
    names = canonical_kmers(k)
    return maps.select(group, "total", F.transform(F.array(*map(F.lit, names)), lambda x: F.coalesce(F.element_at("m", x), F.lit(0)).cast("double")).alias("v"))


def purge_short(vecs: DataFrame, window: int) -> DataFrame:
    return vecs.where(F.col("total") >= 0.75 * window)


def distances(vecs: DataFrame, group: str, formula: str = "EUCLIDEAN") -> DataFrame:
    """``a, b, distance`` for a > b. Meant for the few groups that are compared all to all (the result is quadratic)."""
    spearman = formula.upper() == "SPEARMAN"
    unit = vecs.select(F.col(group).alias("g"), (stats.average_ranks("v") if spearman else stats.unit("v")).alias("u"))
    a, b = unit.select(F.col("g").alias("a"), F.col("u").alias("ua")), unit.select(F.col("g").alias("b"), F.col("u").alias("ub"))
    d = stats.spearman_distance("ua", "ub") if spearman else stats.euclidean("ua", "ub")
    return a.join(b, F.col("a") > F.col("b")).select("a", "b", d.alias("distance"))


def to_reference(vecs: DataFrame, group: str, reference: list[float]) -> DataFrame:
    """``group, distance`` of each unit vector to one reference vector, which is a literal."""
    norm = float(np.sqrt(np.square(reference).sum())) or 1.0
    lit = F.array(*(F.lit(float(x) / norm) for x in reference))
    return vecs.select(group, stats.euclidean(stats.unit("v"), lit).alias("distance"))


def likelihoods(pairs: DataFrame, bins: int = 100, top: float = 2**0.5) -> DataFrame:
    """``same, bin, pairs, share``: histogram of distances within and between labels. ``pairs`` has ``same, distance``."""
    by = pairs.groupBy("same", F.least(F.floor(F.col("distance") * bins / top), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("pairs"))
    return by.withColumn("share", F.col("pairs") / F.sum("pairs").over(Window.partitionBy("same")))


def by_distance(pairs: DataFrame) -> DataFrame:
    """Pairs in order of distance, then of names."""
    return pairs.orderBy("distance", "a", "b")


def sum_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, i, s, n``: sums of vectors by group, an element a row, so that groups of any size are added up in parts."""
    each = rows.select(group, F.posexplode(vector).alias("i", "x"))
    return each.groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))


def cluster(names: list[str], counts: np.ndarray, threshold: float = 0.175) -> list[list[str]]:
    """Agglomerative clusters of count vectors: the closest pair merges (counts add up) while within ``threshold``.

    Sequential by nature: the driver does it, for vectors of groups, not of reads.
    """
    groups, v = [[n] for n in names], np.asarray(counts, float).copy()
    while len(groups) > 1:
        u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        d = np.sqrt(np.maximum(0, ((u[:, None] - u[None]) ** 2).sum(2)))
        d[np.triu_indices(len(d))] = np.inf
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > threshold:
            break
        groups[j] += groups.pop(i)
        v[j] += v[i]
        v = np.delete(v, i, axis=0)
    return [sorted(g) for g in groups]
