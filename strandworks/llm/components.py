"""Connected components of a link table, by alternating large and small stars.

Each round is two group-and-join steps over the links; every round's links are a
written table in the shared folder, so a lost executor never reruns the loop.
Nothing about single nodes or links reaches the driver: it sees one count and
one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import files_for, forget, fresh

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the ``(u, v)`` links; the root is the least node."""
    spark = links.sparkSession

    def settle(df: DataFrame, files: int | None = None) -> tuple[DataFrame, str, tuple]:
        path = fresh(spark, "links")
        (df if files is None else df.coalesce(files)).write.parquet(path)
        kept = spark.read.schema("u long, v long").parquet(path)
        sums = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return kept, path, tuple(sums)

    now, path, sums = settle(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        if sums[0] == 0:
            break
        then, then_path, then_sums = settle(_small_star(_large_star(now)), files_for(sums[0]))
        forget(spark, path)
        now, path, same, sums = then, then_path, then_sums == sums, then_sums
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
