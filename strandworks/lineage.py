"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_MADE: dict[str, list[str]] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a single machine without it a folder below the warehouse, on a cluster an error."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"a cluster needs {KEY}, a folder that all its machines share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in :func:`shared_dir`."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in :func:`shared_dir`; :func:`forget_all` knows it."""
    path = f"{shared_dir(spark)}/sequences/{tag}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def keep(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table that is written once and read from then on."""
    path = fresh(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove a table of :func:`keep` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def forget_all(spark: SparkSession) -> int:
    """Remove every path of this application; results that are not stored yet can no longer be read. Returns how many."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(made)
