"""Tables and files in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``; where that is unset on a
single machine (``local`` masters, as in tests), a folder below the warehouse is
taken, and a cluster without the setting is refused. Nothing is written to a
machine-local temporary folder. What a session has written is known by
:func:`forget_all`, which removes it once its results are stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_MADE: dict[str, list[str]] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a slash at its end."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"a cluster needs {KEY}, a folder that all its machines share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        found = f"{warehouse.rstrip('/')}/_shared"
    return found.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/strandworks/{tag}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


ROWS_A_FILE = 500_000


def files_for(rows: int) -> int:
    """Files (and last tasks) for a table of so many narrow rows."""
    return max(1, -(-rows // ROWS_A_FILE))


def keep(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, in at most ``files`` files if given.

    Cuts the lineage: a lost executor costs a re-read of files, never a rerun of
    what lies before.
    """
    spark = df.sparkSession
    path = fresh(spark, tag)
    (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that no plan reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget_all(spark: SparkSession) -> int:
    """Remove every scratch path of this application; results that are not stored yet can no longer be read. Returns how many."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        forget(spark, path)
    return len(made)
