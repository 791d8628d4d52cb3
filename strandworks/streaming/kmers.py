"""k-mer counting over a stream of reads, and event-time counts.

The running table lies in files, not in the memory of the driver or of a state store:
a keyed state of Python functions costs a call to the store for each k-mer of a batch,
where a merge of two tables of counts is one aggregation, and the purge of k-mers seen
once is a filter over the table, not a timer for each of its keys. So each micro-batch writes its own counts as Parquet under its number (a batch that is
run again writes the same folder anew), and a compaction merges what lies there into
one table. Event-time windows are an addition: the batch programs have no event time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandworks.functions import dna
from strandworks.operators import runs

SIZES = "batch long, raw long, distinct_kmers long, singletons long, purged long"


@dataclass
class Counts:
    """Running k-mer counts below ``path``.

    ``gen=<b>`` folders hold merged counts up to batch b, ``batch=<b>`` those of one
    batch; ``sizes`` has a row for each snapshot. What a reader takes is named by the
    last ``log/<b>`` entry, written after all it names.
    """

    spark: SparkSession
    path: str
    k: int
    growth: float = 1.05
    purge_every: int = 0  # batches; 0: never

    def _entries(self) -> list[dict]:
        """The last log entry as a list, or none."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().startswith("b")]
        if not names:
            return []
        return [json.loads(self.spark.read.text(max(names)).first()[0])]

    def state(self) -> dict:
        return (self._entries() or [{"batch": -1, "gen": None, "batches": [], "raw": 0, "tracked": 0, "purged": 0, "since": 0}])[0]

    def _note(self, state: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        row.write.mode("overwrite").text(f"{self.path}/log/b{state['batch']:012d}")

    def _table(self, state: dict) -> DataFrame:
        folders = ([f"{self.path}/gen={state['gen']}"] if state["gen"] is not None else []) + [f"{self.path}/batch={b}" for b in state["batches"]]
        if not folders:
            return self.spark.createDataFrame([], "kmer string, n long")
        parts = self.spark.read.schema("code long, n long").parquet(*folders)
        return parts.groupBy("code").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """``kmer, n`` of all batches so far."""
        found = self._table(self.state())
        return found.select(dna.kmer_of("code").alias("kmer"), "n") if "code" in found.columns else found

    def sizes(self) -> DataFrame:
        """Snapshots of the table's sizes, by batch."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes")
        known = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(SIZES).parquet(f"{self.path}/sizes/*") if known else self.spark.createDataFrame([], SIZES)

    def add(self, reads: DataFrame, batch: int) -> None:
        """Take in a micro-batch; one that was taken in before is left alone."""
        state = self.state()
        if batch <= state["batch"]:
            return
        runs.counts(reads, self.k).select("code", "n").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        seen = self.spark.read.schema("code long, n long").parquet(f"{self.path}/batch={batch}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        state = state | {"batch": batch, "batches": [*state["batches"], batch], "raw": state["raw"] + seen, "since": state["since"] + 1}
        if self.purge_every and state["since"] >= self.purge_every:
            state = self._purged(state)
        if state["raw"] >= state["tracked"] * self.growth and seen:
            self._snapshot(state)
            state["tracked"] = state["raw"]
        self._note(state)

    def _purged(self, state: dict) -> dict:
        """Merge all counts without the k-mers seen once so far: the table stays bounded, and such k-mers start anew."""
        whole = self._table(state)
        gone = whole.where("n = 1").count()
        whole.where("n > 1").write.mode("overwrite").parquet(f"{self.path}/gen={state['batch']}")
        return state | {"gen": state["batch"], "batches": [], "purged": state["purged"] + gone, "since": 0}

    def _snapshot(self, state: dict) -> None:
        sizes = self._table(state).agg(F.count("*").alias("d"), F.count_if(F.col("n") == 1).alias("s")).first()
        row = self.spark.createDataFrame([(state["batch"], state["raw"], sizes.d, sizes.s, state["purged"])], SIZES)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes/b{state['batch']:012d}")


def run_available(reads: DataFrame, counts: Counts, checkpoint: str) -> StreamingQuery:
    """Count what is available now, in micro-batches; returns the finished query."""
    query = reads.writeStream.foreachBatch(lambda df, batch: counts.add(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sampling_rounds(reads: DataFrame, counts: Counts, parts: int, fraction: float) -> float:
    """Take in one hash part of the reads after the other until ``fraction`` of them is counted; returns what was reached.

    Rounds taken in by an earlier run are not repeated.
    """
    done = counts.state()["batch"] + 1
    part = F.conv(F.substring(F.md5(F.col("read_id").cast("string")), 1, 8), 16, 10).cast("bigint") % parts
    while done < parts and done / parts < fraction:
        counts.add(reads.where(part == done), done)
        done += 1
    return done / parts


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by type and tumbling window, with a watermark on ``ts``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
