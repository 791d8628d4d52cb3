"""Sinks: sequence text, keyed and named files, k-mer tables, spectra, alignments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.operators import kmers, reads
from strandworks.sources import sam, sink

FASTQ, FASTA, FASTQ_UNMASKED, FASTA_UNMASKED = range(4)


def records(df: DataFrame, kind: int = FASTQ, key: str | None = None) -> DataFrame:
    """``read_id, record`` in an output format, and ``key`` as ``out_key``; the unmasked kinds write ``raw_seq`` (bases under the mask)."""
    src = df.withColumn("seq", F.col("raw_seq")) if kind in (FASTQ_UNMASKED, FASTA_UNMASKED) and "raw_seq" in df.columns else df
    record = reads.fastq_record(src.columns) if kind in (FASTQ, FASTQ_UNMASKED) else reads.fasta_record()
    return src.select("read_id", record.alias("record"), *([F.col(key).cast("string").alias("out_key")] if key else []))


def write_reads(df: DataFrame, path: str, kind: int = FASTQ, key: str | None = None, compression: str = "none") -> None:
    """Write reads in read_id order over range partitions; with ``key`` one folder a key, with a part for each partition."""
    made = records(df, kind, key)
    ordered = made.repartitionByRange("read_id").sortWithinPartitions(*(["out_key"] if key else []), "read_id")
    writer = ordered.drop("read_id").write.option("compression", compression)
    (writer.partitionBy("out_key") if key else writer).text(path)


def write_read_files(df: DataFrame, folder: str, kind: int = FASTQ, key: str | None = None, template: str = "{Key}{Uniq}", single: bool = False, second_dim: int = 0) -> list[str]:
    """Write reads in read_id order to named files, one (or parts of one) for each value of ``key``, in one pass; returns the paths.

    See :func:`strandworks.sources.sink.write_files`. Reads are dealt out by range of
    read_id, so a file of most of the reads is many tasks' work.
    """
    made = records(df, kind, key).repartitionByRange("read_id").sortWithinPartitions("read_id")
    return sink.write_files(made.select((F.col("out_key") if key else F.lit("")).alias("file"), "record"), folder, template, single, second_dim)


def write_table_text(df: DataFrame, path: str, *columns: str, order: str | None = None) -> None:
    """Tab-separated text, sorted globally by ``order``."""
    src = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    src.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value")).write.text(path)


def write_mercount(spec: DataFrame, path: str) -> None:
    """``kmer<TAB>count``, both strands, sorted."""
    write_table_text(kmers.both_strands(spec.select("kmer", "n")), path, "kmer", "n", order="kmer")


def write_mergraph(spec: DataFrame, path: str) -> None:
    """``kmer`` and twelve extension counts and a closing 0, both strands, sorted."""
    counters = [f"{s}_{b}" for s in ("left", "right") for b in kmers.EXTENSION_LETTERS]
    both = kmers.both_strands(spec.select("kmer", *counters)).withColumn("zero", F.lit(0))
    write_table_text(both, path, "kmer", *counters, "zero", order="kmer")


def save_spectrum(spec: DataFrame, table: str, buckets: int = 64) -> None:
    """A spectrum bucketed and sorted by k-mer, so that later joins on it do not shuffle it."""
    spec.write.bucketBy(buckets, "kmer").sortBy("kmer").mode("overwrite").saveAsTable(table)


def load_spectrum(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def write_bam(df: DataFrame, path: str, header: str, refs: list[tuple[str, int]]) -> list[str]:
    """A coordinate-sorted BAM as ordered parts whose concatenation is one file; returns the parts in order.

    The first part carries the header, the last the end marker (both are empty of
    records). Only parts of committed tasks are returned.
    """
    from strandworks.operators import align

    names = [*sam._FIELDS, *(["tags"] if "tags" in df.columns else [])]
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fsys, where = fs.FileSystem.from_uri(path)
        name = f"{where}/part-{uuid.uuid4().hex}.bam"
        number, some = None, False
        with fsys.open_output_stream(name, compression=None) as out:
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
                number = batch.column("_part")[0].as_py() if batch.num_rows else number
                some |= bool(rows)
                out.write(sam.bam_bytes("", refs, rows, first=False, eof=False))
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name])], ["part", "name"])

    ordered = align.coordinate_sort(df, [r[0] for r in refs]).select(*names).withColumn("_part", F.spark_partition_id())
    parts = sorted(ordered.mapInArrow(write, "part int, name string").collect())
    ends = [f"{folder}/head.bam", f"{folder}/tail.bam"]
    for name, raw in zip(ends, (sam.bam_bytes(header, refs, [], eof=False), sam.BGZF_EOF)):
        with store.open_output_stream(name, compression=None) as out:
            out.write(raw)
    return [ends[0], *(p["name"] for p in parts), ends[1]]


def write_bam_file(df: DataFrame, path: str, header: str, refs: list[tuple[str, int]]) -> None:
    """A coordinate-sorted BAM as one file: the parts of :func:`write_bam`, joined in their order by tasks."""
    spark = df.sparkSession
    target = sink.qualified(spark, path)
    folder = f"{target}._{uuid.uuid4().hex}"
    store, name = fs.FileSystem.from_uri(folder)
    try:
        parts = write_bam(df, folder, header, refs)
        sizes = store.get_file_info(parts)
        prefix = folder[: len(folder) - len(name)]
        sink.join_parts(spark, [(prefix + i.path, i.size) for i in sizes], target)
    finally:
        if store.get_file_info(name).type != fs.FileType.NotFound:
            store.delete_dir(name)


def write_unmapped(df: DataFrame, path: str) -> None:
    """Unmapped records as gzip FASTQ, mates marked /1 and /2; an empty sequence is ``N`` with quality ``A``."""
    mark = F.when(F.col("flag").bitwiseAND(0x40) != 0, "/1").when(F.col("flag").bitwiseAND(0x80) != 0, "/2").otherwise("")
    none = F.col("seq").isNull() | F.col("seq").isin("", "*")
    made = df.select(F.concat(F.lit("@"), "qname", mark, F.lit("\n"), F.when(none, "N").otherwise(F.col("seq")), F.lit("\n+\n"), F.when(none, "A").otherwise(F.col("qual"))).alias("value"))
    made.write.option("compression", "gzip").text(path)
