"""Tables derived from the driver's tables, the same in both engines.

Reads come from the letters of each whole text: letters become bases, and every
60 bases a read of up to 100 starts, the last ones as long as the text goes on.
Consecutive reads are mates; a text has room for 2**23 reads (500 million letters) in the
ids, which leaves room for ids of documents up to 2**40. Alignment
records come from ``orders``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
AS_BASES = ("ACGT" * 7)[:26] * 2
READ, STEP, ROOM = 100, 60, 1 << 23
SLICE = 1 << 20  # bases of reads that are handled at once


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dna(text: str):
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), LETTERS, AS_BASES)


@lru_cache(1)
def _quality_table() -> np.ndarray:
    """Quality bytes of READ bases for each remainder of a read id by 257 and by 33; remainders have the id's sign."""
    j, a, b = np.arange(1, READ + 1), np.arange(-256, 257)[:, None, None], np.arange(-32, 33)[:, None]
    return np.where(np.fmod(j * j * j + a * 31, 257) < 3, 35, 41 + np.fmod(j * 7 + b * 3, 33)).astype(np.uint8)


@F.arrow_udf(StringType())
def _qualities(length: pa.Array, read_id: pa.Array) -> pa.Array:
    """Qualities of reads, made from a table: an expression for each base took longer than all else."""
    valid = pc.and_(length.is_valid(), read_id.is_valid())
    n, ids = pc.fill_null(length, 0).to_numpy().astype(np.int64), pc.fill_null(read_id, 0).to_numpy()
    rows = _quality_table()[np.fmod(ids, 257) + 256, np.fmod(ids, 33) + 32]
    data = rows[np.arange(READ) < n[:, None]]
    made = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n))), pa.py_buffer(data)])
    return pc.if_else(valid, made.cast(pa.string()), None)


@lru_cache(1)
def _base_table() -> np.ndarray:
    """The base of each byte; 0 for what is no letter, bytes of longer code points too."""
    table = np.zeros(256, np.uint8)
    table[np.frombuffer(LETTERS.encode(), np.uint8)] = np.frombuffer(AS_BASES.encode(), np.uint8)
    return table


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, i, seq`` of ``doc_id, text``: bases by a table of bytes, and reads as slices of them, some SLICE at once."""
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw, a = np.frombuffer(text.buffers()[2] or b"", np.uint8), 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, side="right")) - 1)
            yield from _slices(batch.column("doc_id").slice(a, b - a), raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            a = b


def _slices(ids: pa.Array, raw: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    bases = _base_table()[raw]
    letters, some = np.zeros(len(ids), np.int64), np.diff(ends) > 0
    if some.any():
        letters[some] = np.add.reduceat(bases > 0, ends[:-1][some], dtype=np.int64)
    bases, off, count = bases[bases > 0], np.append(0, np.cumsum(letters)), -(-letters // STEP)
    last = np.cumsum(count)
    for a in range(0, int(last[-1]), SLICE // READ):
        at = np.arange(a, min(a + SLICE // READ, int(last[-1])))
        row = np.searchsorted(last, at, side="right")
        i = at - (last - count)[row]
        start = off[row] + i * STEP
        size = np.minimum(READ, off[row + 1] - start)
        to = np.append(0, np.cumsum(size))
        data = bases[np.arange(to[-1]) + np.repeat(start - to[:-1], size)]
        seq = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(i.astype(np.int32)), seq], ["doc_id", "i", "seq"])


def cut_reads(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """``read_id, doc_id, i, file_id, name, comment, seq, qual`` of documents; a narrow transformation."""
    # Bases and reads are made from bytes: text functions for each letter and each read took some seven times as long.
    texts = docs.select(F.col(ident).alias("doc_id"), "text")
    cut = texts.mapInArrow(_cut, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, i int, seq string")
    named = cut.withColumn("read_id", F.col("doc_id") * ROOM + F.col("i")).withColumn("name", F.expr("concat('d', doc_id, '.', i div 2, '/', 1 + i % 2)"))
    return named.select("read_id", "doc_id", "i", F.lit(0).alias("file_id"), "name", F.lit(None).cast("string").alias("comment"), "seq", _qualities(F.length("seq"), F.col("read_id")).alias("qual"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the documents; a file of fewer parts than there are cores is dealt out first."""
    docs, cores = load(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return cut_reads(docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores))


def name_of(read_id: str) -> Column:
    """The name that :func:`cut_reads` gives a read, from its id: what is joined by read need not carry names."""
    i = f"({read_id} & {ROOM - 1})"
    return F.expr(f"concat('d', shiftright({read_id}, {ROOM.bit_length() - 1}), '.', {i} div 2, '/', 1 + {i} % 2)")


def reads_with_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`reads` with an N in every third, at a place that moves."""
    at = (1 + (F.col("doc_id") * 7 + F.col("i") * 13) % F.length("seq")).cast("int")
    return reads(spark, sf_dir).withColumn("seq", F.when(F.col("i") % 3 == 0, F.overlay("seq", F.lit("N"), at, F.lit(1))).otherwise(F.col("seq")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, seq1, seq2`` of reads with both mates."""
    r = reads(spark, sf_dir).select(F.expr("read_id div 2").alias("pair_id"), (F.col("i") % 2).alias("m"), "seq")
    p = r.groupBy("pair_id").agg(F.max(F.when(F.col("m") == 0, F.col("seq"))).alias("seq1"), F.max(F.when(F.col("m") == 1, F.col("seq"))).alias("seq2"))
    return p.where("seq1 IS NOT NULL AND seq2 IS NOT NULL")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment records: ``qname, flag, rname, pos, mapq, cigar, nm, as_score, seq_len, part``."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flag = 1 + F.when(k % 2 == 0, 64).otherwise(128) + F.when(c % 11 == 0, 4).otherwise(0) + F.when(c % 13 == 0, 8).otherwise(0) + F.when(c % 2 == 0, 16).otherwise(0)
    return load(spark, sf_dir, "orders").select(
        F.expr("concat('q', o_orderkey div 2)").alias("qname"), flag.cast("int").alias("flag"), F.when(c % 11 == 0, "*").otherwise(F.concat(F.lit("chr"), (c % 5).cast("string"))).alias("rname"),
        (c * 7 + 1).cast("int").alias("pos"), (k % 60).cast("int").alias("mapq"),
        F.when(k % 3 == 0, "50M").when(k % 3 == 1, "20M5D30M").otherwise("10S40M").alias("cigar"), (k % 7).cast("int").alias("nm"), (100 - k % 7).cast("int").alias("as_score"),
        F.lit(50).alias("seq_len"), (c % 3).cast("int").alias("part"),
    )


def multi_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of each order's read by three index parts."""
    k, part = F.col("o_orderkey"), F.col("part")
    c = F.col("o_custkey") + part
    rows = load(spark, sf_dir, "orders").withColumn("part", F.explode(F.array(*map(F.lit, range(3)))))
    lost = c % 13 == 0
    flag = 1 + F.when(k % 2 == 0, 64).otherwise(128) + F.when(c % 11 == 0, 4).otherwise(0) + F.when(lost, 8).otherwise(0) + F.when(((F.expr("o_orderkey div 2") + part) % 3 == 0) & ~lost, 2).otherwise(0)
    return rows.select(
        F.expr("concat('q', o_orderkey div 2)").alias("qname"), "part", flag.cast("int").alias("flag"), F.concat(F.lit("chr"), (c % 3).cast("string")).alias("rname"),
        ((k + part * 5) % 7).cast("int").alias("nm"), ((k * 3 + part * 17) % 60).cast("int").alias("mapq"), F.when((k + part) % 3 == 2, 40).otherwise(50).alias("aligned"),
        (90 + (k * 7 + part) % 11).cast("int").alias("as_score"), F.lit(50).alias("seq_len"),
    )


# ------------------------------------------------------------ SQL of the same tables

SQL_READS = f"""s AS (SELECT doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{AS_BASES}') AS dna FROM documents),
reads AS (SELECT doc_id * {ROOM} + i AS read_id, doc_id, i, 'd' || doc_id || '.' || (i // 2) || '/' || (1 + i % 2) AS name, substring(dna, 1 + i * 60, 100) AS seq
  FROM s, unnest(generate_series(0, greatest(0, (length(dna) - 1) // 60))) t(i) WHERE length(substring(dna, 1 + i * 60, 100)) > 0)"""

SQL_READS_N = SQL_READS.replace("reads AS (", "reads0 AS (") + """,
reads AS (SELECT read_id, doc_id, i, name, CASE WHEN i % 3 = 0 THEN substring(seq, 1, n_at - 1) || 'N' || substring(seq, n_at + 1) ELSE seq END AS seq
  FROM (SELECT *, 1 + (doc_id * 7 + i * 13) % length(seq) AS n_at FROM reads0))"""

SQL_PAIRS = """pairs AS (SELECT a.read_id // 2 AS pair_id, a.seq AS seq1, b.seq AS seq2 FROM reads a JOIN reads b ON b.read_id = a.read_id + 1 AND a.read_id % 2 = 0)"""

SQL_RECORDS = """recs AS (SELECT 'q' || (o_orderkey // 2) AS qname,
  1 + CASE WHEN o_orderkey % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN o_custkey % 11 = 0 THEN 4 ELSE 0 END + CASE WHEN o_custkey % 13 = 0 THEN 8 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 16 ELSE 0 END AS flag,
  CASE WHEN o_custkey % 11 = 0 THEN '*' ELSE 'chr' || (o_custkey % 5) END AS rname, o_custkey * 7 + 1 AS pos, o_orderkey % 60 AS mapq,
  CASE o_orderkey % 3 WHEN 0 THEN '50M' WHEN 1 THEN '20M5D30M' ELSE '10S40M' END AS cigar, CASE o_orderkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 55 ELSE 40 END AS span,
  CASE o_orderkey % 3 WHEN 2 THEN 40 ELSE 50 END AS aligned, o_orderkey % 7 AS nm, 100 - o_orderkey % 7 AS as_score, o_custkey % 3 AS part FROM orders)"""


def sql_q(j: str, read_id: str = "read_id") -> str:
    return f"(CASE WHEN (({j}) * ({j}) * ({j}) + ({read_id} % 257) * 31) % 257 < 3 THEN 2 ELSE 8 + (({j}) * 7 + ({read_id} % 33) * 3) % 33 END)"


def sql_p(j: str, read_id: str = "read_id") -> str:
    q = sql_q(j, read_id)
    return f"(CASE WHEN {q} < 3 THEN 0.0::DOUBLE ELSE 1 - pow(10.0, -{q} / 10.0) END)"


def sql_kmers(k: int, source: str = "reads", name: str = "ck", ident: str = "read_id") -> str:
    """Windows of a table with ``seq``: ``ident, p (0-based), f, kmer``."""
    return f"""{name}_w AS (SELECT {ident}, p, substring(seq, p + 1, {k}) AS f FROM {source}, unnest(generate_series(0, length(seq) - {k})) t(p)),
{name} AS (SELECT {ident}, p, f, least(f, translate(reverse(f), 'ACGT', 'TGCA')) AS kmer FROM {name}_w WHERE NOT contains(f, 'N'))"""


def sql_spectrum(name: str = "sp", source: str = "ck") -> str:
    return f"{name} AS (SELECT kmer, count(*) AS n, count(*) FILTER (WHERE f = kmer) AS n_fwd FROM {source} GROUP BY kmer)"
