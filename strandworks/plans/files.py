"""Queries that write what is derived from the driver's tables as files and scan it back: sources and sinks against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandworks import lineage
from strandworks.operators import reads as rd
from strandworks.plans import derived
from strandworks.plans.catalogue import _with, query
from strandworks.plans.derived import SQL_READS, SQL_RECORDS, load, sql_q
from strandworks.sources import fastx, pipes, sam, sink, writers

_QUAL = f"array_to_string(list_transform(generate_series(1, length(seq)), lambda j: chr((33 + {sql_q('j')})::INT)), '')"
_COLUMNS = ["read_id", "name", "seq", "qual"]


def _folder(spark, tag: str) -> str:
    return lineage.fresh(spark, tag)


@query(_with(SQL_READS) + f"SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, name, seq, {_QUAL} AS qual FROM reads")
def fastq_scan(spark, sf_dir):
    """Reads as a folder of FASTQ parts, scanned by byte ranges and numbered through."""
    folder = _folder(spark, "fastq")
    writers.write_read_files(derived.reads(spark, sf_dir), folder, template="part-{Uniq}.fastq")
    return fastx.read_fastq(spark, folder).select(*_COLUMNS)


@query(_with(SQL_READS) + f"SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, name, seq, {_QUAL} AS qual FROM reads")
def fasta_qual_scan(spark, sf_dir):
    """Reads as one FASTA file and its file of integer qualities, found beside it and joined by record."""
    folder = _folder(spark, "fasta")
    reads = derived.reads(spark, sf_dir)
    writers.write_read_files(reads, folder, writers.FASTA, template="reads.fasta", single=True)
    numbers = rd.to_qual(reads).repartitionByRange("read_id").sortWithinPartitions("read_id")
    sink.write_files(numbers.select(F.lit("").alias("file"), "record"), folder, "reads.fasta.qual", single=True)
    return fastx.read_fasta(spark, f"{folder}/reads.fasta", ignore_quality=False).select(*_COLUMNS)


_MATES_SQL = ", keyed AS (SELECT *, regexp_replace(name, '/[^/]$', '/') AS pair_key, CASE WHEN name LIKE '%/1' THEN 1 ELSE 2 END AS num FROM reads), n AS (SELECT pair_key, count(*) AS c FROM keyed GROUP BY 1), sp AS (SELECT keyed.*, CASE WHEN c = 2 THEN num ELSE 0 END AS file FROM keyed JOIN n USING (pair_key))\n"


@query(_with(SQL_READS) + _MATES_SQL + f"SELECT file, row_number() OVER (ORDER BY file, read_id) - 1 AS read_id, name, seq, {_QUAL} AS qual FROM sp")
def mate_files(spark, sf_dir):
    """Reads split to three single files in one pass, first mates, second mates and reads without one; scanned back in the files' order."""
    folder = _folder(spark, "mates")
    split = rd.split_mates(derived.reads(spark, sf_dir))
    made = writers.write_read_files(split, folder, key="file", template="mates-{Key}.fastq", single=True)
    number = F.element_at(F.array(*(F.lit(int(p.rsplit("-", 1)[1][0])) for p in made)), F.col("file_id") + 1)
    return fastx.read_any(spark, *(f"file:{p}" if p.startswith("/") else p for p in made), paired_first=False).select(number.alias("file"), *_COLUMNS)


@query(_with(SQL_READS) + ", x AS (SELECT read_id // 2 % 5 AS key, read_id, name, seq FROM reads) SELECT key::INT AS key, row_number() OVER (PARTITION BY key ORDER BY read_id) - 1 AS at, name, seq FROM x")
def keyed_parts(spark, sf_dir):
    """Reads in parts of five named files; each file's parts, in the order of their names, are scanned as one."""
    folder = _folder(spark, "keyed")
    keyed = derived.reads(spark, sf_dir).withColumn("key", F.expr("cast(read_id div 2 % 5 as int)"))
    writers.write_read_files(keyed, folder, writers.FASTA, key="key", template="k{Key}.{Uniq}.fasta")
    found = fastx.read_any(spark, *(f"{folder}/k{i}.*" for i in range(5)), paired_first=False)
    least = found.groupBy("file_id").agg(F.min("read_id").alias("_least"))  # a row a file
    return found.join(F.broadcast(least), "file_id").select(F.col("file_id").alias("key"), (F.col("read_id") - F.col("_least")).alias("at"), "name", "seq")


_HEADER = "@HD\tVN:1.0\n" + "".join(f"@SQ\tSN:chr{i}\tLN:{1 << 28}\n" for i in range(5))
_REFS = [(f"chr{i}", 1 << 28) for i in range(5)]


@query(_with(SQL_RECORDS) + "SELECT qname, flag, rname, pos, mapq, cigar, repeat('ACGTN', 10) AS seq, chr((33 + mapq % 40)::INT) || repeat('I', 49) AS qual, nm, as_score FROM recs")
def bam_scan(spark, sf_dir):
    """Alignments as one coordinate-sorted BAM file with header and tags, scanned by ranges."""
    path = f"{_folder(spark, 'bam')}/all.bam"
    rec = derived.records(spark, sf_dir)
    tags = F.create_map(F.lit("NM"), F.concat(F.lit("i:"), F.col("nm").cast("string")), F.lit("AS"), F.concat(F.lit("i:"), F.col("as_score").cast("string")))
    full = rec.select("qname", "flag", "rname", "pos", "mapq", "cigar", F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.repeat(F.lit("ACGTN"), F.lit(10)).alias("seq"), F.concat(F.char(33 + F.col("mapq") % 40), F.repeat(F.lit("I"), F.lit(49))).alias("qual"), tags.alias("tags"))
    writers.write_bam_file(full, path, sam.sorted_header(_HEADER), _REFS)
    tag = lambda t: F.substring(F.col("tags")[t], F.lit(3), F.length(F.col("tags")[t])).cast("int")
    return sam.read_alignments(spark, path).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", tag("NM").alias("nm"), tag("AS").alias("as_score"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) - 1 AS num FROM l)
SELECT doc_id, num, 'upper' AS output, md5(translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS line FROM x UNION ALL SELECT doc_id, num, 'plain', md5(line) FROM x""")
def pipe_lines(spark, sf_dir):
    """Every line of every document through a command with two outputs, capitals and a copy."""
    each = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("num", "line"))
    rows = each.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("num").cast("string"), "line").alias("record"))
    got = pipes.pipe_to(rows, ["/bin/sh", "-c", "tee {copy} | tr a-z A-Z"], outputs=("copy",))
    cell = F.split("line", "\t", 3)
    return got.select(F.get(cell, F.lit(0)).cast("long").alias("doc_id"), F.get(cell, F.lit(1)).cast("long").alias("num"), F.when(F.col("output") == "copy", "plain").otherwise("upper").alias("output"), F.md5(F.get(cell, F.lit(2))).alias("line"))


@query(_with(SQL_READS) + "SELECT read_id % 4 AS part, read_id, seq FROM reads")
def command_files(spark, sf_dir):
    """Reads fed to a process for each of four partitions, which sorts them to a file of its own; the files are read by a command source."""
    folder = _folder(spark, "commands")
    local = sink.qualified(spark, folder).removeprefix("file:").replace("//", "/")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    reads = derived.reads(spark, sf_dir).select(F.to_json(F.struct((F.col("read_id") % 4).alias("part"), "read_id", "seq")).alias("record"))
    pipes.write_command(reads, ["/bin/sh", "-c", f"sort > {local}/{{Uniq}}.tmp && mv {local}/{{Uniq}}.tmp {local}/{{Uniq}}"], partitions=4)
    back = pipes.read_command(spark, ["cat", f"{local}/{{Uniq}}"], 4)
    return back.select(F.from_json("line", "part long, read_id long, seq string").alias("x")).select("x.*")

