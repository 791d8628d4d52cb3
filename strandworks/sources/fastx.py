"""FASTQ and FASTA readers.

Files are scanned by :mod:`strandworks.sources.scan`, a data source of record-aligned
byte ranges: reading shuffles nothing. One light pass counts the records of each
range, so that reads are numbered through, and finds the base of the qualities; the
driver gets a row for each range.

Files in a store that only Spark reads are read as lines instead and put together by
line number: a line's number is its place in its split plus the lines of the splits
before. That shuffles every line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandworks.functions import quality
from strandworks.sources import scan as ranges

COLUMNS = ["read_id", "file_id", "name", "comment", "seq", "qual"]


def split_header(head) -> tuple:
    """Name and comment of a header line without its marker; the comment is null if there is none."""
    name = F.regexp_extract(head, r"^[@>]?(\S*)", 1)
    rest = F.regexp_extract(head, r"^\S*\s+(.*)$", 1)
    return name, F.when(rest != "", rest)


# --------------------------------------------------------------- stores of Spark's own


def _numbered(spark: SparkSession, paths: list[str], mark: str | None = None) -> DataFrame:
    """``file_id, line_no, line`` of text files; with ``mark`` also ``record``, how many lines up to here, less one, start with it."""
    lines = None
    for i, path in enumerate(paths):
        one = spark.read.text(path).select(
            F.lit(i).alias("file_id"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
            F.monotonically_increasing_id().alias("_m"), F.regexp_replace("value", "\r$", "").alias("line"),
        )
        lines = one if lines is None else lines.unionByName(one)
    marked = F.col("line").startswith(mark) if mark else F.lit(False)
    splits = lines.groupBy("file_id", "_f", "_b").agg(F.min("_m").alias("least"), F.count("*").alias("n"), F.count_if(marked).alias("marks")).collect()
    starts, at, heads, last = [], 0, 0, None
    for r in sorted(splits, key=lambda r: (r.file_id, r["_f"], r["_b"])):
        at, heads = (0, 0) if r.file_id != last else (at, heads)
        starts.append((r.file_id, r["_f"], r["_b"], at - r.least, heads))
        at, heads, last = at + r.n, heads + r.marks, r.file_id
    table = spark.createDataFrame(starts or [(0, "", 0, 0, 0)], "file_id int, _f string, _b long, _shift long, _heads long")
    out = lines.join(F.broadcast(table), ["file_id", "_f", "_b"]).withColumn("line_no", F.col("_m") + F.col("_shift"))
    if not mark:
        return out.select("file_id", "line_no", "line")
    so_far = F.count_if(marked).over(Window.partitionBy("file_id", "_f", "_b").orderBy("_m"))  # of one split
    return out.withColumn("record", F.col("_heads") + so_far - 1).select("file_id", "record", "line_no", "line")


def _ids(df: DataFrame) -> DataFrame:
    """``read_id`` by file and record: offsets of files are sums of their record counts (a row a file)."""
    counts = df.groupBy("file_id").agg(F.count("*").alias("c")).collect()
    before, at = [], 0
    for r in sorted(counts, key=lambda r: r.file_id):
        before.append((r.file_id, at))
        at += r.c
    table = df.sparkSession.createDataFrame(before or [(0, 0)], "file_id int, _before long")
    return df.join(F.broadcast(table), "file_id").withColumn("read_id", F.col("_before") + F.col("record")).drop("_before", "record")


def fastq_of_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """The scan's columns of FASTQ files, from lines of text."""
    record = _numbered(spark, list(paths)).groupBy("file_id", F.expr("line_no div 4").alias("record")).agg(
        *(F.max(F.when(F.col("line_no") % 4 == i, F.col("line"))).alias(c) for i, c in enumerate(("head", "seq", "plus", "qual")))
    )
    bad = ~F.col("head").startswith("@") | ~F.col("plus").startswith("+") | (F.length("seq") != F.length("qual")) | F.col("qual").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("broken FASTQ record "), F.col("record").cast("string")))).otherwise(F.col("qual"))
    return _ids(record.select("file_id", "record", "head", "seq", checked.alias("qual")))


def fasta_of_lines(spark: SparkSession, *paths: str, joiner: str = "") -> DataFrame:
    """The scan's columns of FASTA files, from lines of text."""
    placed = _numbered(spark, list(paths), ">").where("record >= 0")
    head = F.col("line").startswith(">")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~head, F.struct("line_no", "line")))), lambda s: s["line"]), joiner)
    rec = placed.groupBy("file_id", "record").agg(F.max(F.when(head, F.col("line"))).alias("head"), body.alias("seq"))
    return _ids(rec.withColumn("record", F.col("record").cast("long"))).withColumn("qual", F.lit(None).cast("string"))


# ------------------------------------------------------------------------ readers


def _as_reads(rows: DataFrame) -> DataFrame:
    name, comment = split_header(F.col("head"))
    return rows.select("read_id", "file_id", name.alias("name"), comment.alias("comment"), F.upper(F.translate("seq", ".", "N")).alias("seq"), "qual")


def _passed() -> Column:
    return F.col("comment").isNull() | ~F.col("comment").rlike("^[12]:Y:")


def _at_33(rows: DataFrame, base_64: list[int], base: int | None) -> DataFrame:
    """Qualities at base 33; without ``base`` those of the files ``base_64`` are at 64."""
    if base is not None:
        return rows if base == 33 else rows.withColumn("qual", quality.rescale("qual", base, 33))
    return rows.withColumn("qual", F.when(F.col("file_id").isin(base_64), quality.rescale("qual", 64, 33)).otherwise(F.col("qual"))) if base_64 else rows


def _at_64(stats) -> list[int]:
    """Files whose qualities are at base 64: none below ``;`` and one above ``K``; ``stats`` are (file, least, greatest)."""
    low, high = {}, {}
    for f, a, b in stats:
        if a is not None and a <= b:
            low[f], high[f] = min(low.get(f, 255), a), max(high.get(f, 0), b)
    return [f for f in low if low[f] >= ord(";") and high[f] > ord("K")]


def read_fastq(spark: SparkSession, *paths: str, base: int | None = None, drop_filtered: bool = True, numbered: bool = True, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """FASTQ files as ``read_id, file_id, name, comment, seq, qual`` with qualities at base 33.

    Bases are upper-cased, ``.`` becomes N. Without ``base`` the quality base is found
    for each file: 64 if no quality character is below ``;`` and one is above ``K``,
    else 33. Reads whose comment says they failed the filter (``1:Y:...``) are dropped.
    ``read_id`` counts from 0 through all files; without ``numbered``, and with ``base``,
    it is the range's number and the place there, and files are read once only. Mates
    that follow each other are in one partition. Empty files have no reads.
    """
    files = ranges.listed(spark, *paths)
    if files is None:
        rows = fastq_of_lines(spark, *paths)
        codes = F.transform(F.split("qual", ""), F.ascii)
        stats = [] if base is not None else rows.groupBy("file_id").agg(F.min(F.array_min(codes)), F.max(F.array_max(codes))).collect()
    else:
        if any(f["kind"] != "@" for f in files):
            raise ValueError(f"broken FASTQ: {next(f['uri'] for f in files if f['kind'] != '@')} does not begin with @")
        found = ranges.statistics(spark, files, range_bytes) if numbered or base is None else None
        rows = ranges.scan(spark, files, found if numbered else None, range_bytes)
        stats = [(r.file_id, r.low, r.high) for r in found or []]
    rows = _as_reads(_at_33(rows, _at_64(stats), base))
    return (rows.where(_passed()) if drop_filtered else rows).select(*COLUMNS)


def companion(spark: SparkSession, path: str) -> str | None:
    """The path of the quality file that lies beside a FASTA file (``x.fasta`` and ``x.fasta.qual`` or ``x.qual``), if there is one."""
    for name in (f"{path}.qual", re.sub(r"\.[^./]+$", ".qual", path)):
        where = spark._jvm.org.apache.hadoop.fs.Path(name)
        if name != path and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return name
    return None


def _fasta_records(spark: SparkSession, paths: list[str], joiner: str, range_bytes: int) -> DataFrame:
    files = ranges.listed(spark, *paths)
    if files is None:
        return fasta_of_lines(spark, *paths, joiner=joiner)
    if any(f["kind"] != ">" for f in files):
        raise ValueError(f"{next(f['uri'] for f in files if f['kind'] != '>')} does not begin with >")
    files = [f | {"joiner": joiner} for f in files]
    return ranges.scan(spark, files, ranges.statistics(spark, files, range_bytes), range_bytes)


def read_fasta(spark: SparkSession, *paths: str, qual: str | list[str] | None = None, ignore_quality: bool = True, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """FASTA files (multi-line) as the same columns.

    ``qual`` is a companion file of integer qualities, or one for each path; without
    it and with ``ignore_quality`` off, a quality file beside each path is taken. Reads
    have null qualities where there is none.
    """
    quals = [qual] if isinstance(qual, str) else list(qual) if qual else None
    if quals is None and not ignore_quality:
        beside = [companion(spark, p) for p in paths]
        quals = beside if all(beside) else None  # type: ignore[assignment]
    if quals is not None and len(quals) != len(paths):
        raise ValueError("a quality file for each sequence file")
    rows = _as_reads(_fasta_records(spark, list(paths), "", range_bytes)).select(*COLUMNS)
    if quals is None:
        return rows
    q_name, _ = split_header(F.col("head"))
    numbers = F.transform(F.filter(F.split(F.trim("seq"), r"\s+"), lambda x: x != ""), lambda x: F.least(x.cast("int"), F.lit(126 - 33)))
    q = _fasta_records(spark, quals, " ", range_bytes).select("file_id", "read_id", q_name.alias("q_name"), quality.quality_text(numbers).alias("q"))
    agreed = F.when((F.col("name") == F.col("q_name")) & (F.length("seq") == F.length("q")), F.col("q")).otherwise(F.raise_error(F.concat(F.lit("qualities do not fit "), F.col("name"))))
    return rows.join(q, ["file_id", "read_id"], "left").select(*COLUMNS[:5], agreed.alias("qual"))


def read_any(spark: SparkSession, *paths: str, paired_first: bool = True, base: int | None = None, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """FASTQ or FASTA, told by each file's first byte (``@`` or ``>``), in one scan.

    With ``paired_first`` reads are numbered through the files in which mates follow
    each other first, then through the others; ``file_id`` is the place in ``paths``.
    """
    files = ranges.listed(spark, *paths)
    if files is None:
        return _any_of_lines(spark, *paths)
    for f in files:
        if f["kind"] not in ("@", ">"):
            raise ValueError(f"{f['uri']} is neither FASTQ nor FASTA")
    found = ranges.statistics(spark, files, range_bytes)
    rows = ranges.scan(spark, files, found, range_bytes, paired_first=paired_first)
    rows = _as_reads(_at_33(rows, _at_64((r.file_id, r.low, r.high) for r in found), base))
    return rows.where(_passed() | F.col("qual").isNull()).select(*COLUMNS)


def _any_of_lines(spark: SparkSession, *paths: str) -> DataFrame:
    out, at = None, 0
    for i, path in enumerate(paths):
        first = spark.read.text(path).limit(1).collect()
        mark = first[0][0][:1] if first else "@"
        if mark not in ("@", ">"):
            raise ValueError(f"{path} is neither FASTQ nor FASTA")
        one = (read_fastq if mark == "@" else read_fasta)(spark, path)
        one = one.withColumn("file_id", F.lit(i)).withColumn("read_id", F.col("read_id") + at)
        at += one.count() if len(paths) > 1 else 0
        out = one if out is None else out.unionByName(one)
    return out


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """Reads of a FASTA or FASTQ text in memory."""
    rows = []
    if text.startswith("@"):
        lines = text.removesuffix("\n").split("\n")
        rows = [(h[1:], s, q) for h, s, _, q in zip(*(lines[i::4] for i in range(4)))]
    elif text.strip():
        rows = [(*(r.split("\n", 1) + [""])[:2], None) for r in text.lstrip(">").split("\n>")]
    made = [(i, 0, h.split()[0] if h.split() else "", " ".join(h.split()[1:]) or None, s.replace("\n", "").replace(".", "N").upper(), q) for i, (h, s, q) in enumerate(rows)]
    return spark.createDataFrame(made, "read_id long, file_id int, name string, comment string, seq string, qual string")
