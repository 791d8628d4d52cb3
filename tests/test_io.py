import gzip
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandworks.operators import align, kmers
from strandworks.sources import fastx, pipes, sam, writers


def fastq(n, base=33, seed=1, extra=""):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = "".join(rnd.choice("ACGT") for _ in range(30 + i % 5))
        q = "".join(chr(base + (10 + rnd.randrange(30))) for _ in s)
        rows.append((f"r{i // 2}/{1 + i % 2}", s, q))
    return rows, "".join(f"@{a}{extra}\n{s}\n+\n{q}\n" for a, s, q in rows)


@pytest.mark.parametrize("split", [64, 1 << 27])
def test_fastq_is_whole_at_any_split(spark, tmp_path, split):
    rows, text = fastq(200)
    (tmp_path / "a.fastq").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split if split > 64 else 900)
    try:
        got = fastx.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("read_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(g.read_id, g.name, g.seq, g.qual) for g in got] == [(i, *r) for i, r in enumerate(rows)]


def test_quality_base_and_compression_and_order_of_files(spark, tmp_path):
    rows, text = fastq(8, 64)
    more, other = fastq(6, 33, 2)
    (tmp_path / "a.fastq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b.fastq").write_text(other.replace("\n", "\r\n"))
    got = fastx.read_fastq(spark, str(tmp_path / "a.fastq.gz"), str(tmp_path / "b.fastq")).orderBy("read_id").collect()
    assert [(g.file_id, g.name, g.seq) for g in got] == [(0, a, s) for a, s, _ in rows] + [(1, a, s) for a, s, _ in more]
    assert [g.qual for g in got] == ["".join(chr(ord(c) - 31) for c in q) for *_, q in rows] + [q for *_, q in more]


def test_filtered_reads_and_broken_records(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a 1:Y:0:A\nACGT\n+\nIIII\n@b 1:N:0:A\nac.t\n+\nIII#\n")
    got = fastx.read_fastq(spark, str(tmp_path / "a.fastq"), base=33).collect()
    assert [(g.name, g.comment, g.seq) for g in got] == [("b", "1:N:0:A", "ACNT")]
    (tmp_path / "c.fastq").write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="broken FASTQ"):
        fastx.read_fastq(spark, str(tmp_path / "c.fastq"), base=33).collect()


def test_fasta_with_qualities(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACGT\nAC\n>y\nGG\n")
    (tmp_path / "a.qual").write_text(">x\n1 2 3\n4 5 6\n>y\n40 99\n")
    got = fastx.read_fasta(spark, str(tmp_path / "a.fa"), qual=str(tmp_path / "a.qual")).orderBy("read_id").collect()
    assert [(g.name, g.comment, g.seq, g.qual) for g in got] == [("x", "one", "ACGTAC", "\"#$%&'"), ("y", None, "GG", "I~")]
    assert fastx.read_any(spark, str(tmp_path / "a.fa")).count() == 2
    assert [tuple(r) for r in fastx.from_text(spark, ">x one\nAC\nGT\n>y\nA\n").select("name", "seq").collect()] == [("x", "ACGT"), ("y", "A")]


HEADER = "@HD\tVN:1.0\n@SQ\tSN:c1\tLN:1000\n@SQ\tSN:c2\tLN:500\n"
REFS = [("c1", 1000), ("c2", 500)]
RECORDS = [
    ("p1", 99, "c2", 40, 30, "10M", "=", 60, 30, "ACGTACGTAC", "IIIIIIIIII"), ("p1", 147, "c2", 60, 30, "5M2D5M", "=", 40, -30, "ACGTACGTAN", "IIIIIIIII#"),
    ("p2", 65, "c1", 7, 20, "4S6M", "c2", 9, 0, "ACGTACGTAC", "*"), ("u1", 77, "*", 0, 0, "*", "*", 0, 0, "ACG", "III"), ("u1", 141, "*", 0, 0, "*", "*", 0, 0, "*", "*"), ("s1", 0, "c1", 7, 60, "3M", "*", 0, 0, "ACG", "III"),
]


def test_sam_and_bam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(HEADER + "".join("\t".join(map(str, r)) + "\tNM:i:1\n" for r in RECORDS))
    text = sam.read_alignments(spark, str(tmp_path / "a.sam"))
    assert sorted(tuple(r)[:11] for r in text.collect()) == sorted(RECORDS) and text.first().tags == {"NM": "i:1"}
    (tmp_path / "a.bam").write_bytes(sam.bam_bytes(HEADER, REFS, RECORDS))
    assert sorted(tuple(r)[:11] for r in sam.read_alignments(spark, str(tmp_path / "a.bam")).collect()) == sorted(RECORDS)
    parts = writers.write_bam(text, f"file://{tmp_path}/sorted", HEADER, REFS)
    raw = b"".join(open(p, "rb").read() for p in parts)
    assert raw.endswith(sam.BGZF_EOF)
    head, refs, rows = sam.bam_records(raw)
    assert head == HEADER and refs == REFS
    assert [(r[0], r[2], r[3]) for r in rows] == [("p2", "c1", 7), ("s1", "c1", 7), ("p1", "c2", 40), ("p1", "c2", 60), ("u1", "*", 0), ("u1", "*", 0)]
    with pytest.raises((ValueError, zlib.error)):
        sam.bam_records(raw[:100] + bytes([raw[100] ^ 255]) + raw[101:])
    kinds = {r.kind: r.n for r in align.split_unmapped(text).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"mapped": 4, "pair_unmapped": 2}
    writers.write_unmapped(text.where("flag & 4 <> 0"), str(tmp_path / "un"))
    out = "".join(gzip.open(p, "rt").read() for p in sorted((tmp_path / "un").glob("*.gz")))
    assert sorted(out.split("@")[1:]) == ["u1/1\nACG\n+\nIII\n", "u1/2\nN\n+\nA\n"]


def test_writers(spark, tmp_path):
    rows, text = fastq(40)
    df = spark.createDataFrame([(i, *r, f"p{i % 2}") for i, r in enumerate(rows)], "read_id long, name string, seq string, qual string, part string")
    writers.write_reads(df, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == text
    writers.write_reads(df, str(tmp_path / "keyed"), kind=writers.FASTA, key="part")
    assert sorted(p.name for p in (tmp_path / "keyed").glob("out_key*")) == ["out_key=p0", "out_key=p1"]
    spec = kmers.spectrum(kmers.observe(df, 9), 1)
    writers.write_mercount(spec, str(tmp_path / "mer"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "mer").glob("part-*"))).splitlines()
    assert lines == sorted(lines) and len(lines) >= spec.count()
    graph = kmers.spectrum(kmers.observe(df, 9, extensions=True), 1, 20)
    writers.write_mergraph(graph, str(tmp_path / "graph"))
    assert all(len(x.split("\t")) == 14 for p in (tmp_path / "graph").glob("part-*") for x in p.read_text().splitlines())
    piped = pipes.pipe_to(df.select(F.col("seq").alias("record")), ["tr", "ACGT", "TGCA"])
    assert sorted(r.line for r in piped.collect()) == sorted(s.translate(str.maketrans("ACGT", "TGCA")) for _, s, _ in rows)


def test_spectrum_table(spark):
    df = spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(itertools.product("ACGT", repeat=4))], "read_id long, seq string")
    spec = kmers.spectrum(kmers.observe(df, 3))
    writers.save_spectrum(spec, "spectrum_test", 4)
    back = writers.load_spectrum(spark, "spectrum_test")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, spec.collect()))
    spark.sql("DROP TABLE spectrum_test")


TAGS = {"NM": "i:3", "AS": "i:-7", "XA": "A:q", "XF": "f:0.5", "RG": "Z:group one", "XH": "H:1AE3", "XB": "B:s,1,-2,300", "XE": "B:f,0.25"}


def many_records(n):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        s = "".join(rnd.choice("ACGTN") for _ in range(rnd.choice([1, 50, 151])))
        rows.append((f"read{i}", 0, rnd.choice(["c1", "c2"]), rnd.randrange(1, 400), 30, f"{len(s)}M", "*", 0, 0, s, "".join(chr(33 + rnd.randrange(41)) for _ in s), {**TAGS, "XI": f"i:{i}"}))
    return rows


@pytest.mark.parametrize("range_bytes", [700, 5000, 1 << 25])
@pytest.mark.parametrize("block", [333, 0xFF00])
def test_bam_is_whole_at_any_range(spark, tmp_path, range_bytes, block):
    rows = many_records(400)
    raw = b"".join(sam.bgzf_blocks(sam.bam_bytes(HEADER, REFS, rows)))
    (tmp_path / "a.bam").write_bytes(sam.bgzf(raw, block=block))  # records cross blocks
    got = sam.read_bam(spark, str(tmp_path / "a.bam"), range_bytes)
    assert got.rdd.getNumPartitions() == -(-(tmp_path / "a.bam").stat().st_size // range_bytes)
    assert sorted((*tuple(r)[:11], tuple(sorted(r.tags.items()))) for r in got.collect()) == sorted((*r[:11], tuple(sorted(r[11].items()))) for r in rows)
    assert sam.read_header(spark, str(tmp_path / "a.bam")) == (HEADER, REFS)


def test_tags_and_header_survive_the_sort(spark, tmp_path):
    rows = many_records(60)
    (tmp_path / "a.bam").write_bytes(sam.bam_bytes(HEADER, REFS, rows))
    from strandworks import apps

    apps.main(["bam-sort", str(tmp_path / "a.bam"), "--output", f"file://{tmp_path}/o"], spark)
    folder = tmp_path / "o" / "sorted"
    head, refs, _ = sam.bam_records((folder / "head.bam").read_bytes() + sam.BGZF_EOF)
    assert head == HEADER.replace("VN:1.0", "VN:1.0\tSO:coordinate") and refs == REFS
    whole = {}
    for p in folder.glob("part-*.bam"):
        for r in sam.bam_records((folder / "head.bam").read_bytes() + p.read_bytes())[2]:
            whole[r[0]] = r
    assert whole == {r[0]: r for r in rows}
    (tmp_path / "a.sam").write_text(HEADER + "".join("\t".join([*map(str, r[:11]), *(f"{k}:{v}" for k, v in r[11].items())]) + "\n" for r in rows))
    assert sam.read_header(spark, str(tmp_path / "a.sam")) == (HEADER, REFS)


@pytest.mark.parametrize("split", [300, 1 << 27])
def test_fasta_is_whole_at_any_split(spark, tmp_path, split):
    rnd = random.Random(7)
    recs = [(f"s{i}", ["".join(rnd.choice("ACGTN") for _ in range(rnd.choice([1, 20, 60]))) for _ in range(rnd.choice([0, 1, 3, 40]))]) for i in range(50)]
    for part, some in (("a", recs[:30]), ("b", recs[30:])):
        (tmp_path / f"{part}.fasta").write_text("".join(f">{n} about\n" + "".join(f"{x}\n" for x in ls) for n, ls in some))
        (tmp_path / f"{part}.qual").write_text("".join(f">{n}\n" + "".join(" ".join(str(j % 50) for j in range(len(x))) + "\n" for x in ls) for n, ls in some))
    paths = [str(tmp_path / f"{p}.fasta") for p in "ab"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        plain = fastx.read_fasta(spark, *paths).orderBy("read_id").collect()
        rich = fastx.read_fasta(spark, *paths, ignore_quality=False).orderBy("read_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(g.read_id, g.name, g.seq) for g in plain] == [(i, n, "".join(ls)) for i, (n, ls) in enumerate(recs)] and plain[0].qual is None
    assert [g.qual for g in rich] == ["".join(chr(33 + j % 50) for x in ls for j in range(len(x))) for _, ls in recs]
