"""Named files in one pass, parts and single files, and what is left when tasks fail."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandworks.sources import fastx, sam, sink, writers


@pytest.fixture(scope="module")
def reads(spark):
    rnd = random.Random(1)
    rows = [(i, f"r{i // 2}/{1 + i % 2}", "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(5, 90))), ["read1", "read2", "unpaired"][i % 2 if i < 1900 else 2]) for i in range(2000)]
    return spark.createDataFrame(rows, "read_id long, name string, seq string, part string").withColumn("qual", F.expr("repeat('I', length(seq))")).repartition(7)


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay dealt out."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def text(rows, only=None):
    return "".join(f"@{r.name}\n{r.seq}\n+\n{r.qual}\n" for r in sorted(rows) if only is None or r.part == only)


def hidden(folder):
    return [x for x in os.listdir(folder) if x.startswith((".", "_"))]


def test_names_follow_the_template():
    assert sink.fill_template("{Key}-{Uniq}.{FileNum}.{NumFiles}", 1, 4, "x") == "x-000001of000004.000001.000004"
    assert sink.fill_template("{UniqFirst}_{UniqSecond}_{FirstNum}{SecondNum}", 7, 12, second_dim=3) == "000002of000004_000001of000003_000002000001"
    assert sink.fill_template("{FirstNum}{Other}", 7, 12) == "{FirstNum}{Other}"


def test_parts_of_named_files_in_order(spark, reads, tmp_path):
    rows = reads.collect()
    made = writers.write_read_files(reads, str(tmp_path), key="part", template="lane.{Key}.{Uniq}.fastq")
    assert sorted(os.listdir(tmp_path)) == sorted(os.path.basename(p) for p in made)
    for only in ("read1", "read2", "unpaired"):
        mine = [p for p in made if f".{only}." in p]
        assert [os.path.basename(p) for p in mine] == [f"lane.{only}.{i:06d}of{len(mine):06d}.fastq" for i in range(len(mine))]
        assert "".join(open(p).read() for p in mine) == text(rows, only)
    assert len([p for p in made if "read1" in p]) > 1  # no task owns a file


@pytest.mark.parametrize("copy", [100, 64 << 20])
def test_single_files_are_their_parts_joined(spark, reads, tmp_path, monkeypatch, copy):
    monkeypatch.setattr(sink.join_parts, "__defaults__", (copy,))
    rows = reads.collect()
    made = writers.write_read_files(reads, str(tmp_path), key="part", template="{Key}.fastq", single=True)
    assert [os.path.basename(p) for p in made] == sorted(os.listdir(tmp_path)) == ["read1.fastq", "read2.fastq", "unpaired.fastq"]
    for p in made:
        assert open(p).read() == text(rows, os.path.basename(p)[:-6])
    whole = writers.write_read_files(reads, str(tmp_path), template="all.fastq", single=True)
    assert open(whole[0]).read() == text(rows) and not hidden(tmp_path)
    back = fastx.read_fastq(spark, whole[0], range_bytes=5000).orderBy("read_id").collect()
    assert [(r.read_id, r.name, r.seq) for r in back] == [(r.read_id, r.name, r.seq) for r in sorted(rows)]


def test_more_files_than_a_task_holds_open(spark, tmp_path, monkeypatch):
    rows = spark.range(3000, numPartitions=2).select((F.col("id") % 150).cast("string").alias("file"), F.col("id").cast("string").alias("record"))
    made = sink.write_files(rows, str(tmp_path), "f{Key}", single=True)
    assert len(made) == 150
    for p in made:
        key = int(os.path.basename(p)[1:])
        assert [int(x) for x in open(p)] == list(range(key, 3000, 150))


def test_edges(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), ("x", None), (None, "b\nc"), ("é k", "ü")], "file string, record string").coalesce(1)
    made = sink.write_files(rows, str(tmp_path), "n-{Key}.txt", single=True)
    assert {os.path.basename(p): open(p).read() for p in made} == {"n-.txt": "a\nb\nc\n", "n-x.txt": "", "n-é k.txt": "ü\n"}
    assert sink.write_files(rows.limit(0), str(tmp_path / "none")) == [] and os.listdir(tmp_path / "none") == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "kept.txt").write_text("as it was")
    bad = spark.range(100, numPartitions=4).select(F.lit("k").alias("file"), F.when(F.col("id") == 90, F.raise_error(F.lit("no such read"))).otherwise("x").cast("string").alias("record"))
    with pytest.raises(Exception, match="no such read"):
        sink.write_files(bad, str(tmp_path), "{Key}{Uniq}")
    assert os.listdir(tmp_path) == ["kept.txt"]


def test_bam_as_one_file(spark, tmp_path):
    header, refs = "@HD\tVN:1.0\n@SQ\tSN:c1\tLN:90000\n@SQ\tSN:c2\tLN:90000\n", [("c1", 90000), ("c2", 90000)]
    rows = [(f"q{i}", 0, f"c{1 + i % 2}", 1 + (i * 7919) % 80000, 30, "5M", "*", 0, 0, "ACGTA", "IIIII", {"NM": f"i:{i}"}) for i in range(700)]
    df = spark.createDataFrame(rows, sam.SAM).repartition(6)
    writers.write_bam_file(df, str(tmp_path / "all.bam"), header, refs)
    assert os.listdir(tmp_path) == ["all.bam"]
    raw = (tmp_path / "all.bam").read_bytes()
    head, got_refs, got = sam.bam_records(raw)
    assert raw.endswith(sam.BGZF_EOF) and head.startswith("@HD\tVN:1.0") and got_refs == refs
    assert [(r[2], r[3]) for r in got] == sorted((r[2], r[3]) for r in rows) and sorted(map(str, got)) == sorted(map(str, rows))
