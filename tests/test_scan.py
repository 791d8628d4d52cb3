"""The range scan: the same records at any range size, mates together, no exchange."""

import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandworks.sources import fastx, scan


def fastq_text(n, seed, paired=True, end="\n", longest=60):
    rnd, out = random.Random(seed), []
    for i in range(n):
        size = rnd.choice([0, 1, longest // 3, longest])
        seq = "".join(rnd.choice("ACGTN") for _ in range(size))
        qual = "".join(rnd.choice("@+I#5") for _ in range(size))  # lines that look like headers
        name = f"r{i // 2}/{1 + i % 2}" if paired else rnd.choice([f"r{i}", f"r{i} 1:N:0:AC", f"@r{i}"])
        out.append((f"@{name}", seq, qual))
    return out, "".join(end.join([h, s, "+", q]) + end for h, s, q in out)


def fasta_text(n, seed):
    rnd, out = random.Random(seed), []
    for i in range(n):
        lines = ["".join(rnd.choice("ACGT") for _ in range(rnd.choice([1, 9, 70]))) for _ in range(rnd.choice([0, 1, 2, 9]))]
        out.append((f">s{i // 2}/{1 + i % 2} x>y", "".join(lines), lines))
    return [(h, s) for h, s, _ in out], "".join(f"{h}\n" + "".join(f"{x}\n" for x in lines) for h, _, lines in out)


def by_range(path, kind, step, joiner=""):
    entry = {"file_id": 0, "uri": f"file://{path}", "size": path.stat().st_size, "kind": kind, "packed": False, "joiner": joiner}
    return [[(h.decode(), s.decode(), q.decode() if q is not None else None) for heads, seqs, quals in scan.records_of(r) for h, s, q in zip(heads, seqs, quals or [None] * len(heads))] for r in scan.ranges_of([entry], step)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("chunk,back", [(50, 16), (4 << 20, 1 << 16)])
def test_fastq_records_at_any_range_size(tmp_path, monkeypatch, end, chunk, back):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    monkeypatch.setattr(scan, "LOOK_BACK", back)
    for paired in (True, False):
        rows, text = fastq_text(41, 3, paired, end)
        for cut in (text, text[: -len(end)]):
            path = tmp_path / "a.fastq"
            path.write_bytes(cut.encode())
            for step in [*range(1, 40, 6), 97, 150, 211, 500, 3000, 10**6]:
                got = by_range(path, "@", step)
                assert [r for part in got for r in part] == rows
                if paired:
                    assert all(len({p for p, part in enumerate(got) for h, *_ in part if h[:-1] == f"@r{i}/"}) <= 1 for i in range(20))


@pytest.mark.parametrize("chunk,back", [(30, 8), (4 << 20, 1 << 16)])
def test_fasta_records_at_any_range_size(tmp_path, monkeypatch, chunk, back):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    monkeypatch.setattr(scan, "LOOK_BACK", back)
    rows, text = fasta_text(40, 5)
    for cut in (text, text[:-1], text.replace("\n", "\r\n")):
        path = tmp_path / "a.fa"
        path.write_bytes(cut.encode())
        for step in [1, 3, 11, 64, 65, 200, 999, 10**6]:
            got = by_range(path, ">", step)
            assert [r[:2] for part in got for r in part] == rows
            assert all(len({p for p, part in enumerate(got) for h, *_ in part if h.startswith(f">s{i}/")}) <= 1 for i in range(20))


def test_a_record_longer_than_many_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "LOOK_BACK", 32)
    rows, text = fastq_text(9, 8, longest=6000)
    (tmp_path / "a.fastq").write_text(text)
    for step in (50, 700, 5000):
        assert [r for part in by_range(tmp_path / "a.fastq", "@", step) for r in part] == rows


def test_scan_is_narrow_and_pruned(spark, tmp_path):
    rows, text = fastq_text(400, 1)
    (tmp_path / "a.fastq").write_text(text)
    for size in (333, 5000, 1 << 26):
        df = fastx.read_fastq(spark, str(tmp_path / "a.fastq"), base=33, range_bytes=size)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        placed = df.withColumn("p", F.spark_partition_id()).collect()
        assert [(r.read_id, f"@{r.name}", r.seq, r.qual) for r in sorted(placed)] == [(i, *r) for i, r in enumerate(rows)]
        where = {}
        for r in placed:
            where.setdefault(r.name[:-2], set()).add(r.p)
        assert all(len(p) == 1 for p in where.values())
    files = scan.listed(spark, str(tmp_path / "a.fastq"))
    some = scan.scan(spark, files, None, 2000, "seq string, read_id long")
    assert some.columns == ["seq", "read_id"] and sorted(r.seq for r in some.collect()) == sorted(s for _, s, _ in rows)
    ids = [r.read_id for r in fastx.read_fastq(spark, str(tmp_path / "a.fastq"), base=33, numbered=False, range_bytes=2000).collect()]
    assert len(set(ids)) == 400 and max(ids) >> 32 == len(text) // 2000 or max(ids) >> 32 == (len(text) - 1) // 2000


def test_folders_compression_and_order_of_paired_files(spark, tmp_path):
    single, one = fastq_text(7, 2, paired=False)
    pairs, two = fastq_text(10, 4)
    seqs, three = fasta_text(6, 6)
    (tmp_path / "dir").mkdir()
    half = two.index("@r3/1")
    (tmp_path / "dir" / "part-0.fastq.gz").write_bytes(gzip.compress(two[:half].encode()))
    (tmp_path / "dir" / "part-1.fastq.bz2").write_bytes(bz2.compress(two[half:].encode()))
    (tmp_path / "dir" / "_SUCCESS").write_text("")
    (tmp_path / "single.fastq").write_text(one)
    (tmp_path / "c.fa").write_text(three)
    (tmp_path / "none.fastq").write_text("")
    paths = [str(tmp_path / n) for n in ("single.fastq", "dir", "none.fastq", "c.fa")]
    got = fastx.read_any(spark, *paths, range_bytes=100).orderBy("read_id").collect()
    assert [r.file_id for r in got] == [1] * 10 + [3] * 6 + [0] * 7
    assert [r.seq for r in got] == [s for _, s, _ in pairs] + [s for _, s in seqs] + [s for _, s, _ in single]
    plain = fastx.read_any(spark, *paths, paired_first=False).orderBy("read_id").collect()
    assert [r.file_id for r in plain] == [0] * 7 + [1] * 10 + [3] * 6 and [r.read_id for r in plain] == list(range(23))


def test_what_is_broken_is_told(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nAC\n+\nI\n")
    (tmp_path / "b.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nAC\n")
    (tmp_path / "c.txt").write_text("hello\n")
    for name in ("a.fastq", "b.fastq"):
        with pytest.raises(Exception, match="broken FASTQ"):
            fastx.read_fastq(spark, str(tmp_path / name)).collect()
    with pytest.raises(ValueError, match="neither"):
        fastx.read_any(spark, str(tmp_path / "c.txt"))
    with pytest.raises(FileNotFoundError):
        fastx.read_any(spark, str(tmp_path / "missing"))


def test_lines_of_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    rows, text = fastq_text(30, 9)
    seqs, fasta = fasta_text(20, 9)
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "a.fa").write_text(fasta)
    names = [str(tmp_path / n) for n in ("a.fastq", "a.fa")]
    want = [sorted(map(tuple, f.collect())) for f in (fastx.read_fastq(spark, names[0]), fastx.read_fasta(spark, names[1]), fastx.read_any(spark, *names))]
    monkeypatch.setattr(scan, "uri_for_arrow", lambda uri: None)
    assert [sorted(map(tuple, f.collect())) for f in (fastx.read_fastq(spark, names[0]), fastx.read_fasta(spark, names[1]), fastx.read_any(spark, *names))] == want


def test_text_in_memory(spark):
    assert [tuple(r)[2:] for r in fastx.from_text(spark, "@a x\nAC.t\n+\n@@II\n@b\n\n+\n\n").collect()] == [("a", "x", "ACNT", "@@II"), ("b", None, "", "")]
