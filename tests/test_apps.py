from strandworks import apps

from .test_io import HEADER, RECORDS, fastq
from .test_pipelines import genome, rc


def test_programs(spark, tmp_path, capsys):
    g = genome(300, 5)
    text = "".join(f"@f{i}/{m}\n{s}\n+\n{'I' * 60}\n" for i, a in enumerate(list(range(0, 200, 10)) * 2) for m, s in ((1, g[a : a + 60]), (2, rc(g[a + 30 : a + 90]))))
    src = tmp_path / "a.fastq"
    src.write_text(text)
    run = lambda *args: apps.main([str(x) for x in args], spark)
    out = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    run("filter-reads", src, "--output", tmp_path / "f", "--kmer-size", 21, "--scoring", "MEDIAN", "--artifacts")
    assert out("f").count("MedianScore") == 80
    (tmp_path / "phi.fa").write_text(f">phi\n{g[:100]}\n")
    run("filter-reads", src, "--output", tmp_path / "f2", "--kmer-size", 21, "--artifacts", "--mask-simple-repeats", "--control", tmp_path / "phi.fa", "--discarded", tmp_path / "gone")
    gone = (tmp_path / "gone" / "Control.fastq").read_text()
    assert gone.count("\n") % 8 == 0 and gone.count("\n") // 4 + out("f2").count("\n") // 4 == 80 and gone.count("@f0/") == 2
    run("filter-reads", src, "--output", tmp_path / "parts", "--kmer-size", 21, "--scoring", "MEDIAN", "--partition-by-depth", 8, "--remainder-trim", 0.4)
    files = sorted(p.name for p in (tmp_path / "parts").iterdir())
    assert files and set(files) <= {"depth-8.fastq", "depth-4.fastq", "depth-2.fastq", "remainder.fastq"} and sum((tmp_path / "parts" / f).read_text().count("\n") for f in files) == 80 * 4
    run("filter-reads", src, "--output", tmp_path / "cover", "--kmer-size", 21, "--max-depth", 1, "--normalization", "OPTIMAL")
    assert 2 <= out("cover").count("Score") < 40
    run("dedup-reads", src, "--output", tmp_path / "d")
    assert out("d").count("@C2-") == 40 and out("d").count("@f") == 0
    run("mer-count", src, "--output", tmp_path / "m", "--kmer-size", 21)
    assert len(out("m/mercount").splitlines()) == len(out("m/mergraph").splitlines()) > 400
    run("histogram", src, "--output", tmp_path / "h", "--kmer-size", 21)
    assert out("h/histogram")
    run("sample", src, "--output", tmp_path / "s", "-n", 7)
    assert out("s").count("\n") == 7 * 2 * 4
    run("split", src, "--output", tmp_path / "p", "--parts", 4)
    assert len(list((tmp_path / "p").glob("part=*"))) + len(list((tmp_path / "p").glob("out_key=*"))) == 4
    run("split", src, "--output", tmp_path / "mates", "--mates")
    assert sorted(p.name for p in (tmp_path / "mates").iterdir()) == ["read1.fastq", "read2.fastq"]
    assert (tmp_path / "mates" / "read1.fastq").read_text() == "".join(f"{x}\n" for i, x in enumerate(text.splitlines()) if i % 8 < 4)
    run("split", src, "--output", tmp_path / "more", "--mates", "--in-parts", "--template", "{Key}.{Uniq}.fq")
    assert (tmp_path / "more" / "read2.000000of000001.fq").exists()
    (tmp_path / "seed.fa").write_text(f">seed\n{g[100:170]}\n")
    run("nucleate", tmp_path / "seed.fa", src, "--output", tmp_path / "n", "--kmer-size", 21, "--min-coverage", 2.0)
    head, grown = (tmp_path / "n" / "contigs.fasta").read_text().split()
    assert grown in g and len(grown) > 200 and head.startswith(">seed-l")
    run("convert", src, "--output", tmp_path / "c")
    assert out("c/fasta").count(">") == out("c/qual").count(">") == 80
    run("compare", src, src, "--kmer-size", 21)
    run("tnf", src, src)
    run("estimate-size", src, "--kmer-size", 21, "--fraction", 1.0)
    assert "genome_kmers" in capsys.readouterr().out


def test_bam_sort(spark, tmp_path):
    (tmp_path / "a.sam").write_text(HEADER + "".join("\t".join(map(str, r)) + "\n" for r in RECORDS))
    apps.main(["bam-sort", str(tmp_path / "a.sam"), "--output", f"file://{tmp_path}/o"], spark)
    assert list((tmp_path / "o" / "sorted").glob("*.bam")) and fastq(2)
