"""Processes as operators, sources and sinks."""

import resource

import pytest
from pyspark.sql import functions as F

from strandworks.sources import pipes


def test_a_partition_goes_through_in_pieces(spark):
    rows = spark.range(60_000, numPartitions=3).select(F.concat_ws(",", F.lit("line"), "id").alias("record"))
    got = [r.line for r in pipes.pipe_to(rows, ["cat"]).collect()]
    assert got == [f"line,{i}" for i in range(60_000)]
    upper = pipes.pipe_to(rows.where("id % 2 = 0"), ["tr", "a-z", "A-Z"])
    assert upper.where("line like 'LINE,%'").count() == 30_000


def test_memory_stays_bounded():
    """Half a gigabyte through ``cat`` in a few pieces."""
    piece, n = b"x" * 999_999 + b"\n", 512
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    size = sum(len(data) for _, data in pipes.run(["cat"], (piece for _ in range(n))))
    assert size == n * 1_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def test_outputs_that_are_larger_than_pipes_hold():
    script = "tee {all} | awk 'NR % 2' | tee {odd} > /dev/null; echo done"
    found = {}
    for name, some in pipes.lines(pipes.run(["/bin/sh", "-c", script], (f"{i}\n".encode() * 3 for i in range(100_000)), ("all", "odd"))):
        found.setdefault(name, []).extend(some)
    assert len(found["all"]) == 300_000 and len(found["odd"]) == 150_000 and found[""] == [b"done"]


def test_outputs_as_rows(spark):
    rows = spark.range(100, numPartitions=2).select(F.col("id").cast("string").alias("record"))
    got = pipes.pipe_to(rows, ["/bin/sh", "-c", "tee {copy} | wc -l"], outputs=("copy",)).collect()
    assert sorted(int(r.line) for r in got if r.output == "copy") == list(range(100))
    assert [r.line.strip() for r in got if r.output == ""] == ["50", "50"]


def test_status_and_early_ends(spark):
    rows = spark.range(200_000, numPartitions=2).select(F.col("id").cast("string").alias("record"))
    assert pipes.pipe_to(rows, ["head", "-n", "3"]).count() == 6
    with pytest.raises(Exception, match="ended with 3: too bad"):
        pipes.pipe_to(rows, ["/bin/sh", "-c", "cat > /dev/null; echo too bad >&2; exit 3"]).count()
    with pytest.raises(Exception, match="no-such-command"):
        pipes.pipe_to(rows, ["no-such-command"]).count()
    broken = rows.select(F.when(F.col("record") == "150000", F.raise_error(F.lit("bad row"))).otherwise(F.col("record")).alias("record"))
    with pytest.raises(Exception, match="bad row"):
        pipes.pipe_to(broken, ["cat"]).count()
    edges = spark.createDataFrame([(None,), ("",), ("a\nb",), ("é" * 300_000,)], "record string").coalesce(1)
    assert [r.line for r in pipes.pipe_to(edges, ["cat"]).collect()] == ["", "a", "b", "é" * 300_000]
    assert pipes.pipe_to(edges.limit(0), ["cat"]).count() == 0


def test_source_and_sink(spark, tmp_path):
    got = pipes.read_command(spark, ["seq", "-f", "{FileNum}/{NumFiles} %g", "3"], 4).orderBy("partition", "line_no").collect()
    assert [(r.partition, r.line_no, r.line) for r in got] == [(p, i, f"{p:06d}/000004 {i + 1}") for p in range(4) for i in range(3)]
    with pytest.raises(Exception, match="ended with 1"):
        pipes.read_command(spark, ["false"]).collect()
    rows = spark.range(1000, numPartitions=3).select(F.col("id").cast("string").alias("record"))
    pipes.write_command(rows, ["/bin/sh", "-c", f"sort > {tmp_path}/{{Uniq}}.txt"])
    files = sorted(tmp_path.iterdir())
    assert [f.name for f in files] == [f"{i:06d}of000003.txt" for i in range(3)]
    assert sorted(int(x) for f in files for x in f.read_text().split()) == list(range(1000))
    with pytest.raises(Exception, match="ended with 7"):
        pipes.write_command(rows, ["/bin/sh", "-c", "exit 7"])


def test_commands_of_rows(spark):
    rows = spark.createDataFrame([(1, "true"), (2, "echo no >&2; exit 4"), (3, None)], "k int, command string")
    assert [tuple(r) for r in pipes.run_commands(rows).orderBy("k").collect()] == [(1, "true", 0, ""), (2, "echo no >&2; exit 4", 4, "no"), (3, None, None, None)]
