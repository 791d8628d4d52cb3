"""Reads of odd texts against plain slices, and how they are made."""

import re

from strandworks.plans import derived

TEXTS = [(0, None), (1, ""), (2, "...12"), (3, "é中!aZ" * 50), (None, "abc" * 40), (-5, "Hello world " * 999), (7, "x" * 60), (8, "x" * 61), (9, "x" * 120), (11, "yQ7 " * 7001)]


def test_reads_are_slices_of_letters(spark, monkeypatch):
    want = []
    for doc, text in TEXTS:
        dna = re.sub("[^A-Za-z]", "", text or "").translate(str.maketrans(derived.LETTERS, derived.AS_BASES))
        want += [(doc, i, dna[60 * i : 60 * i + 100]) for i in range(-(-len(dna) // 60))]
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    for size in (derived.SLICE, 300):
        monkeypatch.setattr(derived, "SLICE", size)
        got = derived.cut_reads(docs)
        assert sorted(map(str, ((r.doc_id, r.i, r.seq) for r in got.collect()))) == sorted(map(str, want))
    assert {(r.read_id, r.name, len(r.qual)) for r in got.where("doc_id = 8").collect()} == {(8 * derived.ROOM, "d8.0/1", 61), (8 * derived.ROOM + 1, "d8.0/2", 1)}


def test_reads_take_no_text_function_a_letter(spark, sf):
    plan = derived.reads(spark, sf).select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "translate(" not in plan and "transform(" not in plan


def test_names_follow_from_read_ids(spark):
    docs = spark.createDataFrame([t for t in TEXTS if t[0] is not None] + [(2**40 - 1, "abc" * 99), (-(2**39), "Abc" * 99)], "doc_id long, text string")
    got = derived.cut_reads(docs).select("name", derived.name_of("read_id").alias("made")).collect()
    assert len(got) > 400 and all(r.name == r.made for r in got)
