"""Each stage of the pipeline against brute force on its own input, and the whole run."""

from collections import Counter

import pytest

import corpus_pipeline
from strandworks.llm import langid, mixing, packing

from .test_dedup import brute_components, brute_fingerprint, brute_lines, words


@pytest.fixture(scope="module")
def base(spark, rows):
    from .cases import SCHEMA

    more = [(1000 + i, f"{r[1]} and more of {i}" if r[1] else r[1], r[2], r[3], 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows + more, SCHEMA).cache()


def test_language_stage(spark, base, sf):
    net = langid.fit(base)
    said = langid.predict(base, net, *base.columns).collect()
    want = Counter((r.doc_id, r.text, r.lang or r.lang_pred, r.source, r.n_chars) for r in said if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE)
    assert Counter(map(tuple, corpus_pipeline.language_id(spark, base, sf).collect())) == want
    assert not any(t is None or not any(c.isalpha() for c in t) for _, t, *_ in want)


def test_line_stage(spark, base, sf):
    rows = [tuple(r) for r in base.collect()]
    keys = {(r.doc_id, r.text): (r.a, r.b) for r in base.selectExpr("doc_id", "text", "xxhash64(doc_id, text) a", "xxhash64(1, doc_id, text) b").collect()}
    kept = brute_lines(rows, keys, 2, 10)
    want = Counter()
    for i, t, lang, source, n in rows:
        new = kept[(i, t)] if t is not None else None
        if new == t or words(new):
            want[(i, new, lang, source, n if new == t else len(new))] += 1
    assert Counter(map(tuple, corpus_pipeline.line_dedup(spark, base, sf).collect())) == want


def test_near_stage(spark, base, sf):
    rows = [tuple(r) for r in base.collect()]
    comp = brute_components(list(range(len(rows))), [brute_fingerprint(r[1]) for r in rows])
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, base, sf).collect()]
    assert len(got) == len(set(comp)) and len({comp[rows.index(g)] for g in got}) == len(got)
    for g in got:
        ids = [r[0] for r, c in zip(rows, comp) if c == comp[rows.index(g)]]
        assert g[0] is None or None in ids or g[0] == min(ids)


def test_mixing_and_packing_stages(spark, base, sf):
    often = Counter()
    for r in mixing.copies(base).collect():
        often[r.doc_id] += r.passes
    mixed = corpus_pipeline.mix_sources(spark, base, sf)
    assert Counter(r.doc_id for r in mixed.collect()) == +often
    packed = corpus_pipeline.pack_batches(spark, mixed, sf).collect()
    assert Counter((p.doc_id, p.n_tokens) for p in packed) == Counter((r.doc_id, len(words(r.text))) for r in mixed.collect())
    assert sorted((p.bucket, p.batch, p.slot) for p in packed) == sorted({(p.bucket, p.batch, p.slot) for p in packed})


def test_run_is_the_stages_one_after_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns and name
    last = packing.pack(docs).collect()
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, last))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables_and_clashing_names(spark, sf, empty, wide, docs, name, stage):
    none = stage(spark, empty, sf)
    assert none.count() == 0
    got, plain = stage(spark, wide, sf), stage(spark, docs, sf)
    if stage is not corpus_pipeline.pack_batches:
        assert none.columns == empty.columns and got.columns == wide.columns
        assert Counter(map(tuple, got.select(*docs.columns).collect())) == Counter(map(tuple, plain.collect()))
        assert {r.score for r in got.collect()} == {"x-score"}
    else:
        assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == Counter((r.doc_id, r.n_tokens) for r in plain.collect())
