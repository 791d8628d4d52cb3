import io
import zlib
from collections import Counter

import numpy as np
import pytest

from strandworks.llm import sstable, tokenfiles
from strandworks.llm.scratch import fresh


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfiles.tokenizer_file())


TRICKY = ["", "a", " lead", "tail ", "a  b\n c", "x \ny z\n", "it's 'll we ' s's don't!!", "  a b c d", "a\tb <|endoftext|> c", "日本 語 x\x1cy  z 12³½ a1b2", "né ü ö é ß", "a\n\n\nb c\n", "no-break space x", "x" * 500 + " y"]


def test_pieces_equal_whole_texts(tokenizer, rows):
    encode = tokenfiles.Encoder(tokenfiles.tokenizer_file())
    assert encode.by_piece
    for text in [*TRICKY, *(r[1] for r in rows if r[1])]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        for _ in range(2):  # the second time from the cache
            assert np.frombuffer(encode(text), encode.kind).tolist() == want, text[:30]


def test_table_round_trip_and_lookup():
    entries = sorted(((sstable.key_of(i), bytes([i % 251]) * (i % 700)) for i in [*range(-3000, 9000, 7), 5, 5, -(1 << 63), (1 << 63) - 1]), key=lambda e: e[0])
    out = io.BytesIO()
    w = sstable.Writer(out, 2)
    w.add(sstable.key_of(None), b"null")
    for k, v in entries:
        w.add(k, v)
    w.close()
    table = sstable.Reader(io.BytesIO(out.getvalue()))
    assert list(table) == [(b"", b"null"), *entries] and len(table.blocks) > 3
    by_key = {}
    for k, v in entries:
        by_key.setdefault(k, []).append(v)
    for k, vs in by_key.items():
        assert table.get(k) == vs and sstable.key_of(sstable.id_of(k)) == k
    assert table.get(sstable.key_of(None)) == [b"null"]
    absent = [sstable.key_of(i) for i in range(9000, 12000) if sstable.key_of(i) not in by_key]
    assert all(table.get(k) == [] for k in absent)
    assert sum(table.may_contain(k) for k in absent) < 0.05 * len(absent)
    with pytest.raises(ValueError):
        bad = bytearray(out.getvalue())
        bad[10] ^= 1
        list(sstable.Reader(io.BytesIO(bytes(bad))))


def test_keys_out_of_order_are_refused():
    w = sstable.Writer(io.BytesIO(), 2)
    w.add(sstable.key_of(2), b"")
    with pytest.raises(ValueError):
        w.add(sstable.key_of(1), b"")


def test_token_shards(spark, docs, rows, tokenizer):
    manifest = tokenfiles.write_shards(docs, fresh(spark, "test-shards"))
    got = tokenfiles.read_shards(spark, manifest).collect()
    coded = [(r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in rows]
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == Counter((i, len(c), zlib.crc32(c.tobytes())) for i, c in coded)
    at = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at
        at += g.n_tokens
    order = [g.doc_id for g in sorted(got, key=lambda g: g.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    for ident in (-4, 2, 5, None):
        assert Counter(tuple(a) for a in tokenfiles.lookup(manifest, ident)) == Counter(tuple(c) for i, c in coded if i == ident)
    assert tokenfiles.lookup(manifest, 999) == []


def test_token_edges(spark, wide, empty, rows):
    assert tokenfiles.read_shards(spark, tokenfiles.write_shards(wide, fresh(spark, "test-shards"))).count() == len(rows)
    assert tokenfiles.read_shards(spark, tokenfiles.write_shards(empty, fresh(spark, "test-shards"))).count() == 0


def test_manifest_is_written_last(spark, docs, rows):
    path = fresh(spark, "shards")
    with pytest.raises(Exception):
        tokenfiles.open_shards(spark, path).collect()
    written = tokenfiles.write_shards(docs, path)
    again = tokenfiles.open_shards(spark, path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, written.collect())) and sum(r.n_docs for r in again.collect()) == len(rows)
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    with store.open_output_stream(f"{folder}/shard-leftover.sst") as out:
        out.write(b"half a shard")
    assert tokenfiles.read_shards(spark, tokenfiles.open_shards(spark, path)).count() == len(rows)


def test_an_id_of_all_rows_is_many_shards(spark):
    """Null ids with different texts, and one row over and over: shards share them, and starts count through."""
    from pyspark.sql import functions as F

    from strandworks.llm import tokenfiles
    from strandworks.llm.scratch import fresh

    texts = spark.range(6000, numPartitions=5).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 3000, F.concat(F.lit("text number "), "id")).otherwise("the same").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokenfiles.write_shards(texts, fresh(spark, "test-shards"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes) == 3000
    rows = sorted(tokenfiles.read_shards(spark, manifest).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.doc_id is None and r.start == at
        at += r.n_tokens
    assert len(tokenfiles.lookup(manifest, None)) == 6000
