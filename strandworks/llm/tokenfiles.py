"""Operator 6, token-ID output: tokenised documents in sorted-string-table shards.

Documents are range-partitioned and sorted by doc_id, then by text hash, so an id
that very many rows have, null too, is many shards; each task tokenises its range and writes one shard in the shared folder (see ``sstable``), under a name
of its own, so a retried task never touches another's file. The manifest, a row a
shard, comes from the tasks that Spark counted as done and is written last, beside
the shards: a folder with a manifest is whole, and files that it does not name are
leftovers of tasks that were run again.

Texts are encoded piece by piece with a cache: the byte-level pre-tokeniser always
cuts before a space that follows a non-space, so a text without white space
before a space is the concatenation of its space-led pieces, and a piece of plain
characters that of its pre-tokens, which go to the library's BPE model. Other
texts and pieces are encoded whole. A test holds both ways against each other.

Edge cases: a null or empty text has only the end id; a null doc_id comes first;
repeated doc_ids keep all their rows, ordered by text hash; very long pieces are
not cached; an empty table gives no shards. Other columns are not read.
"""

from __future__ import annotations

import gc
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh
from .sstable import Reader, Writer, id_of, key_of

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
CACHE_ENTRIES = 800_000
CACHE_CHARS = 40
MANIFEST_NAME = "manifest"
MANIFEST = "path string, first_id long, last_id long, n_docs long, n_tokens long, first_hash long, last_hash long"
# Every character that any definition of white space holds, before a space.
_WHITE_THEN_SPACE = tuple(f"{c} " for c in map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def tokenizer_file(name: str = TOKENIZER) -> str:
    """Where the installed public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Fixed values of byte-level BPE: the pre-tokeniser's pattern, and the bytes that stand for themselves.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = {b: b if b in _OWN else 256 + sum(x not in _OWN for x in range(b)) for b in range(256)}
_SPACE = chr(_ALPHABET[0x20])
_STOPS = (",", ".", ";", ":", "!", "?")
#: Characters on whose classes all Unicode versions agree.
_PLAIN = re.compile("[\n!-~\u00a1-\u024f]+")


class _Parts(dict):
    """Ids of pre-tokens, each one call of the library's BPE model."""

    def __init__(self, model, width: int, vocabulary: int) -> None:
        super().__init__()
        self.model, self.coded = model, [i.to_bytes(width, "little") for i in range(vocabulary)]

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part[1:].isalpha():  # of such characters only the space has another sign
            signs = part.replace(" ", _SPACE)
        else:
            signs = part.encode().decode("latin-1").translate(_ALPHABET)
        out = b"".join([self.coded[t.id] for t in self.model.tokenize(signs)])
        if len(self) < CACHE_ENTRIES and len(part) <= CACHE_CHARS:
            self[part] = out
        return out


class _Pieces(dict):
    """Ids of space-led pieces, made of pre-tokens."""

    def __init__(self, parts: _Parts, whole) -> None:
        super().__init__()
        self.parts, self.whole = parts, whole

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            out = self.parts[" " + piece]
        elif piece.isascii() and piece[-1:] in _STOPS and piece[:-1].isalpha():
            out = self.parts[" " + piece[:-1]] + self.parts[piece[-1]]
        elif _PLAIN.fullmatch(piece):
            out = b"".join([self.parts[p] for p in _CUT.findall(" " + piece)])
        else:
            out = self.whole(" " + piece)
        if len(self) < CACHE_ENTRIES and len(piece) <= CACHE_CHARS:
            self[piece] = out
        return out


class Encoder:
    """Token ids of texts as little-endian bytes of ``width`` each."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        said = json.loads(self.tok.to_str())
        pre = said["pre_tokenizer"] or {}
        self.by_piece = said["normalizer"] is None and said["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.added = [t["content"] for t in said["added_tokens"]]
        model = self.tok.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the caches here take its place
        self.pieces = _Pieces(_Parts(model, self.width, self.tok.get_vocab_size(with_added_tokens=True)), self.whole)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece or any(x in text for x in _WHITE_THEN_SPACE) or any(a in text for a in self.added):
            return self.whole(text)
        head, *rest = text.split(" ")
        return b"".join([self.whole(head) if head else b"", *map(self.pieces.__getitem__, rest)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write the shards of ``docs`` below ``path`` and then their manifest, which is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file(tokenizer))
        end = end_id.to_bytes(encode.width, "little")
        store = name = out = writer = first = last = first_h = last_h = None
        tokens = 0
        gc.disable()  # cached ids and pieces are no garbage, and are many
        try:
            for batch in batches:
                for ident, text, h in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("h").to_pylist()):
                    ids = encode(text.as_py())
                    if writer is None:
                        store, folder = fs.FileSystem.from_uri(path)
                        store.create_dir(folder, recursive=True)
                        name, first, first_h = f"shard-{uuid.uuid4().hex}.sst", ident, h
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                        writer = Writer(out, encode.width)
                    writer.add(key_of(ident), ids + end)
                    tokens += len(ids) // encode.width + 1
                    last, last_h = ident, h
        finally:
            gc.enable()
        if writer is not None:
            writer.close()
            out.close()
            columns = [[f"{path}/{name}"], [first], [last], [writer.entries], [tokens], [first_h], [last_h]]
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "first_id", "last_id", "n_docs", "n_tokens", "first_hash", "last_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    # An id that many rows have, null too, is cut by text hash, and equal rows by their place in the input.
    order = [F.asc_nulls_first("doc_id"), "h", "row"]
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", "h")
    done = ordered.mapInArrow(run, MANIFEST).collect()  # a row a shard, from the tasks that count
    docs.sparkSession.createDataFrame([tuple(r) for r in done], MANIFEST).coalesce(1).write.parquet(f"{path}/{MANIFEST_NAME}")
    return open_shards(docs.sparkSession, path)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the shards below ``path``; fails if they were not written to their end."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/{MANIFEST_NAME}")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files of a manifest.

    The manifest has one row for each shard, so the driver may hold it: it grows
    with the number of range partitions, not with documents.
    """
    shards = sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_hash, r.last_id is not None, r.last_id or 0, r.last_hash))
    starts, at = [], 0
    for s in shards:
        starts.append((s.path, at))
        at += s.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as source:
                    table, rows = Reader(source), []
                    for key, value in table:
                        ids = np.frombuffer(value, f"<u{table.id_width}")
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """Token ids of each document with this id, by binary search in the one shard that can hold it."""
    near = manifest.where(F.col("first_id").eqNullSafe(F.lit(doc_id).cast("long")) | F.col("first_id").isNull() | (F.col("first_id") <= F.lit(doc_id).cast("long")))
    if doc_id is not None:
        near = near.where(F.col("last_id") >= doc_id)
    found = []
    for row in near.collect():
        store, name = fs.FileSystem.from_uri(row.path)
        with store.open_input_file(name) as source:
            table = Reader(source)
            found += [np.frombuffer(v, f"<u{table.id_width}") for v in table.get(key_of(doc_id))]
    return found


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised into shards, and what the shards hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(spark, write_shards(docs, fresh(spark, "token-shards")))
