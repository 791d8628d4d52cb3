"""Operator 13, Merkle dataset manifest.

Every document is a leaf: SHA-256 of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value. The leaves of a language, in order of doc_id, are the
bottom of a tree of arity 8; the roots of the languages are the leaves of one more
tree. With a leaf's siblings on the way to the root anyone can check the document
against the root alone.

How Spark does it:

* Leaves are dealt out by range of (lang, doc_id, leaf), so a language with most of
  the rows is many tasks; a leaf's number in its language is its number in its
  partition plus what the partitions before hold, one small table of counts.
* The tree is cut in aligned blocks of 8**4 leaves. A block's root comes from one
  treehash pass, the roots of the blocks are the leaves of the next round, and so on:
  two or three rounds for any number of documents. Then each block gets its upper path,
  which all its leaves share, from top to bottom.
* Inside a block, authentication paths are made leaf by leaf with Merkle's traversal
  schedule (:class:`Traversal`): beside the path itself there is one treehash stack a
  level, which reads one leaf a step and has the level's next run of nodes ready just
  when the path turns to it. State is a run and a stack of at most 7 digests on each
  of at most 4 levels, however many leaves the block has.

No group is larger than a block, and only counts by (partition, language) are joined.

Edge cases: a null field is ``-``, so null and empty texts differ; a null doc_id comes
first and is never tampered with; rows with the same lang and doc_id are ordered by
leaf, equal rows by their place in the input (their leaves are the same, so any order
gives the same digests; each has its own proof); a null lang is a language of its own
and comes first; a lone leaf is its language's root, and a lone language's root is the
root; an empty table gives an empty result; very long texts are hashed in the JVM and
never leave it. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

ARITY = 8
LEVELS = 4  # of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of digests, each as lowercase hex text."""
    return sha256("".join([p.hex() for p in parts]).encode()).digest()


def leaf(text: Column) -> Column:
    """Digest of a document, as binary, with ``text`` for its text."""
    values = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256))


def lowered(text: Column) -> Column:
    """The tampering: A-Z become a-z, nothing else changes."""
    return F.translate(text, _UPPER, _LOWER)


class TreeHash:
    """Reads the leaves below the nodes ``first`` to ``first + 7`` of a level one by one; keeps a stack of open runs.

    ``leaf_at(i)`` gives leaf i, ``n`` is the number of leaves. ``nodes`` has the nodes
    of the level that are complete.
    """

    def __init__(self, leaf_at: Callable[[int], bytes], n: int, level: int, first: int) -> None:
        self.leaf_at, self.level = leaf_at, level
        self.at, self.end = first * ARITY**level, min(n, (first + ARITY) * ARITY**level)
        self.open: list[list[bytes]] = [[] for _ in range(level)]
        self.nodes: list[bytes] = []

    def step(self) -> None:
        if self.at >= self.end:
            return
        node = self.leaf_at(self.at)
        self.at += 1
        last = self.at == self.end
        for run in self.open:
            run.append(node)
            if len(run) < ARITY and not last:
                return
            node = digest(run)
            run.clear()
        self.nodes.append(node)

    def finish(self) -> list[bytes]:
        while self.at < self.end:
            self.step()
        return self.nodes


def height(n: int, levels: int | None) -> int:
    """Levels above n leaves: ``levels`` in a block of a larger tree, else as many as it takes to have one node."""
    if levels is not None:
        return levels
    at = 0
    while n > 1:
        n, at = -(-n // ARITY), at + 1
    return at


def subtree_root(leaf_at: Callable[[int], bytes], n: int, levels: int | None) -> bytes:
    return TreeHash(leaf_at, n, height(n, levels), 0).finish()[0]


class Traversal:
    """Authentication paths of leaf 0, 1, ... of a tree of n leaves.

    :meth:`path` gives, from the leaves' level up, the siblings left and right of the
    current leaf's ancestors; :meth:`advance` goes to the next leaf.
    """

    def __init__(self, leaf_at: Callable[[int], bytes], n: int, levels: int | None) -> None:
        self.leaf_at, self.n, self.i = leaf_at, n, 0
        self.levels = height(n, levels)
        self.runs = [TreeHash(leaf_at, n, h, 0).finish() for h in range(self.levels)]
        self.ahead = [TreeHash(leaf_at, n, h, ARITY) for h in range(self.levels)]

    def path(self) -> list[tuple[list[bytes], list[bytes]]]:
        out = []
        for h, run in enumerate(self.runs):
            p = self.i // ARITY**h % ARITY
            out.append((run[:p], run[p + 1 :]))
        return out

    def advance(self) -> None:
        self.i += 1
        for h, ahead in enumerate(self.ahead):
            ahead.step()
            width = ARITY ** (h + 1)
            if self.i % width == 0:
                self.runs[h] = ahead.nodes
                self.ahead[h] = TreeHash(self.leaf_at, self.n, h, (self.i // width + 1) * ARITY)


def fold(node: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        node = digest([*left, node, *right])
    return node


# --------------------------------------------------------------- the tree in Spark


def _numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``idx`` of each row in its group, by ``order``, and the group's ``total``; the rows are written and read again.

    Rows are dealt out by range, so a group with most of the rows is many tasks. ``_row``
    (the row's place in the input) parts rows that are equal in all of ``order``.
    """
    ordered = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_row").sortWithinPartitions(group, *order, "_row")
    placed = keep(ordered.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "manifest-order")
    counts = placed.groupBy("_part", group).agg(F.min("_at").alias("_least"), F.count("*").alias("_n"))
    by_part = Window.partitionBy(group).orderBy("_part")
    before = counts.select(
        "_part", group, "_least", F.coalesce(F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("total"),
    )
    right = before.withColumnsRenamed({group: "_g", "_part": "_p"})
    joined = placed.join(right, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_least")).drop("_at", "_part", "_p", "_g", "_least", "_before")


_PATH = "array<struct<left: array<binary>, right: array<binary>>>"


def _plain(path) -> list[dict]:
    return [{"left": left, "right": right} for left, right in path]


def _tuples(path) -> list[tuple[list[bytes], list[bytes]]]:
    return [(x["left"], x["right"]) for x in path]


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (g, idx, total, node) with its aligned block."""
    return nodes.withColumn("block", F.expr(f"idx div {ARITY**levels}"))


def _block(t: pa.Table, levels: int) -> tuple[pa.Table, list[bytes], int | None]:
    """A block in order, its leaves, and its levels: all of them in a tree of several blocks."""
    t = t.sort_by("idx")
    return t, t.column("node").to_pylist(), levels if t.column("total")[0].as_py() > ARITY**levels else None


def _walk(leaves: list[bytes], levels: int | None) -> Iterator[list[tuple[list[bytes], list[bytes]]]]:
    walk = Traversal(leaves.__getitem__, len(leaves), levels)
    for _ in leaves:
        yield walk.path()
        walk.advance()


def _climb(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes`` (g, idx, total, node): roots (g, node), and for each block (g, block) its ``upper`` path to g's root."""

    def roots(t: pa.Table) -> pa.Table:
        t, leaves, high = _block(t, levels)
        blocks = -(-t.column("total")[0].as_py() // ARITY**levels)
        root = subtree_root(leaves.__getitem__, len(leaves), high)
        return pa.table({"g": t.column("g").slice(0, 1), "idx": t.column("block").slice(0, 1), "total": pa.array([blocks], pa.int64()), "node": pa.array([root], pa.binary())})

    up = keep(_blocks(nodes, levels).groupBy("g", "block").applyInArrow(roots, "g string, idx long, total long, node binary"), "manifest-blocks")
    if up.where("total > 1").isEmpty():
        return up.select("g", "node"), up.select("g", F.col("idx").alias("block"), F.array().cast(_PATH).alias("upper"))
    top, above = _climb(up, levels)

    def paths(key: tuple, t: pa.Table, u: pa.Table) -> pa.Table:
        t, leaves, high = _block(t, levels)
        shared = u.column("upper")[0].as_py()
        out = [_plain(path) + shared for path in _walk(leaves, high)]
        return pa.table([t.column("g"), t.column("idx"), pa.array(out, u.schema.field("upper").type)], ["g", "block", "upper"])

    found = _blocks(up, levels).groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(paths, f"g string, block long, upper {_PATH}")
    return top, keep(found, "manifest-paths")


def manifest(docs: DataFrame, change: Column | None = None, when: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaf, roots, proof and check of each document.

    ``change`` is the text that a document has when it is checked, where ``when`` holds;
    without them every document is checked as it is. Returns ``doc_id, leaf, subroot,
    root, proof_sha256, folded_root, verified, path_len``, digests as lowercase hex;
    ``path_len`` is the number of siblings. ``levels`` are those of a block; they change
    how the work is cut, not the tree.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in FIELDS[1:]))
    seen = F.when(when, leaf(change)) if change is not None else F.lit(None).cast("binary")
    leaves = picked.select("doc_id", F.col("lang").cast("string").alias("g"), leaf(F.col("text")).alias("node"), seen.alias("seen"))
    placed = keep(_numbered(leaves, "g", "doc_id", "node"), "manifest-leaves")
    roots, upper = _climb(placed.select("g", "idx", "total", "node"), levels)
    # Languages are the leaves of the last tree; its only group has an empty name.
    langs = _numbered(roots.select(F.lit("").alias("all"), F.col("g").alias("lang"), "node"), "all", "lang")
    langs = keep(langs.select(F.col("all").alias("g"), "idx", "total", "lang", "node"), "manifest-langs")
    top, above = _climb(langs.select("g", "idx", "total", "node"), levels)

    def lang_paths(key: tuple, t: pa.Table, u: pa.Table) -> pa.Table:
        t, leaves, high = _block(t, levels)
        shared = u.column("upper")[0].as_py()
        out = [_plain(path) + shared for path in _walk(leaves, high)]
        root = fold(leaves[0], _tuples(out[0]))
        return pa.table([t.column("lang"), t.column("node"), pa.array([root] * len(leaves), pa.binary()), pa.array(out, u.schema.field("upper").type)], ["lang", "subroot", "root", "last"])

    of_lang = _blocks(langs, levels).groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(lang_paths, f"lang string, subroot binary, root binary, last {_PATH}")
    whole = keep(upper.join(of_lang, F.col("g").eqNullSafe(F.col("lang"))).select("g", "block", F.concat("upper", "last").alias("upper"), "subroot", "root"), "manifest-upper")

    def proofs(key: tuple, t: pa.Table, u: pa.Table) -> pa.Table:
        t, leaves, high = _block(t, levels)
        shared, subroot, root = _tuples(u.column("upper")[0].as_py()), u.column("subroot")[0].as_py().hex(), u.column("root")[0].as_py()
        above = "".join(x.hex() for pair in shared for side in pair for x in side)
        extra = sum(len(left) + len(right) for left, right in shared)
        rows = []
        for node, seen, path in zip(leaves, t.column("seen").to_pylist(), _walk(leaves, high)):
            proof = sha256(("".join([x.hex() for pair in path for side in pair for x in side]) + above).encode()).hexdigest()
            folded = fold(seen or node, path + shared)
            rows.append((node.hex(), proof, folded.hex(), folded == root, extra + sum(len(a) + len(b) for a, b in path)))
        hexes, proof, folded, good, held = zip(*rows)
        n = len(leaves)
        return pa.table({
            "doc_id": t.column("doc_id"), "leaf": pa.array(hexes), "subroot": pa.array([subroot] * n), "root": pa.array([root.hex()] * n), "proof_sha256": pa.array(proof),
            "folded_root": pa.array(folded), "verified": pa.array(good), "path_len": pa.array(held, pa.int64()),
        })

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path_len long"
    return _blocks(placed, levels).groupBy("g", "block").cogroup(whole.groupBy("g", "block")).applyInArrow(proofs, schema)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; a third is checked with its text in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, lowered(F.col("text")), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def _sql_levels(levels: int, start: str, walk: str) -> str:
    """CTEs of ``levels`` rounds over nodes ``l0`` (g, i, d) and walkers ``p0`` (g, i, sib, f, ...), named by ``start`` and ``walk``."""
    out = []
    for k in range(levels):
        a, b, p, q = f"{start}{k}", f"{start}{k + 1}", f"{walk}{k}", f"{walk}{k + 1}"
        out.append(f"""{a}_r AS MATERIALIZED (SELECT g, i // 8 AS j, list(d ORDER BY i) AS run, any_value(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {a}) GROUP BY g, i // 8),
{b} AS MATERIALIZED (SELECT g, j AS i, CASE WHEN m = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d FROM {a}_r),
{q} AS MATERIALIZED (SELECT p.* EXCLUDE (i, sib, f), p.i // 8 AS i, CASE WHEN m = 1 THEN sib ELSE sib || array_to_string(run[1:p.i % 8], '') || array_to_string(run[p.i % 8 + 2:], '') END AS sib,
  CASE WHEN m = 1 THEN f ELSE sha256(array_to_string(run[1:p.i % 8], '') || f || array_to_string(run[p.i % 8 + 2:], '')) END AS f FROM {p} p JOIN {a}_r r ON r.g = p.g AND r.j = p.i // 8)""")
    return ",\n".join(out)


def _sql_leaf(text: str) -> str:
    part = "coalesce(strlen({0}) || ':' || {0}, '-')"
    return f"sha256({' || '.join(part.format(x) for x in ('CAST(doc_id AS VARCHAR)', 'source', 'lang', 'CAST(n_chars AS VARCHAR)', text))})"


#: Unsigned CRC-32 of the ASCII string ``{0}``; 3988292384 is the reflected polynomial.
SQL_CRC32 = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({0}, ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: xor(c >> 8, list_reduce(list_concat([xor(c, b) & 255], list_transform(range(8), lambda k: k::UBIGINT)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))), 4294967295)"""

# Up to 8**8 documents a language and 8**4 languages.
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE 'x' || lang END AS g, {_sql_leaf('text')} AS leaf,
  CASE WHEN {SQL_CRC32.format('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS seen FROM documents),
o AS MATERIALIZED (SELECT doc_id, g, leaf, coalesce(seen, leaf) AS now, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
a0 AS MATERIALIZED (SELECT g, i, leaf AS d FROM o),
p0 AS MATERIALIZED (SELECT doc_id, leaf, g, i, '' AS sib, now AS f FROM o),
{_sql_levels(8, 'a', 'p')},
s AS MATERIALIZED (SELECT g AS lang, d, row_number() OVER (ORDER BY g) - 1 AS i FROM a8),
b0 AS MATERIALIZED (SELECT 0 AS g, i, d FROM s),
q0 AS MATERIALIZED (SELECT doc_id, leaf, s.d AS subroot, 0 AS g, s.i AS i, sib, f FROM p8 JOIN s ON s.lang = p8.g),
{_sql_levels(4, 'b', 'q')}
SELECT doc_id, leaf, subroot, b4.d AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = b4.d AS verified, CAST(length(sib) // 64 AS BIGINT) AS path_len FROM q4, b4
"""
