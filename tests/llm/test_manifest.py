"""Merkle manifest: digests against plain lists of levels, and its SQL twin."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandworks.llm import manifest

from .. import oracle
from .cases import SCHEMA


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(row, text):
    doc_id, _, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def brute_tree(leaves):
    """Root, and the siblings (left, right) by level of each leaf."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, i in enumerate(at):
            run, p = runs[i // 8], i % 8
            paths[k].append((run[:p], run[p + 1 :]))
            at[k] = i // 8
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def brute(rows):
    first = lambda v: (v is not None, v)
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((first(r[0]), brute_leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda x: (x[0][0], x[0][1] or 0, x[1]))
        trees[g] = brute_tree([x[1] for x in by[g]])
    root, tops = brute_tree([trees[g][0] for g in langs])
    out = Counter()
    for g, top in zip(langs, tops):
        for (_, leaf, r), path in zip(by[g], trees[g][1]):
            path = path + top
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            f = brute_leaf(r, text)
            for left, right in path:
                f = sha("".join([*left, f, *right]))
            sib = [x for pair in path for side in pair for x in side]
            out[(r[0], leaf, trees[g][0], root, sha("".join(sib)), f, f == root, len(sib))] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path_len"]


def found(docs, levels):
    out = manifest.manifest(docs, manifest.lowered(F.col("text")), F.crc32(F.col("doc_id").cast("string")) % 3 == 0, levels)
    return Counter(tuple(r[c] for c in COLUMNS) for r in out.collect())


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_equals_plain_levels_at_any_block_size(spark, rows, levels):
    more = rows + [(5000 + i, f"Text {i} of MANY", "en" if i % 3 else "de", "s", i) for i in range(230)] + [(i, "lone", f"l{i % 11}", None, 0) for i in range(11)]
    assert found(spark.createDataFrame(more, SCHEMA).repartition(5), levels) == brute(more)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 73, 513])
def test_traversal_of_any_number_of_leaves(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    root, paths = brute_tree([x.hex() for x in leaves])
    walk = manifest.Traversal(leaves.__getitem__, n, None)
    for i in range(n):
        assert [([x.hex() for x in a], [x.hex() for x in b]) for a, b in walk.path()] == paths[i]
        assert manifest.fold(leaves[i], walk.path()).hex() == root
        walk.advance()
    assert manifest.subtree_root(leaves.__getitem__, n, None).hex() == root


def test_traversal_state_is_logarithmic():
    reads = Counter()
    walk = manifest.Traversal(lambda i: reads.update([i]) or hashlib.sha256(b"%d" % i).digest(), 4096, None)
    most = 0
    for _ in range(4096):
        walk.advance()
        most = max(most, sum(map(len, walk.runs)) + sum(len(a.nodes) + sum(map(len, a.open)) for a in walk.ahead))
    assert most <= 4 * 8 + 4 * (8 + 4 * 8) and max(reads.values()) <= 5


def test_edges(spark, rows, docs, wide, empty):
    assert manifest.manifest(empty).count() == 0
    assert found(wide, 4) == found(docs, 4) == brute(rows)
    lone = spark.createDataFrame([(None, None, None, None, None)], SCHEMA)
    (r,) = manifest.manifest(lone).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("-----") and r.verified and r.proof_sha256 == sha("")
    same = spark.createDataFrame([(None, "x" * 100_000, None, "s", 1)] * 600, SCHEMA)
    got = manifest.manifest(same, levels=1).collect()
    assert len(got) == 600 and all(r.verified for r in got)


def test_sql_twin(spark, sf):
    oracle.assert_equal(manifest.op13_merkle_manifest(spark, sf), oracle.tables(sf), manifest.OP13_SQL)
