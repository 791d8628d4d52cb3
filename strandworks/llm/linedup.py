"""Operator 10, line dedup. DataFrame functions only.

A document is its sequence of lines that have a word; a suffix is such a sequence
from one line on. The suffix array over all documents is built by distributed
prefix doubling, FOLD doublings a round:

1. Lines that occur once are dropped: no repeated run holds one, and a suffix that
   starts with one shares nothing. Every other line has an ID, one for each text.
2. In a round with blocks of h lines (1, 2**FOLD, 4**FOLD, ...), the key of a suffix
   is the array of the ranks of its next 2**FOLD blocks, up to the end, the first
   line that occurs once, or the first block that occurs once. The different keys
   are counted and sorted by range, and their place is the rank of the suffixes
   that have them: suffixes are in the order of their lines, to 2**FOLD * h lines.
   Suffixes whose whole key is filled and occurs again go on with blocks of that
   size, until all are told apart or have ended.
3. The longest common prefix of neighbours in the suffix array comes from their
   keys: the equal blocks, and for the first that differ, the keys behind their
   ranks in the round before. Suffixes with the same key share all of it.
4. Neighbours whose common prefix does not fall below ``min_lines`` form an LCP
   interval: a repeated run of that many lines, wherever it stands. The first place
   of an interval in document order is the original, the others are later copies.
   The longer runs are nested intervals, made of the same lines.
5. The greater common prefix with either neighbour is the length of the longest
   run that starts at a line and stands elsewhere too; where it does not follow from
   the run one line before, the run is maximal (:func:`maximal_runs`).

Deleted are the lines of later copies of runs with at least ``min_lines`` lines,
and of single lines with at least ``min_words`` words. Positions are in order of
(doc_id, text hash, line number).

Lines and keys are known by pairs of 64-bit hashes; equal ones give equal names,
and a name needs a collision of 128 bits to be wrong. They are grouped by name with
partial aggregation before the shuffle, so a line in a third of all documents is
one row for each task; the joins back are left to the adaptive skew join. Sorting is
of different keys, so no key is hot in it. A document's lines are one row, as its
text is.

Edge cases: a null text has no lines and stays null; lines without a word are
never part of a run and always stay; lines end at ``\\n`` only; a null doc_id comes
first; rows with the same doc_id and the same text are one document listed twice
and get the same result; an empty table gives an empty result. Columns other
than doc_id and text go along unread, whatever their names (names with a leading
``_ld_`` excepted).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import files_for, keep

MIN_LINES = 2
MIN_WORDS = 10
FOLD = 5  # doublings a round
KEYS_A_RANGE, MAX_RANGES = 100_000, 20_000  # of the sort; a range is one sorted task, which may spill
_WORD = "[^ \t-\r]+"
_NAME = ["_ld_a", "_ld_b"]
_DOC = ["_ld_k", "_ld_l"]
_PLACE = ["_ld_doc", *_DOC, "_ld_pos"]


def _doc_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("_ld_k"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_ld_l")]


def _lines(docs: DataFrame) -> DataFrame:
    """One row a line with a word: document, number among these lines, number among all lines, name, words."""
    split = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("_ld_doc"), *_doc_keys(),
        F.expr("filter(transform(split(text, '\\n'), (x, i) -> struct(i AS at, x AS line)), s -> s.line RLIKE '[^ \\t-\\r]')").alias("lines"),
    )
    each = split.select("_ld_doc", *_DOC, F.posexplode("lines").alias("_ld_pos", "l"))
    return each.select(
        "_ld_doc", *_DOC, "_ld_pos", F.col("l.at").alias("_ld_at"), F.xxhash64("l.line").alias("_ld_a"), F.xxhash64(F.lit(1), "l.line").alias("_ld_b"),
        F.regexp_count("l.line", F.lit(_WORD)).alias("_ld_words"),
    )


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, int]:
    """Lines that occur at more than one place, with ``id`` and whether they are later copies, and about how many rows that is."""
    lines = keep(_lines(docs), "lines")
    files = files_for(lines.count())
    place = F.struct(*_PLACE)
    groups = lines.groupBy(*_NAME).agg(F.min(place).alias("_ld_first"), F.max(place).alias("_ld_last")).where("_ld_first <> _ld_last")
    # A written table, so that the IDs stay and the join has an exchange of its own, which the adaptive join can split.
    groups = keep(groups.select(*_NAME, "_ld_first", F.monotonically_increasing_id().alias("id")), "lines-groups", files)
    joined = lines.join(groups, _NAME).withColumn("_ld_later", place > F.col("_ld_first"))
    return keep(joined.select(*_PLACE, "_ld_at", "_ld_words", "id", "_ld_later"), "lines-repeated", files), files


@dataclass
class Level:
    """A round: blocks of ``h`` lines, ``keys`` in order and ``members``, the suffixes they belong to."""

    h: int
    keys: DataFrame  # rank, _ld_a, _ld_b, key, lines, n, full, first, lcp, lcp_next, interval
    members: DataFrame  # place, act, _ld_a, _ld_b


def _common(a: str, b: str) -> str:
    """SQL: how many leading elements two arrays have in common; 0 if one is null."""
    differ = f"array_position(zip_with({a}, {b}, (x, y) -> NOT (x <=> y)), true)"
    return f"coalesce(IF({differ} = 0, size({a}), {differ} - 1), 0)"


def _suffix_keys(rows: DataFrame, h: int, fold: int) -> DataFrame:
    """Place, ``act``, ``key`` (ranks of blocks), ``lines`` (how many it spells) and ``full`` of each suffix.

    ``rows`` has the place, the rank ``id`` of the suffix's first block, its lines
    ``span`` and ``act``: does the block occur again? Only documents with such a block
    are looked at; other blocks in them are a key of their own.
    """
    whole = rows.groupBy("_ld_doc", *_DOC).agg(F.sort_array(F.collect_set(F.struct(F.col("_ld_pos").alias("p"), "id", "span", "act"))).alias("s"), F.max("act").alias("some")).where("some")
    ahead = f"IF(me.act, transform(sequence(0, least({(1 << fold) - 1}, (size(s) - 1 - i) div {h})), j -> s[i + j * {h}]), array(me))"
    # Blocks follow each other if none before has ended and their places are h lines apart.
    stop = f"array_position(transform(c, (x, j) -> x.p <> me.p + j * {h} OR (j > 0 AND NOT c[j - 1].act)), true)"
    cut = f"transform(array({ahead}), c -> IF({stop} = 0, c, slice(c, 1, cast({stop} AS INT) - 1)))[0]"
    made = f"struct(me.p AS _ld_pos, me.act AS act, transform(b, x -> x.id) AS key, (size(b) - 1L) * {h} + b[size(b) - 1].span AS lines, size(b) = {1 << fold} AND b[size(b) - 1].act AS full)"
    # Keys are made inside the document's row: what is copied grows with its lines, not with their square.
    return whole.select("_ld_doc", *_DOC, F.explode(F.expr(f"transform(s, (me, i) -> transform(array({cut}), b -> {made})[0])")).alias("x")).select("_ld_doc", *_DOC, "x.*")


def _in_order(groups: DataFrame, size: int) -> DataFrame:
    """``groups`` with ``part`` and ``rank``, the order of their keys, written as a table."""
    ranges = min(MAX_RANGES, max(1, -(-size // KEYS_A_RANGE)))
    ordered = groups.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    return keep(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rank")), "lines-order")


def _with_neighbours(ordered: DataFrame) -> DataFrame:
    """``ordered`` with the keys before and behind. Windows are of one range; the ends of ranges are a small table of their own."""
    inside = Window.partitionBy("part").orderBy("rank")
    ends = ordered.groupBy("part").agg(F.min_by("key", "rank").alias("a"), F.max_by("key", "rank").alias("z"))
    over = Window.orderBy("part")  # a row for each range, MAX_RANGES at most
    ends = F.broadcast(ends.select("part", F.lag("z").over(over).alias("z"), F.lead("a").over(over).alias("a")))
    out = ordered.withColumn("before", F.lag("key").over(inside)).withColumn("behind", F.lead("key").over(inside)).join(ends, "part", "left")
    return out.withColumn("before", F.coalesce("before", "z")).withColumn("behind", F.coalesce("behind", "a")).drop("a", "z")


def _descend(pairs: DataFrame, a: str, b: str, levels: list[Level], h: int) -> Column | DataFrame:
    """``pairs`` with ``lcp`` of the suffixes behind two keys: equal blocks, then the keys of the first blocks that differ."""
    out = pairs.withColumn("_n", F.expr(_common(a, b))).withColumn("lcp", F.col("_n").cast("long") * h)
    for level in reversed(levels):
        told = lambda x, name: level.keys.select(F.col("rank").alias(f"_{name}"), F.col("key").alias(name))  # noqa: B023, E731
        out = out.withColumn("_x", F.expr(f"get({a}, _n)")).withColumn("_y", F.expr(f"get({b}, _n)")).drop(a, b)
        out = out.join(told("x", "x"), "_x", "left").join(told("y", "y"), "_y", "left").drop("_x", "_y", "_n")
        a, b = "x", "y"
        out = out.withColumn("_n", F.expr(_common(a, b))).withColumn("lcp", F.col("lcp") + F.col("_n") * level.h)
    return out.drop("_n", a, b)


def _level(rows: DataFrame, h: int, fold: int, files: int, below: list[Level], min_lines: int) -> tuple[Level, int]:
    """One round, and how many of its keys are full and occur again."""
    named = _suffix_keys(rows, h, fold).withColumns({"_ld_a": F.xxhash64("key", "full"), "_ld_b": F.xxhash64(F.lit(1), "key", "full")})
    members = keep(named, "lines-suffixes", files)
    groups = members.groupBy(*_NAME).agg(F.first("key").alias("key"), F.first("lines").alias("lines"), F.first("full").alias("full"), F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first"))
    groups = keep(groups, "lines-keys", files)
    size, more = groups.agg(F.count("*"), F.count_if(F.expr("full AND n > 1"))).first()
    near = _with_neighbours(_in_order(groups, size))
    if not below:
        told = near.withColumn("lcp", F.expr(_common("before", "key")).cast("long")).withColumn("lcp_next", F.expr(_common("key", "behind")).cast("long"))
    else:
        near = keep(near, "lines-near", files)
        up = _descend(near.select("rank", F.col("before").alias("k0"), F.col("key").alias("k1")), "k0", "k1", below, h)
        down = _descend(near.select("rank", F.col("key").alias("k0"), F.col("behind").alias("k1")), "k0", "k1", below, h).withColumnRenamed("lcp", "lcp_next")
        told = near.join(up, "rank").join(down, "rank")
    # Intervals: the number of drops below min_lines so far, counted in each range and over the ranges before.
    drop = F.when(F.col("lcp") < min_lines, 1).otherwise(0)
    told = told.drop("before", "behind").withColumn("interval", F.sum(drop).over(Window.partitionBy("part").orderBy("rank")))
    told = keep(told, "lines-lcp", files)
    sums = told.groupBy("part").agg(F.max("interval").alias("_s"))
    sums = sums.select("part", F.coalesce(F.sum("_s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    keys = told.join(F.broadcast(sums), "part").withColumn("interval", F.col("interval") + F.col("_s")).drop("part", "_s")
    return Level(h, keys, members), more


def suffix_array(single: DataFrame, files: int, min_lines: int = MIN_LINES, fold: int = FOLD, deep: bool = True) -> list[Level]:
    """The rounds of prefix doubling over :func:`repeated_lines`; only the first without ``deep``."""
    while 1 << fold < min_lines:
        fold += 1
    rows, h, levels = single.select(*_PLACE, "id", F.lit(1).alias("span"), F.lit(True).alias("act")), 1, []
    while True:
        level, more = _level(rows, h, fold, files, levels, min_lines)
        levels.append(level)
        if not deep or not more:
            return levels
        h <<= fold
        ranks = level.keys.select(*_NAME, F.col("rank").alias("id"), F.col("lines").alias("span"), (F.col("full") & (F.col("n") > 1)).alias("act"))
        rows = keep(level.members.select(*_PLACE, *_NAME).join(ranks, _NAME).drop(*_NAME), "lines-blocks", files)


def later_copies(levels: list[Level], files: int, min_lines: int = MIN_LINES) -> DataFrame:
    """Places at which a run of ``min_lines`` lines starts that stands at an earlier place too, with that ``original``."""
    keys = levels[0].keys.where(F.col("lines") >= min_lines)
    firsts = keys.groupBy("interval").agg(F.min("first").alias("original"), F.sum("n").alias("_n")).where("_n > 1").drop("_n")
    of = keep(keys.select("interval", *_NAME).join(firsts, "interval").drop("interval"), "lines-intervals", files)
    return levels[0].members.select(*_PLACE, *_NAME).join(of, _NAME).drop(*_NAME).where(F.struct(*_PLACE) > F.col("original"))


def longest_runs(levels: list[Level]) -> DataFrame:
    """Place and ``run``: the lines of the longest run that starts there and stands elsewhere too."""
    out = None
    for level in levels:
        deeper = F.col("full") & (F.col("n") > 1)
        longest = F.when(F.col("n") > 1, F.col("lines")).otherwise(F.greatest("lcp", "lcp_next"))
        known = level.keys.where(~deeper).select(*_NAME, longest.alias("run"))
        some = level.members.where("act").select(*_PLACE, *_NAME).join(known, _NAME).drop(*_NAME)
        out = some if out is None else out.unionByName(some)
    return out


def maximal_runs(docs: DataFrame, fold: int = FOLD) -> DataFrame:
    """``(doc_id, line, lines)``: runs of lines that stand elsewhere too and cannot be made longer at either end.

    ``line`` is the number (from 0) of the run's first line among all lines of the
    text, ``lines`` the number of its lines that have a word. Rows with the same
    doc_id and text are one document.
    """
    single, files = repeated_lines(docs)
    runs = longest_runs(suffix_array(single, files, fold=fold))
    before = F.lag(F.struct("_ld_pos", "run")).over(Window.partitionBy(*_DOC, "_ld_doc").orderBy("_ld_pos"))
    left = runs.withColumn("b", before).where("b IS NULL OR b._ld_pos < _ld_pos - 1 OR b.run <= run")
    at = single.select(*_PLACE, "_ld_at").dropDuplicates(_DOC + ["_ld_pos"])
    found = left.join(at.drop("_ld_doc"), [*_DOC, "_ld_pos"])
    return found.select(F.col("_ld_doc").alias("doc_id"), F.col("_ld_at").alias("line"), F.col("run").alias("lines"))


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, runs: bool = False, fold: int = FOLD) -> DataFrame:
    """``(_ld_k, _ld_l, _ld_del)``: sorted numbers (among all lines) of the deleted lines of each document that has any.

    With ``runs``, also ``_ld_run``, the longest run of the document that stands
    elsewhere too, of documents that have one.
    """
    single, files = repeated_lines(docs)
    levels = suffix_array(single, files, min_lines, fold, runs)
    starts = later_copies(levels, files, min_lines).select(*_DOC, F.explode(F.sequence("_ld_pos", F.col("_ld_pos") + min_lines - 1)).alias("_ld_pos"))
    # Every line of a repeated run is a repeated line, so its number among all lines is at hand.
    in_runs = single.select(*_DOC, "_ld_pos", "_ld_at").join(starts.distinct(), [*_DOC, "_ld_pos"]).select(*_DOC, "_ld_at")
    alone = single.where(F.col("_ld_later") & (F.col("_ld_words") >= min_words)).select(*_DOC, "_ld_at")
    each = in_runs.union(alone)
    if not runs:
        return each.groupBy(*_DOC).agg(F.sort_array(F.collect_set("_ld_at")).alias("_ld_del"))
    each = each.withColumn("run", F.lit(None).cast("long")).unionByName(longest_runs(levels).select(*_DOC, F.lit(None).cast("int").alias("_ld_at"), "run"))
    found = each.groupBy(*_DOC).agg(F.sort_array(F.collect_set("_ld_at")).alias("_ld_del"), F.max("run").alias("_ld_run"))
    return found.withColumn("_ld_del", F.when(F.size("_ld_del") > 0, F.col("_ld_del")))


def without_lines(text: str, gone: str) -> Column:
    """The text without the lines whose sorted numbers are in ``gone``; linear in both."""
    lines = f"split({text}, '\\n')"
    return F.expr(
        f"element_at(transform(array({lines}), ls -> array_join(flatten(transform("
        f"concat({gone}, array(size(ls))), (g, i) -> slice(ls, IF(i = 0, 0, {gone}[i - 1] + 1) + 1, g - IF(i = 0, 0, {gone}[i - 1] + 1)))), '\\n')), 1)"
    )


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, runs: bool = False, fold: int = FOLD) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines deleted from ``text``.

    Adds ``_ld_gone``, the number of lines deleted, ``_ld_lines``, the number of all
    lines before, and with ``runs`` ``_ld_run``, the longest run of the document as it
    was that stands elsewhere too (0: none).
    """
    gone = deleted_lines(docs, min_lines, min_words, runs, fold)
    # A row of numbers for each document that loses lines is hashed; else whole texts would be sorted. A partition of it grows with the lines lost.
    joined = docs.select("*", *_doc_keys()).join(gone.hint("shuffle_hash"), _DOC, "left")
    cols = [F.when(F.col("_ld_del").isNull(), F.col("text")).otherwise(without_lines("text", "_ld_del")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    more = [F.coalesce("_ld_run", F.lit(0)).cast("long").alias("_ld_run")] if runs else []
    return joined.select(*cols, F.coalesce(F.size("_ld_del"), F.lit(0)).alias("_ld_gone"), F.size(F.split("text", "\n")).alias("_ld_lines"), *more)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines kept of every document once later copies of repeated runs are gone, and its longest repeated run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs, runs=True)
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("_ld_lines")).cast("long")
    return done.select(
        "doc_id", lines.alias("n_lines"), F.col("_ld_gone").cast("long").alias("n_removed"), F.col("_ld_run").alias("longest_run"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP10_SQL = """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS num FROM s),
y AS (SELECT doc_id, line, num, len(list_filter(string_split_regex(line, '[ \\t-\\r]+'), lambda w: w <> '')) AS words FROM x),
z AS (SELECT doc_id, line, num, words, row_number() OVER (PARTITION BY doc_id ORDER BY num) AS pos FROM y WHERE words > 0),
p AS (SELECT a.doc_id, a.pos, a.line AS l1, b.line AS l2 FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
q AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY l1, l2 ORDER BY doc_id, pos) AS n FROM p) WHERE n > 1),
g AS (SELECT doc_id, pos FROM q UNION SELECT doc_id, pos + 1 FROM q
  UNION SELECT doc_id, pos FROM (SELECT doc_id, pos, words, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS n FROM z) WHERE n > 1 AND words >= 10),
gone AS (SELECT z.doc_id, list(z.num) AS ats FROM g JOIN z USING (doc_id, pos) GROUP BY z.doc_id),
k AS (SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(len(ats), 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN '' WHEN ats IS NULL THEN d.text
  ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda t, i: NOT list_contains(ats, i)), chr(10)) END AS kept
  FROM documents d LEFT JOIN gone USING (doc_id)),
e AS (SELECT a.doc_id AS da, b.doc_id AS db, a.pos AS pa, a.pos - b.pos AS diagonal FROM z a JOIN z b ON a.line = b.line AND (a.doc_id <> b.doc_id OR a.pos <> b.pos)),
i AS (SELECT da, count(*) AS run FROM (SELECT *, pa - row_number() OVER (PARTITION BY da, db, diagonal ORDER BY pa) AS island FROM e) GROUP BY da, db, diagonal, island),
r AS (SELECT da, max(run) AS run FROM i GROUP BY da)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(coalesce(run, 0) AS BIGINT) AS longest_run, sha256(kept) AS kept_sha256 FROM k LEFT JOIN r ON da = doc_id
"""
