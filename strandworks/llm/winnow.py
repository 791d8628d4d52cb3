"""Operator 4, document fingerprints by winnowing. DataFrame functions only.

A text's words (runs of characters outside ``\\x20\\x09-\\x0D``) are hashed; every
run of ``K`` words is a gram with a polynomial hash of its words, as rolling from gram
to gram gives it (62 bits, see ``rolled``); of every ``W`` consecutive grams the one of least hash is chosen, the rightmost on ties. Chosen hashes are
kept with their positions. Any run of ``K + W - 1`` or more words that two texts
share gives them a common chosen hash.

Words do not serve texts of few words or of long unspaced ones. So the words over
``LONG`` code points, or all words of a text of under ``2 * (K + W - 1)``, joined by
blanks, give grams of ``CHARS`` code points too, one chosen of ``CHARS_W`` in turn;
where there are under ``SMALL`` code points, all of these and all grams of
``FEW_CHARS`` are kept.

Likeness is the Jaccard index of the sets of chosen hashes; two texts without
any word are alike (1.0).

The neighbour of a document, in descending doc_id, is found without a global
sort in one task: documents are cut into doc_id ranges of some thousand rows by
quantiles (an id that many rows have, null too, in parts by text hash), each range
gets a copy of the first document of the next one, and the rest is a window function
within the range. Text is shuffled once.

Edge cases: null text counts as empty; fewer than K words make one gram; fewer
than W grams make one window; an edited text of under 6 code points may share
nothing with the text; a null doc_id comes after all others; of equal
doc_ids the smaller text hash comes first; an only document is its own
neighbour; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
W = 4
LONG = 16
CHARS = 12
CHARS_W = 8
SMALL = 64
FEW_CHARS = 4
RANGE_ROWS = 2000
MAX_RANGES = 65_536
PRIME = (1 << 31) - 1
BASES = (1_000_003, 16_777_619)
_FINE = 64
_WHITE = "[ \t-\r]+"
_LEAST_ID = -(1 << 63)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _WHITE), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def residues(hashes: Column) -> Column:
    """The two residues of each 64-bit hash, 31 bits each, in one number."""
    return F.transform(hashes, lambda h: h.bitwiseAND(F.lit((1 << 62) - 1).cast("long")))


def _joined(left: str, right: str, m: int, r: int) -> Column:
    """Gram hashes of ``m + r`` words from those of ``m`` words and those of the ``r`` words behind them."""
    x, y = f"{left}[i]", f"{right}[i + {m}]"
    high = f"(shiftright({x}, 31) * {pow(BASES[0], r, PRIME)}L + shiftright({y}, 31)) % {PRIME}L"
    low = f"(({x} & {PRIME}L) * {pow(BASES[1], r, PRIME)}L + ({y} & {PRIME}L)) % {PRIME}L"
    return F.expr(f"IF(size({left}) > {r}, transform(sequence(0, size({left}) - {r + 1}), i -> shiftleft({high}, 31) | {low}), array())").cast("array<long>")


def rolled(df: DataFrame, words: str, ks: dict[int, str]) -> DataFrame:
    """Add a column of gram hashes for each k of ``ks`` (k and column name) to an array column of residues.

    The hash of words w1 .. wk is w1 * B ** (k - 1) + ... + wk modulo PRIME, for each of
    two bases: the value that rolling from one gram to the next gives. Arrays cannot
    carry a running value, so hashes of 2m words come from two of m words, one
    multiplication each: the work for a gram grows with the logarithm of k. All words
    make one gram where there are fewer than k.
    """
    have, step = {1: words}, df

    def level(k: int) -> str:
        nonlocal step
        if k not in have:
            m = k // 2 if k & (k - 1) == 0 else 1 << (k.bit_length() - 1)
            left, right = level(m), level(k - m)
            have[k] = f"{words}_{k}"
            step = step.withColumn(have[k], _joined(left, right, m, k - m))
        return have[k]

    for k, name in ks.items():
        found = level(k)
        step = step.withColumn(name, F.expr(f"CASE WHEN size({words}) >= {k} THEN {found} WHEN size({words}) > 0 THEN array(xxhash64({words})) ELSE array() END").cast("array<long>"))
    return step.drop(*(name for m, name in have.items() if m > 1))


def chosen_positions(grams: str, w: int = W) -> Column:
    """Positions of the grams that winnowing chooses, ascending.

    Within a window, hashes are compared without their low bits, which hold the
    distance from the right end instead: the least value is the rightmost minimum.
    """
    low = (1 << (w - 1).bit_length()) - 1
    packed = ", ".join(f"(({grams}[i + {j}] & {~low}L) | {w - 1 - j}L)" for j in range(w))
    least = f"least({packed})" if w > 1 else packed
    short = f"transform({grams}, (g, j) -> ((g & {~low}L) | cast(size({grams}) - 1 - j AS BIGINT)))"
    return F.expr(
        f"CASE WHEN size({grams}) >= {w} THEN array_distinct(transform(sequence(0, size({grams}) - {w}), i -> i + {w - 1} - cast({least} & {low}L AS INT))) "
        f"WHEN size({grams}) > 0 THEN array(size({grams}) - 1 - cast(array_min({short}) & {low}L AS INT)) ELSE array() END"
    ).cast("array<int>")


def winnow(df: DataFrame, text: str, prefix: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``<prefix>hash`` and ``<prefix>pos``: chosen hashes and their positions."""
    step = rolled(df.withColumn(f"{prefix}w", residues(word_hashes(F.col(text)))), f"{prefix}w", {k: f"{prefix}g"})
    step = step.withColumn(f"{prefix}pos", chosen_positions(f"{prefix}g", w))
    return step.withColumn(f"{prefix}hash", F.expr(f"transform({prefix}pos, p -> {prefix}g[p])")).drop(f"{prefix}w", f"{prefix}g")


def fingerprint(df: DataFrame, text: str, prefix: str, k: int = K, w: int = W) -> DataFrame:
    """:func:`winnow` with the character grams of long words and of short texts behind the word grams."""
    p = prefix
    step = df.withColumn(f"{p}s", words_of(F.col(text))).withColumn(f"{p}w", residues(F.transform(f"{p}s", lambda x: F.xxhash64(x))))
    few = F.size(f"{p}s") < 2 * (k + w - 1)
    stretch = F.array_join(F.filter(f"{p}s", lambda x: few | (F.char_length(x) > LONG)), " ")
    step = step.withColumn(f"{p}c", residues(F.transform(F.filter(F.split(stretch, ""), lambda x: x != ""), lambda x: F.xxhash64(x)))).drop(f"{p}s")
    small = F.size(f"{p}c") < SMALL
    none = F.array().cast("array<long>")
    step = rolled(rolled(step, f"{p}w", {k: f"{p}g"}), f"{p}c", {CHARS: f"{p}cg", FEW_CHARS: f"{p}fg"})
    step = step.withColumn(f"{p}fg", F.when(small, F.col(f"{p}fg")).otherwise(none))
    every = F.expr(f"IF(size({p}cg) > 0, sequence(0, size({p}cg) - 1), array())").cast("array<int>")
    step = step.withColumn(f"{p}wpos", chosen_positions(f"{p}g", w)).withColumn(f"{p}cpos", F.when(small, every).otherwise(chosen_positions(f"{p}cg", CHARS_W)))
    step = step.withColumn(f"{p}hash", F.expr(f"concat(transform({p}wpos, i -> {p}g[i]), transform({p}cpos, i -> {p}cg[i]), {p}fg)"))
    step = step.withColumn(f"{p}pos", F.expr(f"concat({p}wpos, {p}cpos, transform({p}fg, (g, i) -> i))"))
    return step.drop(*(f"{p}{c}" for c in ("w", "c", "g", "cg", "fg", "wpos", "cpos")))


def digest(prefix: str) -> Column:
    """128 bits over chosen hashes and positions, as hexadecimal digits."""
    halves = [F.lower(F.lpad(F.hex(F.xxhash64(F.lit(s), f"{prefix}hash", f"{prefix}pos")), 16, "0")) for s in (1, 2)]
    return F.concat(*halves)


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two arrays as sets; 1.0 for two empty ones."""
    return F.expr(f"IF(size({a}) = 0 AND size({b}) = 0, 1D, size(array_intersect({a}, {b})) / CAST(size(array_union({a}, {b})) AS DOUBLE))")


def _with_range(docs: DataFrame) -> tuple[DataFrame, list]:
    """Documents with the number of their range, and each range with the did and tie of its first document, lowest range first.

    Ranges are cut at quantiles of did. A did that fills several quantiles is cut on by
    tie, in as many parts, so that rows without an id are not one range.
    """
    ids = docs.select("did")
    n = ids.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    cuts = [] if ranges == 1 else ids.agg(F.percentile_approx("did", [i / ranges for i in range(1, ranges)], max(10_000, 8 * ranges))).first()[0]
    times = Counter(cuts or [])
    bounds = sorted(times)
    parts = max((c + 1 for c in times.values() if c > 1), default=1)
    if not bounds:
        number, sub = F.lit(0), F.lit(0)
    else:
        fine = max(_FINE, math.isqrt(len(bounds)))
        # numbers as one literal, which the optimizer folds to an array
        all_, coarse, many = (F.split(F.lit(",".join(map(str, some))), ",").cast(f"array<{t}>") for some, t in ((bounds, "long"), (bounds[fine - 1 :: fine] or bounds[-1:], "long"), ([times[b] for b in bounds], "int")))
        if len(bounds) < fine:
            number = F.size(F.filter(all_, lambda b: b <= F.col("did")))
        else:
            major = F.size(F.filter(coarse, lambda b: b <= F.col("did"))) * fine
            number = major + F.size(F.filter(F.slice(all_, major + 1, F.lit(fine)), lambda b: b <= F.col("did")))
        at = F.get(all_, F.col("_number") - 1)
        # Ties are even over the 64-bit numbers; the least of them come first, so they get the highest part.
        share = F.get(many, F.col("_number") - 1)
        sub = F.when((at == F.col("did")) & (share > 1), share - 1 - F.floor((F.shiftright("tie", 32) + (1 << 31)) * share / (1 << 32))).otherwise(parts - 1)
    ranged = docs.withColumn("_number", number).withColumn("range", (F.col("_number") * parts + sub).cast("int")).drop("_number")
    # did falls and tie rises along the order: the greatest of (did, not tie) comes first
    heads = ranged.groupBy("range").agg(F.max(F.struct("did", F.bitwise_not("tie").alias("late"))).alias("h")).select("range", "h.did", F.bitwise_not("h.late").alias("tie"))
    return ranged, sorted(heads.collect(), key=lambda r: r["range"])  # at most 2 * MAX_RANGES rows of numbers


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, did, range, tie, next_text)`` in descending doc_id; after the last comes the first.

    The table of range heads is broadcast: at most 2 * MAX_RANGES rows of three numbers.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("did", F.coalesce("doc_id", F.lit(_LEAST_ID).cast("long"))).withColumn("tie", F.xxhash64("text"))
    ranged, heads = _with_range(rows)
    if not heads:
        return rows.select("*", F.lit(0).alias("range"), F.lit(None).cast("string").alias("next_text"), F.lit(False).alias("guest"))
    to = [(r["did"], r["tie"], heads[(i + 1) % len(heads)]["range"]) for i, r in enumerate(heads)]  # a range's head goes to the range above
    sent_to = docs.sparkSession.createDataFrame(to, "did long, tie long, range int")
    guests = rows.join(F.broadcast(sent_to), ["did", "tie"]).groupBy("range").agg(F.min(F.struct("did", "tie", "doc_id", "text")).alias("h"))
    own = ranged.select("doc_id", "text", "did", "range", "tie", F.lit(False).alias("guest"))
    guest = guests.select("h.doc_id", "h.text", "h.did", "range", F.lit(0).cast("long").alias("tie"), F.lit(True).alias("guest"))
    order = Window.partitionBy("range").orderBy("guest", F.desc("did"), "tie")
    return own.unionByName(guest).withColumn("next_text", F.lead("text").over(order))


def fingerprint_report(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses (see ``op4_winnowing``).

    ``hashes`` and ``positions`` are the chosen grams of the text and where they start:
    in words for word grams, then in code points of the joined long or few words.
    """
    order = Window.partitionBy("range").orderBy("guest", F.desc("did"), "tie")
    own = fingerprint(with_next(docs), "text", "a_", k, w).withColumn("n_hash", F.lead("a_hash").over(order)).where("NOT guest")
    cut = F.floor(F.char_length("text") / 3).cast("int")
    own = own.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    )
    both = fingerprint(own.drop("text", "next_text"), "edited", "e_", k, w)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("a_").alias("fingerprint"), digest("e_").alias("edited_fingerprint"),
        likeness("a_hash", "e_hash").alias("near_edited"), likeness("a_hash", "n_hash").alias("near_next"), F.size("a_hash").alias("n_chosen"), F.col("a_hash").alias("hashes"), F.col("a_pos").alias("positions"),
    )


def op4_winnowing(spark, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of all documents and of their edited texts."""
    return fingerprint_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
