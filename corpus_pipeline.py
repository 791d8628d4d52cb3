"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last keep the columns of ``documents``. ``run`` writes each stage as Parquet in
the folder the cluster shares and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm import langid, linedup, mixing, packing, scratch, simhash

#: A text is rejected if no language reaches this probability, or if it has no letter.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; a missing ``lang`` is filled in.

    Null, empty and letterless texts go. Rows with the same text share their fate,
    whatever their other columns hold; without any labelled row to learn from, all
    documents go. An empty table stays empty.
    """
    cols = docs.columns
    # The row goes along as one column, so that no name of it meets one of the prediction.
    seen = langid.predict(docs.select("text", F.struct(*cols).alias("_row")), langid.fit(docs), "_row")
    kept = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*(F.coalesce("_row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"_row.`{c}`").alias(c) for c in cols))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those of which no word is left go.

    The first place in order of (doc_id, text hash, line number) keeps its lines, a
    null doc_id comes first. Null texts, and documents that lose no line, stay as they
    are; ``n_chars`` is made anew where lines went. Rows with the same doc_id and text are
    one document and get the same result. An empty table stays empty.
    """
    cols = docs.columns
    done = linedup.dedup_lines(docs)
    left = done.where((F.col("_ld_gone") == 0) | F.col("text").rlike("[^ \t-\r]"))
    return left.withColumn("n_chars", F.when(F.col("_ld_gone") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*cols)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component.

    Texts without a word, null ones too, have the same fingerprint and are one
    component. The kept document is the one of least doc_id (null comes first), then of
    least hash. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture wants them.

    A null source is a source of its own. Documents of small sources come up to four
    times, so copies come back in here, after near-dedup; of large sources some are left
    out. Rows with equal doc_id and text share their fate. A budget is undershot by at
    most one document a source. An empty table stays empty.
    """
    return mixing.mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents in optimal length buckets; a row for each row, whatever repeats.

    Null and empty texts have length 0. An empty table gives no batch.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Language ID by a trained network has no SQL form; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"pipeline-{name.lower().replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
