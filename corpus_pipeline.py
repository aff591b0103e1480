"""A training-data pipeline over ``documents``: each stage reads what its predecessor wrote.

Language ID drops texts without a recognised language; exact dedup keeps one of each set of
equal texts, and the Jaccard join one of each group of near copies; decontamination cuts
benchmark passages, or drops a document that is mostly benchmark; byte-level BPE encodes what
is left and decodes it again.

Rows, not ids, are what stages keep or drop. Null and empty texts have no language and go with
the first stage. Rows that share an id but not their text are documents of their own; of rows that
repeat both, all stay or all go. Rows without an id are copies of any equal text that has one, and
are in no group of near copies. All columns of documents are carried, extra ones and those whose
names clash with an operator's, too; the last stage names its own. Empty tables give empty tables.
A stage's table goes when the next one is written; the last one's input stays for its lazy result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, exact_dedup, jaccard, langid
from corvane.llm.batches import delete, shared_dir, shuffles_end
from corvane.llm.queries import table, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the classifier learns from labelled documents."""
    seen = langid.identify(docs, langid.fit(docs), out="_corvane_language")
    return seen.where(~F.col("_corvane_language.rejected")).drop("_corvane_language")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one with the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word Jaccard similarity 0.8 join: the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and whether they decode to the text's bytes."""
    path, pattern = vocabulary()
    both = bpe.round_trip(docs, path, pattern)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("raw") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near), ("benchmark_decontamination", benchmark_free), ("byte_bpe", tokens)]

#: Compression sizes can't be had in SQL, so neither can the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with shuffles_end(spark):
            found.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
