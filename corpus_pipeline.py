"""Corpus pipeline: raw documents to packed training sequences, stage by stage.

Each stage works on all that its predecessor kept. All but the last return the
columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import common, decontaminate, jaccard, language, packing, suffix_array

#: Documents go that score less than three quarters of what all but one in a thousand of
#: the learned documents reach: nothing in them is like any language that was learned.
RARE, LEAST_SHARE = 0.001, 0.75
#: Bytes of strings that are cut out where another document has them. Passages of over fifty words are to
#: go, and of these half have under 400 bytes; fifty words of three letters have 200.
REPEATED = 200


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without a letter, or like no learned language, go.

    Profiles, and the score that is asked for, are learned from all labelled documents of
    the stage's own input. Each text is scored once.
    """
    found = common.stored(language.identify(docs, language.learn(language.train_rows(docs))).filter(F.col("lang_pred") != language.UNKNOWN))
    learned = F.col("lang").isNotNull() & F.col("text").isNotNull() & ~language.held_out("doc_id")
    low = language.quantile(found.filter(learned).select("score"), RARE) or 0.0
    found = found.filter(F.col("score") >= LEAST_SHARE * low)
    return found.select(*map(common.named, docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of linked documents the one with the smallest id stays.

    A document that links with nothing stays, also if it has no id or no text.
    """
    return jaccard.keep_one(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: strings of REPEATED bytes that start in another document too are cut out.

    What a document only repeats itself stays: all places would go, and so text that is
    found nowhere else. A document of which nothing is left goes, unless it was empty before. A character
    that a cut goes through is left out.
    """
    found = suffix_array.remove_repeats(docs, REPEATED, carry=[c for c in docs.columns if c != "text"], across=True)
    kept = found.filter("n_removed = 0 OR n_removed < n_units")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return kept.select(*(new[c].alias(c) if c in new else common.named(c, "row").alias(c) for c in docs.columns))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that copy a segment of a benchmark item go."""
    return decontaminate.clean(docs, common.read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the kept documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", remove_repeated_strings),
    ("benchmark decontamination", drop_benchmark_copies),
    ("best-fit packing", pack_sequences),
]

#: Profiles, alignments and packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    What a stage stored for itself is deleted once its result is written, and that once
    the next stage has read it.
    """
    docs, before = common.read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
