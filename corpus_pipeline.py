"""The corpus pipeline: quality rules, language ID, n-gram Jaccard join, substring dedup, packing.

Each stage takes all rows that the one before kept. The first four return the columns of `documents`; the last returns
pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.llm import language, packing, quality, similar, substrings
from brackwater.session import cut_lineage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees (learnt from `labels`) keep."""
    return quality.keep_good(docs, quality.fit_trees(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart from the runner-up."""
    return language.keep_sure(docs, language.fit_dictionaries(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies."""
    return similar.one_of_each(docs, similar.jaccard_join(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id has; one that loses all words stays, empty."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    parsed = substrings.remove_repeats(docs, carry=others)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text")} | {c: F.col("carried")[c].alias(c) for c in others}
    if "n_chars" in made:
        made["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return parsed.select(*[made[c] for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents' tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("ngram_jaccard_join", ngram_jaccard_join), ("substring_dedup", substring_dedup), ("packing", pack)]

# Trees, compression and sub-word merges are not SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
