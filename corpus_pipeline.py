"""The corpus pipeline: documents in, packed training windows out, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last keep the columns of documents.  Every stage calls one operator of colophon.llm.

Edge cases: null, empty and short texts fail the rules and go in the first stage; very long texts are read whole; null
doc_ids keep their rows as far as their texts do; of repeated rows, and of different rows with one doc_id, each is judged
by its text, and of equal or near texts one row stays; an empty table gives an empty result; without labelled rows the
classifier's scores are all 0.5, which passes; extra columns, whatever their names, are kept up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colophon.llm import classifier, decontamination, jaccard, packing, rules
from colophon.llm.common import discard, materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules."""
    return rules.apply(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network accepts; it learns from those of the labelled ones that this stage was given."""
    return classifier.apply(docs, classifier.train(docs, read_table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.deduplicate(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontamination.remove(docs, read_table(spark, sf_dir, "benchmark"))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training windows."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", retrieval_packing),
]
#: SQL can't express the network, the packing and others; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's table is deleted when the next one's is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage{number}")
            if before is not None:
                discard(before)
            before = docs
    return docs
