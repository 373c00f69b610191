"""The corpus pipeline: documents through quality rules, toxicity, near-dedup, decontamination and tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import common, decision_list, decontaminate, lattice, simhash, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the base rule or a learned rule rejects go. A null text is empty and goes; repeated rows are judged alike."""
    rules = decision_list.fit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return decision_list.keep_good(docs, rules)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score as toxic go. The model learns from the labelled rows of the whole table, not of what is left. Without
    labels of both classes all stay; a null or empty text has no words that tell and stays; repeated rows are judged alike."""
    model = toxicity.train(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), common.remainder(F.col("id"), 3) != 1)
    return toxicity.keep_ordinary(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: those that links of five-word shingles with a Jaccard similarity of
    0.8 or more connect. A null text, an empty one and one without words are alike; of repeated rows the first stays."""
    return simhash.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which a window of a benchmark item occurs go. A null or empty text has none and stays, all stay without items."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of each text, with its score and that of the next best. A null or empty text has no pieces."""
    return lattice.encode(docs, lattice.load()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_texts),
    ("near_dedup", near_dedup),
    ("decontamination", leaks),
    ("sentencepiece", pieces),
]

#: SQL cannot state learned rules, models and hashes; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.checkpoint(docs)
    return docs
