"""A training-corpus pipeline: toxicity, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, decontam, linededup, simhash, toxicity
from lodestrata.llm.common import shared_folder, table
from lodestrata.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the bounded sample of labelled rows, doesn't reject.

    Null and empty texts are scored like others; repeated rows go or stay together; without labels of both kinds every
    score is the smoothed share of toxic labels. An empty table gives an empty result.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on several sources, but for each line's first occurrence.

    A null text stays null, one whose lines all go becomes empty; rows that repeat the first occurrence's id and text keep the
    line in each. No document goes; an empty table stays empty.
    """
    return linededup.drop_boilerplate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest ``doc_id``, of each group of near-duplicate fingerprints.

    Texts without words have fingerprint zero and are one group, null texts among them; of repeated rows one stays. An empty table
    gives an empty result.
    """
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule clears. Null and empty texts have no words and stay; repeated rows go or stay together; an empty
    benchmark clears all."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts and of what their ids decode to; a null text is empty, repeated rows repeat."""
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.json"), ranks=tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("bpe", encode)]

#: Boosted trees, fingerprints and BPE aren't expressible in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = f"{folder}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
