"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept; ``run`` writes every stage as
Parquet and reads it again, so a stage never depends on another's lineage.

Defined cases, for every stage: a null text counts as empty, so quality rules
reject it, near duplicates and decontamination keep it, and it is packed as the
end token alone; a document with a null id is judged by its text and never
removed as a copy; of rows equal in id and text near duplicates keep one, and
rows that share an id are each judged by their own text; other columns of any
name pass through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontam, near_dup, packing, pii, quality
from siftwell.llm.common import cut, table
from siftwell.llm.queries import PII_KEY, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return near_dup.keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; n_chars follows the new text."""
    replaced = pii.replace_pii(docs, key=PII_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    pieces = packing.token_pieces(docs, tokenizer_path(), capacity=4096, end_id=1)
    return packing.pack(pieces, capacity=4096).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii surrogates", pii_surrogates),
    ("best-fit packing", best_fit_packing),
]

#: Hashed n-gram scores, MinHash, tokenisation and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
