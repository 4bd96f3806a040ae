"""From documents to packed training sequences: five stages, each on all that the one before kept.

toxicity          documents that the factorization machine rejects go
simhash           of each group of near duplicates the one with the smallest doc_id stays; fingerprints of five-word shingles that
                  differ in at most 5 of 64 bits link (the README says which share of 0.8-similar texts that finds)
decontamination   documents that repeat a test item go
secrets           spans that the scan finds are replaced by a mark; the documents stay
packing           what is left, as pieces of sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import decontaminate, packing, secrets, simhash, toxicity
from maskwright.llm.common import dropped, finished, table
from maskwright.llm.words import tokenizer_path

#: Trained and pairwise stages have no SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None
#: three segments find all pairs of up to 5 differing bits, at the price of 4
NEAR_WORDS, NEAR_BITS = 5, 5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.fitted(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.accepted(docs, machine)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, distance=NEAR_BITS, shingle=NEAR_WORDS)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("decontamination", without_test_items),
    ("secrets", without_secrets),
    ("packing", in_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next one stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = finished(spark, lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023
        if before is not None:
            dropped(before)
        before = docs
    return docs
