"""From raw documents to tokens: quality rules, near-duplicates, pseudonyms, mixing, encoding.

Each stage takes the documents that the one before kept, as a written table, and returns documents; the last returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm import minhash, mixing, pieces, pii, quality
from wayside.llm.catalogue import piece_digests, piece_model, pii_secret
from wayside.session import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the certified cutoffs keep."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Of rows that repeat id and text one stays; rows without id are linked with nothing and stay.
    """
    found = minhash.near_duplicates(docs)
    kept = found.where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    done = pii.pseudonymize(docs, pii_secret(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row per row of the mix."""
    return piece_digests(pieces.encode(docs.select("doc_id", "text"), piece_model()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Certified cutoffs, hashing and the tokenizer have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
