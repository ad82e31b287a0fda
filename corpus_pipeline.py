"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, langid, mixing, packing, simhash, tokens
from graphloom.llm.base import fresh, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A document goes if it has no letter, or if its pooled probability is below LEAST of the way from chance (one by the
#: number of languages) to certainty by SURE standard errors, which short texts have large ones of.
LEAST, SURE = 0.13, 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) and those of no language that the model knows. Where no
    document has a language to learn from, only those without a letter go."""
    model = langid.fit(docs)
    lang, score, error = (fresh(docs, n) for n in ("__lang", "__score", "__error"))
    if not model.languages:
        return docs.where(F.coalesce("text", F.lit("")).rlike("\\p{L}"))
    chance = 1 / len(model.languages)
    found = langid.annotate(docs, model, names=(lang, score, error))
    doubtful = F.col(score) + SURE * F.col(error) < chance + LEAST * (1 - chance)
    return found.where((F.col(lang) != langid.UNDETERMINED) & ~doubtful).drop(lang, score, error)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, that of the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near-duplicates: sets of five-word shingles, similarity 0.8 or
    more. Rows with a null doc_id are in no component and stay."""
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of the smaller languages towards tempered target weights; none is read less than once."""
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    return mixing.mixed(docs, labelled, temperature=0.7, floor=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, n_tokens, bucket, bucket_len, batch, slot."""
    return packing.pack(tokens.token_counts(docs)).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: A trained network and components over hashed fingerprints are not expressible in SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
