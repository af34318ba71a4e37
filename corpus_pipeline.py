"""A training-data pipeline over ``documents``: identify, deduplicate twice, mix and tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, language
from marketlens.llm.common import stored
from marketlens.llm.exact_dedup import refine
from marketlens.llm.mixing import mix
from marketlens.llm.queries import vocabulary
from marketlens.llm.paragraphs import near_texts
from marketlens.llm.simhash import near_duplicates


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; texts without a letter and ties between languages go.

    The model learns from the rows with a language outside the held-out fold.
    """
    known = docs.filter(language.remainder("doc_id") != 1).select("text", "lang")
    d = language.identify(docs, language.train(known))
    return d.filter("guess.lang <> 'und' AND NOT guess.ambiguous").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of every group of equal texts."""
    return refine(docs).filter("kept").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of every near-duplicate component, by SimHash under op7's rule (two bits): nearly identical texts only.

    ``drop_similar`` finds all that are similar.
    """
    return near_duplicates(docs).filter("kept").select("doc.*")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of every component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; no stage of ``STAGES``."""
    return near_texts(docs).filter("kept").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: up to three times, or not at all."""
    return mix(docs).select(F.explode(F.array_repeat("doc", F.col("times"))).alias("doc")).select("doc.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, with the ids themselves."""
    d = bpe.encode(docs, vocabulary("byte_bpe_50k.json"), carry=["doc_id", "lang", "source"])
    return d.select("doc.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("language ID", identify), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies), ("source mix", mix_sources), ("BPE", tokenise)]

#: Fingerprints by XXH64 with a seed, language codes and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
