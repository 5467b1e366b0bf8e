"""From raw documents to encoded training text: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import language, mixing, queries, secret_scan, simhash
from plumbline.llm.frames import settle, spare_name

#: label of letters in no language, learned from training texts with the letters of each word shuffled
NO_LANGUAGE = "zxx"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language.

    Those without a letter go, and those whose words look more like shuffled
    letters than held-out labelled documents do: the limit on that share is
    found when the model is trained (``language.Model.noise_limit``). Without
    labelled documents nothing is learned and only texts without a letter go.
    """
    lang, score, noise = (spare_name(docs, name) for name in ("lang_found", "lang_score", "lang_noise"))
    model = queries.language_model(docs, noise=NO_LANGUAGE)
    found = language.identify(docs, model, lang=lang, score=score, noise=noise)
    read = F.col(lang) != language.UNKNOWN if model.labels else language.has_letter("text")
    return found.where(read & (F.col(noise) <= model.noise_limit)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    spans = spare_name(docs, "spans")
    found = secret_scan.redact(secret_scan.find_secrets(docs, spans=spans), spans=spans)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return found.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every row and of the text decoded from them."""
    return queries.encoding_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("bpe_encoding", encode),
]

#: SQL has neither the language model nor the fingerprints' hash, the cube method or the encoding
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
