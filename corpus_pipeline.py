"""The training-corpus pipeline: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Whatever rows come in, a stage works on all of them: null or
empty texts, repeated rows and further columns included (each operator's module states
how). An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, langid, mixing, simhash, toxicity
from tallyspark.llm.arrays import fresh, small_batches
from tallyspark.llm.queries import MIX_WEIGHTS, RANKS
from tallyspark.llm.saved import drop, saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in the language that they name.

    Those without one go (``und``: null text, no letter), and so do mislabelled ones: the
    text is clearly, not ambiguously, in another language than the document says. A
    document that names none, or one that wasn't learned, stays in whatever language it is.
    """
    model = langid.train(docs)
    found = fresh(docs, "language_found")
    judged = docs.withColumn(found, langid.language_column(model, spark)(F.col("text").cast("string")))
    told = F.col("lang").isin(model.languages) & ~F.col(f"{found}.ambiguous")
    mislabelled = F.coalesce(told & (F.col(f"{found}.lang_pred") != F.col("lang")), F.lit(False))
    return judged.where((F.col(f"{found}.lang_pred") != langid.UNDETERMINED) & ~mislabelled).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below the threshold."""
    small_batches(spark)
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "toxicity_score")
    judged = docs.withColumn(score, toxicity.toxicity_column(net, spark)(F.col("text").cast("string")))
    return judged.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the least id, of each group of near-duplicates."""
    return simhash.one_per_component(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target says."""
    return mixing.mix_sources(docs, MIX_WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document and decodes it again: doc_id, n_tokens and digests of ids and text."""
    return bpe.token_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("toxicity", toxic), ("simhash_dedup", near_duplicates), ("source_mixing", mixture), ("byte_bpe", tokens)]

#: SQL can express neither the models nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one has written goes when the next has."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if written is not None:
            drop(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
