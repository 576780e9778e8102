"""Corpus pipeline: documents to token ids in five stages, each written as Parquet and read again by the next.

Toxic texts go, one of each group of near copies stays, contaminated texts go, secrets are blotted out, and what is left
is encoded (and decoded again, which tells whether the ids hold the whole text). Every stage works on all rows that the
one before kept. All but the last return the columns of ``documents``; repeated rows are near copies of each other, null
texts count as empty, and an empty table goes through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm import bpe, decontaminate, registry, secrets, simhash, toxicity
from driftfield.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below one half; the classifier is trained on the stage's own documents and the table of labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, made="__score").where(F.col("__score") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are similar to 0.8 or more."""
    return simhash.near_copies(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a window of eight benchmark words and without windows of two items or more."""
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("full") & (F.size("items") < 2)).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, ``ids`` and ``whole``: whether the ids decode to the text."""
    codec = bpe.Codec(spark, registry.tokenizer_file(), bpe.frequent_words(docs))
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]
    coded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")), codec, made, bpe.ids_and_digests)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded_sha256") == F.sha2("text", 256)).alias("whole"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("bpe", encode)]

#: A trained classifier and a tokenizer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
