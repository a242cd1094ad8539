"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import jaccard, language, mixing, packing, secrets
from driftline.llm.queries import language_model, vocabulary
from driftline.session import materialise, ship_package

#: Below this calibrated probability a document has no clear language. One of four at random would have 0.25.
MIN_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a clear language, go."""
    ship_package(spark)
    return language.speaks(docs, language_model(docs), MIN_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ship_package(spark)
    return jaccard.one_of_each_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows it. No document goes."""
    ship_package(spark)
    model = secrets.fit(*secrets.labelled_sample(docs))
    return secrets.redacted(docs, model).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target shares: a document is repeated as often as the mix takes it, whole."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, filled with lexically near documents."""
    ship_package(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan),
          ("mixing sources to target weights", mix), ("packing", pack)]

#: SQL cannot express the trained stages or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
