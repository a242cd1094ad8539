"""The queries of this subpackage with the SQL that checks them, where SQL can."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import conversations as conversations_op
from driftline.llm import fertility as fertility_op
from driftline.llm import hard_negatives as hard_negatives_op
from driftline.llm import jaccard as jaccard_op
from driftline.llm import language as language_op
from driftline.llm import licenses as licenses_op
from driftline.llm import mixing as mixing_op
from driftline.llm import neighbours as neighbours_op
from driftline.llm import packing as packing_op
from driftline.llm import personal as personal_op
from driftline.llm import secrets as secrets_op
from driftline.llm import separators as separators_op
from driftline.llm import suffixes as suffixes_op
from driftline.llm.conversations_sql import repair_sql
from driftline.plans.registry import Entry, Query, table
from driftline.session import materialise

LLM_QUERIES: dict[str, Entry] = {}


def llm_query(sql: str | None = None):
    def add(fn: Query) -> Query:
        LLM_QUERIES[fn.__name__] = Entry(fn, sql)
        return fn
    return add


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies; the folder can be set in the environment."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return str(public_tokenizers.path(name))


@llm_query()
def op5_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_op.fertility(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "script", "n_tokens", "chars_per_token", "byte_share", "entropy_share")


@llm_query()
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets_op.fit(*secrets_op.labelled_sample(docs))
    return secrets_op.secrets(docs, model).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 1; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_model(docs: DataFrame) -> language_op.LanguageModel:
    return language_op.fit(docs.where(~held_out(F.col("doc_id"))))


@llm_query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (language_op.predict(docs, language_model(docs))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


@llm_query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_op.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@llm_query(mixing_op.mix_sql())
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_op.mix(table(spark, sf_dir, "documents"))


@llm_query()
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses_op.scan(table(spark, sf_dir, "documents"))


@llm_query()
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_op.jaccard_components(table(spark, sf_dir, "documents"))


@llm_query()
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours_op.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@llm_query()
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes_op.deduplicate(table(spark, sf_dir, "documents"))


SEPARATOR = 49_408  # the first id the vocabulary leaves free, so no text can hold it


@llm_query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as flat token streams, and every document's place and size found again by its separator."""
    stream = materialise(separators_op.write_stream(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), SEPARATOR))
    return separators_op.separator_scan(stream, SEPARATOR).select("doc_id", "n_tokens", "stream", "ordinal", "start")


@llm_query(repair_sql())
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations damaged, then repaired."""
    rows = conversations_op.damaged(table(spark, sf_dir, "conversations"))
    return conversations_op.audits(rows).drop("most_unresolved")


@llm_query(hard_negatives_op.mine_sql())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels are moved first, so that classes overlap; anchors are the rows whose id is divisible by 50."""
    vec_id, label = F.col("vec_id"), F.col("label")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives_op.mine(vectors, vec_id % 50 == 0)


@llm_query()
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and the field, fitted to a bounded sample of the same documents."""
    docs = table(spark, sf_dir, "documents")
    return personal_op.digests(personal_op.personal_spans(docs, personal_op.fit(docs)))
