"""From raw documents to token ids: five stages, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.language import UNDETERMINED, identify_languages, learn_languages
from factloom.llm.lines import drop_common_lines
from factloom.llm.mixing import mix_documents, word_count
from factloom.llm.near_texts import drop_near_texts
from factloom.llm.pieces import encode_pieces
from factloom.llm.queries import ALPHAS, RATE, with_topics
from factloom.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of letters in the main language.
LEAST_SCORE = 0.5
#: Text worked on at once by the last stage, whose workers still hold what earlier stages took.
BLOCK_BYTES = 3_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a main language, go; a missing lang is filled in."""
    judged = identify_languages(docs, learn_languages(docs), carry=COLUMNS)
    kept = judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one of them."""
    return drop_common_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Candidates by SimHash and MinHash; of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 one row stays."""
    return drop_near_texts(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens that meets the target shares of sources, languages and topics; no document twice."""
    counted = docs.select(*COLUMNS, word_count(F.col("text")).alias("n_words"))
    topics = with_topics(counted, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # Near duplicates are gone, so that id and text tell rows apart: each is drawn for itself.
    draw = F.concat_ws(":", "doc_id", F.xxhash64("text").cast("string"))
    mixed = mix_documents(topics, ALPHAS, rate=RATE, once=True, tokens=F.col("n_words"), carry=COLUMNS, draw=draw)
    return mixed.where("copies > 0").select(*COLUMNS)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(docs, model, carry=("doc_id", "lang", "source"), block_bytes=BLOCK_BYTES)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("mixing", mix_sources),
    ("pieces", encode_documents),
]

#: Language identification and tokenization are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
