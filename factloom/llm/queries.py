"""The dealt operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import oracle
from factloom.llm.exact_search import nearest_by_product
from factloom.llm.language import identify_languages, learn_languages
from factloom.llm.licenses import scan_licenses
from factloom.llm.lines import drop_common_lines
from factloom.llm.merkle import hex_text, leaf_digest, merkle_manifest, path_digest, verified_manifest
from factloom.llm.mixing import mix_documents, word_count
from factloom.llm.neighbours import near_duplicate_vectors
from factloom.llm.outliers import judge_documents
from factloom.llm.phrases import collocations
from factloom.llm.pieces import encode_pieces, piece_digests
from factloom.llm.shards import shard_documents
from factloom.llm.simhash import simhash_groups
from factloom.llm.token_files import read_token_files, token_digests, write_token_files
from factloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
#: Target of a dim: its share of tokens to this power.
ALPHAS = {"source": 0.7, "lang": 0.8, "topic": 0.8}
#: Tokens wanted, relative to all.
RATE = 0.5


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, spread over the cores if it is one small file."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def with_topics(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Topic of a document: the label of the embedding with its id, the smallest if there are several."""
    labels = embeddings.groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("label").alias("topic"))
    return docs.drop("topic").join(labels, "doc_id", "left")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # Words are counted where texts are read: only the counts meet the topics.
    docs = docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("n_tokens"))
    docs = with_topics(docs, spark.read.parquet(f"{folder}/embeddings.parquet"))
    mixed = mix_documents(docs, ALPHAS, rate=RATE, tokens=F.col("n_tokens"))
    return mixed.withColumn("expected", F.round("expected", 4))


def op2_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_documents(_table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op3_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, folder, "embeddings"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = drop_common_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_groups(_table(spark, folder, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{folder}/documents.parquet"))


def op7_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = learn_languages(docs.where(~held_out))
    found = identify_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    write_token_files(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return token_digests(read_token_files(spark, out))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(document_files(_table(spark, folder, "documents")))
    return found.withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / thousands / hundreds. Each tenth one takes the name of a licence
    file, so that directories have something to inherit from."""
    numbers = [F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100)]
    start = F.when(F.col("doc_id") % 10 == 0, "LICENSE-").otherwise("text-")
    name = F.concat(start, F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.concat_ws("/", F.coalesce("source", F.lit("unknown")), *numbers, name).alias("path"), "text")


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_digests(encode_pieces(_table(spark, folder, "documents"), model), model)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh document, by the checksum of its id, claims to be one character longer than it is."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    manifest = merkle_manifest(
        spark.read.parquet(f"{folder}/documents.parquet"),
        ["doc_id", "source", "lang", "n_chars", "text"],
        scope="lang",
        order="doc_id",
        carry={"claim": F.when(tampered, claim)},
    )
    checked = verified_manifest(manifest, F.coalesce("claim", "leaf"))
    digests = [hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    return checked.select("doc_id", *digests, path_digest(F.col("path"), F.col("top_path")).alias("proof_sha256"), "verified")


def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations(_table(spark, folder, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return nearest_by_product(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_robust_outliers, op3_nn_descent, op4_line_dedup, op5_simhash, op6_shards, op7_languages,
        op8_token_files, op9_licenses, op10_pieces, op11_merkle_manifest, op12_phrase_mining, op13_exact_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": oracle.mixing(ALPHAS, RATE),
    "op4_line_dedup": oracle.LINE_DEDUP,
    "op11_merkle_manifest": oracle.MERKLE,
    "op12_phrase_mining": oracle.PHRASES,
    "op13_exact_search": oracle.EXACT_SEARCH,
}
