"""The queries of this subpackage: each operator over its whole table, and digests of its output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import (
    bpe, compression_quality, divergence, embed_dedup, language_id, mixing, near_dedup, prefix_counts, pseudonyms, secret_scan,
    spelling, topk, warc)
from jobsift.llm.terms import lower_runs

#: Runs of letters, the share of them that loses a code point, and what makes a run a word.
RUN = r"[A-Za-z\u00C0-\u00FF]+"
WORN, LEAST_LENGTH, LEAST_COUNT = 199, 6, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The secret key of pseudonyms; the default is for tests only."""
    return spark.conf.get("spark.jobsift.pseudonym.key", "test key, set spark.jobsift.pseudonym.key")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A repository is a text: copies of it are one.
    docs = table(spark, sf_dir, "documents").withColumn("repository", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    found = secret_scan.scan_secrets(docs, repository_col="repository")
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.written(secret_scan.base_only(F.col("spans"))), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"), "n_opaque", "n_live", "n_shared")


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.assign_positions(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_text_model(docs, "doc_id", "text", "lang")
    none = F.lit(None).cast("string")
    labelled = docs.select(
        F.lit("document").alias("kind"), "doc_id", F.col("lang").alias("declared"), F.col("source").alias("host"),
        none.alias("domain"), none.alias("suffix"), "text")
    pages = language_id.page_evidence(table(spark, sf_dir, "pages")).withColumn("kind", F.lit("page")).withColumnRenamed("id", "page_id")
    rows = labelled.unionByName(pages, allowMissingColumns=True)
    found = language_id.identify(rows, model, "doc_id", "text", "declared", "host", "domain", "suffix", keep=("kind", "page_id"))
    return found.select(
        "kind", F.col("id").alias("doc_id"), "page_id", "language", "text_language", F.round("confidence", 6).alias("confidence"),
        F.col("accepted").alias("kept"))


def op4_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search_top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.count_prefixes(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, ["doc_id"])
    return bpe.decode(encoded, path, ["doc_id"]).select(
        "doc_id", (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return records.withColumnRenamed("id", "page_id")


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, pii_key(spark), count_col="n_pseudonyms")


def op10_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the runs of letters; one run of a document in ``WORN`` or so has lost a code point.

    Null texts have no runs; a null id is written as ''.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(lower_runs(F.col("text"), RUN)).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = F.pmod("h", F.length("run")).cast("int")
    worn = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % WORN == 0, worn).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(word_counts(table(spark, sf_dir, "documents")))


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def held_out(key: str) -> Column:
        return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1

    model = compression_quality.fit(docs, labels.where(~held_out("doc_id")))
    return compression_quality.score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f for f in (
        op1_secret_ownership, op2_curriculum_mix, op3_language_fusion, op4_block_top_k, op5_minhash_near_dedup,
        op6_token_counts, op7_byte_bpe, op8_warc_derivatives, op9_feistel_pseudonyms, op10_lattice_near_dedup,
        op11_source_divergence, op12_spelling_variants, op13_compression_quality)
}
