"""A training corpus out of raw documents, in five stages.

Language ID (rejected documents go), near-duplicates (one document of each group stays),
personal data (pseudonyms), source mixing (documents repeat or go, in training order) and
BPE encoding with a decoding check.  Each stage takes and gives the columns of ``documents``;
the last adds the token ids.  ``n_chars`` follows the text.

Every stage takes an empty table to an empty one, reads no columns but these five, whatever
others there are, and keeps rows that repeat (but the near-duplicate stage, where they are
copies of each other); null ids, sources and languages are values like others.  The stages
are called in turn, and the result of each is written before the next one begins: what an
earlier stage left in its working tables is then removed, unless the next one still reads it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import bpe, language_id, mixing, near_dedup, pseudonyms
from jobsift.llm.queries import pii_key
from jobsift.session import materialize, recorded, remove_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ENCODING = "byte_bpe_50k.tiktoken"

#: Working tables that earlier stages left.
_left: list[str] = []


def _stage(function: Callable) -> Callable:
    """The stage, recording its working tables and removing those that earlier stages left."""
    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = remove_tables(spark, _left, still_read=docs)
        with recorded() as written:
            result = function(spark, docs, sf_dir)
        _left.extend(written)
        return result
    return staged


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language of enough confidence.

    Null, empty and letterless texts go.  Null languages and sources give no evidence.
    """
    rows = docs.select(*COLUMNS)
    model = language_id.fit_text_model(rows, "doc_id", "text", "lang")
    found = language_id.identify(
        rows, model, "doc_id", "text", declared_col="lang", host_col="source", keep=("text", "lang", "source", "n_chars"))
    return found.where("accepted").withColumnRenamed("id", "doc_id").select(*COLUMNS)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8): of least id, null ids last.

    Rows are told apart by a key of their own, so neither null nor repeated ids make copies.
    """
    # Written once, the row numbers hold for good.
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_dedup.near_duplicates(rows, id_col="row", words=5, similarity=(4, 5)).select(F.col("id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    chosen = found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first.alias("first")).select("first.row")
    copies = materialize(found.select("row").join(chosen, "row", "left_anti"), "copies")
    return rows.join(copies, "row", "left_anti").select(*COLUMNS)


@_stage
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; null texts stay null, all rows stay."""
    clean = pseudonyms.pseudonymize(docs.select(*COLUMNS), pii_key(spark))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row per place of a document, in training order; texts are whole.

    Null and empty texts have no words and no place.  A null source is one source, a null id an id.
    """
    placed = mixing.assign_positions(docs.select(*COLUMNS), keep=("text", "lang", "source", "n_chars"))
    return mixing.training_order(placed).withColumnRenamed("id", "doc_id").select(*COLUMNS)


@_stage
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (unsigned 32-bit, little-endian) and whether they decode to the text; null texts count as empty."""
    path = public_tokenizers.path(ENCODING)
    encoded = bpe.decode(bpe.encode(docs.select(*COLUMNS), path, COLUMNS), path, COLUMNS)
    return encoded.select(
        *COLUMNS, F.col("packed").alias("token_ids"), (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("decodes"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]
#: The fitted language model and the byte-pair merges have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next.

    Once a stage is written, the one before it is removed: a lost executor reads the newer one.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with recorded() as written:
            docs = materialize(result, f"stage-{name}")
        remove_tables(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
