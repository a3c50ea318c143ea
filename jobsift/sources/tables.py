"""Scans with declared schemas, and decoding of the JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift import schemas
from jobsift.functions.text import is_blank, strip_code_fence

CORRUPT = "_corrupt_record"


def scan_screenings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCREENING).parquet(path)


def scan_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles with both JSON documents decoded to structs."""
    raw = spark.read.schema(schemas.PROFILE).parquet(path)
    return raw.withColumns({
        "hard_reject_filters": decode_document("hard_reject_filters", schemas.FILTERS),
        "preferences": decode_document("preferences", schemas.PREFERENCES),
    })


def scan_tracker(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRACKER).parquet(path)


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports with their frozen rows nested (one report may have several parts)."""
    return spark.read.schema(schemas.REPORT).parquet(path)


def decode_document(col: str | Column, schema: T.StructType) -> Column:
    """Struct of an optional JSON document; every absent field is null."""
    text = F.col(col) if isinstance(col, str) else col
    return F.from_json(F.coalesce(text, F.lit("{}")), schema, {"mode": "PERMISSIVE"})


def decode_analysis(df: DataFrame, col: str = "analysis_json", name: str = "analysis") -> DataFrame:
    """Add the analysis struct; ``analysis_ok`` is false where the JSON is broken."""
    with_corrupt = T.StructType([*schemas.ANALYSIS.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = df.withColumn(name, F.from_json(
        F.coalesce(F.col(col), F.lit("{}")), with_corrupt,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    ))
    return (
        parsed.withColumn("analysis_ok", F.col(name)[CORRUPT].isNull())
        .withColumn(name, F.col(name).dropFields(CORRUPT))
    )


def parse_model_output(
    df: DataFrame, col: str, schema: T.StructType = schemas.PARSED_PROFILE
) -> tuple[DataFrame, DataFrame]:
    """(rows with a ``parsed`` struct, rows whose text is not JSON).

    A code fence around the JSON is removed first.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    text = strip_code_fence(F.col(col))
    tried = df.withColumn("parsed", F.from_json(
        text, with_corrupt,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    ))
    bad = F.col("parsed").isNull() | F.col("parsed")[CORRUPT].isNotNull() | is_blank(text)
    ok_rows = tried.where(~bad).withColumn("parsed", F.col("parsed").dropFields(CORRUPT))
    return ok_rows, tried.where(bad).drop("parsed")
