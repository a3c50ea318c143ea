"""Intake of uploaded documents as binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift import constants as K


def intake_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, problem) of each file under ``path``; null problem = accepted."""
    files = spark.read.format("binaryFile").load(path)
    # ``length`` filters are pushed to the source, so oversized files are never read.
    large = files.where(F.col("length") > K.MAX_FILE_BYTES).withColumn("content", F.lit(b""))
    usable = files.where(F.col("length") <= K.MAX_FILE_BYTES)
    return check_documents(large.unionByName(usable))


def check_documents(files: DataFrame) -> DataFrame:
    """The intake rules over (path, length, content)."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    body = F.decode("content", "ISO-8859-1")
    megabytes = F.format_string("%.1f", F.col("length") / (1024 * 1024))
    problem = (
        F.when(F.col("length") > K.MAX_FILE_BYTES, F.format_string(
            "File too large. Max size is 5 MB (got %s MB).", megabytes))
        .when(~extension.isin("pdf", "txt"), K.UNSUPPORTED_FILE)
        .when((extension == "pdf") & ~body.startswith("%PDF-"), K.NOT_PDF)
        .when((extension == "pdf") & body.rlike(K.ACTIVE_PDF_CONTENT), K.ACTIVE_PDF)
    )
    return files.select("path", "length", extension.alias("kind"), problem.alias("problem"))
