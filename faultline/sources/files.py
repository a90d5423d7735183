"""Reading source files for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 when valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def decode_files(files: DataFrame) -> DataFrame:
    return files.filter(F.length("content") > 0).select(
        F.substring_index("path", "/", -1).alias("filename"), decoded(F.col("content")).alias("content")
    )


def read_code_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Non-empty files of a folder tree, decoded."""
    return decode_files(
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "content")
    )
