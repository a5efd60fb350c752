"""Labelled training tables in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_QUOTING = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header line, declared types, quoted line breaks; a value of the wrong type is null."""
    return spark.read.options(**_QUOTING).option("mode", "PERMISSIVE").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
