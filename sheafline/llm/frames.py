"""Small Spark helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later jobs start from files, whatever executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_draw(rows: DataFrame, by: str, most: dict, *keys: str, seed: int = 11) -> DataFrame:
    """Distinct ``rows``, thinned by a hash of ``keys`` where a value of ``by`` has over twice its ``most``.

    For rows that a model is fitted on, after a draw by id: an id that very many rows repeat is bounded too.
    """
    rows = rows.distinct()
    held = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}  # as many rows as values of ``most``
    share = F.lit(2**31)
    for value, n in held.items():
        if n > 2 * most.get(value, n):
            share = F.when(F.col(by) == value, 2**31 * most[value] // n).otherwise(share)
    if not any(n > 2 * most.get(value, n) for value, n in held.items()):
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**31)) < share)
