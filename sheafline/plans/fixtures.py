"""Views over the given tables that stand in for extracted documents.

``blocks`` lays the lines of ``documents`` out on pages of 24 lines; sizes, weights and boxes follow
from the line number, the document number and the words of the line, so every label occurs.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators.ordering import group_profile


@lru_cache(maxsize=256)
def _layout(path: str, app: str):
    """Schema and number of scan pieces of a stored table, looked up once a session."""
    df = SparkSession.getActiveSession().read.parquet(path)
    return df.schema, df.rdd.getNumPartitions()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return spark.read.schema(_layout(path, spark.sparkContext.applicationId)[0]).parquet(path)


def dealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table stored in fewer pieces than there are cores is dealt out first; others stay put."""
    cores = spark.sparkContext.defaultParallelism
    pieces = _layout(f"{sf}/{name}.parquet", spark.sparkContext.applicationId)[1]
    df = table(spark, sf, name)
    return df.repartition(cores) if pieces < cores else df


def lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = dealt(spark, sf, "documents").select("doc_id", "text")
    parts = docs.select("doc_id", F.split("text", "\n").alias("parts"))
    return (
        parts.select("doc_id", F.posexplode("parts").alias("pos", "line"))
        .select(
            "doc_id",
            (F.col("pos") + 1).cast("bigint").alias("line_no"),
            F.trim("line").alias("text"),
        )
        .filter(F.col("text") != "")
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    base = lines(spark, sf).withColumn("n_words", F.size(F.split("text", r"\s+")))
    phase = (F.col("doc_id") + F.col("line_no")) % 5
    short = F.col("n_words") <= 8
    kind = (
        F.when((F.col("line_no") <= 2) & (F.col("doc_id") % 3 == 0), "T")
        .when(short & (phase == 0), "A")
        .when(short & (phase == 1), "B")
        .when(short & (phase == 2), "C")
        .when(short & (phase == 3), "D")
        .when((F.col("doc_id") + F.col("line_no")) % 11 == 0, "S")
        .otherwise("N")
    )
    size = (
        F.when(F.col("kind") == "T", F.lit(24.0))
        .when(F.col("kind") == "A", F.lit(16.5))
        .when(F.col("kind") == "B", F.lit(15.5))
        .when(F.col("kind") == "C", F.lit(14.5))
        .when(F.col("kind") == "D", F.lit(13.5))
        .when(F.col("kind") == "S", F.lit(8.0))
        .otherwise(F.lit(12.0))
    )
    bold = F.col("kind").isin("T", "A")
    left = F.when(F.col("kind") == "T", F.lit(150.0)).otherwise(F.lit(72.0))
    width = F.when(F.col("kind") == "T", F.lit(300.0)).otherwise(F.lit(200.0))
    top = (72 + 30 * ((F.col("line_no") - 1) % 24)).cast("double")
    placed = base.withColumn("kind", kind).select(
        "doc_id",
        "line_no",
        "text",
        "n_words",
        (F.floor((F.col("line_no") - 1) / 24).cast("int") + 1).alias("page"),
        size.alias("font_size"),
        F.when(bold, "Sans-Bold").otherwise("Sans-Regular").alias("font_name"),
        F.when(bold, 700).otherwise(400).alias("weight"),
        left.alias("x0"),
        top.alias("y0"),
        width.alias("_w"),
    )
    return placed.select(
        "doc_id", "line_no", "text", "n_words", "page", "font_size", "font_name", "weight",
        "x0", "y0",
        (F.col("x0") + F.col("_w")).alias("x1"),
        (F.col("y0") + F.col("font_size")).alias("y1"),
        ((F.col("x0") + F.col("x0") + F.col("_w")) / 2).alias("x_center"),
        ((F.col("y0") + F.col("y0") + F.col("font_size")) / 2).alias("y_center"),
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return lb.with_rule_labels(blocks(spark, sf), largest=largest_document(spark, sf))


def labelled_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled blocks of which one document has no id, and one page in seven documents no number."""
    known = F.col("doc_id")
    b = blocks(spark, sf).withColumns(
        {"doc_id": F.when(known != 3, known), "page": F.when((known % 7 != 5) | (F.col("page") != 2), F.col("page"))}
    )
    return lb.with_rule_labels(b, largest=largest_document(spark, sf))


def uniform_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled blocks set in one size, told apart by bold and italic only."""
    salt = F.col("doc_id") + F.col("line_no")
    return (
        labelled(spark, sf)
        .withColumn("font_size", F.lit(12.0))
        .withColumn("is_bold", salt % 5 == 0)
        .withColumn("is_italic", salt % 7 == 0)
    )


@lru_cache(maxsize=32)
def _profile(sf: str, app: str) -> int:
    spark = SparkSession.getActiveSession()
    breaks = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n")))
    longest = table(spark, sf, "documents").agg(F.max(breaks + 1)).first()[0]
    return int(longest or 0)


def largest_document(spark: SparkSession, sf: str) -> int:
    """Most lines of a document (document numbers are unique): the bound that allows windows."""
    return _profile(sf, spark.sparkContext.applicationId)


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One request per benchmark item: its text is the task."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("job_id"),
        F.concat(F.lit("reader "), F.col("item_id")).alias("persona"),
        F.col("text").alias("task"),
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is requested by exactly one job; the order in the request is the id order."""
    n_jobs = table(spark, sf, "benchmark").agg((F.max("item_id") + 1).alias("n")).scalar()
    return table(spark, sf, "documents").select(
        (F.col("doc_id") % n_jobs).alias("job_id"),
        F.floor(F.col("doc_id") / n_jobs).cast("bigint").alias("doc_ord"),
        "doc_id",
    )


@lru_cache(maxsize=32)
def _request_profile(sf: str, app: str) -> int:
    return group_profile(manifest(SparkSession.getActiveSession(), sf), ["job_id"])[1]


def largest_request(spark: SparkSession, sf: str) -> int:
    """Documents of the longest request."""
    return _request_profile(sf, spark.sparkContext.applicationId)
