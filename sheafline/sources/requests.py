"""Requests: which documents to read, for whom, and for what task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST_SCHEMA = (
    "job_id bigint, challenge_info struct<challenge_id:string,test_case_name:string,description:string>, "
    "documents array<struct<filename:string,title:string>>, persona struct<role:string>, "
    "job_to_be_done struct<task:string>"
)


def read_requests(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """One row a request; ``job_id`` is taken from the record or else from the file name."""
    raw = spark.read.schema(REQUEST_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.withColumn("job_id", F.coalesce("job_id", F.xxhash64(F.col("_metadata.file_path"))))


def explode_manifest(requests: DataFrame) -> DataFrame:
    """(job_id, persona, task, doc_ord, filename, title); entries without a file name are skipped."""
    return (
        requests.select(
            "job_id",
            F.col("persona.role").alias("persona"),
            F.col("job_to_be_done.task").alias("task"),
            F.posexplode("documents").alias("doc_ord", "_d"),
        )
        .select(
            "job_id", "persona", "task", F.col("doc_ord").cast("bigint").alias("doc_ord"),
            F.col("_d.filename").alias("filename"), F.col("_d.title").alias("title"),
        )
        .filter(F.coalesce(F.col("filename"), F.lit("")) != "")
    )


def request_records(manifest: DataFrame, jobs: DataFrame) -> DataFrame:
    """The exchange form of a manifest, one record a job."""
    listed = manifest.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("doc_ord", "doc_id"))).alias("_d")
    )
    return jobs.join(listed, "job_id").select(
        "job_id",
        F.transform(
            "_d",
            lambda d: F.struct(
                F.concat(d["doc_id"].cast("string"), F.lit(".pdf")).alias("filename"),
                F.concat(F.lit("Document "), d["doc_id"].cast("string")).alias("title"),
            ),
        ).alias("documents"),
        F.struct(F.col("persona").alias("role")).alias("persona"),
        F.struct("task").alias("job_to_be_done"),
    )
