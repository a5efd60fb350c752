"""Joins of requests, documents and sections, and the composed answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from . import ordering as od
from . import relevance as rv
from .outline import outline
from .summary import extractive_summary


def stage_counts(stages: dict[str, DataFrame], doc: str = "doc_id") -> DataFrame:
    """Documents that reached each stage."""
    counts = [
        df.agg(F.countDistinct(doc).alias("n")).select(F.lit(name).alias("stage"), "n")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def reached_counts(blocks: DataFrame, stages: dict[str, Column], doc: str = "doc_id") -> DataFrame:
    """Documents with a block for which each stage's condition holds: one pass over the blocks for all stages."""
    reached = blocks.groupBy(doc).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(name) for name, c in stages.items()])
    counts = reached.agg(*[F.count_if(F.col(name)).alias(name) for name in stages])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("stage"), F.col(name).alias("n")) for name in stages]))
    return counts.select(rows.alias("_r")).select("_r.*")


def listed_documents(manifest: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents of each request that exist, with their columns."""
    return manifest.join(documents, doc)


def missing_documents(manifest: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Requested documents that do not exist."""
    return manifest.join(documents.select(doc), doc, "left_anti")


def unprocessed(documents: DataFrame, done: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents without a stored result."""
    return documents.join(done.select(doc), doc, "left_anti")


def page_bodies(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Body text of each page in file order, joined by blanks."""
    body = blocks.filter((F.col("label") == "Body") & (tx.strip(F.col("text")) != ""))
    lines = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return body.groupBy(doc, "page").agg(
        F.array_join(F.transform(lines, lambda x: x["text"]), " ").alias("content")
    )


def section_content(sections: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each section with the body text of its page; the stored labels decide what is body.

    The bodies are joined to text once a page, before the join, not once a section. Unknown documents and pages meet each other.
    """
    return od.join_keys(sections, page_bodies(blocks, doc), [doc, "page"]).withColumn(
        "content", F.coalesce("content", F.lit(""))
    )


def job_answer(
    blocks: DataFrame,
    manifest: DataFrame,
    jobs: DataFrame,
    largest: int | None = None,
    docs_per_job: int | None = None,
    encode: Callable[[Column], Column] | None = None,
    summarize: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Top sections of every job with a summary of the body text of their pages.

    ``encode`` (text to dense vector, see ``encoders.encoder``) replaces the token counts of the ranking; every section and
    task is encoded once, before they meet. ``summarize`` (text to text, ``encoders.summarizer``) replaces the built-in summary.

    Scores need only heading texts; body text is read for the pages of the winners alone. The winners
    (five rows a job) are stored, as they are used more than once.
    """
    sections = outline(blocks, largest=largest)
    vector = None
    if encode is not None:
        vector = "_vector"
        sections = sections.withColumn(vector, encode(F.col("text")))
        jobs = jobs.withColumn(vector, encode(F.col("task")))
    scored = rv.relevance_scores(
        sections, manifest, jobs, largest=largest, docs_per_job=docs_per_job, vector=vector
    )
    top = cut_lineage(
        rv.top_sections(scored).select(
            "job_id", "rank", "doc_id", F.col("text").alias("section_title"), "page", "category", "score"
        )
    )
    pages = top.select("doc_id", "page").distinct()
    contents = page_bodies(od.join_keys(blocks, pages, ["doc_id", "page"], "left_semi"))
    if summarize is not None:
        summaries = contents.select("doc_id", "page", summarize(F.col("content")).alias("summary"))
    else:
        summaries = extractive_summary(contents, ["doc_id", "page"])
    return od.join_keys(top, summaries, ["doc_id", "page"]).withColumnRenamed("summary", "refined_text")


def job_answer_nearest(
    blocks: DataFrame,
    manifest: DataFrame,
    jobs: DataFrame,
    largest: int | None = None,
    docs_per_job: int | None = None,
) -> DataFrame:
    """Top headings of every document of a job, each with the body blocks nearest to it."""
    top = cut_lineage(
        rv.top_sections_per_doc(
            blocks, manifest, jobs, largest=largest, docs_per_job=docs_per_job
        ).select(
            "job_id", "rank", "doc_id", "page", "y_center", "line_no", F.col("text").alias("section_title")
        )
    )
    heads = top.select("doc_id", "page", "y_center", F.col("line_no").alias("head_no")).distinct()
    near = rv.nearest_bodies(heads, blocks, largest=largest).withColumnRenamed("head_no", "line_no")
    return od.join_keys(top, near, ["doc_id", "page", "line_no"]).select(
        "job_id", "rank", "doc_id", "section_title", "page", "near_rank",
        F.col("body_text").alias("refined_text"),
    )


def nested_answer(
    answer: DataFrame, manifest: DataFrame, jobs: DataFrame, stamp: Column
) -> DataFrame:
    """One row a job in the exchange form: metadata, extracted_sections, subsection_analysis.

    ``stamp`` is the processing time, passed in so that runs can be repeated.
    """
    entries = answer.groupBy("job_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "doc_id", "section_title", "page", "refined_text"))
        ).alias("_top")
    )
    top = F.coalesce(F.col("_top"), F.array().cast(entries.schema["_top"].dataType))
    sections = F.transform(
        top,
        lambda s: F.struct(
            s["doc_id"].cast("string").alias("document"),
            s["section_title"].alias("section_title"),
            s["rank"].alias("importance_rank"),
            s["page"].alias("page_number"),
        ),
    )
    analysis = F.transform(
        F.filter(top, lambda s: s["refined_text"].isNotNull()),
        lambda s: F.struct(
            s["doc_id"].cast("string").alias("document"),
            s["refined_text"].alias("refined_text"),
            s["page"].alias("page_number"),
        ),
    )
    return _with_metadata(jobs, manifest, stamp).join(entries, "job_id", "left").select(
        "job_id", "metadata", sections.alias("extracted_sections"), analysis.alias("subsection_analysis")
    )


def nested_nearest(answer: DataFrame, manifest: DataFrame, jobs: DataFrame, stamp: Column) -> DataFrame:
    """The alternative answer (rows of ``job_answer_nearest``) in the exchange form, one row a job.

    Sections stand in their rank; the analysis has an entry for each body block near to each of them, in the same order.
    """
    section = F.struct(
        "rank",
        F.struct(
            F.col("doc_id").cast("string").alias("document"),
            "section_title",
            F.col("rank").alias("importance_rank"),
            F.col("page").alias("page_number"),
        ).alias("entry"),
    )
    body = F.struct(
        "rank",
        "near_rank",
        F.struct(F.col("doc_id").cast("string").alias("document"), "refined_text", F.col("page").alias("page_number")).alias("entry"),
    )
    entries = answer.groupBy("job_id").agg(
        F.array_sort(F.collect_set(section)).alias("_sections"),
        F.array_sort(F.collect_list(F.when(F.col("refined_text").isNotNull(), body))).alias("_bodies"),
    )
    kinds = dict(entries.dtypes)

    def part(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast(kinds[name])), lambda s: s["entry"])

    return _with_metadata(jobs, manifest, stamp).join(entries, "job_id", "left").select(
        "job_id", "metadata", part("_sections").alias("extracted_sections"), part("_bodies").alias("subsection_analysis")
    )


def _with_metadata(jobs: DataFrame, manifest: DataFrame, stamp: Column) -> DataFrame:
    """(job_id, metadata): the listed documents in request order, who asks for what, and the time."""
    documents = manifest.groupBy("job_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("doc_ord", "doc_id"))),
            lambda d: d["doc_id"].cast("string"),
        ).alias("_docs")
    )
    metadata = F.struct(
        F.coalesce("_docs", F.array().cast("array<string>")).alias("input_documents"),
        F.col("persona"),
        F.col("task").alias("job_to_be_done"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processing_timestamp"),
    )
    return jobs.join(documents, "job_id", "left").select("job_id", metadata.alias("metadata"))
