"""Queries that take lines through the whole workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as nb
from ..operators import answers as an
from ..operators import workflow as wf
from . import fixtures as fx
from . import oracles as oc
from .catalog import register

_LABELS = ["title", "H1", "H2", "H3", "H4", "Body", "Other"]


def predicted(blocks):
    """Stands for a model: a label by number, and a confidence that passes the gate in four of ten blocks."""
    k = F.pmod(F.col("doc_id") * 3 + F.col("line_no"), F.lit(len(_LABELS))).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), k + 1)
    return blocks.withColumns({"predicted": F.when(F.col("line_no") % 9 != 0, label), "confidence": F.col("line_no") % 10 / F.lit(10.0)})


def run(spark, sf, **more):
    bounds = {"largest": fx.largest_document(spark, sf), "docs_per_job": fx.largest_request(spark, sf)}
    return wf.process_documents(fx.blocks(spark, sf).drop("n_words"), predict=predicted, **bounds, **more)


@register(
    "document_labels",
    oc.workflow_sql(
        """select doc_id, line_no, page, text, n_lines, rule_label, confidence, old_label, label from labelled"""
    ),
)
def document_labels(spark, sf):
    """Merged blocks with the rule's label, the gated one and the repaired one."""
    columns = ["doc_id", "line_no", "page", "text", "n_lines", "rule_label", "confidence", "old_label", "label"]
    return run(spark, sf).labelled.select(*columns)


@register(
    "document_changes",
    oc.workflow_sql("select doc_id, bool_or(old_label <> label) as modified from labelled group by doc_id"),
)
def document_changes(spark, sf):
    """Whether the repair changed a document."""
    return run(spark, sf).modified


@register(
    "document_outlines",
    oc.workflow_sql("select t.doc_id, title, seq, level, text, page from titles t left join outline o using (doc_id)"),
)
def document_outlines(spark, sf):
    """Outlines at the end of the workflow."""
    return run(spark, sf).outlines


@register(
    "document_pipeline",
    oc.workflow_sql(
        """select job_id, rank, t.doc_id, text as section_title, t.page, category, round(score, 6) as score,
 summary as refined_text from top_sections t left join page_summaries s on s.doc_id = t.doc_id and s.page = t.page"""
    ),
)
def document_pipeline(spark, sf):
    """Lines to answers: every operator between them in its place."""
    out = run(spark, sf, manifest=fx.manifest(spark, sf), jobs=fx.jobs(spark, sf)).answer
    return out.withColumn("score", nb.r6(F.col("score")))


@register(
    "answer_nearest_nested",
    oc.sql(
        """select job_id, 'reader ' || job_id as persona, task, '2025-01-01T00:00:00.000000' as stamp, n_documents, part, pos, document,
 page_number, title, importance_rank, refined from (
  select j.job_id, j.task, n_documents, 'section' as part, rank as pos, doc_id::varchar as document, page as page_number, text as title,
   rank as importance_rank, null as refined from jobs j join (select job_id, count(*) n_documents from manifest group by job_id) m using (job_id)
   join top_heads t on t.job_id = j.job_id
  union all
  select j.job_id, j.task, n_documents, 'analysis', cast(row_number() over (partition by j.job_id order by rank, near_rank) as int),
   t.doc_id::varchar, t.page, null, null, body_text
   from jobs j join (select job_id, count(*) n_documents from manifest group by job_id) m using (job_id)
   join top_heads t on t.job_id = j.job_id join near n on n.doc_id = t.doc_id and n.head_no = t.line_no)"""
    ),
)
def answer_nearest_nested(spark, sf):
    """The alternative answer in its exchange form, laid flat again."""
    bounds = {"largest": fx.largest_document(spark, sf), "docs_per_job": fx.largest_request(spark, sf)}
    manifest, jobs = fx.manifest(spark, sf), fx.jobs(spark, sf)
    flat = an.job_answer_nearest(fx.labelled(spark, sf), manifest, jobs, **bounds)
    nested = an.nested_nearest(flat, manifest, jobs, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    head = nested.select(
        "job_id", F.col("metadata.persona").alias("persona"), F.col("metadata.job_to_be_done").alias("task"),
        F.col("metadata.processing_timestamp").alias("stamp"), F.size("metadata.input_documents").alias("n_documents").cast("bigint"),
        "extracted_sections", "subsection_analysis",
    )
    keep = ["job_id", "persona", "task", "stamp", "n_documents"]
    none = F.lit(None)
    sections = head.select(*keep, F.posexplode("extracted_sections").alias("p", "s")).select(
        *keep, F.lit("section").alias("part"), (F.col("p") + 1).alias("pos"), "s.document", "s.page_number",
        F.col("s.section_title").alias("title"), "s.importance_rank", none.cast("string").alias("refined"),
    )
    analysis = head.select(*keep, F.posexplode("subsection_analysis").alias("p", "s")).select(
        *keep, F.lit("analysis").alias("part"), (F.col("p") + 1).alias("pos"), "s.document", "s.page_number",
        none.cast("string").alias("title"), none.cast("int").alias("importance_rank"), F.col("s.refined_text").alias("refined"),
    )
    return sections.unionByName(analysis)
