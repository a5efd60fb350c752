"""Queries on requests: joins, relevance, top sections and composed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as nb
from ..functions import vectors as vc
from ..operators import answers as an
from ..operators import outline as ol
from ..operators import relevance as rv
from ..operators.summary import extractive_summary
from . import fixtures as fx
from . import oracles as oc
from .catalog import register


def _bounds(spark, sf):
    return {
        "largest": fx.largest_document(spark, sf),
        "docs_per_job": fx.largest_request(spark, sf),
    }


@register(
    "manifest_join",
    oc.sql("select job_id, doc_ord, m.doc_id, quality from manifest m join labels l on l.doc_id = m.doc_id"),
)
def manifest_join(spark, sf):
    done = fx.table(spark, sf, "labels").select("doc_id", "quality")
    return an.listed_documents(fx.manifest(spark, sf), done)


@register(
    "missing_docs",
    oc.sql("select job_id, doc_ord, doc_id from manifest where doc_id not in (select doc_id from labels)"),
)
def missing_docs(spark, sf):
    return an.missing_documents(fx.manifest(spark, sf), fx.table(spark, sf, "labels"))


@register(
    "unprocessed_docs",
    "select doc_id, source from documents where doc_id not in (select doc_id from labels)",
)
def unprocessed_docs(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    return an.unprocessed(docs, fx.table(spark, sf, "labels"))


@register(
    "section_content",
    oc.sql(
        """select o.doc_id, seq, text, o.page, coalesce(content, '') as content
 from outline o left join page_bodies p on p.doc_id = o.doc_id and p.page = o.page"""
    ),
)
def section_content(spark, sf):
    b = fx.labelled(spark, sf)
    sections = ol.outline(b, largest=fx.largest_document(spark, sf))
    return an.section_content(sections, b).select("doc_id", "seq", "text", "page", "content")


@register(
    "nearest_body",
    oc.sql("select doc_id, page, head_no, near_rank, body_no, body_text from near"),
)
def nearest_body(spark, sf):
    b = fx.labelled(spark, sf)
    heads = rv.headings(b).select("doc_id", "page", "y_center", F.col("line_no").alias("head_no"))
    return rv.nearest_bodies(heads, b, largest=fx.largest_document(spark, sf))


@register(
    "section_content_gaps",
    oc.gaps_sql(
        """select nullif(o.doc_id, -1) as doc_id, seq, text, nullif(o.page, -1) as page, coalesce(content, '') as content
 from outline o left join page_bodies p on p.doc_id = o.doc_id and p.page = o.page"""
    ),
)
def section_content_gaps(spark, sf):
    b = fx.labelled_gaps(spark, sf)
    sections = ol.outline(b, largest=fx.largest_document(spark, sf))
    return an.section_content(sections, b).select("doc_id", "seq", "text", "page", "content")


@register(
    "nearest_body_gaps",
    oc.gaps_sql(
        "select nullif(doc_id, -1) as doc_id, nullif(page, -1) as page, head_no, near_rank, body_no, body_text from near"
    ),
)
def nearest_body_gaps(spark, sf):
    b = fx.labelled_gaps(spark, sf)
    heads = rv.headings(b).select("doc_id", "page", "y_center", F.col("line_no").alias("head_no"))
    return rv.nearest_bodies(heads, b, largest=fx.largest_document(spark, sf))


@register(
    "cosine_pairs",
    """select a.vec_id, b.vec_id as next_id,
 round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine
 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select(
        (F.col("vec_id") - 1).alias("vec_id"),
        F.col("vec_id").alias("next_id"),
        F.col("embedding").alias("_next"),
    )
    return e.join(nxt, "vec_id").select(
        "vec_id", "next_id", nb.r6(vc.cosine(F.col("embedding"), F.col("_next"))).alias("cosine")
    )


@register(
    "relevance_scores",
    oc.sql("select job_id, doc_id, seq, round(score, 6) as score from scored_sections"),
)
def relevance_scores(spark, sf):
    sections = ol.outline(fx.labelled(spark, sf), largest=fx.largest_document(spark, sf))
    scored = rv.relevance_scores(
        sections, fx.manifest(spark, sf), fx.jobs(spark, sf), **_bounds(spark, sf)
    )
    return scored.select("job_id", "doc_id", "seq", nb.r6(F.col("score")).alias("score"))


@register(
    "relevance_dense",
    """select j.vec_id as job_id, d.vec_id as doc_id,
 round(list_cosine_similarity(d.embedding::double[], j.embedding::double[]), 6) as score
 from embeddings d join embeddings j on j.vec_id % 20 = 0
  and j.vec_id in (d.vec_id - d.vec_id % 20 - 20, d.vec_id - d.vec_id % 20, d.vec_id - d.vec_id % 20 + 20)""",
)
def relevance_dense(spark, sf):
    """Stored vectors as sections; every twentieth is a request that lists the vectors around it, so each is in up to three."""
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    jobs = e.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "job_id")
    own = F.col("vec_id") - F.col("vec_id") % 20
    manifest = e.select(
        F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("doc_ord"), F.explode(F.array(own - 20, own, own + 20)).alias("job_id")
    ).join(jobs.select("job_id"), "job_id", "left_semi")
    sections = e.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("seq"), "embedding")
    scored = rv.relevance_scores(sections, manifest, jobs, largest=1, docs_per_job=60, vector="embedding")
    return scored.select("job_id", "doc_id", nb.r6(F.col("score")).alias("score"))


@register(
    "top_sections",
    oc.sql(
        """select job_id, rank, doc_id, seq, text, page, category, importance, round(score, 6) as score
 from top_sections"""
    ),
)
def top_sections(spark, sf):
    sections = ol.outline(fx.labelled(spark, sf), largest=fx.largest_document(spark, sf))
    scored = rv.relevance_scores(
        sections, fx.manifest(spark, sf), fx.jobs(spark, sf), **_bounds(spark, sf)
    )
    return rv.top_sections(scored).select(
        "job_id", "rank", "doc_id", "seq", "text", "page", "category", "importance",
        nb.r6(F.col("score")).alias("score"),
    )


@register(
    "top_sections_per_doc",
    oc.sql(
        """select job_id, rank, doc_id, doc_rank, line_no, text, page, round(score, 6) as score
 from top_heads"""
    ),
)
def top_sections_per_doc(spark, sf):
    top = rv.top_sections_per_doc(
        fx.labelled(spark, sf), fx.manifest(spark, sf), fx.jobs(spark, sf), **_bounds(spark, sf)
    )
    return top.select(
        "job_id", "rank", "doc_id", "doc_rank", "line_no", "text", "page",
        nb.r6(F.col("score")).alias("score"),
    )


@register(
    "job_answer",
    oc.sql(
        """select job_id, rank, t.doc_id, text as section_title, t.page, category, round(score, 6) as score,
 summary as refined_text from top_sections t left join page_summaries s on s.doc_id = t.doc_id and s.page = t.page"""
    ),
)
def job_answer(spark, sf):
    out = an.job_answer(
        fx.labelled(spark, sf), fx.manifest(spark, sf), fx.jobs(spark, sf), **_bounds(spark, sf)
    )
    return out.withColumn("score", nb.r6(F.col("score")))


@register(
    "job_answer_nearest",
    oc.sql(
        """select job_id, rank, t.doc_id, text as section_title, t.page, near_rank, body_text as refined_text
 from top_heads t left join near n on n.doc_id = t.doc_id and n.head_no = t.line_no"""
    ),
)
def job_answer_nearest(spark, sf):
    return an.job_answer_nearest(
        fx.labelled(spark, sf), fx.manifest(spark, sf), fx.jobs(spark, sf), **_bounds(spark, sf)
    )


@register(
    "extractive_summary", oc.sql("select doc_id, page, summary from page_summaries")
)
def summaries(spark, sf):
    return extractive_summary(an.page_bodies(fx.labelled(spark, sf)), ["doc_id", "page"])
