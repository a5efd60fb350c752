"""Similarity of headings to tasks, and the top sections of each request.

A request (job) lists its documents, so a heading is scored once for every request that lists its
document: the scored rows are the manifest's rows, never jobs x headings. Scores are cosine
similarities of token counts; the job side is one row a job (a map of counts). Where both sides carry a
column of dense vectors, the cosine of those is taken over the same join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vc
from . import ordering as od
from .labels import LEVELS, category, importance

# Sections kept for an answer, body blocks kept for a section, shortest heading.
TOP_SECTIONS = 5
NEAREST_BODIES = 3
HEADING_MIN_CHARS = 3

DOCS_PER_CHUNK = 100_000


def job_vectors(jobs: DataFrame, job: str = "job_id", text: str = "task") -> DataFrame:
    """(job, terms map<token, count>, norm)."""
    counts = (
        jobs.select(job, F.explode(tx.tokens(F.col(text))).alias("_t"))
        .groupBy(job, "_t")
        .agg(F.count("*").alias("_c"))
    )
    return counts.groupBy(job).agg(
        F.map_from_entries(F.collect_list(F.struct("_t", "_c"))).alias("_terms"),
        F.sqrt(F.sum(F.col("_c") * F.col("_c")).cast("double")).alias("_norm"),
    )


def largest_request(manifest: DataFrame, job: str = "job_id") -> int:
    return od.group_profile(manifest, [job])[1]


def attach_jobs(
    sections: DataFrame,
    manifest: DataFrame,
    vectors: DataFrame,
    job: str = "job_id",
    docs_per_job: int | None = None,
    docs_per_chunk: int = DOCS_PER_CHUNK,
) -> DataFrame:
    """Join the job vectors to the sections of their requests.

    The vectors are broadcast when their measured size allows it. A request of very many documents
    is spread over chunks of its document order, its vector repeated once a chunk.
    """
    if docs_per_job is None:
        docs_per_job = largest_request(manifest, job)
    if docs_per_job <= docs_per_chunk:
        return sections.join(vectors, job, "left")
    chunk = F.coalesce(F.floor(F.col("doc_ord") / docs_per_chunk).cast("int"), F.lit(0))
    spans = manifest.groupBy(job).agg(F.max(chunk).alias("_hi"))
    spread = vectors.join(spans, job).select(
        *vectors.columns, F.explode(F.sequence(F.lit(0), "_hi")).alias("_salt")
    )
    return (
        sections.withColumn("_salt", chunk).join(spread, [job, "_salt"], "left").drop("_salt")
    )


def similarity(toks: Column) -> Column:
    """Cosine of the heading's tokens and the attached job vector; 0 where either is empty."""
    dot = F.aggregate(
        toks,
        F.lit(0).cast("bigint"),
        lambda acc, t: acc + F.coalesce(F.element_at(F.col("_terms"), t), F.lit(0).cast("bigint")),
    )
    scale = F.sqrt(tx.squared_norm(toks).cast("double")) * F.col("_norm")
    return F.coalesce(dot / F.nullif(scale, F.lit(0.0)), F.lit(0.0))


def request_sections(
    sections: DataFrame,
    manifest: DataFrame,
    doc: str = "doc_id",
    ordinal: str = "seq",
    largest: int | None = None,
) -> DataFrame:
    """Sections of the documents each request lists (inner, by document).

    With a document beyond the row limit the sections are spread over chunks of ``ordinal``.
    """
    if largest is not None and largest <= od.MAX_GROUP_ROWS:
        return sections.join(manifest, doc)
    chunk = od.line_chunk(ordinal)
    spans = sections.groupBy(doc).agg(F.min(chunk).alias("_lo"), F.max(chunk).alias("_hi"))
    spread = manifest.join(spans, doc).select(
        *manifest.columns, F.explode(F.sequence("_lo", "_hi")).alias("_salt")
    )
    return sections.withColumn("_salt", chunk).join(spread, [doc, "_salt"]).drop("_salt")


def relevance_scores(
    sections: DataFrame,
    manifest: DataFrame,
    jobs: DataFrame,
    text: str = "text",
    ordinal: str = "seq",
    largest: int | None = None,
    docs_per_job: int | None = None,
    vector: str | None = None,
) -> DataFrame:
    """Every section of every request with its ``score``.

    ``vector`` names a column of dense vectors in ``sections`` and in ``jobs``; a missing vector scores 0.
    """
    listed = request_sections(sections, manifest, ordinal=ordinal, largest=largest)
    if vector is not None:
        asked = jobs.select("job_id", F.col(vector).alias("_asked"))
        scored = attach_jobs(listed, manifest, asked, docs_per_job=docs_per_job)
        return scored.withColumn("score", vc.cosine(F.col(vector), F.col("_asked"))).drop(vector, "_asked")
    scored = attach_jobs(listed, manifest, job_vectors(jobs), docs_per_job=docs_per_job)
    return (
        scored.withColumn("_toks", tx.tokens(F.col(text)))
        .withColumn("score", similarity(F.col("_toks")))
        .drop("_toks", "_terms", "_norm")
    )


def top_sections(scored: DataFrame, k: int = TOP_SECTIONS) -> DataFrame:
    """The ``k`` best sections of each job: importance first, then similarity, then input order.

    ``row_number`` under a rank limit keeps ``k`` rows per job in every task before the shuffle.
    """
    ranked = scored.withColumn("category", category(F.col("text"))).withColumn(
        "importance", importance(F.col("category"))
    )
    w = W.partitionBy("job_id").orderBy("importance", F.desc("score"), "doc_ord", "seq")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def headings(blocks: DataFrame) -> DataFrame:
    """Blocks labelled as headings whose trimmed text is longer than three characters."""
    return blocks.filter(
        F.col("label").isin(LEVELS) & (F.char_length(tx.strip(F.col("text"))) > HEADING_MIN_CHARS)
    )


def top_sections_per_doc(
    blocks: DataFrame,
    manifest: DataFrame,
    jobs: DataFrame,
    k: int = TOP_SECTIONS,
    largest: int | None = None,
    docs_per_job: int | None = None,
    limit: int | None = None,
    vector: str | None = None,
) -> DataFrame:
    """The ``k`` most similar headings of each document of a request, numbered through the request.

    ``vector`` as in ``relevance_scores``, a column of ``blocks`` and ``jobs``.
    """
    if docs_per_job is None:
        docs_per_job = largest_request(manifest)
    dense = [vector] if vector is not None else []
    heads = headings(blocks).select("doc_id", "line_no", "page", "y_center", "text", *dense)
    scored = relevance_scores(
        heads, manifest, jobs, ordinal="line_no", largest=largest, docs_per_job=docs_per_job, vector=vector
    )
    w = W.partitionBy("job_id", "doc_id").orderBy(F.desc("score"), "line_no")
    best = scored.withColumn("doc_rank", F.row_number().over(w)).filter(F.col("doc_rank") <= k)
    return od.numbered(
        best, ["job_id"], ["doc_ord", "doc_rank"], "rank", largest=k * docs_per_job, limit=limit
    )


def nearest_bodies(
    heads: DataFrame,
    blocks: DataFrame,
    doc: str = "doc_id",
    k: int = NEAREST_BODIES,
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The ``k`` Body blocks of the same page closest in height to each heading.

    No heading meets all bodies of its page. Bodies are reduced to levels (equal height, the first
    ``k`` lines of each), levels are numbered down the page, and a heading only looks at the ``k``
    levels above and below its own place. ``heads`` needs doc, page, y_center and ``head_no``.
    """
    where = [doc, "page"]
    bodies = (
        od.join_keys(blocks.filter(F.col("label") == "Body"), heads.select(*where).distinct(), where, "left_semi")
        .select(*where, "y_center", "line_no", "text")
    )
    tie = W.partitionBy(*where, "y_center").orderBy("line_no")
    kept = bodies.withColumn("_tie", F.row_number().over(tie)).filter(F.col("_tie") <= k)
    marks = kept.select(*where, "y_center", "line_no", "text", "_tie").unionByName(
        heads.select(*where, "y_center", F.col("head_no").alias("line_no"))
        .distinct()
        .withColumn("text", F.lit(None).cast("string"))
        .withColumn("_tie", F.lit(None).cast("int"))
    )
    # At equal height bodies come first, so a heading counts the level it stands on.
    order = ["y_center", F.col("_tie").isNull(), "line_no"]
    levels = od.running_sum(
        marks, where, order, {"_level": F.when(F.col("_tie") == 1, 1).otherwise(0)}, largest, limit
    )
    below = levels.filter(F.col("_tie").isNotNull()).select(
        *where, "_level", F.col("y_center").alias("_y"), F.col("line_no").alias("body_no"), "text"
    )
    look = F.explode(F.sequence(F.col("_level") - (k - 1), F.col("_level") + k)).alias("_level")
    above = levels.filter(F.col("_tie").isNull()).select(
        *where, F.col("line_no").alias("head_no"), F.col("y_center").alias("_h"), look
    )
    pairs = od.join_keys(above, below, [*where, "_level"], "inner")
    near = W.partitionBy(*where, "head_no").orderBy(F.abs(F.col("_y") - F.col("_h")), "body_no")
    return (
        pairs.withColumn("near_rank", F.row_number().over(near))
        .filter(F.col("near_rank") <= k)
        .select(*where, "head_no", "near_rank", "body_no", F.col("text").alias("body_text"))
    )
