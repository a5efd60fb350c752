"""Outlines: title, level repair, first occurrences, skipped levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from . import ordering as od
from .labels import LEVELS, OUTLINE_LEVELS, with_uniform_relabel
from .merge import merge_blocks

UNTITLED = "Untitled Document"


def level_number(label) -> F.Column:
    out = None
    for i, name in enumerate(LEVELS):
        out = F.when(label == name, i) if out is None else out.when(label == name, i)
    return out


def level_name(number) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), number.cast("int") + 1)


def repair_levels(
    blocks: DataFrame,
    doc: str = "doc_id",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """No heading may be more than one level below the heading before it.

    In reading order the repaired level is min(own, repaired level before + 1), starting from 0.
    Unrolled, that is ``rn + min(0, min over the rows so far of (own - rn))`` with ``rn`` the position
    among the headings: a running minimum. Adds ``new_label``; other blocks keep their label.
    """
    order = list(od.READING_ORDER)
    heads = blocks.filter(F.col("label").isin(LEVELS)).withColumn("_cur", level_number(F.col("label")))
    rest = blocks.filter(~F.coalesce(F.col("label").isin(LEVELS), F.lit(False)))
    heads, spans = od.chunked(heads, [doc], order, largest, limit)
    w = od.chunk_window([doc], order)
    heads = heads.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_low", F.min(F.col("_cur") - F.col("_rn")).over(w.rowsBetween(*od.UP_TO))
    )
    if spans:
        heads = od.carry(
            heads,
            [doc],
            [F.count("*").alias("_n"), F.min(F.col("_cur") - F.col("_rn")).alias("_m")],
            lambda over: [
                F.coalesce(F.sum("_n").over(over.rowsBetween(*od.BEFORE)), F.lit(0)).alias("_off"),
                F.col("_m"),
            ],
        )
        # The minimum of each chunk, shifted by the headings before it, then run over the chunks.
        chunks = heads.select(doc, od.CHUNK, "_off", "_m").distinct()
        over = W.partitionBy(doc).orderBy(od.CHUNK).rowsBetween(*od.BEFORE)
        chunks = chunks.select(
            doc, od.CHUNK, F.min(F.col("_m") - F.col("_off")).over(over).alias("_before")
        )
        heads = od.join_keys(heads, chunks, [doc, od.CHUNK])
        low = F.least(F.lit(0), F.col("_before"), F.col("_low") - F.col("_off"))
        new = F.col("_rn") + F.col("_off") + low
    else:
        new = F.col("_rn") + F.least(F.lit(0), F.col("_low"))
    heads = heads.withColumn("new_label", level_name(new))
    return heads.select(*blocks.columns, "new_label").unionByName(
        rest.withColumn("new_label", F.col("label"))
    )


def modified_documents(repaired: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, modified): whether the repair changed a level of the document."""
    changed = ~F.col("label").eqNullSafe(F.col("new_label"))
    return repaired.groupBy(doc).agg(F.bool_or(changed).alias("modified"))


def first_headings(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """First occurrence of each cleaned heading text of a document; empty texts are dropped."""
    heads = blocks.filter(F.col("label").isin(OUTLINE_LEVELS)).select(
        doc,
        tx.clean_text(F.col("text")).alias("clean"),
        F.struct(*od.READING_ORDER, "label").alias("_row"),
    )
    return (
        heads.filter(F.col("clean") != "")
        .groupBy(doc, "clean")
        .agg(F.min("_row").alias("_row"))
        .select(doc, "clean", "_row.*")
    )


def fix_skips(
    headings: DataFrame,
    doc: str = "doc_id",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Number the kept headings and turn an H3 right after an H1 into an H2.

    The fix never makes an H1, so the label before the fix of the previous row decides. Adds ``seq``
    and ``level``.
    """
    order = list(od.READING_ORDER)
    if not od.is_bounded(largest, limit):
        headings = cut_lineage(headings)  # counted, sampled and ranged: made once, and few against the blocks
    rows, spans = od.chunked(headings, [doc], order, largest, limit)
    w = od.chunk_window([doc], order)
    rows = rows.select(
        "*", F.row_number().over(w).alias("seq"), F.lag("label").over(w).alias("_prev")
    )
    if spans:
        rows = od.carry(
            rows,
            [doc],
            [F.count("*").alias("_n"), F.max_by("label", F.struct(*order)).alias("_last")],
            lambda over: [
                F.coalesce(F.sum("_n").over(over.rowsBetween(*od.BEFORE)), F.lit(0)).alias("_off"),
                F.lag("_last").over(over).alias("_carried"),
            ],
        )
        rows = rows.withColumn(
            "_prev", F.when(F.col("seq") == 1, F.col("_carried")).otherwise(F.col("_prev"))
        ).withColumn("seq", (F.col("seq") + F.col("_off")).cast("int"))
        rows = rows.drop("_off", "_carried")
    skipped = (F.col("_prev") == "H1") & (F.col("label") == "H3")
    return rows.withColumn("level", F.when(skipped, "H2").otherwise(F.col("label"))).drop(
        "_prev", od.CHUNK
    )


def doc_titles(
    blocks: DataFrame,
    doc: str = "doc_id",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One title a document: merged title blocks, page 1 preferred, largest font, first on ties."""
    titles = merge_blocks(
        blocks.filter(F.col("label") == "title").drop("n_lines"), doc=doc, largest=largest, limit=limit
    )
    ranked = titles.select(
        doc,
        F.struct(
            (~F.col("page").eqNullSafe(F.lit(1))).alias("later_page"),
            (-F.col("font_size")).alias("neg_size"),
            F.col("page"),
            F.col("y_head"),
            F.col("line_no"),
            tx.clean_text(F.col("text")).alias("title"),
        ).alias("_t"),
    )
    every = blocks.select(doc, F.lit(None).cast(ranked.schema["_t"].dataType).alias("_t"))
    return (
        ranked.unionByName(every)
        .groupBy(doc)
        .agg(F.min("_t").alias("_t"))
        .select(doc, F.coalesce(F.col("_t.title"), F.lit(UNTITLED)).alias("title"))
    )


def outline(
    blocks: DataFrame,
    doc: str = "doc_id",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(doc, seq, level, text, page): style relabel, headings, first occurrences, skipped levels."""
    relabelled = with_uniform_relabel(blocks, doc, largest=largest, limit=limit)
    kept = fix_skips(first_headings(relabelled, doc), doc, largest, limit)
    return kept.select(doc, "seq", "level", F.col("clean").alias("text"), "page")


def titled_outline(blocks: DataFrame, doc: str = "doc_id", **bounds) -> DataFrame:
    """The outline with the document title on every entry; untouched documents give one bare row.

    Blocks without a document are one document.
    """
    return od.join_keys(doc_titles(blocks, doc, **bounds), outline(blocks, doc, **bounds), [doc])


def nested_outline(titled: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``{title, outline: [{level, text, page}]}`` per document, the exchange form."""
    entry = F.struct("seq", "level", "text", "page")
    return (
        titled.groupBy(doc)
        .agg(
            F.first("title").alias("title"),
            F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), entry))).alias("_e"),
        )
        .select(
            doc,
            "title",
            F.transform(
                "_e",
                lambda e: F.struct(
                    e["level"].alias("level"), e["text"].alias("text"), e["page"].alias("page")
                ),
            ).alias("outline"),
        )
    )
