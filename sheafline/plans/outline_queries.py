"""Queries on merges, level repair and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as mg
from ..operators import outline as ol
from . import fixtures as fx
from . import oracles as oc
from .catalog import register


@register("merge_titles", oc.sql("select * from merged_titles"))
def merge_titles(spark, sf):
    merged = mg.merge_titles(fx.blocks(spark, sf), largest=fx.largest_document(spark, sf))
    return merged.select(
        "doc_id", "line_no", "page", "text", "font_size", "font_name", "weight",
        "x0", "y0", "x1", "y1", "n_lines",
    )


@register("merge_blocks", oc.sql("select * from merged_blocks"))
def merge_blocks(spark, sf):
    merged = mg.merge_blocks(fx.labelled(spark, sf), largest=fx.largest_document(spark, sf))
    return merged.select(
        "doc_id", "line_no", "page", "label", "text", "font_size", "font_name",
        "x0", "y0", "x1", "y1", "y_head", "n_lines",
    )


@register("merge_titles_chunked", oc.sql("select * from merged_titles"))
def merge_titles_chunked(spark, sf):
    """The same merge where no bound is known: lines in ranges, and every segment of over one line in chunks of one."""
    merged = mg.merge_titles(fx.blocks(spark, sf), limit=2000, chunk_rows=1)
    return merged.select(
        "doc_id", "line_no", "page", "text", "font_size", "font_name", "weight",
        "x0", "y0", "x1", "y1", "n_lines",
    )


@register("merge_blocks_chunked", oc.sql("select * from merged_blocks"))
def merge_blocks_chunked(spark, sf):
    """The same merge where no bound is known: lines in ranges, and segments of over eight lines in chunks of eight."""
    merged = mg.merge_blocks(fx.labelled(spark, sf), limit=2000, chunk_rows=8)
    return merged.select(
        "doc_id", "line_no", "page", "label", "text", "font_size", "font_name",
        "x0", "y0", "x1", "y1", "y_head", "n_lines",
    )


@register("repair_levels_ranged", oc.ORACLE_REPAIR)
def repair_levels_ranged(spark, sf):
    """The level repair where documents are cut into ranges of lines."""
    out = ol.repair_levels(fx.labelled(spark, sf), limit=20)
    return out.filter(F.col("label").isin(ol.LEVELS)).select(
        "doc_id", "line_no", F.col("label").alias("old_label"), "new_label"
    )


@register("outline_ranged", oc.sql("select doc_id, seq, level, text, page from outline"))
def outline_ranged(spark, sf):
    """The outline where documents are cut into ranges of lines."""
    return ol.outline(fx.labelled(spark, sf), limit=20)


@register("doc_title", oc.sql("select doc_id, title from titles"))
def doc_title(spark, sf):
    return ol.doc_titles(fx.labelled(spark, sf), largest=fx.largest_document(spark, sf))


@register(
    "repair_levels",
    oc.ORACLE_REPAIR,
)
def repair_levels(spark, sf):
    out = ol.repair_levels(fx.labelled(spark, sf), largest=fx.largest_document(spark, sf))
    return out.filter(F.col("label").isin(ol.LEVELS)).select(
        "doc_id", "line_no", F.col("label").alias("old_label"), "new_label"
    )


@register(
    "repair_flags",
    oc.sql(
        f"""select doc_id, coalesce(bool_or(cur <> rn + low), false) as modified
 from (select distinct doc_id from labelled) left join (
  select doc_id, cur, rn, least(0, min(cur - rn) over
    (partition by doc_id order by page, y_center, line_no rows unbounded preceding)) as low
  from (select *, {oc.LEVEL.format(x='label')} as cur,
    row_number() over (partition by doc_id order by page, y_center, line_no) rn
    from labelled where label in ('title', 'H1', 'H2', 'H3', 'H4'))) using (doc_id) group by doc_id"""
    ),
)
def repair_flags(spark, sf):
    out = ol.repair_levels(fx.labelled(spark, sf), largest=fx.largest_document(spark, sf))
    return ol.modified_documents(out)


@register(
    "dedup_headings", oc.sql("select doc_id, line_no, clean, page, label from first_headings")
)
def dedup_headings(spark, sf):
    from ..operators.labels import with_uniform_relabel

    bound = fx.largest_document(spark, sf)
    return ol.first_headings(with_uniform_relabel(fx.labelled(spark, sf), largest=bound)).select(
        "doc_id", "line_no", "clean", "page", "label"
    )


@register(
    "fix_skips",
    oc.sql(
        """select f.doc_id, f.line_no, f.label as old_label, o.level as new_label, o.seq
 from first_headings f join outline o on o.doc_id = f.doc_id and o.text = f.clean"""
    ),
)
def fix_skips(spark, sf):
    from ..operators.labels import with_uniform_relabel

    bound = fx.largest_document(spark, sf)
    heads = ol.first_headings(with_uniform_relabel(fx.labelled(spark, sf), largest=bound))
    return ol.fix_skips(heads, largest=bound).select(
        "doc_id", "line_no", F.col("label").alias("old_label"), F.col("level").alias("new_label"), "seq"
    )


@register(
    "outline",
    oc.sql("select t.doc_id, title, seq, level, text, page from titles t left join outline o using (doc_id)"),
)
def outline(spark, sf):
    return ol.titled_outline(fx.labelled(spark, sf), largest=fx.largest_document(spark, sf))


@register(
    "outline_gaps",
    oc.gaps_sql(
        """select nullif(t.doc_id, -1) as doc_id, title, seq, level, text, nullif(page, -1) as page
 from titles t left join outline o using (doc_id)"""
    ),
)
def outline_gaps(spark, sf):
    """Outlines where a document has no id and pages have no number."""
    return ol.titled_outline(fx.labelled_gaps(spark, sf), largest=fx.largest_document(spark, sf))
