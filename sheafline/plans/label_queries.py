"""Queries on labels, fonts and text (projections, filters, aggregates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as nb
from ..functions import text as tx
from ..operators import labels as lb
from ..operators import ordering as od
from . import fixtures as fx
from . import oracles as oc
from .catalog import register

ID = ["doc_id", "line_no"]


@register("label_rule", oc.sql("select doc_id, line_no, label from labelled"))
def label_rule(spark, sf):
    return fx.labelled(spark, sf).select(*ID, "label")


FONTS = "['Sans-Bold', 'Serif-Black', 'Mono-Italic', 'Sans-BoldItalic', 'Times']"


@register(
    "parse_font",
    oc.sql(
        f"""select doc_id, line_no, split_part(f, '-', 1) as alt_family_name, false as embedded,
 'WinAnsiEncoding' as encoding, split_part(f, '-', 1) as family_name, 'TrueType' as font_type,
 contains(lower(f), 'italic') as italic, false as monospaced, f as name, false as subset,
 case when regexp_matches(lower(f), '(bold|black)') then 700 else 400 end as weight
 from (select *, {FONTS}[1 + (doc_id + line_no) % 5] as f from blocks)"""
    ),
)
def parse_font(spark, sf):
    fonts = F.array(*[F.lit(x) for x in FONTS.strip("[]").replace("'", "").split(", ")])
    pick = (1 + (F.col("doc_id") + F.col("line_no")) % 5).cast("int")
    return (
        fx.blocks(spark, sf)
        .select(*ID, lb.parse_font(F.element_at(fonts, pick)).alias("f"))
        .select(*ID, "f.*")
    )


@register(
    "layout_attrs",
    oc.sql(
        """select doc_id, line_no, (x0 + x1) / 2 as x_center, (y0 + y1) / 2 as y_center,
 round_even(font_size, 2) as font_size, round_even(font_size * 1.2::double, 1) as line_height,
 0.0::double as space_after,
 case when abs((x0 + x1) / 2 - 300) < 100 then 'Center' else 'Left' end as text_align from blocks"""
    ),
)
def layout_attrs(spark, sf):
    return fx.blocks(spark, sf).select(*ID, *lb.layout_attributes())


@register("clean_text", oc.sql(f"select doc_id, line_no, {oc.clean('text')} as clean from lines"))
def clean_text(spark, sf):
    return fx.lines(spark, sf).select(*ID, tx.clean_text(F.col("text")).alias("clean"))


@register(
    "text_stats",
    oc.sql(
        f"""select doc_id, line_no, length(text) as text_length, {oc.n_words('text')} as word_count,
 round(coalesce(length(text) / nullif({oc.n_words('text')}, 0)::double, 0), 6) as avg_word_length,
 {oc.is_upper('text')} as is_upper from lines"""
    ),
)
def text_stats(spark, sf):
    t = F.col("text")
    return (
        fx.lines(spark, sf)
        .select(*ID, F.char_length(t).alias("text_length"), tx.word_count(t).alias("word_count"), "text")
        .select(
            *ID,
            "text_length",
            "word_count",
            nb.r6(nb.ratio(F.col("text_length"), F.col("word_count"))).alias("avg_word_length"),
            tx.is_upper(t).alias("is_upper"),
        )
    )


@register(
    "reading_order",
    oc.sql(
        """select doc_id, line_no, page, cast(row_number() over (partition by doc_id
 order by page, y_center, line_no) as int) as position from blocks"""
    ),
)
def reading_order(spark, sf):
    b = fx.blocks(spark, sf).select(*ID, "page", "y_center")
    out = od.numbered(
        b, ["doc_id"], list(od.READING_ORDER), "position", largest=fx.largest_document(spark, sf)
    )
    return out.drop("y_center")


@register(
    "font_stats",
    oc.sql(
        """select doc_id, count(*) as n_blocks, avg(font_size) as avg_font_size,
 max(font_size) as largest_font from blocks group by doc_id"""
    ),
)
def font_stats(spark, sf):
    return lb.font_stats(fx.blocks(spark, sf))


@register(
    "uniform_share",
    oc.sql("select doc_id, round(top_share, 6) as top_share, top_share > 0.8 as is_dominated from shares"),
)
def uniform_share(spark, sf):
    return lb.size_shares(fx.blocks(spark, sf)).select(
        "doc_id", nb.r6(F.col("top_share")).alias("top_share"), "is_dominated"
    )


@register(
    "uniform_distinct", oc.sql("select doc_id, n_sizes, n_sizes <= 2 as has_few_sizes from shares")
)
def uniform_distinct(spark, sf):
    return lb.size_shares(fx.blocks(spark, sf)).select("doc_id", "n_sizes", "has_few_sizes")


@register(
    "uniform_relabel",
    oc.sql(
        f"""select doc_id, line_no, label as old_label,
 {oc.relabel(oc.strip('text'), 'is_bold', 'is_italic')} as new_label from uniform_blocks"""
    ),
)
def uniform_relabel(spark, sf):
    b = fx.uniform_blocks(spark, sf)
    return lb.with_uniform_relabel(b, out="new_label", largest=fx.largest_document(spark, sf)).select(
        *ID, F.col("label").alias("old_label"), "new_label"
    )


@register(
    "uniform_relabel_repair",
    oc.sql(
        rf"""select doc_id, line_no, label as old_label, case when label <> 'Other' then label
 when is_bold then case when {oc.is_upper(oc.strip('text'))} then 'H1' else 'H2' end
 when is_italic then 'H3'
 when regexp_matches({oc.strip('text')}, '^\d+\.(\d+\.?)?\s') then 'H2'
 when {oc.opens_with(f"lower({oc.strip('text')})", ['chapter', 'section', 'part'])} then 'H1'
 else label end as new_label from uniform_blocks"""
    ),
)
def uniform_relabel_repair(spark, sf):
    b = fx.uniform_blocks(spark, sf)
    return lb.with_repair_relabel(b, out="new_label", largest=fx.largest_document(spark, sf)).select(
        *ID, F.col("label").alias("old_label"), "new_label"
    )


@register(
    "categorize",
    oc.sql(
        f"""select doc_id, line_no, category, {oc.importance('category')} as importance
 from (select doc_id, line_no, {oc.category('text')} as category from lines)"""
    ),
)
def categorize(spark, sf):
    return (
        fx.lines(spark, sf)
        .select(*ID, lb.category(F.col("text")).alias("category"))
        .withColumn("importance", lb.importance(F.col("category")))
    )


@register(
    "confidence_gate",
    oc.sql(
        """select doc_id, line_no, (line_no % 10) / 10.0::double as confidence,
 case when (line_no % 10) / 10.0::double < 0.6::double then label else 'Body' end as label from labelled"""
    ),
)
def confidence_gate(spark, sf):
    conf = F.col("line_no") % 10 / F.lit(10.0)
    return fx.labelled(spark, sf).select(
        *ID,
        conf.alias("confidence"),
        lb.confidence_gate(conf, F.lit("Body"), F.col("label")).alias("label"),
    )


@register(
    "stage_counts",
    oc.sql(
        """select 'extracted' as stage, count(distinct doc_id) as n from blocks
 union all select 'classified', count(distinct doc_id) from labels join blocks using (doc_id)
 union all select 'outlined', count(distinct doc_id) from outline"""
    ),
)
def stage_counts(spark, sf):
    from ..operators import answers as an
    from ..operators import outline as ol

    seen = fx.table(spark, sf, "labels").select("doc_id").distinct().withColumn("_seen", F.lit(True))
    b = lb.with_uniform_relabel(fx.labelled(spark, sf), largest=fx.largest_document(spark, sf))
    heading = F.col("label").isin(ol.OUTLINE_LEVELS) & (tx.clean_text(F.col("text")) != "")
    return an.reached_counts(
        b.join(seen, "doc_id", "left"), {"extracted": F.lit(True), "classified": F.col("_seen"), "outlined": heading}
    )
