"""Queries on features, encoding, splits and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as nb
from ..operators import features as ft
from ..operators import knn
from ..operators import labels as lb
from . import fixtures as fx
from . import oracles as oc
from .catalog import register

ID = ["doc_id", "line_no"]


def nested_blocks(spark, sf):
    """The blocks in their exchange form, with font and attributes as structs."""
    b = fx.blocks(spark, sf)
    return b.select(
        *ID,
        "page",
        "text",
        F.bround("font_size", 2).alias("font_size"),
        "font_name",
        "x_center",
        "y_center",
        F.lit("en").alias("Lang"),
        lb.parse_font(F.col("font_name")).alias("Font"),
        F.struct(
            F.bround(F.col("font_size") * F.lit(1.2), 1).alias("LineHeight"),
            F.lit(0.0).alias("SpaceAfter"),
            F.when(lb.is_centred(F.col("x_center")), "Center").otherwise("Left").alias("TextAlign"),
        ).alias("attributes"),
    )


FLAT = """select doc_id, line_no, page, text, round_even(font_size, 2) as font_size, font_name, x_center, y_center,
 'en' as "Lang", split_part(font_name, '-', 1) as "Font_alt_family_name", false as "Font_embedded",
 'WinAnsiEncoding' as "Font_encoding", split_part(font_name, '-', 1) as "Font_family_name",
 'TrueType' as "Font_font_type", contains(lower(font_name), 'italic') as "Font_italic",
 false as "Font_monospaced", font_name as "Font_name_nested", false as "Font_subset",
 case when regexp_matches(lower(font_name), '(bold|black)') then 700 else 400 end as "Font_weight",
 round_even(font_size * 1.2::double, 1) as "attributes_LineHeight", 0.0::double as "attributes_SpaceAfter",
 case when abs(x_center - 300) < 100 then 'Center' else 'Left' end as "attributes_TextAlign" from blocks"""


@register("flatten_blocks", oc.sql(FLAT))
def flatten_blocks(spark, sf):
    return ft.flatten(nested_blocks(spark, sf))


@register(
    "parse_bbox",
    oc.sql(
        """select doc_id, line_no, case when ok then x1 - x0 else 0 end as bbox_width,
 case when ok then y1 - y0 else 0 end as bbox_height,
 case when ok then (x1 - x0) * (y1 - y0) else 0 end as bbox_area,
 case when line_no % 6 = 1 then 400 else weight end::double as weight
 from (select *, line_no % 4 <> 0 as ok from blocks)"""
    ),
)
def parse_bbox(spark, sf):
    """Boxes given as text, a quarter of them broken; weights given as text, some not numbers."""
    b = fx.blocks(spark, sf)
    good = F.concat(F.lit("["), F.concat_ws(", ", "x0", "y0", "x1", "y1"), F.lit("]"))
    broken = F.when(F.col("line_no") % 8 == 0, "[1.0, 2.0]").otherwise("n/a")
    raw = b.select(
        *ID,
        F.when(F.col("line_no") % 4 == 0, broken).otherwise(good).alias("bbox"),
        F.when(F.col("line_no") % 6 == 1, "bold").otherwise(F.col("weight").cast("string")).alias("weight"),
    )
    box = F.col("_box")
    sides = ft.bbox_features(*[F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4)])
    return raw.withColumn("_box", ft.parse_bbox(F.col("bbox"))).select(
        *ID, *[v.alias(k) for k, v in sides.items()], nb.number(F.col("weight"), 400).alias("weight")
    )


@register(
    "category_codes",
    """select doc_id, dense_rank() over (order by source) - 1 as source_code,
 dense_rank() over (order by lang) - 1 as lang_code from documents""",
)
def category_codes(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "lang")
    coded = ft.category_codes(docs, "source", "source_code")
    return ft.category_codes(coded, "lang", "lang_code").drop("source", "lang")


@register(
    "font_zscore",
    oc.sql(
        """select doc_id, line_no, round(coalesce((font_size - avg(font_size) over w)
 / nullif(stddev_samp(font_size) over w, 0), 0), 6) + 0.0 as font_size_zscore
 from blocks window w as (partition by doc_id)"""
    ),
)
def font_zscore(spark, sf):
    out = ft.block_features(
        fx.blocks(spark, sf), scope="document", largest=fx.largest_document(spark, sf)
    )
    return out.select(*ID, nb.r6(F.col("font_size_zscore")).alias("font_size_zscore"))


@register(
    "y_norm",
    oc.sql(
        """select doc_id, line_no, round(y, 6) as normalized_y_pos, cast(y <= 0.33::double as int) as is_top_third
 from (select doc_id, line_no, y_center / max(y_center) over (partition by doc_id) as y from blocks)"""
    ),
)
def y_norm(spark, sf):
    out = ft.block_features(
        fx.blocks(spark, sf), scope="document", largest=fx.largest_document(spark, sf)
    )
    return out.select(*ID, nb.r6(F.col("normalized_y_pos")).alias("normalized_y_pos"), "is_top_third")


def _features_sql(over: str, rank: str, digit: str) -> str:
    return oc.sql(
        rf"""select doc_id, line_no, text_length, word_count, round(text_length / word_count::double, 6) as avg_word_length,
 bbox_width, bbox_height, bbox_width * bbox_height as bbox_area, starts_with_number, has_punctuation,
 round(coalesce((font_size - avg(font_size) over w) / nullif(stddev_samp(font_size) over w, 0), 0), 6) + 0.0
  as font_size_zscore,
 round(y_center / max(y_center) over w, 6) as normalized_y_pos,
 cast(y_center / max(y_center) over w <= 0.33::double as int) as is_top_third,
 dense_rank() over ({rank} order by font_name) - 1 as font_name_code
 from (select *, length(text) as text_length, {oc.n_words('text')} as word_count, x1 - x0 as bbox_width,
  y1 - y0 as bbox_height, cast({digit} as int) as starts_with_number,
  cast(regexp_matches(text, '[.,!?]') as int) as has_punctuation from blocks) window w as ({over})"""
    )


_FEATURES = [
    "text_length", "word_count", "avg_word_length", "bbox_width", "bbox_height", "bbox_area",
    "starts_with_number", "has_punctuation", "font_size_zscore", "normalized_y_pos", "is_top_third",
    "font_name_code",
]
_ROUNDED = {"avg_word_length", "font_size_zscore", "normalized_y_pos"}


def _rounded(df, columns=_FEATURES):
    return df.select(*ID, *[nb.r6(F.col(c)).alias(c) if c in _ROUNDED else F.col(c) for c in columns])


@register(
    "features_serving",
    _features_sql("partition by doc_id", "partition by doc_id", r"starts_with(text, '\d')"),
)
def features_serving(spark, sf):
    return _rounded(
        ft.block_features(
            fx.blocks(spark, sf), scope="document", compat=True, largest=fx.largest_document(spark, sf)
        )
    )


@register("features_training", _features_sql("", "", r"regexp_matches(text, '^\d')"))
def features_training(spark, sf):
    return _rounded(ft.block_features(fx.blocks(spark, sf), scope="global"))


@register(
    "features_network",
    oc.sql(
        f"""select doc_id, line_no, font_size, weight::double as weight, page::double as page, x_center, y_center,
 length(text)::double as text_length, ({oc.n_words('text')})::double as word_count,
 x1 - x0 as bbox_width, y1 - y0 as bbox_height, (x1 - x0) * (y1 - y0) as bbox_area,
 (abs(x_center - 300) < 100)::int::double as is_center_aligned,
 (abs(x_center - 300) >= 100)::int::double as is_left_aligned, (weight >= 700)::int::double as is_bold,
 0.0::double as is_italic from blocks"""
    ),
)
def features_network(spark, sf):
    b = fx.blocks(spark, sf).withColumn(
        "TextAlign", F.when(lb.is_centred(F.col("x_center")), "Center").otherwise("Left")
    )
    inputs, names = ft.numeric_inputs(ft.network_features(b))
    return inputs.select(*ID, *names)


@register(
    "heading_cues",
    oc.sql(
        rf"""select doc_id, line_no, font_size, weight >= 700 as is_bold, {oc.is_upper('text')} as is_all_caps,
 regexp_matches(text, '^\d+\.?\s') as starts_with_number, x0 as indentation, length(text) as text_length,
 0.0::double as line_spacing_before, coalesce(nxt - y1, 0) < 20 as has_following_content,
 round(y0 / 842.0::double, 6) as position_on_page,
 {oc.has_any('lower(text)', ['chapter', 'section', 'part'])} as looks_like_title,
 ends_with({oc.strip('lower(text)')}, ':') as ends_with_colon,
 {oc.has_any('lower(text)', ['introduction', 'conclusion', 'summary', 'methodology', 'results', 'discussion', 'references'])}
  as contains_heading_keywords
 from (select *, lead(y0) over (partition by doc_id, page order by y_center, line_no) as nxt from blocks)"""
    ),
)
def heading_cues(spark, sf):
    b = fx.blocks(spark, sf).withColumns(
        {
            "is_bold": F.col("weight") >= lb.BOLD_WEIGHT,
            "x_coord": F.col("x0"),
            "y_coord": F.col("y0"),
            "page_height": F.lit(842.0),
        }
    )
    cues = ft.heading_cues(ft.next_distance(b, largest=fx.largest_document(spark, sf)))
    return cues.select(
        *ID, "font_size", "is_bold", "is_all_caps", "starts_with_number", "indentation", "text_length",
        "line_spacing_before", "has_following_content",
        nb.r6(F.col("position_on_page")).alias("position_on_page"),
        "looks_like_title", "ends_with_colon", "contains_heading_keywords",
    )


_SCALED = ["font_size", "weight", "page", "x_center", "y_center", "n_words"]


@register(
    "standardize",
    oc.sql(
        "select doc_id, line_no, "
        + ", ".join(
            f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) + 0.0 as z_{c}" for c in _SCALED
        )
        + ", 0.0::double as z_constant from blocks"
    ),
)
def standardize(spark, sf):
    columns = [*_SCALED, "constant"]
    b = fx.blocks(spark, sf).withColumn("constant", F.lit(7.0))
    out = ft.standardize(b, columns, ft.fit_scaler(b, columns))
    return out.select(*ID, *[nb.r6(F.col(f"z_{c}")).alias(f"z_{c}") for c in columns])


def split_sql(label: str, identity: str, source: str) -> str:
    return f"""select *, row_number() over (partition by {label} order by md5(cast({identity} as varchar)))
  <= ceil(0.2::double * count(*) over (partition by {label})) as is_test from {source}"""


@register(
    "stratified_split",
    f"select doc_id, quality, is_test from ({split_sql('quality', 'doc_id', 'labels')})",
)
def stratified_split(spark, sf):
    rows = fx.table(spark, sf, "labels").select("doc_id", "quality")
    return ft.stratified_split(rows, "quality", "doc_id")


@register(
    "class_weights",
    oc.sql(
        """select label, n, round(sum(n) over () / (count(*) over () * n)::double, 6) as weight
 from (select label, count(*) n from labelled group by label)"""
    ),
)
def class_weights(spark, sf):
    return ft.class_weights(fx.labelled(spark, sf), "label").withColumn("weight", nb.r6(F.col("weight")))


@register(
    "knn_cosine",
    f"""with s as ({split_sql('label', 'vec_id', 'embeddings')}),
 near as (select * from (select q.vec_id as query_id, t.vec_id, t.label,
   round(greatest(1 - list_cosine_similarity(q.embedding::double[], t.embedding::double[]), 0), 9) as d,
   row_number() over (partition by q.vec_id order by
    round(greatest(1 - list_cosine_similarity(q.embedding::double[], t.embedding::double[]), 0), 9), t.vec_id) r
   from s q join s t on q.is_test and not t.is_test) where r <= 5),
 votes as (select query_id, label, sum(case when z then (d = 0)::int::double else 1 / nullif(d, 0) end) w
   from (select *, bool_or(d = 0) over (partition by query_id) z from near) group by all),
 shares as (select query_id, label, round(w / sum(w) over (partition by query_id), 9) as share from votes)
 select query_id, label as predicted, round(share, 6) as confidence from shares
 qualify row_number() over (partition by query_id order by share desc, label) = 1""",
)
def knn_cosine(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    split = ft.stratified_split(rows, "label", "vec_id")
    near = knn.nearest_neighbours(
        split.filter("is_test"), split.filter("not is_test"), "vec_id", "embedding", ["label"]
    )
    return knn.predict(near, "label").withColumn("confidence", nb.r6(F.col("confidence")))
