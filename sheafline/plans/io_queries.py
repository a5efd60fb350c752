"""Queries through the readers and writers; what they read is first written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as an
from ..operators import features as ft
from ..operators import labels as lb
from ..operators import outline as ol
from ..operators import schemaless as sl
from ..session import cut_lineage, scratch_path
from ..sources import blocks_json as bj
from ..sources import documents as dc
from ..sources import pages as pg
from ..sources import requests as rq
from ..sources import spans as sp
from ..sources import tabular as tb
from ..streaming.incremental import incremental_classify as stream_classify
from ..streaming.pieces import gather_documents
from . import fixtures as fx
from . import oracles as oc
from .answer_queries import job_answer
from .catalog import register


def fixture_spans(spark, sf):
    """Every word of every line as a span, with ragged blanks and a larger font after the first."""
    b = fx.blocks(spark, sf)
    word = F.posexplode(F.split("text", " ")).alias("span_no", "word")
    return b.select(
        "doc_id", "page", F.lit(0).alias("block"), F.lit(0).alias("block_type"),
        F.col("line_no").alias("line"), "font_size", "font_name", "x0", "y0", "x1", "y1", word,
    ).select(
        "doc_id", "page", "block", "block_type", "line", "span_no",
        F.concat(F.lit(" "), "word", F.lit("  ")).alias("text"),
        (F.col("font_size") + F.col("span_no")).alias("size"),
        F.col("font_name").alias("font"),
        (F.col("x0") + F.col("span_no")).alias("x0"), "y0", "x1", "y1",
    )


@register(
    "lines_from_spans",
    oc.sql(
        f"""select doc_id, page, 0 as block, line_no as line, {oc.strip('text')} as text, font_size, font_name,
 x0, y0, x1, y1 from blocks"""
    ),
)
def lines_from_spans(spark, sf):
    return sp.lines_from_spans(fixture_spans(spark, sf))


# Tokens, then a recursion over the tags of blocks that carries the list of open elements; runs are counted by those tags.
_INLINE = ", ".join(f"'{t}'" for t in sorted(pg.INLINE_TAGS))
_CARRY = ", ".join(f"'{t}'" for t in pg.PAGE_TAGS)
_REFERENCE = "&(?:amp|copy|middot|quot|lt|gt|nbsp);?"
_RESOLVED = f"""array_to_string(list_transform(regexp_extract_all(t, '{_REFERENCE}|&|[^&]+'), lambda x: case rtrim(x, ';')
  when '&amp' then '&' when '&copy' then '©' when '&middot' then '·' when '&quot' then '"' when '&lt' then '<' when '&gt' then '>'
  when '&nbsp' then chr(160) else x end), '')"""
_PAGES_SQL = rf"""with recursive shown as (
  select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
    '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis') as h from pages
), tokens as (
  select page_id, unnest(regexp_extract_all(h, '<[^>]*>|[^<]+')) as t,
    unnest(range(1, len(regexp_extract_all(h, '<[^>]*>|[^<]+')) + 1)) as pos from shown
), named as (
  select page_id, pos, t, lower(regexp_extract(t, '^</?([A-Za-z][^\s/>]*)', 1)) as name, t like '<%' as is_tag from tokens
), counted as (
  select *, is_tag and name <> '' and name not in ({_INLINE}) as is_mark from named
), runs as (
  select *, count(*) filter (is_mark) over (partition by page_id order by pos) as k from counted
), marks as (select page_id, k, name, t like '</%' as closes from runs where is_mark),
open as (
  select distinct page_id, 0::bigint as k, cast([] as varchar[]) as s from shown
  union all
  select page_id, k, case when closes then case when list_contains(s, name)
      then s[: len(s) - list_position(list_reverse(s), name)] else s end
    when name in ('meta', 'link', 'hr') then p
    when name = 'li' and near = 'li' then list_append(p[: len(p) - list_position(list_reverse(p), 'li')], name)
    else list_append(p, name) end
  from (select m.page_id, m.k, m.name, m.closes, o.s, case when o.s[-1] = 'p' then o.s[:-2] else o.s end as p,
      list_filter(case when o.s[-1] = 'p' then o.s[:-2] else o.s end, lambda x: x in ('li', 'ul', 'ol', 'menu'))[-1] as near
    from open o join marks m on m.page_id = o.page_id and m.k = o.k + 1)
), texts as (
  select page_id, k, string_agg(case when is_tag then ' ' else {_RESOLVED} end, '' order by pos) as text
  from runs where not is_tag or name = 'br' group by page_id, k
), blocks as (
  select page_id, k, list_filter(s, lambda x: x in ({_CARRY}))[-1] as tag, {oc.strip('text')} as text from texts join open using (page_id, k)
)
select page_id, row_number() over (partition by page_id order by k) as line_no, tag, text,
  case tag when 'title' then 24.0 when 'h1' then 16.5 when 'footer' then 8.0 else 12.0 end::double as font_size,
  case when tag in ('title', 'h1') then 700 else 400 end as weight
from blocks where text <> '' and tag is not null"""


@register("blocks_from_pages", _PAGES_SQL)
def blocks_from_pages(spark, sf):
    return pg.blocks_from_pages(fx.dealt(spark, sf, "pages"))


_BLOCK_COLUMNS = [
    "doc_id", "line_no", "page", "text", "font_size", "font_name", "weight", "x0", "y0", "x1", "y1",
    "x_center", "y_center",
]


@register("scan_blocks_json", oc.sql(f"select {', '.join(_BLOCK_COLUMNS)} from blocks"))
def scan_blocks_json(spark, sf):
    path = scratch_path(spark, "blocks")
    bj.write_blocks(fx.blocks(spark, sf), path)
    blocks, _ = bj.read_blocks(spark, path, whole_files=False, glob="*.txt")
    return bj.with_box_columns(blocks).select(*_BLOCK_COLUMNS)


def any_fixture(spark, sf):
    """Blocks as JSON objects that differ in their fields: nested, missing, of mixed kinds, with names that no schema knows."""
    b = fx.blocks(spark, sf)
    n = F.col("line_no")
    common = {c: F.col(c) for c in ("page", "text")}
    kinds = {
        0: {"score": n, "meta": F.struct(F.struct(n.alias("deep"), F.col("font_name").alias("name")).alias("in"), (n % 2 == 0).alias("even"))},
        1: {"score": F.col("font_name"), "bbox": F.array("x0", "y0")},
        2: {"score": F.struct(n.alias("a"), F.array(F.lit("x"), "font_name").alias("tags")), "odd key.x": F.col("font_size")},
        3: {"meta_even": F.lit("flat"), "Text": F.lit("other case")},
    }
    value = F.lit(None)
    for k, more in kinds.items():
        whole = F.to_json(F.struct(*[c.alias(name) for name, c in {**common, **more, "doc_id": F.col("doc_id"), "line_no": n}.items()]))
        value = F.when(n % 4 == k, whole).otherwise(value)
    arrays = b.select("doc_id", F.floor(n / 1000).alias("part"), "line_no", value.alias("v")).groupBy("doc_id", "part")
    path = scratch_path(spark, "any")
    lines = arrays.agg(F.array_sort(F.collect_list(F.struct("line_no", "v"))).alias("held"))
    joined = F.concat(F.lit("["), F.array_join(F.transform("held", lambda x: x["v"]), ", "), F.lit("]"))
    lines.select(joined.alias("value")).write.text(path)
    return bj.read_any_blocks(spark, path, whole_files=False, glob="*.txt")[0]


_ANY_FIELDS = """
 ('Text', 'STRING', n3), ('bbox', 'ARRAY<DECIMAL', n1), ('doc_id', 'BIGINT', n), ('line_no', 'BIGINT', n), ('meta_even', 'BOOLEAN', n0),
 ('meta_even', 'STRING', n3), ('meta_in_deep', 'BIGINT', n0), ('meta_in_name', 'STRING', n0), ('odd key.x', 'DECIMAL', n2), ('page', 'BIGINT', n),
 ('score', 'BIGINT', n0), ('score', 'STRING', n1), ('score_a', 'BIGINT', n2), ('score_tags', 'ARRAY<STRING', n2), ('text', 'STRING', n)
"""


@register(
    "dataset_header",
    oc.sql(
        f"""select t.name, t.kind, t.n from (select count(*) n, count(*) filter (line_no % 4 = 0) n0, count(*) filter (line_no % 4 = 1) n1,
 count(*) filter (line_no % 4 = 2) n2, count(*) filter (line_no % 4 = 3) n3 from blocks) c, lateral (values {_ANY_FIELDS}) t(name, kind, n)"""
    ),
)
def dataset_header(spark, sf):
    """Flattened names of all fields that occur, with the kinds of their values and how often they do."""
    found = sl.field_kinds(any_fixture(spark, sf))
    return found.groupBy(F.array_join("path", "_").alias("name"), "kind").agg(F.sum("n").alias("n"))


@register(
    "flatten_any",
    oc.sql(
        """select doc_id::varchar as doc_id, line_no, page::bigint as page, text, if(line_no % 4 = 3, 'other case', null) as text_nested,
 case line_no % 4 when 0 then line_no::varchar when 1 then '"' || font_name || '"' end as score,
 case line_no % 4 when 0 then (line_no % 2 = 0)::varchar when 3 then '"flat"' end as meta_even,
 if(line_no % 4 = 0, line_no, null) as meta_in_deep, if(line_no % 4 = 0, font_name, null) as meta_in_name,
 if(line_no % 4 = 2, line_no, null) as score_a, if(line_no % 4 = 2, 'x,' || font_name, null) as score_tags,
 if(line_no % 4 = 2, font_size, null) as odd_key, if(line_no % 4 = 1, x0 + y0, null) as bbox_sum from blocks"""
    ),
)
def flatten_any(spark, sf):
    """The fields as columns: objects laid flat, mixed kinds kept, two spellings of a name kept apart."""
    blocks = any_fixture(spark, sf)
    flat = sl.flatten_any(blocks, sl.Fields.of(blocks))
    assert {"Text", "text_nested"} <= set(flat.columns)  # 'Text' sorts first
    return flat.select(
        "doc_id", "line_no", "page", F.col("text_nested").alias("text"), F.col("`Text`").alias("text_nested"),
        *[F.to_json(c).alias(c) for c in ("score", "meta_even")], "meta_in_deep", "meta_in_name", "score_a",
        F.array_join("score_tags", ",").alias("score_tags"), F.col("`odd key.x`").alias("odd_key"),
        F.aggregate("bbox", F.lit(0.0), lambda a, x: a + x).alias("bbox_sum"),
    )


@register(
    "union_any",
    oc.sql(
        """select doc_id::varchar as doc_id, line_no, if(src = 1, page::bigint, null) as page, if(src = 2, weight::bigint, null) as weight,
 if(src = 1, text, null) as style_text, if(src = 2, font_name, null) as style_font
 from blocks, (values (1), (2)) s(src) where (src = 1) = (line_no % 2 = 0)"""
    ),
)
def union_any(spark, sf):
    """Two sources with other fields under one header."""
    b = fx.blocks(spark, sf)
    ids = [F.col("doc_id"), F.col("line_no")]
    shapes = (
        (b.filter("line_no % 2 = 0"), [F.col("page"), F.struct("text").alias("style")]),
        (b.filter("line_no % 2 = 1"), [F.col("weight"), F.struct(F.col("font_name").alias("font")).alias("style")]),
    )
    frames = []
    for k, (part, fields) in enumerate(shapes):
        path = scratch_path(spark, f"source{k}")
        part.select(F.concat(F.lit("["), F.to_json(F.struct(*ids, *fields)), F.lit("]")).alias("value")).write.text(path)
        frames.append(bj.read_any_blocks(spark, path, whole_files=False, glob="*.txt")[0])
    return sl.union_any(*frames).select("doc_id", "line_no", "page", "weight", "style_text", "style_font")


@register(
    "scan_folder",
    oc.sql(
        """select count(*) as n_blocks, count(distinct b.doc_id) as n_documents, sum(length(text))::bigint as n_chars,
 lang from blocks b join (select doc_id, lang from documents) using (doc_id) group by lang"""
    ),
)
def scan_folder(spark, sf):
    """A folder of sub-folders, one a language, read as one table."""
    path = scratch_path(spark, "folder")
    langs = fx.table(spark, sf, "documents").select("doc_id", "lang")
    arrays = bj.block_arrays(fx.blocks(spark, sf), bj.nested_block(("doc_id", "line_no")))
    arrays.join(langs, "doc_id").select("value", "lang").write.partitionBy("lang").text(path)
    blocks, _ = bj.read_blocks(spark, path, whole_files=False, glob="*.txt")
    return (
        blocks.select("doc_id", "text").join(langs, "doc_id")
        .groupBy("lang")
        .agg(
            F.count("*").alias("n_blocks"),
            F.countDistinct("doc_id").alias("n_documents"),
            F.sum(F.char_length("text")).alias("n_chars"),
        )
    )


@register(
    "manifest_explode",
    oc.sql(
        """select m.job_id, persona, task, doc_ord, doc_id || '.pdf' as filename, 'Document ' || doc_id as title
 from manifest m join jobs j on j.job_id = m.job_id"""
    ),
)
def manifest_explode(spark, sf):
    path = scratch_path(spark, "requests")
    bj.write_documents(rq.request_records(fx.manifest(spark, sf), fx.jobs(spark, sf)), path)
    return rq.explode_manifest(rq.read_requests(spark, path, multi_line=False))


@register(
    "scan_csv",
    oc.sql("select doc_id, line_no, text, font_size, font_name, weight, page, y_center, label from labelled"),
)
def scan_csv(spark, sf):
    path = scratch_path(spark, "training")
    columns = ["doc_id", "line_no", "text", "font_size", "font_name", "weight", "page", "y_center", "label"]
    tb.write_csv(fx.labelled(spark, sf).select(*columns), path)
    return tb.read_csv(
        spark,
        path,
        "doc_id bigint, line_no bigint, text string, font_size double, font_name string, weight int, "
        "page int, y_center double, label string",
    )


@register(
    "alias_columns",
    oc.sql(
        """select doc_id, line_no, (abs(x_center - 300) < 100)::int as is_center_aligned,
 (abs(x_center - 300) >= 100)::int as is_left_aligned, (weight >= 700)::int as is_bold, 0 as is_italic from blocks"""
    ),
)
def alias_columns(spark, sf):
    """The same features from a table with other column names, and without an italic column."""
    b = fx.blocks(spark, sf).select(
        "doc_id", "line_no", "text", "x0", "y0", "x1", "y1",
        F.col("weight").cast("string").alias("font_weight"),
        F.when(lb.is_centred(F.col("x_center")), "Center").otherwise("Left").alias("text_align"),
    )
    return ft.network_features(b).select(
        "doc_id", "line_no", "is_center_aligned", "is_left_aligned", "is_bold", "is_italic"
    )


@register(
    "answer_json",
    oc.sql(
        """select t.job_id, 'reader ' || t.job_id as persona, rank as importance_rank, t.doc_id::varchar as document,
 text as section_title, t.page as page_number, n as n_documents
 from top_sections t join (select job_id, count(*) n from manifest group by job_id) m on m.job_id = t.job_id"""
    ),
)
def answer_json(spark, sf):
    """Nested answers written as JSON, read back and laid flat again."""
    path = scratch_path(spark, "answers")
    nested = an.nested_answer(
        job_answer(spark, sf), fx.manifest(spark, sf), fx.jobs(spark, sf), F.lit("2025-01-01 00:00:00").cast("timestamp")
    )
    bj.write_documents(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select(
        "job_id",
        F.col("metadata.persona").alias("persona"),
        F.size("metadata.input_documents").alias("n_documents"),
        F.inline("extracted_sections"),
    )


@register(
    "outline_files",
    oc.sql(
        """select t.doc_id || '_outline.json' as file, title, seq, level, text, page
 from titles t left join outline o using (doc_id)"""
    ),
)
def outline_files(spark, sf):
    """Outlines written one file a document under their derived names, read back and laid flat."""
    path = scratch_path(spark, "outline-files")
    titled = ol.titled_outline(fx.labelled(spark, sf), largest=fx.largest_document(spark, sf))
    named = titled.withColumn("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))
    dc.write_documents(dc.outline_rows(named), path, "_outline.json", order=("seq",))
    back = dc.read_documents(spark, path, "_outline.json").filter("_error is null")
    entry = "struct<title:string, outline:array<struct<level:string, text:string, page:int>>>"
    whole = back.select(F.concat("document", F.lit("_outline.json")).alias("file"), F.from_json("value", entry).alias("o"))
    flat = whole.select("file", "o.title", F.posexplode_outer("o.outline").alias("seq", "e"))
    return flat.select("file", "title", (F.col("seq") + 1).alias("seq"), "e.level", "e.text", "e.page")


@register(
    "parsed_files",
    oc.sql(
        """select doc_id::varchar as document, line_no::int as line, text, null as error from blocks where doc_id % 4 <> 0
 union all select distinct doc_id::varchar, null, null, 'ValueError: unreadable' from blocks where doc_id % 12 = 0
 union all select doc_id::varchar, line_no::int, text, null from blocks where doc_id % 4 = 0 and doc_id % 12 <> 0 and line_no % 2 = 0
 union all select doc_id::varchar, null, null, 'row' from blocks where doc_id % 4 = 0 and doc_id % 12 <> 0 and line_no % 2 = 1"""
    ),
)
def parsed_files(spark, sf):
    """Files through a user's parser that fails on some, and gives values of a wrong type in others."""
    path = scratch_path(spark, "raw-files")
    b = fx.blocks(spark, sf)
    entry = F.to_json(F.struct("line_no", "text"))
    rows = b.select(F.col("doc_id").cast("string").alias("document"), F.lit("[").alias("head"), entry.alias("entry"), F.lit("]").alias("tail"), "line_no")
    dc.write_documents(rows, path, ".raw", order=("line_no",))

    def parser(name: str, content: bytes):
        import json

        if int(name) % 12 == 0:
            raise ValueError("unreadable")
        for line in json.loads(content):
            wrong = int(name) % 4 == 0 and line["line_no"] % 2 == 1
            yield {"document": name, "line": "a word" if wrong else line["line_no"], "text": line["text"]}

    dc.register_parser(spark, "numbered_lines", parser, "document string, line int, text string")
    back = spark.read.format("numbered_lines").option("suffix", ".raw").load(path)
    error = F.when(F.col("_error").startswith("row "), "row").otherwise(F.col("_error"))
    return back.select(F.col("_file").alias("document"), "line", "text", error.alias("error"))


@register(
    "incremental_classify",
    oc.sql("select t.doc_id, title, seq, level, text, page from titles t left join outline o using (doc_id)"),
)
def incremental_classify(spark, sf):
    """Blocks arrive as files in a folder and are labelled and outlined batch by batch."""
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "outlines")
    arrays = bj.block_arrays(fx.blocks(spark, sf), bj.nested_block(("doc_id", "line_no")))
    arrays.repartition(4, "doc_id").select("value").write.text(inbox)  # four files, made by all tasks
    run = stream_classify(
        spark, inbox, out, scratch_path(spark, "progress"), whole_files=False, files_per_batch=4
    )
    run.awaitTermination()
    return spark.read.parquet(f"{out}/outlines").drop("batch")


@register(
    "documents_in_pieces",
    oc.sql("select t.doc_id, title, seq, level, text, page from titles t left join outline o using (doc_id)"),
)
def documents_in_pieces(spark, sf):
    """Every document comes in three pieces, in other files and micro-batches, with a restart before the last."""
    inbox, out, progress = (scratch_path(spark, name) for name in ("pieces", "gathered", "state"))
    b = fx.blocks(spark, sf)
    counts = b.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.min("line_no").alias("_first"))
    whole = b.join(counts, "doc_id").withColumn("n_blocks", F.when(F.col("line_no") == F.col("_first"), F.col("n_blocks")))
    whole = cut_lineage(whole)  # made once for the three pieces
    for k in range(3):
        piece = whole.filter(F.pmod(F.col("line_no") + F.col("doc_id"), F.lit(3)) == k)
        arrays = bj.block_arrays(piece, bj.nested_block(("doc_id", "line_no", "n_blocks")))
        arrays.select("value").repartition(2).write.mode("append").text(inbox)  # two files, made by all tasks
        if k:
            gather_documents(spark, inbox, out, progress, files_per_batch=2).awaitTermination()
    return spark.read.parquet(f"{out}/outlines").drop("batch")
