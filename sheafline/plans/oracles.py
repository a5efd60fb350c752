"""SQL counterparts of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

import re

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+\z', '', 'g')"


def clean(x: str) -> str:
    return (
        rf"coalesce(regexp_replace(regexp_replace({strip(x)}, '{SPACE}+', ' ', 'g'), "
        rf"'[^\x20-\x7E]', '', 'g'), '')"
    )


def n_words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> ''))"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def is_upper(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') and not regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]'))"


def has_any(x: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{n}')" for n in needles) + ")"


def opens_with(x: str, prefixes: list[str]) -> str:
    return "(" + " or ".join(f"starts_with({x}, '{p}')" for p in prefixes) + ")"


def category(x: str) -> str:
    groups = [
        ("cities", ["city", "cities", "town", "region"]),
        ("activities", ["beach", "sport", "adventure", "activity"]),
        ("cuisine", ["food", "cuisine", "restaurant", "wine"]),
        ("tips", ["tip", "guide", "advice", "pack"]),
        ("entertainment", ["night", "entertainment", "bar", "club"]),
    ]
    whens = " ".join(f"when {has_any(f'lower({x})', words)} then '{name}'" for name, words in groups)
    return f"case {whens} else 'other' end"


def importance(x: str) -> str:
    return (
        f"case {x} when 'cities' then 1 when 'activities' then 2 when 'cuisine' then 3 "
        f"when 'tips' then 4 when 'entertainment' then 5 else 99 end"
    )


RULE = """case when font_size >= mx - 0.5 and abs(x_center - 300) < 100 then 'title'
 when font_size >= av + 4 and weight >= 700 then 'H1' when font_size >= av + 3 then 'H2'
 when font_size >= av + 2 then 'H3' when font_size >= av + 1 then 'H4'
 when font_size >= av - 1 then 'Body' else 'Other' end"""

LEVEL = "case {x} when 'title' then 0 when 'H1' then 1 when 'H2' then 2 when 'H3' then 3 when 'H4' then 4 end"

GUIDES = [
    "what you need to know", "key points", "quick guide", "tips for", "guide to", "how to",
    "best places", "things to do", "where to",
]
OPENERS = ["chapter", "section", "part", "introduction", "conclusion", "overview", "summary"]


def relabel(t: str, bold: str, italic: str) -> str:
    return rf"""case when label = 'title' then label
 when {bold} then case when {opens_with(f'lower({t})', OPENERS)} or ({is_upper(t)} and {n_words(t)} <= 6)
   then 'H1' else 'H2' end
 when {italic} then case when {n_words(t)} <= 8 then 'H3' else label end
 when regexp_matches({t}, '^[A-Z]') then case when {n_words(t)} <= 6 then 'H3' else label end
 when {has_any(f'lower({t})', GUIDES)} then 'H2' else label end"""


# Named sub-queries; each may use the ones above it.
CTES: dict[str, str] = {}

CTES["lines"] = """select doc_id, cast(line_no as bigint) line_no, trim(line) as text
 from (select doc_id, unnest(string_split(text, chr(10))) as line,
              generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)
 where trim(line) <> ''"""

CTES["blocks"] = r"""select doc_id, line_no, text, n_words, page, font_size,
 case when bold then 'Sans-Bold' else 'Sans-Regular' end font_name,
 case when bold then 700 else 400 end weight,
 x0, y0, x0 + w x1, y0 + font_size y1, (x0 + x0 + w) / 2 x_center, (y0 + y0 + font_size) / 2 y_center
 from (
 select *, cast(case kind when 'T' then 24.0 when 'A' then 16.5 when 'B' then 15.5 when 'C' then 14.5
                when 'D' then 13.5 when 'S' then 8.0 else 12.0 end as double) font_size,
  kind in ('T', 'A') bold, cast(case when kind = 'T' then 150 else 72 end as double) x0,
  cast(case when kind = 'T' then 300 else 200 end as double) w,
  cast(72 + 30 * ((line_no - 1) % 24) as double) y0
 from (select *, cast(floor((line_no - 1) / 24) as int) + 1 page,
  case when line_no <= 2 and doc_id % 3 = 0 then 'T'
       when n_words <= 8 and (doc_id + line_no) % 5 = 0 then 'A'
       when n_words <= 8 and (doc_id + line_no) % 5 = 1 then 'B'
       when n_words <= 8 and (doc_id + line_no) % 5 = 2 then 'C'
       when n_words <= 8 and (doc_id + line_no) % 5 = 3 then 'D'
       when (doc_id + line_no) % 11 = 0 then 'S' else 'N' end kind
  from (select *, cast(len(regexp_split_to_array(text, '\s+')) as int) n_words from lines) a) b) e"""

CTES["labelled"] = f"""select * exclude (av, mx), {RULE} as label
 from (select *, avg(font_size) over (partition by doc_id) av, max(font_size) over (partition by doc_id) mx
       from blocks)"""

CTES["uniform_blocks"] = """select * replace (cast(12.0 as double) as font_size),
 (doc_id + line_no) % 5 = 0 as is_bold, (doc_id + line_no) % 7 = 0 as is_italic from labelled"""

CTES["shares"] = """select doc_id, max(n) / sum(n) as top_share, count(*) as n_sizes
 from (select doc_id, round_even(font_size, 1) s, count(*) n from blocks group by all) group by doc_id"""

CTES["relabelled"] = f"""select l.* exclude (label), case when top_share > 0.8
   then {relabel(strip('text'), 'false', 'false')} else label end as label
 from labelled l join shares using (doc_id)"""

CTES["first_headings"] = f"""select * exclude (rn) from (
 select doc_id, clean, page, y_center, line_no, label,
  row_number() over (partition by doc_id, clean order by page, y_center, line_no) rn
 from (select *, {clean('text')} as clean from relabelled where label in ('H1', 'H2', 'H3', 'H4'))
 where clean <> '') where rn = 1"""

CTES["outline"] = """select doc_id, cast(row_number() over w as int) as seq,
 case when label = 'H3' and lag(label) over w = 'H1' then 'H2' else label end as level,
 clean as text, page from first_headings window w as (partition by doc_id order by page, y_center, line_no)"""

# Recursive folds: one row per line, carrying the state of its group.
CTES["title_in"] = """select *, font_size >= av + 4 and weight >= 700 and abs(x_center - 300) < 100 as tl,
 row_number() over (partition by doc_id, page order by y_center, line_no) rn
 from (select *, avg(font_size) over (partition by doc_id) av from blocks)"""

CTES["title_fold"] = """(
 select doc_id, page, rn, rn as head, text as gtext, x0 gx0, y0 gy0, x1 gx1, y1 gy1, font_size gsize,
  font_name gfont, tl gtl, line_no gline, weight gweight from title_in where rn = 1
 union all
 select doc_id, page, nrn, case when j then head else nrn end, case when j then gtext || ' ' || ntext else ntext end,
  case when j then least(gx0, nx0) else nx0 end, case when j then least(gy0, ny0) else ny0 end,
  case when j then greatest(gx1, nx1) else nx1 end, case when j then greatest(gy1, ny1) else ny1 end,
  case when j then gsize else nsize end, case when j then gfont else nfont end,
  case when j then gtl else ntl end, case when j then gline else nline end,
  case when j then gweight else nweight end
 from (select g.*, n.rn nrn, n.text ntext, n.x0 nx0, n.y0 ny0, n.x1 nx1, n.y1 ny1, n.font_size nsize,
         n.font_name nfont, n.tl ntl, n.line_no nline, n.weight nweight,
         g.gtl and n.tl and n.y0 - g.gy1 >= 0 and n.y0 - g.gy1 <= 40 and g.gfont = n.font_name
          and abs(g.gsize - n.font_size) <= 1 as j
       from title_fold g join title_in n on n.doc_id = g.doc_id and n.page = g.page and n.rn = g.rn + 1))"""

CTES["merged_titles"] = """select doc_id, gline line_no, page, gtext text, gsize font_size, gfont font_name,
 gweight weight, gx0 x0, gy0 y0, gx1 x1, gy1 y1, n_lines from (
  select *, row_number() over (partition by doc_id, page, head order by rn desc) k,
   count(*) over (partition by doc_id, page, head) n_lines from title_fold) where k = 1"""

CTES["block_in"] = """select *, row_number() over (partition by doc_id, page, label order by y_center, line_no) rn
 from labelled"""

CTES["block_fold"] = """(
 select doc_id, page, label, rn, rn as head, text as gtext, x0 gx0, y0 gy0, x1 gx1, y1 gy1, font_size gsize,
  font_name gfont, line_no gline, y_center gy, y_center ghead from block_in where rn = 1
 union all
 select doc_id, page, label, nrn, case when j then head else nrn end,
  case when j then gtext || ' ' || ntext else ntext end,
  case when j then least(gx0, nx0) else nx0 end, case when j then least(gy0, ny0) else ny0 end,
  case when j then greatest(gx1, nx1) else nx1 end, case when j then greatest(gy1, ny1) else ny1 end,
  case when j then gsize else nsize end, case when j then gfont else nfont end,
  case when j then gline else nline end,
  case when j then (least(gy0, ny0) + greatest(gy1, ny1)) / 2 else ny end,
  case when j then ghead else ny end
 from (select g.*, n.rn nrn, n.text ntext, n.x0 nx0, n.y0 ny0, n.x1 nx1, n.y1 ny1, n.font_size nsize,
         n.font_name nfont, n.line_no nline, n.y_center ny,
         abs(g.gsize - n.font_size) <= 1 and g.gfont = n.font_name and abs(n.y_center - g.gy) <= 50 as j
       from block_fold g join block_in n
        on n.doc_id = g.doc_id and n.page = g.page and n.label = g.label and n.rn = g.rn + 1))"""

CTES["merged_blocks"] = """select doc_id, gline line_no, page, label, gtext text, gsize font_size, gfont font_name,
 gx0 x0, gy0 y0, gx1 x1, gy1 y1, ghead y_head, n_lines from (
  select *, row_number() over (partition by doc_id, page, label, head order by rn desc) k,
   count(*) over (partition by doc_id, page, label, head) n_lines from block_fold) where k = 1"""

CTES["titles"] = f"""select doc_id, coalesce(title, 'Untitled Document') as title
 from (select distinct doc_id from blocks) d left join (
  select doc_id, {clean('text')} as title from merged_blocks where label = 'title'
  qualify row_number() over (partition by doc_id
   order by case when page = 1 then 0 else 1 end, font_size desc, page, y_head, line_no) = 1) t using (doc_id)"""

CTES["jobs"] = "select item_id job_id, 'reader ' || item_id persona, text task from benchmark"

CTES["manifest"] = """select doc_id % n job_id, cast(floor(doc_id / n) as bigint) doc_ord, doc_id
 from documents, (select max(item_id) + 1 n from benchmark)"""


# Cosine of token counts between the headings of a request and its task.
CTES["job_terms"] = f"""select job_id, t, count(*) c from (select job_id, unnest({tokens('task')}) t from jobs)
 group by all"""

CTES["job_norms"] = "select job_id, sqrt(sum(c * c)::double) nj from job_terms group by job_id"


def scored(sections: str, doc: str, pos: str) -> str:
    """Rows of ``sections`` (doc, pos, text) times the jobs that list the document, with the score."""
    return f"""select m.job_id, m.doc_ord, s.*, coalesce(p.score, 0) as score
 from {sections} s join manifest m on m.doc_id = s.{doc} left join (
  select job_id, {doc}, {pos}, sum(h.c * j.c)::double / (sqrt(any_value(h.q)::double) * any_value(nj)) as score
  from (select *, sum(c * c) over (partition by {doc}, {pos}) q from (
         select {doc}, {pos}, t, count(*) c
         from (select {doc}, {pos}, unnest({tokens('text')}) t from {sections}) group by all)) h
  join job_terms j using (t) join job_norms using (job_id) group by all
 ) p on p.job_id = m.job_id and p.{doc} = s.{doc} and p.{pos} = s.{pos}"""


CTES["scored_sections"] = scored("outline", "doc_id", "seq")

CTES["top_sections"] = f"""select * from (
 select *, cast(row_number() over (partition by job_id order by importance, score desc, doc_ord, seq) as int) as rank
 from (select *, {importance('category')} as importance from
  (select *, {category('text')} as category from scored_sections))) where rank <= 5"""

CTES["head_blocks"] = f"""select doc_id, line_no, page, y_center, text from labelled
 where label in ('title', 'H1', 'H2', 'H3', 'H4') and length({strip('text')}) > 3"""

CTES["scored_heads"] = scored("head_blocks", "doc_id", "line_no")

CTES["top_heads"] = """select *, cast(row_number() over (partition by job_id order by doc_ord, doc_rank) as int) as rank
 from (select *, cast(row_number() over (partition by job_id, doc_id order by score desc, line_no) as int) as doc_rank
  from scored_heads) where doc_rank <= 5"""

CTES["near"] = """select * from (select h.doc_id, h.page, h.line_no as head_no, b.line_no as body_no, b.text as body_text,
  cast(row_number() over (partition by h.doc_id, h.line_no order by abs(b.y_center - h.y_center), b.line_no) as int) near_rank
 from head_blocks h join labelled b on b.doc_id = h.doc_id and b.page = h.page and b.label = 'Body')
 where near_rank <= 3"""

CTES["page_bodies"] = f"""select doc_id, page, string_agg(text, ' ' order by line_no) as content
 from labelled where label = 'Body' and {strip('text')} <> '' group by doc_id, page"""

CTES["page_sentences"] = f"""select doc_id, page, idx, {strip('s')} as s from (
  select doc_id, page, unnest(ss) as s, generate_subscripts(ss, 1) as idx
  from (select doc_id, page, regexp_extract_all(content, '[^.!?]+[.!?]*') ss from page_bodies))
 where {strip('s')} <> ''"""

CTES["page_scores"] = f"""select doc_id, page, idx, sum(tf)::double / count(*) as score from (
  select doc_id, page, idx, sum(c) over (partition by doc_id, page, t) tf from (
   select doc_id, page, idx, t, count(*) c from (
    select doc_id, page, idx, unnest({tokens('s')}) t from page_sentences) group by all)) group by all"""

CTES["page_taken"] = f"""select * from (select *, sum(n) over (partition by doc_id, page order by score desc, idx
   rows unbounded preceding) cum from (select *, {n_words('s')} n from page_sentences join page_scores
   using (doc_id, page, idx))) where cum <= 120 or cum - n < 50"""

CTES["page_summaries"] = f"""select doc_id, page, array_to_string(list_slice(list_filter(
  regexp_split_to_array(string_agg(s, ' ' order by idx), '{SPACE}+'), lambda w: w <> ''), 1, 120), ' ') as summary
 from page_taken group by doc_id, page"""



# Blocks without a document or a page: -1 stands for what is not known, and sorts first like it.
GAPS = f"""select * replace (case when doc_id = 3 then -1 else doc_id end as doc_id,
 case when doc_id % 7 = 5 and page = 2 then -1 else page end as page) from ({CTES["blocks"]})"""


def gaps_sql(body: str) -> str:
    """``sql`` over blocks with unknown documents and pages."""
    return sql(body).replace(CTES["blocks"], GAPS)


_PREDICTED = "list_extract(['title', 'H1', 'H2', 'H3', 'H4', 'Body', 'Other'], cast((doc_id * 3 + line_no) % 7 as int) + 1)"

# The labelled blocks of the whole workflow: merged titles, rule, gate, styles of documents of few sizes, levels.
WORKFLOW = f"""select * exclude (n_sizes, rn, low, styled), case when {LEVEL.format(x='styled')} is null then styled
  else list_extract(['title', 'H1', 'H2', 'H3', 'H4'], cast(rn + least(0, low) + 1 as int)) end as label
 from (select *, min(case when {LEVEL.format(x='styled')} is not null then {LEVEL.format(x='styled')} - rn end) over
     (partition by doc_id order by page, y_center, line_no rows unbounded preceding) as low
  from (select *, count({LEVEL.format(x='styled')}) over
      (partition by doc_id order by page, y_center, line_no rows unbounded preceding) as rn
   from (select *, case when n_sizes <= 2 and old_label = 'Other' then case
       when regexp_matches({strip('text')}, '^[0-9]+\\.([0-9]+\\.?)?\\s') then 'H2'
       when {opens_with(f'lower({strip("text")})', ["chapter", "section", "part"])} then 'H1' else old_label end else old_label end as styled
    from (select *, len(list(distinct round_even(font_size, 1)) over (partition by doc_id)) as n_sizes,
       case when confidence >= 0.6::double and line_no % 9 <> 0 then {_PREDICTED} else rule_label end as old_label
     from (select * exclude (av, mx), (line_no % 10) / 10.0::double as confidence, {RULE} as rule_label
      from (select *, (x0 + x1) / 2 as x_center, (y0 + y1) / 2 as y_center, avg(font_size) over (partition by doc_id) as av,
        max(font_size) over (partition by doc_id) as mx from merged_titles))))))"""


def workflow_sql(body: str) -> str:
    """``sql`` over what the whole workflow makes of the lines."""
    names = [n for n in CTES if n in ("lines", "blocks", "title_in", "title_fold", "merged_titles")]
    inner = ",\n".join(f"{n} as {CTES[n]}" if CTES[n].startswith("(") else f"{n} as ({CTES[n]})" for n in names)
    shares = CTES["shares"].replace("from blocks", "from labelled")
    out = sql(body).replace(CTES["labelled"], f"with recursive {inner}\n{WORKFLOW}")
    return out.replace(CTES["shares"], shares)


def sql(body: str) -> str:
    """``body`` with the named sub-queries it needs, directly or through others."""
    wanted: set[str] = set()
    texts = [body]
    while texts:
        current = texts.pop()
        for name, text in CTES.items():
            if name not in wanted and re.search(rf"\b{name}\b", current):
                wanted.add(name)
                texts.append(text)
    if not wanted:
        return body
    parts = [
        f"{name} as {text}" if text.startswith("(") else f"{name} as ({text})"
        for name, text in CTES.items()
        if name in wanted
    ]
    return "with recursive " + ",\n".join(parts) + "\n" + body


ORACLE_REPAIR = sql(
    f"""select doc_id, line_no, label as old_label,
 list_extract(['title', 'H1', 'H2', 'H3', 'H4'], cast(rn + least(0, min(cur - rn) over
   (partition by doc_id order by page, y_center, line_no rows unbounded preceding)) + 1 as int)) as new_label
 from (select *, {LEVEL.format(x='label')} as cur,
   row_number() over (partition by doc_id order by page, y_center, line_no) rn
   from labelled where label in ('title', 'H1', 'H2', 'H3', 'H4'))"""
)
