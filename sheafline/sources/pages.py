"""Blocks from tagged pages: a linear tokenizer and a stack of open elements.

A page is read once, from left to right. Text between two tags of blocks is a run: it belongs to the innermost open element that
carries text, so text in front of, between and behind nested elements keeps its place and its tag. Tags in the line (links, bold, ...)
do not end a run, a line break is a blank, character references are resolved in the text in which they stand, and comments, scripts
and styles are no text. Missing end tags are supplied as browsers do: a block closes an open paragraph, a list item the one before it in
the same list, an end tag whatever was opened inside; an end tag that nothing opened is ignored.

Time follows the length of a page: every step moves forward, the nearest carrying element is kept for each open one, and a
quotation mark that is never closed is looked for once.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# The tags that carry text, and the size and weight each stands for.
PAGE_TAGS = {
    "title": (24.0, 700), "h1": (16.5, 700), "p": (12.0, 400), "li": (12.0, 400), "div": (12.0, 400),
    "footer": (8.0, 400),
}
# Tags in the line, tags without content, lists, and elements whose content is no text.
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
VOID_TAGS = frozenset("area base col embed hr input link meta param source track".split())
LISTS = frozenset(("ul", "ol", "menu"))
RAW_TAGS = frozenset(("script", "style"))

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_TAG_END = re.compile(r"=\s*([\"'])|>")
_ROWS = 20_000


class _Stack:
    """Open elements, the carrying tag that holds at each of them, and how often each name is open."""

    def __init__(self):
        self.names: list[str] = []
        self.carriers: list[str | None] = [None]
        self.items: list[int] = []  # places of list items and lists
        self.count: Counter[str] = Counter()

    def push(self, name: str) -> None:
        if name == "li" or name in LISTS:
            self.items.append(len(self.names))
        self.names.append(name)
        self.carriers.append(name if name in PAGE_TAGS else self.carriers[-1])
        self.count[name] += 1

    def pop(self) -> str:
        name = self.names.pop()
        self.carriers.pop()
        self.count[name] -= 1
        if self.items and self.items[-1] == len(self.names):
            self.items.pop()
        return name

    def open(self, name: str) -> None:
        if self.names and self.names[-1] == "p":
            self.pop()
        if name == "li" and self.items and self.names[self.items[-1]] == "li":
            for _ in range(len(self.names) - self.items[-1]):
                self.pop()
        if name not in VOID_TAGS:
            self.push(name)

    def close(self, name: str) -> None:
        if self.count[name]:
            while self.pop() != name:
                pass


def page_runs(page: str) -> list[tuple[str, str]]:
    """(tag, text) of the runs of a page, in order; see the module."""
    stack = _Stack()
    runs: list[tuple[str, str]] = []
    parts: list[str] = []
    unclosed: set[str] = set()

    def end_of_run() -> None:
        if parts:
            text = "".join(parts)
            if stack.carriers[-1] is not None:
                runs.append((stack.carriers[-1], text))
            parts.clear()

    def tag_end(at: int) -> int:
        """Place behind the tag that goes on at ``at``; quoted values may hold what ends a tag."""
        while found := _TAG_END.search(page, at):
            quote = found[1]
            if quote is None:
                return found.end()
            stop = -1 if quote in unclosed else page.find(quote, found.end())
            if stop < 0:
                unclosed.add(quote)
            at = max(stop + 1, found.end())
        return len(page)

    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark != at:
            text = page[at : mark if mark >= 0 else n]
            parts.append(entities.unescape(text) if "&" in text else text)
            at = mark if mark >= 0 else n
            continue
        found = _NAME.match(page, at)
        if found is None:
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = stop + 3 if stop >= 0 else n
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                stop = page.find(">", at)
                at = stop + 1 if stop >= 0 else n
            else:
                parts.append("<")
                at += 1
            continue
        name, closes = found[1].lower(), page[at + 1] == "/"
        stop = tag_end(found.end())
        if name in INLINE_TAGS:
            if name == "br":
                parts.append(" ")
        else:
            end_of_run()
            if closes:
                stack.close(name)
            elif name in RAW_TAGS:
                last = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, stop)
                stop = tag_end(last.start() + 2) if last else n
            elif page[stop - 2 : stop] != "/>":
                stack.open(name)
            elif stack.names and stack.names[-1] == "p":
                stack.pop()
        at = stop
    end_of_run()
    return runs


def blocks_from_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Runs of the pages as blocks: ``line_no`` numbers the runs with text, the tag gives size and weight.

    A null page has no blocks. Nothing is shuffled; a page is the unit of work.
    """
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            numbers: list[int] = []
            tags: list[str] = []
            texts: list[str] = []

            def out() -> pa.RecordBatch:
                found = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64()), pa.array(tags, pa.string()), pa.array(texts, pa.string())],
                    names=["page", "line_no", "tag", "text"],
                )
                for x in (at, numbers, tags, texts):
                    x.clear()
                return found

            for i in range(batch.num_rows):
                number = 0
                for tag, text in page_runs(batch.column(1)[i].as_py() or ""):
                    if text := text.strip(tx.SPACES):
                        number += 1
                        at.append(i), numbers.append(number), tags.append(tag), texts.append(text)
                if len(at) >= _ROWS:
                    yield out()
            yield out()

    sizes = F.create_map(*[F.lit(x) for t, (s, _) in PAGE_TAGS.items() for x in (t, s)])
    weights = F.create_map(*[F.lit(x) for t, (_, w) in PAGE_TAGS.items() for x in (t, w)])
    rows = pages.select(F.col(page_id).alias("page"), F.col(html).alias("html")).mapInArrow(run, f"page {kind}, line_no bigint, tag string, text string")
    return rows.withColumns({"font_size": sizes[F.col("tag")], "weight": weights[F.col("tag")]}).withColumnRenamed("page", page_id)
