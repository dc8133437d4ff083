"""Parse dispatch for pages: a stack-based HTML reader first, line and pattern parsing as fallbacks, errors as rows.

The reader keeps the open elements on a stack, so list items know their depth, a table is
one block with its cells, and what is left open ends where HTML says it does. It runs on
Arrow batches; what comes before and after it is plain columns.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import prepare
from .parsing import html_blocks

SILENT = {"script", "style", "nav", "head", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li"}
#: What an opening tag ends, and the elements that this does not reach across.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}} | {t: {"p"} for t in ("h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div", "article")}
WALLS = {"li": {"ul", "ol"}, "p": {"li", "td", "th", "div", "article"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}}
#: Open elements beyond this are not read but an error.
DEEPEST = 500

BLOCK = pa.list_(pa.struct([("kind", pa.string()), ("depth", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.list_(pa.string())))]))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[dict] = []
        self.taking: list[dict] = []
        self.tables: list[dict] = []

    def _push(self, kind: str) -> None:
        depth = sum(t in ("ul", "ol") for t in self.open) if kind == "li" else 0
        self.blocks.append({"kind": kind, "depth": depth, "text": [], "cells": None})
        self.taking.append(self.blocks[-1])

    def _end(self, tag: str) -> None:
        if tag in BLOCKS and not self.tables:
            self.taking.pop()
        elif tag == "table":
            self.tables.pop()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.handle_data(" ")
            return
        ends, walls = CLOSES.get(tag, set()), WALLS.get(tag, WALLS["p"])
        while (at := next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i] in ends or self.open[i] in walls), None)) is not None and self.open[at] in ends:
            self._unwind(at)
        self.open.append(tag)
        if len(self.open) > DEEPEST:
            raise RecursionError("too deep")
        if SILENT & set(self.open):
            return
        if tag == "table":
            self.blocks.append({"kind": "table", "depth": len(self.tables), "text": [], "cells": []})
            self.tables.append(self.blocks[-1])
        elif self.tables and tag == "tr":
            self.tables[-1]["cells"].append([])
        elif self.tables and tag in ("td", "th"):
            (self.tables[-1]["cells"] or self.tables[-1]["cells"].append([]) or self.tables[-1]["cells"])[-1].append([])
        elif tag in BLOCKS and not self.tables:
            self._push(tag)

    def _unwind(self, at: int) -> None:
        while len(self.open) > at:
            loud = not SILENT & set(self.open)
            tag = self.open.pop()
            if loud:
                self._end(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            self._unwind(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data):
        if SILENT & set(self.open):
            return
        if self.tables:
            row = self.tables[-1]["cells"]
            if row and row[-1] and any(t in ("td", "th") for t in self.open):
                row[-1][-1].append(data)
        elif self.taking:
            self.taking[-1]["text"].append(data)


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def read(markup: str) -> list[dict]:
    """Blocks in the order in which they open: headings, paragraphs, list items with their depth, tables with their cells; empty ones are left out."""
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    out = []
    for b in reader.blocks:
        cells = None if b["cells"] is None else [[_clean(c) for c in row] for row in b["cells"] if row]
        text = _clean(b["text"]) if cells is None else "\n".join(" | ".join(row) for row in cells)
        if text.strip(" |\n"):
            out.append({"kind": b["kind"], "depth": b["depth"], "text": text, "cells": cells})
    return out


def _work(batches):
    for batch in batches:
        blocks, errors = [], []
        for markup in batch.column(1).to_pylist():
            try:
                blocks.append(read(markup))
                errors.append(None)
            except (RecursionError, AssertionError, ValueError) as error:
                blocks.append(None)
                errors.append(f"reader failed: {str(error)[:80]}")
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(blocks, BLOCK), pa.array(errors, pa.string())], names=["page_id", "html", "blocks", "failed"])


def parse(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) -> page_id, parser, error, ord, kind, depth, text, cells: a row for each block, or one for a page without any.

    empty: no text at all; text without a tag is parsed by its lines; where the reader
    fails (too deep) the patterns take over, and its error stays beside their blocks; a page
    in which no parser finds a block has the error no content.
    """
    prepare(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    given = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    blank, marked = F.trim(F.regexp_replace("html", r"\s+", " ")) == "", F.col("html").rlike(r"<[a-zA-Z!/][^>]*>")
    line = lambda t, i: F.struct(F.lit("p").alias("kind"), F.lit(0).alias("depth"), F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text"), F.lit(None).cast("array<array<string>>").alias("cells"))
    lines = F.filter(F.transform(F.split("html", "\n"), line), lambda b: b["text"] != "")
    none = F.lit(None).cast("string")
    empty = given.where(blank).select("page_id", none.alias("parser"), F.lit("empty").alias("error"), F.array().cast("array<struct<kind:string,depth:int,text:string,cells:array<array<string>>>>").alias("blocks"))
    plain = given.where(~blank & ~marked).select("page_id", F.lit("lines").alias("parser"), none.alias("error"), lines.alias("blocks"))
    read_ = given.where(~blank & marked).mapInArrow(_work, f"page_id {kind}, html string, blocks array<struct<kind:string,depth:int,text:string,cells:array<array<string>>>>, failed string")
    # The patterns see only what the reader could not read.
    spare = html_blocks(read_.where("failed is not null").select("page_id", "html"))
    block = F.struct("ord", F.struct("kind", F.lit(0).alias("depth"), "text", F.lit(None).cast("array<array<string>>").alias("cells")).alias("b"))
    second = spare.groupBy("page_id").agg(F.array_sort(F.collect_list(block)).alias("s")).select("page_id", F.transform("s", lambda x: x["b"]).alias("more"))
    failed = read_.where("failed is not null").select("page_id", "failed").join(second, "page_id", "left").select("page_id", F.lit("patterns").alias("parser"), F.col("failed").alias("error"), "more")
    first = read_.where("failed is null").select("page_id", F.lit("reader").alias("parser"), none.alias("error"), "blocks")
    every = empty.unionByName(plain).unionByName(first).unionByName(failed.withColumn("blocks", F.coalesce("more", F.array().cast("array<struct<kind:string,depth:int,text:string,cells:array<array<string>>>>"))).drop("more"))
    told = every.withColumn("error", F.when((F.size("blocks") == 0) & (F.coalesce("error", F.lit("")) != "empty"), "no content").otherwise(F.col("error")))
    rows = told.select("page_id", "parser", "error", F.posexplode_outer("blocks").alias("ord", "b"))
    return rows.select("page_id", "parser", "error", "ord", "b.kind", "b.depth", "b.text", "b.cells")
