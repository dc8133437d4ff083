"""Layout spans, headings, sections, HTML blocks and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import estimate_tokens
from ..functions.words import BULLETS

LIST_ITEM = r"^(\(?\d{1,3}[.)]|\(?[a-z][.)]|\(?[ivxIVX]+[.)])\s"


def font_profile(spans: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Body size of each document and its heading thresholds: the size, to a tenth, of most characters; first seen wins ties."""
    sizes = spans.withColumn("size", F.round("size", 1)).groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"), F.min("ord").alias("ord"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("ord"))).alias("body"))
    scale = F.col("body") / 11
    return body.select("doc_id", "body", *[F.round(F.greatest(F.lit(least), F.col("body") + step * scale), 6).alias(f"h{i}") for i, (least, step) in enumerate(zip(s.heading_sizes, (4, 2, 1, 0.5), strict=True), 1)])


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def heading_level(text: Column, size: Column, bold: Column) -> Column:
    """1 to 4, or null for body text; needs the columns h1 to h4."""
    caps, n = is_upper(text), F.length(text)
    many = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= 2
    return (
        F.when((n < 2) | (text.endswith(".") & (n > 100)), None)
        .when(size >= F.col("h1"), 1)
        .when((size >= F.col("h2")) & bold, 2)
        .when(bold & caps & (n <= 80) & many, 2)
        .when((size >= F.col("h3")) & bold, 3)
        .when((size >= F.col("h4")) & (bold | (caps & (n <= 60))), 4)
    )


def bullet(text: Column) -> Column:
    """The list mark a line starts with, or null."""
    t = F.ltrim(text)
    return F.when(F.contains(F.lit(BULLETS), F.substring(t, 1, 1)) & (t != ""), F.substring(t, 1, 1)).when(t.rlike(LIST_ITEM), F.regexp_extract(t, r"^(\S+)\s", 1))


def indent(x0: Column, margin: Column) -> Column:
    return F.when(x0 <= margin + 5, 0).when(x0 <= margin + 25, 1).when(x0 <= margin + 50, 2).otherwise(3)


def section_paths(headings: DataFrame) -> DataFrame:
    """Headings (doc_id, ord, level, title) with the titles of their open ancestors and their own.

    A heading closes all open ones of its level or deeper; the ancestor of level L is the
    last heading of L that no later heading of a level up to L has closed.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for level in range(1, 5):
        own = F.last(F.when(F.col("level") == level, F.struct("ord", "title")), ignorenulls=True).over(w)
        closed = F.lit(0)
        if level > 1:
            closed = F.coalesce(F.max(F.when(F.col("level") < level, F.col("ord"))).over(w), F.lit(0))
        parts.append(F.when((F.col("level") >= level) & (own["ord"] > closed), own["title"]))
    return headings.withColumn("path", F.filter(F.array(*parts), lambda p: p.isNotNull()))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks of which no table of their page covers more than half."""
    wide = F.least("b.x1", "t.x1") - F.greatest("b.x0", "t.x0")
    high = F.least("b.y1", "t.y1") - F.greatest("b.y0", "t.y0")
    area = F.greatest((F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0")), F.lit(1.0))
    over = (F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))) / area > 0.5
    return blocks.alias("b").join(tables.alias("t"), (F.col("b.page") == F.col("t.page")) & over, "left_anti")


def clean_cell(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table_quality(cells: Column) -> Column:
    """Share of filled cells, a tenth more if it is a quarter at least; 0 under two rows or columns."""
    wide = F.array_max(F.transform(cells, F.size))
    filled = F.size(F.filter(F.flatten(cells), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    fill = filled / (F.size(cells) * wide)
    return F.when((F.size(cells) < 2) | (wide < 2), 0.0).when(fill < 0.25, fill).otherwise(F.least(F.lit(1.0), fill + 0.1))


def convert(cells: Column) -> Column:
    """struct(headers, rows): empty rows dropped, cells cleaned; a first row that does not look like a header gets Column A, B, ..."""
    kept = F.filter(cells, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    title = lambda c: F.initcap(F.lower(c)) == c

    def parts(clean: Column) -> Column:
        first = F.get(clean, F.lit(0))
        looks = F.forall(first, lambda c: (c == "") | is_upper(c) | title(c) | (F.length(c) < 50))
        made = F.transform(first, lambda c, i: F.concat(F.lit("Column "), F.char(i + 65)))
        return let(looks, lambda ok: F.struct(F.when(ok, first).otherwise(made).alias("headers"), F.when(ok, F.slice(clean, 2, F.greatest(F.size(clean), F.lit(1)))).otherwise(clean).alias("rows")))

    return let(F.transform(kept, lambda r: F.transform(r, clean_cell)), parts)


def merge_continuations(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, tbl, page, headers, rows) of equal headers on neighbouring pages, pairwise.

    A merged table keeps its first page, so in a run of pages every second one joins its predecessor.
    """
    w = Window.partitionBy("doc_id").orderBy("tbl")
    follows = (F.lag("headers").over(w) == F.col("headers")) & (F.lag("page").over(w) + 1 == F.col("page")) & (F.size("headers") > 0)
    run = tables.withColumn("_new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("tbl")) - 1
    paired = run.withColumn("_pair", F.floor(place / 2))
    grouped = paired.groupBy("doc_id", "_run", "_pair").agg(F.array_sort(F.collect_list(F.struct("tbl", "page", "headers", "rows"))).alias("g"))
    return grouped.select("doc_id", F.col("g")[0]["tbl"].alias("tbl"), F.col("g")[0]["page"].alias("page"), F.col("g")[0]["headers"].alias("headers"), F.flatten(F.transform("g", lambda x: x["rows"])).alias("rows"))


def _cell(c: Column) -> Column:
    return F.trim(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, _cell), " | "), F.lit(" |"))


def row_lines(headers: Column, rows: Column) -> Column:
    """Markdown lines of the rows, padded or cut to the header's width."""
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.size(headers) - F.size(r), F.lit(0)))), 1, F.size(headers))
    return F.transform(rows, lambda r: _line(fit(r)))


def head_lines(headers: Column) -> Column:
    return F.concat(_line(headers), F.lit("\n| "), F.array_join(F.transform(headers, lambda h: F.lit("---")), " | "), F.lit(" |"))


def markdown(headers: Column, rows: Column, caption: Column) -> Column:
    body = F.array_join(F.concat(F.array(head_lines(headers)), row_lines(headers, rows)), "\n")
    return F.concat(F.when(caption != "", F.concat(F.lit("**Table: "), caption, F.lit("**\n\n"))).otherwise(F.lit("")), body)


def row_chunks(headers: Column, rows: Column) -> Column:
    return F.transform(row_lines(headers, rows), lambda r: F.concat(head_lines(headers), F.lit("\n"), r))


def table_chunks(headers: Column, rows: Column, s: Settings = DEFAULTS) -> Column:
    """The whole table if small enough, else batches of rows with the header repeated; none without rows."""
    from ..functions.folds import pack_rows

    whole = markdown(headers, rows, F.lit(""))
    return F.when(F.size(rows) == 0, F.array().cast("array<string>")).when(estimate_tokens(whole) <= s.table_row_threshold, F.array(whole)).otherwise(pack_rows(row_chunks(headers, rows), s.table_max_tokens))


def document_tables(docs: DataFrame, tables: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Chunks (doc_id, chunk_no, text) of documents' tables (doc_id, tbl, headers, rows), in the order of the tables."""
    cut = tables.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "tbl", table_chunks(F.col("headers"), F.col("rows"), s).alias("chunks"))
    listed = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tbl", "chunks"))).alias("t"))
    return listed.select("doc_id", F.posexplode(F.flatten(F.transform("t", lambda x: x["chunks"]))).alias("chunk_no", "text"))


BLOCK = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1\s*>"


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of HTML in order: page_id, ord, kind, text; scripts, styles, navigation and comments are left out."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    kinds, bodies = F.regexp_extract_all(bare, F.lit(BLOCK), F.lit(1)), F.regexp_extract_all(bare, F.lit(BLOCK), F.lit(2))
    plain = lambda b: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"(?i)<br\s*/?>", " "), "<[^>]*>", ""), r"\s+", " "))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(kinds.alias("kind"), F.transform(bodies, plain).alias("text"))).alias("ord", "b"))
    return rows.select("page_id", "ord", F.lower(F.col("b.kind")).alias("kind"), F.col("b.text").alias("text")).where("text <> ''")


def word_lines(found: DataFrame, snap: float = 3.0) -> DataFrame:
    """Words (page, ord, x0, y, text) clustered to lines: a word joins the first line within ``snap`` of its height, else opens one.

    Heights are rounded to a tenth; lines come out by height, their words by x0.
    """
    grouped = found.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "x0", F.round("y", 1).alias("y"), "text"))).alias("w"))
    start = F.struct(F.array().cast("array<double>").alias("lines"), F.array().cast("array<double>").alias("of"))

    def step(s: Column, w: Column) -> Column:
        near = F.get(F.filter(s["lines"], lambda y: F.abs(y - w["y"]) <= snap), F.lit(0))
        return F.struct(F.when(near.isNull(), F.concat(s["lines"], F.array(w["y"]))).otherwise(s["lines"]).alias("lines"), F.concat(s["of"], F.array(F.coalesce(near, w["y"]))).alias("of"))

    placed = grouped.withColumn("of", F.aggregate("w", start, step, lambda s: s["of"]))
    rows = placed.select("page", F.explode(F.arrays_zip("w", "of")).alias("z")).select("page", F.col("z.of").alias("y"), F.struct(F.col("z.w.x0").alias("x0"), F.col("z.w.ord").alias("ord"), F.col("z.w.text").alias("text")).alias("t"))
    lines = rows.groupBy("page", "y").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return lines.select("page", "y", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
