"""Queries on layout, sections, tables and HTML."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import estimate_tokens
from ..operators import chunking as C
from ..operators import parsing as P
from ..operators import tables as E
from .base import query, table
from .chunks import _PARENTS, LINES

#: Lines of documents as laid-out spans: some as headings, list items and capitals, in several sizes and places.
SPAN = {
    "text": "CASE ord % 9 WHEN 1 THEN 'SECTION ' || ord || ' OF ' || doc_id WHEN 2 THEN '- ' || text WHEN 3 THEN ord || '. ' || text WHEN 4 THEN 'Part ' || ord WHEN 5 THEN substring(text, 1, 120) || '.' ELSE text END",
    "size": "CASE (doc_id + ord) % 7 WHEN 0 THEN 18.0 WHEN 1 THEN 13.5 WHEN 2 THEN 11.04 WHEN 3 THEN 11.6 ELSE 11.0 END", "bold": "ord % 3 = 1", "x0": "CASE ord % 4 WHEN 0 THEN 50 WHEN 1 THEN 60 WHEN 2 THEN 80 ELSE 120 END", "y0": "(ord * 37) % 950",
}
SP = f"(SELECT doc_id, ord, {', '.join(f'({x})::DOUBLE AS {c}' if c == 'size' else f'{x} AS {c}' for c, x in SPAN.items())} FROM (SELECT doc_id, cast(ord AS INTEGER) AS ord, text FROM ({LINES})))"


def spans(spark, d):
    found = {c: F.expr(x) for c, x in SPAN.items()}
    return C.paragraphs(table(spark, d, "documents")).select("doc_id", "ord", *[(x.cast("double") if c == "size" else x).alias(c) for c, x in found.items()])


_PROFILE = f"""SELECT doc_id, body, {', '.join(f'round(greatest({least}::DOUBLE, body + {step}::DOUBLE * (body / 11)), 6) AS h{i}' for i, (least, step) in enumerate(zip(DEFAULTS.heading_sizes, (4, 2, 1, 0.5), strict=True), 1))}
FROM (SELECT doc_id, arg_max(size, (chars, -first)) AS body FROM (SELECT doc_id, round(size, 1) AS size, sum(length(text)) AS chars, min(ord) AS first FROM {SP} GROUP BY doc_id, round(size, 1)) GROUP BY doc_id)"""


@query("PRS2", _PROFILE)
def prs2(spark, d):
    return P.font_profile(spans(spark, d))


_UP = "upper(text) = text AND lower(text) <> text"
_LEVEL = f"""SELECT s.doc_id, s.ord, s.text, CASE WHEN length(text) < 2 OR (text LIKE '%.' AND length(text) > 100) THEN NULL WHEN size >= h1 THEN 1 WHEN size >= h2 AND bold THEN 2
 WHEN bold AND {_UP} AND length(text) <= 80 AND len(string_split(text, ' ')) >= 2 THEN 2 WHEN size >= h3 AND bold THEN 3 WHEN size >= h4 AND (bold OR ({_UP} AND length(text) <= 60)) THEN 4 END AS level FROM {SP} s JOIN ({_PROFILE}) p USING (doc_id)"""


@query("PRS3", f"SELECT doc_id, ord, level FROM ({_LEVEL})")
def prs3(spark, d):
    rows = spans(spark, d).join(P.font_profile(spans(spark, d)), "doc_id")
    return rows.select("doc_id", "ord", P.heading_level(F.col("text"), F.col("size"), F.col("bold")).alias("level"))


@query("PRS4", f"SELECT doc_id, ord, CASE WHEN left(ltrim(text), 1) IN ('•', '·', '◦', '▪', '▸', '‣', '➢', '➤', '-', '*') THEN left(ltrim(text), 1) WHEN regexp_matches(ltrim(text), '^(\\(?\\d{{1,3}}[.)]|\\(?[a-z][.)]|\\(?[ivxIVX]+[.)])\\s') THEN regexp_extract(ltrim(text), '^(\\S+)\\s', 1) END AS mark FROM {SP}")
def prs4(spark, d):
    return spans(spark, d).select("doc_id", "ord", P.bullet(F.col("text")).alias("mark"))


@query("PRS5", f"SELECT doc_id, ord, CASE WHEN x0 <= 55 THEN 0 WHEN x0 <= 75 THEN 1 WHEN x0 <= 100 THEN 2 ELSE 3 END AS level FROM {SP}")
def prs5(spark, d):
    return spans(spark, d).select("doc_id", "ord", P.indent(F.col("x0"), F.lit(50)).alias("level"))


@query("PRS6", f"SELECT doc_id, ord, y0 / 842.0 >= {DEFAULTS.footnote_fraction} AS footnote FROM {SP}")
def prs6(spark, d):
    return spans(spark, d).select("doc_id", "ord", (F.col("y0") / 842.0 >= DEFAULTS.footnote_fraction).alias("footnote"))


@query("PRS8", f"SELECT doc_id, arg_max(text, (length(text), -ord)) AS dominant, count(*) AS n FROM {SP} GROUP BY doc_id")
def prs8(spark, d):
    return spans(spark, d).groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("dominant"), F.count(F.lit(1)).alias("n"))


@query("PRS9", f"SELECT doc_id, ord, CASE WHEN size > 18 THEN 1 WHEN size > 14 THEN 2 WHEN {_UP} AND length(text) <= 60 THEN 2 END AS level FROM {SP}")
def prs9(spark, d):
    t = F.col("text")
    return spans(spark, d).select("doc_id", "ord", F.when(F.col("size") > 18, 1).when(F.col("size") > 14, 2).when(P.is_upper(t) & (F.length(t) <= 60), 2).alias("level"))


#: A customer's orders as the headings of a document.
H = "(SELECT o_custkey AS doc_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS ord, cast(1 + (o_orderkey * 7) % 4 AS INTEGER) AS level, o_orderpriority || ' ' || o_orderkey AS title FROM orders)"


def headings(spark, d):
    ord_ = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), ord_.alias("ord"), F.expr("cast(1 + (o_orderkey * 7) % 4 AS INT)").alias("level"), F.expr("o_orderpriority || ' ' || o_orderkey").alias("title"))


_PATHS = f"SELECT h.doc_id, h.ord, h.level, h.title, (SELECT string_agg(a.title, ' > ' ORDER BY a.ord) FROM {H} a WHERE a.doc_id = h.doc_id AND (a.ord = h.ord OR (a.ord < h.ord AND a.level < h.level AND NOT EXISTS (SELECT 1 FROM {H} c WHERE c.doc_id = h.doc_id AND c.ord > a.ord AND c.ord <= h.ord AND c.level <= a.level)))) AS path FROM {H} h"


@query("PRS7", f"SELECT doc_id, ord, path FROM ({_PATHS})")
def prs7(spark, d):
    return P.section_paths(headings(spark, d)).select("doc_id", "ord", F.array_join("path", " > ").alias("path"))


@query("HLP5", f"SELECT doc_id, ord, cast(len(string_split(path, ' > ')) AS INTEGER) AS depth FROM ({_PATHS})")
def hlp5(spark, d):
    return P.section_paths(headings(spark, d)).select("doc_id", "ord", F.size("path").alias("depth"))


@query("PRS12", f"SELECT doc_id, string_agg(repeat('  ', level - 1) || title, chr(10) ORDER BY ord) AS toc FROM {H} GROUP BY doc_id")
def prs12(spark, d):
    rows = headings(spark, d).withColumn("line", F.concat(F.expr("repeat('  ', level - 1)"), "title"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("toc"))


@query("PRS22", f"SELECT doc_id, string_agg(path, '; ' ORDER BY ord) AS paths FROM ({_PATHS}) GROUP BY doc_id")
def prs22(spark, d):
    return prs7(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda x: x["path"]), "; ").alias("paths"))


#: Orders as boxes on their customer's page, where the customer is a table.
BLOCK = {"page": "o_custkey", "id": "o_orderkey", "x0": "o_orderkey % 50", "y0": "o_orderkey % 70", "x1": "o_orderkey % 50 + o_orderkey % 13", "y1": "o_orderkey % 70 + 5 + o_orderkey % 11"}
AREA = {"page": "c_custkey", "x0": "c_nationkey", "y0": "c_nationkey * 2", "x1": "c_nationkey + 20", "y1": "c_nationkey * 2 + 25"}


def _columns(some: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {c}" for c, x in some.items())


@query("PRS10", f"SELECT id FROM (SELECT {_columns(BLOCK)} FROM orders) b WHERE NOT EXISTS (SELECT 1 FROM (SELECT {_columns(AREA)} FROM customer) t WHERE t.page = b.page AND greatest(least(b.x1, t.x1) - greatest(b.x0, t.x0), 0) * greatest(least(b.y1, t.y1) - greatest(b.y0, t.y0), 0) / greatest((b.x1 - b.x0) * (b.y1 - b.y0), 1) > 0.5)")
def prs10(spark, d):
    boxes = lambda name, some: table(spark, d, name).select(*[F.expr(x).alias(c) for c, x in some.items()])
    return P.outside_tables(boxes("orders", BLOCK), boxes("customer", AREA)).select("id")


#: Customers' orders as raw tables: rows joined by '~', cells by '^', an empty cell is missing. Four customers are the tables of a document.
TABLE = {"doc_id": "cast((o_custkey - o_custkey % 4) / 4 AS bigint)", "tbl": "cast(o_custkey % 4 AS int)", "page": "cast(CASE WHEN o_custkey % 3 = 0 THEN 9 ELSE o_custkey % 4 END AS int)"}
FIRST = "CASE o_custkey % 7 WHEN 0 THEN 'this first row has a cell that is a good deal longer than fifty characters^x' WHEN 1 THEN 'K^V^W' ELSE 'Key^Status^Priority' END"
CELL = "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE cast(o_orderkey AS {}) END || '^' || CASE WHEN o_orderkey % 4 = 0 THEN '  a   ' || o_orderstatus || '|' ELSE o_orderstatus END || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '^' || o_orderpriority END"
CELLS = f"(SELECT doc_id, tbl, page, list_transform(string_split(raw, '~'), lambda r: list_transform(string_split(r, '^'), lambda c: nullif(c, ''))) AS cells FROM (SELECT {_columns(TABLE)}, {FIRST} || '~' || string_agg({CELL.format('VARCHAR')}, '~' ORDER BY o_orderkey) || CASE WHEN o_custkey % 2 = 0 THEN '~^' ELSE '' END AS raw FROM orders GROUP BY o_custkey))"


def raw_tables(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.expr(CELL.format("string")).alias("row")))).alias("r"))
    raw = F.concat(F.expr(FIRST), F.lit("~"), F.array_join(F.transform("r", lambda x: x["row"]), "~"), F.expr("CASE WHEN o_custkey % 2 = 0 THEN '~^' ELSE '' END"))
    cells = F.transform(F.split(raw, "~"), lambda r: F.transform(F.split(r, r"\^"), lambda c: F.nullif(c, F.lit(""))))
    return rows.select(*[F.expr(x).alias(c) for c, x in TABLE.items()], cells.alias("cells"))


_WIDE = "list_max(list_transform(cells, lambda r: len(r)))"
_FILL = f"(len(list_filter(flatten(cells), lambda c: trim(coalesce(c, '')) <> '')) / (len(cells) * {_WIDE}))"


@query("PRS13", f"SELECT doc_id, tbl, round(cast(CASE WHEN len(cells) < 2 OR {_WIDE} < 2 THEN 0.0 WHEN {_FILL} < 0.25 THEN {_FILL} ELSE least(1.0, {_FILL} + 0.1) END AS DOUBLE), 6) AS quality FROM {CELLS}")
def prs13(spark, d):
    return raw_tables(spark, d).select("doc_id", "tbl", F.round(P.table_quality(F.col("cells")), 6).alias("quality"))


_KEPT = "list_transform(list_filter(cells, lambda r: len(list_filter(r, lambda c: trim(coalesce(c, '')) <> '')) > 0), lambda r: list_transform(r, lambda c: trim(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g'))))"
_LOOKS = "len(list_filter(kept[1], lambda c: NOT (c = '' OR (upper(c) = c AND lower(c) <> c) OR length(c) < 50))) = 0"
_CONV = f"(SELECT doc_id, tbl, page, CASE WHEN {_LOOKS} THEN kept[1] ELSE list_transform(range(len(kept[1])), lambda i: 'Column ' || chr(cast(65 + i AS INTEGER))) END AS headers, CASE WHEN {_LOOKS} THEN kept[2:] ELSE kept END AS rows FROM (SELECT doc_id, tbl, page, {_KEPT} AS kept FROM {CELLS}) WHERE len(kept) > 0)"


def converted(spark, d):
    rows = raw_tables(spark, d).where(F.exists("cells", lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")))
    return rows.withColumn("t", P.convert(F.col("cells"))).select("doc_id", "tbl", "page", F.col("t.headers").alias("headers"), F.col("t.rows").alias("rows"))


@query("PRS14", f"SELECT doc_id, tbl, array_to_string(headers, ',') AS headers FROM {_CONV}")
def prs14(spark, d):
    return converted(spark, d).select("doc_id", "tbl", F.array_join("headers", ",").alias("headers"))


_FLATROWS = "array_to_string(list_transform({}, lambda r: array_to_string(r, ',')), ';')"


def _flat(rows):
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, ",")), ";")


@query("PRS16", f"SELECT doc_id, tbl, {_FLATROWS.format('rows')} AS cells FROM {_CONV}")
def prs16(spark, d):
    return converted(spark, d).select("doc_id", "tbl", _flat(F.col("rows")).alias("cells"))


@query("HLP7", f"SELECT doc_id, tbl, {_FLATROWS.format(_KEPT)} AS cells FROM {CELLS}")
def hlp7(spark, d):
    kept = F.filter("cells", lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return raw_tables(spark, d).select("doc_id", "tbl", _flat(F.transform(kept, lambda r: F.transform(r, P.clean_cell))).alias("cells"))


@query("HLP24", f"SELECT doc_id, tbl, cast(len(rows) AS INTEGER) AS n_rows, cast(len(headers) AS INTEGER) AS n_cols FROM {_CONV}")
def hlp24(spark, d):
    return converted(spark, d).select("doc_id", "tbl", F.size("rows").alias("n_rows"), F.size("headers").alias("n_cols"))


_MERGED = f"""(SELECT doc_id, min(tbl) AS tbl, min(page) AS page, arg_min(headers, tbl) AS headers, flatten(list(rows ORDER BY tbl)) AS rows FROM (
 SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY tbl) - 1) // 2 AS pair FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY tbl) AS run FROM (
  SELECT *, CASE WHEN lag(headers) OVER (PARTITION BY doc_id ORDER BY tbl) = headers AND lag(page) OVER (PARTITION BY doc_id ORDER BY tbl) + 1 = page THEN 0 ELSE 1 END AS fresh FROM {_CONV}))) GROUP BY doc_id, run, pair)"""


@query("PRS17", f"SELECT doc_id, tbl, page, {_FLATROWS.format('rows')} AS cells FROM {_MERGED}")
def prs17(spark, d):
    return P.merge_continuations(converted(spark, d)).select("doc_id", "tbl", "page", _flat(F.col("rows")).alias("cells"))


#: Customers' orders drawn as tables on pages: every second one with rules, the others by gaps; some ruled ones with
#: three more columns that stay empty, as do two of the first three; on some pages a box lost its end.
RULED, SPARSE, LOST = "o_custkey % 2 = 0", "o_custkey % 10 = 4", "o_custkey % 10 IN (6, 7)"


def drawn(spark, d):
    """Words and rules of the pages: (words, rules), the latter with small errors of place. An order makes several boxes and a page's size
    many rules, so both are dealt to the session's partitions: put together by their own bytes, they make tasks that write too much."""
    orders, parts = table(spark, d, "orders"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    line = lambda n, *cells: F.struct(n.cast("int").alias("n"), F.array(*cells).alias("cells"))
    head = line(F.lit(0), *map(F.lit, ("Key", "Status", "Priority")))
    own = line(F.col("n"), F.col("o_orderkey").cast("string"), *[F.when(F.expr(SPARSE), "").otherwise(F.col(c)) for c in ("o_orderstatus", "o_orderpriority")])
    rows = orders.repartition(parts, "o_custkey").select("o_custkey", nth.alias("n"), "o_orderkey", "o_orderstatus", "o_orderpriority").select("o_custkey", F.inline(F.when(F.col("n") == 1, F.array(head, own)).otherwise(F.array(own))))
    cells = rows.select("o_custkey", "n", F.posexplode("cells").alias("c", "cell")).select("*", F.posexplode(F.split("cell", " ")).alias("w", "text")).where("text <> ''")
    x0 = 50 + F.col("c") * 100 + F.col("w") * 30
    end = F.when(F.expr(LOST) & (F.col("n") == 1) & (F.col("c") == 0), None).otherwise(x0 + F.least(F.lit(27), 4 * F.length("text")))
    words = cells.select(F.col("o_custkey").alias("page"), x0.alias("x0"), (100 + 20 * F.col("n") + F.col("c") % 2).alias("y0"), end.alias("x1"), (110 + 20 * F.col("n") + F.col("c") % 2).alias("y1"), "text")
    sizes = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("rows")).where(RULED).repartition(parts, "o_custkey", "rows").withColumn("columns", F.when(F.expr(SPARSE), 6).otherwise(3))
    right, bottom = 45 + F.col("columns") * 100, 115 + 20 * F.col("rows")
    across = F.transform(F.sequence(F.lit(0), F.col("rows") + 1), lambda k: F.struct(F.lit(45.0).alias("x0"), (95 + 20 * k + (k % 3 - 1) * 0.5).alias("y0"), right.cast("double").alias("x1"), (95 + 20 * k + (k % 3 - 1) * 0.5).alias("y1")))
    down = F.transform(F.sequence(F.lit(0), F.col("columns")), lambda k: F.struct((45 + 100 * k + (k % 2) * 0.7).cast("double").alias("x0"), F.lit(95.0).cast("double").alias("y0"), (45 + 100 * k + (k % 2) * 0.7).cast("double").alias("x1"), bottom.cast("double").alias("y1")))
    number = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    return words, sizes.select(F.col("o_custkey").alias("page"), F.inline(F.concat(across.cast(number), down.cast(number))))


_DRAWN = f"""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN {SPARSE} THEN '' ELSE o_orderstatus END AS s, CASE WHEN {SPARSE} THEN '' ELSE o_orderpriority END AS p FROM orders),
t AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || ',' || s || ',' || p || CASE WHEN {SPARSE} THEN ',,,' ELSE '' END, ';' ORDER BY o_orderkey) AS cells FROM o GROUP BY o_custkey),
q AS (SELECT *, CASE WHEN {SPARSE} THEN (n + 3) / (6 * (n + 1)) ELSE 1.0 END AS fill FROM t)
SELECT o_custkey AS page, CASE WHEN {LOST} THEN NULL WHEN {RULED} THEN 'lattice' ELSE 'stream' END AS method, CASE WHEN NOT ({LOST}) THEN round(CASE WHEN fill < 0.25 THEN fill ELSE least(1.0, fill + 0.1) END, 6)::DOUBLE END AS quality,
 CASE WHEN {LOST} THEN NULL WHEN {SPARSE} THEN 'Key,Status,Priority,,,' ELSE 'Key,Status,Priority' END AS headers, CASE WHEN NOT ({LOST}) THEN cells END AS cells, CASE WHEN {LOST} THEN 'broken box' END AS error FROM q WHERE ({LOST}) OR fill >= {DEFAULTS.table_quality_min}"""


@query("PRS15", _DRAWN)
def prs15(spark, d):
    """Tables of all pages, ruled and unruled, that are good enough."""
    return E.extract(*drawn(spark, d)).select("page", "method", "quality", F.array_join("headers", ",").alias("headers"), _flat(F.col("rows")).alias("cells"), "error")


@query("HLP6", f"SELECT coalesce(error, method) AS outcome, count(*) AS n FROM ({_DRAWN}) GROUP BY 1")
def hlp6(spark, d):
    """Pages by how their tables came out; broken ones have none and stop no other."""
    return prs15(spark, d).groupBy(F.coalesce("error", "method").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("PRS18", f"SELECT page, quality, headers, cells FROM ({_DRAWN.replace(LOST, 'false')}) WHERE method = 'lattice' AND page % 4 = 0")
def prs18(spark, d):
    """Tables that are drawn as a rectangle for each cell, on every fourth page."""
    words, rules = drawn(spark, d)
    at = lambda axis: F.array_sort(F.collect_list(F.when(F.col(f"{axis}0") == F.col(f"{axis}1"), F.col(f"{axis}0"))))
    lines = rules.where("page % 4 = 0").groupBy("page").agg(at("y").alias("ys"), at("x").alias("xs"))
    steps = lambda lines: F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda a, i: F.struct(a.alias("a"), F.get(lines, i + 1).alias("b")))
    boxes = lines.select("page", F.explode(steps(F.col("ys"))).alias("y"), "xs").select("page", "y", F.explode(steps(F.col("xs"))).alias("x"))
    cells = boxes.select("page", F.col("x.a").alias("x0"), F.col("y.a").alias("y0"), F.col("x.b").alias("x1"), F.col("y.b").alias("y1"))
    mended = words.where("page % 4 = 0").withColumn("x1", F.coalesce("x1", F.col("x0") + 8))
    return E.drawn(mended, cells).select("page", "quality", F.array_join("headers", ",").alias("headers"), _flat(F.col("rows")).alias("cells"))


_MD = "'| ' || array_to_string(list_transform({}, lambda c: trim(replace(replace(c, '|', '\\|'), chr(10), ' '))), ' | ') || ' |'"
_FIT = "list_resize(r, len(headers), '')"
_HEAD = _MD.format("headers") + " || chr(10) || '| ' || array_to_string(list_transform(headers, lambda h: '---'), ' | ') || ' |'"


@query("PRS19", f"SELECT doc_id, tbl, '**Table: T' || tbl || '**' || chr(10) || chr(10) || array_to_string(list_concat([{_HEAD}], list_transform(rows, lambda r: {_MD.format(_FIT)})), chr(10)) AS md FROM {_CONV}")
def prs19(spark, d):
    return converted(spark, d).select("doc_id", "tbl", P.markdown(F.col("headers"), F.col("rows"), F.concat(F.lit("T"), F.col("tbl").cast("string"))).alias("md"))


@query("PRS20", f"SELECT doc_id, tbl, array_to_string(list_transform(rows, lambda r: {_HEAD} || chr(10) || {_MD.format(_FIT)}), '##') AS chunks FROM {_CONV}")
def prs20(spark, d):
    return converted(spark, d).select("doc_id", "tbl", F.array_join(P.row_chunks(F.col("headers"), F.col("rows")), "##").alias("chunks"))


@query("CHK8", f"SELECT doc_id, tbl, 'doc ' || doc_id || ' > table ' || tbl AS path FROM {_CONV}")
def chk8(spark, d):
    return converted(spark, d).select("doc_id", "tbl", F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" > table "), F.col("tbl").cast("string")).alias("path"))


#: Nations of all regions as one table of each region, suppliers as a large one.
@query("CHK9", None)
def chk9(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", F.array(F.col("c_custkey").cast("string"), F.col("c_name")).alias("row"), "c_custkey")
    grouped = rows.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))).alias("r"))
    chunks = P.table_chunks(F.array(F.lit("key"), F.lit("name")), F.transform("r", lambda x: x["row"]))
    return grouped.select("c_nationkey", F.posexplode(chunks).alias("chunk_no", "text")).select("c_nationkey", "chunk_no", estimate_tokens(F.col("text")).alias("tokens"), F.md5("text").alias("digest"))


@query("CHK12_FAULTS", _PARENTS + f"""SELECT doc_id, 0 AS place, 'parent' AS strategy, count(*) AS n, NULL AS error FROM parents WHERE doc_id % 7 <> 3 GROUP BY doc_id UNION ALL SELECT doc_id, 0, 'parent', 0, 'unreadable' FROM documents WHERE doc_id % 7 = 3
UNION ALL SELECT doc_id, 1, 'line', count(*), NULL FROM u GROUP BY doc_id
UNION ALL SELECT doc_id, 2, 'table', count(*), NULL FROM {_CONV} WHERE len(rows) > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars % 7 <> 0) GROUP BY doc_id UNION ALL SELECT doc_id, 2, 'table', 0, 'broken tables' FROM documents WHERE n_chars % 7 = 0""")
def chk12_faults(spark, d):
    """Parents, lines and tables of all documents, where two of the strategies fail on some of them."""
    strategies = [
        C.Strategy("parent", C.parents, F.expr("CASE WHEN doc_id % 7 = 3 THEN 'unreadable' END")),
        C.Strategy("line", lambda docs: C.paragraphs(docs).withColumnRenamed("ord", "chunk_no")),
        C.Strategy("table", lambda docs: P.document_tables(docs, converted(spark, d)), F.expr("CASE WHEN n_chars % 7 = 0 THEN 'broken tables' END")),
    ]
    return C.orchestrate(table(spark, d, "documents"), strategies).groupBy("doc_id", "place", "strategy", "error").agg(F.count("text").alias("n"))


_ITEMS = f"SELECT doc_id, string_agg(repeat('  ', CASE WHEN x0 <= 55 THEN 0 WHEN x0 <= 75 THEN 1 ELSE 2 END) || '- ' || trim(text), chr(10) ORDER BY ord) AS md FROM {SP} GROUP BY doc_id"


@query("PRS21", _ITEMS)
def prs21(spark, d):
    x = F.col("x0")
    level = F.when(x <= 55, 0).when(x <= 75, 1).otherwise(2)
    rows = spans(spark, d).withColumn("line", F.concat(F.repeat(F.lit("  "), level), F.lit("- "), F.trim("text")))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda z: z["line"]), "\n").alias("md"))


@query("HLP3", f"SELECT doc_id, ord, CASE WHEN left(ltrim(text), 1) = '-' THEN '- ' || trim(substring(ltrim(text), 2)) ELSE trim(text) END AS text FROM {SP}")
def hlp3(spark, d):
    t = F.ltrim("text")
    return spans(spark, d).select("doc_id", "ord", F.when(F.startswith(t, F.lit("-")), F.concat(F.lit("- "), F.trim(F.substring(t, 2, 1 << 20)))).otherwise(F.trim("text")).alias("text"))


_BARE = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<nav\\b.*?</nav\\s*>|<head\\b.*?</head\\s*>|<!--.*?-->', ' ', 'g')"
_BLK = "(?is)<h1\\b[^>]*>.*?</h1\\s*>|<h2\\b[^>]*>.*?</h2\\s*>|<h3\\b[^>]*>.*?</h3\\s*>|<h4\\b[^>]*>.*?</h4\\s*>|<h5\\b[^>]*>.*?</h5\\s*>|<h6\\b[^>]*>.*?</h6\\s*>|<p\\b[^>]*>.*?</p\\s*>|<li\\b[^>]*>.*?</li\\s*>"
_HTML = f"""SELECT page_id, ord, kind, text FROM (SELECT page_id, cast(ord - 1 AS INTEGER) AS ord, lower(regexp_extract(b, '^<([a-zA-Z0-9]+)', 1)) AS kind,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?is)^<[^>]*>|</[a-z0-9]+\\s*>$', '', 'g'), '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text
 FROM (SELECT page_id, unnest(l) AS b, generate_subscripts(l, 1) AS ord FROM (SELECT page_id, regexp_extract_all({_BARE}, '{_BLK}') AS l FROM pages))) WHERE text <> ''"""


@query("PRS1", f"SELECT page_id, ord, kind, md5(text) AS digest FROM ({_HTML})")
def prs1(spark, d):
    return P.html_blocks(table(spark, d, "pages")).select("page_id", "ord", "kind", F.md5("text").alias("digest"))


@query("CHK2", f"SELECT page_id, md5(string_agg(CASE WHEN kind LIKE 'h%' THEN repeat('#', cast(substring(kind, 2) AS INTEGER)) || ' ' || text WHEN kind = 'li' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY ord)) AS digest FROM ({_HTML}) GROUP BY page_id")
def chk2(spark, d):
    rows = P.html_blocks(table(spark, d, "pages"))
    line = F.when(F.startswith("kind", F.lit("h")), F.concat(F.repeat(F.lit("#"), F.substring("kind", 2, 1).try_cast("int")), F.lit(" "), "text")).when(F.col("kind") == "li", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    return rows.withColumn("line", line).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l")).select("page_id", F.md5(F.array_join(F.transform("l", lambda z: z["line"]), "\n\n")).alias("digest"))


@query("PRS11")
def prs11(spark, d):
    """Line items as words on their order's page."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 100).cast("double").alias("x0"), ((F.col("l_suppkey") % 40) * 1.3).alias("y"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"))
    return P.word_lines(rows)
