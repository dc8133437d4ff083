"""Tables found on pages: ruled ones by their grid, others by the gaps between their words.

Words are boxes (page, x0, y0, x1, y1, text), rules are line segments (page, x0, y0, x1, y1);
y grows downwards. Words and rules of a page meet in one aggregation, and what follows is
a Column over the page's two arrays: sorts and cuts, no step of which grows faster than a
sort. A page whose rules make a grid is read by it; only a page without one is read by its
gaps. A page with a broken box (a missing or non-finite number, or an end before its start)
gives a row with an error and no table, and the others are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from . import parsing as P

#: Positions of rules closer than this are one; shorter segments are no rules.
SNAP, EDGE = 4.0, 3.0
#: Words whose middles lie this close in height are on one line; a wider gap parts columns.
LINE, GAP = 3.0, 8.0
BOX = ("x0", "y0", "x1", "y1")
TABLES = "array<struct<tbl:int,method:string,cells:array<array<string>>,error:string>>"

At = Callable[[Column], Column]


def _broken(x: Callable[[str], Column]) -> Column:
    bad = F.lit(False)
    for c in BOX:
        bad = bad | x(c).isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf"))
    return bad | F.coalesce((x("x1") < x("x0")) | (x("y1") < x("y0")), F.lit(True))


def _cut(rows: Column, fresh: Callable[[Column, Column], Column]) -> Column:
    """Runs of an array: each begins at an element that is fresh (the element, its place from 0); what is before the first goes."""
    starts = F.filter(F.transform(rows, lambda x, i: F.when(fresh(x, i), i)), lambda i: i.isNotNull())
    return P.let(starts, lambda s: F.transform(s, lambda a, k: F.slice(rows, a + 1, F.coalesce(F.get(s, k + 1), F.size(rows)) - a)))


def _by(rows: Column, at: At) -> Column:
    """Structs (at, i) of rows in order, with their places i. Sorted structs hold no others: Spark makes a new ordering for each comparison of these."""
    return F.sort_array(F.transform(rows, lambda x, i: F.struct(at(x).alias("at"), i.alias("i"))))


def clustered(rows: Column, at: At, reach: float) -> Column:
    """Runs of (at, i) with no gap over ``reach``, in order."""
    return P.let(_by(rows, at), lambda v: _cut(v, lambda x, i: F.coalesce(x["at"] - F.get(v, i - 1)["at"] > reach, F.lit(True))))


def banded(rows: Column, low: str, high: str, reach: float) -> Column:
    """Groups of intervals that overlap or lie within ``reach`` of each other, in order.

    A group begins at the n-th lowest start if the n - 1 lowest ends lie that far before it:
    these are then the ends of all n - 1 intervals before.
    """
    ends = F.sort_array(F.transform(rows, lambda x: x[high]))
    begun = _by(rows, lambda x: x[low])
    cut = P.let(begun, lambda b: P.let(ends, lambda e: _cut(b, lambda x, i: F.coalesce(x["at"] - F.get(e, i - 1) > reach, F.lit(True)))))
    return F.transform(cut, lambda g: F.transform(g, lambda x: F.get(rows, x["i"])))


def regions(rules: Column, reach: float = SNAP) -> Column:
    """Rules by the table they belong to: parted by empty bands across, then along, then across again."""
    across = lambda rows: banded(rows, "y0", "y1", reach)
    along = lambda rows: F.flatten(F.transform(banded(rows, "x0", "x1", reach), across))
    return F.flatten(F.transform(across(rules), along))


def edges(boxes: Column) -> Column:
    """The four sides of rectangles as rules."""
    side = lambda x, *ends: F.struct(*[x[e].alias(c) for e, c in zip(ends, BOX, strict=True)])
    ends = [("x0", "y0", "x1", "y0"), ("x0", "y1", "x1", "y1"), ("x0", "y0", "x0", "y1"), ("x1", "y0", "x1", "y1")]
    return F.flatten(F.transform(boxes, lambda b: F.array(*[side(b, *e) for e in ends])))


def grids(rules: Column) -> Column:
    """Tables of a page's rules: ys, xs, the snapped heights and places of their lines; a grid has two of both at least."""
    wide, high = lambda r: r["x1"] - r["x0"], lambda r: r["y1"] - r["y0"]
    kind = lambda r: F.when((high(r) <= SNAP) & (wide(r) >= EDGE), "y").when((wide(r) <= SNAP) & (high(r) >= EDGE), "x")
    lines = F.filter(F.transform(rules, lambda r: F.struct(*[r[c].alias(c) for c in BOX], kind(r).alias("axis"))), lambda r: r["axis"].isNotNull())
    mean = lambda run: F.aggregate(run, F.lit(0.0), lambda s, x: s + x["at"]) / F.size(run)

    def own(region: Column, axis: str) -> Column:
        return F.transform(clustered(F.filter(region, lambda r: r["axis"] == axis), lambda r: (r[f"{axis}0"] + r[f"{axis}1"]) / 2, SNAP), mean)

    found = F.transform(P.let(lines, lambda r: regions(r)), lambda r: F.struct(own(r, "y").alias("ys"), own(r, "x").alias("xs")))
    return F.filter(found, lambda g: (F.size(g["ys"]) >= 2) & (F.size(g["xs"]) >= 2))


def _between(words: Column, lines: Column, at: At, closed: bool) -> Column:
    """An array of words for each place behind a line and before the next; a word on a line is behind it. ``closed``: nothing is behind the last."""
    point = lambda at, word, i: F.struct(at.alias("at"), F.lit(word).alias("word"), i.alias("i"))
    met = F.sort_array(F.concat(F.transform(lines, lambda v, i: point(v, False, i)), F.transform(words, lambda w, i: point(at(w), True, i))))
    runs = P.let(met, lambda m: _cut(m, lambda x, _: ~x["word"]))
    runs = P.let(runs, lambda r: F.slice(r, 1, F.size(r) - 1)) if closed else runs
    return F.transform(runs, lambda r: F.transform(F.slice(r, 2, F.size(r)), lambda x: F.get(words, x["i"])))


def _cell(words: Column) -> Column:
    """Its words in order; what no word lies in is missing."""
    return F.when(F.size(words) > 0, F.array_join(F.transform(F.sort_array(words), lambda w: w["text"]), " "))


def lattice(words: Column, found: Column) -> Column:
    """Cells of the tables of these grids with a word in them; a word belongs to the cell that its middle lies in."""
    row = lambda held, g: F.transform(_between(held, g["xs"], lambda w: w["x"], True), _cell)
    cells = lambda g: F.transform(_between(words, g["ys"], lambda w: w["y"], True), lambda held: row(held, g))
    return F.filter(F.transform(found, cells), lambda t: F.exists(t, lambda r: F.exists(r, lambda c: c.isNotNull())))


def stream(words: Column) -> Column:
    """Cells of a page's words: lines by their middles, columns by the gaps that all lines share; no table without a word."""
    starts = F.transform(banded(words, "x0", "x1", GAP), lambda g: F.get(g, F.lit(0))["x0"])
    row = lambda held, s: F.transform(_between(held, s, lambda w: w["x0"], False), _cell)
    lines = F.transform(clustered(words, lambda w: w["y"], LINE), lambda run: F.transform(run, lambda x: F.get(words, x["i"])))
    return P.let(starts, lambda s: F.transform(lines, lambda held: row(held, s)))


def _pages(words: DataFrame, rules: DataFrame) -> DataFrame:
    """page, words, rules: both as arrays of one row for each page, with all numbers as doubles.

    Boxes are dealt to as many partitions as the session shuffles to before any list is begun. Lists begun earlier would
    hold all boxes of a task that is only as small as what they are made from; and partitions put together by their
    compressed bytes hold too many boxes, which take more memory and time than their bytes say.
    """
    sized = lambda rows, text, word: rows.select("page", *[F.col(c).cast("double").alias(c) for c in BOX], text.alias("text"), F.lit(word).alias("word"))
    both = sized(words, F.col("text"), True).unionByName(sized(rules, F.lit(None).cast("string"), False))
    dealt = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page")
    of = lambda kind: F.collect_list(F.when(kind, F.struct(*BOX, "text")))
    return dealt.groupBy("page").agg(of(F.col("word")).alias("words"), of(~F.col("word")).alias("rules"))


def _laid(words: Column) -> Column:
    """Words with their middles and, in front, the order of words in a cell."""
    place = lambda w: F.struct(F.round(w["y0"] / LINE).alias("l"), w["x0"].alias("x0"), w["text"].alias("text"), w["x1"].alias("x1"), ((w["x0"] + w["x1"]) / 2).alias("x"), ((w["y0"] + w["y1"]) / 2).alias("y"))
    return F.transform(words, place)


def _numbered(tables: Column, method: str) -> Column:
    return F.transform(tables, lambda t, i: F.struct((i + 1).cast("int").alias("tbl"), F.lit(method).alias("method"), t.alias("cells"), F.lit(None).cast("string").alias("error"))).cast(TABLES)


def _rows(pages: DataFrame, tables: Column) -> DataFrame:
    """A row for each of a page's tables. Outer, as Spark would put a filter that computes the tables once more before an inner one."""
    return pages.select("page", F.inline_outer(tables)).where("cells IS NOT NULL OR error IS NOT NULL")


def _ruled(pages: DataFrame, rules: Column) -> DataFrame:
    """With the columns words (laid), grids and ruled, each a step of its own."""
    return pages.withColumn("grids", grids(rules)).withColumn("words", _laid(F.col("words"))).withColumn("ruled", lattice(F.col("words"), F.col("grids")))


def _kept(found: DataFrame, least: float) -> DataFrame:
    """Tables that are good enough, and the pages' errors: page, tbl, method, quality, headers, rows, error."""
    rated = found.withColumn("quality", F.when(F.col("error").isNull(), F.round(P.table_quality(F.col("cells")), 6)))
    filled = F.exists("cells", lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    kept = rated.where(F.col("error").isNotNull() | ((F.col("quality") >= least) & filled)).withColumn("t", F.when(F.col("error").isNull(), P.convert(F.col("cells"))))
    return kept.select("page", "tbl", "method", "quality", "t.headers", "t.rows", "error")


def extract(words: DataFrame, rules: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """page, tbl, method, quality, headers, rows, error: every table of at least ``table_quality_min``, and a row for each broken page."""
    pages = _pages(words.where("trim(coalesce(text, '')) <> ''"), rules)
    broken = lambda rows: F.exists(rows, lambda b: _broken(lambda c: b[c]))
    error = F.array(F.struct(F.lit(None), F.lit(None), F.lit(None), F.lit("broken box"))).cast(TABLES)
    found = _ruled(pages.withColumn("broken", broken("words") | broken("rules")), F.col("rules"))
    loose = F.when(F.size("words") > 0, F.array(stream(F.col("words"))))
    tables = F.when(F.col("broken"), error).when(F.size("ruled") > 0, _numbered(F.col("ruled"), "lattice")).otherwise(_numbered(loose, "stream"))
    return _kept(_rows(found, tables), s.table_quality_min)


def drawn(words: DataFrame, boxes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Tables drawn as rectangles, one for each cell or for several: page, tbl, quality, headers, rows; those of one row are left out."""
    sound = ~_broken(lambda c: F.col(c).cast("double"))
    found = _ruled(_pages(words.where(sound), boxes.where(sound)), edges(F.col("rules")))
    tables = _rows(found, _numbered(F.col("ruled"), "lattice"))
    return _kept(tables.where(F.size("cells") >= 2), s.table_quality_min).select("page", "tbl", "quality", "headers", "rows")
