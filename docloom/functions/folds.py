"""Sequential folds over arrays, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cosine, estimate_tokens


def pack_starts(tokens: Column, limit: int) -> Column:
    """First place (from 1) of each group: a unit that would overflow a non-empty group opens the next.

    The fold's array grows by groups, not by units.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        at = s["at"] + 1
        opens = (at == 1) | ((s["used"] + t > limit) & (s["used"] > 0))
        return F.struct(at.alias("at"), (F.when(opens, 0).otherwise(s["used"]) + t).cast("int").alias("used"), F.when(opens, F.concat(s["out"], F.array(at))).otherwise(s["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def pack_groups(units: Column, starts: Column) -> Column:
    """The units of each group, in an array; both arguments are columns, not expressions."""
    bounds = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, 1 << 30), F.array(F.size(units) + 1)).alias("b"))
    return F.transform(F.filter(bounds, lambda z: z["a"].isNotNull()), lambda z: F.slice(units, z["a"], z["b"] - z["a"]))


def _tail(parts: Column, overlap: int) -> Column:
    """Trailing parts whose tokens add up to ``overlap`` at most, scanned from the end until the first overflow."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("sum"), F.lit(False).alias("full"))

    def step(s: Column, p: Column) -> Column:
        size = estimate_tokens(p)
        full = s["full"] | (s["sum"] + size > overlap)
        return F.struct(F.when(full, s["kept"]).otherwise(F.concat(F.array(p), s["kept"])).alias("kept"), F.when(full, s["sum"]).otherwise(s["sum"] + size).cast("int").alias("sum"), full.alias("full"))

    return F.aggregate(F.reverse(parts), start, step, lambda s: s["kept"])


def pack_with_overlap(units: Column, limit: int, overlap: int, joiner: str) -> Column:
    """Texts of packed units: a full pack is emitted with the tail of the one before in front.

    After a pack the token count restarts at that of the tail text, which is one for
    an empty tail. Units are never cut.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("parts"), F.lit(0).alias("used"), F.lit("").alias("tail"), empty.alias("out"))
    text = lambda s: F.array_join(F.concat(F.when(s["tail"] != "", F.array(s["tail"])).otherwise(empty), s["parts"]), joiner)

    def step(s: Column, u: Column) -> Column:
        size = estimate_tokens(u)
        over = (s["used"] + size > limit) & (F.size(s["parts"]) > 0)
        tail = F.array_join(_tail(s["parts"], overlap), joiner)
        return F.struct(
            F.when(over, F.array(u)).otherwise(F.concat(s["parts"], F.array(u))).alias("parts"),
            (F.when(over, estimate_tokens(tail)).otherwise(s["used"]) + size).cast("int").alias("used"),
            F.when(over, tail).otherwise(s["tail"]).alias("tail"),
            F.when(over, F.concat(s["out"], F.array(text(s)))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(units, start, step, lambda s: F.when(F.size(s["parts"]) > 0, F.concat(s["out"], F.array(text(s)))).otherwise(s["out"]))


def pack_rows(rows: Column, limit: int, joiner: str = "\n") -> Column:
    """Texts of packed units without overlap; the count restarts at zero."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("parts"), F.lit(0).alias("used"), empty.alias("out"))

    def step(s: Column, r: Column) -> Column:
        size = estimate_tokens(r)
        over = (s["used"] + size > limit) & (F.size(s["parts"]) > 0)
        return F.struct(F.when(over, F.array(r)).otherwise(F.concat(s["parts"], F.array(r))).alias("parts"), (F.when(over, 0).otherwise(s["used"]) + size).cast("int").alias("used"), F.when(over, F.concat(s["out"], F.array(F.array_join(s["parts"], joiner)))).otherwise(s["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda s: F.when(F.size(s["parts"]) > 0, F.concat(s["out"], F.array(F.array_join(s["parts"], joiner)))).otherwise(s["out"]))


def pack_words(units: Column, size: int) -> Column:
    """Sentences joined by spaces; the pack is emitted before the sentence that brings it to ``size`` words."""
    empty = F.array().cast("array<string>")
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    start = F.struct(F.lit("").alias("now"), empty.alias("out"))

    def step(s: Column, u: Column) -> Column:
        joined = F.trim(F.concat_ws(" ", s["now"], u))
        full = count(joined) >= size
        return F.struct(F.when(full, u).otherwise(joined).alias("now"), F.when(full & (s["now"] != ""), F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(units, start, step, lambda s: F.when(s["now"] != "", F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]))


def greedy_distinct(ranked: Column, limit: float) -> Column:
    """Of structs (id, vec, ...) in rank order, those with a cosine below ``limit`` to all kept before."""
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: cosine(k["vec"], x["vec"]) >= limit), kept).otherwise(F.concat(kept, F.array(x))))


def token_bucket(times: Column, rate: float, burst: float) -> Column:
    """Whether each request (seconds, ascending) passes a bucket that refills at ``rate`` up to ``burst``."""
    start = F.struct(F.lit(burst).alias("tokens"), F.lit(None).cast("double").alias("at"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        now = F.least(F.lit(burst), s["tokens"] + F.coalesce(t - s["at"], F.lit(0.0)) * rate)
        ok = now >= 1
        return F.struct((now - ok.cast("double")).alias("tokens"), t.alias("at"), F.concat(s["out"], F.array(ok)).alias("out"))

    return F.aggregate(times, start, step, lambda s: s["out"])
