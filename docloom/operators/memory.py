"""Conversation memory: windows, topics, entities, sessions, admission, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.folds import token_bucket
from ..functions.text import topic_of
from ..functions.words import DEFAULT_TOPIC


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation; blank texts are not remembered."""
    ranked = turns.where("trim(text) <> ''").withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return ranked.where(F.col("back") <= n).drop("back")


def topics(turns: DataFrame, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    """Active topic of each turn, carried forward, and the distinct topics left so far in the order of leaving."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    best = topic_of(F.col("text"), lists)
    active = F.coalesce(F.last(best, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(DEFAULT_TOPIC))
    rows = turns.withColumn("active", active)
    before = F.coalesce(F.lag("active").over(w), F.lit(DEFAULT_TOPIC))
    left = F.when(before != F.col("active"), before)
    rows = rows.withColumn("_left", left)
    return rows.withColumn("history", F.array_distinct(F.collect_list("_left").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_left")


def cumulative(turns: DataFrame, found: Column, name: str) -> DataFrame:
    """Sorted distinct values of an array column over all turns so far."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn(name, F.array_sort(F.array_distinct(F.flatten(F.collect_list(found).over(w)))))


def memory(turns: DataFrame, lists: dict[str, tuple[str, ...]], found: Column, kinds: list[str], n: int) -> DataFrame:
    """Each conversation's memory after each turn: its last n turns, entities of every kind, topics; blank texts leave it as it was."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = topics(turns.where("trim(text) <> ''"), lists).withColumn("_found", found)
    for kind in kinds:
        rows = cumulative(rows, F.col("_found")[kind], kind)
    return rows.withColumn("short_term", F.collect_list(F.struct("turn", "role", "text")).over(w.rowsBetween(1 - n, 0))).drop("_found")


def sessions(events: DataFrame, minutes: int = DEFAULTS.session_ttl_minutes) -> DataFrame:
    """Runs of a user's events with no gap over the time to live: user_id, first, last, n."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")
    marked = events.withColumn("_new", (F.coalesce(gap, F.lit(0.0)) > minutes * 60).cast("int"))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


def concurrent(found: DataFrame) -> DataFrame:
    """Open sessions at each start, it included: opens and closes as +1 and -1 by day, then a running sum.

    Days are summed first, so that no window holds all events at once.
    """
    edges = found.select(F.col("first").alias("at"), F.lit(1).alias("d"), "user_id", "session").union(found.select(F.col("last"), F.lit(-1), F.col("user_id"), F.col("session"))).withColumn("day", F.to_date("at"))
    days = edges.groupBy("day").agg(F.sum("d").alias("net"))
    before = days.withColumn("base", F.sum("net").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", F.coalesce("base", F.lit(0)).alias("base"))
    inside = Window.partitionBy("day").orderBy("at", F.desc("d"), "user_id", "session").rowsBetween(Window.unboundedPreceding, 0)
    return edges.join(F.broadcast(before), "day").withColumn("open", (F.col("base") + F.sum("d").over(inside)).cast("long")).where("d = 1").select("user_id", "session", "at", "open")


def rate_limit(requests: DataFrame, rate: float = DEFAULTS.rate_per_second, burst: float = DEFAULTS.rate_burst) -> DataFrame:
    """Requests (key, seq, at in seconds) -> allowed, by a token bucket for each key."""
    grouped = requests.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("r"))
    passed = grouped.withColumn("ok", token_bucket(F.transform("r", lambda x: x["at"]), rate, burst))
    return passed.select("key", F.explode(F.arrays_zip("r", "ok")).alias("z")).select("key", F.col("z.r.seq").alias("seq"), F.col("z.ok").alias("allowed"))
