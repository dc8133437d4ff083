"""Queries on conversations, sessions, events and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..functions.folds import pack_words
from ..functions.words import CATEGORY_KEYWORDS, DEFAULT_TOPIC, ENTITY_PATTERNS, PRODUCTS, TOPIC_KEYWORDS
from ..operators import memory as M
from .base import query, table

#: Words of the domain, which the synthetic conversations lack, said in some of their turns; some turns are blank.
SAID = (
    "My home loan LN-1234567 and savings account", "The interest rate is 8.5% p.a. for a home loan", "Open a fixed deposit of rs. 5,00,000 and also a complaint? Really?", "Ticket TKT-654321 lodged with the ombudsman",
    "upi and net banking", "transfer 10 lakh by neft", "balance of account 123456789012345",
)
TEXT = "CASE (conv_id * 5 + turn) % 11 " + " ".join(f"WHEN {i} THEN text || ' {said}'" for i, said in enumerate(SAID)) + " WHEN 9 THEN ' ' ELSE text END"
MSG = f"(SELECT conv_id, turn, role, {TEXT} AS text FROM conversations)"


def messages(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.expr(TEXT).alias("text"))


def _hits(keys: tuple[str, ...]) -> str:
    return " + ".join(f"cast(contains(lower(text), '{k}') AS INTEGER)" for k in keys)


def _best(lists: dict, normalised: bool) -> str:
    scores = [f"({_hits(k)})" + (f"::DOUBLE / {len(k)}.0::DOUBLE" if normalised else "::DOUBLE") for k in lists.values()]
    top = f"greatest({', '.join(scores)})"
    return "CASE " + " ".join(f"WHEN {s} = {top} AND {top} > 0 THEN '{n}'" for n, s in zip(lists, scores, strict=True)) + " END"


_CATEGORY, _TOPIC = _best(CATEGORY_KEYWORDS, True), _best(TOPIC_KEYWORDS, False)


@query("FLT2", f"SELECT conv_id, turn, {_CATEGORY} AS category FROM {MSG}")
def flt2(spark, d):
    return messages(spark, d).select("conv_id", "turn", T.category_of(F.col("text")).alias("category"))


@query("FLT3", "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'hi' ELSE 'en' END AS script FROM documents")
def flt3(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_of(F.col("text")).alias("script"))


@query("FLT4", f"SELECT conv_id, turn, {_CATEGORY} AS doc_category, 'en' AS language FROM {MSG}")
def flt4(spark, d):
    f = T.filters_of(F.col("text"))
    return messages(spark, d).withColumn("f", f).select("conv_id", "turn", F.try_element_at("f", F.lit("doc_category")).alias("doc_category"), F.col("f")["language"].alias("language"))


@query("FLT7", f"SELECT conv_id, turn, contains(lower(text), ' and also ') OR contains(lower(text), ' as well as ') OR contains(lower(text), ' additionally ') OR contains(lower(text), ' moreover ') OR len(regexp_extract_all(text, '\\?')) > 1 AS compound FROM {MSG}")
def flt7(spark, d):
    return messages(spark, d).select("conv_id", "turn", T.is_compound(F.col("text")).alias("compound"))


@query("FLT8", "SELECT e.user_id, count(*) AS n FROM events e WHERE e.user_id = 7 AND e.event_type <> 'error' GROUP BY 1")
def flt8(spark, d):
    return table(spark, d, "events").where("user_id = 7 AND event_type <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("AGG15", f"SELECT conv_id, turn, {_TOPIC} AS topic FROM {MSG}")
def agg15(spark, d):
    return messages(spark, d).select("conv_id", "turn", T.topic_of(F.col("text")).alias("topic"))


_ACTIVE = f"SELECT conv_id, turn, text, coalesce(last_value({_TOPIC} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '{DEFAULT_TOPIC}') AS active FROM {MSG}"
_LEFT = f"SELECT *, CASE WHEN coalesce(lag(active) OVER (PARTITION BY conv_id ORDER BY turn), '{DEFAULT_TOPIC}') <> active THEN coalesce(lag(active) OVER (PARTITION BY conv_id ORDER BY turn), '{DEFAULT_TOPIC}') END AS gone FROM ({_ACTIVE})"


@query("WIN4", f"SELECT a.conv_id, a.turn, a.active, coalesce((SELECT string_agg(gone, ',' ORDER BY first) FROM (SELECT gone, min(turn) AS first FROM ({_LEFT}) b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND gone IS NOT NULL GROUP BY gone)), '') AS history FROM ({_ACTIVE}) a")
def win4(spark, d):
    return M.topics(messages(spark, d), TOPIC_KEYWORDS).select("conv_id", "turn", "active", F.array_join("history", ",").alias("history"))


def _found(kind: str) -> str:
    if kind == "banking_product":
        return "list_sort(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN '{p}' END" for p in PRODUCTS) + "], lambda p: p IS NOT NULL))"
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{ENTITY_PATTERNS[kind]}'), lambda m: trim(m)), lambda m: m <> '')))"


_KINDS = [*ENTITY_PATTERNS, "banking_product"]


@query("FN3", f"SELECT conv_id, turn, {', '.join(f'array_to_string({_found(k)}, chr(44)) AS {k}' for k in _KINDS)} FROM {MSG}")
def fn3(spark, d):
    rows = messages(spark, d).withColumn("e", T.entities(F.col("text")))
    return rows.select("conv_id", "turn", *[F.array_join(F.col("e")[k], ",").alias(k) for k in _KINDS])


@query("WIN5", f"SELECT a.conv_id, a.turn, coalesce((SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM (SELECT unnest({_found('banking_product')}) AS v FROM {MSG} b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn)), '') AS products FROM {MSG} a")
def win5(spark, d):
    rows = M.cumulative(messages(spark, d), T.entities(F.col("text"))["banking_product"], "products")
    return rows.select("conv_id", "turn", F.array_join("products", ",").alias("products"))


@query("HLP15", f"SELECT conv_id, string_agg(DISTINCT v, ',' ORDER BY v) AS products FROM (SELECT conv_id, unnest({_found('banking_product')}) AS v FROM {MSG}) GROUP BY conv_id")
def hlp15(spark, d):
    return messages(spark, d).select("conv_id", F.explode(T.entities(F.col("text"))["banking_product"]).alias("v")).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("products"))


_LABELS = {k: k.replace("_", " ").title() for k in _KINDS}
_LINES = ", ".join(f"CASE WHEN len({_found(k)}) > 0 THEN '- {_LABELS[k]}: ' || array_to_string({_found(k)}, ', ') END" for k in _KINDS)


@query("FN4", f"SELECT conv_id, turn, CASE WHEN len(l) > 0 THEN '=== Active Conversation Entities ===' || chr(10) || array_to_string(l, chr(10)) ELSE '' END AS context FROM (SELECT conv_id, turn, list_filter([{_LINES}], lambda x: x IS NOT NULL) AS l FROM {MSG})")
def fn4(spark, d):
    return messages(spark, d).select("conv_id", "turn", T.entity_context(T.entities(F.col("text"))).alias("context"))


@query("FN18", f"SELECT conv_id, turn, CASE WHEN contains(lower(text), 'balance') THEN 'balance' WHEN contains(lower(text), 'loan') OR contains(lower(text), 'interest') THEN 'loan' WHEN contains(lower(text), 'transaction') OR contains(lower(text), 'transfer') THEN 'transfer' ELSE 'help' END AS reply FROM {MSG}")
def fn18(spark, d):
    return messages(spark, d).select("conv_id", "turn", T.intent_reply(F.col("text")).alias("reply"))


_LAST = "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE trim(text) <> '') WHERE back <= {}"


@query("WIN2", _LAST.format(2 * DEFAULTS.short_term_turns).replace("SELECT conv_id, turn, role, text", "SELECT conv_id, turn", 1))
def win2(spark, d):
    return M.last_turns(table(spark, d, "conversations"), 2 * DEFAULTS.short_term_turns).select("conv_id", "turn")


@query("WIN3", f"SELECT conv_id, count(*) FILTER (back <= 10) AS rewrite, count(*) FILTER (back <= 6) AS answer, count(*) FILTER (back <= 8) AS chat FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) GROUP BY conv_id")
def win3(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    n = lambda k, name: F.size(F.slice("t", -F.least(F.size("t"), F.lit(k)), F.lit(k))).cast("long").alias(name)
    return turns.select("conv_id", n(10, "rewrite"), n(6, "answer"), n(8, "chat"))


@query("STR7", "SELECT conv_id, count(*) AS remembered, max(turn) AS last_turn FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def str7(spark, d):
    return table(spark, d, "conversations").where("trim(text) <> ''").groupBy("conv_id").agg(F.count(F.lit(1)).alias("remembered"), F.max("turn").alias("last_turn"))


_SO_FAR = ", ".join(f"coalesce((SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM (SELECT unnest({_found(k)}) AS v FROM {MSG} b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn)), '') AS {k}" for k in _KINDS)
_RECENT = f"SELECT conv_id, turn, array_to_string(list(turn || ' ' || role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {2 * DEFAULTS.short_term_turns - 1} PRECEDING AND CURRENT ROW), chr(10)) AS short_term FROM {MSG} WHERE trim(text) <> ''"


@query("STR7_MEMORY", f"SELECT a.conv_id, a.turn, r.short_term, a.active, coalesce((SELECT string_agg(gone, ',' ORDER BY first) FROM (SELECT gone, min(turn) AS first FROM ({_LEFT}) b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND gone IS NOT NULL GROUP BY gone)), '') AS history, {_SO_FAR} FROM ({_ACTIVE}) a JOIN ({_RECENT}) r ON r.conv_id = a.conv_id AND r.turn = a.turn")
def str7_memory(spark, d):
    rows = M.memory(messages(spark, d), TOPIC_KEYWORDS, T.entities(F.col("text")), _KINDS, 2 * DEFAULTS.short_term_turns)
    line = lambda x: F.concat(x["turn"].cast("string"), F.lit(" "), x["role"], F.lit(": "), x["text"])
    return rows.select("conv_id", "turn", F.array_join(F.transform("short_term", line), "\n").alias("short_term"), "active", *[F.array_join(c, ",").alias(c) for c in ("history", *_KINDS)])


def history(rows, n: int, line):
    """Lines of the last n turns of each conversation, in order."""
    kept = M.last_turns(rows, n).withColumn("line", line)
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("h")).select("conv_id", F.transform("h", lambda x: x["line"]).alias("lines"))


@query("FN13", f"SELECT conv_id, md5('=== Recent Conversation ===' || chr(10) || string_agg(upper(role) || ': ' || trim(text), chr(10) ORDER BY turn) || chr(10) || chr(10) || '=== Latest Query ===' || chr(10) || arg_max(text, turn)) AS prompt FROM ({_LAST.format(10)}) GROUP BY conv_id")
def fn13(spark, d):
    rows = table(spark, d, "conversations")
    lines = history(rows, 10, F.concat(F.upper("role"), F.lit(": "), F.trim("text")))
    latest = rows.where("trim(text) <> ''").groupBy("conv_id").agg(F.max_by("text", "turn").alias("q"))
    prompt = F.concat(F.lit("=== Recent Conversation ===\n"), F.array_join("lines", "\n"), F.lit("\n\n=== Latest Query ===\n"), "q")
    return lines.join(latest, "conv_id").select("conv_id", F.md5(prompt).alias("prompt"))


@query("FN14", "SELECT conv_id, count(*) AS n, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn)) AS example FROM conversations GROUP BY conv_id")
def fn14(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    line = F.transform("m", lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>")))
    return rows.select("conv_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(line, "\n")).alias("example"))


_SUMMARY = "'- **Key Inquiries**: ''' || substring(arg_max(text, turn), 1, 80) || '...'''"


@query("FN16", f"SELECT conv_id, {_SUMMARY} AS summary FROM conversations WHERE role = 'user' GROUP BY conv_id")
def fn16(spark, d):
    last = F.max_by("text", "turn")
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.concat(F.lit("- **Key Inquiries**: '"), F.substring(last, 1, 80), F.lit("...'")).alias("summary"))


@query("MDL7", f"SELECT conv_id, length({_SUMMARY}) AS n_chars FROM conversations WHERE role = 'user' GROUP BY conv_id")
def mdl7(spark, d):
    return fn16(spark, d).select("conv_id", F.length("summary").cast("long").alias("n_chars"))


@query("FN15", "SELECT user_id, string_agg('[' || n || '] Summary from ' || strftime(ts, '%Y-%m-%d') || ': ' || event_type, chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 3 GROUP BY user_id")
def fn15(spark, d):
    from ..operators.retrieval import top

    rows = top(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.asc("event_id")], DEFAULTS.memory_top_k, "n")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] Summary from "), F.date_format("ts", "yyyy-MM-dd"), F.lit(": "), "event_type")
    return rows.withColumn("line", line).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l")).select("user_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


@query("FN11", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def fn11(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day"))




@query("FN12", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, cast(to_json({'id': event_id, 'type': event_type}) AS VARCHAR) AS encoded FROM events")
def fn12(spark, d):
    keys = F.json_object_keys("props")
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.try_element_at(parsed, F.get(keys, F.lit(0))).alias("first_value"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("encoded"))


_SESS = """SELECT user_id, session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, session"""


@query("STR2", f"SELECT user_id, cast(session AS BIGINT) AS session, epoch_us(last) - epoch_us(first) AS span_us, n FROM ({_SESS})")
def str2(spark, d):
    return M.sessions(table(spark, d, "events")).select("user_id", "session", (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))).alias("span_us"), "n")


@query("STR3", f"WITH s AS ({_SESS}), e AS (SELECT user_id, session, first AS moment, 1 AS d FROM s UNION ALL SELECT user_id, session, last, -1 FROM s) SELECT user_id, cast(session AS BIGINT) AS session, open <= {DEFAULTS.max_sessions} AS admitted, open FROM (SELECT *, cast(sum(d) OVER (ORDER BY moment, d DESC, user_id, session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS open FROM e) WHERE d = 1")
def str3(spark, d):
    found = M.concurrent(M.sessions(table(spark, d, "events")))
    return found.select("user_id", "session", (F.col("open") <= DEFAULTS.max_sessions).alias("admitted"), "open")


#: Events as requests of their user, close enough together that buckets run dry; times are sums of eighths, exact in both engines.
_RATES = "SELECT user_id AS key, event_id AS seq, nth, nth * 0.375::DOUBLE + (event_id % 3) * 0.125::DOUBLE AS sec FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events)"


@query("STR4", f"""WITH RECURSIVE r AS ({_RATES}), b AS (
  SELECT key, seq, nth, sec, true AS allowed, 9.0::DOUBLE AS tokens FROM r WHERE nth = 1
  UNION ALL
  SELECT r.key, r.seq, r.nth, r.sec, least(10, b.tokens + r.sec - b.sec) >= 1, least(10, b.tokens + r.sec - b.sec) - CASE WHEN least(10, b.tokens + r.sec - b.sec) >= 1 THEN 1 ELSE 0 END FROM b JOIN r ON r.nth = b.nth + 1 AND r.key = b.key)
SELECT key, seq, allowed FROM b""")
def str4(spark, d):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (nth * 0.375 + (F.col("event_id") % 3) * 0.125).alias("at"))
    return M.rate_limit(rows).select("key", "seq", "allowed")


@query("STR8", "SELECT event_type, count(*) AS n, round(avg(round(value * 1000, 2)), 2) AS mean_ms FROM events GROUP BY event_type")
def str8(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.round(F.col("value") * 1000, 2)), 2).alias("mean_ms"))


BUCKETS = (0.1, 0.5, 1, 2.5, 5, 10, 25, 50, 100)


@query("AGG12", "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{str(b).replace('.', '_')}" for b in BUCKETS) + ", count(*) AS total FROM events GROUP BY event_type")
def agg12(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BUCKETS], F.count(F.lit(1)).alias("total"))


@query("WIN6", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def win6(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").select("event_id").limit(100)


@query("HLP26", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, event_type FROM events")
def hlp26(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "event_type")


@query("SMP1", None)
def smp1(spark, d):
    """A seeded shuffle: order by a hash of the id and a seed, then take."""
    return table(spark, d, "conversations").select("conv_id").distinct().orderBy(F.xxhash64("conv_id", F.lit(42)), "conv_id").limit(50)




@query("CHK15", None)
def chk15(spark, d):
    parts = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(pack_words(parts, 25)).alias("pack", "text"))


@query("STR_TUMBLE", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumble(spark, d):
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")
