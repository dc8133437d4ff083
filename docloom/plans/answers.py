"""Queries on answers, evaluation and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..operators import models as M
from ..operators import validation as V
from .base import query, table

#: Answers made of documents' texts: well and badly cited, with and without numbers, short and long; three sources each.
ANSWER = (
    "CASE doc_id % 8 WHEN 0 THEN substring(text, 1, 60) || ' The interest rate is 8.5% [Source 1].' WHEN 1 THEN 'No citation here but 12 items.' WHEN 2 THEN 'Rates are 7% [Source 1, 3]. ' || substring(text, 1, 80) || ' 20 [Source 2]. See also 5.' "
    "WHEN 3 THEN substring(text, 1, 150) WHEN 4 THEN 'Bad source [Source 9] with 3 apples. ' || substring(text, 1, 40) WHEN 5 THEN 'Mixed [source 2] CASE 44 units and [Source x] 45 units. Last 46 [Source 1]! ' || substring(text, 90, 30) "
    "WHEN 6 THEN substring(text, 1, 120) || ' 8.5% per year [Source 3].' ELSE substring(text, 101, 99) || ' 3 [Source 2]' END"
)
CHUNKS = ("substring(text, 1, 100)", "substring(text, 101, 100) || ' case 44 units mixed and'", "'the interest rate for loans is 8.5% per year'")
SCORES = [f"CASE WHEN doc_id % 9 = 0 THEN 0.0 ELSE {x} END" for x in ("(n_chars % 100) / 100.0", "(n_chars % 37) / 50.0", "(doc_id % 10) / 100.0")]
A = f"(SELECT doc_id AS answer_id, {ANSWER} AS answer, [{', '.join(CHUNKS)}] AS chunks, [{', '.join(f'({x})::DOUBLE' for x in SCORES)}] AS scores FROM documents)"


def answers(spark, d):
    scores = [F.expr(x).cast("double") for x in SCORES]
    return table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.expr(ANSWER).alias("answer"), F.array(*map(F.expr, CHUNKS)).alias("chunks"), F.array(*scores).alias("scores"))


def _cited(t: str) -> str:
    return f"list_sort(list_distinct(list_filter(flatten(list_transform(regexp_extract_all({t}, '(?i)\\[Source\\s+([\\d,\\s]+)\\]', 1), lambda g: list_transform(string_split(g, ','), lambda n: try_cast(trim(n) AS INTEGER)))), lambda n: n IS NOT NULL)))"


def _numeric(t: str) -> str:
    return f"list_filter(string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: regexp_matches(s, '\\d'))"


def _claims(t: str) -> str:
    # Letters beyond ASCII are word characters at a word's border, as the underscore is.
    return f"list_distinct(regexp_extract_all(regexp_replace(lower({t}), '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}\\p{{M}}]', '_', 'g'), '\\b[a-z0-9₹%.,]+\\b'))"


def _grounded(s: str) -> str:
    return f"len(list_filter(list_filter({_cited(s)}, lambda c: c >= 1 AND c <= len(chunks)), lambda c: len(list_intersect({_claims(s)}, {_claims('chunks[c]')})) / greatest(len({_claims(s)}), 1) >= {DEFAULTS.guard_min_overlap})) > 0"


_C = _cited("answer")
_VALID = f"len(list_filter({_C}, lambda c: c >= 1 AND c <= len(chunks)))"
_COMPLETE = f"CASE WHEN len({_C}) = 0 THEN CASE WHEN length(answer) < 100 THEN 0.6 ELSE 0.2 END ELSE 0.7::DOUBLE * {_VALID} / len({_C}) + 0.3::DOUBLE * least({_VALID} / greatest(len(chunks), 1), 1) END"
_RETRIEVAL = "CASE WHEN coalesce(list_max(scores), 0) <= 0 THEN 0.0 WHEN list_max(scores) > 0.5 THEN list_avg(scores) ELSE list_avg(scores) / list_max(scores) END"
_N = _numeric("answer")
_FAITH = f"CASE WHEN len({_N}) = 0 THEN 0.75 ELSE len(list_filter({_N}, lambda s: len({_cited('s')}) > 0 AND (len({_claims('s')}) < 3 OR {_grounded('s')}))) / len({_N}) END"
_SCORED = f"SELECT answer_id, answer, chunks, cast({_RETRIEVAL} AS DOUBLE) AS retrieval, cast({_COMPLETE} AS DOUBLE) AS complete, cast({_FAITH} AS DOUBLE) AS faith FROM {A}"
_OVERALL = f"SELECT *, 1.0 / (0.35 / greatest(retrieval, 0.01) + 0.30 / greatest(faith, 0.01) + 0.35 / greatest(complete, 0.01)) AS overall FROM ({_SCORED})"


def scored(spark, d):
    rows = answers(spark, d)
    rows = rows.withColumns({"retrieval": V.retrieval_confidence(F.col("scores")), "complete": V.citation_completeness(F.col("answer"), F.size("chunks")), "faith": V.numeric_faithfulness(F.col("answer"), F.col("chunks"))})
    r, g, c = DEFAULTS.confidence_weights
    return rows.withColumn("overall", V.harmonic_mean([F.col("retrieval"), F.col("faith"), F.col("complete")], [r, g, c]))


@query("FN1", f"SELECT answer_id, array_to_string({_C}, ',') AS cited FROM {A}")
def fn1(spark, d):
    return answers(spark, d).select("answer_id", F.array_join(T.cited_numbers(F.col("answer")).cast("array<string>"), ",").alias("cited"))


@query("JN7", f"SELECT answer_id, cast(n AS INTEGER) AS source, chunks[n] AS chunk FROM (SELECT answer_id, chunks, unnest({_C}) AS n FROM {A}) WHERE n >= 1 AND n <= len(chunks)")
def jn7(spark, d):
    rows = answers(spark, d).select("answer_id", "chunks", F.explode(T.cited_numbers(F.col("answer"))).alias("source"))
    return rows.where((F.col("source") >= 1) & (F.col("source") <= F.size("chunks"))).select("answer_id", "source", F.get("chunks", F.col("source") - 1).alias("chunk"))


@query("JN8", f"SELECT a.answer_id, c.chunk, c.score FROM {A} a LEFT JOIN (SELECT answer_id, unnest(chunks) AS chunk, unnest(scores) AS score FROM {A}) c ON c.answer_id = a.answer_id AND c.chunk = a.chunks[1]")
def jn8(spark, d):
    rows = answers(spark, d)
    each = rows.select("answer_id", F.explode(F.arrays_zip("chunks", "scores")).alias("z")).select("answer_id", F.col("z.chunks").alias("chunk"), F.col("z.scores").alias("score"))
    wanted = rows.select("answer_id", F.get("chunks", F.lit(0)).alias("chunk"))
    return wanted.join(each, ["answer_id", "chunk"], "left").select("answer_id", "chunk", "score")


@query("AGG5", f"SELECT answer_id, round(retrieval, 6) AS retrieval FROM ({_SCORED})")
def agg5(spark, d):
    return scored(spark, d).select("answer_id", F.round("retrieval", 6).alias("retrieval"))


@query("AGG6", f"SELECT answer_id, round(complete, 6) AS complete FROM ({_SCORED})")
def agg6(spark, d):
    return scored(spark, d).select("answer_id", F.round("complete", 6).alias("complete"))


@query("AGG7", f"SELECT answer_id, round(faith, 6) AS faith FROM ({_SCORED})")
def agg7(spark, d):
    return scored(spark, d).select("answer_id", F.round("faith", 6).alias("faith"))


@query("AGG8", f"SELECT answer_id, round(overall, 6) AS overall FROM ({_OVERALL})")
def agg8(spark, d):
    return scored(spark, d).select("answer_id", F.round("overall", 6).alias("overall"))


_LABEL = "CASE WHEN overall >= 0.75 THEN 'HIGH' WHEN overall >= 0.5 THEN 'MEDIUM' WHEN overall >= 0.35 THEN 'LOW' ELSE 'VERY_LOW' END"


@query("AGG9", f"SELECT answer_id, round_even(overall, 4) AS overall, {_LABEL} AS label, overall >= {DEFAULTS.confidence_min} AS passed FROM ({_OVERALL})")
def agg9(spark, d):
    o = F.col("overall")
    return scored(spark, d).select("answer_id", F.bround(o, 4).alias("overall"), V.label(o).alias("label"), (o >= DEFAULTS.confidence_min).alias("passed"))


_ISSUES = f"""SELECT answer_id, overall, cast(len(list_filter({_C}, lambda c: c < 1 OR c > len(chunks))) + CASE WHEN len({_C}) = 0 AND length(answer) > 100 THEN 1 ELSE 0 END
 + CASE WHEN {_VALID} > 0 THEN len(list_filter({_N}, lambda s: len({_cited('s')}) > 0 AND len({_claims('s')}) >= 3 AND NOT ({_grounded('s')}))) ELSE 0 END + CASE WHEN overall < {DEFAULTS.confidence_min} THEN 1 ELSE 0 END AS INTEGER) AS issues FROM ({_OVERALL})"""


@query("ORC3", f"SELECT answer_id, issues, CASE WHEN issues = 0 THEN 'PASS' WHEN overall < {DEFAULTS.confidence_min} * 0.7 OR issues >= 3 THEN 'FAIL' ELSE 'WARN' END AS guard FROM ({_ISSUES})")
def orc3(spark, d):
    rows = scored(spark, d).withColumn("issues", V.guard_issues(F.col("answer"), F.col("chunks"), F.col("overall")))
    return rows.select("answer_id", "issues", V.guard_result(F.col("issues"), F.col("overall")).alias("guard"))


REFUSAL = V.REFUSAL
#: Of some turns nothing was retrieved; the questions share words with the first source, or hardly any.
_ASKED = "CASE WHEN doc_id % 5 = 0 THEN 'unrelated' ELSE substring(text, 1, 40) END"
_SET = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"
_GUARD = f"CASE WHEN issues = 0 THEN 'PASS' WHEN overall < {DEFAULTS.confidence_min} * 0.7 OR issues >= 3 THEN 'FAIL' ELSE 'WARN' END"


@query("ORC2", f"""WITH g AS (SELECT i.answer_id, i.overall, a.answer, {_GUARD} AS guard, len(list_filter(a.chunks, lambda c: len(list_intersect({_SET.format(_ASKED)}, {_SET.format('c')})) >= 2)) AS found FROM ({_ISSUES}) i JOIN {A} a USING (answer_id) JOIN documents d ON d.doc_id = i.answer_id),
r AS (SELECT *, CASE WHEN answer_id % 11 = 0 THEN 'no sources' WHEN found = 0 THEN 'no evidence' WHEN guard = 'FAIL' OR overall < {DEFAULTS.confidence_min} THEN 'low confidence' END AS reason FROM g)
SELECT answer_id, reason, CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS outcome, CASE WHEN reason IN ('no sources', 'no evidence') OR guard = 'FAIL' THEN '{REFUSAL}' WHEN guard = 'WARN' THEN answer || '{V.NOTE}' ELSE answer END AS reply FROM r""")
def orc2(spark, d):
    """Turns through all three gates: sources, evidence, confidence and guard."""
    rows = scored(spark, d).withColumn("issues", V.guard_issues(F.col("answer"), F.col("chunks"), F.col("overall")))
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.expr(_ASKED).alias("question"))
    given = rows.join(asked, "answer_id").withColumn("evidence", M.evidence(F.col("question"), F.col("chunks"))).withColumn("chunks", F.when(F.col("answer_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("chunks")))
    return V.replies(given).select("answer_id", "reason", "outcome", "reply")


@query("HLP18", f"SELECT conv_id, turn, '{REFUSAL}' || ' (' || left(text, 20) || ')' AS reply FROM conversations WHERE role = 'user'")
def hlp18(spark, d):
    """The refusal text as the reply to every question, with its start."""
    asked = table(spark, d, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.concat(F.lit(f"{REFUSAL} ("), F.left("text", F.lit(20)), F.lit(")")).alias("reply"))


@query("FLT6", f"SELECT doc_id, cast(len({_numeric('text')}) AS INTEGER) AS n FROM documents")
def flt6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.numeric_sentences(F.col("text"))).alias("n"))


#: Letters beyond ASCII are word characters at a word's border, as the underscore is.
_PLAIN = "regexp_replace(lower(text), '[^\\x00-\\x7F\\p{P}\\p{S}\\p{Z}\\p{C}\\p{M}]', '_', 'g')"


@query("FN2", f"SELECT doc_id, cast(len(list_distinct(regexp_extract_all({_PLAIN}, '\\b[a-z0-9₹%.,]+\\b'))) AS INTEGER) AS n FROM documents")
def fn2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.claim_words(F.col("text"))).alias("n"))


_W = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"
_EVAL = f"SELECT b.item_id, {_W.format('b.text')} AS a, {_W.format('c.text')} AS q, {_W.format('d.text')} AS c FROM benchmark b JOIN (SELECT count(*) AS n FROM benchmark) ON true JOIN benchmark c ON c.item_id = (b.item_id + 1) % n JOIN documents d ON d.doc_id = b.item_id"
_EVALUATED = f"SELECT item_id, len(list_intersect(a, c)) / greatest(len(a), 1) AS faith, len(list_intersect(a, q)) / greatest(len(q), 1) AS relevance, len(list_intersect(c, q)) / greatest(len(q), 1) AS recall, len(list_intersect(c, q)) / greatest(len(c), 1) AS prec FROM ({_EVAL})"


def evaluated(spark, d):
    """Each item as the answer, its successor (of the last one the first) as question and ground truth, the document of its id as context."""
    b = table(spark, d, "benchmark")
    w = lambda c: F.array_distinct(T.words(F.col(c)))
    rows = b.select("item_id", w("text").alias("a")).crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("n")))).withColumn("next", (F.col("item_id") + 1) % F.col("n")).join(b.select(F.col("item_id").alias("next"), w("text").alias("q")), "next").join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), w("text").alias("c")), "item_id")
    share = lambda x, y, of: F.size(F.array_intersect(x, y)) / F.greatest(F.size(of), F.lit(1))
    return rows.select("item_id", share("a", "c", "a").alias("faith"), share("a", "q", "q").alias("relevance"), share("c", "q", "q").alias("recall"), share("c", "q", "c").alias("prec"))


@query("SET2", f"SELECT item_id, round(faith, 6) AS faith FROM ({_EVALUATED})")
def set2(spark, d):
    return evaluated(spark, d).select("item_id", F.round("faith", 6).alias("faith"))


@query("AGG10", f"SELECT round(avg(faith), 6) AS faith, round(avg(relevance), 6) AS relevance, round(avg(recall), 6) AS recall, round(avg(prec), 6) AS prec, count(*) AS n FROM ({_EVALUATED})")
def agg10(spark, d):
    m = lambda c: F.round(F.avg(c), 6).alias(c)
    return evaluated(spark, d).agg(m("faith"), m("relevance"), m("recall"), m("prec"), F.count(F.lit(1)).alias("n"))


@query("ORC5", f"SELECT item_id, round((faith + relevance + recall + prec) / 4, 6) AS mean FROM ({_EVALUATED})")
def orc5(spark, d):
    return evaluated(spark, d).select("item_id", F.round((F.col("faith") + F.col("relevance") + F.col("recall") + F.col("prec")) / 4, 6).alias("mean"))


@query("HLP14", "SELECT item_id, text AS question, '' AS answer, cast(0 AS INTEGER) AS n_contexts FROM benchmark")
def hlp14(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), F.lit("").alias("answer"), F.lit(0).alias("n_contexts"))


#: What generators put out, around the turns of conversations.
RAW = "CASE turn % 4 WHEN 0 THEN '\"Rewritten query: ' || text || '\"' WHEN 1 THEN 'rewritten standalone query ' || text WHEN 2 THEN 'abc' ELSE '  ' || text || '  ' END"
OUTPUTS = f"(SELECT conv_id, turn, {RAW} AS raw, role || ' asked' AS original FROM conversations)"


@query("FN5", f"SELECT conv_id, turn, CASE WHEN length(o) < 5 THEN original ELSE o END AS cleaned FROM (SELECT conv_id, turn, original, trim(regexp_replace(regexp_replace(trim(raw), '^[\"'']|[\"'']$', '', 'g'), '(?i)^(rewritten\\s+(?:standalone\\s+)?query\\s*:?\\s*)', '')) AS o FROM {OUTPUTS})")
def fn5(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(RAW).alias("raw"), F.concat("role", F.lit(" asked")).alias("original"))
    return rows.select("conv_id", "turn", T.clean_rewrite(F.col("raw"), F.col("original")).alias("cleaned"))


_T = "replace(replace(text, chr(10), ' '), '~', ' ')"
#: Lists as generators write them, of the texts of conversations; lines are parted by '~'.
LISTS = (
    f"CASE (conv_id + turn) % 3 WHEN 0 THEN '1. ' || substring({_T}, 1, 40) || '~2) second one here~<think>~3. abc~' || substring({_T}, 41, 40) WHEN 1 THEN substring({_T}, 1, 50) || '~another plain line' "
    f"ELSE '1. variant number one~2. ' || substring({_T}, 1, 30) || '~3. variant number three~4. ' || substring({_T}, 31, 30) END"
)
_LINES = f"SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS ord FROM (SELECT id, list_transform(string_split(raw, '~'), lambda x: trim(x)) AS l FROM (SELECT conv_id * 1000 + turn AS id, {LISTS} AS raw FROM conversations))"


def generated(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.replace(F.expr(LISTS), F.lit("~"), F.lit("\n")).alias("raw"))


@query("FN6", f"SELECT id, string_agg(q, '|' ORDER BY ord) AS items FROM (SELECT id, ord, trim(regexp_replace(line, '^\\d+[.)]\\s*', '')) AS q FROM ({_LINES}) WHERE line <> '' AND NOT regexp_matches(line, '^</?\\w+>$')) WHERE length(q) > 5 GROUP BY id")
def fn6(spark, d):
    rows = generated(spark, d)
    return rows.select("id", F.array_join(T.numbered_items(F.col("raw")), "|").alias("items"))


@query("FN7", f"""SELECT id, string_agg(q, '|' ORDER BY ord) AS variants FROM (
  SELECT id, ord, q, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM (
    SELECT id, ord, CASE WHEN listed THEN item ELSE line END AS q, listed, count(*) FILTER (listed AND length(item) > 5) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier, row_number() OVER (PARTITION BY id, listed ORDER BY ord) AS nth
    FROM (SELECT id, ord, line, regexp_matches(line, '^[\\d\\-*]+[.)]\\s*.+') AS listed, trim(regexp_extract(line, '^[\\d\\-*]+[.)]\\s*(.+)', 1)) AS item FROM ({_LINES})))
  WHERE (listed AND length(q) > 5) OR (NOT listed AND length(q) > 10 AND earlier = 0 AND nth = 1)) WHERE n <= 3 GROUP BY id""")
def fn7(spark, d):
    rows = generated(spark, d)
    return rows.select("id", F.array_join(T.variants(F.col("raw"), 3), "|").alias("variants"))


#: Parts as models: a size in parameters and a quantization.
_N, _Q = "cast(p_size AS bigint) * 250000000 + p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN '8bit' ELSE '4bit' END"


@query("FN17", f"SELECT id, round(n * CASE q WHEN '4bit' THEN 0.5 WHEN '8bit' THEN 1.0 ELSE 2.0 END::DOUBLE / 1073741824.0::DOUBLE * 1.2::DOUBLE, 6) AS gb FROM (SELECT p_partkey AS id, {_N} AS n, {_Q} AS q FROM part)")
def fn17(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(T.vram_gb(F.expr(_N), F.expr(_Q)), 6).alias("gb"))
