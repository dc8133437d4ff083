"""Personal data by weak supervision, in DataFrame functions only.

Regex labelers propose spans. Every span gets the votes (1, 0, -1) of further
labelers: shape, gazetteer, cue words before and after. Vote patterns are counted by
an aggregation (at most kinds * 3^labelers rows); expectation-maximisation over these
counts estimates how reliable each labeler is and how likely each pattern is personal
data, and a logistic span classifier is fitted to those posteriors with the spans'
length and digit features. Its coefficients go back into a Column expression. Spans
of the contract's patterns always stay; others need a probability of one half.

Candidates are found once and kept as a table, from which the counts are taken and the
accepted spans. Texts with many matches stay cheap: places are sums over runs of ``RUN``
matches and then inside each run, and what a run of loose spans meets is looked up among
the base spans that reach into it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, table, unused

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "name")

# The base patterns. A run of word characters is entered at its start or
# where the last match ended, and loops are possessive: same matches, linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Given names, titles, domain ends, calling codes and cue words.
GIVEN_NAMES = (
    "Alice", "Andrea", "Anna", "Antonio", "Carlos", "Carmen", "Charles", "Christian", "Claire", "Daniel", "David", "Elena", "Elizabeth", "Emma", "Eric", "Felix",
    "Francisco", "George", "Hans", "Helen", "Isabel", "Jacques", "James", "Jean", "Jennifer", "John", "Jose", "Joseph", "Juan", "Julia", "Karl", "Katharina", "Laura",
    "Linda", "Louis", "Lucas", "Luis", "Manuel", "Maria", "Marie", "Martin", "Mary", "Michael", "Monika", "Nicolas", "Olivia", "Paul", "Pedro", "Peter", "Philippe",
    "Pierre", "Richard", "Robert", "Sarah", "Sofia", "Sophie", "Stefan", "Susan", "Thomas", "Ursula", "Victor", "William", "Wolfgang",
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "eu")
CALLING_CODES = ("1", "33", "34", "44", "49", "39", "41", "43", "91", "86", "81")
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": "ip|server|host|address|login|adresse",
    "card": "card|visa|master|pay|karte|carte|tarjeta",
    "phone": "call|tel|phone|fax|mobile|contact|anruf|llam",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "ssn": "ssn|social|security",
    "name": "mr|mrs|ms|dr|name|dear|herr|frau|señor|madame",
}
AGAINST = "version|order|invoice|isbn|article|chapter|page|figure|build"
#: Loose patterns add candidates that only the classifier can accept.
LOOSE = [
    ("email", r"(?<![\p{L}\p{N}])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![\p{N}+)(] ?)\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\p{N}-])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])"),
    ("name", r"(?<!\p{L})(?=\p{Lu})(?:(?:" + "|".join(GIVEN_NAMES) + r") |(?<=(?<!\p{L})(?:" + "|".join(TITLES) + r")\.? )(?:\p{Lu}\p{Ll}++ )?)\p{Lu}\p{Ll}++(?!\p{L})"),
]
LABELERS = ("shape", "gazetteer", "cue", "against", "edges")
EM_ROUNDS = 40
#: Matches of one run.
RUN = 256
_PART = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern stands; other kinds have no such rule."""
    size = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^(?:0*{_PART}\.){{3}}0*{_PART}$")
    if kind == "card":
        return F.when(size.between(13, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def _votes(kind: str, match: Column, before: Column, after: Column) -> list[Column]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 abstains."""
    small, sure = F.lower(before), F.lit(0)
    shape = {"iban": F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), 1).otherwise(-1), "ssn": F.when(match.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1), "name": sure, "phone": F.when(F.length(_digits(match)).between(9, 15), 1).otherwise(sure)}.get(kind, F.lit(1))
    gazetteer = {
        "email": F.when(F.lower(match).rlike(r"(?:" + "|".join(DOMAIN_ENDS) + ")$"), 1).otherwise(0),
        "phone": F.when(match.rlike(r"^\+(?:" + "|".join(CALLING_CODES) + ")"), 1).otherwise(0),
        "name": F.when(match.rlike(r"^(?:" + "|".join(GIVEN_NAMES) + ") "), 1).otherwise(0),
    }.get(kind, sure)
    cue = F.when(small.rlike(rf"(?<!\p{{L}})(?:{CUES[kind]})"), 1).otherwise(0)
    against = F.when(small.rlike(rf"(?<!\p{{L}})(?:{AGAINST})\p{{L}}*[ :#]*$"), -1).otherwise(0)
    edges = F.when(before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]"), -1).otherwise(0)
    return [shape, gazetteer, cue, against, edges]


def _spans(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """The pattern's leftmost non-overlapping matches with places in code points and votes.

    Splitting by the pattern gives the text between matches, whose lengths give the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = f"array<struct<kind:int,start:int,end:int,base:boolean,{','.join(f'{v}:int' for v in LABELERS)},size:int,digits:int>>"

    def step(state: Column, pair: Column) -> Column:
        match, gap, after = pair["match"], pair["gap"], pair["after"]
        start = state["at"] + F.length(gap)
        end = start + F.length(match)
        votes = _votes(kind, match, F.substring(gap, -40, 40), F.substring(after, 1, 8))
        span = F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), F.lit(base).alias("base"),
            *[v.cast("int").alias(n) for v, n in zip(votes, LABELERS, strict=True)],
            F.least(F.floor(F.length(match) / 8), F.lit(4)).cast("int").alias("size"),
            F.floor(4 * F.length(_digits(match)) / F.length(match)).cast("int").alias("digits"),
        )
        grown = F.concat(state["found"], F.array(span))
        return F.struct(end.alias("at"), (F.when(valid(kind, match), grown).otherwise(state["found"]) if base else grown).alias("found"))

    rows = F.arrays_zip(matches.alias("match"), gaps.alias("gap"), F.slice(gaps, 2, 1 << 30).alias("after"))
    pairs = F.filter(rows, lambda r: r["match"].isNotNull())
    chars = lambda run: F.aggregate(run, F.lit(0), lambda n, p: n + F.length(p["match"]) + F.length(p["gap"]))
    place = lambda at: F.struct(at.alias("at"), F.array().cast(empty).alias("found"))
    found = F.flatten(F.transform(_offsets(_runs(pairs), chars), lambda r: F.aggregate(r["run"], place(r["at"]), step, lambda s: s["found"])))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(empty))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: inside a function of arrays an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(items: Column) -> Column:
    """A non-empty array in runs of ``RUN``."""
    return _let(items, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda k: F.slice(all_, k * RUN + 1, RUN)))


def _offsets(runs: Column, size) -> Column:
    """Each run with the sum of the sizes of those before it."""
    begin = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))

    def with_sums(all_: Column) -> Column:
        sums = F.aggregate(F.transform(all_, size), begin, lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all")), lambda s: s["all"])
        return F.arrays_zip(all_.alias("run"), sums.alias("at"))

    return _let(runs, with_sums)


def _apart(loose: Column, base: Column) -> Column:
    """The loose spans that no base span overlaps; a run of them is compared with the base spans that reach into it."""

    def kept(run: Column) -> Column:
        limits = F.struct(F.array_min(F.transform(run, lambda x: x["start"])).alias("start"), F.array_max(F.transform(run, lambda x: x["end"])).alias("end"))
        near = _let(limits, lambda w: F.filter(base, lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
        return _let(near, lambda some: F.filter(run, lambda x: ~F.exists(some, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"]))))

    return F.when((F.size(base) > 0) & (F.size(loose) > 0), F.flatten(F.transform(_runs(loose), kept))).otherwise(loose)


def candidates(docs: DataFrame, name: str) -> DataFrame:
    """docs with an array of that name: base spans and loose ones that no base span overlaps."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    signs = {"email": "@", "phone": "+"}
    none = F.array()
    out = docs
    for kind in BASE_KINDS:
        spans = _spans(text, kind, PATTERNS[kind], True)
        kept = F.when(F.contains(text, F.lit(signs[kind])), spans) if kind in signs else spans
        out = out.withColumn(f"{name}_{kind}", kept)
    for k, (kind, pattern) in enumerate(LOOSE):
        out = out.withColumn(f"{name}_loose_{k}", _spans(text, kind, pattern, False))
    base = F.concat(*[F.coalesce(F.col(f"{name}_{k}"), none) for k in BASE_KINDS])
    out = out.withColumn(f"{name}_base", base)
    free = [_apart(F.col(f"{name}_loose_{k}"), F.col(f"{name}_base")) for k in range(len(LOOSE))]
    return out.withColumn(name, F.concat(f"{name}_base", *free)).select(*docs.columns, name)


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[dict, dict]:
    """EM over (kind, votes...) counts: posteriors by pattern, and rates of votes by (labeler, class).

    Two classes; a labeler votes by its own rates, smoothed and started so that a
    positive vote speaks for personal data.
    """
    rate = {(j, c, v): (0.7 if v == (1 if c else -1) else 0.15) for j in range(len(LABELERS)) for c in (0, 1) for v in (-1, 0, 1)}
    prior = {p[0]: 0.5 for p, _ in patterns}
    post: dict[tuple[int, ...], float] = {}
    for _ in range(EM_ROUNDS):
        for p, _n in patterns:
            logs = [math.log(prior[p[0]] if c else 1 - prior[p[0]]) + sum(math.log(rate[j, c, v]) for j, v in enumerate(p[1:])) for c in (0, 1)]
            post[p] = 1 / (1 + math.exp(max(-60.0, min(60.0, logs[0] - logs[1]))))
        for kind in prior:
            own = [(post[p], n) for p, n in patterns if p[0] == kind]
            prior[kind] = min(0.98, max(0.02, (1 + sum(q * n for q, n in own)) / (2 + sum(n for _, n in own))))
        for j in range(len(LABELERS)):
            for c in (0, 1):
                mass = {v: 2.0 * (0.7 if v == (1 if c else -1) else 0.15) for v in (-1, 0, 1)}
                for p, n in patterns:
                    mass[p[1 + j]] += n * (post[p] if c else 1 - post[p])
                for v in mass:
                    rate[j, c, v] = mass[v] / sum(mass.values())
    return post, rate


FEATURES = ["bias", *[f"kind{k}" for k in range(len(KINDS))], *LABELERS, "size", "digits"]


def _row(key: tuple[int, ...]) -> list[float]:
    kind, votes, size, digits = key[0], key[1 : 1 + len(LABELERS)], key[-2], key[-1]
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *map(float, votes), size / 4, digits / 4]


def fit_classifier(groups: list[tuple[tuple[int, ...], int]]) -> list[float]:
    """Logistic regression on (kind, votes..., size, digits) groups against their EM posteriors."""
    votes: dict[tuple[int, ...], int] = {}
    for key, n in groups:
        votes[key[: 1 + len(LABELERS)]] = votes.get(key[: 1 + len(LABELERS)], 0) + n
    post, _ = reliabilities(sorted(votes.items()))
    total = sum(n for _, n in groups) or 1
    beta = [0.0] * len(FEATURES)
    data = [(_row(k), post[k[: 1 + len(LABELERS)]], n / total) for k, n in sorted(groups)]
    for _ in range(400):
        grad = [0.002 * b for b in beta]
        for x, y, w in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, beta, strict=True))))))
            for i, v in enumerate(x):
                grad[i] += w * (p - y) * v
        beta = [b - 1.0 * g for b, g in zip(beta, grad, strict=True)]
    return beta


def train(found: DataFrame, name: str) -> list[float]:
    """Coefficients from the candidates of all rows; what is collected is one row for each feature pattern."""
    fields = ["kind", *LABELERS, "size", "digits"]
    one = found.where(F.size(name) > 0).select(F.explode(name).alias("c")).select(*[F.col(f"c.{f}") for f in fields])
    counted = one.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_classifier([(tuple(r[f] for f in fields), r["n"]) for r in counted])


def probability(span: Column, beta: list[float]) -> Column:
    k = len(KINDS)
    by_kind = F.element_at(F.array(*[F.lit(b) for b in beta[1 : 1 + k]]), span["kind"] + 1)
    total = F.lit(beta[0]) + by_kind
    for name, b in zip([*LABELERS, "size", "digits"], beta[1 + k :], strict=True):
        total = total + span[name] * F.lit(b / 4 if name in ("size", "digits") else b)
    return 1 / (1 + F.exp(-total))


def find_pii(docs: DataFrame, name: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """docs with a column name: array of struct(kind, start, end, base), ordered by kind, then start.

    Null texts count as empty; null ids are kept; repeated rows get equal results; an
    empty table gives an empty result. Of accepted loose spans that overlap, all stay;
    a loose span that overlaps a base span never does. Places are in code points, ends
    exclusive. Texts of any length are searched whole. A column of docs that already has
    the name is replaced; all others stay, whatever their names. With ``keep`` only those
    columns stay: the table of candidates, which outlives the call, holds no others.
    """
    docs = docs.drop(name)
    own = unused(docs, "_pii_found")
    found = Workspace(docs.sparkSession).save(candidates(docs, own).select(*(docs.columns if keep is None else keep), own), "candidates")
    beta = train(found, own)
    accepted = F.filter(own, lambda s: s["base"] | (probability(s, beta) >= 0.5))
    slim = F.array_sort(F.transform(accepted, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))
    return found.withColumn(name, slim).drop(own)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of the text replaced by its kind in brackets; other columns as they were.

    Overlapping spans are replaced from left to right, each as far as it reaches beyond
    those before. Awkward rows as in ``find_pii``; a null text stays null.
    """
    name = unused(docs, "_pii_spans")
    spans = F.array_sort(F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    reach = lambda run: F.array_max(F.transform(run, lambda s: s["end"]))

    empty = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("parts"))
    reached = lambda all_, e: F.concat(all_, F.array(F.greatest(e, F.element_at(all_, -1))))

    def replaced(z: Column, text: Column) -> Column:
        """The text of one run, which begins at z.at, with its spans replaced."""

        def step(state: Column, s: Column) -> Column:
            begun = F.greatest(s["start"], state["at"])
            before = F.substring(text, state["at"] - z["at"] + 1, begun - state["at"])
            piece = F.when(s["end"] > state["at"], F.concat(before, F.element_at(marks, s["kind"] + 1))).otherwise(F.lit(""))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["parts"], F.array(piece)).alias("parts"))

        return F.aggregate(z["run"], empty(z["at"]), step, lambda s: F.array_join(s["parts"], ""))

    def pieces(runs: Column) -> Column:
        # A run begins where the spans of all runs before it end at the latest.
        ends = F.aggregate(F.transform(runs, reach), F.array(F.lit(0)), reached)
        zipped = lambda at: F.filter(F.arrays_zip(runs.alias("run"), at.alias("at"), F.slice(at, 2, 1 << 30).alias("till")), lambda z: z["run"].isNotNull())
        part = lambda z: _let(F.substring(F.col("text"), z["at"] + 1, z["till"] - z["at"]), lambda t: replaced(z, t))
        rest = lambda at: F.substring(F.col("text"), F.element_at(at, -1) + 1, F.length("text"))
        return _let(ends, lambda at: F.concat(F.array_join(F.transform(zipped(at), part), ""), rest(at)))

    done = _let(_runs(spans), pieces)
    return find_pii(docs, name).withColumn("text", F.when(F.size(name) > 0, done).otherwise(F.col("text"))).select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of all documents; awkward rows as in ``find_pii``."""
    spans = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == KINDS.index(kind)))).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
