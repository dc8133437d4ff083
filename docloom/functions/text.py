"""Column functions on text: token estimates, splitting, citations, entities, intents, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import CATEGORY_KEYWORDS, ENTITY_PATTERNS, PRODUCTS, TOPIC_KEYWORDS

CITATION = r"(?i)\[Source\s+([\d,\s]+)\]"
CLAIM_WORD = r"(?U)\b[a-z0-9₹%.,]+\b"
COMPOUND = (" and also ", " as well as ", " additionally ", " moreover ")


def estimate_tokens(text: Column) -> Column:
    """A token for every four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Split behind . ! ? before a capital, digit or quote; trimmed, blanks dropped, never empty."""
    parts = F.filter(F.transform(F.split(text, r'(?<=[.!?])\s+(?=[A-Z0-9"])'), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def numeric_sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\d"))


def cited_numbers(text: Column) -> Column:
    """Distinct source numbers of all ``[Source 1, 3]`` marks, ascending; what is no number is ignored."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).try_cast("int"))))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


def claim_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(CLAIM_WORD), F.lit(0)))


def language_of(text: Column) -> Column:
    return F.when(text.rlike("[\\u0900-\\u097F]"), "hi").otherwise("en")


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    low = F.lower(text)
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(low, F.lit(k)).cast("int")
    return total


def best_key(text: Column, lists: dict[str, tuple[str, ...]], normalised: bool) -> Column:
    """The list with the highest share (or number) of its keywords in the text; the first of equals; null without a hit."""
    scores = [keyword_hits(text, ks) / F.lit(float(len(ks))) if normalised else keyword_hits(text, ks).cast("double") for ks in lists.values()]
    top = F.greatest(*scores)
    found = F.lit(None).cast("string")
    for name, score in reversed(list(zip(lists, scores, strict=True))):
        found = F.when((score == top) & (top > 0), F.lit(name)).otherwise(found)
    return found


def category_of(text: Column, lists: dict[str, tuple[str, ...]] = CATEGORY_KEYWORDS) -> Column:
    return best_key(text, lists, True)


def topic_of(text: Column, lists: dict[str, tuple[str, ...]] = TOPIC_KEYWORDS) -> Column:
    return best_key(text, lists, False)


def filters_of(text: Column) -> Column:
    """The metadata filter of a query: language, and category where one is found."""
    category = category_of(text)
    return F.when(category.isNotNull(), F.create_map(F.lit("doc_category"), category, F.lit("language"), language_of(text))).otherwise(F.create_map(F.lit("language"), language_of(text)))


def is_compound(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for mark in COMPOUND:
        found = found | F.contains(low, F.lit(mark))
    return found | (F.regexp_count(text, F.lit(r"\?")) > 1)


def entities(text: Column) -> Column:
    """Map from kind to the sorted distinct values found."""
    out = []
    for kind, pattern in ENTITY_PATTERNS.items():
        found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.trim(m)), lambda m: m != "")
        out += [F.lit(kind), F.array_sort(F.array_distinct(found))]
    low = F.lower(text)
    products = F.array_sort(F.filter(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in PRODUCTS]), lambda p: p.isNotNull()))
    return F.create_map(*out, F.lit("banking_product"), products)


def entity_context(found: Column) -> Column:
    """Lines of the kinds that have values, under a heading; empty without any."""
    kinds = [*ENTITY_PATTERNS, "banking_product"]
    lines = F.array(*[F.when(F.size(found[k]) > 0, F.concat(F.lit(f"- {k.replace('_', ' ').title()}: "), F.array_join(F.array_sort(found[k]), ", "))) for k in kinds])
    lines = F.filter(lines, lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.concat(F.lit("=== Active Conversation Entities ===\n"), F.array_join(lines, "\n"))).otherwise(F.lit(""))


def clean_rewrite(text: Column, original: Column) -> Column:
    """A rewriter's output without quotes and prefix; the original query if under five characters remain."""
    out = F.regexp_replace(F.trim(text), "^[\"']|[\"']$", "")
    out = F.trim(F.regexp_replace(out, r"(?i)^(rewritten\s+(?:standalone\s+)?query\s*:?\s*)", ""))
    return F.when(F.length(out) < 5, original).otherwise(out)


def numbered_items(text: Column) -> Column:
    """Sub-queries of a numbered list: blank and tag lines skipped, numbers removed, more than five characters."""
    lines = F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^</?\w+>$"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\d+[.)]\s*", ""))), lambda x: F.length(x) > 5)


def variants(text: Column, n: int) -> Column:
    """Query variants of a list; a plain line counts only while there is none yet; at most n."""
    lines = F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(x))

    def step(found: Column, line: Column) -> Column:
        item = F.trim(F.regexp_extract(line, r"^[\d\-*]+[.)]\s*(.+)", 1))
        listed = line.rlike(r"^[\d\-*]+[.)]\s*.+")
        more = F.when(listed & (F.length(item) > 5), F.array(item)).when(~listed & (F.length(line) > 10) & (F.size(found) == 0), F.array(line)).otherwise(F.array().cast("array<string>"))
        return F.concat(found, more)

    return F.slice(F.aggregate(lines, F.array().cast("array<string>"), step), 1, n)


def title_of(file_name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file_name, r"\.pdf", ""), "_", " ")


def cache_name(url: Column) -> Column:
    """Base name of the URL's path, ending in .pdf."""
    name = F.regexp_extract(F.regexp_replace(F.parse_url(url, F.lit("PATH")), "/+$", ""), r"([^/]*)$", 1)
    name = F.when(name == "", F.lit("document")).otherwise(name)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def intent_reply(text: Column) -> Column:
    """Which canned reply a question gets."""
    low = F.lower(text)
    has = lambda *ws: F.greatest(*[F.contains(low, F.lit(w)) for w in ws], F.lit(False))
    return F.when(has("balance"), "balance").when(has("loan", "interest"), "loan").when(has("transaction", "transfer"), "transfer").otherwise("help")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vram_gb(parameters: Column, quantization: Column, dtype_bytes: int = 2) -> Column:
    per = F.when(quantization == "4bit", 0.5).when(quantization == "8bit", 1.0).otherwise(float(dtype_bytes))
    return parameters * per / float(1024**3) * 1.2
