"""Scalar text functions over the page table: features, keywords, similarity, repair. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword and stop-word lists.
IMPORTANCE_WORDS = ["coverage", "eligibility", "exclusion", "requirement", "criteria", "policy", "procedure"]
DEFINITION_PATTERN = r"\bdefinition|\bdefined as\b|\bmeans\b|\brefers to\b|\bshall mean\b"
REFERENCE_PATTERN = r"see section|refer to|as defined in|pursuant to"
SIMILARITY_STOP = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]
KEYWORD_STOP = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "should", "could", "may", "might", "must", "can", "this", "that", "these", "those", "it", "its", "they", "them", "their",
]
REFINER_STOP = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "shall", "can",
]
VERIFIER_STOP = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
]
TITLE_STOP = ["for", "of", "the", "and", "or", "in", "a", "an", "to", "is", "are", "be"]
TITLE_PREFIXES = ["criteria for", "guidelines for", "policy for", "requirements for"]
SUFFIXES = ["tion", "ness", "ment", "ity", "ies", "ing", "ed", "er", "est", "ly", "s"]
POLICY_STARTS = [r"^\d+\.\s+[A-Z]", r"^[A-Z\s]{3,}$", r"^\d+\.\d+\s+[A-Z]", r"^POLICY\s*:", r"^COVERAGE\s*:"]
POLICY_WORDS = ["policy", "coverage", "benefit", "procedure", "treatment", "service"]
ADMIN_FAMILIES = {
    "references": ["references", "bibliography", "citations"],
    "revision_history": ["revised", "mptac review", "updated", "change log"],
    "websites": ["websites for additional information", "available at:", "accessed on"],
    "index": ["index", "table of contents"],
    "contact": ["contact information", "customer service", "member services"],
    "legal": ["disclaimer", "copyright", "legal notice"],
}
CITATIONS = [r"\(\d{4}\)", r"et\s+al\.", r"https?://", r"www\."]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def without(tokens: Column, stop: list[str], longer_than: int = 0) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(stop) & (F.length(w) > longer_than))


def any_of(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def preview(text: Column, size: int = 250) -> Column:
    return stripped(F.substring(text, 1, size))


def is_scanned(text: Column) -> Column:
    return (F.length(stripped(text)) < 50) | (F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))) < 10)


def page_importance(text: Column, page: Column, pages: Column, headings: Column, tables: Column, images: Column) -> Column:
    at = page / pages
    lower = F.lower(text)
    hits = sum((F.contains(lower, F.lit(w)).cast("int") for w in IMPORTANCE_WORDS), F.lit(0))
    score = (
        F.lit(0.5)
        + F.when((at > 0.1) & (at < 0.9), 0.1).otherwise(0.0)
        + F.least(F.lit(0.2), headings * F.lit(0.05))
        + F.least(F.lit(0.1), (tables + images) * F.lit(0.03))
        + F.least(F.lit(0.2), F.length(text) / F.lit(5000.0))
        + F.least(F.lit(0.1), hits * F.lit(0.02))
    )
    return F.least(F.lit(1.0), score)


def has_policy_content(text: Column, page: Column, pages: Column) -> Column:
    lower, size = F.lower(text), F.length(stripped(text))
    return ~(
        ((page == 1) & (size < 500))
        | F.contains(lower, F.lit("table of contents"))
        | ((page > pages * 0.95) & F.contains(F.substring(lower, 1, 200), F.lit("index")))
        | ((size < 100) & stripped(text).rlike(r"^\d+$"))
    )


def ocr_confidence(text: Column) -> Column:
    share = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / F.length(text)
    return F.when(F.length(text) > 0, F.least(F.lit(1.0), share * 1.2)).otherwise(0.0)


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def heading_level(line: Column) -> Column:
    """1 to 3 for a heading line, null for any other."""
    size = F.length(line)
    caps = is_upper(line) & (size > 5) & (size < 100)
    numbered = (
        F.when(line.rlike(r"^\d+\.\s+[A-Z]"), 1)
        .when(line.rlike(r"^\d+\.\d+\s+"), 2)
        .when(line.rlike(r"^\d+\.\d+\.\d+\s+"), 3)
        .when(line.rlike(r"(?i)^(Article|Section|Chapter)\s+\d+"), 1)
    )
    return F.when(size >= 3, F.when(caps & (F.coalesce(numbered, F.lit(3)) == 3), 2).otherwise(numbered)).cast("int")


def contains_definitions(text: Column) -> Column:
    return F.lower(text).rlike(DEFINITION_PATTERN)


def context_complete(text: Column) -> Column:
    return contains_definitions(text) | ~F.lower(text).rlike(REFERENCE_PATTERN)


def similarity_tokens(text: Column) -> Column:
    return without(words(text), SIMILARITY_STOP)


def keywords(text: Column) -> Column:
    return without(words(text), KEYWORD_STOP, 3)


def refiner_keywords(text: Column) -> Column:
    return F.array_distinct(without(words(text), REFINER_STOP, 3))


def space_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def key_phrases(text: Column) -> Column:
    w = space_words(text)

    def grams(n: int) -> Column:
        last = F.size(w) - n + 1
        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(last > 0, made).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(grams(2), grams(3)))


def root_word(word: Column) -> Column:
    out = word
    for suffix in sorted(SUFFIXES, key=len):  # the longest suffix is tested first, so it is wrapped last
        out = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) > len(suffix) + 2), F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def text_jaccard(a: Column, b: Column, stop: list[str] = VERIFIER_STOP) -> Column:
    return jaccard(without(words(a), stop), without(words(b), stop))


def title_jaccard(a: Column, b: Column) -> Column:
    same = F.lower(F.trim(a)) == F.lower(F.trim(b))
    return F.when(same, 1.0).otherwise(jaccard(similarity_tokens(a), similarity_tokens(b)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(space_words(F.lower(a))), F.array_distinct(space_words(F.lower(b)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(0.0)


def titles_similar(a: Column, b: Column) -> Column:
    return overlap_coefficient(a, b) > 0.7


def title_parts(title: Column) -> Column:
    """Struct of what similarity of titles looks at: lower text, words, phrases, roots."""
    text = F.lower(F.trim(title))
    rest = text
    for prefix in TITLE_PREFIXES:
        rest = F.trim(F.replace(rest, F.lit(prefix), F.lit("")))
    kept = F.array_distinct(F.filter(space_words(rest), lambda w: ~w.isin(TITLE_STOP) & (F.length(w) > 2)))
    return F.struct(text.alias("text"), kept.alias("words"), key_phrases(rest).alias("phrases"), F.array_distinct(F.transform(kept, root_word)).alias("roots"))


def parts_semantically_similar(a: Column, b: Column) -> Column:
    both = (F.size(a["words"]) > 0) & (F.size(b["words"]) > 0)
    phrases = F.greatest(F.size(a["phrases"]), F.size(b["phrases"]))
    return (a["text"] == b["text"]) | (
        both
        & (
            (jaccard(a["words"], b["words"]) > 0.60)
            | F.when(phrases > 0, F.size(F.array_intersect(a["phrases"], b["phrases"])) / phrases > 0.65).otherwise(False)
            | (F.size(F.array_intersect(a["roots"], b["roots"])) / F.greatest(F.least(F.size(a["roots"]), F.size(b["roots"])), F.lit(1)) > 0.70)
        )
    )


def section_slug(title: Column, parent: Column) -> Column:
    snake = F.lower(F.regexp_replace(title, r"(?i)^(Section|Chapter|Part|Article)\s+", ""))
    snake = F.regexp_replace(F.regexp_replace(snake, r"(?U)[^\w\s-]", ""), r"[-\s]+", "_")
    snake = F.regexp_replace(snake, "^_+|_+$", "")
    snake = F.when(F.length(snake) > 50, F.array_join(F.slice(F.split(snake, "_"), 1, 5), "_")).otherwise(snake)
    return F.when(parent.isNull() | (parent == ""), snake).otherwise(F.concat_ws("_", F.array_join(F.slice(F.split(parent, "_"), 1, 2), "_"), snake))


def is_policy_heading(text: Column) -> Column:
    starts = F.lit(False)
    for pattern in POLICY_STARTS:
        starts = starts | F.trim(text).rlike(pattern)
    return starts | any_of(F.lower(text), POLICY_WORDS)


def filterable_ratio(kind: Column, policy_ratio: Column) -> Column:
    return F.when(kind.isin("table_of_contents", "index", "bibliography", "administrative"), 0.9).otherwise(1.0 - policy_ratio)


def chunk_priority(kind: Column, importance: Column) -> Column:
    base = F.when(kind == "policy_content", 0.9).when(kind.isin("definitions", "coverage"), 0.8).when(kind.isin("exclusions", "eligibility"), 0.7).otherwise(0.5)
    return F.least(F.lit(1.0), base * importance)


def admin_sections(text: Column) -> Column:
    lower = F.lower(text)
    cited = sum((F.regexp_count(text, F.lit(f"(?i){p}")) for p in CITATIONS), F.lit(0))
    found = F.array_compact(F.array(*[F.when(any_of(lower, family), F.lit(name)) for name, family in ADMIN_FAMILIES.items()]))
    return F.when((cited > 10) & ~F.array_contains(found, "references"), F.array_append(found, "references")).otherwise(found)


def repaired_json(content: Column) -> Column:
    """Trailing commas and // comments dropped, quoted keywords freed, invisible characters dropped, in this order."""
    out = F.regexp_replace(content, r",(\s*[}\]])", "$1")
    out = F.regexp_replace(out, r"(?m)//.*?$", "")
    for quoted, plain in (('"True"', "true"), ('"False"', "false"), ('"None"', "null"), ('"null"', "null")):
        out = F.replace(out, F.lit(quoted), F.lit(plain))
    return F.regexp_replace(out, "[​﻿]", "")


def balanced_prefix(content: Column) -> Column:
    """``content`` up to where the depth of its braces last returns to zero; if it never does, without the space behind a last brace; then repaired."""
    folded = F.aggregate(
        F.split(content, ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("zero")),
        lambda acc, c: F.struct(
            (acc["at"] + 1).alias("at"),
            (acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
            F.when((c == "}") & (acc["depth"] == 1), acc["at"] + 1).otherwise(acc["zero"]).alias("zero"),
        ),
    )
    last = F.length(content) - F.instr(F.reverse(content), "}") + 1
    end = F.when(folded["zero"] > 0, folded["zero"]).when(content.rlike(r"\}\s*$"), last).otherwise(F.length(content))
    return repaired_json(F.substring(content, F.lit(1), end))


def fenced(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))


def strict_json(content: Column) -> Column:
    """``content`` as a variant if it is one JSON value and nothing behind it; the parser alone would stop at the value's end.

    Only what closes neither an array nor an object around it is whole.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), content, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), content, F.lit("}")))
    return F.when(named.isNotNull() & (F.size(F.variant_get(listed, "$", "array<variant>")) == 1), F.variant_get(listed, "$[0]", "variant"))


def json_value(content: Column) -> Column:
    """The first of: the whole text, its fenced block, its first object, its first array, that parses as JSON."""
    tries = [content, fenced(content), F.nullif(F.regexp_extract(content, r"(?s)(\{.*\})", 1), F.lit("")), F.nullif(F.regexp_extract(content, r"(?s)(\[.*\])", 1), F.lit(""))]
    return F.coalesce(*[strict_json(t) for t in tries])


def json_object(content: Column) -> Column:
    """As ``json_value`` without the array, objects only."""
    tries = [content, F.nullif(F.regexp_extract(content, r"(?s)(\{.*\})", 1), F.lit(""))]
    parsed = [strict_json(t) for t in tries]
    return F.coalesce(*[F.when(F.startswith(F.schema_of_variant(p), F.lit("OBJECT")), p) for p in parsed])


def json_array(content: Column) -> Column:
    """A whole text that is an array, or the one object that it is, in an array; else the first bracketed part that parses as one; else empty."""
    whole = strict_json(content)
    kind = F.schema_of_variant(whole)
    parts = F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"(?s)(\[.*?\])"), F.lit(1)), strict_json), lambda v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY")))
    items = "array<variant>"
    found = F.when(F.startswith(kind, F.lit("ARRAY")), F.variant_get(whole, "$", items)).when(F.startswith(kind, F.lit("OBJECT")), F.array(whole)).otherwise(F.variant_get(F.get(parts, 0), "$", items))
    return F.coalesce(found, F.array().cast(items))


def suggested_question(condition: Column) -> Column:
    text = F.trim(condition)
    lower = F.lower(text)
    return (
        F.when(F.endswith(text, F.lit("?")), text)
        .when(F.contains(text, F.lit("BMI")) | F.contains(lower, F.lit("age")), F.concat(F.lit("What is your "), F.get(space_words(lower), 0), F.lit("?")))
        .when(any_of(lower, ["have", "has"]), F.concat(F.lit("Do you "), F.replace(F.replace(lower, F.lit("has "), F.lit("have ")), F.lit("the patient "), F.lit("")), F.lit("?")))
        .otherwise(F.concat(F.lit("Does the patient meet the following requirement: "), text, F.lit("?")))
    )


def joined_answer(answer: Column) -> Column:
    """A JSON list as comma-joined text, other text as it is."""
    listed = F.from_json(answer, "array<string>")
    return F.when(F.startswith(F.trim(answer), F.lit("[")) & listed.isNotNull(), F.array_join(listed, ", ")).otherwise(answer)


def merge_recommendation(similarity: Column) -> Column:
    return F.when(similarity > 0.9, "MERGE").when(similarity > 0.8, "REVIEW").otherwise("MONITOR")


def source_reference(page: Column, section: Column, quote: Column) -> Column:
    return F.struct(page.alias("page_number"), section.alias("section"), F.left(quote, F.lit(500)).alias("quoted_text"))
