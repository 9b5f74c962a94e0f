"""Page and document classification by keywords, place, headings and importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import any_of, chunk_priority, filterable_ratio

# Content types in order of preference with their keywords, and document-type phrases.
KEYWORDS: dict[str, list[str]] = {
    "policy_content": [],
    "definitions": ["definitions", "defined terms", "terminology", "glossary", "means", "shall mean", "is defined as", "refers to"],
    "exclusions": ["exclusions", "limitations", "not covered", "excluded", "does not cover", "limitations and exclusions", "what is not covered"],
    "coverage": ["covered services", "coverage", "benefits", "covered benefits", "what is covered", "eligible services", "covered procedures"],
    "eligibility": ["eligibility", "eligible", "qualification", "qualifies", "who is eligible", "member eligibility", "enrollment"],
    "procedures": ["procedure", "process", "how to", "steps to", "filing a claim", "appeals process", "authorization"],
    "table_of_contents": ["table of contents", "contents", "section", "page number"],
    "references": ["references", "see also", "refer to", "cross reference", "reference"],
    "bibliography": ["bibliography", "works cited", "citations", "sources"],
    "index": ["index", "alphabetical index"],
    "appendix": ["appendix", "attachment", "exhibit", "schedule"],
    "administrative": ["cover page", "disclaimer", "notice", "copyright", "proprietary", "confidential", "internal use", "disclaimer of liability"],
}
DOCUMENT_TYPES = {"insurance": ["insurance", "coverage", "policy", "benefit"], "regulatory": ["regulation", "compliance", "regulatory"], "legal": ["contract", "agreement", "legal"]}
# What the place in the document adds.
FRONT = {"administrative": 0.3, "table_of_contents": 0.2}
BACK = {"appendix": 0.3, "index": 0.3, "references": 0.2}
BULLET = r"^\s*[•*-]"


def scored_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_number, pages, text, headings, importance)`` with ``s``: (score, -rank, name) of each content type, the best first. ``headings``: array of the page's heading texts.

    Each step reads columns of the one before, so a text is lower-cased once and no score is computed twice.
    """
    bullets = F.size(F.filter(F.split("text", "\n"), lambda line: line.rlike(BULLET)))
    read = pages.withColumns({"lower": F.lower("text"), "place": F.col("page_number") / F.col("pages"), "bullets": bullets, "heads": F.transform("headings", F.lower)})
    lower, place, importance = F.col("lower"), F.col("place"), F.col("importance")
    raw = {}
    for name, words in KEYWORDS.items():
        score = sum((F.contains(lower, F.lit(w)).cast("double") for w in words), F.lit(0.0)) / max(len(words), 1)
        score = score + F.when(place < 0.1, FRONT.get(name, 0.0)).when(place > 0.9, BACK.get(name, 0.0)).otherwise(0.0)
        if name == "definitions":
            score = score + F.when(F.col("bullets") > 10, 0.2).otherwise(0.0)
        if name == "policy_content":
            score = score + F.when(importance > 0.7, 0.3).otherwise(0.0)
        if words:
            score = score + 0.4 * F.size(F.filter("heads", _names(words)))
        raw[f"raw_{name}"] = score
    weighed = read.withColumns(raw).withColumn("weak", F.greatest(*raw) < 0.3)
    scores = {name: F.when(F.col("weak"), 0.5).otherwise(F.col(f"raw_{name}")) if name == "policy_content" else F.col(f"raw_{name}") for name in KEYWORDS}
    ranked = [F.struct(F.round(s, 9).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores.items())]
    return weighed.withColumn("s", F.sort_array(F.array(*ranked), asc=False)).select(*pages.columns, "s")


def _names(words: list[str]):
    return lambda heading: any_of(heading, words)


def classify_pages(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page_number, pages, text, headings, importance)`` with type, secondary types, flags and ratios."""
    scored = scored_pages(pages)
    lines = F.split(F.trim("text"), "\n")
    typed = scored.select(
        "doc_id",
        "page_number",
        F.get("s", 0)["name"].alias("primary_type"),
        F.transform(F.filter(F.slice("s", 2, 3), lambda x: x["score"] > 0.2), lambda x: x["name"]).alias("secondary_types"),
        F.col("text").rlike(r"(?m)^\s*\d+\.").alias("has_numbered"),
        F.col("text").rlike("(?m)" + BULLET).alias("has_bullets"),
        F.col("text").rlike(r"(?i)\bsee\s+(page|section|chapter)\b").alias("has_references"),
        (F.size(lines) > 40).alias("many_lines"),
        F.col("importance"),
    )
    kind = F.col("primary_type")
    return typed.withColumns(
        {
            "is_dense": F.col("many_lines") & ~F.col("has_bullets"),
            "priority": chunk_priority(kind, F.col("importance")),
            "include": ~kind.isin("table_of_contents", "index", "administrative") & (filterable_ratio(kind, F.col("importance")) < 0.8),
        }
    ).drop("many_lines")


def document_types(pages: DataFrame) -> DataFrame:
    """Type of each document by its first three pages: ``pages(doc_id, page_number, text, primary_type)``."""
    first = pages.where("page_number <= 3").withColumn("lower", F.lower("text"))
    lower = F.col("lower")
    seen = first.groupBy("doc_id").agg(F.bool_or(F.col("primary_type").isin("coverage", "eligibility", "exclusions")).alias("insured"), *[F.bool_or(any_of(lower, words)).alias(name) for name, words in DOCUMENT_TYPES.items()])
    return seen.select("doc_id", F.when(F.col("insured") | F.col("insurance"), "insurance").when(F.col("regulatory"), "regulatory").when(F.col("legal"), "legal").otherwise("unknown").alias("document_type"))

