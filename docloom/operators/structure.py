"""Document structure: boundaries, zones, sections, references, statistics. Ranges of pages are joined by document and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import any_of, is_upper, space_words, stripped

# Reference patterns and document-type phrases.
REFERENCES = [r"(?i)\bsee\s+page\s+(\d+)\b", r"(?i)\bsee\s+section\s+(\d+\.?\d*)\b", r"(?i)\brefer\s+to\s+page\s+(\d+)\b", r"(?i)\b\(see\s+page\s+(\d+)\)"]
MID_STARTS = ("and", "or", "but", "which", "that")


def in_document(*order: str | Column):
    return Window.partitionBy("doc_id").orderBy(*order)


def page_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page_number").alias("pages"))


def continuity_markers(pages: DataFrame) -> DataFrame:
    text = stripped(F.col("text"))
    first, last = F.substring(text, 1, 1), F.right(text, F.lit(1))
    lower = (F.lower(first) == first) & (F.upper(first) != first)
    starts = lower
    for word in MID_STARTS:
        starts = starts | F.startswith(text, F.lit(word))
    return pages.where(F.length(text) > 0).select(
        "doc_id",
        "page_number",
        starts.alias("starts_mid_sentence"),
        (~last.isin(".", "!", "?")).alias("ends_mid_sentence"),
        text.rlike(r"^([a-z]\)|\d+\.|-|•)").alias("list_continuation"),
    )


def content_zones(types: DataFrame) -> DataFrame:
    """Runs of pages of equal type: ``types(doc_id, page_number, primary_type, chunk_priority)``."""
    order = in_document("page_number")
    changed = F.coalesce((F.lag("primary_type").over(order) != F.col("primary_type")).cast("int"), F.lit(1))
    runs = types.withColumn("changed", changed).withColumn("zone", F.sum("changed").over(order))
    return runs.groupBy("doc_id", "zone").agg(
        F.first("primary_type").alias("zone_type"),
        F.min("page_number").alias("start_page"),
        F.max("page_number").alias("end_page"),
        F.count(F.lit(1)).alias("n_pages"),
        F.avg("chunk_priority").alias("avg_priority"),
    )


def section_boundaries(headings: DataFrame, totals: DataFrame) -> DataFrame:
    """Headings of level 1 and 2; a section ends before the next one's page, the last at the last page."""
    major = headings.where("level <= 2")
    order = in_document("page_number", "ord")
    after = F.lead("page_number").over(order) - 1
    return (
        major.withColumns({"section_no": F.row_number().over(order), "next_end": after})
        .join(totals, "doc_id")
        .select("doc_id", "section_no", F.col("text").alias("title"), F.col("page_number").alias("start_page"), F.coalesce("next_end", "pages").alias("end_page"))
    )


def major_sections(headings: DataFrame, totals: DataFrame) -> DataFrame:
    """Level-1 headings; an end never precedes its start."""
    order = in_document("page_number", "ord")
    tops = headings.where("level = 1").withColumns({"section_no": F.row_number().over(order), "next_page": F.lead("page_number").over(order)})
    end = F.coalesce(F.greatest("page_number", F.when(F.col("next_page") == F.col("page_number"), F.col("page_number")).otherwise(F.col("next_page") - 1)), F.col("pages"))
    return tops.join(totals, "doc_id").select("doc_id", "section_no", F.col("text").alias("title"), F.col("page_number").alias("start_page"), end.alias("end_page"))


def pages_of(ranges: DataFrame, key: list[str]) -> DataFrame:
    """A row per page of each range; ranges whose end precedes their start have none."""
    return ranges.where("start_page <= end_page").select("doc_id", *key, F.explode(F.sequence("start_page", "end_page")).alias("page_number"))


def subsections(sections: DataFrame, headings: DataFrame) -> DataFrame:
    """Level 2 and 3 headings inside a section; one ends before the next heading of its level or a higher one, else with its section."""
    inside = pages_of(sections, ["section_no"]).join(headings.where("level in (2, 3)"), ["doc_id", "page_number"])
    ends = sections.select("doc_id", "section_no", F.col("end_page").alias("section_end"))
    inside = inside.join(ends, ["doc_id", "section_no"])
    order = Window.partitionBy("doc_id", "section_no").orderBy("page_number", "level", "ord")
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    # The next heading of level 2 ends both levels; one of level 3 ends only its own.
    next_two = F.min(F.when(F.col("level") == 2, F.col("page_number"))).over(ahead)
    next_any = F.min("page_number").over(ahead)
    end = F.coalesce(F.when(F.col("level") == 2, next_two).otherwise(next_any) - 1, F.col("section_end"))
    return inside.select("doc_id", "section_no", "page_number", "level", F.col("text").alias("title"), end.alias("end_page"))


def policy_boundaries(headings: DataFrame, pages: DataFrame, is_policy: Column) -> DataFrame:
    """A row per page and policy heading that covers it; other pages are ``unassigned``."""
    order = in_document("page_number", "ord")
    totals = page_totals(pages)
    major = headings.where("level <= 2").withColumns({"next_end": F.lead("page_number").over(order) - 1, "nth": F.row_number().over(order)})
    spans = major.where(is_policy).join(totals, "doc_id").select("doc_id", "nth", F.col("page_number").alias("start_page"), F.coalesce("next_end", "pages").alias("end_page"), "text")
    covered = pages_of(spans, ["nth", "text", "start_page", "end_page"]).select(
        "doc_id", "page_number", F.concat(F.lit("policy_"), F.col("nth").cast("string")).alias("policy_id"), (F.col("page_number") == F.col("start_page")).alias("starts"), (F.col("page_number") == F.col("end_page")).alias("ends")
    )
    rest = pages.select("doc_id", "page_number").join(covered.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    return covered.unionByName(rest.select("*", F.lit("unassigned").alias("policy_id"), F.lit(False).alias("starts"), F.lit(False).alias("ends")))


def last_boundary(boundaries: DataFrame) -> DataFrame:
    return boundaries.groupBy("doc_id", "page_number").agg(F.max_by("policy_id", F.struct(F.length("policy_id"), "policy_id")).alias("policy_id"))


def policy_flow(boundaries: DataFrame) -> DataFrame:
    """Per policy: page span, pages, interior continuation pages."""
    return (
        boundaries.where("policy_id <> 'unassigned'")
        .groupBy("doc_id", "policy_id")
        .agg(F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"), F.count(F.lit(1)).alias("n_pages"), F.count_if(~F.col("starts") & ~F.col("ends")).alias("n_interior"))
    )


def references(pages: DataFrame) -> DataFrame:
    """A row per match of each reference pattern; targets that are whole numbers count as pages."""
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in REFERENCES]
    rows = pages.select("doc_id", "page_number", F.posexplode(F.array(*found)).alias("pattern", "targets"))
    return rows.select("doc_id", "page_number", "pattern", F.explode("targets").alias("target")).withColumn("target_page", F.when(F.col("target").rlike(r"^\d+$"), F.expr("try_cast(target AS int)")))


def document_statistics(types: DataFrame, zones: DataFrame) -> DataFrame:
    by_page = types.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("primary_type") == "policy_content").alias("policy_pages"), F.count_if(F.col("primary_type") == "administrative").alias("admin_pages"), F.avg("chunk_priority").alias("priority"))
    by_zone = zones.groupBy("doc_id").agg(F.count(F.lit(1)).alias("zones"), F.min(F.when(F.col("zone_type") == "definitions", F.col("start_page"))).alias("definitions_from"))
    return by_page.join(by_zone, "doc_id").withColumns(
        {"extractability": F.col("policy_pages") / F.col("pages"), "structure_confidence": F.least(F.lit(1.0), F.col("zones") / (F.col("pages") / 10))}
    )


def document_complexity(statistics: DataFrame) -> DataFrame:
    """Mean of five shares: pages, zones, mixed pages, tables a page, and whether it defines or excludes; the expensive tier is above 0.7.

    ``statistics(doc_id, pages, zones, mixed_ratio, tables_a_page, has_complex_sections)``.
    """
    one = F.lit(1.0)
    shares = [F.least(one, F.col("pages") / 100), F.least(one, F.col("zones") / 10), F.col("mixed_ratio"), F.least(one, F.col("tables_a_page") / 3), F.when(F.col("has_complex_sections"), 0.7).otherwise(0.3)]
    return statistics.select("doc_id", (sum(shares[1:], shares[0]) / 5).alias("complexity")).withColumn("expensive_tier", F.col("complexity") > 0.7)


def document_aggregates(pages: DataFrame) -> DataFrame:
    text = F.col("text")
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.floor(F.length(text) / 4)).alias("tokens"),
        F.count_if(F.length(F.trim(text)) < 50).alias("scanned"),
        F.avg((F.length(text) > 100).cast("double")).alias("content_ratio"),
        F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.floor(F.length(text) / 4).alias("n")))), lambda p: p["n"]).alias("page_tokens"),
    )


def toc_entries(lines: DataFrame) -> DataFrame:
    """Entries ``title .... N`` or ``title<TAB>N``; level by indentation."""
    entry = r"^(\s*)(\S.*?)\s*(?:\.{3,}|\t)\s*(\d+)\s*$"
    indent = F.length(F.regexp_extract("line", entry, 1))
    rows = lines.where(F.col("line").rlike(entry))
    return rows.select(
        "doc_id", "line_no", F.regexp_extract("line", entry, 2).alias("title"), F.regexp_extract("line", entry, 3).cast("int").alias("page_number"), F.when(indent >= 4, 3).when(indent >= 2, 2).otherwise(1).alias("level")
    )


def administrative_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages of under 50 words that are first, or outside all sections."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    inside = pages_of(sections, []).distinct().withColumn("inside", F.lit(True))
    return pages.join(inside, ["doc_id", "page_number"], "left").where((words < 50) & (F.col("inside").isNull() | (F.col("page_number") == 1))).select("doc_id", "page_number")


# Keywords and patterns of headings.
ADMIN_HEADINGS = ["place of service", "billing", "coding", "benefit application", "required documentation", "claims", "authorization process", "reference", "sources", "citations"]
REFERENCE_HEADINGS = ["society", "association", "organization", "committee", "references", "bibliography", "sources"]
MAJOR_HEADINGS = ["medical necessity", "coverage criteria", "eligibility", "indications", "contraindications", "exclusions", "limitations", "covered services", "medically necessary"]
SUBSECTION_HEADINGS = ["requirements", "considerations", "guidelines", "procedures", "selection", "evaluation", "criteria", "assessment"]
# (level, pattern, group of the numbering, group of the title; 0 is the whole text).
HEADING_PATTERNS = [
    (1, r"^([IVX]+)\.\s+(.+)$", 1, 2),
    (1, r"^(\d+)\.\s+([A-Z][A-Z\s]{2,})$", 1, 2),
    (1, r"^([A-Z][A-Z\s]{10,})$", 1, 0),
    (2, r"^([A-Z])\.\s+(.+)$", 1, 2),
    (2, r"^(\d+\.\d+)\s+(.+)$", 1, 2),
    (3, r"^([a-z])\.\s+(.+)$", 1, 2),
    (3, r"^(\d+\.\d+\.\d+)\s+(.+)$", 1, 2),
]


def heading_hierarchy(headings: DataFrame) -> DataFrame:
    """``headings(doc_id, page_number, ord, text)`` with level, numbering, title and what decided; administrative and reference headings are dropped.

    In this order: administrative words, reference words, words of major sections, level-1 patterns, words of
    subsections, level-2 and level-3 patterns, capitals and length.
    """
    text = stripped(F.col("text"))
    lower = F.lower(text)
    none = F.lit(None).cast("string")

    def found(level: int, numbering: Column, title: Column, match: str) -> Column:
        return F.struct(F.lit(level).alias("level"), numbering.alias("numbering"), title.alias("title"), F.lit(match).alias("pattern_match"))

    def of_level(level: int, otherwise: Column) -> Column:
        out = otherwise
        for _, pattern, number, title in reversed([p for p in HEADING_PATTERNS if p[0] == level]):
            named = F.regexp_extract(text, pattern, title) if title else text
            out = F.when(text.rlike(pattern), found(level, F.regexp_extract(text, pattern, number), named, f"level_{level}_pattern")).otherwise(out)
        return out

    words = F.size(space_words(text))
    capitals = is_upper(text)
    guessed = (
        F.when(capitals & (F.length(text) > 15), found(1, none, text, "heuristic_long_caps"))
        .when(capitals & (words <= 3), found(0, none, text, "heuristic_short_caps"))
        .when(is_upper(F.substring(text, 1, 1)) & (words > 2), found(2, none, text, "heuristic_title"))
        .otherwise(found(2, none, text, "default"))
    )
    below = F.when(any_of(lower, SUBSECTION_HEADINGS), found(2, none, text, "semantic_subsection")).otherwise(of_level(2, of_level(3, guessed)))
    policy = F.when(any_of(lower, MAJOR_HEADINGS), found(1, none, text, "semantic_major_policy")).otherwise(of_level(1, below))
    rows = headings.where(~any_of(lower, ADMIN_HEADINGS) & ~any_of(lower, REFERENCE_HEADINGS)).withColumn("h", policy).where("h.level > 0")
    return rows.select("doc_id", "page_number", "ord", text.alias("text"), "h.*")


def chunking_guidance(flow: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: page ranges of its policies, pages to filter, pages that need special handling.

    flow: as ``policy_flow`` gives it; pages: doc_id, page_number, primary_type, requires_special_handling,
    is_table_heavy, has_list_continuation.
    """
    ranges = flow.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_page", "end_page"))).alias("chunk_boundaries"))
    filtered = F.when(F.col("primary_type").isin("table_of_contents", "index", "administrative", "bibliography"), F.col("page_number"))
    special = F.when(F.col("requires_special_handling") | F.col("is_table_heavy") | F.col("has_list_continuation"), F.col("page_number"))
    lists = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(filtered)).alias("pages_to_filter"), F.array_sort(F.collect_list(special)).alias("special_handling"))
    none = F.array().cast("array<struct<start_page:bigint,end_page:bigint>>")
    return lists.join(ranges, "doc_id", "left").withColumn("chunk_boundaries", F.coalesce(F.col("chunk_boundaries").cast("array<struct<start_page:bigint,end_page:bigint>>"), none))


def structure_type(toc: Column, headings: Column, sections: Column, zones: Column) -> Column:
    """How structured a document is, by its numbers of contents entries, headings, sections and zones."""
    return F.when((toc > 0) & (headings > 0) & (zones > 5), "highly_structured").when((headings > 0) & (sections > 0), "moderately_structured").when((headings > 0) | (zones > 2), "basic_structure").otherwise("unstructured")


def document_structure(headings: DataFrame, toc: DataFrame, totals: DataFrame) -> DataFrame:
    """Per document: its headings in page order, its entries of contents, its section boundaries, as arrays."""
    listed = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "ord", "text", "level"))).alias("headings"))
    entries = toc.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "title", "page_number", "level"))).alias("toc_entries"))
    bounds = section_boundaries(headings, totals).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "title", "start_page", "end_page"))).alias("section_boundaries"))
    return totals.select("doc_id", "pages").join(listed, "doc_id", "left").join(entries, "doc_id", "left").join(bounds, "doc_id", "left")


def analyzed(kinds: DataFrame, statistics: DataFrame, complexity: DataFrame, structure: DataFrame, guidance: DataFrame, flow: DataFrame, links: DataFrame) -> DataFrame:
    """One row of metadata per document, from what the other operators found about it.

    kinds: doc_id, document_type; complexity: doc_id, complexity; structure: as ``document_structure``; links: as ``references``.
    """
    size = {c: F.coalesce(F.size(c), F.lit(0)) for c in ("headings", "toc_entries", "section_boundaries")}
    size = {c: F.when(F.col(c).isNotNull(), n).otherwise(0) for c, n in size.items()}
    built = structure.select("doc_id", *[n.alias(c) for c, n in size.items()])
    policies = flow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("estimated_policies"))
    met = links.groupBy("doc_id").agg(F.count(F.lit(1)).alias("references"), F.count_if(F.col("target_page").isNotNull()).alias("internal"))
    rows = statistics.join(kinds, "doc_id", "left").join(complexity, "doc_id").join(built, "doc_id").join(guidance, "doc_id").join(policies, "doc_id", "left").join(met, "doc_id", "left")
    kind = structure_type(F.col("toc_entries"), F.col("headings"), F.col("section_boundaries"), F.col("zones"))
    return rows.withColumns(
        {"structure_type": kind, "estimated_policies": F.coalesce("estimated_policies", F.lit(0)), "references": F.coalesce("references", F.lit(0)), "has_internal_references": F.coalesce("internal", F.lit(0)) > 0}
    ).drop("internal")
