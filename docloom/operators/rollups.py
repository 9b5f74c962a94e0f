"""Document roll-ups over pages and sections: type, complexity, strategy; page layout; expected policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases of policy types, in order of preference: (type, in section titles, in the first pages).
POLICY_TYPES = [
    ("medical_coverage", ["medical necessity", "coverage criteria"], []),
    ("surgical_procedure", ["surgery"], ["bariatric"]),
    ("exclusions", ["exclusion", "limitation"], []),
    ("benefits", ["benefit", "covered service"], []),
]
COLUMN_GAP, COLUMN_WORDS = 50, 20


def structure_summary(sections: DataFrame, subsections: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document: sections, subsections, mean section length, pages, type, complexity, strategy."""
    by_section = sections.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"), F.avg(F.col("end_page") - F.col("start_page") + 1).alias("section_length"), F.concat_ws(" ", F.collect_list(F.lower("title"))).alias("titles")
    )
    by_subsection = subsections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("subsections"))
    by_page = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), *[F.bool_or((F.col("page_number") <= 3) & _any(F.lower("text"), front)).alias(f"front_{name}") for name, _, front in POLICY_TYPES])
    rows = by_page.join(by_section, "doc_id", "left").join(by_subsection, "doc_id", "left").na.fill({"sections": 0, "subsections": 0, "section_length": 0.0, "titles": ""})
    kind = F.lit("general_policy")
    for name, in_titles, _ in reversed(POLICY_TYPES):
        kind = F.when(_any(F.col("titles"), in_titles) | F.col(f"front_{name}"), name).otherwise(kind)
    points = (
        F.when(F.col("sections") > 5, 2).when(F.col("sections") > 3, 1).otherwise(0)
        + F.when(F.col("subsections") > 10, 2).when(F.col("subsections") > 5, 1).otherwise(0)
        + (F.col("section_length") > 3).cast("int")
        + (F.col("pages") > 10).cast("int")
    )
    rows = rows.withColumns({"policy_type": kind, "complexity": F.when(points >= 5, "high").when(points >= 3, "medium").otherwise("low")})
    strategy = (
        F.when((F.col("complexity") == "high") & (F.col("sections") > 5), "section_based_with_subsections")
        .when((F.col("complexity") == "medium") | (F.col("sections") > 3), "section_based")
        .when(F.col("pages") < 5, "full_document")
        .otherwise("page_range_based")
    )
    return rows.select("doc_id", "sections", "subsections", "section_length", "pages", "policy_type", "complexity", strategy.alias("strategy"))


def _any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def page_layout(words: DataFrame) -> DataFrame:
    """``words(page, width, height, text, x0, top)``: header, footer, density a square inch, columns."""
    order = Window.partitionBy("page").orderBy("x0")
    before = F.lag("x0").over(order)
    # Places are counted where the order has a new one: a distinct count would hold every place of a task's pages.
    rows = words.withColumns({"gap": F.coalesce(F.col("x0") - before > COLUMN_GAP, F.lit(False)), "new": F.col("x0").isNotNull() & ~F.col("x0").eqNullSafe(before)})
    seen = rows.groupBy("page").agg(
        F.bool_or(F.col("top") < F.col("height") * 0.1).alias("has_header"),
        F.bool_or(F.col("top") > F.col("height") * 0.9).alias("has_footer"),
        (F.sum(F.length("text")) / (F.max(F.col("width") * F.col("height")) / (72 * 72))).alias("density"),
        F.count_if("new").alias("places"),
        F.count_if("gap").alias("gaps"),
        F.when(F.max("height") > F.max("width"), "portrait").otherwise("landscape").alias("orientation"),
    )
    return seen.withColumn("columns", F.when(F.col("places") > COLUMN_WORDS, F.col("gaps") + 1).otherwise(1)).drop("places", "gaps")


def table_features(table: Column) -> Column:
    """Of an array of rows: row and column counts, the first three rows, a constant confidence; null for an empty table."""
    return F.when(F.size(table) > 0, F.struct(F.size(table).alias("row_count"), F.size(F.get(table, 0)).alias("col_count"), F.slice(table, 1, 3).alias("preview"), F.lit(0.85).alias("confidence")))


def expected_policies(text: Column) -> Column:
    """One for each line in capitals, and a half for every five list items; at least one."""
    sections = F.regexp_count(text, F.lit(r"\n[A-Z][A-Z\s]+\n"))
    items = F.regexp_count(text, F.lit(r"\n\s*[\d\-•]\s+"))
    return F.greatest(F.lit(1), F.floor(sections + 0.5 * F.floor(items / 5))).cast("int")


def related_text(references: DataFrame, pages: DataFrame, most: int = 3000) -> DataFrame:
    """The pages that a policy refers to, in order, cut: ``references(policy_id, doc_id, page_number)``."""
    rows = references.distinct().join(pages, ["doc_id", "page_number"])
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("policy_id").orderBy("doc_id", "page_number").rowsBetween(Window.unboundedPreceding, -1))
    near = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= most)  # what lies beyond the cut is never gathered
    listed = near.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "page_number", F.left("text", F.lit(most)).alias("text")))).alias("p"))
    return listed.select("policy_id", F.left(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), F.lit(most)).alias("context"))
