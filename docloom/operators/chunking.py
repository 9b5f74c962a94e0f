"""Chunks of whole documents, by what each document has: sections, else policies, else zones; too large ones are split.

Every step works on all documents at once: ranges meet pages by document and page, and what decides are sums of
lengths. Texts come in last, once: only the pages of a chunk are gathered, for its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import contains_definitions, context_complete
from docloom.operators.chunks import packed_pages
from docloom.operators.structure import in_document, pages_of
from docloom.staging import stage

MOST_TOKENS, TARGET_TOKENS = 8000, 3000


def tokens(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / 4)).cast("long")


def boundary_ranges(boundaries: DataFrame) -> DataFrame:
    """(doc_id, range_no, policy_id, start_page, end_page, heading, is_multi_page) of per-page flags.

    ``boundaries(doc_id, page_number, policy_ids, starts, continues, ends, heading)``. A start closes what is open, a
    continuing page extends it, an end closes it; pages without a policy, and pages between an end and the next start,
    count for nothing. The first policy of a page holds.
    """
    rows = boundaries.where((F.size("policy_ids") > 0) & (F.col("policy_ids") != F.array(F.lit("unassigned"))))
    order = in_document("page_number")
    opened = rows.withColumn("range_no", F.sum(F.col("starts").cast("int")).over(order)).where("range_no > 0")
    own = Window.partitionBy("doc_id", "range_no")
    kept = opened.withColumn("closed", F.min(F.when(F.col("ends"), F.col("page_number"))).over(own)).where("closed is null or page_number <= closed")
    extends = F.col("starts") | F.col("continues")
    return kept.groupBy("doc_id", "range_no").agg(
        F.min_by(F.get("policy_ids", 0), "page_number").alias("policy_id"),
        F.min("page_number").alias("start_page"),
        F.coalesce(F.max("closed"), F.max(F.when(extends, F.col("page_number")))).alias("end_page"),
        F.min_by("heading", "page_number").alias("heading"),
        F.bool_or(~F.col("starts") & F.col("continues")).alias("is_multi_page"),
    )


def zone_ids(ranges: DataFrame, zones: DataFrame, key: list[str]) -> DataFrame:
    """``ranges`` with ``zone_ids`` and ``zone_types`` of the zones that share a page with them, in order."""
    a = pages_of(ranges, key)
    b = zones.select("doc_id", "zone_id", "zone_type", F.explode(F.sequence("start_page", "end_page")).alias("page_number"))
    met = a.join(b, ["doc_id", "page_number"]).groupBy("doc_id", *key).agg(F.array_sort(F.collect_set("zone_id")).alias("zone_ids"), F.array_sort(F.collect_set("zone_type")).alias("zone_types"))
    none = F.array().cast("array<string>")
    return ranges.join(met, ["doc_id", *key], "left").withColumns({"zone_ids": F.coalesce("zone_ids", none), "zone_types": F.coalesce("zone_types", none)})


def page_block(tables: Column | None = None) -> Column:
    """A page in a policy's chunk: its mark, its text, a mark for each of its tables."""
    page = F.col("page_number").cast("string")
    block = F.concat(F.lit("--- Page "), page, F.lit(" ---\n\n"), F.col("text"))
    if tables is None:
        return block
    marks = F.transform(F.sequence(F.lit(1), F.greatest(tables, F.lit(1))), lambda i: F.concat(F.lit("\n\n\n[Table "), i.cast("string"), F.lit(" on page "), page, F.lit("]")))
    return F.when(tables > 0, F.concat(block, F.array_join(marks, ""))).otherwise(block)


def page_sizes(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, chars, policy_chars) of ``pages(doc_id, page_number, text, n_tables)``, a staged table: lengths of the text and of its block."""
    return stage(pages.select("doc_id", "page_number", F.length("text").alias("chars"), F.length(page_block(F.col("n_tables"))).alias("policy_chars")), "page-sizes")


def heading_block(heading: Column) -> Column:
    return F.when(F.length(heading) > 0, F.concat(F.lit("=== "), heading, F.lit(" ===\n")))


def _policy_length(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): characters of the chunk that the pages of each key make under their heading."""
    head = F.coalesce(F.length(heading_block(F.col("title"))) + 2, F.lit(0))
    return rows.groupBy(*key).agg((F.sum(F.col("policy_chars") + 2) - 2 + F.max(head)).alias("n"))


def split_by_pages(rows: DataFrame, target: int) -> DataFrame:
    """``rows`` (of one policy or zone a unit) with ``piece``: pages in order, a new piece where the target would be passed."""
    head = F.coalesce(F.length(heading_block(F.col("title"))) + 2, F.lit(0))
    sized = rows.select("doc_id", "unit", "part", "page_number", (F.col("policy_chars") + head).alias("size"))
    packed = packed_pages(sized, tokens(F.col("size")), target, ["doc_id", "unit", "part"])
    return rows.join(packed.select("doc_id", "unit", "part", "page_number", F.col("grp").alias("piece")), ["doc_id", "unit", "part", "page_number"])


def _by_size(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pages of units within ``most`` tokens, and those of the others."""
    sized = rows.join(_policy_length(rows, ["doc_id", "unit", "part"]), ["doc_id", "unit", "part"])
    large = tokens(F.col("n")) > most
    return sized.where(~large).drop("n"), sized.where(large).drop("n")


def _forced(rows: DataFrame, target: int) -> DataFrame:
    """Page splits of too large units: their ranges are their pages', and they belong to no zone."""
    pieces = split_by_pages(rows, target)
    own = Window.partitionBy("doc_id", "unit", "part", "piece")
    return pieces.withColumns(
        {
            "kind": F.lit("page_split_forced"),
            "start_page": F.min("page_number").over(own),
            "end_page": F.max("page_number").over(own),
            "complete": F.lit(False),
            "continuous": F.lit(False),
            "zone_ids": F.array().cast("array<string>"),
        }
    )


def policy_rows(ranges: DataFrame, zones: DataFrame, sizes: DataFrame, most: int = MOST_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """Pages with the chunk that they fall into, one chunk a boundary range; too large ones by zones, then by pages. ``sizes`` as ``page_sizes`` gives them."""
    tagged = zone_ids(ranges.withColumnRenamed("range_no", "unit"), zones, ["unit"])
    units = tagged.select("doc_id", "unit", F.lit(0).alias("part"), F.lit("policy").alias("kind"), F.col("policy_id").alias("source_id"), F.col("heading").alias("title"), "start_page", "end_page", "zone_ids", "is_multi_page")
    rows = pages_of(units, [c for c in units.columns if c not in ("doc_id", "start_page", "end_page")] + ["start_page", "end_page"]).join(sizes, ["doc_id", "page_number"])
    present = Window.partitionBy("doc_id", "unit")
    whole_run = F.count(F.lit(1)).over(present) == F.col("end_page") - F.col("start_page") + 1
    rows = rows.withColumns({"complete": F.lit(None).cast("boolean"), "continuous": ~F.col("is_multi_page") | whole_run}).drop("is_multi_page")
    small, large = _by_size(stage(rows, "policy-pages"), most)
    z = zones.select("doc_id", "zone_id", "zone_no", F.col("start_page").alias("zone_start"), F.col("end_page").alias("zone_end"), F.explode(F.sequence("start_page", "end_page")).alias("page_number"))
    parted = large.withColumn("has_zone", F.size("zone_ids") > 0).drop("part", "zone_ids", "start_page", "end_page", "kind", "complete", "continuous").join(z, ["doc_id", "page_number"], "left")
    zoned = parted.withColumns({"part": F.coalesce(F.col("zone_no") + 1, F.lit(0)).cast("int"), "kind": F.lit("zone_split"), "zone_ids": F.array_compact(F.array("zone_id")), "start_page": F.col("zone_start"), "end_page": F.col("zone_end"), "complete": F.lit(False), "continuous": F.lit(True)})
    fits, rest = _by_size(zoned.where("has_zone and zone_no is not null").select(*small.columns), most)
    # A policy that meets no zone is split by pages; else its pages outside of all zones are in no chunk.
    bare = large.where(F.size("zone_ids") == 0)
    none = F.lit(0).alias("piece")
    forced = _forced(rest.unionByName(bare), target)
    return small.select("*", none).unionByName(fits.select("*", none)).unionByName(forced.select(*small.columns, "piece"))


def zone_rows(zones: DataFrame, sizes: DataFrame, most: int = MOST_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """Pages with the chunk that they fall into, one chunk a zone; too large ones by pages."""
    units = zones.select("doc_id", F.col("zone_no").alias("unit"), F.lit(0).alias("part"), F.lit("content_zone").alias("kind"), F.col("zone_id").alias("source_id"), F.col("zone_type").alias("title"), "start_page", "end_page", F.array("zone_id").alias("zone_ids"))
    rows = pages_of(units, [c for c in units.columns if c not in ("doc_id", "start_page", "end_page")] + ["start_page", "end_page"]).join(sizes, ["doc_id", "page_number"])
    rows = rows.withColumns({"complete": F.lit(True), "continuous": F.lit(True)})
    small, large = _by_size(rows, most)
    return small.withColumn("piece", F.lit(0)).unionByName(_forced(large, target).select(*small.columns, "piece"))


def policy_chunks(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks of ``policy_rows`` and ``zone_rows``: numbered in each document, with text, tokens and flags."""
    blocks = pages.select("doc_id", "page_number", page_block(F.col("n_tables")).alias("block"))
    listed = rows.join(blocks, ["doc_id", "page_number"]).groupBy("doc_id", "unit", "part", "piece").agg(
        *[F.first(c).alias(c) for c in ("kind", "source_id", "title", "start_page", "end_page", "complete", "continuous", "zone_ids")],
        F.array_sort(F.collect_list(F.struct("page_number", "block"))).alias("b"),
    )
    body = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    text = F.concat_ws("\n\n", heading_block(F.col("title")), body)
    numbered = listed.withColumns({"chunk_id": F.row_number().over(in_document("unit", "part", "piece")) - 1, "text": text}).drop("b")
    return numbered.withColumns(
        {"token_count": tokens(F.length("text")), "has_definitions": contains_definitions(F.col("text")), "has_complete_context": F.coalesce("complete", context_complete(F.col("text")))}
    ).select("doc_id", "chunk_id", "kind", "source_id", "title", "start_page", "end_page", "zone_ids", "token_count", "has_definitions", "has_complete_context", F.col("continuous").alias("continuity_preserved"), "text")


def section_chunks(sections: DataFrame, subsections: DataFrame, zones: DataFrame, pages: DataFrame, sizes: DataFrame, most: int = MOST_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """One chunk a major section with all its subsections; too large ones a chunk a subsection, or by pages where there are none.

    sections: doc_id, section_no, section_id, title, start_page, end_page; subsections: doc_id, section_no, sub_no,
    subsection_id, title, start_page, end_page.
    """
    line = F.concat(F.lit("  - "), "title", F.lit(" (pages "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"), F.lit(")"))
    listed = subsections.groupBy("doc_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("sub_no", line.alias("line")))).alias("subs"))
    with_subs = sections.join(listed, ["doc_id", "section_no"], "left")
    lines = F.when(F.col("subs").isNotNull(), F.concat(F.lit("\nSubsections: "), F.size("subs").cast("string"), F.lit("\n"), F.array_join(F.transform("subs", lambda s: s["line"]), "\n"))).otherwise("")
    units = with_subs.select("doc_id", "section_no", F.col("section_id").alias("source_id"), "title", "start_page", "end_page", F.concat(_section_head("section_id"), lines).alias("head"), F.col("subs").isNotNull().alias("has_subs"))
    page = F.col("page_number").cast("string")
    rows = pages_of(units, ["section_no", "source_id", "title", "head", "has_subs", "start_page", "end_page"]).join(sizes.select("doc_id", "page_number", "chars"), ["doc_id", "page_number"])
    marked = F.length(page) + len("[Page ]\n") + F.col("chars")
    totals = rows.groupBy("doc_id", "section_no").agg((F.sum(marked + 2) + F.max(F.length("head")) + 1).alias("n"))
    sized = stage(rows.join(totals, ["doc_id", "section_no"]).withColumn("large", tokens(F.col("n")) > most).drop("n"), "section-pages")
    whole = sized.where("not large").withColumns({"part": F.lit(0), "kind": F.lit("section")})

    sub = subsections.select("doc_id", "section_no", F.col("sub_no").alias("part"), F.col("subsection_id").alias("sub_id"), F.col("title").alias("sub_title"), F.col("start_page").alias("sub_start"), F.col("end_page").alias("sub_end"))
    sub_pages = sub.where("sub_start <= sub_end").withColumn("page_number", F.explode(F.sequence("sub_start", "sub_end")))
    renamed = {"source_id": F.col("sub_id"), "title": F.col("sub_title"), "start_page": F.col("sub_start"), "end_page": F.col("sub_end")}
    split = sized.where("large and has_subs").join(sub_pages, ["doc_id", "section_no", "page_number"]).withColumns(renamed)
    split = split.withColumns({"head": _section_head("source_id"), "kind": F.lit("subsection")}).select(*whole.columns)

    bare = sized.where("large and not has_subs")
    packed = packed_pages(bare.select("doc_id", "section_no", "page_number", "chars"), tokens(F.col("chars")), target, ["doc_id", "section_no"])
    ranged = bare.join(packed.select("doc_id", "section_no", "page_number", F.col("grp").alias("part")), ["doc_id", "section_no", "page_number"])
    own = Window.partitionBy("doc_id", "section_no", "part")
    ranged = ranged.withColumns({"start_page": F.min("page_number").over(own), "end_page": F.max("page_number").over(own), "head": F.lit(None).cast("string"), "kind": F.lit("page_range")}).select(*whole.columns)

    blocks = pages.select("doc_id", "page_number", F.concat(F.lit("[Page "), page, F.lit("]\n"), F.col("text")).alias("block"))
    chunks = whole.unionByName(split).unionByName(ranged).join(blocks, ["doc_id", "page_number"]).groupBy("doc_id", "section_no", "part").agg(
        *[F.first(c).alias(c) for c in ("kind", "source_id", "title", "start_page", "end_page", "head")], F.array_sort(F.collect_list(F.struct("page_number", "block"))).alias("b")
    )
    numbered = chunks.withColumn("chunk_id", F.row_number().over(in_document("section_no", "part")) - 1)
    page_range = F.concat(F.lit("\nPages: "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"))
    head = F.coalesce("head", F.concat(F.lit("=== "), "title", F.lit(" (Part "), (F.col("chunk_id") + 1).cast("string"), F.lit(") ==="), page_range))
    text = F.concat(head, F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit("\n"))
    tagged = zone_ids(numbered.withColumn("text", text).drop("b"), zones, ["chunk_id"])
    return tagged.select(
        "doc_id", "chunk_id", "kind", "source_id", "title", "start_page", "end_page", F.col("zone_types").alias("zone_ids"), tokens(F.length("text")).alias("token_count"),
        F.array_contains("zone_types", "definitions").alias("has_definitions"), (F.col("kind") != "page_range").alias("has_complete_context"), F.lit(True).alias("continuity_preserved"), "text",
    )


def _section_head(source: str) -> Column:
    pages = F.concat(F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"))
    return F.concat(F.lit("=== "), "title", F.lit(" ===\nSection ID: "), source, F.lit("\nPages: "), pages)


def chunk_documents(pages: DataFrame, sections: DataFrame, subsections: DataFrame, ranges: DataFrame, zones: DataFrame, most: int = MOST_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """Chunks of all documents: by sections where a document has some, else by policy ranges, else by zones. ``pages`` are those that a filter kept."""
    sizes = page_sizes(pages)
    zones, ranges, sections = stage(zones, "zones"), stage(ranges, "ranges"), stage(sections, "sections")
    sectioned, ranged = sections.select("doc_id").distinct(), ranges.select("doc_id").distinct()
    by_section = section_chunks(sections, subsections, zones, pages, sizes, most, target)
    others = ranges.join(sectioned, "doc_id", "left_anti")
    rest = zones.join(sectioned.union(ranged).distinct(), "doc_id", "left_anti")
    rows = policy_rows(others, zones, sizes, most, target).unionByName(zone_rows(rest, sizes, most, target))
    return by_section.unionByName(policy_chunks(rows, pages))


def validation(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, complete ones, coverage of definitions in per cent."""
    complete = F.col("has_definitions") & F.col("has_complete_context") & F.col("continuity_preserved")
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(complete).alias("complete"), (F.avg(F.col("has_definitions").cast("double")) * 100).alias("definition_coverage"))
