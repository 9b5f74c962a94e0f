"""Queries over the chunks of whole documents, with their SQL: sections, policies and zones, and how they are split."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import chunking as G
from docloom.operators import chunks as C
from docloom.operators import structure as D
from docloom.plans.document_queries import SECTIONS, ZONES
from docloom.plans.registration import Registry
from docloom.plans.text_queries import DEFINES

registry = Registry()
query = registry.query

MOST, TARGET = 600, 300
TABLES = ("doc_pages", "text_pages", "headings", "page_types")
COMPLETE = f"({DEFINES} OR NOT regexp_matches(lower(text), 'see section|refer to|as defined in|pursuant to'))"

# Flags of a page by rule: a policy starts on every fourth page, ends on every eighth or on a second one, is unknown on every seventh.
FLAGS = """SELECT doc_id, page_number, CASE WHEN page_number % 7 = 0 THEN 'unassigned' ELSE 'policy_' || CAST((page_number + 3) // 4 AS VARCHAR) END AS policy_id, page_number % 4 = 1 AS starts, page_number % 4 IN (2, 3) AS continues, page_number % 8 = 4 OR (page_number % 4 = 2 AND doc_id % 2 = 0) AS ends, left(text, 20) AS heading FROM {doc_pages}"""
# The fold over pages as a recursion: what is open, and what a page closes.
RANGES = f"""b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS i FROM ({FLAGS}) f WHERE policy_id <> 'unassigned'),
    rf AS (SELECT doc_id, 0 AS i, 0 AS range_no, FALSE AS is_open, '' AS policy_id, 0 AS start_page, 0 AS end_page, '' AS heading, FALSE AS multi FROM b GROUP BY doc_id
      UNION ALL SELECT rf.doc_id, b.i, rf.range_no + CASE WHEN b.starts THEN 1 ELSE 0 END, (b.starts OR rf.is_open) AND NOT b.ends, CASE WHEN b.starts THEN b.policy_id ELSE rf.policy_id END, CASE WHEN b.starts THEN b.page_number ELSE rf.start_page END,
        CASE WHEN b.starts OR (rf.is_open AND (b.continues OR b.ends)) THEN b.page_number ELSE rf.end_page END, CASE WHEN b.starts THEN b.heading ELSE rf.heading END, CASE WHEN b.starts THEN FALSE ELSE rf.multi OR (rf.is_open AND b.continues) END FROM rf JOIN b ON b.doc_id = rf.doc_id AND b.i = rf.i + 1),
    rg AS (SELECT doc_id, range_no, policy_id, start_page, end_page, heading, multi AS is_multi_page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, range_no ORDER BY i DESC) AS nth FROM rf WHERE range_no > 0) q WHERE nth = 1)"""


def flags(p):
    page = F.col("page_number")
    return p.select(
        "doc_id",
        "page_number",
        F.array(F.when(page % 7 == 0, "unassigned").otherwise(F.concat(F.lit("policy_"), F.floor((page + 3) / 4).cast("string")))).alias("policy_ids"),
        (page % 4 == 1).alias("starts"),
        (page % 4).isin(2, 3).alias("continues"),
        ((page % 8 == 4) | ((page % 4 == 2) & (F.col("doc_id") % 2 == 0))).alias("ends"),
        F.left("text", F.lit(20)).alias("heading"),
    )


@query(f"WITH RECURSIVE {RANGES} SELECT doc_id, CAST(range_no AS BIGINT) AS range_no, policy_id, start_page, end_page, heading, is_multi_page FROM rg", "doc_pages")
def c03_boundary_ranges(p):
    return G.boundary_ranges(flags(p))


ZONED = f"zo AS (SELECT doc_id, CAST(zone AS INT) AS zone_no, 'zone_' || CAST(zone AS INT) AS zone_id, zone_type, start_page, end_page FROM ({ZONES}) z)"


def zones(t):
    return D.content_zones(t).select("doc_id", F.col("zone").cast("int").alias("zone_no"), F.concat(F.lit("zone_"), F.col("zone").cast("string")).alias("zone_id"), "zone_type", "start_page", "end_page")


@query(f"WITH {ZONED} SELECT doc_id, zone_id, zone_type, start_page, end_page FROM zo", "page_types")
def c04_content_zone_scan(t):
    """Zones read back from the documents' metadata, one array a document."""
    nested = zones(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("zone_no", "zone_id", "zone_type", "start_page", "end_page"))).alias("content_zones"))
    return nested.select("doc_id", F.inline("content_zones")).drop("zone_no")


def pack(name: str, source: str, target: int) -> str:
    """Pages of source(doc_id, unit, part, page_number, n) in groups, as a recursion."""
    over = f"f.filled + s.n > {target}"
    return f"""{name}_s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, part ORDER BY page_number) AS i FROM ({source}) x),
    {name} AS (SELECT doc_id, unit, part, page_number, i, 0 AS grp, n AS filled FROM {name}_s WHERE i = 1 UNION ALL SELECT s.doc_id, s.unit, s.part, s.page_number, s.i, CASE WHEN {over} THEN f.grp + 1 ELSE f.grp END, CASE WHEN {over} THEN s.n ELSE f.filled + s.n END
      FROM {name} f JOIN {name}_s s ON s.doc_id = f.doc_id AND s.unit = f.unit AND s.part = f.part AND s.i = f.i + 1)"""


PAGES = """pg AS (SELECT p.doc_id, p.page_number, p.text, CASE WHEN p.page_number % 3 = 2 THEN 2 ELSE 0 END AS n_tables FROM {text_pages} p JOIN {page_types} t ON t.doc_id = p.doc_id AND t.page_number = p.page_number WHERE t.primary_type NOT IN ('administrative', 'index')),
    pb AS (SELECT doc_id, page_number, '--- Page ' || CAST(page_number AS VARCHAR) || ' ---' || chr(10) || chr(10) || text || CASE WHEN n_tables > 0 THEN repeat(chr(10), 3) || '[Table 1 on page ' || CAST(page_number AS VARCHAR) || ']' || repeat(chr(10), 3) || '[Table 2 on page ' || CAST(page_number AS VARCHAR) || ']' ELSE '' END AS block FROM pg)"""
NN = "chr(10) || chr(10)"
SUBS = f"""i AS (SELECT s.doc_id, s.section_no, s.end_page AS section_end, h.page_number, h.level, h.text FROM s0 s JOIN {{headings}} h ON s.doc_id = h.doc_id AND h.page_number BETWEEN s.start_page AND s.end_page WHERE h.level IN (2, 3)),
    su AS (SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY page_number) AS sub_no, text AS title, page_number AS start_page,
      coalesce((SELECT min(b.page_number) FROM i b WHERE b.doc_id = a.doc_id AND b.section_no = a.section_no AND b.level <= a.level AND b.page_number > a.page_number) - 1, section_end) AS end_page FROM i a WHERE section_no % 3 <> 0)"""


def sections_sql(most: int) -> str:
    head = "'=== ' || title || ' ===' || chr(10) || 'Section ID: ' || source_id || chr(10) || 'Pages: ' || CAST(start_page AS VARCHAR) || '-' || CAST(end_page AS VARCHAR)"
    return f"""s0 AS (SELECT doc_id, CAST(section_no AS INT) AS section_no, 'section_' || CAST(section_no AS INT) AS source_id, title, start_page, end_page FROM ({SECTIONS}) q WHERE doc_id % 3 <> 0), {SUBS},
    sl AS (SELECT doc_id, section_no, count(*) AS k, string_agg('  - ' || title || ' (pages ' || CAST(start_page AS VARCHAR) || '-' || CAST(end_page AS VARCHAR) || ')', chr(10) ORDER BY sub_no) AS lines FROM su GROUP BY 1, 2),
    sh AS (SELECT s.*, {head} || coalesce(chr(10) || 'Subsections: ' || CAST(k AS VARCHAR) || chr(10) || lines, '') AS head, k IS NOT NULL AS has_subs FROM s0 s LEFT JOIN sl ON sl.doc_id = s.doc_id AND sl.section_no = s.section_no),
    sr AS (SELECT sh.*, p.page_number, p.text AS page_text, '[Page ' || CAST(p.page_number AS VARCHAR) || ']' || chr(10) || p.text AS block FROM sh JOIN pg p ON p.doc_id = sh.doc_id AND p.page_number BETWEEN sh.start_page AND sh.end_page),
    sn AS (SELECT doc_id, section_no, length(min(head) || {NN} || string_agg(block, {NN} ORDER BY page_number) || chr(10)) // 4 > {most} AS large FROM sr GROUP BY 1, 2), sz AS (SELECT sr.*, large FROM sr JOIN sn ON sn.doc_id = sr.doc_id AND sn.section_no = sr.section_no),
    {pack("sp", "SELECT doc_id, section_no AS unit, 0 AS part, page_number, greatest(1, length(page_text) // 4) AS n FROM sz WHERE large AND NOT has_subs", TARGET)},
    sa AS (SELECT doc_id, section_no, 0 AS part, 'section' AS kind, source_id, title, start_page, end_page, head, page_number, block FROM sz WHERE NOT large
      UNION ALL SELECT doc_id, section_no, part, 'subsection', source_id, title, start_page, end_page, {head}, page_number, block FROM (SELECT z.doc_id, z.section_no, u.sub_no AS part, 'sub_' || CAST(z.section_no AS VARCHAR) || '_' || CAST(u.sub_no AS VARCHAR) AS source_id, u.title, u.start_page, u.end_page, z.page_number, z.block FROM sz z JOIN su u ON u.doc_id = z.doc_id AND u.section_no = z.section_no AND z.page_number BETWEEN u.start_page AND u.end_page WHERE z.large) q
      UNION ALL SELECT z.doc_id, z.section_no, sp.grp, 'page_range', source_id, title, min(z.page_number) OVER w, max(z.page_number) OVER w, NULL, z.page_number, block FROM sz z JOIN sp ON sp.doc_id = z.doc_id AND sp.unit = z.section_no AND sp.page_number = z.page_number WINDOW w AS (PARTITION BY z.doc_id, z.section_no, sp.grp)),
    sg AS (SELECT doc_id, section_no, part, min(kind) AS kind, min(source_id) AS source_id, min(title) AS title, min(start_page) AS start_page, min(end_page) AS end_page, min(head) AS head, string_agg(block, {NN} ORDER BY page_number) AS body, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, part) - 1 AS chunk_id FROM sa GROUP BY 1, 2, 3),
    sx AS (SELECT *, coalesce(head, '=== ' || title || ' (Part ' || CAST(chunk_id + 1 AS VARCHAR) || ') ===' || chr(10) || 'Pages: ' || CAST(start_page AS VARCHAR) || '-' || CAST(end_page AS VARCHAR)) || {NN} || body || chr(10) AS text,
      coalesce((SELECT string_agg(DISTINCT zone_type, ',' ORDER BY zone_type) FROM zo WHERE zo.doc_id = sg.doc_id AND zo.start_page <= sg.end_page AND zo.end_page >= sg.start_page), '') AS zone_ids FROM sg),
    section_chunks AS (SELECT doc_id, chunk_id, kind, source_id, title, start_page, end_page, zone_ids, greatest(1, length(text) // 4) AS token_count, contains(',' || zone_ids || ',', ',definitions,') AS has_definitions, kind <> 'page_range' AS has_complete_context, TRUE AS continuity_preserved, text FROM sx)"""


def units_sql(name: str, most: int) -> str:
    """Chunks of {name}_u(doc_id, unit, kind, source_id, title, start_page, end_page, zone_ids, is_multi_page, complete), split by zones if that is a policy, and by pages."""
    head = "CASE WHEN length(title) > 0 THEN '=== ' || title || ' ===' || chr(10) || chr(10) || chr(10) ELSE '' END"
    return f"""{name}_r AS (SELECT u.*, b.page_number, b.block, is_multi_page AND count(*) OVER (PARTITION BY u.doc_id, u.unit) < u.end_page - u.start_page + 1 AS broken FROM {name}_u u JOIN pb b ON b.doc_id = u.doc_id AND b.page_number BETWEEN u.start_page AND u.end_page),
    {name}_n AS (SELECT doc_id, unit, length(min({head}) || string_agg(block, {NN} ORDER BY page_number)) // 4 > {most} AS large FROM {name}_r GROUP BY 1, 2),
    {name}_z AS (SELECT r.doc_id, r.unit, CASE WHEN kind = 'policy' THEN zo.zone_no + 1 ELSE 0 END AS part, kind, source_id, title, CASE WHEN kind = 'policy' THEN zo.start_page ELSE r.start_page END AS start_page, CASE WHEN kind = 'policy' THEN zo.end_page ELSE r.end_page END AS end_page, zo.zone_id, page_number, block
      FROM {name}_r r JOIN {name}_n n ON n.doc_id = r.doc_id AND n.unit = r.unit JOIN zo ON zo.doc_id = r.doc_id AND r.page_number BETWEEN zo.start_page AND zo.end_page WHERE large),
    {name}_m AS (SELECT doc_id, unit, part, length(min({head}) || string_agg(block, {NN} ORDER BY page_number)) // 4 > {most} AS large FROM {name}_z GROUP BY 1, 2, 3),
    {name}_l AS (SELECT z.* FROM {name}_z z JOIN {name}_m m ON m.doc_id = z.doc_id AND m.unit = z.unit AND m.part = z.part WHERE large),
    {pack(name + "_p", f"SELECT doc_id, unit, part, page_number, greatest(1, length({head} || block) // 4) AS n FROM {name}_l", TARGET)},
    {name}_a AS (SELECT r.doc_id, r.unit, 0 AS part, 0 AS piece, kind, source_id, title, start_page, end_page, zone_ids, page_number, block, complete, NOT broken AS continuous FROM {name}_r r JOIN {name}_n n ON n.doc_id = r.doc_id AND n.unit = r.unit WHERE NOT large
      UNION ALL SELECT z.doc_id, z.unit, z.part, 0, 'zone_split', source_id, title, start_page, end_page, zone_id, page_number, block, FALSE, TRUE FROM {name}_z z JOIN {name}_m m ON m.doc_id = z.doc_id AND m.unit = z.unit AND m.part = z.part WHERE NOT large
      UNION ALL SELECT l.doc_id, l.unit, l.part, p.grp, 'page_split_forced', source_id, title, min(l.page_number) OVER w, max(l.page_number) OVER w, '', l.page_number, block, FALSE, FALSE FROM {name}_l l JOIN {name}_p p ON p.doc_id = l.doc_id AND p.unit = l.unit AND p.part = l.part AND p.page_number = l.page_number WINDOW w AS (PARTITION BY l.doc_id, l.unit, l.part, p.grp)),
    {name}_g AS (SELECT doc_id, unit, part, piece, min(kind) AS kind, min(source_id) AS source_id, min(title) AS title, min(start_page) AS start_page, min(end_page) AS end_page, min(zone_ids) AS zone_ids, bool_and(complete) AS complete, bool_and(continuous) AS continuity_preserved, min({head}) || string_agg(block, {NN} ORDER BY page_number) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY unit, part, piece) - 1 AS chunk_id FROM {name}_a GROUP BY 1, 2, 3, 4),
    {name}_chunks AS (SELECT doc_id, chunk_id, kind, source_id, title, start_page, end_page, zone_ids, greatest(1, length(text) // 4) AS token_count, {DEFINES} AS has_definitions, coalesce(complete, {COMPLETE}) AS has_complete_context, continuity_preserved, text FROM {name}_g)"""


def policy_units(where: str) -> str:
    return f"""pol_u AS (SELECT doc_id, range_no AS unit, 'policy' AS kind, policy_id AS source_id, heading AS title, start_page, end_page, is_multi_page, CAST(NULL AS BOOLEAN) AS complete, coalesce((SELECT string_agg(DISTINCT zone_id, ',' ORDER BY zone_id) FROM zo WHERE zo.doc_id = rg.doc_id AND zo.start_page <= rg.end_page AND zo.end_page >= rg.start_page), '') AS zone_ids FROM rg WHERE {where})"""


def zone_units(where: str) -> str:
    return f"zon_u AS (SELECT doc_id, zone_no AS unit, 'content_zone' AS kind, zone_id AS source_id, zone_type AS title, start_page, end_page, FALSE AS is_multi_page, TRUE AS complete, zone_id AS zone_ids FROM zo WHERE {where})"


COLUMNS = "doc_id, CAST(chunk_id AS INT) AS chunk_id, kind, source_id, title, start_page, end_page, zone_ids, token_count, has_definitions, has_complete_context, continuity_preserved, sha256(text) AS text_sha256"
BASE = f"WITH RECURSIVE {ZONED}, {PAGES}, {RANGES}"


def digest(chunks):
    return chunks.withColumns({"zone_ids": F.array_join("zone_ids", ","), "text_sha256": F.sha2("text", 256)}).drop("text")


def kept_pages(x, t):
    types = t.where(~F.col("primary_type").isin("administrative", "index")).select("doc_id", "page_number", "primary_type")
    return C.filter_pages(x, t.select("doc_id", "page_number", "primary_type")).join(types.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_semi").select("doc_id", "page_number", "text", F.when(F.col("page_number") % 3 == 2, 2).otherwise(0).alias("n_tables"))


def structure(p, h):
    major = D.major_sections(h, D.page_totals(p)).where("doc_id % 3 <> 0")
    name = F.concat(F.lit("section_"), F.col("section_no").cast("string"))
    order = Window.partitionBy("doc_id", "section_no").orderBy("page_number")
    subs = D.subsections(major, h).where("section_no % 3 <> 0").withColumn("sub_no", F.row_number().over(order))
    sub_name = F.concat_ws("_", F.lit("sub"), F.col("section_no").cast("string"), F.col("sub_no").cast("string"))
    return major.withColumn("section_id", name), subs.select("doc_id", "section_no", "sub_no", sub_name.alias("subsection_id"), "title", F.col("page_number").alias("start_page"), "end_page")


@query(f"{BASE}, {sections_sql(MOST)}, {policy_units('doc_id % 6 = 3')}, {units_sql('pol', MOST)}, {zone_units('doc_id % 6 = 0')}, {units_sql('zon', MOST)} SELECT {COLUMNS} FROM (SELECT * FROM section_chunks UNION ALL SELECT * FROM pol_chunks UNION ALL SELECT * FROM zon_chunks) k", *TABLES)
def c01_chunk_document(p, x, h, t):
    """Filtered pages of all documents as chunks: two thirds have sections, of the rest one half has policies, the other zones only."""
    sections, subs = structure(p, h)
    return digest(G.chunk_documents(kept_pages(x, t), sections, subs, G.boundary_ranges(flags(p)).where("doc_id % 6 = 3"), zones(t), MOST, TARGET))


@query(f"{BASE}, {sections_sql(0)} SELECT {COLUMNS} FROM section_chunks", *TABLES)
def c08_split_by_subsections(p, x, h, t):
    """All sections count as too large: a chunk a subsection, or by pages where there are none."""
    sections, subs = structure(p, h)
    pages = kept_pages(x, t)
    return digest(G.section_chunks(sections, subs, zones(t), pages, G.page_sizes(pages), 0, TARGET))


@query(f"{BASE}, {policy_units('TRUE')}, {units_sql('pol', MOST)} SELECT {COLUMNS} FROM pol_chunks", *TABLES)
def c11_c12b_policy_boundary_chunks(p, x, h, t):
    pages = kept_pages(x, t)
    return digest(G.policy_chunks(G.policy_rows(G.boundary_ranges(flags(p)), zones(t), G.page_sizes(pages), MOST, TARGET), pages))


@query(f"{BASE}, {policy_units('TRUE')}, {units_sql('pol', TARGET // 2)} SELECT {COLUMNS} FROM pol_chunks WHERE kind <> 'policy'", *TABLES)
def c13_split_large_policy(p, x, h, t):
    """Policies of over half the target, by zones and by pages."""
    pages = kept_pages(x, t)
    return digest(G.policy_chunks(G.policy_rows(G.boundary_ranges(flags(p)), zones(t), G.page_sizes(pages), TARGET // 2, TARGET), pages).where("kind <> 'policy'"))


@query(f"{BASE}, {zone_units('TRUE')}, {units_sql('zon', MOST)} SELECT {COLUMNS} FROM zon_chunks", *TABLES)
def c15_zone_chunks(p, x, h, t):
    pages = kept_pages(x, t)
    return digest(G.policy_chunks(G.zone_rows(zones(t), G.page_sizes(pages), MOST, TARGET), pages))


@query(f"{BASE}, {sections_sql(MOST)} SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE has_definitions AND has_complete_context AND continuity_preserved) AS complete, round(avg(CASE WHEN has_definitions THEN 100.0 ELSE 0 END), 6) AS definition_coverage FROM section_chunks GROUP BY doc_id", *TABLES)
def c18_context_summary(p, x, h, t):
    sections, subs = structure(p, h)
    pages = kept_pages(x, t)
    return G.validation(G.section_chunks(sections, subs, zones(t), pages, G.page_sizes(pages), MOST, TARGET)).withColumn("definition_coverage", F.round("definition_coverage", 6))
