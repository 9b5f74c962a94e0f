"""Queries over pages, headings, zones and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import is_policy_heading
from docloom.operators import chunks as C
from docloom.operators import classify as K
from docloom.operators import structure as D
from docloom.plans.registration import Registry
from docloom.plans.text_queries import DEFINES

registry = Registry()
query = registry.query

TOTALS = "SELECT doc_id, max(page_number) AS pages FROM {doc_pages} GROUP BY doc_id"
ZONES = """SELECT doc_id, zone, min(primary_type) AS zone_type, min(page_number) AS start_page, max(page_number) AS end_page, count(*) AS n_pages, avg(chunk_priority) AS avg_priority FROM
(SELECT *, sum(changed) OVER (PARTITION BY doc_id ORDER BY page_number) AS zone FROM (SELECT *, CASE WHEN lag(primary_type) OVER (PARTITION BY doc_id ORDER BY page_number) = primary_type THEN 0 ELSE 1 END AS changed FROM {page_types}) a) b GROUP BY doc_id, zone"""
SECTIONS = f"""SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY page_number, ord) AS section_no, text AS title, page_number AS start_page, coalesce(greatest(page_number, lead(page_number) OVER (PARTITION BY h.doc_id ORDER BY page_number, ord) - 1), t.pages) AS end_page
FROM {{headings}} h JOIN ({TOTALS}) t ON h.doc_id = t.doc_id WHERE level = 1"""
STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    rf"""WITH s AS (SELECT doc_id, page_number, {STRIPPED} AS t FROM {{text_pages}})
    SELECT doc_id, page_number, (lower(left(t, 1)) = left(t, 1) AND upper(replace(left(t, 1), 'ß', 'X')) <> left(t, 1)) OR starts_with(t, 'and') OR starts_with(t, 'or') OR starts_with(t, 'but') OR starts_with(t, 'which') OR starts_with(t, 'that') AS starts_mid_sentence,
    right(t, 1) NOT IN ('.', '!', '?') AS ends_mid_sentence, regexp_matches(t, '^([a-z]\)|\d+\.|-|•)') AS list_continuation FROM s WHERE length(t) > 0""",
    "text_pages",
)
def d06_continuity_markers(t):
    return D.continuity_markers(t)


@query(f"SELECT doc_id, CAST(zone AS BIGINT) AS zone, zone_type, start_page, end_page, n_pages, round(avg_priority, 6) AS avg_priority FROM ({ZONES}) z", "page_types")
def d05_content_zones(t):
    return D.content_zones(t).withColumn("avg_priority", F.round("avg_priority", 6))


@query(
    f"""SELECT h.doc_id, CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY page_number, ord) AS INT) AS section_no, text AS title, page_number AS start_page, coalesce(lead(page_number) OVER (PARTITION BY h.doc_id ORDER BY page_number, ord) - 1, t.pages) AS end_page
    FROM {{headings}} h JOIN ({TOTALS}) t ON h.doc_id = t.doc_id WHERE level <= 2""",
    "headings",
    "doc_pages",
)
def d24_section_boundaries(h, p):
    return D.section_boundaries(h, D.page_totals(p))


@query(f"SELECT doc_id, CAST(section_no AS INT) AS section_no, title, start_page, end_page FROM ({SECTIONS}) s", "headings", "doc_pages")
def d15_major_sections(h, p):
    return D.major_sections(h, D.page_totals(p))


@query(
    f"""WITH s AS ({SECTIONS}), i AS (SELECT s.doc_id, s.section_no, s.end_page AS section_end, h.page_number, h.level, h.ord, h.text FROM s JOIN {{headings}} h ON s.doc_id = h.doc_id AND h.page_number BETWEEN s.start_page AND s.end_page WHERE h.level IN (2, 3))
    SELECT doc_id, CAST(section_no AS INT) AS section_no, page_number, level, text AS title, coalesce((SELECT min(b.page_number) FROM i b WHERE b.doc_id = a.doc_id AND b.section_no = a.section_no AND b.level <= a.level AND b.page_number > a.page_number) - 1, section_end) AS end_page FROM i a""",
    "headings",
    "doc_pages",
)
def d16_subsections(h, p):
    return D.subsections(D.major_sections(h, D.page_totals(p)), h)


IS_POLICY = r"""(regexp_matches(trim(text), '^\d+\.\s+[A-Z]|^[A-Z\s]{3,}$|^\d+\.\d+\s+[A-Z]|^POLICY\s*:|^COVERAGE\s*:') OR contains(lower(text), 'policy') OR contains(lower(text), 'coverage') OR contains(lower(text), 'benefit') OR contains(lower(text), 'procedure') OR contains(lower(text), 'treatment') OR contains(lower(text), 'service') OR starts_with(text, 'I.'))"""
BOUNDARIES = f"""WITH m AS (SELECT *, lead(page_number) OVER (PARTITION BY doc_id ORDER BY page_number, ord) - 1 AS next_end, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, ord) AS nth FROM {{headings}} WHERE level <= 2),
    s AS (SELECT m.doc_id, nth, page_number AS start_page, coalesce(next_end, pages) AS end_page FROM m JOIN ({TOTALS}) t ON m.doc_id = t.doc_id WHERE {IS_POLICY}),
    c AS (SELECT p.doc_id, p.page_number, 'policy_' || CAST(s.nth AS VARCHAR(9)) AS policy_id, p.page_number = s.start_page AS starts, p.page_number = s.end_page AS ends FROM {{doc_pages}} p JOIN s ON p.doc_id = s.doc_id AND p.page_number BETWEEN s.start_page AND s.end_page)
    SELECT * FROM c UNION ALL SELECT doc_id, page_number, 'unassigned', FALSE, FALSE FROM {{doc_pages}} p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND c.page_number = p.page_number)"""


def boundaries(h, p):
    return D.policy_boundaries(h, p, is_policy_heading(F.col("text")) | F.startswith("text", F.lit("I.")))


@query(BOUNDARIES, "headings", "doc_pages")
def d03_p21_policy_boundaries(h, p):
    return boundaries(h, p)


@query(f"SELECT doc_id, page_number, max(policy_id) AS policy_id FROM ({BOUNDARIES}) b GROUP BY doc_id, page_number", "headings", "doc_pages")
def d04_attach_boundaries(h, p):
    return D.last_boundary(boundaries(h, p))


@query(
    f"""SELECT doc_id, policy_id, min(page_number) AS start_page, max(page_number) AS end_page, count(*) AS n_pages, count(*) FILTER (WHERE NOT starts AND NOT ends) AS n_interior FROM ({BOUNDARIES}) b WHERE policy_id <> 'unassigned' GROUP BY doc_id, policy_id""",
    "headings",
    "doc_pages",
)
def d07_policy_flow_map(h, p):
    return D.policy_flow(boundaries(h, p))


LINKED = "SELECT doc_id, page_number, text || CASE page_number % 5 WHEN 0 THEN ' See section 4.2 and see section 7' WHEN 1 THEN ' refer to page 12' WHEN 2 THEN ' (see page 9) and refer  to page 3' WHEN 3 THEN ' see page 99999999999' ELSE '' END AS text FROM {text_pages}"


def linked(t):
    n = F.col("page_number") % 5
    more = F.when(n == 0, " See section 4.2 and see section 7").when(n == 1, " refer to page 12").when(n == 2, " (see page 9) and refer  to page 3").when(n == 3, " see page 99999999999").otherwise("")
    return t.select("doc_id", "page_number", F.concat("text", more).alias("text"))


REFERRED = f"""r AS ({LINKED}), m AS (SELECT doc_id, page_number, 0 AS pattern, unnest(regexp_extract_all(text, '(?i)\\bsee\\s+page\\s+(\\d+)\\b', 1)) AS target FROM r UNION ALL SELECT doc_id, page_number, 1, unnest(regexp_extract_all(text, '(?i)\\bsee\\s+section\\s+(\\d+\\.?\\d*)\\b', 1)) FROM r
    UNION ALL SELECT doc_id, page_number, 2, unnest(regexp_extract_all(text, '(?i)\\brefer\\s+to\\s+page\\s+(\\d+)\\b', 1)) FROM r UNION ALL SELECT doc_id, page_number, 3, unnest(regexp_extract_all(text, '(?i)\\b\\(see\\s+page\\s+(\\d+)\\)', 1)) FROM r)"""


@query(f"WITH {REFERRED} SELECT *, TRY_CAST(CASE WHEN regexp_matches(target, '^[0-9]+$') THEN target END AS INT) AS target_page FROM m", "text_pages")
def d08_detect_references(t):
    return D.references(linked(t))


STATISTICS = f"""SELECT a.*, zones, definitions_from, CAST(policy_pages AS DOUBLE) / pages AS extractability, least(1.0, zones / (CAST(pages AS DOUBLE) / 10)) AS structure_confidence FROM
    (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE primary_type = 'policy_content') AS policy_pages, count(*) FILTER (WHERE primary_type = 'administrative') AS admin_pages, avg(chunk_priority) AS priority FROM {{page_types}} GROUP BY doc_id) a
    JOIN (SELECT doc_id, count(*) AS zones, min(CASE WHEN zone_type = 'definitions' THEN start_page END) AS definitions_from FROM ({ZONES}) z GROUP BY doc_id) b ON a.doc_id = b.doc_id"""


@query(f"SELECT doc_id, pages, policy_pages, admin_pages, round(priority, 6) AS priority, zones, definitions_from, round(extractability, 6) AS extractability, round(structure_confidence, 6) AS structure_confidence FROM ({STATISTICS}) s", "page_types")
def d09_document_statistics(t):
    return D.document_statistics(t, D.content_zones(t)).withColumns({c: F.round(c, 6) for c in ("priority", "extractability", "structure_confidence")})


@query(
    f"""SELECT doc_id, round(c, 6) AS complexity, c > 0.7 AS expensive_tier FROM (SELECT doc_id, (least(1.0, CAST(pages AS DOUBLE) / 100) + least(1.0, CAST(zones AS DOUBLE) / 10) + CAST(admin_pages AS DOUBLE) / pages + least(1.0, CAST(pages % 4 AS DOUBLE) / 3) + CASE WHEN definitions_from IS NOT NULL THEN 0.7 ELSE 0.3 END) / 5 AS c FROM ({STATISTICS}) s) q""",
    "page_types",
)
def d12_d27_document_complexity(t):
    s = D.document_statistics(t, D.content_zones(t))
    s = s.withColumns({"mixed_ratio": F.col("admin_pages") / F.col("pages"), "tables_a_page": F.col("pages") % 4, "has_complex_sections": F.col("definitions_from").isNotNull()})
    return D.document_complexity(s).withColumn("complexity", F.round("complexity", 6))


def scored_types() -> str:
    """The classifier's scores in SQL: text t, headings h, place r, importance i."""
    out = []
    for rank, (name, words) in enumerate(K.KEYWORDS.items()):
        hits = " + ".join(f"CASE WHEN contains(lower(t), '{w}') THEN 1.0 ELSE 0 END" for w in words) or "0"
        named = " OR ".join(f"contains(lower(h), '{w}')" for w in words) or "FALSE"
        extra = f"CASE WHEN r < 0.1 THEN {K.FRONT.get(name, 0.0)} WHEN r > 0.9 THEN {K.BACK.get(name, 0.0)} ELSE 0 END + CASE WHEN {named} THEN 0.4 ELSE 0 END"
        extra += " + CASE WHEN i > 0.7 THEN 0.3 ELSE 0 END" if name == "policy_content" else ""
        out.append(f"SELECT doc_id, page_number, {rank} AS rank, '{name}' AS name, ({hits}) / {max(len(words), 1)} + {extra} AS score FROM g")
    return " UNION ALL ".join(out)


CLASSIFIED = f"""g AS (SELECT p.doc_id, p.page_number, p.text AS t, coalesce(h.text, '') AS h, CAST(p.page_number AS DOUBLE) / q.pages AS r, CAST(p.page_number % 10 AS DOUBLE) / 10 AS i FROM {{text_pages}} p JOIN ({TOTALS}) q ON q.doc_id = p.doc_id LEFT JOIN {{headings}} h ON h.doc_id = p.doc_id AND h.page_number = p.page_number),
    s AS ({scored_types()}), w AS (SELECT doc_id, page_number, rank, name, round(CASE WHEN name = 'policy_content' AND max(score) OVER (PARTITION BY doc_id, page_number) < 0.3 THEN 0.5 ELSE score END, 9) AS score FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY score DESC, rank) AS nth FROM w), c AS (SELECT doc_id, page_number, max(CASE WHEN nth = 1 THEN name END) AS primary_type, coalesce(string_agg(CASE WHEN nth BETWEEN 2 AND 4 AND score > 0.2 THEN name END, ',' ORDER BY nth), '') AS secondary_types FROM n GROUP BY doc_id, page_number)"""


def classified(t, h):
    heads = h.groupBy("doc_id", "page_number").agg(F.collect_list("text").alias("headings"))
    rows = t.join(D.page_totals(t), "doc_id").join(heads, ["doc_id", "page_number"], "left").withColumns({"headings": F.coalesce("headings", F.array().cast("array<string>")), "importance": (F.col("page_number") % 10) / 10})
    return K.classify_pages(rows)


@query(
    rf"""WITH {CLASSIFIED} SELECT c.doc_id, c.page_number, primary_type, secondary_types, regexp_matches(t, '(?m)^\s*\d+\.') AS has_numbered, regexp_matches(t, '(?m)^\s*[•*-]') AS has_bullets, regexp_matches(t, '(?i)\bsee\s+(page|section|chapter)\b') AS has_references,
    round(least(1.0, CASE WHEN primary_type = 'policy_content' THEN 0.9 WHEN primary_type IN ('definitions', 'coverage') THEN 0.8 WHEN primary_type IN ('exclusions', 'eligibility') THEN 0.7 ELSE 0.5 END * i), 6) AS priority FROM c JOIN g ON g.doc_id = c.doc_id AND g.page_number = c.page_number""",
    "text_pages",
    "headings",
)
def d01_d02_classify_page(t, h):
    return classified(t, h).select("doc_id", "page_number", "primary_type", F.array_join("secondary_types", ",").alias("secondary_types"), "has_numbered", "has_bullets", "has_references", F.round("priority", 6).alias("priority"))


@query(
    f"""WITH {CLASSIFIED} SELECT c.doc_id, CASE WHEN bool_or(primary_type IN ('coverage', 'eligibility', 'exclusions')) OR bool_or(contains(lower(t), 'insurance') OR contains(lower(t), 'coverage') OR contains(lower(t), 'policy') OR contains(lower(t), 'benefit')) THEN 'insurance'
    WHEN bool_or(contains(lower(t), 'regulation') OR contains(lower(t), 'compliance') OR contains(lower(t), 'regulatory')) THEN 'regulatory' WHEN bool_or(contains(lower(t), 'contract') OR contains(lower(t), 'agreement') OR contains(lower(t), 'legal')) THEN 'legal' ELSE 'unknown' END AS document_type FROM c JOIN g ON g.doc_id = c.doc_id AND g.page_number = c.page_number WHERE c.page_number <= 3 GROUP BY c.doc_id""",
    "text_pages",
    "headings",
)
def d11_document_type(t, h):
    return K.document_types(classified(t, h).select("doc_id", "page_number", "primary_type").join(t, ["doc_id", "page_number"]))


@query(
    """SELECT doc_id, count(*) AS pages, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, count(*) FILTER (WHERE length(trim(text)) < 50) AS scanned, round(avg(CASE WHEN length(text) > 100 THEN 1.0 ELSE 0.0 END), 6) AS content_ratio,
    string_agg(CAST(length(text) // 4 AS VARCHAR(9)), ',' ORDER BY page_number) AS page_tokens FROM {doc_pages} GROUP BY doc_id""",
    "doc_pages",
)
def d25_document_aggregates(p):
    return D.document_aggregates(p).withColumns({"content_ratio": F.round("content_ratio", 6), "page_tokens": F.array_join(F.transform("page_tokens", lambda x: x.cast("string")), ",")})


@query(
    """SELECT doc_id, line_no, left(line, 8) AS title, CAST(line_no AS INT) AS page_number, CAST(CASE WHEN line_no % 5 = 4 THEN 3 WHEN line_no % 5 >= 2 THEN 2 ELSE 1 END AS INT) AS level FROM {doc_lines} WHERE line_no % 3 = 0 AND regexp_matches(left(line, 8), '^[A-Za-z]{8}$')""",
    "doc_lines",
)
def d23_toc_parse(t):
    made = F.concat(F.repeat(F.lit(" "), (F.col("line_no") % 5).cast("int")), F.left("line", F.lit(8)), F.when(F.col("line_no") % 2 == 0, " .... ").otherwise("\t"), F.col("line_no").cast("string"))
    rows = t.where((F.col("line_no") % 3 == 0) & F.left("line", F.lit(8)).rlike("^[A-Za-z]{8}$"))
    return D.toc_entries(rows.select("doc_id", "line_no", made.alias("line")))


@query(
    rf"""WITH s AS ({SECTIONS}) SELECT doc_id, page_number FROM {{doc_pages}} p WHERE len(regexp_extract_all(text, '\S+')) < 50 AND (page_number = 1 OR NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND p.page_number BETWEEN s.start_page AND s.end_page))""",
    "doc_pages",
    "headings",
)
def d17_administrative_pages(p, h):
    return D.administrative_pages(p, D.major_sections(h, D.page_totals(p)))


@query(
    """SELECT p.doc_id, p.page_number, t.primary_type FROM {doc_pages} p LEFT JOIN {page_types} t ON p.doc_id = t.doc_id AND p.page_number = t.page_number WHERE t.primary_type NOT IN ('table_of_contents', 'index', 'bibliography', 'references', 'administrative') OR t.primary_type IS NULL""",
    "doc_pages",
    "page_types",
)
def c02_filter_pages(p, t):
    return C.filter_pages(p.select("doc_id", "page_number"), t.select("doc_id", "page_number", "primary_type"))


TARGET = 400
# The fold as a recursion over pages.
PACKED = f"""WITH RECURSIVE s AS (SELECT doc_id, page_number, greatest(1, length(text) // 4) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS i FROM {{doc_pages}}),
    f AS (SELECT doc_id, page_number, n, i, 0 AS grp, n AS filled FROM s WHERE i = 1 UNION ALL
      SELECT s.doc_id, s.page_number, s.n, s.i, CASE WHEN f.filled + s.n > {TARGET} THEN f.grp + 1 ELSE f.grp END, CASE WHEN f.filled + s.n > {TARGET} THEN s.n ELSE f.filled + s.n END FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)"""


def packed(p):
    return C.packed_pages(p, F.greatest(F.lit(1), F.floor(F.length("text") / 4)), TARGET)


@query(f"{PACKED} SELECT doc_id, page_number, n, CAST(grp AS INT) AS grp FROM f", "doc_pages")
def c09_c14_page_pack(p):
    return packed(p)


CHUNKS = f"""{PACKED}, c AS (SELECT f.doc_id, f.grp, min(f.page_number) AS start_page, max(f.page_number) AS end_page, count(*) AS n_pages, string_agg('[Page ' || CAST(f.page_number AS VARCHAR(9)) || ']' || chr(10) || p.text, chr(10) || chr(10) ORDER BY f.page_number) AS text
    FROM f JOIN {{text_pages}} p ON f.doc_id = p.doc_id AND f.page_number = p.page_number GROUP BY f.doc_id, f.grp), k AS (SELECT *, greatest(1, length(text) // 4) AS token_count, {DEFINES} AS has_definitions, {DEFINES} OR NOT regexp_matches(lower(text), 'see section|refer to|as defined in|pursuant to') AS has_complete_context FROM c)"""


def chunk_rows(p, t):
    return C.joined_text(packed(p).select("doc_id", "page_number", "grp").join(t, ["doc_id", "page_number"]), ["doc_id", "grp"])


def chunk_facts(p, t):
    return C.chunk_facts(packed(p).select("doc_id", "page_number", "grp").join(t, ["doc_id", "page_number"]), ["doc_id", "grp"])


@query(f"{CHUNKS} SELECT doc_id, CAST(grp AS INT) AS grp, start_page, end_page, n_pages, sha256(text) AS text_sha256, token_count, has_definitions, has_complete_context FROM k", "doc_pages", "text_pages")
def c06_c10_c12_chunk_rows(p, t):
    return chunk_rows(p, t).select("doc_id", "grp", "start_page", "end_page", "n_pages", F.sha2("text", 256).alias("text_sha256"), "token_count", "has_definitions", "has_complete_context")


@query(
    f"{CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(token_count), 6) AS avg_tokens, max(token_count) AS max_tokens, min(token_count) AS min_tokens, count(*) FILTER (WHERE has_complete_context) AS complete FROM k GROUP BY doc_id",
    "doc_pages",
    "text_pages",
)
def c20_chunk_statistics(p, t):
    return C.chunk_statistics(chunk_facts(p, t)).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(
    f"{CHUNKS} SELECT doc_id, CAST(grp AS INT) AS grp, 'missing_definitions' AS issue FROM k WHERE NOT has_definitions AND contains(lower(text), 'coverage') UNION ALL SELECT doc_id, grp, 'incomplete_context' FROM k WHERE NOT has_complete_context UNION ALL SELECT doc_id, grp, 'continuity_broken' FROM k WHERE end_page - start_page + 1 > n_pages",
    "doc_pages",
    "text_pages",
)
def c17_c18_context_validation(p, t):
    return C.chunk_issues(chunk_facts(p, t))


@query(
    f"""WITH s AS ({SECTIONS}) SELECT s.doc_id, CAST(s.section_no AS INT) AS section_no, count(*) AS n_pages, CAST(sum(length(p.text)) AS BIGINT) AS chars FROM s JOIN {{doc_pages}} p ON p.doc_id = s.doc_id AND p.page_number BETWEEN s.start_page AND s.end_page GROUP BY s.doc_id, s.section_no""",
    "headings",
    "doc_pages",
)
def c05_section_chunks(h, p):
    inside = D.pages_of(D.major_sections(h, D.page_totals(p)), ["section_no"]).join(p, ["doc_id", "page_number"])
    return inside.groupBy("doc_id", "section_no").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("text")).alias("chars"))


@query(
    f"""WITH s AS ({SECTIONS}), z AS ({ZONES}) SELECT DISTINCT s.doc_id, CAST(s.section_no AS INT) AS section_no, CAST(z.zone AS BIGINT) AS zone FROM s JOIN z ON s.doc_id = z.doc_id AND NOT (s.end_page < z.start_page OR s.start_page > z.end_page)""",
    "headings",
    "doc_pages",
    "page_types",
)
def c07_c16_zone_overlap(h, p, t):
    return C.overlapping(D.major_sections(h, D.page_totals(p)), D.content_zones(t), "section_no")


@query(
    f"""WITH t AS ({TOTALS}), s AS (SELECT doc_id, pages, unnest(generate_series(1, greatest(pages - 1, 1), 3)) AS start_page FROM t) SELECT doc_id, CAST((start_page - 1) // 3 AS INT) AS chunk_id, start_page, least(start_page + 3, pages) AS end_page FROM s""",
    "doc_pages",
)
def c21_page_window_chunks(p):
    return C.page_windows(D.page_totals(p), 4, 1)


# Windows as a recursion: the next start depends on where the last one was cut.
CUT = """coalesce((SELECT max(i) FROM (SELECT unnest(range(greatest(s, e - 200), e)) AS i) x WHERE contains('.!?' || chr(10), substr(text, i + 1, 1)) AND (i + 1 >= n OR regexp_matches(substr(text, i + 2, 1), '[\\s\\x0B\\p{Z}\\p{Lu}]'))) + 1, e)"""
WINDOWS = f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM {{documents}} WHERE length(text) > 0),
    b AS (SELECT doc_id, 0 AS chunk_id, 0 AS s, CASE WHEN n <= 1000 THEN n ELSE (SELECT {CUT} FROM (SELECT 0 AS s, 1000 AS e) y) END AS f FROM d
      UNION ALL SELECT b.doc_id, b.chunk_id + 1, greatest(b.s + 1, b.f - 100), CASE WHEN greatest(b.s + 1, b.f - 100) + 1000 >= n THEN n ELSE (SELECT {CUT} FROM (SELECT greatest(b.s + 1, b.f - 100) AS s, greatest(b.s + 1, b.f - 100) + 1000 AS e) y) END FROM b JOIN d ON d.doc_id = b.doc_id WHERE b.f < n)"""


@query(f"{WINDOWS} SELECT doc_id, CAST(chunk_id AS BIGINT) AS chunk_id, s AS start, f AS end FROM b", "documents")
def c22_c24_char_window_chunks(t):
    return C.char_windows(t)


@query(
    "SELECT doc_id, CASE WHEN pages <= 8 AND chars <= 25000 THEN 'semantic' ELSE 'page' END AS method, chars < 25000 AND pages < 8 AS whole FROM (SELECT doc_id, count(*) AS pages, sum(length(text)) AS chars FROM {doc_pages} GROUP BY doc_id) q",
    "doc_pages",
)
def c25_c29_choose_chunking(p):
    sizes = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"))
    return sizes.select("doc_id", F.when((F.col("pages") <= 8) & (F.col("chars") <= 25000), "semantic").otherwise("page").alias("method"), ((F.col("chars") < 25000) & (F.col("pages") < 8)).alias("whole"))


@query("SELECT doc_id, CAST((page_number - 1) // 3 AS BIGINT) AS batch, string_agg(CAST(page_number AS VARCHAR(9)), ',' ORDER BY page_number) AS pages FROM {doc_pages} GROUP BY 1, 2", "doc_pages")
def c27_batch_pages(p):
    listed = p.groupBy("doc_id", F.floor((F.col("page_number") - 1) / 3).alias("batch")).agg(F.array_sort(F.collect_list("page_number")).alias("pages"))
    return listed.withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


HEADED = r"""SELECT doc_id, (line_no - 1) // 5 + 1 AS page_number, line_no AS ord, CASE line_no % 15 WHEN 0 THEN 'II. ' || x WHEN 1 THEN '3. MEDICAL THINGS' WHEN 2 THEN 'SCOPE OF THE DOCUMENT' WHEN 3 THEN 'A. ' || x WHEN 4 THEN '1.2 ' || x WHEN 5 THEN 'a. ' || x WHEN 6 THEN '1.2.3 ' || x WHEN 7 THEN 'Billing ' || x WHEN 8 THEN 'National society ' || x WHEN 9 THEN 'Exclusions ' || x
    WHEN 10 THEN 'Selection of ' || x WHEN 11 THEN 'NOTE 7' WHEN 12 THEN 'Some title words ' || x WHEN 13 THEN 'THE 12 RULES OF ALL 7' ELSE lower(x) END AS text FROM (SELECT doc_id, line_no, 'q' || left(regexp_replace(line, '[^a-zA-Z ]', '', 'g'), 12) || 'q' AS x FROM {doc_lines}) l"""
LEVELS = {1: [("^([IVX]+)\\.\\s+(.+)$", 2), ("^(\\d+)\\.\\s+([A-Z][A-Z\\s]{2,})$", 2), ("^([A-Z][A-Z\\s]{10,})$", 1)], 2: [("^([A-Z])\\.\\s+(.+)$", 2), ("^(\\d+\\.\\d+)\\s+(.+)$", 2)], 3: [("^([a-z])\\.\\s+(.+)$", 2), ("^(\\d+\\.\\d+\\.\\d+)\\s+(.+)$", 2)]}


def named(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def by_level(level: int, then) -> str:
    return " ".join(f"WHEN regexp_matches(text, '{p}') THEN {then(level, p, title)}" for p, title in LEVELS[level])


def deciding(then, words) -> str:
    """The chain of decisions, with what each gives."""
    return f"""CASE WHEN {named(D.MAJOR_HEADINGS)} THEN {words(1, 'semantic_major_policy')} {by_level(1, then)} WHEN {named(D.SUBSECTION_HEADINGS)} THEN {words(2, 'semantic_subsection')} {by_level(2, then)} {by_level(3, then)}
      WHEN upper(text) = text AND lower(text) <> text AND length(text) > 15 THEN {words(1, 'heuristic_long_caps')} WHEN upper(text) = text AND lower(text) <> text AND len(string_split(text, ' ')) <= 3 THEN {words(0, 'heuristic_short_caps')} WHEN regexp_matches(text, '^\\p{{Lu}}') AND len(list_filter(string_split(text, ' '), lambda w: w <> '')) > 2 THEN {words(2, 'heuristic_title')} ELSE {words(2, 'default')} END"""


@query(
    f"""WITH h AS (SELECT doc_id, page_number, ord, trim(text) AS text FROM ({HEADED}) q), k AS (SELECT *, {deciding(lambda n, p, t: str(n), lambda n, m: str(n))} AS level, {deciding(lambda n, p, t: f"regexp_extract(text, '{p}', 1)", lambda n, m: "NULL")} AS numbering, {deciding(lambda n, p, t: f"regexp_extract(text, '{p}', {t})", lambda n, m: "text")} AS title,
      {deciding(lambda n, p, t: f"'level_{n}_pattern'", lambda n, m: f"'{m}'")} AS pattern_match FROM h WHERE NOT {named(D.ADMIN_HEADINGS)} AND NOT {named(D.REFERENCE_HEADINGS)}) SELECT * FROM k WHERE level > 0""",
    "doc_lines",
)
def d14_heading_hierarchy(t):
    """Headings of every kind, made of lines by their number."""
    k = F.col("line_no") % 15
    x = F.concat(F.lit("q"), F.left(F.regexp_replace("line", "[^a-zA-Z ]", ""), F.lit(12)), F.lit("q"))
    heads = {0: "II. ", 3: "A. ", 4: "1.2 ", 5: "a. ", 6: "1.2.3 ", 7: "Billing ", 8: "National society ", 9: "Exclusions ", 10: "Selection of ", 12: "Some title words "}
    whole = {1: "3. MEDICAL THINGS", 2: "SCOPE OF THE DOCUMENT", 11: "NOTE 7", 13: "THE 12 RULES OF ALL 7"}
    text = F.lower(x)
    for n, head in heads.items():
        text = F.when(k == n, F.concat(F.lit(head), x)).otherwise(text)
    for n, line in whole.items():
        text = F.when(k == n, line).otherwise(text)
    return D.heading_hierarchy(t.select("doc_id", (F.floor((F.col("line_no") - 1) / 5) + 1).alias("page_number"), F.col("line_no").alias("ord"), text.alias("text")))


FLOW = f"SELECT doc_id, policy_id, min(page_number) AS start_page, max(page_number) AS end_page FROM ({BOUNDARIES}) b WHERE policy_id <> 'unassigned' GROUP BY doc_id, policy_id"
GUIDANCE = f"""fl AS ({FLOW}), gr AS (SELECT doc_id, string_agg(CAST(start_page AS VARCHAR) || '-' || CAST(end_page AS VARCHAR), ',' ORDER BY start_page, end_page) AS ranges FROM fl GROUP BY 1),
    gd AS (SELECT t.doc_id, coalesce(min(ranges), '') AS chunk_boundaries, coalesce(string_agg(CASE WHEN primary_type IN ('table_of_contents', 'index', 'administrative', 'bibliography') THEN CAST(page_number AS VARCHAR) END, ',' ORDER BY page_number), '') AS pages_to_filter,
      coalesce(string_agg(CASE WHEN page_number % 5 = 0 OR page_number % 7 = 0 OR (page_number + t.doc_id) % 11 = 0 THEN CAST(page_number AS VARCHAR) END, ',' ORDER BY page_number), '') AS special_handling FROM {{page_types}} t LEFT JOIN gr ON gr.doc_id = t.doc_id GROUP BY t.doc_id)"""


def guidance(h, p, t):
    n = F.col("page_number")
    pages = t.select("doc_id", "page_number", "primary_type", (n % 5 == 0).alias("requires_special_handling"), (n % 7 == 0).alias("is_table_heavy"), ((n + F.col("doc_id")) % 11 == 0).alias("has_list_continuation"))
    found = D.chunking_guidance(D.policy_flow(boundaries(h, p)), pages)
    listed = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("pages_to_filter", "special_handling")}
    return found.withColumns({"chunk_boundaries": F.array_join(F.transform("chunk_boundaries", lambda x: F.concat_ws("-", x["start_page"].cast("string"), x["end_page"].cast("string"))), ","), **listed})


@query(f"WITH {GUIDANCE} SELECT * FROM gd", "headings", "doc_pages", "page_types")
def d10_chunking_guidance(h, p, t):
    return guidance(h, p, t)


TOC = "SELECT doc_id, line_no, left(line, 8) AS title FROM {doc_lines} WHERE line_no % 3 = 0 AND doc_id % 2 = 0 AND regexp_matches(left(line, 8), '^[A-Za-z]{8}$')"
STRUCTURE = f"""st AS (SELECT t.doc_id, t.pages, coalesce(h.n, 0) AS headings, coalesce(h.texts, '') AS heading_texts, coalesce(c.n, 0) AS toc_entries, coalesce(c.titles, '') AS toc_titles, coalesce(h.major, 0) AS section_boundaries FROM ({TOTALS}) t
    LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(text, '|' ORDER BY page_number, ord) AS texts, count(*) FILTER (WHERE level <= 2) AS major FROM {{headings}} WHERE doc_id % 5 <> 0 GROUP BY 1) h ON h.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(title, '|' ORDER BY line_no) AS titles FROM ({TOC}) q GROUP BY 1) c ON c.doc_id = t.doc_id)"""


def built(h, p, lines):
    """A document in five has no headings, every second one contents."""
    made = F.concat(F.left("line", F.lit(8)), F.lit("\t"), F.col("line_no").cast("string"))
    rows = lines.where((F.col("line_no") % 3 == 0) & (F.col("doc_id") % 2 == 0) & F.left("line", F.lit(8)).rlike("^[A-Za-z]{8}$"))
    return D.document_structure(h.where("doc_id % 5 <> 0"), D.toc_entries(rows.select("doc_id", "line_no", made.alias("line"))), D.page_totals(p))


@query(f"WITH {STRUCTURE} SELECT * FROM st", "headings", "doc_pages", "doc_lines")
def d26_document_structure(h, p, lines):
    def n(c):
        return F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).alias(c)

    def texts(c, field):
        return F.coalesce(F.array_join(F.transform(c, lambda x: x[field]), "|"), F.lit(""))

    return built(h, p, lines).select("doc_id", "pages", n("headings"), texts("headings", "text").alias("heading_texts"), n("toc_entries"), texts("toc_entries", "title").alias("toc_titles"), n("section_boundaries"))


KINDS = "CASE WHEN toc_entries > 0 AND headings > 0 AND zones > 5 THEN 'highly_structured' WHEN headings > 0 AND section_boundaries > 0 THEN 'moderately_structured' WHEN headings > 0 OR zones > 2 THEN 'basic_structure' ELSE 'unstructured' END"


@query(f"WITH {STRUCTURE}, z AS (SELECT doc_id, count(*) AS zones FROM ({ZONES}) q GROUP BY 1) SELECT st.doc_id, {KINDS} AS structure_type FROM st JOIN z ON z.doc_id = st.doc_id", "headings", "doc_pages", "doc_lines", "page_types")
def d13_structure_type(h, p, lines, t):
    zones = D.content_zones(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("zones"))
    size = [F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0) for c in ("toc_entries", "headings", "section_boundaries")]
    return built(h, p, lines).join(zones, "doc_id").select("doc_id", D.structure_type(*size, F.col("zones")).alias("structure_type"))


@query(
    f"""WITH {STRUCTURE}, {GUIDANCE}, {REFERRED}, sx AS ({STATISTICS}), ty AS (SELECT p.doc_id, CASE WHEN bool_or(primary_type IN ('coverage', 'eligibility', 'exclusions')) OR bool_or(regexp_matches(lower(text), 'insurance|coverage|policy|benefit')) THEN 'insurance' WHEN bool_or(regexp_matches(lower(text), 'regulation|compliance|regulatory')) THEN 'regulatory'
      WHEN bool_or(regexp_matches(lower(text), 'contract|agreement|legal')) THEN 'legal' ELSE 'unknown' END AS document_type FROM {{text_pages}} p JOIN {{page_types}} t ON t.doc_id = p.doc_id AND t.page_number = p.page_number WHERE p.page_number <= 3 GROUP BY 1),
    lk AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(CASE WHEN regexp_matches(target, '^[0-9]+$') THEN target END AS INT) IS NOT NULL) AS internal FROM m GROUP BY 1), fc AS (SELECT doc_id, count(*) AS n FROM fl GROUP BY 1)
    SELECT sx.doc_id, document_type, sx.pages, policy_pages, admin_pages, zones, definitions_from, round(extractability, 6) AS extractability, round(structure_confidence, 6) AS structure_confidence, round((least(1.0, CAST(sx.pages AS DOUBLE) / 100) + least(1.0, CAST(zones AS DOUBLE) / 10) + CAST(admin_pages AS DOUBLE) / sx.pages + least(1.0, CAST(sx.pages % 4 AS DOUBLE) / 3) + CASE WHEN definitions_from IS NOT NULL THEN 0.7 ELSE 0.3 END) / 5, 6) AS complexity,
      {KINDS} AS structure_type, chunk_boundaries, pages_to_filter, special_handling, coalesce(fc.n, 0) AS estimated_policies, coalesce(lk.n, 0) AS references, coalesce(internal, 0) > 0 AS has_internal_references FROM sx JOIN ty ON ty.doc_id = sx.doc_id JOIN st ON st.doc_id = sx.doc_id JOIN gd ON gd.doc_id = sx.doc_id LEFT JOIN fc ON fc.doc_id = sx.doc_id LEFT JOIN lk ON lk.doc_id = sx.doc_id""",
    "text_pages",
    "doc_pages",
    "headings",
    "page_types",
    "doc_lines",
)
def d22_analyze_document(x, p, h, t, lines):
    """All that is known of a document in one row."""
    s = D.document_statistics(t, D.content_zones(t))
    more = s.withColumns({"mixed_ratio": F.col("admin_pages") / F.col("pages"), "tables_a_page": F.col("pages") % 4, "has_complex_sections": F.col("definitions_from").isNotNull()})
    kinds = K.document_types(t.select("doc_id", "page_number", "primary_type").join(x, ["doc_id", "page_number"]))
    rows = D.analyzed(kinds, s.drop("priority"), D.document_complexity(more).drop("expensive_tier"), built(h, p, lines), guidance(h, p, t), D.policy_flow(boundaries(h, p)), D.references(linked(x)))
    return rows.drop("headings", "toc_entries", "section_boundaries").withColumns({c: F.round(c, 6) for c in ("extractability", "structure_confidence", "complexity")})
