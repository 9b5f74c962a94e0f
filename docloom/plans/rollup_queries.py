"""Queries over document roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import entities as E
from docloom.operators import hierarchy as H
from docloom.operators import jobs
from docloom.operators import rollups as R
from docloom.operators import structure as D
from docloom.plans.document_queries import SECTIONS
from docloom.plans.registration import Registry
from docloom.plans.tree_queries import DEPTH

registry = Registry()
query = registry.query


@query(
    f"""WITH s AS ({SECTIONS}), a AS (SELECT doc_id, count(*) AS sections, avg(end_page - start_page + 1) AS section_length, string_agg(lower(title), ' ') AS titles FROM s GROUP BY doc_id),
    b AS (SELECT s.doc_id, count(*) AS subsections FROM s JOIN {{headings}} h ON s.doc_id = h.doc_id AND h.page_number BETWEEN s.start_page AND s.end_page WHERE h.level IN (2, 3) GROUP BY s.doc_id),
    p AS (SELECT doc_id, count(*) AS pages, bool_or(page_number <= 3 AND contains(lower(text), 'bariatric')) AS bariatric FROM {{text_pages}} GROUP BY doc_id),
    r AS (SELECT p.doc_id, coalesce(sections, 0) AS sections, coalesce(subsections, 0) AS subsections, coalesce(section_length, 0) AS section_length, pages, coalesce(titles, '') AS t, bariatric FROM p LEFT JOIN a ON a.doc_id = p.doc_id LEFT JOIN b ON b.doc_id = p.doc_id),
    c AS (SELECT *, CASE WHEN sections > 5 THEN 2 WHEN sections > 3 THEN 1 ELSE 0 END + CASE WHEN subsections > 10 THEN 2 WHEN subsections > 5 THEN 1 ELSE 0 END + CASE WHEN section_length > 3 THEN 1 ELSE 0 END + CASE WHEN pages > 10 THEN 1 ELSE 0 END AS points FROM r),
    k AS (SELECT *, CASE WHEN points >= 5 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS complexity FROM c)
    SELECT doc_id, sections, subsections, round(section_length, 6) AS section_length, pages, CASE WHEN contains(t, 'medical necessity') OR contains(t, 'coverage criteria') THEN 'medical_coverage' WHEN bariatric OR contains(t, 'surgery') THEN 'surgical_procedure' WHEN contains(t, 'exclusion') OR contains(t, 'limitation') THEN 'exclusions'
      WHEN contains(t, 'benefit') OR contains(t, 'covered service') THEN 'benefits' ELSE 'general_policy' END AS policy_type, complexity, CASE WHEN complexity = 'high' AND sections > 5 THEN 'section_based_with_subsections' WHEN complexity = 'medium' OR sections > 3 THEN 'section_based' WHEN pages < 5 THEN 'full_document' ELSE 'page_range_based' END AS strategy FROM k""",
    "headings",
    "text_pages",
)
def d18_d21_structure_summary(h, t):
    sections = D.major_sections(h, D.page_totals(t))
    return R.structure_summary(sections, D.subsections(sections, h), t).withColumn("section_length", F.round("section_length", 6))


@query(
    """WITH w AS (SELECT l_orderkey // 20 AS page, l_shipmode AS text, CAST(floor(l_extendedprice) AS BIGINT) % 600 AS x0, l_quantity * 15 AS top FROM (SELECT *, 'word' AS l_shipmode FROM {lineitem}) q), g AS (SELECT *, x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) AS gap FROM w)
    SELECT page, bool_or(top < 79.2) AS has_header, bool_or(top > 712.8) AS has_footer, round(CAST(sum(length(text)) AS DOUBLE) / (612 * 792 / 5184.0), 6) AS density, 'portrait' AS orientation, CASE WHEN count(DISTINCT x0) > 20 THEN count(*) FILTER (WHERE gap > 50) + 1 ELSE 1 END AS columns FROM g GROUP BY page""",
    "lineitem",
)
def p08_layout_features(t):
    words = t.select(F.floor(F.col("l_orderkey") / 20).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit("word").alias("text"), (F.floor("l_extendedprice") % 600).alias("x0"), (F.col("l_quantity") * 15).alias("top"))
    return R.page_layout(words).withColumn("density", F.round("density", 6))


@query("SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS row_count, CAST(o_orderkey % 3 + 1 AS INT) AS col_count, CAST(least(3, o_orderkey % 5) AS INT) AS preview_rows, o_orderstatus || '1:1' AS first_cell, o_orderstatus || CAST(least(3, o_orderkey % 5) AS VARCHAR) || ':1' AS last_row, 0.85 AS confidence FROM {orders} WHERE o_orderkey % 5 > 0", "orders")
def p07_table_features(o):
    """Tables of up to four rows and three columns; those without rows are dropped."""
    rows, columns = F.col("o_orderkey") % 5, F.col("o_orderkey") % 3 + 1

    def upto(n):
        return F.filter(F.array(*[F.lit(i) for i in range(1, 5)]), lambda i: i <= n)

    table = F.transform(upto(rows), lambda r: F.transform(upto(columns), lambda c: F.concat("o_orderstatus", r.cast("string"), F.lit(":"), c.cast("string"))))
    made = o.select("o_orderkey", R.table_features(table).alias("t")).where("t is not null")
    first = F.get(F.get("t.preview", 0), 0)
    return made.select("o_orderkey", "t.row_count", "t.col_count", F.size("t.preview").alias("preview_rows"), first.alias("first_cell"), F.get(F.element_at("t.preview", -1), 0).alias("last_row"), "t.confidence")


@query(
    r"""SELECT doc_id, CAST(greatest(1, floor(len(regexp_extract_all(t, '\n[A-Z][A-Z\s]+\n')) + 0.5 * (len(regexp_extract_all(t, '\n\s*[\d\-•]\s+')) // 5))) AS INT) AS expected FROM (SELECT doc_id, chr(10) || 'ITEMS' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY line_no) AS t FROM {doc_lines} GROUP BY doc_id) q""",
    "doc_lines",
)
def q04_expected_policies(t):
    listed = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.concat(F.lit("- "), "line").alias("l")))).alias("l"))
    text = F.concat(F.lit("\nITEMS\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\n"))
    return listed.select("doc_id", R.expected_policies(text).alias("expected"))


@query("SELECT 'p' || CAST(doc_id // 5 AS VARCHAR) AS policy_id, left(string_agg(text, chr(10) ORDER BY doc_id, page_number), 3000) AS context FROM {doc_pages} GROUP BY 1", "doc_pages")
def e15_related_page_text(p):
    refs = p.select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 5).cast("string")).alias("policy_id"), "doc_id", "page_number")
    return R.related_text(refs, p)


@query(f"{DEPTH} SELECT p.job_id, p.policy_id, pl.depth AS level, pl.root FROM {{policies}} p JOIN pl ON p.job_id = pl.job_id AND p.policy_id = pl.policy_id", "policies")
def e08_e12_hierarchy_levels(p):
    """Levels from the table's links as a fixpoint, whatever the order of its rows."""
    return H.plan(p).select("job_id", "policy_id", F.col("depth").alias("level"), "root")


@query("SELECT job_id, event_id, event_type FROM {job_events} UNION ALL SELECT DISTINCT job_id, CAST(-1 AS BIGINT), 'created' FROM {job_events}", "job_events")
def j07_history_append(t):
    return t.select("job_id", "event_id", "event_type").union(t.select("job_id").distinct().select("job_id", F.lit(-1).cast("long"), F.lit("created")))


@query("WITH k AS (SELECT DISTINCT parent_id FROM {policies} WHERE parent_id IS NOT NULL) SELECT policy_id FROM {policies} WHERE ord % 6 = 0 UNION SELECT policy_id FROM {policies} p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.parent_id = p.policy_id)", "policies")
def r07_affected_trees(p):
    """Merge survivors, and all leaves once anything has moved."""
    leaves = H.leaves(p).select("policy_id")
    return p.where("ord % 6 = 0").select("policy_id").union(leaves).distinct()
