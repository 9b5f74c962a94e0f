"""Queries over policies, conditions and trees: entity resolution, checks and repairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import entities as E
from docloom.operators import jobs
from docloom.operators import quality as Q
from docloom.plans.document_queries import packed
from docloom.plans.registration import Registry
from docloom.plans.text_queries import kept, set_jaccard, word_list

registry = Registry()
query = registry.query

COUNTS = "SELECT policy_id, count(*) AS n_conditions FROM {conditions} GROUP BY policy_id"
PARENTS = "SELECT DISTINCT job_id, parent_id AS policy_id FROM {policies} WHERE parent_id IS NOT NULL"


def any_word(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(
    f"""WITH c AS ({COUNTS}), h AS ({PARENTS}), r AS (SELECT p.*, coalesce(c.n_conditions, 0) AS n FROM {{policies}} p LEFT JOIN c ON c.policy_id = p.policy_id LEFT JOIN h ON h.job_id = p.job_id AND h.policy_id = p.policy_id
      WHERE length(trim(description)) >= 20 AND NOT (h.policy_id IS NULL AND p.parent_id IS NOT NULL AND coalesce(c.n_conditions, 0) = 0) AND confidence >= 0.4 AND NOT ({any_word("lower(title)", E.GENERIC_TITLES)} AND length(title) < 25 AND coalesce(c.n_conditions, 0) < 2))
    SELECT job_id, ord, policy_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, trim(lower(left(description, 100))) ORDER BY ord) AS nth FROM r) q WHERE nth = 1""",
    "policies",
    "conditions",
)
def e05_filter_low_quality(p, c):
    return E.quality_filter(p, E.condition_counts(c)).select("job_id", "ord", "policy_id")


@query("SELECT user_id AS job_id, event_type AS term, event_id AS definition FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS nth FROM {events}) q WHERE nth = 1", "events")
def e14_definition_merge(t):
    return E.last_definitions(t.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("term"), F.col("event_id").alias("definition"), F.col("event_id").alias("chunk_ord")))


@query("SELECT p_partkey AS response_id, CAST(i AS INT) AS pos, 'p' || CAST(p_partkey AS VARCHAR(20)) AS policy_id, CASE WHEN i = 0 THEN p_name ELSE 'Untitled Policy' END AS title, p_type AS description, CAST(i AS INT) AS level, CAST(0.7 AS DOUBLE) AS confidence FROM {part} CROSS JOIN (SELECT unnest([0, 1]) AS i) x", "part")
def e02_e03_typed_policies(t):
    one, two = (
        F.struct(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("policy_id"), title.alias("title"), F.col("p_type").alias("description"), F.lit(i).alias("level"))
        for i, title in ((0, F.col("p_name")), (1, F.lit(None).cast("string")))
    )
    body = F.to_json(F.struct(F.array(one, two).alias("policies")))
    fenced = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return E.typed_policies(t.select(F.col("p_partkey").alias("response_id"), fenced.alias("content")))


# A policy in three has no source; jobs are those of the policies and five more.
ISSUES = """SELECT 'warning' AS severity, 'missing_title' AS issue_type, policy_id AS location FROM {policies} WHERE coalesce(CASE WHEN ord % 29 = 3 THEN '' ELSE title END, '') = '' UNION ALL SELECT 'warning', 'missing_description', policy_id FROM {policies} WHERE ord % 31 = 4
    UNION ALL SELECT 'error', 'missing_source_reference', policy_id FROM {policies} WHERE ord % 3 = 1 UNION ALL SELECT 'error', 'missing_policies', 'job ' || CAST(job_id + 5 AS VARCHAR) FROM (SELECT DISTINCT job_id FROM {policies}) j WHERE job_id + 5 NOT IN (SELECT job_id FROM {policies})
    UNION ALL SELECT 'warning', 'low_confidence', policy_id FROM {policies} WHERE confidence < 0.7 UNION ALL SELECT 'error', 'invalid_parent_reference', policy_id FROM {policies} p WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {policies} q WHERE q.job_id = p.job_id AND q.policy_id = p.parent_id)"""


def policy_issues(p):
    rows = p.withColumns({"title": F.when(F.col("ord") % 29 == 3, "").otherwise(F.col("title")), "description": F.when(F.col("ord") % 31 != 4, F.col("description"))})
    return Q.hierarchy_issues(rows, p.where("ord % 3 <> 1"), p.select((F.col("job_id") + 5).alias("job_id")).distinct())


@query(ISSUES, "policies")
def v02_validate_hierarchy(p):
    return policy_issues(p)


# Trees with every fault: no root, a node under its own child, questions without text or children, outcomes without type or with children.
BROKEN = """SELECT tree_id, node_id, parent_node_id, sibling_ord, CASE WHEN node_id % 17 = 0 THEN 'outcome' WHEN node_id % 19 = 0 THEN 'question' ELSE node_type END AS node_type, CASE WHEN node_id % 11 <> 0 THEN CASE WHEN node_id % 13 = 0 THEN 'Short?' ELSE 'Is criterion ' || CAST(node_id AS VARCHAR) || ' met?' END END AS question_text,
    CASE WHEN node_id % 3 = 0 THEN 'why' END AS explanation, CASE WHEN node_id % 9 <> 0 THEN outcome_type END AS outcome_type, node_id % 2 = 0 AS has_source FROM (SELECT tree_id, node_id, parent_node_id, sibling_ord, node_type, outcome_type FROM {tree_nodes} UNION ALL SELECT tree_id, node_id, 5, 9, node_type, outcome_type FROM {tree_nodes} WHERE node_id = 2 AND tree_id % 4 = 0) q WHERE NOT (node_id = 1 AND tree_id % 10 = 3)"""
WALKED = f"""n AS ({BROKEN}), k AS (SELECT tree_id, parent_node_id AS node_id, count(*) AS n_children FROM n WHERE parent_node_id IS NOT NULL GROUP BY 1, 2), f AS (SELECT DISTINCT n.tree_id, n.node_id, node_type, question_text, outcome_type, has_source, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.tree_id = n.tree_id AND k.node_id = n.node_id),
    w AS (SELECT tree_id, node_id, [node_id] AS path, FALSE AS cyclic FROM n WHERE parent_node_id IS NULL UNION ALL SELECT n.tree_id, n.node_id, list_append(w.path, n.node_id), list_contains(w.path, n.node_id) FROM w JOIN n ON n.tree_id = w.tree_id AND n.parent_node_id = w.node_id WHERE NOT w.cyclic),
    x AS (SELECT f.*, CAST(f.tree_id AS VARCHAR) || '/' || CAST(f.node_id AS VARCHAR) AS location FROM w JOIN f ON f.tree_id = w.tree_id AND f.node_id = w.node_id WHERE NOT cyclic)"""
TREE_ISSUES = """SELECT 'error' AS severity, 'missing_root_node' AS issue_type, CAST(tree_id AS VARCHAR) AS location FROM (SELECT DISTINCT tree_id FROM {tree_nodes}) t WHERE tree_id NOT IN (SELECT tree_id FROM n WHERE parent_node_id IS NULL)
    UNION ALL SELECT 'error', 'circular_reference', CAST(tree_id AS VARCHAR) || '/' || CAST(node_id AS VARCHAR) FROM w WHERE cyclic UNION ALL SELECT 'error', 'missing_question', location FROM x WHERE node_type = 'question' AND question_text IS NULL UNION ALL SELECT 'warning', 'dead_end', location FROM x WHERE node_type = 'question' AND n_children = 0
    UNION ALL SELECT 'error', 'missing_outcome', location FROM x WHERE node_type = 'outcome' AND outcome_type IS NULL UNION ALL SELECT 'warning', 'outcome_with_children', location FROM x WHERE node_type = 'outcome' AND n_children > 0 UNION ALL SELECT 'warning', 'missing_source_reference', location FROM x WHERE node_type = 'outcome' AND NOT has_source"""
QUESTION_ISSUES = """SELECT 'warning' AS severity, 'short_question' AS issue_type, CAST(tree_id AS VARCHAR) || '/' || CAST(node_id AS VARCHAR) AS location FROM n WHERE node_type = 'question' AND length(question_text) < 10 UNION ALL SELECT 'info', 'missing_explanation', CAST(tree_id AS VARCHAR) || '/' || CAST(node_id AS VARCHAR) FROM n WHERE node_type = 'question' AND question_text IS NOT NULL AND explanation IS NULL"""


def broken(n):
    """The faulty trees of ``BROKEN``."""
    again = n.where("node_id = 2 and tree_id % 4 = 0").withColumns({"parent_node_id": F.lit(5).cast("long"), "sibling_ord": F.lit(9).cast(n.schema["sibling_ord"].dataType)})
    i = F.col("node_id")
    rows = n.unionByName(again).where("not (node_id = 1 and tree_id % 10 = 3)")
    text = F.when(i % 11 != 0, F.when(i % 13 == 0, "Short?").otherwise(F.concat(F.lit("Is criterion "), i.cast("string"), F.lit(" met?"))))
    return rows.withColumns(
        {"node_type": F.when(i % 17 == 0, "outcome").when(i % 19 == 0, "question").otherwise(F.col("node_type")), "question_text": text, "explanation": F.when(i % 3 == 0, "why"), "outcome_type": F.when(i % 9 != 0, F.col("outcome_type")), "has_source": i % 2 == 0}
    )


@query(f"WITH RECURSIVE {WALKED} {TREE_ISSUES}", "tree_nodes")
def v03_v04_tree_issues(n):
    return Q.tree_issues(broken(n), n)


@query(f"WITH n AS ({BROKEN}) {QUESTION_ISSUES}", "tree_nodes")
def v06_question_issues(n):
    return Q.question_issues(broken(n).where("node_type = 'question'"))


# A tree for two policies in three, some with wrong flags, missing children and other parents.
AGGREGATORS = """tr AS (SELECT p.policy_id, p.parent_id, ord % 2 = 0 AS is_aggregator, k.kids IS NOT NULL AS has_kids, coalesce(missing, 0) AS missing, CASE WHEN ord % 7 = 0 THEN 'px' ELSE p.parent_id END AS parent_policy_id FROM {policies} p LEFT JOIN (SELECT job_id, parent_id, count(*) AS kids, count(*) FILTER (WHERE ord % 5 = 0) AS missing FROM {policies} WHERE parent_id IS NOT NULL GROUP BY 1, 2) k ON k.job_id = p.job_id AND k.parent_id = p.policy_id WHERE ord % 3 <> 2)"""
AGGREGATOR_ISSUES = """SELECT 'info' AS severity, 'aggregator_metadata_missing' AS issue_type, policy_id AS location FROM tr WHERE has_kids AND NOT is_aggregator UNION ALL SELECT 'warning', 'missing_child_references', policy_id FROM tr WHERE missing > 0 UNION ALL SELECT 'warning', 'incorrect_aggregator_flag', policy_id FROM tr WHERE NOT has_kids AND is_aggregator
    UNION ALL SELECT 'warning', 'parent_mismatch', policy_id FROM tr WHERE parent_id IS NOT NULL AND parent_policy_id <> parent_id"""


def aggregators(p):
    kids = p.where("parent_id is not null and ord % 5 <> 0").groupBy("job_id", F.col("parent_id").alias("policy_id")).agg(F.collect_list("policy_id").alias("child_policy_ids"))
    rows = p.where("ord % 3 <> 2").join(kids.hint("merge"), ["job_id", "policy_id"], "left")
    return rows.select("policy_id", (F.col("ord") % 2 == 0).alias("is_aggregator"), "child_policy_ids", F.when(F.col("ord") % 7 == 0, "px").otherwise(F.col("parent_id")).alias("parent_policy_id"))


@query(f"WITH {AGGREGATORS} {AGGREGATOR_ISSUES}", "policies")
def v08_hierarchical_completeness(p):
    return Q.aggregator_issues(p, aggregators(p))


@query(
    f"WITH RECURSIVE {WALKED}, {AGGREGATORS}, i AS ({ISSUES} UNION ALL {TREE_ISSUES} UNION ALL {QUESTION_ISSUES} UNION ALL {AGGREGATOR_ISSUES}) SELECT issue_type, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM i GROUP BY issue_type",
    "policies",
    "tree_nodes",
)
def v01_v16_issue_summary(p, n):
    nodes = broken(n)
    return Q.by_severity(policy_issues(p).unionByName(Q.tree_issues(nodes, n)).unionByName(Q.question_issues(nodes.where("node_type = 'question'"))).unionByName(Q.aggregator_issues(p, aggregators(p))))


@query(
    f"""WITH c AS ({COUNTS}), j AS (SELECT job_id, count(*) FILTER (WHERE confidence < 0.06) AS e, count(*) FILTER (WHERE confidence < 0.15) AS w, avg(CASE WHEN ord % 4 = 0 AND job_id % 3 = 0 THEN 0.0 ELSE 1.0 END) AS a, avg(least(1.0, CAST(p.ord % 60 AS DOUBLE) / n_conditions)) AS b, avg(CASE WHEN ord % 3 = 0 OR job_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS t FROM {{policies}} p LEFT JOIN c ON c.policy_id = p.policy_id GROUP BY job_id)
    SELECT job_id, array_to_string(list_filter([CASE WHEN e > 0 THEN 'Address ' || CAST(e AS VARCHAR) || ' critical errors before using this output' END, CASE WHEN w > 5 THEN 'Review ' || CAST(w AS VARCHAR) || ' warnings to improve quality' END, CASE WHEN a < 0.9 THEN 'Some policies are missing decision trees - consider regenerating' END,
      CASE WHEN b < 0.8 THEN 'Decision trees may not fully represent policy conditions - review for completeness' END, CASE WHEN t < 0.8 THEN 'Improve traceability by adding more source references' END], lambda x: x IS NOT NULL), '|') AS recommendations FROM j""",
    "policies",
    "conditions",
)
def v13_recommendations(p, c):
    ord_, job = F.col("ord"), F.col("job_id")
    rows = p.join(c.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n_conditions")), "policy_id", "left").groupBy("job_id").agg(
        F.count_if(F.col("confidence") < 0.06).alias("e"),
        F.count_if(F.col("confidence") < 0.15).alias("w"),
        F.avg(F.when((ord_ % 4 == 0) & (job % 3 == 0), 0.0).otherwise(1.0)).alias("a"),
        F.avg(F.when(F.col("n_conditions").isNotNull(), F.least(F.lit(1.0), ord_ % 60 / F.col("n_conditions")))).alias("b"),
        F.avg(F.when((ord_ % 3 == 0) | (job % 2 == 0), 1.0).otherwise(0.0)).alias("t"),
    )
    return rows.select("job_id", F.array_join(Q.recommendations(*(F.col(x) for x in "ewabt")), "|").alias("recommendations"))


@query("SELECT job_id, count(*) FILTER (WHERE ord % 4 = 0) AS without_tree, round(avg(CASE WHEN ord % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS completeness FROM {policies} GROUP BY job_id", "policies")
def v07_completeness(p):
    return Q.completeness(p, p.where("ord % 4 <> 0")).withColumn("completeness", F.round("completeness", 6))


@query(f"WITH c AS ({COUNTS}) SELECT job_id, round(avg(least(1.0, CAST(p.ord % 6 AS DOUBLE) / n_conditions)), 6) AS consistency, count(*) FILTER (WHERE p.ord % 6 < n_conditions) AS incomplete FROM {{policies}} p JOIN c ON c.policy_id = p.policy_id GROUP BY job_id", "policies", "conditions")
def v09_consistency(p, c):
    return Q.consistency(p, c, p.select("policy_id", (F.col("ord") % 6).alias("n_questions"))).withColumn("consistency", F.round("consistency", 6))


@query(
    """WITH n AS (SELECT tree_id, node_id FROM {tree_nodes}) SELECT round((SELECT avg(confidence) FROM {policies}), 6) AS confidence, round((SELECT avg(CASE WHEN ref THEN 1.0 ELSE 0.0 END) FROM (SELECT ord % 3 = 0 AS ref FROM {policies} UNION ALL SELECT node_id % 2 = 0 FROM n) q), 6) AS traceability""",
    "policies",
    "tree_nodes",
)
def v10_v11_scores(p, n):
    refs = p.select((F.col("ord") % 3 == 0).alias("ref")).union(n.select(F.col("node_id") % 2 == 0)).agg(F.round(F.avg(F.col("ref").cast("double")), 6).alias("traceability"))
    return p.agg(F.round(F.avg("confidence"), 6).alias("confidence")).join(refs)


@query("SELECT policy_id, title FROM {policies} WHERE confidence < 0.3", "policies")
def v12_low_confidence(p):
    return p.where("confidence < 0.3").select("policy_id", "title")


@query("SELECT title, policy_id FROM (SELECT title, policy_id, row_number() OVER (PARTITION BY title ORDER BY job_id, ord) AS nth FROM {policies} WHERE confidence < 0.5) q WHERE nth = 1", "policies")
def v14_failed_policy_ids(p):
    return jobs.first_of_each(p.where("confidence < 0.5"), "title", [F.col("job_id"), F.col("ord")]).select("title", "policy_id")


@query("SELECT policy_id, CASE WHEN ord % 5 = 0 THEN 'retried' ELSE title END AS title FROM {policies}", "policies")
def v15_retry_merge(p):
    new = p.where("ord % 5 = 0").select("policy_id", F.lit("retried").alias("title"))
    return jobs.latest_wins(p.select("policy_id", "title"), new, "policy_id")


@query(
    f"""WITH t AS (SELECT policy_id, condition_id, list_distinct({kept(word_list("description"), X.VERIFIER_STOP)}) AS t FROM {{conditions}}), p AS (SELECT a.policy_id AS a_id, b.policy_id AS b_id FROM {{policies}} a JOIN {{policies}} b ON a.job_id = b.job_id AND a.ord + 1 = b.ord),
    m AS (SELECT a_id, b_id, x.condition_id, max({set_jaccard("x.t", "y.t")}) AS best FROM p JOIN t x ON x.policy_id = a_id JOIN t y ON y.policy_id = b_id GROUP BY 1, 2, 3) SELECT a_id, b_id, round(avg(best), 6) AS similarity FROM m GROUP BY 1, 2""",
    "policies",
    "conditions",
)
def q02_condition_similarity(p, c):
    a = p.select("job_id", "ord", F.col("policy_id").alias("a_id"))
    b = p.select("job_id", (F.col("ord") - 1).alias("ord"), F.col("policy_id").alias("b_id"))
    return Q.condition_similarity(a.join(b, ["job_id", "ord"]), c).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH RECURSIVE t AS (SELECT policy_id, ord, condition_id, list_distinct({word_list("description")}) AS t FROM {{conditions}}),
    f AS (SELECT policy_id, ord, condition_id, [t] AS kept, TRUE AS stays FROM t WHERE ord = 1 UNION ALL SELECT t.policy_id, t.ord, t.condition_id, CASE WHEN len(list_filter(f.kept, lambda k: CAST(len(list_intersect(k, t.t)) AS DOUBLE) / len(list_distinct(list_concat(k, t.t))) > 0.7)) = 0 THEN list_append(f.kept, t.t) ELSE f.kept END,
      len(list_filter(f.kept, lambda k: CAST(len(list_intersect(k, t.t)) AS DOUBLE) / len(list_distinct(list_concat(k, t.t))) > 0.7)) = 0 FROM f JOIN t ON t.policy_id = f.policy_id AND t.ord = f.ord + 1)
    SELECT policy_id, ord, condition_id FROM f WHERE stays""",
    "conditions",
)
def r02_dedup_conditions(c):
    return Q.dedup_conditions(c, 0.7)


@query(
    """WITH RECURSIVE m AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS id, 'p' || CAST(p_partkey - p_partkey % 3 - 1 AS VARCHAR) AS up FROM {part} WHERE p_partkey % 3 > 0 AND p_partkey > 3),
    w AS (SELECT id, up, 1 AS d FROM m UNION ALL SELECT w.id, m.up, d + 1 FROM w JOIN m ON m.id = w.up), l AS (SELECT id, up, row_number() OVER (PARTITION BY id ORDER BY d DESC) AS nth FROM w) SELECT id AS policy_id, up AS survivor FROM l WHERE nth = 1""",
    "part",
)
def r01_merge_survivors(t):
    key = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return Q.survivors(t.where((key % 3 > 0) & (key > 3)).select(name(key - key % 3 - 1).alias("a_id"), name(key).alias("b_id")))


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, page_number, greatest(1, length(text) // 4) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS i FROM {doc_pages}),
    f AS (SELECT doc_id, n, i, 0 AS grp, n AS filled FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.n, s.i, CASE WHEN f.filled + s.n > 400 THEN f.grp + 1 ELSE f.grp END, CASE WHEN f.filled + s.n > 400 THEN s.n ELSE f.filled + s.n END FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
    k AS (SELECT doc_id, grp, count(*) AS expected FROM f GROUP BY 1, 2) SELECT doc_id, CAST(grp AS INT) AS grp, expected, CASE WHEN grp % 3 = 0 THEN 'missing' WHEN grp % 3 = 1 THEN 'over_extracted' ELSE 'ok' END AS coverage FROM k""",
    "doc_pages",
)
def q03_policy_coverage(p):
    """Policies per chunk against what is expected: none is missing, over one and a half times is too many."""
    expected = packed(p).groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("expected"))
    got = F.when(F.col("grp") % 3 == 0, 0).when(F.col("grp") % 3 == 1, F.col("expected") * 2).otherwise(F.col("expected"))
    return expected.select("doc_id", "grp", "expected", F.when(got == 0, "missing").when(got > 1.5 * F.col("expected"), "over_extracted").otherwise("ok").alias("coverage"))

