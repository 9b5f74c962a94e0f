"""Queries over policy hierarchies and decision trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import hierarchy as H
from docloom.operators import trees as T
from docloom.plans.fixtures import large
from docloom.plans.registration import Registry

registry = Registry()
query = registry.query

DEPTH = """WITH RECURSIVE r AS (SELECT p.job_id, p.policy_id, 0 AS depth, p.policy_id AS root FROM {policies} p WHERE p.parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM {policies} q WHERE q.job_id = p.job_id AND q.policy_id = p.parent_id)
    UNION ALL SELECT p.job_id, p.policy_id, r.depth + 1, r.root FROM {policies} p JOIN r ON p.job_id = r.job_id AND p.parent_id = r.policy_id),
    n AS (SELECT job_id, parent_id AS policy_id, count(*) AS n_children FROM {policies} GROUP BY 1, 2),
    pl AS (SELECT p.job_id, p.policy_id, p.ord, r.depth, r.root, coalesce(n.n_children, 0) AS n_children, n.n_children IS NULL AS is_leaf FROM {policies} p JOIN r ON p.job_id = r.job_id AND p.policy_id = r.policy_id LEFT JOIN n ON n.job_id = p.job_id AND n.policy_id = p.policy_id)"""


@query(f"{DEPTH} SELECT job_id, policy_id, depth, root, n_children, is_leaf FROM pl", "policies")
def h01_h03_h04_h09_plan(p):
    return H.plan(p).select("job_id", "policy_id", "depth", "root", "n_children", "is_leaf")


@query(
    large("""WITH RECURSIVE w AS (SELECT job_id, policy_id AS root_id, ord AS root_ord, policy_id, [CAST(0 AS BIGINT)] AS ords FROM {policies} WHERE parent_id IS NULL UNION ALL SELECT p.job_id, w.root_id, w.root_ord, p.policy_id, list_append(w.ords, p.ord) FROM w JOIN {policies} p ON p.job_id = w.job_id AND p.parent_id = w.policy_id)
    SELECT job_id, root_id, policy_id, CAST(row_number() OVER (PARTITION BY job_id, root_id ORDER BY ords) AS INT) AS nth_of_root, CAST(row_number() OVER (PARTITION BY job_id ORDER BY root_ord, root_id, ords) AS INT) AS nth FROM w"""),
    "large_jobs",
)
def h01b_h01c_flatten_policies(p):
    return H.flattened(p)


@query(large(f"{DEPTH} SELECT job_id, policy_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY is_leaf DESC, depth DESC, ord) AS INT) AS nth FROM pl"), "large_jobs")
def h08_generation_order(p):
    return H.generation_order(H.plan(p))


@query(f"{DEPTH} SELECT job_id, count(*) AS total, count(*) FILTER (WHERE depth = 0) AS roots, max(depth) AS max_depth, count(*) FILTER (WHERE depth > 0) AS sub_policies, count(*) FILTER (WHERE is_leaf) AS leaves FROM pl GROUP BY job_id", "policies")
def h10_e13_q09_overview(p):
    return H.overview(H.plan(p))


@query("SELECT job_id, parent_id AS policy_id, string_agg(policy_id, ',' ORDER BY ord) AS children FROM {policies} WHERE parent_id IS NOT NULL GROUP BY 1, 2", "policies")
def h02_relationships(p):
    return H.relationships(p).withColumn("children", F.array_join("children", ","))


@query(
    large("""WITH f AS (SELECT job_id, parent_id, string_agg(policy_id || ': ' || left(description, 100), '|' ORDER BY ord) AS kids FROM {policies} WHERE parent_id IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT a.job_id, a.policy_id, string_agg(b.policy_id, ',' ORDER BY b.ord) AS siblings FROM {policies} a JOIN {policies} b ON a.job_id = b.job_id AND a.parent_id = b.parent_id AND a.policy_id <> b.policy_id GROUP BY 1, 2)
    SELECT p.job_id, p.policy_id, q.title AS parent_title, coalesce(s.siblings, '') AS siblings, coalesce(f.kids, '') AS children FROM {policies} p LEFT JOIN {policies} q ON p.job_id = q.job_id AND p.parent_id = q.policy_id
    LEFT JOIN s ON s.job_id = p.job_id AND s.policy_id = p.policy_id LEFT JOIN f ON f.job_id = p.job_id AND f.parent_id = p.policy_id"""),
    "large_jobs",
)
def h05_t23_policy_context(p):
    return H.context(p).withColumns({"siblings": F.array_join("siblings", ","), "children": F.array_join("children", "|")})


@query(
    r"""WITH c AS (SELECT job_id, parent_id AS policy_id, title, CAST(regexp_extract(policy_id, '([0-9]+)$', 1) AS BIGINT) AS s, row_number() OVER (PARTITION BY job_id, parent_id ORDER BY ord) AS i FROM {policies} WHERE parent_id IS NOT NULL),
    g AS (SELECT job_id, policy_id, count(*) AS n, count(DISTINCT title) AS titles, min(s - i) = max(s - i) AS sequential FROM c GROUP BY 1, 2)
    SELECT job_id, policy_id, sequential, CASE WHEN n >= 2 AND titles = n THEN 'scenario_routing' WHEN sequential THEN 'sequential' ELSE 'conditional' END AS strategy FROM g""",
    "policies",
)
def h06_h07_aggregation_strategy(p):
    return H.aggregation_strategy(p)


@query("SELECT job_id, policy_id, parent_id FROM {policies} p WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {policies} q WHERE q.job_id = p.job_id AND q.policy_id = p.parent_id)", "policies")
def e16_q10_orphans(p):
    return H.orphans(p).select("job_id", "policy_id", "parent_id")


@query("SELECT job_id, policy_id FROM {policies} p WHERE NOT EXISTS (SELECT 1 FROM {policies} q WHERE q.job_id = p.job_id AND q.parent_id = p.policy_id)", "policies")
def t24_leaf_only(p):
    return H.leaves(p).select("job_id", "policy_id")


REPEATED = "SELECT job_id, ord, CASE WHEN ord % 5 = 4 THEN 'p' || CAST(job_id * 100 + ord - 1 AS VARCHAR(20)) ELSE policy_id END AS policy_id, parent_id, title, description, confidence FROM {policies}"


@query(
    f"""WITH r AS ({REPEATED}), n AS (SELECT *, row_number() OVER (PARTITION BY job_id, policy_id ORDER BY ord) AS nth, count(*) OVER (PARTITION BY job_id, policy_id) AS size FROM r), i AS (SELECT *, CASE WHEN nth > 1 THEN policy_id || '_dup' || CAST(nth - 1 AS VARCHAR(9)) ELSE policy_id END AS new_id FROM n)
    SELECT a.job_id, a.ord, a.new_id AS policy_id, coalesce(m.new_id, a.parent_id) AS parent_id FROM i a LEFT JOIN (SELECT * FROM i WHERE size = 2 AND nth = 2) m ON m.job_id = a.job_id AND m.policy_id = a.parent_id""",
    "policies",
)
def e04_dedup_policy_ids(p):
    again = F.when(F.col("ord") % 5 == 4, F.concat(F.lit("p"), (F.col("job_id") * 100 + F.col("ord") - 1).cast("string"))).otherwise(F.col("policy_id"))
    return H.unique_ids(p.withColumn("policy_id", again)).select("job_id", "ord", "policy_id", "parent_id")


KIDS = "SELECT tree_id, parent_node_id AS node_id, count(*) AS n_children, bool_or(answer = 'yes') AS has_yes, bool_or(answer = 'no') AS has_no FROM {tree_nodes} WHERE parent_node_id IS NOT NULL GROUP BY 1, 2"
PATHS = """WITH RECURSIVE w AS (SELECT tree_id, node_id, node_type, CAST(node_id AS VARCHAR) AS path, 0 AS depth FROM {tree_nodes} WHERE parent_node_id IS NULL
    UNION ALL SELECT c.tree_id, c.node_id, c.node_type, w.path || '>' || CAST(c.node_id AS VARCHAR), w.depth + 1 FROM w JOIN {tree_nodes} c ON c.tree_id = w.tree_id AND c.parent_node_id = w.node_id WHERE w.node_type <> 'outcome'),
    k AS (SELECT DISTINCT tree_id, parent_node_id AS node_id FROM {tree_nodes} WHERE parent_node_id IS NOT NULL),
    e AS (SELECT w.* FROM w LEFT JOIN k ON w.tree_id = k.tree_id AND w.node_id = k.node_id WHERE w.node_type = 'outcome' OR k.node_id IS NULL)"""
REACHED = """WITH RECURSIVE x AS (SELECT tree_id, parent_node_id AS node_id, node_id AS nxt FROM {tree_nodes} WHERE parent_node_id IS NOT NULL UNION SELECT r.tree_id, r.node_id, r.next_node_id FROM {routing_rules} r JOIN {tree_nodes} t ON t.tree_id = r.tree_id AND t.node_id = r.next_node_id),
    v AS (SELECT tree_id, node_id FROM {tree_nodes} WHERE parent_node_id IS NULL UNION SELECT x.tree_id, x.nxt FROM v JOIN x ON v.tree_id = x.tree_id AND v.node_id = x.node_id)"""


@query(f"{PATHS} SELECT tree_id, node_id, path FROM e", "tree_nodes")
def t14_all_paths(n):
    return T.all_paths(n).select("tree_id", "node_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"{PATHS} SELECT tree_id, count(*) AS paths, max(depth) AS depth FROM e GROUP BY tree_id", "tree_nodes")
def t05_t06_count_paths(n):
    return T.path_counts(n).select("tree_id", F.col("paths").cast("long").alias("paths"), "depth")


@query("SELECT tree_id, count(*) AS nodes, count(*) FILTER (WHERE node_type = 'question') AS questions, count(*) FILTER (WHERE node_type = 'outcome') AS outcomes, count(DISTINCT node_id) AS ids FROM {tree_nodes} GROUP BY tree_id", "tree_nodes")
def t04_t08_t09_node_counts(n):
    kind = F.col("node_type")
    return n.groupBy("tree_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(kind == "question").alias("questions"), F.count_if(kind == "outcome").alias("outcomes"), F.count_distinct("node_id").alias("ids"))


@query(f"{PATHS} SELECT w.tree_id, w.node_id, w.depth FROM w WHERE w.node_type = 'question'", "tree_nodes")
def t07_q07_extract_questions(n):
    from docloom.operators.iterate import root_paths

    return root_paths(n, T.IS_OUTCOME).where("node_type = 'question'").select("tree_id", "node_id", (F.size("path") - 1).alias("depth"))


@query(f"{REACHED} SELECT tree_id, node_id FROM v", "tree_nodes", "routing_rules")
def t10_reachable(n, r):
    return T.reachable(n, r)


@query(
    f"""WITH k AS ({KIDS}), q AS (SELECT t.tree_id, t.node_id, coalesce(has_yes, FALSE) AS y, coalesce(has_no, FALSE) OR EXISTS (SELECT 1 FROM {{routing_rules}} r WHERE r.tree_id = t.tree_id AND r.node_id = t.node_id) AS n FROM {{tree_nodes}} t LEFT JOIN k ON t.tree_id = k.tree_id AND t.node_id = k.node_id WHERE node_type = 'question')
    SELECT tree_id, node_id, 'no route' AS missing FROM q WHERE NOT y AND NOT n UNION ALL SELECT tree_id, node_id, 'yes' FROM q WHERE n AND NOT y UNION ALL SELECT tree_id, node_id, 'no' FROM q WHERE y AND NOT n""",
    "tree_nodes",
    "routing_rules",
)
def t11_incomplete_routes(n, r):
    return T.incomplete_routes(n, r)


@query("SELECT tree_id, node_id, next_node_id IS NOT NULL AND (comparison <> 'in_range' OR coalesce(range_min <= range_max, FALSE)) AS valid FROM {routing_rules}", "routing_rules")
def t13_routing_rule_check(r):
    return r.select("tree_id", "node_id", T.valid_rule().alias("valid"))


@query(
    """SELECT tree_id, node_id AS group_id, node_id + 1000 * (node_id % 2) AS node_id FROM {tree_nodes} t WHERE NOT EXISTS (SELECT 1 FROM {tree_nodes} u WHERE u.tree_id = t.tree_id AND u.node_id = t.node_id + 1000 * (t.node_id % 2))""",
    "tree_nodes",
)
def t12_logic_group_check(n):
    groups = n.select("tree_id", F.col("node_id").alias("group_id"), F.array(F.col("node_id") + 1000 * (F.col("node_id") % 2)).alias("member_node_ids"))
    return T.missing_members(groups, n)


@query(f"{PATHS}, o AS (SELECT e.tree_id, e.node_id, t.outcome_type FROM e JOIN {{tree_nodes}} t ON e.tree_id = t.tree_id AND e.node_id = t.node_id) SELECT tree_id, coalesce(outcome_type, 'other') AS bucket, count(*) AS paths FROM o GROUP BY 1, 2", "tree_nodes")
def t18_outcome_paths(n):
    return T.outcome_buckets(n).withColumn("paths", F.col("paths").cast("long"))


@query(
    f"""{REACHED}, q AS (SELECT t.tree_id, t.node_id, coalesce(has_yes, FALSE) AS y, coalesce(has_no, FALSE) OR EXISTS (SELECT 1 FROM {{routing_rules}} r WHERE r.tree_id = t.tree_id AND r.node_id = t.node_id) AS n FROM {{tree_nodes}} t LEFT JOIN ({KIDS}) k ON t.tree_id = k.tree_id AND t.node_id = k.node_id WHERE node_type = 'question'),
    g AS (SELECT tree_id, count(*) FILTER (WHERE NOT (y AND n)) AS incomplete FROM q GROUP BY tree_id),
    s AS (SELECT tree_id, count(*) AS nodes, count(*) FILTER (WHERE node_type = 'question') AS questions, count(*) FILTER (WHERE node_type = 'outcome') AS outcomes FROM {{tree_nodes}} GROUP BY tree_id),
    u AS (SELECT t.tree_id, count(*) AS unreachable FROM {{tree_nodes}} t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.tree_id = t.tree_id AND v.node_id = t.node_id) GROUP BY t.tree_id)
    SELECT s.tree_id, nodes, questions, outcomes, coalesce(unreachable, 0) AS unreachable, coalesce(incomplete, 0) AS incomplete, coalesce(unreachable, 0) = 0 AND coalesce(incomplete, 0) = 0 AS valid FROM s LEFT JOIN u ON s.tree_id = u.tree_id LEFT JOIN g ON s.tree_id = g.tree_id""",
    "tree_nodes",
    "routing_rules",
)
def t16_t17_tree_report(n, r):
    return T.report(n, r)


@query(
    f"""{PATHS}, q AS (SELECT t.tree_id, coalesce(has_yes, FALSE) AS y, coalesce(has_no, FALSE) OR EXISTS (SELECT 1 FROM {{routing_rules}} r WHERE r.tree_id = t.tree_id AND r.node_id = t.node_id) AS n FROM {{tree_nodes}} t LEFT JOIN ({KIDS}) k ON t.tree_id = k.tree_id AND t.node_id = k.node_id WHERE node_type = 'question'),
    s AS (SELECT tree_id, count(*) AS nodes FROM {{tree_nodes}} GROUP BY tree_id), p AS (SELECT tree_id, count(*) AS paths FROM e GROUP BY tree_id), g AS (SELECT tree_id, bool_and(y AND n) AS complete FROM q GROUP BY tree_id)
    SELECT count(*) AS trees, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(paths) AS BIGINT) AS paths, round(avg(0.5 + s.tree_id % 5 / 10), 6) AS mean_confidence, count(*) FILTER (WHERE coalesce(complete, TRUE)) AS complete FROM s LEFT JOIN p ON s.tree_id = p.tree_id LEFT JOIN g ON s.tree_id = g.tree_id""",
    "tree_nodes",
    "routing_rules",
)
def t20_tree_statistics(n, r):
    """Nodes, paths, confidence and routing of all trees; a tree's confidence is of its number."""
    confidences = n.select("tree_id", (0.5 + F.col("tree_id") % 5 / 10).alias("confidence")).distinct()
    return T.statistics(n, r, confidences).withColumns({"paths": F.col("paths").cast("long"), "mean_confidence": F.round("mean_confidence", 6)})


@query(
    """WITH RECURSIVE a AS (SELECT s AS subject, tree_id, node_id, CASE WHEN (s * 31 + node_id) % 3 > 0 THEN 'yes' ELSE 'no' END AS answer FROM {tree_nodes} CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS s) x WHERE (s + node_id) % 11 <> 0),
    w AS (SELECT DISTINCT a.subject, t.tree_id, t.node_id, CAST(t.node_id AS VARCHAR) AS path FROM a JOIN {tree_nodes} t ON t.tree_id = a.tree_id WHERE t.parent_node_id IS NULL
      UNION ALL SELECT w.subject, w.tree_id, c.node_id, w.path || '>' || CAST(c.node_id AS VARCHAR) FROM w JOIN a ON a.subject = w.subject AND a.tree_id = w.tree_id AND a.node_id = w.node_id JOIN {tree_nodes} c ON c.tree_id = w.tree_id AND c.parent_node_id = w.node_id AND c.answer = a.answer)
    SELECT w.subject, w.tree_id, w.node_id, w.path, t.outcome_type FROM w JOIN {tree_nodes} t ON t.tree_id = w.tree_id AND t.node_id = w.node_id WHERE NOT EXISTS (SELECT 1 FROM a JOIN {tree_nodes} c ON c.tree_id = a.tree_id AND c.parent_node_id = a.node_id AND c.answer = a.answer WHERE a.subject = w.subject AND a.tree_id = w.tree_id AND a.node_id = w.node_id)""",
    "tree_nodes",
)
def t19_score_answers(n):
    subjects = n.select("tree_id", "node_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("subject"))
    answers = subjects.where((F.col("subject") + F.col("node_id")) % 11 != 0).withColumn("answer", F.when((F.col("subject") * 31 + F.col("node_id")) % 3 > 0, "yes").otherwise("no"))
    walked = T.score(n, answers)
    return walked.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CASE l_linenumber % 4 WHEN 0 THEN l_quantity BETWEEN 10 AND 20 WHEN 1 THEN l_quantity > 25 WHEN 2 THEN l_returnflag = 'R' ELSE contains(l_linestatus, 'O') END AS holds FROM {lineitem}""",
    "lineitem",
)
def t21_routing_compare(t):
    case = F.col("l_linenumber") % 4
    kind = F.when(case == 0, "in_range").when(case == 1, "greater_than").when(case == 2, "equals").otherwise("contains")
    value = F.when(case < 2, F.col("l_quantity").cast("string")).when(case == 2, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))
    target = F.when(case == 1, "25").when(case == 2, "R").otherwise("O")
    return t.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", T.holds(kind, value, target, F.lit(10.0), F.lit(20.0)).alias("holds"))


@query(
    """SELECT p_partkey AS tree_id, 'r' || CAST(p_partkey AS VARCHAR) AS node_id, NULL AS parent_node_id, NULL AS answer, 0 AS sibling_ord, CASE WHEN p_partkey % 3 = 0 THEN 'outcome' ELSE 'question' END AS node_type, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS question_text, CASE WHEN p_partkey % 3 <> 0 THEN 'yes_no' END AS question_type,
      CASE WHEN p_partkey % 3 = 0 THEN 'refer_to_manual' END AS outcome_type, 0.7 AS confidence_score FROM {part}
    UNION ALL SELECT p_partkey, 'a', 'r' || CAST(p_partkey AS VARCHAR), 'yes', 0, 'outcome', NULL, NULL, p_brand, 0.9 FROM {part} WHERE p_partkey % 3 <> 0
    UNION ALL SELECT p_partkey, 'root.no', 'r' || CAST(p_partkey AS VARCHAR), 'no', 1, 'outcome', NULL, NULL, 'refer_to_manual', 0.3 FROM {part} WHERE p_partkey % 3 <> 0""",
    "part",
)
def t01_t03_parse_tree(t):
    name = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))
    yes = F.to_json(F.struct(F.lit("a").alias("node_id"), F.lit("outcome").alias("node_type"), F.col("p_brand").alias("outcome_type"), F.lit(0.9).alias("confidence_score")))
    head = F.to_json(F.struct(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("question").alias("node_type"), F.struct(name.alias("question_text"), F.lit("odd").alias("question_type")).alias("question")))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"children":{"yes":'), yes, F.lit(',"no":{}}}'))
    return T.parse_nodes(t.select(F.col("p_partkey").alias("tree_id"), body.alias("json"))).drop("options")
