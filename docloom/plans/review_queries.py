"""Queries over the review domain and the store's sinks, each operator on its own, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import entities as E
from docloom.operators import jobs, review
from docloom.operators import trees as T
from docloom.plans.registration import Registry
from docloom.sources.keyed import KeyedTable
from docloom.staging import new_path
from docloom.sources import store

registry = Registry()
query = registry.query

NOW = "2024-06-01 12:00:00"

# Questionnaires are parts, sessions are orders, answers are lines of orders.
QUESTIONNAIRES = "SELECT p_partkey AS id, p_size AS policy_id, p_name AS name, p_partkey % 3 = 0 AS is_approved, CASE WHEN p_partkey % 3 = 0 THEN '2024-01-01' END AS approved_at FROM {part}"
SESSIONS = "SELECT o_orderkey AS id, o_custkey AS application_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'Pending' END ELSE 'In Review' END AS status, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END AS final_recommendation, CASE WHEN o_orderkey % 4 = 0 THEN '2024-02-02' END AS completed_at FROM {orders}"
LINES = "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS id, l_orderkey AS session_id, CASE WHEN l_returnflag = 'R' THEN 'NOT_FOUND' ELSE l_linestatus || CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS answer_text, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'r' || CAST(l_partkey AS VARCHAR) END AS reasoning, CASE l_linenumber % 2 WHEN 0 THEN NULL ELSE 'c' || CAST(l_suppkey AS VARCHAR) END AS clinical_rationale, CASE WHEN l_linenumber % 4 > 0 THEN l_linenumber % 4 - 1 END AS source_page_number FROM {lineitem}"


def questionnaires(p):
    three = F.col("p_partkey") % 3 == 0
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("policy_id"), F.col("p_name").alias("name"), three.alias("is_approved"), F.when(three, "2024-01-01").alias("approved_at"))


def sessions(o):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(s == "F", "completed").when(s == "O", F.when(k % 2 == 0, "pending").otherwise("Pending")).otherwise("In Review")
    return o.select(k.alias("id"), F.col("o_custkey").alias("application_id"), status.alias("status"), F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.col("o_orderpriority")).alias("final_recommendation"), F.when(k % 4 == 0, "2024-02-02").alias("completed_at"))


def answers(t):
    """Answers without an id of their own: the key is all that tells lines apart."""
    n = F.col("l_linenumber")
    return t.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_extendedprice").cast("decimal(20,2)")).alias("id"),
        F.col("l_orderkey").alias("session_id"),
        F.when(F.col("l_returnflag") == "R", "NOT_FOUND").otherwise(F.concat("l_linestatus", F.col("l_quantity").cast("int").cast("string"))).alias("answer_text"),
        F.when(n % 3 == 0, None).when(n % 3 == 1, "").otherwise(F.concat(F.lit("r"), F.col("l_partkey").cast("string"))).alias("reasoning"),
        F.when(n % 2 != 0, F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))).alias("clinical_rationale"),
        F.when(n % 4 > 0, (n % 4 - 1).cast("int")).alias("source_page_number"),
    )


ANSWERS = LINES.replace("row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice)", "CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS VARCHAR)")


@query(f"SELECT id, policy_id, name FROM ({QUESTIONNAIRES}) q WHERE is_approved", "part")
def a01_approved_questionnaires(p):
    return questionnaires(p).where("is_approved").select("id", "policy_id", "name")


@query(f"SELECT id, policy_id, name FROM ({QUESTIONNAIRES}) q WHERE policy_id IN (SELECT n_nationkey FROM {{nation}})", "part", "nation")
def a02_questionnaires_by_policy(p, n):
    return review.by_keys(questionnaires(p), n.select(F.col("n_nationkey").alias("policy_id")), "policy_id").select("id", "policy_id", "name")


@query(f"SELECT id, session_id, answer_text FROM ({ANSWERS}) a WHERE session_id IN (SELECT o_orderkey FROM {{orders}} WHERE o_orderpriority = '1-URGENT')", "lineitem", "orders")
def a09_answers_by_session(t, o):
    return review.by_keys(answers(t), o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("session_id")), "session_id").select("id", "session_id", "answer_text")


@query(f"SELECT id, application_id, status FROM ({SESSIONS}) s WHERE status IN ('pending', 'Pending')", "orders")
def a35_pending_sessions(o):
    return review.pending(sessions(o)).select("id", "application_id", "status")


@query(f"SELECT id, application_id, final_recommendation FROM ({SESSIONS}) s WHERE status = 'completed' AND final_recommendation <> ''", "orders")
def a36_decided_sessions(o):
    return review.decided(sessions(o)).select("id", "application_id", "final_recommendation")


@query("SELECT p_partkey AS question_id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'edited ' || p_brand ELSE p_name END AS question_text, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 = 0 THEN 'yes_no' ELSE p_type END AS question_type, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS page_number FROM {part}", "part")
def a05_update_question(p):
    k = F.col("p_partkey")
    table = p.select(k.alias("question_id"), F.col("p_name").alias("question_text"), F.col("p_type").alias("question_type"), F.col("p_size").alias("page_number"))
    size = (F.col("p_size") + 1).cast(p.schema["p_size"].dataType)
    changes = p.where(k % 3 == 0).select(k.alias("question_id"), F.when(k % 2 == 0, F.concat(F.lit("edited "), "p_brand")).alias("question_text"), F.when(k % 5 == 0, "yes_no").alias("question_type"), size.alias("page_number"))
    return jobs.merged(table, changes, "question_id")


@query(f"SELECT id, policy_id, name, is_approved OR policy_id IN (SELECT n_nationkey FROM {{nation}}) AS is_approved, CASE WHEN policy_id IN (SELECT n_nationkey FROM {{nation}}) THEN '{NOW}' ELSE approved_at END AS approved_at FROM ({QUESTIONNAIRES}) q", "part", "nation")
def a39_approve_questionnaire(p, n):
    rows = questionnaires(p)
    return review.approved(rows, review.by_keys(rows, n.select(F.col("n_nationkey").alias("policy_id")), "policy_id"), F.lit(NOW))


CHANGED = "id % 3 = 1"
NEW_STATUS = "CASE id % 4 WHEN 0 THEN 'Completed' WHEN 1 THEN 'completed' WHEN 2 THEN 'pending' ELSE 'In Review' END"


@query(f"SELECT id, CASE WHEN {CHANGED} THEN {NEW_STATUS} ELSE status END AS status, CASE WHEN {CHANGED} AND id % 7 = 0 THEN 'Approved' ELSE final_recommendation END AS final_recommendation, CASE WHEN {CHANGED} AND id % 4 < 2 THEN '{NOW}' ELSE completed_at END AS completed_at FROM ({SESSIONS}) s", "orders")
def a40_update_session_status(o):
    rows = sessions(o).drop("application_id")
    k = F.col("id")
    status = F.when(k % 4 == 0, "Completed").when(k % 4 == 1, "completed").when(k % 4 == 2, "pending").otherwise("In Review")
    changes = rows.where(CHANGED).select("id", status.alias("status"), F.when(k % 7 == 0, "Approved").when(k % 7 == 1, "").alias("recommendation"))
    return review.updated_status(rows, changes, F.lit(NOW))


@query(f"SELECT id, CASE WHEN {CHANGED} AND id % 2 = 0 THEN 'high' ELSE application_id END AS review_priority, CASE WHEN {CHANGED} AND id % 5 = 0 THEN 'Denied' ELSE final_recommendation END AS final_recommendation, CASE WHEN {CHANGED} THEN 'In Review' ELSE status END AS status FROM (SELECT id, CAST(application_id AS VARCHAR) AS application_id, status, final_recommendation FROM ({SESSIONS}) s) q", "orders")
def a41_update_session(o):
    rows = sessions(o).select("id", F.col("application_id").cast("string").alias("review_priority"), "final_recommendation", "status")
    k = F.col("id")
    changes = rows.where(CHANGED).select("id", F.when(k % 2 == 0, "high").alias("review_priority"), F.when(k % 5 == 0, "Denied").alias("final_recommendation"), F.lit("In Review").alias("status"))
    return jobs.merged(rows, changes, "id")


@query(f"SELECT id, CASE WHEN session_id % 3 = 0 AND source_page_number = 1 THEN 'found' ELSE answer_text END AS answer_text, CASE WHEN session_id % 3 = 0 THEN 'checked' ELSE reasoning END AS reasoning FROM ({ANSWERS}) a", "lineitem")
def a42_update_answer(t):
    rows = answers(t).select("id", "session_id", "answer_text", "reasoning", "source_page_number")
    changes = rows.where("session_id % 3 = 0").select("id", F.when(F.col("source_page_number") == 1, "found").alias("answer_text"), F.lit("checked").alias("reasoning")).dropDuplicates(["id"])
    return jobs.merged(rows, changes, "id").select("id", "answer_text", "reasoning")


@query("SELECT o_orderkey, CASE WHEN extracted <> '' AND extracted <> 'Not Found' AND length(trim(extracted)) > length(trim(entered)) THEN extracted ELSE entered END AS name FROM (SELECT o_orderkey, c_name AS entered, CASE o_orderkey % 4 WHEN 0 THEN 'Not Found' WHEN 1 THEN '' WHEN 2 THEN c_name || ' ' || o_orderstatus WHEN 3 THEN left(c_name, 5) END AS extracted FROM {orders} JOIN {customer} ON c_custkey = o_custkey) q", "orders", "customer")
def a37_reconcile_name(o, c):
    k = F.col("o_orderkey")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    extracted = F.when(k % 4 == 0, "Not Found").when(k % 4 == 1, "").when(k % 4 == 2, F.concat("c_name", F.lit(" "), "o_orderstatus")).otherwise(F.left("c_name", F.lit(5)))
    return rows.select("o_orderkey", review.reconciled_name(F.col("c_name"), extracted).alias("name"))


@query(f"SELECT id, answer_text, coalesce(nullif(reasoning, ''), nullif(clinical_rationale, ''), '') AS reasoning, CASE WHEN answer_text = 'NOT_FOUND' THEN 0 ELSE 95 END AS confidence_score, CASE WHEN coalesce(source_page_number, 0) <> 0 THEN CAST(source_page_number AS VARCHAR) ELSE '' END AS page_references FROM ({ANSWERS}) a", "lineitem")
def a38_answer_payload(t):
    return review.answer_payload(answers(t))


@query("SELECT job_id, CASE WHEN job_id % 3 = 0 THEN status ELSE NULL END AS status, CASE WHEN job_id % 3 = 0 THEN created_at END AS created_at FROM {jobs} WHERE job_id IN (SELECT job_id FROM {job_events}) OR job_id % 3 = 0", "jobs", "job_events")
def j05_get_job(j, e):
    """Jobs that events ask for, and every third, of which the whole row is read."""
    asked = j.where("job_id % 3 = 0").select("job_id").union(e.select("job_id"))
    whole = F.col("job_id") % 3 == 0
    return review.by_keys(j, asked, "job_id").select("job_id", F.when(whole, F.col("status")).alias("status"), F.when(whole, F.col("created_at")).alias("created_at"))


HIERARCHY = "struct<total_policies:int>"


@query("SELECT p_partkey AS job_id, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 ELSE p_size END AS total_policies, CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE p_partkey % 3 END AS total_decision_trees FROM {part}", "part")
def s11_update_results(p):
    k = F.col("p_partkey")

    def hierarchy(n):
        return F.to_json(F.struct(n.cast("int").alias("total_policies")))

    def trees(n):
        return F.to_json(F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= n), lambda i: F.struct(i.alias("tree_id"))))

    table = p.select(k.alias("job_id"), hierarchy(F.col("p_size")).alias("policy_hierarchy_json"), trees(k % 3).alias("decision_trees_json"))
    changes = p.where("p_partkey % 3 = 0 or p_partkey % 4 = 0").select(k.alias("job_id"), F.when(k % 3 == 0, hierarchy(F.col("p_size") * 2)).alias("policy_hierarchy_json"), F.when(k % 4 == 0, trees(F.lit(3))).alias("decision_trees_json"))
    return store.updated_results(table, changes, HIERARCHY).select("job_id", "total_policies", "total_decision_trees")


@query("SELECT t.tree_id, t.node_id, t.parent_node_id, CASE WHEN t.node_id % 4 = 1 THEN 'revised' ELSE t.outcome_type END AS outcome_type, CASE WHEN t.node_id % 4 = 1 AND t.node_id % 3 = 0 THEN 'maybe' ELSE t.answer END AS answer FROM {tree_nodes} t", "tree_nodes")
def t22_edit_trees(n):
    """Edits of nodes by tree and node: non-null columns overwrite."""
    key = F.concat_ws("/", F.col("tree_id").cast("string"), F.col("node_id").cast("string")).alias("key")
    rows = n.select(key, "tree_id", "node_id", "parent_node_id", "outcome_type", "answer")
    changes = n.where("node_id % 4 = 1").select(key, F.lit("revised").alias("outcome_type"), F.when(F.col("node_id") % 3 == 0, "maybe").alias("answer"))
    return jobs.merged(rows, changes, "key").drop("key")


@query("SELECT job_id, status, strftime(created_at, '%Y-%m-%d') AS created, validation_confidence AS confidence FROM {jobs}", "jobs")
def s13_export_json(j):
    """Results written as JSON and read back."""
    path = new_path(j.sparkSession, "export")
    store.export_json(j.select("job_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.col("validation_confidence").alias("confidence")), path)
    return store.read_json(j.sparkSession, path, "job_id long, status string, created string, confidence double")


@query("SELECT '2024-06-01T12:00:00' AS timestamp, agent, count(*) AS samples, round(max(cpu_percent), 4) AS cpu FROM {metric_samples} GROUP BY agent UNION ALL SELECT '2024-06-01T13:00:00', agent, count(*), round(min(cpu_percent), 4) FROM {metric_samples} GROUP BY agent", "metric_samples")
def s14_metrics_snapshot_json(t):
    """Two snapshots appended to one place, read back."""
    path = new_path(t.sparkSession, "snapshots")
    for hour, of in ((12, F.max), (13, F.min)):
        store.snapshot(t.groupBy("agent").agg(F.count(F.lit(1)).alias("samples"), F.round(of("cpu_percent"), 4).alias("cpu")), F.lit(f"2024-06-01 {hour}:00:00").cast("timestamp"), path)
    return store.read_json(t.sparkSession, path, "timestamp string, agent string, samples long, cpu double")


@query(f"SELECT id, answer_text, CASE WHEN source_page_number = 1 THEN 0.5 ELSE 0.0 END AS confidence_score FROM ({ANSWERS}) a", "lineitem")
def s17_save_answers(t):
    """Answers appended in two batches and read back."""
    path = new_path(t.sparkSession, "answers")
    rows = answers(t).select("id", "session_id", "answer_text", F.when(F.col("source_page_number") == 1, 0.5).alias("confidence_score"))
    for batch in (rows.where("session_id % 2 = 0"), rows.where("session_id % 2 = 1")):
        store.save_answers(batch, path)
    return t.sparkSession.read.schema(rows.schema).parquet(path).select("id", "answer_text", "confidence_score")


def made_responses(p):
    """Responses of all shapes: failed, without results, without a job, with and without parts."""
    k = F.col("p_partkey")
    parts = {
        "job_id": F.when(k % 7 != 3, F.concat(F.lit("j"), k.cast("string"))),
        "status": F.when(k % 2 == 0, "completed"),
        "metadata": F.when(k % 3 != 0, F.struct(F.when(k % 3 == 1, F.col("p_brand")).alias("document_type"), F.col("p_size").cast("int").alias("total_pages"))),
        "policy_hierarchy": F.when(k % 4 != 0, F.struct((k % 9).cast("int").alias("total_policies"))),
        "decision_trees": F.when(k % 5 != 0, F.filter(F.array(F.lit("a"), F.lit("b")), lambda x: (k % 5 > 1) | (x == "a"))),
        "validation_result": F.when(k % 6 != 0, F.struct((k % 10 / 10).alias("overall_confidence"), (k % 2 == 0).alias("is_valid"))),
        "processing_stats": F.when(k % 8 != 0, F.struct((k % 13).cast("double").alias("processing_time_seconds"))),
    }
    results = F.when(k % 11 != 5, F.struct(*[v.alias(n) for n, v in parts.items()]))
    content = F.to_json(F.struct(F.when(k % 10 == 9, "failed").alias("status"), results.alias("results")))
    return p.select(content.alias("content"), F.encode("p_name", "utf-8").alias("document"), F.concat("p_brand", F.lit(".pdf")).alias("filename"), F.col("p_type").alias("policy_name"))


GOOD = "p_partkey % 10 <> 9 AND p_partkey % 11 <> 5 AND p_partkey % 7 <> 3"
JOB = "'j' || CAST(p_partkey AS VARCHAR)"


@query(
    f"""SELECT {JOB} AS job_id, p_type AS policy_name, p_brand || '.pdf' AS filename, sha256(p_name) AS document_hash, length(p_name) AS file_size_bytes, coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'completed' END, 'completed') AS status, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_brand ELSE 'unknown' END AS document_type, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS total_pages,
    CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 9 END AS total_policies, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 2 END AS total_decision_trees, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 10 AS DOUBLE) / 10 END AS validation_confidence, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 2 = 0 END AS validation_passed,
    CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_partkey % 13 AS DOUBLE) END AS processing_time_seconds, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS pages_in_result FROM {{part}} WHERE {GOOD}""",
    "part",
)
def s16_ingest_response(p):
    """The three tables, joined again by job."""
    documents, made, results = store.ingest(made_responses(p))
    pages = F.get_json_object("results_json", "$.metadata.total_pages").cast("int").alias("pages_in_result")
    return documents.drop("content_base64", "mime_type").join(made.drop("policy_name"), "job_id").join(results.select("job_id", pages), "job_id")


@query("SELECT p_partkey % 50 AS job_id, count(*) AS chunks, count(*) FILTER (WHERE p_partkey % 4 = 1) AS failed, CAST(sum(CASE WHEN p_partkey % 4 <> 1 THEN p_partkey % 3 ELSE 0 END) AS BIGINT) AS policies FROM {part} GROUP BY 1", "part")
def e17_extract_policies(p):
    """Policies of all chunks' responses; those that failed or don't parse are counted and skipped."""
    k = F.col("p_partkey")
    one = F.struct(F.concat(F.lit("p"), k.cast("string")).alias("policy_id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"))
    body = F.to_json(F.struct(F.filter(F.array(one, one), lambda x: k % 3 > 0).alias("policies")))
    single = F.to_json(F.struct(F.filter(F.array(one), lambda x: k % 3 > 0).alias("policies")))
    content = F.when(k % 4 == 1, F.when(k % 8 == 1, "no JSON at all")).otherwise(F.when(k % 3 == 2, body).otherwise(single))
    return E.extraction_summary(p.select((k % 50).alias("job_id"), k.alias("response_id"), content.alias("content")))


@query(
    """WITH RECURSIVE w AS (SELECT tree_id, node_id FROM {tree_nodes} WHERE parent_node_id IS NULL UNION SELECT c.tree_id, c.node_id FROM w JOIN {tree_nodes} c ON c.tree_id = w.tree_id AND c.parent_node_id = w.node_id)
    SELECT r.tree_id, r.next_node_id AS node_id, t.node_type, w.node_id IS NOT NULL AS found FROM {routing_rules} r LEFT JOIN w ON w.tree_id = r.tree_id AND w.node_id = r.next_node_id LEFT JOIN {tree_nodes} t ON t.tree_id = w.tree_id AND t.node_id = w.node_id""",
    "tree_nodes",
    "routing_rules",
)
def t10b_find_node(n, r):
    return T.find_nodes(n, r.select("tree_id", F.col("next_node_id").alias("node_id"))).select("tree_id", "node_id", "node_type", "found")


def stored(rows, key: str) -> KeyedTable:
    """``rows`` as a stored table of its own."""
    table = KeyedTable(rows.sparkSession, new_path(rows.sparkSession, "stored") + "/table", key, rows.schema, buckets=16)
    table.create(rows)
    return table


@query(
    """SELECT job_id, CASE WHEN job_id % 64 = 5 THEN 'reopened' WHEN job_id % 32 = 5 THEN 'archived' ELSE status END AS status, created_at, coalesce(CASE WHEN job_id % 32 = 5 AND job_id % 3 = 0 THEN 0.5 END, validation_confidence) AS validation_confidence FROM {jobs} WHERE job_id % 32 <> 7""",
    "jobs",
)
def s08_s19_stored_jobs(j):
    """Two updates and a deletion in a row against a stored table, read back."""
    rows = j.select("job_id", "status", "created_at", F.col("validation_confidence").cast("double").alias("validation_confidence"))
    table = stored(rows, "job_id")
    nothing = F.lit(None).cast("double").alias("validation_confidence")
    table.update(rows.where("job_id % 32 = 5").select("job_id", F.lit("archived").alias("status"), F.when(F.col("job_id") % 3 == 0, 0.5).alias("validation_confidence")))
    table.update(rows.where("job_id % 64 = 5").select("job_id", F.lit("reopened").alias("status"), nothing))
    table.delete(rows.where("job_id % 32 = 7"))
    return table.read()


@query(
    """SELECT job_id, event_type, details FROM (SELECT job_id, 'created' AS event_type, NULL AS details FROM {jobs} UNION ALL SELECT job_id, 'archived', '{"reason":"old"}' FROM {jobs} WHERE job_id % 32 = 5) q""",
    "jobs",
)
def s07_job_history(j):
    """The history table: a row for every job that is saved, appended to when some are archived."""
    jobs_rows, created = jobs.save_job(j.select("job_id", "status", F.lit(None).cast("double").alias("threshold"), "created_at"))
    history = stored(created.select("job_id", "event_type", F.lit(None).cast("string").alias("details")), "job_id")
    history.append(jobs_rows.where("job_id % 32 = 5").select("job_id", F.lit("archived").alias("event_type"), F.to_json(F.struct(F.lit("old").alias("reason"))).alias("details")))
    return history.read()


@query(
    """SELECT p_partkey AS question_id, CASE WHEN p_partkey % 40 = 0 AND p_partkey % 3 = 0 THEN 'twice' WHEN p_partkey % 40 = 0 THEN 'edited ' || p_brand ELSE p_name END AS question_text, p_type AS question_type FROM {part} WHERE p_partkey % 40 <> 1""",
    "part",
)
def a05_a06_stored_questions(p):
    """Questions edited twice and deleted in a stored table."""
    k = F.col("p_partkey")
    rows = p.select(k.alias("question_id"), F.col("p_name").alias("question_text"), F.col("p_type").alias("question_type"))
    table = stored(rows, "question_id")
    table.update(p.where(k % 40 == 0).select(k.alias("question_id"), F.concat(F.lit("edited "), "p_brand").alias("question_text")))
    table.update(p.where((k % 40 == 0) & (k % 3 == 0)).select(k.alias("question_id"), F.lit("twice").alias("question_text")))
    table.delete(rows.where("question_id % 40 = 1"))
    return table.read()


@query(
    f"SELECT id, CASE WHEN id % 30 = 1 THEN {NEW_STATUS} ELSE status END AS status, CASE WHEN id % 30 = 2 THEN 'Denied' WHEN id % 30 = 1 AND id % 7 = 0 THEN 'Approved' ELSE final_recommendation END AS final_recommendation, CASE WHEN id % 30 = 1 AND id % 4 < 2 THEN '{NOW}' ELSE completed_at END AS completed_at FROM ({SESSIONS}) s",
    "orders",
)
def a40_a41_stored_sessions(o):
    """A status update and an update of other columns, in a row, in a stored table."""
    rows = sessions(o).drop("application_id")
    k = F.col("id")
    status = F.when(k % 4 == 0, "Completed").when(k % 4 == 1, "completed").when(k % 4 == 2, "pending").otherwise("In Review")
    changes = rows.where("id % 30 = 1").select("id", status.alias("status"), F.when(k % 7 == 0, "Approved").alias("recommendation"))
    table = stored(rows, "id")
    table.edit(changes, lambda old: review.updated_status(old, changes, F.lit(NOW)))
    table.update(rows.where("id % 30 = 2").select("id", F.lit("Denied").alias("final_recommendation")))
    return table.read()
