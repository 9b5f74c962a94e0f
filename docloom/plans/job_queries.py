"""Queries over the job store and the review domain, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import jobs, review
from docloom.plans.registration import Registry

registry = Registry()
query = registry.query


@query("SELECT job_id, status, created_at FROM {jobs} WHERE status = 'completed' ORDER BY created_at DESC, job_id LIMIT 50", "jobs")
def j01_list_jobs(t):
    return jobs.list_jobs(t, "completed").select("job_id", "status", "created_at")


@query("SELECT status, count(*) AS n FROM {jobs} GROUP BY status", "jobs")
def j02_count_jobs(t):
    return t.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING') AS name_exists FROM {orders} o", "orders", "customer")
def j03_policy_name_exists(o, c):
    known = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")).distinct().withColumn("hit", F.lit(True))
    return o.join(known, "o_custkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("name_exists"))


@query(
    """SELECT job_id, min(CASE WHEN event_type = 'processing' THEN ts END) AS started_at, max(CASE WHEN event_type IN ('completed', 'failed') THEN ts END) AS completed_at,
    arg_max(event_type, event_id) AS status, round(CAST(epoch_us(max(CASE WHEN event_type IN ('completed', 'failed') THEN ts END)) - epoch_us(min(CASE WHEN event_type = 'processing' THEN ts END)) AS DOUBLE) / 1000000, 3) AS duration_s
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS nth FROM {job_events}) q GROUP BY job_id""".replace("arg_max(event_type, event_id)", "max(CASE WHEN nth = 1 THEN event_type END)"),
    "job_events",
)
def j06_status_transitions(t):
    return jobs.status_transitions(t).withColumn("duration_s", F.round("duration_s", 3))


@query("SELECT job_id, event_type, ts, event_id FROM {job_events} WHERE job_id = 1", "job_events")
def j08_job_history(t):
    return jobs.history(t, 1).select("job_id", "event_type", "ts", "event_id")


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'processing') AS processing,
    round(avg(CASE WHEN status = 'completed' THEN validation_confidence END), 6) AS average_confidence, round(CAST(count(*) FILTER (WHERE status = 'completed') AS DOUBLE) / count(*), 6) AS success_rate FROM {jobs}""",
    "jobs",
)
def j09_store_statistics(t):
    return jobs.store_statistics(t).withColumns({c: F.round(c, 6) for c in ("average_confidence", "success_rate")})


@query("SELECT doc_id, sha256(text) AS document_hash FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS nth FROM {documents}) q WHERE nth = 1", "documents")
def j11_document_dedup(t):
    hashed = t.select("doc_id", F.sha2("text", 256).alias("document_hash"))
    return hashed.groupBy("document_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "document_hash")


@query(
    """SELECT o_custkey, o_orderkey, status FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS size, sum(CASE WHEN status IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM
    (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status FROM {orders}) a) b
    WHERE size <= 1.2 * 5 OR status = 'processing' OR nth > size - 5""",
    "orders",
)
def j12_bounded_store_prune(o):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    return jobs.pruned(o.select("o_custkey", "o_orderkey", status.alias("status")), 5, "o_custkey", "o_orderkey")


@query(
    """SELECT j.job_id, CASE WHEN j.job_id % 3 = 0 THEN 'archived' ELSE j.status END AS status, j.created_at, coalesce(CASE WHEN j.job_id % 3 = 0 AND j.job_id % 2 = 0 THEN 0.5 END, j.validation_confidence) AS validation_confidence FROM {jobs} j""",
    "jobs",
)
def s08_update_job_merge(t):
    changes = t.where("job_id % 3 = 0").select("job_id", F.lit("archived").alias("status"), F.when(F.col("job_id") % 2 == 0, F.lit(0.5)).alias("validation_confidence"))
    return jobs.merged(t, changes, "job_id").select("job_id", "status", "created_at", "validation_confidence")


@query("SELECT job_id, status FROM {jobs} WHERE job_id % 4 <> 0", "jobs")
def s19_delete_job_data(t):
    return jobs.without_keys(t, t.where("job_id % 4 = 0"), "job_id").select("job_id", "status")


@query("SELECT job_id, coalesce(CASE WHEN job_id % 2 = 0 THEN status END, 'submitted') AS status, CAST(0.7 AS DOUBLE) AS threshold FROM {jobs}", "jobs")
def s07_save_job(t):
    rows, _ = jobs.save_job(t.select("job_id", F.when(F.col("job_id") % 2 == 0, F.col("status")).alias("status"), F.lit(None).cast("double").alias("threshold"), "created_at"))
    return rows.select("job_id", "status", "threshold")


@query("SELECT doc_id, sha256(text) AS document_hash, sha256(to_base64(encode(text))) AS text_hash, sha256(text) || ':p1' AS first_page_id FROM {documents}", "documents")
def s01_s09_document_fingerprints(t):
    return jobs.document_hashes(t)


@query(
    """SELECT doc_id, count(*) AS page_count, round(CAST(sum(strlen(text)) AS DOUBLE) / 1024, 6) AS size_kb, bool_or(length(trim(text)) > 0) AS has_text, substr(arg_min(text, page_number), 1, 200) AS sample FROM {doc_pages} GROUP BY doc_id""",
    "doc_pages",
)
def s05_content_validation(t):
    return jobs.content_validation(t)


@query(
    """SELECT doc_id, line_no, trim(line) AS line, CAST(coalesce(before, 0) AS BIGINT) AS char_start, CAST(coalesce(before, 0) + length(line) AS BIGINT) AS char_end FROM
    (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {doc_lines}) q WHERE trim(line) <> ''""",
    "doc_lines",
)
def s04_line_references(t):
    return jobs.line_references(t)


@query(
    """SELECT session_id, question_id, answer_text, n_chunks FROM (SELECT *, count(*) OVER (PARTITION BY session_id, question_id) AS n_chunks, row_number() OVER (PARTITION BY session_id, question_id
    ORDER BY CASE WHEN answer_text <> 'NOT_FOUND' AND trim(answer_text) <> '' THEN 1 ELSE 0 END DESC, CASE WHEN answer_text <> 'NOT_FOUND' THEN length(answer_text) ELSE 0 END DESC, chunk_ord) AS nth FROM {answers}) q WHERE nth = 1""",
    "answers",
)
def a12_best_answer_merge(t):
    return review.best_answers(t)


@query("SELECT session_id, count(*) FILTER (WHERE answer_text <> 'NOT_FOUND') AS n_found, count(*) FILTER (WHERE answer_text = 'NOT_FOUND') AS n_missing FROM {answers} GROUP BY session_id", "answers")
def a11_answers_found_split(t):
    return review.answers_found(t)


EVALUATED = """SELECT session_id, answer_text, CASE WHEN question_id % 3 = 0 THEN 'No' WHEN question_id % 3 = 1 THEN 'Yes' ELSE 'Partly' END AS meets_requirement, CASE WHEN question_id = 7 THEN 'High' ELSE 'Low' END AS risk_assessment FROM {answers}"""


@query(
    f"""WITH e AS ({EVALUATED}), k AS (SELECT session_id, risk_assessment, CASE WHEN answer_text = 'NOT_FOUND' THEN 'missing' WHEN meets_requirement = 'Yes' THEN 'met' WHEN meets_requirement = 'No' THEN 'not_met' ELSE 'unclear' END AS kind FROM e),
    c AS (SELECT session_id, count(*) AS total, count(*) FILTER (WHERE kind = 'met') AS met, count(*) FILTER (WHERE kind = 'not_met') AS not_met, count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'unclear') AS unclear, bool_or(risk_assessment = 'High') AS critical FROM k GROUP BY session_id)
    SELECT *, CASE WHEN critical OR not_met > 3 THEN 'High' WHEN missing > 5 OR unclear > 3 THEN 'Medium' ELSE 'Low' END AS overall_risk, met >= floor(total * 0.75) AND not_met <= 2 AS approve_by_rule FROM c""",
    "answers",
)
def a15_a17_requirement_counts(t):
    kind = F.when(F.col("question_id") % 3 == 0, "No").when(F.col("question_id") % 3 == 1, "Yes").otherwise("Partly")
    return review.requirement_counts(t.select("session_id", "answer_text", kind.alias("meets_requirement"), F.when(F.col("question_id") == 7, "High").otherwise("Low").alias("risk_assessment")))


@query("SELECT session_id, question_id, chunk_ord, CAST((row_number() OVER (PARTITION BY session_id ORDER BY question_id, chunk_ord) - 1) // 3 AS BIGINT) AS batch FROM {answers}", "answers")
def a23_evaluation_batches(t):
    nth = t.withColumn("question_key", F.struct("question_id", "chunk_ord"))
    return review.batches(nth.drop("question_id").withColumnRenamed("question_key", "question_id"), 3).select("session_id", "question_id.question_id", "question_id.chunk_ord", "batch")


@query("SELECT policy_id, ord, condition_id, CAST(row_number() OVER (PARTITION BY policy_id ORDER BY description, condition_id) AS INT) AS order_index FROM {conditions}", "conditions")
def a04_reorder_questions(t):
    return review.renumbered(t, "policy_id", ["description", "condition_id"]).select("policy_id", "ord", "condition_id", "order_index")


@query("SELECT policy_id, ord, substr(description, 1, 20) AS description FROM {conditions} WHERE ord <= 3", "conditions")
def a19_summarise_questions(t):
    return review.top_per_group(t, ["policy_id"], [F.col("ord")], 3).select("policy_id", "ord", F.left("description", F.lit(20)).alias("description"))


CALLS = "SELECT event_id, user_id AS job_id, event_type AS model, CAST(event_id % 1000 AS BIGINT) AS input_tokens, CAST(event_id % 77 AS BIGINT) AS output_tokens FROM {events}"


@query(
    f"""WITH calls AS ({CALLS}), priced AS (SELECT *, CASE model WHEN 'click' THEN 2.5 WHEN 'view' THEN 0.15 END AS ip, CASE model WHEN 'click' THEN 10.0 WHEN 'view' THEN 0.6 END AS op FROM calls),
    c AS (SELECT *, coalesce(CAST(input_tokens AS DOUBLE) / 1000000 * ip + CAST(output_tokens AS DOUBLE) / 1000000 * op, 0) AS cost FROM priced),
    g AS (SELECT model, input_tokens, output_tokens, cost FROM c UNION ALL SELECT NULL, input_tokens, output_tokens, cost FROM c)
    SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 6) AS cost, count(*) AS calls, round(CASE WHEN sum(input_tokens + output_tokens) > 0 THEN sum(cost) / sum(input_tokens + output_tokens) * 1000000 END, 6) AS per_million FROM g GROUP BY model""",
    "events",
)
def a25_a28_call_costs(t):
    calls = t.select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    prices = t.sparkSession.createDataFrame([("click", 2.5, 10.0), ("view", 0.15, 0.6)], "model string, input_price double, output_price double")
    return review.cost_totals(review.call_costs(calls, F.broadcast(prices)))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 10 + 35 * (o_orderkey % 9) + 15 WHEN 'O' THEN 8 + 25 * (o_orderkey % 9) + 12 ELSE 3 + 2 * (o_orderkey % 9) + 8 END AS seconds FROM {orders}", "orders")
def a32_time_estimate(o):
    kind = F.when(F.col("o_orderstatus") == "F", "policy").when(F.col("o_orderstatus") == "O", "application").otherwise("decision")
    return o.select("o_orderkey", review.time_estimate(kind, F.col("o_orderkey") % 9).alias("seconds"))


@query(
    """SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN trim(value) <> '' THEN 1 ELSE 0 END DESC, event_id DESC) AS nth FROM
    (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' || CAST(event_id AS VARCHAR(20)) END AS value FROM {events}) a) b WHERE nth = 1""",
    "events",
)
def a14_patient_info_merge(t):
    value = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    return review.merged_values(t.select("user_id", "event_type", "event_id", value.alias("value")), "user_id", "event_type", "value", "event_id")


@query("SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'general') AS criterion, count(*) AS n, min(event_id) AS first_id FROM {events} GROUP BY 1", "events")
def a34_questions_by_type(t):
    kind = F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("general"))
    return t.groupBy(kind.alias("criterion")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT session_id, count(*) AS n_found FROM {answers} WHERE answer_text <> 'NOT_FOUND' AND answer_text <> '' GROUP BY session_id", "answers")
def a24_found_answers(t):
    return t.where(review.found(F.col("answer_text"))).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_found"))
