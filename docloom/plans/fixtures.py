"""Input tables of the library's queries, derived from the driver's tables by one rule each.

Every fixture has a statement for Spark and one for DuckDB that give the same rows.
``{name}`` is another fixture or a table.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from docloom.staging import stage

TABLES = ("documents", "part", "lineitem", "customer", "orders", "events")

# name: (Spark, DuckDB)
FIXTURES: dict[str, tuple[str, str]] = {
    "doc_lines": (
        r"""SELECT doc_id, pos+1 AS line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line""",
        r"""SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM {documents}""",
    ),
    # A document's lines meet where its pages and whatever is joined by document are needed, so its text is shuffled once.
    "doc_pages": (
        r"""SELECT doc_id, CAST(floor((line_no-1)/5) AS BIGINT)+1 AS page_number, array_join(transform(array_sort(collect_list(struct(line_no,line))), x->x.line), '\n') AS text FROM (SELECT doc_id, pos+1 AS line_no, line FROM (SELECT /*+ REPARTITION(doc_id) */ doc_id, text FROM {documents}) d LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line) l GROUP BY 1,2""",
        r"""SELECT doc_id, (line_no-1)//5+1 AS page_number, string_agg(line, chr(10) ORDER BY line_no) AS text FROM {doc_lines} GROUP BY 1,2""",
    ),
    "policies": (
        r"""SELECT job_id, k AS ord, policy_id, CASE WHEN k=0 OR k%17=0 THEN NULL WHEN k%23=0 THEN 'p999999' ELSE 'p'||CAST(job_id*100+CAST(floor((k-1)/3) AS BIGINT) AS VARCHAR(20)) END AS parent_id, p_name AS title, p_name||' '||p_type||' '||p_brand AS description, p_size/50.0 AS confidence FROM (SELECT CAST(floor(p_partkey/100) AS BIGINT) AS job_id, p_partkey%100 AS k, 'p'||CAST(p_partkey AS VARCHAR(20)) AS policy_id, p_name,p_type,p_brand,p_size FROM {part}) q""",
        r"""SELECT job_id, k AS ord, policy_id, CASE WHEN k=0 OR k%17=0 THEN NULL WHEN k%23=0 THEN 'p999999' ELSE 'p'||CAST(job_id*100+(k-1)//3 AS VARCHAR(20)) END AS parent_id, p_name AS title, p_name||' '||p_type||' '||p_brand AS description, p_size/50.0 AS confidence FROM (SELECT p_partkey//100 AS job_id, p_partkey%100 AS k, 'p'||CAST(p_partkey AS VARCHAR(20)) AS policy_id, p_name,p_type,p_brand,p_size FROM {part}) q""",
    ),
    # The same in twenty jobs that grow with the table.
    "large_jobs": (
        r"""SELECT job_id, k AS ord, policy_id, CASE WHEN k=0 OR k%17=0 THEN NULL WHEN k%23=0 THEN 'p999999' ELSE 'p'||CAST(CAST(floor((k-1)/3) AS BIGINT)*20+job_id AS VARCHAR(20)) END AS parent_id, p_name AS title, p_name||' '||p_type||' '||p_brand AS description, p_size/50.0 AS confidence FROM (SELECT p_partkey%20 AS job_id, CAST(floor(p_partkey/20) AS BIGINT) AS k, 'p'||CAST(p_partkey AS VARCHAR(20)) AS policy_id, p_name,p_type,p_brand,p_size FROM {part}) q""",
        r"""SELECT job_id, k AS ord, policy_id, CASE WHEN k=0 OR k%17=0 THEN NULL WHEN k%23=0 THEN 'p999999' ELSE 'p'||CAST(((k-1)//3)*20+job_id AS VARCHAR(20)) END AS parent_id, p_name AS title, p_name||' '||p_type||' '||p_brand AS description, p_size/50.0 AS confidence FROM (SELECT p_partkey%20 AS job_id, p_partkey//20 AS k, 'p'||CAST(p_partkey AS VARCHAR(20)) AS policy_id, p_name,p_type,p_brand,p_size FROM {part}) q""",
    ),
    "few_policies": (
        r"""SELECT job_id, k AS ord, policy_id, CASE WHEN k=0 OR k=5 THEN NULL WHEN job_id%3=0 THEN 'p'||CAST(p_partkey-k AS VARCHAR(20)) ELSE 'p'||CAST(p_partkey-k+CAST(floor((k-1)/2) AS BIGINT) AS VARCHAR(20)) END AS parent_id, CASE WHEN job_id%4=1 THEN p_name||' part '||CAST(k AS VARCHAR(20)) ELSE p_name END AS title, p_name||' '||p_type||' '||p_brand AS description, p_size/50.0 AS confidence FROM (SELECT CAST(floor(p_partkey/6) AS BIGINT) AS job_id, p_partkey%6 AS k, 'p'||CAST(p_partkey AS VARCHAR(20)) AS policy_id, p_partkey, p_name,p_type,p_brand,p_size FROM {part}) q""",
        r"""SELECT job_id, k AS ord, policy_id, CASE WHEN k=0 OR k=5 THEN NULL WHEN job_id%3=0 THEN 'p'||CAST(p_partkey-k AS VARCHAR(20)) ELSE 'p'||CAST(p_partkey-k+(k-1)//2 AS VARCHAR(20)) END AS parent_id, CASE WHEN job_id%4=1 THEN p_name||' part '||CAST(k AS VARCHAR(20)) ELSE p_name END AS title, p_name||' '||p_type||' '||p_brand AS description, p_size/50.0 AS confidence FROM (SELECT p_partkey//6 AS job_id, p_partkey%6 AS k, 'p'||CAST(p_partkey AS VARCHAR(20)) AS policy_id, p_partkey, p_name,p_type,p_brand,p_size FROM {part}) q""",
    ),
    "conditions": (
        r"""SELECT policy_id, ord, policy_id||'_c'||CAST(ord AS VARCHAR(20)) AS condition_id, description FROM (SELECT 'p'||CAST(l_partkey AS VARCHAR(20)) AS policy_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey,l_linenumber,l_suppkey,l_extendedprice) AS ord, 'quantity at least '||CAST(CAST(l_quantity AS INT) AS VARCHAR(20))||' with status '||l_linestatus||' and flag '||l_returnflag AS description FROM {lineitem}) q""",
        r"""SELECT policy_id, ord, policy_id||'_c'||CAST(ord AS VARCHAR(20)) AS condition_id, description FROM (SELECT 'p'||CAST(l_partkey AS VARCHAR(20)) AS policy_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey,l_linenumber,l_suppkey,l_extendedprice) AS ord, 'quantity at least '||CAST(CAST(l_quantity AS INT) AS VARCHAR(20))||' with status '||l_linestatus||' and flag '||l_returnflag AS description FROM {lineitem}) q""",
    ),
    "tree_nodes": (
        r"""SELECT tree_id, idx AS node_id, CASE WHEN idx>1 THEN CAST(floor(idx/2) AS BIGINT) END AS parent_node_id, CASE WHEN idx=1 THEN NULL WHEN idx%2=0 THEN 'yes' ELSE 'no' END AS answer, idx%2 AS sibling_ord, CASE WHEN 2*idx>n THEN 'outcome' ELSE 'question' END AS node_type, CASE WHEN 2*idx>n THEN lower(c_mktsegment) END AS outcome_type FROM (SELECT c_nationkey AS tree_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS idx, count(*) OVER (PARTITION BY c_nationkey) AS n, c_mktsegment FROM {customer}) q""",
        r"""SELECT tree_id, idx AS node_id, CASE WHEN idx>1 THEN idx//2 END AS parent_node_id, CASE WHEN idx=1 THEN NULL WHEN idx%2=0 THEN 'yes' ELSE 'no' END AS answer, idx%2 AS sibling_ord, CASE WHEN 2*idx>n THEN 'outcome' ELSE 'question' END AS node_type, CASE WHEN 2*idx>n THEN lower(c_mktsegment) END AS outcome_type FROM (SELECT c_nationkey AS tree_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS idx, count(*) OVER (PARTITION BY c_nationkey) AS n, c_mktsegment FROM {customer}) q""",
    ),
    "answers": (
        r"""SELECT l_orderkey AS session_id, l_linenumber AS question_id, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_suppkey,l_partkey,l_extendedprice) AS chunk_ord, CASE WHEN l_returnflag='R' THEN 'NOT_FOUND' ELSE repeat(l_linestatus, CAST(l_quantity AS INT)) END AS answer_text FROM {lineitem}""",
        r"""SELECT l_orderkey AS session_id, l_linenumber AS question_id, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_suppkey,l_partkey,l_extendedprice) AS chunk_ord, CASE WHEN l_returnflag='R' THEN 'NOT_FOUND' ELSE repeat(l_linestatus, CAST(l_quantity AS INT)) END AS answer_text FROM {lineitem}""",
    ),
    "jobs": (
        r"""SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status, o_orderdate AS created_at, CASE WHEN o_orderkey%7<>0 THEN (o_orderkey%100)/100.0 END AS validation_confidence FROM {orders}""",
        r"""SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status, o_orderdate AS created_at, CASE WHEN o_orderkey%7<>0 THEN (o_orderkey%100)/100.0 END AS validation_confidence FROM {orders}""",
    ),
    "job_events": (
        r"""SELECT event_id, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'viewed' END AS event_type, ts, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 WHEN 'error' THEN -1 ELSE 0 END AS delta FROM {events}""",
        r"""SELECT event_id, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'viewed' END AS event_type, ts, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 WHEN 'error' THEN -1 ELSE 0 END AS delta FROM {events}""",
    ),
    "metric_samples": (
        r"""SELECT event_id, 'agent'||CAST(user_id AS VARCHAR(20)) AS agent, ts, value AS cpu_percent, value*10 AS memory_mb, CAST(user_id%60 AS INT) AS num_threads FROM {events}""",
        r"""SELECT event_id, 'agent'||CAST(user_id AS VARCHAR(20)) AS agent, ts, value AS cpu_percent, value*10 AS memory_mb, CAST(user_id%60 AS INT) AS num_threads FROM {events}""",
    ),
    "responses": (
        r"""SELECT event_id AS response_id, CASE event_id%4 WHEN 0 THEN props WHEN 1 THEN '```json'||chr(10)||props||chr(10)||'```' WHEN 2 THEN replace(props,'}',',}') ELSE 'Here is the result: '||props END AS content FROM {events}""",
        r"""SELECT event_id AS response_id, CASE event_id%4 WHEN 0 THEN props WHEN 1 THEN '```json'||chr(10)||props||chr(10)||'```' WHEN 2 THEN replace(props,'}',',}') ELSE 'Here is the result: '||props END AS content FROM {events}""",
    ),
    "text_pages": (
        r"""SELECT doc_id, page_number, text || CASE WHEN page_number % 4 = 0 THEN ' see page 3' ELSE '' END || CASE WHEN page_number % 5 = 0 THEN ' shall mean' ELSE '' END || CASE WHEN page_number % 3 = 0 THEN ' coverage eligibility' ELSE '' END AS text FROM {doc_pages}""",
        r"""SELECT doc_id, page_number, text || CASE WHEN page_number % 4 = 0 THEN ' see page 3' ELSE '' END || CASE WHEN page_number % 5 = 0 THEN ' shall mean' ELSE '' END || CASE WHEN page_number % 3 = 0 THEN ' coverage eligibility' ELSE '' END AS text FROM {doc_pages}""",
    ),
    "headings": (
        r"""SELECT doc_id, page_number, CAST(1 AS INT) AS ord, CASE page_number % 6 WHEN 1 THEN 'I. ' || upper(replace(substr(text, 1, 30), 'ß', 'ss')) WHEN 3 THEN 'A. ' || substr(text, 1, 30) ELSE '1.1 ' || substr(text, 1, 30) END AS text, CAST(CASE page_number % 6 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS INT) AS level FROM (SELECT doc_id, page_number, split_part(text, '\n', 1) AS text FROM {doc_pages}) q WHERE page_number % 2 = 1""",
        r"""SELECT doc_id, page_number, CAST(1 AS INT) AS ord, CASE page_number % 6 WHEN 1 THEN 'I. ' || upper(replace(substr(text, 1, 30), 'ß', 'ss')) WHEN 3 THEN 'A. ' || substr(text, 1, 30) ELSE '1.1 ' || substr(text, 1, 30) END AS text, CAST(CASE page_number % 6 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS INT) AS level FROM (SELECT doc_id, page_number, split_part(text, chr(10), 1) AS text FROM {doc_pages}) q WHERE page_number % 2 = 1""",
    ),
    "routing_rules": (
        r"""SELECT tree_id, node_id, 'no' AS answer_value, node_id * 2 AS next_node_id, CASE WHEN node_id % 20 = 0 THEN 'in_range' ELSE 'equals' END AS comparison, CASE WHEN node_id % 20 = 0 THEN 9.0D END AS range_min, CASE WHEN node_id % 20 = 0 THEN CAST(node_id % 3 AS DOUBLE) * 9 END AS range_max FROM {tree_nodes} WHERE node_id % 5 = 0""",
        r"""SELECT tree_id, node_id, 'no' AS answer_value, node_id * 2 AS next_node_id, CASE WHEN node_id % 20 = 0 THEN 'in_range' ELSE 'equals' END AS comparison, CASE WHEN node_id % 20 = 0 THEN CAST(9.0 AS DOUBLE) END AS range_min, CASE WHEN node_id % 20 = 0 THEN CAST(node_id % 3 AS DOUBLE) * 9 END AS range_max FROM {tree_nodes} WHERE node_id % 5 = 0""",
    ),
    "page_types": (
        r"""SELECT doc_id, page_number, element_at(array('policy_content', 'definitions', 'coverage', 'administrative', 'index'), CAST((doc_id + page_number div 3) % 5 AS INT) + 1) AS primary_type, (page_number % 10) / 10.0D AS chunk_priority FROM {doc_pages}""",
        r"""SELECT doc_id, page_number, list_extract(['policy_content', 'definitions', 'coverage', 'administrative', 'index'], CAST((doc_id + page_number // 3) % 5 AS INT) + 1) AS primary_type, CAST(page_number % 10 AS DOUBLE) / 10 AS chunk_priority FROM {doc_pages}""",
    ),
}


def _needs(name: str) -> set[str]:
    return set(re.findall(r"\{([a-z_]+)\}", FIXTURES[name][0])) if name in FIXTURES else set()


def spark_fixture(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A fixture or a driver table; ``made`` has fixtures that are there already."""
    if made and name in made:
        return made[name]
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = re.sub(r"\{(?![a-z_]+\})|(?<![a-z_])\}", lambda m: m[0] * 2, FIXTURES[name][0])
    return spark.sql(plain, **{n: spark_fixture(spark, sf_dir, n, made) for n in _needs(name)})


def spark_fixtures(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> list[DataFrame]:
    """The fixtures of a query. What several of them are made of is made once and staged, so no table is read and split twice."""
    uses: Counter[str] = Counter()
    order: list[str] = []  # after what it needs

    def walk(name: str) -> None:
        uses[name] += 1
        if uses[name] == 1:
            for needed in sorted(_needs(name)):
                walk(needed)
            order.append(name)

    for name in names:
        walk(name)
    made: dict[str, DataFrame] = {}
    for name in order:
        if uses[name] > 1 and name in FIXTURES:
            made[name] = stage(spark_fixture(spark, sf_dir, name, made), "fixture", compression="zstd")
    return [spark_fixture(spark, sf_dir, name, made) for name in names]


def large(sql: str) -> str:
    """``sql`` over policies for the fixture of large jobs."""
    return sql.replace("{policies}", "{large_jobs}")


def duck(sql: str) -> str:
    """``sql`` for DuckDB, with the fixtures that it names in braces as common table expressions."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{([a-z_]+)\}", text):
            if name in FIXTURES and name not in ordered:
                need(FIXTURES[name][1])
                ordered.append(name)

    need(sql)
    heads = [f"f_{name} AS ({FIXTURES[name][1]})" for name in ordered]
    body = sql.strip()
    if heads and body.upper().startswith("WITH RECURSIVE "):
        body = "WITH RECURSIVE " + ", ".join(heads) + ", " + body[len("WITH RECURSIVE ") :]
    elif heads and body.upper().startswith("WITH "):
        body = "WITH " + ", ".join(heads) + ", " + body[len("WITH ") :]
    elif heads:
        body = "WITH " + ", ".join(heads) + " " + body
    return re.sub(r"\{([a-z_]+)\}", lambda m: f"f_{m[1]}" if m[1] in FIXTURES else m[1], body)
