"""Results of a job as nested JSON: assembled bottom-up from flat rows, counted, and loaded with their job and document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.iterate import cut, depths
from docloom.staging import drop

EMPTY = {"metadata": "{}", "policy_hierarchy": "{}", "decision_trees": "[]", "validation_result": "{}", "processing_stats": "{}"}
RESULT = """struct<metadata:struct<total_pages:long>,
policy_hierarchy:struct<total_policies:long,root_policies:array<string>,max_depth:long,definitions:map<string,string>>,
decision_trees:array<string>,
validation_result:struct<overall_confidence:double,completeness_score:double,consistency_score:double,traceability_score:double,is_valid:boolean,issues:array<struct<severity:string>>>>"""


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def nested_json(rows: DataFrame, group: str, node: str, parent: str, order: str, head: Column, key: str | None = None) -> DataFrame:
    """(group, order, node, json) of the roots of ``rows``, each with all that is below it under ``children``.

    head: a row's own fields as a JSON object. Children are a list in ``order``, or an object by ``key``. From the deepest level up, a
    level's objects are joined into those above it, so every row moves once per level that holds it and no path is listed.
    A row whose parent is null or absent is a root; rows on or below a cycle are left out; ids are unique within a group. Nested
    text is never broadcast, however well its file is compressed.
    """
    levels = depths(rows.select(group, node, parent), group, node, parent).where("depth is not null").select(group, node, "depth")
    kept = [F.col(c) for c in dict.fromkeys([group, node, parent, order, *([key] if key else [])])]
    held = cut(rows.select(*kept, head.alias("__head")).join(levels.hint("merge"), [group, node]))
    below = None
    for depth in range(held.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = held.where(F.col("depth") == depth)
        level = level.withColumn("__kids", F.lit(None).cast("string")) if below is None else level.join(below.hint("merge"), [group, node], "left")
        inner = F.when(F.col("__kids").isNotNull(), F.concat(F.lit(',"children":'), "__kids")).otherwise("")
        whole = F.concat(F.substring("__head", F.lit(1), F.length("__head") - 1), inner, F.lit("}"))
        whole = F.when(F.col("__head") == "{}", F.concat(F.lit("{"), F.substring(inner, F.lit(2), F.length(inner)), F.lit("}"))).otherwise(whole)
        done = cut(level.select(*kept, whole.alias("json")))
        one = F.concat(_quoted(F.col(key)), F.lit(":"), "json") if key else F.col("json")
        opening, closing = "{}" if key else "[]"
        kids = done.groupBy(group, F.col(parent).alias(node)).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("one")))).alias("l"))
        below = kids.select(group, node, F.concat(F.lit(opening), F.array_join(F.transform("l", lambda x: x.one), ","), F.lit(closing)).alias("__kids"))
    drop(held)
    return done.select(group, order, node, "json")


def tree_json(nodes: DataFrame) -> DataFrame:
    """(tree_id, json): nested trees of node rows; ``trees.parse_nodes`` gives the same rows back."""
    asks = F.when(F.col("node_type") == "question", F.struct("question_text", "question_type", "options"))
    head = F.to_json(F.struct("node_id", "node_type", asks.alias("question"), "outcome_type", "confidence_score"))
    roots = nested_json(nodes, "tree_id", "node_id", "parent_node_id", "sibling_ord", head, "answer")
    return roots.select("tree_id", "json")


def hierarchy_json(policies: DataFrame, definitions: DataFrame) -> DataFrame:
    """(job_id, json) of ``policies(job_id, ord, policy_id, parent_id, title, confidence)`` and ``definitions(job_id, term, definition)``."""
    policies = cut(policies)
    head = F.to_json(F.struct("policy_id", "title", "confidence"))
    roots = nested_json(policies, "job_id", "policy_id", "parent_id", "ord", head)
    listed = roots.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ord", "json"))).alias("l"))
    root_list = listed.select("job_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x.json), ","), F.lit("]")).alias("roots"))
    deepest = depths(policies, "job_id", "policy_id", "parent_id").groupBy("job_id").agg(F.max("depth").alias("max_depth"))
    sizes = policies.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_policies"))
    terms = definitions.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("term", "definition"))).alias("d"))
    rows = sizes.join(deepest, "job_id", "left").join(root_list, "job_id", "left").join(terms, "job_id", "left")
    known = F.to_json(F.struct("total_policies", "max_depth", F.map_from_entries(F.coalesce("d", F.array().cast("array<struct<term:string,definition:string>>"))).alias("definitions")))
    return rows.select("job_id", F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(',"root_policies":'), F.coalesce("roots", F.lit("[]")), F.lit("}")).alias("json"))


def listed_json(rows: DataFrame, key: str, order: str, json: str) -> DataFrame:
    """(key, json): the objects of a key as one list in ``order``."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(json).alias("j")))).alias("l"))
    return listed.select(key, F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x.j), ","), F.lit("]")).alias("json"))


def get_results(jobs: DataFrame, **parts: DataFrame) -> DataFrame:
    """(job_id, result_json) of ``jobs(job_id)``: the parts, tables (job_id, json) named as in ``EMPTY``; a part that a job lacks is empty."""
    rows = jobs.select("job_id")
    for name, part in parts.items():
        rows = rows.join(part.select("job_id", F.col("json").alias(name)), "job_id", "left")
    fields = [F.concat(F.lit(f'"{name}":'), F.coalesce(F.col(name) if name in parts else F.lit(None).cast("string"), F.lit(empty))) for name, empty in EMPTY.items()]
    head = F.concat(F.lit('{"job_id":'), _quoted(F.col("job_id").cast("string")), F.lit(',"status":"completed"'))
    return rows.select("job_id", F.concat(head, *[F.concat(F.lit(","), f) for f in fields], F.lit("}")).alias("result_json"))


def result_rows(results: DataFrame) -> DataFrame:
    """Counters and scores of ``results(job_id, result_json)``; what is absent counts as nothing, and as not valid."""
    r = F.from_json("result_json", RESULT.replace("\n", ""))
    parsed = results.select("job_id", "result_json", r.alias("r"))

    def size(of: str) -> Column:
        return F.coalesce(F.size(of), F.lit(0)).cast("long")

    def severity(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("r.validation_result.issues", lambda i: i.severity == kind)), F.lit(0)).cast("long")

    scores = {f"{s}": F.coalesce(f"r.validation_result.{s}", F.lit(0.0)) for s in ("overall_confidence", "completeness_score", "consistency_score", "traceability_score")}
    hierarchy = "r.policy_hierarchy"
    return parsed.select(
        "job_id",
        "result_json",
        F.col("r.metadata.total_pages").alias("total_pages"),
        F.coalesce(f"{hierarchy}.total_policies", F.lit(0)).alias("total_policies"),
        size(f"{hierarchy}.root_policies").alias("total_root_policies"),
        F.coalesce(f"{hierarchy}.max_depth", F.lit(0)).alias("max_hierarchy_depth"),
        size("r.decision_trees").alias("total_decision_trees"),
        size(f"{hierarchy}.definitions").alias("total_definitions"),
        *[c.alias(name) for name, c in scores.items()],
        F.coalesce("r.validation_result.is_valid", F.lit(False)).alias("is_valid"),
        size("r.validation_result.issues").alias("total_issues"),
        *[severity(kind).alias(f"{kind}_count") for kind in ("error", "warning", "info")],
    )


def save_results(results: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(result rows of known jobs, job rows with the summary copied back, history rows) of ``results(job_id, result_json)``."""
    rows = cut(result_rows(results).join(jobs.select("job_id").distinct(), "job_id", "left_semi"))
    copied = {"total_pages": "total_pages", "total_policies": "total_policies", "total_decision_trees": "total_decision_trees", "validation_confidence": "overall_confidence", "validation_passed": "is_valid"}
    summary = rows.select("job_id", F.lit(True).alias("__has"), *[F.col(of).alias(f"__{name}") for name, of in copied.items()])
    others = [c for c in jobs.columns if c not in copied]
    held = {name: F.col(name) if name in jobs.columns else F.lit(None) for name in copied}
    updated = jobs.join(summary, "job_id", "left").select(*others, *[F.when(F.col("__has"), F.col(f"__{name}")).otherwise(held[name]).alias(name) for name in copied])
    history = rows.select("job_id", F.lit("results_saved").alias("event_type"), F.to_json(F.struct("total_policies", F.col("overall_confidence").alias("confidence"))).alias("details"))
    return rows, updated, history


def _set(json: Column, **values: Column) -> Column:
    """A JSON object with these keys set; a null value removes the key's old value and leaves the key out."""
    names = F.array(*[F.lit(n) for n in values])
    old = F.map_filter(F.from_json(json, "map<string,variant>"), lambda k, _: ~F.array_contains(names, k))
    parts = [F.when(v.isNotNull(), F.create_map(F.lit(n), v.cast("variant"))) for n, v in values.items()]
    return F.to_json(reduce(lambda m, p: F.when(p.isNotNull(), F.map_concat(m, p)).otherwise(m), parts, old))


def load_job_results(results: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results with their document and the job's metadata merged in: two left joins.

    results: job_id, result_json; documents: job_id, filename, content_base64; jobs: job_id, total_pages,
    processing_time_seconds, validation_confidence, document_type. A document that isn't base64 has a null content and its
    ``document_error``; the filename defaults to ``document.pdf`` where there is a document.
    """
    docs = documents.select("job_id", F.lit(True).alias("__doc"), F.expr("try_to_binary(content_base64, 'base64')").alias("document_content"), "filename", "content_base64")
    own = jobs.select("job_id", F.lit(True).alias("__job"), *[F.col(c).alias(f"__{c}") for c in ("total_pages", "processing_time_seconds", "validation_confidence", "document_type")])
    rows = results.join(docs, "job_id", "left").join(own, "job_id", "left")
    part = {name: F.coalesce(F.get_json_object("result_json", f"$.{name}"), F.lit("{}")) for name in EMPTY}
    metadata = _set(part["metadata"], total_pages=F.col("__total_pages"), processing_time=F.col("__processing_time_seconds"), validation_confidence=F.col("__validation_confidence"), document_type=F.col("__document_type"))
    validation = _set(part["validation_result"], overall_confidence=F.coalesce("__validation_confidence", F.lit(0.0)))
    merged = [F.concat(F.lit(f'"{n}":'), F.when(F.col("__job"), {"metadata": metadata, "validation_result": validation}[n]).otherwise(p) if n in ("metadata", "validation_result") else F.coalesce(F.get_json_object("result_json", f"$.{n}"), F.lit(EMPTY[n]))) for n, p in part.items()]
    head = F.concat(F.lit('{"job_id":'), _quoted(F.col("job_id").cast("string")), F.lit(',"status":"completed"'))
    broken = F.col("content_base64").isNotNull() & F.col("document_content").isNull()
    return rows.select(
        "job_id",
        F.concat(head, *[F.concat(F.lit(","), m) for m in merged], F.lit("}")).alias("result_json"),
        "document_content",
        F.when(F.col("__doc"), F.coalesce("filename", F.lit("document.pdf"))).alias("document_filename"),
        F.when(broken, "not base64").alias("document_error"),
    )
