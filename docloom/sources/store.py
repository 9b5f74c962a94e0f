"""Sinks and sources of the store: appended tables, JSON exports, ingestion of responses into three tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import json_value
from docloom.staging import stage

# What is read of a response.
RESPONSE = """struct<job_id:string,status:string,results:struct<job_id:string,status:string,metadata:struct<document_type:string,total_pages:int>,policy_hierarchy:struct<total_policies:int>,
    decision_trees:array<string>,validation_result:struct<overall_confidence:double,is_valid:boolean>,processing_stats:struct<processing_time_seconds:double>>>"""


def append(rows: DataFrame, path: str, **options: str) -> None:
    """Append rows to a Parquet table; a job that is tried again adds nothing twice that was committed."""
    rows.write.options(**options).mode("append").parquet(path)


def save_answers(answers: DataFrame, path: str) -> None:
    """Append answers, with confidence 0 where none is given."""
    append(answers.withColumn("confidence_score", F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0))), path)


def export_json(results: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One JSON object per row: the whole result, or some columns of it."""
    (results if columns is None else results.select(*columns)).write.mode("errorifexists").json(path)


def snapshot(statistics: DataFrame, at: Column, path: str) -> None:
    """Append a table of statistics as JSON under the time of the snapshot."""
    statistics.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "*").write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a schema from JSON lines; what doesn't fit is null."""
    return spark.read.schema(schema).json(path)


def ingest(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, jobs, results) of ``responses(content, document, filename, policy_name)``: one row each for responses that didn't fail and have results and a job.

    ``document`` are the bytes of the file. Responses are parsed once; the three tables are columns of that.
    """
    # Staged, so that no condition or column that reads a part of a response parses it again.
    parsed = stage(responses.withColumn("r", F.from_json("content", RESPONSE)), "responses", compression="zstd").withColumn("job_id", F.coalesce("r.job_id", "r.results.job_id"))
    good = parsed.where((F.coalesce("r.status", F.lit("unknown")) != "failed") & F.col("r.results").isNotNull() & (F.coalesce("job_id", F.lit("")) != ""))
    x = F.col("r.results")
    documents = good.select("job_id", "policy_name", "filename", F.regexp_replace(F.base64("document"), r"\s", "").alias("content_base64"), F.sha2("document", 256).alias("document_hash"), F.octet_length("document").alias("file_size_bytes"), F.lit("application/pdf").alias("mime_type"))
    jobs = good.select(
        "job_id",
        "policy_name",
        F.coalesce(x["status"], F.lit("completed")).alias("status"),
        F.when(x["metadata"].isNotNull(), F.coalesce(x["metadata"]["document_type"], F.lit("unknown"))).alias("document_type"),
        x["metadata"]["total_pages"].alias("total_pages"),
        F.when(x["policy_hierarchy"].isNotNull(), F.coalesce(x["policy_hierarchy"]["total_policies"], F.lit(0))).alias("total_policies"),
        F.when(x["decision_trees"].isNotNull(), F.size(x["decision_trees"])).alias("total_decision_trees"),
        F.when(x["validation_result"].isNotNull(), F.coalesce(x["validation_result"]["overall_confidence"], F.lit(0.0))).alias("validation_confidence"),
        F.when(x["validation_result"].isNotNull(), F.coalesce(x["validation_result"]["is_valid"], F.lit(False))).alias("validation_passed"),
        F.when(x["processing_stats"].isNotNull(), F.coalesce(x["processing_stats"]["processing_time_seconds"], F.lit(0.0))).alias("processing_time_seconds"),
    )
    results = good.select("job_id", F.to_json(F.variant_get(json_value(F.col("content")), "$.results", "variant")).alias("results_json"))
    return documents, jobs, results


def updated_results(results: DataFrame, changes: DataFrame, schema: str) -> DataFrame:
    """``results(job_id, policy_hierarchy_json, decision_trees_json)`` with what ``changes`` replaces, counters made anew.

    schema: of the hierarchy, with ``total_policies``; trees are a JSON array.
    """
    new = changes.select("job_id", *[F.col(c).alias(f"__{c}") for c in ("policy_hierarchy_json", "decision_trees_json")])
    rows = results.join(new, "job_id", "left").select("job_id", *[F.coalesce(f"__{c}", c).alias(c) for c in ("policy_hierarchy_json", "decision_trees_json")])
    policies = F.coalesce(F.from_json("policy_hierarchy_json", schema)["total_policies"], F.lit(0))
    trees = F.coalesce(F.json_array_length("decision_trees_json"), F.lit(0))
    return rows.withColumns({"total_policies": policies, "total_decision_trees": trees})
