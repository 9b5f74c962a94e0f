"""The job store and its analytics: status folds, edits as merges, statistics, pruning. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.scan import running_sums


def list_jobs(jobs: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest jobs first, ties by id."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit)


def store_statistics(jobs: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "processing").alias("processing"),
        F.avg(F.when(done, F.col("validation_confidence"))).alias("average_confidence"),
    ).withColumn("success_rate", F.when(F.col("total") > 0, F.col("completed") / F.col("total")).otherwise(0.0))


def status_transitions(events: DataFrame) -> DataFrame:
    """Per job: first processing, last completed or failed, seconds between, latest status. ``events(job_id, event_type, ts, event_id)``."""
    ended = F.col("event_type").isin("completed", "failed")
    return events.groupBy("job_id").agg(
        F.min(F.when(F.col("event_type") == "processing", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("completed_at"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("status"),
    ).withColumn("duration_s", F.unix_micros(F.col("completed_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6)


def history(events: DataFrame, job_id: int) -> DataFrame:
    return events.where(F.col("job_id") == job_id).orderBy("ts", "event_id")


def merged(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the non-null columns of ``changes`` of the same key; the key never changes."""
    fields = [c for c in changes.columns if c != key and c in table.columns]
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = table.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def latest_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key it doesn't hold."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def first_of_each(table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key: duplicates by hash, latest boundary, first title."""
    return table.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")


def pruned(store: DataFrame, most: int, group: str, ord_: str) -> DataFrame:
    """A store that holds over 1.2 times ``most`` rows loses its oldest finished rows down to ``most``; active rows stay."""
    finished = F.col("status").isin("completed", "failed")
    sizes = store.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    nth = F.when(finished, F.sum(finished.cast("long")).over(Window.partitionBy(group).orderBy(ord_)))
    return (
        store.join(sizes, group)
        .withColumn("__nth", nth)
        .where((F.col("__size") <= 1.2 * most) | ~finished | (F.col("__nth") > F.col("__size") - most))
        .drop("__size", "__nth")
    )


def result_counters(results: DataFrame, schema: str) -> DataFrame:
    """Counters of nested result JSON: ``results(job_id, result_json)``."""
    parsed = results.select("job_id", F.from_json("result_json", schema).alias("r"))

    def issues(kind: str) -> Column:
        return F.size(F.filter("r.issues", lambda i: i.severity == kind))

    return parsed.select(
        "job_id",
        F.coalesce(F.size("r.policies"), F.lit(0)).alias("n_policies"),
        F.coalesce(F.size("r.trees"), F.lit(0)).alias("n_trees"),
        issues("error").alias("n_errors"),
        issues("warning").alias("n_warnings"),
    )


def save_job(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job rows with defaults, their first history rows)."""
    jobs = rows.withColumns({"status": F.coalesce("status", F.lit("submitted")), "threshold": F.coalesce("threshold", F.lit(0.7))})
    return jobs, jobs.select("job_id", F.lit("created").alias("event_type"), "created_at")


def document_hashes(documents: DataFrame) -> DataFrame:
    """Fingerprint of the bytes and of their base64 text; page ids are ``hash:pN``."""
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")  # Spark may break lines
    return documents.select(
        "doc_id",
        F.sha2(F.unbase64(coded), 256).alias("document_hash"),
        F.sha2(coded, 256).alias("text_hash"),
        F.concat(F.sha2(F.unbase64(coded), 256), F.lit(":p1")).alias("first_page_id"),
    )


def content_validation(pages: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.round(F.sum(F.octet_length(text)) / 1024, 6).alias("size_kb"),
        F.bool_or(F.length(F.trim(text)) > 0).alias("has_text"),
        F.left(F.min_by(text, "page_number"), F.lit(200)).alias("sample"),
    )


def line_references(lines: DataFrame) -> DataFrame:
    """Non-empty lines with their place in the text, line ends counted; no task holds a document. ``lines(doc_id, line_no, line)``."""
    summed = running_sums(lines.withColumn("__length", F.length("line") + 1), "doc_id", ["line_no"], "__length")
    placed = summed.withColumn("char_start", F.col("running") - F.col("__length")).withColumn("char_end", F.col("char_start") + F.length("line"))
    return placed.where(F.trim("line") != "").select("doc_id", "line_no", F.trim("line").alias("line"), "char_start", "char_end")


def processing_stats(chunks: DataFrame, policies: DataFrame, trees: DataFrame) -> DataFrame:
    """Per job: chunks and their tokens, policies, trees, mean tokens and share of complete contexts. A job that lacks one of the three has no statistics.

    ``chunks(job_id, token_count, has_complete_context)``, ``policies(job_id)``, ``trees(job_id)``.
    """
    of_chunks = chunks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.sum("token_count").alias("total_tokens"), F.avg("token_count").alias("mean_tokens"), F.avg(F.coalesce("has_complete_context", F.lit(True)).cast("double")).alias("complete_share")
    )
    of_policies = policies.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_policies"))
    of_trees = trees.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_decision_trees"))
    return of_chunks.join(of_policies, "job_id").join(of_trees, "job_id")
