"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every row becomes a digest of its normalised text. The rows are dealt over
``runs`` runs by their number. A run is sorted by digest and holds one entry per
digest: its smallest id and how many rows it stands for. Runs then meet in binomial
rounds: in each round ``FAN_IN`` runs, those whose numbers agree but for their lowest
``FAN_BITS`` bits, are exchanged by slices of digests, merged in order of (digest, id), and
of equal digests the first entry stays, the smallest id, with the sum of the counts.
(Binomial with two runs would be more rounds of the same.) A slice of a run is sorted
and merged in one task; no task gets a whole run, and no round gathers more than
``FAN_IN`` entries of a digest, even if all rows are copies. The way back joins all rows
to the last run, a staged table; both sides come straight from an exchange, so Spark
splits a hot digest there.

Entries only meet if the SHA-256 digest, the byte length and an independent
64-bit hash all agree, in every round.

Defined results: null text counts as empty text; empty texts are equal to each
other; a null ``doc_id`` sorts after every other id; of rows that agree in text
and ``doc_id`` exactly one is kept; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import fields, numbered, only_rows, shuffle_partitions, shuffles_removed, stage, temporary

FAN_BITS = 4
FAN_IN = 2**FAN_BITS
ENTRY = ["digest", "n_bytes", "other_hash"]


def normalised(text):
    """Runs of space, tab, line feed, vertical tab, form feed and return become one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(rows: DataFrame) -> DataFrame:
    """(row, doc_id, digest, n_bytes, other_hash) of ``rows(row, doc_id, text)``."""
    return rows.select("row", "doc_id", normalised(F.col("text")).alias("t")).select(
        "row",
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("other_hash"),
    )


def sorted_runs(rows: DataFrame, bits: int) -> DataFrame:
    """(run, digest..., keep_id, keep_row, group_size): one entry for each digest of each of ``2 ** bits`` runs.

    Copies become one entry in the task that reads them, before anything is shuffled.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(2**bits)))
    return dealt.groupBy("run", *ENTRY).agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))


def merge_round(entries: DataFrame, bits: int) -> DataFrame:
    """The runs whose numbers agree but for the lowest ``bits`` bits become one, sorted by digest; of equal digests the smallest id stays."""
    met = entries.withColumn("run", F.shiftright("run", bits))
    ordered = Window.partitionBy("run", *ENTRY).orderBy("first")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = met.withColumns({"nth": F.row_number().over(ordered), "group_size": F.sum("group_size").over(whole)})
    return summed.where("nth = 1").drop("nth")


def merged_runs(rows: DataFrame, runs: int | None = None) -> DataFrame:
    """(digest..., keep_id, keep_row, group_size): the last run of ``digests``, a staged table.

    runs: number of runs, rounded up to a power of two; by default about the number of shuffle partitions, so that a
    digest held by all rows is still spread over all tasks.
    """
    bits = max(1, math.ceil(math.log2(max(2, runs or shuffle_partitions(rows.sparkSession)))))
    merged = sorted_runs(rows, bits)
    for left in range(bits, 0, -FAN_BITS):
        merged = merge_round(merged, min(left, FAN_BITS))
    return stage(merged.select(*ENTRY, F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "last-run")


def exact_dedup(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stage(digests(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")), "digests")
    return rows.join(merged_runs(rows, runs), ENTRY).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; the columns stay as they are. Rows are chosen by number before their texts move."""
    with shuffles_removed(docs.sparkSession), temporary() as stay:
        rows = numbered(docs)
        found = stage(digests(fields(rows).withColumnRenamed("__row", "row")), "digests")
        kept = stage(merged_runs(found).select(F.col("keep_row").alias("__row")), "kept-rows")
        stay += [rows, kept]
        return only_rows(rows, kept)
