"""Documents as files: hashed, decoded and split into pages; what fails is a stub page with its error, never a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import approx_tokens

PAGE_BREAK = "\f"
PREVIEW = 200
MOST_BYTES = 1 << 30
# The layout of a page that says nothing of it.
WIDTH, HEIGHT = 612, 792


def page_rows(files: DataFrame, break_: str = PAGE_BREAK) -> DataFrame:
    """One row per page of ``files(path, content, error)``, numbered from 1: texts of UTF-8 with ``break_`` between pages.

    Pages are cut as bytes, so one that isn't UTF-8 becomes a stub with its error and its neighbours stay. A file with an
    ``error`` or no content is one stub. ``document_hash`` is of the bytes, a page's id is ``hash:pN``; a hash that can't be
    had is that of the path.
    """
    latin = F.decode("content", "ISO-8859-1")  # one character a byte, whatever the bytes are
    hashed = F.coalesce(F.sha2("content", 256), F.sha2(F.col("path"), 256))
    empty = F.when(F.col("content").isNull() | (F.octet_length("content") == 0), "empty file")
    cut = F.split(F.coalesce(latin, F.lit("")), break_)
    pages = files.select("path", hashed.alias("document_hash"), F.coalesce("error", empty).alias("file_error"), F.posexplode(cut).alias("pos", "raw"))
    text = F.try_validate_utf8(F.encode("raw", "ISO-8859-1").cast("string"))
    read = pages.select("*", (F.col("pos") + 1).alias("page_number"), text.alias("text"))
    error = F.coalesce("file_error", F.when(F.col("text").isNull(), "not UTF-8"))
    return _with_facts(read.select("path", "document_hash", "page_number", "text", error.alias("error")))


def stubs(rows: DataFrame) -> DataFrame:
    """``rows(..., text, error)`` with ``approx_tokens``; a page with an error is an empty one of no tokens."""
    text = F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).otherwise("")
    tokens = F.when(F.col("error").isNull(), approx_tokens(text)).otherwise(0)
    return rows.withColumns({"text": text, "approx_tokens": tokens})


def _with_facts(pages: DataFrame) -> DataFrame:
    return stubs(pages).select(
        F.concat("document_hash", F.lit(":p"), F.col("page_number").cast("string")).alias("page_id"),
        "document_hash",
        "path",
        "page_number",
        "text",
        F.left("text", F.lit(PREVIEW)).alias("text_preview"),
        F.length("text").alias("char_count"),
        "approx_tokens",
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
        F.lit("portrait").alias("orientation"),
        F.when(F.col("error").isNull(), F.array().cast("array<string>")).otherwise(F.array("error")).alias("processing_errors"),
    )


def read_pages(spark: SparkSession, folder: str, glob: str = "*", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``page_rows`` of the files of a folder and those below it.

    Files over ``most_bytes`` aren't read: the source drops them by their size, and each is a stub that says so. Spark's source
    doesn't list files of no bytes at all.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= most_bytes).select("path", "content", F.lit(None).cast("string").alias("error"))
    large = files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("error"))
    return page_rows(small.union(large))
