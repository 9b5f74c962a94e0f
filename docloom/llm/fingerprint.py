"""Document fingerprints: weighted SimHash and permuted block tables (DataFrame functions only).

A text's terms are its lower-cased word pairs (the word itself, if it has only one).
A term weighs 1, and 1 more for each of its words of over three characters; every
occurrence casts its weight on the 64 bits of the term's hash, and a bit is set if
the votes for it outweigh those against. Votes are summed in packed lanes.

``search`` finds all fingerprints within a Hamming radius: the bits are cut into
``radius + EXTRA_BLOCKS`` blocks; whichever bits differ, ``EXTRA_BLOCKS`` blocks agree, so one
table for each choice of that many blocks, keyed by their bits, meets every such pair.

Defined results: null text counts as empty; a text without words has fingerprint
zero; texts are used whole; equal texts have equal fingerprints; the next document
is the one with the next lower ``doc_id`` (of any type that has an order); rows that share a
``doc_id``, null ones too, follow each other by their first ``HEAD`` characters, then by a hash of the
text; null ids come last, and the first row follows the last (a single row follows itself); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop, shuffle_partitions, stage

TERMS_IN_PART = 8192  # terms of weight 3 at most: a lane of 16 bits stays below its sign
RADIUS, EXTRA_BLOCKS = 3, 2
BUCKETS_PER_PARTITION = 4
HEAD = 64  # characters of a text that order rows of one id
TIE = ["head", "hash", "row"]


def simhash(rows: DataFrame, keys: list[str], text: str, name: str = "fp") -> DataFrame:
    """``keys`` and the fingerprint's 64 bits as a signed long, for each row; ``keys`` must tell the rows apart.

    The words are exploded and their votes summed in the same task, sixteen longs of four lanes each, so what is
    shuffled is one row per text (and per ``TERMS_IN_PART`` terms of a long one).
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    listed = rows.select(*keys, words.alias("words"))
    terms = listed.select(*keys, F.size("words").alias("n"), "words", F.posexplode_outer("words").alias("pos", "word")).where("pos is null or pos = 0 or pos < n - 1")
    after = F.get("words", F.col("pos") + 1)

    def heavy(word: Column) -> Column:
        return F.when(F.length(word) > 3, 1).otherwise(0)

    weight = F.when(F.col("word").isNull(), 0).otherwise(1 + heavy(F.col("word")) + F.coalesce(heavy(after), F.lit(0))).cast("long")
    hashed = F.when(F.col("n") > 1, F.xxhash64("word", after)).otherwise(F.xxhash64("word"))
    votes = terms.select(*keys, F.expr(f"coalesce(pos, 0) div {TERMS_IN_PART}").alias("part"), hashed.alias("h"), weight.alias("w"))
    lanes, pairs = F.lit(0x0001000100010001), F.lit(0x0000FFFF0000FFFF)
    parts = votes.groupBy(*keys, "part").agg(
        F.sum("w").alias("total"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(lanes) * F.col("w")).alias(f"a{i}") for i in range(16)]
    )
    wide = parts.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        *[F.sum(F.shiftrightunsigned(f"a{i}", shift).bitwiseAND(pairs)).alias(f"a{i}_{shift}") for i in range(16) for shift in (0, 16)],
    )
    bits = F.lit(0).cast("long")
    for b in range(64):
        lane = b // 16  # lanes 0 and 2 are the halves of the unshifted sums, 1 and 3 those of the shifted ones
        count = F.shiftrightunsigned(f"a{b % 16}_{16 * (lane % 2)}", 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        bits = bits.bitwiseOR(F.when(2 * count > F.col("total"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return wide.select(*keys, bits.alias(name))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bounds(rows: DataFrame) -> DataFrame:
    """(bounds, first): one row, staged. bounds: rows that cut the order of ``rows(doc_id, head, hash, row)`` into slices of like size; first: the number of its first row.

    Only keys are moved, and as ``row`` tells all of them apart, rows of one id are cut like any others. The
    number of slices depends on the partitions, not on the rows.
    """
    order = [F.col("doc_id").desc_nulls_last(), *TIE]
    wanted = BUCKETS_PER_PARTITION * shuffle_partitions(rows.sparkSession)
    keys = stage(rows.select("doc_id", *TIE).repartitionByRange(wanted, *order).withColumn("slice", F.spark_partition_id()), "keys")
    first = keys.orderBy(*order).limit(1).select("row")
    one_each = keys.groupBy("slice").agg(F.max(F.struct("doc_id", *TIE)).alias("bound"))
    cuts = one_each.join(F.broadcast(first), F.col("bound.row") == first.row, "left_anti").agg(F.array_sort(F.collect_list(F.struct("slice", "bound"))).alias("cuts"))
    found = stage(cuts.select(F.transform("cuts", lambda c: c.bound).alias("bounds"), first.scalar().alias("first")), "bounds")
    drop(keys)
    return found


def in_buckets(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, head, hash, row, ...)`` with ``bucket``, ascending with the order, and ``ahead``: the bucket whose last row this one follows, if any.

    A bound is the first row of its bucket, so the bucket before knows what follows it; the first row of all follows the last bucket.
    """
    found = _bounds(rows)
    most = BUCKETS_PER_PARTITION * shuffle_partitions(rows.sparkSession)
    middle = "cast((a.lo + a.hi) div 2 as int)"
    not_after = f"""coalesce(b[{middle}].doc_id > doc_id, b[{middle}].doc_id is not null and doc_id is null) or (b[{middle}].doc_id <=> doc_id
        and struct(b[{middle}].head as h, b[{middle}].hash as x, b[{middle}].row as r) <= struct(head as h, hash as x, row as r))"""
    # How many bounds don't come after the row, by halving.
    at = f"""aggregate(sequence(1, {most.bit_length() + 1}), struct(0 as lo, size(b) as hi),
        (a, i) -> if(a.lo >= a.hi, a, if({not_after}, struct({middle} + 1 as lo, a.hi as hi), struct(a.lo as lo, {middle} as hi))), a -> a.lo)"""
    placed = rows.withColumns({"b": found.select("bounds").scalar(), "first": found.select("first").scalar()}).withColumn("bucket", F.expr(at))
    starts = F.get("b", F.col("bucket") - 1)["row"] == F.col("row")
    ahead = F.when(starts, F.col("bucket") - 1).when(F.col("row") == F.col("first"), F.size("b"))
    return placed.withColumn("ahead", ahead).drop("b", "first")


def with_next(placed: DataFrame, columns: list[str], order: list) -> DataFrame:
    """``placed`` with ``next_<column>`` of the row that follows, and ``nth``, its place in its bucket.

    Rows that start a bucket are copied behind the one before. So the rows move once, and no window sees more than a bucket.
    """
    here = F.struct("bucket", F.lit(0).alias("rank"))
    behind = F.when(F.col("ahead").isNotNull(), F.struct(F.col("ahead").alias("bucket"), F.lit(1).alias("rank")))
    rest = [c for c in placed.columns if c != "bucket"]
    moved = placed.select(*rest, F.inline(F.array_compact(F.array(here, behind))))
    window = Window.partitionBy("bucket").orderBy("rank", *order)
    follows = [F.lead(c).over(window).alias(f"next_{c}") for c in columns]
    return moved.select("*", *follows, F.row_number().over(window).alias("nth")).where("rank = 0").drop("rank")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the second half taken from the next one, and their likeness."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = stage(texts.withColumns({"head": F.left("text", F.lit(HEAD)), "hash": F.xxhash64("text")}), "texts", compression="zstd")
    followed = with_next(in_buckets(rows), ["text"], [F.col("doc_id").desc_nulls_last(), *TIE])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = followed.select(
        "row",
        "doc_id",
        "bucket",
        "nth",
        "ahead",
        F.length("text").cast("long").alias("n_chars"),
        "text",
        F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half)).alias("edited"),
    ).withColumn("sha", F.unhex(F.sha2("edited", 256)))
    keys = ["row", "doc_id", "bucket", "nth", "ahead", "n_chars", "sha"]
    both = edited.select(*keys, F.inline(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("t")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("t")))))
    prints = simhash(both, [*keys, "is_edited"], "t").groupBy(*keys).agg(F.max(F.when(~F.col("is_edited"), F.col("fp"))).alias("fp"), F.max(F.when(F.col("is_edited"), F.col("fp"))).alias("edited_fp"))
    done = stage(prints.withColumnRenamed("nth", "place").drop("row"), "edited")
    drop(rows)
    after = with_next(done, ["fp"], ["place"])
    return after.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def block_masks(radius: int = RADIUS) -> list[int]:
    """The bits of each table's key."""
    blocks = radius + EXTRA_BLOCKS
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, EXTRA_BLOCKS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def search(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, found, n): the fingerprints of the table within ``radius`` bits of each queried one, and their rows.

    Both have a column fp. Equal fingerprints count once in the tables; n has how many rows hold them.
    """
    masks = block_masks(radius)

    def tables(df: DataFrame) -> DataFrame:
        return df.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"))

    held = tables(fingerprints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))).withColumnRenamed("fp", "found")
    apart = F.col("fp").bitwiseXOR(F.col("found"))
    first = F.lit(len(masks))
    for i, mask in reversed(list(enumerate(masks))):
        first = F.when(apart.bitwiseAND(F.lit(mask)) == 0, F.lit(i)).otherwise(first)
    # A pair that several tables hold is taken from the first of them.
    return tables(queries.select("fp").distinct()).join(held, ["block", "key"]).where((F.bit_count(apart) <= radius) & (F.col("block") == first)).select("fp", "found", "n")
