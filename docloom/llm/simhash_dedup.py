"""SimHash near-duplicate classes with pigeonring candidate filtering.

A text (A-Z lower-cased) becomes its 3-word shingles, repeats included; a bit of
the 64-bit fingerprint is set if it is set in over half of the shingles' XXH64
values. Fingerprints link when they differ in at most ``radius`` bits; a class is
a connected component of linked fingerprints.

Candidates follow the pigeonring principle: with the 64 bits cut into a ring of
``segments`` consecutive segments, two fingerprints within the radius have a
start segment from which the differences of every chain of 1, 2, ... segments sum
to at most ``length * radius / segments``. The chain lengths whose budget rounds
down to zero must agree outright and are the key of an equality join; the
longer chains are tested on the candidates, and last the whole distance.

A key that more than ``bucket_limit`` different fingerprints share isn't paired.
Its members are handled exactly in linear work: two fingerprints are within two
bits if and only if a fingerprint exists that is within one bit of both, so each
member lists its 65 neighbours within one bit, and members that list the same
neighbour are linked to the smallest of them (for radius 2; a radius of 1
uses only bit-cleared forms, and a radius of 0 needs no links).

Equal fingerprints collapse to one before any join, so copies are never paired.

Defined results: null text counts as empty; a text without words has fingerprint
zero and links like any other; texts of one or two words are one shingle; a null
``doc_id`` gets a class like any other row but never names one unless all its
class is null; repeated rows fall into one class; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fields, first_of_each, numbered, small_batches, stage
from docloom.operators.iterate import components

RADIUS, SEGMENTS, BUCKET_LIMIT, SHINGLE, SEED = 2, 7, 64, 3, 42
BLOCK = 1 << 16


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):  # long texts in blocks: the bit matrix stays small
        part = hashes[at : at + BLOCK]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((text_fingerprint(t) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.select("doc_id", of("text").alias("fp"))


def ring(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(parts: list[tuple[int, int]]) -> int:
    value = sum(((1 << width) - 1) << first for first, width in parts)
    return value - (1 << 64) if value >> 63 else value


def chain_masks(start: int, radius: int = RADIUS, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(bit mask, budget) of the chains of 1, 2, ... segments from ``start``."""
    parts = ring(segments)
    order = [parts[(start + i) % segments] for i in range(segments)]
    return [(_mask(order[:length]), length * radius // segments) for length in range(1, segments + 1)]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b) with a < b: links whose components are those of "at most ``radius`` bits differ".

    fps: column fp, distinct. Pairs of common buckets come out in full; crowded
    buckets come out as stars with the same components.
    """
    if not 0 <= radius <= 2 or segments <= radius:
        raise ValueError("radius is 0, 1 or 2, and segments more than radius")
    chains = [chain_masks(s, radius, segments) for s in range(segments)]
    keys = [[mask for mask, budget in chain if budget == 0][-1] for chain in chains]
    index = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k)) for k in keys])).alias("start", "key"))
    crowd = stage(index.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = stage(index.join(crowd, ["start", "key"]), "bucket-members")

    few = met.where(F.col("n") <= bucket_limit).select("start", "key", "fp")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    in_budget = F.lit(False)
    for start, chain in enumerate(chains):
        fits = F.col("start") == start
        for mask, budget in chain:
            if budget:
                fits = fits & (F.bit_count(apart.bitwiseAND(F.lit(mask))) <= budget)
        in_budget = in_budget | fits
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), ["start", "key"])
        .where("a < b")
        .where(in_budget & (F.bit_count(apart) <= radius))
        .select("a", "b")
        .distinct()
    )
    if radius == 0:
        return pairs

    crowded = met.where(F.col("n") > bucket_limit).select("fp").distinct()
    bit = [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]
    if radius == 1:
        near = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.bitwise_not(b)).alias("v")) for i, b in enumerate(bit)]
    else:
        near = [F.struct(F.lit(0).alias("i"), F.col("fp").bitwiseXOR(b).alias("v")) for b in [F.lit(0), *bit]]
    around = crowded.select("fp", F.inline(F.array(*near)))
    hub = around.groupBy("i", "v").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = around.join(hub, ["i", "v"]).where("fp > hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def near_classes(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    small_batches(docs.sparkSession)
    rows = stage(fingerprints(docs), "fingerprints")
    by_fp = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-ids")
    roots = components(fingerprint_links(by_fp.select("fp"), radius, segments, bucket_limit))
    rooted = stage(by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    lowest = stage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest-ids")  # both sides of the join are tables: Spark can split a giant class
    classes = stage(rooted.join(lowest, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest ``doc_id``; columns unchanged.

    Rows are told apart by a number of their own: null or repeated ids of other classes don't matter.
    """
    small_batches(docs.sparkSession)
    rows = numbered(docs)
    held = fields(rows)
    found = fingerprints(held.withColumn("doc_id", F.col("__row")))
    ids = held.select("__row", "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    named = stage(ids.join(found.withColumnRenamed("doc_id", "__row"), "__row"), "fingerprints")
    roots = components(fingerprint_links(named.select("fp").distinct()))
    classes = named.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("__row", "doc_id", "tie", F.coalesce("root", "fp").alias("root"))
    return first_of_each(rows, classes)
