"""Near-duplicate texts by the exact Jaccard similarity of their five-word shingles.

A text (A-Z lower-cased) becomes the set of its 5-word shingles, each an XXH64 value.
Two texts are near copies if their sets' Jaccard similarity is 0.8 or more; a class is
a connected component of near copies. No pair is missed: similarity is tested on whole
sets, and every step before it only removes pairs that can't reach 0.8.

Equal sets collapse to one by a 128-bit key. All shingles have one order, the rarest
first. Of two sets of 0.8 or more, each has one of its first ``n - ceil(0.8 n) + 1`` shingles in
the other; those that only one set has count there but aren't indexed. Shingles are
shuffled in two steps, so that few are: in the first only those whose hash is below
``HOME`` (and, in sets that have too few of these, the next ones) are counted. A set that has so
many to itself that its first ones are among them has no near copy. The sets
that are left, and all their shingles, are counted again among themselves and indexed.

At a common shingle, what is left of both sets bounds their overlap, and so does a sketch of
512 bits: parities of how many shingles fall on each place, which differ in at most as many
places as the sets do. The sketches are compared by pigeonring: with their words as a ring of
segments, some chain of consecutive segments stays within its share of the allowed
differences at every length, so pairs without such a chain fall before the whole distance is taken.

Only components are needed, so pairs within one are never made. In rounds, all members
of a bucket (an indexed shingle) are compared with one hub of it, and what is found
is joined into components. When few pairs are left, or after ``HUB_ROUNDS``, what lies
outside a bucket's largest component is compared with the rest of it that it can be near to at all: of two near copies at least one has, from
their first common shingle on, eight ninths of its size in shared shingles (a strong member), so weak ones never meet each other. Forms filled in on
one template, alike but below 0.8, are weak in the template's buckets: those have no strong member, and go before anything is joined.

Defined results: null text counts as empty; texts without words are equal; texts of
one to four words are one shingle; a null ``doc_id`` comes after all others; each
class keeps exactly one row, whatever ids other classes have; an empty table gives an
empty result; shingles are equal when their 64-bit hashes agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop, fields, first_of_each, numbered, shuffles_removed, small_batches, stage, temporary
from docloom.operators.iterate import components

SHINGLE, SEED = 5, 42
SKETCH_BITS = 512
HUB_ROUNDS, FEW_PAIRS = 3, 8
HOME = -(1 << 63) + (2 << 64) // 5  # signed hashes below this are two fifths of all
CHAIN = 3


def text_shingles(text: str | None) -> np.ndarray:
    """The different shingles of one text as sorted signed 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64).view(np.int64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each of ``SKETCH_BITS`` places, as signed longs."""
    odd = np.bincount(shingles & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def set_keys(rows: DataFrame) -> DataFrame:
    """(__row, doc_id, tie, h, h2, n, home, bits) for ``rows`` with ``__row``: two hashes, size, size below ``HOME``, sketch of each text's set."""

    @F.pandas_udf("h long, h2 long, n int, home int, bits array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        def key(text):
            t = text_shingles(text)
            return *np.frombuffer(xxhash.xxh3_128_digest(t.tobytes()), np.int64).tolist(), len(t), int(np.searchsorted(t, HOME)), sketch(t)

        return pd.DataFrame([key(t) for t in texts], columns=["h", "h2", "n", "home", "bits"])

    tie = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")
    return rows.select("__row", "doc_id", tie, of("text").alias("s")).select("__row", "doc_id", "tie", "s.*")


def can_be_near(a: str, b: str) -> Column:
    """Whether what is left of both sets and their sketches allow 0.8: nine overlaps are four times both sizes."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    left = F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest")) + 1
    segments = SKETCH_BITS // 64
    apart = [F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(segments)]
    ring = F.lit(False)
    for start in range(segments):
        held = F.lit(True)
        for length in range(1, CHAIN + 1):
            held = held & (9 * segments * sum(apart[(start + i) % segments] for i in range(length)) <= length * n)
        ring = ring | held
    return (9 * left >= 4 * n) & ring & (9 * sum(apart) <= n)


def is_strong(v: str) -> Column:
    """Whether a near copy of the same size could still follow: of a pair that ``can_be_near``, the smaller member is."""
    return 9 * (F.col(f"{v}.rest") + 1) >= 8 * F.col(f"{v}.n")


def prefix_size(n: Column) -> Column:
    """How many of its first shingles a set of ``n`` may need before one that a near copy has."""
    return n - F.floor((4 * n + 4) / 5) + 1


def leading_shingles(text: str | None) -> np.ndarray:
    """The text's shingles below ``HOME``, and where they are fewer than its prefix the next ones, ascending."""
    shingles = text_shingles(text)
    prefix = len(shingles) - (4 * len(shingles) + 4) // 5 + 1
    return shingles[: max(int(np.searchsorted(shingles, HOME)), prefix)]


def shared_by_sets(texts: DataFrame, some) -> tuple[DataFrame, DataFrame]:
    """(set_id, w) of the shingles that ``some`` takes of each of ``texts(set_id, text)``, and (w, n_sets) of those that several sets have, a staged table."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([some(t) for t in texts], dtype=object)

    grams = texts.select("set_id", F.explode(of("text")).alias("w"))
    return grams, stage(grams.groupBy("w").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1"), "shared-shingles")


def likely_sets(texts: DataFrame) -> DataFrame:
    """``texts(set_id, text, n, home)`` without those that have too many shingles below ``HOME`` to themselves; a staged table."""
    grams, rarity = shared_by_sets(texts, leading_shingles)
    shared = grams.join(rarity, "w").groupBy("set_id").agg(F.count_if(F.col("w") < HOME).alias("shared"))
    asked = stage(shared.join(texts.select("set_id", "n", "home"), "set_id").where(F.col("home") - F.col("shared") < prefix_size(F.col("n"))).select("set_id"), "likely-sets")
    drop(rarity)
    return stage(texts.join(asked.hint("merge"), "set_id", "left_semi"), "likely-texts", compression="zstd")


def shared_shingles(texts: DataFrame) -> DataFrame:
    """(set_id, n, alone, rest, w): the indexed shingles of ``texts(set_id, text, n)``: those that other sets have too among the
    first of each set, of which a near copy has one; a staged table. rest: how many of the set's shared shingles come after
    it; alone: the share of the set's shingles that no other set has.
    """
    grams, rarity = shared_by_sets(texts, text_shingles)
    found = grams.join(rarity, "w").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("n_sets", "w"))).alias("r"))
    k = F.size("r")
    rows = found.join(texts.select("set_id", "n"), "set_id").withColumn("room", (prefix_size(F.col("n")) - (F.col("n") - k)).cast("int")).where("room > 0")
    index = rows.select("set_id", "n", k.alias("k"), F.posexplode(F.slice("r", F.lit(1), F.col("room"))).alias("pos", "x"))
    out = stage(index.select("set_id", "n", (1 - F.col("k") / F.col("n")).alias("alone"), (F.col("k") - F.col("pos") - 1).alias("rest"), F.col("x.w").alias("w")), "rare-shingles")
    drop(rarity)
    return out


def near_links(texts: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b) with a < b: near copies whose components are those of all pairs of 0.8 or more.

    texts: set_id, text, n, home, a staged table, no two sets equal; bits: set_id, bits.
    """
    likely = likely_sets(texts)
    drop(texts)
    indexed = shared_shingles(likely)
    v = F.struct("set_id", "n", "rest", "alone", "bits").alias("v")
    index = stage(indexed.join(bits, "set_id").select("w", v), "rare-sets")
    drop(indexed)

    @F.pandas_udf("array<long>")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([text_shingles(t) for t in texts], dtype=object)

    met = index.groupBy("w").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("w")
    asked = index.join(met, "w", "left_semi").select("v.set_id").distinct()
    held = stage(likely.join(asked, "set_id", "left_semi").select("set_id", "n", whole("text").alias("r")), "whole-sets")
    drop(likely)

    def near(candidates: DataFrame) -> DataFrame:
        pairs = candidates.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()
        a, b = (held.select(F.col("set_id").alias(s), F.col("r").alias(f"r{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
        both = F.size(F.array_intersect("ra", "rb"))
        return pairs.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")

    links = texts.sparkSession.createDataFrame([], "a long, b long")
    members, before = index, None
    for round_ in range(HUB_ROUNDS + 1):
        if round_:
            roots = stage(components(links), "near-roots")
            rooted = members.join(roots, F.col("v.set_id") == F.col("node"), "left").select("w", "v", F.coalesce("root", "v.set_id").alias("root"))
        else:
            roots, rooted = None, members.select("w", "v", F.col("v.set_id").alias("root"))
        by_root = rooted.groupBy("w", "root").agg(F.count(F.lit(1)).alias("m"), F.bool_or(is_strong("v")).alias("strong"))
        largest = by_root.groupBy("w").agg(F.max_by("root", F.struct("m", "root")).alias("major"), F.max("m").alias("most"), F.sum("m").alias("size"), F.bool_or("strong").alias("strong"))
        buckets = stage(largest.where("strong and size > most").select("w", "major", (F.col("size") * (F.col("size") - F.col("most"))).alias("pairs")), "near-buckets")
        live = stage(rooted.join(buckets, "w").select("w", "v", "root", (F.col("root") == F.col("major")).alias("major")), "near-members")
        # A bucket that is one component stays one: the next round reads the live buckets' members only.
        drop(*[t for t in (before, roots) if t is not None])
        members, before = live.select("w", "v"), live
        left = buckets.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            return links
        if round_ == HUB_ROUNDS or left <= FEW_PAIRS * live.count():
            break
        order = F.struct("v.alone", "v.set_id") if round_ == 0 else F.struct(F.xxhash64("v.set_id", F.lit(round_)), "v.set_id")
        hubs = stage(live.groupBy("w").agg(F.min_by(F.struct("v", "root"), order).alias("h")), "near-hubs")
        met = live.select("w", F.col("v").alias("x"), "root").join(hubs.select("w", F.col("h.v").alias("y"), F.col("h.root").alias("hub_root")), "w")
        found = near(met.where(F.col("root") != F.col("hub_root")).where(can_be_near("x", "y")))
        links = stage(links.union(found), "near-links")
        drop(buckets, hubs)

    minor = live.where("not major").select("w", F.col("v").alias("x"), F.col("root").alias("root_x"))
    every = live.select("w", F.col("v").alias("y"), F.col("root").alias("root_y"), "major")
    once = F.col("major") | (F.col("root_x") < F.col("root_y"))
    met = minor.where(is_strong("x")).join(every, "w").union(minor.where(~is_strong("x")).join(every.where(is_strong("y")), "w"))
    return stage(links.union(near(met.where(once).where(can_be_near("x", "y")))), "near-links")


def near_classes(rows: DataFrame) -> DataFrame:
    """(__row, doc_id, tie, root) for ``rows(__row, doc_id, text)`` of a staged table: root names the row's class."""
    small_batches(rows.sparkSession)
    key = ["h", "h2", "n"]
    with temporary() as stay:
        found = stage(set_keys(rows), "set-keys")
        firsts = stage(found.groupBy(*key).agg(F.min("__row").alias("set_id"), F.min("home").alias("home")), "first-rows")
        first_keys = firsts.select(F.col("set_id").alias("__row"), "n", "home").hint("merge")
        texts = stage(rows.select("__row", "text").join(first_keys, "__row").select(F.col("__row").alias("set_id"), "text", "n", "home"), "set-texts", compression="zstd")
        roots = components(near_links(texts, found.select(F.col("__row").alias("set_id"), "bits")))
        named = stage(firsts.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(*key, F.coalesce("root", "set_id").alias("root")), "near-names")
        classes = stage(found.select("__row", "doc_id", "tie", *key).join(named, key).select("__row", "doc_id", "tie", "root"), "near-classes")
        stay.append(classes)
    return classes


def keep_one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest ``doc_id``; columns unchanged."""
    with shuffles_removed(docs.sparkSession):
        rows = numbered(docs)
        return first_of_each(rows, near_classes(fields(rows)))
