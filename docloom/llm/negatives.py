"""Hard negatives by exact integer inner products: subset-sum tables of anchors, indexed by candidates' bit-plane bytes.

A component x becomes floor(256 * x). For each group of eight dimensions an anchor has a
table of 256 sums, one for each subset of its eight components (the method of Four Russians). A
candidate is packed as bit planes: for each plane and group one byte, which says which of the eight
components have that bit. A score is then looked up instead of multiplied: the planes' bytes
index the tables, the sums of a plane's groups are added, and planes are added by shifting, from the sign
plane (in two's complement it counts negatively) downwards. All scores are exact.

Anchors are a stated query set and meet all rows, in blocks: a packed block of candidates is one row,
a block of anchors is copied to every slot (as many as shuffle partitions) and meets the blocks of candidates that the
slot got. Both kinds of blocks are cut from rows ordered by label, so the first pass, which looks for
positives, scores only blocks that share a label. The second pass looks for negatives below and
above the bounds that each positive sets. A task holds one block of each kind, and per anchor only the best rows
leave it, so no label is ever gathered, however many rows it has.

Defined results: rows with a null ``vec_id``, label or vector, or with null or non-finite components, take no part; so do those with a
component of which 256 times passes ``MOST``, whose scores wouldn't fit into a long; vectors of different lengths are compared as if the shorter ended in
zeros; rows that share a ``vec_id`` are rows of their own, and none is its own positive or negative; an anchor without positives or
negatives gives no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop, shuffle_partitions, small_batches, stage

GROUP = 8
ANCHORS_IN_BLOCK, CANDIDATES_IN_BLOCK = 256, 4096
POSITIVES, NEGATIVES = 5, 3
MOST = 1 << 23
LOW, HIGH = 50, 95  # hundredths of the positive's score
_SUBSETS = (np.arange(256)[:, None] >> np.arange(GROUP) & 1).astype(np.int64)


def quantised(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, v) of ``rows(vec_id, label, embedding)`` that take part: v has whole numbers, row tells rows apart."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) <= MOST))
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(F.coalesce(fits, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")
    )


def tables(anchors: np.ndarray) -> np.ndarray:
    """(anchors, groups, 256) subset sums of whole numbers of a length that ``GROUP`` divides."""
    return anchors.reshape(len(anchors), -1, GROUP) @ _SUBSETS.T


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of whole numbers in two's complement, the sign plane first."""
    planes = max(int(np.abs(values + (values < 0)).max(initial=0)).bit_length() + 1, 1)
    bits = values.T[None] >> np.arange(planes - 1, -1, -1)[:, None, None] & 1
    shape = (planes, values.shape[1] // GROUP, GROUP, len(values))
    return np.packbits(bits.astype(np.uint8).reshape(shape), axis=2, bitorder="little")[:, :, 0]


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One anchor's inner products with all packed candidates; groups that one side lacks count as zeros."""
    total = np.zeros(planes.shape[2], np.int64)
    for nth, plane in enumerate(planes):
        looked_up = np.zeros(planes.shape[2], np.int64)
        for sums, index in zip(table, plane, strict=False):
            looked_up += sums.take(index)
        total = (total << 1) + looked_up if nth else -looked_up
    return total


def _padded(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows, zeros at their ends up to a length that ``GROUP`` divides."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), -(-int(sizes.max(initial=0)) // GROUP) * GROUP), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


_BLOCK = "block long, labels array<long>, rows binary, ids binary, label binary, shape array<long>, body binary"
_BLOCK_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
_POSITIVE = "block long, anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long"
_NEGATIVE = "anchor_row long, positive_row long, negative_row long, negative_id long, negative_score long"


def _batch(rows: list[tuple], schema: str, types: list | None = None) -> Iterator[pa.RecordBatch]:
    if rows:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types or [pa.int64()] * len(names), strict=True)], names=names)


def packed_blocks(rows: DataFrame, size: int, pack, name: str) -> DataFrame:
    """``rows`` in blocks of at most ``size`` in order of label, a row each, a staged table; ``pack`` makes an array of a block's vectors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                row, ids, label = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "vec_id", "label"))
                body = np.ascontiguousarray(pack(_padded(part.column("v"))))
                packed = int(row[0]), np.unique(label).tolist(), row.tobytes(), ids.tobytes(), label.tobytes(), list(body.shape), body.tobytes()
                yield from _batch([packed], _BLOCK, _BLOCK_TYPES)

    order = ["label", "vec_id", "row"]
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _BLOCK), name)


def block_pairs(anchors: DataFrame, candidates: DataFrame, able: Column | None = None) -> DataFrame:
    """(a, c): every block of anchors beside every block of candidates for which ``able`` holds. Candidates are dealt over slots, anchors copied to each."""
    slots = shuffle_partitions(candidates.sparkSession)
    a = anchors.select(F.struct("*").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    c = candidates.select(F.struct("*").alias("c"), F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"))
    met = a.hint("merge").join(c.hint("merge"), "slot")
    return (met if able is None else met.where(able)).select("a", "c")


class _Block:
    """A packed block as arrays; its body is numbers (anchors) or bytes of bit planes (candidates)."""

    def __init__(self, packed: dict, kind: type) -> None:
        self.packed = packed
        self.rows, self.ids, self.label = (np.frombuffer(packed[c], np.int64) for c in ("rows", "ids", "label"))
        self.body = np.frombuffer(packed["body"], kind).reshape(packed["shape"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, np.ndarray, _Block]]:
    """(anchors, their tables, candidates) of each pair of blocks, one pair at a time; tables are kept while the same anchors come again."""
    anchors, table = None, None
    for batch in batches:
        for at in range(batch.num_rows):
            pair = batch.slice(at, 1).to_pylist()[0]
            if anchors is None or pair["a"]["block"] != anchors.packed["block"]:
                anchors = _Block(pair["a"], np.int64)
                table = tables(anchors.body)
            yield anchors, table, _Block(pair["c"], np.uint8)


def best_positives(pairs: DataFrame, most: int = POSITIVES) -> DataFrame:
    """Each anchor's best other rows of its label: scores descending, then ids. One row per anchor and positive, with the anchor's block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, table, others in _met(batches):
            out = []
            for at, (row, anchor_id, label) in enumerate(zip(anchors.rows.tolist(), anchors.ids.tolist(), anchors.label.tolist(), strict=True)):
                picked = np.flatnonzero((others.label == label) & (others.rows != row))
                found = scores(table[at], others.body[:, :, picked])
                best = np.lexsort((others.rows[picked], others.ids[picked], -found))[:most]
                of_best = zip(others.rows[picked[best]].tolist(), others.ids[picked[best]].tolist(), found[best].tolist(), strict=True)
                out += [(anchors.packed["block"], row, anchor_id, *b) for b in of_best]
            yield from _batch(out, _POSITIVE)

    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    return pairs.mapInArrow(find, _POSITIVE).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")


def best_negatives(pairs: DataFrame, most: int = NEGATIVES) -> DataFrame:
    """(anchor_row, positive_row, negative_row, negative_id, negative_score, rank): the best rows of other labels between the bounds of each positive.

    The blocks of anchors have ``bounds``, a list of (anchor_row, positive_row, positive_score).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, table, others in _met(batches):
            out = []
            of_row: dict[int, list[tuple[int, int]]] = {}
            for b in anchors.packed["bounds"]:
                of_row.setdefault(b["anchor_row"], []).append((b["positive_row"], b["positive_score"]))
            for at, row in enumerate(anchors.rows.tolist()):
                asked = of_row.get(row, [])
                if not asked:
                    continue
                hundredfold = 100 * scores(table[at], others.body)
                best, worst = max(s for _, s in asked), min(s for _, s in asked)
                picked = np.flatnonzero((others.label != anchors.label[at]) & (hundredfold <= HIGH * best) & (hundredfold >= LOW * worst))
                picked = picked[np.lexsort((others.rows[picked], others.ids[picked], -hundredfold[picked]))]
                falling = -hundredfold[picked]
                for positive, score in asked:
                    first = int(np.searchsorted(falling, -HIGH * score))
                    taken = picked[first : first + most]
                    taken = taken[hundredfold[taken] >= LOW * score]
                    out += [(row, positive, *b) for b in zip(others.rows[taken].tolist(), others.ids[taken].tolist(), (hundredfold[taken] // 100).tolist(), strict=True)]
            yield from _batch(out, _NEGATIVE)

    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    return pairs.mapInArrow(find, _NEGATIVE).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows(vec_id, label, embedding)``."""
    small_batches(rows.sparkSession)
    held = stage(quantised(rows), "quantised")
    asked = packed_blocks(held.where(is_anchor), ANCHORS_IN_BLOCK, lambda v: v, "anchor-blocks")
    candidates = packed_blocks(held, CANDIDATES_IN_BLOCK, bit_planes, "candidate-blocks")
    positives = stage(best_positives(block_pairs(asked, candidates, F.arrays_overlap("a.labels", "c.labels"))), "positives")
    bounds = positives.groupBy("block").agg(F.collect_list(F.struct("anchor_row", "positive_row", "positive_score")).alias("bounds"))
    bounded = stage(asked.join(bounds, "block"), "bounded-anchors")
    drop(held, asked)
    found = best_negatives(block_pairs(bounded, candidates))
    return found.join(positives, ["anchor_row", "positive_row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
