"""Removal of long repeated byte strings by bucket-pointer refinement.

A byte goes if some string of ``length`` bytes that covers it also starts at another
place, in the same text or any other. As in a suffix array built by bucket-pointer
refinement, places are first put into buckets by a q-gram, and a bucket is refined by
sorting its members on the bucket identifiers at later offsets; the identifiers so renewed are
used in turn for twice the offset (see ``rolling``). A bucket is refined only as far as the
answer needs, and set at a time over all texts:

1. Anchors (see ``rolling``) are bucketed by their q-gram's identifier and refined by those at the later and
   earlier offsets that cover all windows that picked the anchor. Anchors that share
   both have only repeated windows; an anchor alone in its bucket has none.
2. The others' windows go into nodes of ``NODE`` windows: bucketed by the identifiers at offsets that cover
   what the node's windows have in common, refined by those that cover all of it. The same holds of them.
3. What is left are single windows, bucketed by their identifiers at all offsets.

Instead of ranks, identifiers are 64-bit names that are equal wherever the bytes are, so that the one at
a later offset is at hand without a shuffle; Spark's grouping by (bucket, refined bucket) is the sort.
From a bucket's parts one member stands for all in the next round, with their
number as its weight. A round is two aggregations, counted in each partition before
they are shuffled, and one join of rows to counts, both of whose sides come straight
from an exchange, so Spark splits hot buckets. No round pairs the members of a bucket.

Defined results: null text counts as empty; texts shorter than ``length`` have nothing
removed; repeated rows repeat each other's strings and are both emptied of them; rows
that share a ``doc_id``, null or not, are told apart by two 64-bit hashes of id and text; any
type of ``doc_id`` is kept as it is; an empty table gives an empty result; other columns are ignored. Strings
count as equal when two 64-bit names of theirs (of the bucket and of the part) agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop, shuffles_removed, small_batches, stage
from docloom.llm.rolling import BLOCK, Buckets, all_anchors, mixed

LENGTH, Q, NODE = 200, 50, 8
TEXTS_AT_ONCE = 2000
ROW = "doc long, tag long, bucket long, part long, at long, first int, last int, weight long"
_ROW = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("bucket", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("weight", pa.int64())])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, tag, data): the text's bytes, and two hashes of id and text that tell rows apart; equal rows share them."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull()
    return docs.select("doc_id", F.xxhash64(*name, data).alias("doc"), F.xxhash64(data, *name).alias("tag"), data.alias("data"))


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, f.type, safe=False) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def anchor_rows(texts: DataFrame, length: int, q: int) -> DataFrame:
    """Round 1: a row per anchor, bucketed by its q-gram, its part being all its surroundings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                doc, tag = (some.column(c).to_numpy() for c in ("doc", "tag"))
                for found in all_anchors(some.column("data").to_pylist(), length, q):
                    r = found.row
                    yield _batch([doc[r], tag[r], found.gram, found.around, found.at, found.first, found.last, np.ones(len(r), np.int64)])

    return texts.select("doc", "tag", "data").mapInArrow(scan, ROW)


def split_buckets(rows: DataFrame, name: str) -> DataFrame:
    """Rows of buckets with more than one member, with ``n``, their part's weight, and ``alone``, the bucket's parts of weight 1."""
    parts = stage(rows.groupBy("bucket", "part").agg(F.sum("weight").alias("n")), name + "-parts")
    shared = stage(
        parts.groupBy("bucket").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("alone")).where("total > 1").drop("total"),
        name + "-buckets",
    )
    known = stage(parts.join(shared, "bucket"), name + "-known")
    out = stage(rows.join(known, ["bucket", "part"]), name)
    drop(parts, shared, known)
    return out


def unresolved(split: DataFrame) -> DataFrame:
    """The members that the next round looks at: those alone in their part, and one for each other part beside them."""
    alone = split.where("n = 1")
    beside = split.where("n > 1 and alone > 0").dropDuplicates(["bucket", "part"])
    return alone.unionByName(beside).select("doc", "tag", "at", "first", "last", F.col("n").alias("weight"))


def repeated(split: DataFrame, length: int) -> DataFrame:
    """(doc, tag, start, end) covered by the windows of members that share their part."""
    return split.where("n > 1").select("doc", "tag", (F.col("at") - F.col("first")).alias("start"), (F.col("at") - F.col("last") + length).alias("end"))


def _with_items(texts: DataFrame, items: DataFrame, fields: list[str], how: str) -> DataFrame:
    """``texts`` with the array ``items`` of their rows: as many as a text has positions at most."""
    lists = items.groupBy("doc", "tag").agg(F.collect_list(F.struct(*fields)).alias("items"))
    return texts.join(lists, ["doc", "tag"], how)


def next_rows(texts: DataFrame, items: DataFrame, length: int, q: int, node: int) -> DataFrame:
    """Rounds 2 and 3: the items' windows in nodes of ``node`` windows, counted back from the anchor.

    bucket: the bytes common to the node's windows; part: all its bytes, or, where the text ends within, a part of its own.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, data, lists in zip(*(batch.column(c) for c in ("doc", "tag", "data")), batch.column("items"), strict=True):
                text, values = np.frombuffer(data.as_buffer(), np.uint8), lists.values
                at, first, last, weight = (values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("at", "first", "last", "weight"))
                # One row per node: numbers of the nodes that an item's windows touch.
                low, high = last // node, first // node
                many = high - low + 1
                item = np.repeat(np.arange(len(at)), many)
                number = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + low[item]
                near, far = np.maximum(last[item], number * node), np.minimum(first[item], number * node + node - 1)
                where = at[item]
                order = np.argsort(where, kind="stable")
                item, number, near, far, where = item[order], number[order], near[order], far[order], where[order]
                begin = 0
                while begin < len(where):  # a long text in stretches that fit into a block
                    origin = max(0, int(where[begin]) - 2 * length)
                    end = int(np.searchsorted(where, origin + BLOCK - 4 * length, "right"))
                    buckets = Buckets(text[origin : origin + BLOCK], q)
                    size = min(len(text) - origin, BLOCK)
                    place, k = where[begin:end] - origin, number[begin:end]
                    start, stop = place - k * node - (node - 1), place - k * node + length
                    common = buckets.names(start + node - 1, stop - node + 1)
                    bucket = mixed(common ^ (k * 64 + node).astype(np.uint64))
                    whole = (start >= 0) & (stop <= size)
                    inside = np.where(whole, start, 0), np.where(whole, stop, length)
                    text_key = mixed(np.array([doc.as_py(), tag.as_py()], np.int64).view(np.uint64))
                    own = mixed(mixed((where[begin:end] * 256 + k).astype(np.uint64)) ^ text_key[0] ^ (text_key[1] << np.uint64(1)))
                    part = np.where(whole, buckets.names(*inside), own)
                    n = end - begin
                    yield _batch([np.full(n, doc.as_py(), np.int64), np.full(n, tag.as_py(), np.int64), bucket, part, where[begin:end], far[begin:end], near[begin:end], weight[item[begin:end]]])
                    begin = end

    found = _with_items(texts, items, ["at", "first", "last", "weight"], "inner")
    return found.select("doc", "tag", "data", "items").mapInArrow(scan, ROW)


def _without(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[dict]]:
    """The bytes outside ``spans``, and the spans merged where they meet."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    kept, at = [], 0
    for start, end in merged:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]]), [{"start": s, "end": e} for s, e in merged]


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed (spans of bytes), kept (the other bytes)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = keyed(docs)
    node = min(NODE, length - q + 1)  # what a node's windows have in common must hold a q-gram
    with shuffles_removed(spark):
        rows = stage(anchor_rows(texts, length, q), "anchors")
        split = split_buckets(rows, "repeats-1")
        drop(rows)
        spans = repeated(split, length)
        for nth, size in ((2, node), (3, 1)):
            rows = stage(next_rows(texts, unresolved(split), length, q, size), f"nodes-{nth}")
            split = split_buckets(rows, f"repeats-{nth}")
            drop(rows)
            spans = spans.union(repeated(split, length))

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    names = ["doc_id", "n_bytes", "removed", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                data = some.column("data").to_pylist()
                found = [_without(d, [(x["start"], x["end"]) for x in items or []]) for d, items in zip(data, some.column("items").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array([s for _, s in found], pa.list_(span)), pa.array([k for k, _ in found], pa.binary())],
                    names=names,
                )

    whole = _with_items(texts, spans.distinct(), ["start", "end"], "left")
    return whole.select("doc_id", "data", "items").mapInArrow(cut, f"doc_id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def removed_bytes(removed: Column) -> Column:
    return F.aggregate(removed, F.lit(0).cast("long"), lambda acc, s: acc + s.end - s.start)
