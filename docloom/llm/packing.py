"""Bounded-space online packing of token documents into fixed-length sequences.

Each partition keeps ``open_windows`` windows. A document (its ids and an end id)
is first cut into whole sequences; what is left goes into the open window that it
fits best. When it fits none and all windows are in use, the fullest is topped up
with the document's next ids and emitted, and the rest is placed again. So only
the windows that are open at a partition's end are partly filled: these leftovers
are merged, the windows of ``MERGED_TOGETHER`` partitions in one small task, by
filling sequences one after the other. The last sequence of such a task is cut
into lengths that are powers of two, which need no padding.

A task holds ``open_windows`` windows and one batch of rows; a merging task at most
``MERGED_TOGETHER * open_windows`` windows. Sequence ids come from partition and
counter, so a task that is run again gives the same rows.

Defined results: a null or empty text is one piece, the end id alone; texts of any
length are packed whole; repeated rows are packed as often as they come; a null
``doc_id`` is kept, and ids keep all 64 bits beside it; ids are whole numbers, and an id that is not one (a text) is an
error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.deploy import ship_file
from docloom.llm.bpe import merging_encoder
from docloom.llm.common import small_batches, stage

CAPACITY, OPEN_WINDOWS, END_ID, MERGED_TOGETHER = 2048, 16, 1, 64
MERGED_FROM = 1 << 62
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = [f.split(" ")[0] for f in PIECE.split(", ")]
_ARROW = pa.schema([(f, pa.int64()) for f in FIELDS] + [("task", pa.int64()), ("is_open", pa.bool_()), ("ids", pa.binary())])
_MERGED = pa.schema([*((f, pa.int64()) for f in FIELDS), ("ids", pa.binary())])


class Windows:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.open: list[list] = []  # [filled, pieces]
        self.full: list[list] = []  # pieces of finished windows

    def _put(self, window: list, piece: tuple) -> None:
        window[0] += len(piece[2])
        window[1].append(piece)
        if window[0] == self.capacity:
            self.full.append(window[1])
            self.open.remove(window)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while total - at >= self.capacity:
            self.full.append([(doc_id, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        while at < total:
            left = total - at
            fitting = [w for w in self.open if w[0] + left <= self.capacity]
            if fitting:
                window, size = max(fitting, key=lambda w: w[0]), left
            elif len(self.open) < self.most:
                window, size = [0, []], left
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                size = self.capacity - window[0]
            self._put(window, (doc_id, at, ids[at : at + size], total))
            at += size


def _rows(pieces: list[tuple], sequence_id: int, with_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, total in pieces:
        raw = ids.astype("<u4").tobytes()
        yield doc_id, start, len(ids), zlib.crc32(raw), total, sequence_id, offset, raw if with_ids else None
        offset += len(ids)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ids: the piece as little-endian unsigned 32-bit integers, null unless ``with_ids``.
    """

    tokenizer = ship_file(docs.sparkSession, tokenizer_path)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows, task, sequence = merging_encoder(SparkFiles.get(tokenizer)), Windows(capacity, open_windows), TaskContext.get().partitionId(), 0

        def batch(found: list[list[tuple]], is_open: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for pieces in found:
                rows += [(*r[:-1], task, is_open, r[-1]) for r in _rows(pieces, (task << 32) + sequence, with_ids or is_open)]
                sequence += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for rows in batches:
            ids = rows.column("doc_id").to_pylist()
            texts = rows.column("text").to_pylist()
            for at in range(0, len(ids), 1024):
                for doc_id, x in zip(ids[at : at + 1024], encoder.encode(texts[at : at + 1024]), strict=True):
                    windows.add(doc_id, np.append(x, np.uint32(end_id)))
                yield from batch(windows.full, False)
                windows.full = []
        yield from batch([w[1] for w in windows.open], True)

    small_batches(docs.sparkSession)
    placed = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, f"{PIECE}, task long, is_open boolean, ids binary"), "pieces")

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        held = zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
        pieces = [(doc_id, start, np.frombuffer(ids, "<u4"), total) for doc_id, start, ids, total in held]
        left = sum(len(p[2]) for p in pieces)
        sizes = [capacity] * (left // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (left % capacity) >> b & 1]
        out, queue = [], iter(pieces)
        piece = next(queue, None)
        for nth, size in enumerate(sizes):
            window, room = [], size
            while room:
                doc_id, start, ids, total = piece
                taken = min(room, len(ids))
                window.append((doc_id, start, ids[:taken], total))
                room -= taken
                piece = (doc_id, start + taken, ids[taken:], total) if taken < len(ids) else next(queue, None)
            out += _rows(window, MERGED_FROM + (key[0].as_py() << 32) + nth, with_ids)
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _MERGED.types, strict=True)], schema=_MERGED)

    # The leftovers of a bounded number of tasks make one group, whatever the size of the table.
    leftovers = placed.where("is_open").withColumn("part", F.expr(f"task div {MERGED_TOGETHER}"))
    merged = leftovers.groupBy("part").applyInArrow(merge, f"{PIECE}, ids binary")
    return placed.where("not is_open").select(*FIELDS, "ids").union(merged)
