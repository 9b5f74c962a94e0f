"""Merkle manifest of a dataset: bitmap ranks give leaf coordinates, keyed slot arrays reduce levels (DataFrame functions only).

A row's leaf is the SHA-256 of its fields. The leaves of a language ascend by ``doc_id``;
every eight consecutive nodes become their hash until one is left, the subroot; subroots, by
language, reduce to the root in the same way.

No leaf is sorted. The ids of a language are a bitmap in words of 64: a word's mask is the
union of its rows' bits, so partial bitmaps merge as they are shuffled, and words without ids
don't exist. A popcount directory over the words, of four levels of at most 2 ** 14 entries
(2 ** 16 at the top), says how many rows come before each word. A row's place is then a rank
query: the rows before its word and the bits below its own. Rows whose word says that ids repeat are
counted by id and leaf instead, and ranked by 16 bits of the leaf before anything is ordered.

A place is a block and a slot. A block is an array of up to 512 nodes, put in place by slot; it
reduces three levels in one task. Blocks are the nodes of the next round, so a table of N rows takes
log512(N) rounds. Proofs come down the same way: a block hands each of its nodes what lies left and right of
it on every level, and above that what it was handed itself. Nothing is gathered but blocks.

Defined results: every null field counts as ``-``; a null ``doc_id`` comes before all others and is
never tampered with; rows that share a ``doc_id`` follow each other by leaf, equal rows are leaves of their own;
a null language comes first; an empty table gives an empty result; a single row is leaf, subroot
and root; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop, stage

FAN_BITS, LEVELS = 3, 3  # eight nodes become one; a block has three levels of them
BLOCK = 1 << (FAN_BITS * LEVELS)
WORD_BITS, ENTRY_BITS, STEPS = 6, 14, 4
NO_ID = -(1 << 58)  # a word below those of all ids
SPAN = 8192
FIELDS = ["doc_id", "source", "lang", "n_chars"]


def leaf(text: Column) -> Column:
    """The row's leaf with ``text`` as its text, in hex."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(F.col(f)) for f in FIELDS], part(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(k, word, doc_id, leaf, tampered): k orders languages, null first; tampered is null where the text stays."""
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("k"),
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), WORD_BITS), F.lit(NO_ID)).alias("word"),
        "doc_id",
        F.unhex(leaf(F.col("text"))).alias("leaf"),
        F.when(hit, F.unhex(leaf(lowered))).alias("tampered"),
    )


def bitmaps(rows: DataFrame) -> DataFrame:
    """(k, word, mask, n): the ids of each word as bits, and its rows."""
    bit = F.expr(f"shiftleft(1L, cast(doc_id & {(1 << WORD_BITS) - 1} AS INT))")
    return rows.groupBy("k", "word").agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("mask"), F.count(F.lit(1)).alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` with ``before``, the rows of k before the word's, and ``total``, all rows of k."""
    levels = [words.withColumnRenamed("word", "p0")]
    for i in range(1, STEPS):
        levels.append(levels[-1].groupBy("k", F.shiftright(f"p{i - 1}", ENTRY_BITS).alias(f"p{i}")).agg(F.sum("n").alias("n")))
    whole = Window.partitionBy("k").orderBy(f"p{STEPS - 1}")
    above = levels[-1].select(
        "*", F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("start"), F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total")
    )
    for i in reversed(range(STEPS - 1)):
        keys = ["k", f"p{i + 1}"]
        finer = levels[i].withColumn(f"p{i + 1}", F.shiftright(f"p{i}", ENTRY_BITS))
        inside = F.sum("n").over(Window.partitionBy(*keys).orderBy(f"p{i}").rowsBetween(Window.unboundedPreceding, -1))
        counted = finer.withColumn("inside", F.coalesce(inside, F.lit(0)))
        starts = above.select(*keys, F.coalesce("start", F.lit(0)).alias("above"), "total")
        above = counted.join(starts, keys).withColumn("start", F.col("inside") + F.col("above"))
    return above.select("k", F.col("p0").alias("word"), "mask", "n", F.col("start").alias("before"), "total")


def repeated_ids(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(k, pos, total, doc_id, leaf, tampered) of the rows whose word has an id more than once.

    Equal rows are counted and dealt out again as so many places, ``SPAN`` of them to a row that is shuffled.
    """
    met = stage(rows.join(words.select("k", "word", "before", "total"), ["k", "word"]), "repeated-ids")
    entry = ["k", "word", "id", "part"]
    different = met.groupBy("k", "word", F.coalesce("doc_id", F.lit(0)).alias("id"), F.hex(F.substring("leaf", 1, 2)).alias("part"), "before", "total", "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("m"))
    counted = stage(different, "repeated-leaves")
    parts = counted.groupBy(*entry).agg(F.sum("m").alias("m"))
    earlier = Window.partitionBy("k", "word").orderBy("id", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*entry, F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("m").over(Window.partitionBy(*entry).orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("inside", inside).join(starts, entry).withColumn("first", F.col("before") + F.col("start") + F.col("inside"))
    last = F.col("first") + F.col("m") - 1
    spans = placed.select("k", "total", "doc_id", "leaf", "tampered", last.alias("last"), F.explode(F.sequence("first", last, F.lit(SPAN).cast("long"))).alias("at"))
    each = F.sequence("at", F.least(F.col("at") + SPAN - 1, F.col("last")))
    return spans.repartition("k", "at").select("k", F.explode(each).alias("pos"), "total", "doc_id", "leaf", "tampered")


def placed_leaves(rows: DataFrame) -> tuple[DataFrame, int]:
    """(k, pos, total, doc_id, leaf, tampered) of ``leaves``, a staged table, and how many the largest language has."""
    words = stage(bitmaps(rows), "bitmaps")
    found = stage(directory(words), "directory")
    drop(words)
    most = found.agg(F.max("total")).first()[0] or 0
    alone = F.col("n") == F.bit_count("mask")
    below = F.expr(f"bit_count(mask & ~shiftleft(-1L, cast(doc_id & {(1 << WORD_BITS) - 1} AS INT)))")
    ranked = rows.join(found.where(alone).drop("n"), ["k", "word"]).select("k", (F.col("before") + below).alias("pos"), "total", "doc_id", "leaf", "tampered")
    repeated = found.where(~alone)
    return (ranked if repeated.isEmpty() else ranked.union(repeated_ids(rows, repeated))), most


def n_levels(n: int) -> int:
    """How often ``n`` nodes are reduced until one is left."""
    return 0 if n <= 1 else 1 + n_levels(-(-n >> FAN_BITS)) if n < 1 << 62 else 21


def _levels(total: Column) -> Column:
    return reduce(lambda a, b: a + b, [(total > (1 << (FAN_BITS * i))).cast("int") for i in range(21)])


def _reduced(nodes: Column) -> Column:
    """The hashes of every eight consecutive nodes."""
    fan = 1 << FAN_BITS
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * fan + 1, F.lit(fan)), ""), 256))


def blocks(nodes: DataFrame, nth: int) -> DataFrame:
    """(k, block, total, deep, slots, l0, l1, l2, top) of ``nodes(k, pos, total, node)``: the ``nth`` round of reducing, a staged table.

    node: a struct with the digest in hex and what else goes with it. deep: how many levels the block reduces, fewer
    than ``LEVELS`` where its language has no more; top: its last node.
    """
    slot = F.struct((F.col("pos") % BLOCK).cast("int").alias("slot"), "node")
    dealt = nodes.groupBy("k", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(slot)).alias("slots"))
    deep = F.least(F.lit(LEVELS), F.greatest(_levels(F.col("total")) - LEVELS * nth, F.lit(0)))
    rows = dealt.select("k", "block", "total", deep.alias("deep"), F.transform("slots", lambda s: s.node).alias("slots"))
    rows = rows.withColumn("l0", F.transform("slots", lambda s: s.digest))
    for i in range(1, LEVELS):
        rows = rows.withColumn(f"l{i}", F.when(F.col("deep") >= i, _reduced(F.col(f"l{i - 1}"))))
    last = F.when(F.col("deep") == LEVELS, _reduced(F.col(f"l{LEVELS - 1}")))
    return stage(rows.withColumn("top", F.coalesce(last, *[F.col(f"l{i}") for i in reversed(range(LEVELS))])[0]), "blocks", compression="zstd")


def reduced_to_roots(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The rounds of ``blocks`` until every k has one; ``most`` is the largest number of nodes of a k."""
    rounds = [blocks(nodes, 0)]
    while len(rounds) * LEVELS < n_levels(most):
        rounds.append(blocks(rounds[-1].select("k", F.col("block").alias("pos"), "total", F.struct(F.col("top").alias("digest")).alias("node")), len(rounds)))
    return rounds


def _with_paths(round_: DataFrame, handed: DataFrame) -> DataFrame:
    """(k, pos, node, path, ...) of a round's nodes: path has, level by level to the root, what lies left and right; handed(k, block, path, ...) has the blocks' own."""
    others = [c for c in handed.columns if c not in ("k", "block", "path")]
    fan = 1 << FAN_BITS

    def beside(i: Column, level: int) -> Column:
        at = F.shiftright(i, FAN_BITS * level)
        nth = at.bitwiseAND(F.lit(fan - 1))
        nodes = F.col(f"l{level}")
        return F.struct(F.array_join(F.slice(nodes, at - nth + 1, nth), "").alias("left"), F.array_join(F.slice(nodes, at + 2, fan - 1 - nth), "").alias("right"))

    def paths(node: Column, i: Column) -> Column:
        own = F.slice(F.array(*[beside(i, level) for level in range(LEVELS)]), F.lit(1), F.col("deep"))
        return F.struct((F.col("block") * BLOCK + i).alias("pos"), node.alias("node"), F.concat(own, "path").alias("path"))

    met = round_.join(handed, ["k", "block"])
    return met.select("k", *others, F.inline(F.transform("slots", paths)))


def proofs(rounds: list[DataFrame], handed: DataFrame) -> DataFrame:
    """(k, node, path, ...) of all nodes of the first round; handed(k, block, path, ...) has those of the last round's blocks."""
    for round_ in reversed(rounds[1:]):
        handed = stage(_with_paths(round_, handed).drop("node").withColumnRenamed("pos", "block"), "paths", compression="zstd")
    return _with_paths(rounds[0], handed)


def in_order(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``pos``, their place by a unique column: sorted in ranges, places from the ranges' sizes."""
    sorted_rows = rows.repartitionByRange(by).sortWithinPartitions(by)
    dealt = stage(sorted_rows.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return dealt.join(starts, "range").withColumn("pos", F.col("start") + F.col("nth")).drop("range", "nth", "start")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and what lies beside its path give."""
    return F.aggregate(path, start, lambda below, s: F.sha2(F.concat(s.left, below, s.right), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""

    def hexadecimal(digest: Column) -> Column:
        return F.lower(F.hex(digest))

    rows = stage(leaves(docs), "leaves")
    placed, most = placed_leaves(rows)
    node = F.struct(hexadecimal(F.col("leaf")).alias("digest"), "doc_id", hexadecimal(F.coalesce("tampered", "leaf")).alias("seen"))
    of_docs = reduced_to_roots(placed.select("k", "pos", "total", node.alias("node")), most)
    drop(rows)

    subroots = stage(in_order(of_docs[-1].select("k", "top"), "k"), "subroots")
    n = subroots.count()
    of_langs = reduced_to_roots(subroots.select(F.lit("").alias("k"), "pos", F.lit(n).cast("long").alias("total"), F.struct(F.col("top").alias("digest"), F.col("k").alias("name")).alias("node")), n)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = of_langs[-1].select("k", "block", nothing.alias("path"), F.col("top").alias("root"))
    langs = stage(proofs(of_langs, root).select(F.col("node.name").alias("k"), F.lit(0).cast("long").alias("block"), "path", F.col("node.digest").alias("subroot"), "root"), "lang-paths")

    found = proofs(of_docs, langs)
    beside = F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), "")
    done = found.select("node.doc_id", F.col("node.digest").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded(F.col("node.seen"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
