"""Near-duplicate embeddings by collision-counting projections; links are pairs with a cosine of 0.95 or more.

Unit vectors are projected on many random lines. Were each line counted alone, the windows of
all queries would hold over N^2 pairs whatever their width: a window takes near pairs at most
four and a half times as often as far ones. So lines are taken in bands. A band's first lines are cut into
cells with random offsets, its last one is sorted within them, and two vectors collide in a band if they share its cells and each
lies in the window of ``HALF`` around the other. Collisions are counted per pair over the
bands; pairs that reach the count are verified by their cosine in double precision. How many
lines a band has follows from the number of vectors (``PARTNERS`` chance collisions a vector and
band), how many bands from ``RECALL``: a pair at the threshold reaches ``COUNT`` collisions with that
probability, by the binomial distribution (``calibrated``); nearer pairs do so more often.

Copies are never paired. Vectors within half the threshold's angle of a leader, found in the cells of the first
bands, are its ball: all pairs of a ball are links, by the triangle inequality. Bands hold each ball
once per cell, with the range of its members there. For two balls that collide often enough the
angle of their leaders and their radii tell that all pairs between them are links, or none;
only in between are members compared, first with the other ball's leader and then, where
that leaves it open, with its members. Links are counted, not listed.

Defined results: a vector that is null, zero or has null or non-finite components links with
nothing and is a component of its own; vectors of different lengths are compared as if the shorter ended
in zeros; rows that share a ``vec_id`` count as vectors of their own; a null ``vec_id`` never names a
component unless all its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop, small_batches, stage
from docloom.operators.iterate import components

COSINE, SEED = 0.95, 20
CELL, HALF = 1.9, 0.64  # lengths on a line: of a cell, and of half a window
RECALL, COUNT, PARTNERS, LEAST_LINES = 0.9999, 2, 4, 4
BALL_ROUNDS = 3
SURE = 1e-9  # angles nearer than this to a bound are looked at again
ROWS_AT_ONCE = 2048


def collision_chance(cosine: float, lines: int) -> float:
    """Of colliding in a band of ``lines`` lines, for two unit vectors of that cosine."""
    apart = math.sqrt(2 - 2 * cosine)
    t = CELL / apart
    cell = math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))
    return cell ** (lines - 1) * math.erf(HALF / apart / math.sqrt(2))


def calibrated(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(lines of a band, bands) for ``n`` vectors."""
    lines = LEAST_LINES
    while n * collision_chance(0.0, lines) > PARTNERS:
        lines += 1
    p, bands = collision_chance(cosine, lines), COUNT
    while sum(math.comb(bands, i) * p**i * (1 - p) ** (bands - i) for i in range(COUNT)) > 1 - RECALL:
        bands += 1
    return lines, bands


class Lines:
    """The random lines of ``bands`` bands; the same seed gives the same lines in every task."""

    def __init__(self, dims: int, lines: int, bands: int) -> None:
        rng = np.random.default_rng(SEED)
        self.lines, self.bands = lines, bands
        self.direction = rng.normal(size=(bands, lines, dims))
        self.offset = rng.uniform(0, CELL, (bands, lines))
        self.odd = rng.integers(0, 1 << 63, (bands, lines), np.uint64) * 2 + 1

    def band(self, nth: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key of the cells, place on the last line) of each vector in a band."""
        found = units @ self.direction[nth].T + self.offset[nth]
        cells = np.floor(found[:, :-1] / CELL).astype(np.int64).view(np.uint64)
        return (cells * self.odd[nth, :-1]).sum(1, dtype=np.uint64).view(np.int64), found[:, -1]


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(row, vec_id, unit) of ``rows(vec_id, embedding)``: unit is null for vectors that link with nothing, else doubles of the longest vector's length; a staged table."""
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))
            out = np.zeros((len(sizes), max(dims, 1)))
            out[np.arange(out.shape[1]) < sizes[:, None]] = pc.fill_null(vectors.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
            largest = np.abs(out).max(1, initial=0)
            able = np.isfinite(largest) & (largest > 0)
            out[able] /= largest[able, None]
            out[able] /= np.sqrt((out[able] ** 2).sum(1))[:, None]
            units = pa.array([u.tobytes() if ok else None for u, ok in zip(out, able.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), units], names=["row", "vec_id", "unit"])

    vectors = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    return stage(vectors.mapInArrow(scaled, f"row long, vec_id {kind}, unit binary"), "units")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _with_numbers(rows: DataFrame, schema: str, of: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``rows`` through ``of``, batch by batch, as columns of long, int or double."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                found = of(batch.slice(at, ROWS_AT_ONCE))
                yield pa.RecordBatch.from_arrays([pa.array(found[name]).cast(kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])

    return rows.mapInArrow(run, schema)


def balls(units: DataFrame, lines: int, bands: int, cosine: float) -> DataFrame:
    """(row, ball, near) of all vectors: ball is a leader's row, near the cosine to it; a staged table.

    In each round the vectors that are in no ball yet meet one leader of their cell: one that leads already, or else the first of them.
    """
    dims = units.agg(F.max(F.octet_length("unit"))).first()[0] // 8
    inner = math.cos(math.acos(cosine) / 2) + SURE
    left = units.select("row", "unit", F.lit(False).alias("leads"))
    found = []
    for nth in range(min(BALL_ROUNDS, bands)):

        def keys(batch: pa.RecordBatch, nth: int = nth) -> dict:
            return {"row": batch.column("row"), "key": Lines(dims, lines, bands).band(nth, _matrix(batch.column("unit")))[0]}

        keyed = stage(left.join(_with_numbers(left.select("row", "unit"), "row long, key long", keys), "row"), "ball-keys")
        first = F.min_by(F.struct("row", "unit"), F.struct(~F.col("leads"), "row"))
        leaders = stage(keyed.groupBy("key").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("first.row").alias("ball"), F.col("first.unit").alias("centre")), "leaders")

        def near(batch: pa.RecordBatch) -> dict:
            cosines = (_matrix(batch.column("unit")) * _matrix(batch.column("centre"))).sum(1)
            keep = pa.array(cosines >= inner)
            return {"row": batch.column("row").filter(keep), "ball": batch.column("ball").filter(keep), "near": pa.array(cosines).filter(keep)}

        met = keyed.where(~F.col("leads")).hint("merge").join(leaders.hint("merge"), "key").where("row <> ball")
        found.append(stage(_with_numbers(met.select("row", "ball", "unit", "centre"), "row long, ball long, near double", near), "ball-members"))
        marks = found[-1].select("row", F.lit(True).alias("gone")).union(found[-1].select("ball", F.lit(False)).distinct())
        rest = keyed.join(marks, "row", "left").where("gone is null or not gone")
        left = stage(rest.select("row", "unit", (F.col("leads") | F.col("gone").isNotNull()).alias("leads")), "ball-rest")
        drop(keyed, leaders)
    alone = left.select("row", F.col("row").alias("ball"), F.lit(1.0).alias("near"))
    for part in found:
        alone = alone.union(part)
    return stage(alone, "balls")


def colliding_balls(members: DataFrame, lines: int, bands: int, dims: int) -> DataFrame:
    """(a, b) with a < b: balls that collide in ``COUNT`` bands or more. members: ball, unit."""

    def places(batch: pa.RecordBatch) -> dict:
        units, ball = _matrix(batch.column("unit")), batch.column("ball").to_numpy()
        drawn = Lines(dims, lines, bands)
        each = [drawn.band(nth, units) for nth in range(bands)]
        return {"band": np.repeat(np.arange(bands, dtype=np.int32), len(ball)), "key": np.concatenate([k for k, _ in each]), "ball": np.tile(ball, bands), "place": np.concatenate([p for _, p in each])}

    spread = _with_numbers(members.select("ball", "unit"), "band int, key long, ball long, place double", places)
    held = stage(spread.groupBy("band", "key", "ball").agg(F.min("place").alias("low"), F.max("place").alias("high")), "places")
    x, y = (held.select("band", "key", F.col("ball").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}")) for n in "ab")
    in_window = (F.col("low_b") - F.col("high_a") <= HALF) & (F.col("low_a") - F.col("high_b") <= HALF)
    met = x.hint("merge").join(y.hint("merge"), ["band", "key"]).where("a < b").where(in_window)
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("collisions")).where(F.col("collisions") >= COUNT).select("a", "b")


def _states(x: np.ndarray, y: np.ndarray, room: np.ndarray, cosine: float) -> np.ndarray:
    """1 where all pairs around x and y are links, 0 where none is, 2 where some may be; room is the sum of the radii."""
    cosines = (x * y).sum(1)
    angle, bound = np.arccos(np.clip(cosines, -1, 1)), math.acos(cosine)
    around = np.where(angle + room <= bound - SURE, 1, np.where(angle - room > bound + SURE, 0, 2))
    return np.where(room == 0, cosines >= cosine, around).astype(np.int32)


def vector_classes(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``rows(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    small_batches(rows.sparkSession)
    every = unit_vectors(rows)
    units = stage(every.where("unit is not null"), "able-units")
    n = units.count()
    if not n:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lines, bands = calibrated(n, cosine)
    dims = units.select(F.octet_length("unit")).first()[0] // 8

    of_ball = balls(units, lines, bands, cosine)
    members = stage(of_ball.join(units, "row"), "members")
    radius = F.when(F.count(F.lit(1)) > 1, F.acos(F.least(F.min("near"), F.lit(1.0))) + SURE).otherwise(0.0)
    sizes = members.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), radius.alias("radius"), F.min("vec_id").alias("first_id"))
    centres = stage(sizes.join(members.where("row = ball").select("ball", "unit"), "ball"), "centres")
    a, b = (centres.select(F.col("ball").alias(s), F.col("unit").alias(f"unit_{s}"), F.col("n").alias(f"n_{s}"), F.col("radius").alias(f"radius_{s}")) for s in "ab")
    candidates = stage(colliding_balls(members, lines, bands, dims), "candidates")

    def number(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False)

    def between(batch: pa.RecordBatch) -> dict:
        state = _states(_matrix(batch.column("unit_a")), _matrix(batch.column("unit_b")), number(batch, "radius_a") + number(batch, "radius_b"), cosine)
        return {c: batch.column(c) for c in ("a", "b", "n_a", "n_b")} | {"state": state}

    pairs = stage(_with_numbers(candidates.join(a, "a").join(b, "b"), "a long, b long, n_a long, n_b long, state int", between).where("state > 0"), "ball-pairs")

    # What the balls leave open: members of the larger one against the other's leader, then against its members.
    larger = F.when(F.col("n_a") >= F.col("n_b"), F.struct(F.col("a").alias("ball"), F.col("b").alias("other"))).otherwise(F.struct(F.col("b").alias("ball"), F.col("a").alias("other")))
    open_pairs = pairs.where("state = 2").select(larger.alias("p")).select("p.*")
    asked = stage(open_pairs.join(centres.select(F.col("ball").alias("other"), F.col("unit").alias("centre"), "radius", F.col("n").alias("n_other")), "other"), "open-pairs")

    def beside(batch: pa.RecordBatch) -> dict:
        state = _states(_matrix(batch.column("unit")), _matrix(batch.column("centre")), number(batch, "radius"), cosine)
        return {c: batch.column(c) for c in ("row", "ball", "other", "n_other")} | {"state": state}

    held = members.select("row", "ball", "unit")
    met = held.hint("merge").join(asked.hint("merge"), "ball")
    singles = stage(_with_numbers(met, "row long, ball long, other long, n_other long, state int", beside).where("state > 0"), "row-pairs")

    def exact(batch: pa.RecordBatch) -> dict:
        linked = (_matrix(batch.column("unit")) * _matrix(batch.column("unit_y"))).sum(1) >= cosine
        return {c: batch.column(c).filter(pa.array(linked)) for c in ("row", "y", "ball", "other")}

    left = stage(singles.where("state = 2").select("row", "ball", "other").join(held.select("row", "unit"), "row"), "open-rows")
    others = held.select(F.col("row").alias("y"), F.col("ball").alias("other"), F.col("unit").alias("unit_y"))
    lone = stage(_with_numbers(left.hint("merge").join(others.hint("merge"), "other"), "row long, y long, ball long, other long", exact), "row-links")

    sure, by_row = pairs.where("state = 1"), singles.where("state = 1")
    links = sure.select("a", "b").union(by_row.select("ball", "other").distinct()).union(lone.select("ball", "other").distinct())
    roots = stage(components(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "roots")
    more = sure.select(F.col("a").alias("ball"), F.col("n_b").alias("more")).union(sure.select("b", "n_a")).union(by_row.groupBy("other").agg(F.count(F.lit(1))))
    ball_more = more.groupBy("ball").agg(F.sum("more").alias("of_ball"))
    row_more = by_row.select("row", F.col("n_other").alias("more")).union(lone.select("row", F.lit(1))).union(lone.select("y", F.lit(1))).groupBy("row").agg(F.sum("more").alias("of_row"))
    known = stage(centres.select("ball", "n", "first_id").join(ball_more, "ball", "left").join(roots.withColumnRenamed("node", "ball"), "ball", "left").withColumn("root", F.coalesce("root", "ball")), "known-balls")
    named = stage(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    per_ball = stage(known.join(named, "root").select("ball", (F.col("n") - 1 + F.coalesce("of_ball", F.lit(0))).alias("of_ball"), "component_id"), "named-balls")
    linked = stage(of_ball.select("row", "ball").join(per_ball, "ball").join(row_more, "row", "left").select("row", (F.col("of_ball") + F.coalesce("of_row", F.lit(0))).alias("n_links"), "component_id"), "linked-rows")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return every.join(linked, "row", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
