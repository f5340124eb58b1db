"""Mixing sources to target weights: Pfair scheduling.

Each source's documents form blocks of equal size. With weight w (a share of all slots), block j of a
source is released at floor(j / w) and due at ceil((j + 1) / w); in each slot the released block with
the earliest deadline goes. A source is then never a whole block ahead of its weight or behind it.

Weights are taken exactly as given (floats as fractions), so no rounding adds up over the corpus. The schedule is made on the
driver from weights and numbers of blocks: one step for each block. A block has BLOCK documents, or more in a corpus that would have
over BLOCKS of them, so the driver's work and what is broadcast have a bound. A source that has run out leaves its share
free; sources with weight 0 come after all others. Documents get their number in their source by counts of hash ranges, so a source
that holds a third of all rows is numbered in many tasks.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction
from math import isqrt, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents in a block, documents that one task numbers at most, about, and blocks up to which the schedule is broadcast.
BLOCK, CHUNK, SMALL = 16, 2_000, 1_000_000
#: Blocks that the schedule has at most, about (blocks get larger beyond), and sources; more of these are an error.
BLOCKS, SOURCES = 1 << 18, 100_000


def deal(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """All blocks by earliest deadline first: source, block, slot, release, deadline. Ties go by deadline of the next block, then name.

    Weights count relative to their sum. Sources with weight 0 share the slots after all others equally."""
    exact = {s: Fraction(weights.get(s, 0)) for s in blocks}
    start = 0
    for phase in ({s: w for s, w in exact.items() if w > 0}, {s: Fraction(1) for s, w in exact.items() if w <= 0}):
        scale = lcm(*(w.denominator for w in phase.values()))
        whole = {s: int(w * scale) for s, w in phase.items()}
        total = sum(whole.values())
        release = lambda s, j: start + j * total // whole[s]  # noqa: B023, E731
        due = lambda s, j: start - (-(j + 1) * total // whole[s])  # noqa: B023, E731
        waiting = [(start, s, 0) for s in sorted(phase) if blocks[s]]
        heapq.heapify(waiting)
        ready: list[tuple[int, int, str, int]] = []
        t = start
        while waiting or ready:
            if not ready:
                t = max(t, waiting[0][0])
            while waiting and waiting[0][0] <= t:
                _, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (due(s, j), due(s, j + 1), s, j))
            d, _, s, j = heapq.heappop(ready)
            yield s, j, t, release(s, j), d
            if j + 1 < blocks[s]:
                heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
            t += 1
        start = t


def _counts(docs: DataFrame) -> list[tuple[str, int]]:
    """The sources with their numbers of documents."""
    found = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s")).count().limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    return [(s, n) for s, n in found]


def target_slots(docs: DataFrame, weights: dict[str, float] | None = None) -> dict[str, float]:
    """The weight of each source of docs: of weights (0 where it has none), else the root of its count. A null source and '' are one source, named ''."""
    counts = dict(_counts(docs))
    return {s: max(0.0, float(weights.get(s, 0.0))) if weights is not None else isqrt(n << 20) for s, n in counts.items()}


def numbered(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (doc_id, source) -> the same columns and rank, from 0 in each source, in the order of the key's hash, where the key is null of the whole row's.

    Rows with equal keys are ranked one after another."""
    total = docs.agg(F.count("*")).first()[0]
    bits = max(0, (total // CHUNK).bit_length())
    hashed = docs.withColumn("_h", F.when(F.col(key).isNull(), F.xxhash64(*docs.columns)).otherwise(F.xxhash64(key))).withColumn("_s", F.coalesce(F.col("source").cast("string"), F.lit("")))
    hashed = hashed.withColumn("_c", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = hashed.groupBy("_s", "_c").agg(F.count("*").alias("n"))
    sizes = sizes.select("_s", "_c", F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_c").orderBy("_h", key)))
    return ranked.join(sizes, ["_s", "_c"]).withColumn("rank", F.col("_before") + F.col("_r") - 1).drop("_h", "_c", "_r", "_before")


def mix(docs: DataFrame, slots: dict[str, float], block: int | None = None) -> DataFrame:
    """docs (doc_id, source, more) -> the same columns with block (in the source), slot, place (in the slot), release and deadline (slots).

    slots: weights of the sources, relative to their sum. No document is dropped or repeated: a source that has run out leaves its share
    free, one without a weight comes last. A null source and '' are one source. Columns of those five names are replaced. Read in the order of
    slot and place."""
    spark: SparkSession = docs.sparkSession
    added = ["block", "slot", "place", "release", "deadline"]
    docs = docs.select(*(c for c in docs.columns if c not in (*added, "rank")))
    counts = _counts(docs)
    block = block or max(BLOCK, -(-sum(n for _, n in counts) // BLOCKS))
    names = sorted(s for s, _ in counts)
    at, columns = {s: i for i, s in enumerate(names)}, [array("q") for _ in range(5)]
    for s, *numbers in deal(slots, {s: -(-n // block) for s, n in counts}):
        for column, x in zip(columns, (at[s], *numbers), strict=True):
            column.append(x)
    plan = pa.table([pa.array(names, pa.string()).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["_s", "block", "slot", "release", "deadline"])
    few = plan.num_rows <= SMALL
    plan = spark.createDataFrame(plan) if plan.num_rows else spark.createDataFrame([], "_s string, block long, slot long, release long, deadline long")
    rows = numbered(docs).withColumn("block", F.floor(F.col("rank") / block)).withColumn("place", F.col("rank") % block)
    return rows.join(F.broadcast(plan) if few else plan, ["_s", "block"]).select(*docs.columns, *added)


def in_order(docs: DataFrame, slots: dict[str, float], block: int | None = None) -> DataFrame:
    """docs in the mixed order (files and rows within them), with their own columns."""
    mixed = mix(docs, slots, block)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*(c for c in docs.columns))
