"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import new_path, small_enough, with_rank

#: Rows of a block; sources at most; blocks that the driver holds at once; slots that are broadcast at most.
BLOCK_ROWS, SOURCES, PIECE, BROADCAST = 32, 4096, 1 << 18, 2_000_000


def turns(units: Mapping) -> Iterator:
    """The source of each slot, without end, by the Pfair schedule.

    Block j of a source of weight w = units / their sum is released at
    floor((j - 1) / w) and due by ceil(j / w); of the released blocks, the one
    with the earliest deadline takes the next slot. After any number of slots
    each source is less than one block from its share.
    """
    whole, t = sum(units.values()), 0
    names = sorted(units, key=lambda s: (s is None, str(s)))
    waiting = [(0, i, 1) for i in range(len(names)) if units[names[i]]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    while True:
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * whole // units[names[i]]), i, j))
        _, i, j = heapq.heappop(ready)
        yield names[i]
        heapq.heappush(waiting, (j * whole // units[names[i]], i, j + 1))
        t += 1


def schedule(units: Mapping) -> dict:
    """One period of the schedule: each source's slots, in order, units[s] of them out of sum(units)."""
    slots: dict = {s: [] for s in units}
    for t, s in enumerate(islice(turns(units), sum(units.values()))):
        slots[s].append(t)
    return slots


def in_units(weights: Mapping) -> dict:
    """The smallest whole numbers in exactly the ratios of weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*[w.denominator for w in exact.values()])
    whole = {s: int(w * common) for s, w in exact.items()}
    shared = math.gcd(*whole.values())
    return {s: n // shared for s, n in whole.items()}


def placed(blocks: Mapping, weights: Mapping, slot: int = 0, phase: int = 0) -> Iterator[tuple]:
    """(source, block, slot, phase, active) for every block. A phase ends when a source has given its last block; those left go on at the same ratios."""
    units, done = in_units(weights), dict.fromkeys(weights, 0)
    left, whole = dict(units), sum(units.values())
    while left:
        active = sum(left.values()) / whole
        for s in turns(left):
            yield s, done[s], slot, phase, active
            done[s], slot = done[s] + 1, slot + 1
            if done[s] == blocks[s]:
                break
        left, phase = {o: n for o, n in left.items() if o != s}, phase + 1


def _slots(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """(s, block, slot, phase, active) of rows, written in pieces."""
    path = new_path(spark, "slots")
    types = pa.schema({"s": pa.string(), "block": pa.int64(), "slot": pa.int64(), "phase": pa.int32(), "active": pa.float64()})
    piece = list(islice(rows, PIECE))
    while True:
        columns = zip(*piece) if piece else [()] * 5
        arrays = [pa.array(c, t.type) for c, t in zip(columns, types)]
        spark.createDataFrame(pa.Table.from_arrays(arrays, schema=types)).write.mode("append").parquet(path)
        if not (piece := list(islice(rows, PIECE))):
            return spark.read.schema("s string, block long, slot long, phase int, active double").parquet(path)


def order_key(id_col: Column) -> Column:
    """What a source's rows are ordered by: the first 60 bits of the md5 of the id as text, null being empty."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Mapping | None = None, source_col: str = "source", id_col: str = "doc_id", temperature: float = 0.7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id_col, source, phase, slot, position, active_weight) for every row: its place in the mixture.

    A source's rows are put in hashed order and cut into blocks of block_rows;
    Pfair scheduling gives each block a slot. weights names sources' target
    weights (null is a source of its own; sources not named get weight 0 and
    follow all others, in phases of their own); by default they are the
    sources' row counts to the power temperature. Weights are held as exact
    ratios. The driver computes the slots from counts by source, never from
    rows, and holds PIECE of them at once; its time grows with the number of
    blocks. When a source is used up, the others go on at the same ratios in a
    new phase; active_weight is the share of the target weight that the sources
    of a phase hold, 1 in the first. No row is dropped or repeated here.
    position is gapless from 0.

    Null ids and repeated rows get places like any others. An empty table gives
    no rows. More than SOURCES sources are an error, as the driver holds a
    number for each and goes through all at the end of each phase. Texts, of
    any length, and other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(source_col).alias("source"))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).limit(SOURCES + 1).collect()}
    if len(counts) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    wanted = {s: n**temperature for s, n in counts.items()} if weights is None else {s: float(weights.get(s, 0)) for s in counts}
    if any(w < 0 for w in wanted.values()):
        raise ValueError("a weight is negative")
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    named = {s: w for s, w in wanted.items() if w > 0}
    rest = dict.fromkeys((s for s, w in wanted.items() if w == 0), 1)
    last: dict = {}

    def plan() -> Iterator[tuple]:
        others = placed(blocks, rest, sum(blocks[s] for s in named), len(named)) if rest else ()
        for s, block, slot, phase, active in chain(placed(blocks, named) if named else (), others):
            if block == blocks[s] - 1:
                last[s] = slot
            yield None if s is None else str(s), block, slot, phase, active if s in named else 0.0

    table = _slots(spark, plan())
    ranked = with_rank(rows.withColumn("_h", order_key(F.col(id_col))), "source", ["_h", id_col], "_r")
    ranked = ranked.withColumns({"_b": F.floor(F.col("_r") / block_rows).cast("long"), "_i": F.col("_r") % block_rows})
    found = ranked.join(small_enough(table, BROADCAST), F.col("source").cast("string").eqNullSafe(F.col("s")) & (F.col("_b") == F.col("block")))
    short = [(t, blocks[s] * block_rows - counts[s]) for s, t in last.items()]
    missing = F.lit(0).cast("long")
    short = [(t, m) for t, m in short if m]
    if short:
        gaps = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(m).cast("long").alias("m")) for t, m in short])
        missing = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + F.when(g["t"] < F.col("slot"), g["m"]).otherwise(F.lit(0).cast("long")))
    return found.select(id_col, "source", "phase", "slot", (F.col("slot") * block_rows + F.col("_i") - missing).alias("position"), F.col("active").alias("active_weight"))
