"""Mixing sources to target weights: Pfair windows per source block, interleaved earliest deadline first.

DataFrame functions only. The driver plans with one entry per kind of source (its weight and rows)
and writes the plan as a table, a bounded piece at a time; rows are never collected.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sluice.llm.shared import documents, materialize, new_path

#: Rows of a block.
BLOCK_ROWS = 16
#: Row numbers are dealt inside hash ranges, so that no source is one task: 1024 ranges of a source, or
#: twice as many, again and again, until the largest source has at most RANGE_ROWS rows a range.
RANGES, RANGE_ROWS = 1024, 1 << 16
#: Sources of a run at most, and runs that the driver holds at once.
PIECE, HELD = 1024, 1 << 16

_PLAN = ("__g", "mix_block", "__from", "__count", "__at", "mix_release", "mix_deadline", "__row", "__rows")


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of weights. What isn't positive gets 2**-20 of the least that is."""
    least = min((w for w in weights if w > 0), default=1.0)
    exact = [Fraction(w) if w > 0 else Fraction(least) / (1 << 20) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    return [int(w * scale) for w in exact]


def edf_runs(groups: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(group, block, first member, members, slot, release, deadline): whose blocks fill the slots from 0 on.

    groups: (whole weight w, blocks n of each member, members); members' windows are equal. In the
    ideal division at virtual time v every source has had min(wv, n) blocks, so all of them together
    T(v), which is the slot: sources that run out leave their share to the others at once. Block j
    (from 0) has release floor(T(j/w)) and deadline ceil(T((j+1)/w)), in whole numbers without
    rounding; in each slot, of the released blocks that with the earliest deadline runs (ties: the
    larger weight, then the earlier group, then the earlier member).
    """
    order = sorted((i for i, g in enumerate(groups) if g[1] and g[2]), key=lambda i: Fraction(groups[i][1], groups[i][0]))
    active, gone, phases = sum(groups[i][0] * groups[i][2] for i in order), 0, []
    for i in order:  # until this group runs out: its weight and blocks, blocks of those that ran out before, weight of the others
        w, n, m = groups[i]
        phases.append((w, n, gone, active))
        gone, active = gone + n * m, active - w * m
    phase, block = [0] * len(groups), [0] * len(groups)
    future, ready, t = [(0, i) for i in sorted(order)], [], 0
    while future or ready:
        while future and future[0][0] <= t:
            release, i = heapq.heappop(future)
            w, n, _ = groups[i]
            j = block[i] = block[i] + 1
            while j * phases[phase[i]][0] > phases[phase[i]][1] * w:
                phase[i] += 1
            _, _, before, others = phases[phase[i]]
            whole, part = divmod(j * others, w)
            heapq.heappush(ready, (before + whole + (part > 0), -w, i, j - 1, 0, release))
            if j < n:
                heapq.heappush(future, (before + whole, i))
        deadline, minus, i, j, member, release = heapq.heappop(ready)
        count = groups[i][2] - member
        if future:
            count = min(count, future[0][0] - t)
        if t + count > deadline:
            raise AssertionError("a block missed its deadline")
        yield i, j, member, count, t, release, deadline
        t += count
        if member + count < groups[i][2]:
            heapq.heappush(ready, (deadline, minus, i, j, member + count, release))


def edf_slots(shares: list[int]) -> list[list[int]]:
    """The slots of each source in a period of sum(shares) slots."""
    slots: list[list[int]] = [[] for _ in shares]
    for i, _, _, _, t, _, _ in edf_runs([(a, a, 1) for a in shares]):
        slots[i].append(t)
    return slots


def plan_rows(groups: list[tuple[int, int, int]], block_rows: int) -> Iterator[tuple[int, ...]]:
    """The runs of edf_runs as rows of _PLAN, cut at multiples of PIECE members. groups: (weight, rows of each member, members)."""
    row = 0
    for i, j, member, count, t, release, deadline in edf_runs([(w, -(-n // block_rows), m) for w, n, m in groups]):
        rows = min(block_rows, groups[i][1] - j * block_rows)
        while count:
            now = min(count, PIECE - member % PIECE)
            yield i, j, member, now, t, release, deadline, row, rows
            member, count, t, row = member + now, count - now, t + now, row + now * rows


def _plan_table(spark: SparkSession, groups: list[tuple[int, int, int]], block_rows: int) -> DataFrame:
    path, schema = new_path(spark, "plan"), pa.schema([(c, pa.int64()) for c in _PLAN])
    rows, more = plan_rows(groups, block_rows), True
    while more:
        held = [r for _, r in zip(range(HELD), rows, strict=False)]
        more = len(held) == HELD
        table = pa.table([pa.array(c, pa.int64()) for c in zip(*held, strict=True)] or [pa.array([], pa.int64())] * len(_PLAN), schema=schema)
        spark.createDataFrame(table).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(T.StructType([T.StructField(c, T.LongType()) for c in _PLAN])).parquet(path)


def range_bits(largest: int) -> int:
    """Leading bits of a hash that name its range, where the largest group has so many rows."""
    return max(RANGES.bit_length() - 1, (-(-largest // RANGE_ROWS) - 1).bit_length())


def _range(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def _before(rows: DataFrame, group: str) -> DataFrame:
    """(group, __r, __before): rows of the group in the hash ranges before each of its ranges."""
    own = Window.partitionBy(group).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(group, "__r").count().withColumn("__before", F.coalesce(F.sum("count").over(own), F.lit(0))).drop("count")


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    source: str = "source",
    key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    slots: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """docs with mix_block, mix_release, mix_deadline, mix_block_position and mix_position (all long).

    Each source's rows, in hash order of `key`, form blocks of block_rows; blocks get the Pfair
    windows of their source's exact weight and run earliest deadline first, one a slot. After every
    slot, each source is less than one block from its share, however long the input: no weight is
    rounded. When a source runs out, the others share its part in proportion to their weights, so
    every row gets a place. weights: target weight by source (others get the least given weight);
    by default row counts to the power of temperature. mix_position counts rows from 0 without
    gaps. slots: not used; there are no periods.

    Null sources are a source of their own, null keys hash alike; rows that tie on hash and key
    take the tied places in any order. Repeated rows get a place each, an empty table stays
    empty, and columns with the names above are replaced. There may be any number of sources: those
    of equal weight and rows are planned as one kind, and the plan is a table that rows are joined to.
    """
    spark = docs.sparkSession
    added = ("mix_block", "mix_release", "mix_deadline", "mix_block_position", "mix_position")
    own = ("__s", "__h", "__r", "__n", "__m", "__w", "__k", "__range", "__before", *_PLAN[:1], *_PLAN[2:5], *_PLAN[7:])
    docs = docs.drop(*added, *own)
    sizes = docs.groupBy(F.col(source).alias("__s")).agg(F.count("*").alias("__n"))
    if weights:
        given = F.from_json(F.lit(json.dumps([{"s": s, "w": float(w)} for s, w in weights.items()])), T.ArrayType(T.StructType([T.StructField("s", docs.schema[source].dataType), T.StructField("w", T.DoubleType())])))
        named = spark.range(1).select(F.explode(given).alias("x")).select(F.col("x.s").alias("__name"), F.col("x.w").alias("__w"))
        sizes = sizes.join(F.broadcast(named), F.col("__s").eqNullSafe(F.col("__name")), "left").select("__s", "__n", F.coalesce("__w", F.lit(float(min(weights.values())))).alias("__w"))
    else:
        sizes = sizes.withColumn("__w", F.lit(1.0))
    sizes = materialize(sizes, "sources")
    kinds = sizes.groupBy("__n", "__w").count().orderBy("__n", "__w").collect()
    whole = whole_weights([r["__w"] if weights else float(r["__n"]) ** temperature for r in kinds])
    plan = _plan_table(spark, [(w, r["__n"], r["count"]) for w, r in zip(whole, kinds, strict=True)], block_rows)

    listed = pa.table({"__g": pa.array(range(len(kinds)), pa.int64()), "__n": pa.array([r["__n"] for r in kinds], pa.int64()), "__w": pa.array([r["__w"] for r in kinds], pa.float64())})
    sized = sizes.join(spark.createDataFrame(listed), ["__n", "__w"]).select("__s", "__g", F.xxhash64(F.lit(seed), "__s").alias("__h"))
    sized = sized.withColumn("__r", _range(F.col("__h"), range_bits(max((r["count"] for r in kinds), default=0))))
    member = F.col("__before") + F.row_number().over(Window.partitionBy("__g", "__r").orderBy("__h", "__s")) - 1
    sized = sized.join(_before(sized, "__g"), ["__g", "__r"]).select(F.col("__s").alias("__name"), "__g", member.alias("__m"))

    hashed = F.xxhash64(F.lit(seed), F.col(key))
    bits = range_bits(max((r["__n"] for r in kinds), default=0))
    before = _before(docs.select(F.col(source).alias("__s"), _range(hashed, bits).alias("__r")), "__s")
    before = before.join(sized, F.col("__s").eqNullSafe(F.col("__name"))).select("__s", F.col("__r").alias("__range"), "__before", "__g", "__m")
    docs = docs.withColumn("__h", hashed).withColumn("__r", _range(F.col("__h"), bits))
    ranked = docs.join(before, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__r") == F.col("__range"))).withColumn(
        "__n", F.col("__before") + F.row_number().over(Window.partitionBy("__s", "__r").orderBy("__h", key)) - 1
    )
    ranked = ranked.withColumn("mix_block", F.floor(F.col("__n") / block_rows).cast("long")).withColumn("__k", F.floor(F.col("__m") / PIECE))
    at = F.col("__m") - F.col("__from")
    inside = (at >= 0) & (at < F.col("__count"))
    return (
        ranked.join(plan.withColumnsRenamed({"__g": "__pg", "mix_block": "__pb"}).withColumn("__pk", F.floor(F.col("__from") / PIECE)),
            (F.col("__g") == F.col("__pg")) & (F.col("mix_block") == F.col("__pb")) & (F.col("__k") == F.col("__pk")) & inside)
        .withColumn("mix_block_position", F.col("__at") + at)
        .withColumn("mix_position", F.col("__row") + at * F.col("__rows") + F.pmod("__n", F.lit(block_rows)))
        .drop(*own, "__pg", "__pb", "__pk")
        .select(*(c for c in docs.columns if c not in own), *added)
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_block_position", "mix_position")
