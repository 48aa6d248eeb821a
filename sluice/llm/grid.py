"""A stated set of askers against all rows, block by block."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_blocks(asked: DataFrame, held: DataFrame, task: Callable[[pa.Table, pa.Table], pa.Table], schema: str, keys: tuple[str, str], sizes: tuple[int, int]) -> DataFrame:
    """The rows that task makes of each block of askers and each block of held rows, of about `sizes` rows.

    Both sides are dealt by the hash of a key that tells rows apart, so a block has a like share
    whatever the rows hold; a task has one block of each, and gives a pre-aggregate of their pairs.
    """
    ours, theirs = (max(1, -(-df.count() // size)) for df, size in zip((asked, held), sizes, strict=True))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.toDF(*asked.columns)  # columns of its own, if both come from one table
    left = asked.select("*", deal(keys[0], ours).alias("__a"), every(theirs).alias("__b"))
    right = held.select("*", every(ours).alias("__a"), deal(keys[1], theirs).alias("__b"))
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = task(a, b) if a.num_rows and b.num_rows else None
        return pa.table({n: pa.array([], pa.int64()) for n in names}) if out is None else out

    return left.groupBy("__a", "__b").cogroup(right.groupBy("__a", "__b")).applyInArrow(run, schema)
