"""Connected components, and streams of sorted rows by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node that has an edge (a, b) to another.

    Alternating large-star and small-star rounds; each round is a table in the shared folder, and
    only a count and a checksum come to the driver. Hot nodes meet partial aggregates and joins
    that can be split, never one task's list of neighbours.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = None
    while True:
        check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == before or not check[0]:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("root"))).distinct()
        before = check
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialize(small.where("a > b").distinct(), "edges", instead=now)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal integer keys, from batches that come sorted by them."""
    held: list[pa.Table] = []

    def key_of(table: pa.Table, row: int) -> tuple:
        return tuple(table.column(k)[row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            part = table.slice(a, b - a)
            if held and key_of(held[0], 0) != key_of(part, 0):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)
