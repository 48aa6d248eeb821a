"""Approximate retrieval by an inverted file: rows are dealt over cells, and a query looks into the nearest.

The cells' centres are fitted on a bounded sample; every row is in the file. A cell of any size, also one
that holds a third of all rows, is read in blocks, so no task has more than a block of each side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sluice.operators import retrieval as V
from sluice.sources import stored

#: Rows that centres are fitted on, and cells, at most; rounds of the fit.
SAMPLE, CELLS, ROUNDS = 20_000, 1024, 12
#: Share of the sample's nearest neighbours that lie in the cells looked into, of so many of its rows, and neighbours of each.
TARGET, TRIED, NEIGHBOURS = 0.97, 512, 10


@dataclass
class Index:
    """file: every row with a vector and its cell, in the shared folder; the cells' centres; and the cells that a query looks into."""

    file: DataFrame
    centres: np.ndarray
    probes: int


def fit(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of length one, by rounds of assignment to the most similar and of averaging; an empty cell takes the worst placed row."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].astype(float)
    for _ in range(ROUNDS):
        sims = sample @ centres.T
        own, best = sims.argmax(axis=1), sims.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, target: float = TARGET) -> int:
    """The least number of nearest cells that hold a share `target` of the neighbours that TRIED of the sample's rows have in it."""
    asked = sample[:TRIED]
    sims = asked @ sample.T
    np.fill_diagonal(sims, -np.inf)
    found = np.argsort(-sims, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(sample) - 1)]
    if not found.size:
        return 1
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in a row's order
    own = (sample @ centres.T).argmax(axis=1)
    return int(np.sort(np.take_along_axis(place, own[found], axis=1).ravel())[int(np.ceil(target * found.size)) - 1]) + 1


def nearest(rows: DataFrame, centres: np.ndarray, count: int) -> DataFrame:
    """rows with cells: the numbers of the `count` most similar centres of each vector, the best first."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # CELLS rows at most
    kind = T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = V._vectors(pa.chunked_array([batch.column(batch.schema.get_field_index("vector"))])) if batch.num_rows else np.zeros((0, sent.value.shape[1]))
            order = np.argsort(-(v @ sent.value.T), axis=1, kind="stable")[:, :count].astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return rows.mapInArrow(run, kind)


def build(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> Index:
    """The inverted file of corpus (pos, vector, source); rows without a vector are left out.

    Centres are fitted on `sample` rows at most, those of the least hash of pos; there are about as
    many as the root of the rows, CELLS at most. Vectors that fall into clusters need few probes, and
    others many: their number is measured on the sample, for a share `target` of neighbours to be found.
    """
    corpus = corpus.where("vector is not null")
    rows = corpus.count()
    if not rows:
        return Index(stored(corpus.withColumn("cell", F.lit(0)), "file"), np.zeros((1, 1)), 1)
    chosen = V._vectors(corpus.orderBy(F.xxhash64("pos"), "pos").limit(sample).select("vector").toArrow().column("vector"))  # `sample` vectors
    centres = fit(chosen, cells or min(CELLS, max(1, round(rows**0.5))))
    file = stored(nearest(corpus, centres, 1).withColumn("cell", F.get("cells", F.lit(0))).drop("cells"), "file")
    return Index(file, centres, probes_for(chosen, centres, target))


def top_k(queries: DataFrame, index: Index, k: int, probes: int | None = None, leave_out: bool = False) -> DataFrame:
    """(q, pos, sim, rank) as retrieval.top_k gives, of the rows in the `probes` cells nearest to each query: by default the index's.

    With as many probes as cells the result is exact.
    """
    file, centres = index.file, index.centres
    probes = min(len(centres), probes or index.probes)
    asked = queries.where("vector is not null").select("q", "vector", "q_source")
    looking = stored(nearest(asked, centres, probes).withColumn("cell", F.explode("cells")).drop("cells"), "looking") if file.limit(1).count() else asked.withColumn("cell", F.lit(0))
    sizes = [(df.groupBy("cell").agg(F.ceil(F.count("*") / size).alias(name))) for df, name, size in ((looking, "qbs", V.QUERY_BLOCK), (file, "pbs", V.PASSAGE_BLOCK))]
    blocks = F.broadcast(stored(sizes[0].join(sizes[1], "cell"), "blocks"))  # a row a cell, CELLS at most
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = looking.join(blocks, "cell").select("q", "vector", "q_source", "cell", F.expr("pmod(xxhash64(q), qbs)").alias("qb"), every("pbs").alias("pb"))
    right = file.join(blocks, "cell").select("pos", "vector", "source", "cell", every("qbs").alias("qb"), F.expr("pmod(xxhash64(pos), pbs)").alias("pb"))
    keys = ("cell", "qb", "pb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: V._best(a, b, k, leave_out) if a.num_rows and b.num_rows else V._NONE, V._FOUND)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "pos")  # k rows a block
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, wanted, hits, recall: the share of the exact result's (q, pos) that was found."""
    both = exact.select("q", "pos").join(found.select("q", "pos").withColumn("hit", F.lit(1)), ["q", "pos"], "left")
    return both.agg(F.countDistinct("q").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
