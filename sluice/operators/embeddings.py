"""A content-addressed cache of embeddings: each text's vector is made once, whichever rows and runs have it.

The cache is a folder of runs that are only ever added; of a text that several runs have, the latest
counts. A null vector is a model's failure: it is kept, and asked for again unless that is turned off.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an entry: the model's signature, the text's SHA-256 and its vector of length one.
SCHEMA = "sig string, sha string, vector array<double>"
Model = Callable[[list[str]], Sequence[Sequence[float] | None]]


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def runs(spark: SparkSession, path: str) -> list[str]:
    """The cache's runs, the oldest first; a cache that isn't there yet has none."""
    where, fs = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n.removeprefix("run=") for n in names if n.startswith("run="))


def entries(spark: SparkSession, path: str, upto: list[str] | None = None) -> DataFrame:
    """sig, sha, vector, run: the latest entry of each text and model, null vectors too; upto: the runs that count, all by default."""
    known = runs(spark, path) if upto is None else upto
    if not known:
        return spark.createDataFrame([], SCHEMA + ", run string")
    rows = spark.read.schema(SCHEMA + ", run string").option("basePath", path).parquet(*(f"{path}/run={r}" for r in known))
    return rows.groupBy("sig", "sha").agg(F.max_by(F.struct("vector", "run"), "run").alias("e")).select("sig", "sha", "e.vector", "e.run")


def normalized(vector: Sequence[float] | None) -> list[float] | None:
    """vector at length one; None for none, an empty one, one of zeros or one with a component that isn't finite."""
    if vector is None or not len(vector):
        return None
    v = np.asarray(vector, float)
    length = float(np.sqrt((v * v).sum()))
    return (v / length).tolist() if length > 0 and np.isfinite(length) else None


def _embed(model: Model, texts: list[str]) -> list[list[float] | None]:
    try:
        made = list(model(texts))
    except Exception:  # noqa: BLE001 - models raise errors of any kind
        made = []
    if len(made) != len(texts):
        made = [None] * len(texts)
    return [normalized(v) for v in made]


def embedded(texts: DataFrame, path: str, sig: str, model: Model, key: str = "pos", text: str = "text", retry: bool = True) -> DataFrame:
    """(key, sha, vector, cached) of all texts: from the cache where it has them, else made now, each different text once, and kept.

    cached: whether the vector, or with retry off the failure, was there before. model gives vectors
    for a batch of texts, None for one it can't embed; if it raises, the whole batch has failed. It runs
    on executors. Null texts have no vector and aren't asked for. Writes before it returns.
    """
    spark, run = texts.sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    before = runs(spark, path)
    rows = texts.select(key, F.col(text).alias("text"), F.sha2(F.col(text), 256).alias("sha"))
    known = entries(spark, path, before).where(F.col("sig") == sig)
    known = (known.where("vector is not null") if retry else known).select("sha", "vector")
    missing = rows.where("sha is not null").join(known.select("sha"), "sha", "left_anti").groupBy("sha").agg(F.any_value("text").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array(_embed(model, batch.column(1).to_pylist()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([sig] * batch.num_rows, pa.string()), batch.column(0), vectors], ["sig", "sha", "vector"])

    missing.mapInArrow(make, SCHEMA).write.parquet(f"{path}/run={run}")
    new = entries(spark, path, [run]).select("sha", "vector", F.lit(False).alias("cached"))
    both = known.withColumn("cached", F.lit(True)).unionByName(new)
    return rows.drop("text").join(both, "sha", "left").select(key, "sha", "vector", F.coalesce("cached", F.lit(False)).alias("cached"))


def compact(spark: SparkSession, path: str) -> str:
    """Replaces the cache's runs by one that holds the latest entries, and returns it.

    The new run is whole before the old ones go, so a reader or a crash in between finds every entry.
    It takes the name of the latest run that it holds, so runs that are added meanwhile stay later.
    """
    old = runs(spark, path)
    if not old:
        return ""
    run = f"{old[-1]}+"
    entries(spark, path, old).drop("run").write.mode("overwrite").parquet(f"{path}/run={run}")
    for name in old:
        where, fs = _fs(spark, f"{path}/run={name}")
        fs.delete(where, True)
    return run
